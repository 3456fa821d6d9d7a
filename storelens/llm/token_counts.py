"""Token counts: byte-pair merging with a heap and a linked list; no identifiers are made.

The vocabulary is a ``tokenizers`` JSON file of the kind "byte-level BPE with word ends" (others are refused): NFC,
white space runs to one space, lower case; the file's pattern cuts words; each word starts as its bytes, the last one marked as
the word's end. The count of a word is its initial symbols minus the merges made.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); special strings in a text count one token
each, as the library does by default; whole texts are read; rows are not deduplicated; other columns of
``docs`` are ignored whatever their names.
"""

from __future__ import annotations

import heapq
import json
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer
from tokenizers.pre_tokenizers import Split

from .base import WordMemo, batches, claim, column, slim

WORD_END = "</w>"


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    names, spare = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in names:
            names[b], spare = chr(spare), spare + 1
    return [names[b] for b in range(256)]


class Merger:
    """Counts the tokens of one word."""

    def __init__(self, spec: dict):
        model = spec["model"]
        ids = {s: i for i, s in enumerate(model["vocab"])}
        signs = byte_symbols()
        self.inner = [ids.setdefault(s, len(ids)) for s in signs]
        self.last = [ids.setdefault(s + WORD_END, len(ids)) for s in signs]
        self.pairs = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[ids[a], ids[b]] = rank, ids[a + b]

    def count(self, word: str) -> int:
        raw, pairs = word.encode(), self.pairs
        symbols = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        n = len(symbols)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*found, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (found := pairs.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, joined, i, a, b = heapq.heappop(heap)
            j = right[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # one of the two has merged with another neighbour meanwhile
            symbols[i], symbols[j] = joined, -1
            right[i] = k = right[j]
            merges += 1
            if k < n:
                left[k] = i
                if found := pairs.get((joined, symbols[k])):
                    heapq.heappush(heap, (*found, i, joined, symbols[k]))
            if (h := left[i]) >= 0 and (found := pairs.get((symbols[h], joined))):
                heapq.heappush(heap, (*found, h, symbols[h], joined))
        return n - merges


#: The parts of a file that this operator follows, beside its pattern, vocabulary and merges.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
CUT = {"type": "Split", "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": WORD_END, "byte_fallback": False, "ignore_merges": False}
ADDED = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}


def check(spec: dict) -> None:
    """Refuse a file of another kind, whose counts would not be the library's."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    same = spec.get("normalizer") == NORMALIZER and len(steps) == 2 and steps[1] == BYTES and spec.get("post_processor") is None
    same = same and {k: steps[0].get(k) for k in CUT} == CUT and {k: spec["model"].get(k) for k in MODEL} == MODEL
    if not same or any({k: t.get(k) for k in ADDED} != ADDED for t in spec["added_tokens"]):
        raise ValueError("not a byte-level BPE file with word ends, NFC, single spaces and lower case")


#: Characters whose classes no version of Unicode has changed for long: Latin, Greek, Cyrillic, Devanagari letters, kana, Han, Hangul.
SETTLED = regex.compile(r"[\x00-\u024F\u0386-\u03FF\u0400-\u052F\u0904-\u0939\u1E00-\u1EFF\u2010-\u2027\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FA5\uAC00-\uD7A3]*")


class Counter:
    """Counts the tokens of whole texts by one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        check(spec)
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special)) or r"(?!)")
        self.memo = WordMemo(Merger(spec).count, 400_000)
        # the file's own steps, as Python's tables are of another version of Unicode than the library's
        self.prepare = Tokenizer.from_file(path).normalizer.normalize_str
        self.split = Split(Regex(self.words.pattern), "removed", invert=True).pre_tokenize_str

    def plain(self, text: str) -> int:
        text = text.lower() if text.isascii() else self.prepare(text)
        found = self.words.findall(text) if SETTLED.fullmatch(text) else [w for w, _ in self.split(text)]
        return sum(map(self.memo.__getitem__, found))

    def count(self, text: str) -> int:
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


@cache
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs`` (doc_id, text)."""
    path = path or vocabulary_path()

    def run(source):
        claim("token counts", counter.cache_clear)
        count = counter(path).count
        for batch in batches(source):
            texts = column(batch, "text").to_pylist()
            n = [count(t) if t else 0 for t in texts]
            size = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return slim(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
