"""SentencePiece encoding and decoding with a batched numpy Viterbi.

Texts are cut into words at the space mark; equally long words advance together through the lattice of
pieces, one character a step. For a unigram file the score of a path is the sum of its pieces' scores. For a
byte-pair file a path's score is minus infinity unless each two neighbouring pieces stay apart under the
file's merges; exactly one path of a word then has a finite score, and it is the library's result. Either way
a vectorised maximum over the pieces that end at a character stores the back-pointers.

Defined cases: null and empty texts give no pieces (null decodes to the empty text); characters outside the
vocabulary fall back to byte pieces; whole texts are encoded; repeated rows give repeated results; extra
columns are ignored by the operator. Special strings such as ``<s>`` in a text are ordinary text.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import LONGEST, MOST_LETTERS, batches, claim, column, slim
from .lattice import PieceTable

SPACE = "▁"
NEVER = -np.inf


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Joins:
    """Whether two neighbouring pieces of a byte-pair file stay apart, by (left, right), remembered.

    Merges happen in the order of the pieces' ranks. While a piece is built, its outer symbol at a border is
    one of a chain; each link lives from its own rank to that of the next. Two neighbours would have merged
    across the border if some pair of links that live at one time makes a piece of a rank before either ends.
    """

    def __init__(self, pieces: dict[str, int], rank: dict[int, float]):
        self.pieces, self.rank, self.n = pieces, rank, max(pieces.values()) + 1
        self.memo: dict[int, bool] = {}
        self.chains: dict[tuple[int, bool], list] = {}
        self.text = {i: p for p, i in pieces.items()}

    def merge(self, text: str) -> tuple[list[str], list[list[str]], list[list[str]]]:
        """Merge one short text by rank; also the chains of its first and its last symbol."""
        parts, first, last = list(text), [text[0]], [text[-1]]
        while True:
            ranks = [(self.rank[k], i) for i in range(len(parts) - 1) if (k := self.pieces.get(parts[i] + parts[i + 1])) is not None]
            if not ranks:
                return parts, first, last
            i = min(ranks)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if i == 0:
                first.append(parts[0])
            if i == len(parts) - 1:
                last.append(parts[-1])

    def chain(self, piece: int, right: bool) -> list[tuple[str, float, float]]:
        """The outer symbols at the right (or left) border: text, from rank, to rank."""
        if (key := (piece, right)) not in self.chains:
            _, first, last = self.merge(self.text[piece])
            links = last if right else first
            ranks = [NEVER, *(self.rank[self.pieces[x]] for x in links[1:]), np.inf]
            self.chains[key] = [(x, ranks[k], ranks[k + 1]) for k, x in enumerate(links)]
        return self.chains[key]

    def apart(self, left: int, right: int) -> bool:
        pieces, rank = self.pieces, self.rank
        for a, _, a_end in self.chain(left, True):
            for b, _, b_end in self.chain(right, False):
                if (k := pieces.get(a + b)) is not None and rank[k] < a_end and rank[k] <= b_end:
                    return False
        return True

    def known(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pairs, where = np.unique(left.astype(np.int64) * self.n + right, return_inverse=True)
        if len(self.memo) > 600_000:
            self.memo.clear()
        out, memo = np.empty(len(pairs), bool), self.memo
        for k, pair in enumerate(pairs.tolist()):
            if (x := memo.get(pair)) is None:
                x = memo[pair] = self.apart(*divmod(pair, self.n))
            out[k] = x
        return out[where]


class Pieces:
    """Encodes and decodes by one model file."""

    def __init__(self, path: str, kind: str = "bpe", most: int = 200_000):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        size = p.get_piece_size()
        self.bytes = {int(p.id_to_piece(i)[3:5], 16): i for i in range(size) if p.is_byte(i)}
        self.unknown = p.unk_id()
        usual = [i for i in range(size) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        self.ids = np.array(usual)
        names = [p.id_to_piece(i) for i in usual]
        self.score = np.array([p.get_score(i) for i in usual])
        self.table = PieceTable(names)
        self.joins = Joins({x: k for k, x in enumerate(names)}, {k: -float(s) for k, s in enumerate(self.score)}) if kind == "bpe" else None
        self.single = {x for x in names if len(x) == 1}
        self.memo: dict[str, bytes] = {}
        self.most, self.letters = most, 0
        # where no piece has two such neighbours, a text can be cut between them without changing its pieces
        if any(SPACE in x.lstrip(SPACE) for x in names):
            raise ValueError("pieces across words are not supported")
        signs = "".join(sorted(x for x in self.single if x.isalnum() and not x.isalpha() and not x.isdecimal()))
        letter, other = rf"[^\W\d_{signs}]", rf"[\W\d_{signs}]"
        mixed = re.compile(f"{letter}(?!{SPACE}){other}|(?!{SPACE}){other}{letter}")
        if any(mixed.search(x) for x in names):
            self.cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        else:
            self.cut = re.compile(f"{SPACE}*{letter}+|{SPACE}*(?:(?!{SPACE}){other})+|{SPACE}+")
        raw = [b""] * size
        for i, x in zip(usual, names, strict=True):
            raw[i] = x.replace(SPACE, " ").encode()
        for b, i in self.bytes.items():
            raw[i] = bytes([b])
        self.raw = raw

    def viterbi(self, words: list[str]) -> list[np.ndarray]:
        """Piece indices of words that hold no stranger."""
        out: list = [None] * len(words)
        for at, points in self.table.groups(words):
            n, size = points.shape
            found = self.table.matches(points)
            best = np.full((n, size + 1), NEVER)
            best[:, 0] = 0
            back, last = np.zeros((n, size + 1), np.int32), np.full((n, size + 1), -1, np.int32)
            for end in range(1, size + 1):
                for length in range(1, min(end, len(found)) + 1):
                    piece = found[length - 1][:, end - length]
                    rows = np.flatnonzero((piece >= 0) & (best[:, end - length] > NEVER))
                    if not len(rows):
                        continue
                    if self.joins:
                        before = last[rows, end - length]
                        if end > length:
                            rows = rows[self.joins.known(before, piece[rows])]
                        value = np.zeros(len(rows))
                    else:
                        value = best[rows, end - length] + self.score[piece[rows]]
                    better = value > best[rows, end]
                    rows = rows[better]
                    best[rows, end], back[rows, end], last[rows, end] = value[better], length, piece[rows]
            rows, ends = np.arange(n), np.full(n, size)
            steps = []
            while (ends > 0).any():
                steps.append(np.where(ends > 0, last[rows, ends], -1))
                ends = ends - back[rows, ends]
            path = np.stack(steps[::-1], 1)
            for k, i in enumerate(at):
                out[i] = path[k][path[k] >= 0]
        return out

    def learn(self, words: list[str]) -> None:
        """Encode words that the memo lacks."""
        plain, odd = [], []
        for w in words:
            (plain if self.single.issuperset(w) else odd).append(w)
        parts = [self._runs(w) for w in odd]
        inner = list({x for p in parts for x, known in p if known})
        paths = self.viterbi(plain + inner)
        for w, p in zip(plain, paths, strict=False):
            self.memo[w] = self.ids[p].astype("<i4").tobytes()
        by = dict(zip(inner, paths[len(plain) :], strict=True))
        for w, p in zip(odd, parts, strict=True):
            ids = [self.ids[by[x]] if known else np.array([self.bytes.get(b, self.unknown) for b in x.encode()]) for x, known in p]
            self.memo[w] = np.concatenate(ids).astype("<i4").tobytes()

    def _runs(self, word: str) -> list[tuple[str, bool]]:
        """Cut into characters of the vocabulary and strangers."""
        return [("".join(run), known) for known, run in groupby(word, self.single.__contains__)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.cut.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.memo) > self.most or self.letters > MOST_LETTERS:
            self.memo.clear()
            self.letters = 0
        if new := list({w for words in cut for w in words}.difference(self.memo)):
            self.learn(new)
        memo = self.memo
        out = [np.frombuffer(b"".join(map(memo.__getitem__, words)), "<i4") for words in cut]
        for w in new:
            if len(w) > LONGEST:
                del memo[w]
            else:
                self.letters += len(w)
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.raw.__getitem__, ids.tolist())).decode(errors="replace").removeprefix(" ")


@cache
def pieces(path: str, kind: str) -> Pieces:
    return Pieces(path, kind)


def lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.empty(0, np.int32)]).astype(np.int32)))


def encode(docs: DataFrame, path: str | None = None, kind: str = "bpe") -> DataFrame:
    """``doc_id, n_pieces, ids`` of every row of ``docs`` (doc_id, text)."""
    path = path or model_path()

    def run(source):
        claim("pieces", pieces.cache_clear)
        coder = pieces(path, kind)
        for batch in batches(source, 4 << 20):
            ids = coder.encode([t or "" for t in column(batch, "text").to_pylist()])
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array([len(x) for x in ids], pa.int64()), lists(ids)], ["doc_id", "n_pieces", "ids"])

    return slim(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_pieces long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, kind: str = "bpe") -> DataFrame:
    """``doc_id, text`` back from ``ids``: each text exactly, for texts that were valid UTF-8."""
    path = path or model_path()

    def run(source):
        claim("pieces", pieces.cache_clear)
        coder = pieces(path, kind)
        for batch in batches(source, 4 << 20):
            texts = [coder.decode(np.array(x or [], np.int32)) for x in column(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return slim(encoded, "doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_checked(docs: DataFrame, path: str | None = None, kind: str = "bpe") -> DataFrame:
    """``encode`` plus the round trip: ``decoded_sha256`` of the decoded text, ``lossless`` against the text."""
    path = path or model_path()

    def run(source):
        claim("pieces", pieces.cache_clear)
        coder = pieces(path, kind)
        for batch in batches(source, 4 << 20):
            texts = [t or "" for t in column(batch, "text").to_pylist()]
            ids = coder.encode(texts)
            back = [coder.decode(x) for x in ids]
            digests = [hashlib.sha256(t.encode()).hexdigest() for t in back]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array([len(x) for x in ids], pa.int64()), lists(ids), pa.array(digests), pa.array([a == b for a, b in zip(texts, back, strict=True)])], ["doc_id", "n_pieces", "ids", "decoded_sha256", "lossless"])

    return slim(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_pieces long, ids array<int>, decoded_sha256 string, lossless boolean")
