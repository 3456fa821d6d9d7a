"""Language ID by segmentation-marginalised unigrams over a fixed public piece vocabulary.

For each language every vocabulary piece has a probability: the smoothed share of its occurrences in the
training words of that language. A word's likelihood is the sum over all its segmentations into pieces, by
the forward algorithm in numpy (equally long words advance together). A text's likelihood is the product over its
words, and the prediction is the language under which it is greatest. The score is the posterior of that language
by the geometric mean of the words' likelihoods, under equal priors, so that it tells short texts from clear ones.

A word is a letter (Unicode category L) with the letters and marks (category M) behind it. Training reads only text
and the language column of the rows it is given; ``per_language`` bounds the sample of each language and is a documented
parameter of the fit; there is no bound on the languages. Every row is then scored over its whole text, by ``SLICE``
languages at a time, so that a worker never holds the probabilities of more.

Defined cases: null texts and texts without a letter get ``und`` with score 0; ties go to the first language
in alphabetical order; rows whose language is null are not learned from; without any training row every text
is ``und``; repeated rows give repeated results; rows without an id are scored like others; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import MOST_LETTERS, batches, claim, column, slim, stash
from .lattice import PieceTable
from .sentence_pieces import SPACE, model_path

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
PIECE = regex.compile(r"[\p{L}\p{M}]+")
UNDETERMINED = "und"


@cache
def vocabulary(path: str) -> tuple[PieceTable, int]:
    """All lower-case pieces of letters and marks, with or without the space mark, and the mark itself."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    names = {p.id_to_piece(i).lower() for i in range(p.get_piece_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i))}
    usual = sorted(x for x in names if x == SPACE or PIECE.fullmatch(x.removeprefix(SPACE)))
    return PieceTable(usual), len(usual)


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def piece_counts(found: Counter, path: str) -> np.ndarray:
    """Occurrences of every piece in counted words."""
    pieces, size = vocabulary(path)
    out, names = np.zeros(size), [SPACE + w for w in found]
    weight = np.fromiter(found.values(), np.float64, len(found))
    for at, points in pieces.groups(names):
        for hit in pieces.matches(points):
            rows, starts = np.nonzero(hit >= 0)
            out += np.bincount(hit[rows, starts], weight[at][rows], size)
    return out


def sampled(rows: DataFrame, per_language: int, few: int = 100_000) -> DataFrame:
    """``lang, text`` of about ``per_language`` rows of each language, chosen by a hash of doc_id."""
    share = stash(rows.groupBy("lang").count().select("lang", F.least(F.lit(1.0), per_language / F.col("count")).alias("share")))
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    least = share.agg(F.max("share")).first()[0]
    rows = rows.where(chance < (least or 0.0) * (1 << 20))  # rows that no language takes go before the join
    joined = rows.join(F.broadcast(share) if share.count() <= few else share, "lang")
    return joined.where(chance < F.col("share") * (1 << 20)).select("lang", "text")


#: A model: the languages in alphabetical order, and for each those of its pieces that were seen, with their counts.
Model = tuple[list[str], list[tuple[np.ndarray, np.ndarray]]]


def train(labelled: DataFrame, per_language: int = 4000, path: str | None = None) -> Model:
    """The languages of ``labelled`` (doc_id, text, lang) and the counts of their pieces.

    A language with more than ``per_language`` rows gives a share of them. The result's size is languages x vocabulary at
    most, whatever the input.
    """
    path = path or model_path()
    rows = slim(labelled, "doc_id", "text", "lang").where("lang is not null and text is not null")

    def run(source):
        found: dict[str, Counter] = {}
        for batch in batches(source):
            for lang, text in zip(column(batch, "lang").to_pylist(), column(batch, "text").to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(words(text))
        for lang, counts in found.items():
            n = piece_counts(counts, path)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array([-1, *at]), pa.array([0.0, *n[at]])], ["lang", "piece", "n"])

    counted = sampled(rows, per_language).mapInArrow(run, "lang string, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
    counted = counted.sort_by([("lang", "ascending"), ("piece", "ascending")])
    lang, piece, n = counted["lang"].to_pylist(), counted["piece"].to_numpy(), counted["n"].to_numpy()
    starts = np.flatnonzero(piece == -1)  # one for each language, even if it has no piece
    ends = np.r_[starts[1:], len(piece)][: len(starts)]
    return [lang[k] for k in starts], [(piece[a + 1 : b], n[a + 1 : b]) for a, b in zip(starts, ends, strict=True)]


def probabilities(counts: list[tuple[np.ndarray, np.ndarray]], size: int, smoothing: float = 0.5) -> np.ndarray:
    """Log-probabilities (language x piece)."""
    n = np.full((len(counts), size), smoothing)
    for row, (piece, count) in zip(n, counts, strict=True):
        row[piece] += count
    return np.log(n / n.sum(1, keepdims=True))


class Scorer:
    """Likelihoods of words in each language, remembered within a Python worker."""

    def __init__(self, model: np.ndarray, path: str, most: int = 200_000):
        self.pieces, size = vocabulary(path)
        self.chance = np.exp(model).T.copy()
        self.stranger = self.chance.min(0) / 10  # a character outside the vocabulary
        self.memo: dict[str, int] = {}
        self.values = np.empty((0, model.shape[0]))
        self.most, self.letters = min(most, (1 << 27) // (8 * len(model))), 0

    def forward(self, names: list[str]) -> np.ndarray:
        """Log-likelihood of each word by language: the sum over all its segmentations."""
        languages = self.chance.shape[1]
        out = np.empty((len(names), languages))
        for at, points in self.pieces.groups(names, max(2000, 400_000 // languages)):
            n, size = points.shape
            found = self.pieces.matches(points)
            behind, scale = [np.ones((n, languages))], np.zeros((n, languages))  # sums up to the last few characters
            for end in range(1, size + 1):
                now = np.zeros((n, languages))
                for length in range(1, len(behind) + 1):
                    piece = found[length - 1][:, end - length]
                    rows = np.flatnonzero(piece >= 0)
                    if len(rows):
                        now[rows] += behind[-length][rows] * self.chance[piece[rows]]
                lone = np.flatnonzero(found[0][:, end - 1] < 0)
                now[lone] += behind[-1][lone] * self.stranger
                behind = [*behind, now][-len(found) :]
                if end % 16 == 0:  # keep long words within the range of a double
                    top = now + (now == 0)
                    behind = [x / top for x in behind]
                    scale += np.log(top)
            out[at] = np.log(behind[-1]) + scale
        return out

    def score(self, texts: list[list[str]]) -> np.ndarray:
        """The mean log-likelihood of each list of words; zeros for none."""
        if len(self.memo) > self.most or self.letters > MOST_LETTERS:
            self.memo, self.values, self.letters = {}, self.values[:0], 0
        if new := list({w for t in texts for w in t}.difference(self.memo)):
            self.letters += sum(map(len, new))
            self.memo.update(zip(new, range(len(self.values), len(self.values) + len(new)), strict=True))
            self.values = np.concatenate([self.values, self.forward([SPACE + w for w in new])])
        out = np.zeros((len(texts), self.values.shape[1]))
        for k, t in enumerate(texts):
            if t:
                out[k] = self.values[np.fromiter(map(self.memo.__getitem__, t), np.int64, len(t))].mean(0)
        return out


_scorers: dict[str, Scorer] = {}

#: So many languages are scored at a time.
SLICE = 128


def _best(docs: DataFrame, model: Model, path: str | None, each: int) -> tuple[DataFrame, str, str]:
    """``docs`` with two more columns, whose names are given back: the best language and its score.

    Slices of the languages follow each other as steps over the same rows. A step has a worker, a model and a memo of its
    own, and hands on the best language so far, its mean log-likelihood, and the sum of all likelihoods relative to it.
    """
    path = path or model_path()
    names, counts = model
    label, mean, total = (f"{x} {uuid.uuid4().hex}" for x in ("label", "mean", "total"))
    docs = docs.withColumns({label: F.lit(UNDETERMINED), mean: F.lit(float("-inf")), total: F.lit(0.0)})
    for at in range(0, len(names), each):
        some = names[at : at + each]
        shared = docs.sparkSession.sparkContext.broadcast(probabilities(counts[at : at + each], vocabulary(path)[1]).astype(np.float32))
        docs = docs.mapInArrow(_step(some, shared, path, (label, mean, total)), docs.schema)
    return docs.withColumn(total, F.when(F.col(total) > 0, 1 / F.col(total)).otherwise(0.0)).drop(mean), label, total


def _step(names: list[str], shared, path: str, columns: tuple[str, str, str]):
    key = uuid.uuid4().hex

    def run(source):
        claim("languages", _scorers.clear)
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(shared.value, path)
        scorer = _scorers[key]
        for batch in batches(source, 4 << 20):
            found = [words(t) for t in column(batch, "text").to_pylist()]
            likely = scorer.score(found)
            best = likely.argmax(1)
            labels, means, totals = (column(batch, x).to_pylist() for x in columns)
            for k, w in enumerate(found):
                if w:
                    top = max(here := float(likely[k, best[k]]), means[k])
                    totals[k] = float(np.exp(likely[k] - top).sum()) + totals[k] * float(np.exp(means[k] - top))
                    if here > means[k]:
                        labels[k], means[k] = names[best[k]], here
            new = dict(zip(columns, (pa.array(labels, pa.string()), pa.array(means, pa.float64()), pa.array(totals, pa.float64())), strict=True))
            yield pa.RecordBatch.from_arrays([new.get(x, y) for x, y in zip(batch.schema.names, batch.columns, strict=True)], batch.schema.names)

    return run


def predict(docs: DataFrame, model: Model, path: str | None = None, each: int = SLICE) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row of ``docs`` (doc_id, text)."""
    found, label, score = _best(slim(docs, "doc_id", "text"), model, path, each)
    return found.select("doc_id", F.col(label).alias("lang_pred"), F.col(score).alias("score"))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: the remainder of its id's CRC is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def identify(docs: DataFrame, per_language: int = 4000, path: str | None = None) -> DataFrame:
    """Learn from the labelled rows that are not held out; ``doc_id, held_out, lang_pred, score`` of all."""
    held = F.coalesce(held_out(docs["doc_id"]), F.lit(False))
    out = predict(docs, train(docs.where(~held), per_language, path), path)
    return out.select("doc_id", F.coalesce(held_out(out["doc_id"]), F.lit(False)).alias("held_out"), "lang_pred", "score")


def reject_unknown(docs: DataFrame, per_language: int = 4000, path: str | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, without those of undetermined language.

    The labels of the rows that are not held out train the model; without labels every text is undetermined.
    """
    held = F.coalesce(held_out(docs["doc_id"]), F.lit(False))
    found, label, score = _best(docs, train(docs.where(~held), per_language, path), path, SLICE)
    return found.where(F.col(label) != UNDETERMINED).drop(label, score)
