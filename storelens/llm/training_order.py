"""Token-ID output in training order.

Texts become token identifiers (two bytes each), and a text's identifiers are cut into sequences of a fixed length;
the last of a text is padded with the end-of-text identifier. Every sequence has a dense number; a keyed Feistel network
permutes the numbers, walking along the cycle until it falls below their count, and so gives every sequence a
global slot without a sort or a table of slots. Slots are cut into ranges of a fixed number; the sequences of a range
are one shard, whose bytes have a fixed stride. Slot s is at ``(s mod per_shard) * stride`` of shard
``s div per_shard``, so a reader goes on anywhere without an index. Shards are written by range: a file holds
neighbouring shards in their order. ``write_plain`` writes each shard's bytes as a file of its own, in which a reader seeks to
a slot (``read_plain``), so that it goes on in mid-shard without reading what is before.

Numbers follow the order of doc_id (rows without one first), then of a hash of the text's identifiers, then of the place
in the text: a sort by range over whole encoded texts, which does not depend on how the input is split. Rows that agree in all
of these are alike, so the same table gives the same shards whatever its partitions.

Defined cases: null and empty texts give no sequence; special strings in texts are ordinary text; repeated
rows give repeated sequences; rows without an id are encoded too, their id in the lists is null; an empty table gives
no shard; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import batches, claim, column, discard, mix, shared_dir, slim, stash

END_OF_TEXT = 50256


def ranks_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Tokenizer:
    """Token identifiers of texts by the library, two bytes each."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.library = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        return np.array(self.library.encode_ordinary(text), "<u2").tobytes()


@cache
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def feistel(numbers: np.ndarray, count: int, key: int, rounds: int = 6) -> np.ndarray:
    """A keyed permutation of 0 .. count - 1."""
    half = np.uint64(max(1, (max(count - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))
    out = numbers.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> half, out[walking] & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        out[walking] = left << half | right
        walking = walking[out[walking] >= np.uint64(count)]
    return out.astype(np.int64)


#: The starts of so many ranges (of two numbers each) are broadcast at most; those of more are joined by a shuffle.
FEW_RANGES = 1_000_000

ENCODED = "doc_id long, tokens binary"
NUMBERED = "part int, number long, doc_id long, tokens binary"


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """The identifiers of each text that has any."""

    def run(source):
        claim("token ids", tokenizer.cache_clear)
        encode = tokenizer(path).encode
        for batch in batches(source, 4 << 20):
            cells = [encode(t) if t else b"" for t in column(batch, "text").to_pylist()]
            out = pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(cells, pa.binary())], ["doc_id", "tokens"])
            yield out.filter(pa.array([len(x) > 0 for x in cells], pa.bool_()))

    return slim(docs, "doc_id", "text").mapInArrow(run, ENCODED)


def numbered(texts: DataFrame, length: int, ranges: int) -> DataFrame:
    """Texts in order, with the number of their first sequence within their range."""

    def run(source):
        claim("training order", lambda: None)  # the encoder is not needed here
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches(source):
            n = np.array([-(-len(x) // (2 * length)) for x in column(batch, "tokens").to_pylist()], np.int64)
            first = number + np.cumsum(n) - n
            number += int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), pa.array(first), column(batch, "doc_id"), column(batch, "tokens")], ["part", "number", "doc_id", "tokens"])

    order = ["doc_id", F.xxhash64("tokens"), F.crc32("tokens")]  # short keys: the range sort samples them
    return texts.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(run, NUMBERED)


SHARD = "shard long, first_slot long, n_sequences int, stride int, n_tokens long, doc_ids array<long>, sequence_nos array<int>, sha256 string, payload binary"
PLACED = "shard long, slot long, doc_id long, sequence int, payload binary"


def training_shards(docs: DataFrame, length: int = 512, per_shard: int = 1024, key: int = 2024, path: str | None = None, range_bytes: int = 32 << 20) -> DataFrame:
    """One row per shard: its slots' range, documents and sequence numbers in slot order, and its bytes.

    ``range_bytes`` is about how much a task sorts or writes; it has no bearing on the result.
    """
    texts = stash(encoded(docs, path or ranks_path()))
    size = texts.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0
    ordered = stash(numbered(texts, length, max(1, -(-size // range_bytes))))
    discard(texts)
    n = F.ceil(F.octet_length("tokens") / (2 * length))
    counts = stash(ordered.groupBy("part").agg(F.sum(n).alias("n")))  # a row for each range
    total, ranges = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))

    def place(source):
        claim("training order", lambda: None)
        for batch in batches(source):
            docs, seq, number, cells = [], [], [], []
            for start, first, doc, raw in zip(*(column(batch, x).to_pylist() for x in ("start", "number", "doc_id", "tokens")), strict=True):
                mine = [raw[at : at + 2 * length] for at in range(0, len(raw), 2 * length)]
                docs += [doc] * len(mine)
                seq += range(len(mine))
                number += range(start + first, start + first + len(mine))
                cells += mine
            slot = feistel(np.array(number, np.int64), total, key)
            yield pa.RecordBatch.from_arrays([pa.array(slot // per_shard), pa.array(slot), pa.array(docs, pa.int64()), pa.array(seq, pa.int32()), pa.array(cells, pa.binary())], ["shard", "slot", "doc_id", "sequence", "payload"])

    pad = np.array([END_OF_TEXT], "<u2").tobytes()

    def write(table):
        table = table.sort_by("slot")
        cells = table.column("payload").to_pylist()
        payload = b"".join([x + pad * (length - len(x) // 2) for x in cells])
        shard, n = table.column("shard")[0].as_py(), len(table)
        lists = [pa.array([table.column(x).to_pylist()], t) for x, t in (("doc_id", pa.list_(pa.int64())), ("sequence", pa.list_(pa.int32())))]
        return pa.table([pa.array([shard]), pa.array([shard * per_shard]), pa.array([n], pa.int32()), pa.array([2 * length], pa.int32()), pa.array([sum(map(len, cells)) // 2]), *lists, pa.array([hashlib.sha256(payload).hexdigest()]), pa.array([payload], pa.binary())], [x.split()[0] for x in SHARD.split(", ")])

    shards = -(-total // per_shard)
    files = max(1, min(shards, -(-total * 2 * length // range_bytes)))
    placed = ordered.join(F.broadcast(starts) if ranges <= FEW_RANGES else starts, "part").mapInArrow(place, PLACED)
    return placed.repartitionByRange(files, "shard").groupBy("shard").applyInArrow(write, SHARD)  # a shard is a group of a fixed size


def write_shards(shards: DataFrame, path: str) -> None:
    """Write the shards: neighbouring ones in one file, in the order of their slots."""
    shards.write.option("compression", "zstd").parquet(path)


def written_shards(docs: DataFrame, **options) -> DataFrame:
    """``training_shards`` written to the shared folder by range, and read from there."""
    shards = training_shards(docs, **options)
    path = f"{shared_dir(docs.sparkSession)}/{uuid.uuid4().hex}"
    write_shards(shards, path)
    return docs.sparkSession.read.schema(shards.schema).parquet(path)


def read_slots(shards: DataFrame, first: int, n: int, per_shard: int = 1024) -> DataFrame:
    """``slot, tokens`` of ``n`` slots from ``first`` on: reads only the shards that hold them."""
    rows = shards.where(F.col("shard").between(first // per_shard, (first + n - 1) // per_shard)).select("shard", "n_sequences", "stride", "payload")

    def run(source):
        for batch in source:
            for row in batch.to_pylist():
                slots = [s for s in range(row["shard"] * per_shard, row["shard"] * per_shard + row["n_sequences"]) if first <= s < first + n]
                cells = np.frombuffer(row["payload"], "<u2").reshape(row["n_sequences"], -1)
                yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array([cells[s - row["shard"] * per_shard].astype(np.int32) for s in slots], pa.list_(pa.int32()))], ["slot", "tokens"])

    return rows.mapInArrow(run, "slot long, tokens array<int>")


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)


def _name(shard: int) -> str:
    """The file of a shard; a thousand shards share a folder."""
    return f"{shard // 1000:06d}/{shard:012d}.bin"


def write_plain(shards: DataFrame, folder: str) -> DataFrame:
    """Each shard's bytes as a file below the shared ``folder``, and their list, without bytes, as Parquet in ``<folder>/index``,
    which is written last and is returned. A task that is repeated writes the same bytes; a file has its name only when it is whole.
    """

    def write(source):
        system, root = _place(folder)
        for batch in source:
            for shard, payload in zip(column(batch, "shard").to_pylist(), column(batch, "payload").to_pylist(), strict=True):
                name, own = f"{root}/{_name(shard)}", f"{root}/{_name(shard)}.{uuid.uuid4().hex}"
                system.create_dir(name.rpartition("/")[0], recursive=True)
                with system.open_output_stream(own) as out:
                    out.write(payload)
                system.move(own, name)
            yield batch.drop_columns(["payload"])

    fields = SHARD.rpartition(",")[0]
    shards.mapInArrow(write, fields).write.mode("overwrite").parquet(f"{folder}/index")
    return shards.sparkSession.read.schema(fields).parquet(f"{folder}/index")


def read_plain(spark: SparkSession, folder: str, first: int, n: int, per_shard: int = 1024, slots: int = 4096) -> DataFrame:
    """``slot, tokens`` of ``n`` slots from ``first`` on, out of the files of ``write_plain``: only their own bytes are read.

    A task takes about ``slots`` of them: it opens a shard's file and seeks to the first.
    """
    index = spark.read.parquet(f"{folder}/index").where(F.col("shard").between(first // per_shard, (first + n - 1) // per_shard))
    wanted = index.select("shard", "stride", F.greatest(F.lit(first), F.col("first_slot")).alias("a"), F.least(F.lit(first + n), F.col("first_slot") + F.col("n_sequences")).alias("b")).where("a < b")

    def run(source):
        system, root = _place(folder)
        for batch in source:
            for row in batch.to_pylist():
                with system.open_input_file(f"{root}/{_name(row['shard'])}") as held:
                    for a in range(row["a"], row["b"], slots):
                        held.seek((a - row["shard"] * per_shard) * row["stride"])
                        cells = np.frombuffer(held.read(min(slots, row["b"] - a) * row["stride"]), "<u2").reshape(-1, row["stride"] // 2)
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + len(cells))), pa.array(cells.astype(np.int32).tolist(), pa.list_(pa.int32()))], ["slot", "tokens"])

    parts = max(1, -(-n // max(slots, 1)))
    return wanted.repartitionByRange(min(parts, 10_000), "shard").mapInArrow(run, "slot long, tokens array<int>")
