"""Packed exchange: long arrays of (name, payload) entries are cut into column blocks by name, as binary cells.

A task turns a batch of documents into one row per block, so that the shuffle moves a few large cells in place
of a row per entry, and numpy sorts a block at a time. Blocks are cut by the names' leading bits (names are
hashes), so they are even whatever the documents hold; their number follows the input.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import tidy

#: The most partitions of an exchange of blocks.
PARTITIONS = 20_000


def block_count(n_bytes: int, each: int = 16 << 20, least: int = 12) -> int:
    return max(least, -(-n_bytes // each))


def block_of(names: np.ndarray, blocks: int) -> np.ndarray:
    """The block of each 64-bit name, by its upper 32 bits."""
    return ((names >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int32)


def schema(fields: dict[str, str]) -> str:
    return "block int, " + ", ".join(f"{x} binary" for x in fields)


def pack(block: np.ndarray, fields: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row per block that has entries, each field's entries as bytes, in their order."""
    order = np.argsort(block, kind="stable")
    block = block[order]
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.empty(0, int)
    ends = np.r_[starts[1:], len(block)].astype(int)[: len(starts)]
    cells = {}
    for name, values in fields.items():
        values = values[order]
        cells[name] = pa.array([values[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(block[starts], pa.int32()), *cells.values()], ["block", *cells])


def unpack(table: pa.Table, fields: dict[str, str]) -> dict[str, np.ndarray]:
    return {x: np.frombuffer(b"".join(table.column(x).to_pylist()), kind) for x, kind in fields.items()}


def by_block(packed: DataFrame, fields: dict[str, str], solve: Callable[[dict[str, np.ndarray]], pa.Table], out: str, blocks: int, number: str | None = None) -> DataFrame:
    """Run ``solve`` on the entries of each block, with the block's number under the name ``number`` if given.

    Up to ``PARTITIONS`` blocks each is a partition of its own; of more, several share one and are solved one after the other,
    so tasks stay small in memory, and their number stays one that a scheduler can bear, as inputs grow.
    """

    def run(table):
        out = solve(unpack(table, fields) | ({number: table.column("block")[0].as_py()} if number else {}))
        tidy()
        return out

    return packed.repartitionById(min(blocks, PARTITIONS), "block").groupBy("block").applyInArrow(run, out)
