"""The shared folder."""

from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from storelens.llm import base, blocks


def test_a_cluster_must_name_its_shared_folder():
    session = lambda master, path=None: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: path, set=lambda *_: None), sparkContext=SimpleNamespace(master=master))
    assert base.shared_dir(session("spark://host:7077", "/shared")) == "/shared"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        base.shared_dir(session("spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        base.shared_dir(session("local-cluster[2,1,1024]"))
    assert Path(base.shared_dir(session("local[4]"))).is_dir()


def test_what_is_no_longer_read_is_deleted(spark):
    kept, gone = base.stash(spark.range(3)), base.stash(spark.range(3))
    base.discard(gone, None, spark.range(1))
    assert Path(kept.stashed_at).exists() and not Path(gone.stashed_at).exists() and kept.count() == 3


def test_blocks_of_a_huge_input_share_partitions(spark, monkeypatch):
    """At 100 TB there are millions of blocks, but at most PARTITIONS partitions; several blocks of one are solved apart."""
    many = blocks.block_count(100 << 40)
    assert many > 3_000_000
    planned = []
    frame = SimpleNamespace(repartitionById=lambda n, _: planned.append(n) or SimpleNamespace(groupBy=lambda _: SimpleNamespace(applyInArrow=lambda *_: None)))
    blocks.by_block(frame, {}, lambda e: None, "x long", 2 * many)
    assert planned == [blocks.PARTITIONS] and blocks.PARTITIONS <= 20_000
    monkeypatch.setattr(blocks, "PARTITIONS", 3)
    fields = {"name": "<u8"}
    packed = spark.range(200).mapInArrow(lambda source: (blocks.pack((ids := b.column(0).to_numpy()) % 17, {"name": ids.astype(np.uint64)}) for b in source), blocks.schema(fields))
    solved = blocks.by_block(packed, fields, lambda e: pa.table({"block": [e["block"]], "n": [len(e["name"])], "total": [int(e["name"].sum())]}), "block long, n long, total long", 17, "block")
    assert solved.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, solved.collect())) == [(k, len(range(k, 200, 17)), sum(range(k, 200, 17))) for k in range(17)]
