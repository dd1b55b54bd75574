import zlib

import numpy as np
import pytest
from scoreloom.llm import shared, training_order

SCHEMA = "id long, text string, slot string, record string"
PLAN = {"length": 8, "per_shard": 5, "key": 77}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation(n):
    for key in (0, 1, 1 << 70):
        slots = training_order.permute(np.arange(n), n, key)
        assert sorted(slots.tolist()) == list(range(n))
    if n > 100:
        assert (training_order.permute(np.arange(n), n, 1) != training_order.permute(np.arange(n), n, 2)).mean() > 0.9


def expected(rows):
    """Records of every (id, part), as often as they occur."""
    out = []
    for i, text in rows:
        ids = (text or "").encode() + b"\xff"
        out += [(i, k // 8, len(ids[k : k + 8]), ids[k : k + 8].ljust(8, b"\xfe")) for k in range(0, len(ids), 8)]
    return sorted(out, key=str)


def test_shards_hold_every_sequence_at_its_slot(rows_of, spark):
    rows = [(k, f"text {k} " + "é\n" * k) for k in range(40)] + [(100, None), (101, ""), (None, "no id"), (102, "exactly8"), (103, "same"), (103, "same"), (103, "other"), (104, "long" * 5000)]
    docs = rows_of([(*r, "x", "y") for r in rows], SCHEMA)
    path = shared.fresh(spark, "shards")
    index = training_order.materialise(docs, path, **PLAN, id="id").collect()
    record = {r["slot"]: bytes(r["record"]) for r in training_order.read(spark, path, 8, 5).collect()}
    assert sorted(r["slot"] for r in index) == list(range(len(index))) == sorted(record)
    assert sorted(((r["id"], r["part"], r["ids"], record[r["slot"]]) for r in index), key=str) == expected(rows)
    assert all(r["digest"] == zlib.crc32(record[r["slot"]]) and r["shard"] == r["slot"] // 5 and r["offset"] == r["slot"] % 5 * 9 for r in index)
    resumed = training_order.read(spark, path, 8, 5, 7, 19).collect()
    assert {r["slot"]: bytes(r["record"]) for r in resumed} == {s: record[s] for s in range(7, 19)}


def test_changed_partitions_are_noticed(rows_of, spark, monkeypatch):
    docs = rows_of([(k, "text" * k, "x", "y") for k in range(20)], SCHEMA)
    found = training_order.starts(docs.select("id", "text"), 8)[0]
    monkeypatch.setattr(training_order, "starts", lambda *_: ({k: (0, 1) for k in found}, 20))
    with pytest.raises(Exception, match="store the table first"):
        training_order.materialise(docs, shared.fresh(spark, "shards"), **PLAN, id="id").collect()


def test_empty_table(rows_of, spark):
    assert training_order.materialise(rows_of([], SCHEMA), shared.fresh(spark, "shards"), **PLAN, id="id").collect() == []
