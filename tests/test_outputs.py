"""Outputs on demand, batches that clean up, merges of repeated keys, numbering."""

import os

import pytest

from tallyworks import session
from tallyworks.operators import merge
from tallyworks.operators.outputs import Outputs
from tallyworks.plans import queries
from tallyworks.sources.adapters import StarBooks
from tallyworks.sources.tables import assign_keys

SF = "/root/testdata/sf0.001"


def test_outputs_are_built_once_and_when_asked(spark):
    built = []
    made = Outputs({"a": lambda: built.append("a") or 1, "b": lambda: built.append("b") or 2})
    assert list(made) == ["a", "b"] and len(made) == 2 and not built
    assert (made["b"], made["b"]) == (2, 2) and built == ["b"]
    with pytest.raises(KeyError):
        made["c"]


@pytest.mark.parametrize(
    "batch, output, spared",
    [(queries._sales, "finished_inventory", "postings"), (queries._production, "raw_inventory", "receipts"), (queries._receipt, "outcome", "receipts")],
)
def test_unneeded_tables_are_not_written(spark, batch, output, spared):
    with session.batch(spark) as paths:
        result = batch(StarBooks(spark, SF))[output].count()
        names = {os.path.basename(p).rsplit("-", 1)[0] for p in paths}
        assert result and names and not [n for n in names if n == spared]
    folder = session.shared_folder(spark).removeprefix("file:")
    left = {os.path.basename(p) for p in paths} & set(os.listdir(folder))
    assert not left


def test_a_failed_batch_cleans_up_too(spark):
    with pytest.raises(RuntimeError):
        with session.batch(spark) as outer:
            kept = session.materialise(spark.range(3), "outer")
            with session.batch(spark) as inner:
                session.materialise(spark.range(3), "inner")
            assert len(inner) == 1 and kept.count() == 3
            raise RuntimeError
    assert len(outer) == 1 and not os.path.exists(outer[0].removeprefix("file:"))


def test_merges_refuse_repeated_keys(spark):
    target = spark.createDataFrame([(1, 10, "a"), (2, 20, "b"), (None, 5, "n")], "k long, v long, kept string")
    source = spark.createDataFrame(
        [(1, 11, 1), (1, 12, 2), (3, 30, 1), (2, 21, 1), (None, 6, 1), (None, 7, 2), (4, 1, 1), (4, 1, 1)], "k long, v long, seq long"
    )
    plain = source.drop("seq")
    merged, lost = merge.upsert_or_refuse(target, plain, ["k"])
    nulls = [(None, 5, "n"), (None, 6, None), (None, 7, None)]
    assert sorted(map(tuple, merged.collect()), key=str) == sorted([(1, 10, "a"), (2, 21, "b"), (3, 30, None), *nulls], key=str)
    code = merge.REPEATED_KEY
    assert sorted(map(tuple, lost.collect())) == [(1, 11, code), (1, 12, code), (4, 1, code), (4, 1, code)]
    merged, lost = merge.upsert_or_refuse(target, source, ["k"], ["seq"])
    want = [(1, 12, "a"), (2, 21, "b"), (3, 30, None), (4, 1, None), *nulls]
    assert sorted(map(tuple, merged.collect()), key=str) == sorted(want, key=str)
    assert sorted(map(tuple, lost.collect())) == [(1, 11, 1, code), (4, 1, 1, code)]
    merged, lost = merge.upsert_or_refuse(target, plain.limit(0), ["k"])
    assert merged.count() == 3 and lost.count() == 0


@pytest.mark.parametrize("partitions", [1, 7])
def test_numbering_is_gapless_with_ties_in_range_bounds(spark, partitions):
    rows = [(5 if i < 400 else i % 11, i, f"r{i}") for i in range(1000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(rows, "day long, seq long, name string").repartition(5)
        got = assign_keys(df, "id", ["day", "seq"], 100).collect()
        empty = assign_keys(df.limit(0), "id", ["day", "seq"]).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {name: 101 + n for n, (_, _, name) in enumerate(sorted(rows))}
    assert {r["name"]: r["id"] for r in got} == want and empty == 0
