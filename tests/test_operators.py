import random

import pytest
from pyspark.sql import functions as F

from tarnlake.functions.predicates import Op, cmp, col, const_str
from tarnlake.operators.relational import SortKey, fetch, filter_rows, first_per_key, index_entries, index_scan, lookup_many, merge_join, range_scan, sort_rows, with_rid


def test_join_duplicates_and_names(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id long, r_id string")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z")], "id long, name string")
    out = merge_join(left, right, 0, 0)
    assert out.columns == ["id", "r_id", "r_id", "r_name"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a", 1, "x"), (1, "a", 1, "y"), (1, "b", 1, "x"), (1, "b", 1, "y")]


def test_equal_names_by_position(spark):
    left = spark.createDataFrame([(1, "a"), (2, "c")], "id long, r_ID string")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "id long, Id string")
    out = merge_join(left, right, 0, 0)
    kept = filter_rows(out, cmp(col(3), Op.EQ, const_str("y")))
    assert kept.columns == out.columns and [tuple(r) for r in kept.collect()] == [(1, "a", 1, "y")]
    assert [r[3] for r in sort_rows(out, [SortKey(3, False)]).collect()] == ["z", "y", "x"]


def test_join_empty_sides(spark):
    some = spark.createDataFrame([(1,)], "k long")
    none = some.filter("k > 5")
    for a, b in ((some, none), (none, some), (none, none)):
        out = merge_join(a, b, 0, 0)
        assert out.count() == 0 and out.columns == ["k", "r_k"]


def test_join_string_keys(spark):
    a = spark.createDataFrame([("x",), ("y",)], "s string")
    n = spark.createDataFrame([(0,), (4,)], "n long")
    with pytest.raises(TypeError):
        merge_join(a, a, 0, 0)
    assert merge_join(a, a, 0, 0, "exact").count() == 4
    assert merge_join(a, n, 0, 0, "exact").count() == 2  # only 0 meets what strings read as
    with pytest.raises(IndexError):
        merge_join(a, a, 1, 0)


def test_skewed_join_is_whole(spark):
    left = spark.range(3000).select(F.when(F.col("id") < 1500, 7).otherwise(F.col("id")).cast("long").alias("k"))
    right = spark.range(10).select(F.col("id").alias("k"))
    assert merge_join(left, right, 0, 0).count() == 1500


def test_sort(spark):
    words = ["z", "", "é", "ab", "A", "a", "B"]
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "s string, i long")
    assert [r.s for r in sort_rows(df, [SortKey(0)]).collect()] == ["", "A", "B", "a", "ab", "z", "é"]
    assert [r.s for r in sort_rows(df, [SortKey(0, False)]).collect()] == ["é", "z", "ab", "a", "B", "A", ""]
    assert sort_rows(df, []) is df
    wide = spark.createDataFrame([(2**63 - 1,), (-(2**63),), (0,)], "n long")
    assert [r.n for r in sort_rows(wide, [SortKey(0)]).collect()] == [-(2**63), 0, 2**63 - 1]


@pytest.mark.parametrize("order", ["shuffled", "up", "down"])
def test_index_of_1000_keys(spark, tmp_path, order):
    keys = list(range(1000))
    {"shuffled": random.Random(42).shuffle, "up": lambda k: None, "down": list.reverse}[order](keys)
    rows = [(k, f"v{k}") for k in keys] + [(k, "late") for k in keys[:50]]
    spark.createDataFrame(rows, "k long, v string").coalesce(1).write.parquet(str(tmp_path / "t"))
    df = with_rid(spark.read.parquet(str(tmp_path / "t")))
    assert index_entries(df, 0).count() == 1000
    first = {r.k: r.v for r in first_per_key(df, 0).collect()}
    assert first == {k: f"v{k}" for k in keys}
    found = lookup_many(df, 0, spark.createDataFrame([(3,), (3,), (5000,)], "w long"))
    assert [(r.k, r.v) for r in found.collect()] == [(3, "v3")]
    plain = spark.read.parquet(str(tmp_path / "t"))
    assert [tuple(r) for r in index_scan(plain, 0, keys[0]).collect()] == [(keys[0], f"v{keys[0]}")]
    assert index_scan(plain, 0, -5).count() == 0
    with pytest.raises(TypeError):
        index_scan(plain, 1, 3)
    assert [r.k for r in range_scan(plain, 0, 998, 2000).collect()][-1] == 999
    rid = df.filter("k = 3 and v = 'v3'").first()["_rid"]
    assert [r.v for r in fetch(plain, rid["file"], rid["row"]).collect()] == ["v3"]
    assert fetch(plain, rid["file"], 10**6).count() == 0
