"""Differences through the checksum tree, shards by depth, and multiset differences against plain counts."""

import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from schemaweave.operators import validate as V

ROWS = "k long, d double, s string, t timestamp, m decimal(9,2), b binary, a array<int>"


def table(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def random_rows(r, n):
    import datetime

    return [(r.choice([None, *range(40)]), r.choice([None, 0.5, 1.25, float("nan"), float("inf")]), r.choice([None, "", "N", "1:x", "é|"]), r.choice([None, datetime.datetime(2024, 1, 2, 3, 4, 5, 6)]), r.choice([None, Decimal("1.50")]), r.choice([None, bytearray(b"\0x")]), r.choice([None, [1, None], []])) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_differences(spark, seed):
    r = random.Random(seed)
    rows = random_rows(r, 60)
    other = [x for x in rows if r.random() < 0.9] + random_rows(r, 4) + rows[:2]
    got = {x.k: (x.difference, x.rows_before, x.rows_after) for x in V.differences(table(spark, rows), table(spark, other), ["k"], depth=2).collect()}
    want = {}
    for k in {x[0] for x in rows + other}:
        b, a = (Counter(repr(x) for x in side if x[0] == k) for side in (rows, other))
        if b != a:
            want[k] = ("ADDED" if not b else "REMOVED" if not a else "CHANGED", b.total(), a.total())
    assert got == want


def test_tree_descends_to_what_differs(spark):
    rows = [(i, 1.0, "x", None, None, None, None) for i in range(500)]
    same = V.unequal_shards(table(spark, rows), table(spark, rows[::-1]).repartition(7), ["k"])
    assert same.count() == 0 and V.differences(table(spark, rows), table(spark, rows), ["k"]).count() == 0
    changed = [(*x[:2], "y", *x[3:]) if x[0] == 77 else x for x in rows]
    got = sorted((x.level, len(x.shard), x.rows_before == x.rows_after) for x in V.unequal_shards(table(spark, rows), table(spark, changed), ["k"]).collect())
    assert got == [(n, n, True) for n in range(4)]
    empty = V.differences(table(spark, rows).limit(0), table(spark, rows), ["k"])
    assert {x.difference for x in empty.collect()} == {"ADDED"} and empty.count() == 500


@pytest.mark.parametrize("key", ["flat", "heavy", "nulls", "one", "text", None])
def test_depth_shards(spark, key):
    """Every row once, ranges in order, and no shard off its share by more than the error and chance."""
    df = spark.range(8000).select("id", F.col("id").alias("flat"), F.when(F.col("id") % 5 < 3, 7).otherwise(F.col("id")).alias("heavy"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("nulls"), F.lit(3).alias("one"), F.lpad(F.col("id").cast("string"), 5, "0").alias("text"))
    if key == "text":
        df = df.withColumn("text", F.col("text").cast("int").cast("date") if False else F.date_add(F.lit("2000-01-01"), F.col("id").cast("int")))
    out = V.depth_shards(df, key, 10)
    sizes = {x.shard: x.n for x in out.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    assert set(sizes) == set(range(10)) and sum(sizes.values()) == 8000
    assert all(abs(n - 800) < 90 for n in sizes.values())
    if key:
        ends = out.where(F.col(key).isNotNull()).groupBy("shard").agg(F.min(key).alias("low"), F.max(key).alias("high")).orderBy("shard").collect()
        assert all(a.high <= b.low for a, b in zip(ends[:-1], ends[1:], strict=True))
    assert V.depth_shards(df.limit(0), key, 10).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_matched(spark, seed):
    """Repeated rows, nulls, and values that many share: each row once, and pairs as many as counts allow, step by step."""
    from schemaweave.operators import diffs

    r = random.Random(seed)
    rows = lambda n: [(r.choice(["p", None]), f"path{r.randrange(12)}", r.choice(["hot", "hot", "h1", "h2", None])) for _ in range(n)]
    b, a = rows(40), rows(45)
    df = lambda x: spark.createDataFrame(x, "project_id string, relative_path string, content_hash string")
    got = [(x.change, x.before and tuple(x.before), x.after and tuple(x.after)) for x in diffs.matched(df(b), df(a), *diffs.FILES).collect()]
    assert Counter(x for _, x, _ in got if x) == Counter(b) and Counter(x for *_, x in got if x) == Counter(a)
    left = Counter(b), Counter(a)
    for label, key in (("SAME", lambda x: x), ("CHANGED", lambda x: x[:2]), ("MOVED", lambda x: (x[0], x[2]))):
        pairs = [(x, y) for c, x, y in got if c == label]
        assert all(key(x) == key(y) for x, y in pairs)
        groups = [Counter(key(x) for x in side.elements()) for side in left]
        assert len(pairs) == (groups[0] & groups[1]).total()
        left = left[0] - Counter(x for x, _ in pairs), left[1] - Counter(y for _, y in pairs)
    assert Counter(c for c, *_ in got)["REMOVED"] == left[0].total() and Counter(c for c, *_ in got)["ADDED"] == left[1].total()


@pytest.mark.parametrize("partitions", ["1", "4", "13"])
def test_as_of(spark, partitions):
    """The last entry that isn't later, wherever the ranges end; nulls, ties and keys without entries."""
    from schemaweave.operators import history

    r = random.Random(7)
    log = [(r.choice(["a", "a", "b", None]), r.randrange(40), r.choice(["x", "y", None])) for _ in range(120)] + [("a", None, "never")]
    asked = [(r.choice(["a", "a", "b", None, "none"]), r.randrange(-2, 45), i) for i in range(150)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = history.as_of(spark.createDataFrame(asked, "k string, at int, i int"), spark.createDataFrame(log, "k string, at int, v string"), ["k"], ["v"])
        got = {x.i: x.v for x in df.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {i: max(((t, v is not None, v or "") for k2, t, v in log if k2 == k and t is not None and t <= at), default=(0, False, ""))[1:] for k, at, i in asked}
    assert got == {i: v if some else None for i, (some, v) in want.items()}
    rows = spark.sql("select * from values ('p', 1, 'x'), ('p', 5, 'y') t(k, at, v)")
    assert [(x.at, x.until) for x in history.effective(rows, ["k"]).orderBy("at").collect()] == [(1, 5), (5, None)]
