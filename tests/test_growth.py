"""What must not grow with the tables: guesses of sizes, tasks, projects in one task."""

import hashlib
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from schemaweave.operators import digests, graph, history, places, review, scratch, validate
from schemaweave.plans import corpus, oracles, queries

from .parity import assert_same, duck

NODE, EDGE = "project_id string, object_id string", "project_id string, source_object_id string, target_object_id string"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["o50_dependencies", "o51_preferences", "o103_graph"])
def test_no_broadcast_of_guessed_size(spark, smallest, name):
    assert "BroadcastHashJoin" not in plan(queries.queries()[name](spark, smallest))


def test_sources_are_dealt(spark, tmp_path):
    pd.DataFrame({"p_partkey": range(25_000)}).to_parquet(tmp_path / "part.parquet")
    for made in (corpus.corpus, corpus.linked):
        assert made(spark, str(tmp_path)).rdd.getNumPartitions() == 3


def kahn(nodes: list, edges: list) -> list:
    """By hand: the least node of a project that needs nothing goes next, the rest by id."""
    left, out = set(nodes), []
    while ready := [n for n in left if not any(a == n and b in left for a, b in edges)]:
        out.append(min(ready))
        left.discard(out[-1])
    return out + sorted(left)


@pytest.mark.parametrize("seed", range(3))
def test_order_without_a_project_in_a_task(spark, monkeypatch, seed):
    monkeypatch.setattr(review, "BUCKET", 3)
    draw, nodes, edges = random.Random(seed), [], []
    for project in "pq":
        ids = [f"{i:02d}" for i in range(40)]
        nodes += [(project, i) for i in ids]
        edges += [(project, *draw.choices(ids, k=2)) for _ in range(30)]
    order = review.ordered(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE))
    assert "FlatMapCoGroups" not in plan(order)
    got = sorted((r.project_id, r.seq, r.object_id) for r in order.collect())
    want = [(p, n, i) for p in "pq" for n, i in enumerate(kahn([i for q, i in nodes if q == p], [e[1:] for e in edges if e[0] == p and e[1] != e[2]]), 1)]
    assert got == want


def test_archive_of_a_long_text(spark, tmp_path):
    pd.DataFrame({"doc_id": [3, 10, 17], "text": ["a" * 52_428, "a" * 52_429, "short"]}).to_parquet(tmp_path / "documents.parquet")
    got = queries.o03_zip(spark, str(tmp_path)).toPandas()
    assert [p.startswith("Zip entry is too large") for p in got.sort_values("batch_id")["problem"]] == [True, False, False]
    assert_same(got, duck(str(tmp_path), oracles.oracle_sql()["o03_zip"]))


def test_merges_of_what_was_written(spark):
    """A round's files are compressed, so their size says little of what a broadcast of them takes."""
    rows = spark.range(200).selectExpr("'p' AS project_id", "cast(id AS string) AS object_id", "id % 7 AS n")
    assert "BroadcastHashJoin" not in plan(places.placed(rows, ["project_id"], "n"))
    edges = rows.selectExpr("project_id", "object_id AS source_object_id", "cast(n AS string) AS target_object_id")
    assert "BroadcastHashJoin" not in plan(graph.clusters(rows, edges))
    log = rows.selectExpr("object_id AS k", "n AS at", "project_id AS v")
    assert "BroadcastHashJoin" not in plan(history.as_of(log.select("k", "at"), log, ["k"], ["v"]))


def test_digest_of_a_group_by_pieces(spark):
    """the ids of a project pass through a task by pieces, never as one value."""
    rows = [(p, f"{(i * 7919) % 3001:05d}") for p, n in (("p", 3001), ("q", 1), (None, 40)) for i in range(n)] + [("q", None)]
    got = {r.g: r.md5 for r in digests.joined_md5(spark.createDataFrame(rows, "g string, t string"), "g", "t").collect()}
    assert got == {g: hashlib.md5(",".join(sorted(t for h, t in rows if h == g and t is not None)).encode()).hexdigest() for g in ("p", "q", None)}


def test_preview_holds_no_project(spark, smallest):
    assert "object_ids" not in plan(queries.queries()["q11_preview"](spark, smallest))


def test_hub_costs_no_round_a_level(spark, monkeypatch):
    """without the hub its cluster is chains that tasks search, however long they are."""
    peel, seen = graph._peel, []
    monkeypatch.setattr(graph, "_peel", lambda *a: seen.append(peel(*a)) or seen[-1])
    pairs = [(f"{c}{i:02d}", f"{c}{i - 1:02d}" if i else "hub") for c in "abcdef" for i in range(12)] + [(f"{c}{i:02d}", "hub") for c in "abcdef" for i in range(0, 12, 3)]
    names = sorted({n for p in pairs for n in p})
    got = graph.components(spark.createDataFrame([("p", n) for n in names], NODE), spark.createDataFrame([("p", *e) for e in pairs], EDGE), local=20)
    assert sum(len(done) for done, _ in seen) == 1
    assert {r.object_id: r.wave for r in got.collect()} == {n: 0 if n == "hub" else int(n[1:]) + 1 for n in names}


def test_batches_are_made_once(spark, smallest):
    """what finds the counterparts runs once, not once for each of its three outcomes; and a parse that is read once isn't stored."""
    runs = spark.sparkContext.accumulator(0)
    rounds = scratch.Rounds(spark, "once")
    counted = F.udf(lambda x: runs.add(1) or x, "long")
    rounds.deal(0, spark.range(9).select(counted("id").alias("id")), F.concat(F.lit("t"), (F.col("id") % 3).cast("string")))
    assert runs.value == 9 and sorted(r.id for r in rounds.read("t1", "id long", 0).collect()) == [1, 4, 7]
    stored = spark.sparkContext._jsc.getPersistentRDDs().size()
    queries.queries()["d1_objects"](spark, smallest).count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == stored


def test_sums_of_digests_are_sums_of_longs(spark):
    """exact beyond a long, without a decimal a row."""
    d = spark.createDataFrame([((1 << 60) - 1 - i,) for i in range(100)] + [(None,)], "d long")
    total = d.agg(validate._summed(F.col("d")).alias("s"))
    assert int(total.first().s) == sum((1 << 60) - 1 - i for i in range(100)) and "sum(cast" not in plan(total)
