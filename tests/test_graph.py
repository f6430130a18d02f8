"""Clusters, components, waves and reachability against plain searches."""

import random

import pytest

from schemaweave.operators import diffs, graph

EDGES, NODES = "project_id string, source_object_id string, target_object_id string", "project_id string, object_id string"


def closure(names, pairs):
    after = {n: set() for n in names}
    for a, b in pairs:
        if a in after and b in after and a != b:
            after[a].add(b)
    out = {}
    for n in names:
        seen, todo = set(), [n]
        while todo:
            for m in after[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        out[n] = seen
    return after, out


def plain(names, pairs):
    after, far = closure(names, pairs)
    component = {n: min({n} | {m for m in far[n] if n in far[m]}) for n in names}
    cyclic = {n: any(m != n and n in far[m] for m in far[n]) for n in names}
    waves = {}

    def wave(c):
        if c not in waves:
            waves[c] = max((1 + wave(component[m]) for n in names if component[n] == c for m in after[n] if component[m] != c), default=0)
        return waves[c]

    return {n: (component[n], cyclic[n], wave(component[n])) for n in names}


@pytest.mark.parametrize("seed,n,m", [(1, 12, 14), (2, 20, 22), (3, 30, 80), (4, 15, 5)])
def test_components_and_clusters(spark, seed, n, m):
    r = random.Random(seed)
    names = [f"n{i:02d}" for i in range(n)]
    pairs = [(r.choice(names), r.choice(names)) for _ in range(m)] + [("n00", "gone"), ("n01", "n01")]
    nodes = spark.createDataFrame([("p", x) for x in names] + [("q", "n00"), ("p", "n00"), ("p", None)], NODES)
    edges = spark.createDataFrame([("p", *e) for e in pairs] * 2 + [("q", "n00", "n01")], EDGES)
    for f in (graph.components, graph.components_in_rounds) if seed != 2 else (lambda *a: graph.components(*a, local=3),):
        got = {(x.project_id, x.object_id): (x.component_id, x.cyclic, x.wave) for x in f(nodes, edges).collect()}
        assert got == {("p", k): v for k, v in plain(names, pairs).items()} | {("q", "n00"): ("n00", False, 0)}
    _, far = closure(names, pairs + [(b, a) for a, b in pairs])
    got = {(x.project_id, x.object_id): x.cluster_id for x in graph.clusters(nodes, edges).collect()}
    assert got == {("p", k): min({k} | far[k]) for k in names} | {("q", "n00"): "n00"}


def test_hub_chain_and_empty(spark):
    """A hub that all need, with a long chain behind: one cluster; the plan of the result is no larger for it."""
    pairs = [(f"x{i:03d}", "hub") for i in range(300)] + [(f"c{i:03d}", f"c{i - 1:03d}") for i in range(1, 40)] + [("c000", "x299")]
    names = sorted({n for p in pairs for n in p})
    nodes, edges = spark.createDataFrame([("p", n) for n in names], NODES), spark.createDataFrame([("p", *e) for e in pairs], EDGES)
    got = graph.clusters(nodes, edges)
    assert {r.cluster_id for r in got.collect()} == {"c000"} and got.count() == len(names)
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString().splitlines())
    deep, flat = graph.components_in_rounds(nodes, edges), graph.components_in_rounds(nodes, edges.limit(3))
    assert size(deep) == size(flat) and {r.object_id: r.wave for r in deep.collect()}["c039"] == 41
    assert {r.object_id: r.wave for r in graph.components(nodes, edges).collect()} == {r.object_id: r.wave for r in deep.collect()}
    for f in (graph.clusters, graph.components):
        assert f(nodes.limit(0), edges).count() == 0 and f(nodes, edges.limit(0)).count() == len(names)


def test_reached_and_stale(spark):
    edges = spark.createDataFrame([("p", "a", "b"), ("p", "b", "c"), ("p", "c", "a"), ("p", "a", "c"), ("q", "a", "z"), ("p", "y", "w"), ("p", None, "b")], "project_id string, node string, next string")
    seeds = spark.createDataFrame([("p", "a"), ("p", "a"), ("p", "lone"), ("p", None)], "project_id string, node string")
    assert sorted(tuple(r) for r in graph.reached(edges, seeds).collect()) == [("p", "a", 0), ("p", "b", 1), ("p", "c", 1), ("p", "lone", 0)]
    assert graph.reached(edges, seeds.limit(0)).count() == 0
    arts = edges.selectExpr("project_id", "concat('source|', node) node", "concat('object|', next) next").where("node is not null")
    got = {(r.project_id, r.kind, r.id): (r.stale, r.distance) for r in diffs.stale_along(arts, spark.sql("select 'p' project_id, 'y' source_id")).collect()}
    assert got["p", "source", "y"] == (True, 0) and got["p", "object", "w"] == (True, 1) and got["q", "object", "z"] == (False, None)
