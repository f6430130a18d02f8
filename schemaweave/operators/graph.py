"""Clusters, cycles, waves and what is reached, over graphs of a project's objects.

Edges point from what depends to what it needs: (project_id, source_object_id, target_object_id). All operators go in rounds
of equi-joins and aggregates; a round is one job that writes what it found below the shared folder (``scratch.Rounds``), so the
plan of a round is as large as that of the first, and a lost executor costs tasks of one round. A hub that half of all objects
depend on is met by partial aggregates and by joins with one row on the hub's side, which adaptive execution splits.

Contract: edges with an end that isn't among the nodes, repeated edges and edges from a node to itself don't count; repeated nodes
are one; nodes without an id are left out; one id in two projects is two nodes. No nodes, no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Rounds

NODE = ["project_id", "object_id"]
EDGE = "project_id string, object_id string, needs string"
LOCAL, BUCKET = 200_000, 50_000


def _nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select(*NODE).where("project_id is not null and object_id is not null").distinct()


def pruned(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """EDGE rows between nodes."""
    e = edges.select("project_id", F.col("source_object_id").alias("object_id"), F.col("target_object_id").alias("needs")).where("object_id <> needs").distinct()
    for end in ("object_id", "needs"):
        e = e.join(nodes.withColumnRenamed("object_id", end).hint("merge"), ["project_id", end], "left_semi")
    return e.select("project_id", "object_id", "needs")


# ---- clusters


def clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, object_id, cluster_id): the least id among those that edges connect, whichever way these point.

    Star contraction: every node hangs its larger neighbours under the least it knows, then its smaller ones and itself, until
    every cluster is a star around its least id. The number of rounds grows with the logarithm of a cluster's size."""
    own = _nodes(nodes)
    return clusters_of(own, pruned(own, edges))


def clusters_of(own: DataFrame, e: DataFrame) -> DataFrame:
    """``clusters`` of EDGE rows that are pruned already."""
    rounds, schema = Rounds(own.sparkSession, "clusters"), "project_id string, a string, b string"
    up, down = F.greatest("object_id", "needs"), F.least("object_id", "needs")
    rounds.write(0, stars=e.select("project_id", up.alias("a"), down.alias("b")).distinct())
    n, before = 0, None
    while True:
        stars = rounds.read("stars", schema, n)  # a > b
        now = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("project_id", "a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            break
        both = stars.unionByName(stars.select("project_id", F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("project_id", "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least.hint("merge"), ["project_id", "a"]).select("project_id", F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        rounds.write(n + 1, stars=large)
        large = rounds.read("stars", schema, n + 1)
        least = large.groupBy("project_id", "a").agg(F.min("b").alias("m"))
        small = large.join(least.hint("merge"), ["project_id", "a"]).where("b <> m").select("project_id", F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("project_id", "a", F.col("m").alias("b")))
        rounds.write(n + 2, stars=small.distinct())
        before, n = now, n + 2
        rounds.drop(n - 2, n - 1)
    root = stars.select("project_id", F.col("a").alias("object_id"), F.col("b").alias("root"))
    return own.join(root.hint("merge"), NODE, "left").select(*NODE, F.coalesce("root", "object_id").alias("cluster_id"))


# ---- waves and cycles

FRONT, WAIT = "project_id string, object_id string, wave int", "project_id string, object_id string, needs string, wave int"


def _peel(rounds: Rounds, front: DataFrame, waiting: DataFrame, most: int | None = None) -> tuple[list[int], int]:
    """Takes away, round by round, the nodes that need nothing (more), ``front`` first: their wave stands, and those that need them come later.

    ``waiting`` are WAIT rows, with the least wave that their node can still have. Returns the rounds with a ``front`` and the last one,
    whose ``waiting`` rows are those in or behind a cycle; after ``most`` rounds the last one still has a ``front`` too."""
    n = getattr(rounds, "next", 0)
    rounds.write(n, front=front, waiting=waiting)
    done = []
    while rounds.has(n, "front") and (most is None or len(done) < most):
        done.append(n)
        edges = rounds.read("waiting", WAIT, n)
        gone = rounds.read("front", FRONT, n).select("project_id", F.col("object_id").alias("needs"), F.col("wave").alias("at"))
        met = edges.join(gone, ["project_id", "needs"], "left")
        node = met.groupBy(*NODE).agg(F.greatest(F.max("at") + 1, F.max("wave")).alias("least"), F.count_if(F.col("at").isNull()).alias("left"))
        front = node.where("left = 0").select(*NODE, F.col("least").alias("wave"))
        rest = met.where("at is null").select(*NODE, "needs").join(node.where("left > 0").select(*NODE, F.col("least").alias("wave")).hint("merge"), NODE)
        rounds.write(n + 1, front=front, waiting=rest)
        n += 1
    rounds.next = n + 1
    return done, n


def _from_behind(rounds: Rounds, waiting: DataFrame) -> int:
    """Takes away the edges of nodes that no other one of ``waiting`` needs; returns the round with the rest, turned round."""
    turned = waiting.select("project_id", F.col("needs").alias("object_id"), F.col("object_id").alias("needs"), F.lit(0).alias("wave"))
    ends = waiting.select(*NODE).distinct().join(turned.select(*NODE).distinct(), NODE, "left_anti")
    return _peel(rounds, ends.withColumn("wave", F.lit(0)), turned)[1]


COLOUR = "project_id string, object_id string, colour string"


def _coloured(rounds: Rounds, edges: DataFrame, backward: DataFrame | None = None) -> DataFrame:
    """Without ``backward``: (project_id, object_id, colour), the greatest id that leads to each node. With it: the nodes of each colour that lead
    to the node of the colour's name. Only what changed in one round moves on in the next."""
    n = rounds.next
    start = backward.where("colour = object_id") if backward is not None else edges.select(*NODE).unionByName(edges.select("project_id", F.col("needs").alias("object_id"))).distinct().withColumn("colour", F.col("object_id"))
    rounds.write(n, all=start, changed=start)
    while rounds.has(n, "changed"):
        known, moved = rounds.read("all", COLOUR, n), rounds.read("changed", COLOUR, n)
        if backward is None:
            got = edges.join(moved, NODE).groupBy("project_id", F.col("needs").alias("object_id")).agg(F.max("colour").alias("new"))
            all_ = known.join(got, NODE, "left").select(*NODE, F.greatest("colour", "new").alias("colour"), (F.col("new") > F.col("colour")).alias("is_new"))
            changed = all_.where("is_new").drop("is_new")
            all_ = all_.drop("is_new")
        else:
            got = edges.join(moved.withColumnRenamed("object_id", "needs"), ["project_id", "needs"]).select(*NODE, "colour").distinct()
            changed = got.join(backward, [*NODE, "colour"], "left_semi").join(known, NODE, "left_anti")
            all_ = known.unionByName(changed)
        rounds.write(n + 1, all=all_, changed=changed)
        rounds.drop(n)
        n += 1
    rounds.next = n + 1
    return rounds.read("all", COLOUR, n)


ANSWER = "project_id string, object_id string, component_id string, cyclic boolean, wave int"


def _inside(edges: pd.DataFrame) -> pd.DataFrame:
    """ANSWER rows of the nodes of whole clusters of a project: components by one depth-first search, which names them prerequisites first.

    ``wave`` is the least that a node can have; a node with ``at``, its wave, is known and has no row."""
    needs: dict[str, list[str]] = {}
    for a, b in zip(edges["object_id"], edges["needs"], strict=True):
        needs.setdefault(a, []).append(b)
        needs.setdefault(b, [])
    known = {b: at for b, at in zip(edges["needs"], edges["at"], strict=True) if at >= 0}
    least = {**dict(zip(edges["object_id"], edges["wave"], strict=True)), **known}
    seen: dict[str, int] = {}  # order of arrival
    low: dict[str, int] = {}
    path, of, waves, rows = [], {}, {}, []
    for root in sorted(needs):
        todo = [(root, iter(needs[root]))] if root not in seen else []
        while todo:
            node, rest = todo[-1]
            if node not in seen:
                seen[node] = low[node] = len(seen)
                path.append(node)
            for nxt in rest:
                if nxt not in seen:
                    todo.append((nxt, iter(needs[nxt])))
                    break
                if nxt not in of:
                    low[node] = min(low[node], seen[nxt])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[node])
                if low[node] == seen[node]:
                    members = path[path.index(node) :] if path[-1] != node else [node]
                    del path[-len(members) :]
                    name = min(members)
                    of.update(dict.fromkeys(members, name))
                    waves[name] = max([*(least.get(x, 0) for x in members), *(1 + waves[of[m]] for x in members for m in needs[x] if of[m] != name)])
                    rows += [(x, name, len(members) > 1, waves[name]) for x in members if x not in known]
    out = pd.DataFrame(rows, columns=["object_id", "component_id", "cyclic", "wave"])
    out.insert(0, "project_id", edges["project_id"].iloc[0])
    return out


def components(nodes: DataFrame, edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """(project_id, object_id, component_id, cyclic, wave) of every object.

    component_id is the least id of the objects that need each other, directly or not; cyclic, whether there are several. The
    wave is the longest way to an object without needs over the graph in which a component is one node, so that all of a cycle
    come in one wave, and what stands behind it later.

    What needs nothing is peeled off first, hubs among it, so that what they held together falls into small clusters. Clusters of at most
    ``local`` edges are searched in tasks, many in each; larger ones are peeled on, twice as many rounds each time, until they fall
    apart too. Where nothing can be peeled off, larger ones go through the rounds of ``components_in_rounds``."""
    own, rounds = _nodes(nodes), Rounds(nodes.sparkSession, "parts")
    rounds.write(0, waiting=pruned(own, edges).withColumn("wave", F.lit(0)))
    waiting, rounds.next = rounds.read("waiting", WAIT, 0), 1
    front = own.join(waiting.select(*NODE).distinct().hint("merge"), NODE, "left_anti").withColumn("wave", F.lit(0))
    single, searched, rest, most = [], [], None, 1
    while True:
        done, last = _peel(rounds, front, waiting, most)
        single += done
        if not rounds.has(last, "waiting"):
            single.append(last)
            break
        waiting, front = rounds.read("waiting", WAIT, last), rounds.read("front", FRONT, last)
        ends = waiting.select(*NODE).unionByName(waiting.select("project_id", F.col("needs").alias("object_id"))).distinct()
        placed = waiting.join(clusters_of(ends, waiting.select("project_id", "object_id", "needs")).hint("merge"), NODE)
        size = placed.groupBy("project_id", "cluster_id").agg(F.count("*").alias("n"))
        at = front.select("project_id", F.col("object_id").alias("needs"), F.col("wave").alias("at"))
        sized = placed.join(size.hint("merge"), ["project_id", "cluster_id"]).join(at.hint("merge"), ["project_id", "needs"], "left").withColumn("at", F.coalesce("at", F.lit(-1)))
        dealt = rounds.next
        rounds.next += 1
        rounds.deal(dealt, sized.select("project_id", "object_id", "needs", "wave", "at", "cluster_id", "n"), F.when(F.col("n") > local, "large").otherwise("small"))
        if rounds.has(dealt, "small"):
            searched.append(dealt)
        if not rounds.has(dealt, "large"):
            single.append(last)
            break
        waiting, most = rounds.read("large", WAIT, dealt), 2 * most
        if not rounds.has(last, "front"):
            rest = _rest(rounds, waiting)
            break
    out = rounds.read("front", FRONT, *single).select(*NODE, F.col("object_id").alias("component_id"), F.lit(False).alias("cyclic"), "wave")
    if searched:
        small = rounds.read("small", f"{WAIT}, at int, cluster_id string", *searched)
        bucket = F.pmod(F.xxhash64("cluster_id"), F.lit(-(-small.count() // BUCKET)))
        out = out.unionByName(small.groupBy("project_id", bucket.alias("bucket")).applyInPandas(_inside, ANSWER))
    return out if rest is None else out.unionByName(rest)


def components_in_rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``components`` of graphs whose clusters may be of any size.

    Objects are peeled off from both ends first, so that chains and trees cost a join per level and cycles only what is left. In
    the rest the greatest ids spread along the edges; each one's component is what leads back to it within its colour. These
    go, ends are peeled off again, until nothing is left; then the peeling goes on over components where it stopped."""
    own = _nodes(nodes)
    return _in_rounds(own, pruned(own, edges))


def _in_rounds(own: DataFrame, e: DataFrame) -> DataFrame:
    rounds = Rounds(own.sparkSession, "components")
    rounds.write(0, waiting=e.withColumn("wave", F.lit(0)))
    e, rounds.next = rounds.read("waiting", WAIT, 0), 1
    done, last = _peel(rounds, own.join(e.select(*NODE).distinct(), NODE, "left_anti").withColumn("wave", F.lit(0)), e)
    single = rounds.read("front", FRONT, *done).select(*NODE, F.col("object_id").alias("component_id"), F.lit(False).alias("cyclic"), "wave")
    if not rounds.has(last, "waiting"):
        return single
    return single.unionByName(_rest(rounds, rounds.read("waiting", WAIT, last)))


def _rest(rounds: Rounds, waiting: DataFrame) -> DataFrame:
    """ANSWER rows of the nodes of ``waiting``, where peeling has stopped: all of them in or behind a cycle."""
    inside, found = waiting, []  # what is waited for waits too
    while True:
        ended = _from_behind(rounds, inside)
        if not rounds.has(ended, "waiting"):
            break
        turned = rounds.read("waiting", WAIT, ended).select("project_id", F.col("needs").alias("object_id"), F.col("object_id").alias("needs"))
        colours = _coloured(rounds, turned)
        members = _coloured(rounds, turned, colours)
        at = rounds.next
        gone = members.select(*NODE)
        left = turned.join(gone, NODE, "left_anti").join(gone.withColumnRenamed("object_id", "needs"), ["project_id", "needs"], "left_anti").select("project_id", "object_id", "needs")
        rounds.write(at, members=members, left=left)
        rounds.next, found = at + 1, [*found, at]
        if not rounds.has(at, "left"):
            break
        inside = rounds.read("left", EDGE, at)
    members = rounds.read("members", COLOUR, *found)
    named = members.join(members.groupBy("project_id", "colour").agg(F.min("object_id").alias("component_id"), F.count("*").alias("n")), ["project_id", "colour"]).select(*NODE, "component_id", (F.col("n") > 1).alias("cyclic"))
    of = waiting.select(*NODE).distinct().join(named, NODE, "left").select(*NODE, F.coalesce("component_id", "object_id").alias("component_id"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"))
    at = rounds.next
    rounds.write(at, of=of)
    rounds.next, of = at + 1, rounds.read("of", "project_id string, object_id string, component_id string, cyclic boolean", at)
    names = of.select("project_id", "object_id", "component_id")
    # where the peeling stopped: a component's least wave is the greatest of its members'
    least = waiting.select(*NODE, "wave").distinct().join(names, NODE).groupBy("project_id", "component_id").agg(F.max("wave").alias("wave"))
    apart = waiting.drop("wave").join(names, NODE).join(names.select("project_id", F.col("object_id").alias("needs"), F.col("component_id").alias("c")), ["project_id", "needs"]).where("component_id <> c")
    condensed = apart.select("project_id", "component_id", F.col("c").alias("needs")).distinct().join(least, ["project_id", "component_id"]).select("project_id", F.col("component_id").alias("object_id"), "needs", "wave")
    first = least.join(condensed.select("project_id", F.col("object_id").alias("component_id")).distinct(), ["project_id", "component_id"], "left_anti").select("project_id", F.col("component_id").alias("object_id"), "wave")
    done, _ = _peel(rounds, first, condensed)
    when = rounds.read("front", FRONT, *done).withColumnRenamed("object_id", "component_id")
    return of.join(when, ["project_id", "component_id"]).select(*NODE, "component_id", "cyclic", "wave")


# ---- what is reached


def reached(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(project_id, node, distance) of all that the ``seeds`` (project_id, node) lead to along (project_id, node, next), themselves at 0.

    Semi-naive: a round follows the edges of the nodes that the round before found, and keeps those that none found yet."""
    rounds, schema = Rounds(edges.sparkSession, "reached"), "project_id string, node string, distance int"
    n = 0
    rounds.write(0, edges=edges.select("project_id", "node", "next").where("node is not null and next is not null").distinct(), found=seeds.select("project_id", "node").where("project_id is not null and node is not null").distinct().withColumn("distance", F.lit(0)))
    e = rounds.read("edges", "project_id string, node string, next string", 0)
    while rounds.has(n, "found"):
        frontier, known = rounds.read("found", schema, n), rounds.read("found", schema, *range(n + 1))
        ahead = e.join(frontier, ["project_id", "node"]).select("project_id", F.col("next").alias("node")).distinct()
        rounds.write(n + 1, found=ahead.join(known, ["project_id", "node"], "left_anti").withColumn("distance", F.lit(n + 1)))
        n += 1
    return rounds.read("found", schema, *range(n))
