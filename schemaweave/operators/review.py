"""Review gate and export of the dependency-ordered package."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import textops as T
from . import graph
from .places import placed
from .scratch import Rounds
from .versions import marked

APPROVED = ["APPROVED", "CONDITIONALLY_APPROVED"]
PACKAGE_FILE = "001_schema_baseline.sql"

# What a closed gate says.
GATE_MESSAGES = {
    "NO_CURRENT_REPORT": "Current precheck report is required before SQL package export",
    "NO_APPROVED_REVIEW": "Approved review is required before SQL package export",
    "NO_BASELINE": "Frozen SQL baseline is required before SQL package export",
    "MANUAL_BASELINE": "Manual-required SQL must be edited before SQL package export",
    "DRAFT_BASELINE": "Draft SQL must be edited before SQL package export",
    "BLOCKERS": "BLOCKER risks must be resolved or waived before SQL package export",
}


def submit(requests: DataFrame, reports: DataFrame) -> DataFrame:
    """review_record rows with a ``rejection`` that says why a request doesn't count (null: it does)."""
    known = reports.select(F.col("report_id").alias("known_report"), F.col("project_id").alias("report_project"), F.col("status").alias("report_status"))
    r = requests.join(known.hint("merge"), F.col("report_id") == F.col("known_report"), "left")
    yes = F.col("decision").isin(APPROVED)
    why = (
        F.when(F.col("report_id").isNull(), "report id is required")
        .when(F.col("decision").isNull(), "decision is required")
        .when(F.col("known_report").isNull() | (F.col("report_project") != F.col("project_id")), "Report not found")
        .when(yes & (F.col("report_status") == "STALE"), "Stale report cannot be approved")
        .when(yes & (F.col("report_status") == "BLOCKED"), "Blocked report cannot be approved")
    )
    name = F.when(T.is_blank(F.col("reviewer")), "developer").otherwise(T.trimmed(F.col("reviewer")))
    ids = ["review_id"] if "review_id" in requests.columns else []
    return r.select(*ids, "project_id", "report_id", "decision", name.alias("reviewer"), F.coalesce("comment", F.lit("")).alias("comment"), "created_at", why.alias("rejection"))


def current_report(reports: DataFrame) -> DataFrame:
    """The newest report of each project."""
    return reports.groupBy("project_id").agg(F.max_by("report_id", F.struct("created_at", "report_id")).alias("report_id"), F.max_by("status", F.struct("created_at", "report_id")).alias("report_status"))


def gate(projects: DataFrame, reports: DataFrame, reviews: DataFrame, versions: DataFrame, risks: DataFrame) -> DataFrame:
    """(project_id, status, baseline_count, blocker_count): READY or the first thing in the way.

    Of the reviews of a report in its own project that weren't rejected as requests, the last one counts; of one instant that
    with the greatest review_id or, without one, decision."""
    newest = current_report(reports)
    accepted = reviews.where("rejection is null") if "rejection" in reviews.columns else reviews
    tie = "review_id" if "review_id" in reviews.columns else "decision"
    last = accepted.groupBy("project_id", "report_id").agg(F.max_by("decision", F.struct("created_at", tie, "decision")).alias("decision"))
    base = versions.where("status = 'BASELINE'").groupBy("project_id").agg(F.count("*").alias("baseline_count"), F.count_if(marked("target_sql", "MANUAL_REQUIRED")).alias("manual"), F.count_if(marked("target_sql", "DRAFT")).alias("drafts"))
    blockers = risks.groupBy("project_id").agg(F.count_if(F.col("level") == "BLOCKER").alias("blocker_count"))
    g = projects.select("project_id").join(newest, "project_id", "left").join(last, ["project_id", "report_id"], "left").join(base, "project_id", "left").join(blockers, "project_id", "left").fillna(0, ["baseline_count", "manual", "drafts", "blocker_count"])
    status = (
        F.when(F.coalesce(F.col("report_status"), F.lit("")) != "CURRENT", "NO_CURRENT_REPORT")
        .when(~F.coalesce(F.col("decision").isin(APPROVED), F.lit(False)), "NO_APPROVED_REVIEW")
        .when(F.col("baseline_count") == 0, "NO_BASELINE")
        .when(F.col("manual") > 0, "MANUAL_BASELINE")
        .when(F.col("drafts") > 0, "DRAFT_BASELINE")
        .when(F.col("blocker_count") > 0, "BLOCKERS")
        .otherwise("READY")
    )
    message = F.element_at(F.create_map(*[F.lit(x) for kv in GATE_MESSAGES.items() for x in kv]), F.col("status"))
    return g.select("project_id", status.alias("status"), "baseline_count", "blocker_count").withColumn("message", message)


#: Edges of whole clusters that one task puts in order.
BUCKET = 50_000


def _kahn(edges: pd.DataFrame) -> pd.DataFrame:
    """Of whole clusters, prerequisites first and ready ones by id: an object's place ``at`` and the greatest id ``top`` of its cluster up to it; ``late`` is what is left in or behind cycles."""
    waiting, after, cluster = {}, {}, {}
    for project, dependent, prerequisite, own in zip(edges["project_id"], edges["object_id"], edges["needs"], edges["cluster_id"], strict=True):
        a, b = (project, dependent), (project, prerequisite)
        waiting[a] = waiting.get(a, 0) + 1
        waiting.setdefault(b, 0)
        after.setdefault(b, []).append(a)
        cluster[a] = cluster[b] = (project, own)
    ready = [n for n, needs in waiting.items() if not needs]
    heapq.heapify(ready)
    top, rows = {}, []
    while ready:
        n = heapq.heappop(ready)
        top[cluster[n]] = max(top.get(cluster[n], n[1]), n[1])
        rows.append((*n, False, top[cluster[n]], len(rows)))
        for dependent in after.get(n, ()):
            waiting[dependent] -= 1
            if not waiting[dependent]:
                heapq.heappush(ready, dependent)
    rows += [(*n, True, n[1], 0) for n, needs in waiting.items() if needs]
    return pd.DataFrame(rows, columns=["project_id", "object_id", "late", "top", "at"])


def ordered(baselines: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, object_id, seq): stable topological order per project: prerequisites first, ready ones by id; what is left in or behind cycles follows by id.

    A cluster, the objects that edges connect, has an order of its own, made in one task. Of the clusters' next objects the least always
    goes first, so an object stands where the greatest id of its cluster up to it belongs; these are placed by ranges, and no task
    holds a project."""
    rounds, keys, order = Rounds(baselines.sparkSession, "order"), ["project_id", "object_id"], "project_id string, object_id string, late boolean, top string, at int"
    rounds.write(0, nodes=baselines.select(*keys).distinct())
    nodes = rounds.read("nodes", "project_id string, object_id string", 0)
    rounds.write(1, edges=graph.pruned(nodes, edges))
    e = rounds.read("edges", graph.EDGE, 1)
    ends = e.select(*keys).unionByName(e.select("project_id", F.col("needs").alias("object_id"))).distinct()
    bucket = F.pmod(F.xxhash64("project_id", "cluster_id"), F.lit(max(1, -(-e.count() // BUCKET))))
    found = e.join(graph.clusters_of(ends, e).hint("merge"), keys).groupBy(bucket.alias("bucket")).applyInPandas(_kahn, order)
    lone = nodes.join(ends.hint("merge"), keys, "left_anti").select(*keys, F.lit(False).alias("late"), F.col("object_id").alias("top"), F.lit(0).alias("at"))
    rounds.write(2, order=found.unionByName(lone))
    return placed(rounds.read("order", order, 2), ["project_id"], "late", "top", "at").select(*keys, F.col("position").cast("int").alias("seq"))


def waves(baselines: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, object_id, component_id, cyclic, wave): the length of the longest way to an object without prerequisites, the objects of a cycle being one."""
    return graph.components(baselines, edges)


def package_blocks(versions: DataFrame, order: DataFrame) -> DataFrame:
    """(project_id, seq, block): the package without its header, a row per baseline: its SQL under a line that names it."""
    rows = versions.where("status = 'BASELINE'").join(order.hint("merge"), ["project_id", "object_id"])
    block = F.concat(F.lit("-- object: "), F.col("object_id"), F.lit(", version: "), F.col("version_number").cast("string"), F.lit("\n"), T.stripped(F.col("target_sql")), F.lit("\n\n"))
    return rows.select("project_id", "seq", block.alias("block"))


def package_header() -> Column:
    return F.concat(F.lit("-- SQL package\n-- project: "), F.col("project_id"), F.lit("\n\n"))


def package_text(versions: DataFrame, order: DataFrame) -> DataFrame:
    """(project_id, sql): a header, then the blocks in order. One value holds a project's file; ``package_blocks`` has the same by rows."""
    gathered = package_blocks(versions, order).groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("seq", "block"))).alias("b"))
    return gathered.select("project_id", F.concat(package_header(), F.array_join("b.block", "")).alias("sql"))


def preview_heads(gated: DataFrame) -> DataFrame:
    """What a preview says of every project whose gate is open, without its objects: these are the rows of ``order``."""
    return gated.where("status = 'READY'").select("project_id", "status", "baseline_count", F.lit(1).alias("approved_review_count"), "blocker_count", F.array(F.lit(PACKAGE_FILE)).alias("files"))


def preview(gated: DataFrame, order: DataFrame) -> DataFrame:
    """Previews with their objects in order. One value holds a project's ids; ``preview_heads`` goes without them."""
    ids = order.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("seq", "object_id"))).alias("o")).select("project_id", F.col("o.object_id").alias("object_ids"))
    return preview_heads(gated).join(ids, "project_id")


def write_package(text: DataFrame, path: str) -> None:
    """One text file per project below ``path``."""
    text.select("project_id", F.col("sql").alias("value")).write.mode("overwrite").partitionBy("project_id").text(path)


def latest_first(reports: DataFrame) -> DataFrame:
    return reports.withColumn("rn", F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("created_at"), "report_id"))).where("rn = 1").drop("rn")
