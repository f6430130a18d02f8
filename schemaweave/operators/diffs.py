"""Differences, boards and folds over the model's tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph
from .places import placed
from .scratch import Rounds


def batch_diff(before: DataFrame, after: DataFrame, key: str = "relative_path", value: str = "content_hash") -> DataFrame:
    """(key, change): ADDED, REMOVED, CHANGED or SAME."""
    b, a = before.select(key, F.col(value).alias("b")), after.select(key, F.col(value).alias("a"))
    j = b.join(a, key, "full_outer")
    return j.select(key, F.when(F.col("b").isNull(), "ADDED").when(F.col("a").isNull(), "REMOVED").when(F.col("a") != F.col("b"), "CHANGED").otherwise("SAME").alias("change"))


#: Columns of what is compared between batches, and in which order rows find their counterpart: what they then are, and what they must agree in.
FILES = ["project_id", "relative_path", "content_hash"], [("CHANGED", ["project_id", "relative_path"]), ("MOVED", ["project_id", "content_hash"])]
OBJECTS = ["project_id", "type", "schema_name", "object_name", "source_path", "sql_hash"], [("MOVED", ["project_id", "type", "schema_name", "object_name", "sql_hash"]), ("CHANGED", ["project_id", "type", "schema_name", "object_name"]), ("RETYPED", ["project_id", "schema_name", "object_name"])]
RISKS = ["project_id", "source_path", "type", "schema_name", "object_name", "code", "level"], [("MOVED", ["project_id", "type", "schema_name", "object_name", "code", "level"]), ("CHANGED", ["project_id", "type", "schema_name", "object_name", "code"])]


def object_rows(objects: DataFrame) -> DataFrame:
    return objects.select("project_id", "type", "schema_name", "object_name", "source_path", F.sha2("original_sql", 256).alias("sql_hash"))


def risk_rows(risks: DataFrame, objects: DataFrame) -> DataFrame:
    named = objects.select("object_id", "source_path", "type", "schema_name", "object_name")
    return risks.select("project_id", "object_id", "code", "level").join(named.hint("merge"), "object_id").drop("object_id")


def matched(before: DataFrame, after: DataFrame, columns: list[str], steps: list[tuple[str, list[str]]]) -> DataFrame:
    """(change, before, after): a row per row of either side, as a struct of ``columns``; null where a side has none.

    A multiset difference: rows equal in all columns are SAME, as often as both sides have them. The others find a counterpart step by
    step among those that agree in the step's columns, the first with the first in the order of the rest and so on; what is left is
    REMOVED or ADDED. Occurrences are numbered by ranges (``places``), so a value that a third of all rows share is no one task's work."""

    def single(df: DataFrame) -> DataFrame:
        return df.select(columns).groupBy(*columns).agg(F.count("*").cast("int").alias("n")).select(*columns, F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))

    rounds, schema = Rounds(before.sparkSession, "matched"), None
    of = lambda side: F.struct(*(F.col(f"{side}.{c}").alias(c) for c in columns))
    out, left = [], {"b": single(before).withColumn("position", F.lit(1).cast("long")), "a": single(after).withColumn("position", F.lit(1).cast("long"))}
    for n, (label, keys) in enumerate([("SAME", [*columns, "copy"]), *steps]):
        rest = [c for c in (*columns, "copy") if c not in keys]
        b, a = ((df if not rest else placed(df.drop("position"), keys, *rest)).alias(side) for side, df in left.items())
        on = F.col("b.position") == F.col("a.position")
        for k in keys:
            on = on & F.col(f"b.{k}").eqNullSafe(F.col(f"a.{k}"))
        j = b.join(a, on, "full_outer").select(F.lit(label).alias("change"), F.when(F.col("b.copy").isNotNull(), of("b")).alias("before"), F.when(F.col("a.copy").isNotNull(), of("a")).alias("after"), F.col("b.copy").alias("b_copy"), F.col("a.copy").alias("a_copy"))
        rounds.deal(n, j, F.when(F.col("after").isNull(), "b").when(F.col("before").isNull(), "a").otherwise("pairs"))
        schema = j.schema
        left = {side: rounds.read(side, schema, n).select(f"{name}.*", F.col(f"{side}_copy").alias("copy"), F.lit(1).cast("long").alias("position")) for side, name in (("b", "before"), ("a", "after"))}
        out.append(rounds.read("pairs", schema, n))
    last = len(steps)
    out += [rounds.read("b", schema, last).withColumn("change", F.lit("REMOVED")), rounds.read("a", schema, last).withColumn("change", F.lit("ADDED"))]
    return functools.reduce(DataFrame.unionByName, out).select("change", "before", "after")


def report_diff(before: DataFrame, after: DataFrame, counts: list[str], key: str = "project_id") -> DataFrame:
    """Per project and count: value before, value after, difference."""
    pack = lambda df, name: df.select(key, F.explode(F.map_from_arrays(F.array(*map(F.lit, counts)), F.array(*(F.col(c).cast("long") for c in counts)))).alias("count_name", name))
    j = pack(before, "before").join(pack(after, "after"), [key, "count_name"], "full_outer")
    return j.withColumn("difference", F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0)))


def duplicates(sources: DataFrame, path: str = "relative_path", digest: str = "content_hash") -> DataFrame:
    """Sources whose content occurs more than once; counts are partial aggregates, so a content that a third shares isn't gathered."""
    many = sources.groupBy(digest).agg(F.count("*").alias("copies"), F.min(path).alias("first_path")).where("copies > 1")
    return sources.join(many.hint("merge"), digest).select(path, digest, "copies", "first_path")


def work_items(issues: DataFrame, risks: DataFrame, reviews: DataFrame, uncertainties: DataFrame) -> DataFrame:
    """Open points of all stages in one table: project_id, source_stage, item, detail."""
    one = lambda df, stage, item, detail: df.select("project_id", F.lit(stage).alias("source_stage"), F.col(item).alias("item"), F.col(detail).alias("detail"))
    return one(issues, "PARSE", "code", "original_text").unionByName(one(risks, "RISK", "code", "message")).unionByName(one(reviews.where("comment <> ''"), "REVIEW", "decision", "comment")).unionByName(one(uncertainties, "ADVICE", "type", "uncertainty"))


def folded_risks(risks: DataFrame, keep: int = 5) -> DataFrame:
    """One row per project, code and level with its count and up to ``keep`` object ids; severity orders them."""
    rank = F.when(F.col("level") == "BLOCKER", 0).when(F.col("level") == "HIGH", 1).when(F.col("level") == "MEDIUM", 2).otherwise(3)
    order = Window.partitionBy("project_id", "code", "level").orderBy("object_id")
    counts = risks.groupBy("project_id", "code", "level").agg(F.count("*").alias("n"))
    shown = risks.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= keep).groupBy("project_id", "code", "level").agg(F.concat_ws(",", F.array_sort(F.collect_list("object_id"))).alias("object_ids"))
    return counts.join(shown, ["project_id", "code", "level"]).withColumn("severity", rank)


def residue(versions: DataFrame) -> DataFrame:
    """(project_id, object_id, code): every risk rule on the target SQL and its blanked form."""
    from . import risk
    from ..functions import textops as T

    target = F.coalesce("target_sql", F.lit(""))
    hits = risk.detect(F.col("target"), F.col("masked"))["code"]
    return versions.select("project_id", "object_id", target.alias("target"), T.blank(target).alias("masked")).select("project_id", "object_id", F.explode(hits).alias("code"))


def stale_artefacts(artefacts: DataFrame, sources: DataFrame) -> DataFrame:
    """Artefacts (source_id, source_hash) whose source has another hash by now, or is gone."""
    s = sources.select("source_id", F.col("content_hash").alias("now_hash"))
    return artefacts.join(s.hint("merge"), "source_id", "left").withColumn("stale", ~F.coalesce(F.col("now_hash") == F.col("source_hash"), F.lit(False)))


def artefact_edges(objects: DataFrame, dependencies: DataFrame, versions: DataFrame, reports: DataFrame) -> DataFrame:
    """(project_id, node, next): from sources to their objects, from objects to those that depend on them and to their versions, from versions to their project's reports and from these to its package. A node is its kind, a bar and its id."""
    named = lambda kind, c: F.concat(F.lit(f"{kind}|"), F.col(c))
    step = lambda df, a, b: df.select("project_id", a.alias("node"), b.alias("next"))
    own = reports.select("project_id", "report_id")
    return (
        step(objects, named("source", "input_source_id"), named("object", "object_id"))
        .unionByName(step(dependencies, named("object", "target_object_id"), named("object", "source_object_id")))
        .unionByName(step(versions, named("object", "object_id"), named("version", "version_id")))
        .unionByName(step(versions.join(own, "project_id"), named("version", "version_id"), named("report", "report_id")))
        .unionByName(step(own, named("report", "report_id"), named("package", "project_id")))
    )


def stale_along(artefacts: DataFrame, changed_sources: DataFrame) -> DataFrame:
    """(project_id, kind, id, stale, distance) of every artefact that ``artefact_edges`` names: stale are the changed sources (project_id,
    source_id) and all that comes of them, ``distance`` steps away at least."""
    seeds = changed_sources.select("project_id", F.concat(F.lit("source|"), F.col("source_id")).alias("node"))
    every = artefacts.select("project_id", "node").unionByName(artefacts.select("project_id", F.col("next").alias("node"))).unionByName(seeds).distinct()
    found = every.join(graph.reached(artefacts, seeds).hint("merge"), ["project_id", "node"], "left")
    return found.select("project_id", F.substring_index("node", "|", 1).alias("kind"), F.regexp_extract("node", r"(?s)^[^|]*\|(.*)$", 1).alias("id"), F.col("distance").isNotNull().alias("stale"), "distance")


def graph_view(objects: DataFrame, risks: DataFrame, dependencies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the graph view: objects and risks, with edges from the input, between objects and to risks."""
    risk_id = F.concat_ws("|", F.col("object_id"), F.col("code"))
    nodes = objects.select("project_id", F.col("object_id").alias("node_id"), F.concat("type", F.lit(": "), "object_name").alias("label")).unionByName(risks.select("project_id", risk_id.alias("node_id"), F.concat("level", F.lit(": "), "code").alias("label")))
    one = lambda df, a, b, label: df.select("project_id", a.alias("source"), b.alias("target"), label.alias("label"))
    edges = one(objects, F.lit("input"), F.col("object_id"), F.lit("")).unionByName(one(dependencies, F.col("source_object_id"), F.col("target_object_id"), F.col("type"))).unionByName(one(risks, F.col("object_id"), risk_id, F.lit("")))
    return nodes, edges
