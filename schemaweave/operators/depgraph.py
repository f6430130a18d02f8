"""Dependency graph: every reference is a key and meets the objects' names in an equi-join.

Edges point from the dependent object to what it needs. A name resolves to one object: of the same source project if there
is one, else the first by type, name, path and offset. Mentions in views and routines are rewritten as joins too: each
identifier of a text and each qualified pair becomes a key. A name that isn't one run of letters, digits, _, $ and # meets the
texts that hold one of its runs, and these are searched for it.
"""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, StringType

from ..functions import textops as T

ID = T.IDENTIFIER
CHAIN = rf"{ID}(?:\s*\.\s*{ID})*"
FOREIGN_KEY = rf"(?i)\breferences\s+({CHAIN})"
NEXTVAL = rf"(?i)(?<![\w$#])({CHAIN})\s*\.\s*nextval\b"
INDEX_ON = rf"(?i)\bcreate\s+(?:(?:unique|bitmap)\s+)?index\s+{CHAIN}\s+on\s+({CHAIN})"
TRIGGER_ON = rf"(?i)\bon\s+({CHAIN})"
DECLARED = re.compile(r'(?is)(\bcreate\s+(?:or\s+replace\s+)?(?:(?:no\s+)?force\s+)?(?:(?:non)?editionable\s+)?(?:view|function|procedure)\s+)((?:"(?:""|[^"])+"|[\w$#]+)(?:\s*\.\s*(?:"(?:""|[^"])+"|[\w$#]+))*)', re.A)
PART = re.compile(r'"(?:""|[^"])+"|[\w$#]+', re.A)
RUN = re.compile(r"[\w$#]+", re.A)
GAP = re.compile(r"\s*\.\s*")
MENTIONERS = ("VIEW", "FUNCTION", "PROCEDURE")


def mention_keys(text: str | None) -> list[str]:
    """Keys of the identifiers in a blanked text, the declared one aside: u:name for a bare part, q:schema.name for a pair."""
    if not text:
        return []
    text = DECLARED.sub(lambda m: m[1] + " " * len(m[2]), text, count=1).lower()
    word = re.compile(r"[\w$#]", re.A)
    before = lambda at: text[at - 1] if at else " "
    after = lambda at: text[at] if at < len(text) else " "
    bare = lambda s: s[1:-1].replace('""', '"') if s.startswith('"') else s
    found = list(PART.finditer(text))
    out = set()
    for m in (*found, *RUN.finditer(text)):
        p, n = before(m.start()), after(m.end())
        if p not in '."' and not word.match(p) and n != '"' and not word.match(n):
            out.add(f"u:{bare(m[0])}")
    for i, m in enumerate(found):
        p = before(m.start())
        if i + 1 < len(found):
            nxt = found[i + 1]
            if GAP.fullmatch(text, m.end(), nxt.start()) and not word.match(p) and not word.match(after(nxt.end())):
                out.add(f"q:{bare(m[0])}.{bare(nxt[0])}")
    return sorted(out)


@pandas_udf(ArrayType(StringType()))
def _mention_keys(text: pd.Series) -> pd.Series:
    return text.map(mention_keys)


def searchable(text: str | None) -> str:
    """A blanked text in lower case with the declared name blank."""
    return DECLARED.sub(lambda m: m[1] + " " * len(m[2]), text or "", count=1).lower()


@pandas_udf(StringType())
def _searchable(text: pd.Series) -> pd.Series:
    return text.map(searchable)


@pandas_udf(ArrayType(StringType()))
def _chunks(text: pd.Series) -> pd.Series:
    """The runs of letters, digits, _, $ and # of a text, and its other characters but white space."""
    return text.map(lambda t: sorted(set(re.findall(r"[\w$#]+|[^\w$#\s]", t, re.A))))


def _odd_pattern(schema: str | None, name: str) -> str:
    """Finds a name, bare or behind its schema, as it stands in a text or in double quotes."""
    part = lambda s: f"(?:{re.escape(s)}|\"{re.escape(s.replace(chr(34), chr(34) * 2))}\")"
    bare = rf'(?<![\w$#.\"]){part(name)}(?![\w$#\"])'
    return bare if not schema else rf"{bare}|(?<![\w$#]){part(schema)}\s*\.\s*{part(name)}(?![\w$#])"


@pandas_udf(BooleanType())
def _holds(text: pd.Series, schema: pd.Series, name: pd.Series) -> pd.Series:
    patterns: dict = {}
    hit = lambda t, s, n: bool((patterns.get((s, n)) or patterns.setdefault((s, n), re.compile(_odd_pattern(s, n), re.A))).search(t))
    return pd.Series([hit(*x) for x in zip(text, schema, name, strict=True)], dtype=bool)


def odd_mentions(objs: DataFrame) -> DataFrame:
    """(mentioner's project_id, source_project_id, object_id, type; target columns): targets whose name isn't one run of letters, digits, _, $ and #."""
    odd = objs.select("project_id", F.col("object_id").alias("target_object_id"), F.col("source_project_id").alias("target_source"), F.col("object_name").alias("target_name"), F.lower("schema_name").alias("s"), F.lower("object_name").alias("n")).where(~F.col("n").rlike(r"^[\w$#]+$"))
    longest = F.element_at(F.array_sort(F.array_union(F.regexp_extract_all("n", F.lit(r"([\w$#]+)"), F.lit(1)), F.regexp_extract_all("n", F.lit(r"([^\w$#\s])"), F.lit(1))), lambda a, b: F.length(b) - F.length(a)), 1)
    texts = objs.where(F.col("type").isin(*MENTIONERS)).select("project_id", "source_project_id", "object_id", "type", _searchable("blank_sql").alias("t"))
    chunks = texts.select("project_id", "object_id", F.explode(_chunks("t")).alias("chunk"))
    likely = chunks.join(odd.withColumn("chunk", longest).hint("merge"), ["project_id", "chunk"]).drop("chunk")
    found = texts.join(likely.hint("merge"), ["project_id", "object_id"]).where(_holds("t", "s", "n"))
    return found.select("project_id", "source_project_id", "object_id", "type", "target_object_id", "target_source", "target_name")


def names(objs: DataFrame) -> DataFrame:
    """(project_id, key, what an edge needs of the target): bare and qualified names in lower case."""
    bare = F.lower("object_name")
    both = F.when(F.col("schema_name").isNotNull(), F.array(bare, F.concat(F.lower("schema_name"), F.lit("."), bare))).otherwise(F.array(bare))
    return objs.select("project_id", F.explode(both).alias("key"), F.col("object_id").alias("target_object_id"), F.col("type").alias("target_type"), F.col("source_project_id").alias("target_source"), F.col("object_name").alias("target_name"), F.col("source_path").alias("target_path"), F.col("start_offset").alias("target_offset"))


def _resolved(refs: DataFrame, known: DataFrame) -> DataFrame:
    """refs: project_id, source_project_id, object_id, pos, ref, evidence, and per kind of reference ``edge``; ``wanted`` limits its candidates, ``after`` the one chosen; ``own``: an object may need itself. All kinds meet the names in one join."""
    hits = refs.withColumn("key", T.normalise(F.col("ref"))).join(known.hint("merge"), ["project_id", "key"]).where("wanted is null or target_type = wanted")
    first = Window.partitionBy("object_id", "edge", "pos").orderBy(F.desc(F.col("source_project_id") == F.col("target_source")), "target_type", "target_name", "target_path", "target_offset")
    hits = hits.withColumn("rn", F.row_number().over(first)).where("rn = 1 and (after is null or target_type = after) and (own or object_id <> target_object_id)")
    best = hits.groupBy("project_id", "source_project_id", "object_id", "edge", "target_object_id", "target_source").agg(F.min_by("evidence", "pos").alias("evidence"))
    kind = F.when(F.col("source_project_id") != F.col("target_source"), "CROSS_SOURCE_DEPENDENCY").otherwise(F.col("edge"))
    return best.select("project_id", "source_project_id", F.col("object_id").alias("source_object_id"), "target_object_id", kind.alias("type"), "evidence")


def _kind(refs: DataFrame, edge: str, wanted: str | None = None, after: str | None = None, own: bool = False) -> DataFrame:
    return refs.select("*", F.lit(edge).alias("edge"), F.lit(wanted).cast("string").alias("wanted"), F.lit(after).cast("string").alias("after"), F.lit(own).alias("own"))


def _all(objs: DataFrame, pattern: str) -> DataFrame:
    whole, ids = F.regexp_extract_all("blank_sql", F.lit(pattern), F.lit(0)), F.regexp_extract_all("blank_sql", F.lit(pattern), F.lit(1))
    return objs.select("project_id", "source_project_id", "object_id", F.posexplode(F.arrays_zip(ids.alias("ref"), whole.alias("evidence"))).alias("pos", "m")).select("project_id", "source_project_id", "object_id", "pos", "m.ref", "m.evidence")


def _first(objs: DataFrame, pattern: str) -> DataFrame:
    ref = F.regexp_extract("blank_sql", pattern, 1)
    return objs.where(ref != "").select("project_id", "source_project_id", "object_id", F.lit(0).alias("pos"), ref.alias("ref"), F.regexp_extract("blank_sql", pattern, 0).alias("evidence"))


def mentions(objs: DataFrame) -> DataFrame:
    """Views and routines to every object their text names; of objects with one bare name those of the same source project, if any."""
    keys = objs.where(F.col("type").isin(*MENTIONERS)).select("project_id", "source_project_id", "object_id", "type", F.explode(_mention_keys("blank_sql")).alias("key"))
    known = names(objs).withColumn("key", F.concat(F.when(F.col("key") == F.lower("target_name"), "u:").otherwise("q:"), F.col("key")))
    hits = keys.join(known.hint("merge"), ["project_id", "key"]).select("project_id", "source_project_id", "object_id", "type", "target_object_id", "target_source", "target_name")
    hits = hits.unionByName(odd_mentions(objs)).where("object_id <> target_object_id")
    hits = hits.dropDuplicates(["object_id", "target_object_id"]).withColumn("same", F.col("source_project_id") == F.col("target_source"))
    any_same = F.max("same").over(Window.partitionBy("object_id", F.lower("target_name")))
    kind = F.when(F.col("type") == "VIEW", "VIEW_REFERENCES_TABLE").otherwise("ROUTINE_REFERENCES_OBJECT")
    return hits.withColumn("any_same", any_same).where("same or not any_same").select("project_id", "source_project_id", F.col("object_id").alias("source_object_id"), "target_object_id", F.when(~F.col("same"), "CROSS_SOURCE_DEPENDENCY").otherwise(kind).alias("type"), F.col("target_name").alias("evidence"))


def missing(objs: DataFrame, versions: DataFrame) -> DataFrame:
    """(project_id, object_id, key): what tables, indexes and triggers refer to, and the package of a body, of which no object has a version. Names in views and routines may be aliases or columns, so they are not counted."""
    of = lambda t: objs.where(F.col("type") == t)
    known = names(objs.join(versions.select("object_id").distinct().hint("merge"), "object_id", "left_semi")).select("project_id", "key", "target_type")
    bodies = of("PACKAGE_BODY").select("project_id", "object_id", F.lower(F.when(F.col("schema_name").isNotNull(), F.concat_ws(".", "schema_name", "object_name")).otherwise(F.col("object_name"))).alias("key"))
    parts = [(_all(of("TABLE"), FOREIGN_KEY), "target_type = 'TABLE'"), (_all(of("TABLE"), NEXTVAL), "target_type = 'SEQUENCE'"), (_first(of("INDEX"), INDEX_ON), "target_type = 'TABLE'"), (_first(of("TRIGGER"), TRIGGER_ON), "true")]
    found = bodies.join(known.where("target_type = 'PACKAGE'").hint("merge"), ["project_id", "key"], "left_anti")
    for refs, wanted in parts:
        keys = refs.select("project_id", "object_id", T.normalise(F.col("ref")).alias("key"))
        found = found.unionByName(keys.join(known.where(wanted).hint("merge"), ["project_id", "key"], "left_anti").select("project_id", "object_id", "key"))
    return found.distinct()


def dependencies(objs: DataFrame) -> DataFrame:
    """object_dependency rows of all objects of all projects."""
    known = names(objs)
    of = lambda t: objs.where(F.col("type") == t)
    own = of("PACKAGE_BODY")
    spelled = F.when(F.col("schema_name").isNotNull(), F.concat_ws(".", *(F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')) for c in ("schema_name", "object_name")))).otherwise(F.concat(F.lit('"'), F.replace("object_name", F.lit('"'), F.lit('""')), F.lit('"')))
    bodies = own.select("project_id", "source_project_id", "object_id", F.lit(0).alias("pos"), spelled.alias("ref"), F.col("object_name").alias("evidence"))
    refs = [
        _kind(_all(of("TABLE"), FOREIGN_KEY), "TABLE_REFERENCES_TABLE", "TABLE"),
        _kind(_all(of("TABLE"), NEXTVAL), "TABLE_USES_SEQUENCE", "SEQUENCE"),
        _kind(_first(of("INDEX"), INDEX_ON), "INDEX_ON_TABLE", "TABLE"),
        _kind(_first(of("TRIGGER"), TRIGGER_ON), "TRIGGER_ON_TABLE", own=True),
        _kind(bodies, "PACKAGE_BODY_FOR_SPEC", after="PACKAGE"),  # of all candidates, the first must be the package
    ]
    return _resolved(functools.reduce(DataFrame.unionByName, refs), known).unionByName(mentions(objs))
