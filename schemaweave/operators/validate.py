"""Evidence from the data itself: value profiles, row counts, samples, shard checksums, sequence positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, MapType, StructType, TimestampNTZType, TimestampType


def value_profile(df: DataFrame, columns: list[str], table: str) -> DataFrame:
    """Per column: rows, nulls, least, greatest, values with a fraction, and the type the values allow. One pass over the table."""
    aggs = []
    for c in columns:
        x, kind = F.col(c), df.schema[c].dataType
        if isinstance(kind, (FloatType, DoubleType)):
            split = (x != F.floor(x)) | F.isnan(x)
            bound = lambda v, bits: (v >= F.lit(-(2.0**bits))) & (v < F.lit(2.0**bits))
        else:  # integers and decimals keep their type, so no digit is lost
            split = x % 1 != 0
            exact = lambda n: F.lit(str(n)).cast("decimal(38,0)")
            bound = lambda v, bits: (v >= exact(-(2**bits))) & (v <= exact(2**bits - 1))
        within = lambda bits: bound(F.min(x), bits) & bound(F.max(x), bits)  # noqa: B023, E731
        fit = F.when((F.count(x) == 0) | (F.count_if(split) > 0), "numeric").when(within(31), "integer").when(within(63), "bigint").otherwise("numeric")
        aggs += [F.count(x).alias(f"{c}__n"), F.min(x).cast("double").alias(f"{c}__min"), F.max(x).cast("double").alias(f"{c}__max"), F.count_if(split).alias(f"{c}__frac"), fit.alias(f"{c}__fit")]
    one = df.agg(F.count("*").alias("rows"), *aggs)
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__n").alias("n"), F.col(f"{c}__min").alias("min_value"), F.col(f"{c}__max").alias("max_value"), F.col(f"{c}__frac").alias("fractions"), F.col(f"{c}__fit").alias("narrowest")) for c in columns)))
    p = one.select("rows", rows.alias("x")).select(F.lit(table).alias("table_name"), "rows", "x.*")
    return p.withColumn("nulls", F.col("rows") - F.col("n"))


def shard(key: Column, shards: int) -> Column:
    """A shard by content that any engine can compute: the first 7 hex digits of the MD5 of the key's text."""
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, 7), 16, 10).cast("long") % shards).cast("int")


def shared_text(df: DataFrame, column: str) -> Column:
    """A value in a form that any engine can write: its length, a colon and its text, or N for null.

    Integers, strings and booleans as they are; decimals with their scale; floating-point numbers to six decimals; dates as
    yyyy-mm-dd; timestamps as microseconds since 1970 in the session's zone; binary in hexadecimal digits; anything else as JSON."""
    x, kind = F.col(column), df.schema[column].dataType
    if isinstance(kind, (FloatType, DoubleType)):
        name = F.when(F.isnan(x), "NaN").when(x == float("inf"), "Infinity").when(x == float("-inf"), "-Infinity")
        text = F.coalesce(name, x.try_cast("decimal(38,6)").cast("string"), x.cast("string"))
    elif isinstance(kind, TimestampNTZType):
        text = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{column}`)").cast("string")
    elif isinstance(kind, TimestampType):
        text = F.unix_micros(x).cast("string")
    elif isinstance(kind, BinaryType):
        text = F.lower(F.hex(x))
    elif isinstance(kind, (ArrayType, MapType, StructType)):
        text = F.to_json(F.struct(x.alias("x")))
    else:
        text = x.cast("string")
    return F.when(x.isNull(), "N").otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text))


def row_digest(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The first 15 hexadecimal digits of the MD5 of a row's values, as a number; of all columns unless some are named."""
    text = F.concat(*(shared_text(df, c) for c in columns or df.columns))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _halves(digest: Column) -> tuple[Column, Column]:
    """Sums of the upper and the lower 30 bits of digests: sums of longs, exact up to 2^33 rows, cost a fraction of those of decimals."""
    return F.sum(F.shiftright(digest, 30)), F.sum(digest.bitwiseAND(F.lit((1 << 30) - 1)))


def _summed(digest: Column) -> Column:
    upper, lower = _halves(digest)
    return (upper.cast("decimal(27,0)") * F.lit(1 << 30).cast("decimal(10,0)") + lower.cast("decimal(20,0)")).cast("decimal(38,0)")


def shard_checksums(df: DataFrame, key: str, columns: list[str] | None = None, shards: int = 16) -> DataFrame:
    """(shard, rows, checksum): sums, so that order and partitioning don't matter and partial aggregates do the work."""
    return df.select(shard(F.col(key), shards).alias("shard"), row_digest(df, columns).alias("d")).groupBy("shard").agg(F.count("*").alias("rows"), _summed(F.col("d")).cast("string").alias("checksum"))


def _leaf(df: DataFrame, keys: list[str], depth: int) -> Column:
    """Where a row hangs in the tree of shards: the first ``depth`` hexadecimal digits of the MD5 of its key."""
    return F.substring(F.md5(F.concat(*(shared_text(df, k) for k in keys))), 1, depth)


def checksum_tree(df: DataFrame, keys: list[str], depth: int = 3) -> DataFrame:
    """(level, shard, rows, checksum): 16 ** depth leaves in one pass over the table, and the levels above them from the leaves; '' is the whole table."""
    leaves = df.select(_leaf(df, keys, depth).alias("leaf"), row_digest(df).alias("d")).groupBy("leaf").agg(F.count("*").alias("rows"), _summed(F.col("d")).alias("checksum"))
    every = leaves.select("rows", "checksum", F.explode(F.transform(F.sequence(F.lit(0), F.lit(depth)), lambda n: F.struct(n.alias("level"), F.substring("leaf", F.lit(1), n).alias("shard")))).alias("x"))
    return every.groupBy("x.level", "x.shard").agg(F.sum("rows").alias("rows"), F.sum("checksum").alias("checksum"))


def unequal_shards(before: DataFrame, after: DataFrame, keys: list[str], depth: int = 3) -> DataFrame:
    """(level, shard, rows_before, rows_after) of the shards whose rows or checksums differ, from the whole table down to the leaves."""
    b = checksum_tree(before, keys, depth).toDF("level", "shard", "rows_before", "b")
    a = checksum_tree(after, keys, depth).toDF("level", "shard", "rows_after", "a")
    j = b.join(a, ["level", "shard"], "full_outer")
    return j.where(~(F.col("rows_before").eqNullSafe(F.col("rows_after")) & F.col("b").eqNullSafe(F.col("a")))).select("level", "shard", F.coalesce("rows_before", F.lit(0)).alias("rows_before"), F.coalesce("rows_after", F.lit(0)).alias("rows_after"))


def differences(before: DataFrame, after: DataFrame, keys: list[str], depth: int = 3) -> DataFrame:
    """The keys whose rows aren't the same: ADDED, REMOVED or CHANGED, with how many rows each side has of them.

    Both tables are read once for the tree; only rows of leaves that differ are read again, with their keys and digests, and
    meet by key. Rows may share a key: what counts is which rows there are and how often. Two different sets of rows are taken
    for equal with a chance of about 2^-60."""
    bad = unequal_shards(before, after, keys, depth).where(F.col("level") == depth).select(F.col("shard").alias("leaf"))

    both = before.select(*keys, _leaf(before, keys, depth).alias("leaf"), row_digest(before).alias("d"), F.lit(1).alias("sign")).unionByName(after.select(*keys, _leaf(after, keys, depth).alias("leaf"), row_digest(after).alias("d"), F.lit(-1).alias("sign")))
    # 16 ** depth leaves at most
    near = both.join(F.broadcast(bad), "leaf", "left_semi")
    # how far the two sides' sums are apart; each half counts with the sign of its side
    apart = F.sum(F.col("sign") * F.shiftright("d", 30)) * F.lit(1 << 30).cast("decimal(10,0)") + F.sum(F.col("sign") * F.col("d").bitwiseAND(F.lit((1 << 30) - 1)))
    j = near.groupBy(*keys).agg(F.count_if(F.col("sign") > 0).alias("rows_before"), F.count_if(F.col("sign") < 0).alias("rows_after"), apart.alias("apart"))
    kind = F.when(F.col("rows_before") == 0, "ADDED").when(F.col("rows_after") == 0, "REMOVED").when((F.col("rows_before") != F.col("rows_after")) | (F.col("apart") != 0), "CHANGED")
    return j.withColumn("difference", kind).where("difference is not null").select(*keys, "difference", "rows_before", "rows_after")


def sampled(df: DataFrame, key: str, one_in: int = 100) -> DataFrame:
    """The same rows in every run and engine."""
    return df.where(shard(F.col(key), one_in) == 0)


def range_shards(df: DataFrame, key: str, shards: int) -> DataFrame:
    """(shard, rows, low, high) of equal widths between the least and the greatest key: two aggregates, no sort."""
    ends = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    width = (F.col("hi") - F.col("lo") + 1).cast("double") / shards
    s = df.select(key).crossJoin(F.broadcast(ends)).withColumn("shard", F.floor((F.col(key) - F.col("lo")) / width).cast("int"))  # ends is one row
    return s.groupBy("shard").agg(F.count("*").alias("rows"), F.min(key).alias("low"), F.max(key).alias("high"))


def depth_shards(df: DataFrame, key: str | None, shards: int, accuracy: int = 10_000) -> DataFrame:
    """Adds ``shard``: ranges of the key, nulls first, with about as many rows each, or without a key a hash of the whole row.

    The cuts come from a mergeable quantile sketch in one pass; each is off by one in ``accuracy`` of all rows at most. A key that
    fills several shards is one that several cuts share; these keys are counted exactly, and their rows dealt over the places
    that they take by a hash of the row, so such a shard is also off by what the hash deals unevenly; rows equal in all columns stay together."""
    draw = F.pmod(F.xxhash64(*df.columns), F.lit(1 << 30)) / float(1 << 30)
    if key is None:
        return df.withColumn("shard", F.floor(draw * shards).cast("int"))
    x, kind = F.col(key), df.schema[key].dataType
    nulls, total = df.agg(F.count_if(x.isNull()), F.count("*")).first()
    wanted = [(i * total / shards - nulls) / (total - nulls) for i in range(1, shards) if i * total / shards > nulls] if total > nulls else []
    cuts = df.agg(F.percentile_approx(x, F.array(*map(F.lit, wanted)), F.lit(accuracy))).first()[0] if wanted else []
    place = F.size(F.filter(F.array(*(F.lit(c).cast(kind) for c in cuts)), lambda c: c < x)) + (shards - 1 - len(cuts)) if cuts else F.lit(shards - 1)
    heavy = [c for c in dict.fromkeys(cuts) if cuts.count(c) > 1]
    spot = lambda before, rows: F.floor((F.lit(float(before)) + draw * rows) * shards / total)
    out = F.when(x.isNull(), spot(0, nulls))
    if heavy:
        counted = df.agg(*(f for c in heavy for f in (F.count_if(x < F.lit(c).cast(kind)), F.count_if(x == F.lit(c).cast(kind))))).first()
        for n, c in enumerate(heavy):
            out = out.when(x == F.lit(c).cast(kind), spot(nulls + counted[2 * n], counted[2 * n + 1]))
    return df.withColumn("shard", out.otherwise(place).cast("int"))


def sequence_positions(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(table_name, next_value): where each table's sequence must go on."""
    out = None
    for name, (df, key) in sorted(tables.items()):
        one = df.agg((F.coalesce(F.max(key), F.lit(0)) + 1).cast("long").alias("next_value")).select(F.lit(name).alias("table_name"), "next_value")
        out = one if out is None else out.unionByName(one)
    return out


# The stages of a migration plan in order, and the object types each one executes.
STAGES = ["PREPARE_TARGET", "CAPTURE_SOURCE_SNAPSHOT", "PRECHECK_TARGET", "DRY_RUN_DDL", "DRY_RUN_UNDO", "CREATE_SCHEMA", "CREATE_TABLE", "LOAD_DATA", "CREATE_INDEX", "CREATE_CONSTRAINT", "CREATE_VIEW", "CREATE_ROUTINE", "CREATE_TRIGGER", "RESET_SEQUENCE", "REPLAY_GRANT", "ANALYZE_TARGET", "VALIDATE", "FINALIZE_ARCHIVE"]
STAGE_OF = {"TABLE": "CREATE_TABLE", "INDEX": "CREATE_INDEX", "VIEW": "CREATE_VIEW", "FUNCTION": "CREATE_ROUTINE", "PROCEDURE": "CREATE_ROUTINE", "PACKAGE": "CREATE_ROUTINE", "PACKAGE_BODY": "CREATE_ROUTINE", "TRIGGER": "CREATE_TRIGGER", "SEQUENCE": "RESET_SEQUENCE"}


def plan_stages(objects: DataFrame) -> DataFrame:
    """(project_id, position, stage, objects): all stages of every project with how many objects each one executes."""
    spark = objects.sparkSession
    stages = F.broadcast(spark.createDataFrame(list(enumerate(STAGES, 1)), "position int, stage string"))  # eighteen rows
    of = F.element_at(F.create_map(*[F.lit(x) for kv in STAGE_OF.items() for x in kv]), F.col("type"))
    counts = objects.select("project_id", of.alias("stage")).groupBy("project_id", "stage").agg(F.count("*").alias("objects"))
    return objects.select("project_id").distinct().crossJoin(stages).join(counts, ["project_id", "stage"], "left").withColumn("objects", F.coalesce("objects", F.lit(0)))
