"""Sources: inline SQL, files, folders and zip archives as input_source rows; violations are rows too."""

from __future__ import annotations

import io
import urllib.parse
import zipfile
import zlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType

from ..functions import textops as T

# The import limits, and what is said about an archive that breaks one.
MAX_FILE_BYTES, MAX_BATCH_BYTES, MAX_ZIP_ENTRIES, MAX_ZIP_RATIO = 10 * 1024 * 1024, 50 * 1024 * 1024, 2000, 100
ZIP_FILE, ZIP_ENTRIES, ZIP_ENTRY, ZIP_TOTAL, ZIP_RATIO, ZIP_BAD, ZIP_NONE, ZIP_PATH = "Zip file is too large", "Zip contains too many files", "Zip entry is too large: ", "Zip uncompressed size is too large", "Zip expansion ratio is too high", "Invalid zip file", "Zip contains no SQL files", "Illegal file path: "
FILE = "batch_id string, relative_path string, content binary, type string"


def inline_source(spark: SparkSession, batch_id: str, sql: str, name: str | None = None) -> DataFrame:
    """One file row of inline SQL; the name is trimmed and defaults to manual.sql."""
    if not (sql or "").strip(T.WHITE):
        raise ValueError("SQL must not be blank")
    return spark.createDataFrame([(batch_id, (name or "").strip(T.CONTROLS) if (name or "").strip(T.WHITE) else "manual.sql", bytearray(sql.encode()), "MANUAL_SQL")], FILE)


def relative_to(root: str, path: Column) -> Column:
    """A path below ``root``, taken literally; the base name of the root itself. Both with or without a scheme."""
    bare = F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")
    root = "/" + root.rstrip("/").split(":", 1)[-1].lstrip("/")
    return F.when(bare.startswith(root + "/"), F.substring(bare, len(root) + 2, 1 << 30)).otherwise(T.base_name(bare))


def file_source(spark: SparkSession, path: str, batch_id: str) -> DataFrame:
    """All files below ``path`` with paths relative to it. The reader skips empty files, so these come from its own listing, without content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    listed = spark.createDataFrame([(urllib.parse.unquote(p),) for p in files.inputFiles()], "path string")
    bare = lambda c: F.regexp_replace(c, "^([A-Za-z][A-Za-z0-9+.-]*):/*", "$1:/")
    empty = listed.select(bare("path").alias("path")).join(files.select(bare("path").alias("path")), "path", "left_anti").select("path", F.to_binary(F.lit(""), F.lit("utf-8")).alias("content"))
    both = files.select("path", "content").unionByName(empty)
    return both.select(F.lit(batch_id).alias("batch_id"), relative_to(path, F.col("path")).alias("relative_path"), "content")


def unzipped(content: bytes) -> tuple[list[tuple[str, bytes]], str | None]:
    """The file entries of an archive, or what is wrong with it; bytes are counted as they come out, not as declared."""
    if len(content) > MAX_FILE_BYTES:
        return [], ZIP_FILE
    if not content.startswith(b"PK"):
        return [], ZIP_NONE
    out, total = [], 0
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for i, e in enumerate(e for e in archive.infolist() if not e.is_dir()):
                if i >= MAX_ZIP_ENTRIES:
                    return [], ZIP_ENTRIES
                name = e.filename.replace("\\", "/")
                if not name.strip(T.WHITE) or name.startswith("/") or "../" in name or name == ".." or ":/" in name:
                    return [], ZIP_PATH + e.filename
                with archive.open(e) as f:
                    data = f.read(MAX_FILE_BYTES + 1)
                total += len(data)
                if len(data) > MAX_FILE_BYTES:
                    return [], ZIP_ENTRY + name
                if total > MAX_BATCH_BYTES:
                    return [], ZIP_TOTAL
                if total // len(content) > MAX_ZIP_RATIO:
                    return [], ZIP_RATIO
                out.append((name, data))
    except (zipfile.BadZipFile, zipfile.LargeZipFile, zlib.error, EOFError, OSError, RuntimeError, NotImplementedError, ValueError):  # cut, damaged, encrypted or compressed in an unknown way
        return [], ZIP_BAD
    return out, None if out else ZIP_NONE


@udtf(returnType=StructType().add("relative_path", "string").add("content", "binary").add("problem", "string"))
class UnzipEntries:
    """unzip_entries(content): a row per file entry; what is wrong with an archive is a single row with a problem."""

    def eval(self, content: bytes):
        entries, problem = unzipped(bytes(content or b""))
        if problem:
            yield None, None, problem
        for name, data in entries:
            yield name, data, None


def zip_source(archives: DataFrame) -> DataFrame:
    """Entries of archives (batch_id, content) as file rows with ``problem``."""
    spark = archives.sparkSession
    spark.udtf.register("unzip_entries", UnzipEntries)
    return spark.sql("SELECT a.batch_id, z.relative_path, z.content, z.problem, 'SQL_FILE' AS type FROM {archives} a, LATERAL unzip_entries(a.content) z", archives=archives)


def violations(files: DataFrame) -> DataFrame:
    """The files (batch_id, relative_path, content) with ``violation``: the first rule each breaks, null if none.

    A batch's running size counts in order of path, files of one path together; only paths and sizes go through that window,
    and only the paths beyond the limit meet the files again."""
    size = F.length("content").cast("long")
    sizes = files.select("batch_id", "relative_path", size.alias("size")).groupBy("batch_id", "relative_path").agg(F.sum("size").alias("size"))
    big = sizes.groupBy("batch_id").agg(F.sum("size").alias("total")).where(F.col("total") > MAX_BATCH_BYTES)
    running = F.sum("size").over(Window.partitionBy("batch_id").orderBy("relative_path"))
    beyond = sizes.join(big, "batch_id", "left_semi").withColumn("running", running).where(F.col("running") > MAX_BATCH_BYTES).select(F.col("batch_id").alias("__batch"), F.col("relative_path").alias("__path"), F.lit(True).alias("__beyond"))
    rows = files.join(beyond, files["batch_id"].eqNullSafe(F.col("__batch")) & files["relative_path"].eqNullSafe(F.col("__path")), "left")
    archive = F.when(F.col("problem").isNotNull(), "ZIP") if "problem" in files.columns else F.lit(None).cast("string")
    why: Column = (
        F.when(~F.coalesce(T.allowed_extension(T.normal_path(F.col("relative_path"))), F.lit(False)), "EXTENSION")
        .when(F.coalesce(size, F.lit(0)) == 0, "EMPTY")
        .when(size > MAX_FILE_BYTES, "FILE_SIZE")
        .when(F.col("__beyond"), "BATCH_SIZE")
        .when(T.illegal_path(F.col("relative_path")), "PATH")
        .when(~F.expr("is_valid_utf8(cast(content as string))"), "ENCODING")
    )
    return rows.withColumn("violation", F.coalesce(archive, why)).select(*(files[c] for c in files.columns), "violation")


def input_sources(files: DataFrame, project_id: str, source_project_id: str, at: Column | None = None) -> DataFrame:
    """input_source rows of the files that break no rule. A ``type`` column says where they come from; without one a batch of several files is a FOLDER."""
    at = F.current_timestamp() if at is None else at
    ok = violations(files).where("violation is null").withColumn("original_text", F.decode("content", "UTF-8")).withColumn("relative_path", T.normal_path(F.col("relative_path")))
    if "type" not in files.columns:
        several = files.groupBy("batch_id").agg(F.when(F.count("*") > 1, "FOLDER").otherwise("SQL_FILE").alias("type"))
        ok = ok.join(several, "batch_id")
    key = F.sha2(F.concat_ws("|", F.lit(project_id), F.lit(source_project_id), "batch_id", "relative_path"), 256)
    return ok.select(key.alias("input_source_id"), "batch_id", F.lit(project_id).alias("project_id"), F.lit(source_project_id).alias("source_project_id"), "type", T.base_name(F.col("relative_path")).alias("name"), F.col("relative_path").alias("source_path"), F.sha2("original_text", 256).alias("content_hash"), F.length("content").cast("long").alias("size_bytes"), F.lit("UTF-8").alias("encoding"), "original_text", at.alias("created_at"))


def input_batches(sources: DataFrame) -> DataFrame:
    """input_batch rows of the sources that came in."""
    return sources.groupBy("batch_id", "project_id", "source_project_id").agg(F.lit("IMPORTED").alias("status"), F.min("created_at").alias("created_at"))


def out_of_scope(sources: DataFrame, source_projects: DataFrame) -> DataFrame:
    """Sources whose source project doesn't exist in their project."""
    return sources.join(source_projects.select("project_id", "source_project_id"), ["project_id", "source_project_id"], "left_anti")


def register_projects(projects: DataFrame, at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(project, source_project) rows: names trimmed, blank ones dropped, a default unit for inline SQL each."""
    at = F.current_timestamp() if at is None else at
    p = projects.where(~T.is_blank(F.col("name"))).withColumn("name", T.trimmed(F.col("name"))).withColumn("status", F.lit("DRAFT")).withColumn("created_at", at)
    unit = p.select("project_id", F.sha2(F.concat(F.col("project_id"), F.lit("|manual")), 256).alias("source_project_id"), F.lit("Manual SQL").alias("name"), F.lit("MANUAL_BATCH").alias("type"), "created_at")
    return p, unit


def register_units(units: DataFrame, at: Column | None = None) -> DataFrame:
    """source_project rows of (project_id, name, type): names trimmed, blank ones dropped, DATABASE_EXPORT where no type is given."""
    at = F.current_timestamp() if at is None else at
    u = units.where(~T.is_blank(F.col("name"))).withColumn("name", T.trimmed(F.col("name")))
    return u.select("project_id", F.sha2(F.concat_ws("|", "project_id", "name"), 256).alias("source_project_id"), "name", F.coalesce("type", F.lit("DATABASE_EXPORT")).alias("type"), at.alias("created_at"))
