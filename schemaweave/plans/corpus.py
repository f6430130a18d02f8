"""A deterministic corpus of source text made from the ``part`` table by one SQL expression that Spark and DuckDB both read.

Sixteen templates by p_partkey % 16; each row is a source with one statement. Names are unique, and templates refer to
others of their group of sixteen, so what an operator must find follows from key arithmetic.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType

#: ``§`` is the key, ``§-5`` a neighbour's; ``~`` an apostrophe, ``^`` a line end and ````` a tab in the template.
TEMPLATES = [
    "create table app.t§ (^  id number(10,0) primary key,^  name^    varchar2(100 char)^    not null,^`note`clob`^);",
    "create table t§ (^`id number(19,0),^`made date^`  default sysdate,^`flag`varchar2(1)^ default ~~`,^` constraint t§_pk primary key (id) using index enable);",
    "-- child of another^create table t§ (amount number, raw_id raw(16), ref_id number(10,0) references app.t§-2 (id));",
    "create table t§ (label varchar2(50) default q~[it~s, (ok); number]~, n number(8,2) default s§+4.nextval);",
    'create table "Mixed t§" ("Id" number(10,0), "Big Text" nclob);',
    "create or replace view v§ as select id, name from app.t§-5 where rownum < 10;",
    "create unique index i§ on app.t§-6 (id);",
    "create sequence s§ start with 1;",
    "create or replace trigger g§ before insert on app.t§-8 for each row^begin^  null;^end;^/",
    "create or replace function f§ return number is^begin^  execute immediate ~drop table t§-7~;^  return app.t§-9;^end;^/",
    "create or replace package k§ as^  g_count number(5);^  procedure run;^end;^/",
    "create or replace package body k§-1 as^  procedure run is begin null; end;^end;^/",
    "create or replace procedure r§ is^  pragma autonomous_transaction;^begin^  insert into log select * from v§-7; /* sysdate */^end;^/",
    "create view v§ as select /*+ full(x) */ decode(id, 1, ~a~, ~b~) d, nvl(name, ~-~) n from app.t§-13 x connect by prior id = id;",
    "create global temporary table t§ (^`id`number(10,0) `,`d^``date^) on commit preserve rows;",
    "grant select on app.t§-15 to reader;",
]


def _expression(template: str) -> str:
    import re

    text = template.replace("~", "'||chr(39)||'").replace("^", "'||chr(10)||'").replace("`", "'||chr(9)||'")
    text = re.sub(r"§([-+]\d+)?", lambda m: f"'||CAST(p_partkey{' ' + m[1][0] + ' ' + m[1][1:] if m[1] else ''} AS VARCHAR(20))||'", text)
    return f"'{text}'"


CORPUS = (
    "SELECT p_partkey AS k, p_partkey % 16 AS template, 'p'||CAST(p_partkey % 48 - p_partkey % 16 AS VARCHAR(20)) AS project_id, 's'||CAST(p_partkey % 2 AS VARCHAR(20)) AS source_project_id, "
    "CAST(p_partkey AS VARCHAR(20)) AS input_source_id, 'f'||CAST(p_partkey AS VARCHAR(20))||'.sql' AS source_path, CASE p_partkey % 16 "
    + " ".join(f"WHEN {i} THEN {_expression(t)}" for i, t in enumerate(TEMPLATES))
    + " END AS original_text FROM part"
)


#: Sources that one task makes and parses.
SOURCES = 10_000


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of ``part``, dealt by a hash: as a file they are a few bytes each, so that millions would be one task's texts."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    return part.repartition(max(1, -(-part.count() // SOURCES)), "p_partkey")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CORPUS.replace("FROM part", "FROM {part}"), part=_keys(spark, sf_dir))


#: Tables that refer to others by key arithmetic, 128 to a group: a chain of 67, a ring of eight on it, two behind the ring, a pair on
#: the ring, one on both, one that refers to itself, two pairs one of which needs the other, and lone tables; every even key needs its project's hub.
LINKS = """SELECT p_partkey AS k, p_partkey % 128 AS m, 'p'||CAST(CAST((p_partkey - p_partkey % 128) / 128 AS BIGINT) % 3 AS VARCHAR(20)) AS project_id, 's'||CAST(p_partkey % 2 AS VARCHAR(20)) AS source_project_id,
    CASE WHEN p_partkey % 128 BETWEEN 1 AND 66 OR p_partkey % 128 BETWEEN 81 AND 87 OR p_partkey % 128 IN (89, 91, 95, 97) THEN p_partkey - 1 WHEN p_partkey % 128 IN (90, 94, 96) THEN p_partkey + 1
        WHEN p_partkey % 128 = 80 THEN p_partkey + 7 WHEN p_partkey % 128 = 88 THEN p_partkey - 4 WHEN p_partkey % 128 = 92 THEN p_partkey - 2 WHEN p_partkey % 128 = 93 THEN p_partkey END AS first_ref,
    CASE p_partkey % 128 WHEN 83 THEN p_partkey - 43 WHEN 91 THEN p_partkey - 4 WHEN 92 THEN p_partkey - 87 WHEN 95 THEN p_partkey + 1 END AS second_ref,
    CASE WHEN p_partkey % 2 = 0 THEN 127 + 128 * (CAST((p_partkey - p_partkey % 128) / 128 AS BIGINT) % 3) END AS hub_ref FROM part"""
LINKED = (
    "SELECT k, project_id, source_project_id, CAST(k AS VARCHAR(20)) AS input_source_id, 'f'||CAST(k AS VARCHAR(20))||'.sql' AS source_path, 'create table n'||CAST(k AS VARCHAR(20))||' (id number(10,0)'"
    + "".join(f"||coalesce(', r{i} number references n'||CAST({r} AS VARCHAR(20))||' (id)', '')" for i, r in enumerate(("first_ref", "second_ref", "hub_ref")))
    + f"||');' AS original_text FROM ({LINKS}) l"
)


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LINKED.replace("FROM part", "FROM {part}"), part=_keys(spark, sf_dir))


def archive(text: str, key: int) -> bytes:
    """Two entries; by the key's remainder of seven the archive is 1 cut, 2 marked as encrypted, 3 one that expands too far, 4 one with an illegal path, 5 none."""
    kind, out = key % 7, io.BytesIO()
    if kind == 5:
        return text.encode()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo(f"../d{key}.sql" if kind == 4 else f"d{key}.sql"), text.encode())
        z.writestr(zipfile.ZipInfo(f"sub\\e{key}.txt"), f"entry {key}")
        if kind == 3:
            z.writestr(zipfile.ZipInfo("wide.sql"), "a" * max(1 << 20, 200 * len(text.encode())), zipfile.ZIP_DEFLATED)
    data = bytearray(out.getvalue())
    if kind == 2:  # the flag in the first entry of the directory and of the data
        data[6] |= 1
        data[data.index(b"PK\x01\x02") + 8] |= 1
    return bytes(data[: len(data) // 2] if kind == 1 else data)


@pandas_udf(BinaryType())
def archived(text: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series([archive(t, int(k)) for t, k in zip(text, key, strict=True)])
