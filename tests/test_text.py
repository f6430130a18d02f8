import random
import re

import pytest
from pyspark.sql import functions as F

from schemaweave.functions import textops as T
from schemaweave.functions import typemap
from schemaweave.operators import convert, splitter


def texts(sql):
    return [r[0] for r in splitter.split(sql)]


@pytest.mark.parametrize(
    ("sql", "expected"),
    [
        ("create table a (x int);\ncreate trigger g\nbegin\n null;\nend;\n/\ncreate sequence s;", ["create table a (x int);", "create trigger g\nbegin\n null;\nend;\n/", "create sequence s;"]),
        ("select 1; select 2;", ["select 1;", "select 2;"]),
        ("create function f return number is begin return 1; end;\n/\ncreate table t (x int);", ["create function f return number is begin return 1; end;\n/", "create table t (x int);"]),
        ("-- head\n/* more */\ncreate procedure p is begin null; end;\n/", ["-- head\n/* more */\ncreate procedure p is begin null; end;\n/"]),
        ("create or replace editionable function f is\nbegin null; end;\n/\ncreate noneditionable procedure p is\nbegin null; end;\n/", ["create or replace editionable function f is\nbegin null; end;\n/", "create noneditionable procedure p is\nbegin null; end;\n/"]),
        ("select 1 -- a; b\n/* c; d */ from t;", ["select 1 -- a; b\n/* c; d */ from t;"]),
        ("select q'[a;b]' from t;", ["select q'[a;b]' from t;"]),
        ("select q'!a;\nb;\nc!' from t;\nselect 2;", ["select q'!a;\nb;\nc!' from t;", "select 2;"]),
        ("select 'a;''\nb;' from t;", ["select 'a;''\nb;' from t;"]),
        ("begin\n x := q'[\n/\n]';\n y := 'a\n/\n';\nend;\n/\nselect 1;", ["begin\n x := q'[\n/\n]';\n y := 'a\n/\n';\nend;\n/", "select 1;"]),
        ("begin\n -- it's\n null;\nend;\n/\nselect 1;", ["begin\n -- it's\n null;\nend;\n/", "select 1;"]),
        ("select 1;\n/\nselect 2;", ["select 1;", "/\nselect 2;"]),
        ("create table t (\n\n x int);", ["create table t (\n x int);"]),
        ("", []),
        (None, []),
    ],
)
def test_split(sql, expected):
    assert texts(sql) == expected


def test_split_places():
    assert splitter.split("select 1; select 2;\r\n\r\nselect\r\n3;") == [("select 1;", 1, 1, 0, 9), ("select 2;", 1, 1, 9, 19), ("select\n3;", 3, 4, 21, 30)]


def spelled_blank(text):
    """The specification, character by character."""
    out, i, n = [], 0, len(text)
    while i < n:
        if text[i] in "qQ" and text[i + 1 : i + 2] == "'" and i + 2 < n:
            close = {"[": "]", "(": ")", "{": "}", "<": ">"}.get(text[i + 2], text[i + 2])
            j = text.find(close + "'", i + 3)
            j = n if j < 0 else j + 2
        elif text[i] == "'":
            j = i + 1
            while j < n and (text[j] != "'" or text[j + 1 : j + 2] == "'"):
                j += 2 if text[j] == "'" else 1
            j = min(n, j + 1)
        elif text.startswith("--", i):
            j = text.find("\n", i)
            j = n if j < 0 else j + 1
        elif text.startswith("/*", i):
            j = text.find("*/", i + 2)
            j = n if j < 0 else j + 2
        else:
            out.append(text[i])
            i += 1
            continue
        out.append(re.sub(r"\S", " ", text[i:j]))
        i = j
    return "".join(out)


def test_blank_keeps_length_and_matches_the_specification(spark):
    rng = random.Random(5)
    samples = ["".join(rng.choice("ab'q[]!-*/ \n;") for _ in range(rng.randint(0, 30))) for _ in range(800)] + ["", "'" * 501]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(samples)], "i int, t string").select("i", T.blank(F.col("t")).alias("b")).collect()
    for r in got:
        assert len(r.b) == len(samples[r.i])
        assert r.b == spelled_blank(samples[r.i]), samples[r.i]
        assert T.mask(samples[r.i]) == r.b


def test_parentheses_and_commas():
    assert T.paren_block("create table t (a number(10,0), b varchar2(10) default ')') x (y)") == "a number(10,0), b varchar2(10) default ')'"
    assert T.paren_block("no") == T.paren_block("(open") == ""
    assert T.comma_parts("a number(10,0), b default q'[x, y]', check (c in (1,2))") == ["a number(10,0)", "b default q'[x, y]'", "check (c in (1,2))"]


@pytest.mark.parametrize(
    ("source", "target", "review"),
    [("NUMBER(10,0)", "numeric(10,0)", False), ("VARCHAR2(120)", "varchar(120)", False), ("NVARCHAR2(40)", "varchar(40)", False), ("CLOB", "text", False), ("BLOB", "bytea", False), ("VARCHAR2(120 CHAR)", "varchar(120)", True), ("DATE", "timestamp", True), ("NUMBER", "numeric", True), ("FLOAT(10)", "FLOAT(10)", True), ("number(*,0)", "numeric(*,0)", False)],
)
def test_types(spark, source, target, review):
    t = spark.range(1).select(typemap.map_type(F.lit(source)).alias("t")).first().t
    assert (t.target_type, t.review_required) == (target, review)


@pytest.mark.parametrize(
    ("suffix", "expected"),
    [
        ('default "UserSeq".nextval', "default nextval('\"UserSeq\"'::regclass)"),
        ("default HR.accounts_seq.nextval not null", "default nextval('hr.accounts_seq'::regclass) not null"),
        ("default 'sysdate accounts_seq.nextval'", "default 'sysdate accounts_seq.nextval'"),
        ("default sysdate", "default clock_timestamp()"),
        ("primary key using index enable novalidate", "primary key"),
        ("not null enable novalidate rely", "not null"),
        ("check (enable in ('Y'))", "check (enable in ('Y'))"),
    ],
)
def test_suffixes(suffix, expected):
    assert convert.rewritten(suffix, True) == expected


def test_paths(spark):
    rows = [("a.sql",), ("../evil.sql",), ("/a.sql",), ("x\\..\\y.sql",), ("a/..",), ("",), (None,), ("c:/a.PKB",)]
    got = spark.createDataFrame(rows, "p string").select("p", T.illegal_path(F.col("p")).alias("bad"), T.allowed_extension(F.col("p")).alias("ok")).collect()
    assert [r.bad for r in got] == [False, True, True, True, False, True, True, True]
    assert [r.ok for r in got][0] and [r.ok for r in got][-1]


@pytest.mark.parametrize("partitions", ["1", "3", "9"])
def test_places_are_those_of_one_window(spark, partitions):
    """Ties, nulls and falling keys, whatever the number of ranges."""
    import random

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from schemaweave.plans import reads

    r = random.Random(4)
    df = spark.createDataFrame([(r.choice(["p", "q", None]), r.choice([None, 1, 2, 3]), r.choice(["x", "x", "x", "y", None, "z"]), i) for i in range(200)], "project_id string, a int, b string, i int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for given, wanted in ((("a", "b"), (F.asc("a"), F.asc("b"))), ((reads.Falling("b"), F.col("a") * 2), (F.desc("b"), F.asc("a"))), (("b",), (F.asc("b"),))):
            want = df.withColumn("position", F.rank().over(Window.partitionBy("project_id").orderBy(*wanted)))
            got = reads.ranked(df, *given)
            assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
        assert reads.ranked(df.limit(0), "a").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
