import io
import zipfile

import pytest

from schemaweave.plans.catalog import Catalog, Snapshots, dimension
from schemaweave.sources import imports
from schemaweave.streaming.ingest import follow


def test_inline(spark):
    with pytest.raises(ValueError):
        imports.inline_source(spark, "b", "  ")
    s = imports.input_sources(imports.inline_source(spark, "b", "select 'é';"), "p", "s").first()
    assert (s.source_path, s.size_bytes, len(s.content_hash), s.type) == ("manual.sql", 12, 64, "MANUAL_SQL")


def test_files_and_violations(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.sql").write_text("select 1;")
    (tmp_path / "sub" / "b.pkb").write_text("select 2;")
    (tmp_path / "c.txt").write_text("x")
    (tmp_path / "e.sql").write_bytes(b"\xff\xfe")
    (tmp_path / "z.sql").write_text("")
    files = imports.file_source(spark, f"file://{tmp_path}", "b")
    assert {r.relative_path: r.violation for r in imports.violations(files).collect()} == {"a.sql": None, "sub/b.pkb": None, "c.txt": "EXTENSION", "e.sql": "ENCODING", "z.sql": "EMPTY"}
    assert sorted(r.name for r in imports.input_sources(files, "p", "s").collect()) == ["a.sql", "b.pkb"]


def test_zip(spark):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("x/a.sql", "select 1;")
        z.writestr("../evil.sql", "select 2;")
    bomb = io.BytesIO()
    with zipfile.ZipFile(bomb, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.sql", "a" * 3_000_000)
    rows = [("b", bytearray(buf.getvalue())), ("n", bytearray(b"no zip")), ("m", bytearray(bomb.getvalue()))]
    got = imports.zip_source(spark.createDataFrame(rows, "batch_id string, content binary")).collect()
    assert sorted((r.batch_id, r.relative_path or r.problem) for r in got) == [("b", "Illegal file path: ../evil.sql"), ("m", "Zip expansion ratio is too high"), ("n", "Zip contains no SQL files")]
    files = imports.zip_source(spark.createDataFrame(rows, "batch_id string, content binary"))
    assert {r.batch_id: r.violation for r in imports.violations(files).collect()} == {"b": "ZIP", "m": "ZIP", "n": "ZIP"}


def _archive(*entries, method=zipfile.ZIP_STORED):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", method) as z:
        for name, data in entries:
            z.writestr(name, data)
    return buf.getvalue()


def test_archives_good_and_damaged(spark):
    good = _archive(("x/", b""), ("x/a.sql", "select 1;"), ("y\\b.pks", "select 2;"))
    assert imports.unzipped(good) == ([("x/a.sql", b"select 1;"), ("y/b.pks", b"select 2;")], None)
    assert imports.unzipped(good[:40])[1] == "Invalid zip file"
    crc = bytearray(good)
    crc[good.index(b"select 1;")] ^= 1
    assert imports.unzipped(bytes(crc))[1] == "Invalid zip file"
    odd = bytearray(good)
    for sign, at in ((b"PK\x01\x02", 10), (b"PK\x03\x04", 8)):  # a method nobody knows
        i = -1
        while (i := odd.find(sign, i + 1)) >= 0:
            odd[i + at] = 77
    assert imports.unzipped(bytes(odd))[1] == "Invalid zip file"
    locked = bytearray(good)
    for sign, at in ((b"PK\x01\x02", 8), (b"PK\x03\x04", 6)):
        i = -1
        while (i := locked.find(sign, i + 1)) >= 0:
            locked[i + at] |= 1
    assert imports.unzipped(bytes(locked))[1] == "Invalid zip file"
    assert imports.unzipped(_archive(*((f"{i}.sql", b"x") for i in range(2001))))[1] == "Zip contains too many files"
    assert imports.unzipped(b"")[1] == imports.unzipped(_archive())[1] == "Zip contains no SQL files"
    rows = spark.createDataFrame([("b", bytearray(good))], "batch_id string, content binary")
    assert sorted((r.name, r.type, r.source_path) for r in imports.input_sources(imports.zip_source(rows), "p", "s").collect()) == [("a.sql", "SQL_FILE", "x/a.sql"), ("b.pks", "SQL_FILE", "y/b.pks")]


def test_root_is_taken_literally(spark, tmp_path):
    for folder in ("a+b (1)", "ab"):
        (tmp_path / folder / "s").mkdir(parents=True)
        (tmp_path / folder / "s" / "x y.sql").write_text("select 1;")
    files = imports.file_source(spark, f"file://{tmp_path}/a+b (1)/", "b")
    assert [r.relative_path for r in files.collect()] == ["s/x y.sql"]
    assert [r.type for r in imports.input_sources(imports.file_source(spark, f"{tmp_path}", "b"), "p", "s").collect()] == ["FOLDER", "FOLDER"]


def test_batch_size_counts_in_order_of_path(spark, monkeypatch):
    monkeypatch.setattr(imports, "MAX_BATCH_BYTES", 10)
    rows = [("b", "a.sql", bytearray(b"12345")), ("b", "b.sql", bytearray(b"12345")), ("b", "c.sql", bytearray(b"1")), ("c", "z.sql", bytearray(b"123456")), ("c", None, bytearray(b"1"))]
    got = imports.violations(spark.createDataFrame(rows, "batch_id string, relative_path string, content binary")).collect()
    assert sorted((r.batch_id, str(r.relative_path), r.violation) for r in got if r.relative_path != "c.sql") == [("b", "a.sql", None), ("b", "b.sql", None), ("c", "None", "EXTENSION"), ("c", "z.sql", None)]
    assert [r.violation for r in got if r.relative_path == "c.sql"] == ["BATCH_SIZE"]


def test_units_and_batches(spark):
    units = imports.register_units(spark.sql("select * from values ('p', ' A ', null), ('p', 'B', 'FOLDER_SET'), ('p', '  ', null) t(project_id, name, type)"))
    assert sorted((r.name, r.type) for r in units.collect()) == [("A", "DATABASE_EXPORT"), ("B", "FOLDER_SET")]
    s = imports.input_sources(imports.inline_source(spark, "b", "x;"), "p", "s")
    assert [(r.batch_id, r.status) for r in imports.input_batches(s).collect()] == [("b", "IMPORTED")]


def test_scope_and_projects(spark):
    projects, units = imports.register_projects(spark.sql("select * from values ('p', ' A '), ('q', ' ') t(project_id, name)"))
    assert [r.name for r in projects.collect()] == ["A"] and units.count() == 1
    s = imports.input_sources(imports.inline_source(spark, "b", "x;"), "p", "nowhere")
    assert imports.out_of_scope(s, units).count() == 1


def test_catalog_replaces_partitions(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/c")
    c.replace("t", spark.sql("select * from values ('p', 1), ('q', 2) t(project_id, x)"))
    c.replace("t", spark.sql("select 'p' project_id, 3 x"))
    assert sorted((r.project_id, r.x) for r in c.read("t").collect()) == [("p", 3), ("q", 2)]
    assert c.read("t", "q").count() == 1
    assert [r.code for r in dimension(spark, "risk_level").orderBy("ordinal").collect()] == ["LOW", "MEDIUM", "HIGH", "BLOCKER"]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.sql").write_text("create table t (d date default sysdate);\nselect 1;")
    for folder in ("x", "y"):
        (tmp_path / "in" / folder).mkdir()
        (tmp_path / "in" / folder / "same.sql").write_text("create view v as select 1 from dual;")
    q = follow(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/cp", "p", "s")
    q.awaitTermination()
    c = Snapshots(spark, f"file://{tmp_path}/out")
    assert [c.read(t).count() for t in ("db_object", "db_column", "parse_issue", "risk_issue")] == [3, 1, 1, 2]


STATE = "project_id string, input_source_id string, x int"


def test_snapshots(spark, tmp_path):
    """An emptied source loses its rows; a failed write shows the old state whole; a repeated batch changes nothing."""
    c = Snapshots(spark, f"file://{tmp_path}/state", buckets=4)
    table = lambda *rows: spark.createDataFrame([("p", *r) for r in rows], STATE)
    state = lambda: [sorted((r.input_source_id, r.x) for r in c.read(t).collect()) for t in ("a", "b")]
    every = table(*((f"s{i}", 0) for i in range(20)))
    assert c.commit({"a": table(*((f"s{i}", i) for i in range(20))), "b": table(("s1", 1), ("s1", 2))}, every, "st", 0)
    first = state()
    assert first == [sorted((f"s{i}", i) for i in range(20)), [("s1", 1), ("s1", 2)]]
    came = table(("s1", 0), ("s2", 0))
    assert not c.commit({"a": table(("s1", 9)), "b": table()}, came, "st", 0) and state() == first
    bad = table(("s2", 5)).selectExpr("project_id", "input_source_id", "cast(raise_error('lost') as int) x")
    with pytest.raises(Exception, match="lost"):
        c.commit({"a": table(("s2", 5)), "b": bad}, came, "st", 1)
    assert state() == first
    assert c.commit({"a": table(("s2", 5), ("s7", 99)), "b": table()}, came, "st", 1)
    second = [sorted([("s2", 5)] + [(f"s{i}", i) for i in range(20) if i not in (1, 2)]), []]
    assert state() == second  # s7 didn't come in
    assert not c.commit({"a": table(("s2", 6)), "b": table()}, came, "st", 1) and state() == second
    assert c.commit({"a": table(("s2", 6)), "b": table()}, came, "other", 0) and c.manifest(2)["tables"] != c.manifest()["tables"]
    assert sorted(r.x for r in c.read("a", c.manifest(2)).where("input_source_id = 's2'").collect()) == [5]
    with pytest.raises(Exception, match="exists"):
        c._publish(c.manifest())  # another writer was first
    c.vacuum(1)
    assert sorted(r.x for r in c.read("a").where("input_source_id = 's2'").collect()) == [6] and c._numbers() == [3]


def test_snapshots_keep_edits(spark, tmp_path):
    from schemaweave.operators import versions

    schema = "project_id string, input_source_id string, source string, x int"
    c = Snapshots(spark, f"file://{tmp_path}/v")
    rows = lambda *r: spark.createDataFrame([("p", *x) for x in r], schema)
    c.commit({"v": rows(("1", "AUTO_CONVERSION", 1), ("1", "USER_EDIT", 2), ("2", "AUTO_CONVERSION", 3))}, rows(("1", "", 0), ("2", "", 0)))
    c.commit({"v": rows(("1", "AUTO_CONVERSION", 4))}, rows(("1", "", 0), ("2", "", 0)), merge={"v": versions.replace_generated})
    assert sorted((r.input_source_id, r.source, r.x) for r in c.read("v").collect()) == [("1", "AUTO_CONVERSION", 4), ("1", "USER_EDIT", 2)]
