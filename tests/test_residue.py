from schemaweave.operators import depgraph, diffs
from schemaweave.plans.lifecycle import Project


def test_every_rule_reads_the_target(spark):
    rows = [("p", "1", "create function f return number is begin return 1; end;"), ("p", "2", "create view v as select /*+ full(x) */ 1 from x"), ("p", "3", "select '' from t"), ("p", "4", "create package k as\n  total number;\nend;"), ("p", "5", None)]
    got = {(r.object_id, r.code) for r in diffs.residue(spark.createDataFrame(rows, "project_id string, object_id string, target_sql string")).collect()}
    assert {("1", "NUMBER_WITHOUT_PRECISION"), ("2", "ORACLE_HINT_IGNORED"), ("3", "ORACLE_EMPTY_STRING_AS_NULL"), ("4", "PACKAGE_GLOBAL_STATE_REVIEW_REQUIRED")} <= got


def test_missing_dependencies(spark):
    texts = ["create table a (id number(5) primary key);", "create table b (id number(5) references a(id), c number(5) references nowhere(id));", "create index i on gone (id);", "create index j on a (id);"]
    sources = spark.createDataFrame([("p", "s", str(i), f"f{i}.sql", t) for i, t in enumerate(texts)], "project_id string, source_project_id string, input_source_id string, source_path string, original_text string")
    p = Project(sources)
    assert sorted(r.key for r in depgraph.missing(p.objects, p.versions).collect()) == ["gone", "nowhere"]
