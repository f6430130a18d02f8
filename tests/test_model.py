import pytest

from schemaweave.operators import depgraph, report, review, versions
from schemaweave.plans.lifecycle import Project


def project(spark, *sources):
    """Each source: (source project, text)."""
    rows = [("p", sp, str(i), f"f{i}.sql", text) for i, (sp, text) in enumerate(sources)]
    return Project(spark.createDataFrame(rows, "project_id string, source_project_id string, input_source_id string, source_path string, original_text string"))


def edges(p):
    names = {r.object_id: (r.type, f"{r.schema_name}.{r.object_name}" if r.schema_name else r.object_name) for r in p.objects.collect()}
    return sorted((names[e.source_object_id][1], names[e.target_object_id][1], e.type) for e in p.edges.collect())


def test_objects_columns_and_issues(spark):
    p = project(spark, ("s", 'create table HR."User Account" (id number(8,0) /* ) */, "Full Name" varchar2(100) default q\'[it\'s, x]\' not null, constraint pk primary key (id));\nselect * from dual;\n-- just a comment\n'))
    o = p.objects.collect()
    assert [(x.type, x.schema_name, x.object_name) for x in o] == [("TABLE", "HR", "User Account")]
    assert [(c.name, c.source_type, c.nullable, c.ordinal_position) for c in p.columns.orderBy("ordinal_position").collect()] == [("id", "number(8,0)", True, 1), ("Full Name", "varchar2(100)", False, 2)]
    assert [i.original_text for i in p.issues.collect()] == ["select * from dual;"]


@pytest.mark.parametrize("head", ["table t (x int)", "global temporary table t (x int)", "index t on x (y)", "bitmap index t on x (y)", "view t as select 1 from x", "force editionable view t as select 1 from x", "sequence t start with 1"])
def test_heads(spark, head):
    o = project(spark, ("s", f"create {head};")).objects.collect()
    assert [x.object_name for x in o] == ["t"]


def test_risks_ignore_literals_and_identifiers(spark):
    p = project(spark, ("s", "create view v as select sysdate_col, decode_status, 'sysdate nvl(' a, q'[rownum]' b, 'O''Reilly' c from t -- connect by\n;"))
    assert p.risks.count() == 0


def test_edges(spark):
    t = [("a", "create table users (id int);"), ("b", "create table orders (id int, u int references users(id), w int references users (id));"), ("a", "create view v as select * from users where x = 'orders';"), ("a", "create trigger g before insert -- on orders\n on users begin null; end;\n/"), ("a", "create procedure p is begin delete from orders; end;\n/")]
    assert edges(project(spark, *t)) == [("g", "users", "TRIGGER_ON_TABLE"), ("orders", "users", "CROSS_SOURCE_DEPENDENCY"), ("p", "orders", "CROSS_SOURCE_DEPENDENCY"), ("v", "users", "VIEW_REFERENCES_TABLE")]


def test_edges_prefer_schema_and_source(spark):
    t = [("a", "create table app.users (id int);\ncreate table audit.users (id int);\ncreate view v as select * from app.users;"), ("b", "create table local (id int);"), ("a", "create table local (id int);\ncreate view w as select * from local;")]
    got = edges(project(spark, *t))
    assert ("v", "app.users", "VIEW_REFERENCES_TABLE") in got and ("v", "audit.users", "VIEW_REFERENCES_TABLE") not in got
    assert [e for e in got if e[0] == "w"] == [("w", "local", "VIEW_REFERENCES_TABLE")]


def test_package_bodies(spark):
    both = [("a", "create package k as\n procedure x;\nend;\n/"), ("a", "create package body k as\n procedure x is begin null; end;\nend;\n/")]
    assert edges(project(spark, *both)) == [("k", "k", "PACKAGE_BODY_FOR_SPEC")]
    apart = [("b", both[0][1]), both[1]]
    assert edges(project(spark, *apart)) == []  # the body is the first candidate of its own source
    assert edges(project(spark, both[0], ("a", "create table k (id int);"), ("b", both[1][1]))) == []
    assert edges(project(spark, ("a", "create table k (id int);"), both[0], both[1])) == [("k", "k", "PACKAGE_BODY_FOR_SPEC")]


def test_names_that_are_not_one_word(spark):
    tables = [("a", 'create table "Big Text" (id int);'), ("a", 'create table app."%" (id int);'), ("b", 'create table "x-y" (id int);')]
    uses = [("a", 'create view v as select 1 from big text;'), ("a", "create view w as select 1 from app . % where bigtext = 1;"), ("a", 'create view u as select 1 from "X-Y", xx-yy;'), ("a", "create procedure p is begin select 'big text' from dual; end;\n/")]
    assert edges(project(spark, *tables, *uses)) == [("u", "x-y", "CROSS_SOURCE_DEPENDENCY"), ("v", "Big Text", "VIEW_REFERENCES_TABLE"), ("w", "app.%", "VIEW_REFERENCES_TABLE")]


def test_trigger_on_itself(spark):
    assert edges(project(spark, ("a", "create trigger g before insert on g begin null; end;\n/"))) == [("g", "g", "TRIGGER_ON_TABLE")]


def test_waves(spark):
    chain = [(f"c{i:03d}", f"c{i - 1:03d}") for i in range(1, 71)]
    ladder = [(f"{x}{i}", f"{y}{i - 1}") for i in range(1, 12) for x in "lr" for y in "lr"]
    circle = [("x", "y"), ("y", "x"), ("z", "x"), ("x", "c000"), ("s", "s")]
    pairs = chain + ladder + circle
    e = spark.createDataFrame([("p", a, b) for a, b in pairs], "project_id string, source_object_id string, target_object_id string")
    nodes = spark.createDataFrame([("p", n) for n in sorted({n for pair in pairs for n in pair})] + [("q", "x")], "project_id string, object_id string")
    want = {("p", f"c{i:03d}"): i for i in range(71)} | {("p", f"{x}{i}"): i for i in range(12) for x in "lr"} | {("p", "x"): 1, ("p", "y"): 1, ("p", "z"): 2} | {("p", "s"): 0, ("q", "x"): 0}
    assert {(r.project_id, r.object_id): r.wave for r in review.waves(nodes, e).collect()} == want


def test_marker_behind_white_space(spark):
    c = spark.sql("select 'p' project_id, 'o' object_id, 'DRAFT' level")
    v = spark.sql("select 'p' project_id, 'o' object_id, 1 version_number, 'GENERATED' status, '\n -- DRAFT: x' target_sql")
    assert report.unedited(c, v).count() == 1


def test_reports_get_stale_in_their_contents(spark):
    p = project(spark, ("s", "create table b (id number(8,0));"))
    r = p.precheck.selectExpr("*", "timestamp'2024-01-01' as created_at")
    change = spark.sql("select 'p' project_id, timestamp'2024-01-02' changed_at")
    got = report.with_staleness(r, change).first()
    assert got.status == "STALE" and '"status":"STALE"' in got.json_content and "<dt>Status</dt><dd>STALE</dd>" in got.html_content
    same = report.with_staleness(r, change.where("false")).first()
    assert same.status == "CURRENT" and '"status":"CURRENT"' in same.json_content


def test_replace_generated_and_freeze_approved(spark):
    p = project(spark, ("s", "create table b (id number(8,0));"), ("s", "create sequence q;"))
    v = versions.generated(p.conversions)
    edited = versions.with_edits(v, v.selectExpr("project_id", "version_id as parent_version_id", "'x' as target_sql", "1 as edit_order"))
    fresh = v.where("input_source_id = '0'").selectExpr(*[f"'new' as {c}" if c == "version_id" else c for c in v.columns])
    got = versions.replace_generated(edited, fresh, v.where("input_source_id = '0'"))
    assert versions.replace_generated(edited, fresh.where("false"), v.where("input_source_id = '0'")).where("source = 'AUTO_CONVERSION'").count() == 1
    assert got.count() == 4 and got.where("version_id = 'new'").count() == 1
    reviews = spark.sql("select 'p' project_id, 'APPROVED' decision, cast(null as string) rejection")
    assert {r.status for r in versions.freeze_approved(edited, reviews).where("version_number = 2").collect()} == {"BASELINE"}
    assert {r.status for r in versions.freeze_approved(edited, reviews.where("false")).where("version_number = 2").collect()} == {"EDITED"}
    again = versions.with_edits(versions.freeze(edited), versions.freeze(edited).where("status = 'BASELINE'").selectExpr("project_id", "version_id as parent_version_id", "'y' as target_sql", "1 as edit_order"))
    assert sorted(r.status for r in versions.freeze(again).where("input_source_id = '0'").collect()) == ["BASELINE", "GENERATED", "STALE"]


def test_mention_keys():
    assert depgraph.mention_keys('create view app.v as select x_users from "HR"."User Account" u') >= ["q:hr.user account"]
    assert "u:v" not in depgraph.mention_keys("create view app.v as select 1 from dual")
    assert depgraph.mention_keys(None) == []


def test_versions_report_gate_and_package(spark):
    p = project(spark, ("s", "create table b (id number(8,0));\ncreate table a (id number(8,0), x int references b(id));\ncreate sequence q;"))
    v = versions.generated(p.conversions)
    assert p.precheck.first().status == "BLOCKED"
    edits = v.where("target_sql like '-- DRAFT%'").selectExpr("project_id", "version_id as parent_version_id", "'create sequence q;' as target_sql", "1 as edit_order")
    v = versions.with_edits(v, edits.unionByName(edits.selectExpr("project_id", "parent_version_id", "' ' as target_sql", "2 as edit_order")))
    assert report.precheck(p.objects, p.issues, p.risks, p.conversions, v).first().status == "CURRENT"
    frozen = versions.freeze(v)
    base = frozen.where("status = 'BASELINE'")
    assert base.count() == 3
    reports = spark.sql("select 'p' project_id, 'r' report_id, 'CURRENT' status, timestamp'2024-01-01' created_at")
    reviews = spark.sql("select 'p' project_id, 'r' report_id, 'APPROVED' decision, timestamp'2024-01-02' created_at")
    projects = reports.select("project_id")
    gate = lambda *a: review.gate(projects, *a).first().status
    assert gate(reports, reviews, frozen, p.risks) == "READY"
    assert gate(reports, reviews.where("false"), frozen, p.risks) == "NO_APPROVED_REVIEW"
    assert gate(reports.where("false"), reviews, frozen, p.risks) == "NO_CURRENT_REPORT"
    assert gate(reports, reviews, v, p.risks) == "NO_BASELINE"
    order = review.ordered(base, p.edges)
    names = {r.object_id: r.object_name for r in p.objects.collect()}
    seq = [names[r.object_id] for r in order.orderBy("seq").collect()]
    assert seq.index("b") < seq.index("a") and len(seq) == 3
    text = review.package_text(frozen, order).first().sql
    assert text.index('create table "b"') < text.index('create table "a"')


def test_review_requests(spark):
    reports = spark.sql("select * from values ('p','r1','BLOCKED'),('p','r2','STALE'),('p','r3','CURRENT') t(project_id, report_id, status)")
    asked = spark.sql("select 'p' project_id, r report_id, d decision, cast(null as string) reviewer, cast(null as string) comment, timestamp'2024-01-01' created_at from values ('r1','APPROVED'),('r2','APPROVED'),('r3','APPROVED'),('r1','REJECTED'),('x','REJECTED'),('r3',null) t(r,d)")
    got = [r.rejection is None for r in review.submit(asked, reports).collect()]
    assert sorted(got) == [False] * 4 + [True] * 2


def test_cycles_come_last(spark):
    b = spark.sql("select 'p' project_id, id object_id from values ('a'),('b'),('c') t(id)")
    e = spark.sql("select 'p' project_id, s source_object_id, t target_object_id from values ('a','b'),('b','a'),('c','zz') x(s,t)")
    assert [r.object_id for r in review.ordered(b, e).orderBy("seq").collect()] == ["c", "a", "b"]


def test_white_space_of_any_kind(spark):
    """Columns over several lines, tabs and wide spaces; edits, reviewers and names of nothing but white space."""
    p = project(spark, ("s", "create table w (\n\ta\n date\n  default sysdate,\n\tb varchar2(5 char)\n   not null ,\n c\t\tnumber( 8 , 2 )\t,\n　d clob );"))
    assert [(c.name, c.source_type, c.nullable) for c in p.columns.orderBy("ordinal_position").collect()] == [("a", "date", True), ("b", "varchar2(5 char)", False), ("c", "number( 8 , 2 )", True), ("d", "clob", True)]
    c = p.conversions.first()
    assert c.target_sql == 'create table "w" (\n    "a" timestamp default clock_timestamp(),\n    "b" varchar(5) not null,\n    "c" numeric(8,2),\n    "d" text\n);'
    assert [h.rule_code for h in c.rule_hits] == ["TYPE_MAPPING_DATE", "ORACLE_INLINE_COLUMN_CLAUSE_REVIEW", "TYPE_MAPPING_VARCHAR2_5_CHAR_", "TYPE_MAPPING_NUMBER_8_2_", "TYPE_MAPPING_CLOB"]
    v = p.versions
    blank = v.selectExpr("project_id", "version_id as parent_version_id", "'\n\t ' as target_sql", "1 as edit_order")
    assert versions.with_edits(v, blank).count() == 1
    reports = spark.sql("select 'p' project_id, 'r' report_id, 'CURRENT' status")
    asked = spark.sql("select 'p' project_id, 'r' report_id, 'APPROVED' decision, r reviewer, cast(null as string) comment, 1 created_at from values ('\n\t'), ('\tann\n') t(r)")
    assert sorted(r.reviewer for r in review.submit(asked, reports).collect()) == ["ann", "developer"]


def test_gate_takes_only_own_and_accepted_reviews(spark):
    reports = spark.sql("select p project_id, concat('r', p) report_id, 'CURRENT' status, 1 created_at from values ('a'), ('b') t(p)")
    versions_ = spark.sql("select p project_id, p object_id, 'BASELINE' status, 'select 1' target_sql from values ('a'), ('b') t(p)")
    risks = spark.sql("select 'z' project_id, 'LOW' level")
    asked = lambda *rows: spark.createDataFrame([(*r, None, None) for r in rows], "review_id string, project_id string, report_id string, decision string, created_at int, reviewer string, comment string")
    gate = lambda *rows: {r.project_id: r.status for r in review.gate(reports, reports, review.submit(asked(*rows), reports), versions_, risks).collect()}
    assert gate(("1", "a", "rb", "APPROVED", 1)) == {"a": "NO_APPROVED_REVIEW", "b": "NO_APPROVED_REVIEW"}
    assert gate(("1", "b", "rb", "APPROVED", 1), ("2", "a", "rb", "REJECTED", 2))["b"] == "READY"
    assert gate(("1", "b", "rb", "APPROVED", 1), ("2", "b", "rb", "REJECTED", 1))["b"] == "NO_APPROVED_REVIEW"
    assert gate(("2", "b", "rb", "APPROVED", 1), ("1", "b", "rb", "REJECTED", 1))["b"] == "READY"


def test_value_profile_is_exact(spark):
    from schemaweave.operators import validate

    df = spark.sql("select * from values (9223372036854775807, cast('9007199254740993.5' as decimal(20,1)), cast('9223372036854775808' as decimal(38,0)), 1.0D, cast(5 as int)), (0, 1, 1, cast('nan' as double), null) t(big, half, over, f, i)")
    got = {r.column_name: (r.narrowest, r.fractions, r.nulls) for r in validate.value_profile(df, df.columns, "t").collect()}
    assert got == {"big": ("bigint", 0, 0), "half": ("numeric", 1, 0), "over": ("numeric", 0, 0), "f": ("numeric", 1, 0), "i": ("integer", 0, 1)}
