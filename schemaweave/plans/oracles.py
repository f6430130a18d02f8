"""DuckDB SQL for the registered queries: expected rows from the templates' known contents or from RE2, not from the Spark code."""

from __future__ import annotations

import re

from ..functions import typemap
from ..operators import advice, convert, report
from ..operators.validate import STAGES
from ..sources import imports
from .corpus import CORPUS, LINKS

TOKEN = r"""(?s)[qQ]'(?:\[.*?(?:\]'|\z)|\(.*?(?:\)'|\z)|\{.*?(?:\}'|\z)|<.*?(?:>'|\z)|!.*?(?:!'|\z))|'[^']*(?:''[^']*)*(?:'|\z)|--[^\n]*(?:\n|\z)|/\*.*?(?:\*/|\z)|[^qQ'/\-]+|."""


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _tokens(text: str) -> str:
    return f"regexp_extract_all({text}, {_q(TOKEN)})"


def _masked(text: str, which: str) -> str:
    mask = r"regexp_replace(x, '\S', ' ', 'g')"
    return f"array_to_string(list_transform({_tokens(text)}, lambda x: CASE WHEN regexp_matches(x, {_q(which)}) THEN {mask} ELSE x END), '')"


BLANK, COMMENT = r"(?s)^(?:[qQ]'.|'|--|/\*)", r"^(?:--|/\*)"
C = f"WITH c AS (SELECT * FROM ({CORPUS}))"
#: Objects the templates make: type, and name as a function of the key.
OBJECTS = f"""{C}, o AS (SELECT *, CASE template WHEN 5 THEN 'VIEW' WHEN 6 THEN 'INDEX' WHEN 7 THEN 'SEQUENCE' WHEN 8 THEN 'TRIGGER' WHEN 9 THEN 'FUNCTION' WHEN 10 THEN 'PACKAGE' WHEN 11 THEN 'PACKAGE_BODY' WHEN 12 THEN 'PROCEDURE' WHEN 13 THEN 'VIEW' ELSE 'TABLE' END AS type FROM c WHERE template <> 15)"""
#: (template, code, level): what each template must be found to risk.
RISK_ROWS = [
    (0, "NUMBER_INTEGER_NARROWING_REVIEW", "HIGH", "number(10,0)"),
    (1, "NUMBER_INTEGER_NARROWING_REVIEW", "HIGH", "number(19,0)"),
    (1, "SYSDATE_TIME_SEMANTICS", "HIGH", "SYSDATE"),
    (1, "ORACLE_DATE_TIME_SEMANTICS", "MEDIUM", "DATE"),
    (1, "ORACLE_EMPTY_STRING_AS_NULL", "HIGH", "''"),
    (2, "NUMBER_INTEGER_NARROWING_REVIEW", "HIGH", "number(10,0)"),
    (2, "NUMBER_WITHOUT_PRECISION", "MEDIUM", "NUMBER"),
    (4, "NUMBER_INTEGER_NARROWING_REVIEW", "HIGH", "number(10,0)"),
    (4, "QUOTED_IDENTIFIER_CASE_SENSITIVE", "MEDIUM", '"identifier"'),
    (5, "ROWNUM_REWRITE_REQUIRED", "MEDIUM", "ROWNUM"),
    (9, "NUMBER_WITHOUT_PRECISION", "MEDIUM", "NUMBER"),
    (9, "DYNAMIC_SQL_REVIEW_REQUIRED", "HIGH", "EXECUTE IMMEDIATE"),
    (10, "PACKAGE_GLOBAL_STATE_REVIEW_REQUIRED", "HIGH", "package global variable"),
    (12, "AUTONOMOUS_TRANSACTION_UNSUPPORTED", "BLOCKER", "PRAGMA AUTONOMOUS_TRANSACTION"),
    (13, "CONNECT_BY_REWRITE_REQUIRED", "HIGH", "CONNECT BY"),
    (13, "DECODE_REWRITE_REQUIRED", "MEDIUM", "DECODE"),
    (13, "NVL_REWRITE_REQUIRED", "MEDIUM", "NVL"),
    (13, "ORACLE_HINT_IGNORED", "LOW", "/*+ hint */"),
    (14, "NUMBER_INTEGER_NARROWING_REVIEW", "HIGH", "number(10,0)"),
    (14, "ORACLE_DATE_TIME_SEMANTICS", "MEDIUM", "DATE"),
]
RULES = f"rules(template, code, level, evidence) AS (VALUES {', '.join(f'({t}, {_q(c)}, {_q(v)}, {_q(e)})' for t, c, v, e in RISK_ROWS)})"
RISKS = f"{OBJECTS}, {RULES}, r AS (SELECT o.*, rules.code, rules.level, rules.evidence FROM o JOIN rules USING (template))"
COLUMN_ROWS = [
    (0, "id", "number(10,0)", True), (0, "name", "varchar2(100 char)", False), (0, "note", "clob", True),
    (1, "id", "number(19,0)", True), (1, "made", "date", True), (1, "flag", "varchar2(1)", True),
    (2, "amount", "number", True), (2, "raw_id", "raw(16)", True), (2, "ref_id", "number(10,0)", True),
    (3, "label", "varchar2(50)", True), (3, "n", "number(8,2)", True),
    (4, "Id", "number(10,0)", True), (4, "Big Text", "nclob", True),
    (14, "id", "number(10,0)", True), (14, "d", "date", True),
]
#: (template, how far the key of what it needs lies, type within one source project). A body's package lies in another source project, so the body itself is its name's first candidate and there is no edge.
EDGE_ROWS = [(2, -2, "TABLE_REFERENCES_TABLE"), (3, 4, "TABLE_USES_SEQUENCE"), (5, -5, "VIEW_REFERENCES_TABLE"), (6, -6, "INDEX_ON_TABLE"), (8, -8, "TRIGGER_ON_TABLE"), (9, -9, "ROUTINE_REFERENCES_OBJECT"), (12, -7, "ROUTINE_REFERENCES_OBJECT"), (13, -13, "VIEW_REFERENCES_TABLE")]
EDGES = f"{OBJECTS}, e(template, step, type) AS (VALUES {', '.join(f'({t}, {s}, {_q(x)})' for t, s, x in EDGE_ROWS)}), edges AS (SELECT a.project_id, a.k AS source_key, b.k AS target_key, CASE WHEN a.source_project_id <> b.source_project_id THEN 'CROSS_SOURCE_DEPENDENCY' ELSE e.type END AS type FROM o a JOIN e USING (template) JOIN o b ON b.k = a.k + e.step AND b.project_id = a.project_id)"
LEVEL = "CASE WHEN type IN ('VIEW', 'INDEX', 'SEQUENCE') THEN 'DRAFT' WHEN type <> 'TABLE' THEN 'MANUAL_REQUIRED' WHEN template = 4 THEN 'AUTO' ELSE 'REVIEW_REQUIRED' END"
COUNTS = """SELECT {key}, count(*) AS object_count, sum((SELECT count(*) FROM rules WHERE rules.template = o.template)) AS risk_count,
    sum((template = 12)::INT) AS blocker_count, sum((SELECT count(*) FROM rules WHERE rules.template = o.template AND level = 'HIGH')) AS high_risk_count FROM o GROUP BY {group}"""
_N = {k: _q(v) for k, v in (("narrow", typemap.NOTE_NARROW), ("raw", typemap.NOTE_RAW), ("none", typemap.NOTE_NONE), ("length", typemap.NOTE_LENGTH), ("number", typemap.NOTE_NUMBER), ("date", typemap.NOTE_DATE), ("char", typemap.NOTE_UNIT[0] + "CHAR" + typemap.NOTE_UNIT[1]))}
_PATHS = "SELECT page_id, url AS path FROM pages UNION ALL SELECT page_id, 'a\\b' || page_id || '.SQL' FROM pages"


def _conversion_rows() -> list[tuple[int, str, str]]:
    """(template, rule codes, notes): tables by their columns' types, other types by their one rule."""
    note_of = {"number": typemap.NOTE_NUMBER, "date": typemap.NOTE_DATE, "raw(16)": typemap.NOTE_RAW, "varchar2(100 char)": typemap.NOTE_UNIT[0] + "CHAR" + typemap.NOTE_UNIT[1]}
    rows = []
    for t in (0, 1, 2, 3, 4, 14):
        codes, notes = (["ORACLE_TEMPORARY_TABLE_REVIEW"], [convert.TEMPORARY_NOTE]) if t == 14 else ([], [])
        for _, name, kind, _ in (r for r in COLUMN_ROWS if r[0] == t):
            codes.append("TYPE_MAPPING_" + re.sub("[^A-Z0-9]+", "_", kind.upper()))
            notes += [typemap.NOTE_NARROW] if kind.startswith("number(") else [note_of[kind]] if kind in note_of else []
            if (t, name) in ((1, "made"), (3, "n")):
                codes.append("ORACLE_INLINE_COLUMN_CLAUSE_REVIEW")
                notes.append(convert.COLUMN_NOTE)
        if t == 1:
            codes.append("ORACLE_TABLE_CONSTRAINT_REVIEW")
            notes.append(convert.CONSTRAINT_NOTE)
        rows.append((t, ",".join(codes), "|".join(dict.fromkeys(notes))))
    for t, kind in ((5, "VIEW"), (13, "VIEW"), (6, "INDEX"), (7, "SEQUENCE")):
        rows.append((t, f"CONSERVATIVE_{kind}_DRAFT", convert.DRAFT_NOTES[kind]))
    return rows + [(t, "MANUAL_REQUIRED_OBJECT", convert.MANUAL_NOTE) for t in (8, 9, 10, 11, 12)]


NAME = "CASE template WHEN 11 THEN 'k'||(k - 1) WHEN 4 THEN 'Mixed t'||k ELSE ['t','t','t','t','','v','i','s','g','f','k','','r','v','t'][template + 1]||k END"
ID = "sha256(project_id || '|' || source_project_id || '|' || input_source_id || '|0')"


def _shared(column: str, text: str = "{}::VARCHAR") -> str:
    value = text.format(column)
    return f"CASE WHEN {column} IS NULL THEN 'N' ELSE length({value}) || ':' || {value} END"


LINE_KEY = " || ".join(_shared(c) for c in ("l_orderkey", "l_linenumber"))
_MONEY = "{}::DECIMAL(38,6)::VARCHAR"
_LINE = [(c, "{}::VARCHAR") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")] + [(c, _MONEY) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")] + [(c, "{}") for c in ("l_returnflag", "l_linestatus")] + [("l_shipdate", "epoch_us({})::VARCHAR")]
ROW_DIGEST = f"('0x' || md5({' || '.join(_shared(c, t) for c, t in _LINE)})[1:15])::BIGINT"
LOADED = """WITH x AS (SELECT *, 0 AS side FROM lineitem UNION ALL SELECT * REPLACE (CASE WHEN l_orderkey % 997 = 0 AND l_linenumber = 1 THEN l_tax + 0.01::DOUBLE ELSE l_tax END AS l_tax, CASE WHEN l_orderkey % 991 <> 0 THEN l_shipdate END AS l_shipdate), 1 FROM lineitem WHERE l_orderkey % 1009 <> 0
    UNION ALL SELECT *, 1 FROM lineitem WHERE l_orderkey % 983 = 0 AND l_linenumber = 1 UNION ALL SELECT * REPLACE (-l_orderkey AS l_orderkey), 1 FROM lineitem WHERE l_orderkey % 977 = 0 AND l_linenumber = 1)"""


#: Objects of the linked corpus with their ids, and its references to tables that are there, none to itself.
LINK_EDGES = f"""WITH RECURSIVE o AS (SELECT *, sha256(project_id || '|' || source_project_id || '|' || k || '|0') AS object_id FROM ({LINKS})),
    e AS (SELECT DISTINCT a.project_id, a.object_id, b.object_id AS needs FROM (SELECT *, unnest([first_ref, second_ref, hub_ref]) AS r FROM o) a JOIN o b ON b.k = a.r AND b.k <> a.k AND b.project_id = a.project_id)"""


FATE = "CASE WHEN k % 11 = 0 THEN 'ADDED' WHEN k % 7 = 0 THEN 'REMOVED' WHEN k % 5 = 0 THEN 'CHANGED' WHEN k % 9 = 0 THEN 'MOVED' WHEN k % 13 = 0 THEN 'TWICE' ELSE 'SAME' END"
PATHS = "CASE WHEN fate = 'ADDED' THEN '' ELSE source_path END AS {0}before, CASE fate WHEN 'REMOVED' THEN '' WHEN 'MOVED' THEN 'moved/' || source_path ELSE source_path END AS {0}after"


def _imports_and_times() -> dict[str, str]:
    said = {k: _q(v) for k, v in {1: imports.ZIP_BAD, 2: imports.ZIP_BAD, 5: imports.ZIP_NONE}.items()}
    # the wide entry holds 200 times the text's bytes, a MiB at least; an entry's size counts before its archive's ratio
    said[3] = f"CASE WHEN 200 * strlen(t) > {imports.MAX_FILE_BYTES} THEN {_q(imports.ZIP_ENTRY + 'wide.sql')} ELSE {_q(imports.ZIP_RATIO)} END"
    told = " ".join(f"WHEN {k} THEN {v}" for k, v in said.items())
    return {
        "o03_zip": f"""WITH d AS (SELECT doc_id, doc_id % 7 AS m, coalesce(text, '') AS t FROM documents)
            SELECT doc_id::VARCHAR AS batch_id, '' AS relative_path, CASE m {told} ELSE {_q(imports.ZIP_PATH)} || '../d' || doc_id || '.sql' END AS problem, 'ZIP' AS violation, '' AS content_sha256 FROM d WHERE m BETWEEN 1 AND 5
            UNION ALL SELECT doc_id::VARCHAR, 'd' || doc_id || '.sql', '', CASE WHEN t = '' THEN 'EMPTY' ELSE '' END, sha256(t) FROM d WHERE m IN (0, 6)
            UNION ALL SELECT doc_id::VARCHAR, 'sub/e' || doc_id || '.txt', '', 'EXTENSION', sha256('entry ' || doc_id) FROM d WHERE m IN (0, 6)""",
        "o99_history": f"""{OBJECTS}, d AS (SELECT unnest([0, 2, 11, 19, 20])::INT AS day), x AS (SELECT day, 1 AS version_number, CASE WHEN day < k % 5 THEN '' WHEN day >= 20 AND k % 5 <> 0 THEN 'BASELINE' ELSE 'GENERATED' END AS status FROM o, d
            UNION ALL SELECT day, 2, CASE WHEN day < 10 + k % 3 THEN '' WHEN day >= 20 THEN 'BASELINE' ELSE 'EDITED' END FROM o, d WHERE k % 5 = 0) SELECT day, version_number, status, count(*) AS n FROM x GROUP BY ALL""",
        "o76_as_of": """WITH o AS (SELECT *, c_nationkey AS project_id FROM orders JOIN customer ON c_custkey = o_custkey), c AS (SELECT DISTINCT project_id, o_orderdate AS changed_at FROM o WHERE o_orderstatus = 'F'),
            x AS (SELECT q.project_id, coalesce(c.changed_at > q.o_orderdate, false) AS stale FROM (SELECT *, o_orderdate + INTERVAL 3 DAYS AS at FROM o) q ASOF LEFT JOIN c ON c.project_id = q.project_id AND c.changed_at <= q.at)
            SELECT project_id, stale, count(*) AS n FROM x GROUP BY ALL""",
    }


def _batch_differences() -> dict[str, str]:
    """What became of each source; one that came twice is the same and once more new."""
    change = "CASE WHEN fate = 'TWICE' THEN 'SAME' ELSE fate END AS change"
    return {
        "d1_files": f"{C}, f AS (SELECT *, {FATE} AS fate FROM c) SELECT {change}, {PATHS.format('path_')} FROM f UNION ALL SELECT 'ADDED', '', 'again/' || source_path FROM f WHERE fate = 'TWICE'",
        "d1_objects": f"""{OBJECTS}, f AS (SELECT *, {FATE} AS fate, {NAME} AS name FROM o),
            b AS (SELECT *, row_number() OVER (PARTITION BY project_id, name ORDER BY type) AS n FROM f WHERE fate = 'REMOVED'),
            a AS (SELECT *, row_number() OVER (PARTITION BY project_id, name ORDER BY type) AS n FROM (SELECT * REPLACE (CASE WHEN fate = 'TWICE' THEN 'again/' ELSE '' END || source_path AS source_path) FROM f WHERE fate IN ('ADDED', 'TWICE')))
            SELECT {change}, type AS type_before, name AS object_name_before, type AS type_after, name AS object_name_after, {PATHS.format('source_path_')} FROM f WHERE fate NOT IN ('ADDED', 'REMOVED')
            UNION ALL SELECT CASE WHEN b.k IS NULL THEN 'ADDED' WHEN a.k IS NULL THEN 'REMOVED' ELSE 'RETYPED' END, coalesce(b.type, ''), coalesce(b.name, ''), coalesce(a.type, ''), coalesce(a.name, ''), coalesce(b.source_path, ''), coalesce(a.source_path, '') FROM b FULL JOIN a ON a.project_id = b.project_id AND a.name = b.name AND a.n = b.n""",
        "d1_risks": f"""{RISKS}, f AS (SELECT *, {FATE} AS fate, {NAME} AS name FROM r), g AS (SELECT *, CASE WHEN code = 'NUMBER_INTEGER_NARROWING_REVIEW' AND k % 5 = 0 AND fate <> 'MOVED' THEN 'LOW' ELSE level END AS later FROM f)
            SELECT CASE WHEN fate IN ('ADDED', 'REMOVED', 'MOVED') THEN fate WHEN later <> level THEN 'CHANGED' ELSE 'SAME' END AS change, name AS object_name, code, CASE WHEN fate = 'ADDED' THEN '' ELSE level END AS level_before, CASE WHEN fate = 'REMOVED' THEN '' ELSE later END AS level_after FROM g
            UNION ALL SELECT 'ADDED', name, code, '', level FROM g WHERE fate = 'TWICE'""",
    }


def oracle_sql() -> dict[str, str]:
    first = _first()
    return first | _lifecycle(first["o110_convert"]) | _graphs() | _batch_differences() | _imports_and_times()


def _graphs() -> dict[str, str]:
    return {
        "d8_clusters": f"""{LINK_EDGES}, u AS (SELECT object_id AS a, needs AS b FROM e UNION SELECT needs, object_id FROM e UNION SELECT object_id, object_id FROM o),
            l AS (SELECT object_id, object_id AS label, 0 AS n FROM o UNION ALL SELECT u.a, min(label), any_value(n) + 1 FROM l JOIN u ON u.b = l.object_id WHERE n < 130 GROUP BY u.a)
            SELECT project_id, object_id, min(label) AS cluster_id FROM l JOIN o USING (object_id) GROUP BY ALL""",
        "d8_cycles": f"""{LINK_EDGES}, r AS (SELECT object_id AS a, needs AS b FROM e UNION SELECT r.a, e.needs FROM r JOIN e ON e.object_id = r.b),
            m AS (SELECT x.a, x.b FROM r x JOIN r y ON x.a = y.b AND x.b = y.a),
            c AS (SELECT project_id, object_id, least(object_id, coalesce(min(m.b), object_id)) AS component_id, count(m.b) FILTER (WHERE m.b <> object_id) > 0 AS cyclic FROM o LEFT JOIN m ON m.a = object_id GROUP BY project_id, object_id),
            d AS (SELECT DISTINCT x.component_id AS a, y.component_id AS b FROM e JOIN c x ON x.object_id = e.object_id JOIN c y ON y.object_id = e.needs WHERE x.component_id <> y.component_id),
            w AS (SELECT DISTINCT component_id, 0 AS wave FROM c UNION SELECT d.a, wave + 1 FROM w JOIN d ON d.b = w.component_id)
            SELECT project_id, object_id, component_id, cyclic, (SELECT max(wave) FROM w WHERE w.component_id = c.component_id) AS wave FROM c""",
        "d14_stale_along": f"""{LINK_EDGES}, v AS (SELECT *, sha256('version|' || object_id || '|1') AS version_id FROM o),
            s AS (SELECT project_id, 'source|' || k AS node FROM o WHERE project_id <> 'p2' AND (k % 37 = 0 OR k % 41 = 0)),
            g AS (SELECT project_id, 'source|' || k AS node, 'object|' || object_id AS next FROM o UNION SELECT project_id, 'object|' || needs, 'object|' || object_id FROM e UNION SELECT project_id, 'object|' || object_id, 'version|' || version_id FROM v
                UNION SELECT project_id, 'version|' || version_id, 'report|r' || project_id FROM v UNION SELECT project_id, 'report|r' || project_id, 'package|' || project_id FROM o),
            f AS (SELECT project_id, node, 0 AS n FROM s UNION SELECT g.project_id, g.next, n + 1 FROM f JOIN g USING (project_id, node) WHERE n < 130),
            x AS (SELECT project_id, node FROM g UNION SELECT project_id, next FROM g)
            SELECT project_id, split_part(node, '|', 1) AS kind, substr(node, instr(node, '|') + 1) AS id, count(n) > 0 AS stale, coalesce(min(n), -1) AS distance FROM x LEFT JOIN f USING (project_id, node) GROUP BY ALL""",
    }


def _first() -> dict[str, str]:
    text = "('select q''[a''b]'', ''' || coalesce(text, '') || ''' from t -- it''s' || chr(10) || '/* '''' */ where x = '''' or y = ''z')"
    leading = r"(?s)^(?:\s+|--[^\n]*(?:\n|\z)|/\*.*?(?:\*/|\z))+"
    profile = lambda t, c: f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS rows, '{c}' AS column_name, count({c}) AS n, min({c})::DOUBLE AS min_value, max({c})::DOUBLE AS max_value, count(*) FILTER (WHERE {c}::DOUBLE <> floor({c}::DOUBLE)) AS fractions, (SELECT count(*) FROM {t}) - count({c}) AS nulls, CASE WHEN count({c}) = 0 OR count(*) FILTER (WHERE {c}::DOUBLE <> floor({c}::DOUBLE)) > 0 THEN 'numeric' WHEN min({c}) >= -2147483648 AND max({c}) < 2147483648 THEN 'integer' ELSE 'bigint' END AS narrowest FROM {t}"
    nexts = " UNION ALL ".join(f"SELECT '{t}' AS table_name, (max({k}) + 1)::BIGINT AS next_value FROM {t}" for t, k in (("orders", "o_orderkey"), ("customer", "c_custkey"), ("part", "p_partkey"), ("events", "event_id")))
    counted = COUNTS.format(key="project_id", group="project_id")
    return {
        "minimum_slice": f"{RISKS} SELECT level, code, count(*) AS n FROM r GROUP BY level, code",
        "o04_path_rules": f"SELECT page_id, path, regexp_matches(lower(path), '\\.(sql|ddl|pls|pks|pkb)$') AS allowed, (trim(replace(path, '\\', '/')) = '' OR starts_with(replace(path, '\\', '/'), '/') OR contains(replace(path, '\\', '/'), '../') OR path = '..' OR contains(replace(path, '\\', '/'), ':/')) AS illegal, string_split(replace(path, '\\', '/'), '/')[-1] AS base_name FROM ({_PATHS})",
        "o09_content_hash": "SELECT doc_id, sha256(coalesce(text, '')) AS content_hash, strlen(coalesce(text, ''))::BIGINT AS size_bytes FROM documents",
        "o18_blank": f"SELECT doc_id, md5({_masked('t', BLANK)}) AS blank_md5, list_contains({_tokens('t')}, '''''') AS has_empty FROM (SELECT doc_id, {text} AS t FROM documents)",
        "o19_blank_comments": f"{C} SELECT k, md5({_masked('original_text', COMMENT)}) AS blank_md5, md5(regexp_replace(original_text, {_q(leading)}, '')) AS stripped_md5, true AS terminated FROM c",
        "o24_identifiers": """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'hr.'||lower(p_brand) WHEN 1 THEN lower(p_brand) ELSE 'hr.a"'||p_size END AS normal, CASE p_partkey % 3 WHEN 0 THEN '"'||lower(p_brand)||'"' WHEN 1 THEN '"'||p_brand||'"' ELSE '"A""'||p_size||'"' END AS quoted FROM part""",
        "o29_split": f"{C} SELECT ((k - template) // 16)::BIGINT AS file, md5(original_text) AS text_md5 FROM c",
        "o34_classify": f"""{C} SELECT input_source_id, CASE template WHEN 15 THEN 'UNKNOWN' WHEN 5 THEN 'VIEW' WHEN 6 THEN 'INDEX' WHEN 7 THEN 'SEQUENCE' WHEN 8 THEN 'TRIGGER' WHEN 9 THEN 'FUNCTION' WHEN 10 THEN 'PACKAGE' WHEN 11 THEN 'PACKAGE_BODY' WHEN 12 THEN 'PROCEDURE' WHEN 13 THEN 'VIEW' ELSE 'TABLE' END AS type,
            CASE WHEN template = 0 THEN 'app' ELSE '' END AS schema_name, CASE template WHEN 15 THEN '' WHEN 11 THEN 'k'||(k - 1) WHEN 4 THEN 'Mixed t'||k ELSE ['t','t','t','t','','v','i','s','g','f','k','','r','v','t'][template + 1]||k END AS object_name FROM c""",
        "o40_columns": f"{C}, cols(template, name, source_type, nullable, ordinal_position) AS (VALUES {', '.join(f'({t}, {_q(n)}, {_q(s)}, {str(u).lower()}, {sum(r[0] == t for r in COLUMN_ROWS[: i + 1])})' for i, (t, n, s, u) in enumerate(COLUMN_ROWS))}) SELECT input_source_id, name, source_type, nullable, ordinal_position FROM c JOIN cols USING (template)",
        "o44_replace": f"{OBJECTS} SELECT type, CASE WHEN k % 2 = 0 THEN 'FRESH' ELSE 'PARSED' END AS status, count(*) AS n FROM o WHERE k % 6 <> 0 GROUP BY ALL",
        "o44_snapshot": f"{RISKS} SELECT type, CASE WHEN k % 4 = 0 THEN 'FRESH' ELSE 'PARSED' END AS status, count(*) AS n FROM o WHERE k % 12 <> 0 GROUP BY ALL UNION ALL SELECT code, '', count(*) FROM r WHERE k % 12 <> 0 GROUP BY code",
        "o45_type_map": f"""SELECT p_partkey, CASE m WHEN 0 THEN 'varchar('||n||')' WHEN 1 THEN 'varchar('||n||')' WHEN 2 THEN 'VARCHAR2(*)' WHEN 3 THEN 'numeric('||n||',2)' WHEN 4 THEN 'bytea' WHEN 5 THEN 'TIMESTAMP(6)' WHEN 6 THEN 'numeric' WHEN 7 THEN 'timestamp' WHEN 8 THEN 'timestamp' WHEN 9 THEN 'text' WHEN 10 THEN 'bytea' WHEN 11 THEN 'XMLTYPE' ELSE 'SYSDATE' END AS target_type,
            m IN (1, 2, 5, 6, 7, 11, 12) AS review_required, CASE m WHEN 1 THEN {_N['char']} WHEN 2 THEN {_N['length']} WHEN 3 THEN {_N['narrow']} WHEN 4 THEN {_N['raw']} WHEN 6 THEN {_N['number']} WHEN 7 THEN {_N['date']} WHEN 5 THEN {_N['none']} WHEN 11 THEN {_N['none']} WHEN 12 THEN {_N['none']} ELSE '' END AS notes,
            CASE m WHEN 0 THEN 'VARCHAR2('||n||')' WHEN 1 THEN 'nvarchar2( '||n||' char )' WHEN 2 THEN 'VARCHAR2(*)' WHEN 3 THEN 'number('||n||', 2)' WHEN 4 THEN 'RAW('||n||')' WHEN 5 THEN 'TIMESTAMP(6)' WHEN 6 THEN ' number ' WHEN 7 THEN 'DATE' WHEN 8 THEN 'timestamp' WHEN 9 THEN 'NCLOB' WHEN 10 THEN 'BLOB' WHEN 11 THEN 'XMLTYPE' ELSE 'clock_timestamp()' END AS expression
            FROM (SELECT p_partkey, p_partkey % 13 AS m, p_size::VARCHAR AS n FROM part)""",
        "o47_risks": f"{RISKS} SELECT input_source_id, code, level, evidence FROM r",
        "o50_dependencies": f"{EDGES} SELECT source_key, target_key, type FROM edges",
        "o63_freeze": f"{OBJECTS} SELECT input_source_id, 1 AS version_number, 'AUTO_CONVERSION' AS source, CASE WHEN k % 5 = 0 THEN 'GENERATED' ELSE 'BASELINE' END AS status FROM o UNION ALL SELECT input_source_id, 2, 'USER_EDIT', 'BASELINE' FROM o WHERE k % 5 = 0",
        "o70_precheck": f"""{RISKS}, n AS ({counted}), i AS (SELECT project_id, count(*) AS issues FROM c WHERE template = 15 GROUP BY project_id),
            x AS (SELECT project_id, count(*) FILTER (WHERE k % 5 = 0) AS edits, count(*) FILTER (WHERE k % 5 <> 0 AND type <> 'TABLE') AS still_open FROM o GROUP BY project_id),
            y AS (SELECT n.project_id, object_count, coalesce(issues, 0) AS parse_issue_count, risk_count::BIGINT AS risk_count, blocker_count::BIGINT AS blocker_count, high_risk_count::BIGINT AS high_risk_count, object_count AS conversion_count, (object_count + edits)::BIGINT AS sql_version_count, CASE WHEN blocker_count > 0 OR coalesce(issues, 0) > 0 OR still_open > 0 THEN 'BLOCKED' ELSE 'CURRENT' END AS status FROM n LEFT JOIN i USING (project_id) JOIN x USING (project_id))
            SELECT *, '{{"projectId":"' || project_id || '","type":"PRECHECK","status":"' || status || '","objectCount":' || object_count || ',"parseIssueCount":' || parse_issue_count || ',"riskCount":' || risk_count || ',"blockerCount":' || blocker_count || ',"highRiskCount":' || high_risk_count || ',"conversionCount":' || conversion_count || ',"sqlVersionCount":' || sql_version_count || '}}' AS json_content FROM y""",
        "o80_gate": f"{OBJECTS} SELECT project_id, CASE project_id WHEN 'p0' THEN 'NO_CURRENT_REPORT' WHEN 'p16' THEN 'NO_APPROVED_REVIEW' ELSE 'MANUAL_BASELINE' END AS status, count(*) AS baseline_count, sum((template = 12)::INT)::BIGINT AS blocker_count, CASE project_id WHEN 'p0' THEN 'Current precheck report is required before SQL package export' WHEN 'p16' THEN 'Approved review is required before SQL package export' ELSE 'Manual-required SQL must be edited before SQL package export' END AS message FROM o GROUP BY project_id",
        "o76_stale_reports": "SELECT CASE WHEN o_orderdate < changed THEN 'STALE' ELSE 'CURRENT' END AS status, count(*) AS n FROM orders LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS changed FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) USING (o_custkey) GROUP BY 1",
        "o89_reviews": """SELECT 'developer' AS reviewer, '' AS comment, CASE WHEN decision IS NULL THEN 'decision is required' WHEN b.o_orderkey IS NULL OR b.o_custkey <> a.o_custkey THEN 'Report not found' WHEN decision = 'APPROVED' AND b.o_orderstatus = 'F' THEN 'Stale report cannot be approved' WHEN decision = 'APPROVED' AND b.o_orderstatus = 'P' THEN 'Blocked report cannot be approved' ELSE '' END AS rejection, count(*) AS n
            FROM (SELECT *, o_orderkey + (o_orderkey % 10 = 0)::INT AS wanted, CASE WHEN o_orderkey % 3 = 0 THEN 'REJECTED' WHEN o_orderkey % 7 <> 0 THEN 'APPROVED' END AS decision FROM orders) a LEFT JOIN orders b ON b.o_orderkey = a.wanted GROUP BY ALL""",
        "o100_columns_per_object": f"{C}, cols(template, n_columns) AS (VALUES (0, 3), (1, 3), (2, 3), (3, 2), (4, 2), (14, 2)) SELECT CASE WHEN template = 4 THEN 'Mixed t'||k ELSE 't'||k END AS object_name, n_columns::BIGINT AS n_columns FROM c JOIN cols USING (template)",
        "o103_graph": f"{EDGES}, {RULES}, r AS (SELECT o.*, rules.code, rules.level FROM o JOIN rules USING (template)) SELECT 'node' AS kind, type AS label, count(*) AS n FROM o GROUP BY type UNION ALL SELECT 'node', level, count(*) FROM r GROUP BY level UNION ALL SELECT 'edge', '', (SELECT count(*) FROM o) + (SELECT count(*) FROM r) UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type",
        "d2_report_diff": f"""{RISKS}, x AS (SELECT project_id, 'object_count' AS count_name, count(*) FILTER (WHERE k % 2 = 0) AS before, count(*) AS after FROM o GROUP BY project_id UNION ALL SELECT project_id, 'risk_count', count(*) FILTER (WHERE k % 2 = 0), count(*) FROM r GROUP BY project_id) SELECT *, after - before AS difference FROM x""",
        "d6_work_items": f"""{RISKS} SELECT project_id, 'PARSE' AS source_stage, count(*) AS n FROM c WHERE template = 15 GROUP BY project_id UNION ALL SELECT project_id, 'RISK', count(*) FROM r GROUP BY project_id UNION ALL SELECT DISTINCT project_id, 'REVIEW', 1 FROM o UNION ALL SELECT DISTINCT project_id, 'ADVICE', 1 FROM o""",
        "d12_plan_stages": f"""{OBJECTS}, s(position, stage) AS (VALUES {', '.join(f"({i}, '{x}')" for i, x in enumerate(STAGES, 1))}), t AS (SELECT *, CASE type WHEN 'TABLE' THEN 7 WHEN 'INDEX' THEN 9 WHEN 'VIEW' THEN 11 WHEN 'TRIGGER' THEN 13 WHEN 'SEQUENCE' THEN 14 ELSE 12 END AS position FROM o) SELECT p.project_id, s.position, s.stage, (SELECT count(*) FROM t WHERE t.project_id = p.project_id AND t.position = s.position) AS objects FROM (SELECT DISTINCT project_id FROM o) p, s""",
        "d14_stale_artefacts": f"{C} SELECT input_source_id AS source_id, k % 7 = 0 OR k % 5 = 0 AS stale FROM c",
        "o96_advice": f"""{EDGES}, {RULES}, r AS (SELECT o.*, rules.code, rules.level FROM o JOIN rules USING (template)) SELECT project_id, 'Risk explanation draft' AS title, 'Detected ' || (SELECT count(*) FROM o WHERE o.project_id = r.project_id) || ' objects, ' || (SELECT count(*) FROM edges WHERE edges.project_id = r.project_id) || ' dependencies, ' || count(*) || ' risks and ' || (SELECT count(*) FROM o WHERE o.project_id = r.project_id) || ' conversion results.' AS summary, array_to_string(list_sort(list_distinct(list(code))), ',') AS rule_codes, count(DISTINCT k)::INT AS n_affected FROM r GROUP BY project_id""",
        "o110_convert": f"""{OBJECTS}, x(template, rule_codes, notes) AS (VALUES {', '.join(f'({t}, {_q(c)}, {_q(n)})' for t, c, n in _conversion_rows())}) SELECT input_source_id, {LEVEL} AS level, rule_codes, notes, CASE template
            WHEN 0 THEN 'create table "app"."t'||k||'" (' || chr(10) || '    "id" numeric(10,0) primary key,' || chr(10) || '    "name" varchar(100) not null,' || chr(10) || '    "note" text' || chr(10) || ');'
            WHEN 1 THEN 'create table "t'||k||'" (' || chr(10) || '    "id" numeric(19,0),' || chr(10) || '    "made" timestamp default clock_timestamp(),' || chr(10) || '    "flag" varchar(1) default '''',' || chr(10) || '    constraint t'||k||'_pk primary key (id)' || chr(10) || ');'
            WHEN 2 THEN 'create table "t'||k||'" (' || chr(10) || '    "amount" numeric,' || chr(10) || '    "raw_id" bytea,' || chr(10) || '    "ref_id" numeric(10,0) references app.t'||(k - 2)||' (id)' || chr(10) || ');'
            WHEN 3 THEN 'create table "t'||k||'" (' || chr(10) || '    "label" varchar(50) default q''[it''s, (ok); number]'',' || chr(10) || '    "n" numeric(8,2) default nextval(''s'||(k + 4)||'''::regclass)' || chr(10) || ');'
            WHEN 4 THEN 'create table "Mixed t'||k||'" (' || chr(10) || '    "Id" numeric(10,0),' || chr(10) || '    "Big Text" text' || chr(10) || ');'
            WHEN 14 THEN 'create temporary table "t'||k||'" (' || chr(10) || '    "id" numeric(10,0),' || chr(10) || '    "d" timestamp' || chr(10) || ') on commit preserve rows;'
            WHEN 5 THEN '-- DRAFT: Simple view SQL is carried forward as a draft; Oracle functions and outer joins still need precheck.' || chr(10) || original_text
            WHEN 13 THEN '-- DRAFT: Simple view SQL is carried forward as a draft; Oracle functions and outer joins still need precheck.' || chr(10) || original_text
            WHEN 6 THEN '-- DRAFT: Review index method, expression syntax, and tablespace/storage clauses before execution.' || chr(10) || original_text
            WHEN 7 THEN '-- DRAFT: Review sequence min/max/cache/cycle semantics and reset position after data load.' || chr(10) || original_text
            ELSE '-- MANUAL_REQUIRED: Only conservative DDL conversion is available in the P0 automatic path.' || chr(10) || original_text END AS target_sql FROM o JOIN x USING (template)""",
        "q3_risks": f"{RISKS} SELECT input_source_id, level, code FROM r WHERE project_id = 'p16'",
        "d1_batch_diff": f"{C} SELECT source_path AS relative_path, CASE WHEN k % 11 = 0 THEN 'ADDED' WHEN k % 7 = 0 THEN 'REMOVED' WHEN k % 5 = 0 THEN 'CHANGED' ELSE 'SAME' END AS change FROM c WHERE NOT (k % 11 = 0 AND k % 7 = 0)",
        "d3_value_profile": " UNION ALL ".join(profile(t, c) for t, c in (("lineitem", "l_orderkey"), ("lineitem", "l_quantity"), ("lineitem", "l_extendedprice"), ("lineitem", "l_linenumber"), ("orders", "o_orderkey"), ("orders", "o_totalprice"))),
        "d4_shard_checksums": f"SELECT (('0x' || md5(l_orderkey::VARCHAR)[1:7])::BIGINT % 16)::INT AS shard, count(*) AS rows, sum({ROW_DIGEST})::VARCHAR AS checksum FROM lineitem GROUP BY 1",
        "d4_unequal_shards": f"""{LOADED}, t AS (SELECT side, level, md5({LINE_KEY})[1:level] AS shard, {ROW_DIGEST} AS d FROM x, (SELECT unnest(range(0, 4))::INT AS level)),
            s AS (SELECT level, shard, count(*) FILTER (WHERE side = 0) AS rows_before, count(*) FILTER (WHERE side = 1) AS rows_after, sum(CASE WHEN side = 0 THEN d ELSE -d END) AS d FROM t GROUP BY ALL)
            SELECT level, shard, rows_before, rows_after FROM s WHERE rows_before <> rows_after OR d <> 0""",
        "d4_differences": f"""{LOADED}, c AS (SELECT l_orderkey, l_linenumber, {ROW_DIGEST} AS d, count(*) FILTER (WHERE side = 0) AS b, count(*) FILTER (WHERE side = 1) AS a FROM x GROUP BY ALL),
            s AS (SELECT l_orderkey, l_linenumber, sum(b)::BIGINT AS rows_before, sum(a)::BIGINT AS rows_after, bool_or(a <> b) AS differs FROM c GROUP BY ALL)
            SELECT l_orderkey, l_linenumber, CASE WHEN rows_before = 0 THEN 'ADDED' WHEN rows_after = 0 THEN 'REMOVED' ELSE 'CHANGED' END AS difference, rows_before, rows_after FROM s WHERE differs""",
        "d4_sample": f"""{LOADED} SELECT l_orderkey, l_linenumber, {ROW_DIGEST} AS digest, count(*) FILTER (WHERE side = 0) AS rows_before, count(*) FILTER (WHERE side = 1) AS rows_after FROM x WHERE ('0x' || md5(l_orderkey::VARCHAR)[1:7])::BIGINT % 50 = 0 GROUP BY ALL""",
        "d5_depth_shards": "SELECT unnest(['event_id', 'skewed', 'sparse', '']) AS key, shard, true AS near, (SELECT count(*) FROM events) AS total FROM (SELECT unnest(range(0, 8))::INT AS shard)",
        "d5_range_shards": "SELECT floor((o_orderkey - lo) / ((hi - lo + 1)::DOUBLE / 8))::INT AS shard, count(*) AS rows, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders, (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders) GROUP BY 1",
        "d7_folded_risks": f"{RISKS} SELECT project_id, code, level, count(*) AS n, CASE level WHEN 'BLOCKER' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END AS severity FROM r GROUP BY project_id, code, level",
        "d8_waves": f"""{EDGES.replace('WITH', 'WITH RECURSIVE', 1)}, w(project_id, k, depth) AS (SELECT project_id, k, 0 FROM o UNION ALL SELECT edges.project_id, edges.source_key, w.depth + 1 FROM w JOIN edges ON edges.target_key = w.k), m AS (SELECT project_id, k, max(depth) AS wave FROM w GROUP BY project_id, k) SELECT project_id, wave, count(*) AS n FROM m GROUP BY project_id, wave""",
        "d9_roll_up": f"""{RISKS}, b AS ({COUNTS.format(key="project_id, source_project_id", group="project_id, source_project_id")}), i AS (SELECT project_id, source_project_id, count(*) AS issues FROM c WHERE template = 15 GROUP BY ALL),
            j AS (SELECT coalesce(b.project_id, i.project_id) AS project_id, coalesce(b.source_project_id, i.source_project_id) AS source_project_id, coalesce(object_count, 0) AS object_count, coalesce(issues, 0) AS parse_issue_count, coalesce(risk_count, 0) AS risk_count, coalesce(blocker_count, 0) AS blocker_count, coalesce(high_risk_count, 0) AS high_risk_count FROM b FULL JOIN i ON b.project_id = i.project_id AND b.source_project_id = i.source_project_id),
            s AS (SELECT * FROM j UNION ALL SELECT project_id, '*', sum(object_count), sum(parse_issue_count), sum(risk_count), sum(blocker_count), sum(high_risk_count) FROM j GROUP BY project_id)
            SELECT project_id, source_project_id, object_count::BIGINT AS object_count, parse_issue_count::BIGINT AS parse_issue_count, risk_count::BIGINT AS risk_count, blocker_count::BIGINT AS blocker_count, high_risk_count::BIGINT AS high_risk_count, object_count::BIGINT AS conversion_count, object_count::BIGINT AS sql_version_count,
            greatest(0, floor(100 - (25 * blocker_count + 10 * high_risk_count + (risk_count - blocker_count - high_risk_count))::DOUBLE / greatest(object_count, 1)))::BIGINT AS score FROM s""",
        "d10_duplicates": "SELECT doc_id AS relative_path, sha256(coalesce(text, '')) AS content_hash, count(*) OVER w AS copies, min(doc_id) OVER w AS first_path FROM documents WINDOW w AS (PARTITION BY coalesce(text, '')) QUALIFY count(*) OVER w > 1",
        "d13_sequences": nexts,
    }


def _lifecycle(convert_sql: str) -> dict[str, str]:
    """SQL of the queries over the life of a project; ``convert_sql`` holds the target SQL of every template."""
    counted = COUNTS.format(key="project_id", group="project_id")
    target = next(iter(re.findall(r"(?s)CASE template\n(.*?) AS target_sql", convert_sql)))
    return {
        "o05_import": """SELECT p_partkey, violation, CASE WHEN violation = '' THEN 'FOLDER' ELSE '' END AS type, CASE WHEN violation = '' THEN name ELSE '' END AS name, CASE WHEN violation = '' THEN sha256('select ' || p_partkey || ' é;') ELSE '' END AS content_hash, CASE WHEN violation = '' THEN length('select ' || p_partkey) + 4 ELSE 0 END::BIGINT AS size_bytes
            FROM (SELECT p_partkey, CASE WHEN p_partkey % 9 = 1 THEN 'EXTENSION' WHEN p_partkey % 10 = 0 THEN 'EMPTY' WHEN p_partkey % 9 = 2 THEN 'PATH' WHEN p_partkey % 10 = 1 THEN 'ENCODING' ELSE '' END AS violation, 'f' || p_partkey || CASE p_partkey % 9 WHEN 0 THEN '.sql' WHEN 3 THEN '.PKB' ELSE '.ddl' END AS name FROM part)""",
        "o51_preferences": f"""{OBJECTS}, e(template, step, type) AS (VALUES {', '.join(f'({t}, {s}, {_q(x)})' for t, s, x in [*EDGE_ROWS, (11, -1, 'PACKAGE_BODY_FOR_SPEC')])}),
            d AS (SELECT k, template, project_id, source_project_id AS sp, k AS id, 0 AS copy FROM o UNION ALL SELECT k, template, project_id, 'c' || ((k // 2) % 3), k + 10000000, 1 FROM o),
            found AS (SELECT a.id AS source_key, b.id AS target_key, e.type, a.template, a.sp = b.sp AS same, max((a.sp = b.sp)::INT) OVER (PARTITION BY a.id, e.step) AS any_same, row_number() OVER (PARTITION BY a.id, e.step ORDER BY (a.sp = b.sp)::INT DESC, b.copy) AS place FROM d a JOIN e USING (template) JOIN d b ON b.k = a.k + e.step AND b.project_id = a.project_id)
            SELECT source_key::BIGINT AS source_key, target_key::BIGINT AS target_key, CASE WHEN same THEN type ELSE 'CROSS_SOURCE_DEPENDENCY' END AS type FROM found
            WHERE CASE WHEN template IN (5, 9, 12, 13) THEN same OR any_same = 0 WHEN template = 11 THEN same ELSE place = 1 END""",
        "o64_frozen_again": f"""{OBJECTS} SELECT input_source_id, 1 AS version_number, 'AUTO_CONVERSION' AS source, CASE WHEN project_id = 'p0' THEN 'GENERATED' WHEN k % 3 = 0 THEN 'STALE' ELSE 'BASELINE' END AS status FROM o UNION ALL SELECT input_source_id, 2, 'USER_EDIT', CASE WHEN project_id = 'p0' THEN 'EDITED' ELSE 'BASELINE' END FROM o WHERE k % 3 = 0""",
        "o69_replaced": f"""{OBJECTS} SELECT input_source_id, 1 AS version_number, 'AUTO_CONVERSION' AS source, k % 8 = 0 AS fresh FROM o WHERE k % 8 <> 4 UNION ALL SELECT input_source_id, 2, 'USER_EDIT', false FROM o WHERE k % 5 = 0""",
        "o74_html": f"""{RISKS}, n AS ({counted}), i AS (SELECT project_id, count(*) AS issues FROM c WHERE template = 15 GROUP BY project_id),
            y AS (SELECT n.*, coalesce(issues, 0) AS issues, CASE WHEN project_id <> 'p0' THEN 'STALE' ELSE 'BLOCKED' END AS status FROM n LEFT JOIN i USING (project_id))
            SELECT project_id, status, status AS json_status, {_q(report.HTML[0])} || '<dt>Project</dt><dd>' || project_id || '</dd><dt>Status</dt><dd>' || status || '</dd><dt>Objects</dt><dd>' || object_count || '</dd><dt>Parse Issues</dt><dd>' || issues || '</dd><dt>Risks</dt><dd>' || risk_count::BIGINT || '</dd><dt>Blockers</dt><dd>' || blocker_count::BIGINT || '</dd><dt>High Risks</dt><dd>' || high_risk_count::BIGINT || '</dd><dt>Conversions</dt><dd>' || object_count || '</dd><dt>SQL Versions</dt><dd>' || object_count || '</dd>' || {_q(report.HTML[1])} AS html_content FROM y""",
        "q1_objects": f"{OBJECTS}, x AS (SELECT *, {NAME} AS object_name FROM o) SELECT project_id, source_project_id, input_source_id, type, object_name, 'PARSED' AS status, source_path, 0 AS start_offset, 1 AS start_line, rank() OVER (PARTITION BY project_id ORDER BY type, object_name)::BIGINT AS position FROM x",
        "q2_parse_issues": f"""{C}, x AS (SELECT *, ((k - template) // 16)::BIGINT::VARCHAR AS file FROM c), y AS (SELECT *, coalesce(sum(length(original_text) + 1) OVER (PARTITION BY project_id, file ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start_offset FROM x)
            SELECT project_id, file AS input_source_id, 'UNSUPPORTED_STATEMENT' AS code, 'Statement is not supported by the object model.' AS message, original_text AS text, start_offset, rank() OVER (PARTITION BY project_id ORDER BY start_offset)::BIGINT AS position FROM y WHERE template = 15""",
        "q4_conversions": f"{OBJECTS}, x AS (SELECT *, {LEVEL} AS level, {ID} AS object_id FROM o) SELECT project_id, input_source_id, level, rank() OVER (PARTITION BY project_id ORDER BY list_position(['AUTO', 'REVIEW_REQUIRED', 'DRAFT', 'MANUAL_REQUIRED'], level), object_id)::BIGINT AS position FROM x",
        "q5_dependencies": f"{EDGES}, r AS (SELECT project_id, type, rank() OVER (PARTITION BY project_id ORDER BY type)::BIGINT AS position FROM edges) SELECT project_id, type, position, count(*) AS n FROM r GROUP BY ALL",
        "q6_versions": f"{OBJECTS}, v AS (SELECT *, 1 AS version_number, 'AUTO_CONVERSION' AS source, {ID} AS object_id FROM o UNION ALL SELECT *, 2, 'USER_EDIT', {ID} FROM o WHERE k % 5 = 0) SELECT project_id, input_source_id, version_number, source, rank() OVER (PARTITION BY project_id ORDER BY object_id, version_number)::BIGINT AS position FROM v",
        "q7_reports": "SELECT o_custkey AS project_id, o_orderkey AS report_id, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC)::BIGINT AS position, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1 AS latest FROM orders",
        "q11_preview": f"{OBJECTS}, x AS (SELECT *, {ID} AS object_id FROM o WHERE template <> 12 AND project_id <> 'p0') SELECT project_id, 'READY' AS status, count(*) AS baseline_count, 1::BIGINT AS approved_review_count, 0::BIGINT AS blocker_count, '001_schema_baseline.sql' AS files, md5(string_agg(object_id, ',' ORDER BY object_id)) AS objects_md5 FROM x GROUP BY project_id",
        "q12_package_blocks": f"{OBJECTS}, x AS (SELECT project_id, {ID} AS object_id, CASE template\n{target} AS target_sql FROM o) SELECT project_id, md5('-- object: ' || object_id || ', version: 1' || chr(10) || regexp_replace(target_sql, '\\s+$', '') || chr(10) || chr(10)) AS block_md5 FROM x",
        "o88_package": f"{OBJECTS}, x AS (SELECT project_id, {ID} AS object_id, CASE template\n{target} AS target_sql FROM o) SELECT project_id, (length('-- SQL package' || chr(10) || '-- project: ' || project_id) + 2 + sum(length('-- object: ' || object_id || ', version: 1' || regexp_replace(target_sql, '\\s+$', '')) + 3))::INT AS n_chars, count(*)::INT AS n_objects FROM x GROUP BY project_id",
        "q13_advice": f"""{OBJECTS}, {RULES}, t(n, type, title) AS (VALUES {', '.join(f'({n}, {_q(k)}, {_q(v)})' for n, (k, v) in enumerate(advice.TITLES.items()))}), r AS (SELECT project_id, count(*) AS n_risks FROM o JOIN rules USING (template) GROUP BY project_id)
            SELECT project_id, t.type, title, 'DRAFT' AS status, {_q(advice.HUMAN)} AS uncertainty, 'rules' AS provider, count(*) AS object_count, any_value(n_risks) AS risk_count, (4 - n)::BIGINT AS position FROM o JOIN r USING (project_id), t GROUP BY project_id, t.type, title, n""",
        "q14_batches": "SELECT c_nationkey::VARCHAR AS project_id, trim(c_name) AS name, CASE WHEN c_custkey % 2 = 0 THEN 'FOLDER_SET' ELSE 'DATABASE_EXPORT' END AS type, c_custkey::BIGINT AS created, rank() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)::BIGINT AS position FROM customer WHERE c_custkey % 5 <> 0",
    }
