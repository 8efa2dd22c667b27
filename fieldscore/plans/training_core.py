"""Queries of the general data-work operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscore.operators.current import current_rows
from fieldscore.operators.diff import json_differences
from fieldscore.operators.nested import ARM_SECTIONS, JUDGE_SECTIONS, array_paths, doc_result_roots, node_links, scalar_elements, typed_tables, _columns
from fieldscore.session import table

KEY = ["run_id", "doc_id"]


def _current_results(spark: SparkSession, d: str) -> DataFrame:
    return current_rows(table(spark, d, "doc_results").select(*KEY, "written_at", "arms", "judge"), KEY, "written_at", [F.xxhash64("arms", "judge")])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every element object of the nested sections with the element it hangs under."""
    return node_links(_current_results(spark, d), KEY, doc_result_roots())


def _p1_table(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return typed_tables(_current_results(spark, d), KEY, doc_result_roots())[name]

    query.__doc__ = f"The flat table {name}: keys, path, parent, root, position and its typed columns."
    return query


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Results that one side lacks, and leaves on which doc_results and app_results disagree."""
    return json_differences(table(spark, d, "doc_results"), table(spark, d, "app_results"), KEY, "arms", "written_at", "stored_at", left_filter=F.col("ok"), left_columns=("ok",))


def p1_scalars(spark: SparkSession, d: str) -> DataFrame:
    """Elements of the nested sections that are no objects."""
    return scalar_elements(_current_results(spark, d), KEY, doc_result_roots())


def p1_array_paths(spark: SparkSession, d: str) -> DataFrame:
    """All arrays of the current payloads, declared or not, with their elements; arms named _... have no tables."""
    declared = ("lineItems", "lineItems[].modifiers", "totals.otherCharges", "totals.taxes")
    return array_paths(_current_results(spark, d), "arms", declared)


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p1_scalars": p1_scalars, "p1_array_paths": p1_array_paths}
TABLES = _columns((*ARM_SECTIONS, *JUDGE_SECTIONS))
QUERIES |= {f"p1_{t}": _p1_table(t) for t in TABLES}
_ELEMENTS = "CASE json_type(v) WHEN 'ARRAY' THEN CAST(v AS JSON[]) WHEN 'OBJECT' THEN [v] ELSE [] END"
_READ = "CASE WHEN json_valid({c}) THEN CASE WHEN starts_with(ltrim({c}), '\"') THEN try_cast(({c}::JSON->>'$') AS JSON) ELSE {c}::JSON END END"
_NODES = f"""WITH c AS (SELECT run_id, doc_id, arms, judge FROM (SELECT *, row_number() OVER (PARTITION BY run_id, doc_id ORDER BY written_at DESC NULLS LAST, arms, judge) AS rn FROM doc_results) WHERE rn = 1),
      top AS MATERIALIZED (SELECT run_id, doc_id, {_READ.format(c="arms")} AS a, {_READ.format(c="judge")} AS j FROM c),
      named AS MATERIALIZED (SELECT run_id, doc_id, k AS arm, json_extract(a, '$."' || k || '"') AS v FROM top, unnest(json_keys(a)) t(k) WHERE a IS NOT NULL AND NOT starts_with(k, '_')),
      opened AS MATERIALIZED (SELECT run_id, doc_id, arm, CASE WHEN json_type(v) = 'VARCHAR' THEN try_cast((v->>'$') AS JSON) ELSE v END AS v FROM named),
      p AS MATERIALIZED (SELECT run_id, doc_id, arm, CASE WHEN len(json_keys(v)) = 1 AND json_keys(v)[1] IN ('invoiceOutputData', 'receiptOutputData') THEN json_extract(v, '$.' || json_keys(v)[1]) ELSE v END AS p FROM opened WHERE json_type(v) = 'OBJECT'),
      one AS MATERIALIZED (
        SELECT run_id, doc_id, arm AS parent, arm AS root, arm || '.' || s AS pre, json_extract(p, '$.' || s) AS v, CASE s WHEN 'lineItems' THEN 'modifiers' END AS below, t AS tab FROM p, (VALUES ('lineItems', 'line_items'), ('totals.otherCharges', 'charges'), ('totals.taxes', 'taxes')) x(s, t)
        UNION ALL SELECT run_id, doc_id, 'judge', 'judge', 'judge.issues.' || k, json_extract(j, '$.issues."' || k || '"'), 'evidence', 'issues' FROM (SELECT * FROM top WHERE json_type(j, '$.issues') = 'OBJECT'), unnest(json_keys(j, '$.issues')) t(k)),
      l1 AS MATERIALIZED (SELECT run_id, doc_id, parent, root, pre, below, tab, {_ELEMENTS} AS l FROM one),
      e1 AS MATERIALIZED (SELECT run_id, doc_id, parent, root, pre || '[' || i || ']' AS node, below, tab, i AS position, l[i + 1] AS e FROM l1, unnest(range(len(l))) t(i)),
      n1 AS MATERIALIZED (SELECT * FROM e1 WHERE json_type(e) = 'OBJECT'),
      two AS MATERIALIZED (SELECT run_id, doc_id, node AS parent, root, node || '.' || below AS pre, json_extract(e, '$.' || below) AS v, below AS tab FROM n1 WHERE below IS NOT NULL),
      l2 AS MATERIALIZED (SELECT run_id, doc_id, parent, root, pre, tab, {_ELEMENTS} AS l FROM two),
      e2 AS MATERIALIZED (SELECT run_id, doc_id, parent, root, pre || '[' || i || ']' AS node, tab, i AS position, l[i + 1] AS e FROM l2, unnest(range(len(l))) t(i)),
      elements AS (SELECT run_id, doc_id, parent, root, node, tab, position, e FROM e1 UNION ALL SELECT * FROM e2),
      nodes AS (SELECT * FROM elements WHERE json_type(e) = 'OBJECT')"""


def _typed_sql(name: str, path: str, kind: str) -> str:
    v = f"json_extract(e, '$.{path}')"
    text = f"CASE WHEN json_type({v}) NOT IN ('NULL', 'OBJECT', 'ARRAY') THEN {v}->>'$' END"
    return f"TRY_CAST({text} AS DOUBLE) AS {name}" if kind == "double" else f"{text} AS {name}"


# Each leaf of a payload: JSON text in strings opened, wrappers stripped, an object in the place of a section its only element.
_OPEN = "CASE WHEN json_type({v}) = 'VARCHAR' AND regexp_matches({v}->>'$', '^\\s*[\\[{{\"]') AND json_valid({v}->>'$') AND json_type(({v}->>'$')::JSON) IN ('OBJECT', 'ARRAY') THEN ({v}->>'$')::JSON ELSE {v} END"
_SECTION = "regexp_matches(regexp_replace(path, '\\[\\d+\\]', '[]', 'g') || '.' || k, '^[^.]*\\.(lineItems|lineItems\\[\\]\\.modifiers|totals\\.otherCharges|totals\\.taxes)$')"


def _side_sql(name: str, table: str, version: str, kept: str) -> str:
    """CTEs <name>_keys and <name>_leaves of one copy."""
    return f"""{name}_cur AS MATERIALIZED (SELECT * FROM (SELECT run_id, doc_id, arms, {kept} AS kept, row_number() OVER (PARTITION BY run_id, doc_id ORDER BY {version} DESC NULLS LAST, arms) AS rn FROM {table}) WHERE rn = 1),
      {name}_keys AS MATERIALIZED (SELECT run_id, doc_id, {_READ.format(c="arms")} AS a FROM {name}_cur WHERE kept),
      {name}_arms AS MATERIALIZED (SELECT run_id, doc_id, k AS path, {_OPEN.format(v="v")} AS v FROM (SELECT run_id, doc_id, k, json_extract(a, '$."' || k || '"') AS v FROM {name}_keys, unnest(json_keys(a)) t(k) WHERE json_type(a) = 'OBJECT' AND NOT starts_with(k, '_'))),
      {name}_tree AS (
        SELECT run_id, doc_id, path, CASE WHEN json_type(v) = 'OBJECT' AND len(json_keys(v)) = 1 AND json_keys(v)[1] IN ('invoiceOutputData', 'receiptOutputData') THEN {_OPEN.format(v="json_extract(v, '$.' || json_keys(v)[1])")} ELSE v END AS v FROM {name}_arms
        UNION ALL (
          SELECT run_id, doc_id, path || '.' || k, CASE WHEN {_SECTION} AND json_type({_OPEN.format(v="x")}) = 'OBJECT' THEN json_array({_OPEN.format(v="x")}) ELSE {_OPEN.format(v="x")} END
          FROM (SELECT run_id, doc_id, path, k, json_extract(v, '$."' || k || '"') AS x FROM {name}_tree, unnest(json_keys(v)) t(k) WHERE json_type(v) = 'OBJECT')
          UNION ALL SELECT run_id, doc_id, path || '[' || i || ']', {_OPEN.format(v="json_extract(v, '$[' || i || ']')")} FROM {name}_tree, unnest(range(json_array_length(v)::BIGINT)) t(i) WHERE json_type(v) = 'ARRAY')),
      {name}_leaves AS MATERIALIZED (SELECT run_id, doc_id, path, CASE WHEN json_type(v) IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT') THEN 'n' || CAST(CAST(v->>'$' AS DOUBLE) AS VARCHAR) WHEN json_type(v) = 'VARCHAR' THEN 's' || (v->>'$') ELSE 'l' || CAST(v AS VARCHAR) END AS leaf
        FROM {name}_tree WHERE json_type(v) NOT IN ('OBJECT', 'ARRAY'))"""


ORACLES: dict[str, str] = {
    "p1_found": f"{_NODES} SELECT run_id, doc_id, node AS node_path, parent AS parent_path FROM nodes",
    "p1_scalars": f"{_NODES} SELECT run_id, doc_id, node AS node_path, parent AS parent_path, CAST(e AS VARCHAR) AS value FROM elements WHERE json_type(e) NOT IN ('OBJECT', 'NULL')",
    "p3_found": f"""WITH RECURSIVE {_side_sql("r", "doc_results", "written_at", "ok")}, {_side_sql("a", "app_results", "stored_at", "true")}
      SELECT run_id, doc_id, '' AS leaf_path, CASE WHEN a.doc_id IS NULL THEN 'only_run' ELSE 'only_app' END AS diff_kind FROM r_keys r FULL JOIN (SELECT run_id, doc_id FROM a_keys) a USING (run_id, doc_id) WHERE r.doc_id IS NULL OR a.doc_id IS NULL
      UNION ALL SELECT run_id, doc_id, path, CASE WHEN a.leaf IS NULL THEN 'leaf_only_run' WHEN r.leaf IS NULL THEN 'leaf_only_app' ELSE 'differs' END
      FROM (SELECT * FROM r_leaves SEMI JOIN a_keys USING (run_id, doc_id)) r FULL JOIN (SELECT * FROM a_leaves SEMI JOIN r_keys USING (run_id, doc_id)) a USING (run_id, doc_id, path) WHERE r.leaf IS DISTINCT FROM a.leaf""",
}
ORACLES |= {f"p1_{t}": f"{_NODES} SELECT run_id, doc_id, node AS node_path, parent AS parent_path, root, CAST(position AS INTEGER) AS position, {', '.join(_typed_sql(*c) for c in columns)} FROM nodes WHERE tab = '{t}'" for t, columns in TABLES.items()}
