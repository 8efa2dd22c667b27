"""Parts of the SQL that states the same results for DuckDB."""

from __future__ import annotations

from fieldscore.operators.rules import DOC_TYPES, rule_registry

NUMBER = r"(?:\(\s*)?(?:[-+]\s*)?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:\s*\))?"


def norm(x: str) -> str:
    return f"nullif(trim(regexp_replace(lower({x}), '\\s+', ' ', 'g')), '')"


def norm_words(x: str) -> str:
    return f"nullif(trim(regexp_replace(regexp_replace(lower({x}), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')), '')"


def money(x: str) -> str:
    """decimal text rules over a string; needs no subquery, so it can stand anywhere."""
    s = f"trim(regexp_replace({x}, '^\\s*[A-Z][A-Z0-9_]*\\s*:\\s*', ''))"
    tok = f"regexp_extract_all({s}, '{NUMBER}')[-1]"
    val = f"round(try_cast(regexp_replace(regexp_replace({tok}, '[^\\d.]', '', 'g'), '\\.$', '') AS DECIMAL(28,10)), 2)"
    before = f"substr({s}, 1, length({s}) - strpos(reverse({s}), reverse({tok})) - length({tok}) + 1)"
    neg = f"((starts_with({tok}, '(') AND ends_with({tok}, ')')) OR starts_with(regexp_replace({tok}, '[(\\s]', '', 'g'), '-') OR regexp_matches({before}, '\\(\\s*-\\s*\\)\\s*[^\\d]{{0,3}}$'))"
    return f"CASE WHEN {neg} THEN -({val}) ELSE {val} END"


def address_line(x: str) -> str:
    parts = f"list_filter(list_transform(string_split(regexp_replace({x}, '\\r\\n?', chr(10), 'g'), chr(10)), lambda q: trim(q, ' ,')), lambda q: q <> '')"
    return norm(f"array_to_string({parts}, ', ')")


def address_compared(x: str) -> str:
    return norm(f"regexp_replace({x}, '[,;.]', ' ', 'g')")


def address_merged(v: str, alt: bool = False) -> str:
    order = ("address", "postal_code", "city", "state", "country") if alt else ("address", "city", "state", "postal_code", "country")
    return norm("concat_ws(' ', " + ", ".join(f"nullif(trim({v}->>'{k}', ' ,'), '')" for k in order) + ")")


def emitted(v: str) -> str:
    bare = f"regexp_replace(regexp_replace({v}::VARCHAR, '\"(?:[^\"\\\\]|\\\\.)*\"\\s*:', '', 'g'), 'null|\"(?:\\s|\\\\[nrt])*\"|[\\s{{}}\\[\\],]', '', 'g')"
    return f"({v} IS NOT NULL AND json_type({v}) <> 'NULL' AND {bare} <> '')"


def anls(p: str, t: str) -> str:
    return f"CASE WHEN {p} IS NULL AND {t} IS NULL THEN 1.0 WHEN {p} IS NULL OR {t} IS NULL THEN 0.0 ELSE 1.0 - levenshtein({p}, {t})::DOUBLE / greatest(length({p}), length({t})) END"


def rule_values() -> str:
    rows = [f"('{name}', '{p}', '{r}')" for name, spec in DOC_TYPES.items() for p, r in sorted(rule_registry(spec).items()) if "[]" not in p]
    return f"rules AS (SELECT * FROM (VALUES {', '.join(rows)}) t(doc_type, path, rule))"


PREDS = """cur AS (
  SELECT run_id, doc_id, arms, judge FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id, doc_id ORDER BY written_at DESC NULLS LAST, arms, judge) AS rn FROM doc_results) WHERE rn = 1 AND ok),
top AS MATERIALIZED (
  SELECT run_id, doc_id, CASE WHEN json_valid(arms) THEN CASE WHEN starts_with(ltrim(arms), '"') THEN try_cast((arms::JSON->>'$') AS JSON) ELSE arms::JSON END END AS a FROM cur),
named AS MATERIALIZED (
  SELECT run_id, doc_id, k AS arm, json_extract(a, '$."' || k || '"') AS v FROM top, unnest(json_keys(a)) t(k) WHERE a IS NOT NULL AND NOT starts_with(k, '_')),
opened AS MATERIALIZED (SELECT run_id, doc_id, arm, CASE WHEN json_type(v) = 'VARCHAR' THEN try_cast((v->>'$') AS JSON) ELSE v END AS v FROM named),
preds AS MATERIALIZED (
  SELECT run_id, doc_id, arm, CASE WHEN len(json_keys(v)) = 1 AND json_keys(v)[1] IN ('invoiceOutputData', 'receiptOutputData') THEN json_extract(v, '$.' || json_keys(v)[1]) ELSE v END AS p
  FROM opened WHERE json_type(v) = 'OBJECT')"""

RECORDS = """rec AS MATERIALIZED (
  SELECT *, coalesce(json_extract_string(meta, '$.no_tax_label') = 'true', false) AS no_tax FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY received_at DESC NULLS LAST) AS rn FROM gt_records) WHERE rn = 1)"""


def _verdict_sql() -> str:
    nv, ov = "json_extract(pv, '$.normalizedValue')", "json_extract(pv, '$.originalValue')"
    number = f"json_type({nv}) IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT')"
    printed = f"CASE WHEN json_type({ov}) IS NOT NULL AND json_type({ov}) NOT IN ('NULL', 'BOOLEAN') THEN {money(f'({ov}->>' + chr(39) + '$' + chr(39) + ')')} END"
    p_num = f"""CASE WHEN json_type(pv) = 'OBJECT' THEN CASE WHEN json_type({nv}) = 'NULL' THEN NULL WHEN {number} THEN round(try_cast(({nv}->>'$') AS DECIMAL(28,10)), 2) WHEN json_type({ov}) = 'NULL' THEN NULL ELSE {printed} END
        WHEN json_type(pv) NOT IN ('NULL', 'BOOLEAN') THEN {money("(pv->>'$')")} END"""
    p_src = f"""CASE WHEN json_type(pv) = 'OBJECT' THEN CASE WHEN json_type({nv}) = 'NULL' OR {number} THEN 'normalizedValue' WHEN json_type({ov}) = 'NULL' OR {printed} IS NOT NULL THEN 'originalValue' END
        WHEN json_type(pv) NOT IN ('NULL', 'BOOLEAN') AND {money("(pv->>'$')")} IS NOT NULL THEN 'originalValue' END"""
    return f"""{PREDS}, {RECORDS}, {rule_values()},
fields AS MATERIALIZED (
  SELECT p.run_id, p.arm, p.doc_id, r.cluster_id, r.doc_type, r.source_dataset, r.no_tax, u.path, x.rule, json_extract(p.p, '$.' || u.path) AS pv, r.gt[u.path] AS truth
  FROM preds p JOIN rec r USING (doc_id), unnest(r.annotated_fields) u(path) JOIN rules x ON x.path = u.path WHERE x.doc_type = r.doc_type),
forms AS MATERIALIZED (
  SELECT *, CASE WHEN json_type(pv) <> 'NULL' THEN pv->>'$' END AS raw,
    CASE WHEN rule = 'numeric' THEN {p_num} END AS p_num, CASE WHEN rule = 'numeric' THEN {p_src} END AS p_src, CASE WHEN rule = 'numeric' THEN {money("truth")} END AS t_num,
    CASE WHEN rule = 'address' THEN CASE WHEN json_type(pv) = 'OBJECT' THEN {address_compared(address_merged("pv"))} ELSE {address_compared(address_line("(pv->>'$')"))} END END AS p_adr,
    CASE WHEN rule = 'address' THEN CASE WHEN json_type(pv) = 'OBJECT' THEN {address_compared(address_merged("pv", True))} ELSE {address_compared(address_line("(pv->>'$')"))} END END AS p_alt,
    CASE WHEN rule = 'address' THEN {address_compared(address_line("truth"))} END AS t_adr,
    {emitted("pv")} AS says
  FROM fields),
plain AS MATERIALIZED (
  SELECT *, CASE WHEN rule = 'phone' THEN nullif(regexp_replace(raw, '\\s+', '', 'g'), '') WHEN rule = 'text_contained' THEN {norm_words("raw")} ELSE {norm("raw")} END AS p_txt,
    CASE WHEN rule = 'phone' THEN nullif(regexp_replace(truth, '\\s+', '', 'g'), '') WHEN rule = 'text_contained' THEN {norm_words("truth")} ELSE {norm("truth")} END AS t_txt,
    (pv IS NULL OR json_type(pv) = 'NULL' OR (json_type(pv) <> 'OBJECT' AND coalesce(trim(raw) = '', false))) AS no_p, (truth IS NULL OR trim(truth) = '') AS no_t
  FROM forms),
matched AS MATERIALIZED (
  SELECT *, CASE WHEN no_p AND no_t THEN true WHEN no_p <> no_t THEN false
      WHEN rule = 'numeric' THEN coalesce(p_num = t_num, false)
      WHEN rule = 'address' THEN (p_adr IS NOT DISTINCT FROM t_adr OR p_alt IS NOT DISTINCT FROM t_adr)
      WHEN rule = 'text_contained' THEN coalesce(list_count(list_filter(string_split(t_txt, ' '), lambda w: list_contains(string_split(p_txt, ' '), w)))::DOUBLE / len(string_split(t_txt, ' ')) >= 0.9, false) AND p_txt IS NOT DISTINCT FROM t_txt
      ELSE p_txt IS NOT DISTINCT FROM t_txt END AS hit
  FROM plain),
verdicts AS MATERIALIZED (
  SELECT run_id, arm, doc_id, cluster_id, doc_type, source_dataset, no_tax, path, rule, truth, raw, p_num, t_num, p_txt, t_txt, p_adr, p_alt, t_adr, pv, hit,
    CASE WHEN coalesce(truth = '__ABSENT__', false) THEN CASE WHEN says THEN 'hallucination' ELSE 'correct_null' END
         WHEN hit THEN 'correct' WHEN NOT says OR (rule = 'numeric' AND p_num IS NULL AND p_src IS NOT NULL) THEN 'missing' ELSE 'wrong' END AS state,
    CASE WHEN rule = 'numeric' AND truth IS DISTINCT FROM '__ABSENT__' THEN p_src END AS value_source
  FROM matched)"""


VERDICTS = "WITH " + _verdict_sql()


def over_verdicts(query: str) -> str:
    return f"{VERDICTS}\n{query}"


def rate(num: str, den: str) -> str:
    return f"round(({num})::DOUBLE / nullif({den}, 0), 6)"


def n_in(*states: str) -> str:
    return "count_if(state IN (" + ", ".join(f"'{s}'" for s in states) + "))"


ACCURACY = rate(n_in("correct"), n_in("correct", "wrong", "missing"))
NULL_RATE = rate(n_in("correct_null"), n_in("correct_null", "hallucination"))
