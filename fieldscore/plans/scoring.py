"""Queries over verdict rows of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscore.operators import metrics as M
from fieldscore.operators.verdicts import verdicts
from fieldscore.options import ScoringOptions
from fieldscore.plans import sql_parts as S
from fieldscore.session import cut, table


def _v(spark: SparkSession, d: str, options: ScoringOptions = ScoringOptions()) -> DataFrame:
    return verdicts(table(spark, d, "gt_records"), table(spark, d, "doc_results"), options)


def _narrow(spark: SparkSession, d: str) -> DataFrame:
    """The few columns that rates need, written once for queries that read them several times."""
    return cut(_v(spark, d).select("arm", "path", "doc_id", "cluster_id", "no_tax", "state", "exact", "ok_convention"))


def flagship_field_accuracy(spark, d):  # noqa: ANN001, ANN201
    """Accuracy of every field in every arm."""
    return M.per_field(_v(spark, d)).select("arm", "path", "n_docs", "n_clusters", *[f"n_{s}" for s in M.STATES], "accuracy", "correct_null_rate")


def verdict_states(spark, d):  # noqa: ANN001, ANN201
    return _v(spark, d).groupBy("arm", "path", "rule", "state").agg(F.count("*").alias("n"))


def verdict_rows(spark, d):  # noqa: ANN001, ANN201
    return _v(spark, d).select("run_id", "arm", "doc_id", "path", "rule", "state", "ok", "value_source")


def hallucination_counts(spark, d):  # noqa: ANN001, ANN201
    return _v(spark, d).filter("state = 'hallucination'").groupBy("path").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def correct_null_rate(spark, d):  # noqa: ANN001, ANN201
    return _v(spark, d).groupBy("arm").agg(M.rate(M.n_in("correct_null"), M.n_in("correct_null", "hallucination")).alias("correct_null_rate"), M.n_in("correct_null").alias("n"))


def macro_micro(spark, d):  # noqa: ANN001, ANN201
    return M.summary(_narrow(spark, d)).select("arm", "n_instances", "n_docs", "micro_accuracy", "macro_accuracy", "n_fields", "hallucinations")


def headline_accuracy(spark, d):  # noqa: ANN001, ANN201
    """Micro accuracy over the fields that are eligible by coverage."""
    from fieldscore.operators.coverage import coverage

    eligible = coverage(table(spark, d, "gt_records"), least_docs=30, least_values=20).filter("headline_eligible").select("path").distinct()
    return M.summary(_narrow(spark, d), eligible).select("arm", "headline_accuracy")


def stage_lift(spark, d):  # noqa: ANN001, ANN201
    v = cut(_v(spark, d).select("run_id", "doc_id", "path", "arm", "ok"))
    return M.stage_lift(v, "RAW", "RAW_POSTPROCESSED").unionByName(M.stage_lift(v, "RAW_POSTPROCESSED", "FINAL")).unionByName(M.stage_lift(v, "RAW", "FINAL"))


def judge_confusion(spark, d):  # noqa: ANN001, ANN201
    return M.detector_matrix(M.with_flag(_v(spark, d), M.judge_flags(table(spark, d, "doc_results"))), "RAW", "FINAL")


def arm_denominators(spark, d):  # noqa: ANN001, ANN201
    return M.arm_denominators(_v(spark, d))


def no_tax_slice(spark, d):  # noqa: ANN001, ANN201
    return M.no_tax_slice(_narrow(spark, d))


def cluster_sufficient_stats(spark, d):  # noqa: ANN001, ANN201
    return M.cluster_counts(_v(spark, d))


def cluster_bootstrap_ci(spark, d):  # noqa: ANN001, ANN201
    return M.bootstrap_intervals(_v(spark, d))


def score_by_run(spark, d):  # noqa: ANN001, ANN201
    return _v(spark, d).groupBy("run_id", "arm").agg(F.count("*").alias("n"), M.accuracy().alias("accuracy"))


def text_scores(spark, d):  # noqa: ANN001, ANN201
    """Similarity scores of all printed names and addresses. SQL engines count bytes or normalise otherwise, so there is no twin."""
    v = _v(spark, d).filter(F.col("rule").isin("text", "address") & (F.col("truth") != "__ABSENT__"))
    return v.select("run_id", "arm", "doc_id", "path", F.round("score", 6).alias("score"))


def review_pivot(spark, d):  # noqa: ANN001, ANN201
    """One row a field of a document with the arms' verdicts side by side and the transitions."""
    from fieldscore.operators.views import field_review

    return field_review(_v(spark, d)).select("run_id", "doc_id", "path", "truth", "raw_state", "raw_pp_state", "final_state", "raw_to_pp", "pp_to_final")


def review_by_file(spark, d):  # noqa: ANN001, ANN201
    from fieldscore.operators.views import rollup

    return rollup(_v(spark, d), ["run_id", "doc_id"])


def review_by_field(spark, d):  # noqa: ANN001, ANN201
    from fieldscore.operators.views import rollup

    return rollup(_v(spark, d), ["path"])


def strict_ladder(spark, d):  # noqa: ANN001, ANN201
    """Accuracy under the three strictest comparators, those that its SQL has; `strict_ladder_levels` has all five."""
    from fieldscore.operators.ladder import strict_ladder as ladder

    return ladder(_v(spark, d), ("L0", "L1", "L2"))


def strict_ladder_levels(spark, d):  # noqa: ANN001, ANN201
    """Accuracy under five comparators of falling strictness."""
    from fieldscore.operators.ladder import strict_ladder as ladder

    return ladder(_v(spark, d))


def strict_gaps(spark, d):  # noqa: ANN001, ANN201
    """Why fields that pass differ from the truth as printed."""
    from fieldscore.operators.ladder import gap_causes

    return gap_causes(_v(spark, d))


def comparison_forms(spark, d):  # noqa: ANN001, ANN201
    """Rows whose shown forms contradict the verdict: none."""
    v = _v(spark, d).filter("not absent and p_form is not null and t_form is not null")
    return v.filter((F.col("p_form").eqNullSafe(F.col("t_form")) | F.col("p_form_alt").eqNullSafe(F.col("t_form"))) != F.col("exact")).select("run_id", "arm", "doc_id", "path")


QUERIES = {f.__name__: f for f in (
    flagship_field_accuracy, verdict_states, verdict_rows, hallucination_counts, correct_null_rate, macro_micro, headline_accuracy, stage_lift, judge_confusion, arm_denominators, no_tax_slice,
    cluster_sufficient_stats, cluster_bootstrap_ci, score_by_run, text_scores, review_pivot, review_by_file, review_by_field, strict_ladder, strict_ladder_levels, strict_gaps, comparison_forms,
)}

_OK = "state IN ('correct', 'correct_null')"


ORACLES = {
    "flagship_field_accuracy": S.over_verdicts(f"""SELECT arm, path, count(*) AS n_docs, count(DISTINCT cluster_id) AS n_clusters, {", ".join(f"{S.n_in(s)} AS n_{s}" for s in M.STATES)}, {S.ACCURACY} AS accuracy, {S.NULL_RATE} AS correct_null_rate
      FROM verdicts GROUP BY arm, path"""),
    "verdict_states": S.over_verdicts("SELECT arm, path, rule, state, count(*) AS n FROM verdicts GROUP BY ALL"),
    "verdict_rows": S.over_verdicts(f"SELECT run_id, arm, doc_id, path, rule, state, {_OK} AS ok, value_source FROM verdicts"),
    "hallucination_counts": S.over_verdicts("SELECT path, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM verdicts WHERE state = 'hallucination' GROUP BY path"),
    "correct_null_rate": S.over_verdicts(f"SELECT arm, {S.NULL_RATE} AS correct_null_rate, {S.n_in('correct_null')} AS n FROM verdicts GROUP BY arm"),
    "macro_micro": S.over_verdicts(f"""SELECT arm, n_instances, n_docs, micro_accuracy, macro_accuracy, n_fields, hallucinations FROM
      (SELECT arm, count(*) AS n_instances, count(DISTINCT doc_id) AS n_docs, {S.ACCURACY} AS micro_accuracy, {S.n_in('hallucination')} AS hallucinations FROM verdicts GROUP BY arm)
      JOIN (SELECT arm, round(avg(a) + 1e-12, 6) AS macro_accuracy, count(*) AS n_fields FROM (SELECT arm, path, {S.ACCURACY} AS a FROM verdicts GROUP BY arm, path) GROUP BY arm) USING (arm)"""),
    "headline_accuracy": S.over_verdicts(f"""SELECT arm, headline_accuracy FROM (SELECT DISTINCT arm FROM verdicts) LEFT JOIN (SELECT arm, {S.ACCURACY} AS headline_accuracy FROM verdicts WHERE path IN (
      SELECT path FROM (SELECT source_dataset, u.path, count(*) AS n, count(DISTINCT CASE WHEN r.gt[u.path] <> '__ABSENT__' THEN r.gt[u.path] END) AS k FROM rec r, unnest(r.annotated_fields) u(path) GROUP BY ALL) WHERE n >= 30 AND k >= 20) GROUP BY arm) USING (arm)"""),
    "stage_lift": S.over_verdicts(" UNION ALL ".join(
        f"""SELECT '{b}' AS before, '{a}' AS after, count(*) AS n_compared, count_if(NOT b AND a) AS fixed, count_if(b AND NOT a) AS harmed, count_if(NOT b AND a) - count_if(b AND NOT a) AS net,
        round(count_if(b AND NOT a) / greatest(count_if(b), 1)::DOUBLE, 6) AS harm_rate
        FROM (SELECT x.state IN ('correct', 'correct_null') AS b, y.state IN ('correct', 'correct_null') AS a FROM verdicts x JOIN verdicts y USING (run_id, doc_id, path) WHERE x.arm = '{b}' AND y.arm = '{a}')"""
        for b, a in (("RAW", "RAW_POSTPROCESSED"), ("RAW_POSTPROCESSED", "FINAL"), ("RAW", "FINAL")))),
    "judge_confusion": S.VERDICTS + f""",
      report AS MATERIALIZED (SELECT run_id, doc_id, CASE WHEN json_valid(judge) THEN CASE WHEN starts_with(ltrim(judge), '"') THEN try_cast((judge::JSON->>'$') AS JSON) ELSE judge::JSON END END AS j FROM cur),
      section AS MATERIALIZED (SELECT run_id, doc_id, json_extract(j, '$.issues."' || k || '"') AS s FROM report, unnest(json_keys(j, '$.issues')) t(k) WHERE json_type(j, '$.issues') = 'OBJECT'),
      flags AS MATERIALIZED (SELECT DISTINCT run_id, doc_id, e->>'field' AS field FROM section, unnest(CASE WHEN json_type(s) = 'OBJECT' THEN [s] WHEN json_type(s) = 'ARRAY' THEN CAST(s AS JSON[]) ELSE [] END) t(e)),
      d AS (SELECT x.run_id, x.doc_id, x.path, x.{_OK} AS ok FROM verdicts x WHERE x.arm = 'RAW' AND EXISTS (SELECT 1 FROM verdicts y WHERE y.arm = 'FINAL' AND y.run_id = x.run_id AND y.doc_id = x.doc_id AND y.path = x.path)),
      m AS (SELECT d.ok, EXISTS (SELECT 1 FROM flags f WHERE f.run_id = d.run_id AND f.doc_id = d.doc_id AND f.field <> '' AND contains(f.field, regexp_extract(d.path, '[^.]*$'))) AS f FROM d),
      c AS (SELECT count_if(f AND NOT ok) AS tp, count_if(f AND ok) AS fp, count_if(NOT f AND NOT ok) AS fn, count_if(NOT f AND ok) AS tn FROM m)
      SELECT tp, fp, fn, tn, {S.rate('tp', 'tp + fp')} AS precision, {S.rate('tp', 'tp + fn')} AS recall, {S.rate('2 * tp', '2 * tp + fp + fn')} AS f1 FROM c""",
    "arm_denominators": S.over_verdicts("SELECT run_id, arm, count(DISTINCT doc_id) AS n_docs FROM verdicts GROUP BY ALL"),
    "no_tax_slice": S.over_verdicts(f"""SELECT arm, all_accuracy, n_all, n_no_tax, taxed_accuracy, n_taxed FROM (SELECT arm, {S.ACCURACY} AS all_accuracy, count(*) AS n_all, count_if(no_tax) AS n_no_tax FROM verdicts GROUP BY arm)
      LEFT JOIN (SELECT arm, {S.ACCURACY} AS taxed_accuracy, count(*) AS n_taxed FROM verdicts WHERE NOT no_tax GROUP BY arm) USING (arm)"""),
    "cluster_sufficient_stats": S.over_verdicts(f"SELECT arm, path, cluster_id, {S.n_in('correct')} AS num, {S.n_in('correct', 'wrong', 'missing')} AS den FROM verdicts GROUP BY ALL"),
    "score_by_run": S.over_verdicts(f"SELECT run_id, arm, count(*) AS n, {S.ACCURACY} AS accuracy FROM verdicts GROUP BY ALL"),
    "review_pivot": S.over_verdicts("""SELECT run_id, doc_id, path, truth, max(state) FILTER (arm = 'RAW') AS raw_state, max(state) FILTER (arm = 'RAW_POSTPROCESSED') AS raw_pp_state, max(state) FILTER (arm = 'FINAL') AS final_state,
      CASE WHEN bool_or(state IN ('correct', 'correct_null')) FILTER (arm = 'RAW') = false AND bool_or(state IN ('correct', 'correct_null')) FILTER (arm = 'RAW_POSTPROCESSED') THEN 'FIXED'
           WHEN bool_or(state IN ('correct', 'correct_null')) FILTER (arm = 'RAW') AND bool_or(state IN ('correct', 'correct_null')) FILTER (arm = 'RAW_POSTPROCESSED') = false THEN 'HARMED' ELSE '' END AS raw_to_pp,
      CASE WHEN bool_or(state IN ('correct', 'correct_null')) FILTER (arm = 'RAW_POSTPROCESSED') = false AND bool_or(state IN ('correct', 'correct_null')) FILTER (arm = 'FINAL') THEN 'FIXED'
           WHEN bool_or(state IN ('correct', 'correct_null')) FILTER (arm = 'RAW_POSTPROCESSED') AND bool_or(state IN ('correct', 'correct_null')) FILTER (arm = 'FINAL') = false THEN 'HARMED' ELSE '' END AS pp_to_final
      FROM verdicts GROUP BY run_id, doc_id, path, truth"""),
    "strict_ladder": S.over_verdicts(f"""SELECT arm, level, count(*) AS n, count_if(ok) AS n_ok, {S.rate('count_if(ok)', 'count(*)')} AS accuracy FROM (
      SELECT arm, unnest(['L0', 'L1', 'L2']) AS level, unnest([coalesce(w = truth, false), coalesce({S.norm('w')} = {S.norm('truth')}, false), coalesce({S.norm('w')} = {S.norm('truth')}, false) OR (rule = 'numeric' AND coalesce({S.money('w')} = {S.money('truth')}, false))]) AS ok
      FROM (SELECT *, CASE WHEN json_type(pv) = 'OBJECT' THEN coalesce(CASE WHEN json_type((pv->'originalValue')) = 'DOUBLE' THEN CAST(CAST((pv->'originalValue') AS DOUBLE) AS VARCHAR) ELSE (pv->'originalValue')->>'$' END, CASE WHEN json_type((pv->'normalizedValue')) = 'DOUBLE' THEN CAST(CAST((pv->'normalizedValue') AS DOUBLE) AS VARCHAR) ELSE (pv->'normalizedValue')->>'$' END) WHEN json_type(pv) <> 'NULL' THEN CASE WHEN json_type(pv) = 'DOUBLE' THEN CAST(CAST(pv AS DOUBLE) AS VARCHAR) ELSE pv->>'$' END END AS w FROM verdicts WHERE rule <> 'address' AND truth <> '__ABSENT__')) GROUP BY ALL"""),
    "comparison_forms": "SELECT '' AS run_id, '' AS arm, '' AS doc_id, '' AS path WHERE false",
}
for _name, _keys in (("review_by_file", "run_id, doc_id"), ("review_by_field", "path")):
    ORACLES[_name] = S.over_verdicts(f"""SELECT {_keys}, count_if({_OK}) AS n_match, count_if(NOT ({_OK})) AS n_mismatch, {S.rate(f'count_if({_OK})', 'count(*)')} AS match_rate FROM verdicts WHERE arm = 'FINAL' GROUP BY {_keys}""")
