"""Verdict rows: what each arm of each result says of each annotated field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscore.operators.compare import ABSENT, emitted, with_forms, with_match
from fieldscore.operators.current import current_rows
from fieldscore.operators.nested import arm_roots, read_json
from fieldscore.operators.rules import DOC_TYPES, rule_registry
from fieldscore.options import ScoringOptions


def current_records(gt_records: DataFrame) -> DataFrame:
    """The last delivery of each record; a record delivered again counts once."""
    return current_rows(gt_records, ["doc_id"], "received_at")


def predictions(doc_results: DataFrame) -> DataFrame:
    """(run_id, doc_id, arm, payload) of the current ok results; one row an arm."""
    cur = current_rows(doc_results.select("run_id", "doc_id", "ok", "arms", "written_at"), ["run_id", "doc_id"], "written_at", [F.xxhash64("arms")]).filter("ok")
    arms = F.transform(arm_roots(read_json(F.col("arms"))), lambda r: F.struct(r["root"].alias("arm"), r["node"].alias("payload")))
    return cur.select("run_id", "doc_id", F.inline(arms)).filter(F.col("payload").isNotNull())


def _fields(payload: str, doc_type: str) -> Column:
    """array<struct<path, rule, pred>> of all scoreable paths of the row's document type, as one parsed expression."""

    def value(name: str, path: str) -> str:
        sources = DOC_TYPES[name].merged_targets.get(path)
        if not sources:
            return f"try_variant_get({payload}, '$.{path}', 'variant')"
        said = ", ".join(f"nullif(trim(try_variant_get({payload}, '$.{s}', 'string')), '')" for s in sources)
        return f"cast(nullif(concat_ws(' ', {said}), '') as variant)"  # what the sources say, joined

    def of(name: str) -> str:
        rules = {p: r for p, r in rule_registry(DOC_TYPES[name]).items() if "[]" not in p}
        return "array(" + ", ".join(f"named_struct('path', '{p}', 'rule', '{r}', 'pred', {value(name, p)})" for p, r in sorted(rules.items())) + ")"

    return F.expr("CASE " + " ".join(f"WHEN {doc_type} = '{n}' THEN {of(n)}" for n in DOC_TYPES) + " END")


def field_rows(preds: DataFrame, records: DataFrame) -> DataFrame:
    """Predictions joined with the record of their document, one row an annotated path with a rule.

    One shuffle: payloads meet records by doc_id; the fields come out of the row, never through a join.
    """
    r = records.select("doc_id", "cluster_id", "doc_type", "source_dataset", "gt", "annotated_fields", F.coalesce(F.get_json_object("meta", "$.no_tax_label") == "true", F.lit(False)).alias("no_tax"))
    joined = preds.join(r, "doc_id")
    rows = joined.withColumn("f", F.explode(_fields("payload", "doc_type"))).filter(F.array_contains("annotated_fields", F.col("f.path")))
    return rows.select("run_id", "arm", "doc_id", "cluster_id", "doc_type", "source_dataset", "no_tax", "f.path", "f.rule", "f.pred", F.try_element_at("gt", F.col("f.path")).alias("truth"))


def score_fields(rows: DataFrame, options: ScoringOptions = ScoringOptions()) -> DataFrame:
    """Adds the verdict to field rows: state, ok, score, exact, ok_convention and the forms that were compared."""
    if options.ignore_fields:
        rows = rows.filter(~F.col("path").isin(*options.ignore_fields))
    df = with_match(with_forms(rows, options), options)
    df = df.withColumn("absent", F.coalesce(F.col("truth") == ABSENT, F.lit(False)))
    says = emitted(F.col("pred"))  # only looked at where the truth is absent or the values differ
    state = (
        F.when(F.col("absent"), F.when(says, "hallucination").otherwise("correct_null"))
        .when(F.col("matched"), "correct")
        .when(F.col("shipped_null") | ~says, "missing")
        .otherwise("wrong")
    )
    df = df.withColumn("state", state).withColumn("ok", F.col("state").isin("correct", "correct_null"))
    own = lambda c: F.when(F.col("absent"), F.col("ok")).otherwise(F.col(c))
    return df.withColumns({"score": F.when(F.col("absent"), F.col("ok").cast("double")).otherwise(F.col("score")), "exact": own("exact"), "ok_convention": own("convention"), "value_source": F.when(~F.col("absent"), F.col("value_source"))}).drop("matched", "convention", "shipped_null")


def verdicts(gt_records: DataFrame, doc_results: DataFrame, options: ScoringOptions = ScoringOptions()) -> DataFrame:
    """The central fact table, one row per (run, arm, document, path)."""
    return score_fields(field_rows(predictions(doc_results), current_records(gt_records)), options)
