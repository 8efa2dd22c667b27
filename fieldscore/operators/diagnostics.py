"""Diagnostics of predictions: defects on the wire, stage traces, censuses, probes against what is printed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscore.functions.text import normal
from fieldscore.operators.diff import PayloadForm, json_leaves
from fieldscore.operators.metrics import rate

_BARE = PayloadForm(wrappers=(), sections=(), hidden="\0", opened=False)


def _leaves(df: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """(keys, leaf_path, leaf) of payloads given as JSON text, whatever they hold."""
    return df.select(*keys, F.inline(json_leaves(F.concat(F.lit('{"p":'), F.col(payload), F.lit("}")), _BARE))).withColumn("leaf_path", F.substring("leaf_path", 3, 1 << 20))


def wire_defects(payloads: DataFrame, keys: list[str], payload: str = "payload_json") -> DataFrame:
    """(arm, n_docs, n_list_leaked, n_two_taxes, n_disagree) over payloads with ``arm`` among ``keys``: a list printed into a
    string, two amounts in the single tax amount, and printed numbers that differ from their normalised ones."""
    leaves = _leaves(payloads, keys, payload)
    printed = F.when(F.col("leaf").startswith("s"), F.substring("leaf", 2, 1 << 20))
    by_field = leaves.withColumn("s", printed).withColumn("part", F.substring_index("leaf_path", ".", -1)).withColumn("field", F.expr("regexp_replace(leaf_path, '[.](originalValue|normalizedValue)$', '')"))
    amount = lambda c: F.regexp_replace(c, r"[^\d.]", "").try_cast("double")
    f = by_field.groupBy(*keys, "field").agg(
        F.max(F.col("s").rlike(r"^\s*\[")).alias("leaked"), F.max(F.when(F.col("field").rlike(r"totals\.taxAmount$"), F.col("s").rlike(r"\d[,;]\s*\d+\.\d"))).alias("two"),
        F.max(F.when(F.col("part") == "originalValue", amount(F.col("s")))).alias("o"), F.max(F.when((F.col("part") == "normalizedValue") & F.col("leaf").startswith("n"), F.abs(F.substring("leaf", 2, 1 << 20).try_cast("double")))).alias("n"),
    )
    return f.groupBy("arm").agg(F.count_distinct(*[k for k in keys if k != "arm"]).alias("n_docs"), F.count_if("leaked").alias("n_list_leaked"), F.count_if("two").alias("n_two_taxes"), F.count_if(F.abs(F.col("o") - F.col("n")) > 0.005).alias("n_disagree"))


def numeric_census(payloads: DataFrame, keys: list[str], payload: str = "payload_json") -> DataFrame:
    """(arm, n_numeric, n_normalised, share): numeric objects, and how many carry a normalised value that isn't null."""
    leaves = _leaves(payloads, keys, payload).filter(F.col("leaf_path").rlike(r"\.(originalValue|normalizedValue)$"))
    f = leaves.groupBy(*keys, F.expr("regexp_replace(leaf_path, '[.][a-zA-Z]+$', '')").alias("field")).agg(F.max(F.col("leaf_path").endswith(".normalizedValue") & (F.col("leaf") != "lnull")).alias("normalised"))
    return f.groupBy("arm").agg(F.count("*").alias("n_numeric"), F.count_if("normalised").alias("n_normalised"), rate(F.count_if("normalised"), F.count("*")).alias("share"))


def stage_trace(printed: DataFrame, dumps: DataFrame, skip: str = "reasoning") -> DataFrame:
    """(doc_id, stage, n_printed, n_seen): how many of a document's printed amounts (doc_id, amounts) each stage's dump
    (doc_id, stage, data) still holds, outside whatever stands under a key named ``skip``."""
    leaves = _leaves(dumps.filter("data is not null"), ["doc_id", "stage"], "data").filter(~F.col("leaf_path").rlike(rf"(^|\.){skip}(\.|\[|$)"))
    text = F.substring("leaf", 2, 1 << 20)
    found = F.when(F.col("leaf").startswith("n"), F.array(F.format_string("%.2f", text.cast("double")))).otherwise(F.regexp_extract_all(text, F.lit(r"(\d+\.\d{2})\b"), F.lit(1)))
    seen = leaves.groupBy("doc_id", "stage").agg(F.array_distinct(F.flatten(F.collect_set(found))).alias("seen"))  # what one dump holds
    return printed.join(seen, "doc_id").select("doc_id", "stage", F.size(F.array_distinct("amounts")).alias("n_printed"), F.size(F.array_intersect("amounts", "seen")).alias("n_seen"))


def defect_label(states: dict[str, Column]) -> Column:
    """Why a printed line fails in the last arm, by its states in the arms in order: the first arm that tells."""
    raw, processed, final = states["RAW"], states.get("RAW_POSTPROCESSED", states["RAW"]), states["FINAL"]
    ok = "correct"
    return (
        F.when(final == ok, None)
        .when((raw == ok) & (processed != ok), "lost in postprocessing")
        .when(processed == ok, "lost by the judge")
        .when(raw == "not_emitted", F.when(final == "not_emitted", "never emitted").otherwise("emitted late, wrong"))
        .otherwise(F.concat(F.lit("wrong from the start: "), raw))
    )


def verbatim_probe(fields: DataFrame) -> DataFrame:
    """(arm, path, n, hit_printed, hit_stored): how often what was predicted (wire) is the printed span (printed), and how often
    it is the stored truth, both as normalised text."""
    hit = lambda c: F.count_if(F.coalesce(normal(F.col("wire")) == normal(F.col(c)), F.lit(False)))
    return fields.groupBy("arm", "path").agg(F.count("*").alias("n"), rate(hit("printed"), F.count("*")).alias("hit_printed"), rate(hit("truth"), F.count("*")).alias("hit_stored"))


def not_contained(fields: DataFrame, value: str = "truth", within: str = "page_text") -> DataFrame:
    """Rows whose value doesn't stand in the page's text, as normalised text; rows without either are left out."""
    return fields.filter(F.col(value).isNotNull() & F.col(within).isNotNull() & ~F.coalesce(F.contains(normal(F.col(within)), normal(F.col(value))), F.lit(False)))
