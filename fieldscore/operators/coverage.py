"""Coverage of the ground truth: which fields are known how often, and which are fit for a headline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldscore.operators.compare import ABSENT
from fieldscore.operators.verdicts import current_records


def truth_fields(gt_records: DataFrame) -> DataFrame:
    """One row an annotated field of a current record: absent or with its value; what isn't annotated has no row."""
    r = current_records(gt_records).select("doc_id", "source_dataset", "doc_type", "cluster_id", "gt", F.explode("annotated_fields").alias("path"))
    value = F.try_element_at("gt", F.col("path"))
    return r.select("doc_id", "source_dataset", "doc_type", "cluster_id", "path", F.coalesce(value == ABSENT, F.lit(False)).alias("is_absent"), F.when(value != ABSENT, value).alias("value"))


def coverage(gt_records: DataFrame, least_docs: int = 30, least_values: int = 20, barred: dict[str, str] | None = None) -> DataFrame:
    """By dataset and path: documents, clusters, distinct values, absences, and whether the field may be in a headline."""
    agg = truth_fields(gt_records).groupBy("source_dataset", "path").agg(
        F.count("*").alias("n_docs"), F.count_distinct("cluster_id").alias("n_clusters"), F.count_distinct("value").alias("distinct_values"), F.count_if("is_absent").alias("absent_docs"),
    )
    reason = F.when(F.col("n_docs") < least_docs, "too few documents").when(F.col("distinct_values") <= 1, "constant").when(F.col("distinct_values") < least_values, "too few values")
    for path, why in (barred or {}).items():
        reason = F.when(F.col("path") == path, why).otherwise(reason)
    return agg.withColumn("bar_reason", reason).withColumn("headline_eligible", F.col("bar_reason").isNull())


def exclusion_histogram(gt_records: DataFrame) -> DataFrame:
    r = current_records(gt_records).select("source_dataset", F.explode("excluded_fields").alias("path", "why"))
    return r.groupBy("source_dataset", "path", F.substring("why", 1, 80).alias("reason")).agg(F.count("*").alias("n"))


def label_inventory(gt_records: DataFrame, label_path: str = "$.labels") -> DataFrame:
    """Labels of the current records' meta with their count and first document."""
    labels = F.from_json(F.get_json_object("meta", label_path), "array<string>")
    r = current_records(gt_records).select("source_dataset", "doc_id", F.explode(labels).alias("label"))
    return r.groupBy("source_dataset", "label").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def keyset_ids(gt_records: DataFrame, label_path: str = "$.labels") -> DataFrame:
    """The identity of each record's set of labels: ten digits of a digest of the sorted labels."""
    labels = F.array_sort(F.array_distinct(F.from_json(F.get_json_object("meta", label_path), "array<string>")))
    return current_records(gt_records).select("doc_id", F.substring(F.sha1(F.array_join(labels, "|")), 1, 10).alias("keyset"))


def record_faults(gt_records: DataFrame) -> DataFrame:
    """Records that break an invariant: truths that aren't annotated, fields annotated and excluded, no cluster."""
    r = current_records(gt_records)
    faults = F.array_compact(F.array(
        F.when(F.size(F.array_except(F.map_keys("gt"), "annotated_fields")) > 0, F.lit("truth not annotated")),
        F.when(F.size(F.array_intersect("annotated_fields", F.map_keys("excluded_fields"))) > 0, F.lit("annotated and excluded")),
        F.when(F.coalesce(F.trim("cluster_id"), F.lit("")) == "", F.lit("no cluster")),
        F.when(F.col("image_path").startswith("/"), F.lit("absolute image path")),
    ))
    return r.select("doc_id", F.explode(faults).alias("fault"))
