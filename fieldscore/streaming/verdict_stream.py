"""Verdicts of results that arrive as files: the stateless scoring projection over a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscore.operators.current import current_rows
from fieldscore.operators.nested import arm_roots, read_json
from fieldscore.operators.verdicts import current_records, field_rows, score_fields
from fieldscore.options import ScoringOptions
from fieldscore.session import cut, scratch


def scored_batch(results: DataFrame, records: DataFrame, options: ScoringOptions = ScoringOptions()) -> DataFrame:
    """Verdicts of the ok rows of a batch, each with its row's own ``written_at`` and ``tie``; which row is current is told at reading."""
    arms = F.transform(arm_roots(read_json(F.col("arms"))), lambda r: F.struct(r["root"].alias("arm"), r["node"].alias("payload")))
    rows = results.filter("ok").withColumn("version", F.struct("written_at", "tie"))
    preds = rows.select(F.struct("run_id", "version").alias("run_id"), "doc_id", F.inline(arms)).filter(F.col("payload").isNotNull())
    v = score_fields(field_rows(preds, records), options)
    return v.select("run_id.run_id", "doc_id", "run_id.version.written_at", "run_id.version.tie", "arm", "path", "rule", "state")


def run_to_table(spark: SparkSession, path: str, gt_records: DataFrame, options: ScoringOptions = ScoringOptions()) -> DataFrame:
    """Scores every file under ``path`` once and returns the verdicts of current rows, equal to those over the whole table.

    Each micro-batch writes the verdicts of its rows, and which rows it has seen, ok or not; exactly-once comes from the
    stream's checkpoint and a folder per batch. At reading the current row of a key is chosen among all that were seen as
    `current_rows` does, and only its verdicts are kept, so a result that was replaced has none whatever batch it came in.
    """
    base = scratch(spark, "stream")
    schema = spark.read.parquet(path).schema
    records = cut(current_records(gt_records))

    def write(batch: DataFrame, number: int) -> None:
        keyed = batch.select("run_id", "doc_id", "ok", "arms", "written_at", F.xxhash64("arms").alias("tie"))
        current = current_rows(keyed, ["run_id", "doc_id"], "written_at", [F.col("tie")])  # within the batch
        current.select("run_id", "doc_id", "ok", "written_at", "tie").write.mode("overwrite").parquet(f"{base}/seen/batch={number}")
        scored_batch(current, records, options).write.mode("overwrite").parquet(f"{base}/verdicts/batch={number}")

    folder, _, name = path.rpartition("/")
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if not name.endswith(".parquet") else f"{folder}/{name}*")
    query = source.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    seen = current_rows(spark.read.parquet(f"{base}/seen"), ["run_id", "doc_id"], "written_at", [F.col("tie")]).filter("ok")
    chosen = seen.select("run_id", "doc_id", "written_at", "tie", "batch")
    v, c = spark.read.parquet(f"{base}/verdicts").alias("v"), chosen.alias("c")
    same = [F.col(f"v.{k}").eqNullSafe(F.col(f"c.{k}")) for k in ("run_id", "doc_id", "written_at", "tie", "batch")]
    return v.join(c, same, "left_semi").drop("batch", "tie", "written_at")
