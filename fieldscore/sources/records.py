"""Readers and writers: ground-truth records, run files, leaf inventories, Parquet trees, sampling plans."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "doc_id string, source_dataset string, doc_type string, image_path string, cluster_id string, keyset_id string, gt map<string,string>, annotated_fields array<string>, excluded_fields map<string,string>, meta string"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth from JSON lines: one record a line; list values are kept as their JSON text."""
    return spark.read.schema(RECORD).json(path)


def write_records(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Ground truth as JSON lines with sorted fields; an existing folder isn't overwritten unless asked to."""
    cols = [c.split()[0] for c in RECORD.split(", ") if c.split()[0] in df.columns]
    df.select(*[F.array_sort(c).alias(c) if c == "annotated_fields" else F.col(c) for c in cols]).write.mode(mode).json(path)


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """(run_id, doc_id, result): a run's files ``<run>/raw/<doc>.json``, each read whole as a variant."""
    f = spark.read.text(f"{folder}/*/raw/*.json", wholetext=True)
    name = F.input_file_name()
    return f.select(F.regexp_extract(name, r"([^/]+)/raw/[^/]+$", 1).alias("run_id"), F.regexp_extract(name, r"([^/]+)\.json$", 1).alias("doc_id"), F.try_parse_json("value").alias("result"))


def run_arms(runs: DataFrame, records: DataFrame) -> DataFrame:
    """(run_id, doc_id, arm, payload) of run files that are ok and whose document has a record; arms named ``_...`` and arms that
    are no objects don't count."""
    ok = runs.filter(F.try_variant_get("result", "$.ok", "boolean")).join(records.select("doc_id").distinct(), "doc_id", "left_semi")
    arms = ok.select("run_id", "doc_id", F.explode(F.try_variant_get("result", "$.arms", "map<string,variant>")).alias("arm", "payload"))
    return arms.filter(~F.col("arm").startswith("_") & F.schema_of_variant("payload").startswith("OBJECT"))


def read_leaf_paths(spark: SparkSession, path: str) -> dict[str, str]:
    """path -> type from a tab-separated inventory; comments and blank lines don't count."""
    rows = spark.read.text(path, wholetext=True).first()
    lines = [x for x in (rows[0] if rows else "").splitlines() if x.strip() and not x.startswith("#")]
    return dict(x.split("\t", 1) for x in lines)


def read_parquet_tree(spark: SparkSession, folder: str) -> DataFrame:
    """All Parquet files below a folder with the split that their name or folder tells."""
    return spark.read.option("recursiveFileLookup", True).parquet(folder).withColumn("split", split_name(F.regexp_extract(F.input_file_name(), r"(train|test|dev|valid(?:ation)?|val)", 1)))


def split_name(c: Column) -> Column:
    """validation, valid and val are dev."""
    s = F.lower(F.trim(c))
    return F.when(s.isin("validation", "valid", "val"), "dev").otherwise(s)


def image_kind(content: Column) -> Column:
    """png, jpg, gif, bmp or tif by the first bytes of a binary column."""
    h = F.hex(F.substring(content, 1, 8))
    return F.when(h.startswith("89504E47"), "png").when(h.startswith("FFD8FF"), "jpg").when(h.startswith("47494638"), "gif").when(h.startswith("424D"), "bmp").when(h.startswith("49492A00") | h.startswith("4D4D002A"), "tif")


def regrouped_lines(lines: DataFrame) -> DataFrame:
    """Word-level lines (doc_id, group_id, sub_group_id, category, words, and pos, their place on the page, if there is one) to
    printed rows: the words that aren't a key, in page order, joined by spaces, as one map of category -> text a group."""
    words = F.array_join(F.transform(F.filter("words", lambda w: ~F.coalesce(w["is_key"].cast("boolean"), F.lit(False))), lambda w: w["text"]), " ")
    at = F.col("pos") if "pos" in lines.columns else F.monotonically_increasing_id()
    cells = lines.select("doc_id", "group_id", "sub_group_id", "category", at.alias("pos"), words.alias("text")).filter("text <> ''")
    by = cells.groupBy("doc_id", "group_id", "sub_group_id", "category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("text"))
    return by.groupBy("doc_id", "group_id", "sub_group_id").agg(F.map_from_entries(F.collect_list(F.struct("category", "text"))).alias("row"))


def ids_digest(ids: DataFrame, column: str = "doc_id") -> str:
    """A digest of a set of ids, whatever their order and number: the sum and the exclusive or of each one's own digest."""
    own = F.conv(F.substring(F.sha2(column, 256), 1, 15), 16, 10).cast("bigint")
    r = ids.select(column).filter(F.col(column).isNotNull()).distinct().agg(F.count("*"), F.sum(own.cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit("ids"), column))).first()
    return hashlib.sha256(f"{r[0]}:{r[1]}:{r[2]}".encode()).hexdigest()


def write_plan(spark: SparkSession, ids: DataFrame, path: str, header: dict[str, str]) -> None:
    """A sampling plan with its provenance; an existing one is refused."""
    plan = ids.select("doc_id").withColumns({k: F.lit(v) for k, v in header.items()}).withColumn("ids_sha256", F.lit(ids_digest(ids)))
    plan.write.mode("errorifexists").json(path)


def read_annotations(spark: SparkSession, pattern: str, split: bool = False) -> DataFrame:
    """(doc_id, annotation) of annotation files (``.../*.json``), each read whole; the id is the file's stem, with ``split`` the
    split's folder before it: ``<split>-<stem>`` of ``<split>/annotations/<stem>.json``."""
    f = spark.read.text(pattern, wholetext=True)
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    of = split_name(F.regexp_extract(F.input_file_name(), r"([^/]+)/annotations/[^/]+$", 1))
    return f.select((F.concat_ws("-", of, stem) if split else stem).alias("doc_id"), F.col("value").alias("annotation"))


def read_field_map(spark: SparkSession, path: str) -> DataFrame:
    """(label, status, path, parser) of a reviewed field map in YAML; needs the yaml package. A label without targets has one row."""
    import yaml

    whole = spark.read.text(path, wholetext=True).first()
    rows = []
    for r in (yaml.safe_load(whole[0]) or {}).get("labels", []) if whole else []:
        for label in r.get("labels") or [r.get("label") or r.get("label_regex")]:
            for t in r.get("targets") or [{}]:
                rows.append((label, r.get("status"), t.get("path"), t.get("parser")))
    return spark.createDataFrame(rows, "label string, status string, path string, parser string")


def image_bytes(value: Column) -> Column:
    """The bytes of an image given as bytes in base64, at times with a data prefix; null where it is none."""
    plain = F.regexp_replace(F.regexp_replace(value, r"^data:[^,]*,", ""), r"\s+", "")
    return F.when(plain.rlike(r"^[A-Za-z0-9+/]+={0,2}$") & (F.length(plain) % 4 == 0), F.unbase64(plain))


def materialise(docs: DataFrame, path: str, key: str = "doc_id", expected: int | None = None) -> int:
    """Writes documents as JSON lines and returns how many; repeated ids are an error before anything is written, and so is
    a number that isn't the expected one. An existing folder is refused."""
    if twice := docs.groupBy(key).count().filter("count > 1").limit(3).collect():
        raise ValueError(f"repeated ids {[r[0] for r in twice]}")
    n = docs.count()
    if expected is not None and n != expected:
        raise ValueError(f"{n} documents, not {expected}")
    docs.write.mode("errorifexists").json(path)
    return n
