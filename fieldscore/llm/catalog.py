"""Queries of the training-data operators over the test tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscore.llm.addresses import same_addresses
from fieldscore.llm.groups import linked_groups, split_groups
from fieldscore.llm.leaks import leaked_items
from fieldscore.llm.packing import pack_windows
from fieldscore.llm.pii import pii_values, redacted
from fieldscore.llm.stable_sample import NumberStore, seed_array, stable_sample
from fieldscore.session import checkpoint_dir, cut, table


def _store(spark: SparkSession, d: str, name: str) -> NumberStore:
    """The store of one set of tables in the shared folder: a later call finds what an earlier one has seen."""
    return NumberStore(spark, f"{checkpoint_dir(spark).rstrip('/')}/numbers-{name}-{hashlib.md5(d.encode()).hexdigest()}")


def p2_stable_sample(spark: SparkSession, d: str) -> DataFrame:
    """The documents drawn by each plan over documents; each is seen with its first delivery, all in one pass."""
    store = _store(spark, d, "documents")
    plans = table(spark, d, "plans").filter("dataset = 'documents'").select("plan_name", "seed", "share")
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.coalesce("batch_no", F.lit(1)).alias("batch"))
    store.see(docs.select("id", "batch", F.explode(seed_array(plans)).alias("seed")), "batch")
    store.keep(plans)
    drawn = stable_sample(store, plans).join(docs.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    return drawn.select("plan_name", F.col("doc_id").cast("bigint").alias("doc_id"), F.round("u", 9).alias("u"))


def p2_record_sample(spark: SparkSession, d: str) -> DataFrame:
    """The records drawn by each plan over records; repeated rows of a record fare alike."""
    store = _store(spark, d, "records")
    plans = table(spark, d, "plans").filter("dataset is null or dataset <> 'documents'")
    records = table(spark, d, "gt_records").select(F.col("doc_id").alias("id"), "source_dataset")
    store.see(records.select("id", F.explode(seed_array(plans)).alias("seed")), 1)
    store.keep(plans)
    drawn = stable_sample(store, plans.select("plan_name", "seed", "share"))
    of = plans.select("plan_name", F.col("dataset").alias("__of"))
    rows = records.withColumnRenamed("id", "doc_id").join(drawn, "doc_id").join(F.broadcast(of), "plan_name")
    return rows.filter("__of is null or __of = source_dataset").groupBy("plan_name", "doc_id").agg(F.count("*").alias("n_rows"), F.round(F.max("u"), 9).alias("u"))


def _document_groups(spark: SparkSession, d: str) -> DataFrame:
    return linked_groups(table(spark, d, "documents").select("doc_id", "cluster_id", "entity_key"), "doc_id", ["cluster_id", "entity_key"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents of groups of two and more with any cluster_id, and the group's smallest cluster_id."""
    groups = cut(_document_groups(spark, d).filter(F.col("root").startswith("0:")))
    sizes = groups.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1")
    return groups.join(sizes, "root").select(F.col("record").alias("doc_id"), F.substring("root", 3, 1_000_000).alias("group_key"))


def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    """The split of every document."""
    groups = cut(_document_groups(spark, d))
    return split_groups(groups, table(spark, d, "split_targets")).select(F.col("record").alias("doc_id"), F.col("split").alias("split_name"))


def p5_split_totals(spark: SparkSession, d: str) -> DataFrame:
    """How many documents each split has, and how many groups are in more than one: none."""
    g = cut(_document_groups(spark, d))
    placed = split_groups(g, table(spark, d, "split_targets"))
    torn = placed.groupBy("root").agg(F.count_distinct("split").alias("k"), F.first("split").alias("split_name")).groupBy("split_name").agg(F.count_if(F.col("k") > 1).alias("n_torn_groups"))
    return placed.groupBy(F.col("split").alias("split_name")).agg(F.count("*").alias("n_docs")).join(torn, "split_name")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Which document repeats which test item."""
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of seller and customer addresses that name the same place."""
    held = [F.struct(F.concat("doc_id", F.lit(f"#{p}")).alias("addr"), F.col("gt")[f"parties.{p}.addressStructured"].alias("text")) for p in ("seller", "customer")]
    rows = table(spark, d, "gt_records").filter("doc_id is not null").select(F.inline(F.array(*held))).filter("text <> '__ABSENT__'").distinct()
    return same_addresses(rows)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The distinct personal values of every text."""
    return pii_values(table(spark, d, "documents"))


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every text with placeholders for its personal values."""
    return redacted(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "redacted")


def p6_windows(spark: SparkSession, d: str) -> DataFrame:
    """The window of every document, or of its pieces, for each container."""
    return pack_windows(table(spark, d, "documents"), table(spark, d, "containers"), series="cluster_id")


QUERIES = {"p6_windows": p6_windows, "p8_found": p8_found, "p8_redacted": p8_redacted, "p4_found": p4_found, "p7_found": p7_found, "p2_stable_sample": p2_stable_sample, "p2_record_sample": p2_record_sample, "p5_found": p5_found, "p5_splits": p5_splits, "p5_split_totals": p5_split_totals}

_NUMBER = "CAST(('0x' || substr(md5(coalesce(p.seed, '') || ':' || CAST({id} AS VARCHAR)), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496.0"
ORACLES = {
    "p2_stable_sample": f"""
        SELECT plan_name, doc_id, round(u, 9) AS u FROM (
          SELECT p.plan_name, p.share, d.doc_id, {_NUMBER.format(id="d.doc_id")} AS u
          FROM (SELECT DISTINCT doc_id FROM documents) d, plans p WHERE p.dataset = 'documents') WHERE u < share""",
    "p2_record_sample": f"""
        SELECT plan_name, doc_id, n_rows, round(u, 9) AS u FROM (
          SELECT p.plan_name, p.share, d.doc_id, d.n_rows, {_NUMBER.format(id="d.doc_id")} AS u
          FROM (SELECT doc_id, source_dataset, count(*) AS n_rows FROM gt_records GROUP BY ALL) d, plans p
          WHERE p.dataset IS DISTINCT FROM 'documents' AND (p.dataset IS NULL OR p.dataset = d.source_dataset)) WHERE u < share""",
    # the nearest totals there can be: the share of all documents, rounded; the largest split takes the rest
    "p5_split_totals": """
        WITH n AS (SELECT count(*) AS n FROM documents), t AS (SELECT split_name, share / sum(share) OVER () AS share, row_number() OVER (ORDER BY share DESC, split_name) AS r FROM split_targets),
        small AS (SELECT split_name, CAST(round_even(share * n, 0) AS BIGINT) AS n_docs FROM t, n WHERE r > 1)
        SELECT split_name, n_docs, 0 AS n_torn_groups FROM small UNION ALL SELECT split_name, n - (SELECT sum(n_docs) FROM small), 0 FROM t, n WHERE r = 1""",
    "p5_found": """
        WITH RECURSIVE k AS (
          SELECT doc_id, lower(regexp_replace(cluster_id, '[^\\p{L}\\p{N}]+', '', 'g')) AS c, lower(regexp_replace(entity_key, '[^\\p{L}\\p{N}]+', '', 'g')) AS e FROM documents),
        unknown AS (SELECT unnest(['', 'na', 'nan', 'nil', 'none', 'notknown', 'null', 'missing', 'tba', 'tbc', 'tbd', 'unknown', 'undefined', 'unspecified']) AS w),
        n AS (SELECT doc_id, CASE WHEN c NOT IN (SELECT w FROM unknown) THEN '0:' || c END AS c, CASE WHEN e NOT IN (SELECT w FROM unknown) THEN '1:' || e END AS e FROM k),
        g AS (SELECT DISTINCT c AS a, e AS b FROM n WHERE c IS NOT NULL AND e IS NOT NULL UNION SELECT DISTINCT e, c FROM n WHERE c IS NOT NULL AND e IS NOT NULL),
        r AS (SELECT c AS node, c AS root FROM n WHERE c IS NOT NULL UNION SELECT e, e FROM n WHERE e IS NOT NULL
              UNION SELECT g.b, r.root FROM r JOIN g ON r.node = g.a),
        m AS (SELECT node, min(root) AS root FROM r GROUP BY node),
        d AS (SELECT doc_id, m.root FROM n JOIN m ON m.node = coalesce(n.c, n.e)),
        s AS (SELECT root FROM d WHERE root LIKE '0:%' GROUP BY root HAVING count(*) > 1)
        SELECT doc_id, substr(root, 3) AS group_key FROM d JOIN s USING (root)""",
}
