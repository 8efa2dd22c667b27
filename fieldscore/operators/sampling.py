"""Sampling plans over records: ranks within clusters and strata, by digests instead of a shuffled list.

A digest rank gives the same plan on every run and partitioning, and a larger plan contains the smaller one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldscore.session import cut


def digest(seed: str, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def _ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def smoke_plan(records: DataFrame, cluster: str = "cluster_id", doc: str = "doc_id", extras: list[str] | None = None) -> DataFrame:
    """The second document of each cluster (the only one of a single), and the named extras. Two rows a cluster and task move."""
    docs = records.select(doc, cluster).distinct()
    two = _ranked(docs, [cluster], [F.col(doc)]).filter("rn <= 2")
    picked = two.groupBy(cluster).agg(F.max(doc).alias(doc)).select(doc, cluster)
    return picked.union(docs.filter(F.col(doc).isin(*extras))).distinct() if extras else picked


def exact_ranks(df: DataFrame, by: str, order: str, name: str = "rank") -> DataFrame:
    """Adds the 0-based rank by ``order`` within ``by`` and ``<name>_of``, the group's size, however large one group is.

    Rows are sorted across partitions; a row's rank is its place among its group's rows of its partition plus what earlier
    partitions hold of the group, of which there is one count a partition and group. Rows should be distinct.
    """
    placed = cut(df.repartitionByRange(by, order).withColumn("__p", F.spark_partition_id()))
    counts = placed.groupBy("__p", by).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(by)
    before = counts.select("__p", by, F.coalesce(F.sum("__n").over(w.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__n").over(w).alias(f"{name}_of"))
    within = placed.withColumn("__r", F.row_number().over(Window.partitionBy("__p", by).orderBy(order)))
    same = [within["__p"] == before["__p"], within[by].eqNullSafe(before[by])]
    return within.join(before, same).select(*[within[c] for c in df.columns], (F.col("__r") - 1 + F.col("__before")).alias(name), f"{name}_of")


def pilot_plan(records: DataFrame, keyset: str = "keyset_id", doc: str = "doc_id", strata: str | None = None, size: int = 0, seed: str = "pilot") -> DataFrame:
    """The middle document of each key set; with ``strata`` filled to ``size`` by up to two more of each stratum in digest order."""
    docs = records.select(doc, keyset).distinct()
    r = exact_ranks(docs, keyset, doc)
    middle = r.filter(F.col("rank") == F.floor(F.col("rank_of") / 2)).select(doc, keyset)
    if strata is None:
        return middle
    middle = cut(middle)
    more = _ranked(records.select(doc, keyset, strata).distinct().join(middle.select(doc), doc, "left_anti"), [strata], [digest(seed, F.col(doc))]).filter("rn <= 2")
    return middle.union(more.orderBy("rn", strata, doc).limit(max(0, size - middle.count())).select(doc, keyset))


def main_plan(records: DataFrame, per_cluster: int, seed: str, cluster: str = "cluster_id", doc: str = "doc_id") -> DataFrame:
    """The first documents of each cluster in digest order, with their position."""
    r = _ranked(records.select(doc, cluster).distinct(), [cluster], [digest(seed, F.col(doc))], "position")
    return r.filter(F.col("position") <= per_cluster).select(doc, cluster, (F.col("position") - 1).alias("position"))


def plan_slices(plan: DataFrame, size: int) -> DataFrame:
    """The slice of each document of a plan by its position in its cluster."""
    return plan.withColumn("slice", F.floor(F.col("position") / size))


def stratum(n: Column) -> Column:
    return F.when(n.isNull() | (n == 0), "none").when(n == 1, "single").when(n <= 3, "small").when(n <= 9, "medium").otherwise("large")


def stratified_round_robin(records: DataFrame, strata: str, size: int, seed: str, doc: str = "doc_id", exclude: DataFrame | None = None, split: str | None = None, split_column: str = "split") -> DataFrame:
    """``size`` documents taken in turn from each stratum, in digest order, of one split if named; those of ``exclude`` not. A
    stratum gives ``size`` at most, so no more of it moves."""
    if split is not None:
        records = records.filter(F.col(split_column) == split)
    r = records.select(doc, strata).distinct()
    if exclude is not None:
        r = r.join(exclude.select(doc), doc, "left_anti")
    return _ranked(r, [strata], [digest(seed, F.col(doc))]).filter(F.col("rn") <= size).orderBy("rn", strata, doc).limit(size).select(doc, strata)


def quota_sample(records: DataFrame, band: str, quotas: dict[str, int], size: str, doc: str = "doc_id", total: int = 0) -> DataFrame:
    """Per band the largest documents up to the band's quota; where that gives fewer than ``total``, the largest others fill up."""
    limit = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    r = _ranked(records.select(doc, band, size).distinct(), [band], [F.desc(size), F.col(doc)]).filter(F.col("rn") <= max(quotas.values(), default=0))
    chosen = r.filter(F.col("rn") <= F.coalesce(F.try_element_at(limit, F.col(band)), F.lit(0))).select(doc, band, size)
    if not total:
        return chosen
    chosen = cut(chosen)
    rest = records.select(doc, band, size).distinct().join(chosen.select(doc), doc, "left_anti").orderBy(F.desc(size), doc)
    return chosen.union(rest.limit(max(0, total - chosen.count())))


def shuffle_batches(records: DataFrame, sizes: tuple[int, ...], each: int, seed: str, doc: str = "doc_id") -> DataFrame:
    """(doc, batch): all documents in one digest order, the first ``sizes`` batches of those sizes, then batches of ``each``."""
    one = records.select(doc).distinct().select(doc, F.lit("").alias("all"), digest(seed, F.col(doc)).alias("d"))
    r = exact_ranks(one, "all", "d")
    batch = F.when(F.lit(False), F.lit(0))
    for k in range(len(sizes)):
        batch = batch.when(F.col("rank") < sum(sizes[: k + 1]), F.lit(k))
    return r.select(doc, F.coalesce(batch, F.floor((F.col("rank") - sum(sizes)) / each).cast("int") + len(sizes)).alias("batch"))


def top_counts(df: DataFrame, key: str, k: int) -> DataFrame:
    """(key, n): the ``k`` most frequent values; of equal counts the lesser value first."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


def identify_draw(plan: DataFrame, records: DataFrame, seeds: list[str], sizes: list[int], cluster: str = "cluster_id", doc: str = "doc_id") -> DataFrame:
    """(seed, per_cluster, n_plan, n_drawn, n_shared): every candidate draw against a plan; the one that made it shares all."""
    p = plan.select(doc).distinct().withColumn("in_plan", F.lit(True))
    most = max(sizes)
    marks = F.array(*[F.struct(F.lit(s).alias("seed"), digest(s, F.col(doc)).alias("d")) for s in seeds])
    r = _ranked(records.select(doc, cluster).distinct().select(doc, cluster, F.inline(marks)), ["seed", cluster], [F.col("d")]).filter(F.col("rn") <= most)
    at = r.select("seed", doc, F.explode(F.filter(F.array(*[F.lit(k) for k in sizes]), lambda k: k >= F.col("rn"))).alias("per_cluster")).join(p, doc, "left")
    return at.groupBy("seed", "per_cluster").agg(F.count("*").alias("n_drawn"), F.count_if("in_plan").alias("n_shared")).withColumn("n_plan", F.lit(p.count()))


def plan_overlap(plans: DataFrame, name: str = "plan_name", ids: str = "doc_ids") -> DataFrame:
    """How many documents each pair of plans shares: members by document, pairs within a document's few plans."""
    member = plans.select(name, F.explode(ids).alias("doc_id")).distinct()
    per_doc = member.groupBy("doc_id").agg(F.sort_array(F.collect_set(name)).alias("in_plans"))
    pairs = F.flatten(F.transform("in_plans", lambda a: F.transform(F.filter("in_plans", lambda b: b > a), lambda b: F.struct(a.alias("plan_a"), b.alias("plan_b")))))
    return per_doc.select(F.inline(pairs)).groupBy("plan_a", "plan_b").agg(F.count("*").alias("n_shared"))
