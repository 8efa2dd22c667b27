"""Reproducible samples that stay as the data grow: permanent random numbers.

Every identifier gets a uniform number at first sight, which is written down and never drawn again; a sample is the
identifiers whose number lies under a threshold, and thresholds never fall. The number comes from a digest of seed and
identifier, so a lost store can be drawn again alike; the store still decides where it has a row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBER = "id string, seed string, u double, first_batch int"
SHARE = "plan_name string, seed string, share double"


def uniform(seed: Column, key: Column) -> Column:
    """A number in [0, 1) with 52 bits from the MD5 of ``seed:key``; the same on every engine with MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", seed, key)), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


class NumberStore:
    """The persisted numbers of identifiers, and the shares once named: two Parquet folders below ``path`` to which each
    delivery appends what it sees first. It outlives the call and the session.

    Two writers at once may both write an identifier; both write the same number, and readers take one of them.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, part: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")

    def rows(self) -> DataFrame:
        return self._read("numbers", NUMBER)

    def shares(self) -> DataFrame:
        return self._read("shares", SHARE)

    def see(self, ids: DataFrame, batch: int | str) -> None:
        """Anti-join insert: of ``ids`` (id, seed) those without a number get one. ``batch`` is the delivery's number or the
        column that holds each row's; of several the first counts. Null ids are left out; a second run adds nothing."""
        first = F.col(batch) if isinstance(batch, str) else F.lit(batch)
        seen = ids.filter(F.col("id").isNotNull()).select(F.col("id").cast("string").alias("id"), F.coalesce(F.col("seed").cast("string"), F.lit("")).alias("seed"), first.cast("int").alias("first_batch"))
        new = seen.groupBy("id", "seed").agg(F.min("first_batch").alias("first_batch")).join(self.rows().select("id", "seed"), ["id", "seed"], "left_anti")
        new.select("id", "seed", uniform(F.col("seed"), F.col("id")).alias("u"), "first_batch").write.mode("append").parquet(f"{self.path}/numbers")

    def keep(self, plans: DataFrame) -> None:
        """Notes the plans' shares where they exceed all that were noted before."""
        now, before = non_decreasing(plans), non_decreasing(self.shares())
        more = now.join(before.withColumnRenamed("share", "__before"), ["plan_name", "seed"], "left").filter("__before is null or share > __before")
        more.select("plan_name", "seed", "share").coalesce(1).write.mode("append").parquet(f"{self.path}/shares")


def non_decreasing(plans: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """(plan_name, seed, share): the greatest share ever named for each plan, nulls as 0; seeds null as ''."""
    cols = ["plan_name", F.coalesce(F.col("seed").cast("string"), F.lit("")).alias("seed"), F.least(F.greatest(F.coalesce(F.col("share"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("share")]
    parts = [p.select(*cols) for p in (plans, kept) if p is not None]
    return reduce(DataFrame.unionByName, parts).groupBy("plan_name", "seed").agg(F.max("share").alias("share"))


def seed_array(plans: DataFrame, most: int = 10_000) -> Column:
    """The different seeds of a handful of plans as one array; more than ``most`` are an error."""
    seeds = [r[0] for r in plans.select(F.coalesce(F.col("seed").cast("string"), F.lit("")).alias("seed")).distinct().limit(most + 1).collect()]
    if len(seeds) > most:
        raise ValueError(f"more than {most} seeds")
    return F.array(*[F.lit(s) for s in sorted(seeds)]).cast("array<string>")


def stable_sample(store: NumberStore, plans: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """(plan_name, doc_id, u): the identifiers of the store under each plan's threshold.

    ``plans`` (plan_name, seed, share) is small by its nature, its rows are checked against 10,000; ``kept`` are the
    shares of earlier deliveries, by default those the store has noted. All identifiers drawn from deliveries 1..k are
    drawn again from 1..k+1.
    """
    shares = non_decreasing(plans, store.shares() if kept is None else kept).join(plans.select("plan_name").distinct(), "plan_name", "left_semi")
    if shares.count() > 10_000:
        raise ValueError("stable_sample: more than 10,000 plans")
    drawn = store.rows().join(F.broadcast(shares), "seed").filter(F.col("u") < F.col("share"))
    return drawn.groupBy("plan_name", F.col("id").alias("doc_id")).agg(F.min("u").alias("u"))
