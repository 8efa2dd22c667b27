"""Aggregates over verdict rows: rates, slices, stage lift, detector matrix, guards and bootstrap intervals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscore.options import ScoringOptions

STATES = ("correct", "wrong", "missing", "correct_null", "hallucination")


def n_in(*states: str) -> Column:
    return F.count_if(F.col("state").isin(*states))


def rate(num: Column, den: Column) -> Column:
    """num / den to six places; null where there is nothing to divide by."""
    return F.round(F.try_divide(num.cast("double"), den.cast("double")), 6)


def accuracy() -> Column:
    return rate(n_in("correct"), n_in("correct", "wrong", "missing"))


def convention_rate() -> Column:
    eligible = F.col("state").isin("correct", "wrong", "missing")
    return rate(F.count_if(eligible & F.col("ok_convention")), F.count_if(eligible))


def per_field(verdicts: DataFrame, by: tuple[str, ...] = ("arm", "path")) -> DataFrame:
    """One row an arm and field; one pass, with a partial aggregate before the shuffle."""
    return verdicts.groupBy(*by).agg(
        F.count("*").alias("n_docs"),
        F.count_distinct("cluster_id").alias("n_clusters"),
        *[n_in(s).alias(f"n_{s}") for s in STATES],
        accuracy().alias("accuracy"),
        rate(F.count_if(F.col("exact") & F.col("state").isin("correct", "wrong", "missing")), n_in("correct", "wrong", "missing")).alias("exact_rate"),
        rate(n_in("correct_null"), n_in("correct_null", "hallucination")).alias("correct_null_rate"),
        convention_rate().alias("convention_accuracy"),
    )


def summary(verdicts: DataFrame, headline: DataFrame | None = None) -> DataFrame:
    """micro, macro and headline accuracy of each arm. ``headline`` (path) is a handful of eligible fields."""
    fields = per_field(verdicts)
    macro = fields.groupBy("arm").agg(F.round(F.avg("accuracy") + 1e-12, 6).alias("macro_accuracy"), F.count("*").alias("n_fields"))
    micro = verdicts.groupBy("arm").agg(
        F.count("*").alias("n_instances"), F.count_distinct("doc_id").alias("n_docs"), accuracy().alias("micro_accuracy"), convention_rate().alias("micro_convention"),
        rate(n_in("correct_null"), n_in("correct_null", "hallucination")).alias("correct_null_rate"), n_in("hallucination").alias("hallucinations"),
    )
    out = micro.join(macro, "arm")
    if headline is None:
        return out
    head = verdicts.join(F.broadcast(headline.select("path")), "path", "left_semi").groupBy("arm").agg(accuracy().alias("headline_accuracy"))
    return out.join(head, "arm", "left")


def stage_lift(verdicts: DataFrame, before: str, after: str, keys: tuple[str, ...] = ("run_id", "doc_id", "path")) -> DataFrame:
    """fixed, harmed, net and harm rate from one arm to another: one grouped pass instead of a self-join."""
    arms = verdicts.filter(F.col("arm").isin(before, after))
    sides = arms.groupBy(*keys).agg(F.max(F.when(F.col("arm") == before, F.col("ok"))).alias("b"), F.max(F.when(F.col("arm") == after, F.col("ok"))).alias("a"))
    both = sides.filter("a is not null and b is not null")
    fixed, harmed = F.count_if(~F.col("b") & F.col("a")), F.count_if(F.col("b") & ~F.col("a"))
    return both.agg(
        F.lit(before).alias("before"), F.lit(after).alias("after"), F.count("*").alias("n_compared"), fixed.alias("fixed"), harmed.alias("harmed"), (fixed - harmed).alias("net"),
        F.round(harmed / F.greatest(F.count_if("b"), F.lit(1)), 6).alias("harm_rate"),
    )


def judge_flags(doc_results: DataFrame) -> DataFrame:
    """(run_id, doc_id, field) of the issues of the current judge reports."""
    from fieldscore.operators.current import current_rows
    from fieldscore.operators.nested import JUDGE_SECTIONS, nested_tables, read_json, report_root

    cur = current_rows(doc_results.select("run_id", "doc_id", "ok", "judge", "written_at"), ["run_id", "doc_id"], "written_at", [F.xxhash64("judge")]).filter("ok")
    issues = nested_tables(cur, ["run_id", "doc_id"], {"judge": (report_root(read_json(F.col("judge"))), JUDGE_SECTIONS)})["issues"]
    return issues.select("run_id", "doc_id", "node_path", F.try_variant_get("node", "$.field", "string").alias("field"), F.try_variant_get("node", "$.issue_type", "string").alias("issue_type"), F.to_json(F.try_variant_get("node", "$.corrected_value", "variant")).alias("corrected"))


def with_flag(verdicts: DataFrame, flags: DataFrame) -> DataFrame:
    """Adds ``flagged``: an issue's field is the path or holds the path's last part.

    The fields of one document's issues come as one array (bounded by its report), so the test is a filter in the row.
    """
    fields = flags.filter("field <> ''").groupBy("run_id", "doc_id").agg(F.collect_set("field").alias("fields"))
    leaf = F.element_at(F.split("path", r"\."), -1)
    return verdicts.join(fields, ["run_id", "doc_id"], "left").withColumn("flagged", F.coalesce(F.exists("fields", lambda f: f.contains(leaf) | (f == F.col("path"))), F.lit(False))).drop("fields")


def detector_matrix(flagged: DataFrame, arm: str, final: str) -> DataFrame:
    """The judge as a detector of wrong fields of ``arm``, over the fields that ``final`` has too."""
    keys = ["run_id", "doc_id", "path"]
    there = flagged.filter(F.col("arm").isin(arm, final)).groupBy(*keys).agg(F.max(F.when(F.col("arm") == arm, F.col("ok"))).alias("ok"), F.max(F.col("arm") == final).alias("final"), F.max("flagged").alias("flagged"))
    d = there.filter("ok is not null and final")
    f, bad = F.col("flagged"), ~F.col("ok")
    tp, fp, fn, tn = F.count_if(f & bad), F.count_if(f & ~bad), F.count_if(~f & bad), F.count_if(~f & ~bad)
    return d.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"), rate(2 * tp, 2 * tp + fp + fn).alias("f1"))


def arm_denominators(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("run_id", "arm").agg(F.count_distinct("doc_id").alias("n_docs"))


def check_denominators(verdicts: DataFrame) -> None:
    """Raises where a run's arms don't hold the same number of documents."""
    uneven = arm_denominators(verdicts).groupBy("run_id").agg(F.count_distinct("n_docs").alias("k")).filter("k > 1").limit(5).collect()
    if uneven:
        raise ValueError(f"arms of different size in runs {[r[0] for r in uneven]}")


def cluster_counts(verdicts: DataFrame, by: tuple[str, ...] = ("arm", "path")) -> DataFrame:
    """Correct and eligible rows by cluster: all the bootstrap has to know."""
    return verdicts.groupBy(*by, "cluster_id").agg(n_in("correct").alias("num"), n_in("correct", "wrong", "missing").alias("den"))


def bootstrap_intervals(verdicts: DataFrame, by: tuple[str, ...] = ("arm", "path"), options: ScoringOptions = ScoringOptions(), least_clusters: int = 2, least_rows: int = 50) -> DataFrame:
    """95 % intervals of the pooled accuracy when clusters are drawn with replacement.

    In each draw a cluster comes as often as a Poisson number of mean 1 says, which its name and the seed tell, so clusters
    are drawn where they are: a task sends the sums of its clusters in every draw, one row a group, however many
    clusters a group has (where each document is one, it has a cluster a document). The result doesn't depend on the
    partitioning. Null with fewer than ``least_clusters`` clusters or ``least_rows`` rows.
    """
    counts = cluster_counts(verdicts, by).filter("den > 0")
    seed, iters = options.bootstrap_seed, options.bootstrap_iterations
    kinds = dict(counts.dtypes)
    keys = ", ".join(f"{k} {kinds[k]}" for k in by)

    def weights(names: pd.Series) -> np.ndarray:
        starts = [int.from_bytes(hashlib.blake2b(f"{seed}:{n}".encode(), digest_size=16).digest(), "little") for n in names]
        return np.stack([np.random.Generator(np.random.Philox(s)).poisson(1.0, iters) for s in starts]) if starts else np.zeros((0, iters), np.int64)

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, list] = {}
        for b in batches:
            names, at = np.unique(b["cluster_id"].astype(str).to_numpy(), return_inverse=True)
            w = weights(pd.Series(names))
            for key, g in b.assign(__at=at).groupby(list(by), dropna=False):
                x = w[g["__at"].to_numpy()]
                held = sums.setdefault(key, [0, 0, np.zeros(iters, np.int64), np.zeros(iters, np.int64)])
                held[0] += len(g)
                held[1] += int(g["den"].sum())
                held[2] += g["num"].to_numpy() @ x
                held[3] += g["den"].to_numpy() @ x
        yield pd.DataFrame([[*k, *v] for k, v in sums.items()], columns=[*by, "n_clusters", "n_rows", "num", "den"])

    def interval(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n, rows = int(pdf["n_clusters"].sum()), int(pdf["n_rows"].sum())
        num, den = (np.sum(np.stack(pdf[c].to_list()), axis=0) for c in ("num", "den"))
        low = high = None
        if n >= least_clusters and rows >= least_rows:
            rates = np.sort(num[den > 0] / den[den > 0])  # draws without any cluster say nothing
            low, high = float(rates[int(0.025 * len(rates))]), float(rates[int(0.975 * len(rates)) - 1])
        return pd.DataFrame([[*key, n, rows, low, high]], columns=[*by, "n_clusters", "n_rows", "low", "high"])

    partial = counts.mapInPandas(drawn, f"{keys}, n_clusters long, n_rows long, num array<long>, den array<long>")
    return partial.groupBy(*by).applyInPandas(interval, f"{keys}, n_clusters int, n_rows long, low double, high double")  # a row a task and group


def no_tax_slice(verdicts: DataFrame) -> DataFrame:
    """Accuracy over all records and over those that print a tax, by arm."""
    taxed = verdicts.filter(~F.col("no_tax")).groupBy("arm").agg(accuracy().alias("taxed_accuracy"), F.count("*").alias("n_taxed"))
    return verdicts.groupBy("arm").agg(accuracy().alias("all_accuracy"), F.count("*").alias("n_all"), F.count_if("no_tax").alias("n_no_tax")).join(taxed, "arm", "left")
