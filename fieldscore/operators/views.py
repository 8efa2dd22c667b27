"""Review tables over verdict rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _of(arm: str, c: str) -> Column:
    return F.max(F.when(F.col("arm") == arm, F.col(c)))


def _transition(before: Column, after: Column) -> Column:
    return F.when(~before & after, "FIXED").when(before & ~after, "HARMED").otherwise("")


def field_review(verdicts: DataFrame, arms: tuple[tuple[str, str], ...] = (("RAW", "raw"), ("RAW_POSTPROCESSED", "raw_pp"), ("FINAL", "final"))) -> DataFrame:
    """(run, document, path): the truth, each arm's value, form and state, and the transitions between arms.

    A pivot over known arms is a conditional aggregate: one shuffle with a partial aggregate before it.
    """
    cols = [F.max("truth").alias("truth")]
    for arm, short in arms:
        cols += [_of(arm, "p_raw").alias(f"{short}_value"), _of(arm, "p_form").alias(f"{short}_form"), _of(arm, "state").alias(f"{short}_state"), _of(arm, "ok").alias(f"{short}_ok")]
    v = verdicts.groupBy("run_id", "doc_id", "path").agg(*cols)
    return v.withColumns({"raw_to_pp": _transition(F.col("raw_ok"), F.col("raw_pp_ok")), "pp_to_final": _transition(F.col("raw_pp_ok"), F.col("final_ok"))})


def rollup(verdicts: DataFrame, by: list[str], arm: str = "FINAL") -> DataFrame:
    """Matches and mismatches of one arm by file or by field."""
    ok = F.count_if("ok")
    return verdicts.filter(F.col("arm") == arm).groupBy(*by).agg(ok.alias("n_match"), F.count_if(~F.col("ok")).alias("n_mismatch"), F.round(F.try_divide(ok.cast("double"), F.count("*")), 6).alias("match_rate"))


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A bounded table as Markdown, for reports."""
    rows = df.limit(most).collect()
    line = lambda xs: "| " + " | ".join("" if x is None else str(x) for x in xs) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *[line(r) for r in rows]])


def spreadsheet_safe(c: Column) -> Column:
    """Text that a spreadsheet would read as a formula gets a quote in front."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)
