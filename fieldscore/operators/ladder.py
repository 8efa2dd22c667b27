"""The strict ladder: the same fields under comparators of falling strictness, in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscore.functions import dates, numbers, text

LEVELS = ("L0", "L1", "L2", "L3", "L4")


def wire(v: Column) -> Column:
    """What a field prints as: the printed string of a number, else its number, else the scalar's own text.

    A number with a point keeps one: 4.0 and 4.00 print as 4.0, 4.60 as 4.6 and 4 as 4.
    """

    def printed(x: Column) -> Column:
        text = F.try_variant_get(x, "$", "string")
        return F.when(~F.is_variant_null(x), F.when(F.schema_of_variant(x).rlike(r"^DECIMAL\(\d+,0\)$"), F.concat(text, F.lit(".0"))).otherwise(text))

    part = lambda k: printed(F.try_variant_get(v, f"$.{k}", "variant"))
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.coalesce(part("originalValue"), part("normalizedValue"))).otherwise(printed(v))


def with_levels(verdicts: DataFrame) -> DataFrame:
    """Adds L0 (bytes), L1 (+ normalised text), L2 (+ money), L3 (+ dates), L4 (+ phone digits); addresses are left out."""
    v = verdicts.filter("rule <> 'address' and truth <> '__ABSENT__'").withColumn("wire", wire(F.col("pred")))
    w, t, r = F.col("wire"), F.col("truth"), F.col("rule")
    yes = lambda c: F.coalesce(c, F.lit(False))
    v = v.withColumn("L0", yes(w == t)).withColumn("L1", F.col("L0") | yes(text.normal(w) == text.normal(t)))
    v = v.withColumn("L2", F.col("L1") | ((r == "numeric") & yes(numbers.money(w) == numbers.money(t))))
    v = v.withColumn("L3", F.col("L2") | (r.isin("date_raw", "date_iso") & yes(dates.iso_date(w) == dates.iso_date(t))))
    return v.withColumn("L4", F.col("L3") | ((r == "phone") & yes(text.phone_digits(w) == text.phone_digits(t))))


def strict_ladder(verdicts: DataFrame, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """(arm, level, n, n_ok, accuracy)."""
    v = with_levels(verdicts)
    long = v.select("arm", F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.col(x).alias("ok")) for x in levels])).alias("z")).select("arm", "z.*")
    return long.groupBy("arm", "level").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"), F.round(F.try_divide(F.count_if("ok").cast("double"), F.count("*")), 6).alias("accuracy"))


def gap_causes(verdicts: DataFrame) -> DataFrame:
    """(path, cause, n, examples): fields that pass but aren't printed alike, by the least change that explains it."""
    v = with_levels(verdicts).filter("state = 'correct' and not L0")
    w, t = F.col("wire"), F.col("truth")
    squeeze = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    cause = (
        F.when(F.lower(w) == F.lower(t), "letter case")
        .when(squeeze(w) == squeeze(t), "white space")
        .when(F.col("L1"), "case and white space")
        .when(F.col("L2"), "number format")
        .when(F.col("L3"), "date format")
        .when(F.col("L4"), "phone format")
        .otherwise("other")
    )
    g = v.withColumn("cause", cause).groupBy("path", "cause")
    return g.agg(F.count("*").alias("n"), F.min(F.concat_ws(" | ", w, t)).alias("example"))
