"""Typed comparison: both sides in their comparable form as columns, then one CASE per result column.

Nothing is computed twice: each row has the forms its rule needs (the others are null), and the verdict columns read
only those. The forms are also what a reviewer is shown, so they can't disagree with the verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscore.functions import dates, numbers, text
from fieldscore.functions.expr import let
from fieldscore.operators import rules as R
from fieldscore.options import ScoringOptions

ABSENT = "__ABSENT__"


def emitted(v: Column) -> Column:
    """Whether a predicted value says anything: not null, blank, empty, or an object or array of such values.

    Objects and arrays say something if any scalar in them does, which their JSON text shows without recursion.
    """
    s = F.to_json(v)
    scalars = F.regexp_replace(F.regexp_replace(s, r'"(?:[^"\\]|\\.)*"\s*:', ""), r'null|"(?:\s|\\[nrt])*"|[\s{}\[\],]', "")
    return v.isNotNull() & ~F.is_variant_null(v) & (scalars != "")


def is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "struct<>").isNotNull()


def with_forms(df: DataFrame, options: ScoringOptions, rule: str = "rule", pred: str = "pred", truth: str = "truth") -> DataFrame:
    """Adds p_* and t_* columns: strings normalised for each rule, numbers, and both orders of an address.

    Text goes to Python at most once, and only where it isn't plain ASCII.
    """
    r, v, t = F.col(rule), F.col(pred), F.col(truth)
    address, phone = r == R.ADDRESS, r == R.PHONE
    parts = {k: F.try_variant_get(v, f"$.{k}", "string") for k in text.ADDRESS_PARTS}
    df = df.withColumns(
        {
            "p_raw": F.when(~F.is_variant_null(v), F.try_variant_get(v, "$", "string")),
            "p_object": is_object(v),
            "p_num": F.when(r == R.NUMERIC, numbers.numeric_fact(v, options.numeric_source)),
            "t_num": F.when(r == R.NUMERIC, numbers.money(t)),
            "p_joined": F.when(address & is_object(v), text.address_joined(parts)),
            "p_joined_alt": F.when(address & is_object(v), text.address_joined(parts, alt=True)),
        }
    )
    fold = (lambda c: c) if options.ascii_only else (lambda c: text.unicode_folded(c, phone))
    needed = ~r.isin(R.NUMERIC, R.DATE_ISO)
    df = df.withColumns(
        {
            "p_uni": fold(F.when(needed & ~F.col("p_object"), F.col("p_raw"))),
            "t_uni": fold(F.when(needed, t)),
            "p_joined": fold(F.col("p_joined")),
            "p_joined_alt": fold(F.col("p_joined_alt")),
        }
    )
    plain = (R.DATE_RAW, R.IDENTIFIER, R.ENUM, R.BOOL, R.CURRENCY, R.EMAIL, R.TEXT)

    def form(c: Column, raw: Column) -> Column:
        return (
            F.when(r.isin(*plain), text.normal(c, ascii_only=True))
            .when(phone, text.phone_printed(c, True))
            .when(r == R.TEXT_CONTAINED, text.normal(c, drop_punct=True, ascii_only=True))
            .when(r == R.DATE_ISO, dates.iso_date(raw))
            .when(r == R.CHARGE_LABEL, text.charge_name(c, True))
        )

    def printed(c: Column) -> Column:
        return text.address_compared(text.address_line(c, True), True)

    u, w = F.col("p_uni"), F.col("t_uni")
    rate = lambda c: F.when(r == R.CHARGE_LABEL, text.charge_rate(c))
    return df.withColumns(
        {
            "p_form": F.when(address, F.when(F.col("p_object"), text.address_compared(F.col("p_joined"), True)).otherwise(printed(u))).when(r == R.NUMERIC, numbers.money_text(F.col("p_num.value"))).otherwise(form(u, F.col("p_raw"))),
            "p_form_alt": F.when(address, F.when(F.col("p_object"), text.address_compared(F.col("p_joined_alt"), True)).otherwise(printed(u))),
            "t_form": F.when(address, printed(w)).when(r == R.NUMERIC, numbers.money_text(F.col("t_num"))).otherwise(form(w, t)),
            "p_rate": rate(F.col("p_raw")),
            "t_rate": rate(t),
        }
    ).drop("p_uni", "t_uni", "p_joined", "p_joined_alt")


def with_match(df: DataFrame, options: ScoringOptions, rule: str = "rule", pred: str = "pred", truth: str = "truth") -> DataFrame:
    """Adds matched, exact, convention, score, value_source, shipped_null and parse_disagreement to rows with forms."""
    r, v = F.col(rule), F.col(pred)
    p, alt, t = F.col("p_form"), F.col("p_form_alt"), F.col("t_form")
    raw_p, raw_t = F.col("p_raw"), F.col(truth)
    no_p = v.isNull() | F.is_variant_null(v) | F.coalesce((F.trim(raw_p) == "") & ~F.col("p_object"), F.lit(False))
    no_t = raw_t.isNull() | (F.trim(raw_t) == "")
    same = p.eqNullSafe(t)
    strict = F.coalesce(p == t, F.lit(False))
    recall = text.token_recall_normal(p, t)
    anls_best = F.greatest(text.anls_normal(p, t), F.when(r == R.ADDRESS, text.anls_normal(alt, t)))
    by_rule = (
        F.when(r.isin(R.NUMERIC, R.DATE_ISO), strict)
        .when(r == R.CHARGE_LABEL, same & F.col("p_rate").eqNullSafe(F.col("t_rate")))
        .when(r == R.ADDRESS, same | alt.eqNullSafe(t))
        .otherwise(same)
    )
    df = df.withColumns({"both_empty": no_p & no_t, "one_empty": no_p != no_t, "same_form": by_rule})
    exact = F.when(F.col("both_empty"), True).when(F.col("one_empty"), False).otherwise(F.col("same_form"))
    contained = recall >= options.contained_recall
    matched_contained = contained if options.match_policy == "threshold" else contained & same
    matched = F.when(F.col("both_empty"), True).when(F.col("one_empty"), False).when(r == R.TEXT_CONTAINED, matched_contained).otherwise(F.col("same_form"))
    convention = (
        F.when(F.col("both_empty"), True)
        .when(F.col("one_empty"), False)
        .when(r == R.CURRENCY, F.col("same_form") | text.currency_convention(raw_p, raw_t))
        .when(r == R.ADDRESS, F.col("same_form") | text.address_convention(p, t) | text.address_convention(alt, t))
        .otherwise(matched)
    )
    score = F.when(F.col("both_empty"), 1.0).when(F.col("one_empty"), 0.0).when(r.isin(R.TEXT, R.ADDRESS), anls_best).when(r == R.TEXT_CONTAINED, recall).otherwise(matched.cast("double"))
    source = F.col("p_num.source")
    return df.withColumns(
        {
            "exact": exact,
            "matched": matched,
            "convention": convention,
            "score": score,
            "value_source": F.when(r == R.NUMERIC, source),
            "shipped_null": F.coalesce((r == R.NUMERIC) & F.col("p_num.value").isNull() & source.isNotNull(), F.lit(False)),
            "parse_disagreement": F.when(r == R.NUMERIC, let(v, numbers.parse_disagreement)),
        }
    ).drop("both_empty", "one_empty", "same_form", "p_object")
