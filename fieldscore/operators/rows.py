"""Scoring of repeated sections: rows of a section aligned, their cells compared, and the results by section and cell.

Both row lists of a section stand in one row of the table (as JSON arrays of flat objects), so aligning them moves
nothing. Cells come out of aligned rows by exploding a handful of declared targets, and are compared by the same rules as
fields; of several leaves that may hold a value the best one counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscore.functions import numbers, text
from fieldscore.operators import rules as R
from fieldscore.operators.align import align_rows, charge_line_states
from fieldscore.operators.compare import with_forms, with_match
from fieldscore.operators.metrics import rate
from fieldscore.options import ScoringOptions


@dataclass(frozen=True)
class Target:
    """A printed cell, the predicted leaves that may hold it, and the rule of the first of them."""

    cell: str
    leaves: tuple[str, ...]
    rule: str = R.NUMERIC


LINE_ITEM_TARGETS = (
    Target("description", ("description", "itemCode"), R.TEXT), Target("quantity", ("quantity",)), Target("unitPrice", ("unitPrice",)),
    Target("lineTotal", ("lineTotalExcludingTax", "lineTotalIncludingTax")),
)
KEYED_TARGETS = (Target("key", ("key",), R.CHARGE_LABEL), Target("value", ("value",)), Target("percentage", ("percentage",)))
KEYS = ["run_id", "doc_id", "arm", "section"]


def list_size(rows: Column) -> Column:
    """The number of rows of a JSON array as text; 0 for null, unreadable text and whatever is no array."""
    return F.when(F.ltrim(rows).startswith("["), F.coalesce(F.size(F.from_json(rows, "array<string>")), F.lit(0))).otherwise(F.lit(0))


def aligned(sections: DataFrame, keyed: tuple[str, ...] = (), options: ScoringOptions = ScoringOptions()) -> DataFrame:
    """Adds ``pairs`` to (run_id, doc_id, arm, section, gt_rows, pred_rows). Sections in ``keyed`` pair rows that carry a
    rate by it, the n-th with the n-th; a printed row whose rate nobody has stays alone; rows without one pair by text."""
    by_text = align_rows(F.col("gt_rows"), F.col("pred_rows"), threshold=options.anls_threshold)
    by_rate = align_rows(F.col("gt_rows"), F.col("pred_rows"), gt_text=("key", "keyAlt"), pred_text=("key",), threshold=options.anls_threshold, keyed=True)
    return sections.withColumn("pairs", F.when(F.col("section").isin(*keyed), by_rate).otherwise(by_text) if keyed else by_text)


def row_cells(aligned_sections: DataFrame, targets: dict[str, tuple[Target, ...]], options: ScoringOptions = ScoringOptions()) -> DataFrame:
    """(run_id, doc_id, arm, section, gt_row, pred_row, cell, leaf, truth, matched, score): every printed cell of every
    aligned row, with the leaf that answers it best; of equal ones the first declared. Cells without a printed value
    have no row. ``targets`` are a few constants by section."""
    pairs = aligned_sections.withColumn("pair", F.explode("pairs"))
    at = lambda rows, i, kind: F.get(F.from_json(F.col(rows), f"array<{kind}>"), F.col(i))
    rows = pairs.select(*KEYS, "pair.gt_row", "pair.pred_row", at("gt_rows", "pair.gt_row", "map<string,string>").alias("gt"), F.try_variant_get(F.try_parse_json("pred_rows"), "$", "array<variant>").alias("preds"))
    rows = rows.withColumn("p", F.get("preds", F.col("pred_row"))).drop("preds")

    def cells(ts: tuple[Target, ...]) -> Column:
        return F.array(*[F.struct(F.lit(t.cell).alias("cell"), F.lit(leaf).alias("leaf"), F.lit(-k).alias("order"), F.lit(t.rule).alias("rule"), F.try_element_at("gt", F.lit(t.cell)).alias("truth"), F.try_variant_get("p", f"$.{leaf}", "variant").alias("pred")) for t in ts for k, leaf in enumerate(t.leaves)])

    kind = "array<struct<cell:string,leaf:string,order:int,rule:string,truth:string,pred:variant>>"
    of = F.when(F.lit(False), F.array().cast(kind))
    for section, ts in targets.items():
        of = of.when(F.col("section") == section, cells(ts))
    long = rows.select(*KEYS, "gt_row", "pred_row", F.inline(of)).filter(F.trim("truth") != "")
    compared = with_match(with_forms(long, options), options)
    best = compared.groupBy(*KEYS, "gt_row", "pred_row", "cell", "truth").agg(F.max(F.struct("matched", "score", "order", "leaf")).alias("b"))
    return best.select(*KEYS, "gt_row", "pred_row", "cell", "b.leaf", "truth", "b.matched", F.round("b.score", 6).alias("score"))


def section_documents(aligned_sections: DataFrame, cells: DataFrame) -> DataFrame:
    """One row a document's section: rows printed, predicted, matched and matched exactly, cells and right cells."""
    sizes = aligned_sections.select(*KEYS, list_size(F.col("gt_rows")).alias("n_gt"), list_size(F.col("pred_rows")).alias("n_pred"), F.size("pairs").alias("n_matched"))
    by_row = cells.groupBy(*KEYS, "gt_row").agg(F.min("matched").alias("exact"), F.count("*").alias("n"), F.count_if("matched").alias("k"))
    by_doc = by_row.groupBy(*KEYS).agg(F.count_if("exact").alias("n_exact"), F.sum("n").alias("n_cells"), F.sum("k").alias("n_correct"))
    return sizes.join(by_doc, KEYS, "left").na.fill(0, ["n_exact", "n_cells", "n_correct"]).withColumn("table_exact", (F.col("n_gt") == F.col("n_pred")) & (F.col("n_gt") == F.col("n_exact")))


def sections_by_path(documents: DataFrame, by: tuple[str, ...] = ("arm", "section")) -> DataFrame:
    """One row an arm and section: row precision, recall and F1 over all rows, F1 averaged over documents, whole rows and
    tables, cells. Documents that print no row are counted apart and nowhere else."""
    some = F.col("n_gt") > 0
    total = lambda c: F.sum(F.when(some, F.col(c)))
    g, p, m = total("n_gt"), total("n_pred"), total("n_matched")
    f1 = F.when(some, F.try_divide(2.0 * F.col("n_matched"), F.col("n_gt") + F.col("n_pred")))
    return documents.groupBy(*by).agg(
        F.count_if(some).alias("n_docs"), F.count_if(~some).alias("n_docs_without_rows"), g.alias("n_gt"), p.alias("n_pred"), m.alias("n_matched"),
        rate(m, p).alias("precision"), rate(m, g).alias("recall"), rate(2 * m, g + p).alias("f1"), F.round(F.avg(f1), 6).alias("macro_f1"),
        rate(total("n_exact"), m).alias("row_exact_rate"), rate(F.count_if(some & F.col("table_exact")), F.count_if(some)).alias("table_exact_rate"), rate(total("n_correct"), total("n_cells")).alias("cell_accuracy"),
    )


def per_cell(cells: DataFrame, by: tuple[str, ...] = ("arm", "section", "cell")) -> DataFrame:
    """(arm, section, cell, n, n_correct, accuracy) of aligned rows."""
    return cells.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("matched").alias("n_correct"), rate(F.count_if("matched"), F.count("*")).alias("accuracy"))


def line_item_review(aligned_sections: DataFrame, cells: DataFrame, arms: tuple[str, ...] = ScoringOptions().arm_order) -> DataFrame:
    """(run_id, doc_id, section, gt_row, cell, truth, one column an arm): every printed cell with each arm's verdict: match,
    MISMATCH, or ROW NOT FOUND where the arm has no row for it, and null where it has no such section."""
    printed = aligned_sections.select("run_id", "doc_id", "section", "arm", F.posexplode(F.from_json("gt_rows", "array<map<string,string>>")).alias("gt_row", "gt"))
    printed = printed.select("run_id", "doc_id", "section", "arm", "gt_row", F.explode("gt").alias("cell", "truth")).filter(F.trim("truth") != "")
    keys = ["run_id", "doc_id", "section", "arm", "gt_row", "cell"]
    known = cells.select("section", "cell").distinct()  # a few rows
    seen = printed.join(F.broadcast(known), ["section", "cell"], "left_semi").join(cells.select(*keys, "matched"), keys, "left")
    says = F.when(F.col("matched").isNull(), "ROW NOT FOUND").when(F.col("matched"), "match").otherwise("MISMATCH")
    return seen.groupBy("run_id", "doc_id", "section", "gt_row", "cell", "truth").agg(*[F.max(F.when(F.col("arm") == a, says)).alias(a.lower()) for a in arms])


LINES = "array<struct<rate:decimal(38,2),value:decimal(38,2),scalar:boolean>>"


def charge_lines(payload: Column, lists: tuple[str, ...] = ("totals.taxes", "totals.otherCharges"), scalars: tuple[str, str, str] | None = ("totals.taxName", "totals.taxPercentage", "totals.taxAmount")) -> Column:
    """array<struct<rate, value, scalar>>: the charge lines of a payload, from its keyed lists in order, then from the three
    scalars of a single tax if they carry a rate. A rate stands in the key, else in the percentage."""

    def number(v: Column, path: str) -> Column:
        return numbers.numeric_fact(F.try_variant_get(v, path, "variant"))["value"]

    def line(x: Column) -> Column:
        own = text.charge_rate(F.try_variant_get(x, "$.key", "string")).cast("decimal(38,2)")
        return F.struct(F.coalesce(own, number(x, "$.percentage").cast("decimal(38,2)")).alias("rate"), number(x, "$.value").cast("decimal(38,2)").alias("value"), F.lit(False).alias("scalar"))

    parts = []
    for path in lists:
        v = F.try_variant_get(payload, f"$.{path}", "variant")
        held = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.when(F.schema_of_variant(v).startswith("OBJECT"), F.array(v)), F.array().cast("array<variant>"))
        parts.append(F.transform(F.filter(held, lambda x: x.isNotNull() & ~F.is_variant_null(x)), line))
    if scalars:
        name, percentage, amount = scalars
        own = F.coalesce(number(payload, f"$.{percentage}").cast("decimal(38,2)"), text.charge_rate(F.try_variant_get(payload, f"$.{name}", "string")).cast("decimal(38,2)"))
        single = F.array(F.struct(own.alias("rate"), number(payload, f"$.{amount}").cast("decimal(38,2)").alias("value"), F.lit(True).alias("scalar")))
        parts.append(F.when(own.isNotNull(), single).otherwise(F.array().cast(LINES)))
    return F.concat(*[p.cast(LINES) for p in parts])


def charge_line_scores(df: DataFrame, truth: str = "truth_lines", pred: str = "pred_lines") -> DataFrame:
    """Adds states (of each printed line), n_spurious (predicted lines that answer none), exact_set (as many lines, all
    right) and from_scalar (whether the three scalars gave a line)."""
    plain = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast(LINES)), lambda x: F.struct(x["rate"].alias("rate"), x["value"].alias("value")))
    out = df.withColumn("states", charge_line_states(plain(truth), plain(pred)))
    answered = F.size(F.filter("states", lambda s: s != "not_emitted"))
    n_pred = F.size(plain(pred))
    right = F.size(F.filter("states", lambda s: s == "correct"))
    scalar = F.exists(F.coalesce(F.col(pred), F.array().cast(LINES)), lambda x: x["scalar"])
    return out.withColumns({"n_spurious": n_pred - answered, "exact_set": (right == F.size("states")) & (n_pred == right), "from_scalar": scalar})


def charge_line_totals(scored: DataFrame, by: tuple[str, ...] = ("arm",)) -> DataFrame:
    """One row a group: documents, printed lines, right ones, predicted ones, spurious ones, documents with all lines and with
    exactly the printed set, and each state's count."""
    states = ("correct", "missing", "wrong_value", "wrong_rate", "not_emitted")
    n = lambda s: F.sum(F.size(F.filter("states", lambda x: x == s)))
    return scored.groupBy(*by).agg(
        F.count("*").alias("n_docs"), F.sum(F.size("states")).alias("n_lines"), F.sum(F.size("pred_lines")).alias("n_predicted"), F.sum("n_spurious").alias("n_spurious"),
        F.count_if(F.forall("states", lambda s: s == "correct")).alias("n_all_lines"), F.count_if("exact_set").alias("n_exact_set"), F.count_if("from_scalar").alias("n_from_scalar"), *[n(s).alias(f"n_{s}") for s in states],
    )
