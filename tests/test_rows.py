import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldscore.operators import align, rows

GT = [{"description": f"item {w}", "quantity": str(i + 1), "unitPrice": f"{i + 2}.50", "lineTotal": f"{(i + 1) * (i + 2.5):.2f}"} for i, w in enumerate(("apple", "bread", "candle", "drill"))]
PRED = [{"description": g["description"], "quantity": {"originalValue": g["quantity"]}, "unitPrice": {"originalValue": g["unitPrice"]}, "lineTotalIncludingTax": {"originalValue": g["lineTotal"]}} for g in GT]
SCHEMA = "run_id string, doc_id string, arm string, section string, gt_rows string, pred_rows string"


def scored(spark, docs, keyed=(), targets=None):
    a = rows.aligned(spark.createDataFrame([("r", d, "FINAL", s, json.dumps(g) if g is not None else None, json.dumps(p) if p is not None else None) for d, s, g, p in docs], SCHEMA), keyed).cache()
    return a, rows.row_cells(a, targets or {"lineItems": rows.LINE_ITEM_TARGETS, "taxes": rows.KEYED_TARGETS}).cache()


@pytest.mark.parametrize("seed", range(4))
def test_assignment_costs_least(seed):
    r = np.random.default_rng(seed)
    for n, m in ((3, 3), (2, 5), (5, 3), (1, 4)):
        cost = r.integers(0, 9, (n, m)).astype(float)
        got = sum(cost[i, j] for i, j in align.assignment(cost))
        short, long = (cost, m) if n <= m else (cost.T, n)
        assert got == min(sum(short[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(long), min(n, m)))


def test_cells_take_the_best_leaf_and_rows_that_miss_are_told(spark):
    wrong = [PRED[0] | {"quantity": {"originalValue": "9"}}, PRED[1], PRED[3]]  # the third row is missing
    a, cells = scored(spark, [("d1", "lineItems", GT, PRED), ("d2", "lineItems", GT, wrong), ("d3", "lineItems", [], PRED[:1]), ("d4", "lineItems", GT[:1], None), ("d5", "lineItems", None, PRED)])
    got = {(x.doc_id, x.gt_row, x.cell): (x.leaf, x.matched) for x in cells.collect()}
    assert got[("d1", 0, "lineTotal")] == ("lineTotalIncludingTax", True) and got[("d2", 0, "quantity")] == ("quantity", False) and ("d2", 2, "quantity") not in got
    s = rows.sections_by_path(rows.section_documents(a, cells)).collect()[0]
    assert (s.n_docs, s.n_docs_without_rows, s.n_gt, s.n_pred, s.n_matched) == (3, 2, 9, 7, 7)
    assert s.precision == 1.0 and s.recall == round(7 / 9, 6) and s.row_exact_rate == round(6 / 7, 6) and s.table_exact_rate == round(1 / 3, 6) and s.cell_accuracy == round(27 / 28, 6)
    assert s.macro_f1 == round((1 + 6 / 7 + 0) / 3, 6)
    assert {(x.cell, x.n, x.n_correct) for x in rows.per_cell(cells).collect()} == {("description", 7, 7), ("quantity", 7, 6), ("unitPrice", 7, 7), ("lineTotal", 7, 7)}
    review = {(x.doc_id, x.gt_row, x.cell): x.final for x in rows.line_item_review(a, cells).collect()}
    assert review[("d2", 2, "quantity")] == "ROW NOT FOUND" and review[("d2", 0, "quantity")] == "MISMATCH" and review[("d1", 3, "unitPrice")] == "match" and review[("d4", 0, "lineTotal")] == "ROW NOT FOUND"


def test_rows_with_a_rate_never_pair_by_text(spark):
    gt = [{"key": "VAT (5%)", "value": "1.00"}, {"key": "VAT (7%)", "value": "2.00"}, {"key": "Shipping fee", "value": "3.00"}]
    pred = [{"key": "Shipping fee", "value": {"originalValue": "3.00"}}, {"key": "VAT", "percentage": {"originalValue": "5"}, "value": {"originalValue": "1.00"}}, {"key": "VAT (7.5%)", "value": {"originalValue": "2.00"}}]
    a, cells = scored(spark, [("d", "taxes", gt, pred)], keyed=("taxes",))
    assert [(x.gt_row, x.pred_row, x.matched_on) for x in a.first().pairs] == [(0, 1, "rate"), (2, 0, "key")]
    assert {(x.gt_row, x.cell, x.matched) for x in cells.collect()} == {(0, "key", False), (0, "value", True), (2, "key", True), (2, "value", True)}


def test_charge_lines_of_lists_and_scalars(spark):
    payloads = [
        '{"totals": {"taxes": [{"key": "VAT (5%)", "value": {"originalValue": "1.00"}}, {"key": "GST", "percentage": {"originalValue": "7"}, "value": {"originalValue": "2.00"}}], "taxAmount": {"originalValue": "3.00"}}}',
        '{"totals": {"otherCharges": {"key": "Shipping", "value": {"originalValue": "4"}}, "taxName": "VAT (19%)", "taxAmount": {"originalValue": "5"}}}',
        "{}",
    ]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, p string").withColumn("lines", rows.charge_lines(F.try_parse_json("p")))
    got = {r.i: [(None if x.rate is None else float(x.rate), float(x.value), x.scalar) for x in r.lines] for r in df.collect()}
    assert got == {0: [(5.0, 1.0, False), (7.0, 2.0, False)], 1: [(None, 4.0, False), (19.0, 5.0, True)], 2: []}
    truth = F.array(F.struct(F.lit(5).cast("decimal(38,2)").alias("rate"), F.lit(1).cast("decimal(38,2)").alias("value"), F.lit(False).alias("scalar")))
    s = rows.charge_line_scores(df.withColumnRenamed("lines", "pred_lines").withColumn("truth_lines", truth))
    assert {r.i: (r.states, r.n_spurious, r.exact_set, r.from_scalar) for r in s.collect()} == {0: (["correct"], 1, False, False), 1: (["not_emitted"], 2, False, True), 2: (["not_emitted"], 0, False, False)}
    t = rows.charge_line_totals(s.withColumn("arm", F.lit("FINAL"))).first()
    assert (t.n_docs, t.n_lines, t.n_predicted, t.n_spurious, t.n_all_lines, t.n_exact_set, t.n_correct, t.n_not_emitted) == (3, 3, 4, 3, 1, 0, 1, 2)
