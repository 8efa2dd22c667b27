import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldscore.operators import align, groundtruth, metrics, runs, sampling
from fieldscore.operators.compare import emitted
from fieldscore.operators.rules import INVOICE, RECEIPT, rule_for, rule_registry
from fieldscore.operators.verdicts import verdicts
from fieldscore.options import ScoringOptions

GT = "doc_id string, cluster_id string, doc_type string, source_dataset string, gt map<string,string>, annotated_fields array<string>, meta string, received_at timestamp"
RES = "run_id string, doc_id string, ok boolean, arms string, judge string, written_at timestamp"


def planted(spark):
    """Perfect predictions for 60 documents with counted defects."""
    gt, res = [], []
    for i in range(60):
        truth = {"totals.totalIncludingTax": f"{i}.50 EUR", "currency": "EUR", "parties.seller.name": f"Firm {i}", "totals.taxAmount": "__ABSENT__", "parties.seller.addressStructured": f"{i} Main St\nTown, AB 12345"}
        gt.append((f"d{i:02}", f"c{i % 7}", "invoice", "s", truth, list(truth), "{}", None))
        good = {"totals": {"totalIncludingTax": {"originalValue": f"{i}.50 EUR", "normalizedValue": i + 0.5}}, "currency": "EUR", "parties": {"seller": {"name": f"FIRM  {i}", "addressStructured": {"address": f"{i} Main St", "city": "Town", "state": "AB", "postal_code": "12345"}}}}
        raw, final = json.loads(json.dumps(good)), json.loads(json.dumps(good))
        if i == 3:
            raw["totals"]["totalIncludingTax"]["normalizedValue"] = 99
        if i == 4:
            raw["totals"]["taxAmount"] = {"originalValue": "1.00"}
            final["totals"]["taxAmount"] = {"originalValue": "1.00"}
        if i == 5:
            final["currency"] = "USD"
        if i == 6:
            raw["parties"]["seller"]["name"] = None
        res.append(("r", f"d{i:02}", True, json.dumps({"RAW": raw, "FINAL": {"invoiceOutputData": final}}), json.dumps({"issues": {"totals": [{"field": "totals.totalIncludingTax"}]}}) if i in (3, 10) else None, None))
    return spark.createDataFrame(gt, GT), spark.createDataFrame(res, RES)


def test_planted_defects(spark):
    gt, res = planted(spark)
    v = verdicts(gt, res).cache()
    bad = {(r.arm, r.doc_id, r.path, r.state) for r in v.filter("not ok").collect()}
    assert bad == {("RAW", "d03", "totals.totalIncludingTax", "wrong"), ("RAW", "d04", "totals.taxAmount", "hallucination"), ("FINAL", "d04", "totals.taxAmount", "hallucination"), ("FINAL", "d05", "currency", "wrong"), ("RAW", "d06", "parties.seller.name", "missing")}
    lift = metrics.stage_lift(v, "RAW", "FINAL").first()
    assert (lift.fixed, lift.harmed, lift.net, lift.n_compared) == (2, 1, 1, 300)
    m = metrics.detector_matrix(metrics.with_flag(v, metrics.judge_flags(res)), "RAW", "FINAL").first()
    assert (m.tp, m.fp, m.fn, m.tn) == (1, 1, 2, 296)
    metrics.check_denominators(v)
    with pytest.raises(ValueError):
        metrics.check_denominators(v.filter("not (arm = 'RAW' and doc_id = 'd01')"))
    ci = {(r.arm, r.path): r for r in metrics.bootstrap_intervals(v).collect()}
    assert ci["RAW", "currency"].low == 1.0 and 0.8 < ci["RAW", "totals.totalIncludingTax"].low < 1.0
    again = {(r.arm, r.path): r for r in metrics.bootstrap_intervals(v.repartition(3)).collect()}
    assert ci == again


def test_empty_tables(spark):
    gt, res = planted(spark)
    assert verdicts(gt.filter("false"), res).count() == 0
    assert verdicts(gt, res.filter("false")).count() == 0
    assert metrics.per_field(verdicts(gt, res.filter("false"))).count() == 0


def test_emitted(spark):
    no, yes = ["null", '""', '"  "', "{}", "[]", '{"a":null,"b":{"c":""}}', "[null]"], ["0", "0.0", "false", '"x"', '{"a":0}', "[false]"]
    for js, want in [(x, False) for x in no] + [(x, True) for x in yes]:
        assert spark.sql("select 1").select(emitted(F.parse_json(F.lit(js)))).first()[0] is want, js


def test_rules():
    assert rule_for("totals.otherCharges[].key", "str", INVOICE) == "charge_label"
    assert rule_for("invoiceInfo.issueDateISO", "str", INVOICE) == "date_iso" and rule_for("receiptInfo.txnDate", "str", RECEIPT) == "date_raw"
    assert rule_for("parties.seller.name", "str", RECEIPT) == "text_contained"
    r = rule_registry(INVOICE)
    assert r["parties.seller.addressStructured"] == "address" and not any(".addressStructured." in p for p in r)


def test_options():
    for bad in ({"match_policy": "x"}, {"numeric_source": "x"}, {"anls_threshold": 0}):
        with pytest.raises(ValueError):
            ScoringOptions(**bad)


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for n, m in itertools.product(range(1, 6), repeat=2):
        for _ in range(20):
            c = rng.integers(-10, 30, (n, m)).astype(float)
            got = align.assignment(c)
            best = min(sum(c[i, j] for i, j in (zip(p, range(m)) if n >= m else zip(range(n), p))) for p in itertools.permutations(range(max(n, m)), min(n, m)))
            assert sum(c[i, j] for i, j in got) == best and len(got) == min(n, m)
    assert align.assignment(np.zeros((0, 3))) == []


def test_align_rows(spark):
    gt = [{"description": x, "quantity": str(i)} for i, x in enumerate(("red mop", "blue soap", "glass lamp", "steel hose"))]
    pred = [{"description": x, "quantity": {"originalValue": str(i)}} for i, x in ((0, "red mop"), (2, "glass lamq"), (3, "STEEL  hose"))]
    same = [{"description": "tea", "quantity": "1"}, {"description": "tea", "quantity": "2"}]
    swapped = [{"description": "tea", "quantity": "2"}, {"description": "tea", "quantity": "1"}]
    rows = [(json.dumps(gt), json.dumps(pred)), (json.dumps(same), json.dumps(swapped)), (None, "[]"), ("{", json.dumps(pred)), (json.dumps(gt), None)]
    df = spark.createDataFrame(rows, "g string, p string").select(align.align_rows(F.col("g"), F.col("p")).alias("x"))
    assert [[(y.gt_row, y.pred_row) for y in r.x] for r in df.collect()] == [[(0, 0), (2, 1), (3, 2)], [(0, 1), (1, 0)], [], [], []]


def test_charge_lines(spark):
    lines = "array<struct<rate:decimal(38,2),value:decimal(38,2)>>"
    df = spark.sql(f"select cast(array((5, 1), (7, 2), (9, 3), (11, 4), (13, 5)) as {lines}) t, cast(array((5, 1), (7, null), (9, 8), (1, 4)) as {lines}) p union all select cast(null as {lines}), cast(null as {lines})")
    got = [r[0] for r in df.select(align.charge_line_states(F.col("t"), F.col("p"))).collect()]
    assert got == [["correct", "missing", "wrong_value", "wrong_rate", "not_emitted"], []]


def test_ground_truth_states(spark):
    rows = [(1, 0, "TOTAL", "5.00 EUR"), (1, 0, "AMOUNT_DUE", "6.00 EUR"), (2, 0, "TOTAL", "TOTAL : 7.00 $"), (3, 0, "DATE", "soon"), (3, 0, "TOTAL", "8.00"), (4, 1, "NUMBER", " A  1 ")]
    labels = spark.createDataFrame(rows, "doc_id int, template int, label string, raw string")
    got = {(r.doc_id, r.path): (r.value, r.state) for r in groundtruth.resolve(labels).collect()}
    assert got[1, "totals.totalIncludingTax"] == (None, "excluded") and got[2, "totals.totalIncludingTax"] == ("7.00", "present")
    assert got[2, "currency"] == ("$", "present") and got[1, "currency"] == ("EUR", "present") and got[3, "invoiceInfo.issueDateISO"] == (None, "excluded")
    assert got[1, "invoiceInfo.issueDate"] == ("__ABSENT__", "absent") and (4, "totals.totalIncludingTax") not in got and got[4, "invoiceInfo.documentNumber"] == ("A 1", "present")


def test_plans_nest(spark):
    recs = spark.createDataFrame([(f"d{i}", f"c{i % 3}") for i in range(60)], "doc_id string, cluster_id string")
    small, large = ({r.doc_id for r in sampling.main_plan(recs, n, "s").collect()} for n in (5, 10))
    assert len(small) == 15 and small < large
    assert small == {r.doc_id for r in sampling.main_plan(recs.union(recs).repartition(5), 5, "s").collect()}


def test_merge_guards(spark):
    _, res = planted(spark)
    m = "run_id string, doc_type string, field_map_version string, tail_version string, image_prep string"
    both = res.union(res.withColumn("run_id", F.lit("q")))
    with pytest.raises(ValueError, match="documents"):
        runs.merge_runs(both, spark.createDataFrame([("r", "i", "1", "t", "p"), ("q", "i", "1", "t", "p")], m), ["r", "q"], "x")
    with pytest.raises(ValueError, match="differ"):
        runs.merge_runs(both, spark.createDataFrame([("r", "i", "1", "t", "p"), ("q", "i", "2", "t", "p")], m), ["r", "q"], "x")
    assert runs.merge_runs(res, spark.createDataFrame([("r", "i", "1", "t", "p")], m), ["r"], "x").count() == 60
