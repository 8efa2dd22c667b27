import datetime
import json

from fieldscore.operators import runs

RESULTS = "run_id string, doc_id string, ok boolean, arms string, written_at int"
APP = "run_id string, doc_id string, arms string, stored_at int"
STAGES = "run_id string, doc_id string, stage string, arm string, utc string, cached boolean, stage_ms double, data string, received_at timestamp"


def causes(spark, final, app, extract, refined, **more):
    day = datetime.datetime(2025, 1, 1)
    dump = lambda stage, data, days=0: ("r", "d", stage, None, "", False, 1.0, data if data is None or isinstance(data, str) else json.dumps(data), day + datetime.timedelta(days=days))
    stages = [dump("extract", extract), dump("extract", {"stale": 1}, -1), dump("refine", refined), dump("refine", {"stale": 2}, -1), dump("tail", {"other": 1})]
    got = runs.attributed_differences(
        spark.createDataFrame([("r", "d", True, json.dumps({"FINAL": final, "RAW": {"x": 1}}), 1), ("r", "run", True, "{}", 1)], RESULTS),
        spark.createDataFrame([("r", "d", json.dumps({"FINAL": app, "RAW": {"x": 2}}), 1), ("r", "app", "{}", 1)], APP),
        spark.createDataFrame(stages, STAGES), **more,
    )
    return {r.leaf_path: r.cause for r in got.collect()}


def test_difference_causes(spark):
    extract = {"why": "bench", "tax": "1.29%", "gone": 1, "n": 5, "lineItems": [{"q": "1"}]}
    refined = {"why": "bench", "tax": "(1.29%)", "n": 5, "lineItems": {"q": "2"}}
    final = {"invoiceOutputData": {"why": "bench", "tax": "(1.29%)", "norm": None, "n": 1.0, "lineItems": [{"q": "2"}]}}
    app = {"why": "app", "tax": "1.29%", "norm": 1.29, "n": "1.0", "gone": 1, "new": 3, "documentType": "invoice", "lineItems": [{"q": "1"}]}
    want = {
        "FINAL.why": "EXTRACTION", "FINAL.tax": "JUDGE+REFINE", "FINAL.norm": "TAIL", "FINAL.n": "FORMAT", "FINAL.gone": "JUDGE+REFINE", "FINAL.new": "EXTRACTION",
        "FINAL.documentType": "SERVE-LAYER", "FINAL.lineItems[0].q": "JUDGE+REFINE",
    }
    assert causes(spark, final, app, extract, {"invoiceOutputData": refined}) == want
    assert causes(spark, final, app, json.dumps(json.dumps(extract)), refined) == want


def test_no_refined_dump_is_unattributed(spark):
    for nothing in (None, "{", {}, {"receiptOutputData": {}}):
        assert causes(spark, {"a": 1, "b": 2}, {"a": 3, "b": "2.0"}, {"a": 1}, nothing) == {"FINAL.a": "UNATTRIBUTED", "FINAL.b": "FORMAT"}
    assert causes(spark, {"a": 1}, {"a": 3}, {"a": 1}, {"lineItems": []}) == {"FINAL.a": "JUDGE+REFINE"}


def test_introduced_nulls_of_odd_documents(spark):
    doc = lambda *payloads: [("r", "d", p if p is None else json.dumps(p)) for p in payloads]
    of = lambda before, after: {(r.field, r.n, r.n_docs) for r in runs.introduced_nulls(spark.createDataFrame(before, S), spark.createDataFrame(after, S), ["run_id", "doc_id"]).collect()}
    S = "run_id string, doc_id string, payload_json string"  # noqa: N806
    was = {"a": "x", "b": 0, "c": " \n", "d": None, "e": [{"q": "1"}, {"q": "2"}], "f": False}
    assert of(doc(was), doc({"a": " ", "b": None, "e": [{"q": "1"}]})) == {("a", 1, 1), ("b", 1, 1), ("e[].q", 1, 1), ("f", 1, 1)}
    assert of(doc(was), doc(None)) == {("a", 1, 1), ("b", 1, 1), ("e[].q", 2, 1), ("f", 1, 1)}
    assert of(doc({"a": 1, "b": 2}, {"a": 1}), doc({"a": None}, {"b": 3})) == {("a", 2, 1)}
    assert of(doc({"a": "\v"}), doc({})) == {("a", 1, 1)}  # blank is what SQL takes for it
    assert of(doc({"a": 1}), [("r", "other", "{}")]) == of([("r", None, '{"a": 1}')], [("r", None, "{}")]) == of([], doc({})) == set()


def test_introduced_nulls_broadcasts_nothing(spark, tmp_path):
    from fieldscore.operators.verdicts import predictions
    from fieldscore.plans.operators_catalog import introduced_nulls

    arms = [json.dumps({"RAW": {"a": 1, "n": i}, "RAW_POSTPROCESSED": {"a": None if i % 2 else 1, "n": i}}) for i in range(10)]
    spark.createDataFrame([("r", f"d{i}", True, t, 1) for i, t in enumerate(arms)], RESULTS).write.parquet(f"{tmp_path}/doc_results.parquet")
    payload = lambda arm: predictions(spark.read.parquet(f"{tmp_path}/doc_results.parquet")).filter(f"arm = '{arm}'").selectExpr("run_id", "doc_id", "to_json(payload) payload_json")
    for got in (introduced_nulls(spark, str(tmp_path)), runs.introduced_nulls(payload("RAW"), payload("RAW_POSTPROCESSED"), ["run_id", "doc_id"])):
        assert [tuple(r) for r in got.collect()] == [("a", 5, 5)]
        assert not [x for x in ("Broadcast", "Join") if x in got._jdf.queryExecution().executedPlan().toString()]
