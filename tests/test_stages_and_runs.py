import json
import time

import pytest
from pyspark.sql import functions as F

from fieldscore.operators import diagnostics, runs, score, stages


def test_arms_and_stages():
    assert stages.resolve_arms(["final", "RAW"]) == ["RAW", "RAW_POSTPROCESSED", "FINAL"] and stages.resolve_arms(["RAW"]) == ["RAW"]
    for bad in (["A"], [], ["RAW_POSTPROCESSED"]):
        with pytest.raises(ValueError):
            stages.resolve_arms(bad)
    assert [s.name for s in stages.stages_for(["RAW"])] == ["extract", "extraction_postprocessing"] and len(stages.stages_for(["RAW", "RAW_POSTPROCESSED", "FINAL"])) == 6


def test_a_plan_runs_with_cache_resume_timeouts_and_errors(spark):
    plan = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z"), ("d", "w"), ("e", "v"), ("a", "x"), (None, "n")], "doc_id string, image string")

    def extract(given):
        if given["doc"]["image"] == "y":
            raise RuntimeError("no answer")
        if given["doc"]["image"] == "z":
            time.sleep(2)
        return {"read": given["doc"]["image"]}

    calls = {"extract": extract, "extraction_postprocessing": lambda g: g["extract"] | {"tidy": True}}
    cache = spark.createDataFrame([("d", {"extract": '{"read": "held"}'})], "doc_id string, held map<string,string>")
    done = spark.createDataFrame([("e", True), ("a", False)], "doc_id string, ok boolean")
    out = {r.doc_id: r for r in stages.run_plan(plan, calls, "r1", ["RAW"], cache, done, {"extract": 0.3}).collect()}
    assert set(out) == {"a", "b", "c", "d"} and json.loads(out["a"].arms) == {"RAW": {"read": "x", "tidy": True}} and out["a"].ok and not out["a"].cached
    assert (out["b"].ok, out["b"].error_stage, out["b"].stage_status) == (False, "extract", {"extract": "error"}) and "no answer" in out["b"].error
    assert out["c"].timed_out and out["c"].stage_status == {"extract": "timeout"}
    assert out["d"].cached and json.loads(out["d"].arms)["RAW"]["read"] == "held"
    steps = stages.dry_run(plan, ["RAW"], cache, done).collect()
    assert [(s.stage, s.paid, s.n_docs, s.n_calls) for s in steps] == [("extract", True, 4, 3), ("extraction_postprocessing", False, 4, 4)]
    assert stages.run_plan(plan.filter("false"), calls, "r", ["RAW"]).count() == 0


def test_recorded_outputs_and_keys(spark):
    o = spark.createDataFrame([("a", "extract", "1", 1), ("a", "extract", "2", 2), ("a", "extract", None, 3), ("a", "judge", "3", 1)], "doc_id string, stage string, data string, received_at int")
    assert [tuple(r) for r in stages.recorded(o).collect()] == [("a", {"extract": "2", "judge": "3"})]
    k = spark.createDataFrame([("img", "p")], "i string, p string").select(stages.cache_key(F.col("i"), "m", "pr", "v1", "extract"), stages.cache_key(F.col("i"), "m", "pr", "v1", "judge", F.col("p"))).first()
    assert k[0].endswith(".m.pr.v1.extract") and len(k[0].split(".")[0]) == 16 and len(k[1].split(".")[-1]) == 12


def test_preflight(spark):
    plan = spark.createDataFrame([("a",), ("a",), ("b",), ("x",)], "doc_id string")
    records = spark.createDataFrame([("a", "s1", "i/a.png"), ("b", "s2", "i/b.png")], "doc_id string, source_dataset string, image_path string")
    images = spark.createDataFrame([("i/a.png",)], "image_path string")
    assert {tuple(r) for r in stages.preflight(plan, records, images, "s1").collect()} == {("a", "twice in the plan"), ("x", "no record"), ("b", "of another dataset"), ("b", "no image")}


def test_manifests_and_arms(spark):
    m = spark.createDataFrame([("r1", "invoice", "d", "1", "t", "p", 1.5, {"input": 3}), ("r2", "invoice", None, "2", "t", "p", 0.25, {"input": 4, "output": 1}), ("r3", "x", "d", "1", "t", "p", 9.0, None)], "run_id string, doc_type string, dataset string, field_map_version string, tail_version string, image_prep string, total_cost_usd double, tokens map<string,bigint>")
    r = runs.merged_manifest(m, ["r1", "r2"], "all").first()
    assert float(r.total_cost_usd) == 1.75 and r.sources == ["r1", "r2"] and r.mismatch == ["dataset", "field_map_version"] and r.tokens == {"input": 7, "output": 1}
    results = spark.createDataFrame([("r", "a", True, '{"RAW": {"x": 1}, "_p": 1}', 1), ("r", "a", True, '{"RAW": {"x": 2}}', 2), ("r", "b", False, None, 1)], "run_id string, doc_id string, ok boolean, arms string, written_at int")
    dumps = spark.createDataFrame([("r", "a", "refine", '{"x": 5}', 1), ("r", "b", "refine", "{}", 1), ("r", "a", "judge", "{}", 1)], "run_id string, doc_id string, stage string, data string, received_at int")
    arms = runs.derive_arms(results, dumps, {"REFINED": "refine"})
    assert {(x.arm, x.data) for x in arms.collect()} == {("RAW", '{"x":2}'), ("REFINED", '{"x": 5}')}
    made = spark.createDataFrame([("r", "a", '{"x": 3}')], "run_id string, doc_id string, data string")
    assert {x.arm for x in runs.backfill_arm(arms, "RAW", "RAW_POSTPROCESSED", made).collect()} == {"RAW", "REFINED", "RAW_POSTPROCESSED"}
    for bad in (lambda: runs.backfill_arm(arms, "RAW", "REFINED", made), lambda: runs.backfill_arm(arms, "RAW", "N", made.filter("false"))):
        with pytest.raises(ValueError):
            bad()
    again, changed = runs.rebuilt(arms, made, "RAW")
    assert {(x.arm, x.data) for x in again.collect()} == {("REFINED", '{"x": 5}'), ("RAW", '{"x": 3}')} and [(x.field, x.change, x.n) for x in changed.collect()] == [("x", "changed", 1)]


def test_diagnostics(spark):
    p = spark.createDataFrame(
        [("r", "a", "RAW", '{"totals": {"taxAmount": {"originalValue": "1.00, 2.00", "normalizedValue": 1.0}, "x": "[1, 2]"}}'), ("r", "b", "RAW", '{"totals": {"taxAmount": {"originalValue": "5.00", "normalizedValue": 7}, "subtotal": {"originalValue": "3.00", "normalizedValue": null}}}')],
        "run_id string, doc_id string, arm string, payload_json string",
    )
    w = diagnostics.wire_defects(p, ["run_id", "doc_id", "arm"]).first()
    assert (w.n_docs, w.n_list_leaked, w.n_two_taxes, w.n_disagree) == (2, 1, 1, 1)
    c = diagnostics.numeric_census(p, ["run_id", "doc_id", "arm"]).first()
    assert (c.n_numeric, c.n_normalised) == (3, 2)
    printed = spark.createDataFrame([("a", ["1.00", "2.50"])], "doc_id string, amounts array<string>")
    dumps = spark.createDataFrame([("a", "extract", '{"t": "pays 1.00 and 2.50"}'), ("a", "refine", '{"v": 2.5, "reasoning": {"n": "1.00"}}'), ("a", "judge", None)], "doc_id string, stage string, data string")
    assert {(x.stage, x.n_printed, x.n_seen) for x in diagnostics.stage_trace(printed, dumps).collect()} == {("extract", 2, 2), ("refine", 2, 1)}
    s = spark.createDataFrame([("correct", "wrong_value", "wrong_value"), ("correct", "correct", "missing"), ("not_emitted", "not_emitted", "not_emitted"), ("wrong_rate", "wrong_rate", "correct")], "RAW string, RAW_POSTPROCESSED string, FINAL string")
    assert [x[0] for x in s.select(diagnostics.defect_label({c: F.col(c) for c in s.columns})).collect()] == ["lost in postprocessing", "lost by the judge", "never emitted", None]
    v = spark.createDataFrame([("RAW", "t", "Rp 38.000", "rp 38.000", "38000.00"), ("RAW", "t", "38000.00", "Rp 38.000", "38000.00")], "arm string, path string, wire string, printed string, truth string")
    assert [tuple(x) for x in diagnostics.verbatim_probe(v).collect()] == [("RAW", "t", 2, 0.5, 0.5)]
    t = spark.createDataFrame([("a", "Blue  Lamp", "one blue lamp here"), ("b", "red", "green"), ("c", None, "x")], "doc_id string, truth string, page_text string")
    assert [r.doc_id for r in diagnostics.not_contained(t).collect()] == ["b"]


def test_score_run(spark, tmp_path):
    kind = "doc_id string, cluster_id string, doc_type string, source_dataset string, gt map<string,string>, annotated_fields array<string>, excluded_fields map<string,string>, meta string, received_at int"
    items = json.dumps([{"description": "blue lamp", "quantity": "2"}])
    gt = spark.createDataFrame([(d, f"c{d}", "receipt", "s", {"currency": "EUR", "lineItems": items}, ["currency", "lineItems"], {}, "{}", 1) for d in "ab"], kind)
    arm = lambda c: {"currency": c, "lineItems": [{"description": "blue lamp", "quantity": {"originalValue": "2"}}]}
    rows = [("r", "a", True, json.dumps({"RAW": arm("USD"), "FINAL": arm("EUR")}), '{"issues": {"x": [{"field": "currency"}]}}', 1), ("r", "b", True, json.dumps({"RAW": arm("EUR"), "FINAL": arm("EUR")}), None, 1), ("r", "x", True, "{}", None, 1), ("r", "y", False, None, None, 1)]
    results = spark.createDataFrame(rows, "run_id string, doc_id string, ok boolean, arms string, judge string, written_at int")
    s = score.score_run(gt, results, least_docs=1, least_values=1)
    assert s.n_documents_scored == 3 and s.arm_denominators_equal
    assert {(r.arm, r.micro_accuracy) for r in s.tables["summary"].collect()} == {("RAW", 0.5), ("FINAL", 1.0)}
    assert {(r.before, r.after, r.fixed, r.harmed) for r in s.tables["lift"].collect()} >= {("RAW", "FINAL", 1, 0)}
    assert (s.tables["judge"].first().tp, s.tables["judge"].first().tn) == (1, 1) and {r.cell_accuracy for r in s.tables["sections"].collect()} == {1.0}
    assert s.report().splitlines()[2].startswith("| RAW | 2 | 2 | 0.5")
    s.write(str(tmp_path / "out"), "s")
    assert spark.read.parquet(str(tmp_path / "out" / "summary")).count() == 2
    with pytest.raises(Exception, match="exist"):
        s.write(str(tmp_path / "out"), "s")
    uneven = results.withColumn("arms", F.when(F.col("doc_id") == "b", json.dumps({"FINAL": arm("EUR")})).otherwise(F.col("arms")))
    with pytest.raises(ValueError, match="arms"):
        score.score_run(gt, uneven)
    assert not score.score_run(gt, uneven, allow_arm_mismatch=True).arm_denominators_equal


def test_tables_of_a_session_are_deleted(spark):
    from pathlib import Path

    from fieldscore import session

    a, b = session.cut(spark.range(3).toDF("x")), session.cut(spark.range(2).toDF("x"))
    assert a.count() == 3 and Path(a._stored_at).exists()
    session.forget(a)
    assert not Path(a._stored_at).exists() and b.count() == 2
    held = list(session._TABLES)
    session._TABLES[:] = [b._stored_at]
    session.clean()
    assert not Path(b._stored_at).exists() and session._TABLES == []
    session._TABLES[:] = [x for x in held if x != b._stored_at]
