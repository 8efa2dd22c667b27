import json

import pytest
from pyspark.sql import functions as F

from fieldscore.operators import metrics, sampling
from fieldscore.sources import records as S


def test_ranks_of_one_large_group(spark):
    df = spark.createDataFrame([("hot", f"k{i:05}") for i in range(3000)] + [("b", "x"), (None, "y"), (None, "z")], "g string, k string").repartition(7)
    got = sampling.exact_ranks(df, "g", "k").collect()
    assert sorted((r.k, r["rank"]) for r in got if r.g == "hot") == [(f"k{i:05}", i) for i in range(3000)]
    assert {(r.k, r["rank"], r.rank_of) for r in got if r.g != "hot"} == {("x", 0, 1), ("y", 0, 2), ("z", 1, 2)} and sampling.exact_ranks(df.filter("false"), "g", "k").count() == 0


def test_plans(spark):
    rows = [(f"d{i:02}", f"c{i % 4 if i < 19 else 9}", f"k{i % 3}", "train" if i % 2 else "test", i) for i in range(20)]
    r = spark.createDataFrame(rows, "doc_id string, cluster_id string, keyset_id string, split string, n int")
    assert {(x.doc_id, x.cluster_id) for x in sampling.smoke_plan(r, extras=["d00"]).collect()} == {("d04", "c0"), ("d05", "c1"), ("d06", "c2"), ("d07", "c3"), ("d19", "c9"), ("d00", "c0")}
    assert {x.doc_id for x in sampling.pilot_plan(r).collect()} == {"d09", "d10", "d11"}
    more = r.withColumn("band", sampling.stratum(F.col("n")))
    filled = sampling.pilot_plan(more, strata="band", size=8)
    assert filled.count() == 8 and filled.select("doc_id").distinct().count() == 8
    s = sampling.stratified_round_robin(more, "band", 6, "s", split="train")
    assert s.count() == 6 and s.join(r.filter("split = 'test'"), "doc_id").count() == 0
    q = sampling.quota_sample(more, "band", {"large": 1, "single": 1}, "n", total=4)
    assert {x.doc_id for x in q.collect()} == {"d19", "d01", "d18", "d17"}
    b = {x.doc_id: x.batch for x in sampling.shuffle_batches(r, (3,), 5, "s").collect()}
    assert [sum(v == k for v in b.values()) for k in range(5)] == [3, 5, 5, 5, 2]
    assert [tuple(x) for x in sampling.top_counts(r, "keyset_id", 2).collect()] == [("k0", 7), ("k1", 7)]
    plan = sampling.main_plan(r, 2, "seed-b")
    found = {(x.seed, x.per_cluster): (x.n_plan, x.n_drawn, x.n_shared) for x in sampling.identify_draw(plan, r, ["seed-a", "seed-b"], [1, 2, 3]).collect()}
    n = plan.count()
    assert found[("seed-b", 2)] == (n, n, n) and found[("seed-b", 1)][2] == found[("seed-b", 1)][1] and found[("seed-b", 3)][2] == n and found[("seed-a", 2)][2] < n


def test_plan_files_and_materialised_documents(spark, tmp_path):
    ids = spark.createDataFrame([("b",), ("a",), (None,), ("a",)], "doc_id string")
    assert S.ids_digest(ids) == S.ids_digest(spark.createDataFrame([("a",), ("b",)], "doc_id string")) != S.ids_digest(ids.filter("doc_id = 'a'"))
    S.write_plan(spark, ids.filter("doc_id is not null").distinct(), str(tmp_path / "p"), {"seed": "s"})
    assert {(r.doc_id, r.seed) for r in spark.read.json(str(tmp_path / "p")).collect()} == {("a", "s"), ("b", "s")}
    with pytest.raises(Exception, match="exist"):
        S.write_plan(spark, ids, str(tmp_path / "p"), {})
    docs = spark.createDataFrame([("a", 1), ("b", 2)], "doc_id string, n int")
    assert S.materialise(docs, str(tmp_path / "m"), expected=2) == 2
    for bad in (lambda: S.materialise(docs.union(docs), str(tmp_path / "n")), lambda: S.materialise(docs, str(tmp_path / "n"), expected=3)):
        with pytest.raises(ValueError):
            bad()


def test_annotation_files_and_maps(spark, tmp_path):
    for split, stem in (("train", "7"), ("validation", "8")):
        folder = tmp_path / split / "annotations"
        folder.mkdir(parents=True)
        (folder / f"{stem}.json").write_text(json.dumps({"x": 1}, indent=1))
    assert {tuple(r)[0] for r in S.read_annotations(spark, f"{tmp_path}/*/annotations/*.json", split=True).collect()} == {"train-7", "dev-8"}
    assert [(r.doc_id, json.loads(r.annotation)) for r in S.read_annotations(spark, f"{tmp_path}/train/annotations/*.json").collect()] == [("7", {"x": 1})]
    (tmp_path / "leaves.tsv").write_text("# path\ttype\n\na.b\tstr\nc\tenum:x|y\n")
    assert S.read_leaf_paths(spark, str(tmp_path / "leaves.tsv")) == {"a.b": "str", "c": "enum:x|y"}
    (tmp_path / "run1" / "raw").mkdir(parents=True)
    (tmp_path / "run1" / "raw" / "d.json").write_text(json.dumps({"ok": True, "arms": {}}, indent=1))
    assert [(r.run_id, r.doc_id, r.ok) for r in S.read_runs(spark, str(tmp_path)).select("run_id", "doc_id", F.try_variant_get("result", "$.ok", "boolean").alias("ok")).collect()] == [("run1", "d", True)]
    pytest.importorskip("yaml")
    (tmp_path / "map.yaml").write_text("labels:\n- label: TOTAL\n  status: mapped\n  targets:\n  - {path: totals.x, parser: money_amount}\n  - {path: currency, parser: money_currency}\n- labels: [A, B]\n  status: unmapped\n")
    got = {tuple(r) for r in S.read_field_map(spark, str(tmp_path / "map.yaml")).collect()}
    assert got == {("TOTAL", "mapped", "totals.x", "money_amount"), ("TOTAL", "mapped", "currency", "money_currency"), ("A", "unmapped", None, None), ("B", "unmapped", None, None)}


def test_words_keep_their_order_on_the_page(spark):
    w = "array<struct<text:string,is_key:boolean>>"
    rows = [("d", 1, 0, "menu.nm", [("zebra", False), ("cake", False)], 0), ("d", 1, 0, "menu.nm", [("apple", False)], 1), ("d", 1, 0, "menu.price", [("Price", True), ("2.00", False)], 2)]
    df = spark.createDataFrame(rows, f"doc_id string, group_id int, sub_group_id int, category string, words {w}, pos int")
    assert S.regrouped_lines(df).first()["row"] == {"menu.nm": "zebra cake apple", "menu.price": "2.00"}
    b = spark.createDataFrame([("iVBORw0KGgo=",), ("data:image/png;base64,iVBORw0KGgo=",), ("no image!",), (None,)], "s string").select(S.image_kind(S.image_bytes(F.col("s"))))
    assert [r[0] for r in b.collect()] == ["png", "png", None, None]


def test_bootstrap_where_every_document_is_a_cluster(spark):
    v = spark.range(4000).selectExpr("'RAW' AS arm", "'p' AS path", "concat('c', id) AS cluster_id", "CASE WHEN id % 10 = 0 THEN 'wrong' ELSE 'correct' END AS state")
    r = metrics.bootstrap_intervals(v).first()
    assert r.n_clusters == 4000 and 0.885 < r.low < 0.895 and 0.905 < r.high < 0.915  # 0.9 +- 1.96 * 0.0047


def test_arms_of_run_files(spark):
    rows = [("r", "a", '{"ok": true, "arms": {"RAW": {"x": 1}, "_p": {}, "FINAL": null}}'), ("r", "b", '{"ok": false, "arms": {"RAW": {}}}'), ("r", "z", '{"ok": true, "arms": {"RAW": {}}}'), ("r", "c", "{")]
    runs = spark.createDataFrame(rows, "run_id string, doc_id string, t string").select("run_id", "doc_id", F.try_parse_json("t").alias("result"))
    records = spark.createDataFrame([("a",), ("b",), ("c",)], "doc_id string")
    assert [(r.doc_id, r.arm, r.p) for r in S.run_arms(runs, records).select("doc_id", "arm", F.to_json("payload").alias("p")).collect()] == [("a", "RAW", '{"x":1}')]
