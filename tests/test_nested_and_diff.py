import json

from pyspark.sql import functions as F

from fieldscore.operators.current import current_rows
from fieldscore.operators.diff import Reader, PayloadForm, json_differences
from fieldscore.operators.nested import doc_result_roots, nested_tables, node_links

SCHEMA = "run_id string, doc_id string, arms string, judge string, node_path string, position int"


def links(spark, arms=None, judge=None):
    df = spark.createDataFrame([("r", "d", arms, judge, "clash", 7)], SCHEMA)
    return {(x.node_path, x.parent_path) for x in node_links(df, ["run_id", "doc_id"], doc_result_roots()).collect()}


def test_links_and_positions(spark):
    arms = {"FINAL": {"invoiceOutputData": {"lineItems": [None, {"modifiers": [{"k": 1}, 5, {"k": 2}]}], "totals": {"taxes": {"key": "VAT"}, "otherCharges": []}}}, "_debug": {"lineItems": [{}]}}
    judge = {"issues": {"totals": {"field": "x", "evidence": {"arm": "RAW"}}, "parties": [{"field": "y"}, {"field": "z", "evidence": [{"a": 1}]}], "none": None}}
    assert links(spark, json.dumps(arms), json.dumps(json.dumps(judge))) == {
        ("FINAL.lineItems[1]", "FINAL"), ("FINAL.lineItems[1].modifiers[0]", "FINAL.lineItems[1]"), ("FINAL.lineItems[1].modifiers[2]", "FINAL.lineItems[1]"), ("FINAL.totals.taxes[0]", "FINAL"),
        ("judge.issues.totals[0]", "judge"), ("judge.issues.totals[0].evidence[0]", "judge.issues.totals[0]"), ("judge.issues.parties[0]", "judge"), ("judge.issues.parties[1]", "judge"),
        ("judge.issues.parties[1].evidence[0]", "judge.issues.parties[1]"),
    }


def test_json_in_strings(spark):
    inner = json.dumps({"lineItems": json.dumps([{"a": 1}])})
    assert links(spark, json.dumps({"RAW": inner})) == {("RAW.lineItems[0]", "RAW")}


def test_unreadable_null_and_empty(spark):
    for text in (None, "", "{", "[]", "3", '"x"', "{}", '{"RAW": null}', '{"RAW": []}'):
        assert links(spark, text, text) == set()


def test_tables_of_an_empty_frame(spark):
    df = spark.createDataFrame([], SCHEMA)
    tables = nested_tables(df, ["run_id", "doc_id"], doc_result_roots())
    assert set(tables) == {"line_items", "modifiers", "charges", "taxes", "issues", "evidence"}
    assert all(t.count() == 0 for t in tables.values())


def test_very_long_lists(spark):
    arms = json.dumps({"RAW": {"lineItems": [{"n": i} for i in range(5000)]}})
    assert len(links(spark, arms)) == 5000


def test_current_rows(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("b", None, "z"), (None, 1, "n"), (None, 3, "m")]
    df = spark.createDataFrame(rows, "k string, t int, __rank string")
    assert {(r[0], r[1], r[2]) for r in current_rows(df, ["k"], "t").collect()} == {("a", 2, "y"), ("b", None, "z"), (None, 3, "m")}
    assert current_rows(df.filter("false"), ["k"], "t").count() == 0


def diff(spark, left, right):
    a = spark.createDataFrame(left, "run_id string, doc_id string, arms string, ok boolean, t int, leaf string, n int")
    b = spark.createDataFrame(right, "run_id string, doc_id string, arms string, t int, leaf_path string")
    out = json_differences(a, b, ["run_id", "doc_id"], "arms", "t", "t", left_filter=F.col("ok"), left_columns=("ok",))
    return {tuple(r) for r in out.collect()}


def test_differences(spark):
    x = json.dumps({"RAW": {"a": 14, "b": "x", "c": None, "lineItems": {"q": 1}, "only": True}, "_d": 1})
    y = json.dumps({"RAW": json.dumps({"invoiceOutputData": {"lineItems": [{"q": 1.0}], "b": "X", "c": None, "a": 1.4e1, "new": [1, {"z": False}]}})})
    got = diff(spark, [("r", "d", x, True, 1, "", 0), ("r", "d", "{}", True, 0, "", 0), ("r", "l", x, True, 1, "", 0), ("r", "bad", x, False, 1, "", 0)], [("r", "d", y, 1, ""), ("r", "d", y, 1, ""), ("r", "r", y, 1, "")])
    assert got == {("r", "d", "RAW.b", "differs"), ("r", "d", "RAW.only", "leaf_only_run"), ("r", "d", "RAW.new[0]", "leaf_only_app"), ("r", "d", "RAW.new[1].z", "leaf_only_app"), ("r", "l", "", "only_run"), ("r", "r", "", "only_app")}


def test_difference_of_types_nulls_and_empty(spark):
    assert diff(spark, [("r", "d", '{"A": {"x": 1}}', True, 1, "", 0)], [("r", "d", '{"A": {"x": "1"}}', 1, "")]) == {("r", "d", "A.x", "differs")}
    assert diff(spark, [("r", "d", '{"A": {"x": 1}}', True, 1, "", 0)], [("r", "d", '{"A": {"x": true}}', 1, "")]) == {("r", "d", "A.x", "differs")}
    assert diff(spark, [("r", None, None, True, None, "", 0)], [("r", None, "", None, "")]) == set()
    assert diff(spark, [("r", "d", "{", True, 1, "", 0)], [("r", "d", '{"A": {"x": null}}', 1, "")]) == {("r", "d", "A.x", "leaf_only_app")}
    assert diff(spark, [], []) == set()
    assert diff(spark, [], [("r", "d", None, 1, "")]) == {("r", "d", "", "only_app")}


def test_numbers_by_value():
    r = Reader(PayloadForm())
    same = ['{"A": {"x": 14}}', '{"A": {"x": 14.0}}', '{ "A" : {"x": 1.4e1} }', '{"A": {"x": 14.00000000000000000000}}']
    assert len({r.digest(t) for t in same}) == 1
    assert r.digest('{"A": {"x": 0.1}}') != r.digest('{"A": {"x": 0.10000000000000000001}}')
    assert r.digest('{"A": {"x": 123456789012345678901}}') != r.digest('{"A": {"x": 123456789012345678902}}')


def test_typed_tables_scalars_and_undeclared_arrays(spark):
    from fieldscore.operators import nested as N

    arms = '{"RAW": {"lineItems": [{"description": "a", "quantity": {"originalValue": "2", "normalizedValue": 2}, "modifiers": ["extra", {"key": "k"}]}, "loose", null, 7], "parties": {"seller": {"phones": ["1", "2"]}}}, "_x": {"parts": [{"n": 1}]}}'
    judge = '{"issues": {"totals": [{"field": "f", "corrected_value": {"originalValue": "3"}}, {"field": "g", "corrected_value": "4"}]}}'
    df = spark.createDataFrame([("r", arms, judge, 5), ("s", None, "", 6)], "run string, arms string, judge string, position int")
    t = N.typed_tables(df, ["run"], N.doc_result_roots())
    (row,) = t["line_items"].collect()
    assert (row.node_path, row.description, row.quantity_printed, row.quantity_value, row.position) == ("RAW.lineItems[0]", "a", "2", 2.0, 0)
    assert [(x.parent_path, x.key, x.position) for x in t["modifiers"].collect()] == [("RAW.lineItems[0]", "k", 1)]
    assert {(x.field, x.corrected_printed, x.corrected_text) for x in t["issues"].collect()} == {("f", "3", None), ("g", None, "4")}
    got = {(x.node_path, x.parent_path, x.value) for x in N.scalar_elements(df, ["run"], N.doc_result_roots()).collect()}
    assert got == {("RAW.lineItems[1]", "RAW", '"loose"'), ("RAW.lineItems[3]", "RAW", "7"), ("RAW.lineItems[0].modifiers[0]", "RAW.lineItems[0]", '"extra"')}
    paths = {x.array_path: (x.n_elements, x.declared) for x in N.array_paths(df, "arms", ("lineItems", "lineItems[].modifiers")).collect()}
    assert paths == {"RAW.lineItems": (4, True), "RAW.lineItems[].modifiers": (2, True), "RAW.parties.seller.phones": (2, False), "_x.parts": (1, False)}


def test_stream_equals_batch(spark, tmp_path):
    """Rows that are replaced in the same file and in a later one, by rows that are ok and by such that aren't."""
    from fieldscore.operators.verdicts import verdicts
    from fieldscore.streaming.verdict_stream import run_to_table

    gt = spark.createDataFrame([("d", "c", "invoice", "s", {"currency": "EUR"}, ["currency"], {}, "{}", 1), ("e", "c", "invoice", "s", {"currency": "USD"}, ["currency"], {}, "{}", 1)], "doc_id string, cluster_id string, doc_type string, source_dataset string, gt map<string,string>, annotated_fields array<string>, excluded_fields map<string,string>, meta string, received_at int")
    one = lambda d, c, t, ok=True: ("r", d, ok, f'{{"FINAL": {{"currency": "{c}"}}}}', t)
    files = [[one("d", "EUR", 1), one("d", "USD", 2), one("e", "USD", 5)], [one("d", "EUR", 3), one("e", "GBP", 4)], [one("e", "USD", 6, False)], [one("d", "GBP", 1)]]
    schema = "run_id string, doc_id string, ok boolean, arms string, written_at int"
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}.parquet"))
    flat = tmp_path / "flat"
    flat.mkdir()
    for i in range(len(files)):
        next((tmp_path / "in" / f"{i}.parquet").glob("*.parquet")).rename(flat / f"{i}.parquet")
    got = sorted((x.doc_id, x.path, x.state) for x in run_to_table(spark, str(flat), gt).collect())
    want = sorted((x.doc_id, x.path, x.state) for x in verdicts(gt, spark.read.parquet(str(flat))).collect())
    assert got == want == [("d", "currency", "correct")]
