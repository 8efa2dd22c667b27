from dataclasses import replace

import pytest

from fieldscore.operators import rules as R
from fieldscore.operators.verdicts import verdicts


@pytest.mark.parametrize(
    "path, declared, want",
    [
        ("totals.otherCharges[].key", "numeric", R.CHARGE_LABEL), ("invoiceInfo.issueDateISO", "numeric", R.NUMERIC), ("currency", "enum:EUR|USD", R.ENUM), ("currency", "bool", R.BOOL), ("currency", "str", R.CURRENCY),
        ("invoiceInfo.issueDateISO", "str", R.DATE_ISO), ("invoiceInfo.issueDate", "str", R.DATE_RAW), ("parties.seller.addressStructured", "str", R.ADDRESS), ("parties.seller.addressStructured.address", "str", R.ADDRESS),
        ("parties.seller.addressStructured.city", "str", R.TEXT), ("parties.seller.phone", "str", R.PHONE), ("x.email", "str", R.EMAIL), ("invoiceInfo.documentNumber", "str", R.IDENTIFIER), ("parties.seller.name", "str", R.TEXT),
    ],
)
def test_precedence(path, declared, want):
    assert R.rule_for(path, declared, R.INVOICE) == want


def test_contained_names_of_receipts():
    assert R.rule_for("parties.seller.name", "str", R.RECEIPT) == R.TEXT_CONTAINED


def test_merged_targets_are_joined_from_their_sources(spark, monkeypatch):
    spec = replace(R.INVOICE, merged_targets={"parties.seller.full": ("parties.seller.name", "parties.seller.email")})
    monkeypatch.setitem(R.DOC_TYPES, "invoice", spec)
    assert R.rule_registry(spec)["parties.seller.full"] == R.TEXT_CONTAINED and "parties.seller.name" not in R.rule_registry(spec)
    assert {"parties.seller.name", "totals.taxAmount", "parties.seller.addressStructured.city"} <= R.consumed_paths(spec) and "parties.seller.full" not in R.consumed_paths(spec)
    gt = spark.createDataFrame([(d, "c", "invoice", "s", {"parties.seller.full": "A Shop a@b.example"}, ["parties.seller.full"], {}, "{}", 1) for d in "xyz"], "doc_id string, cluster_id string, doc_type string, source_dataset string, gt map<string,string>, annotated_fields array<string>, excluded_fields map<string,string>, meta string, received_at int")
    arms = {"x": '{"F": {"parties": {"seller": {"name": " A Shop ", "email": "a@b.example"}}}}', "y": '{"F": {"parties": {"seller": {"name": "A Shop", "email": " "}}}}', "z": '{"F": {"parties": {"seller": {"name": null}}}}'}
    res = spark.createDataFrame([("r", d, True, a, 1) for d, a in arms.items()], "run_id string, doc_id string, ok boolean, arms string, written_at int")
    assert {(r.doc_id, r.state) for r in verdicts(gt, res).select("doc_id", "state").collect()} == {("x", "correct"), ("y", "wrong"), ("z", "missing")}
