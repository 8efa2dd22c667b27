import json

from fieldscore.operators import adapters as A


def docs(spark, rows):
    return spark.createDataFrame([(k, json.dumps(v) if v is not None else None) for k, v in rows.items()], "doc_id string, annotation string")


def line(category, value, caption=""):
    return {"category": category, "words": [{"text": w, "is_key": True} for w in caption.split()] + [{"text": w, "is_key": False} for w in value.split()]}


RECEIPTS = {
    "a": {
        "gt_parse": {
            "menu": [{"nm": "SALMON", "cnt": "2 x", "price": "85,500", "itemsubtotal": "1"}, {"nm": "TEA", "itemsubtotal": "3.000", "discountprice": "10%"}, {"cnt": "1"}, {"nm": ["X", "Y"], "num": "7", "unitprice": "1.2345"}],
            "sub_total": [{"subtotal_price": "1"}, {"discount_price": "-2,000"}], "total": {"total_price": "51.300", "cashprice": ["1", "2"]},
        },
        "valid_line": [line("sub_total.subtotal_price", "46.636", "TOTAL"), line("sub_total.subtotal_price", "46.636", "DPP"), line("sub_total.tax_price", "4.664", "PB1 10%"), line("sub_total.service_price", "abc", "SVC")],
    },
    "b": {"gt_parse": {"menu": {"nm": "PESTO", "price": "1.000"}, "sub_total": {"tax_price": ["1,000", "1,000"]}}},
    "c": {"gt_parse": {"menu": [{"nm": "P", "cnt": "1", "price": "9.000"}, {"nm": "P", "cnt": "1", "price": "9.000", "discountprice": "9.000"}]}},
    "d": None,
}


def test_receipts(spark):
    values, items, keyed = A.receipt_truth(docs(spark, RECEIPTS))
    v = {(r.doc_id, r.path): (r.value, r.state) for r in values.collect()}
    assert v[("a", "totals.totalIncludingTax")] == ("51300.00", "present") and v[("a", "totals.discountTotal")] == ("2000.00", "present")
    assert v[("a", "totals.cash")] == (None, "excluded") and ("a", "totals.change") not in v and v[("a", "lineItems[2]")][1] == "excluded" and v[("a", "lineItems[3].description")][1] == "excluded" and v[("a", "lineItems[3].unitPrice")][1] == "excluded"
    i = {(r.doc_id, r.row): r for r in items.collect()}
    assert (i["a", 0].quantity, i["a", 0].lineTotal) == ("2.00", "85500.00") and (i["a", 1].lineTotal, i["a", 1].discountPercent, i["a", 1].discountAmount) == ("3000.00", "10.00", None)
    assert ("a", 2) not in i and i["a", 3].itemCode == "7" and i["b", 0].description == "PESTO"
    assert i["c", 1].discountAmount is None and v[("c", "lineItems[1].discountAmount")][1] == "excluded"
    k = {(r.doc_id, r.section): (r.key, r.key_alt, r.value, r.percentage) for r in keyed.collect()}
    assert k == {("a", "totals.subtotal"): ("TOTAL", None, "46636.00", None), ("a", "totals.taxes"): ("PB1", "PB1 10%", "4664.00", "10.00"), ("b", "totals.taxes"): ("tax", None, "1000.00", None)}
    assert v[("a", "totals.subtotal[DPP]")][1] == "excluded" and v[("a", "totals.otherCharges[SVC]")][1] == "excluded"
    printed = {(r.doc_id, r.path): r.value for r in A.receipt_truth(docs(spark, RECEIPTS), verbatim=True)[0].collect()}
    assert printed[("a", "totals.totalIncludingTax")] == "51.300"


def test_small_receipts(spark):
    v = {(r.doc_id, r.path): (r.value, r.state) for r in A.small_receipt_truth(docs(spark, {"a": {"key_value_pairs": {"company": " My  Shop ", "total": "none", "date": " "}}, "b": {}})).collect()}
    assert v[("a", "parties.seller.name")] == ("My Shop", "present") and v[("a", "totals.totalIncludingTax")] == (None, "excluded") and v[("a", "receiptInfo.txnDate")] == ("__ABSENT__", "absent") and v[("b", "parties.seller.name")] == ("__ABSENT__", "absent")


INVOICES = {
    "T1_I0": {"Image_Name": "x", "NUMBER": " 12 ", "DATE": "20-Mar-2008", "TOTAL": "TOTAL : 734.33 EUR", "SELLER": {"Name": "S", "Address": "1 A St", "Email": "m@x.example"}, "BUYER": {"Name": "B", "Address": "1 A St", "Tel": "+1 22"}, "GST(12.5%)": "GST(12.5%) : 3.00", "_line_items_status": "ok", "LINE_ITEMS": [{"description": " a  b ", "quantity": "2", "price": "1.50"}, 7]},
    "T1_I1": {"NUMBER": "13", "TOTAL": "TOTAL : 9.00 EUR", "AMOUNT_DUE": "DUE : 8.00 EUR", "BUYER": {"Name": "B"}, "BILL_TO": {"Name": "C"}, "GST(18%)": "GST(18%) : 1.00", "TAX": "VAT (5.99%): 2.00 EUR"},
    "T1_I2": {"NUMBER": "14", "TOTAL": "no digits"},
}


def test_invoices(spark):
    values, lines, notes = A.invoice_truth(docs(spark, INVOICES))
    v = {(r.doc_id, r.path): (r.value, r.state) for r in values.collect()}
    assert v[("T1_I0", "invoiceInfo.documentNumber")] == ("12", "present") and v[("T1_I0", "invoiceInfo.issueDateISO")] == ("2008-03-20", "present") and v[("T1_I1", "invoiceInfo.issueDate")] == ("__ABSENT__", "absent")
    assert v[("T1_I0", "totals.taxPercentage")] == ("12.50", "present") and v[("T1_I0", "totals.taxName")] == ("GST", "present") and v[("T1_I0", "totals.taxAmount")] == ("3.00", "present")
    assert all(v[("T1_I1", p)] == (None, "excluded") for p in (*A.TAX_PATHS, "parties.customer.name", "totals.totalIncludingTax"))
    assert v[("T1_I2", "totals.totalIncludingTax")] == (None, "excluded") and v[("T1_I2", "parties.seller.email")] == ("__ABSENT__", "absent") and v[("T1_I0", "parties.seller.addressStructured")][1] == "present"
    assert v[("T1_I0", "parties.customer.phone")] == ("+1 22", "present") and ("T1_I0", "parties.seller.phone") not in v
    assert [(r.pos, r.key, r.percentage, r.amount) for r in lines.orderBy("pos").collect()] == [(1, "GST(18%)", "18.00", "1.00"), (2, "VAT(5.99%)", "5.99", "2.00")]
    assert {tuple(r) for r in notes.collect()} == {("T1_I0", "seller_equals_buyer_address"), ("T1_I1", "multi_tax_template"), ("T1_I2", "no_tax_label")}
    assert [tuple(r) for r in A.invoice_line_items(docs(spark, INVOICES)).collect()] == [("T1_I0", 0, "a b", "2.00", "1.50")]
    r = {x.doc_id: x for x in A.records(values, docs(spark, INVOICES).select("doc_id")).collect()}
    assert r["T1_I0"].gt["totals.totalIncludingTax"] == "734.33" and "totals.taxName" in r["T1_I1"].excluded_fields and not set(r["T1_I1"].annotated_fields) & set(r["T1_I1"].excluded_fields)


def test_contract(spark):
    said = spark.createDataFrame([("NUMBER", "mapped"), ("SITE", "unmapped"), ("OLD", "mapped")], "label string, status string")
    assert A.contract_faults(said, ["NUMBER", "SITE"], {"a.b.c"}, ["a.b", "x"]) == ["label OLD is mapped but has no rule", "label SITE has a rule but is unmapped", "path x isn't in the schema"]
