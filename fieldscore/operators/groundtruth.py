"""Ground truth from raw annotations: labels to fields, conflicts resolved, three states kept apart.

The input is narrow: one row a printed label of a document (doc_id, template, label, raw). Labels meet a small rule
table, each written value one row; a field is resolved by one grouped pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldscore.functions.numbers import AMBIGUOUS
from fieldscore.functions.parsers import VERBATIM, parse, printed_symbol
from fieldscore.operators.compare import ABSENT


@dataclass(frozen=True)
class Rule:
    label: str
    path: str
    parser: str
    literal: str | None = None


# Which label writes which field through which parser.
INVOICE_RULES = tuple(Rule(*r) for r in (
    ("NUMBER", "invoiceInfo.documentNumber", "passthrough_strip"), ("PO_NUMBER", "invoiceInfo.purchaseOrderNumber", "passthrough_strip"),
    ("DATE", "invoiceInfo.issueDate", "passthrough_strip"), ("DATE", "invoiceInfo.issueDateISO", "date_to_iso"),
    ("DUE_DATE", "invoiceInfo.dueDate", "passthrough_strip"), ("DUE_DATE", "invoiceInfo.dueDateISO", "date_to_iso"),
    ("TOTAL", "totals.totalIncludingTax", "money_amount"), ("TOTAL", "currency", "money_currency"),
    ("AMOUNT_DUE", "totals.totalIncludingTax", "money_amount"), ("AMOUNT_DUE", "currency", "money_currency"),
    ("SUB_TOTAL", "totals.subtotal", "money_amount"), ("SUB_TOTAL", "currency", "money_currency"),
    ("TAX", "totals.taxName", "tax_name"), ("TAX", "totals.taxPercentage", "tax_pct"), ("TAX", "totals.taxAmount", "tax_amount"), ("TAX", "currency", "money_currency"),
    ("DISCOUNT", "totals.discountPercentage", "pct_in_parens"), ("DISCOUNT", "totals.discountTotal", "money_abs"),
))
SMALL_RECEIPT_RULES = tuple(Rule(*r) for r in (("company", "parties.seller.name", "passthrough_strip"), ("date", "receiptInfo.txnDate", "passthrough_strip"), ("address", "parties.seller.addressStructured", "address_whole"), ("total", "totals.totalIncludingTax", "money_amount")))
PARTY_LEAVES = {"Name": ("name", "passthrough_strip"), "Address": ("addressStructured", "address_whole"), "Tel": ("phone", "phone_verbatim"), "Email": ("email", "passthrough_strip")}


def party_roles(labels: Column) -> Column:
    """struct<seller, shipTo, customer, collision> of a document's party labels: which label fills which role.

    BILL_TO stands in for BUYER where there is no BUYER; both together exclude the customer.
    """
    has = lambda x: F.array_contains(labels, x)
    both = has("BUYER") & has("BILL_TO")
    return F.struct(
        F.when(has("SELLER"), F.lit("SELLER")).alias("seller"), F.when(has("SEND_TO"), F.lit("SEND_TO")).alias("shipTo"),
        F.when(~both & has("BUYER"), F.lit("BUYER")).when(~both & has("BILL_TO"), F.lit("BILL_TO")).alias("customer"), both.alias("collision"),
    )


def template_vocabulary(labels: DataFrame) -> DataFrame:
    """(template, label): every label that any document of the template prints."""
    return labels.select("template", "label").distinct()


def writes(labels: DataFrame, rules: tuple[Rule, ...] = INVOICE_RULES, verbatim: bool = False) -> DataFrame:
    """(doc_id, template, label, path, raw, value): each label's value for each field it writes, rules as one CASE."""
    swap = VERBATIM if verbatim else {}
    by_label: dict[str, list[Rule]] = {}
    for r in rules:
        by_label.setdefault(r.label, []).append(r)
    targets = F.when(F.lit(False), F.array().cast("array<struct<path:string,value:string>>"))
    for label, held in by_label.items():
        fields = [F.struct(F.lit(r.path).alias("path"), (F.lit(r.literal) if r.literal else parse(swap.get(r.parser, r.parser), F.col("raw"), F.col("label"))).cast("string").alias("value")) for r in held]
        targets = targets.when(F.col("label") == label, F.array(*fields))
    return labels.select("doc_id", "template", "label", "raw", F.inline(targets))


def resolve(labels: DataFrame, rules: tuple[Rule, ...] = INVOICE_RULES, verbatim: bool = False, excluded: DataFrame | None = None) -> DataFrame:
    """(doc_id, path, value, state, reason): present, absent or excluded, for each field of the template's vocabulary.

    Several different values exclude a field as conflicting; a printed but unreadable value excludes it too; a field
    of the vocabulary that the document doesn't print is absent; other fields have no row. For currencies an ISO code
    beats bare symbols, one symbol alone stays as printed, several exclude the field. ``excluded`` (doc_id, path) are
    known defects.
    """
    w = writes(labels, rules, verbatim)
    vocabulary = template_vocabulary(labels).join(labels.sparkSession.createDataFrame(sorted({(r.label, r.path) for r in rules}), "label string, path string"), "label").select("template", "path").distinct()
    expected = labels.select("doc_id", "template").distinct().join(vocabulary, "template").select("doc_id", "path")
    found = w.groupBy("doc_id", "path").agg(
        F.collect_set("value").alias("values"), F.collect_set(F.when(F.col("value") == AMBIGUOUS, printed_symbol(F.col("raw")))).alias("signs"),
        F.max(F.col("value").isNull() & (F.trim(F.coalesce("raw", F.lit(""))) != "")).alias("unreadable"),
    )
    clear = F.filter("values", lambda v: v != AMBIGUOUS)
    values = F.when(F.col("path") != "currency", F.col("values")).when(F.size(clear) > 0, clear).otherwise(F.col("signs"))
    r = expected.join(found, ["doc_id", "path"], "left").withColumn("vs", F.coalesce(values, F.array().cast("array<string>")))
    state = (
        F.when(F.size("vs") == 1, "present")
        .when(F.size("vs") > 1, "excluded")
        .when(F.coalesce("unreadable", F.lit(False)), "excluded")
        .otherwise("absent")
    )
    reason = F.when(F.size("vs") > 1, F.when(F.col("path") == "currency", "several currencies").otherwise("conflicting labels")).when((F.size("vs") == 0) & F.coalesce("unreadable", F.lit(False)), "unreadable value")
    out = r.select("doc_id", "path", F.when(F.size("vs") == 1, F.get("vs", F.lit(0))).when(state == "absent", ABSENT).alias("value"), state.alias("state"), reason.alias("reason"))
    return out if excluded is None else out.join(excluded.select("doc_id", "path"), ["doc_id", "path"], "left_anti")


def keyed_rows(occurrences: DataFrame, by: list[str]) -> DataFrame:
    """One row a distinct amount (by..., value) in printed order: the first caption names it, a restatement is no row.

    A rate at the end of a caption is split off into ``percentage``, the whole caption kept as ``key_alt``.
    """
    w = Window.partitionBy(*by, "value").orderBy("pos")
    first = occurrences.filter(F.col("value").isNotNull()).withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
    name = F.regexp_extract("caption", r"^(.*?)[\s:]*(\d+(?:[.,]\d+)?\s*%)\s*$", 1)
    rate = F.regexp_extract("caption", r"^(.*?)[\s:]*(\d+(?:[.,]\d+)?\s*%)\s*$", 2)
    split = F.trim(name) != ""
    return first.withColumns({"key": F.when(split, F.trim(name)).otherwise(F.trim("caption")), "key_alt": F.when(split, F.trim("caption")), "percentage": F.when(split, F.trim(rate))})


def without_unattributable(rows: DataFrame, by: list[str], identity: list[str], cells: list[str]) -> DataFrame:
    """Rows that agree on ``identity`` but not on a cell lose that cell: nothing tells which of them it belongs to."""
    w = Window.partitionBy(*by, *identity)
    wide = rows.withColumns({f"__{c}": (F.count("*").over(w) > 1) & (F.min(F.coalesce(F.col(c).cast("string"), F.lit("\0"))).over(w) != F.max(F.coalesce(F.col(c).cast("string"), F.lit("\0"))).over(w)) for c in cells})
    dropped = F.array_compact(F.array(*[F.when(F.col(f"__{c}"), F.lit(c)) for c in cells]))
    return wide.withColumn("dropped", dropped).withColumns({c: F.when(~F.col(f"__{c}"), F.col(c)) for c in cells}).drop(*[f"__{c}" for c in cells])
