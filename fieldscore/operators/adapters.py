"""Ground truth from the raw annotations of three kinds of corpora: word-level receipts, small receipts, flat invoices.

Input is one row a document: (doc_id, annotation), the annotation's JSON as text. Annotations stay in the row as Variants
and come out as long tables: values (doc_id, path, value, state, reason) and rows of repeated sections. Nothing is
shuffled but by document, and the vocabulary of invoice templates, which is small, is broadcast only if it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldscore.functions.parsers import GST_LABEL, VERBATIM, parse
from fieldscore.functions.text import blank_to_null, squeeze
from fieldscore.operators.compare import ABSENT
from fieldscore.operators.groundtruth import INVOICE_RULES, PARTY_LEAVES, SMALL_RECEIPT_RULES, Rule, keyed_rows, party_roles, resolve, without_unattributable

# Which receipt label feeds which cell, section and field through which parser.
RECEIPT_CELLS = (
    ("nm", "description", "cord_text"), ("num", "itemCode", "passthrough_strip"), ("cnt", "quantity", "cord_qty"), ("unitprice", "unitPrice", "cord_money"), ("price", "lineTotal", "cord_money"),
    ("itemsubtotal", "lineTotal", "cord_money"), ("discountprice", "discountAmount", "cord_money_abs"), ("discountprice", "discountPercent", "cord_percent"),
)
RECEIPT_KEYED = {
    "sub_total.subtotal_price": ("totals.subtotal", "subtotal"), "sub_total.tax_price": ("totals.taxes", "tax"),
    "sub_total.service_price": ("totals.otherCharges", "service"), "sub_total.othersvc_price": ("totals.otherCharges", "other service"),
}
RECEIPT_SCALARS = {
    "total.total_price": ("totals.totalIncludingTax", "cord_money"), "total.cashprice": ("totals.cash", "cord_money"),
    "total.changeprice": ("totals.change", "cord_money"), "sub_total.discount_price": ("totals.discountTotal", "cord_money_abs"),
}
GST_RULES = (Rule("GST", "totals.taxName", "literal", "GST"), Rule("GST", "totals.taxPercentage", "rate_from_key"), Rule("GST", "totals.taxAmount", "money_amount"))
PARTY_LABELS = {"SELLER": ("Name", "Address", "Email"), "BUYER": ("Name", "Address", "Tel", "Email"), "BILL_TO": ("Name", "Address", "Tel", "Email"), "SEND_TO": ("Name", "Address", "Tel", "Email")}
TAX_PATHS = ("totals.taxName", "totals.taxPercentage", "totals.taxAmount")

ITEM_CELLS = tuple(dict.fromkeys(c for _, c, _ in RECEIPT_CELLS))
IDENTITY = ("description", "itemCode", "quantity", "unitPrice", "lineTotal")
_LIST = "array<variant>"


def _kind(v: Column) -> Column:
    return F.substring_index(F.schema_of_variant(v), "<", 1)


def _elements(v: Column) -> Column:
    """The objects of a value that is one or a list of them."""
    held = F.coalesce(F.try_variant_get(v, "$", _LIST), F.when(_kind(v) == "OBJECT", F.array(v)), F.array().cast(_LIST))
    return F.filter(held, lambda x: x.isNotNull() & (_kind(x) == "OBJECT"))


def _text(v: Column) -> Column:
    """A scalar's text; null for lists, objects and null."""
    return F.when(~_kind(v).isin("ARRAY", "OBJECT", "VOID"), F.try_variant_get(v, "$", "string"))


def exclusion_reason(v: Column) -> Column:
    """Why a value that is there isn't used."""
    return F.when(_kind(v) == "ARRAY", "printed more than once, ambiguous").otherwise(F.concat(F.lit("unparseable: "), F.substring(F.coalesce(_text(v), F.lit("")), 1, 40)))


def _stored(v: Column, parser: str, verbatim: bool) -> Column:
    """What is stored for a receipt value: its amount, or as printed; a list is refused either way."""
    raw = _text(v)
    return blank_to_null(squeeze(raw)) if verbatim else parse(parser, raw)


def _last_of(sections: Column, leaf: str) -> Column:
    """A key of a section that may be printed twice: the last block that has it counts."""
    return F.try_element_at(F.filter(F.transform(sections, lambda x: F.try_variant_get(x, f"$.{leaf}", "variant")), lambda y: y.isNotNull()), F.lit(-1))


def receipt_items(docs: DataFrame, verbatim: bool = False) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, <cells>) of the menu lines that can be aligned, and (doc_id, path, reason) of what was left out.

    The price beats the line's subtotal; a discount with a percent sign is a percentage, else an amount; a line without
    description and code is dropped with a reason, as is a cell that tells apart lines which are else alike.
    """
    menu = docs.select("doc_id", F.posexplode(_elements(F.try_variant_get("parse", "$.menu", "variant"))).alias("row", "src"))
    src = lambda k: F.try_variant_get("src", f"$.{k}", "variant")
    has_percent = F.coalesce(_text(src("discountprice")).contains("%"), F.lit(False))
    tries: dict[str, list[tuple[Column, Column]]] = {}
    for key, cell, parser in RECEIPT_CELLS:
        v = src(key)
        meant = (F.lit(True) if key != "discountprice" else has_percent if parser == "cord_percent" else ~has_percent) & v.isNotNull()
        tries.setdefault(cell, []).append((F.when(meant, _stored(v, parser, verbatim)), F.when(meant, exclusion_reason(v))))
    cells = {c: F.coalesce(*[v for v, _ in t]) for c, t in tries.items()}
    wide = menu.select("doc_id", "row", *[v.alias(c) for c, v in cells.items()], *[F.when(cells[c].isNull(), F.coalesce(*[r for _, r in t])).alias(f"__{c}") for c, t in tries.items()])
    known = F.coalesce(F.col("description"), F.col("itemCode")).isNotNull()
    path = lambda c: F.concat(F.lit("lineItems["), F.col("row").cast("string"), F.lit("]" + (f".{c}" if c else "")))
    refused = [F.when(F.col(f"__{c}").isNotNull(), F.struct(path(c).alias("path"), F.col(f"__{c}").alias("reason"))) for c in ITEM_CELLS]
    lone = F.when(~known, F.struct(path("").alias("path"), F.lit("row has nothing to align on").alias("reason")))
    out = wide.select("doc_id", F.inline(F.array_compact(F.array(*refused, lone))))
    rows = without_unattributable(wide.filter(known).select("doc_id", "row", *ITEM_CELLS), ["doc_id"], list(IDENTITY), ["discountAmount", "discountPercent"])
    dropped = rows.select("doc_id", "row", F.explode("dropped").alias("c")).select("doc_id", F.concat(F.lit("lineItems["), F.col("row").cast("string"), F.lit("]."), F.col("c")).alias("path"), F.lit("rows can't be told apart").alias("reason"))
    return rows.drop("dropped"), out.unionByName(dropped)


def receipt_occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, label, pos, caption, printed): every printed amount of a keyed section in page order with the words that
    name it; where no words are annotated the parsed values stand in, without a caption."""
    words = "array<struct<text:string,is_key:boolean>>"
    lines = docs.select("doc_id", F.posexplode(_elements(F.try_variant_get("annotation", "$.valid_line", "variant"))).alias("pos", "line"))
    held = F.coalesce(F.try_variant_get("line", "$.words", words), F.array().cast(words))
    said = lambda keep: F.trim(F.array_join(F.transform(F.filter(held, keep), lambda w: F.coalesce(w["text"], F.lit(""))), " "))
    own = lines.select("doc_id", F.try_variant_get("line", "$.category", "string").alias("label"), "pos", said(lambda w: F.coalesce(w["is_key"], F.lit(False))).alias("caption"), said(lambda w: ~F.coalesce(w["is_key"], F.lit(False))).alias("printed"))
    own = own.filter(F.col("label").isin(*RECEIPT_KEYED) & (F.col("printed") != ""))
    section = F.array(*[F.struct(F.lit(label).alias("label"), _last_of(_elements(F.try_variant_get("parse", f"$.{label.split('.')[0]}", "variant")), label.split(".")[1]).alias("v")) for label in RECEIPT_KEYED])
    parsed = docs.select("doc_id", F.inline(section)).filter("v is not null").select("doc_id", "label", F.posexplode(F.coalesce(F.try_variant_get("v", "$", _LIST), F.array("v"))).alias("pos", "x"))
    rest = parsed.select("doc_id", "label", "pos", F.lit("").alias("caption"), _text(F.col("x")).alias("printed"))
    return own.unionByName(rest.join(own.select("doc_id", "label").distinct(), ["doc_id", "label"], "left_anti"))


def receipt_keyed(docs: DataFrame, verbatim: bool = False) -> tuple[DataFrame, DataFrame]:
    """(doc_id, section, pos, key, key_alt, value, percentage), one row a distinct amount of a label, and what was left out."""
    to = F.create_map(*[F.lit(x) for k, (section, name) in RECEIPT_KEYED.items() for x in (k, f"{section}|{name}")])
    o = receipt_occurrences(docs).withColumn("__to", F.split(F.try_element_at(to, F.col("label")), r"\|"))
    o = o.select("doc_id", "label", "pos", F.col("__to")[0].alias("section"), F.coalesce(blank_to_null(F.trim("caption")), F.col("__to")[1]).alias("caption"), "printed")
    o = o.withColumn("value", blank_to_null(squeeze(F.col("printed"))) if verbatim else parse("cord_money", F.col("printed")))
    rows = keyed_rows(o, ["doc_id", "label"])
    rate = F.col("percentage") if verbatim else parse("cord_percent", F.col("percentage"))
    kept = rows.select("doc_id", "section", "label", "pos", "key", "key_alt", "value", F.when(F.col("section") == "totals.taxes", rate).alias("percentage"))
    name = F.concat("section", F.lit("["), "caption", F.lit("]"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "label", "value").orderBy("pos"))
    again = o.withColumn("nth", nth).filter("value is null or nth > 1").select("doc_id", name.alias("path"), F.when(F.col("value").isNull(), F.concat(F.lit("unparseable: "), F.substring("printed", 1, 40))).otherwise("the same amount printed again").alias("reason"))
    return kept, again


def receipt_truth(annotations: DataFrame, verbatim: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Values, menu rows and keyed rows of word-level receipts. A label that a receipt doesn't print says nothing about its
    field (no row); one that can't be read excludes it."""
    docs = annotations.select("doc_id", F.try_parse_json("annotation").alias("annotation")).withColumn("parse", F.try_variant_get("annotation", "$.gt_parse", "variant"))
    items, left = receipt_items(docs, verbatim)
    keyed, also = receipt_keyed(docs, verbatim)
    fields = []
    for label, (path, parser) in RECEIPT_SCALARS.items():
        section, leaf = label.split(".")
        v = _last_of(_elements(F.try_variant_get("parse", f"$.{section}", "variant")), leaf)
        value = _stored(v, parser, verbatim)
        fields.append(F.when(v.isNotNull(), F.struct(F.lit(path).alias("path"), value.alias("value"), F.when(value.isNull(), "excluded").otherwise("present").alias("state"), F.when(value.isNull(), exclusion_reason(v)).alias("reason"))))
    scalars = docs.select("doc_id", F.inline(F.array_compact(F.array(*fields))))
    json_rows = items.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", *ITEM_CELLS))), lambda r: F.struct(*[r[c].alias(c) for c in ITEM_CELLS])).alias("r"))  # as many as a receipt prints
    listed = json_rows.select("doc_id", F.lit("lineItems").alias("path"), F.to_json("r").alias("value"), F.lit("present").alias("state"), F.lit(None).cast("string").alias("reason"))
    refused = left.unionByName(also).select("doc_id", "path", F.lit(None).cast("string").alias("value"), F.lit("excluded").alias("state"), "reason")
    return scalars.unionByName(listed).unionByName(refused), items, keyed


def small_receipt_truth(annotations: DataFrame) -> DataFrame:
    """(doc_id, path, value, state, reason) of small receipts: a label that isn't there means the page doesn't print it."""
    docs = annotations.select("doc_id", F.try_variant_get(F.try_parse_json("annotation"), "$.key_value_pairs", "map<string,string>").alias("kv"))
    fields = []
    for r in SMALL_RECEIPT_RULES:
        raw = F.try_element_at("kv", F.lit(r.label))
        value = parse(r.parser, raw)
        state = F.when(value.isNotNull(), "present").when(blank_to_null(F.trim(raw)).isNotNull(), "excluded").otherwise("absent")
        fields.append(F.struct(F.lit(r.path).alias("path"), F.when(state == "absent", ABSENT).otherwise(value).alias("value"), state.alias("state"), F.when(state == "excluded", "unreadable value").alias("reason")))
    return docs.select("doc_id", F.inline(F.array(*fields)))


def invoice_labels(annotations: DataFrame) -> DataFrame:
    """(doc_id, template, label, sub, raw): the printed labels of flat invoices, party blocks taken apart; the template is the
    first part of the document's name. Labels that start with _ are bookkeeping; lists are no labels."""
    docs = annotations.select("doc_id", F.substring_index("doc_id", "_", 1).alias("template"), F.explode(F.try_variant_get(F.try_parse_json("annotation"), "$", "map<string,variant>")).alias("label", "v"))
    docs = docs.filter(~F.col("label").startswith("_") & ~F.col("label").isin("Image_Name") & (_kind(F.col("v")) != "ARRAY"))
    one = F.array(F.struct(F.lit(None).cast("string").alias("sub"), _text(F.col("v")).alias("raw")))
    block = F.transform(F.map_entries(F.try_variant_get("v", "$", "map<string,variant>")), lambda e: F.struct(e["key"].alias("sub"), _text(e["value"]).alias("raw")))
    return docs.select("doc_id", "template", "label", F.inline(F.when(F.col("label").isin(*PARTY_LABELS) & (_kind(F.col("v")) == "OBJECT"), F.when(F.size(block) > 0, block).otherwise(one)).otherwise(one)))


def _by_role(labels: DataFrame, by: list[str]) -> DataFrame:
    """The party labels of a document or template with the role each fills."""
    held = labels.filter(F.col("label").isin(*PARTY_LABELS)).groupBy(*by).agg(party_roles(F.collect_set("label")).alias("r"))  # four labels at most
    roles = F.array(*[F.struct(F.lit(role).alias("role"), F.col(f"r.{role}").alias("label")) for role in ("seller", "shipTo", "customer")])
    return held.select(*by, F.inline(roles)).filter("label is not null")


def multi_rate_tax(labels: DataFrame) -> DataFrame:
    """(doc_id, pos, key, percentage, amount): the tax lines of documents that print several rates, GST by label, then TAX."""
    tax = labels.filter(F.col("label").rlike(GST_LABEL) | (F.col("label") == "TAX"))
    several = tax.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    gst = F.col("label") != "TAX"
    name, rate = F.when(gst, "GST").otherwise(parse("tax_name", F.col("raw"))), F.when(gst, parse("rate_from_key", F.col("raw"), F.col("label"))).otherwise(parse("tax_pct", F.col("raw")))
    amount = F.when(gst, parse("money_amount", F.col("raw"))).otherwise(parse("tax_amount", F.col("raw")))
    lines = tax.join(several, "doc_id").select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy(~gst, "label")).alias("pos"), name.alias("name"), rate.alias("percentage"), amount.alias("amount"))
    short = F.regexp_replace(F.regexp_replace("percentage", r"(\.\d*?)0+$", "$1"), r"\.$", "")  # 18.00 is 18
    return lines.withColumn("key", F.when(F.col("percentage").isNotNull(), F.concat(F.coalesce("name", F.lit("")), F.lit("("), short, F.lit("%)"))).otherwise(F.coalesce("name", F.lit(""))))


def invoice_truth(annotations: DataFrame, verbatim: bool = False, defects: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, path, value, state, reason), tax lines and notes (doc_id, note) of flat invoices.

    A field that the template prints anywhere is present, absent or excluded in each of its documents. Several tax rates
    exclude the single tax fields; BUYER and BILL_TO together exclude the customer; ``defects`` (doc_id, path, reason) are
    known faults of the annotations. Notes tell invoices without tax, and equal addresses or mails of seller and buyer.
    """
    labels = invoice_labels(annotations)
    plain = labels.filter("sub is null").withColumn("label", F.when(F.col("label").rlike(GST_LABEL), "GST").otherwise(F.col("label"))).withColumn("key", F.lit(None))
    gst = labels.filter(F.col("label").rlike(GST_LABEL)).select("doc_id", "template", "label", "raw")
    rules = (*INVOICE_RULES, *[r for r in GST_RULES if r.parser != "rate_from_key"], Rule("GST_RATE", "totals.taxPercentage", "passthrough_strip"))
    rate = gst.select("doc_id", "template", F.lit("GST_RATE").alias("label"), parse("rate_from_key", F.col("raw"), F.col("label")).alias("raw"))
    party_rules = tuple(Rule(f"{role}.{sub}", f"parties.{role}.{leaf}", parser) for role in ("seller", "shipTo", "customer") for sub, (leaf, parser) in PARTY_LEAVES.items() if role != "seller" or sub != "Tel")
    of_doc = labels.filter(F.col("label").isin(*PARTY_LABELS)).join(_by_role(labels, ["doc_id"]), ["doc_id", "label"])
    parties = of_doc.select("doc_id", "template", F.concat_ws(".", "role", "sub").alias("label"), "raw")
    # what a template's parties could print counts for its documents: one blank label each, which is no value
    subs = F.create_map(*[x for label, held in PARTY_LABELS.items() for x in (F.lit(label), F.array(*[F.lit(s) for s in held]))])
    could = _by_role(labels, ["template"]).select("template", "role", F.explode(F.try_element_at(subs, F.col("label"))).alias("sub")).select("template", F.concat_ws(".", "role", "sub").alias("label")).distinct()
    first = labels.groupBy("template").agg(F.min("doc_id").alias("doc_id"))
    vocabulary = could.join(first, "template").select("doc_id", "template", "label", F.lit(None).cast("string").alias("raw"))
    cols = ["doc_id", "template", "label", "raw"]
    everything = plain.select(*cols).unionByName(rate).unionByName(parties).unionByName(vocabulary)
    truth = resolve(everything, (*rules, *party_rules), verbatim)
    lines = multi_rate_tax(labels)
    collided = labels.filter(F.col("label").isin("BUYER", "BILL_TO")).groupBy("doc_id").agg(F.count_distinct("label").alias("n")).filter("n = 2").select("doc_id")
    customer = [f"parties.customer.{leaf}" for leaf, _ in PARTY_LEAVES.values()]
    barred = lines.select("doc_id").distinct().select("doc_id", F.explode(F.array(*[F.lit(p) for p in TAX_PATHS])).alias("path"), F.lit("several tax rates").alias("why"))
    barred = barred.unionByName(collided.select("doc_id", F.explode(F.array(*[F.lit(p) for p in customer])).alias("path"), F.lit("BUYER and BILL_TO both printed").alias("why")))
    if defects is not None:
        barred = barred.unionByName(defects.select("doc_id", "path", F.col("reason").alias("why")))
    barred = barred.groupBy("doc_id", "path").agg(F.min("why").alias("why"))
    both = truth.join(barred, ["doc_id", "path"], "full_outer")
    none = F.col("why").isNull()
    values = both.select("doc_id", "path", F.when(none, F.col("value")).alias("value"), F.when(none, F.col("state")).otherwise("excluded").alias("state"), F.when(none, F.col("reason")).otherwise(F.col("why")).alias("reason"))
    wide = labels.groupBy("doc_id").agg(
        F.count_if(F.col("label").rlike(GST_LABEL) | (F.col("label") == "TAX")).alias("n_tax"),
        *[F.max(F.when((F.col("label") == who) & (F.col("sub") == sub), blank_to_null(F.trim("raw")))).alias(f"{who}_{sub}") for who in ("SELLER", "BUYER") for sub in ("Address", "Email")],
    )
    same = lambda sub: F.when(F.col(f"SELLER_{sub}") == F.col(f"BUYER_{sub}"), f"seller_equals_buyer_{sub.lower()}")
    notes = wide.select("doc_id", F.explode(F.array_compact(F.array(F.when(F.col("n_tax") == 0, "no_tax_label"), F.when(F.col("n_tax") > 1, "multi_tax_template"), same("Address"), same("Email")))).alias("note"))
    return values, lines, notes


def invoice_line_items(annotations: DataFrame) -> DataFrame:
    """(doc_id, row, description, quantity, unitPrice): line items whose annotation is marked ok; never scored, only kept."""
    v = annotations.select("doc_id", F.try_parse_json("annotation").alias("a")).filter(F.try_variant_get("a", "$._line_items_status", "string") == "ok")
    rows = v.select("doc_id", F.posexplode(_elements(F.try_variant_get("a", "$.LINE_ITEMS", "variant"))).alias("row", "x"))
    cell = lambda k, parser: parse(parser, _text(F.try_variant_get("x", f"$.{k}", "variant")))
    return rows.select("doc_id", "row", cell("description", "passthrough_strip").alias("description"), cell("quantity", "money_amount").alias("quantity"), cell("price", "money_amount").alias("unitPrice"))


def records(values: DataFrame, header: DataFrame) -> DataFrame:
    """Ground-truth records: one row a document of ``header`` (doc_id and whatever else) with gt, annotated_fields and
    excluded_fields. A path is annotated or excluded, never both; a document without values has empty ones."""
    entry = lambda state, c: F.map_from_entries(F.array_sort(F.collect_list(F.when(state, F.struct("path", c)))))
    said, out = F.col("state").isin("present", "absent"), F.col("state") == "excluded"
    once = values.groupBy("doc_id", "path").agg(F.max(F.struct(F.when(out, 1).otherwise(0), "state", "value", "reason")).alias("x")).select("doc_id", "path", "x.state", "x.value", "x.reason")
    built = once.groupBy("doc_id").agg(entry(said, "value").alias("gt"), F.array_sort(F.collect_set(F.when(said, F.col("path")))).alias("annotated_fields"), entry(out, "reason").alias("excluded_fields"))
    kind = "map<string,string>"
    return header.join(built, "doc_id", "left").withColumns({c: F.coalesce(c, F.from_json(F.lit("{}"), kind)) for c in ("gt", "excluded_fields")}).withColumn("annotated_fields", F.coalesce("annotated_fields", F.array().cast("array<string>")))


def contract_faults(declared: DataFrame, code_labels: list[str], leaves: set[str], paths: list[str]) -> list[str]:
    """What the reviewed field map (label, status, path) and the code's rules disagree on, and paths that the schema lacks."""
    said = {r[0]: r[1] for r in declared.select("label", "status").distinct().collect()}  # one row a label
    known = set(code_labels)
    out = [f"label {x} is mapped but has no rule" for x, s in sorted(said.items()) if s == "mapped" and x not in known]
    out += [f"label {x} has a rule but is {said.get(x, 'not in the map')}" for x in sorted(known) if said.get(x) != "mapped"]
    return out + [f"path {p} isn't in the schema" for p in sorted(set(paths)) if p not in leaves and not any(x.startswith(p + ".") for x in leaves)]
