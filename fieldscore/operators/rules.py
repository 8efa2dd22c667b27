"""Document types, leaf inventories and the comparison rule of each leaf (computed once, on the driver)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

NUMERIC, DATE_ISO, DATE_RAW, IDENTIFIER, ENUM, BOOL, CURRENCY = "numeric", "date_iso", "date_raw", "identifier", "enum", "bool", "currency"
TEXT_CONTAINED, PHONE, EMAIL, CHARGE_LABEL, ADDRESS, TEXT = "text_contained", "phone", "email", "charge_label", "address", "text"
RULES = (NUMERIC, DATE_ISO, DATE_RAW, IDENTIFIER, ENUM, BOOL, CURRENCY, TEXT_CONTAINED, PHONE, EMAIL, CHARGE_LABEL, ADDRESS, TEXT)

# Leaf names of identifiers.
IDENTIFIER_LEAVES = frozenset("documentNumber purchaseOrderNumber customerNumber trackingNumber itemCode accountNumber routingNumber referenceNumber".split())


@dataclass(frozen=True)
class DocType:
    """What scoring has to know of a document type; never data."""

    name: str
    wrapper: str
    date_leaves: frozenset[str]
    list_paths: frozenset[str]
    identifier_leaves: frozenset[str] = IDENTIFIER_LEAVES
    excluded_leaves: frozenset[str] = frozenset()
    contained_leaves: frozenset[str] = frozenset()
    charge_label_paths: frozenset[str] = frozenset()
    rate_keyed_lists: frozenset[str] = frozenset()
    merged_targets: dict[str, tuple[str, ...]] = field(default_factory=dict)
    list_union_sources: dict[str, tuple[str, ...]] = field(default_factory=dict)
    convention_criterion: bool = False


INVOICE = DocType(
    "invoice",
    "invoiceOutputData",
    date_leaves=frozenset({"issueDate", "dueDate", "serviceDate", "deliveryDate"}),
    list_paths=frozenset({"lineItems", "totals.otherCharges"}),
    charge_label_paths=frozenset({"totals.otherCharges[].key"}),
    rate_keyed_lists=frozenset({"totals.otherCharges"}),
    list_union_sources={"totals.otherCharges": ("totals.taxName", "totals.taxPercentage", "totals.taxAmount")},
    convention_criterion=True,
)
RECEIPT = DocType(
    "receipt",
    "receiptOutputData",
    date_leaves=frozenset({"txnDate", "serviceDate"}),
    list_paths=frozenset({"lineItems", "totals.subtotal", "totals.taxes", "totals.otherCharges"}),
    contained_leaves=frozenset({"name"}),
)
DOC_TYPES = {t.name: t for t in (INVOICE, RECEIPT)}

_PARTY = ("name", "addressStructured.address", "addressStructured.city", "addressStructured.state", "addressStructured.postal_code", "addressStructured.country", "phone", "email")


def leaf_inventory(doc_type: DocType) -> dict[str, str]:
    """path -> declared type of the leaves this engine scores without a schema file; `read_leaf_paths` reads a file."""
    parties = ("seller", "customer", "shipTo") if doc_type is INVOICE else ("seller", "customer")
    head = ("invoiceInfo", ("documentNumber", "issueDate", "issueDateISO", "dueDate", "dueDateISO", "purchaseOrderNumber", "customerNumber", "customerMemo")) if doc_type is INVOICE else ("receiptInfo", ("documentNumber", "txnDate", "txnDateISO", "customerNumber", "customerMemo"))
    out = {"currency": "str", "applyTaxAfterDiscount": "bool"}
    out |= {f"{head[0]}.{x}": "str" for x in head[1]}
    out |= {f"parties.{p}.{x}": "str" for p in parties for x in _PARTY}
    out |= {f"totals.{x}": "numeric" for x in ("discountTotal", "discountPercentage", "totalExcludingTax", "totalIncludingTax", "taxAmount", "taxPercentage", *(["subtotal"] if doc_type is INVOICE else []))}
    out |= {"totals.taxName": "str", "totals.otherCharges[].key": "str", "totals.otherCharges[].value": "numeric"}
    rows = ("quantity", "unitPrice", "discountAmount", "discountPercent", "lineTaxAmount", "lineTaxPercent", "lineTotalExcludingTax", "lineTotalIncludingTax")
    return out | {"lineItems[].description": "str", "lineItems[].itemCode": "str"} | {f"lineItems[].{x}": "numeric" for x in rows}


@dataclass(frozen=True)
class Leaf:
    """What a rule is chosen by."""

    path: str
    declared: str
    spec: DocType

    @property
    def name(self) -> str:
        return self.path.rsplit(".", 1)[-1]


# Which leaves have which rule; of several that fit the one further up holds.
CHOICES: dict[str, tuple[Callable[[Leaf], bool], ...]] = {
    CHARGE_LABEL: (lambda x: x.path in x.spec.charge_label_paths,),
    NUMERIC: (lambda x: x.declared == "numeric",),
    ENUM: (lambda x: x.declared.startswith("enum:"),),
    BOOL: (lambda x: x.declared == "bool",),
    CURRENCY: (lambda x: x.path == "currency",),
    DATE_ISO: (lambda x: x.path.endswith("ISO"),),
    DATE_RAW: (lambda x: x.name in x.spec.date_leaves,),
    ADDRESS: (lambda x: x.name == "addressStructured", lambda x: x.path.endswith("addressStructured.address")),
    PHONE: (lambda x: x.name == "phone",),
    EMAIL: (lambda x: x.name == "email",),
    IDENTIFIER: (lambda x: x.name in x.spec.identifier_leaves,),
    TEXT_CONTAINED: (lambda x: x.name in x.spec.contained_leaves,),
}


def rule_for(path: str, declared: str, spec: DocType) -> str:
    """The rule of a leaf by its declared type and its place; text where nothing else fits."""
    leaf = Leaf(path, declared, spec)
    return next((rule for rule, tests in CHOICES.items() if any(t(leaf) for t in tests)), TEXT)


def consumed_paths(spec: DocType) -> set[str]:
    """Leaves that are read as a part of another field and have no verdict of their own: the sources of merged targets, the
    components of addresses, and the scalars that join a list."""
    parts = {p for p in leaf_inventory(spec) if ".addressStructured." in p}
    return parts.union(*spec.merged_targets.values(), *spec.list_union_sources.values()) - set(spec.merged_targets)


def rule_registry(spec: DocType, inventory: dict[str, str] | None = None) -> dict[str, str]:
    """path -> rule: address components collapse to their object, merged targets take the place of their sources."""
    out: dict[str, str] = {}
    for path, declared in (inventory or leaf_inventory(spec)).items():
        if path.rsplit(".", 1)[-1] in spec.excluded_leaves:
            continue
        if ".addressStructured." in path:
            out[path.rsplit(".", 1)[0]] = ADDRESS
        else:
            out[path] = rule_for(path, declared, spec)
    for target, sources in spec.merged_targets.items():
        out[target] = TEXT_CONTAINED
        for s in sources:
            out.pop(s, None)
    return out
