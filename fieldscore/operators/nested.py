"""Deeply nested JSON records to related flat tables that keep parent-child links.

A `Section` declares a repeated section: where it hangs below its parent element and which sections hang below
its own elements. The projection is built from higher-order functions only: nested ``transform`` calls attach the
ancestors' path and index to each element, ``flatten`` joins the arrays of one level, and one ``inline`` per target
table emits the rows. Nothing is shuffled: each record's rows come out where the record is read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscore.functions.expr import let

MAP, LIST = "map<string,variant>", "array<variant>"


@dataclass(frozen=True)
class Section:
    """A repeated section: its table, its dotted path below the parent (``*`` is any key), its own sections, and the
    columns of its table as (name, dotted path below the element, type)."""

    table: str
    path: str
    children: tuple[Section, ...] = ()
    columns: tuple[tuple[str, str, str], ...] = ()


def _numeric(name: str, path: str) -> tuple[tuple[str, str, str], ...]:
    """A number as printed and as read."""
    return (f"{name}_printed", f"{path}.originalValue", "string"), (f"{name}_value", f"{path}.normalizedValue", "double")


KEYED = (("key", "key", "string"), *_numeric("amount", "value"))
ARM_SECTIONS = (
    Section(
        "line_items", "lineItems", (Section("modifiers", "modifiers", columns=KEYED),),
        (
            ("description", "description", "string"), ("item_code", "itemCode", "string"), *_numeric("quantity", "quantity"), *_numeric("unit_price", "unitPrice"),
            *_numeric("total_excluding_tax", "lineTotalExcludingTax"), *_numeric("total_including_tax", "lineTotalIncludingTax"),
        ),
    ),
    Section("charges", "totals.otherCharges", columns=KEYED),
    Section("taxes", "totals.taxes", columns=(*KEYED, *_numeric("percentage", "percentage"))),
)
JUDGE_SECTIONS = (
    Section(
        "issues", "issues.*", (Section("evidence", "evidence", columns=(("arm", "arm", "string"), ("seen", "seen", "string"))),),
        (("field", "field", "string"), ("issue_type", "issue_type", "string"), ("corrected_printed", "corrected_value.originalValue", "string"), ("corrected_text", "corrected_value", "scalar")),
    ),
)


def read_json(text: Column) -> Column:
    """Variant of a JSON text; JSON text held in a JSON string is read too; unreadable text is null."""
    v = F.try_parse_json(text)
    return F.coalesce(F.when(F.ltrim(text).startswith('"'), F.try_parse_json(F.try_variant_get(v, "$", "string"))), v)


def as_map(v: Column) -> Column:
    return F.try_variant_get(v, "$", MAP)


def is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "struct<>").isNotNull()


def _held(v: Column) -> Column:
    """The JSON value held in a string variant; null where there is none."""
    return F.try_parse_json(F.try_variant_get(v, "$", "string"))


def as_object(v: Column) -> Column:
    """The variant if it is an object or a string that holds one, else null."""
    return let(v, lambda x: F.coalesce(F.when(is_object(x), x), let(_held(x), lambda y: F.when(is_object(y), y))))


def as_elements(v: Column) -> Column:
    """The elements of a section's value: an array's own, or the object itself as the only one; else none."""

    def plain(x: Column) -> Column:
        return F.coalesce(F.try_variant_get(x, "$", LIST), F.when(is_object(x), F.array(x)))

    return let(v, lambda x: F.when(x.isNotNull(), F.coalesce(plain(x), let(_held(x), plain))))


def _step(path: str) -> str:
    return "$." + path


def _values(holder: Column, path: str, base: Column) -> Column:
    """array<struct<prefix, value>>: the values at ``path`` below the holder with their printed path."""
    head, star, _ = path.partition(".*")
    if not star:
        return F.array(F.struct(F.concat(base, F.lit("." + path)).alias("prefix"), F.try_variant_get(holder, _step(path), "variant").alias("value")))
    entries = F.map_entries(as_map(as_object(F.try_variant_get(holder, _step(head), "variant"))))
    return F.transform(
        F.coalesce(entries, F.array().cast("array<struct<key:string,value:variant>>")),
        lambda e: F.struct(F.concat(base, F.lit(f".{head}."), e["key"]).alias("prefix"), e["value"].alias("value")),
    )


def _level(roots: Column, section: Section) -> Column:
    """array<struct<node_path, parent_path, root, position, node>> of the objects of one section below all roots."""

    def of_value(root: Column, v: Column) -> Column:
        kept = F.transform(
            as_elements(v["value"]),
            lambda x, i: F.struct(
                F.concat(v["prefix"], F.lit("["), i.cast("string"), F.lit("]")).alias("node_path"),
                root["node_path"].alias("parent_path"),
                root["root"].alias("root"),
                i.cast("int").alias("position"),
                as_object(x).alias("node"),
            ),
        )
        return F.filter(F.coalesce(kept, F.array().cast(NODES)), lambda n: n["node"].isNotNull())

    return F.flatten(F.transform(roots, lambda r: F.flatten(F.transform(_values(r["node"], section.path, r["node_path"]), lambda v: of_value(r, v)))))


NODES = "array<struct<node_path:string,parent_path:string,root:string,position:int,node:variant>>"


def arm_roots(arms: Column, wrappers: tuple[str, ...] = ("invoiceOutputData", "receiptOutputData")) -> Column:
    """The payload of each arm as a root node; arms named ``_...`` don't count; an only wrapper key is stripped."""
    entries = F.filter(F.map_entries(as_map(arms)), lambda e: ~e["key"].startswith("_"))

    def payload(v: Column) -> Column:
        def stripped(x: Column, m: Column) -> Column:
            return F.when((F.size(m) == 1) & F.map_keys(m)[0].isin(*wrappers), as_object(F.map_values(m)[0])).otherwise(x)

        return let(as_object(v), lambda x: let(as_map(x), lambda m: stripped(x, m)))

    rooted = F.transform(
        entries,
        lambda e: F.struct(e["key"].alias("node_path"), F.lit(None).cast("string").alias("parent_path"), e["key"].alias("root"), F.lit(0).alias("position"), payload(e["value"]).alias("node")),
    )
    return F.coalesce(rooted, F.array().cast(NODES))


def report_root(judge: Column, name: str = "judge") -> Column:
    """A whole JSON value as the only root node."""
    return F.array(F.struct(F.lit(name).alias("node_path"), F.lit(None).cast("string").alias("parent_path"), F.lit(name).alias("root"), F.lit(0).alias("position"), judge.alias("node")))


def with_sections(df: DataFrame, roots: dict[str, tuple[Column, tuple[Section, ...]]]) -> tuple[DataFrame, list[str]]:
    """The records with one array column per target table, each level built from the level above."""
    tables: list[str] = []
    for name, (column, _) in roots.items():
        df = df.withColumn(f"__root_{name}", column)

    def below(frame: DataFrame, source: str, sections: tuple[Section, ...]) -> DataFrame:
        for s in sections:
            frame = frame.withColumn(f"__t_{s.table}", _level(F.col(source), s))
            tables.append(s.table)
            frame = below(frame, f"__t_{s.table}", s.children)
        return frame

    for name, (_, sections) in roots.items():
        df = below(df, f"__root_{name}", sections)
    return df, tables


def nested_tables(df: DataFrame, keys: list[str], roots: dict[str, tuple[Column, tuple[Section, ...]]], pick: Callable[[Column], Column] | None = None) -> dict[str, DataFrame]:
    """One flat DataFrame per declared section: the keys, node_path, parent_path, root, position and the node.

    Null, empty or unreadable JSON gives no rows; null elements keep their position but give no row; an object in
    the place of an array is its only element; an empty table gives empty tables. Columns of ``df`` beside ``keys``
    don't reach the result, so clashing names can't arise. Repeated rows give repeated results: pick the current
    row first (`current_rows`). ``pick`` may turn the node's variant into something else.
    """
    built, tables = with_sections(df.select(*keys, *[c.alias(f"__in_{n}") for n, (c, _) in roots.items()]), {n: (F.col(f"__in_{n}"), s) for n, (_, s) in roots.items()})
    out = {}
    for t in tables:
        column = F.col(f"__t_{t}")
        if pick:
            column = F.transform(column, lambda n: F.struct(n["node_path"], n["parent_path"], n["root"], n["position"], pick(n["node"]).alias("node")))
        out[t] = built.select(*keys, F.inline(column))
    return out


def _columns(sections: tuple[Section, ...]) -> dict[str, tuple[tuple[str, str, str], ...]]:
    return {k: v for s in sections for k, v in ((s.table, s.columns), *_columns(s.children).items())}


def typed_tables(df: DataFrame, keys: list[str], roots: dict[str, tuple[Column, tuple[Section, ...]]]) -> dict[str, DataFrame]:
    """`nested_tables` with the declared columns of each section in place of the element: flat, typed, null where a value is
    missing or of another kind. ``scalar`` is the text of a value that is neither object nor array."""
    declared = _columns(tuple(s for _, sections in roots.values() for s in sections))

    def typed(name: str, path: str, kind: str) -> Column:
        if kind != "scalar":
            return F.try_variant_get("node", f"$.{path}", kind).alias(name)
        v = F.try_variant_get("node", f"$.{path}", "variant")
        nested = F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)")
        return F.when(~nested & ~F.is_variant_null(v), F.try_variant_get(v, "$", "string")).alias(name)

    return {t: d.select(*keys, "node_path", "parent_path", "root", "position", *[typed(*c) for c in declared[t]]) for t, d in nested_tables(df, keys, roots).items()}


def scalar_elements(df: DataFrame, keys: list[str], roots: dict[str, tuple[Column, tuple[Section, ...]]]) -> DataFrame:
    """(keys, node_path, parent_path, value): elements of the declared sections that are no objects, which have no row in
    the sections' tables; nulls have none here either. Sections below such an element don't exist."""
    built, _ = with_sections(df.select(*keys, *[c.alias(f"__in_{n}") for n, (c, _) in roots.items()]), {n: (F.col(f"__in_{n}"), s) for n, (_, s) in roots.items()})

    def plain(holders: str, s: Section) -> list[Column]:
        def of(r: Column, v: Column) -> Column:
            return F.filter(
                F.transform(
                    F.coalesce(as_elements(v["value"]), F.array().cast(LIST)),
                    lambda x, i: F.struct(F.concat(v["prefix"], F.lit("["), i.cast("string"), F.lit("]")).alias("node_path"), r["node_path"].alias("parent_path"), F.when(as_object(x).isNull() & ~F.is_variant_null(x), F.to_json(x)).alias("value")),
                ),
                lambda n: n["value"].isNotNull(),
            )

        own = F.flatten(F.transform(F.col(holders), lambda r: F.flatten(F.transform(_values(r["node"], s.path, r["node_path"]), lambda v: of(r, v)))))
        return [own, *[c for child in s.children for c in plain(f"__t_{s.table}", child)]]

    parts = [c for n, (_, sections) in roots.items() for s in sections for c in plain(f"__root_{n}", s)]
    return built.select(*keys, F.inline(F.concat(*parts)))


def array_paths(texts: DataFrame, column: str, declared: tuple[str, ...]) -> DataFrame:
    """(array_path, n_elements, declared): every array that holds something, its index stripped, with how many elements it
    has in all records and whether a table is declared for it: what is not isn't lost unseen."""
    from fieldscore.operators.diff import PayloadForm, json_leaves

    leaves = texts.select(F.col(column).alias("t")).withColumn("row", F.monotonically_increasing_id()).select("row", F.explode(json_leaves(F.col("t"), PayloadForm(hidden="\x00"))).alias("c")).select("row", F.col("c.leaf_path").alias("p"))
    ends = F.filter(F.sequence(F.lit(1), F.length("p")), lambda i: F.substr("p", i, F.lit(1)) == "]")
    at = leaves.select("row", F.explode(F.transform(ends, lambda i: F.substr("p", F.lit(1), i))).alias("e")).distinct()
    path = F.regexp_replace(F.regexp_replace("e", r"\[\d+\]$", ""), r"\[\d+\]", "[]")
    return at.groupBy(path.alias("array_path")).agg(F.count("*").alias("n_elements")).withColumn("declared", F.regexp_replace("array_path", r"^[^.]*\.", "").isin(*declared))


def doc_result_roots() -> dict[str, tuple[Column, tuple[Section, ...]]]:
    return {"arms": (arm_roots(read_json(F.col("arms"))), ARM_SECTIONS), "judge": (report_root(read_json(F.col("judge"))), JUDGE_SECTIONS)}


def node_links(df: DataFrame, keys: list[str], roots: dict[str, tuple[Column, tuple[Section, ...]]]) -> DataFrame:
    """(keys, node_path, parent_path) of all sections' rows in one pass: the tables' arrays joined, one inline."""
    built, tables = with_sections(df.select(*keys, *[c.alias(f"__in_{n}") for n, (c, _) in roots.items()]), {n: (F.col(f"__in_{n}"), s) for n, (_, s) in roots.items()})
    slim = [F.transform(F.col(f"__t_{t}"), lambda n: F.struct(n["node_path"].alias("node_path"), n["parent_path"].alias("parent_path"))) for t in tables]
    return built.select(*keys, F.inline(F.concat(*slim)))
