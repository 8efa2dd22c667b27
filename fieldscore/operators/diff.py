"""Differences between two copies of JSON records, leaf by leaf.

Both sides are unpivoted to key-field-value cells, joined in one union with signed counts and grouped; what does not
cancel is a difference. This is done twice with the same means: first each record is one cell, a digest of all its
leaves, and the records whose signed counts cancel are done; the others are unpivoted to their leaves. Both sides are
distributed by their key when current rows are chosen, which serves the union and the records' counts too; only the leaves of
records that don't cancel move once more.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from decimal import Decimal

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldscore.operators.current import current_rows

CELLS = "array<struct<leaf_path:string,leaf:string>>"


@dataclass(frozen=True)
class PayloadForm:
    """How a record's JSON is read: named payloads at the top, wrapper keys that don't count, repeated sections.

    ``sections`` are dotted paths below a payload (``[]`` after a repeated one); an object in the place of such an
    array is its only element. Names that start with ``hidden`` don't count. JSON text held in a string is read, if ``opened``.
    """

    wrappers: tuple[str, ...] = ("invoiceOutputData", "receiptOutputData")
    sections: tuple[str, ...] = ("lineItems", "lineItems[].modifiers", "totals.otherCharges", "totals.taxes")
    hidden: str = "_"
    opened: bool = True


def _number(text: str) -> object:
    """The number by its value: 14, 14.0 and 1.4e1 are one; long decimals keep all digits."""
    if len(text) < 16:
        f = float(text)
        return int(f) if f.is_integer() else f
    d = Decimal(text)
    if d == d.to_integral_value() and d.adjusted() < 400:
        return int(d)
    f = float(text)
    return f if Decimal(repr(f)) == d else d.normalize()


def _no_constant(_: str) -> object:
    raise ValueError("not JSON")


_DECODER = json.JSONDecoder(parse_float=_number, parse_constant=_no_constant)
_MAY_HOLD = re.compile(r'"\s*[\[{"]')
_HOLDS = re.compile(r"\s*[\[{\"]")
_SILENT = re.compile(r"lnull|s[ \t\n\f\r]*")  # a null or blank leaf


def read(text: str | None) -> object:
    """The JSON value, or None where the text can't be read; JSON text held in a JSON string is read as JSON."""
    if not text:
        return None
    try:
        v = _DECODER.decode(text.strip("﻿ \t\r\n"))
    except (ValueError, RecursionError):
        return None
    return _opened(v)


def _opened(v: object) -> object:
    while isinstance(v, str) and _HOLDS.match(v):
        try:
            inner = _DECODER.decode(v.strip(" \t\r\n"))
        except (ValueError, RecursionError):
            return v
        if not isinstance(inner, (dict, list, str)):
            return v
        v = inner
    return v


def _open_all(v: object) -> object:
    v = _opened(v)
    if isinstance(v, dict):
        return {k: _open_all(x) for k, x in v.items()}
    if isinstance(v, list):
        return [_open_all(x) for x in v]
    return v


class Reader:
    """Reads records of one form; made once per Python worker batch."""

    def __init__(self, form: PayloadForm):
        self.form = form
        self.paths = [[(p.removesuffix("[]"), p.endswith("[]")) for p in s.split(".")] for s in form.sections]

    def payloads(self, text: str | None) -> dict[str, object]:
        v = read(text)
        if not isinstance(v, dict):
            return {}
        deep = self.form.opened and bool(text and _MAY_HOLD.search(text.replace('""', "")))
        out = {}
        for name, p in v.items():
            if name.startswith(self.form.hidden):
                continue
            out[name] = self._plain(_open_all(p) if deep else p)
        return out

    def _plain(self, p: object) -> object:
        if isinstance(p, dict) and len(p) == 1 and (k := next(iter(p))) in self.form.wrappers:
            p = p[k]
        for path in self.paths:
            _listed(p, path)
        return p

    def bare(self, text: str | None) -> object:
        """One payload that stands alone, without a name."""
        return self._plain(_open_all(read(text)))

    def digest(self, text: str | None) -> str:
        whole = json.dumps(self.payloads(text), sort_keys=True, separators=(",", ":"), default=lambda d: {"\x00": str(d)})
        return f"{xxhash.xxh3_128_hexdigest(whole)}{len(whole)}"

    def leaves(self, text: str | None) -> list[tuple[str, str]]:
        out: list[tuple[str, str]] = []
        for name, p in self.payloads(text).items():
            _walk(p, name, out)
        return out


def _listed(v: object, path: list[tuple[str, bool]]) -> None:
    """Puts the only element of a repeated section into a list, in place."""
    for i, (key, each) in enumerate(path):
        if not isinstance(v, dict) or key not in v:
            return
        if i == len(path) - 1:
            if isinstance(v[key], dict):
                v[key] = [v[key]]
            return
        v = v[key]
        if each:
            if isinstance(v, list):
                for x in v:
                    _listed(x, path[i + 1 :])
            return


def _walk(v: object, path: str, out: list[tuple[str, str]]) -> None:
    if isinstance(v, dict):
        for k, x in v.items():
            _walk(x, f"{path}.{k}", out)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            _walk(x, f"{path}[{i}]", out)
    else:
        out.append((path, "s" + v if isinstance(v, str) else "l" + json.dumps(v) if v is None or isinstance(v, bool) else f"n{v}"))


def record_cell(text: Column, form: PayloadForm = PayloadForm()) -> Column:
    """A record as one cell: 128 bits and the length of all its leaves, equal however the text is laid out."""

    @F.arrow_udf("string")
    def cell(texts: pa.Array) -> pa.Array:
        r = Reader(form)
        return pa.array([r.digest(t) for t in texts.to_pylist()], pa.string())

    return cell(text)


def json_leaves(text: Column, form: PayloadForm = PayloadForm()) -> Column:
    """array<struct<leaf_path, leaf>> of a record; the leaf carries its JSON type before its value."""

    @F.arrow_udf(CELLS)
    def leaves(texts: pa.Array) -> pa.Array:
        r = Reader(form)
        cells = [[{"leaf_path": p, "leaf": v} for p, v in r.leaves(t)] for t in texts.to_pylist()]
        return pa.array(cells, type=pa.list_(pa.struct([("leaf_path", pa.string()), ("leaf", pa.string())])))

    return leaves(text)


def bare_leaves(text: Column, name: str, form: PayloadForm = PayloadForm()) -> Column:
    """The leaves of one payload that stands alone, as if it had a name; null where the text holds nothing."""

    @F.arrow_udf(CELLS)
    def leaves(texts: pa.Array) -> pa.Array:
        r = Reader(form)
        cells: list[list[dict[str, str]] | None] = []
        for t in texts.to_pylist():
            out: list[tuple[str, str]] = []
            if p := r.bare(t):
                _walk(p, name, out)
            cells.append([{"leaf_path": q, "leaf": v} for q, v in out] if p else None)
        return pa.array(cells, type=pa.list_(pa.struct([("leaf_path", pa.string()), ("leaf", pa.string())])))

    return leaves(text)


def lost_leaves(before: Column, after: Column, form: PayloadForm = PayloadForm()) -> Column:
    """array<string>: the paths of leaves that say something in the texts of ``before`` (array<string>) and in none of ``after``."""

    @F.arrow_udf("array<string>")
    def lost(xs: pa.Array, ys: pa.Array) -> pa.Array:
        r = Reader(form)
        said = lambda texts: [p for t in texts for p, v in r.leaves(t) if not _SILENT.fullmatch(v)]
        out = []
        for x, y in zip(xs, ys, strict=True):
            there = set(said(y.as_py()))
            out.append([p for p in said(x.as_py()) if p not in there])
        return pa.array(out, pa.list_(pa.string()))

    return lost(before, after)


def same_print(a: Column, b: Column) -> Column:
    """Whether two leaves print alike, though their JSON types or digits differ: 1.0 and "1.0"; null for an absent one."""

    @F.arrow_udf("boolean")
    def same(xs: pa.Array, ys: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else _printed(x) == _printed(y) for x, y in zip(xs.to_pylist(), ys.to_pylist(), strict=True)], type=pa.bool_())

    return same(a, b)


def _printed(leaf: str) -> str:
    kind, text = leaf[0], leaf[1:]
    if kind == "n":
        try:
            return str(float(text))
        except OverflowError:
            return text
    return {"null": "None", "true": "True", "false": "False"}[text] if kind == "l" else text


def json_differences(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    value: str,
    left_version: str,
    right_version: str,
    names: tuple[str, str] = ("run", "app"),
    left_filter: Column | None = None,
    left_columns: tuple[str, ...] = (),
    form: PayloadForm = PayloadForm(),
    leaves: bool = False,
) -> DataFrame:
    """(keys, leaf_path, diff_kind): keys on one side only (leaf_path '') and the leaves that disagree.

    The current row of each key counts (`current_rows`), equal rows once; ``left_filter``, over
    ``left_columns`` too, is applied to current rows.
    diff_kind is only_<name>, leaf_only_<name> or differs. Null, empty or unreadable JSON holds no leaves, so its
    key still counts as present. Null key parts match each other. Extra columns of either side don't reach the result. Empty tables give an empty result.
    With ``leaves``, <name>_leaf holds each side's leaf (its JSON type before its value), null where it has none.
    """
    a, b = names

    marks = [f"__k{i}{m}" for i in range(len(keys)) for m in "vn"]  # null-safe keys

    def side(df: DataFrame, version: str, kept: Column | None, sign: int) -> DataFrame:
        cols = list(dict.fromkeys([*keys, version, value, *([] if kept is None else left_columns)]))
        df = df.select(*cols)
        for i, k in enumerate(keys):
            plain = F.col(k).cast("string")
            df = df.withColumns({f"__k{i}v": F.coalesce(plain, F.lit("")), f"__k{i}n": plain.isNull()})
        df = df.withColumn("__cell", record_cell(F.col(value), form))  # where the text is read: beyond here nothing that loses the partitioning
        cur = current_rows(df, marks, version, [F.xxhash64(F.col(value))])
        return (cur if kept is None else cur.filter(kept)).select(*marks, F.struct(*keys).alias("__keys"), F.lit(sign).alias("__sign"), "__cell", F.col(value).alias("__text"))

    records = side(left, left_version, left_filter, 1).union(side(right, right_version, None, -1))
    counts = records.withColumn("__n", F.sum("__sign").over(Window.partitionBy(*marks, "__cell")))
    differ = counts.withColumn("__both", F.count("*").over(Window.partitionBy(*marks)) == 2).filter(F.col("__n") != 0)
    absent = F.array(F.struct(F.lit("").alias("leaf_path"), F.lit("").alias("leaf")))
    cells = differ.select("__keys", "__sign", F.inline(F.when(F.col("__both"), json_leaves(F.when(F.col("__both"), F.col("__text")), form)).otherwise(absent)))
    counted = cells.groupBy("__keys", "leaf_path", "leaf").agg(F.sum("__sign").alias("n")).filter(F.col("n") != 0)
    per_path = counted.groupBy("__keys", "leaf_path").agg(
        F.max(F.col("n") > 0).alias("in_left"), F.max(F.col("n") < 0).alias("in_right"),
        *([F.max(F.when(F.col("n") > 0, F.col("leaf"))).alias(f"{a}_leaf"), F.max(F.when(F.col("n") < 0, F.col("leaf"))).alias(f"{b}_leaf")] if leaves else []),
    ).select("__keys.*", "*")
    kind = (
        F.when(F.col("in_left") & F.col("in_right"), "differs")
        .when(F.col("leaf_path") == "", F.when(F.col("in_left"), f"only_{a}").otherwise(f"only_{b}"))
        .otherwise(F.when(F.col("in_left"), f"leaf_only_{a}").otherwise(f"leaf_only_{b}"))
    )
    return per_path.select(*keys, "leaf_path", kind.alias("diff_kind"), *([f"{a}_leaf", f"{b}_leaf"] if leaves else []))
