"""Row alignment of repeated sections: exact keys as an occurrence join, the rest by optimal assignment.

Assignment runs inside the row (both row lists of one section as arrays, an Arrow UDF over batches), so nothing is
shuffled for it. The lists of one section are bounded by what one document prints.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAIRS = "array<struct<gt_row:int,pred_row:int,score:double,matched_on:string>>"


def exact_key_pairs(gt: DataFrame, pred: DataFrame, section: list[str], key: str, order: str) -> DataFrame:
    """Pairs of rows with equal keys, the n-th with the n-th: the same as taking the first unused row each time.

    ``gt`` and ``pred`` hold (section..., key, order). Null keys match nothing. Columns: section, gt_row, pred_row.
    """
    def numbered(df: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy(*section, key).orderBy(order)
        return df.filter(F.col(key).isNotNull()).select(*section, key, F.col(order).alias(name), F.row_number().over(w).alias("nth"))

    return numbered(gt, "gt_row").join(numbered(pred, "pred_row"), [*section, key, "nth"]).select(*section, key, "gt_row", "pred_row")


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Minimum-cost assignment of the smaller side of a matrix, by shortest augmenting paths with potentials."""
    cost = np.asarray(cost, dtype=float)
    if not cost.size:
        return []
    flipped = cost.shape[0] > cost.shape[1]
    c = cost.T if flipped else cost
    n, m = c.shape
    row_pot, col_pot = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for i in range(n):
        dist, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, gain, last = i, 0.0, -1
        while True:
            through = gain + c[row] - row_pot[row] - col_pot
            better = (through < dist) & ~done
            dist[better], via[better] = through[better], last
            j = int(np.argmin(np.where(done, np.inf, dist)))
            gain = dist[j]
            done[j] = True
            if owner[j] < 0:
                break
            row, last = owner[j], j
        closed = done & (owner >= 0)
        closed[j] = False
        row_pot[i] += gain
        for k in np.flatnonzero(closed):
            row_pot[owner[k]] += gain - dist[k]
            col_pot[k] -= gain - dist[k]
        while via[j] >= 0:
            owner[j] = owner[via[j]]
            j = via[j]
        owner[j] = i
    pairs = [(int(owner[j]), j) for j in range(m) if owner[j] >= 0]
    return sorted((b, a) if flipped else (a, b) for a, b in pairs)


def edits(a: str, b: str, most: int) -> int:
    """The edit distance, or most + 1 if it is larger: only the band that can stay within ``most`` is computed."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - most), min(len(b), i + most)
        cur = [most + 1] * (len(b) + 1)
        cur[0] = i
        for j in range(lo, hi + 1):
            d = prev[j - 1] + (x != b[j - 1])
            if prev[j] < d:
                d = prev[j] + 1
            if cur[j - 1] < d:
                d = cur[j - 1] + 1
            cur[j] = d
        if min(cur[lo - 1 : hi + 1]) > most:
            return most + 1
        prev = cur
    return min(prev[-1], most + 1)


@lru_cache(maxsize=1 << 16)
def similarity(a: str, b: str, threshold: float) -> float:
    """1 - edits over the longer length of two texts without case and spacing; 0 below the threshold."""
    a, b = " ".join(a.lower().split()), " ".join(b.lower().split())
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    longest = max(len(a), len(b))
    most = int((1 - threshold) * longest + 1e-9)
    d = edits(a, b, most)
    return 1 - d / longest if d <= most else 0.0


def _number(v: object) -> str | None:
    s = "".join(ch for ch in str(v) if ch.isdigit() or ch in ".-") if v is not None else ""
    try:
        return f"{float(s):.2f}"
    except ValueError:
        return None


_PERCENT = re.compile(r"(\d+(?:[.,]\d+)?)\s*%")


def _row_rate(row: dict) -> str | None:
    """The rate a row carries, to two places: in its key, else its percentage."""
    m = _PERCENT.search(row["key"]) if isinstance(row.get("key"), str) else None
    if m:
        return _number(m.group(1).replace(",", "."))
    return _number(row["percentage"]) if row.get("percentage") not in (None, "") else None


def align_rows(gt_rows: Column, pred_rows: Column, gt_text: tuple[str, ...] = ("description",), pred_text: tuple[str, ...] = ("description", "itemCode"), threshold: float = 0.8, numeric_weight: float = 0.001, numeric: dict[str, tuple[str, ...]] | None = None, keyed: bool = False) -> Column:
    """Pairs of two lists of rows (JSON arrays of flat objects as text) by text similarity, numbers breaking ties.

    A pair below ``threshold`` is no pair. The assignment is optimal, so a missing row doesn't shift the others. With
    ``keyed`` rows that carry a rate are paired by it first, each with the first unused one, and never by text. Null,
    unreadable or empty lists give an empty array.
    """
    numeric = numeric or {"quantity": ("quantity",), "unitPrice": ("unitPrice",), "lineTotal": ("lineTotalExcludingTax", "lineTotalIncludingTax")}

    def rows(text: str | None) -> list[dict]:
        try:
            v = json.loads(text) if text else []
        except ValueError:
            return []
        return [x if isinstance(x, dict) else {} for x in v] if isinstance(v, list) else []

    def flat(v: object) -> object:
        return (v.get("normalizedValue") if v.get("normalizedValue") is not None else v.get("originalValue")) if isinstance(v, dict) else v

    def by_text(g: list[dict], p: list[dict]) -> list[dict]:
        if not g or not p:
            return []
        s, key = np.zeros((len(g), len(p))), {}
        for i, a in enumerate(g):
            for j, b in enumerate(p):
                best = max(((similarity(a[x], flat(b[y]), threshold), x) for x in gt_text for y in pred_text if isinstance(a.get(x), str) and isinstance(flat(b.get(y)), str)), default=(0.0, None))
                s[i, j], key[i, j] = best
        agree = np.zeros_like(s)
        for i, a in enumerate(g):
            known = {x: _number(a[x]) for x in numeric if a.get(x) is not None}
            for j, b in enumerate(p):
                if known:
                    agree[i, j] = sum(any(_number(flat(b.get(y))) == v for y in numeric[x]) for x, v in known.items()) / len(known)
        cost = np.where(s >= threshold, -(s + numeric_weight * agree), 1e6)
        return [{"gt_row": i, "pred_row": j, "score": float(s[i, j]), "matched_on": key[i, j]} for i, j in assignment(cost) if s[i, j] >= threshold]

    def pair(g: list[dict], p: list[dict]) -> list[dict]:
        if not keyed:
            return by_text(g, p)
        gk, pk = [_row_rate(x) for x in g], [_row_rate({k: flat(v) for k, v in x.items()}) for x in p]
        free: dict[str, list[int]] = {}
        for j, k in enumerate(pk):
            if k:
                free.setdefault(k, []).append(j)
        out = [{"gt_row": i, "pred_row": free[k].pop(0), "score": 1.0, "matched_on": "rate"} for i, k in enumerate(gk) if k and free.get(k)]
        gs, ps = [i for i, k in enumerate(gk) if not k], [j for j, k in enumerate(pk) if not k]
        rest = by_text([g[i] for i in gs], [p[j] for j in ps])
        return sorted(out + [x | {"gt_row": gs[x["gt_row"]], "pred_row": ps[x["pred_row"]]} for x in rest], key=lambda x: x["gt_row"])

    @F.pandas_udf(PAIRS)
    def run(gs: pd.Series, ps: pd.Series) -> pd.Series:
        return pd.Series([pair(rows(g), rows(p)) for g, p in zip(gs, ps, strict=True)])

    return run(gt_rows, pred_rows)


def section_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Row precision, recall and F1 from (n_gt, n_pred, n_matched), and the share of complete tables.

    Precision without predictions and recall without truth are null; documents without truth rows are counted apart.
    """
    g, p, m = F.sum("n_gt").cast("double"), F.sum("n_pred").cast("double"), F.sum("n_matched").cast("double")
    out = rows.filter("n_gt > 0").groupBy(*by).agg(
        F.count("*").alias("n_docs"), F.sum("n_gt").alias("n_gt"), F.sum("n_pred").alias("n_pred"), F.sum("n_matched").alias("n_matched"),
        F.round(F.try_divide(m, p), 6).alias("precision"), F.round(F.try_divide(m, g), 6).alias("recall"), F.round(F.try_divide(2 * m, g + p), 6).alias("f1"),
        F.round(F.try_divide(F.count_if((F.col("n_gt") == F.col("n_matched")) & (F.col("n_pred") == F.col("n_matched"))).cast("double"), F.count("*")), 6).alias("table_complete_rate"),
    )
    return out


def charge_line_states(truth: Column, pred: Column) -> Column:
    """For each printed charge line (rate, value) what the predicted lines say: correct, missing, wrong_value,
    wrong_rate or not_emitted. Both columns are array<struct<rate:decimal(38,2),value:decimal(38,2)>>.

    Lines are taken in order; a predicted line answers one printed line at most: the first with rate and value, else
    with the rate, else with the value.
    """

    def take(acc: Column, t: Column) -> Column:
        free = acc["free"]
        at = lambda test: F.get(F.filter(F.transform(free, lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull()), F.lit(0))
        both = at(lambda x: x["rate"].eqNullSafe(t["rate"]) & (x["value"] == t["value"]))
        rate, value = at(lambda x: x["rate"].eqNullSafe(t["rate"])), at(lambda x: x["value"] == t["value"])
        chosen = F.coalesce(both, rate, value)
        state = F.when(both.isNotNull(), "correct").when(rate.isNotNull(), F.when(F.get(free, rate)["value"].isNull(), "missing").otherwise("wrong_value")).when(value.isNotNull(), "wrong_rate").otherwise("not_emitted")
        left = F.when(chosen.isNull(), free).otherwise(F.filter(free, lambda x, i: i != chosen))
        return F.struct(left.alias("free"), F.concat(acc["states"], F.array(state)).alias("states"))

    lines = "array<struct<rate:decimal(38,2),value:decimal(38,2)>>"
    start = F.struct(F.coalesce(pred.cast(lines), F.array().cast(lines)).alias("free"), F.array().cast("array<string>").alias("states"))
    return F.aggregate(F.coalesce(truth.cast(lines), F.array().cast(lines)), start, take, lambda acc: acc["states"])
