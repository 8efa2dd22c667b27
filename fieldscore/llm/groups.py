"""Splits that keep related records together.

Records that share a key of any kind belong together, directly or through others. The graph is built over keys, not
over records: a record with two keys is one edge between them, repeats of an edge count once, so a key held by a third
of all records costs as much as its distinct partners. Components come from parallel hooking and shortcutting: each
node's parent is a row of a table; in every round a node hooks onto its least neighbour, parents are replaced by
grandparents (two joins of the parent table with itself), and the edges are rewritten onto the roots, where most of
them vanish. Each round is written to the shared folder
and read again; the rounds before are deleted.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscore.session import cut, forget

# Keys that say a key is not known, reduced to lower-case letters and digits.
UNKNOWN_KEYS = (
    "", "na", "nan", "nil", "none", "notapplicable", "notavailable", "notgiven", "notknown", "notprovided", "notspecified", "null", "missing",
    "tba", "tbc", "tbd", "undefined", "undetermined", "unk", "unknown", "unspecified",
)


def reduced_key(key: Column, unknown: tuple[str, ...] = UNKNOWN_KEYS) -> Column:
    """A key's letters and digits in lower case; null for blank keys and words saying that it isn't known."""
    k = F.lower(F.regexp_replace(key.cast("string"), r"[^\p{L}\p{N}]+", ""))
    return F.when(~k.isin(*unknown), k)


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an undirected graph; root is the least node of the component.

    Loops, repeated edges and both directions are allowed; rows with a null end are left out; an empty table gives an
    empty result. Rounds grow with the logarithm of the longest path; ``max_rounds`` only guards against a fault.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    parents = cut(nodes.select("node", F.col("node").alias("root")))
    live = cut(pairs.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        if live.isEmpty():
            return parents
        both = live.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("other")), F.struct(F.col("v").alias("node"), F.col("u").alias("other")))))
        hooked = cut(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("up")))
        once = cut(_step(hooked))
        short = cut(_step(once))
        up = lambda frame, column: frame.join(short.select(F.col("node").alias(column), F.col("up").alias(f"{column}_up")), column, "left").withColumn(column, F.coalesce(f"{column}_up", column)).drop(f"{column}_up")
        old = [parents, live, hooked, once, short]
        parents = cut(up(parents, "root"))
        live = cut(up(up(live, "u"), "v").filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        for frame in old:
            forget(frame)
    raise RuntimeError(f"components: not done after {max_rounds} rounds")


def _step(p: DataFrame) -> DataFrame:
    """Shortcutting: every parent is replaced by its own parent."""
    q = p.select(F.col("node").alias("up"), F.col("up").alias("up2"))
    return p.join(q, "up", "left").select("node", F.coalesce("up2", "up").alias("up"))


def linked_groups(df: DataFrame, record: str, keys: list[str], unknown: tuple[str, ...] = UNKNOWN_KEYS) -> DataFrame:
    """(record, root): the least key of each record's group, as ``<number of the key column>:<reduced key>``.

    Keys of the first column are less than those of the second, so a root that starts with ``0:`` is the least key of
    the first kind in its group. A record without any known key is a group of its own: root ``~<record>``. A record
    given in several rows has the keys of all of them; ``unknown`` are the reduced keys that link nothing. Null records are left out; other columns don't matter.
    """
    kinds = [F.concat(F.lit(f"{i}:"), reduced_key(F.col(k), unknown)) for i, k in enumerate(keys)]
    held = df.filter(F.col(record).isNotNull()).select(F.col(record).alias("record"), F.array_compact(F.array(*kinds)).alias("keys"))
    # edges: keys of one row with each other; rows of one record (it may be delivered again) link through their keys too
    star = held.filter(F.size("keys") > 0).select(F.get("keys", F.lit(0)).alias("a"), F.explode("keys").alias("b")).distinct()
    repeats = held.filter(F.size("keys") > 0).groupBy("record").agg(F.min(F.get("keys", F.lit(0))).alias("a"), F.max(F.get("keys", F.lit(0))).alias("b"), F.count("*").alias("n")).filter("n > 1")
    again = held.filter(F.size("keys") > 0).join(repeats.filter("a <> b").select("record", F.col("a").alias("first")), "record").select(F.col("first").alias("a"), F.get("keys", F.lit(0)).alias("b")).distinct()
    roots = components(star.union(again))
    first = held.groupBy("record").agg(F.min(F.get("keys", F.lit(0))).alias("key"))
    known = first.join(roots.withColumnRenamed("node", "key"), "key", "left")
    return known.select("record", F.coalesce("root", F.concat(F.lit("~"), F.col("record").cast("string"))).alias("root"))


def reachable(sizes: list[tuple[int, int]], limit: int) -> int:
    """A bitset of the sums up to ``limit`` that can be made of sizes with multiplicities, which are split into powers of two."""
    mask, bits = (1 << (limit + 1)) - 1, 1
    for s, m in sizes:
        m, k = min(m, limit // s), 1
        while m > 0:
            k = min(k, m)
            bits |= (bits << (s * k)) & mask
            m -= k
            k *= 2
    return bits


def _meeting(a: int, b: int, goal: int, step: int = 1 << 20) -> int:
    """The least x with bit x in ``a`` and bit goal - x in ``b``, looked for in blocks."""

    def block(bits: int, low: int) -> np.ndarray:
        part = (bits >> low) & ((1 << step) - 1) if low >= 0 else (bits << -low) & ((1 << step) - 1)
        return np.unpackbits(np.frombuffer(part.to_bytes(step // 8, "little"), np.uint8), bitorder="little")

    for low in range(0, goal + 1, step):
        hit = np.flatnonzero(block(a, low) & block(b, goal - low - step + 1)[::-1])
        if len(hit):
            return low + int(hit[0])
    raise ValueError("the sum can't be made")


def exact_choice(sizes: list[tuple[int, int]], goal: int) -> dict[int, int]:
    """How many of each size make up ``goal``, which can be made: halves of the sizes are asked for two sums that meet, and
    so on. At any time two bitsets are held, however many sizes there are."""
    if goal == 0:
        return {}
    if len(sizes) == 1:
        return {sizes[0][0]: goal // sizes[0][0]}
    half = len(sizes) // 2
    x = _meeting(reachable(sizes[:half], goal), reachable(sizes[half:], goal), goal)
    return exact_choice(sizes[:half], x) | exact_choice(sizes[half:], goal - x)


def choose_totals(sizes: list[tuple[int, int]], targets: list[float], exact: int = 1 << 27) -> list[dict[int, int]]:
    """How many groups of each size go to each target so that the totals come as near to the targets as they can.

    ``sizes`` are (size, how many groups); there are at most sqrt(2 N) different sizes for N records. Targets are
    filled from the smallest on, each to the nearest sum that can be made of what is left, and the last gets the rest.
    Sums are exact for up to ``exact`` records (bitsets of 16 MB). Beyond that groups are
    counted in units of N / exact records, and what the units are off is made up by groups taken by falling size.
    """
    left = dict(sizes)
    total = sum(s * m for s, m in sizes)
    unit = max(1, -(-total // exact))
    out: list[dict[int, int]] = [{} for _ in targets]
    order = sorted(range(len(targets)), key=lambda i: (targets[i], i))
    for i in order[:-1]:
        goal = round(targets[i] * total / unit)
        coarse: dict[int, list[int]] = {}
        for s in sorted((s for s, m in left.items() if m and s >= unit), reverse=True):
            coarse.setdefault(s // unit, []).append(s)
        held = sorted(((w, sum(left[s] for s in ss)) for w, ss in coarse.items()), reverse=True)
        held = [(w, m) for w, m in held if w <= 2 * goal]
        bits = reachable(held, 2 * goal)
        below = (bits & ((1 << (goal + 1)) - 1)).bit_length() - 1
        above = bits >> goal
        over = (above & -above).bit_length() - 1 if above else goal + 1
        for w, n in exact_choice(held, below if goal - below <= over else goal + over).items() if held else ():
            for s in coarse[w]:
                k = min(n, left[s])
                if k:
                    out[i][s] = out[i].get(s, 0) + k
                    left[s] -= k
                    n -= k
        if unit > 1:  # what the units are off: give back, then fill by falling size
            short = round(targets[i] * total) - sum(s * n for s, n in out[i].items())
            while short < 0:
                s = max((s for s in out[i] if s <= -short), default=min(out[i]))
                n = min(out[i][s], max(1, -short // s))
                left[s] += n
                out[i][s] -= n
                if not out[i][s]:
                    del out[i][s]
                short += n * s
            for s in sorted((s for s, m in left.items() if m), reverse=True):
                if n := min(left[s], short // s):
                    out[i][s] = out[i].get(s, 0) + n
                    left[s] -= n
                    short -= n * s
    out[order[-1]] = {s: m for s, m in left.items() if m}
    return out


def rank_in_class(df: DataFrame, kind: str, key: str, rank: str, buckets: int = 1024) -> DataFrame:
    """Adds the 1-based rank of each row within its ``kind`` by the hash of ``key``, however large one kind is.

    Rows are ranked in hash buckets; the buckets' counts (at most ``buckets`` rows a kind) give what lies before.
    """
    from pyspark.sql import Window

    h = df.withColumn("__h", F.xxhash64(F.lit("rank"), F.col(key).cast("string"))).withColumn("__b", F.pmod("__h", F.lit(buckets)))
    within = h.withColumn("__r", F.row_number().over(Window.partitionBy(kind, "__b").orderBy("__h", key)))
    counts = h.groupBy(kind, "__b").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy(kind).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))).drop("__n")
    return within.join(before, [kind, "__b"]).withColumn(rank, F.col("__r") + F.coalesce("__before", F.lit(0))).drop("__h", "__b", "__r", "__before")


def split_groups(groups: DataFrame, targets: DataFrame, name: str = "split_name", share: str = "share") -> DataFrame:
    """(record, root, split): every group whole in one split, the splits' totals as near to the shares as can be.

    ``groups`` is the result of `linked_groups`; ``targets`` a handful of rows whose shares are scaled to sum 1 (null
    or negative shares count as 0). The driver sees only the histogram of group sizes. The same rows give the same
    splits whatever their partitioning. An empty table gives an empty result; no targets is an error.
    """
    wanted = [(r[0], max(0.0, r[1] or 0.0)) for r in targets.select(name, share).orderBy(F.desc(share), name).collect()]
    if not wanted or sum(s for _, s in wanted) <= 0:
        raise ValueError("split_groups: there are no shares")
    whole = sum(s for _, s in wanted)
    sizes = groups.groupBy("root").agg(F.count("*").alias("size"))
    sizes = cut(sizes)
    histogram = [(r[0], r[1]) for r in sizes.groupBy("size").count().collect()]
    chosen = choose_totals(histogram, [s / whole for _, s in wanted])
    bounds = []
    for s, _ in histogram:
        at = 0
        for (split, _), take in zip(wanted, chosen, strict=True):
            if n := take.get(s, 0):
                bounds.append((s, at, at + n, split))
                at += n
    spark = groups.sparkSession
    ranked = rank_in_class(sizes, "size", "root", "rank")
    limits = spark.createDataFrame(bounds, "size long, low long, high long, split string")
    placed = ranked.join(limits, "size").filter("rank > low and rank <= high").select("root", "split")
    return groups.join(placed, "root").select("record", "root", "split")
