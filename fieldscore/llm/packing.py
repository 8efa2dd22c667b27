"""Texts into windows of fixed capacity: lexical retrieval packing.

Texts are measured in tokens of a public tokenizer, whose token ids are also the terms of a BM25 index (so the statistics
of all documents are one row a vocabulary entry). Documents of one series share shards of a bounded number of documents,
small series are pooled; each shard has its own inverted index and is packed by one call. Which shard a document lies in
depends on the table alone, not on partitions. In a shard the longest unused document seeds a window, the index returns
its unused neighbours by score, which fill the window greedily as long as the room they leave can still be filled, and
what room is left then goes to the longest unused documents that fit.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldscore.session import cut

# Fixed value: the public pattern that splits text before the merges of the byte-level vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WINDOW = "container string, window_id string, doc_id string, piece_no int, start_token int, n_tokens int"


@dataclass(frozen=True)
class PackForm:
    """``tokenizer`` is the rank file of a byte-level BPE (read by the driver and sent to the tasks); ``shard`` the
    documents that share an index; ``most_hot`` how many series larger than a shard are joined by broadcast."""

    tokenizer: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    pattern: str = SPLIT
    shard: int = 2000
    k1: float = 1.2
    b: float = 0.75
    most_hot: int = 100_000


@lru_cache(maxsize=2)
def encoding(ranks: bytes, pattern: str):  # noqa: ANN201
    """The tokenizer of a rank file's content."""
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})


def _packed(a: np.ndarray) -> bytes:
    return a.astype(np.uint32 if len(a) and a.max() > 65535 else np.uint16).tobytes()


def _unpacked(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, np.uint32 if len(blob) == 4 * n else np.uint16).astype(np.int64)


def token_rows(docs: DataFrame, doc: str, text: str, series: str | None, form: PackForm) -> DataFrame:
    """(doc_id, series, h, n, n_terms, terms, tfs): the number of tokens, the distinct token ids and how often each comes. Ids travel as text, so that ids beside nulls keep all digits."""
    with open(form.tokenizer, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(ranks.value, form.pattern)
        for b in batches:
            sizes, n_terms, terms, tfs = [], [], [], []
            for t in b["text"]:
                ids = np.array(enc.encode_ordinary(t), dtype=np.int64) if t else np.zeros(0, np.int64)
                u, n = np.unique(ids, return_counts=True)
                sizes.append(len(ids))
                n_terms.append(len(u))
                terms.append(_packed(u))
                tfs.append(_packed(n))
            yield pd.DataFrame({"doc_id": b["doc_id"], "series": b["series"], "h": b["h"], "n": sizes, "n_terms": n_terms, "terms": terms, "tfs": tfs})

    named = F.lower(F.regexp_replace(F.col(series).cast("string"), r"[^\p{L}\p{N}]+", "")) if series else F.lit("")
    read = docs.select(F.col(doc).cast("string").alias("doc_id"), F.col(text).alias("text"), F.coalesce(named, F.lit("")).alias("series"), F.xxhash64(F.col(doc).cast("string"), F.col(text)).alias("h"))
    return read.mapInPandas(run, "doc_id string, series string, h long, n int, n_terms int, terms binary, tfs binary")


def with_shard(rows: DataFrame, total: int, form: PackForm) -> DataFrame:
    """Adds ``shard``: a series larger than a shard has as many as it needs, told by each document's hash; the smaller
    ones are pooled by the hash of their name. The same table gives the same shards on any cluster."""
    sizes = cut(rows.groupBy("series").agg(F.count("*").alias("of_series")).filter(F.col("of_series") > form.shard))
    n_hot, in_hot = sizes.agg(F.count("*"), F.coalesce(F.sum("of_series"), F.lit(0))).first()
    pools = max(1, -(-(total - in_hot) // form.shard))
    out = rows.join(F.broadcast(sizes) if n_hot <= form.most_hot else sizes, "series", "left")
    own = F.concat(F.col("series"), F.lit(":"), F.pmod("h", F.ceil(F.col("of_series") / form.shard)).cast("string"))
    pooled = F.concat(F.lit(":"), F.pmod(F.xxhash64(F.lit("pool"), F.col("series")), F.lit(pools)).cast("string"))
    return out.withColumn("shard", F.coalesce(own, pooled)).drop("of_series")


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, df): in how many documents each token id comes; each task sends one row a term at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            ids = [_unpacked(x, k) for x, k in zip(b["terms"], b["n_terms"], strict=True)]
            if ids:
                c = np.bincount(np.concatenate(ids), minlength=len(total))
                if len(c) > len(total):
                    total = np.pad(total, (0, len(c) - len(total)))
                total[: len(c)] += c
        hit = np.flatnonzero(total)
        yield pd.DataFrame({"term": hit, "df": total[hit]})

    return rows.select("terms", "n_terms").mapInPandas(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


class ShardIndex:
    """The BM25 scores of a shard's documents for each other's terms.

    The postings (term, document, weight) are grouped by term and multiplied out once for all containers: short lists
    pair by pair, long ones in blocks of terms. A term that one document alone holds finds no other and is left out.
    ``score[i, j]`` is the score of document j for the terms of document i.
    """

    BLOCK, LONG = 1024, 24

    def __init__(self, terms: list[np.ndarray], tfs: list[np.ndarray], lengths: np.ndarray, idf: np.ndarray, mean: float, form: PackForm):
        n = len(terms)
        doc = np.repeat(np.arange(n), [len(t) for t in terms])
        term = np.concatenate([np.zeros(0, np.int64), *terms])
        tf = np.concatenate([np.zeros(0, np.int64), *tfs]).astype(np.float32)
        norm = (form.k1 * (1 - form.b + form.b * lengths / max(mean, 1.0))).astype(np.float32)
        weight = idf[np.minimum(term, len(idf) - 1)] * tf * np.float32(form.k1 + 1) / (tf + norm[doc])
        held = np.bincount(term, minlength=1)
        order = np.argsort(term, kind="stable")
        order = order[held[term[order]] > 1]
        doc, weight, size = doc[order], weight[order], held[term[order]]
        starts = np.ones(len(order), bool)
        starts[1:] = term[order][1:] != term[order][:-1]
        slot = np.cumsum(starts) - 1
        self.score = self._short(n, doc, weight, size, starts, size <= self.LONG)
        long = size > self.LONG
        self._add_long(doc[long], weight[long], slot[long])

    @staticmethod
    def _short(n: int, doc: np.ndarray, weight: np.ndarray, size: np.ndarray, starts: np.ndarray, take: np.ndarray) -> np.ndarray:
        doc, weight, size = doc[take], weight[take], size[take]
        lists = np.flatnonzero(starts[take])
        first = np.repeat(lists, size[lists])  # of each posting, where its term's list begins
        of = np.repeat(np.arange(len(doc)), size)
        with_ = np.repeat(first, size) + np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        flat = np.bincount(doc[of] * n + doc[with_], weights=weight[with_], minlength=n * n)
        return flat.astype(np.float32).reshape(n, n)

    def _add_long(self, doc: np.ndarray, weight: np.ndarray, slot: np.ndarray) -> None:
        n = len(self.score)
        slot = np.unique(slot, return_inverse=True)[1]
        for low in range(0, int(slot[-1]) + 1 if len(slot) else 0, self.BLOCK):
            x = slice(*np.searchsorted(slot, [low, low + self.BLOCK]))
            width = int(slot[x.stop - 1]) - low + 1
            has, by = np.zeros((width, n), np.float32), np.zeros((width, n), np.float32)
            has[slot[x] - low, doc[x]] = 1
            by[slot[x] - low, doc[x]] = weight[x]
            self.score += has.T @ by


class Room:
    """Unused items by length."""

    def __init__(self, size: np.ndarray, unused: np.ndarray, capacity: int):
        items = np.flatnonzero(unused)
        items = items[np.lexsort((-items, size[items]))]
        at = np.searchsorted(size[items], np.arange(capacity + 2))
        self.held = {int(n): items[at[n] : at[n + 1]].tolist() for n in np.unique(size[items])}
        self.count = np.zeros(capacity + 1, np.int64)
        self.count[: capacity + 1] = np.diff(at)[: capacity + 1]
        self.most = capacity

    def took(self, n: int) -> None:
        self.count[n] -= 1

    def _of_length(self, n: int, unused: np.ndarray) -> int:
        held = self.held[n]
        while not unused[held[-1]]:
            held.pop()
        return held[-1]

    def longest(self, room: int, unused: np.ndarray) -> int:
        """The longest unused item of at most ``room`` tokens, or -1."""
        at = self.count[: min(room, self.most) + 1].nonzero()[0]
        return self._of_length(int(at[-1]), unused) if len(at) else -1

    def fullest(self, room: int, unused: np.ndarray) -> int:
        """The longer item of the one or two unused ones that leave the least of ``room``, or -1."""
        n = min(room, self.most)
        count = self.count[: n + 1]
        at = count.nonzero()[0]
        if not len(at):
            return -1
        below = np.zeros(n + 1, np.int64)
        below[at] = at
        below = np.maximum.accumulate(below)  # the longest unused item of at most so many tokens
        second = below[n - at]
        twice = (second == at) & (count[at] < 2)
        second = np.where(twice, below[np.maximum(np.minimum(n - at, at - 1), 0)], second)
        best = int((at + second).argmax())
        return self._of_length(int(max(at[best], second[best])), unused)

    def closed(self, room: int, slack: int) -> np.ndarray:
        """By room left over, 0 to ``room``: whether it is waste that's small enough or as long as some unused item, but for ``slack``."""
        upto = np.r_[0, np.cumsum(self.count[: room + 1])]
        low = np.maximum(np.arange(room + 1) - slack, 0)
        ok = upto[1:] > upto[low]
        ok[: slack + 1] = True
        return ok


@dataclass
class Packed:
    """Windows of (document, piece, start, tokens), and how many items seeded a window, came by retrieval, or by length."""

    windows: list[list[tuple[int, int, int, int]]]
    seeds: int = 0
    retrieved: int = 0
    fitted: int = 0


def pack_shard(lengths: np.ndarray, capacity: int, score: np.ndarray) -> Packed:
    """No window holds more than ``capacity``, every token is in one. All unused documents of the shard are neighbours of a
    seed in the order of their score; the nearest that fits, and leaves room that is wide or can be filled, is next."""
    windows: list[list[tuple[int, int, int, int]]] = []
    n_docs = len(lengths)
    pieces = np.where(lengths > capacity, lengths // capacity, 0)
    for i in np.flatnonzero(pieces).tolist():
        windows += [[(i, k, k * capacity, capacity)] for k in range(int(pieces[i]))]
    size = lengths - pieces * capacity  # what is left to place of each document
    unused = size > 0
    room_of = Room(size, unused, capacity)
    slack = capacity // 256  # what a window may waste without a second thought
    wide = int(2 * np.median(size[unused])) if unused.any() else 0
    out = Packed(windows)

    def put(window: list[tuple[int, int, int, int]], i: int) -> int:
        unused[i] = False
        n = int(size[i])
        room_of.took(n)
        window.append((i, int(pieces[i]), int(lengths[i]) - n, n))
        return n

    live = np.arange(n_docs)
    while (seed := room_of.longest(capacity, unused)) >= 0:
        window: list[tuple[int, int, int, int]] = []
        room = capacity - put(window, seed)
        out.seeds += 1
        if 2 * int(np.count_nonzero(unused[live])) < len(live):
            live = live[unused[live]]
        near = live[unused[live] & (size[live] <= room)]
        s, length = score[seed, near], size[near]
        while len(near):
            left = room - length
            ok = (left >= wide) | room_of.closed(min(room, wide), slack)[np.minimum(left, wide)]
            at = int(np.where(ok, s, np.float32(-1)).argmax())
            if not ok[at]:
                break
            room -= put(window, int(near[at]))
            out.retrieved += 1
            length[at] = room + 1  # used
            keep = length <= room
            near, s, length = near[keep], s[keep], length[keep]
        while (j := room_of.fullest(room, unused)) >= 0:
            room -= put(window, j)
            out.fitted += 1
        windows.append(window)
    empty = np.flatnonzero(lengths == 0).tolist()
    if empty:  # texts without tokens need no room
        if not windows:
            windows.append([])
        windows[-1] += [(i, 0, 0, 0) for i in empty]
    return out


def pack_windows(docs: DataFrame, containers: DataFrame, doc: str = "doc_id", text: str = "text", series: str | None = None, form: PackForm = PackForm()) -> DataFrame:
    """(container, window_id, doc_id, piece_no, start_token, n_tokens): where each document stands, for each container.

    A document is split only if it alone exceeds the capacity: into full pieces, of which each is a window, and a rest
    that is packed like a document. Null and empty texts have no tokens and lie in some window; repeated rows are
    items of their own; containers without a positive capacity are an error; empty tables give an empty result. Columns
    beside the named ones don't matter. ``containers`` is checked to have at most 1000 rows. The same tables give the
    same windows however they are partitioned.
    """
    spark = docs.sparkSession
    wanted = [(r[0], r[1]) for r in containers.select("container", "capacity").limit(1001).collect()]
    if len(wanted) > 1000 or any(not c or c <= 0 for _, c in wanted):
        raise ValueError("pack_windows: at most 1000 containers, each with a positive capacity")
    rows = cut(token_rows(docs, doc, text, series, form))
    total, mean = rows.agg(F.count("*"), F.avg("n")).first()
    counts = term_counts(rows).toPandas()  # one row a vocabulary entry
    idf = np.zeros(int(counts["term"].max()) + 2 if len(counts) else 2, np.float32)
    idf[counts["term"]] = np.log1p((total - counts["df"] + 0.5) / (counts["df"] + 0.5))
    shared = spark.sparkContext.broadcast((idf, float(mean or 0.0)))

    def packed(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["series", "h"], kind="stable")
        name = b["shard"].iloc[0]
        parts = np.array_split(np.arange(len(b)), -(-len(b) // form.shard))  # a pool may exceed a shard
        return pd.concat([one(b.iloc[x], f"{name}/{k}") for k, x in enumerate(parts)], ignore_index=True)

    def one(b: pd.DataFrame, name: str) -> pd.DataFrame:
        idf, mean = shared.value
        terms = [_unpacked(x, k) for x, k in zip(b["terms"], b["n_terms"], strict=True)]
        tfs = [_unpacked(y, k) for y, k in zip(b["tfs"], b["n_terms"], strict=True)]
        lengths = b["n"].to_numpy().astype(np.int64)
        score = ShardIndex(terms, tfs, lengths, idf, mean, form).score
        ids = b["doc_id"].to_numpy()
        out = []
        for container, capacity in wanted:
            windows = pack_shard(lengths, capacity, score).windows
            item = np.array([p for w in windows for p in w], dtype=np.int64).reshape(-1, 4)
            number = np.repeat(np.arange(len(windows)), [len(w) for w in windows])
            out.append(pd.DataFrame({"container": container, "window_id": [f"{name}-{w}" for w in number], "doc_id": ids[item[:, 0]], "piece_no": item[:, 1], "start_token": item[:, 2], "n_tokens": item[:, 3]}))
        return pd.concat(out, ignore_index=True)

    return with_shard(rows, total, form).groupBy("shard").applyInPandas(packed, WINDOW).withColumn("doc_id", F.col("doc_id").cast(dict(docs.dtypes)[doc]))
