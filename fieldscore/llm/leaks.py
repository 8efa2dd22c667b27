"""Evaluation texts that leak into training text: a distributed positional inverted index.

The index knows nothing of the test items and serves any number of them. It stands in segments: a segment holds some
thousand documents, and a row of it is a term (the hash of a normalised word) with all its positions in the segment as
gaps, in a numbering that runs through the segment's documents; a row of its own lists the documents and where each
begins. Segments are written where the text is read, so building the index shuffles nothing.

A query takes the postings of the test items' terms from all segments and brings those of one segment together. In the
segment each test passage starts from its rarest terms: their lists, less the term's offset in its item, are the places
where the item could begin, and the lists of the other terms are intersected with them, offset by offset. What holds on
one diagonal is a phrase, diagonals a word or two apart that go on where the other ends are proximity matches. Pairs that
reach the share by these are the result; pairs a few words short of it, where a misread word may stand at the edge of
a stretch, are settled by reading the two texts.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldscore.session import cut

_MARKUP = re.compile(r"</?[A-Za-z!][^<>]{0,200}>")
_UNSEEN = re.compile("[­​-‏⁠﻿]")
_DASHES = re.compile("[‐-―−﹘﹣－]")
_BROKEN = re.compile(r"(?<=\w)-[ \t]*\r?\n[ \t]*(?=\w)")
_INNER = re.compile(r"[^\w\s]+|_+")


@dataclass(frozen=True)
class LeakForm:
    """What counts as a leak, and the sizes the work is cut to.

    A stock phrase is a stretch of ``stock_shortest`` to ``stock_longest`` words, always cut alike, that stands without the
    item's words around it in ``stock_least`` different texts, as often as the item's long passages (and in ``stock_share`` of the distinct texts, if
    that's set); copies of a text count once, and longer passages are never stock however often they leak. A
    segment has at least ``segment`` words, items are taken in blocks of about ``block`` words. ``seeds`` are the rarest
    terms of each stretch that are looked up, so a stretch is lost only if all of them are misread.
    """

    stretch: int = 8
    share: float = 1 / 3
    stock_share: float = 0.0
    stock_least: int = 10
    stock_shortest: int = 6
    stock_longest: int = 20
    seeds: int = 3
    drift: int = 2
    near: float = 0.5
    segment: int = 400_000
    block: int = 400_000


def words(text: str | None) -> list[str]:
    """Lower-case words without markup, punctuation, soft hyphens and line-end hyphens; typography is folded."""
    if not text:
        return []
    t = unicodedata.normalize("NFKC", _UNSEEN.sub("", text))
    if "<" in t:
        t = _MARKUP.sub(" ", t)
    if "&" in t:
        t = html.unescape(t)
    t = _BROKEN.sub("", _DASHES.sub("-", t))
    return _INNER.sub("", t.casefold()).split()


_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


class WordHashes(dict):
    """64-bit hashes of words, each computed once; forgets all when it holds a million words."""

    def __missing__(self, w: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


GAP = 8  # free places between two documents of a segment
DIRECTORY = 0  # the term of a segment's list of documents
INDEX = "segment long, term long, gaps array<int>, ids array<string>, digests array<long>"


def positional_index(docs: DataFrame, doc: str = "doc_id", text: str = "text", form: LeakForm = LeakForm()) -> DataFrame:
    """(segment, term, gaps, ids, digests): the postings of every word of every document, and each segment's documents.

    Nothing is shuffled. A row of the directory has the documents' ids (as text), their first positions (as gaps) and
    digests of their words, which tell copies.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, hashes = TaskContext.get().partitionId() << 32, WordHashes()
        ids: list[str] = []
        held: list[np.ndarray] = []
        size = 0

        def written() -> pa.RecordBatch:
            lengths = np.array([len(x) for x in held])
            starts = GAP + np.cumsum(lengths + GAP) - (lengths + GAP)
            h = np.concatenate(held)
            pos = np.arange(len(h)) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
            order = np.argsort(h, kind="stable")
            h, pos = h[order], pos[order]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
            gaps = np.diff(pos, prepend=0)
            gaps[first] = pos[first]
            n = len(first) + 1
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, len(starts), len(starts) + np.r_[first[1:], len(h)]][: n + 1].astype(np.int32)), pa.array(np.r_[np.diff(starts, prepend=0), gaps].astype(np.int32)))
            only = pa.array(np.r_[0, np.full(n, len(ids))].astype(np.int32))  # of the directory's row
            names = pa.ListArray.from_arrays(only, pa.array(ids, pa.string()))
            digests = pa.ListArray.from_arrays(only, pa.array(np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in held], np.uint64).view(np.int64)))
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), pa.array(np.r_[DIRECTORY, h[first].view(np.int64)]), lists, names, digests], names=["segment", "term", "gaps", "ids", "digests"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ws = words(t)
                if not ws:
                    continue
                ids.append(i)
                held.append(np.fromiter(map(hashes.__getitem__, ws), dtype=np.uint64, count=len(ws)))
                size += len(ws)
                if size >= form.segment:
                    yield written()
                    ids, held, size, number = [], [], 0, number + 1
        if ids:
            yield written()

    read = docs.select(F.col(doc).cast("string").alias("id"), F.col(text).alias("text")).filter("id is not null and text is not null")
    return cut(read.mapInArrow(segments, INDEX))


class Items:
    """A block of test items as numbers: the sorted terms of all, and each item's words as places among them."""

    def __init__(self, ids: list[object], texts: list[list[str]]):
        hashes = WordHashes()
        self.ids, self.words = ids, texts
        self.size = np.array([len(ws) for ws in texts], dtype=np.int64)
        self.first = np.cumsum(self.size) - self.size
        flat = np.fromiter((hashes[w] for ws in texts for w in ws), dtype=np.uint64, count=int(self.size.sum())).view(np.int64)
        self.terms, self.word = np.unique(flat, return_inverse=True)
        self.item = np.repeat(np.arange(len(texts)), self.size)
        self.off = np.arange(len(flat)) - np.repeat(self.first, self.size)
        # with two free places around each item: what stands beside a word, without asking whose it is
        self.padded = np.full(len(flat) + 2 * len(texts) + 2, -2, np.int32)
        self.padded[np.arange(len(flat)) + 2 * self.item + 2] = self.word


def _expand(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs (first, count): which run each entry is of, and the entries."""
    of = np.repeat(np.arange(len(count)), count)
    return of, np.repeat(first - (np.cumsum(count) - count), count) + np.arange(len(of))


class Segment:
    """The postings of a segment that test items ask for, and the intersection of their lists."""

    def __init__(self, q: Items, form: LeakForm, terms: np.ndarray, offsets: np.ndarray, gaps: np.ndarray, starts: np.ndarray):
        self.q, self.form, self.starts = q, form, starts
        term = np.searchsorted(q.terms, terms)
        count = np.diff(offsets)
        run = np.cumsum(gaps)
        first = offsets[:-1] - offsets[0]
        gaps = gaps.astype(np.int64)
        self.pos = run - np.repeat(run[first] - gaps[first], count)
        self.first, self.count = np.zeros(len(q.terms), np.int64), np.zeros(len(q.terms), np.int64)
        self.first[term], self.count[term] = first, count
        self.margin = int(q.size.max(initial=0)) + 16
        top = int(max(self.pos.max(initial=0), starts[-1])) + 1
        self.at = np.full(top + 2 * self.margin, -1, np.int32)  # position -> the term whose list holds it
        self.at[self.pos + self.margin] = np.repeat(term, count)

    def seeds(self) -> np.ndarray:
        """The places (in the items' words) of the rarest terms of every stretch that are in the segment at all."""
        q, k = self.q, self.form.stretch
        often = self.count[q.word]
        if len(often) < k:
            return np.zeros(0, np.int64)
        rank = np.where(often > 0, often, 1 << 40)
        w = np.lib.stride_tricks.sliding_window_view(rank, k)
        inside = q.item[: len(w)] == q.item[k - 1 :]
        best = np.argpartition(w, self.form.seeds - 1, axis=1)[:, : self.form.seeds]
        chosen = np.unique((best + np.arange(len(w))[:, None])[inside])
        return chosen[often[chosen] > 0]

    def begins(self) -> tuple[np.ndarray, np.ndarray]:
        """(item, position of the item's first word): where a rare word stands in three or more in a row."""
        q, seed = self.q, self.seeds()
        of, entry = _expand(self.first[q.word[seed]], self.count[q.word[seed]])
        place, pos = seed[of].astype(np.int32), self.pos[entry].astype(np.int32) + self.margin
        word, at = q.padded, self.at
        inner = (place + 2 * q.item[place] + 2).astype(np.int32)
        left, right = at[pos - 1] == word[inner - 1], at[pos + 1] == word[inner + 1]
        some = np.flatnonzero(left | right)
        place, pos, inner, left, right = place[some], pos[some], inner[some], left[some], right[some]
        row = (left & right) | (left & (at[pos - 2] == word[inner - 2])) | (right & (at[pos + 2] == word[inner + 2]))
        place, pos = place[row].astype(np.int64), pos[row].astype(np.int64) - self.margin
        key = np.unique((q.item[place] << 40) + (pos - q.off[place] + self.margin))
        item, begin = key >> 40, (key & ((1 << 40) - 1)) - self.margin
        return item, begin

    def stretches(self) -> pd.DataFrame:
        """item, doc, off, last (item words from-to), start, end (positions): passages the documents repeat."""
        item, begin = self.begins()
        q = self.q
        of, place = _expand(q.first[item], q.size[item])
        off = q.off[place]
        pos = begin[of] + off
        hit = np.flatnonzero(self.at[pos + self.margin] == q.word[place])
        of, off, pos = of[hit], off[hit], pos[hit]
        doc = np.searchsorted(self.starts, pos, side="right") - 1
        def runs(of: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
            new = np.ones(len(of), bool)
            new[1:] = (of[1:] != of[:-1]) | (doc[1:] != doc[:-1]) | (low[1:] - high[:-1] > step)
            a = np.flatnonzero(new)
            return a, np.r_[a[1:], len(of)] - 1 if len(of) else a

        a, z = runs(of, doc, off, off, 1)  # words in a row
        a, z = a[z > a], z[z > a]  # a word on its own says nothing
        i, k = runs(of[a], doc[a], off[a], off[z], 2)  # rows with a single exchanged word between them
        longest = np.maximum.reduceat(z - a + 1, i) if len(i) else i
        a, z = a[i], z[k]
        f = pd.DataFrame({"item": item[of[a]], "doc": doc[a], "off": off[a], "last": off[z], "start": pos[a], "end": pos[z], "begin": begin[of[a]], "n": longest})
        f = f[f["n"] >= 3].sort_values(["item", "doc", "start", "end"], kind="stable")
        x, y = f.iloc[:-1], f.iloc[1:]
        v = lambda g, c: g[c].to_numpy()
        goes_on = (v(x, "item") == v(y, "item")) & (v(x, "doc") == v(y, "doc")) & (np.abs(v(x, "begin") - v(y, "begin")) <= self.form.drift)
        for lo, hi in (("off", "last"), ("start", "end")):
            step = v(y, lo) - v(x, hi)
            goes_on &= (step >= -2) & (step <= 4)
        f["g"] = np.cumsum(np.r_[True, ~goes_on][: len(f)])
        return f.groupby("g").agg(item=("item", "first"), doc=("doc", "first"), off=("off", "min"), last=("last", "max"), start=("start", "min"), end=("end", "max")).reset_index(drop=True)


FOUND = "place int, id string, parts array<int>, off int, n int, copy long"


def matches(index: DataFrame, block: Items, form: LeakForm) -> DataFrame:
    """For each pair of a document and an item (its number in the block) the item's words in its stretches, as pairs of
    first and last; beside them the short passages that stand alone (off, n), each with its document's digest."""
    spark = index.sparkSession
    shared = spark.sparkContext.broadcast(block)
    asked = spark.createDataFrame(pd.DataFrame({"term": np.r_[DIRECTORY, block.terms]}))  # bounded by form.block

    def segment(table: pa.Table) -> pa.Table:
        q = shared.value
        table = table.combine_chunks()
        term = table.column("term").to_numpy()
        lists = table.column("gaps").chunk(0)
        offsets, gaps = lists.offsets.to_numpy(), lists.values.to_numpy()
        top = int(np.flatnonzero(term == DIRECTORY)[0])
        starts = np.cumsum(gaps[offsets[top] : offsets[top + 1]].astype(np.int64))
        ids, digests = (table.column(c).chunk(0)[top].as_py() for c in ("ids", "digests"))
        digests = np.array(digests)
        keep = np.flatnonzero(term != DIRECTORY)
        count = np.diff(offsets)[keep]
        _, entry = _expand(offsets[keep], count)
        out = {k: [] for k in ("place", "id", "parts", "off", "n", "copy")}
        if len(keep):
            s = Segment(q, form, term[keep], np.r_[0, np.cumsum(count)], gaps[entry], starts)
            f = s.stretches()
            f["n"] = f["last"] - f["off"] + 1
            f = f[f["n"] >= 5]
            alone = f[f["n"].between(form.stock_shortest, form.stock_longest)]
            copy = digests[alone["doc"].to_numpy(dtype=np.int64)]
            for i, o, n, h in zip(alone["item"].tolist(), alone["off"].tolist(), alone["n"].tolist(), copy.tolist(), strict=True):
                for k, v in zip(out, (i, None, None, o, n, h), strict=True):
                    out[k].append(v)
            long = f.groupby(["item", "doc"])
            enough = f[long["n"].transform("sum").to_numpy() >= form.near * form.share * q.size[f["item"].to_numpy(dtype=np.int64)]]
            for (i, d), g in enough.groupby(["item", "doc"]):
                for k, v in zip(out, (i, ids[d], g[["off", "last"]].to_numpy().ravel().tolist(), None, None, None), strict=True):
                    out[k].append(v)
        kinds = (pa.int32(), pa.string(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int64())
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True)})

    return index.join(F.broadcast(asked), "term", "left_semi").groupBy("segment").applyInArrow(segment, FOUND)


def stock_phrases(found: DataFrame, least: int, longest: int) -> DataFrame:
    """(place, off, n): the passages that stand alone in many different documents (copies count once), and in no fewer than there are
    documents with long passages of their item: what is cut alike by chance is rarer than what it is cut from."""
    spans = F.transform(F.sequence(F.lit(0), F.size("parts") - 2, F.lit(2)), lambda k: F.get("parts", k + 1) - F.get("parts", k))
    long = found.filter(F.col("id").isNotNull() & F.exists(spans, lambda n: n >= longest)).groupBy("place").agg(F.count("*").alias("long"))
    alone = found.filter("id is null").groupBy("place", "off", "n").agg(F.count_distinct("copy").alias("places")).filter(F.col("places") >= least)
    return alone.join(long, "place", "left").filter(F.col("places") >= F.coalesce("long", F.lit(0))).select("place", "off", "n")


def near_words(a: str, b: str) -> bool:
    """Whether one word may be a misprint of the other: one edit from four letters on, two from eight on."""
    if a == b:
        return True
    la, lb = len(a), len(b)
    most = 0 if min(la, lb) < 4 else 1 if min(la, lb) < 8 else 2
    if abs(la - lb) > most or not most:
        return False
    if la == lb and sum(x != y for x, y in zip(a, b, strict=True)) <= most:
        return True
    prev = list(range(lb + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        if min(cur) > most:
            return False
        prev = cur
    return prev[-1] <= most


def _follow(item: list[str], doc: list[str], i: int, p: int, step: int) -> tuple[int, int]:
    """The last item and document word of the stretch that goes on from a hit; single exchanged, dropped or added
    words are passed over if the words go on behind them."""
    li, lp = i, p
    ni, nd = len(item), len(doc)

    def same(a: int, b: int) -> bool:
        return 0 <= a < ni and 0 <= b < nd and near_words(item[a], doc[b])

    while True:
        a, b = li + step, lp + step
        if same(a, b):
            li, lp = a, b
        elif same(a + step, b + step) and same(a + 2 * step, b + 2 * step):
            li, lp = a + step, b + step
        elif same(a + step, b) and same(a + 2 * step, b + step):
            li, lp = a + step, b
        elif same(a, b + step) and same(a + step, b + 2 * step):
            li, lp = a, b + step
        elif same(a + step, b + step) and (a + step in (0, ni - 1) or b + step in (0, nd - 1)):
            li, lp = a + step, b + step
        else:
            return li, lp


def repeated_words(item: list[str], doc: list[str], n: int, least: int) -> set[int]:
    """The offsets of the item's words that the document repeats in stretches of at least ``least`` item words."""
    where: dict[tuple[str, ...], list[int]] = {}
    wanted = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)}
    for p in range(len(doc) - n + 1):
        if (k := tuple(doc[p : p + n])) in wanted:
            where.setdefault(k, []).append(p)
    covered: set[int] = set()
    seen: set[tuple[int, int]] = set()
    for i in range(len(item) - n + 1):
        for p in where.get(tuple(item[i : i + n]), ()):
            if (i, p) in seen:
                continue
            ai, ap = _follow(item, doc, i, p, -1)
            bi, bp = _follow(item, doc, i + n - 1, p + n - 1, 1)
            d = min(len(item), bi - ai + 1)
            for k in range(d):  # hits within this stretch need not be followed again
                for x in (-1, 0, 1):
                    seen.add((ai + k, ap + k + x))
                    seen.add((bi - k, bp - k + x))
            if d >= least:
                covered.update(range(ai, bi + 1))
    return covered


def item_blocks(items: DataFrame, item: str, text: str, form: LeakForm) -> Iterator[Items]:
    """The items in blocks of about ``form.block`` words; an item in several texts stands for each of them."""
    rows = items.select(F.col(item).cast("string").alias("id"), F.col(text).alias("text")).filter("id is not null and trim(text) <> ''").distinct()
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = 1 + total // (5 * form.block)
    for b in range(blocks):
        held = [(i, ws) for i, t in rows.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).sort("id", "text").collect() if len(ws := words(t)) >= form.stretch]
        if held:
            yield Items([i for i, _ in held], [ws for _, ws in held])


def leaked_items(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", form: LeakForm = LeakForm(), index: DataFrame | None = None) -> DataFrame:
    """(doc_id, item_id): documents that repeat at least ``form.share`` of an item's words in long stretches.

    Blank and null items and texts never match; items that repeat each other are all reported; repeated documents are
    reported each, rows with a null id not at all. Items shorter than a stretch can't match. Stock phrases don't count
    among the repeated words. Ids keep their type. Columns beside the four named ones don't matter. ``index`` is a stored
    `positional_index` of the documents; without one it is made.
    """
    kinds = dict(docs.dtypes)[doc], dict(items.dtypes)[item]
    index = positional_index(docs, doc, text, form) if index is None else index
    least = form.stock_least
    if form.stock_share:
        least = max(least, int(form.stock_share * docs.select(F.xxhash64(text)).distinct().count()) + 1)
    parts = [_block(docs, doc, text, index, b, least, form) for b in item_blocks(items, item, item_text, form)]
    if not parts:
        return docs.sparkSession.createDataFrame([], f"doc_id {kinds[0]}, item_id {kinds[1]}")
    found = reduce(DataFrame.unionByName, parts).distinct()
    return found.select(F.col("id").cast(kinds[0]).alias("doc_id"), F.col("item").cast(kinds[1]).alias("item_id"))


def _block(docs: DataFrame, doc: str, text: str, index: DataFrame, block: Items, least: int, form: LeakForm) -> DataFrame:
    """(id, item) of one block of items."""
    spark = docs.sparkSession
    found = cut(matches(index, block, form))
    stock: dict[int, set[int]] = {}
    for p, o, n in stock_phrases(found, least, form.stock_longest).collect():  # a few an item
        stock.setdefault(p, set()).update(range(o, o + n))
    names = spark.createDataFrame([(k, i, len(ws), sorted(stock.get(k, ()))) for k, (i, ws) in enumerate(zip(block.ids, block.words, strict=True))], "place int, item string, size int, stock array<int>")
    pairs = found.filter("id is not null").select("place", "id", "parts").join(F.broadcast(names), "place")  # one row an item of the block
    ranges = F.transform(F.sequence(F.lit(0), (F.size("parts") / 2).cast("int") - 1), lambda k: F.sequence(F.get("parts", (2 * k).cast("int")), F.get("parts", (2 * k + 1).cast("int"))))
    covered = lambda least: F.size(F.array_except(F.array_distinct(F.flatten(F.filter(ranges, lambda r: F.size(r) >= least))), "stock"))
    pairs = pairs.withColumns({"sure": covered(form.stretch) >= form.share * F.col("size"), "maybe": covered(5) >= form.near * form.share * F.col("size")})
    sure = pairs.filter("sure").select("id", "item")
    doubtful = pairs.filter("maybe and not sure").groupBy("id").agg(F.collect_set("place").alias("places"))  # at most one entry an item
    shared = spark.sparkContext.broadcast((block, stock))

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, phrases = shared.value
        for b in batches:
            out = []
            for d, t, of in zip(b["id"], b["text"], b["places"], strict=True):
                ws = words(t)
                for i in of:
                    got = repeated_words(q.words[i], ws, 3, form.stretch) - phrases.get(i, set())
                    if len(got) >= form.share * len(q.words[i]):
                        out.append((d, q.ids[i]))
            yield pd.DataFrame(out, columns=["id", "item"], dtype=object)

    texts = docs.select(F.col(doc).cast("string").alias("id"), F.col(text).alias("text"))
    return sure.unionByName(texts.join(doubtful, "id").mapInPandas(settle, "id string, item string"))
