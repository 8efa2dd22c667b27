"""Linear-chain conditional random field over word-shape features, in numpy.

Tokens, hashes and shapes of a whole batch of texts come from a few passes over its code points; no token is ever a
Python object. Scores are sums of hashed feature weights; what only depends on one token is summed once per distinct
token of the batch. Training maximises the likelihood of labelled token sequences (forward-backward, Adagrad);
decoding is Viterbi over batches of texts of similar length.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pandas as pd

NEG = np.float32(-1e4)
_TOP = 0x10000  # code points from here on are one symbol
_U = np.uint64
_DASHES, _QUOTES = set("‐‑‒–—−"), set("’‘`´")


def _alone(c: int) -> bool:
    """Scripts written without spaces: each sign is a token."""
    return 0x3040 <= c < 0x3100 or 0x3400 <= c < 0xA000 or 0xF900 <= c < 0xFB00


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind, fold, shape = np.full(_TOP + 1, 1, np.uint8), np.zeros(_TOP + 1, np.uint32), np.full(_TOP + 1, 2, np.uint8)
    for c in range(_TOP):
        x = chr(c)
        low = x.lower()
        kind[c] = 0 if x.isspace() or c == 0 else 2 if x.isdigit() else 3 if _alone(c) else 1 if x.isalpha() else 3
        fold[c] = ord("-") if x in _DASHES else ord("'") if x in _QUOTES else ord("0") if x.isdigit() else ord(low) if len(low) == 1 else c
        shape[c] = 3 if x.isdigit() else 5 if _alone(c) else 1 if x.isupper() else 2 if x.isalpha() else 4
    fold[_TOP] = _TOP
    kind[0xAD], shape[0xAD] = 1, 2  # a soft hyphen is a part of its word
    return kind, fold, shape


_KIND, _FOLD, _SHAPE = _tables()
_rng = np.random.default_rng(7)
_MIX = _rng.integers(1, 2**63, _TOP + 1, dtype=np.uint64) | _U(1)
_POS = _rng.integers(1, 2**63, 64, dtype=np.uint64) | _U(1)


def _stir(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(29))
    h = h * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


@dataclass
class Tokens:
    """The tokens of a batch: where they stand in their text, and the number of their kind.

    A kind is a distinct token, case and all; ``cased``, ``word``, ``shape`` and ``suffix`` are hashes by kind.
    """

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    kind: np.ndarray
    gap: np.ndarray  # 0 joined to the token before, 1 a space, 2 a line break, 3 the start of the text
    cased: np.ndarray
    word: np.ndarray
    shape: np.ndarray
    suffix: np.ndarray


def _codes(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), _TOP)


def tokenize(texts: list[str]) -> Tokens:
    """Runs of letters, runs of digits and single other signs of all texts; white space only separates."""
    lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    whole = "\0".join(texts) + "\0"
    cp = _codes(whole)
    kind = _KIND[cp]
    begins = kind == 3
    begins[0] |= kind[0] != 0
    begins[1:] |= kind[1:] != kind[:-1]
    begins &= kind != 0
    inside = kind != 0
    stops = np.empty_like(begins)  # the last code point of a token
    stops[-1], stops[:-1] = inside[-1], inside[:-1] & (~inside[1:] | begins[1:])
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    offsets = np.cumsum(lengths) - lengths
    if not len(starts):
        z, h = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return Tokens(z, z, z, z, np.zeros(0, np.uint8), h, h, h, h)
    size = ends - starts
    chars = cp[inside] if not inside.all() else cp
    first = np.cumsum(size) - size
    pos = np.minimum(np.arange(len(chars), dtype=np.int32) - np.repeat(first.astype(np.int32), size), 62)
    cased = _stir(np.add.reduceat(_MIX[chars] * _POS[pos], first))
    number, distinct = pd.factorize(cased)
    some = np.empty(len(distinct), np.int64)
    some[number[::-1]] = np.arange(len(number))[::-1]  # the first token of each kind
    word, shape, suffix = _kinds([whole[a:b].replace("\xad", "") or "\xad" for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)])
    doc = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, np.r_[offsets, len(cp)])))
    line = np.cumsum((cp == 10) | (cp == 13), dtype=np.int32)
    gap = np.zeros(len(starts), np.uint8)
    gap[1:] = (starts[1:] > ends[:-1]).astype(np.uint8) + (line[starts[1:]] > line[starts[:-1]])
    gap[np.r_[True, doc[1:] != doc[:-1]]] = 3
    base = offsets[doc]
    return Tokens(doc, starts - base, ends - base, number.astype(np.int64), gap, distinct.astype(np.uint64), word, shape, suffix)


def _kinds(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each token without case and with digits alike, of its shape, and of its last three letters."""
    size = np.array([len(t) for t in tokens], dtype=np.int64)
    cp = _codes("".join(tokens))
    first = np.cumsum(size) - size
    pos = np.arange(len(cp)) - np.repeat(first, size)
    folded, sh = _FOLD[cp], _SHAPE[cp]
    word = _stir(np.add.reduceat(_MIX[folded] * _POS[np.minimum(pos, 62)], first))
    turn = pos == 0
    turn[1:] |= sh[1:] != sh[:-1]
    n_turn = np.cumsum(turn)
    k = np.minimum(n_turn - np.repeat(n_turn[first], size), 62)
    kind = _KIND[cp[first]]
    extra = np.where(kind == 2, np.minimum(size, 9) + 10, np.where(kind == 3, folded[first].astype(np.int64) + 100, np.minimum(size, 2)))
    shape = _stir(np.add.reduceat(np.where(turn, _MIX[sh] * _POS[k], _U(0)), first) ^ (extra.astype(np.uint64) * _U(0x9E3779B97F4A7C15)))
    tail = np.repeat(size, size) - 1 - pos
    suffix = _stir(np.add.reduceat(np.where(tail < 3, _MIX[folded] * _POS[np.clip(tail, 0, 2) + 40], _U(0)), first))
    return word, shape, suffix


_SALT = [_U(x) for x in _rng.integers(1, 2**63, 64, dtype=np.uint64)]


class Crf:
    """Labels, hashed weights (``2**bits`` rows) and transitions."""

    def __init__(self, kinds: list[str], bits: int = 19):
        self.kinds = kinds
        self.labels = ["O", *[f"{p}-{k}" for k in kinds for p in "BI"]]
        n = len(self.labels)
        self.bits = bits
        self.weights = np.zeros((1 << bits, n), np.float32)
        self.moves = np.zeros((n, n), np.float32)
        self.first = np.zeros(n, np.float32)
        self.banned = np.zeros((n, n), bool)
        for j, y in enumerate(self.labels):
            if y[0] == "I":
                for i, x in enumerate(self.labels):
                    self.banned[i, j] = x not in (y, "B" + y[1:])
        self.first_banned = np.array([y[0] == "I" for y in self.labels])

    # features -----------------------------------------------------------------------------------------------------
    def _slot(self, h: np.ndarray, salt: int) -> np.ndarray:
        return (_stir(h ^ _SALT[salt]) >> _U(64 - self.bits)).astype(np.int64)

    @staticmethod
    def _shift(a: np.ndarray, k: int, doc: np.ndarray) -> np.ndarray:
        """The value k tokens on, or 0 beyond the text."""
        out = np.zeros_like(a)
        n = len(a)
        if abs(k) >= n:
            return out
        if k > 0:
            out[:-k] = np.where(doc[:-k] == doc[k:], a[k:], a.dtype.type(0))
        elif k < 0:
            out[-k:] = np.where(doc[-k:] == doc[:k], a[:k], a.dtype.type(0))
        else:
            out[:] = a
        return out

    #: what one token says about the label k tokens before or behind it
    SINGLE = {-3: "w", -2: "ws", -1: "wsu", 0: "wsuc", 1: "wsu", 2: "ws", 3: "w"}

    def _single(self, w: np.ndarray, s: np.ndarray, u: np.ndarray, c: np.ndarray, k: int) -> list[np.ndarray]:
        by = {"w": w, "s": s, "u": u, "c": c}
        return [self._slot(by[f], (k + 3) * 4 + "wsuc".index(f)) for f in self.SINGLE[k]]

    def _pairs(self, t: Tokens) -> list[np.ndarray]:
        d, word, shape = t.doc, t.word[t.kind], t.shape[t.kind]
        sh = lambda a, k: self._shift(a, k, d)
        g = t.gap.astype(np.uint64) + _U(1)
        g1 = sh(g, 1)
        w1, wn, s1, sn = sh(word, -1), sh(word, 1), sh(shape, -1), sh(shape, 2)
        snext = sh(shape, 1)
        mul = lambda a, m: a * _U(m)
        return [
            self._slot(w1 ^ mul(shape, 3), 30),
            self._slot(wn ^ mul(shape, 5), 31),
            self._slot(s1 ^ mul(shape, 7) ^ mul(snext, 9) ^ mul(g, 1315423911), 32),
            self._slot(mul(shape, 11) ^ mul(snext, 13) ^ mul(sn, 15) ^ mul(g1, 2654435761), 33),
            self._slot(mul(sh(word, -2), 17) ^ w1, 34),
            self._slot(mul(g, 40503) ^ mul(g1, 2246822519) ^ shape, 35),
            self._slot(w1 ^ mul(word, 19), 36),
        ]

    def all_slots(self, t: Tokens) -> np.ndarray:
        """(tokens, features): for training, where each feature's slot is needed."""
        cols = []
        for k in self.SINGLE:
            parts = [self._shift(a[t.kind], k, t.doc) for a in (t.word, t.shape, t.suffix, t.cased)]
            cols += self._single(*parts, k)
        return np.stack(cols + self._pairs(t), axis=1)

    def scores(self, t: Tokens) -> np.ndarray:
        """(tokens, labels): the sum of all features' weights."""
        w, s, u, c = (np.r_[np.zeros(1, np.uint64), a] for a in (t.word, t.shape, t.suffix, t.cased))
        kind = t.kind + 1  # 0 stands for what is beyond the text
        total = np.zeros((len(kind), len(self.labels)), np.float32)
        for k in self.SINGLE:
            by_kind = sum(self.weights[x] for x in self._single(w, s, u, c, k))
            total += by_kind[self._shift(kind, k, t.doc)]
        for x in self._pairs(t):
            total += self.weights[x]
        return total

    # decoding -----------------------------------------------------------------------------------------------------
    def decode(self, texts: list[str], most_chars: int = 2_000_000) -> list[list[tuple[int, int, str]]]:
        """The spans (start, end, kind) of each text; texts of like length are taken together up to ``most_chars``."""
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        at = 0
        while at < len(order):
            size, end = 0, at
            while end < len(order) and (end == at or size + len(texts[order[end]]) <= most_chars):
                size += len(texts[order[end]])
                end += 1
            for i, spans in zip(order[at:end], self._decode([texts[i] for i in order[at:end]]), strict=True):
                out[i] = spans
            at = end
        return out

    def _decode(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        t = tokenize(texts)
        spans: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        if not len(t.doc):
            return spans
        labels = self.viterbi(self.scores(t), t.doc, len(texts))
        hit = np.flatnonzero(labels)
        for i in hit[labels[hit] % 2 == 1]:
            y, j, n = labels[i], i + 1, len(labels)
            while j < n and labels[j] == y + 1 and t.doc[j] == t.doc[i]:
                j += 1
            spans[t.doc[i]].append((int(t.start[i]), int(t.end[j - 1]), self.kinds[(y - 1) // 2]))
        return spans

    MOST_BACK = 1 << 28  # bytes of back pointers held at once

    def viterbi(self, e: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
        """The best labels of every text as a whole; texts of half to full length of the longest go together."""
        counts = np.bincount(doc, minlength=n_docs)
        starts = np.cumsum(counts) - counts
        order = np.argsort(-counts, kind="stable")
        order = order[counts[order] > 0]
        out = np.zeros(len(e), np.int64)
        i = 0
        while i < len(order):
            longest = int(counts[order[i]])
            j = int(np.searchsorted(-counts[order], -(longest // 2 if longest > 64 else 0), side="left"))
            j = max(i + 1, min(j, i + min(1024, self.MOST_BACK // (longest * len(self.labels)))))
            g = order[i:j]
            y = self._viterbi_group(e, starts[g], counts[g])
            t = np.arange(longest)[:, None]
            ok = t < counts[g]
            out[(starts[g] + t)[ok]] = y[ok]
            i = j
        return out

    def _viterbi_group(self, e: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """(steps, sequences): the best labels of sequences sorted by falling length; each step looks at those that go on.

        I-labels are only reached from their own B and I, so those steps compare two labels and not all.
        """
        longest, n, m = int(counts[0]), len(self.labels), len(counts)
        back = np.zeros((longest, n, m), np.uint8)
        score = e[starts].T + np.where(self.first_banned, NEG, self.first)[:, None]
        alive = np.searchsorted(-counts, -np.arange(1, longest + 1), side="right")
        opens = np.array([0, *range(1, n, 2)])  # O and the B labels, reached from anywhere
        to_open = self.moves[:, opens].T.copy()[:, :, None]
        each, columns = np.arange(len(opens))[:, None], np.arange(m)
        inner = np.arange(2, n, 2)
        from_b, from_i = self.moves[inner - 1, inner][:, None], self.moves[inner, inner][:, None]
        for k in range(1, longest):
            m = alive[k]
            s = score[:, :m]
            through = s[None, :, :] + to_open
            b = through.argmax(1)
            x, y = s[inner - 1] + from_b, s[inner] + from_i
            new = np.empty((n, m), np.float32)
            new[opens] = through[each, b, columns[:m]]
            new[inner] = np.maximum(x, y)
            back[k, opens, :m] = b
            back[k, inner, :m] = np.where(y > x, inner[:, None], inner[:, None] - 1)
            new += e[starts[:m] + k].T
            if not k % 64:
                new -= new.max(0)  # only differences count; sums of long texts would lose digits
            score[:, :m] = new
        y = score.argmax(0)
        out = np.zeros((longest, len(counts)), np.int8)
        rows = np.arange(len(counts))
        for k in range(longest - 1, -1, -1):
            m = alive[k]
            out[k, :m] = y[:m]
            if k:
                y[:m] = back[k, y[:m], rows[:m]]
        return out

    # storing ------------------------------------------------------------------------------------------------------
    def to_bytes(self) -> bytes:
        held = io.BytesIO()
        np.savez_compressed(held, kinds=np.array(self.kinds), bits=self.bits, weights=self.weights, moves=self.moves, first=self.first)
        return held.getvalue()

    @classmethod
    def from_bytes(cls, blob: bytes) -> Crf:
        x = np.load(io.BytesIO(blob), allow_pickle=False)
        m = cls([str(k) for k in x["kinds"]], int(x["bits"]))
        m.weights, m.moves, m.first = x["weights"], x["moves"], x["first"]
        return m

    # training -----------------------------------------------------------------------------------------------------
    def fit(self, texts: list[str], spans: list[list[tuple[int, int, str]]], epochs: int = 10, rate: float = 0.25, l2: float = 2e-6, batch: int = 96, seed: int = 5) -> Crf:
        """Maximum likelihood over labelled texts; spans are (start, end, kind) in code points."""
        rng = np.random.default_rng(seed)
        t = tokenize(texts)
        gold = self.gold(t, spans)
        slots = self.all_slots(t)
        counts = np.bincount(t.doc, minlength=len(texts))
        starts = np.cumsum(counts) - counts
        used = np.flatnonzero(counts)
        n = len(self.labels)
        g_w, g_m, g_f = np.full_like(self.weights, 1e-2), np.full_like(self.moves, 1e-2), np.full_like(self.first, 1e-2)
        rng.shuffle(used)
        by_len = np.concatenate([c[np.argsort(counts[c])] for c in np.array_split(used, max(1, len(used) // (batch * 8)))])
        batches = []
        for i in range(0, len(by_len), batch):
            group = by_len[i : i + batch]
            rows = np.concatenate([np.arange(starts[d], starts[d] + counts[d]) for d in group])
            ids = slots[rows].ravel()
            order = np.argsort(ids, kind="stable")
            first = np.flatnonzero(np.r_[True, ids[order][1:] != ids[order][:-1]])
            batches.append((rows, counts[group], ids[order][first], (order // slots.shape[1]).astype(np.int32), first))
        for _ in range(epochs):
            for k in rng.permutation(len(batches)):
                rows, cnt, u, token, first = batches[k]
                grad, gm, gf = self._gradient(self.weights[slots[rows]].sum(1), cnt, gold[rows])
                gw = np.add.reduceat(grad[token], first, axis=0) / len(cnt) - l2 * self.weights[u]
                for w, g, acc in ((self.moves, gm / len(cnt), g_m), (self.first, gf / len(cnt), g_f)):
                    acc += g * g
                    w += rate * g / np.sqrt(acc)
                g_w[u] += gw * gw
                self.weights[u] += rate * gw / np.sqrt(g_w[u])
        return self

    def gold(self, t: Tokens, spans: list[list[tuple[int, int, str]]]) -> np.ndarray:
        y = np.zeros(len(t.doc), np.int64)
        first = np.searchsorted(t.doc, np.arange(len(spans)))
        last = np.searchsorted(t.doc, np.arange(len(spans)), side="right")
        for d, held in enumerate(spans):
            for a, b, kind in held:
                i = first[d] + np.searchsorted(t.start[first[d] : last[d]], a)
                j = first[d] + np.searchsorted(t.start[first[d] : last[d]], b)
                y[i:j] = 2 + 2 * self.kinds.index(kind)
                y[i] -= 1
        return y

    def _gradient(self, e: np.ndarray, counts: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gold minus expected counts, by forward-backward over padded sequences."""
        b, longest, n = len(counts), int(counts.max()), len(self.labels)
        mask = np.arange(longest)[None, :] < counts[:, None]
        x = np.zeros((b, longest, n), np.float32)
        x[mask] = e
        moves = np.where(self.banned, NEG, self.moves)
        first = np.where(self.first_banned, NEG, self.first)
        pm = np.exp(moves)
        top = x.max(2, keepdims=True)
        px = np.exp(x - top)
        alpha, scale = np.zeros((b, longest, n), np.float64), np.ones((b, longest))
        a = np.exp(first)[None, :] * px[:, 0]
        scale[:, 0] = a.sum(1)
        alpha[:, 0] = a / scale[:, :1]
        for k in range(1, longest):
            a = (alpha[:, k - 1] @ pm) * px[:, k]
            s = np.where(mask[:, k], a.sum(1), 1.0)
            scale[:, k] = s
            alpha[:, k] = np.where(mask[:, k, None], a / s[:, None], alpha[:, k - 1])
        beta = np.ones((b, longest, n))
        expected = np.zeros((n, n))
        for k in range(longest - 2, -1, -1):
            f = px[:, k + 1] * beta[:, k + 1] / scale[:, k + 1, None]
            live = mask[:, k + 1]
            beta[:, k] = np.where(live[:, None], f @ pm.T, 1.0)
            if live.any():
                expected += pm * (alpha[live, k].T @ f[live])
        p = alpha * beta
        p /= p.sum(2, keepdims=True)
        flat = p[mask]
        grad = -flat
        grad[np.arange(len(gold)), gold] += 1
        ends = np.cumsum(counts)
        starts = ends - counts
        gm = -expected
        inner = np.ones(len(gold), bool)
        inner[starts] = False
        idx = np.flatnonzero(inner)
        np.add.at(gm, (gold[idx - 1], gold[idx]), 1)
        gf = -p[:, 0].sum(0)
        np.add.at(gf, gold[starts], 1)
        gm[self.banned] = 0
        gf[self.first_banned] = 0
        return grad.astype(np.float32), gm.astype(np.float32), gf.astype(np.float32)
