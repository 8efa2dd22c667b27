"""Postal addresses of the same place, written differently.

An address is read into house number, unit, direction and kind of the street, and two sets of words: the street's name,
which stands beside the number, and the rest (town, region, country, whatever else is printed), in any order and
without any list of places. Names are weighted character n-grams: an n-gram weighs what it tells, so what many addresses
share (regions, countries, common endings) weighs little, and a name that is well attested is one more n-gram of its
own, which keeps real names an edit apart from each other but not a misprint from its name.

Equal readings are one representative. Candidates come from an inverted index of the street's n-grams, cut to the prefix
that two names above the cosine must share and kept apart by house number and unit, which have to agree anyway. They
are verified by the cosine of the streets and that of the towns, which are the rarest words of the rest, by direction and kind.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscore.functions.expr import let
from fieldscore.session import cut

# Words of printed addresses and what they stand for.
KINDS = {
    "street": "street st str", "avenue": "avenue ave av aven avn", "road": "road rd", "lane": "lane ln", "drive": "drive dr drv", "court": "court ct crt",
    "square": "square sq sqr", "boulevard": "boulevard blvd boul bvd", "highway": "highway hwy hway hgwy", "terrace": "terrace ter terr", "place": "place pl",
    "parkway": "parkway pkwy", "circle": "circle cir", "crescent": "crescent cres", "way": "way wy", "alley": "alley aly", "close": "close cl", "trail": "trail trl",
}
DIRECTIONS = {"north": "north n", "south": "south s", "east": "east e", "west": "west w", "northeast": "northeast ne", "northwest": "northwest nw", "southeast": "southeast se", "southwest": "southwest sw"}
TOWN_FIRST = {"saint": "saint st", "fort": "fort ft", "mount": "mount mt", "north": "north n", "south": "south s", "east": "east e", "west": "west w", "port": "port pt", "new": "new", "lake": "lake lk"}
UNITS = "unit u apt apartment suite ste floor fl flr room rm # no".split()
NUMBER_WORDS = "no nr num number".split()
SIDE_WORDS = "attn attention accounts account dept department payable receivable receivables loading dock goods receiving c o care of mailroom reception po box the".split()


def _lookup(table: dict[str, str]) -> dict[str, str]:
    return {w: k for k, ws in table.items() for w in ws.split()}


_KIND, _DIRECTION, _FIRST = _lookup(KINDS), _lookup(DIRECTIONS), _lookup(TOWN_FIRST)
_UNIT, _NUMBER_WORD, _SIDE = set(UNITS) - {"no"}, set(NUMBER_WORDS), set(SIDE_WORDS)
_UNIT_VALUE = re.compile(r"[a-z]?\d{1,4}[a-z]?$")
_HOUSE = re.compile(r"\d{1,5}[a-z]?$")
_FOLD = str.maketrans({"o": "0", "l": "1", "i": "1", "s": "5", "b": "8"})


@dataclass(frozen=True)
class AddressForm:
    """Parameters: the n-gram length; the cosine that two streets and two towns need, and what two streets need by their
    n-grams alone, which prunes the index; the weight of a known name as a
    whole, against its n-grams; when a name is known (addresses that hold it and house numbers it is seen with) and
    isn't a misprint (``far_rarer`` times rarer than a word an edit away, at whose places at least ``at_places`` of its
    own are); and how much more common than the other side's town a word must be to be no town but a region or country."""

    gram: int = 2
    street: float = 0.22
    town: float = 0.2
    letters: float = 0.34
    whole: float = 3.0
    wider: float = 4.0
    smooth: float = 5.0
    known_least: int = 3
    far_rarer: int = 5
    at_places: float = 0.25
    hashed_grams: int = 1 << 18


@dataclass
class Reading:
    number: str = ""
    unit: str = ""
    direction: str = ""
    street: str = ""
    kind: str = ""
    first: str = ""
    town: str = ""
    rest: list[str] = field(default_factory=list)


def _tokens(text: str) -> list[str]:
    t = unicodedata.normalize("NFKC", text).lower()
    t = re.sub(r"\bc\s*/\s*o\b", " attn ", t)
    t = re.sub(r"[\n\r;/,|]+", " , ", t).replace("#", " # ")
    t = re.sub(r"\b([a-z])\.([a-z])\.?(?=\W|$)", r"\1\2", t)  # U.P.
    t = re.sub(r"[^\w#,\s-]+", " ", t).replace("-", " ")
    out = t.split()
    for i, w in enumerate(out):
        if len(w) == 5 and not w.isdigit() and sum(c.isdigit() for c in w) >= 3 and (c := w.translate(_FOLD)).isdigit():
            out[i] = c
    return out


def _open_word(w: str) -> bool:
    return w not in _KIND


def _street_ahead(house: int, at: Callable[[int], str], plain: Callable[[int], bool]) -> tuple[list[int], int, int]:
    """12 [N] NAME [KIND]: the places of the name's words, of the kind and of the direction (-1: none)."""
    i, direction = house + 1, -1
    if plain(i) and at(i) in _DIRECTION and plain(i + 1):
        direction, i = i, i + 1
    if not (plain(i) and _open_word(at(i))):
        return [], -1, -1
    names, j = [i], i + 1
    while plain(j) and _open_word(at(j)) and at(j) not in _FIRST and len(names) < 4:
        names.append(j)
        j += 1
    if plain(j) and at(j) in _KIND:
        return names[:2], j, direction
    if len(names) == 2 and at(j) == "," and any(k not in names and plain(k) and _open_word(at(k)) and at(k) not in _FIRST and len(at(k)) > 2 for k in range(j + 12)):
        return names, -1, direction  # a name cut in two: the town stands elsewhere
    return names[:1], -1, direction


def _street_behind(house: int, at: Callable[[int], str], plain: Callable[[int], bool]) -> tuple[list[int], int, int]:
    """[N] NAME [KIND] 12"""
    j, kind = house - 1, -1
    while j >= 0 and at(j) in _NUMBER_WORD:
        j -= 1
    if plain(j) and at(j) in _KIND and plain(j - 1):
        kind, j = j, j - 1
    names: list[int] = []
    while plain(j) and at(j) not in _DIRECTION and len(names) < 2 and _open_word(at(j)):
        names.insert(0, j)
        j -= 1
    if len(names) == 2 and not (kind >= 0 and (at(j) == "," or at(j) in _DIRECTION)):
        names, j = names[1:], j + 1
    return names, kind if names else -1, j if names and plain(j) and at(j) in _DIRECTION else -1


def read_address(text: str) -> Reading:
    """The parts of one printed address, in whatever order; parts that aren't there are ''."""
    r = Reading()
    ts = _tokens(text)
    used = [False] * len(ts)
    n = len(ts)

    def at(i: int) -> str:
        return ts[i] if 0 <= i < n else ","

    for i, w in enumerate(ts):  # units first: their value may look like a house number
        if w in _UNIT and not r.unit:
            j = i + 1
            while at(j) in _NUMBER_WORD or at(j) == "#":
                j += 1
            if _UNIT_VALUE.match(at(j)):
                r.unit = at(j).lstrip("0") or "0"
                for k in range(i, j + 1):
                    used[k] = True
    postcode = False
    for i, w in enumerate(ts):  # a postcode has five digits, at times with a gap
        if used[i] or postcode:
            continue
        if w.isdigit() and len(w) == 5:
            postcode = used[i] = True
        elif w.isdigit() and len(w) == 3 and at(i + 1).isdigit() and len(at(i + 1)) == 2 and not used[i + 1]:
            postcode = used[i] = used[i + 1] = True
    house = next((i for i, w in enumerate(ts) if not used[i] and _HOUSE.match(w)), -1)
    if house >= 0:
        r.number, used[house] = ts[house].lstrip("0") or "0", True
        if at(house - 1) in _NUMBER_WORD:
            used[house - 1] = True

    def plain(i: int) -> bool:
        w = at(i)
        return 0 <= i < n and not used[i] and w != "," and not w.isdigit() and w not in _SIDE and w not in _UNIT

    if house >= 0:
        ahead, behind = _street_ahead(house, at, plain), _street_behind(house, at, plain)
        best = behind if behind[0] and (not ahead[0] or (behind[1] >= 0 > ahead[1])) else ahead
        names, kind, direction = best
        r.street = "".join(ts[k] for k in names)
        for k in names:
            used[k] = True
        if kind >= 0:
            r.kind, used[kind] = _KIND[ts[kind]], True
        if direction >= 0:
            r.direction, used[direction] = _DIRECTION[ts[direction]], True
    rest = [i for i in range(n) if plain(i)]
    behind = []  # whether each word of the rest stands behind the street
    for k, i in enumerate(rest):
        w = ts[i]
        follows = k + 1 < len(rest) and rest[k + 1] == i + 1 and len(ts[i + 1]) > 3
        if w in _FIRST and follows and not r.first:
            r.first = _FIRST[w]
        elif w in _NUMBER_WORD:
            continue
        elif w in _KIND and not r.kind and len(w) > 1 and at(i - 1) != "," and not r.rest:
            r.kind = _KIND[w]
        elif len(w) > 1:
            r.rest.append(w)
            behind.append(i > house)
    names = [w for w, b in zip(r.rest, behind, strict=True) if b and len(w) > 3] or [w for w in r.rest if len(w) > 3]
    r.town = names[0] if names else ""  # most likely; only used to see which names share their places
    return r


PARTS = ("number", "unit", "direction", "street", "kind", "first", "rest")
READING = ", ".join(f"{p} string" for p in PARTS) + ", town string"


def _read_all(texts: pd.Series) -> pd.DataFrame:
    rows = [(r.number, r.unit, r.direction, r.street, r.kind, r.first, " ".join(sorted(set(r.rest))), r.town) for r in map(read_address, texts)]
    return pd.DataFrame(rows, columns=[*PARTS, "town"])


def same_town(a: list[dict], b: list[dict], near: Callable[[dict, dict], bool], wider: float) -> bool:
    """Whether the rests of two addresses may hold the same town; each word comes with whether it is known and how common.

    The rarest word of each side tells most. If neither stands on the other side, the towns differ, unless one side's
    rarest is so much more common than the other's that it is no town: then the town is left out there.
    """
    if not a or not b:
        return True
    x, y = (min(ws, key=lambda w: (w["known"], w["n"], w["word"])) for ws in (a, b))
    if any(near(x, w) for w in b) or any(near(y, w) for w in a):
        return True
    return x["known"] and y["known"] and max(x["n"], y["n"]) >= wider * min(x["n"], y["n"])


class NameGrams:
    """Weighted character n-grams of names, from the number of addresses that hold each n-gram (all alike without it)."""

    def __init__(self, form: AddressForm = AddressForm(), df: np.ndarray | None = None, n: int = 1):
        self.form, self.df, self.n = form, df, max(1, n)

    def grams(self, word: str) -> set[int]:
        k, w = self.form.gram, f"^{word}$"
        return {xxhash.xxh32_intdigest(w[i : i + k]) & (self.form.hashed_grams - 1) for i in range(max(1, len(w) - k + 1))}

    def weight(self, g: int) -> float:
        return 1.0 if self.df is None else math.log(1 + self.n / (self.form.smooth + self.df[g]))

    def vector(self, words: list[str], roots: dict[str, str]) -> dict[int, float]:
        """Squared weight by n-gram, which is what the n-gram tells. A word that stands for another (``roots``) is that one; a known one, which has itself
        as root, is an n-gram as a whole too."""
        out: dict[int, float] = {}
        for w in words:
            root = roots.get(w)
            own = {g: self.weight(g) for g in self.grams(root or w)}
            if root:
                own[self.form.hashed_grams + xxhash.xxh32_intdigest(root)] = self.form.whole * sum(own.values())
            out |= own
        return out

    def prefix(self, v: dict[int, float], least: float) -> list[int]:
        """The n-grams of which two names of a cosine of ``least`` must share one: all others together weigh too little."""
        rest = sum(v.values())
        bound, out = least * least * rest, []
        for g in sorted(v, key=lambda g: (-v[g], g)):
            if rest < bound:
                break
            out.append(g)
            rest -= v[g]
        return out


def cosine(a: dict[int, float], b: dict[int, float]) -> float:
    return sum(w for g, w in a.items() if g in b) / (math.sqrt(sum(a.values()) * sum(b.values())) or 1.0)


def same_word(a: str, b: str, roots: dict[str, str], form: AddressForm = AddressForm()) -> bool:
    """Whether two names of streets are one by the cosine of their n-grams, all of one weight."""
    n = NameGrams(form)
    return cosine(n.vector([a], roots), n.vector([b], roots)) >= form.street


def word_roots(members: DataFrame, form: AddressForm) -> DataFrame:
    """(word, root): the names seen often enough to be known, each its own root unless it is a frequent misprint.

    A misprint stands at the places of the name it was meant to be, and is far rarer; another name has its own places.
    """
    parts = F.array(F.struct(F.lit("s").alias("part"), F.col("street").alias("word"), F.col("town").alias("other")), F.struct(F.lit("t").alias("part"), F.col("town").alias("word"), F.col("street").alias("other")))
    words = members.select("number", "unit", F.inline(parts)).filter("word <> ''")
    often = words.groupBy("word").agg(F.count("*").alias("n"), F.approx_count_distinct("number").alias("numbers"))
    often = often.filter((F.col("n") >= form.known_least) & (F.col("numbers") >= form.known_least)).select("word")
    places = cut(words.filter("number <> '' and other <> ''").distinct().join(often, "word"))
    n_places = places.groupBy("word").agg(F.count("*").alias("places"))
    pairs = places.alias("b").join(places.withColumnRenamed("word", "root").alias("a"), ["part", "number", "unit", "other"])
    letters = lambda c: F.array_sort(F.split(c, ""))
    far = F.levenshtein("word", "root", 2)
    near = (F.col("word") != F.col("root")) & (F.abs(F.length("word") - F.length("root")) <= 1) & (F.least(F.length("word"), F.length("root")) >= 4) & ((far == 1) | ((far == 2) & (letters("word") == letters("root"))))
    shared = pairs.filter(near).groupBy("word", "root").agg(F.count("*").alias("shared"))
    shared = shared.join(n_places, "word").join(n_places.select(F.col("word").alias("root"), F.col("places").alias("of_root")), "root")
    meant = shared.filter((F.col("shared") >= F.col("places") * form.at_places) & (F.col("places") * form.far_rarer <= F.col("of_root")))
    meant = meant.groupBy("word").agg(F.max_by("root", F.struct("shared", "of_root", "root")).alias("root"))
    return often.join(meant, "word", "left").select("word", F.coalesce("root", "word").alias("root"))


VECTOR = "struct<keys:array<long>,squares:array<double>,total:double,letters:double>"
WORDS = "array<struct<word:string,known:boolean,n:long>>"


def _shared(a: Column, b: Column, whole: int) -> Column:
    """The squared weights of what two names share: in all, and by n-grams alone (those below ``whole``)."""
    start = F.struct(F.lit(0.0).alias("all"), F.lit(0.0).alias("letters"))

    def add(t: Column, z: Column) -> Column:
        w = F.when(F.array_contains(b["keys"], z["keys"]), z["squares"]).otherwise(0.0)
        return F.struct((t["all"] + w).alias("all"), (t["letters"] + F.when(z["keys"] < whole, w).otherwise(0.0)).alias("letters"))

    return F.aggregate(F.arrays_zip(a["keys"].alias("keys"), a["squares"].alias("squares")), start, add)


def same_places(addresses: DataFrame, ident: str = "addr", text: str = "text", form: AddressForm = AddressForm()) -> tuple[DataFrame, DataFrame]:
    """(addr, rep): the representative reading of each address; (ra, rb): pairs of representatives of one place, ra < rb.

    Null and blank texts and null identifiers are left out; equal rows count once. Addresses without a house number or
    without a street only match those that lack it too.
    """
    spark = addresses.sparkSession
    rows = addresses.select(F.col(ident).alias("addr"), F.col(text).alias("text")).filter("addr is not null and trim(text) <> ''")
    read = F.pandas_udf(_read_all, READING)
    members = cut(rows.distinct().withColumn("r", read("text")).select("addr", "r.*").withColumn("rep", F.concat_ws("\x1f", *PARTS)))
    roots = cut(word_roots(members, form))
    reps = members.groupBy("rep", *PARTS).agg(F.count("*").alias("n"))
    named = members.select(F.explode(F.filter(F.split("rest", " "), lambda w: w != "")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    lexicon = roots.join(named, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    words = reps.select("rep", F.explode(F.filter(F.concat(F.array("street"), F.split("rest", " ")), lambda w: w != "")).alias("word"))
    rooted = words.join(lexicon, "word").groupBy("rep").agg(F.collect_set(F.struct("word", "root", "n")).alias("roots"))  # as many as an address has words
    reps = cut(reps.join(rooted, "rep", "left"))
    blank = NameGrams(form)

    @F.pandas_udf("array<int>")
    def grams(street: pd.Series, rest: pd.Series) -> pd.Series:
        return pd.Series([sorted(set().union(*(blank.grams(w) for w in [s, *r.split()] if w))) for s, r in zip(street, rest, strict=True)])

    df = np.zeros(form.hashed_grams, dtype=np.int64)
    total = 0
    for g, n in reps.select(F.explode(grams("street", "rest")).alias("g")).groupBy("g").count().collect():  # at most form.hashed_grams rows
        df[g] = n
    total = reps.count()
    shared = spark.sparkContext.broadcast((df, total))

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = NameGrams(form, *shared.value)

        def packed(v: dict[int, float]) -> dict:
            return {"keys": list(v), "squares": list(v.values()), "total": sum(v.values()), "letters": sum(w for g, w in v.items() if g < form.hashed_grams)}

        for b in batches:
            out = {"prefix": [], "s": [], "r": []}
            for street, rest, held in zip(b["street"], b["rest"], b["roots"], strict=True):
                known = {r["word"]: (r["root"], r["n"]) for r in held} if held is not None else {}
                v = weights.vector([street], {w: r for w, (r, _) in known.items()})
                out["prefix"].append(weights.prefix({g: w for g, w in v.items() if g < form.hashed_grams}, form.letters))
                out["s"].append(packed(v))
                out["r"].append([{"word": known[w][0] if w in known else w, "known": w in known, "n": known[w][1] if w in known else 0} for w in rest.split() if len(w) > 2 or w in known])
            yield b.drop(columns=["roots", "street", "rest"]).assign(**out)

    fields = "rep string, number string, unit string, direction string, kind string, first string"
    held = reps.select("rep", *PARTS, "roots").mapInPandas(vectors, f"{fields}, prefix array<int>, s {VECTOR}, r {WORDS}")
    held = cut(held)
    slim = held.select("number", "unit", F.explode("prefix").alias("gram"), F.struct("rep", "direction", "kind", "first", "prefix").alias("x"))
    pairs = slim.join(slim.withColumnRenamed("x", "y"), ["number", "unit", "gram"])
    agree = lambda p: (F.col(f"x.{p}") == "") | (F.col(f"y.{p}") == "") | (F.col(f"x.{p}") == F.col(f"y.{p}"))
    once = F.col("gram") == F.array_min(F.array_intersect("x.prefix", "y.prefix"))
    pairs = pairs.filter((F.col("x.rep") < F.col("y.rep")) & agree("direction") & agree("kind") & agree("first")).filter(once).select(F.col("x.rep").alias("ra"), F.col("y.rep").alias("rb"))
    part = lambda r, n: held.select(F.col("rep").alias(r), F.struct("s", "r").alias(n))
    pairs = pairs.join(part("ra", "x"), "ra").join(part("rb", "y"), "rb")
    shared_grams = _shared(F.col("x.s"), F.col("y.s"), form.hashed_grams)
    total = F.sqrt(F.col("x.s.total") * F.col("y.s.total"))
    letters = F.sqrt(F.col("x.s.letters") * F.col("y.s.letters"))
    street = let(shared_grams, lambda c: (c["all"] >= form.street * total) & (c["letters"] >= form.letters * letters))

    @F.pandas_udf("boolean")
    def towns(x: pd.Series, y: pd.Series) -> pd.Series:
        weights, seen = NameGrams(form, *shared.value), {}

        def near(a: dict, b: dict) -> bool:
            key = (a["word"], a["known"], b["word"], b["known"])
            if key not in seen:
                v, w = (weights.vector([z["word"]], {z["word"]: z["word"]} if z["known"] else {}) for z in (a, b))
                seen[key] = cosine(v, w) >= form.town
            return seen[key]

        return pd.Series([same_town(list(a), list(b), near, form.wider) for a, b in zip(x, y, strict=True)], dtype=bool)

    return members.select("addr", "rep").distinct(), pairs.filter(street).filter(towns(F.col("x.r"), F.col("y.r"))).select("ra", "rb")


def same_addresses(addresses: DataFrame, ident: str = "addr", text: str = "text", form: AddressForm = AddressForm()) -> DataFrame:
    """(addr_a, addr_b): all pairs of identifiers whose addresses name one place, addr_a < addr_b, from `same_places`.

    This is as large as the groups' sizes squared; who can do with representatives takes those. An identifier with several
    texts pairs by each of them. Empty tables give an empty result; columns beside the two named ones don't matter.
    """
    members, linked = same_places(addresses, ident, text, form)
    members = cut(members)
    p, q = (members.select(F.col("addr").alias(n), F.col("rep").alias(r)) for n, r in (("p", "ra"), ("q", "rb")))
    across = linked.join(p, "ra").join(q, "rb").select("p", "q")
    within = p.join(q.withColumnRenamed("rb", "ra"), "ra").filter("p < q").select("p", "q")
    return across.union(within).filter("p <> q").select(F.least("p", "q").alias("addr_a"), F.greatest("p", "q").alias("addr_b")).distinct()
