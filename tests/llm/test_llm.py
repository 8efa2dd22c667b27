import itertools
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from oracle import SMALL, same
from pyspark.sql import functions as F

from fieldscore.llm import addresses, catalog, crf, groups, leaks, packing, pii, pii_examples, stable_sample

here = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")


@here
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    same(spark, catalog.QUERIES[name], catalog.ORACLES[name])


@here
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, name):
    df = catalog.QUERIES[name](spark, SMALL)
    assert len(df.columns) == len(set(df.columns))
    df.collect()


# samples


def test_samples_only_grow(spark, tmp_path):
    plans = spark.createDataFrame([("p", "s", 0.3), ("p", "s", 0.1), ("q", None, 0.5), ("z", "s", None)], "plan_name string, seed string, share double")
    ids = lambda xs: spark.createDataFrame([(x, s) for x in xs for s in ("s", None)], "id string, seed string")
    a = stable_sample.NumberStore(spark, str(tmp_path / "a"))
    a.see(ids([f"d{i}" for i in range(200)] + ["d1", None]), 1)
    first = {(r.plan_name, r.doc_id) for r in stable_sample.stable_sample(a, plans).collect()}
    a.see(ids([f"d{i}" for i in range(100, 400)]), 2)
    a.see(ids([]), 3)
    second = {(r.plan_name, r.doc_id) for r in stable_sample.stable_sample(a, plans).collect()}
    assert first < second and a.rows().count() == 800
    assert 0.2 < sum(p == "p" for p, _ in second) / 400 < 0.4 and not any(p == "z" for p, _ in second)
    b = stable_sample.NumberStore(spark, str(tmp_path / "b"))
    b.see(ids([f"d{i}" for i in reversed(range(400))]).repartition(7), 1)
    assert second == {(r.plan_name, r.doc_id) for r in stable_sample.stable_sample(b, plans).collect()}
    lower = plans.withColumn("share", F.lit(0.01))
    assert second == {(r.plan_name, r.doc_id) for r in stable_sample.stable_sample(a, lower, kept=plans.filter("share is not null").union(plans.filter("share is null"))).collect() if r.plan_name != "z"}
    assert stable_sample.stable_sample(stable_sample.NumberStore(spark, str(tmp_path / "none")), plans).count() == 0


def test_a_store_outlives_the_call(spark, tmp_path):
    """Two calls with a lower share and a new batch: what was drawn stays drawn."""
    plans = spark.createDataFrame([("p", "s", 0.4)], "plan_name string, seed string, share double")
    docs = lambda n: spark.createDataFrame([(f"d{i}", "s", 1 + i // 100) for i in range(n)] + [("d1", "s", 9)], "id string, seed string, batch int")

    def call(n, share):
        store = stable_sample.NumberStore(spark, str(tmp_path / "store"))
        store.see(docs(n), "batch")
        store.keep(plans.withColumn("share", F.lit(share)))
        return {r.doc_id for r in stable_sample.stable_sample(store, plans.withColumn("share", F.lit(share))).collect()}

    first, second = call(200, 0.4), call(300, 0.1)
    assert first < second and len(second) > 90
    store = stable_sample.NumberStore(spark, str(tmp_path / "store"))
    assert store.rows().count() == 300 and {r.first_batch for r in store.rows().collect()} == {1, 2, 3} and store.shares().count() == 1
    store.rows().limit(5).coalesce(1).write.mode("append").parquet(str(tmp_path / "store" / "numbers"))  # another writer's rows
    assert call(300, 0.1) == second and stable_sample.stable_sample(store, plans).count() == len(second)


# groups


def by_union_find(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {x: root(x) for x in up}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(f"{r.randrange(60):03}", f"{r.randrange(60):03}") for _ in range(45)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(40)]
    df = spark.createDataFrame(edges + edges[:5] + [(None, "x")], "a string, b string")
    assert {x.node: x.root for x in groups.components(df).collect()} == by_union_find(edges)


def test_components_of_nothing(spark):
    assert groups.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_linked_groups(spark):
    rows = [(1, "LAY-1 ", "E1", "c"), (2, "lay_1", None, "c"), (3, None, "e-1", "c"), (4, "N/A", "unknown", "c"), (5, "", "?", "c"), (6, "lay-2", "TBC", "c"), (7, "x", None, "c"), (7, "y", None, "c"), (8, "Y", None, "c"), (None, "lay1", "e1", "c"), (1, "LAY-1 ", "E1", "c")]
    df = spark.createDataFrame(rows, "doc_id long, cluster_id string, entity_key string, root string")
    got = {r.record: r.root for r in groups.linked_groups(df, "doc_id", ["cluster_id", "entity_key"]).collect()}
    assert got[1] == got[2] == got[3] == "0:lay1" and got[4] == "~4" and got[5] == "~5" and got[6] == "0:lay2" and got[7] == got[8] == "0:x" and len(got) == 8
    assert groups.linked_groups(df.filter("false"), "doc_id", ["cluster_id", "entity_key"]).count() == 0


def test_totals_are_the_nearest():
    r = random.Random(4)
    for _ in range(20):
        sizes = [r.randint(1, 12) for _ in range(8)]
        chosen = groups.choose_totals(sorted(Counter(sizes).items()), [0.7, 0.3])
        total, goal = sum(sizes), round(0.3 * sum(sizes))
        best = min(abs(sum(c) - goal) for n in range(9) for c in itertools.combinations(sizes, n))
        assert abs(sum(s * n for s, n in chosen[1].items()) - goal) == best
        assert sum(s * n for c in chosen for s, n in c.items()) == total


def test_units_beyond_the_exact_bound():
    """With fewer exact sums than records the small groups make up what the units are off."""
    r = random.Random(5)
    sizes = sorted(Counter([r.randint(1, 400) for _ in range(300)] + [1] * 500).items())
    total = sum(s * m for s, m in sizes)
    chosen = groups.choose_totals(sizes, [0.8, 0.1, 0.1], exact=2000)
    assert [sum(s * n for s, n in c.items()) for c in chosen[1:]] == [round(0.1 * total)] * 2
    assert {s: sum(c.get(s, 0) for c in chosen) for s, _ in sizes} == dict(sizes)


def test_choice_of_many_sizes():
    sizes = [(s, 3) for s in range(1, 400)]
    chosen = groups.exact_choice(sizes, 100_003)
    assert sum(s * n for s, n in chosen.items()) == 100_003 and max(chosen.values()) <= 3


def test_splits(spark):
    rows = [(i, f"g{i % 37 if i % 5 else i}") for i in range(500)]
    g = spark.createDataFrame(rows, "record long, root string")
    t = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split_name string, share double")
    got = groups.split_groups(g, t).collect()
    assert len(got) == 500 and len({(r.root, r.split) for r in got}) == len({r.root for r in got})
    assert Counter(r.split for r in got) == {"train": 400, "validation": 50, "test": 50}
    assert set(got) == set(groups.split_groups(g.repartition(3), t).collect())
    assert groups.split_groups(g.filter("false"), t).count() == 0
    with pytest.raises(ValueError):
        groups.split_groups(g, t.filter("false"))


def test_rank_in_class(spark):
    df = spark.createDataFrame([(i % 2, f"k{i}") for i in range(3000)], "kind int, key string")
    for _, rows in itertools.groupby(sorted((r.kind, r.rank) for r in groups.rank_in_class(df, "kind", "key", "rank", buckets=16).collect()), key=lambda x: x[0]):
        assert [r for _, r in rows] == list(range(1, 1501))


# addresses


@pytest.mark.parametrize(
    "text, want",
    [
        ("1270 Mallowwick Drive Suite 35\nSaint Laskacre, JL 59730 NL.", ("1270", "35", "", "mallowwick", "drive", "saint", "laskacre")),
        ("NL., 59730 St Laskacre, JL, #35, Mallowwick Dr. 1270", ("1270", "35", "", "mallowwick", "drive", "saint", "laskacre")),
        ("East Larchwick Str 3710,57955 Lasklba,DR,NL.", ("3710", "", "east", "larchwick", "street", "", "lasklba")),
        ("430 ploverfield avenue n. merriacre, jl 627 61 tesmar", ("430", "", "", "ploverfield", "avenue", "north", "merriacre")),
        ("Attn Accounts Payable / 2094 E. Fallowhaven Blvd / 66088 / AV / TSM", ("2094", "", "east", "fallowhaven", "boulevard", "", "")),
        ("No. 340 basaltgrove road,apt. b8,kelmouth united provinces", ("340", "b8", "", "basaltgrove", "road", "", "kelmouth")),
    ],
)
def test_readings(text, want):
    r = addresses.read_address(text)
    assert (r.number, r.unit, r.direction, r.street, r.kind, r.first, r.town) == want


def test_same_addresses(spark):
    rows = [
        ("1", "2140 East Hazelgate Street\nMerristow, FW 61550 Tesmar"), ("2", "MERRISTOW, 2140 E. HAZELGATE ST, FW, 61550"), ("3", "2140 East Hazelagte St / Merristow"), ("4", "2140 West Hazelgate Street\nMerristow"),
        ("5", "2141 East Hazelgate Street\nMerristow"), ("6", "2140 East Hazelgate Street, Apt 3\nMerristow"), ("7", "2140 East Hazelgate Road\nMerristow"), ("8", None), ("9", "  "), (None, "2140 East Hazelgate Street\nMerristow"), ("1", "2140 East Hazelgate Street\nMerristow, FW 61550 Tesmar"), ("z", "?"),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "addr string, text string, rep string, n int")
    assert {tuple(r) for r in addresses.same_addresses(df).collect()} == {("1", "2"), ("1", "3"), ("2", "3")}
    assert addresses.same_addresses(df.filter("false")).count() == 0


def test_prefix_filter_loses_nothing():
    r = random.Random(2)
    names = ["".join(r.choice("abcd") for _ in range(6)) for _ in range(60)]
    form = addresses.AddressForm()
    df = np.zeros(form.hashed_grams, dtype=np.int64)
    for n in names:
        for g in addresses.NameGrams(form).grams(n):
            df[g] += 1
    w = addresses.NameGrams(form, df, len(names))
    vs = [w.vector([n], {n: n} if i % 2 else {}) for i, n in enumerate(names)]
    for least in (form.street, 0.5):
        for a, b in itertools.combinations(vs, 2):
            if addresses.cosine(a, b) >= least:
                assert set(w.prefix(a, least)) & set(w.prefix(b, least))


# packing


def brute_check(lengths, capacity, windows):
    pieces = {}
    for w in windows:
        assert sum(p[3] for p in w) <= capacity
        for doc, piece, start, n in w:
            pieces.setdefault(doc, []).append((piece, start, n))
    assert sorted(pieces) == list(range(len(lengths)))
    for doc, ps in pieces.items():
        ps.sort()
        assert sum(n for _, _, n in ps) == lengths[doc] and [s for _, s, _ in ps] == [sum(n for _, _, n in ps[:k]) for k in range(len(ps))]
        assert len(ps) == 1 or lengths[doc] > capacity


@pytest.mark.parametrize("capacity", [7, 64, 500])
def test_packing_keeps_every_token(capacity):
    r = np.random.default_rng(3)
    lengths = np.r_[r.integers(1, 120, 200), [0, 0, 900]]
    windows = packing.pack_shard(lengths, capacity, r.random((203, 203), np.float32)).windows
    brute_check(lengths, capacity, windows)
    if capacity == 500:
        assert lengths.sum() / (len(windows) * capacity) > 0.97


def test_the_nearest_neighbours_come_first():
    """With room to spare no size is in the way: a window holds its seed's neighbours by falling score, all of them."""
    r = np.random.default_rng(8)
    score = r.random((400, 400), np.float32)
    lengths = r.integers(5, 9, 400)
    lengths[7] = 50
    got = packing.pack_shard(lengths, 10_000, score)
    order = [p[0] for p in got.windows[0]]
    assert order == [7, *[j for j in np.argsort(-score[7]).tolist() if j != 7]] and got.retrieved == 399


@pytest.mark.parametrize("long", [0, 4, 1000])
def test_bm25_scores_equal_the_formula(long, monkeypatch):
    monkeypatch.setattr(packing.ShardIndex, "LONG", long)
    monkeypatch.setattr(packing.ShardIndex, "BLOCK", 8)
    r = np.random.default_rng(5)
    terms = [np.unique(r.integers(0, 30, 8)) for _ in range(12)]
    tfs = [r.integers(1, 4, len(t)) for t in terms]
    n = np.array([int(x.sum()) for x in tfs])
    idf = r.random(31).astype(np.float32)
    f = packing.PackForm()
    got = packing.ShardIndex(terms, tfs, n, idf, n.mean(), f).score
    for i, d in itertools.product(range(12), range(12)):
        want = sum(idf[t] * tf * (f.k1 + 1) / (tf + f.k1 * (1 - f.b + f.b * n[d] / n.mean())) for t, tf in zip(terms[d], tfs[d].astype(float)) if t in terms[i])
        assert i == d or abs(got[i, d] - want) < 1e-4


def test_windows_do_not_depend_on_the_cluster(spark):
    r = random.Random(6)
    rows = [(i, " ".join(r.choice("red mop lamp soap fee tax sum bar".split()) for _ in range(r.randint(1, 90))), f"s{i % 7 if i % 3 else 1}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cluster_id string")
    boxes = spark.createDataFrame([("small", 64), ("large", 700)], "container string, capacity int")
    form, got = packing.PackForm(shard=100), []
    was = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("3", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(set(packing.pack_windows(docs.repartition(int(n)), boxes, series="cluster_id", form=form).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", was)
    assert got[0] == got[1] and len({x.doc_id for x in got[0]}) == 900


def test_windows_of_texts(spark):
    rows = [(1, "red mop " * 40, "a"), (2, "", "b"), (3, None, None), (4, "word " * 3000, "a"), (5, "one two", "a"), (5, "one two", "a"), (None, "no id", "c")]
    docs = spark.createDataFrame([(*r, "w", 9) for r in rows], "doc_id long, text string, cluster_id string, window_id string, n int")
    boxes = spark.createDataFrame([("small", 64), ("large", 2048)], "container string, capacity int")
    got = packing.pack_windows(docs, boxes, series="cluster_id")
    sums = got.groupBy("container", "window_id").agg(F.sum("n_tokens").alias("n")).collect()
    assert all(r.n <= {"small": 64, "large": 2048}[r.container] for r in sums)
    assert {r[0]: r[1] for r in got.filter("container = 'large'").groupBy("doc_id").count().collect()} == {1: 1, 2: 1, 3: 1, 4: 2, 5: 2, None: 1}
    assert packing.pack_windows(docs.filter("false"), boxes).count() == 0
    with pytest.raises(ValueError):
        packing.pack_windows(docs, spark.createDataFrame([("x", 0)], "container string, capacity int"))


# leaks

ITEM = "The folded balance of the tariff never counts the table from the roster below the hidden schedule because a bilingual label for the weight costs 873.40."


def test_leaks(spark):
    other = "Which overtime annotates an embossed salary over the rounded bar-line near the perforated ledger of the second courier?"
    stock = "Goods remain the property of the seller until every open amount has been paid in full."
    noisy = ITEM.replace("tariff", "tarifl").replace("the hidden", "this hidden").replace(" never", "")
    docs = [
        (1, f"Intro text. {ITEM} Outro."), (2, f"<p>{ITEM.upper()}</p>"), (3, ITEM.replace(" ", "\xa0").replace("schedule", "sched\xadule")), (4, noisy), (5, "The folded balance of the tariff never."), (6, None), (7, ""),
        (8, ITEM.replace("table from", "ta-\nble from")), (None, ITEM), (9, ("filler words here " * 20000) + ITEM), *[(100 + i, f"{stock} note {i}") for i in range(60)],
    ]
    items = [(10, ITEM), (11, ITEM.lower()), (12, "  "), (13, None), (14, other), (None, ITEM), (15, stock), (16, "two words")]
    d = spark.createDataFrame([(*x, "z", 1) for x in docs], "doc_id long, text string, item_id string, term int")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in leaks.leaked_items(d, i, form=leaks.LeakForm(stock_share=0.3)).collect()}  # 60 of 70 texts hold the stock phrase
    assert got == {(n, k) for n in (1, 2, 3, 4, 8, 9) for k in (10, 11)}
    assert leaks.leaked_items(d.filter("false"), i).count() == 0
    assert leaks.leaked_items(d, i.filter("false")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_leaks_equal_brute_force(spark, seed):
    r = random.Random(seed)
    vocab = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(3)) for _ in range(300)]
    items = {k: [r.choice(vocab) for _ in range(30)] for k in range(8)}
    docs = {}
    for n in range(60):
        ws = [r.choice(vocab) for _ in range(80)]
        if n % 2:
            k, size = r.randrange(8), r.choice([5, 7, 9, 10, 12, 20, 30])
            a, at = r.randrange(31 - size), r.randrange(60)
            ws[at:at] = items[k][a : a + size]
        docs[n] = ws
    want = set()
    for n, ws in docs.items():
        for k, iw in items.items():
            covered = set()
            for a in range(30):
                for p in range(len(ws)):
                    size = 0
                    while a + size < 30 and p + size < len(ws) and iw[a + size] == ws[p + size]:
                        size += 1
                    if size >= 8:
                        covered |= set(range(a, a + size))
            if len(covered) >= 10:
                want.add((n, k))
    d = spark.createDataFrame([(n, " ".join(ws)) for n, ws in docs.items()], "doc_id long, text string")
    i = spark.createDataFrame([(k, " ".join(ws)) for k, ws in items.items()], "item_id long, text string")
    assert {tuple(x) for x in leaks.leaked_items(d, i, form=leaks.LeakForm(stock_share=1.0)).collect()} == want


def test_near_words():
    assert leaks.near_words("tariff", "tarifl") and leaks.near_words("schedule", "schcdu1e") and not leaks.near_words("the", "tho") and not leaks.near_words("roster", "poster1")


# personal values


@pytest.fixture(scope="module")
def model():
    return pii.trained_model()


def test_held_out_patterns():
    """A model of two thirds of the patterns, on values in the other third, which it has never seen."""
    kept = lambda ps, k: [p for i, p in enumerate(ps) if (i % 3 == 0) == k]
    table = pii_examples.labelled_rows(5000, 3, kept(pii_examples.PATTERNS, False), kept(pii_examples.PLAIN, False))
    model = crf.Crf(pii.KINDS).fit([t for t, _ in table], [s for _, s in table], epochs=6)
    rows = pii_examples.labelled_rows(600, 1234, kept(pii_examples.PATTERNS, True), kept(pii_examples.PLAIN, True))
    found = pii.find(model, [t for t, _ in rows])
    hit = sum(len(set(s) & set(f)) for (_, s), f in zip(rows, found))
    recall, precision = hit / sum(len(s) for _, s in rows), hit / sum(len(f) for f in found)
    print(f"held-out patterns: recall {recall:.3f}, precision {precision:.3f}")
    assert recall > 0.7 and precision > 0.75


def test_found_values(model):
    text = "Dear Anna Smith,\nreply to anna.smith@firm.example or call +1 (555) 555-0123 ext. 12.\nShip to: 12 North Oakfield Ave, Fort Hillville, AB 12345.\nPlease mask SSN 123-45-6789 before sharing.\nOrder no. 123-45-6789\nTotal 12.29  36.87"
    got = {(text[a:b], k) for a, b, k in pii.find(model, [text])[0]}
    assert got == {("Anna Smith", "person_name"), ("anna.smith@firm.example", "email"), ("+1 (555) 555-0123 ext. 12", "phone"), ("12 North Oakfield Ave, Fort Hillville, AB 12345", "street_address"), ("123-45-6789", "id_number")}


@pytest.mark.parametrize("size", [1, 63, 64, 65, 700, 5000])
def test_long_texts_are_decoded_whole(size):
    """Equal to plain Viterbi in double precision, beside texts of other lengths."""
    r = np.random.default_rng(size)
    m = crf.Crf(["x", "y"])
    n = len(m.labels)
    m.moves, m.first = r.normal(size=(n, n)).astype(np.float32), r.normal(size=n).astype(np.float32)
    sizes = [size, 3, max(1, size // 2), size, 1]
    e = r.normal(scale=2, size=(sum(sizes), n)).astype(np.float32)
    got = m.viterbi(e, np.repeat(np.arange(5), sizes), 5)
    moves, at = np.where(m.banned, -1e9, m.moves.astype(float)), 0
    for k in sizes:
        score, back = np.where(m.first_banned, -1e9, m.first.astype(float)) + e[at], []
        for x in e[at + 1 : at + k]:
            through = score[:, None] + moves
            back.append(through.argmax(0))
            score = through.max(0) + x
        best = [int(score.argmax())]
        for b in reversed(back):
            best.append(int(b[best[-1]]))
        assert got[at : at + k].tolist() == best[::-1]
        at += k


def test_no_script_is_one_symbol():
    t = crf.tokenize(["东京 大阪", "Σοφία Παππά"])
    assert len(set(t.word[t.kind[t.doc == 0]].tolist())) == 4 and (t.doc == 1).sum() == 2


def test_a_stored_model_is_the_trained_one(spark, tmp_path):
    a = pii.stored_model(spark, 300, str(tmp_path))
    pii._STORED.clear()
    b = pii.stored_model(spark, 300, str(tmp_path))
    assert a is not b and (a.weights == b.weights).all() and a.labels == b.labels and len(list(tmp_path.iterdir())) == 1


def test_viterbi_equals_brute_force():
    m = crf.Crf(["x"])
    r = np.random.default_rng(0)
    m.moves, m.first = r.normal(size=(3, 3)).astype(np.float32), r.normal(size=3).astype(np.float32)
    for n in (1, 2, 6):
        e = r.normal(size=(n, 3)).astype(np.float32)
        best = max((p for p in itertools.product(range(3), repeat=n) if p[0] != 2 and all(not (b == 2 and a == 0) for a, b in itertools.pairwise(p))), key=lambda p: m.first[p[0]] + sum(e[i, y] for i, y in enumerate(p)) + sum(m.moves[a, b] for a, b in itertools.pairwise(p)))
        assert tuple(m.viterbi(e, np.zeros(n, np.int64), 1)) == best


def test_gradient_is_the_slope():
    m = crf.Crf(["x"])
    r = np.random.default_rng(1)
    m.moves, m.first = r.normal(size=(3, 3)).astype(np.float32), r.normal(size=3).astype(np.float32)
    e, counts, gold = r.normal(size=(5, 3)).astype(np.float32), np.array([3, 2]), np.array([0, 1, 2, 1, 0])

    def likelihood(e):
        total, at = 0.0, 0
        for n in counts:
            paths = [p for p in itertools.product(range(3), repeat=n) if p[0] != 2 and all(not (b == 2 and a == 0) for a, b in itertools.pairwise(p))]
            value = lambda p: m.first[p[0]] + sum(e[at + i, y] for i, y in enumerate(p)) + sum(m.moves[a, b] for a, b in itertools.pairwise(p))  # noqa: B023, E731
            total += value(tuple(gold[at : at + n])) - np.log(sum(np.exp(value(p)) for p in paths))
            at += n
        return total

    grad, _, _ = m._gradient(e, counts, gold)
    for i, y in itertools.product(range(5), range(3)):
        up, down = e.astype(float).copy(), e.astype(float).copy()
        up[i, y] += 1e-4
        down[i, y] -= 1e-4
        assert abs((likelihood(up) - likelihood(down)) / 2e-4 - grad[i, y]) < 1e-3


def test_values_and_placeholders(spark):
    t = "Served by Anna Smith\nTel: 020 7946 0155"
    rows = [(1, t, "a"), (1, t, "a"), (2, None, "b"), (3, "", "c"), (4, "nothing here " * 3000 + t + " " + t, "d"), (None, t, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, pii_type string")
    got = Counter((r.doc_id, r.pii_type, r.pii_text) for r in pii.pii_values(df).collect())
    one = [("person_name", "Anna Smith"), ("phone", "020 7946 0155")]
    assert got == Counter({(n, *v): 2 if n == 1 else 1 for n in (1, 4, None) for v in one})
    out = [(r.doc_id, r.redacted) for r in pii.redacted(df).orderBy("doc_id").collect()]
    assert (1, "Served by [PERSON_NAME]\nTel: [PHONE]") in out and (2, None) in out and (3, "") in out
    assert pii.pii_values(df.filter("false")).count() == 0
