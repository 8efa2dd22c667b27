import random

from fieldscore.llm import leaks

STOCK = "Goods remain the property of the seller until every open amount has been paid in full."
ITEM = "The folded balance of the tariff never counts the table from the roster below the hidden schedule because a bilingual label for the weight costs 873.40."
MIXED = "An embossed salary annotates the overtime of the second courier near an unpaid gate. " + STOCK + " Which perforated ledger rounds the bar-line?"


def noise(r, n):
    return " ".join("".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(3)) for _ in range(n))


def found(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return {tuple(x) for x in leaks.leaked_items(d, i).collect()}


def test_copies_and_wide_leaks_are_no_stock_phrases(spark):
    """With the default form: copies hold a third of all rows, another item leaks into a sixth of them with misprints."""
    r = random.Random(1)
    copy = f"{noise(r, 30)} {STOCK} {ITEM} {noise(r, 30)}"
    half = " ".join(MIXED.split()[:14])  # a part without the stock phrase, short and always in the same surroundings
    part = f"{noise(r, 20)} {half} {noise(r, 20)}"
    other = noise(r, 40)
    leak = lambda: " ".join(w if r.random() > 0.03 else w[:-1] + "q" for w in other.split())
    docs = [(n, copy) for n in range(100)] + [(100 + n, part) for n in range(20)] + [(200 + n, f"{noise(r, 20)} {leak()} {noise(r, 20)}") for n in range(50)]
    docs += [(300 + n, f"{noise(r, 20)}. {STOCK} {noise(r, 5)}") for n in range(60)] + [(400 + n, noise(r, 30)) for n in range(70)]
    got = found(spark, docs, [(1, ITEM), (2, MIXED), (3, other), (4, STOCK)])
    assert got == {(n, 1) for n in range(100)} | {(100 + n, 2) for n in range(20)} | {(200 + n, 3) for n in range(50)}


def test_a_few_leaks_among_few_documents(spark):
    r = random.Random(2)
    docs = [(n, f"{noise(r, 20)} {ITEM} {noise(r, 20)}") for n in range(5)] + [(10 + n, noise(r, 40)) for n in range(30)]
    assert found(spark, docs, [(1, ITEM)]) == {(n, 1) for n in range(5)}


def test_an_item_in_a_twentieth_of_the_documents_is_found(spark):
    """Whatever else they hold; and one index answers several sets of items, in blocks as well."""
    r = random.Random(3)
    item, other = noise(r, 40), noise(r, 30)
    docs = [(n, f"{noise(r, 30)} {item if n % 20 == 0 else other if n % 200 == 7 else noise(r, 9)} {noise(r, 30)}") for n in range(1200)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    index = leaks.positional_index(d)
    assert index.filter(f"term <> {leaks.DIRECTORY}").count() > 1000
    want = {(n, 1) for n in range(0, 1200, 20)} | {(n, 2) for n in range(7, 1200, 200)}
    i = spark.createDataFrame([(1, item), (2, other)], "item_id long, text string")
    for form in (leaks.LeakForm(), leaks.LeakForm(block=10, segment=900)):
        assert {tuple(x) for x in leaks.leaked_items(d, i, form=form).collect()} == want
    assert {tuple(x) for x in leaks.leaked_items(d, i.filter("item_id = 2"), index=index).collect()} == {x for x in want if x[1] == 2}


def test_ids_of_any_kind(spark):
    r = random.Random(4)
    item, second = noise(r, 30), noise(r, 30)
    d = spark.createDataFrame([("a-1", item + " " + noise(r, 9)), ("a-2", second), ("a-3", noise(r, 40))], "doc string, body string")
    i = spark.createDataFrame([("x", item), ("x", second), ("y", noise(r, 30))], "name string, body string")
    got = leaks.leaked_items(d, i, "doc", "body", "name", "body")
    assert got.dtypes == [("doc_id", "string"), ("item_id", "string")] and {tuple(x) for x in got.collect()} == {("a-1", "x"), ("a-2", "x")}


def test_exchanged_words_in_a_short_stretch(spark):
    """Ten of 24 words, one or two of them exchanged; few documents an item, or it would be a stock phrase."""
    r = random.Random(5)
    items = [(k, noise(r, 24).split()) for k in range(5)]
    docs = []
    for n in range(40):
        part = items[n % 5][1][6:16]
        for k in r.sample([2, 4, 5, 7], 2) if n % 2 else [3]:
            part[k] = "other"
        docs.append((n, f"{noise(r, 20)} {' '.join(part)} {noise(r, 20)}"))
    got = found(spark, docs, [(k, " ".join(ws)) for k, ws in items])
    assert {(n, n % 5) for n in range(0, 40, 2)} <= got <= {(n, n % 5) for n in range(40)} and len(got) >= 30
