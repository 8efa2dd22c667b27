import random
from collections import defaultdict
from itertools import combinations

from fieldscore.llm import addresses


def test_names_are_known_whatever_the_number_of_addresses(spark):
    """Beside 60,000 addresses of one hot street: rare names an edit apart stay apart, a frequent misprint of the hot one doesn't."""
    hot = spark.range(60000).selectExpr("cast(1 + id % 9000 AS string) AS number", "cast(1 + id / 9000 AS string) AS unit", "'oakgate' AS street", "'harbury' AS town")
    rare = [(str(k), "", "marrowcliff", "selmouth") for k in (11, 12, 13, 14, 15)] + [(str(k), "", "yarrowcliff", "selmouth") for k in (15, 26, 27, 28, 29)]
    wrong = [(str(k), "1.0", "oakgaet", "harbury") for k in range(40, 52)]
    members = hot.withColumn("unit", hot.unit.cast("double").cast("int").cast("double").cast("string")).unionByName(spark.createDataFrame(rare + wrong, "number string, unit string, street string, town string"))
    roots = {r.word: r.root for r in addresses.word_roots(members, addresses.AddressForm()).collect()}
    assert not addresses.same_word("marrowcliff", "yarrowcliff", roots)
    assert addresses.same_word("oakgaet", "oakgate", roots) and roots["oakgaet"] == "oakgate"


def test_places_of_any_vocabulary(spark):
    """Towns, regions and countries that are named nowhere: other abbreviations, orders, parts left out, misprints."""
    r = random.Random(9)
    make = lambda ends: "".join(r.choice("bcdfgklmnprstvz") + r.choice("aeiou") for _ in range(r.randint(2, 3))) + r.choice(ends)
    streets, towns = [make(["th", "x", "lm", "sk", ""]) for _ in range(120)], [make(["ska", "rno", "vik", "tt", ""]) for _ in range(40)]
    regions, kinds = [(make(["nia"]), make([""])[:2]) for _ in range(6)], [("Street", "St."), ("Avenue", "Ave"), ("Road", "Rd"), ("Lane", "Ln")]

    def misprint(w):
        i = r.randrange(1, len(w) - 1)
        return w[:i] + w[i + 1] + w[i] + w[i + 2 :] if r.random() < 0.5 else w[:i] + r.choice("xqw") + w[i + 1 :]

    rows, place_of = [], defaultdict(list)
    for k in range(600):
        number, unit, street, kind, town = r.randint(1, 400), r.choice([None, None, str(r.randint(1, 40))]), r.choice(streets), r.choice(kinds), r.choice(towns)
        region = regions[towns.index(town) % 6]
        for c in range(3):
            s = misprint(street) if r.random() < 0.2 else street
            t = misprint(town) if r.random() < 0.1 else town
            head = f"{number} {s.title()} {r.choice(kind)}" if r.random() < 0.7 else f"{s.title()} {r.choice(kind)} {number}"
            flat = f", {r.choice(['Unit', 'Apt', '#'])} {unit}" if unit else ""
            tail = f", {t.title()}" if r.random() < 0.93 else ""
            tail += r.choice(["", f", {region[0].title()}", f", {region[1].upper()}"]) + (f" {10000 + towns.index(town) * 7}" if r.random() < 0.5 else "")
            text = head + flat + tail if r.random() < 0.8 or not tail else f"{tail.strip(', ')}, {head}{flat}"
            rows.append((f"{k}-{c}", text.upper() if r.random() < 0.1 else text))
            place_of[(number, unit, street, kind, town)].append(f"{k}-{c}")
    want = {tuple(sorted(p)) for ids in place_of.values() for p in combinations(ids, 2)}
    got = {tuple(x) for x in addresses.same_addresses(spark.createDataFrame(rows, "addr string, text string")).collect()}
    recall, precision = len(got & want) / len(want), len(got & want) / len(got)
    print(f"another vocabulary: recall {recall:.3f}, precision {precision:.3f}")
    assert recall >= 0.9 and precision >= 0.95
