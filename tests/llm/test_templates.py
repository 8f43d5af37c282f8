import random

from loomsight.llm import templates as t

ITEM = "A train leaves Boston at 40 km per hour while Alice waits 15 minutes then walks back to Boston with 40 friends and sings along the road"

CITY = "we walk in Boston and then see Boston again as we leave Boston by boat but Boston waits"


def docs(spark, rows):
    return spark.createDataFrame([(k, x, "s") for k, x in enumerate(rows)], "doc_id long, text string, hits string")


def bench(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "item_id long, text string")


def test_templates():
    words, slots = t.template("Pay $5.50 to Bob, then 3kg or 7 km. The end: It is 2nd!")
    assert words == ["pay", t.NUMBER, "to", t.NAME, "then", t.NUMBER, t.UNIT, "or", t.NUMBER, t.UNIT, "the", "end", "it", "is", t.NUMBER]
    assert slots == {1: "$5.50", 3: "bob", 5: "3", 6: "kg", 8: "7", 9: "km", 14: "2nd"}
    assert t.template(None) == ([], {}) == t.template(" \n ") == t.template("-- !")


def test_reparameterised_questions(spark):
    same = ITEM.replace("Boston", "Paris").replace("Alice", "Chloe").replace("40", "75").replace("15", "9").replace("km", "mi")
    odd = CITY.replace("Boston", "Rome", 1)
    for other in ("Oslo", "Bern", "Lima"):
        odd = odd.replace("Boston", other, 1)
    noise = "some other words stand here before it all "
    rows = [ITEM, noise + same + " and more after it", noise + ITEM.upper() + "!", odd, noise * 5, None, CITY.replace("Boston", "Lyon"), " ".join(ITEM.split()[:9]), "then " + " ".join(ITEM.split()[12:])]
    out = t.contaminated(docs(spark, rows), bench(spark, [ITEM, None, "", ITEM, CITY]))
    got = {r.doc_id: r for r in out.collect()}
    assert [got[k].contaminated for k in range(9)] == [True, True, False, False, False, False, True, False, True]
    assert [(h.item_id, h.share) for h in got[1].hits] == [(0, 1.0), (3, 1.0)]


def test_literal_copies_against_brute_force(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdef") for _ in range(3))
    items = [" ".join(word() for _ in range(rnd.choice([3, 8, 12, 40]))) for _ in range(20)]
    rows = []
    for _ in range(120):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 30)))]
        if rnd.random() < 0.6:
            i = rnd.choice(items).split()
            parts.append(" ".join(i[: rnd.randint(1, len(i))]))
        rows.append(" ".join([*parts, " ".join(word() for _ in range(rnd.randint(0, 30)))]))
    got = {r.doc_id: {h.item_id for h in r.hits} for r in t.contaminated(docs(spark, rows), bench(spark, items)).collect()}
    for k, row in enumerate(rows):
        w = row.split()
        want = set()
        for i, item in enumerate(items):
            own = item.split()
            n, best = min(10, len(own)), 0
            for shift in range(-len(own), len(w)):
                good = {q for p in range(len(own) - n + 1) if 0 <= p + shift and w[p + shift : p + shift + n] == own[p : p + n] for q in range(p, p + n)}
                best = max(best, len(good))
            if best / len(own) >= 0.5:
                want.add(i)
        assert got[k] == want


def test_blocks_and_empty(spark, monkeypatch):
    items = [ITEM, ITEM.replace("train", "plane"), ITEM.replace("sings", "dances").replace("leaves", "left")]
    one = [[h.item_id for h in r.hits] for r in t.contaminated(docs(spark, items), bench(spark, items)).orderBy("doc_id").collect()]
    monkeypatch.setattr(t, "BLOCK_BYTES", 150)
    two = [sorted(h.item_id for h in r.hits) for r in t.contaminated(docs(spark, items), bench(spark, items)).orderBy("doc_id").collect()]
    assert one == two
    assert t.contaminated(docs(spark, [ITEM]), bench(spark, [ITEM]).limit(0)).filter("contaminated").count() == 0
    assert t.contaminated(docs(spark, [ITEM]).limit(0), bench(spark, [ITEM])).count() == 0


def test_verbatim_items_rich_in_placeholders(spark):
    long = "First 3 then 14 15 92 6 5 35 and 8 97 9 so 32 38 4 62 64 33 83 2 79 50 28 done"
    rows = ["so What is 12 plus 7 times 3? asked the teacher", "so What is 12 plus 8 times 3? asked the teacher", "read on: " + long, " ".join(w + "1" if w.isdigit() and k % 5 == 0 else w for k, w in enumerate(long.split()))]
    got = {r.doc_id: [h.item_id for h in r.hits] for r in t.contaminated(docs(spark, rows), bench(spark, ["What is 12 plus 7 times 3?", long])).collect()}
    assert got == {0: [0], 1: [], 2: [1], 3: []}


def test_verbatim_items_whatever_stands_before_them_or_their_case(spark):
    item = "What is the capital city of Greece"
    cities = "Then Anna went with Boris from Cairo to Delhi and Edgar met Frida in Geneva before Hanna saw Ivan leave Java"
    rows = ["the teacher asked " + item, item.lower(), "x " + cities.lower() + " y", "What is the capital town of Greece"]
    got = {r.doc_id: [h.item_id for h in r.hits] for r in t.contaminated(docs(spark, rows), bench(spark, [item, cities])).collect()}
    assert got == {0: [0], 1: [0], 2: [1], 3: []}


def test_insertions_and_deletions(spark):
    item = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    more = item[:20] + ["extra"] + item[20:40] + ["again"] + item[40:]
    less = item[:19] + item[20:39] + item[40:]
    turned = item[40:] + ["x"] + item[20:40] + ["x"] + item[:20]
    rows = [" ".join(x) for x in (more, less, turned)]
    got = {r.doc_id: [(h.item_id, h.share) for h in r.hits] for r in t.contaminated(docs(spark, rows), bench(spark, [" ".join(item)])).collect()}
    assert got == {0: [(0, 1.0)], 1: [(0, 58 / 60)], 2: []}


def test_inconsistent_slots_are_another_question():
    index = t.Index([(1, "If Tom has 12 apples and buys 7 more, how many apples does Tom have now?")])
    hits = lambda text: [h[0] for h in index.hits(*t.forms(text))]
    assert hits("If Ann has 30 apples and buys 8 more, how many apples does Ann have now?") == [1]
    assert hits("If Ann has 30 apples and buys 8 more, how many apples does Bob have now?") == []
    assert hits("If Tom has 12 apples and buys 7 more, how many apples does Tom have now?") == [1]


def test_random_questions_and_their_doubles():
    import random

    rnd = random.Random(9)
    names, things = ["Ann", "Bob", "Cid", "Dora", "Ed"], ["apples", "coins", "books"]
    for _ in range(60):
        a, b = rnd.sample(names, 2)
        x, y = rnd.sample(range(10, 99), 2)
        thing = rnd.choice(things)
        item = f"Yesterday {{0}} gave {{1}} exactly {{2}} {thing} and then {{3}} {thing} more, so how many {thing} did {{0}} give {{1}} if {{2}} were returned by {{1}} later"
        index = t.Index([(5, item.format(a, b, x, y))])
        hits = lambda text: [h[0] for h in index.hits(*t.forms(text))]  # noqa: B023, E731
        c, d = rnd.sample(names, 2)
        v, w = rnd.sample(range(10, 99), 2)
        assert hits("Some words before. " + item.format(c, d, v, w) + " and behind") == [5]
        # one value for two of the item's, or two for one of them, is no re-parameterised copy
        mixed = item.format(c, c, v, w) if rnd.random() < 0.5 else item.replace("{2} were", "77 were").format(c, d, v if v != 77 else 78, w)
        if (c, d, v, w) != (a, b, x, y) and not {str(x), str(y), a, b} & {str(v), str(w), c, d}:
            assert hits(mixed) == []
