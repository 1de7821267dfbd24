import random

from gridtrace.llm import decontam as D

WORDS = "river stone cloud apple garden yellow window mountain silver quiet lantern forest paper music winter bridge copper candle meadow harbor".split()


def text(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.choice("abcdefgh")) * r.randrange(3) for _ in range(n))


def found(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in D.pairs(d, b, **options).collect()}


def test_copies_near_copies_and_clean(spark):
    items = [(1, text(1, 30)), (2, text(2, 40)), (3, text(3, 6))]
    near = items[1][1].split()
    near[20] = "changed"
    docs = [(10, f"{text(50, 60)} {items[0][1]}. {text(51, 40)}"), (11, " ".join(near)), (12, text(60, 500)), (13, items[2][1]), (14, items[0][1].upper())]
    assert found(spark, docs, items).keys() == {(10, 1), (11, 2), (13, 3), (14, 1)}


def test_questions_asked_anew(spark):
    item = "the farmer Anna has 12 apples and gives 5 kg of them to her neighbour who already keeps 12 apples in the old wooden barn"
    anew = item.replace("Anna", "Mary Jane").replace("12", "40").replace("5 kg", "7 pounds")
    broken = item.replace("12", "40", 1).replace("Anna", "Bob")
    got = found(spark, [(1, anew), (2, broken), (3, item)], [(7, item)])
    assert got.keys() == {(1, 7), (3, 7)} and got[1, 7].reparameterised and not got[3, 7].reparameterised


def test_number_tables_alone_are_no_leak(spark):
    item = "sum the row 1 2 3 4 5 6 7 8 9 10 and give the total of the row as an answer"
    docs = [(1, "values 11 12 13 14 15 16 17 18 19 20 are in the table")]
    assert found(spark, docs, [(1, item)]) == {}


def test_odd_rows(spark):
    item = text(1, 30)
    long = text(9, 100_000) + " " + item
    rows = [(1, None, 3), (2, "", 3), (None, item, 3), (3, long, 3), (4, item, 3), (4, item, 3), (5, text(8, 30), 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(1, item, 0), (2, item, 0), (3, None, 0), (None, "", 0), (4, "a b", 0)], "item_id long, text string, doc_id int")
    got = D.pairs(docs, bench).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in got) == [(d, i) for d in ("3", "4", "None") for i in (1, 2)]
    kept = D.keep_clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 5]
    assert D.pairs(docs.limit(0), bench).collect() == [] and D.pairs(docs, bench.limit(0)).collect() == []
    assert D.keep_clean(docs, bench.limit(0)).count() == len(rows)


def test_query_against_brute_force(spark):
    """A document leaks an item where eight words in a row are the item's; here that settles it."""
    from gridtrace.llm.queries import op4_decontamination

    sf = "/root/testdata/sf0.01"
    strip = lambda t: [w for w in (x.strip(D._EDGE).lower() for x in t.split()) if w]
    grams = {}
    for i, t in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect():
        w = strip(t)
        for k in range(len(w) - 12):
            grams.setdefault(tuple(w[k : k + 13]), set()).add(i)
    want = set()
    for d, t in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        w = strip(t)
        for k in range(len(w) - 12):
            want |= {(d, i) for i in grams.get(tuple(w[k : k + 13]), ())}
    got = {(r.doc_id, r.item_id) for r in op4_decontamination(spark, sf).collect()}
    assert want and got == want


def test_passages_of_many_items_count(spark):
    passage, preamble = text(70, 60), text(71, 10)
    items = [(i, f"{passage} {text(100 + i, 12)}") for i in range(30)]  # 30 questions about one passage
    items += [(100 + i, f"{preamble} {text(200 + i, 30)}") for i in range(30)]  # a short preamble: 3 windows
    items += [(200 + i, f"{text(300 + i % 3, 9)} {passage[: len(passage) // 3]}") for i in range(3)]
    half = " ".join(items[35][1].split()[:22])
    docs = [(1, f"{text(80, 40)} {passage} {text(81, 40)}"), (2, f"{text(82, 40)} {preamble} {text(83, 40)}"), (3, half), (4, " ".join(items[40][1].split()[6:20])), (5, text(84, 90))]
    want = {(1, i) for i in [*range(30), 200, 201, 202]} | {(3, 105), (4, 110)}
    for shared in (1, 20, 1000):
        assert found(spark, docs, items, shared=shared).keys() == want


def test_items_of_numbers_and_names_are_found_word_for_word(spark):
    items = [(1, "Solve 3 x + 7 = 22"), (2, "Anna 12, Bob 15, Carl 19, Dora 23"), (3, "the table 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20 has one sum")]
    docs = [(1, f"{text(1, 20)}. Please Solve 3 x + 7 = 22 now"), (2, f"{text(2, 20)} Eve 3, Anna 12, Bob 15, Carl 19, Dora 23 {text(3, 9)}"), (3, "so 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 it goes")]
    docs += [(4, "Solve 4 x + 9 = 25"), (5, "Anna 13, Bob 15, Carl 19, Dora 23"), (6, "the table 31 32 33 34 35 36 37 38 39 40 41 42 43 44 45 46 has a sum")]
    assert found(spark, docs, items).keys() == {(1, 1), (2, 2), (3, 3)}


def test_every_item_of_a_template_makes_a_pair(spark):
    ask = "a shop sells {} red pencils and {} blue pens in one day so how many things does it sell in a week"
    items = [(1, ask.format(3, 5)), (2, ask.format(7, 9)), (3, ask.format(7, 9)), (4, ask.format(6, 6)), (None, ask.format(1, 2))]
    got = found(spark, [(1, ask.format(7, 9)), (2, ask.format(30, 50)), (3, ask.format(8, 8))], items)
    assert {k: r.reparameterised for k, r in got.items() if k[0] == 1} == {(1, 1): True, (1, 2): False, (1, 3): False, (1, None): True}
    assert got.keys() == {(1, i) for i in (1, 2, 3, None)} | {(2, i) for i in (1, 2, 3, None)} | {(3, i) for i in (1, 2, 3, 4, None)}


def test_scattered_fragments_are_no_run(spark):
    words = text(400, 200).split()
    parts = [words[k : k + 8] for k in range(0, 180, 30)]  # six times eight words: 6 of 193 windows
    there = " ".join(" ".join(p) + " " + text(410 + i, 22) for i, p in enumerate(parts))  # all on one diagonal
    assert found(spark, [(1, there), (2, " ".join(words[40:53])), (3, " ".join(words[40:52]))], [(1, " ".join(words))]).keys() == {(2, 1)}


def test_items_of_a_common_stem(spark):
    stem = text(420, 30)
    items = [(i, f"{stem} {WORDS[i % 20]}{i}") for i in range(25)]
    assert found(spark, [(1, items[0][1])], items).keys() == {(1, i) for i in range(25)}


def test_templates_against_brute_force(spark):
    """Items and documents made of templates with slots: all pairs are compared word by word."""
    r = random.Random(5)
    plain = [w.split()[0] for w in (text(500 + i, 1) for i in range(60))]
    shapes = [[r.choice([*plain, *plain, "<>"]) for _ in range(r.randrange(14, 30))] for _ in range(6)]
    fill = lambda shape: " ".join(str(r.randrange(1, 4)) if w == "<>" else w for w in shape)
    items = [(i, fill(r.choice(shapes))) for i in range(24)]
    docs = [(i, " ".join([*r.choices(plain, k=5), *fill(r.choice(shapes)).split(), *r.choices(plain, k=5)])) for i in range(30)]
    want = set()
    for d, t in docs:
        dw = t.split()
        for i, u in items:
            iw = u.split()
            for off in range(len(dw) - len(iw) + 1):
                pairs_ = list(zip(iw, dw[off : off + len(iw)], strict=True))
                shape = all(a == b or (a.isdigit() and b.isdigit()) for a, b in pairs_)
                slots = {(a, b) for a, b in pairs_ if a.isdigit()}
                if shape and len(slots) == len({a for a, _ in slots}):
                    want.add((d, i))
    got = found(spark, docs, items, coverage=1.0, run_words=10_000).keys()
    usable = {i for i, u in items if all(sum(w.isalpha() for w in u.split()[k : k + 8]) >= 4 for k in range(len(u.split()) - 7))}
    assert want and {(d, i) for d, i in got if i in usable} == {(d, i) for d, i in want if i in usable}
