import random

from gleaner.llm import decontam
from tests.llm.cases import docs, odd_docs, words


def bench(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "item_id long, text string, doc_id string")


def best_share(doc, item, size):
    """Over all alignments and windows of `size` aligned words, the greatest share of equal words."""
    d, b = doc.split(), item.split()
    size, best = min(size, len(b)), 0.0
    for shift in range(-len(b) + size, len(d) - size + 1):
        same = [0 <= i + shift < len(d) and d[i + shift] == b[i] for i in range(len(b))]
        for i in range(len(b) - size + 1):
            if 0 <= i + shift and i + shift + size <= len(d):
                best = max(best, sum(same[i : i + size]) / size)
    return best


def test_substitutions_against_brute_force(spark):
    r = random.Random(4)
    items = [words(r.randrange(15, 60), k) for k in range(40)]
    texts = []
    for k in range(200):
        item = items[k % 40].split()
        rate = [0.0, 0.05, 0.1, 0.4][k % 4]
        part = [f"s{r.randrange(999)}" if r.random() < rate else w for w in item]
        texts.append(f"{words(30, 1000 + k)} {' '.join(part)} {words(30, 2000 + k)}")
    texts += [words(150, 5000 + k) for k in range(50)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(x.doc_id, x.item_id): x.share for x in decontam.overlaps(d, bench(spark, items)).collect()}
    truth = {(k, k % 40) for k in range(200) if best_share(texts[k], items[k % 40], decontam.MIN_WORDS) >= decontam.MIN_SHARE}
    assert set(got) <= truth
    assert len(truth) > 100 and len(set(got)) >= 0.95 * len(truth)
    exact = {(k, k % 40) for k in range(0, 200, 4)}
    assert exact <= set(got)


def test_short_shared_phrases_are_left_alone(spark):
    item = words(40, 1)
    d = spark.createDataFrame([(0, f"{words(50, 2)} {' '.join(item.split()[:12])} {words(50, 3)}")], "doc_id long, text string")
    assert decontam.overlaps(d, bench(spark, [item])).count() == 0


def test_odd_rows(spark):
    b = bench(spark, [words(80, 2), None, "", "too short", words(30_000, 1)]).union(spark.createDataFrame([(None, words(80, 2), "x")], "item_id long, text string, doc_id string"))
    got = {(r.doc_id, r.item_id) for r in decontam.overlaps(docs(spark), b).collect()}
    assert got == {(1, 0), (2, 0), (8, 4)}
    out = decontam.decontaminate(docs(spark), b)
    ids = [r.doc_id for r in out.collect()]
    assert out.columns == docs(spark).columns
    assert sorted(i for i in ids if i) == [3, 4, 5, 6, 7, 9, 10, 11] and ids.count(None) == 2


def test_odd_columns(spark):
    d = odd_docs(spark)
    out = decontam.decontaminate(d, bench(spark, [words(80, 2)]).toDF("item_id", "text", "a.b"))
    assert out.columns == d.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert sorted(i for i in ids if i) == [3, 4, 5, 6, 7, 8, 9, 10, 11] and ids.count(None) == 2


def test_short_windows_against_brute_force(spark):
    r = random.Random(5)
    items = [words(r.randrange(8, 40), k, 60) for k in range(12)] + ["one two three"]
    texts = []
    for k in range(60):
        w = items[k % 13].split()
        a = r.randrange(max(1, len(w) - 7))
        texts.append(f"{words(10, 100 + k, 60)} {' '.join(x if r.random() < 0.85 else 'zz' for x in w[a : a + 12])} {words(10, 300 + k, 60)}")
    texts.append(items[0])
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for least in (12, 11, 8, 3, 1):
        got = {(x.doc_id, x.item_id) for x in decontam.overlaps(d, bench(spark, items), least).collect()}
        truth = {(i, j) for i, t in enumerate(texts) for j, item in enumerate(items) if best_share(t, item, least) >= decontam.MIN_SHARE}
        assert got <= truth and (60, 0) in got and (got == truth or least == 12), least


def test_bit_table_holds_every_hash(spark):
    hits = spark.range(3000).selectExpr("xxhash64(id) as seed")
    table = decontam._bit_table(hits)
    shift = 64 - (8 * len(table) - 1).bit_length()
    slots = {(r.seed & (2**64 - 1)) >> shift for r in hits.collect()}
    assert {8 * i + k for i, b in enumerate(table) if b for k in range(8) if b >> k & 1} == slots


def test_empty_tables(spark):
    assert decontam.overlaps(docs(spark, []), bench(spark, ["x"])).count() == 0
    assert decontam.overlaps(docs(spark), bench(spark, ["x"]).limit(0)).count() == 0


def test_every_overlap_of_short_items(spark):
    r = random.Random(8)
    items, texts, truth = [], [], set()
    for n in range(1, 20):
        for most in range(int(n / 5 + 1e-9) + 1):
            for k in range(4):
                item = [f"i{len(items)}x{j}" for j in range(n)]
                changed = set(r.sample(range(n), most))
                for extra in (0, 1):
                    out = [f"c{j}" if j in changed or extra and j == min(set(range(n)) - changed) else w for j, w in enumerate(item)]
                    if not extra or most == int(n / 5 + 1e-9):
                        if not extra:
                            truth.add((len(texts), len(items)))
                        texts.append(f"{words(25, len(texts))} {' '.join(out)} {words(25, 9000 + len(texts))}")
                items.append(" ".join(item))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontam.overlaps(d, bench(spark, items)).collect()} == truth
