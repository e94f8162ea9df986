import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gleaner.llm import simhash
from tests.llm.cases import docs, odd_docs, simple, words


def edited(text, share, seed):
    r = random.Random(seed)
    return " ".join(f"e{r.randrange(9999)}" if r.random() < share else w for w in text.split())


def brute(fps, limit):
    return {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if int(np.bitwise_count(fps[i] ^ fps[j]).sum()) <= limit}


def test_fingerprint_is_the_sign_of_the_bit_sums():
    text = "The cat sat on the mat. The cat sat."
    fp, has = simhash.fingerprints(pa.array([text, None, "", " \n", "one"]))
    assert has.tolist() == [True, False, False, False, True]
    again, _ = simhash.fingerprints(pa.array(["THE CAT, sat on the mat the cat sat"]))
    assert (fp[0] == again[0]).all()


def test_many_words_beyond_one_lane():
    one, _ = simhash.fingerprints(pa.array([words(3000, 1)]))
    both, _ = simhash.fingerprints(pa.array([words(3000, 1), words(700, 2)]))
    assert (one[0] == both[0]).all()


def test_recall_against_brute_force(spark):
    texts = []
    for g in range(60):
        base = words(120, g)
        texts += [base] + [edited(base, 0.05, 100 * g + k) for k in range(4)]
    texts += [words(120, 10_000 + k) for k in range(400)]
    fps, _ = simhash.fingerprints(pa.array(texts))
    truth = brute(fps, simhash.MAX_DISTANCE)
    reps = spark.createDataFrame([(i, *map(int, f.view(np.int64))) for i, f in enumerate(fps)], "rep long, f0 long, f1 long, f2 long, f3 long")
    got = {(r.a, r.b) for r in simhash.near_pairs(reps).collect()}
    assert len(truth) > 300 and got <= truth
    assert len(got) >= 0.9 * len(truth)


def test_crowded_node_has_the_same_recall():
    base = words(200, 5)
    fps, _ = simhash.fingerprints(pa.array([edited(base, 0.02, k) for k in range(300)] + [words(60, 50 + k) for k in range(1500)]))
    truth = brute(fps[:300], simhash.MAX_DISTANCE)
    i, j = simhash.close_pairs(fps, np.zeros(len(fps), np.int64))
    got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
    assert len(got & truth) >= 0.95 * len(truth)


def test_plan_climbs_until_recall():
    for n in (1, 100, 10**6, 10**9, 10**12):
        depth, tries = simhash.plan(n)
        assert 1 <= depth and tries <= simhash.MAX_TRIES
    assert simhash.plan(10**6)[0] > simhash.plan(10**3)[0]


def planted(rows, pairs, distances, seed=7):
    """Random fingerprints, and for each distance the (i, j) of as many pairs that differ in just so many bits."""
    r = np.random.default_rng(seed)
    bits = r.integers(0, 2, (rows, simhash.BITS), dtype=np.uint8)
    truth, at = {}, 0
    for d in distances:
        truth[d] = set()
        for _ in range(pairs):
            bits[at + 1] = bits[at]
            bits[at + 1, r.choice(simhash.BITS, d, replace=False)] ^= 1
            truth[d].add((at, at + 1))
            at += 2
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64), truth


def found_in(fps, trie):
    i, j = simhash.close_pairs(fps, np.full(len(fps), trie << 48, np.int64))
    return {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}


def test_crowded_node_finds_the_farthest_pairs():
    fps, truth = planted(5000, 300, (50, 53, 56))
    got = found_in(fps, 0)
    for d, pairs in truth.items():
        assert len(got & pairs) >= 0.92 * len(pairs), d


def test_crowded_nodes_of_other_tries_miss_other_pairs():
    fps, truth = planted(5000, 800, (56,))
    missed = [truth[56] - found_in(fps, t) for t in range(3)]
    assert len(missed[0] & missed[1] & missed[2]) <= 2


def test_plan_reaches_the_recall_at_the_greatest_distance():
    for n in (1000, 10**5, 10**6, 10**9):
        depth, tries = simhash.plan(n)
        p = np.prod([(simhash.BITS - simhash.MAX_DISTANCE - i) / (simhash.BITS - i) for i in range(depth)])
        assert 1 - (1 - p) ** tries >= simhash.RECALL


def test_groups_keep_the_least_id(spark):
    base = words(150, 1)
    got = {r.doc_id: r for r in simhash.near_duplicates(simple(spark, [words(150, 2), base, edited(base, 0.03, 1), base, words(150, 3)])).collect()}
    assert [got[i].group_id for i in range(5)] == [0, 1, 1, 1, 4]
    assert [got[i].keep for i in range(5)] == [True, True, False, False, True]
    assert got[3].group_size == 3


def test_odd_rows(spark):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark)).collect()}
    assert sorted(got) == list(range(1, 12))
    assert got[2].group_id == 1 and not got[2].keep and got[7].group_id == 6
    assert all(got[i].keep for i in (3, 4, 5, 8, 9, 10, 11))
    kept = simhash.keep_one(docs(spark))
    assert kept.columns == docs(spark).columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i) == [1, 3, 4, 5, 6, 8, 9, 10, 11] and ids.count(None) == 2


def test_odd_columns(spark):
    d = odd_docs(spark)
    got = {r.doc_id: r for r in simhash.near_duplicates(d).collect()}
    assert sorted(got) == list(range(1, 12)) and got[2].group_id == 2  # "a second text" is the least of 2's
    kept = simhash.keep_one(d)
    assert kept.columns == d.columns and kept.schema == d.schema
    rows = {r["doc_id"]: r for r in kept.collect() if r["doc_id"]}
    assert sorted(rows) == [1, 2, 3, 4, 5, 6, 8, 9, 10, 11] and rows[2]["text"] == "a second text" and rows[2]["a`b"] == {"k": "14"}
    assert simhash.keep_one(odd_docs(spark, [])).count() == 0


def test_hot_nodes_are_cut_up(spark):
    base, other = words(200, 5), words(200, 6)
    texts = [edited(base, 0.02, k) for k in range(500)] + [edited(other, 0.02, k) for k in range(60)] + [words(60, 50 + k) for k in range(300)]
    r = random.Random(1)
    r.shuffle(texts)
    fps, _ = simhash.fingerprints(pa.array(texts))
    truth = brute(fps, simhash.MAX_DISTANCE)
    label = list(range(len(texts)))
    i, j = (np.array(x) for x in zip(*truth))
    want = simhash.merge(np.arange(len(texts)), i, j).tolist()
    for levels in (1, 2, 4):
        got = {r.doc_id: r.group_id for r in simhash.near_duplicates(simple(spark, texts), hot=150, every=1, levels=levels).collect()}
        same = set(zip([got[k] for k in label], want))
        assert len(same) == len(set(got.values())) == len(set(want)), levels


def near(r, base, flips, places, n):
    """n fingerprints (bits) that differ from base in ``flips`` of the given places."""
    out = np.repeat(base[None, :], n, axis=0)
    for row in out:
        row[r.choice(places, flips, replace=False)] ^= 1
    return out


def test_a_thick_node_costs_components_and_not_pairs():
    r = np.random.default_rng(3)
    bits = np.concatenate([near(r, r.integers(0, 2, 256, dtype=np.uint8), 12, np.arange(256), 3000), r.integers(0, 2, (1000, 256), dtype=np.uint8)])
    fps = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    tracemalloc.start()
    label = simhash.close_groups(fps, np.zeros(len(fps), np.int64))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (label[:3000] == 0).all() and (label[3000:] == np.arange(3000, 4000)).all()
    assert peak < 100e6  # the node's pairs alone are 72 MB for every trie that has them


def bridged(r, groups=2, n=400):
    """Fingerprints in ``groups`` groups: two thick ones each, joined by one pair of members at 50 bits."""
    parts = []
    for _ in range(groups):
        a = r.integers(0, 2, 256, dtype=np.uint8)
        x, y, b = a.copy(), a.copy(), a.copy()
        x[:40] ^= 1
        y[:90] ^= 1
        b[:120] ^= 1
        parts += [near(r, a, 4, np.arange(120, 256), n), near(r, b, 4, np.arange(120, 256), n), x[None, :], y[None, :]]
    bits = np.concatenate(parts)
    return np.packbits(bits[r.permutation(len(bits))], axis=1, bitorder="little").view(np.uint64)


def test_a_hot_node_loses_no_link_between_two_members(spark, monkeypatch):
    fps = bridged(np.random.default_rng(11))
    i, j = (np.array(k) for k in zip(*brute(fps, simhash.MAX_DISTANCE)))
    want = simhash.merge(np.arange(len(fps)), i, j)
    reps = spark.createDataFrame([(k, *map(int, f.view(np.int64))) for k, f in enumerate(fps)], "rep long, f0 long, f1 long, f2 long, f3 long")
    monkeypatch.setattr(simhash, "plan", lambda *a: (0, 1))  # one node for all
    for levels in (1, 3):
        links = simhash.near_pairs(reps, stars=True, hot=200, every=1, levels=levels).collect()
        got = simhash.merge(np.arange(len(fps)), np.array([e.a for e in links]), np.array([e.b for e in links]))
        assert len(set(want)) == 2 and (got == want).all(), levels


def test_a_crowded_node_loses_no_pair(spark, monkeypatch):
    fps, truth = planted(5000, 800, (50, 53, 56))
    pairs = set.union(*truth.values())
    assert found_in(fps, 3) == pairs
    want = np.arange(len(fps))
    want[[j for _, j in pairs]] = [i for i, _ in pairs]
    assert (simhash.close_groups(fps, np.zeros(len(fps), np.int64)) == want).all()
    reps = spark.createDataFrame([(k, *map(int, f.view(np.int64))) for k, f in enumerate(fps)], "rep long, f0 long, f1 long, f2 long, f3 long")
    monkeypatch.setattr(simhash, "plan", lambda *a: (0, 1))  # one node for all
    for hot in (simhash.HOT, 3000):  # as one task, and as pairs of chunks of more than CROWDED
        assert {(e.a, e.b) for e in simhash.near_pairs(reps, stars=True, hot=hot, every=1).collect()} == pairs, hot


def test_a_task_of_the_search_writes_a_bounded_number_of_entries(spark, monkeypatch):
    fps, truth = planted(3000, 200, (20,))
    rows = [(k, *map(int, f.view(np.int64))) for k, f in enumerate(fps)]
    reps = spark.createDataFrame(rows, "rep long, f0 long, f1 long, f2 long, f3 long").coalesce(1)
    tries, search, written = simhash.plan(len(fps))[1], simhash.search_cells, []

    def spied(members, *args, **params):
        written.extend(tries * r[0] for r in members.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).select("n").collect())
        return search(members, *args, **params)

    monkeypatch.setattr(simhash, "ENTRIES", 10_000, raising=False)
    monkeypatch.setattr(simhash, "search_cells", spied)
    assert {(e.a, e.b) for e in simhash.near_pairs(reps, stars=True).collect()} == truth[20]
    assert sum(written) == 3000 * tries > 20_000 and max(written) < 2 * 10_000


def test_empty_table(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    assert simhash.keep_one(docs(spark, [])).count() == 0
