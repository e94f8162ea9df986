import numpy as np

from gleaner.llm import lattice


def unit(rng, n, d=32):
    v = rng.normal(size=(n, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_decoding_is_nearest():
    x = np.random.default_rng(0).normal(size=(3000, 8)) * 3
    p = lattice.nearest_e8(x)
    own = ((x - p) ** 2).sum(axis=1)
    assert len(lattice.NEIGHBOURS) == 240 and own.max() <= 1 + 1e-9
    for v in lattice.NEIGHBOURS:
        assert (own <= ((x - p - v) ** 2).sum(axis=1) + 1e-9).all()
    half = (2 * p).astype(int)
    assert (half == 2 * p).all() and ((half % 2 == 0).all(axis=1) | (half % 2 != 0).all(axis=1)).all()
    assert (p.sum(axis=1) % 2 == 0).all()


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = unit(rng, 300)
    near = [b * c + np.sqrt(1 - c * c) * (lambda w: (w - (w @ b) * b) / np.linalg.norm(w - (w @ b) * b))(rng.normal(size=32)) for b in base for c in rng.uniform(0.93, 1.0, 3)]
    v = np.concatenate([base, near, unit(rng, 600)])
    s = v @ v.T
    truth = {(i, j) for i, j in zip(*np.where(np.triu(s, 1) >= lattice.MIN_COSINE))}
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {(r.a, r.b) for r in lattice.near_pairs(d).collect()}
    assert len(truth) > 500 and got <= truth and len(got) >= 0.9 * len(truth)


def test_probing_finds_more():
    rng = np.random.default_rng(2)
    a = unit(rng, 3000)
    w = rng.normal(size=a.shape)
    w -= (w * a).sum(axis=1, keepdims=True) * a
    b = 0.96 * a + 0.28 * w / np.linalg.norm(w, axis=1, keepdims=True)
    ka, kb = list(lattice.cells(a, 0, 1)), list(lattice.cells(b, 0, 1))
    alone = (ka[0][0] == kb[0][0]).mean()
    probed = np.any([k == kb[0][0] for k, _ in ka], axis=0).mean()
    assert probed > alone + 0.05


def test_groups_and_odd_rows(spark):
    x = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, x, 0), (2, x, 0), (2, x, 0), (3, [1.0, 2.0, 3.0, 4.01], 0), (4, None, 0), (5, [], 0), (6, [0.0] * 4, 0), (7, [0.0] * 4, None), (8, [float("nan")] * 4, 0), (9, [None, 1.0, 2.0, 3.0], 0), (10, [4.0, -3.0, 2.0, -1.0], 0), (11, [5.0], 0), (None, x, 0), (12, [float("inf"), 1.0, 0.0, 0.0], 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell int")
    got = {r.vec_id: r for r in lattice.near_duplicates(d).collect()}
    assert sorted(got) == list(range(1, 13))
    assert got[2].group_id == got[3].group_id == 1 and got[1].group_size == 3
    assert all(got[i].keep for i in (1, 4, 5, 6, 7, 8, 9, 10, 11, 12)) and not got[2].keep
    assert all(got[i].group_size == 1 for i in (4, 5, 6, 7, 8, 9, 10, 11, 12))


def test_vectors_without_a_direction_stand_alone(spark):
    odd = [[0.0] * 4, [float("inf"), 1.0, 0.0, 0.0], [float("nan")] * 4, [None, 1.0, 0.0, 0.0], [], None]
    rows = [(k * 10 + c, v, {"m": "x"}, 1) for k, v in enumerate(odd) for c in (1, 2)] + [(91, [1e200, 1e200, 0.0, 0.0], None, 1), (92, [1e-200, 1e-200, 0.0, 0.0], None, 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, `a.b` map<string,string>, rep int")
    got = {r.vec_id: (r.group_id, r.group_size, r.keep) for r in lattice.near_duplicates(d).collect()}
    assert got.pop(91) == (91, 2, True) and got.pop(92) == (91, 2, False)
    assert got == {i: (i, 1, True) for i in got} and len(got) == 12


def test_repeated_ids_with_columns_of_any_type(spark):
    rows = [(1, [1.0, 0.0], {"k": "b"}), (1, [0.0, 1.0], {"k": "a"}), (1, [0.0, 1.0], None), (2, [0.0, 1.0], None), (3, [1.0, 0.0], None)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, `meta.url` map<string,string>")
    assert {r.vec_id: r.group_id for r in lattice.near_duplicates(d).collect()} == {1: 1, 2: 1, 3: 3}


def groups_by_brute_force(v):
    label = np.arange(len(v))
    near = v @ v.T >= lattice.MIN_COSINE
    while True:
        new = np.array([label[near[i]].min() for i in range(len(v))])
        if (new == label).all():
            return label
        label = new


def thick(rng, sizes, spread, alone):
    parts = []
    for n in sizes:
        b = unit(rng, 1, 64)[0]
        x = b + spread * rng.normal(size=(n, 64)) / 8
        parts.append(x / np.linalg.norm(x, axis=1, keepdims=True))
    v = np.concatenate([*parts, unit(rng, alone, 64)])
    return v[rng.permutation(len(v))]


def same_groups(got, want):
    pairs = set(zip(got, want))
    return len(pairs) == len(set(got)) == len(set(want))


def test_thick_groups_cost_links_and_not_pairs(spark):
    v = thick(np.random.default_rng(3), [1500, 40], 0.15, 500)
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.group_id for r in lattice.near_duplicates(d).collect()}
    assert [got[i] for i in range(len(v))] == groups_by_brute_force(v).tolist()
    assert lattice.near_pairs(d, stars=True).count() < 5 * len(v)


def test_components_of_a_cell_are_exact():
    v = thick(np.random.default_rng(4), [300, 200, 5], 0.3, 400)
    links = lattice._Links(v.astype(np.float32), np.ones(len(v), bool), lattice.MIN_COSINE, True)
    links.many(np.arange(len(v)))
    i, j = links.unsure()
    near = np.einsum("ij,ij->i", v[i], v[j]) >= lattice.MIN_COSINE
    assert (lattice.merge(links.label, i[near], j[near]) == groups_by_brute_force(v)).all()


def test_hot_cells_are_cut_up(spark):
    v = thick(np.random.default_rng(5), [1200, 30, 20], 0.2, 300)
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    want = groups_by_brute_force(v).tolist()
    for levels in (1, 2, 4):
        got = {r.vec_id: r.group_id for r in lattice.near_duplicates(d, hot=200, every=1, levels=levels).collect()}
        assert same_groups([got[i] for i in range(len(v))], want), levels


def test_a_hot_cell_loses_no_link_between_two_members(spark, monkeypatch):
    rng, parts = np.random.default_rng(12), []
    for _ in range(2):  # two thick groups at 0 and 44 degrees, joined by one pair of members at 14 and 30
        a, w = np.linalg.qr(rng.normal(size=(32, 2)))[0].T
        at = lambda degrees: np.cos(np.radians(degrees)) * a + np.sin(np.radians(degrees)) * w  # noqa: B023, E731
        for degrees, n in ((0, 400), (44, 400), (14, 1), (30, 1)):
            x = at(degrees) + (n > 1) * 0.002 * rng.normal(size=(n, 32))
            parts.append(x / np.linalg.norm(x, axis=1, keepdims=True))
    v = np.concatenate(parts)
    v = v[rng.permutation(len(v))]
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    want = groups_by_brute_force(v).tolist()
    assert len(set(want)) == 2
    monkeypatch.setattr(lattice, "plan", lambda *a: (0, 1))  # one cell for all
    for levels in (1, 3):
        got = {r.vec_id: r.group_id for r in lattice.near_duplicates(d, hot=200, every=1, levels=levels).collect()}
        assert same_groups([got[i] for i in range(len(v))], want), levels


def test_empty_table(spark):
    assert lattice.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
