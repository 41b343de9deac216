"""The n-gram join, the near vectors and the components against brute force."""

import random

import numpy as np
import pytest

from tracelake.llm import graph, jaccard, near_vectors


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(50)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    real = [(a, b) for a, b in edges if a != b]
    assert got == roots({n for e in real for n in e}, real)
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def shingle_set(text, n):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def brute(docs, n, num, den):
    sets = {i: shingle_set(t, n) for i, t in docs}
    ids = list(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in roots(ids, links).items()}


def corpus(seed, n=260):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    passage = [rnd.choice(words) for _ in range(30)]
    docs = []
    for i in range(n):
        if docs and rnd.random() < 0.6:
            own = docs[rnd.randrange(len(docs))].split(" ")
            for _ in range(rnd.choice([0, 1, 1, 2, 4])):
                own[rnd.randrange(len(own))] = rnd.choice(words)
        else:
            own = [rnd.choice(words) for _ in range(rnd.choice([1, 2, 3, 4, 8, 30, 90, 200]))] + (passage if rnd.random() < 0.4 else [])
        docs.append(" ".join(own))
    docs += ["", "  \t\n", "Same text HERE", "same TEXT here", "ÀB c d", "àb c d", "one two", "one  two\n", "one"]
    return [(3 * i, t) for i, t in enumerate(docs)] + [(99_999, None)]


@pytest.mark.parametrize(("n", "num", "den"), [(3, 90, 100), (5, 80, 100), (2, 60, 100)])
def test_join_equals_brute_force(spark, n, num, den):
    docs = corpus(n)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS node", "2 AS family").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_classes(frame, n, num, den).collect()}
    assert got == brute(docs, n, num, den)


def test_split_families_and_shuffled_members(spark, monkeypatch):
    docs = corpus(11, 150)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 300)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", -1)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_classes(frame, 3, 80, 100).collect()}
    assert got == brute(docs, 3, 80, 100)


def test_join_defined_cases(spark):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (5, "other words for the same id"), (9, "other words for the same id"), (None, "a b c d e"), (None, None), (2, "A B C D E")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.join_classes(frame, 3, 90, 100).collect()), key=str)
    assert got == sorted([(False, 5, 3, 2), (False, 5, 3, 2), (False, 5, 4, 5), (False, 9, 4, 5), (True, 0, 3, None), (True, 0, 0, None), (False, 2, 3, 2)], key=str)
    assert jaccard.join_classes(frame.limit(0), 3, 90, 100).count() == 0


def test_signatures_of_linked_sets_meet():
    rnd, measure = np.random.default_rng(0), jaccard.Measure(3, 80, 100)
    for _ in range(400):
        size = int(rnd.integers(4, 400))
        a = np.unique(rnd.integers(0, 2**63, size=size, dtype=np.uint64) * np.uint64(2))
        drop = int(rnd.integers(0, max(1, len(a) // 9)))
        b = np.unique(np.concatenate([a[drop:], rnd.integers(0, 2**63, size=drop, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(a) != len(b) or (a != b).any():
            if measure.reaches(both, len(a), len(b)):
                assert len(set(jaccard.signatures(a, measure).tolist()) & set(jaccard.signatures(b, measure).tolist())) >= jaccard.SHARED


@pytest.mark.parametrize(("num", "den"), [(80, 100), (90, 100), (60, 100), (100, 100)])
def test_signatures_meet_in_any_order_of_shingles(num, den):
    rnd, measure = np.random.default_rng(1), jaccard.Measure(3, num, den)
    common = rnd.integers(0, 3, 1 << jaccard.SLOT_BITS).astype(np.uint16)
    for _ in range(600):
        pool = rnd.integers(0, 2**64, size=60, dtype=np.uint64)
        a = np.unique(rnd.choice(pool, size=int(rnd.integers(1, 40))))
        b = np.unique(np.concatenate([a[int(rnd.integers(0, 3)) :], rnd.choice(pool, size=int(rnd.integers(0, 4)))]))
        if len(a) != len(b) or (a != b).any():
            if measure.reaches(len(np.intersect1d(a, b)), len(a), len(b)):
                both = set(jaccard.signatures(a, measure, common).tolist()) & set(jaccard.signatures(b, measure, common).tolist())
                assert len(both) >= measure.least_shared


def test_a_passage_of_many_documents_makes_no_family(spark, monkeypatch):
    """Documents that share a passage, and nothing else, used to be one wide family, searched in pairs of blocks."""
    rnd, edges, closed = random.Random(4), [], jaccard.components
    passage = [f"p{i}" for i in range(30)]
    docs = [(i, " ".join([f"w{rnd.randrange(10**9)}" for _ in range(70)] + passage)) for i in range(200)]
    docs += [(1_000, docs[0][1] + " more"), (1_001, docs[1][1] + " more")]

    def spied(links, *names):
        edges.append(links.distinct().count())
        return closed(links, *names)

    monkeypatch.setattr(jaccard, "components", spied)
    got = {r.doc_id: r.component_id for r in jaccard.join_classes(spark.createDataFrame(docs, "doc_id bigint, text string"), 5, 80, 100).collect()}
    assert edges[0] == 2 and got == {i: {1_000: 0, 1_001: 1}.get(i, i) for i, _ in docs}


def vector_brute(rows, threshold=0.95):
    ok = {i: v for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = list(ok)
    near = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(ok[a]) == len(ok[b]) and np.dot(ok[a], ok[b]) / (np.linalg.norm(ok[a]) * np.linalg.norm(ok[b])) >= threshold]
    comp = roots([i for i, _ in rows], near)
    return {i: (sum(i in e for e in near), comp[i], comp[i] == i) for i, _ in rows}


def vectors(seed, n=500, dim=16):
    rnd = np.random.default_rng(seed)
    base = rnd.normal(size=(n // 4, dim))
    rows = [(2 * i, (base[rnd.integers(len(base))] + 0.07 * rnd.normal(size=dim)).tolist()) for i in range(n)]
    centre = rnd.normal(size=dim)
    rows += [(5000 + i, (centre + 0.03 * rnd.normal(size=dim)).tolist()) for i in range(120)]
    rows += [(7000, [0.0] * dim), (7001, None), (7002, [float("nan")] * dim), (7003, [None] * dim), (7004, [float("inf")] + [1.0] * (dim - 1)), (7005, [1.0, 2.0]), (7006, [2.0, 4.0]), (7007, []), (7008, rows[0][1]), (7009, rows[0][1])]
    return rows


@pytest.mark.parametrize("shard", [2_000, 90])
def test_near_vectors_reach_the_links(spark, monkeypatch, shard):
    monkeypatch.setattr(near_vectors, "SHARD", shard)
    monkeypatch.setattr(near_vectors, "PER_CENTRE", 100)
    rows = vectors(1)
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 AS label", "2 AS node").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors.near_vectors(frame).collect()}
    want = vector_brute(rows)
    assert set(got) == set(want) and all(got[i][0] <= want[i][0] for i in want)
    assert sum(g[0] for g in got.values()) >= 0.97 * sum(w[0] for w in want.values())
    assert all(got[i] == want[i] for i in range(7000, 7010))
    assert sum(got[i] == want[i] for i in want) >= 0.9 * len(want)


def test_near_vectors_empty_and_null(spark):
    frame = spark.createDataFrame([(1, None), (None, [1.0, 0.0]), (4, [2.0, 0.0]), (4, [2.0, 0.0])], "vec_id bigint, embedding array<double>")
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in near_vectors.near_vectors(frame).collect()), key=str)
    assert got == [(0, 2, None, False), (1, 0, 1, True), (4, 2, 4, True), (4, 2, 4, True)]
    assert near_vectors.near_vectors(frame.limit(0)).count() == near_vectors.near_vectors(frame.where("vec_id = 1")).count() - 1 == 0


def dense_groups(dim=48, size=90):
    """Groups of more than 64 vectors each; the last two lie so close that they link, the others do not."""
    rnd = np.random.default_rng(7)
    centres = rnd.normal(size=(6, dim))
    centres = centres / np.linalg.norm(centres, axis=1, keepdims=True)
    centres[5] = centres[4] + 0.22 * centres[0]
    return [(1000 * g + i, (c + 0.002 * rnd.normal(size=dim)).tolist()) for g, c in enumerate(centres) for i in range(size)]


@pytest.mark.parametrize("shard", [2_000, 150])
def test_dense_groups_in_one_shard_keep_all_links(spark, monkeypatch, shard):
    monkeypatch.setattr(near_vectors, "SHARD", shard)
    monkeypatch.setattr(near_vectors, "PER_CENTRE", 10_000)
    rows = dense_groups()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept, r.audit_recall) for r in near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)).collect()}
    want = vector_brute(rows)
    assert len({c for _, c, _ in want.values()}) == 5 and {n for n, _, _ in want.values()} == {89, 179}
    assert got == {i: (*w, 1.0) for i, w in want.items()}


def test_shards_that_miss_links_are_widened(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "OVERLAP", 1)
    monkeypatch.setattr(near_vectors, "PER_CENTRE", 20)
    monkeypatch.setattr(near_vectors, "fit_centres", lambda sample, wanted: sample[:wanted])  # centres that tear the group apart
    rnd = np.random.default_rng(4)
    rows = [(i, (np.ones(16) + 0.05 * rnd.normal(size=16)).tolist()) for i in range(200)]
    got = {r.vec_id: r for r in near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    want = vector_brute(rows)
    assert all(got[i].n_links <= want[i][0] and got[i].audit_recall >= 0.9 for i in want)
    assert sum(got[i].n_links for i in want) >= 0.9 * sum(w[0] for w in want.values()) and {i: got[i].component_id for i in got} == {i: w[1] for i, w in want.items()}


def test_huge_and_tiny_vectors(spark):
    rows = [(1, [1e200, 2e200]), (2, [2e200, 4e200]), (3, [1e-200, 2e-200]), (4, [5e-324, 1e-323]), (5, [1e308, -1e308]), (6, [1e-308, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5), 6: (0, 6)}


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def test_pruning_hides_what_a_kept_neighbour_stands_for():
    angles = np.radians([[5.0, 6.0, 20.0, -10.0]])  # from a vector at 0 degrees: 6 and 20 lie behind 5, -10 does not
    order = np.argsort(np.abs(angles), axis=1)
    angles = np.take_along_axis(angles, order, 1)
    kept = near_vectors.prune(np.cos(angles), np.cos(angles[:, :, None] - angles[:, None, :]))
    assert np.degrees(angles[kept]).round().tolist() == [5.0, -10.0]
    rnd = unit(np.random.default_rng(0).normal(size=(1, 40, 60)))
    assert near_vectors.prune(np.sort(rnd[:, :, 0])[:, ::-1], rnd @ rnd.transpose(0, 2, 1), degree=7).sum() == 7


@pytest.mark.parametrize("gathered", [1 << 22, 3000])
def test_graph_search_meets_all_links_of_a_part(monkeypatch, gathered):
    monkeypatch.setattr(near_vectors, "GATHERED", gathered)
    rnd = np.random.default_rng(2)
    centre = rnd.normal(size=(9, 24))
    x = unit(np.concatenate([c + s * rnd.normal(size=(m, 24)) for c, s, m in zip(centre, [0.01, 0.05, 0.1, 0.2, 0.2, 0.2, 1, 1, 1], [150, 90, 120, 40, 40, 40, 30, 30, 30], strict=True)]))
    a, b = near_vectors.pruned_edges(x)
    assert set(zip(a.tolist(), b.tolist())) == set(zip(b.tolist(), a.tolist())) and (a != b).all() and len(a) < 2 * near_vectors.DEGREE * len(x)
    seeds = near_vectors.medoids(x, a, b, 0.95)
    label = roots(range(len(x)), list(zip(a.tolist(), b.tolist())))
    assert {label[s] for s in seeds.tolist()} == set(label.values()) and 3 <= len(seeds) <= len(x) / near_vectors.GROUP
    score = near_vectors.greedy_search(x, x, a, b, seeds, 0.95, near_vectors.WIDTH)
    exact = x @ x.T
    met = score > -np.inf
    assert np.allclose(score[met], exact[met], atol=1e-12) and met.mean() < 0.9
    assert ((score >= 0.95) == (exact >= 0.95)).mean() > 0.9999
    one = x[:1]
    assert near_vectors.greedy_search(one, one, *near_vectors.pruned_edges(one), np.array([0]), 0.95, 32).shape == (1, 1)


def test_components_shuffle_three_times_a_round(spark, monkeypatch):
    """A round used to read and join its pairs in four places, which a large number of partitions made slow."""
    import random

    from tracelake.llm import graph

    plans, keep = [], graph.stage
    monkeypatch.setattr(graph, "stage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    pick = random.Random(4)
    edges = [(pick.randrange(300), pick.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, i) for i in range(5001, 5200)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {n: n for pair in edges if pair[0] != pair[1] for n in pair}
    for _ in want:
        for x, y in edges:
            if x != y:
                want[x] = want[y] = min(want[x], want[y])
    assert got == want
    assert len(plans) > 2 and all("Join" not in p and p.count("Exchange hashpartitioning") == 3 for p in plans[1:])
