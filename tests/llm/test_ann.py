import numpy as np

from frameloom.llm import ann, queries
from frameloom.llm.ann import build, search

SF = "/root/testdata/sf0.01"


def exact(ids, vectors, query, own, k):
    scores = vectors @ query
    order = [i for i in np.lexsort((ids, -scores)) if ids[i] != own][:k]
    return [(int(ids[i]), float(scores[i])) for i in order]


def recall_of(found, ids, vectors, k):
    hit = total = 0
    for key, got in found.items():
        want = exact(ids, vectors, vectors[list(ids).index(key)], key, k)
        assert [r for r, *_ in got] == list(range(1, len(got) + 1))
        truth = {i: s for i, s in exact(ids, vectors, vectors[list(ids).index(key)], key, len(ids))}
        assert all(abs(truth[i] - s) < 1e-9 for _, i, s in got)
        assert [(-s, i) for _, i, s in got] == sorted((-s, i) for _, i, s in got)
        # Ties at the end of the list may be cut anywhere by score alone.
        hit += sum(s >= want[-1][1] - 1e-12 for _, _, s in got)
        total += len(want)
    return hit / total


def collect(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def test_recall_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, vectors = np.asarray([r.vec_id for r in rows]), np.asarray([r.embedding for r in rows], dtype=np.float64)
    found = collect(queries.op5_nearest(spark, SF))
    assert set(found) == {int(i) for i in ids if i % 20 == 0} and all(len(x) == 20 for x in found.values())
    assert recall_of(found, ids, vectors, 20) >= 0.95


def test_norms_copies_and_double_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(900, 12)) * rng.exponential(1, size=(900, 1))
    vectors = np.concatenate([base, np.repeat(base[:1], 300, axis=0), base[5:8]])
    ids = rng.permutation(len(vectors)) * 2
    df = spark.createDataFrame([(int(i), v.tolist(), "clash", 1) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>, vec string, node int")
    asked = df.where("vec_id % 20 = 0")
    found = collect(search(build(df, keep=6, rounds=4), asked, k=5))
    assert set(found) == {int(i) for i in ids if i % 20 == 0} and all(len(x) == 5 for x in found.values())
    assert recall_of(found, ids, vectors, 5) >= 0.9
    copies = {int(i) for i, v in zip(ids, vectors) if (v == base[0]).all()}
    for key in copies & set(found):  # equal scores: the smallest ids, never its own
        best = [i for _, i, s in found[key] if abs(s - base[0] @ base[0]) < 1e-12]
        assert best == sorted(copies - {key})[: len(best)]


def test_nulls_and_small_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.0, 2.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 1.0]), (9, []), (10, [1.0]), (40, None), (20, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = collect(search(build(df), df.where("vec_id % 20 = 0")))
    assert found == {0: [(1, 20, 0.5), (2, 3, 0.0)], 20: [(1, 3, 1.0), (2, 0, 0.5)]}
    empty = df.limit(0)
    assert search(build(empty), df).count() == 0 and search(build(df), empty).count() == 0
    one = df.where("vec_id = 0")
    assert search(build(one), one).count() == 0
    assert collect(search(build(one), df.where("vec_id = 3"))) == {3: [(1, 0, 0.0)]}


def test_lists_beside_a_vector_of_large_norm(spark):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(150, 16)) * (1 + rng.pareto(3, size=(150, 1)))  # one bucket: first lists are exact
    vectors[7] *= 300 * np.median(np.linalg.norm(vectors, axis=1)) / np.linalg.norm(vectors[7])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    near = {r.node: set(np.frombuffer(r.near, "<i8").tolist()) for r in build(df, rounds=0).nodes.collect()}
    x = vectors / np.linalg.norm(vectors, axis=1).max()
    x = np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x**2).sum(axis=1)))[:, None]], axis=1)
    sims = x @ x.T - 9 * np.eye(len(x))
    hits = [len(near[i] & set(np.argsort(-sims[i])[:20].tolist())) for i in range(len(x))]
    assert np.mean(hits) / 20 >= 0.9


def test_rows_that_repeat_an_id_are_candidates_of_their_own(spark):
    rows = spark.createDataFrame([(20, [1.0, 0.0]), (3, [0.9, 0.1]), (3, [0.1, 0.9]), (4, [0.5, 0.5]), (4, [0.5, 0.5])], "vec_id long, embedding array<float>")
    got = sorted((r.rank, r.vec_id, round(r.score, 4)) for r in search(build(rows), rows.where("vec_id = 20"), k=20).collect())
    assert got == [(1, 3, 0.9), (2, 4, 0.5), (3, 3, 0.1)]


def sphere(n, seed, dims=32):
    x = np.random.default_rng(seed).normal(size=(n, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_rounds_improve_the_lists_of_a_block():
    x = sphere(4000, 3).astype(np.float32)
    order = np.argsort(-(x[:200] @ x.T), axis=1)[:, 1:21]

    def hits(near):
        return np.mean([len(set(near[i].tolist()) & set(order[i].tolist())) for i in range(200)]) / 20

    rng = np.random.default_rng(1)
    old, ann.BUCKET = ann.BUCKET, 100
    try:
        near, sims = ann._first_lists(x, 20, 3, rng)
    finally:
        ann.BUCKET = old
    first = hits(near)
    near, sims = ann._descend(x, near, sims, 30, 0.01, rng)
    assert first < 0.5 and hits(near) > 0.9
    assert all(len(set(row)) == 20 and i not in row for i, row in enumerate(near.tolist()))
    assert (np.diff(sims, axis=1) <= 0).all()
    assert np.abs(sims[7] - x[near[7]] @ x[7]).max() < 1e-5


def test_recall_of_narrow_pools_over_several_blocks(spark, monkeypatch):
    for name, value in (("BLOCK", 700), ("SMALL", 200), ("BUCKET", 100), ("SEEDS", 32)):
        monkeypatch.setattr(ann, name, value)
    vectors, ids = sphere(5000, 4), np.arange(5000) * 2 + 40
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>")
    index = build(df, neighbours=20)
    assert index.blocks == 8 and index.nodes.select("node").distinct().count() == 5000
    found = collect(search(index, df.where("vec_id % 20 = 0"), k=10, width=480))  # 60 of some 625 in a block
    assert len(found) == 500 and recall_of(found, ids, vectors, 10) >= 0.9


def test_vectors_travel_once_whatever_the_rounds(spark):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(sphere(1500, 5))], "vec_id long, embedding array<double>")

    def jobs(rounds):
        group = f"ann-{rounds}"
        spark.sparkContext.setJobGroup(group, group)
        build(df, rounds=rounds, settled=0)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(1) == jobs(6)
