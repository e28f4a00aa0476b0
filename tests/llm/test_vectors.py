"""Whitening, centroid clustering and vector near-dedup against plain NumPy and Python."""

import hashlib
import math

import numpy as np
import pytest

from loamtree.llm import centroids, registry, vector_dedup, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, rows, parts=3):
    clash = "component int, n string, point string, cluster string, copies string, rep string, size int"
    return spark.createDataFrame([(i, v, 0, *[None] * 7) for i, v in rows], f"{SCHEMA}, {clash}").repartition(parts)


def good(v, length=None) -> bool:
    return v is not None and (length is None or len(v) == length) and all(x is not None and math.isfinite(x) for x in v)


def as_float(v):
    return [float(np.float32(x)) for x in v]


ODD = [(9001, None), (9002, [None] * 64), (9003, [math.nan] + [0.5] * 63), (9004, [math.inf] + [0.5] * 63), (9005, [])]


# whitening


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_whitening_of_the_table(spark, sf_dir, size):
    data = sf_dir.replace("sf0.001", size)
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    check_whitening(rows, registry.QUERIES["op11_whitening"](spark, data).collect())


def check_whitening(rows, got):
    kept = [(i, v) for i, v in rows if good(v) and v]
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in kept], dtype=object)
    n, s = len(x), x.sum(axis=0)
    centred = np.array((x * n - s) / n, float)
    values, columns = np.linalg.eigh(centred.T @ centred / n)
    values, columns = values[::-1], columns[:, ::-1]
    k = min(32, x.shape[1])
    assert len(got) == k * n
    of = {}
    for r in got:
        of.setdefault(r.vec_id, {})[r.component] = r
    projected = centred @ columns[:, :k] / np.sqrt(values[:k])
    signs = np.sign(sum(projected[a] * np.array([of[i][c + 1].whitened for c in range(k)]) for a, (i, _) in enumerate(kept)))
    for a, (i, _) in enumerate(kept):
        own = of[i]
        assert sorted(own) == list(range(1, k + 1))
        assert {r.deviation for r in own.values()} == {int(((n * x[a] - s) ** 2).sum())} and {r.n for r in own.values()} == {n}
        np.testing.assert_allclose([own[c + 1].whitened * signs[c] for c in range(k)], projected[a], atol=1e-8)
        np.testing.assert_allclose([own[c + 1].explained for c in range(k)], values[:k] / values.sum(), rtol=1e-9)
    errors = {r.identity_error for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-9


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, as_float(rng.normal(0, 1, 40) @ np.diag(np.arange(1, 41) / 10))) for i in range(300)]
    rows += [(300, rows[0][1]), (300, rows[0][1])]  # copies, and a repeated row
    out = whitening.whiten(frame(spark, rows + ODD), whitening.fit_whitening(frame(spark, rows + ODD))).collect()
    assert len(out) == 32 * 302 and {r.vec_id for r in out} == set(range(301))
    assert {r.n for r in out} == {302}
    both = [sorted(r.whitened for r in out if r.vec_id == 300 and r.component == c) for c in (1, 2)]
    assert all(a == b for a, b in both)
    # a null id, several lengths, no variance, entries beyond what fits
    mixed = frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [3.0]), (4, [5.0]), (5, [1e30, 0.0, 0.0]), (6, [-1e30, 0.0, 0.0])])
    out = {(r.vec_id, r.component): r for r in whitening.whiten(mixed, whitening.fit_whitening(mixed)).collect()}
    assert [out[1, c].whitened for c in (1, 2)] == [0, 0] and out[1, 1].deviation == 0 and out[1, 1].identity_error == 0
    assert sorted((out[None, 1].whitened, out[4, 1].whitened)) == [-1, 1] and out[4, 1].deviation == 128**2
    assert out[5, 1].deviation is None and abs(out[5, 1].whitened) == 1 and out[5, 2].whitened == 0
    assert whitening.whiten(mixed.limit(0), whitening.fit_whitening(mixed.limit(0))).count() == 0
    assert whitening.fit_whitening(frame(spark, ODD)) == {}


def test_chan_merging_equals_one_pass():
    rows = np.random.default_rng(2).integers(-60, 60, (500, 7))
    whole, parts = whitening.Moments.of(rows), whitening.Moments.of(rows[:1])
    for lo, hi in ((1, 3), (3, 250), (250, 500)):
        parts = parts.merge(whitening.Moments.of(rows[lo:hi]))
    assert parts.n == whole.n and parts.sums == whole.sums
    np.testing.assert_allclose(parts.scatter, whole.scatter, rtol=1e-12)


# centroid clustering


def brute_clusters(rows, clusters=16, rounds=3):
    kept = [(i, tuple(math.floor(64 * c) for c in v)) for i, v in rows if good(v, 64)]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)
    at = [q for _, q in order[:clusters]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), k) for k, c in enumerate(at))
    for _ in range(rounds):
        own = {}
        for _, q in kept:
            own.setdefault(near(q)[1], []).append(q)
        at = [tuple(sum(x) // len(own[k]) for x in zip(*own[k])) if k in own else c for k, c in enumerate(at)]
    found = [(i, *near(q)) for i, q in kept]
    inertia = {k: sum(d for _, d, c in found if c == k) for k in range(len(at))}
    key = lambda r: (r[0] is None, r)
    return sorted([(i if i is not None else -1, k, d, inertia[k], sum(inertia.values()), hashlib.sha256(",".join(map(str, at[k])).encode()).hexdigest()) for i, d, k in found], key=key)


def clustered(df):
    return sorted((r.vec_id if r.vec_id is not None else -1, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def test_clusters_of_the_table(spark, sf_dir):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert clustered(registry.QUERIES["op12_centroids"](spark, sf_dir)) == brute_clusters(rows)


def test_clusters_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, as_float(rng.normal(0, 0.02, 64) + rng.integers(0, 3, 64) / 4)) for i in range(80)]
    rows += [(i, rows[3][1]) for i in range(100, 160)] + [(None, rows[5][1]), (7, rows[7][1]), (170, [0.25] * 63), (171, [-0.001] * 64), (172, as_float([3e4] + [0.0] * 63))]
    assert clustered(centroids.cluster_vectors(frame(spark, rows + ODD))) == brute_clusters(rows)
    few = rows[:5] + [(9, rows[0][1])]
    assert clustered(centroids.cluster_vectors(frame(spark, few))) == brute_clusters(few)  # ties, fewer points than clusters
    assert clustered(centroids.cluster_vectors(frame(spark, ODD))) == [] == clustered(centroids.cluster_vectors(frame(spark, few).limit(0)))


# near-duplicates


def brute_near(rows, threshold=0.9):
    usable = [k for k, (i, v) in enumerate(rows) if i is not None and good(v) and any(v)]
    x = {k: np.array(rows[k][1], float) for k in usable}
    norm = {k: math.sqrt(float(v @ v)) for k, v in x.items()}
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, i in enumerate(usable):
        for j in usable[a + 1 :]:
            if len(x[i]) == len(x[j]) and float(x[i] @ x[j]) / (norm[i] * norm[j]) >= threshold:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    smallest = {}
    for k in usable:
        smallest[root(k)] = min(smallest.get(root(k), rows[k][0]), rows[k][0])
    out = []
    for k, (i, _) in enumerate(rows):
        label = smallest.get(root(k), i)
        out.append((i if i is not None else -1, links[k], label if label is not None else -1, i == label))
    return sorted(out)


def near(df):
    return sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id if r.component_id is not None else -1, r.kept) for r in df.collect())


def test_near_vectors_of_the_table(spark, sf_dir):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert near(registry.QUERIES["op13_vector_dedup"](spark, sf_dir)) == brute_near(rows)


def around(rng, centre, cosine, n):
    """n vectors whose cosine with centre is about `cosine`."""
    noise = rng.normal(0, 1, (n, len(centre)))
    noise -= np.outer(noise @ centre, centre)
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    return cosine * centre + math.sqrt(1 - cosine * cosine) * noise


def unit(rng, width):
    v = rng.normal(0, 1, width)
    return v / np.linalg.norm(v)


def planted(seed=4):
    """Tight and loose groups, pairs at the threshold, copies of two scales, and satellites of a dense group."""
    rng = np.random.default_rng(seed)
    vectors = [unit(rng, 32) for _ in range(300)]
    dense = unit(rng, 32)
    vectors += [*around(rng, dense, 0.995, 500), *around(rng, dense, 0.93, 60), *around(rng, unit(rng, 32), 0.955, 150)]
    for _ in range(60):
        c = unit(rng, 32)
        vectors += [c, *around(rng, c, 0.91, 1)]
    vectors += [vectors[0] * 4] * 40 + [vectors[320]] * 30
    order = rng.permutation(len(vectors))
    return [(int(k), as_float(vectors[i])) for k, i in enumerate(order)]


def test_near_vectors_planted(spark, monkeypatch):
    """Loose groups meet block by block, the dense one is a ball; every link counts."""
    rows = planted()
    want = brute_near(rows)
    assert near(vector_dedup.near_duplicate_vectors(frame(spark, rows))) == want
    monkeypatch.setattr(vector_dedup, "BLOCK_BYTES", 32 * 4 * 16)  # many blocks, several buckets
    monkeypatch.setattr(vector_dedup, "BALL_FROM", 64)
    assert near(vector_dedup.near_duplicate_vectors(frame(spark, rows))) == want


def test_near_vectors_recall(spark):
    """Windows far smaller than the table find at least 0.9 of the pairs at the threshold."""
    rng = np.random.default_rng(5)
    vectors = [unit(rng, 48) for _ in range(4000)]
    for _ in range(400):
        c = unit(rng, 48)
        vectors += [c, *around(rng, c, 0.901, 1)]
    rows = [(i, as_float(v)) for i, v in enumerate(vectors)]
    found = near(vector_dedup.near_duplicate_vectors(frame(spark, rows), window=32))
    assert sum(r[1] for r in found) >= 0.9 * 800 and sum(r[1] for r in found[:4000]) == 0


def test_near_vectors_of_odd_rows(spark):
    rows = [(1, [1.0, 0.0, 0.0, 0.0]), (2, [9.0, 3.0, 3.0, 1.0]), (3, [0.0, 0.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0]), (5, [1.0, 0.0]), (6, [2.0, 0.0]), (7, [-1.0, 0.0]), (8, [3e38] * 4), (9, [1e-40] * 4), (9, [1e-40] * 4), (2, [1.0, -1.0, 0.0, 0.0])]
    assert near(vector_dedup.near_duplicate_vectors(frame(spark, rows + ODD))) == brute_near(rows + ODD)
    assert vector_dedup.near_duplicate_vectors(frame(spark, rows).limit(0)).count() == 0
    assert near(vector_dedup.near_duplicate_vectors(frame(spark, ODD))) == brute_near(ODD)
