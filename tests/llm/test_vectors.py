"""Vector searches against brute force."""

import math

import numpy as np
import pyarrow as pa
import pytest

from factweave.llm import ann, topk


def usable(rows):
    return [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]


def brute(rows, score, every=50, k=5):
    out = []
    for q, a in sorted({(i, tuple(v)) for i, v in rows if i % every == 0}):
        found = sorted((-score(a, v), i) for i, v in rows if i != q and len(v) == len(a))[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(found, 1)]
    return out


def integer(a, b):
    f = lambda x: math.floor(256 * float(np.float32(x)))
    return sum(f(x) * f(y) for x, y in zip(a, b))


def cosine(a, b):
    a, b = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
    return float(a @ b / np.sqrt((a @ a) * (b @ b)))


ODD = [(None, [1.0, 0.0]), (50, None), (100, [float("nan"), 1.0]), (150, [float("inf"), 1.0]), (200, [None, 1.0]), (0, [0.0, 0.0]), (250, [1.0, 0.5]), (7, [1.0, 0.5]), (7, [1.0, 0.5]), (8, [2.0, 1.0]), (9, [-1.0, 0.25]), (300, [1.0, 2.0, 3.0]), (301, [3.0, 2.0, 1.0]), (350, [])]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in ODD], "vec_id long, embedding array<float>, vec int, block int")


def test_exact_on_embeddings(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = usable([(r.vec_id, r.embedding) for r in df.collect()])
    got = sorted(tuple(r) for r in topk.exact_top_k(df).collect())
    assert got == brute(rows, integer)


def test_exact_stops_early_and_stays_exact():
    rng = np.random.default_rng(0)
    v = np.floor(256 * rng.standard_normal((3000, 16)) / 4).astype(np.int64)
    v[1000:1100] = v[0]
    ids = rng.permutation(3000)
    lists = topk.SortedLists(v)
    q = v[:40]
    seen = 0
    for i, index, scores in lists.batch(q, ids[:40], ids, 5):
        all_ = v @ q[i]
        want = sorted((-int(s), int(j)) for s, j in zip(all_, ids) if j != ids[i])[:5]
        assert [(-int(s), int(ids[j])) for s, j in zip(scores, index)] == want
        seen += 1
    assert seen == 40


def test_exact_with_huge_components():
    v = np.array([[2**30, 1], [2**31, -5], [-(2**31), 7], [3, 2**31]], dtype=np.int64)
    got = {int(i): list(index) for i, index, _ in topk.SortedLists(v).batch(v[:2], np.array([0, 1]), np.arange(4), 2)}
    assert got == {0: [1, 3], 1: [0, 3]}


def test_approximate_on_embeddings_has_the_recall(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = usable([(r.vec_id, r.embedding) for r in df.collect()])
    got = ann.nearest(df).collect()
    want = brute(rows, cosine)
    hits = len({(r.query_id, r.vec_id) for r in got} & {(q, i) for q, _, i, _ in want})
    assert hits >= 0.9 * len(want) and len(got) == len(want)
    by = dict(rows)
    for r in got:
        assert abs(r.score - cosine(by[r.query_id], by[r.vec_id])) < 1e-12


@pytest.mark.parametrize("dim", [3, 64, 300])
def test_error_bounds_hold(dim):
    rng = np.random.default_rng(1)
    v, q = rng.standard_normal((2000, dim)), rng.standard_normal((20, dim))
    turn = ann.rotation(dim)
    assert turn.shape == (dim, ann.width(dim)) and np.allclose(turn @ turn.T, np.eye(dim))
    bits, scalar, error = ann.codes(v, turn)
    words, ones = np.ascontiguousarray(bits.T), np.bitwise_count(bits).sum(axis=1, dtype=np.int32)
    signs = np.where(np.unpackbits(bits.view(np.uint8), axis=1) > 0, 1.0, -1.0) / np.sqrt(ann.width(dim))
    within, exact = [], []
    for x in q:
        query = ann.Query(ann.turned(x[None, :], turn)[0])
        estimate = query.estimate(words, ones, scalar)
        plain = signs @ ann.turned(x[None, :], turn)[0] / scalar
        true = v @ x / (np.linalg.norm(v, axis=1) * np.linalg.norm(x))
        exact.append(np.abs(estimate - plain).max() <= 2 * query.rounding)
        within.append((np.abs(estimate - true) <= ann.BOUND * error + query.rounding).mean())
    assert all(exact) and np.mean(within) > 0.85


def test_codes_choose_few_vectors(spark):
    """Most candidates fall by their codes alone, and the recall holds."""
    rng = np.random.default_rng(3)
    v = rng.standard_normal((6000, 64)).astype(np.float32)
    turn = ann.rotation(64)
    bits, scalar, error = ann.codes(v.astype(float), turn)
    table = pa.table({"cand_id": np.arange(6000), "cand_version": np.zeros(6000, np.int64), "code": [r.tobytes() for r in bits], "scalar": scalar, "error": error})
    queries = pa.table({"vec_id": np.arange(0, 6000, 50), "version": np.zeros(120, np.int64), "vec": pa.array(v[::50].astype(float).tolist())})
    left = ann._survivors(5, ann.BOUND, ann.SEED)((pa.scalar(64), None, None), queries, table)
    assert left.num_rows < 0.05 * 120 * 6000
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = {(r.query_id, r.vec_id) for r in ann.nearest(df).collect()}
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    want = set()
    for q in range(0, 6000, 50):
        score = unit @ unit[q]
        score[q] = -2
        want |= {(q, int(j)) for j in np.argsort(-score)[:5]}
    assert len(got & want) >= 0.95 * len(want)


def test_repeated_rows(spark):
    rows = [(0, [1.0, 0.5])] * 3000 + [(1, [1.0, 0.5])] * 3000 + [(50, [0.5, 1.0]), (2, [3.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    few = rows[:6] + rows[3000:3006] + rows[-2:]
    assert sorted(tuple(r) for r in topk.exact_top_k(df).collect()) == brute(few, integer)
    assert sorted((r.query_id, r.rank, r.vec_id) for r in ann.nearest(df).collect()) == [x[:3] for x in brute(few, cosine)]


def test_odd_vectors_take_no_part(spark, odd):
    rows = usable(ODD)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.exact_top_k(odd).collect())
    assert got == brute(rows, integer)
    near = sorted((r.query_id, r.rank, r.vec_id) for r in ann.nearest(odd).collect())
    assert near == [x[:3] for x in brute([(i, v) for i, v in rows if any(v)], lambda a, b: round(cosine(a, b), 12))]
    assert topk.exact_top_k(odd.limit(0)).count() == 0 and ann.nearest(odd.limit(0)).count() == 0
