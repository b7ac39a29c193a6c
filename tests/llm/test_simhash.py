"""Near-duplicates against all pairs."""

from collections import defaultdict

import numpy as np
import pytest
import xxhash

from factweave.llm import simhash
from factweave.llm.components import components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(rows, budget=2):
    """doc id -> least id reachable."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    a = np.array(fps, dtype=np.uint64)
    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= budget):
            root[find(fps[i + 1 + j])] = find(f)
    least = defaultdict(lambda: None)
    for d, f in rows:
        r = find(f)
        if d is not None:
            least[r] = d if least[r] is None else min(d, least[r])
    return {d: least[find(f)] for d, f in rows}


def test_documents_against_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want_fp = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    want = plain_classes(list(want_fp.items()))
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(want_fp)
    for r in got:
        assert int(r.fingerprint, 16) == want_fp[r.doc_id] and len(r.fingerprint) == 16
        assert r.component_id == want[r.doc_id]


def plain_kept(rows):
    """Ids that stay, of (id, text): the least of each class of texts whose five-word shingles agree by 0.8, over all pairs."""
    sets = {}
    for d, t in rows:
        words = (t or "").encode().lower().split()
        sets[d] = frozenset(b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()
    ids = sorted(sets)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and (x == y or len(x & y) >= 0.8 * len(x | y)):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted({find(d) for d in ids})


def test_one_of_each_class_stays(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == plain_kept([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("chunk", [10**9, 60])
def test_near_copies_go_and_others_stay(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "SUBTREE", 8 if chunk == 60 else 4096)
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(5000)] + ["the", "of", "and", "a"] * 300
    originals = [[str(w) for w in rng.choice(vocabulary, int(rng.integers(80, 600)))] for _ in range(120)]
    rows, near = [(i, " ".join(w)) for i, w in enumerate(originals)], 0
    for i, words in enumerate(originals):
        for k in range(3):
            copy = list(words)
            for at in rng.choice(len(copy), max(1, len(copy) // 100), replace=False):
                copy[at] = f"edit{i}{k}{at}"
            a, b = ({" ".join(x[n : n + 5]) for n in range(len(x) - 4)} for x in (words, copy))
            near += len(a & b) / len(a | b) >= 0.8
            rows.append((1000 + 3 * i + k, " ".join(copy)))
    # texts that share half of their words are no copies
    for i, words in enumerate(originals[:60]):
        rows.append((5000 + i, " ".join([*words[: len(words) // 2], *(str(w) for w in rng.choice(vocabulary, len(words) // 2))])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.deduplicate(df).collect()}
    assert set(range(120)) <= kept and set(range(5000, 5060)) <= kept
    assert near > 300 and len([d for d in kept if 1000 <= d < 5000]) <= 0.1 * 360


@pytest.mark.parametrize("seed", range(4))
def test_trie_finds_all_pairs(seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**64, 20, dtype=np.uint64)
    near = np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) for c in centres])
    a = np.unique(np.concatenate([near, rng.integers(0, 2**64, 500, dtype=np.uint64)]))
    b = np.unique(rng.permutation(a)[:300] ^ np.uint64(1))
    same = {(i, j) for x, y in simhash.trie_pairs(a, a, 2, True) for i, j in zip(x, y)}
    dist = np.bitwise_count(a[:, None] ^ a[None, :])
    assert same == {(i, j) for i, j in zip(*np.nonzero(dist <= 2)) if i < j}
    cross = {(i, j) for x, y in simhash.trie_pairs(a, b, 2, False) for i, j in zip(x, y)}
    assert cross == set(zip(*np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= 2)))


@pytest.mark.parametrize("frontier", [1 << 19, 50])
def test_trie_takes_equal_keys(monkeypatch, frontier):
    monkeypatch.setattr(simhash, "FRONTIER", frontier)
    rng = np.random.default_rng(9)
    a = np.sort(np.concatenate([np.repeat(rng.integers(0, 2**64, 6, dtype=np.uint64), 25), np.array([5, 4, 7], dtype=np.uint64)]))
    same = [(i, j) for x, y in simhash.trie_pairs(a, a, 1, True) for i, j in zip(x, y)]
    dist = np.bitwise_count(a[:, None] ^ a[None, :])
    want = {(i, j) for i, j in zip(*np.nonzero(dist <= 1)) if i < j}
    assert len(same) == len(want) and set(same) == want
    cross = [(i, j) for x, y in simhash.trie_pairs(a, a[::3].copy(), 1, False) for i, j in zip(x, y)]
    wide = set(zip(*np.nonzero(np.bitwise_count(a[:, None] ^ a[::3][None, :]) <= 1)))
    assert len(cross) == len(wide) and set(cross) == wide


@pytest.mark.parametrize("chunk", [10**9, 7])
def test_links_over_many_subtrees(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "SUBTREE", 16)
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**64, 150, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64)), base ^ np.uint64(3 << 62)]))
    rows = [(int(i), int(f)) for i, f in enumerate(fps)]
    df = spark.createDataFrame([(i, f - 2**64 if f >= 2**63 else f) for i, f in rows], "doc_id long, fp long")
    got = simhash.classes(df).collect()
    want = plain_classes(rows)
    by_fp = {f: i for i, f in rows}
    assert {by_fp[r.fp % 2**64]: r.component_id for r in got} == want


@pytest.mark.parametrize("chunk", [10**9, 300])
def test_a_dense_ball_costs_no_more_links_than_members(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    centre = 0x0123456789ABCDEF
    ball = sorted({centre ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(64)})
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in ball], "fp long")
    links = simhash.links(df)
    assert links.count() <= 40 * len(ball)
    roots = components(links).select("root").distinct().count()
    assert roots == 1


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201), (5, 5), (None, 3)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(101)} | {200: 200, 201: 200}


def test_nulls_repeats_and_extra_columns(spark):
    rows = [(3, None, 1), (2, "", 1), (None, "one two three four", 1), (5, "One TWO three four", 1), (5, "One TWO three four", 1), (None, "alone", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == [("2", 2), ("3", 2), ("5", 5), ("5", 5), ("None", 5), ("None", None)]
    kept = simhash.deduplicate(df).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["2", "5", "None"] and kept[0].fp == 1
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.deduplicate(df.limit(0)).count() == 0


def edited(words, kind, share, rng):
    """A copy of which this share of words is appended, cut off the end, cut off the start, or replaced here and there."""
    n, fresh = max(1, int(len(words) * share)), lambda k: [f"e{x}" for x in rng.integers(0, 10**9, k)]
    if kind == "replaced":
        copy = list(words)
        for at, word in zip(rng.choice(len(copy), n, replace=False), fresh(n), strict=True):
            copy[at] = word
        return copy
    return {"appended": words + fresh(n), "cut off": words[:-n], "begun later": words[n:]}[kind]


@pytest.mark.parametrize("kind", ["appended", "cut off", "begun later", "replaced"])
def test_candidates_of_every_kind_of_edit(kind):
    rng = np.random.default_rng(11)
    shares = (0.01, 0.02, 0.03) if kind == "replaced" else (0.12, 0.15, 0.18)
    near = found = 0
    for _ in range(400):
        words = [f"w{x}" for x in rng.zipf(1.3, int(rng.integers(60, 500))) % 5000]
        copy = edited(words, kind, rng.choice(shares), rng)
        a, b = ({" ".join(x[n : n + 5]) for n in range(len(x) - 4)} for x in (words, copy))
        if 0.8 <= len(a & b) / len(a | b) < 0.9:
            near += 1
            keys = [np.array(simhash.signature(" ".join(x))[0], dtype=np.int64).view(np.uint64) for x in (words, copy)]
            found += bool((np.bitwise_count(keys[0] ^ keys[1]) <= simhash.KEY_BUDGET).any())
    assert near > 100 and found >= 0.99 * near


def exactly_kept(rows):
    """Ids that stay, of (id, text): the least of each class, over all pairs by exact similarity."""
    sets = {}
    for d, t in sorted(rows):
        words = (t or "").encode().lower().split()
        sets[d] = {b" ".join(words[n : n + 5]) for n in range(max(1, len(words) - 4))}
    ids = list(sets)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, x in enumerate(ids):
        for y in ids[n + 1 :]:
            a, b = sets[x], sets[y]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) / len(a | b) >= 0.8:
                p, q = find(x), find(y)
                root[max(p, q)] = min(p, q)
    return sorted({find(d) for d in ids})


@pytest.mark.parametrize("meet", [512, 7])
def test_exact_similarity_decides(spark, sf_dir, monkeypatch, meet):
    monkeypatch.setattr(simhash, "MEET", meet)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rng = np.random.default_rng(13)
    words = [f"v{x}" for x in range(300)]
    # versions of one text that are some 0.7 alike are no copies, however many there are
    rows += [(100000 + k, " ".join(edited(words, "replaced", 0.018, rng))) for k in range(200)]
    # of one text, copies of every degree, some alike enough and some not
    words = [f"u{x}" for x in range(250)]
    rows += [(200000 + k, " ".join(edited(words, kind, k / 200, rng))) for k in range(1, 60) for kind in ("appended", "cut off")[k % 2 :][:1]]
    want = exactly_kept(rows)
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == want
    assert sum(100000 <= d < 200000 for d in want) > 100 and sum(d >= 200000 for d in want) < 30


def test_pairs_that_share_no_key_or_whose_marks_are_far(spark):
    rows = []
    for p in range(4000):
        words = [f"p{p}w{x}" for x in range(104)]
        pair = [" ".join(words), " ".join(words + [f"p{p}e{x}" for x in range(25)])]
        (keys, marks, *_), (others, far, *_) = map(simhash.signature, pair)
        apart = sum(((x ^ y) % 2**64).bit_count() for x, y in zip(marks, far, strict=True))
        if not any(x == y for x, y in zip(keys, others, strict=True)) or apart > simhash.bits_for(0.8):
            rows += [(2 * p, pair[0]), (2 * p + 1, pair[1])]
    assert len(rows) >= 20
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == exactly_kept(rows) == [d for d, _ in rows[::2]]


@pytest.mark.parametrize(("bucket", "sample"), [(4096, 4096), (5, 20)])
def test_the_rest_is_found_without_any_trie(spark, monkeypatch, bucket, sample):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash, "SAMPLE", sample)
    monkeypatch.setattr(simhash, "links", lambda *_: spark.createDataFrame([], "u long, v long"))
    rng = np.random.default_rng(19)
    line = [f"line{x}" for x in range(12)]
    rows = [(0, ""), (1, None), (2, "one"), (3, "One"), (4, "two words"), (5, " ".join(line))]
    # sketches of these lengths are folded, or not, and all texts have one line in common
    for n in (5, 9, 30, 230, 240, 255, 300, 500, 520, 1030):
        for k in range(4):
            words = line + [f"t{n}_{k}w{x}" for x in range(n)]
            rows.append((1000 * n + 100 * k, " ".join(words)))
            edits = [(kind, share) for kind in ("appended", "cut off", "begun later") for share in (0.1, 0.18, 0.2, 0.24, 0.3)] + [("replaced", 0.02), ("replaced", 0.03)]
            rows += [(1000 * n + 100 * k + 1 + e, " ".join(edited(words, kind, share, rng))) for e, (kind, share) in enumerate(edits)]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    want = exactly_kept(rows)
    assert sorted(r.doc_id for r in kept.collect()) == want and 46 < len(want) < len(rows) / 2


def test_parity_sketches_differ_in_no_more_bits_than_sets():
    rng = np.random.default_rng(23)
    for n in (1, 255, 256, 257, 400, 513, 2000):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[n // 10 :], rng.integers(0, 2**64, n // 8, dtype=np.uint64)]))
        none = (np.empty(0, np.uint64), np.empty(0, np.int64))
        (size, prefix, p), (_, others, q) = (simhash.outline(x, 0.8, none) for x in (a, b))
        length = min(len(p), len(q))
        p, q = (np.bitwise_xor.reduce(x.view(np.uint64).reshape(-1, length), axis=0) for x in (p, q))
        assert size == len(a) and np.bitwise_count(p ^ q).sum() <= len(np.setxor1d(a, b))
        assert len(prefix) == len(a) - -(-8 * len(a) // 10) + 1
        assert np.isin(prefix, others).any() or len(np.intersect1d(a, b)) < 0.8 * max(len(a), len(b))


def test_groups_that_share_a_shingle_cost_no_rows_for_each_of_their_pairs(spark, monkeypatch):
    counts = {}

    def counted(df, name):
        out = materialise(df, name)
        counts[name] = counts.get(name, 0) + out.count()
        return out

    materialise = simhash.materialise
    monkeypatch.setattr(simhash, "materialise", counted)
    monkeypatch.setattr(simhash, "SAMPLE", 1)
    rng = np.random.default_rng(29)
    passage = [f"passage{x}" for x in range(60)]
    # long texts that have a passage in common and nothing else
    rows = [(k, " ".join(passage + [f"t{k}w{x}" for x in range(900)])) for k in range(80)]
    # versions of one text that are almost alike enough
    words = [f"v{x}" for x in range(250)]
    rows += [(1000 + k, " ".join(edited(words, "replaced", 0.016, rng))) for k in range(120)]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == exactly_kept(rows)
    assert counts["missed"] <= len(rows) and counts.get("pairs", 0) <= len(rows)
