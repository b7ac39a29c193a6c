"""Chat collapse and mixing, against plain versions."""

import hashlib
import math
from collections import Counter, defaultdict

from factweave.llm import chat, mixing


def plain_chat(rows):
    convs = defaultdict(list)
    for i, (c, t, r, x) in enumerate(rows):
        convs[("row", i) if c is None else c].append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, t in turns.items():
        if any(len(o) > len(t) and o[: len(t)] == t for o in turns.values()):
            continue
        same = [k for k, o in turns.items() if o == t]
        known = [k for k in same if not isinstance(k, tuple)]
        out[min(known) if known else ("none", *t)] = (len(t), len(same), "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in t))
    return out


def check_chat(df):
    want = plain_chat([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])
    got = chat.chat_format(df).collect()
    assert len(got) == len(want)
    assert sorted((-1 if r.conv_id is None else r.conv_id, r.n_turns, r.n_copies, r.rendered) for r in got) == sorted((-1 if isinstance(c, tuple) else c, *v) for c, v in want.items())


def test_conversations(spark, sf_dir):
    check_chat(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def test_snapshots_copies_ties_and_nulls(spark):
    rows = [(1, 0, "u", "hi")]
    rows += [(2, 0, "u", "hi"), (2, 1, "a", "yo")]
    rows += [(3, 0, "u", "hi"), (3, 1, "a", "yo"), (3, 2, "u", "x" * 50_000)]
    rows += [(4, 5, "u", "hi"), (4, 6, "a", "yo"), (4, 7, "u", "x" * 50_000)]
    rows += [(5, 0, "u", "hi"), (5, 1, "a", "no")]
    rows += [(6, 0, "u", "same"), (6, 0, "u", "same"), (7, 0, "u", "same")]
    rows += [(8, None, None, None), (8, 1, "u", ""), (None, 0, "u", "lost"), (None, 3, "u", "lost"), (None, 0, "u", "hi"), (None, None, "u", "same"), (11, 0, "u", "alone"), (None, 1, "u", "alone"), (9, 0, "uh", "i"), (10, 0, "u", "same\0")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, pos int, n_turns int")
    check_chat(df)
    assert chat.chat_format(df.limit(0)).count() == 0


def plain_times(mean, seed, doc_id, text):
    key = f"{'' if doc_id is None else doc_id}:{hashlib.md5((text or '').encode()).hexdigest()}"
    parts = max(1, math.ceil(mean / mixing.PART))
    total = 0
    for i in range(parts):
        u = int(hashlib.md5(f"{seed}:{i}:{key}".encode()).hexdigest()[:13], 16) / 16**13
        p = c = math.exp(-mean / parts)
        k = 0
        while c < u and k < 2000:
            k += 1
            p *= mean / parts / k
            c += p
        total += k
    return total


def check_mix(df, weights=None, rows_out=None):
    rows = df.collect()
    sizes = Counter(r.source for r in rows)
    w = {s: 1.0 if weights is None else weights.get(s, 0.0) for s in sizes}
    mean = {s: w[s] / sum(w.values()) * (rows_out or len(rows)) / n for s, n in sizes.items()}
    want = Counter()
    for r in rows:
        for k in range(plain_times(mean[r.source], 7, r.doc_id, r.text)):
            want[r.doc_id, r.text, r.source, k + 1] += 1
    got = mixing.mix(df, weights, rows_out).collect()
    assert Counter((r.doc_id, r.text, r.source, r.replica) for r in got) == want
    return got, mean


def test_equal_weights(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got, _ = check_mix(docs)
    n = docs.count()
    assert abs(len(got) - n) < 5 * math.sqrt(n)
    # a global shuffle: neighbours in the result are not neighbours in the table
    ids = [r.doc_id for r in got]
    assert sum(b - a == 1 for a, b in zip(ids, ids[1:])) < 0.1 * len(ids)


def test_given_weights_and_large_means(spark):
    rows = [(i, f"t{i}", "a" if i < 200 else "b", 1) for i in range(400)] + [(None, None, "c", 1), (None, "x", None, 1), (900, "big", "d", 1), (900, "big", "d", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, cdf int")
    got, mean = check_mix(df, {"a": 3.0, "b": 1.0, "d": 4.0}, 3000)
    count = Counter(r.source for r in got)
    assert set(count) == {"a", "b", "d"} and mean["d"] > mixing.PART
    assert abs(count["a"] - 1125) < 5 * math.sqrt(1125) and abs(count["b"] - 375) < 5 * math.sqrt(375)
    assert mixing.mix(df, replica_col=None).columns == df.columns


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(df).count() == 0 and mixing.mix(df, {}).count() == 0


def test_long_conversations(spark):
    rows = [(1, i, "u", f"t{i}") for i in range(3000)] + [(2, i, "u", f"t{i}") for i in range(2500)] + [(3, i, "u", f"t{i}") for i in range(2500)] + [(3, 2500, "a", "other")]
    got = chat.chat_format(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.conv_id, r.n_turns, r.n_copies) for r in got) == [(1, 3000, 1), (3, 2501, 1)]


def test_many_rows_without_a_conversation(spark):
    df = spark.range(200_000).selectExpr("cast(null as long) as conv_id", "id as turn", "'u' as role", "if(id % 3 = 0, concat('t', id), 'same') as text")
    got = chat.chat_format(df).groupBy("n_copies").count().collect()
    assert {r.n_copies: r["count"] for r in got} == {1: 66667, 133333: 1}
