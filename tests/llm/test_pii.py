"""Personal data against plain regular expressions."""

import hashlib
import itertools
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from factweave.llm import pii
from factweave.llm.common import running

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def expected(text):
    text = text or ""
    good = {
        "email": lambda m: True,
        "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda m: 16 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d),
        "phone": lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15,
    }
    found = {k: [(m.start(), m.end()) for m in re.finditer(p, text) if good[k](m[0])] for k, p in PLAIN.items()}
    joined = ",".join(f"{k}:{a}:{b}" for k, spans in found.items() for a, b in spans)
    return [len(v) for v in found.values()], hashlib.sha256(joined.encode()).hexdigest(), joined


def check(rows, texts):
    assert len(rows) == len(texts)
    by_id = {r.doc_id: r for r in rows}
    for i, text in texts.items():
        counts, digest, joined = expected(text)
        r = by_id[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts, (text, r.spans, joined)
        assert r.base_sha256 == digest, (text, r.spans, joined)
        assert r.spans.startswith(joined)


def test_random_strings_give_the_plain_matches(spark):
    rng = random.Random(3)
    parts = ["a", "b.c", "@", "x@y.z", ".", "_", "1", "25", "255", "256", "1.2.3.4", "4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004", "+1", "+49 ", " ", "  ", "-", "(", ")", "é", "😀", "\n", "+1 (555) 010-9999", "co", "%"]
    texts = {i: "".join(rng.choices(parts, k=rng.randint(0, 14))) for i in range(1500)}
    texts |= {5000: None, 5001: "", 5002: "4111 1111 1111 1111" * 2000, 5003: "7" * 6000, 5004: "a@b.co_x@y.z a@b@c.d", 5005: "x" * 6000 + "@y.z"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(pii.report(df).collect(), texts)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(pii.report(docs).collect(), {r.doc_id: r.text for r in docs.collect()})


def test_added_kinds_need_their_checks_and_context(spark):
    rows = {1: "Account IBAN DE89 3704 0044 0532 0130 00.", 2: "Account IBAN DE88 3704 0044 0532 0130 00.", 3: "my SSN is 123-45-6789", 4: "item 123-45-6789", 5: "GB82WEST12345698765432"}
    spans = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    assert "iban:13:40" in spans[1] and "iban" not in spans[2]
    assert "ssn:10:21" in spans[3] and "ssn" not in spans[4]
    assert spans[5] == "iban:0:22"


def test_redaction_cuts_spans_and_keeps_the_rest(spark):
    df = spark.createDataFrame([(1, "é a@b.co x 1.2.3.4!", 9, "k"), (2, None, None, None), (3, "plain", 5, "k")], "doc_id long, text string, n_chars long, row string")
    got = {r.doc_id: r for r in pii.redact(df).collect()}
    assert got[1].text == "é [EMAIL] x [IP]!" and got[1].n_chars == 17 and got[1].row == "k"
    assert got[2].text is None and got[3].text == "plain"
    assert pii.redact(df).columns == df.columns


@pytest.mark.parametrize("run", [pii.report, pii.redact])
def test_empty_table(spark, run):
    assert run(spark.createDataFrame([], "doc_id long, text string, row string, content string")).count() == 0


def test_context_is_looked_for_all_around_a_number(spark):
    texts = ["SSN: 123-45-6789, 234-56-7890", "123-45-6789 is my SSN", f"SSN {'x' * 60} 123-45-6789 {'x' * 60} SSN", "123-45-6789"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    assert got == {0: "ssn:5:16,ssn:18:29", 1: "ssn:0:11", 2: "", 3: ""}
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[0] == "SSN: [SSN], [SSN]"


def test_long_texts_with_many_matches(spark):
    """100,000 addresses in one text take seconds, not minutes."""
    rng = random.Random(1)
    many = "".join(f"{rng.choice(['é', 'x', '?', '😀'])} a{i}@b.co " for i in range(100_000))
    texts = {1: many, 2: "+49 170 1234567, " * 3000 + "9.9.9.9 " * 3000, 3: "4111111111111111, " * 2000 + "é" * 1_000_000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    start = time.time()
    check(pii.report(docs).collect(), texts)
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert time.time() - start < 90
    assert clean[1] == re.sub(r"a[0-9]+@b\.co", "[EMAIL]", many)
    assert clean[2] == "[PHONE], " * 3000 + "[IP] " * 3000 and clean[3] == "[CARD], " * 2000 + "é" * 1_000_000


def plain_redaction(text, spans, scores):
    out, at = "", 0
    cuts = sorted((int(a), int(b), f"[{k.upper()}]") for (k, a, b), s in zip((x.split(":") for x in spans.split(",") if x), scores.split(",")) if float(s) >= pii.THRESHOLD)
    for a, b, tag in cuts:
        if a >= at:
            out += text[at:a] + tag
        at = max(at, b)
    return out + text[at:]


def test_redaction_against_the_plain_form(spark):
    rng = random.Random(8)
    parts = ["a@b.co", "1.2.3.4", "4111 1111 1111 1111", "+1 (555) 010-9999", "x" * 3000, "é" * 2500, " version ", " server ", "SSN 123-45-6789 ", "order ", " ", "😀", "DE89 3704 0044 0532 0130 00"]
    docs = spark.createDataFrame([(i, "".join(rng.choices(parts, k=rng.randint(0, 12)))) for i in range(300)], "doc_id long, text string")
    found = {r.doc_id: r for r in pii.report(docs).collect()}
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    for d in docs.collect():
        assert clean[d.doc_id] == plain_redaction(d.text, found[d.doc_id].spans, found[d.doc_id].scores)


def test_context_moves_scores(spark):
    texts = ["version 1.2.3.4", "the server 1.2.3.4", "1.2.3.4", "write to a@b.co"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.scores for r in pii.report(docs).collect()} == {0: "0.3", 1: "0.9", 2: "0.6", 3: "1.0"}
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean == {0: "version 1.2.3.4", 1: "the server [IP]", 2: "[IP]", 3: "write to [EMAIL]"}


def test_running_values(spark):
    rng = random.Random(4)
    rows = [(n, [rng.randint(0, 9) for _ in range(n)]) for n in (1, 2, 255, 256, 257, 1000)]
    df = spark.createDataFrame(rows, "n int, x array<int>").select("n", running(F.col("x"), lambda a, x: a + x).alias("s"), running(F.col("x"), lambda a, x: F.greatest(a, x)).alias("m"))
    for n, s, m in df.collect():
        x = dict(rows)[n]
        assert s == list(itertools.accumulate(x)) and m == list(itertools.accumulate(x, max))


def test_one_long_run(spark):
    docs = spark.createDataFrame([(1, "x" * 1_000_000 + "@y.z"), (2, "7" * 1_000_000)], "doc_id long, text string")
    assert {r.doc_id: r.spans for r in pii.report(docs).collect()} == {1: "email:0:1000004", 2: ""}
