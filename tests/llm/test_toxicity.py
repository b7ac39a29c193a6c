"""Ordinal regression: held-out accuracy, its parts, and plain versions of them."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from factweave.llm import toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    train, test = labels.where("hash(doc_id) % 2 = 0"), labels.where("hash(doc_id) % 2 <> 0")
    model = toxicity.fit(docs, train)
    rows = toxicity.score(docs, model).join(test.groupBy("doc_id").max("toxic").withColumnRenamed("max(toxic)", "toxic"), "doc_id").collect()
    return model, rows


def test_held_out_accuracy(held_out):
    _, rows = held_out
    toxic = [r for r in rows if r.toxic]
    clean = [r for r in rows if not r.toxic]
    assert len(toxic) > 100 and len(clean) > 1000
    assert np.mean([r.rejected for r in toxic]) >= 0.9
    assert np.mean([r.rejected for r in clean]) <= 0.01
    assert np.mean([r.expected_severity for r in toxic]) > 5 * np.mean([r.expected_severity for r in clean])


def test_thresholds_are_ordered_and_share_weights(held_out):
    model, rows = held_out
    assert model.thresholds == sorted(model.thresholds) and len(model.thresholds) == toxicity.GRADES
    above = model.at_least(np.linspace(-5, 20, 50))
    assert (np.diff(above, axis=1) <= 0).all() and (np.diff(above, axis=0) >= 0).all()
    assert all(0 <= r.expected_severity <= toxicity.GRADES for r in rows)


def test_grades_are_learnt():
    texts = [f"filler{i % 7} words" for i in range(60)] + ["badword here"] * 30 + ["badword awful here"] * 30 + ["badword awful vile here"] * 30
    grades = np.array([0] * 60 + [1] * 30 + [2] * 30 + [3] * 30)
    chosen = {"badword": 5.0, "awful": 5.0, "vile": 5.0}
    model = toxicity.fit_grades([sorted(set(t.split()) & set(chosen)) for t in texts], grades, chosen)
    score = model.scorer()
    expected = model.at_least(np.array([score(t) for t in ("filler1", "badword", "badword awful", "badword awful vile")])).sum(axis=1)
    assert (np.diff(expected) > 0.4).all()


def test_nulls_empty_and_extra_columns(spark):
    model = toxicity.Model({"idiot": 9.0}, [3.0, 5.0, 7.0])
    df = spark.createDataFrame([(1, None, 1), (None, "", 2), (2, "You IDIOT " * 5000, 3), (2, "You IDIOT " * 5000, 3)], "doc_id long, text string, s int")
    got = toxicity.score(df, model).collect()
    assert sorted((str(r.doc_id), r.rejected) for r in got) == [("1", False), ("2", True), ("2", True), ("None", False)]
    assert sorted(str(r.doc_id) for r in toxicity.keep_clean(df, model).collect()) == ["1", "None"]
    assert toxicity.keep_clean(df, model).columns == df.columns
    assert toxicity.score(df.limit(0), model).count() == 0


def test_without_toxic_labels_nothing_is_rejected(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 0), (None, 0, 1), (2, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    assert not any(r.rejected for r in toxicity.score(docs, model).collect())
    assert toxicity.fit(docs.limit(0), labels.limit(0)).weights == {}


def plain_features(text):
    words = set(re.findall(r"\w+", text.lower()))
    found = set(words)
    for n in (4, 5, 6, 7):
        alike = Counter(w[:n] for w in words if len(w) >= n)
        found |= {f"{stem}*{k}" for stem, m in alike.items() for k in (1, 2, 3) if m >= k}
    return found


def test_scores_are_those_of_the_plain_formula(spark, held_out, sf_dir):
    model, _ = held_out
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for d in docs.collect():
        own = plain_features(d.text or "")
        x = sum(w for f, w in model.weights.items() if f in own)
        above = [1 / (1 + math.exp(t - x)) for t in model.thresholds]
        r = got[d.doc_id]
        assert abs(r.expected_severity - sum(above)) < 1e-9 and abs(r.p_toxic - above[0]) < 1e-9 and r.rejected == (above[0] >= 0.5)


def plain_loss(found, grades, chosen, weights, thresholds, decay=3e-3):
    """The penalised negative log-likelihood, document by document."""
    sick = max(1, sum(g > 0 for g in grades))
    n, loss = len(grades), 0.0
    for own, g in zip(found, grades):
        x = sum(weights[f] for f in own)
        above = [1.0, *(1 / (1 + math.exp(t - x)) for t in thresholds), 0.0]
        loss -= math.log(max(above[g] - above[g + 1], 1e-9)) * (n / 2 / sick if g else n / 2 / max(1, n - sick)) / n
    return loss + decay / 2 * sum((weights[f] / (chosen[f] / 4) ** 2) ** 2 for f in weights)


def test_the_fit_is_the_most_likely_one():
    rng = random.Random(2)
    chosen = {f"f{i}": 4.5 for i in range(4)}
    found, grades = [], []
    for _ in range(400):
        own = [f for f in chosen if rng.random() < 0.4]
        found.append(own)
        grades.append(min(3, max(0, len(own) - 1 + (rng.random() < 0.2))))
    model = toxicity.fit_grades(found, np.array(grades), chosen)
    best = plain_loss(found, grades, chosen, model.weights, model.thresholds)
    for f in chosen:
        for step in (-0.2, 0.2):
            assert plain_loss(found, grades, chosen, model.weights | {f: model.weights[f] + step}, model.thresholds) > best - 1e-3
    for k in range(3):
        for step in (-0.2, 0.2):
            moved = [t + step * (i == k) for i, t in enumerate(model.thresholds)]
            assert plain_loss(found, grades, chosen, model.weights, moved) > best - 1e-3


@pytest.mark.parametrize("toxic, clean", [(3600, 3600), (3100, 5000), (4500, 3200), (300, 3500), (400, 390)])
def test_any_mix_and_number_of_labels(spark, toxic, clean):
    rng = random.Random(toxic + clean)
    plain = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(4000)]
    rude = [f"rude{c}" for c in "klmnopq"]
    rows = []
    for i in range(toxic + clean):
        words = rng.choices(plain, k=60)
        if i < toxic:
            words[::15] = rng.choices(rude, k=4)
        rows.append((i, " ".join(words), int(i < toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert {f"rude{c}" for c in "klmnopq"} <= set(model.weights)
    got = toxicity.score(df.select("doc_id", "text"), model).join(df.select("doc_id", "toxic"), "doc_id").collect()
    assert np.mean([r.rejected for r in got if r.toxic]) >= 0.99
    assert np.mean([r.rejected for r in got if not r.toxic]) <= 0.01


def test_repeated_labelled_ids_count_once(spark):
    docs = spark.createDataFrame([(i % 20, f"word{i % 20} {'nasty' if i % 2 else 'kind'} thing{i % 20}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] * 3, "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert sum(r.rejected for r in toxicity.score(docs.dropDuplicates(["doc_id"]), model).collect()) in (0, 10)
