"""The pipeline: each stage on what its predecessor kept, against plain versions."""

import hashlib
import math
import re
from collections import Counter

import corpus_pipeline
import pytest
from test_chat_mixing import plain_times
from test_simhash import plain_kept
from test_toxicity import plain_features

from factweave.llm import toxicity
from factweave.llm.tokenizers_io import TokenizerFile, encoder


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1], sf_dir).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "pii", "mixing", "bpe"]
    assert all(df.columns == stages[0].columns for df in stages[:-1])


def test_toxic_documents_go_and_others_stay(spark, sf_dir, stages):
    """The model's weights, applied by the plain formula (held-out accuracy has a test of its own)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(stages[0], labels)
    score = lambda text: sum(w for f, w in model.weights.items() if f in plain_features(text or ""))
    want = [r.doc_id for r in stages[0].collect() if 1 / (1 + math.exp(model.thresholds[0] - score(r.text))) < 0.5]
    kept = {r.doc_id for r in stages[1].collect()}
    assert sorted(kept) == sorted(want)


def test_one_of_each_class_stays(stages):
    assert sorted(r.doc_id for r in stages[2].collect()) == plain_kept([(r.doc_id, r.text) for r in stages[1].collect()])


def test_personal_data_is_replaced(stages):
    before = {r.doc_id: r.text for r in stages[2].collect()}
    rows = stages[3].collect()
    assert len(rows) == len(before)
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    changed = 0
    for r in rows:
        assert not mail.search(r.text) and r.n_chars == len(r.text)
        changed += r.text != before[r.doc_id]
        if "[" not in r.text:
            assert r.text == before[r.doc_id]
    assert changed


def test_sources_are_mixed(stages):
    rows = stages[3].collect()
    sizes = Counter(r.source for r in rows)
    want = Counter()
    for r in rows:
        want[r.doc_id] += plain_times(1.0 / len(sizes) * float(len(rows)) / sizes[r.source], 7, r.doc_id, r.text)
    assert Counter(r.doc_id for r in stages[4].collect()) == +want


def test_tokens(stages):
    enc = encoder(TokenizerFile.read())
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    rows = stages[5].collect()
    assert len(rows) == stages[4].count()
    for r in rows:
        ids = enc.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_gives_the_last_stages_rows(spark, sf_dir, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, stages[5].collect()))
