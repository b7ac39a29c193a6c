"""Counts, ids and decoded texts against the library that the file belongs to."""

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from factweave.llm import bpe, token_counts
from factweave.llm.tokenizers_io import TokenizerFile, default_path, encoder

PARTS = ["<|endoftext|>", " ", "  ", "a", "'s", "'S", "é", "1", "\n", "\t", "<|", "|>", ".", " ", "　", "Ⅷ", "́", "\U0001f600", "\r\n", "\x85", "​", "\x00", "᠎", "﻿", "word", " then"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_path())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = {i: "".join(rng.choices(PARTS, k=rng.randint(0, 30))) for i in range(1500)}
    return out | {9001: None, 9002: "", 9003: "a" * 50_000, 9004: " " * 20_000 + "x", 9005: "word then " * 20_000, 9006: "a  <|endoftext|>  b"}


@pytest.fixture(scope="module")
def rows(spark, texts):
    more = [(None, "a b"), (9006, texts[9006]), (9006, texts[9006])]
    return spark.createDataFrame([(i, t, 1, "x") for i, t in [*texts.items(), *more]], "doc_id long, text string, n_tokens int, content string")


def test_the_fast_encoder_gives_the_librarys_ids(library):
    enc = encoder(TokenizerFile.read())
    assert enc.byte_level
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    groups = ["".join(f"a{c}1 {c}{c}b.{c}!  {c}\n" for c in points[k : k + 512]) for k in range(0, len(points), 512)]
    assert [enc.encode(t) for t in groups] == [e.ids for e in library.encode_batch(groups, add_special_tokens=False)]


def test_long_runs(spark, library):
    texts = [" " * 2_000_000, "x" + "\n" * 2_000_000 + "y", "a" * 2_000_000, "1" * 2_000_000, "\u3000\x85" * 100_000 + "<|endoftext|>", " \t" * 4095 + "ab" * 3000]
    ids = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    tik = encoder(TokenizerFile.read(default_path("byte_bpe_50k.tiktoken")))
    assert all(tik.encode(t) == i for t, i in zip(texts, ids) if "<" not in t)
    df, file = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), TokenizerFile.read()
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(df, file).collect()} == {k: len(i) for k, i in enumerate(ids)}
    for r in bpe.encode(df, file, ["doc_id"], digests=True).collect():
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids[r.doc_id])).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_words_encode_on_their_own(library, texts):
    enc = encoder(TokenizerFile.read())
    for t in filter(None, texts.values()):
        words = bpe.words_of(t)
        assert " ".join(words) == t
        alone = enc.encode(words[0]) + [i for w in words[1:] for i in enc.encode(" " + w)]
        assert alone == library.encode(t, add_special_tokens=False).ids


def test_encoding_and_decoding(spark, library, texts, rows):
    file = TokenizerFile.read()
    ids = {k: library.encode(t or "", add_special_tokens=False).ids for k, t in texts.items()}
    got = bpe.encode(rows, file, ["doc_id"], digests=True).collect()
    assert len(got) == len(texts) + 3
    for r in got:
        if r.doc_id is not None:
            own = ids[r.doc_id]
            assert r.n_tokens == len(own)
            assert r.ids_sha256 == hashlib.sha256(",".join(map(str, own)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(library.decode(own, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decode(bpe.encode(rows.where("doc_id < 9003"), file, ["doc_id", "content"]), file).collect()
    for r in back:
        assert r.ids == ids[r.doc_id] and r.text == (texts[r.doc_id] or "") and r.content == "x"


def test_counts_and_the_cache(spark, library, texts, rows, tmp_path):
    file, path = TokenizerFile.read(), str(tmp_path / "cache")
    for _ in range(2):
        got = token_counts.token_counts(rows, file, path).collect()
        assert len(got) == len(texts) + 3
        for r in got:
            if r.doc_id is not None:
                t = texts[r.doc_id] or ""
                n = len(library.encode(t, add_special_tokens=False).ids)
                assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 512)
        kept = spark.read.parquet(path)
        # the second call found every content in the cache and appended nothing
        assert kept.count() == kept.select("content_digest").distinct().count() == len({t or "" for t in texts.values()} | {"a b"})
    other = TokenizerFile.read(default_path("byte_bpe_multi_50k.tiktoken"))
    token_counts.token_counts(rows, other, path).count()
    assert spark.read.parquet(path).select("tokenizer_digest").distinct().count() == 2


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_files_go_to_their_library(spark, name):
    file = TokenizerFile.read(default_path(name))
    df = spark.createDataFrame([(1, "Hello world"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(df, file).collect()}
    assert got[1] == len(encoder(file).encode("Hello world")) > 0 and got[2] == 0
    with pytest.raises(ValueError, match="byte-level"):
        bpe.encode(df, file, ["doc_id"])


def test_empty_tables(spark, rows):
    none, file = rows.limit(0), TokenizerFile.read()
    assert bpe.encode(none, file, ["doc_id"], digests=True).count() == 0
    assert token_counts.token_counts(none, file).count() == 0


def test_copies_of_a_row_are_dealt_apart():
    import pyarrow as pa

    row = pa.struct([("doc_id", pa.int64())])
    batch = pa.record_batch([pa.array([{"doc_id": 1}] * 10_000, row), pa.array(["same text"] * 10_000), pa.array([77] * 10_000)], ["row", "content", "hash"])
    sizes = {}
    bpe.TaskContext, real = type("Task", (), {"get": staticmethod(lambda: type("T", (), {"partitionId": staticmethod(lambda: 3)}))}), bpe.TaskContext
    try:
        for part in bpe._pack(row, 20)(iter([batch.slice(0, 4000), batch.slice(4000)])):
            for block, chunk in zip(part.column("block").to_pylist(), part.column("chunk").to_pylist()):
                sizes[block] = sizes.get(block, 0) + pa.ipc.open_stream(chunk).read_all().num_rows
    finally:
        bpe.TaskContext = real
    assert sum(sizes.values()) == 10_000 and len(sizes) == 20 and max(sizes.values()) < 800


def test_two_writers_of_one_cache(spark, tmp_path):
    file, path = TokenizerFile.read(), str(tmp_path / "cache")
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    token_counts.token_counts(docs, file, path).count()
    spark.read.parquet(path).write.mode("append").parquet(path + "2")
    spark.read.parquet(path).write.mode("append").parquet(path + "2")
    assert token_counts.token_counts(docs, file, path + "2").count() == 2


def test_shares_of_blocks(spark, library, monkeypatch):
    """More blocks than may meet in a bucket: same ids, and each distinct word is encoded once."""
    monkeypatch.setattr(bpe, "BUCKET_BLOCKS", 3)
    docs = {i: f"the word {i % 50} is word{i % 7}\0 of <|endoftext|> {'long ' * (i % 5)}" for i in range(200)}
    df, file = spark.createDataFrame(list(docs.items()), "doc_id long, text string"), TokenizerFile.read()
    got = {r.doc_id: r.ids for r in bpe.encode(df, file, ["doc_id"]).collect()}
    assert got == {i: library.encode(t, add_special_tokens=False).ids for i, t in docs.items()}
    lists = [(b, k * 4 + b % 4, bpe._joined(sorted({f" w{k}{j}".encode() for j in range(b, b + 5)}))) for b in range(12) for k in range(2)]
    import pyarrow as pa
    import zstandard

    pack = zstandard.ZstdCompressor().compress
    by = {}
    for block, bucket, words in lists:
        by.setdefault(bucket, []).append((block, bucket, pack(words)))
    table = lambda rows, names: pa.table([pa.array(c) for c in zip(*rows)], names=names)
    own = {b: table(r, ["block", "bucket", "words"]) for b, r in by.items()}
    unions = {}
    for t in own.values():
        u = bpe._union(4)(t)
        unions.setdefault(u.column("bucket")[0].as_py(), []).append(u)
    seen = []
    monkeypatch.setattr(encoder(file), "encode", lambda w: seen.append(w) or [len(seen)])
    met = {k: bpe._answer(file)(pa.concat_tables(v)) for k, v in unions.items()}
    assert len(seen) == len(set(seen))
    for bucket, t in own.items():
        answer = met[bucket // 4]
        mine = answer.filter(pa.array([b == bucket % 4 for b in answer.column("block").to_pylist()]))
        down = bpe._hand_down((), t, mine)
        assert down.num_rows == t.num_rows
        for words, ids in zip(t.column("words").to_pylist(), down.column("ids").to_pylist()):
            plain = zstandard.ZstdDecompressor().decompress(words).decode().split("\0")
            assert [seen[int(i) - 1] for i in zstandard.ZstdDecompressor().decompress(ids).decode().split("\n")] == plain


def test_partitions_follow_the_bytes(spark):
    from factweave.llm import common

    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = spark.range(100)
    assert common.dealt(df, 0, "id").rdd.getNumPartitions() <= own
    assert common.dealt(df, 50 * common.PARTITION_BYTES, "id").rdd.getNumPartitions() == 50
    assert common.plan_bytes(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")) > 10_000
