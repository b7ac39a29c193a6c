"""BPE encoding and decoding through a table of distinct words.

Byte-level BPE never merges across a space that is followed by a visible
character, so a text falls into *words* at such spaces and the ids of a text
are those of its words in order. Encoding runs in four steps:

1. Texts are dealt into blocks of bounded size by a hash, copies of a row apart
   (the one shuffle of texts; both later readers use the same exchange). What a
   scan task has for a block travels as one compressed chunk.
2. Each block lists its distinct words, dealt into buckets by a hash of the
   word. The lists travel sorted and compressed: one row for each block and
   bucket.
3. Each bucket joins the lists of all blocks, encodes each distinct word once,
   and answers each block with ids in the order of its list.
4. Each block makes its lists again and joins the answers back by position: a
   word's place in its list gives its ids, and a text's words in order give the
   text's ids. A checksum tells that the lists are those that were answered.

Decoding joins ids to pieces. The piece table has one row for each id of the
vocabulary, a size that does not grow with the corpus.

A word that has no answer (which a lost and recomputed partition of a source
with changing rows could cause) is encoded on the spot, so results stay right.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import dealt, ship, text_or_empty
from .tokenizers_io import Encoder, TokenizerFile, encoder

#: A space before a visible character. '<' may open a special string, whose
#: spaces the library reads on its own; characters that some library might
#: count as white space do not open a word either.
_WORD_START = re.compile(" (?=[!-;=-~¡-ᙿᚁ-᠍᠏-῿⁰-⿿、-﻾＀-\U0010ffff])")

#: Text bytes in a block, and listed words in a bucket, to aim at.
BLOCK_BYTES = 16 << 20
BUCKET_WORDS = 200_000
#: Blocks that meet in a bucket at most, so that a word that all blocks list does
#: not gather them all in one task. Beyond it (a terabyte of text) shares of so
#: many blocks make one list first, and these lists meet.
BUCKET_BLOCKS = 65_536


def words_of(text: str) -> list[str]:
    """The words of a text; the text is the words joined by single spaces."""
    return _WORD_START.split(text)


def _pack(row_type: pa.DataType, n_blocks: int):
    """Deal a scan task's rows into blocks, by the row's hash, the task's number and how often the task has met the row.

    Copies of a row are alike, so it plays no part which of them was met first:
    a task that runs again deals the same rows, whatever their order.
    """
    schema = pa.schema([("block", pa.int64()), ("chunk", pa.binary())])
    inner = pa.schema([("row", row_type), ("content", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        met: dict[int, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column("hash").to_numpy()
            times = np.zeros(len(rows), np.uint64)
            for k, h in enumerate(rows.tolist()):
                times[k] = met[h] = met.get(h, -1) + 1
            spread = (rows.view(np.uint64) ^ (np.uint64(task) << np.uint64(32)) ^ times) * np.uint64(0x9E3779B97F4A7C15)
            blocks = ((spread ^ (spread >> np.uint64(29))) % np.uint64(n_blocks)).astype(np.int64)
            order = np.argsort(blocks, kind="stable")
            names, starts = np.unique(blocks[order], return_index=True)
            sorted_rows = pa.record_batch([batch.column("row").cast(row_type), batch.column("content").cast(pa.string())], schema=inner).take(pa.array(order))
            chunks = []
            for lo, hi in zip(starts, [*starts[1:], len(order)], strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, inner, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(sorted_rows.slice(lo, hi - lo).take(pa.array(range(hi - lo))))
                chunks.append(sink.getvalue().to_pybytes())
            yield pa.record_batch([pa.array(names, pa.int64()), pa.array(chunks, pa.binary())], schema=schema)

    return run


def _chunks(table: pa.Table) -> Iterator[pa.Table]:
    for chunk in table.column("chunk"):
        yield pa.ipc.open_stream(chunk.as_py()).read_all()


def _lists_of(table: pa.Table, n_buckets: int, shares: int) -> tuple[int, dict[int, list[bytes]]]:
    """A block's number, and its distinct words by bucket, in order."""
    first: set[str] = set()
    later: set[str] = set()
    for chunk in _chunks(table):
        for text in chunk.column("content"):
            words = words_of(text.as_py())
            first.add(words[0])
            later.update(words[1:])
    first.discard("")
    block = table.column("block")[0].as_py()
    share = block % shares
    buckets: dict[int, list[bytes]] = {}
    for word in {w.encode() for w in first} | {b" " + w.encode() for w in later}:
        buckets.setdefault(zlib.crc32(word) % n_buckets * shares + share, []).append(word)
    return block, {k: sorted(v) for k, v in buckets.items()}


def _joined(words: list[bytes]) -> bytes:
    """NUL ends each word; a NUL inside a word is written as the byte 0xFF, which UTF-8 never holds."""
    return b"\0".join(w.replace(b"\0", b"\xff") for w in words)


def _list_words(n_buckets: int, shares: int):
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("words", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        import zstandard

        block, lists = _lists_of(table, n_buckets, shares)
        pack = zstandard.ZstdCompressor(level=3).compress
        return pa.table([pa.array([block] * len(lists), pa.int64()), pa.array(list(lists), pa.int64()), pa.array([pack(_joined(v)) for v in lists.values()], pa.binary())], schema=schema)

    return run


def _answer(file: TokenizerFile):
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("check", pa.int64()), ("ids", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        import zstandard

        enc = encoder(file)
        known: dict[bytes, bytes] = {}
        pack, unpack = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress
        checks, answers = [], []
        for data in table.column("words"):
            joined = unpack(data.as_py())
            out = []
            for word in joined.split(b"\0"):
                ids = known.get(word)
                if ids is None:
                    ids = known[word] = ",".join(map(str, enc.encode(word.replace(b"\xff", b"\0").decode()))).encode()
                out.append(ids)
            checks.append(zlib.crc32(joined))
            answers.append(pack(b"\n".join(out)))
        return pa.table([table.column("block"), table.column("bucket"), pa.array(checks, pa.int64()), pa.array(answers, pa.binary())], schema=schema)

    return run


def _union(shares: int):
    """All words that the blocks of a share list in a bucket, as one list."""
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("words", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        import zstandard

        bucket = table.column("bucket")[0].as_py()
        words = zstandard.ZstdCompressor(level=3).compress(b"\0".join(_listed(table)))
        return pa.table([pa.array([bucket % shares], pa.int64()), pa.array([bucket // shares], pa.int64()), pa.array([words], pa.binary())], schema=schema)

    return run


def _listed(table: pa.Table) -> list[bytes]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    words: set[bytes] = set()
    for data in table.column("words"):
        words.update(unpack(data.as_py()).split(b"\0"))
    return sorted(words)


def _hand_down(key: tuple, lists: pa.Table, answers: pa.Table) -> pa.Table:
    """The answer to a share's one list, handed to each of its blocks in the order of the block's own list."""
    import zstandard

    pack, unpack = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress
    words, checks, out, kept = _listed(lists), [], [], []
    known: dict[bytes, bytes] = {}
    for check, ids in zip(answers.column("check"), answers.column("ids"), strict=True):
        if check.as_py() == zlib.crc32(b"\0".join(words)):
            known = dict(zip(words, unpack(ids.as_py()).split(b"\n"), strict=True))
    for k, data in enumerate(lists.column("words") if known else ()):
        joined = unpack(data.as_py())
        checks.append(zlib.crc32(joined))
        out.append(pack(b"\n".join([known[w] for w in joined.split(b"\0")])))
        kept.append(k)
    own = lists.take(pa.array(kept, pa.int64()))
    return pa.table({"block": own.column("block"), "bucket": own.column("bucket"), "check": pa.array(checks, pa.int64()), "ids": pa.array(out, pa.binary())})


class _Block:
    """One block's words and the ids they join to, by their places in its lists."""

    def __init__(self, enc: Encoder, lists: dict[int, list[bytes]], answers: pa.Table):
        import zstandard

        self.enc = enc
        self.ids: dict[str, str] = {}
        unpack = zstandard.ZstdDecompressor().decompress
        for bucket, check, ids in zip(*(answers.column(c) for c in ("bucket", "check", "ids")), strict=True):
            words = lists.get(bucket.as_py(), [])
            if zlib.crc32(_joined(words)) == check.as_py():
                self.ids.update(zip((w.decode() for w in words), unpack(ids.as_py()).decode().split("\n"), strict=True))

    def __getitem__(self, word: str) -> str:
        found = self.ids.get(word)
        if found is None:
            found = self.ids[word] = ",".join(map(str, self.enc.encode(word)))
        return found

    def encode(self, text: str) -> str:
        """Decimal ids joined by commas."""
        if not text:
            return ""
        words = words_of(text)
        head = [self[words[0]]] if words[0] else []
        spaced = [" " + w for w in words[1:]]
        try:
            return ",".join(head + [self.ids[w] for w in spaced])
        except KeyError:
            return ",".join(head + [self[w] for w in spaced])


def _join_back(file: TokenizerFile, n_buckets: int, shares: int, digests: bool, schema: pa.Schema):
    def run(key: tuple, chunks: pa.Table, answers: pa.Table) -> pa.Table:
        enc = encoder(file)
        if not chunks.num_rows:
            return schema.empty_table()
        block = _Block(enc, _lists_of(chunks, n_buckets, shares)[1], answers)
        out = []
        for docs in _chunks(chunks):
            n, ids, sha, decoded = [], [], [], []
            for text in docs.column("content"):
                joined = block.encode(text.as_py())
                own = list(map(int, joined.split(","))) if joined else []
                n.append(len(own))
                if digests:
                    sha.append(hashlib.sha256(joined.encode()).hexdigest())
                    decoded.append(hashlib.sha256(enc.decode(own).encode()).hexdigest())
                else:
                    ids.append(pa.array(own, pa.int32()))
            more = [pa.array(sha, pa.string()), pa.array(decoded, pa.string())] if digests else [_lists(ids)]
            out.append(pa.table([docs.column("row"), pa.array(n, pa.int64()), *more], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def _lists(arrays: list[pa.Array]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays([pa.array([], pa.int32()), *arrays]))


def encode(docs: DataFrame, file: TokenizerFile, keep: list[str], text_col: str = "text", digests: bool = False) -> DataFrame:
    """Encode every whole text; one output row for each input row.

    keep: columns to carry along. Null texts count as empty and get no ids.
    Repeated rows, repeated or null ids and extra columns are all fine: the
    columns in ``keep`` travel in a struct, so no name can clash. An empty
    table gives an empty result. A block holds about BLOCK_BYTES of text, or
    one longer text.

    Returns keep + n_tokens + ids (array of int). With ``digests``, instead of
    ids: ids_sha256 over the decimal ids joined by commas, and decoded_sha256
    over the text that the ids decode to, so that ids need not leave the worker.
    """
    spark = docs.sparkSession
    ship(spark)
    if not encoder(file).byte_level:
        raise ValueError("the distinct-word table needs a byte-level BPE file")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), text_or_empty(text_col).alias("content"))
    size = rows.agg(F.sum(F.octet_length("content").cast("long")), F.count(F.lit(1))).first()
    n_bytes = (size[0] or 0) + 16 * size[1]
    n_blocks = max(-(-n_bytes // BLOCK_BYTES), 4 * spark.sparkContext.defaultParallelism)
    # about one distinct word in a block for every 40 bytes of it
    n_buckets = max(-(-n_bytes // (40 * BUCKET_WORDS)), 4 * spark.sparkContext.defaultParallelism)
    shares = -(-n_blocks // BUCKET_BLOCKS)
    row_type = rows.schema["row"].dataType
    arrow_row = to_arrow_type(row_type)
    packed = rows.withColumn("hash", F.xxhash64("row", "content")).mapInArrow(_pack(arrow_row, n_blocks), "block long, chunk binary")
    blocks = dealt(packed, n_bytes, "block")
    lists = blocks.groupBy("block").applyInArrow(_list_words(n_buckets, shares), "block long, bucket long, words binary")
    answered = "block long, bucket long, check long, ids binary"
    if shares == 1:
        answers = lists.groupBy("bucket").applyInArrow(_answer(file), answered)
    else:
        # so many blocks that their lists don't fit a task: shares of them make one list each, and these meet
        unions = lists.groupBy("bucket").applyInArrow(_union(shares), "block long, bucket long, words binary")
        met = unions.groupBy("bucket").applyInArrow(_answer(file), answered)
        met = met.select((F.col("bucket") * shares + F.col("block")).alias("bucket"), "check", "ids")
        answers = lists.groupBy("bucket").cogroup(met.groupBy("bucket")).applyInArrow(_hand_down, answered)
    out = T.StructType([T.StructField("row", row_type), T.StructField("n_tokens", T.LongType())])
    out = out.add("ids_sha256", "string").add("decoded_sha256", "string") if digests else out.add("ids", T.ArrayType(T.IntegerType()))
    arrow_out = pa.schema([("row", arrow_row), ("n_tokens", pa.int64()), *([("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] if digests else [("ids", pa.list_(pa.int32()))])])
    back = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_join_back(file, n_buckets, shares, digests, arrow_out), out)
    return back.select("row.*", *out.names[1:])


def decode(encoded: DataFrame, file: TokenizerFile, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """Join ids to pieces and give the text, special pieces included.

    Null ids give a null text, no ids an empty one. All other columns stay.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(file)
        for ids in batches:
            yield pa.array([None if x is None else enc.decode(x) for x in ids.to_pylist()], pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return encoded.withColumn(out_col, F.arrow_udf("string")(run)(F.col(ids_col)))
