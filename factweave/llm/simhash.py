"""SimHash near-duplicates by a self-join of a binary trie.

The distinct fingerprints form a binary trie. Pairs of nodes are walked down
together from (root, root); the bits in which their prefixes differ add up, and
a pair whose sum exceeds the budget is pruned with all that lies below it.

The top levels of the walk are dealt over tasks: a task owns the pairs of
subtrees whose smaller prefix is its own, so every fingerprint goes to its own
task and to those of the lower prefixes that differ from its own in at most
``budget`` bits. A subtree that holds far more fingerprints than others is cut
into chunks, and each pair of chunks is a task, so no task's rows grow with the
largest subtree. Each task then walks its part with arrays of node ranges, a
bounded number of node pairs at a time, and returns a spanning forest of the
links it found: no link is lost, and dense groups cost no more rows than they
have members. Copies share a fingerprint and never meet as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, packed, ship, text_or_empty, unpacked
from .components import components

#: Fingerprints below one top prefix to aim at, and node pairs held at a time.
SUBTREE = 4096
#: A subtree is cut into chunks of this many.
CHUNK = 8 * SUBTREE
FRONTIER = 1 << 19


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a whole text, as a signed integer.

    A-Z are lower-cased; words are runs of bytes other than white space in
    ASCII; shingles of ``shingle`` words are space-joined, repeats included
    (fewer words: the whole sequence; none: zero). A bit is 1 if it is set in
    over half of the shingles' XXH64.
    """
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    starts = [0, *(e + 1 for e in ends)]
    hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :] or ends[-1:])], dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(text: Column, shingle: int = 3, seed: int = 42) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([fingerprint(t.as_py() or "", shingle, seed) for t in batch], pa.int64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf("long")(run)(text)


def _halves(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
    """Where the node ranges [lo, hi) at this depth split by their next bit."""
    bit = np.uint64(1) << np.uint64(63 - depth)
    border = (keys[lo] & ~(bit - np.uint64(1))) | bit
    return np.clip(np.searchsorted(keys, border), lo, hi)


def trie_pairs(a: np.ndarray, b: np.ndarray, budget: int, same: bool, depth: int = 0, spent: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with a[i] and b[j] at most ``budget`` bits apart.

    a, b: sorted uint64, each with one common prefix of ``depth`` bits; the
    prefixes differ in ``spent`` bits. With ``same``, a is b and only i < j are
    given. Equal keys are pairs too.
    """
    if not len(a) or not len(b):
        return
    root = np.zeros(1, dtype=np.int64)
    stack = [(depth, root, root + len(a), root, root + len(b), root + spent)]
    while stack:
        d, alo, ahi, blo, bhi, cost = stack.pop()
        if len(alo) > FRONTIER:
            half = len(alo) // 2
            stack += [(d, *(x[:half] for x in (alo, ahi, blo, bhi, cost))), (d, *(x[half:] for x in (alo, ahi, blo, bhi, cost)))]
            continue
        size = (ahi - alo) * (bhi - blo)
        if d == 64 and size.max() > FRONTIER:
            # many equal keys: halve their range until its pairs fit
            k = int(size.argmax())
            mid = (alo[k] + ahi[k]) // 2 if ahi[k] - alo[k] > 1 else ahi[k]
            cut = (blo[k] + bhi[k]) // 2
            parts = [(x, y, z, w) for x, y in ((alo[k], mid), (mid, ahi[k])) for z, w in ((blo[k], cut), (cut, bhi[k])) if x < y and z < w and (not same or x < w)]
            keep = np.arange(len(size)) != k
            alo, ahi, blo, bhi = (np.concatenate([x[keep], [q[i] for q in parts]]).astype(np.int64) for i, x in enumerate((alo, ahi, blo, bhi)))
            stack.append((d, alo, ahi, blo, bhi, np.concatenate([cost[keep], np.full(len(parts), cost[k])])))
            continue
        small = size <= 16
        if d == 64:
            small = np.cumsum(size) <= max(FRONTIER, int(size[0]))
            if not small.all():
                rest_ = ~small
                stack.append((d, *(x[rest_] for x in (alo, ahi, blo, bhi, cost))))
                alo, ahi, blo, bhi, cost = (x[small] for x in (alo, ahi, blo, bhi, cost))
                small = np.ones(len(alo), bool)
        if small.any():
            l, w = alo[small], (bhi - blo)[small]
            n = (ahi[small] - l) * w
            group = np.repeat(np.arange(len(n)), n)
            k = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
            i, j = l[group] + k // w[group], blo[small][group] + k % w[group]
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            if same:
                near &= i < j
            if near.any():
                yield i[near], j[near]
        rest = ~small
        if not rest.any():
            continue
        alo, ahi, blo, bhi, cost = (x[rest] for x in (alo, ahi, blo, bhi, cost))
        am, bm = _halves(a, alo, ahi, d), _halves(b, blo, bhi, d)
        below = []
        for p, (l, h) in enumerate(((alo, am), (am, ahi))):
            for q, (m, k) in enumerate(((blo, bm), (bm, bhi))):
                c = cost + (p != q)
                live = (c <= budget) & (l < h) & (m < k)
                if same:
                    live &= l <= m
                below.append([x[live] for x in (l, h, m, k, c)])
        stack.append((d + 1, *(np.concatenate(x) for x in zip(*below, strict=True))))


class _Forest:
    """Keeps one spanning link for each merge of two components."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            x, y = self.label[i], self.label[j]
            apart = x != y
            if not apart.any():
                return
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up


def _walk(prefix_bits: int, budget: int, near: int | None):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        own, i, j = (k.as_py() for k in key[1:])
        keys, ids = (table.column(c).to_numpy().view(np.uint64) for c in ("key", "fp"))
        member = table.column("member").to_numpy(zero_copy_only=False)
        marks = table.column("marks").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(keys), -1) if near is not None else None
        every, place = np.unique(ids, return_inverse=True)
        forest = _Forest(len(every))
        order = np.argsort(keys, kind="stable")
        mine, theirs = order[member[order]], order[~member[order]]

        def add(a: np.ndarray, b: np.ndarray) -> None:
            if marks is not None:
                close = np.bitwise_count(marks[a] ^ marks[b]).sum(axis=1) <= near
                a, b = a[close], b[close]
            forest.add(place[a], place[b])

        if i == j:
            for x, y in trie_pairs(keys[mine], keys[mine], budget, True, prefix_bits):
                add(mine[x], mine[y])
        tops = (keys[theirs] >> np.uint64(64 - prefix_bits)).astype(np.int64) if prefix_bits else np.zeros(len(theirs), np.int64)
        for other in np.unique(tops) if len(mine) else []:
            lo, hi = np.searchsorted(tops, [other, other + 1])
            for x, y in trie_pairs(keys[mine], keys[theirs[lo:hi]], budget, False, prefix_bits, int(np.bitwise_count(other ^ own))):
                add(mine[x], theirs[lo:hi][y])
        linked = np.flatnonzero(forest.label != np.arange(len(every)))
        return pa.table([pa.array(every[linked].view(np.int64)), pa.array(every[forest.label[linked]].view(np.int64))], schema=schema)

    return run


def links(nodes: DataFrame, budget: int = 2, near: int | None = None, subtree: int | None = None) -> DataFrame:
    """Links (u, v) that connect all nodes whose keys are at most ``budget`` bits apart.

    nodes: (fp long) without nulls or repeats, the key being fp itself; or
    (fp, keys, marks), where a node has one key for each trie and marks, arrays
    of long, whose differing bits must not exceed ``near`` for a link. The links
    form a spanning forest within each task, so their components are those of
    all pairs.
    """
    n = nodes.count()
    subtree = subtree or SUBTREE
    bits = min(24, max(0, (n // subtree).bit_length()))
    if near is None:
        rows = nodes.select(F.lit(0).alias("trie"), F.col("fp").alias("key"), "fp", F.lit(None).cast("array<bigint>").alias("marks"))
    else:
        rows = nodes.select(F.posexplode("keys").alias("trie", "key"), "fp", "marks")
    top = F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long")
    rows = rows.withColumn("top", top)
    flips = [sum(1 << k for k in c) for d in range(1, budget + 1) for c in combinations(range(bits), d)]
    about = lambda p: F.array(*[p.bitwiseXOR(F.lit(x).cast("long")) for x in flips]) if flips else F.array().cast("array<long>")
    lower = F.explode(F.filter(about(F.col("top")), lambda p: p < F.col("top"))).alias("owner")
    chunk = max(CHUNK, 4 * subtree)
    large = rows.groupBy("trie", "top").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk).select("trie", "top", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    large = materialise(large, "subtrees")
    zero, own = F.lit(0), ("key", "fp", "marks")
    out = lambda df, owner, i, j, member: df.select("trie", owner, i.alias("i"), j.alias("j"), *own, F.lit(member).alias("member"))
    if large.isEmpty():
        members = out(rows, F.col("top").alias("owner"), zero, zero, True)
        visitors = out(rows, lower, zero, zero, False)
    else:
        one = F.lit(1)
        rows = rows.join(large, ["trie", "top"], "left").select("trie", "top", *own, F.pmod(F.xxhash64("fp"), F.coalesce("chunks", one)).cast("int").alias("chunk"))
        # an owner's chunks meet as many chunks of visitors as its largest neighbour, or it itself, has
        wide = large.select("trie", F.explode(F.concat(F.array("top"), about(F.col("top")))).alias("top"), "chunks").groupBy("trie", "top").agg(F.max("chunks").alias("meets"))
        members = out(rows.join(wide, ["trie", "top"], "left"), F.col("top").alias("owner"), F.col("chunk"), F.explode(F.sequence(zero, F.coalesce("meets", one) - 1)), True)
        across = rows.select("trie", lower, *own, "chunk").join(large.withColumnRenamed("top", "owner"), ["trie", "owner"], "left")
        across = out(across, F.col("owner"), F.explode(F.sequence(zero, F.coalesce("chunks", one) - 1)), F.col("chunk"), False)
        within = out(rows.where("chunk > 0"), F.col("top").alias("owner"), F.explode(F.sequence(zero, F.col("chunk") - 1)), F.col("chunk"), False)
        visitors = across.union(within)
    return members.union(visitors).groupBy("trie", "owner", "i", "j").applyInArrow(_walk(bits, budget, near), "u long, v long")


def classes(rows: DataFrame, budget: int = 2) -> DataFrame:
    """The class of each fingerprint: (fp, component_id, component_fp).

    rows: (doc_id long, fp long). component_id is the least non-null doc_id of
    all that the links reach (null if all are null); component_fp is a
    fingerprint that the document with that id has (the least, if several).
    """
    least = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    return _classes(least, links(least.select("fp"), budget))


def _classes(least: DataFrame, edges: DataFrame) -> DataFrame:
    roots = components(edges)
    joined = least.join(roots, least.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    heads = joined.groupBy("root").agg(F.min("least").alias("component_id"), F.min(F.struct(F.col("least").isNull().alias("n"), "least", "fp")).alias("head"))
    return joined.select("fp", "root").join(heads, "root").select("fp", "component_id", F.col("head.fp").alias("component_fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 2) -> DataFrame:
    """One row for each document with its fingerprint and class.

    Every input row gives one output row: id, fingerprint (16 hex digits) and
    component_id, the least id reachable over links of at most ``budget``
    differing bits, itself included. Null texts have no words, as empty ones
    do; their fingerprint is zero and links like any other. Null ids keep their
    rows but are no class's id unless all in the class are null. Repeated rows
    and extra columns are fine; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    rows = materialise(docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprints(text_or_empty(text_col)).alias("fp")), "simhash")
    found = classes(rows, budget)
    return rows.join(found, "fp").select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Tries that a similarity search walks, each over a key of ROWS min-hashes, and the bits in which keys may differ.
#: Two texts of Jaccard similarity s share a key with probability 1 - (1 - s ** ROWS) ** TRIES: 0.998 at 0.8.
TRIES = 20
ROWS = 6
KEY_BUDGET = 0
#: Min-hashes of a text; the marks hold one bit of each.
HASHES = 256
#: Standard deviations by which a candidate's marks may exceed the mean.
DEVIATIONS = 3
_draw = np.random.default_rng(5)
_ODD = _draw.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _draw.integers(0, 2**64, HASHES, dtype=np.uint64)


def digests(text: str, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """The sorted XXH64 of a text's different shingles; none for a text without words."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    starts = [0, *(e + 1 for e in ends)]
    return np.unique(np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :] or ends[-1:])], dtype=np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def signature(text: str, shingle: int = 5, seed: int = 42) -> tuple[list[int], list[int], int, int]:
    """(keys, marks, identity, witness) of a text's different shingles: keys of ROWS min-hashes, a bit of each min-hash, and two hashes of them all."""
    return _signature(digests(text, shingle, seed), seed)


def _signature(found: np.ndarray, seed: int = 42) -> tuple[list[int], list[int], int, int]:
    from xxhash import xxh64_intdigest

    if not len(found):
        return [0] * TRIES, [0] * (HASHES // 64), 0, 0
    least = np.full(HASHES, 2**64 - 1, dtype=np.uint64)
    for k in range(0, len(found), 1 << 10):
        least = np.minimum(least, (found[k : k + (1 << 10), None] * _ODD + _ADD).min(axis=0))
    least = _mixed(least)
    keys = np.zeros(TRIES, dtype=np.uint64)
    for part in least[: TRIES * ROWS].reshape(TRIES, ROWS).T:
        keys = _mixed((keys ^ part) * _ODD[0] + _ADD[0])
    marks = np.packbits((least & np.uint64(1)).astype(np.uint8)).view(np.int64)
    whole = found.tobytes()
    return keys.view(np.int64).tolist(), marks.tolist(), *(int(np.uint64(xxh64_intdigest(whole, s)).view(np.int64)) for s in (seed, seed + 1))


#: Bits of the least parity sketch: one for each shingle, up to the next power of two, is aimed at.
PARITY = 256


def _prefix(n, similarity: float):
    """Shingles in the prefix of a text that has n."""
    return n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1


def outline(found: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    """(size, prefix, parity) of a text's sorted shingles.

    Two sets of this similarity share at least that share of the larger one, so
    they have a shingle in common within their prefixes: all but that share of
    each set, and one more, in one order for all texts. ``common`` (shingles,
    counts) come last in it, by their counts. The prefix is given in that order.

    Each bit of the sketch is the parity of the shingles that fall on it: two
    sketches differ in no more bits than the sets do in shingles. A sketch folds
    to half its length by XOR of its halves.
    """
    n = len(found)
    if not n:
        return 0, np.empty(0, np.int64), np.zeros(PARITY // 64, np.int64)
    rank = np.zeros(n, np.int64)
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], found), len(common[0]) - 1)
        rank = np.where(common[0][at] == found, common[1][at], 0)
    prefix = found[np.argsort(rank, kind="stable")[: _prefix(n, similarity)]]
    bits = PARITY << ((n - 1) // PARITY).bit_length()
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return n, prefix.view(np.int64), np.packbits(odd.astype(np.uint8)).view(np.int64)


#: Different texts, about, whose shingles are counted for the order of prefixes, and the most shingles taken from them.
#: The order decides what the search costs, never what it finds.
SAMPLE = 4096
COMMON = 1 << 16


def common_shingles(docs: DataFrame, text_col: str, shingle: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, sorted, that several of the sampled texts hold, and how many do."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([digests(t.as_py() or "", shingle).view(np.int64) for t in batch], pa.list_(pa.int64()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    text = text_or_empty(text_col)
    texts = docs.select(text.alias("text"), F.xxhash64(text).alias("h")).where(F.pmod("h", F.lit(max(1, docs.count() // SAMPLE))) == 0)
    found = texts.dropDuplicates(["h"]).select(F.explode(F.arrow_udf("array<bigint>")(run)("text")).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    found = found.where("n > 1").orderBy(F.desc("n"), "s").limit(COMMON).toArrow()
    shingles, counts = found.column("s").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(shingles)
    return shingles[order], counts[order]


def signatures(text: Column, shingle: int, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> Column:
    many = pa.list_(pa.int64())
    fields = {"keys": many, "marks": many, "fp": pa.int64(), "witness": pa.int64(), "size": pa.int64(), "prefix": many, "parity": many}

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sets = [digests(t.as_py() or "", shingle) for t in batch]
            found = [(*_signature(x), *outline(x, similarity, common)) for x in sets]
            yield pa.StructArray.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate(fields.values())], list(fields))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf("keys array<bigint>, marks array<bigint>, fp bigint, witness bigint, size bigint, prefix array<bigint>, parity array<bigint>")(run)(text)


def bits_for(similarity: float) -> int:
    """Differing marks that two sets of this Jaccard similarity show in the mean, and DEVIATIONS standard deviations more."""
    share = (1 - similarity) / 2
    return int(np.floor(HASHES * share + DEVIATIONS * np.sqrt(HASHES * share * (1 - share))))


#: Texts of one candidate class that a task compares with each other or with as many others.
MEET = 512


def _similar(similarity: float, shingle: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        i, j = (k.as_py() for k in key[2:])
        fp, root = (table.column(c).to_numpy().view(np.uint64) for c in ("fp", "root"))
        chunk = table.column("chunk").to_numpy()
        sets = [digests(t or "", shingle) for t in table.column("text").to_pylist()]
        sizes = np.array([len(x) for x in sets])
        # a shingle counts within its candidate class only, as classes share tasks
        every, place = np.unique(np.concatenate([x ^ y for x, y in zip(sets, _mixed(root), strict=True)]), return_inverse=True)
        ends = np.cumsum(sizes)
        right = np.repeat(chunk == j, sizes)
        order = np.flatnonzero(right)[np.argsort(place[right], kind="stable")]
        holder = np.repeat(np.arange(len(sets)), sizes)[order]
        held = np.bincount(place[right], minlength=len(every))
        first = np.cumsum(held) - held
        forest = _Forest(len(sets))
        for x in np.flatnonzero(chunk == i):
            own = place[ends[x] - sizes[x] : ends[x]]
            n = held[own]
            common = np.bincount(holder[np.repeat(first[own] - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(sets))
            y = np.flatnonzero(common)
            y = y[common[y] / (sizes[x] + sizes[y] - common[y]) >= similarity]
            forest.add(np.full(len(y), x), y)
        linked = np.flatnonzero(forest.label != np.arange(len(sets)))
        return pa.table([pa.array(fp[linked].view(np.int64)), pa.array(fp[forest.label[linked]].view(np.int64))], schema=schema)

    return run


def similar(texts: DataFrame, similarity: float, shingle: int = 5) -> DataFrame:
    """Links (u, v) that connect all texts of one candidate class whose shingles have this exact Jaccard similarity.

    texts: (fp long, root long, text string), fp without repeats, root naming the
    class. Small classes share tasks; a class of more than MEET texts is cut into
    chunks, and each pair of chunks is a task.
    """
    sizes = materialise(texts.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "candidates")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    large = F.col("n") > MEET
    tasks = F.lit(max(1, total // (2 * MEET)))
    rows = texts.join(sizes, "root").withColumn("chunks", F.when(large, F.ceil(F.col("n") / MEET)).otherwise(1).cast("int"))
    rows = rows.select("fp", "root", "text", large.alias("large"), F.when(large, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), tasks)).alias("owner"), "chunks", F.pmod(F.xxhash64("fp"), "chunks").cast("int").alias("chunk"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    rows = rows.withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other")).drop("other")
    return rows.groupBy("large", "owner", "i", "j").applyInArrow(_similar(similarity, shingle), "u long, v long")


#: Entries of prefixes in a bucket to aim at, and texts whose entries are dealt to the buckets together.
ENTRIES = 1 << 19
DEALT = 2048
#: Texts with one shingle in their prefixes that a chunk holds; each pair of chunks is a group of its own.
BUCKET = 4096
#: Steps in which a shingle's place in its prefix is told, and bytes of sketches to aim at in a task.
STEPS = 255
SKETCHES = 1 << 25


def _deal(bits: int):
    """Entries (fp, shingle, place) of prefixes, packed by bucket: the low ``bits`` of a shingle name its bucket, the next 32 are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), DEALT):
                part = batch.slice(k, DEALT)
                ids, first = np.unique(part.column("fp").to_numpy(), return_index=True)
                prefixes = part.column("prefix").take(pa.array(first))
                shingles = prefixes.flatten().to_numpy().view(np.uint64)
                lengths = prefixes.value_lengths().to_numpy().astype(np.int64)
                fps = np.repeat(ids, lengths)
                places = (np.arange(len(fps)) - np.repeat(np.cumsum(lengths) - lengths, lengths)) * STEPS // np.repeat(lengths, lengths)
                bucket = (shingles & np.uint64((1 << bits) - 1)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                kept, fps, places = (shingles[order] >> np.uint64(bits)).astype(np.uint32), fps[order], places[order].astype(np.uint8)
                names, starts = np.unique(bucket[order], return_index=True)
                ends = [*starts[1:], len(order)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([kept[x:y].tobytes() + fps[x:y].tobytes() + places[x:y].tobytes() for x, y in zip(starts, ends)], pa.binary())], ["bucket", "entries"])

    return run


def _several(chunk: int):
    """Entries of shingles that several texts have, with the chunks that a shingle's texts make."""
    schema = pa.schema([("bucket", pa.int32()), ("shingle", pa.int64()), ("fp", pa.int64()), ("place", pa.int16()), ("chunks", pa.int32())])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        packs = table.column("entries").to_pylist()
        shingle = np.concatenate([np.frombuffer(x, np.uint32, len(x) // 13) for x in packs])
        fp = np.concatenate([np.frombuffer(x, np.int64, len(x) // 13, len(x) // 13 * 4) for x in packs])
        place = np.concatenate([np.frombuffer(x, np.uint8, len(x) // 13, len(x) // 13 * 12) for x in packs])
        order = np.lexsort((place, fp, shingle))
        shingle, fp, place = shingle[order], fp[order], place[order]
        new = np.r_[True, (shingle[1:] != shingle[:-1]) | (fp[1:] != fp[:-1])]
        shingle, fp, place = shingle[new], fp[new], place[new]
        _, of, n = np.unique(shingle, return_inverse=True, return_counts=True)
        keep = n[of] > 1
        chunks = -(-n[of][keep] // chunk)
        return pa.table([pa.array(np.full(keep.sum(), key[0].as_py()), pa.int32()), pa.array(shingle[keep], pa.int64()), pa.array(fp[keep]), pa.array(place[keep], pa.int16()), pa.array(chunks, pa.int32())], schema=schema)

    return run


def _candidates(similarity: float, apart: bool, shingle: np.ndarray, root: np.ndarray, size: np.ndarray, place: np.ndarray, chunk: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows, sorted by shingle, that have it in common, are of different classes (and chunks, if ``apart``) and can be similar.

    Sizes must allow the similarity. So must what is left of both texts from
    their first common shingle on: of similar texts, one common shingle at least
    is the first, and no other is asked to let them pass.
    """
    starts = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1]])
    ends = np.r_[starts[1:], len(shingle)]
    of = np.repeat(np.arange(len(starts)), ends - starts)
    left = size - np.ceil(place * _prefix(size, similarity) / STEPS - 1e-9)
    # the texts of one class have nothing to find
    mixed = np.minimum.reduceat(root, starts) < np.maximum.reduceat(root, starts)
    partners = np.where(mixed[of], ends[of] - 1 - np.arange(len(of)), 0)
    total = np.cumsum(partners)
    at = 0
    while at < len(of):
        to = max(at + 1, int(np.searchsorted(total, total[at] - partners[at] + FRONTIER, "right")))
        n = partners[at:to]
        x = np.repeat(np.arange(at, to), n)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
        near = (root[x] != root[y]) & (np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y]) - 1e-6)
        near &= np.minimum(left[x], left[y]) >= (size[x] + size[y]) * (similarity / (1 + similarity)) - 1e-6
        if apart:
            near &= chunk[x] != chunk[y]
        if near.any():
            yield x[near], y[near]
        at = to


_ENTRY = ("shingle", "root", "size", "place", "chunk")


def _live(similarity: float):
    """Entries that are in a candidate pair, dealt into parts whose sketches fit a task; all of a shingle's are in one part."""
    kinds = {"bucket": pa.int32(), "owner": pa.int64(), "i": pa.int32(), "j": pa.int32(), "part": pa.int32(), "shingle": pa.int64(), "fp": pa.int64(), "root": pa.int64(), "size": pa.int64(), "place": pa.int16(), "chunk": pa.int32()}

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket, owner, i, j = (k.as_py() for k in key)
        table = table.take(pa.array(np.argsort(table.column("shingle").to_numpy(), kind="stable")))
        shingle, root, size, place, chunk = (table.column(c).to_numpy() for c in _ENTRY)
        live = np.zeros(len(shingle), bool)
        for x, y in _candidates(similarity, i != j, shingle, root, size, place, chunk):
            live[x] = live[y] = True
        table = table.filter(pa.array(live))
        shingle, bytes_ = shingle[live], np.cumsum(64 + size[live] // 4)
        part = bytes_[np.searchsorted(shingle, shingle)] // SKETCHES
        named = {"bucket": bucket, "owner": owner, "i": i, "j": j}
        columns = [pa.array([named[c]] * len(part), t) if c in named else pa.array(part, t) if c == "part" else table.column(c).cast(t) for c, t in kinds.items()]
        return pa.table(columns, schema=pa.schema(list(kinds.items())))

    return run


def _folded(sketch: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


def _meet(similarity: float):
    """Links between classes, a spanning forest of those whose candidate pairs have sketches that allow the similarity."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    share = (1 - similarity) / (1 + similarity)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        i, j = (k.as_py() for k in key[2:4])
        table = table.take(pa.array(np.argsort(table.column("shingle").to_numpy(), kind="stable")))
        shingle, root, size, place, chunk = (table.column(c).to_numpy() for c in _ENTRY)
        # a text's entries share its sketch
        _, first, text = np.unique(table.column("fp").to_numpy(), return_index=True, return_inverse=True)
        parity = table.column("parity").take(pa.array(first)).combine_chunks()
        words = parity.value_lengths().to_numpy().astype(np.int64)
        sketches = np.split(parity.flatten().to_numpy().view(np.uint64), np.cumsum(words)[:-1])
        every, node = np.unique(root, return_inverse=True)
        forest = _Forest(len(every))
        for x, y in _candidates(similarity, i != j, shingle, root, size, place, chunk):
            # a pair that the forest connects already has nothing to add
            open_ = forest.label[node[x]] != forest.label[node[y]]
            x, y = x[open_], y[open_]
            # the longer sketch is folded to the shorter one's length
            shorter = np.minimum(words[text[x]], words[text[y]])
            for w in np.unique(shorter):
                p, q = x[shorter == w], y[shorter == w]
                used, at = np.unique(np.r_[text[p], text[q]], return_inverse=True)
                stack = np.stack([_folded(sketches[k], w) for k in used])
                step = max(1, 4 * FRONTIER // int(w))
                for k in range(0, len(p), step):
                    a, b = p[k : k + step], q[k : k + step]
                    differ = np.bitwise_count(stack[at[k : k + len(a)]] ^ stack[at[len(p) + k : len(p) + k + len(a)]]).sum(axis=1, dtype=np.int64)
                    near = differ <= share * (size[a] + size[b]) + 1e-6
                    forest.add(node[a[near]], node[b[near]])
        linked = np.flatnonzero(forest.label != np.arange(len(every)))
        return pa.table([pa.array(every[linked]), pa.array(every[forest.label[linked]])], schema=schema)

    return run


def rest(rows: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) between the roots of classes, which connect all classes that hold two texts of this Jaccard similarity.

    rows: (fp long, size long, prefix and parity arrays of long) as ``outline``
    gives them, rows of one fp alike; classes: (node, root), a text that is no
    node being a class of its own. Texts meet by the shingles of their prefixes;
    shingles that share a bucket and the bits kept there count as one. A pair is
    left out only if its sizes, what is left of its texts after their first
    common shingle, or its sketches say that it can't be similar. Sketches go
    only to entries that some other one can be similar to. A task gives a
    spanning forest of the links it finds, so no group of texts, however dense,
    costs more rows than it has classes.
    """
    entries = rows.agg(F.sum(F.size("prefix"))).first()[0] or 0
    bits = min(24, (entries // ENTRIES).bit_length())
    dealt = rows.select("fp", "prefix").mapInArrow(_deal(bits), "bucket int, entries binary")
    held = dealt.groupBy("bucket").applyInArrow(_several(BUCKET), "bucket int, shingle long, fp long, place short, chunks int")
    outlines = rows.select("fp", "size").dropDuplicates(["fp"])
    outlines = outlines.join(classes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    held = held.join(outlines, "fp").withColumn("chunk", F.pmod(F.xxhash64("fp"), "chunks").cast("int"))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    large = F.col("chunks") > 1
    held = held.select("bucket", F.when(large, F.col("shingle")).alias("owner"), F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "shingle", "fp", "root", "size", "place", "chunk")
    live = held.groupBy("bucket", "owner", "i", "j").applyInArrow(_live(similarity), "bucket int, owner long, i int, j int, part int, shingle long, fp long, root long, size long, place short, chunk int")
    sketches = rows.groupBy("fp").agg(F.any_value("parity").alias("parity"))
    return live.join(sketches, "fp").groupBy("bucket", "owner", "i", "j", "part").applyInArrow(_meet(similarity), "u long, v long")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """Keep one document of each class of similar texts, with all its columns.

    Texts link if their different shingles of ``shingle`` words have an exact
    Jaccard similarity of at least ``similarity`` (over 0). Most pairs come from
    TRIES tries, each over a key of ROWS min-hashes of the shingles: what kind of
    edit made a copy plays no part. Pairs whose marks differ in no more bits than
    ``bits_for`` gives form candidate classes. Tries and marks miss some pairs by
    chance; an exact search between the classes adds all that are left
    (``rest``). Within classes all texts are compared (``similar``).

    Kept is the document with the least non-null id of a class; among rows of
    that id, one with the class's shingles, then the least by its hash. Texts
    without words are alike. A class with null ids only keeps one of its rows
    too. Rows with the same shingles are reduced to one before any shuffle of
    texts. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    rows = packed(docs, doc_id=F.col(id_col).cast("long"), s=signatures(text_or_empty(text_col), shingle, similarity, common_shingles(docs, text_col, shingle)))
    rows = materialise(rows.select("row", "doc_id", *[F.col(f"s.{c}").alias(c) for c in ("fp", "witness", "keys", "marks", "size", "prefix", "parity")]), "simhash")
    least = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.any_value("keys").alias("keys"), F.any_value("marks").alias("marks")), "signatures")
    near = components(links(least.select("fp", "keys", "marks"), KEY_BUDGET, bits_for(similarity), 8 * SUBTREE))
    missed = materialise(rest(rows, near, similarity), "missed")
    if not missed.isEmpty():
        near = components(near.select(F.col("node").alias("u"), F.col("root").alias("v")).union(missed))
    texts = rows.groupBy("fp").agg(F.any_value(F.coalesce(F.col("row")[text_col].cast("string"), F.lit(""))).alias("text"))
    texts = texts.join(near.withColumnRenamed("node", "fp"), "fp")
    found = _classes(least.select("fp", "least"), similar(materialise(texts, "texts"), similarity, shingle))
    heads = found.where("fp = component_fp").select("fp")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("row"))
    # other shingles whose hash happens to be the same have another witness, and stay
    first = rows.groupBy("fp", "witness").agg(F.min_by("row", order).alias("row"))
    # heads take their witnesses along, so that the rows stay where they were grouped
    kept = rows.select("fp", "witness").distinct().join(heads, "fp", "left_semi")
    return unpacked(first.join(kept, ["fp", "witness"], "left_semi"))
