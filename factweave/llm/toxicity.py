"""Toxicity by cumulative-link ordinal regression.

Documents have severity grades 0 < 1 < ... < K. One weight for each sparse text
feature is shared by all ordered thresholds t1 < ... < tK:

    P(grade >= k) = sigmoid(w . x - tk)

and the expected severity is the sum of these over k. Features are words, and
word beginnings that at least one, two or three different words of the document
share; a document has a feature or has it not. Fitting sees a bounded, documented sample of
labelled rows; scoring reads every document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, packed, ship, text_or_empty, unpacked

#: Labelled rows that fitting reads at most, for each label.
SAMPLE = 3000
#: Features kept at most, and how sure their link to the label must be.
FEATURES = 20_000
SURE = 4.2
GRADES = 3
#: P(grade >= 1) from which a document is rejected.
REJECT = 0.5
_WORD = re.compile(r"\w+")
#: Lengths of the word beginnings that are features.
STEMS = (4, 5, 6, 7)
#: Numbers of different words with one beginning that are features.
LEVELS = (1, 2, 3)


def stems_of(word: str) -> list[str]:
    return [f"{word[:n]}*" for n in STEMS if len(word) >= n]


def leveled(words: set[str], stems: dict[str, int]) -> set[str]:
    return words | {f"{s}{k}" for s, n in stems.items() for k in LEVELS if n >= k}


def features(text: str) -> set[str]:
    words = set(_WORD.findall(text.lower()))
    return leveled(words, Counter(s for w in words for s in stems_of(w)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


@dataclass
class Model:
    """At most FEATURES weights, so small enough to send to every worker."""

    weights: dict[str, float]
    thresholds: list[float]

    def scorer(self):
        memo: dict[str, tuple[str, ...]] = {}
        stems = {f[:-1] for f in self.weights if f[-2:-1] == "*"}

        def score(text: str) -> float:
            words: set[str] = set()
            counts: dict[str, int] = {}
            for word in set(_WORD.findall(text.lower())):
                own = memo.get(word)
                if own is None:
                    if len(memo) >= 200_000:
                        memo.clear()
                    own = memo[word] = (*([word] if word in self.weights else ()), *(s for s in stems_of(word) if s in stems))
                for s in own:
                    if s[-1] == "*":
                        counts[s] = counts.get(s, 0) + 1
                    else:
                        words.add(s)
            return sum(self.weights[f] for f in sorted(leveled(words, counts)) if f in self.weights)

        return score

    def at_least(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 ... K, one column each."""
        return _sigmoid(np.asarray(scores, float)[:, None] - np.array(self.thresholds)[None, :])


def marks(text: str) -> tuple[int, int]:
    """The two least shingle hashes of a text."""
    words = _WORD.findall(text.lower())
    shingles = [" ".join(words[k : k + 5]).encode() for k in range(max(1, len(words) - 4))]
    return min(crc32(s, 1) for s in shingles), min(crc32(s, 2) for s in shingles)


def originals(rows: Iterable[tuple[int, int, int, int]]) -> list[int]:
    """Ids of documents without their near copies of the same label. rows: (id, label, mark, mark).

    Copies would pass chance words off as common ones. Two documents are copies
    if one of their two marks agrees.
    """
    seen: set[tuple[int, int, int]] = set()
    kept = []
    for own, label, *found in rows:
        own_marks = [(label, salt, m) for salt, m in enumerate(found)]
        if not any(m in seen for m in own_marks):
            kept.append(own)
        seen.update(own_marks)
    return kept


def select(counts: DataFrame, n_bad: int, n_good: int) -> dict[str, float]:
    """Features that toxic documents have at over twice the rate of others, with the root of their G statistic (6 at most).

    counts: (feature, a, b), the documents of either label that have it. Rates
    are taken within each label, so the sample's mix of labels plays no part in
    the choice.
    """

    def g(n: Column, size: int, p: Column) -> Column:
        return F.when(n > 0, 2 * n * F.log(n / (F.lit(float(size)) * p))).otherwise(0.0)

    a, b = F.col("a"), F.col("b")
    share = (a + b) / float(n_bad + n_good)
    total = g(a, n_bad, share) + g(b, n_good, share) + g(n_bad - a, n_bad, 1 - share) + g(n_good - b, n_good, 1 - share)
    often = (a >= 3) & (a / float(n_bad) > 2 * (b + 0.5) / float(n_good + 1))
    rows = counts.where(often).select("feature", F.least(F.lit(6.0), F.sqrt(total)).alias("sure")).where(F.col("sure") > SURE)
    return {r.feature: r.sure for r in rows.orderBy(F.col("sure").desc(), "feature").limit(FEATURES).collect()}


def grade(found: list[list[str]], toxic: list[int], chosen: dict[str, float], grades: int = GRADES) -> np.ndarray:
    """Severity grades from a binary label: toxic documents fall into equal parts by their chosen features."""
    dose = np.array([sum(chosen[f] for f in sorted(own)) for own in found])
    out = np.array(toxic, dtype=int)
    bad = np.flatnonzero(out)
    if len(bad):
        cuts = np.quantile(dose[bad], [k / grades for k in range(1, grades)])
        out[bad] = 1 + np.searchsorted(cuts, dose[bad], side="right")
    return out


def fit_grades(found: list[list[str]], grades: np.ndarray, chosen: dict[str, float], top: int = GRADES, rounds: int = 400, decay: float = 3e-3) -> Model:
    """Maximum likelihood with a small quadratic penalty, by Adam from a fixed start. found: each document's chosen features.

    Features count the more, and are penalised the less, the surer their link is.
    Toxic and clean documents weigh the same in all, so the sample's share of
    toxic ones does not move the thresholds.
    """
    names = sorted(chosen)
    scale = np.array([(chosen[f] / 4) ** 2 for f in names])
    at = {f: i for i, f in enumerate(names)}
    rows, cols = [], []
    for r, own in enumerate(found):
        rows += [r] * len(own)
        cols += [at[f] for f in own]
    rows, cols, n = np.array(rows, int), np.array(cols, int), len(found)
    w, t = np.full(len(names), 0.5), np.arange(1.0, top + 1)
    order = np.arange(1, top + 1)
    seen = (grades[:, None] == np.arange(top + 1)[None, :]).astype(float)
    sick = max(1, int((grades > 0).sum()))
    weight = np.where(grades > 0, n / 2 / sick, n / 2 / max(1, n - sick))[:, None]
    m, v, p = np.zeros(len(w) + top), np.zeros(len(w) + top), np.concatenate([w, t])
    for step in range(1, rounds + 1):
        w, t = p[: len(w)], p[len(w) :]
        x = np.bincount(rows, weights=(w * scale)[cols], minlength=n) if len(rows) else np.zeros(n)
        above = _sigmoid(x[:, None] - t[None, :])
        edge = np.hstack([np.ones((n, 1)), above, np.zeros((n, 1))])
        chance = np.maximum(edge[:, :-1] - edge[:, 1:], 1e-9)
        slope = above * (1 - above)
        # d(-log chance) by each P(grade >= k)
        by_above = seen[:, :-1] / chance[:, :-1] - seen[:, 1:] / chance[:, 1:]
        pull = weight * by_above * slope
        g_x = pull.sum(axis=1)
        g_w = (np.bincount(cols, weights=g_x[rows], minlength=len(w)) if len(rows) else np.zeros(len(w))) * scale / n + decay * w
        g = np.concatenate([g_w, -pull.sum(axis=0) / n])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        # features were chosen because they speak for toxicity: none may speak against it
        p[: len(w)] = np.maximum(p[: len(w)], 0)
        p[len(w) :] = np.maximum.accumulate(p[len(w) :] + 1e-6 * order)
    return Model({f: float(x) for f, x in zip(names, p[: len(names)] * scale, strict=True)}, [float(x) for x in p[len(names) :]])


def _sparse(text: Column) -> Column:
    """The marks and features of whole texts."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch]
            parts = [pa.array([marks(t) for t in texts], pa.list_(pa.int64())), pa.array([sorted(features(t)) for t in texts], pa.list_(pa.string()))]
            yield pa.StructArray.from_arrays(parts, ["marks", "features"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf("marks array<bigint>, features array<string>")(run)(text)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most ``sample`` labelled documents of each label, chosen by a hash of the id.

    Rows with a null id or label are passed over; of rows with one id, the least
    text counts. Without a toxic and a clean example nothing is rejected. No
    text reaches the driver: it takes two marks for each sampled document, at
    most FEATURES features, and which of these each document has.
    """
    spark = docs.sparkSession
    ship(spark)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("own_id")).agg(F.max(label_col).cast("int").alias("toxic"))
    parts = [known.where(F.col("toxic") == t).orderBy(F.xxhash64("own_id"), "own_id").limit(sample) for t in (0, 1)]
    rows = docs.select(F.col(id_col).cast("long").alias("own_id"), text_or_empty(text_col).alias("content")).join(F.broadcast(parts[0].union(parts[1])), "own_id")
    rows = rows.groupBy("own_id", "toxic").agg(F.min("content").alias("content")).select("own_id", "toxic", _sparse(F.col("content")).alias("s"))
    rows = materialise(rows.select("own_id", "toxic", F.col("s.marks").alias("marks"), F.col("s.features").alias("features")), "toxic-sample")
    toxic = {r.own_id: (r.toxic, *r.marks) for r in rows.select("own_id", "toxic", "marks").collect()}
    kept = originals((own, *toxic[own]) for own in sorted(toxic))
    n_bad = sum(toxic[own][0] for own in kept)
    n_good = len(kept) - n_bad
    if not n_bad or not n_good:
        return Model({}, [20.0 + k for k in range(GRADES)])
    owners = F.broadcast(spark.createDataFrame([(own,) for own in kept], "own_id long"))
    counts = rows.join(owners, "own_id").select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    chosen = select(counts, n_bad, n_good)
    names = F.broadcast(spark.createDataFrame([(f,) for f in chosen], "feature string"))
    held = rows.join(owners, "own_id").select("own_id", F.explode("features").alias("feature")).join(names, "feature").groupBy("own_id").agg(F.sort_array(F.collect_list("feature")).alias("own"))
    own = {r.own_id: r.own for r in held.collect()}
    found, is_toxic = [own.get(i, []) for i in kept], [toxic[i][0] for i in kept]
    return fit_grades(found, grade(found, is_toxic, chosen), chosen)


def severity(text: Column, model: Model) -> Column:
    """A struct of expected severity and P(grade >= 1) for whole texts; null texts count as empty."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score = model.scorer()
        for batch in batches:
            above = model.at_least(np.array([score(t.as_py() or "") for t in batch]))
            yield pa.StructArray.from_arrays([pa.array(above.sum(axis=1)), pa.array(above[:, 0])], ["expected", "toxic"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf("expected double, toxic double")(run)(text)


def score(docs: DataFrame, model: Model, reject: float = REJECT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Severity of every whole text: id, expected_severity, p_toxic, rejected.

    One output row for each input row; null and empty texts have no features and
    score as clean ones do; other columns are not read; an empty table gives an
    empty result.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("own_id"), severity(text_or_empty(text_col), model).alias("s"))
    return rows.select(F.col("own_id").alias(id_col), F.col("s.expected").alias("expected_severity"), F.col("s.toxic").alias("p_toxic"), (F.col("s.toxic") >= reject).alias("rejected"))


def keep_clean(docs: DataFrame, model: Model, reject: float = REJECT, text_col: str = "text") -> DataFrame:
    """Drop documents whose P(grade >= 1) reaches ``reject``; all columns stay."""
    ship(docs.sparkSession)
    rows = packed(docs, s=severity(text_or_empty(text_col), model))
    return unpacked(rows.where(~(F.col("s.toxic") >= reject)).select("row"))
