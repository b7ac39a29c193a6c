"""Exact top-k search without random access.

A query's score is a sum over components, so each component is a list of
candidates sorted by what they add: from its upper end for queries with a
positive component there, from its lower end for the others. Lists are read in
step, in doubling depths, for a batch of queries at a time. A candidate's lower bound counts the
least that each unread list could add, its upper bound the last value read
there. A query stops when the k-th best lower bound exceeds the upper bound of
all but a few candidates, unseen ones included; these few are resolved to their
final scores.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import best, search, usable

#: Share of the lists after which bounds are compared first; each later depth is twice as far.
FIRST = 1 / 8
#: If the bounds leave more than this share of candidates open, the next depth is the lists' end.
HOPELESS = 0.5
#: Queries that are read for together: bounds of one batch and block are held at a time.
BATCH = 512


class SortedLists:
    """A block's components, each sorted once for all queries."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        large = np.abs(vectors).max(initial=0) > 2**30
        self.real = vectors.astype(np.float64 if large else np.float32)
        self.rising = np.argsort(vectors, axis=0, kind="stable")
        self.low, self.high = self.real.min(axis=0), self.real.max(axis=0)

    def batch(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int):
        """(query, indexes, scores) of each query's k best candidates with another id than its own."""
        n, kind = len(ids), self.real.dtype
        up, down = np.maximum(queries, 0).T.astype(kind), np.minimum(queries, 0).T.astype(kind)
        # what rounding may change in a sum of products, many times over
        slack = 1e-4 * (np.abs(queries).astype(kind) @ np.maximum(np.abs(self.low), np.abs(self.high)) + 1)
        active = np.arange(len(queries))
        # what is known of each candidate: values read so far, and what unread ones are at least
        above, below = np.broadcast_to(self.low, self.real.shape).copy(), np.broadcast_to(self.high, self.real.shape).copy()
        seen_above, seen_below = np.zeros(above.shape, bool), np.zeros(above.shape, bool)
        read = 0
        upto = max(int(FIRST * n), min(k + 1, n))
        while True:
            if upto >= n:
                yield from self._all(queries, active, own, ids, k)
                return
            for order, known, seen in ((self.rising[::-1], above, seen_above), (self.rising, below, seen_below)):
                new = order[read:upto]
                np.put_along_axis(known, new, np.take_along_axis(self.real, new, axis=0), axis=0)
                np.put_along_axis(seen, new, True, axis=0)
            read = upto
            last_above = np.take_along_axis(self.real, self.rising[::-1][upto - 1 : upto], axis=0)
            last_below = np.take_along_axis(self.real, self.rising[upto - 1 : upto], axis=0)
            most_above, least_below = np.where(seen_above, above, last_above), np.where(seen_below, below, last_below)
            lower = above @ up[:, active] + below @ down[:, active]
            upper = most_above @ up[:, active] + least_below @ down[:, active]
            same = ids[:, None] == own[active][None, :]
            lower[same], upper[same] = -np.inf, -np.inf
            floor = np.partition(lower, n - k, axis=0)[n - k] if n > k else np.full(len(active), -np.inf, kind)
            open_ = upper + slack[active] >= floor - slack[active]
            open_ &= ~same
            left = open_.sum(axis=0)
            few = left <= max(8 * k, n // 64)
            for i in np.flatnonzero(few):
                contenders = np.flatnonzero(open_[:, i])
                scores = self.vectors[contenders] @ queries[active[i]]
                pick = best(scores, ids[contenders], k)
                yield active[i], contenders[pick], scores[pick]
            active = active[~few]
            if not len(active):
                return
            upto = n if np.median(left[~few]) > HOPELESS * n else 2 * upto

    def _all(self, queries: np.ndarray, active: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int):
        """At the lists' end both bounds are the score, but for rounding."""
        n = len(ids)
        scores = self.real @ queries[active].T.astype(self.real.dtype)
        slack = 1e-4 * (np.abs(queries[active]).astype(scores.dtype) @ np.maximum(np.abs(self.low), np.abs(self.high)) + 1)
        for i, a in enumerate(active):
            score = np.where(ids == own[a], -np.inf, scores[:, i])
            floor = np.partition(score, n - k)[n - k] if n > k else -np.inf
            contenders = np.flatnonzero((score >= floor - 2 * slack[i]) & (ids != own[a]))
            exact = self.vectors[contenders] @ queries[a]
            pick = best(exact, ids[contenders], k)
            yield a, contenders[pick], exact[pick]


def _run(k: int):
    def run(queries: np.ndarray, qid: np.ndarray, block: np.ndarray, cid: np.ndarray):
        lists = SortedLists(block)
        q, c, s = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0, int)]
        for first in range(0, len(queries), BATCH):
            part = slice(first, first + BATCH)
            for i, index, score in lists.batch(queries[part], qid[part], cid, k):
                q.append(np.full(len(index), first + i))
                c.append(index)
                s.append(score)
        return np.concatenate(q), np.concatenate(c), np.concatenate(s)

    return run


def integer_components(rows: DataFrame, scale: int = 256) -> DataFrame:
    return rows.select("vec_id", F.transform("vec", lambda x: F.floor(x * float(scale)).cast("long")).alias("vec"))


def exact_top_k(df: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k candidates of the highest integer inner product, for each query.

    Vectors that are null or hold null or non-finite components take no part,
    nor do rows without an id; vectors meet only those of their own length.
    Equal query rows are one query; a query never meets a row with its own id.
    Ties go to the smaller id. An empty table gives an empty result. Returns
    query_id, rank (from 1), vec_id, score (long).
    """
    return search(integer_components(usable(df, id_col, vec_col)), every, k, _run(k), "long")


ORACLE_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as vec
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id as vec_id,
         cast(list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.vec) = len(c.vec))
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
where rank <= 5
"""
