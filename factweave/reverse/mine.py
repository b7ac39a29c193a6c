"""What the rows say: one value census for each table, and few batched jobs beyond it.

The census lists each column's values with their counts. It is aggregated where
the rows are read, so a value that fills a third of a table costs one row for
each task. Row counts, nulls, distinct counts, domains and most quality findings
are read off it. Candidate keys and references are pruned by counts and bounds
before any join, and joins compare distinct values only.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate, combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sizes of a value domain, how often values must repeat, and how long they may be.
DOMAIN = (2, 25)
REPEATS = 4
LONGEST = 120
#: K9: the least spread of a reference whose name alone does not prove it.
EVEN = 0.2
SENTINELS = ("", "n/a", "na", "null", "none", "unknown", "-", "?", "tbd", "0000-00-00", "9999-12-31")


def plain(df: DataFrame) -> list[str]:
    """Columns whose values can be compared."""
    return [f.name for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType))]


def census(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value, n): every value of every column as text, nulls too."""
    columns = columns or plain(df)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.column", "p.value").agg(F.count(F.lit(1)).alias("n"))


def profile(df: DataFrame) -> DataFrame:
    """K5: (column, rows, nulls, distinct) for each column."""
    return census(df).groupBy("column").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.count("value").alias("distinct"))


@dataclass
class ColumnFacts:
    rows: int
    nulls: int
    distinct: int

    @property
    def never_null(self) -> bool:
        return self.rows > 0 and not self.nulls


def facts(df: DataFrame) -> dict[str, ColumnFacts]:
    found = {r["column"]: ColumnFacts(r["rows"], r["nulls"], r["distinct"]) for r in profile(df).collect()}
    return {c: found[c] for c in plain(df) if c in found}


def has_repeats(df: DataFrame, columns: tuple[str, ...]) -> bool:
    """Whether some combination of values occurs twice."""
    return not df.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).isEmpty()


#: Rows that refute most combinations before any pass over the whole table.
REFUTING = 2000
#: Rows of the share by which one pass refutes most of the rest, at least, for each combination.
SHARE = 100_000
#: Rows that one task groups.
TASK_ROWS = 1_000_000
#: Repeated rows of a combination within which larger ones are tried instead of in all rows.
FEW = 1_000_000


def unique_sets(df: DataFrame, known: dict[str, ColumnFacts], arity: int = 3) -> list[tuple[str, ...]]:
    """K6: minimal unique column combinations of never-null columns, of at most ``arity`` columns.

    A combination is looked at only if the product of its columns' distinct
    counts reaches the number of rows and no part of it is unique already. One
    that repeats in REFUTING rows, or in the share that its hash picks, is not
    unique. What is left is tried on all rows; where a part of it repeats in few
    rows only, on these, as rows that differ in a part differ.
    """
    rows = next(iter(known.values())).rows if known else 0
    if not rows:
        return []
    columns = [c for c, k in known.items() if k.never_null and k.distinct > 1]
    found = [(c,) for c in columns if known[c].distinct == rows]
    rest = [c for c in columns if (c,) not in found]
    some = df.select(*[F.col(f"`{c}`") for c in rest]).limit(REFUTING).collect() if len(rest) > 1 else []
    left = []
    for size in range(2, arity + 1):
        for combo in combinations(rest, size):
            reach = 1
            for c in combo:
                reach *= known[c].distinct
            if reach >= rows and len({tuple(r[c] for c in combo) for r in some}) == len(some):
                left.append(combo)
    refuted = repeating(df, left, rows)
    left = [c for c in left if c not in refuted]
    repeated: dict[tuple[str, ...], DataFrame | None] = {}
    for size in range(2, arity + 1):
        unique: dict[tuple[str, ...], bool] = {}
        tried = [c for c in left if len(c) == size and not any(set(u) <= set(c) for u in found)]
        while open_ := [c for c in tried if c not in unique]:
            # the part that most of them have, if it is worth a pass or has had one
            shared = Counter(p for c in open_ for p in combinations(c, size - 1) if size > 2 and repeated.get(p, df) is not None)
            part = max(shared, key=lambda p: (shared[p] > 1, p in repeated, shared[p]), default=None)
            if part and (shared[part] > 1 or part in repeated):
                if part not in repeated:
                    repeated[part] = few_repeats(repeats(df, part, rows))
                if repeated[part] is not None:
                    unique |= unique_within(df, part, repeated[part], [c for c in open_ if set(part) <= set(c)])
            else:
                groups = repeats(df, open_[0], rows)
                unique[open_[0]] = groups.isEmpty()
                repeated[open_[0]] = few_repeats(groups)
        found += [c for c in tried if unique[c]]
    return found


def repeating(df: DataFrame, combos: list[tuple[str, ...]], rows: int) -> set[tuple[str, ...]]:
    """Combinations that repeat within their shares of the rows; all are looked for in one pass.

    A share is what a combination's hash picks, so rows that are equal in it are
    picked together. Rows count as equal by 128 bits of hashes.
    """
    if not combos:
        return set()
    columns = sorted({c for combo in combos for c in combo})
    place = {c: k for k, c in enumerate(columns)}
    mask = (1 << max(0, (rows // SHARE).bit_length() - 1)) - 1
    places = [[place[c] for c in combo] for combo in combos]
    hashed = df.select(*[F.xxhash64(F.lit(f"{h}{k}"), F.col(f"`{c}`")).alias(f"{h}{k}") for h in "xy" for c, k in place.items()])

    def pick(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x, y = ([batch.column(k + at).to_numpy() for k in range(len(place))] for at in (0, len(place)))
            out = []
            for i, at in enumerate(places):
                mixed = np.bitwise_xor.reduce([x[k] for k in at])
                rows = np.flatnonzero((mixed & mask) == 0)
                out.append((np.full(len(rows), i), mixed[rows], np.bitwise_xor.reduce([y[k][rows] for k in at])))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], ["i", "x", "y"])

    groups = hashed.mapInArrow(pick, "i long, x long, y long").groupBy("i", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    return {combos[r["i"]] for r in groups.where("n > 1").select("i").distinct().collect()}


def repeats(df: DataFrame, combo: tuple[str, ...], rows: int) -> DataFrame:
    """The values of a combination that occur in several rows, and in how many, dealt to more tasks the more rows there are."""
    from ..sources.scratch import materialise

    cols = [F.col(f"`{c}`") for c in combo]
    wanted = -(-rows // TASK_ROWS)
    part = df.select(*cols)
    part = part.repartition(wanted, *cols) if wanted > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else part
    groups = part.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return materialise(groups.toDF(*[f"k{i}" for i in range(len(combo))], "n"), "repeats")


def few_repeats(groups: DataFrame) -> DataFrame | None:
    """The same groups, if they have FEW rows at most."""
    return groups if (groups.agg(F.sum("n").alias("n")).first()["n"] or 0) <= FEW else None


def unique_within(df: DataFrame, part: tuple[str, ...], groups: DataFrame, combos: list[tuple[str, ...]]) -> dict[tuple[str, ...], bool]:
    """Whether combinations that have a part in common are unique, by the rows in which that part repeats."""
    columns = sorted({c for combo in combos for c in combo})
    keys = reduce(Column.__and__, [F.col(f"`{c}`").eqNullSafe(F.col(f"k{i}")) for i, c in enumerate(part)])
    some = df.select(*[F.col(f"`{c}`") for c in columns]).join(groups.drop("n"), keys, "left_semi")
    row = some.agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(F.struct(*[F.col(f"`{c}`") for c in combo])).alias(f"d{i}") for i, combo in enumerate(combos)]).first()
    return {combo: row[f"d{i}"] == row["n"] for i, combo in enumerate(combos)}


def same_kind(a: str, b: str) -> bool:
    group = lambda t: "number" if re.match(r"(tiny|small|big)?int|long|short|byte|decimal|double|float", t) else "text" if t in ("string", "varchar", "char") else t
    return group(a) == group(b)


def bounds(df: DataFrame, columns: list[str]) -> dict[str, tuple]:
    row = df.agg(*[f(f"`{c}`").alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("low", F.min), ("high", F.max))]).first()
    return {c: (row[f"low{i}"], row[f"high{i}"]) for i, c in enumerate(columns)}


@dataclass
class Inclusion:
    child: str
    column: str
    parent: str
    key: str
    score: float
    spread: float | None


def name_parts(name: str) -> list[str]:
    return [p.lower() for p in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", name)]


def name_score(table: str, column: str, parent: str, key: str) -> float:
    """How much a column's name says that it refers to a key."""
    c, k, p = name_parts(column), name_parts(key), name_parts(parent)
    score = 0.0
    if c[-1:] == k[-1:] and c:
        score += 2.0
    if column.lower() == key.lower():
        score += 1.0
    singular = p[-1].rstrip("s") if p else ""
    if singular and any(singular in x or (len(x) > 2 and x in singular) for x in c):
        score += 2.0
    if len(c) > 1 and len(k) > 1 and c[1:] == k[1:]:
        score += 2.0
    return score


def inclusions(tables: dict[str, DataFrame], known: dict[str, dict[str, ColumnFacts]], keys: dict[str, tuple[str, ...]], least_rows: int = 50, least_values: int = 3, threshold: float = 2.6) -> list[Inclusion]:
    """K8: references that the rows allow and the names support; for each column, the best.

    A pair is compared only if types agree, the child's bounds lie within the
    parent's, and the child has no more distinct values; then distinct values
    are anti-joined. A table's own key is never taken for a reference.
    """
    kinds = {t: {f.name: f.dataType.simpleString() for f in df.schema} for t, df in tables.items()}
    pairs = []
    for child in tables:
        for column, facts_ in known[child].items():
            if facts_.rows < least_rows or facts_.distinct < least_values:
                continue
            for parent, key in keys.items():
                # a table's own key refers to another table only as a subtype's does: under the same name
                own = (column,) == keys.get(child)
                if len(key) != 1 or parent == child or own and (column != key[0] or facts_.rows >= known[parent][column].rows):
                    continue
                score = name_score(child, column, parent, key[0])
                if score >= threshold and same_kind(kinds[child][column], kinds[parent][key[0]]) and facts_.distinct <= known[parent][key[0]].distinct:
                    pairs.append((child, column, parent, key, score))
    asked: dict[str, dict[str, None]] = {}
    for child, column, parent, key, _ in pairs:
        asked.setdefault(child, {})[column] = None
        asked.setdefault(parent, {})[key[0]] = None
    limits = {t: bounds(tables[t], list(columns)) for t, columns in asked.items()}
    best: dict[tuple[str, str], Inclusion] = {}
    for child, column, parent, key, score in pairs:
        (a, b), (low, high) = limits[child][column], limits[parent][key[0]]
        if a is None or low is None or a < low or b > high or (child, column) in best and best[child, column].score >= score:
            continue
        if not missing(tables[child], (column,), tables[parent], key).limit(1).isEmpty():
            continue
        even = spread(tables[child], column, tables[parent], key[0])
        # an unknown spread rejects nothing; values at one end of the parent's order are there by chance, as counters that start at 1 are
        if even is not None and even < EVEN and score < 5:
            continue
        best[child, column] = Inclusion(child, column, parent, key[0], score, even)
    return list(best.values())


def missing(child: DataFrame, columns: tuple[str, ...], parent: DataFrame, references: tuple[str, ...]) -> DataFrame:
    names = [f"k{i}" for i in range(len(columns))]
    left = child.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(columns, names, strict=True)]).dropna().distinct()
    return left.join(parent.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(references, names, strict=True)]), names, "left_anti")


def spread(child: DataFrame, column: str, parent: DataFrame, key: str) -> float | None:
    """K9: 1 - 2 W1, how evenly the child's values lie over the parent's order: 1 is even, 0 is one end.

    Both sides are distinct values; quantiles of the child's percent ranks are compared with an even spread. The
    parent's keys are sorted by ranges and ranked within each, so no task holds them all. None: too few values to tell.
    """
    from ..sources.scratch import materialise

    ordered = parent.select(F.col(f"`{key}`").alias("k")).dropna().distinct().orderBy("k")
    # the id holds the range in its upper bits, and the place within the range in the lower 33
    ordered = materialise(ordered.select("k", F.monotonically_increasing_id().alias("id")), "ranks")
    ranges = ordered.groupBy(F.shiftright("id", 33).alias("range")).agg(F.count(F.lit(1)).alias("n")).orderBy("range").collect()
    n = sum(r["n"] for r in ranges)
    if n < 5:
        return None
    starts = child.sparkSession.createDataFrame([(r["range"], t - r["n"]) for r, t in zip(ranges, accumulate(r["n"] for r in ranges), strict=True)], "range long, start long")
    place = F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    ranked = ordered.join(starts, F.shiftright("id", 33) == F.col("range")).select("k", ((F.col("start") + place) / (n - 1)).alias("p"))
    hit = child.select(F.col(f"`{column}`").alias("k")).dropna().distinct().join(ranked, "k")
    row = hit.agg(F.percentile_approx("p", [i / 20 for i in range(21)]).alias("q"), F.count(F.lit(1)).alias("n")).first()
    if row["n"] < 3:
        return None
    return 1 - 2 * sum(abs(q - i / 20) for i, q in enumerate(row["q"])) / 21


def choose_key(table: str, df: DataFrame, sets: list[tuple[str, ...]], others: dict[str, list[str]], threshold: float = 5.0) -> tuple[str, ...]:
    """K7: the candidate that best looks like a key; none if none is good enough or two are as good."""
    order = df.columns
    scored = []
    for u in sets:
        score = 0.0
        if len(u) == 1:
            parts = name_parts(u[0])
            if parts and parts[-1] in ("id", "key", "nr", "no", "code", "num", "number") or parts and parts[-1].endswith(("key", "id")):
                score += 4
            if order[0] == u[0]:
                score += 2
            stem = name_parts(table)[-1].rstrip("s") if name_parts(table) else ""
            if stem and any(stem.startswith(x) or x.startswith(stem) for x in parts if len(x) > 1):
                score += 1
            if isinstance(df.schema[u[0]].dataType, (T.IntegerType, T.LongType, T.ShortType)):
                score += 1
            if isinstance(df.schema[u[0]].dataType, (T.DoubleType, T.FloatType, T.TimestampType, T.TimestampNTZType)):
                score -= 4
            if any(u[0] == k and t != table for t, ks in others.items() for k in ks):
                score -= 3
        elif list(u) == order[: len(u)]:
            score += 5
        scored.append((score, u))
    good = sorted((s for s in scored if s[0] >= threshold), reverse=True)
    if not good or len(good) > 1 and good[0][0] == good[1][0]:
        return ()
    return good[0][1]


def domains(df: DataFrame, low: int = DOMAIN[0], high: int = DOMAIN[1]) -> DataFrame:
    """(column, value, n) for columns of few, often repeated, short values; sentinels are left out."""
    values = census(df).where(F.col("value").isNotNull() & ~F.lower(F.trim("value")).isin(*SENTINELS))
    by = Window.partitionBy("column")
    sized = values.select("column", "value", "n", F.count(F.lit(1)).over(by).alias("size"), F.sum("n").over(by).alias("total"), F.max(F.length("value")).over(by).alias("long"))
    return sized.where((F.col("size").between(low, high)) & (F.col("total") >= REPEATS * F.col("size")) & (F.col("long") <= LONGEST)).select("column", "value", "n")


def dependencies(df: DataFrame, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """(determinant, dependent, groups, broken): how many groups of the first have several values of the second.

    All pairs are counted in one aggregation over distinct pairs of values.
    """
    columns = plain(df)
    pairs = pairs or [(a, b) for a in columns for b in columns if a != b]
    rows = F.array(*[F.struct(F.lit(a).alias("determinant"), F.lit(b).alias("dependent"), F.col(f"`{a}`").cast("string").alias("x"), F.col(f"`{b}`").cast("string").alias("y")) for a, b in pairs])
    each = df.select(F.explode(rows).alias("p")).select("p.*").where("x is not null").distinct()
    groups = each.groupBy("determinant", "dependent", "x").agg(F.count(F.lit(1)).alias("n"))
    return groups.groupBy("determinant", "dependent").agg(F.count(F.lit(1)).alias("groups"), F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("broken"))


def null_patterns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(left, right, rows, both, neither, one) for each pair of columns, in one pass.

    both = 0 with neither = 0 is an exclusion that covers all rows; one = 0 is equality.
    """
    columns = columns or plain(df)
    pairs = list(combinations(columns, 2))
    filled = lambda c: F.col(f"`{c}`").isNotNull()
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    totals = df.agg(F.count(F.lit(1)).alias("rows"), *[x for i, (a, b) in enumerate(pairs) for x in (count(filled(a) & filled(b)).alias(f"both{i}"), count(~filled(a) & ~filled(b)).alias(f"neither{i}"))])
    out = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col("rows"), F.col(f"both{i}").alias("both"), F.col(f"neither{i}").alias("neither"), (F.col("rows") - F.col(f"both{i}") - F.col(f"neither{i}")).alias("one")) for i, (a, b) in enumerate(pairs)])
    return totals.select(F.explode(out).alias("p")).select("p.*")


def comparisons(df: DataFrame, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """(low, high, rows, broken): pairs of columns of which the first never exceeds the second."""
    if pairs is None:
        kinds = {f.name: f.dataType for f in df.schema}
        times = [c for c, k in kinds.items() if isinstance(k, (T.DateType, T.TimestampType, T.TimestampNTZType))]
        ends = [c for c, k in kinds.items() if isinstance(k, T.NumericType) and re.search(r"min|low|from|start", c, re.I)]
        pairs = [(a, b) for a in times for b in times if a != b] + [(a, b) for a in ends for b in kinds if a != b and isinstance(kinds[b], T.NumericType) and re.search(r"max|high|to$|end", b, re.I)]
    if not pairs:
        return df.sparkSession.createDataFrame([], "low string, high string, rows long, broken long")
    over = lambda a, b: F.sum(F.when(F.col(f"`{a}`") > F.col(f"`{b}`"), 1).otherwise(0))
    both = lambda a, b: F.sum(F.when(F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull(), 1).otherwise(0))
    row = df.agg(*[x for i, (a, b) in enumerate(pairs) for x in (both(a, b).alias(f"rows{i}"), over(a, b).alias(f"broken{i}"))])
    out = F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b).alias("high"), F.col(f"rows{i}").alias("rows"), F.col(f"broken{i}").alias("broken")) for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(out).alias("p")).select("p.*")


def computed(df: DataFrame, tolerance: float = 1e-9, skip: tuple[str, ...] = (), at_once: int = 120) -> list[str]:
    """Columns that are a sum, difference or product of two others in every row.

    skip: columns that are no measures, as keys and references are. All formulas are tried, ``at_once`` in an aggregation.
    Formulas that a bounded sample refutes are dropped before the passes that verify the rest over all rows.
    """
    numbers = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]
    forms = [(t, a, op, b) for t in numbers for a, b in combinations([c for c in numbers if c != t], 2) for op in "*+-"]
    value = lambda a, op, b: {"*": F.col(f"`{a}`") * F.col(f"`{b}`"), "+": F.col(f"`{a}`") + F.col(f"`{b}`"), "-": F.col(f"`{a}`") - F.col(f"`{b}`")}[op]
    off = lambda t, a, op, b: F.sum(F.when(F.abs(F.col(f"`{t}`") - value(a, op, b)) > tolerance * F.greatest(F.lit(1.0), F.abs(F.col(f"`{t}`"))), 1).otherwise(0))
    for rows in (df.limit(500), df):
        kept = []
        for k in range(0, len(forms), at_once):
            part = forms[k : k + at_once]
            row = rows.agg(*[off(*f).alias(f"f{i}") for i, f in enumerate(part)], F.count(F.lit(1)).alias("n")).first()
            if not row["n"]:
                return []
            kept += [f for i, f in enumerate(part) if not row[f"f{i}"]]
        forms = kept
    return [f"{t} = {a} {op} {b}" for t, a, op, b in forms] + joined_texts(df, skip, at_once)


#: What joined texts usually stand between.
SEPARATORS = ("", " ", "-", "_", "/", ", ", ":")


def joined_texts(df: DataFrame, skip: tuple[str, ...] = (), at_once: int = 120) -> list[str]:
    """Text columns that are two others with a separator between them, in every row."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in skip]
    forms = [(t, a, sep, b) for t in texts for a in texts for b in texts if len({t, a, b}) == 3 for sep in SEPARATORS]
    off = lambda t, a, sep, b: F.sum(F.when(F.col(f"`{t}`").eqNullSafe(F.concat(F.col(f"`{a}`"), F.lit(sep), F.col(f"`{b}`"))), 0).otherwise(1))
    for rows in (df.limit(500), df):
        kept = []
        for k in range(0, len(forms), at_once):
            part = forms[k : k + at_once]
            row = rows.agg(*[off(*f).alias(f"f{i}") for i, f in enumerate(part)], F.count(F.lit(1)).alias("n")).first()
            kept += [f for i, f in enumerate(part) if row["n"] and not row[f"f{i}"]]
        forms = kept
    return [f"{t} = {a} || '{sep}' || {b}" for t, a, sep, b in forms]


def stored_aggregates(parent: DataFrame, key: str, child: DataFrame, reference: str, tolerance: float = 1e-6) -> list[str]:
    """Parent columns that hold a count or a sum over the child's rows, for parents that have any."""
    numbers = [f.name for f in child.schema if isinstance(f.dataType, T.NumericType) and f.name != reference]
    sums = child.groupBy(F.col(f"`{reference}`").alias("k")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"`{c}`").alias(f"s{i}") for i, c in enumerate(numbers)])
    joined = parent.join(sums, parent[key] == sums["k"])
    targets = [f.name for f in parent.schema if isinstance(f.dataType, T.NumericType) and f.name != key]
    tests = [(t, "n", f"count of rows by {reference}") for t in targets] + [(t, f"s{i}", f"sum of {c} by {reference}") for t in targets for i, c in enumerate(numbers)]
    if not tests:
        return []
    off = lambda t, s: F.sum(F.when(F.abs(F.col(f"`{t}`") - F.col(s)) > tolerance * F.greatest(F.lit(1.0), F.abs(F.col(s))), 1).otherwise(0))
    row = joined.agg(F.count(F.lit(1)).alias("rows"), *[off(t, s).alias(f"x{i}") for i, (t, s, _) in enumerate(tests)]).first()
    return [f"{t} = {said}" for i, (t, _, said) in enumerate(tests) if row["rows"] and not row[f"x{i}"]]


def ring(df: DataFrame, child: str, parent: str) -> dict[str, bool]:
    """Whether a self-reference is irreflexive, and acyclic: whether peeling leaves, until a round peels none, empties it."""
    from ..sources.scratch import materialise

    edges = df.select(F.col(f"`{child}`").alias("a"), F.col(f"`{parent}`").alias("b")).dropna().distinct()
    irreflexive = edges.where("a = b").limit(1).isEmpty()
    left = edges.count()
    while left:
        edges = materialise(edges.join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"), "ring")
        now = edges.count()
        if now == left:
            break
        left = now
    return {"irreflexive": irreflexive, "acyclic": not left}


def coded(df: DataFrame, known: dict[str, ColumnFacts]) -> list[str]:
    """Alternate keys, unique never-null texts of one width that look like codes."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and known[f.name].never_null and known[f.name].distinct == known[f.name].rows]
    if not texts:
        return []
    row = df.agg(*[x for i, c in enumerate(texts) for x in (F.min(F.length(f"`{c}`")).alias(f"a{i}"), F.max(F.length(f"`{c}`")).alias(f"b{i}"), F.sum(F.when(F.col(f"`{c}`").rlike("^[A-Z0-9#_-]+$"), 0).otherwise(1)).alias(f"x{i}"))]).first()
    return [c for i, c in enumerate(texts) if row[f"a{i}"] == row[f"b{i}"] and not row[f"x{i}"]]


def junk_dimension(known: dict[str, ColumnFacts], key: tuple[str, ...]) -> bool:
    """A small table that only lists combinations of flags."""
    flags = [c for c in known if c not in key]
    rows = next(iter(known.values())).rows if known else 0
    reach = 1
    for c in flags:
        reach *= max(1, known[c].distinct)
    return 3 <= len(flags) <= 12 and 0 < rows <= 1000 and all(known[c].distinct <= 12 for c in flags) and rows <= reach


def quality(df: DataFrame) -> DataFrame:
    """(column, finding, values, rows) of values that look wrong, off the census."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    schema = "column string, finding string, values long, rows long"
    if not texts:
        return df.sparkSession.createDataFrame([], schema)
    values = census(df, texts).where("value is not null")
    v = F.col("value")
    kinds = {
        "padded": v != F.trim(v),
        "sentinel for null": F.lower(F.trim(v)).isin(*SENTINELS),
        "number as text": v.rlike(r"^\s*[-+]?[0-9]+(\.[0-9]+)?\s*$"),
        "date as text": v.rlike(r"^\s*([0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})"),
        "empty": v == "",
    }
    found = F.array_compact(F.array(*[F.when(test, F.lit(k)) for k, test in kinds.items()]))
    direct = values.select("column", F.explode(found).alias("finding"), "n").groupBy("column", "finding").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("rows"))
    folded = values.groupBy("column", F.lower(F.regexp_replace(F.trim(v), r"[\s._-]+", " ")).alias("k")).agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n")).where("m > 1")
    variants = folded.groupBy("column").agg(F.sum("m").alias("values"), F.sum("n").alias("rows")).select("column", F.lit("variants in case or spacing").alias("finding"), "values", "rows")
    sized = values.groupBy("column").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("rows"))
    constant = sized.where("values = 1 and rows > 1").select("column", F.lit("constant").alias("finding"), "values", "rows")
    shapes = values.select("column", "n", F.when(v.rlike("^[0-9]{4}-"), "year first").when(v.rlike("^[0-9]{4}/"), "year first, slashes").when(v.rlike("^[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4}"), "year last").alias("shape")).where("shape is not null")
    mixed = shapes.groupBy("column").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("rows"), F.count_distinct("shape").alias("k")).where("k > 1").select("column", F.lit("dates in several formats").alias("finding"), "values", "rows")
    whole = df.agg(F.count(F.lit(1)).alias("whole"))
    sparse = sized.crossJoin(F.broadcast(whole)).where(F.col("rows") < SPARSE * F.col("whole")).select("column", F.lit("sparse").alias("finding"), "values", "rows")
    rare = spellings(values)
    return direct.union(variants).union(constant).union(mixed).union(sparse).union(rare)


#: A column is sparse if it is filled in fewer rows; a rare value is a misspelling of a common one that is so many times as frequent.
SPARSE = 0.05
COMMON = 20


def spellings(values: DataFrame) -> DataFrame:
    """Rare values that differ from a common one of the same column in one letter, as one finding a column.

    Values meet by what is left of them without one letter or none, so that no
    pair is made but of values that are as near. A rare value has no digit, so
    no digit is left of both; a common one occurs COMMON times at least.
    """
    places = cuts(values)
    best = places.where(F.col("n") >= COMMON).groupBy("column", "left").agg(F.max("n").alias("most"), F.max_by("value", "n").alias("common"))
    rare = places.where(~F.col("value").rlike("[0-9]"))
    near = rare.join(best, ["column", "left"]).where((F.col("value") != F.col("common")) & (F.col("most") >= COMMON * F.col("n")))
    once = near.groupBy("column", "value").agg(F.min("n").alias("n"))
    return once.groupBy("column").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("rows")).select("column", F.lit("near a common value").alias("finding"), "values", "rows")


def cuts(values: DataFrame) -> DataFrame:
    """(column, value, n, left): what is left of each value without one letter or none, where no digit is left."""
    short = values.where(F.length("value").between(4, LONGEST) & ~F.col("value").rlike("[0-9][^0-9]*[0-9]")).select("column", "value", "n")
    cut = F.transform(F.sequence(F.lit(0), F.length("value")), lambda i: F.concat(F.left("value", i - 1), F.substr(F.col("value"), i + 1, F.length("value"))))
    return short.select("column", "value", "n", F.explode(F.array_distinct(cut)).alias("left")).where(~F.col("left").rlike("[0-9]"))


def storage_types(df: DataFrame, columns: list[str] | None = None) -> dict[str, str]:
    """The type that every value of a text column has, where there is one."""
    columns = columns or [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not columns:
        return {}
    tests = ("bigint", "double", "date", "boolean")
    fits = lambda c, t: F.sum(F.when(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(t).isNull(), 1).otherwise(0))
    row = df.agg(*[fits(c, t).alias(f"{t}{i}") for i, c in enumerate(columns) for t in tests], *[F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(columns)]).first()
    return {c: next((t for t in tests if row[f"n{i}"] and not row[f"{t}{i}"]), "string") for i, c in enumerate(columns)}


def json_shape(df: DataFrame, column: str, most_keys: int = 40, depth: int = 4, stable: float = 0.6) -> tuple[str, dict[str, str]]:
    """Whether a document column holds records, maps or neither, and a record's leaves with their types.

    Keys and leaf types are counted over all rows, level by level.
    """
    level = df.select(F.col(f"`{column}`").alias("doc"), F.lit("$").alias("at")).where("doc is not null")
    total = level.count()
    if not total:
        return "bag", {}
    leaves: dict[str, str] = {}
    shape = "bag"
    for d in range(depth):
        keys = F.json_object_keys("doc")
        inner = level.where(keys.isNotNull()).select("doc", "at", F.explode(keys).alias("key"))
        inner = inner.select(F.concat("at", F.lit("."), "key").alias("at"), F.call_function("get_json_object", F.col("doc"), F.concat(F.lit("$['"), F.col("key"), F.lit("']"))).alias("doc"))
        if d == 0 and level.where(keys.isNotNull()).count() < stable * total:
            return "bag", {}
        kind = F.when(F.json_object_keys("doc").isNotNull(), "object").when(F.json_array_length("doc").isNotNull(), "array").when(F.col("doc").rlike(r"^-?[0-9]+$"), "bigint").when(F.col("doc").try_cast("double").isNotNull(), "double").when(F.col("doc").isin("true", "false"), "boolean").otherwise("string")
        counted = inner.where("doc is not null").groupBy("at", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n")).collect()
        by_path: dict[str, dict[str, int]] = {}
        for r in counted:
            by_path.setdefault(r["at"], {})[r["kind"]] = r["n"]
        if d == 0:
            if len(by_path) > most_keys or by_path and max(sum(k.values()) for k in by_path.values()) < stable * total:
                return "map", {}
            shape = "record" if by_path else "bag"
        for path, kinds in by_path.items():
            kinds.pop("array", None)
            if set(kinds) == {"bigint", "double"}:
                kinds = {"double": 1}
            if "object" not in kinds and kinds:
                leaves[path] = next(iter(kinds)) if len(kinds) == 1 else "string"
        nested = [p for p, kinds in by_path.items() if "object" in kinds]
        if not nested:
            break
        level = inner.where(F.col("at").isin(*nested))
    return shape, dict(sorted(leaves.items()))


def shared_pairs(a: DataFrame, b: DataFrame, columns: tuple[str, str]) -> dict[str, bool]:
    """Whether a pair of columns is unique in both tables and contained in one."""
    return {"unique_left": not has_repeats(a, columns), "unique_right": not has_repeats(b, columns), "contained": missing(a, columns, b, columns).limit(1).isEmpty()}


def routes_agree(start: DataFrame, key: str, first: DataFrame, second: DataFrame) -> DataFrame:
    """(agree, differ, only_first, only_second) of two routes given as (key, end) pairs."""
    pairs = lambda df, n: df.select(F.col(df.columns[0]).alias("k"), F.col(df.columns[1]).alias("e")).dropna().groupBy("k").agg(F.sort_array(F.collect_set("e")).alias(n))
    both = start.select(F.col(f"`{key}`").alias("k")).distinct().join(pairs(first, "x"), "k", "left").join(pairs(second, "y"), "k", "left")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return both.agg(n(F.col("x") == F.col("y")).alias("agree"), n(F.col("x") != F.col("y")).alias("differ"), n(F.col("x").isNotNull() & F.col("y").isNull()).alias("only_first"), n(F.col("x").isNull() & F.col("y").isNotNull()).alias("only_second"))


def structure(child: DataFrame, reference: str, parent: DataFrame, key: str) -> DataFrame:
    """(parents, covered, rows, most): how a child covers its parent, and its largest group."""
    groups = child.where(F.col(f"`{reference}`").isNotNull()).groupBy(F.col(f"`{reference}`").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    joined = parent.select(F.col(f"`{key}`").alias("k")).distinct().join(groups, "k", "left")
    return joined.agg(F.count(F.lit(1)).alias("parents"), F.count("n").alias("covered"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))


def joint_nulls(df: DataFrame, known: dict[str, ColumnFacts]) -> list[tuple[tuple[str, ...], int]]:
    """Groups of columns, two at least, that are null in exactly the same rows."""
    columns = [c for c, k in known.items() if 0 < k.nulls < k.rows]
    by_count: dict[int, list[str]] = {}
    for c in columns:
        by_count.setdefault(known[c].nulls, []).append(c)
    out = []
    for nulls, group in by_count.items():
        if len(group) < 2:
            continue
        same = {(r["left"], r["right"]) for r in null_patterns(df, group).collect() if not r["one"]}
        left = list(group)
        while left:
            own = tuple([left[0], *[c for c in left[1:] if (left[0], c) in same]])
            left = [c for c in left if c not in own]
            if len(own) > 1:
                out.append((own, nulls))
    return out


def marked_rows(df: DataFrame, known: dict[str, ColumnFacts]) -> list[tuple[str, str]]:
    """(flag, group): two-valued columns of which one value occurs once in every group of another column, and groups have other rows too."""
    flags = [c for c, k in known.items() if k.distinct == 2 and not k.nulls]
    groups = [c for c, k in known.items() if c not in flags and k.never_null and 1 < k.distinct and 2 * k.distinct <= k.rows]
    found = []
    for flag in flags:
        shares = {r["value"]: r["n"] for r in census(df, [flag]).collect()}
        rare = min(sorted(shares), key=shares.__getitem__)
        for group in groups:
            if shares[rare] == known[group].distinct:
                once = df.where(F.col(f"`{flag}`").cast("string") == rare).groupBy(f"`{group}`").agg(F.count(F.lit(1)).alias("n"))
                if once.where("n > 1").limit(1).isEmpty():
                    found.append((flag, group))
    return found


def partition_or_subtype(child: DataFrame, parent: DataFrame, share: float = 0.995) -> str:
    """A one-to-one table with almost all of the parent's rows is the rest of it; else a subtype."""
    return "partition" if child.count() >= share * parent.count() else "subtype"


def document_quality(df: DataFrame, column: str, leaves: dict[str, str]) -> DataFrame:
    """The findings of ``quality`` for the leaves of a document column, by path."""
    paths = [F.get_json_object(F.col(f"`{column}`"), p).alias(p.removeprefix("$.").replace(".", "_")) for p in leaves]
    if not paths:
        return df.sparkSession.createDataFrame([], "column string, finding string, values long, rows long")
    return quality(df.select(*paths))


def referenced_key(df: DataFrame, known: dict[str, ColumnFacts], key: tuple[str, ...], references: list[tuple[str, ...]]) -> tuple[str, ...]:
    """The unique, never-null columns that most references use, rather than a key that none does."""
    counts = {r: references.count(r) for r in set(references)}
    usable = [r for r in counts if all(known[c].never_null for c in r) and not has_repeats(df, r)]
    if not usable or key in counts:
        return key
    return max(sorted(usable), key=counts.__getitem__)
