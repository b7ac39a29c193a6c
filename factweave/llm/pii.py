"""Personal data: patterns propose, checksums confirm, context adjusts.

Everything is a Spark expression. Where a pattern matches, ``split`` gives the
text between matches and ``regexp_extract_all`` the matches; their lengths add
up to positions. Texts without a match cost one scan for each kind. Positions
are running sums, taken in chunks, and nothing is looked up by its place in the
whole text, so the cost of a text grows with its length and its matches.

Patterns use possessive repeats and look behind for the start of a run, so that
a scan is linear in the text. Each finds the same matches as its plain form:
what a possessive repeat takes can never be given back to make a match, and a
match that starts within a run would also start at the run's first character
that no earlier match took.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, running, text_or_empty

#: Characters before and after a match in which context words are looked for.
CONTEXT = 48
#: The least score of a span that the contract's base kinds don't hold already.
THRESHOLD = 0.5


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the value's digits pass the Luhn check."""
    turned = F.reverse(_digits(value))

    def step(acc: Column, i: Column) -> Column:
        d = F.substr(turned, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number passes ISO 7064 mod 97-10, as IBANs do."""
    plain = F.regexp_replace(value, " ", "")
    moved = F.concat(F.substr(plain, F.lit(5), F.length(plain)), F.substr(plain, F.lit(1), F.lit(4)))

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


def small_parts(value: Column) -> Column:
    """Whether all dotted parts are at most 255, leading zeros aside."""
    plain = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(plain, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def _many(low: int, high: int) -> Callable[[Column], Column]:
    return lambda v: F.length(_digits(v)).between(low, high)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A text without this character can't match.
    needs: str | None
    confirm: Callable[[Column], Column]
    score: float
    helps: str = ""
    hurts: str = ""
    #: Base kinds stay whatever their score.
    base: bool = True


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda v: F.lit(True), 0.9, r"mail|contact|write to"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", ".", small_parts, 0.6, r"\bip\b|address|server|host", r"version|release"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", None, lambda v: _many(16, 19)(v) & luhn(v), 0.8, r"card|visa|credit|pay", r"order|serial"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", _many(8, 15), 0.7, r"call|phone|tel|mobile"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", None, mod97, 0.7, r"iban|account|bank|konto|compte|cuenta", r"part no|serial", base=False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", lambda v: ~v.rlike("^(?:000|666|9)"), 0.3, r"ssn|social security", base=False),
)
BASE = tuple(k.name for k in KINDS if k.base)


#: Characters that a text is cut into.
PIECE = 4096


def _ends(text: Column) -> Column:
    """What context can see of a longer text from outside: its first and last CONTEXT characters."""
    return F.when(F.char_length(text) > 2 * CONTEXT, F.concat(F.left(text, F.lit(CONTEXT)), F.right(text, F.lit(CONTEXT)))).otherwise(text)


def _adjusted(kind: Kind, near: Column) -> Column:
    score = F.lit(kind.score)
    if kind.helps:
        score = score + F.when(near.rlike(kind.helps), 0.3).otherwise(0.0)
    if kind.hurts:
        score = score - F.when(near.rlike(kind.hurts), 0.3).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 2)


def _proposed(text: Column, kind: Kind) -> Column:
    """One kind's matches, the text between them, and the numbers of those that its check confirms; null without any."""

    def confirmed(hits: Column) -> Column:
        good = F.filter(F.sequence(F.lit(0), F.size(hits) - 1), lambda i: kind.confirm(F.get(hits, i)))
        parts = lambda g: F.struct(hits.alias("hits"), F.split(text, kind.pattern, -1).alias("gaps"), g.alias("good"))
        return let(good, lambda g: F.when(F.size(g) > 0, parts(g)))

    found = let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), lambda h: F.when(F.size(h) > 0, confirmed(h)))
    return F.when(F.contains(text, F.lit(kind.needs)), found) if kind.needs else found


def _placed(found: Column) -> Column:
    """Places and surroundings of the confirmed matches of one kind."""
    hits, gaps = found["hits"], found["gaps"]
    steps = F.transform(F.sequence(F.lit(0), F.size(hits) - 1), lambda i: F.char_length(F.get(gaps, i)) + F.char_length(F.get(hits, i)))
    # what context can see of gap 0, hit 0, gap 1, ... : CONTEXT of these hold CONTEXT characters, as a hit has two at least
    seen = F.flatten(F.transform(F.sequence(F.lit(0), F.size(hits)), lambda i: F.array(_ends(F.get(gaps, i)), _ends(F.coalesce(F.get(hits, i), F.lit(""))))))

    def place(highs: Column, seen: Column) -> Callable[[Column], Column]:
        def one(i: Column) -> Column:
            before = F.right(F.array_join(F.slice(seen, F.greatest(F.lit(1), 2 * i + 2 - CONTEXT), F.least(F.lit(CONTEXT), 2 * i + 1)), ""), F.lit(CONTEXT))
            after = F.left(F.array_join(F.slice(seen, 2 * i + 3, F.lit(CONTEXT)), ""), F.lit(CONTEXT))
            hit, high = F.get(hits, i), F.get(highs, i)
            near = F.lower(F.concat(before, F.get(seen, 2 * i + 1), after))
            return F.struct((high - F.char_length(hit)).alias("start"), high.alias("end"), hit.alias("value"), near.alias("near"))

        return one

    return let(running(steps, lambda a, x: a + x), lambda highs: let(seen, lambda s: F.transform(found["good"], place(highs, s))))


def _scored(kind: Kind, placed: Column) -> Column:
    spans = F.transform(placed, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), _adjusted(kind, x["near"]).alias("score")))
    return spans if kind.base else F.filter(spans, lambda x: x["score"] >= THRESHOLD)


def find(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """All spans of every whole text, one row for each input row.

    keep: columns to carry along, in a struct ``row`` so that no name clashes.
    A null text counts as empty and has no spans. Repeated rows stay; an empty
    table gives an empty result; texts are never cut. Returns row, content and
    one array of spans for each kind.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), text_or_empty(text_col).alias("content"))
    none = F.array().cast("array<struct<start:int,end:int,value:string,near:string>>")
    found = F.array(*[_proposed(F.col("content"), k) for k in KINDS])
    rows = rows.select("row", "content", F.transform(found, lambda p: F.when(p.isNull(), none).otherwise(_placed(p))).alias("placed"))
    return rows.select("row", "content", *[_scored(k, F.get("placed", F.lit(i))).alias(k.name) for i, k in enumerate(KINDS)])


def _listed(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans, by kind in order, then start, comma-joined."""

    def places(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))

    return F.array_join(F.concat(*map(places, kinds)), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and places of personal data in each document, and the spans' scores in their order."""
    found = find(docs, [id_col], text_col)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in BASE]
    names = tuple(k.name for k in KINDS)
    scores = F.array_join(F.concat(*[F.transform(k, lambda s: s["score"].cast("string")) for k in names]), ",")
    listed = found.select("row.*", *counts, _listed(BASE).alias("base"), _listed(names).alias("spans"), scores.alias("scores"))
    return listed.select(id_col, *[f"n_{k}" for k in BASE], F.sha2("base", 256).alias("base_sha256"), "spans", "scores")


def _between(pieces: Column, low: Column, high: Column) -> Column:
    """The text from code point low to high, from a text's pieces of PIECE code points."""
    first, last = F.floor(low / PIECE).cast("int"), F.floor(high / PIECE).cast("int")
    part = lambda i: F.coalesce(F.get(pieces, i), F.lit(""))
    inside = F.substr(part(first), low % PIECE + 1, high - low)
    across = F.concat(F.substr(part(first), low % PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, first + 2, F.greatest(F.lit(0), last - first - 1)), ""), F.left(part(last), high % PIECE))
    return F.when(first == last, inside).otherwise(across)


def redact(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", least: float = THRESHOLD) -> DataFrame:
    """Replace every span that scores ``least`` or more by its kind in brackets; all rows and columns stay.

    Overlapping spans are one cut, named after the one that starts first. A null
    text stays null. chars_col, if the table has it, is counted anew.
    """
    columns = docs.columns
    found = find(docs, columns, text_col)

    def tagged(kind: Kind) -> Column:
        sure = F.filter(kind.name, lambda s: s["score"] >= least)
        return F.transform(sure, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{kind.name.upper()}]").alias("tag")))

    def cut(spans: Column, reached: Column, pieces: Column) -> Column:
        # a span opens a cut if it starts where all spans before it have ended
        so_far = lambda i: F.coalesce(F.get(reached, i - 1), F.lit(0))
        opening = F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda i: F.get(spans, i)["start"] >= so_far(i))
        parts = F.transform(opening, lambda i: F.concat(_between(pieces, so_far(i), F.get(spans, i)["start"]), F.get(spans, i)["tag"]))
        return F.concat(F.array_join(parts, ""), _between(pieces, F.element_at(reached, -1), F.char_length("content")))

    cuts = F.array_sort(F.concat(*map(tagged, KINDS)))
    pieces = F.regexp_extract_all("content", F.lit("(?s).{1,%d}" % PIECE), F.lit(0))
    ends = lambda spans: running(F.transform(spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x))
    clean = let(cuts, lambda s: F.when(F.size(s) > 0, let(ends(s), lambda r: let(pieces, lambda p: cut(s, r, p)))).otherwise(F.col("content")))
    text = F.when(F.col(f"row.`{text_col}`").isNull(), F.lit(None)).otherwise(clean)
    done = found.select("row", text.alias("clean"))
    out = [F.col("clean").alias(c) if c == text_col else F.char_length("clean").cast("long").alias(c) if c == chars_col else F.col(f"row.`{c}`").alias(c) for c in columns]
    return done.select(*out)
