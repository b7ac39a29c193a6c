"""The scalar function table: a name to a function of Columns.

Null in gives null out, positions count from 1, rounding goes away from zero.
Nothing raises on data: division by zero, bad casts and bad dates give null.
Any callable from Columns to a Column may be added under a name of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    """The number that a text starts with, or null."""
    return F.regexp_extract(c.cast("string"), r"^\s*([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)", 1).try_cast("double")


def date(c: Column) -> Column:
    """A date from a date, a timestamp, or text: year first, or day first."""
    s = c.cast("string")
    first = lambda p, *g: F.concat_ws("-", *[F.lpad(F.regexp_extract(s, p, i), 2, "0") if i != y else F.regexp_extract(s, p, i) for i, y in g])
    iso, slash, day = r"^\s*([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})", r"^\s*([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})", r"^\s*([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})"
    ymd = ((1, 1), (2, 0), (3, 0))
    return F.coalesce(
        F.when(s.rlike(iso), first(iso, *ymd).try_cast("date")),
        F.when(s.rlike(slash), first(slash, *ymd).try_cast("date")),
        F.when(s.rlike(day), first(day, (3, 3), (2, 0), (1, 0)).try_cast("date")),
    )


def divide(a: Column, b: Column) -> Column:
    return F.try_divide(a.try_cast("double"), b.try_cast("double"))


def whole_divide(a: Column, b: Column) -> Column:
    """Truncates towards zero; null where b is zero. Whole numbers beyond 2^53 are divided as decimals, without loss."""
    x, y = a.try_cast("double"), b.try_cast("double")
    q = F.try_divide(x, y)
    exact = F.try_divide(a.try_cast("decimal(19,0)"), b.try_cast("decimal(19,0)")).cast("long")
    large = F.greatest(F.abs(x), F.abs(y)) >= 2.0**53
    return F.when(large, exact).when(q < 0, F.ceil(q).cast("long")).otherwise(F.floor(q).cast("long"))


def _only(ok: Column, value: Column) -> Column:
    return F.when(ok, value)


def _ends(a: Column, b: Column) -> Column:
    return F.endswith(F.lower(a), F.lower(b))


def _both(f: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    """Null if either is null."""
    return lambda a, b: F.when(a.isNotNull() & b.isNotNull(), f(a, b))


def json_object(*pairs: Column) -> Column:
    """A JSON object of keys and values; null values stay."""
    if len(pairs) % 2:
        raise ValueError("jsonObject takes keys and values in pairs")
    return F.to_json(F.struct(*[v.alias(literal(k)) for k, v in zip(pairs[::2], pairs[1::2], strict=True)]), {"ignoreNullFields": "false"})


def literal(c: Column) -> str:
    """A literal column's text; the compiler hands such arguments over as they were written."""
    return getattr(c, "_factweave_text", None) or str(c).removeprefix("Column<'").removesuffix("'>")


FUNCTIONS: dict[str, Callable[..., Column]] = {
    "abs": F.abs,
    "round": lambda x, d=None: F.round(x.cast("double"), d if d is not None else F.lit(0)),
    "floor": lambda x: F.floor(x).cast("long"),
    "ceil": lambda x: F.ceil(x).cast("long"),
    "sqrt": lambda x: _only(x >= 0, F.sqrt(x)),
    "ln": lambda x: _only(x > 0, F.log(x)),
    "log10": lambda x: _only(x > 0, F.log10(x)),
    "exp": F.exp,
    "power": F.pow,
    "div": whole_divide,
    "length": lambda s: F.char_length(s.cast("string")),
    "lower": F.lower,
    "upper": F.upper,
    "substr": lambda s, start, count=None: F.substr(s.cast("string"), start.cast("int"), count.cast("int") if count is not None else F.lit(2**31 - 1)),
    "concat": lambda *xs: F.concat(*[x.cast("string") for x in xs]),
    "instr": lambda s, part: F.call_function("instr", s.cast("string"), part.cast("string")),
    "replace": F.replace,
    "coalesce": F.coalesce,
    "nullif": F.nullif,
    "trim": F.trim,
    "ltrim": F.ltrim,
    "rtrim": F.rtrim,
    "greatest": _both(F.greatest),
    "least": _both(F.least),
    "like": lambda s, p: F.call_function("like", F.lower(s.cast("string")), F.lower(p)),
    "starts_with": lambda s, p: F.startswith(F.lower(s.cast("string")), F.lower(p)),
    "contains": lambda s, p: F.contains(F.lower(s.cast("string")), F.lower(p)),
    "ends_with": lambda s, p: _ends(s.cast("string"), p),
    "year": lambda d: F.year(date(d)),
    "month": lambda d: F.month(date(d)),
    "day": lambda d: F.dayofmonth(date(d)),
    "today": F.current_date,
    "days_between": lambda a, b: F.date_diff(date(a), date(b)),
    "castnumber": number,
    "castinteger": lambda x: number(x).cast("long"),
    "jsonpath": lambda doc, path: F.call_function("get_json_object", doc, path),
    "jsonobject": json_object,
    "json": lambda text: F.to_json(F.try_parse_json(text)),
}
