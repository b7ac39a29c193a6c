"""Chat formatting with collapse of cumulative snapshots.

Loggers often store a conversation again after every turn. A rolling hash of
each prefix of turns identifies conversations that are a prefix of a longer
one; an anti-join removes them, and what is left is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running

TEMPLATE = ("<|im_start|>", "\n", "<|im_end|>\n")


def _plain(docs: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"))


def _tags(turns: Column, seed: str) -> Column:
    """A 64-bit hash for each turn, which covers its place."""
    return F.transform(turns, lambda t, i: F.xxhash64(F.lit(seed), i + 1, t["role"], F.lit("\0"), t["text"]))


def whole(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) with the sorted turns of each conversation: the one move of the texts."""
    item = F.struct(F.col("turn").isNotNull().alias("k"), "turn", "role", "text")
    return turns.where("conv_id is not null").repartition("conv_id").groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("turns"))


def prefixes(convs: DataFrame) -> DataFrame:
    """(conv_id, pos, n_turns, ha, hb): two 64-bit rolling hashes of the first pos turns, the xor of the turns' hashes."""
    rolled = lambda seed: running(_tags(F.col("turns"), seed), lambda a, x: a.bitwiseXOR(x), "bigint")
    both = convs.select("conv_id", F.size("turns").alias("n_turns"), F.arrays_zip(rolled("a").alias("ha"), rolled("b").alias("hb")).alias("hashes"))
    return both.select("conv_id", "n_turns", F.posexplode("hashes").alias("pos", "h")).select("conv_id", (F.col("pos") + 1).alias("pos"), "n_turns", "h.ha", "h.hb")


def lone(turns: DataFrame) -> DataFrame:
    """Different turns without a conversation: (role, text, copies, ha, hb), as conversations of one turn."""
    rows = turns.where("conv_id is null").groupBy("role", "text").agg(F.count(F.lit(1)).alias("copies"))
    own = F.array(F.struct("role", "text"))
    return rows.select("role", "text", "copies", _tags(own, "a")[0].alias("ha"), _tags(own, "b")[0].alias("hb"))


def maximal(known: DataFrame, single: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, ha, hb) of conversations that no longer one extends."""
    ends = known.where("pos = n_turns").select("pos", "ha", "hb", "conv_id", F.lit(1).cast("long").alias("copies"))
    ends = ends.union(single.select(F.lit(1), "ha", "hb", F.lit(None).cast(known.schema["conv_id"].dataType), "copies"))
    ends = ends.groupBy("pos", "ha", "hb").agg(F.min("conv_id").alias("conv_id"), F.sum("copies").alias("n_copies"))
    inner = known.where("pos < n_turns").select("pos", "ha", "hb").distinct()
    return ends.join(inner, ["pos", "ha", "hb"], "left_anti").select("conv_id", F.col("pos").cast("long").alias("n_turns"), "n_copies", "ha", "hb")


def render(role: Column, text: Column, template: tuple[str, str, str] = TEMPLATE) -> Column:
    return F.concat(F.lit(template[0]), role, F.lit(template[1]), text, F.lit(template[2]))


def chat_format(docs: DataFrame, template: tuple[str, str, str] = TEMPLATE) -> DataFrame:
    """Render the maximal conversations, one row each.

    docs: rows (conv_id, turn, role, text); other columns are not read. Turns
    are ordered by (turn, role, text), so ties and repeated turns have a place.
    Null roles and texts count as empty; a null turn comes first; a row with a
    null conv_id is a conversation of its own. Of conversations that are equal
    turn by turn, the one with the least conv_id stays, and n_copies counts
    them. A conversation that is a proper prefix of another does not occur.

    Returns conv_id, n_turns, n_copies, rendered. Texts move once: hashes and
    rendering read the same exchange. Memory of a task follows the longest
    conversation, which becomes one string anyway; copies, common first turns
    and rows without a conversation are aggregated before they are joined.
    """
    turns = _plain(docs)
    convs, single = whole(turns), lone(turns)
    kept = maximal(prefixes(convs), single)
    named = kept.where("conv_id is not null").select(F.col("conv_id").alias("kept_id"), "n_turns", "n_copies")
    rows = convs.join(named, F.col("conv_id") == F.col("kept_id"))
    rendered = lambda t: F.array_join(F.transform(t, lambda x: render(x["role"], x["text"], template)), "")
    out = rows.select("conv_id", "n_turns", "n_copies", rendered(F.col("turns")).alias("rendered"))
    alone = kept.where("conv_id is null").select("conv_id", "n_turns", "n_copies", "ha", "hb").join(single.select("ha", "hb", "role", "text"), ["ha", "hb"])
    return out.union(alone.select("conv_id", "n_turns", "n_copies", render(F.col("role"), F.col("text"), template)))


ORACLE_SQL = """
with keyed as (
  select *, coalesce(conv_id::varchar, 'row ' || row_number() over ()) as own from conversations),
numbered as (
  select own, conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by own order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
  from keyed),
whole as (
  select own, any_value(conv_id) as conv_id, count(*) as n_turns, list(role || chr(0) || text order by pos) as turns,
         string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' order by pos) as rendered
  from numbered group by own),
same as (
  select n_turns, turns, min(conv_id) as conv_id, count(*) as n_copies, any_value(rendered) as rendered
  from whole group by n_turns, turns),
heads as (
  select distinct list_slice(w.turns, 1, n.pos::bigint) as head
  from whole w join numbered n on n.own = w.own and n.pos < w.n_turns)
select conv_id, cast(n_turns as bigint) as n_turns, cast(n_copies as bigint) as n_copies, rendered
from same where not exists (select 1 from heads where heads.head = same.turns)
"""
