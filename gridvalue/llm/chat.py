"""Chat formatting: cumulative snapshots collapse to the longest conversation.

Logs often hold a conversation once a turn: every snapshot is a prefix of the next.
A rolling hash of the turns so far identifies each prefix; conversations whose whole
hash is that of a proper prefix of a longer one go, by an anti join on (turns, hash).
Of conversations with equal turns the smallest id stays. The maximal ones are then
rendered, in parts of a bounded number of turns.

The rolling hash of a prefix is the sum of hashes of (position, role, text) in four
lanes of 31 bits, so prefix sums over ranges of a conversation give it even for one
that holds most rows. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import null_safe_join, settle

TURNS_PER_PART = 256
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"
LANES = 4
_LANE_SIZE = 2**31


def _lane(i: int) -> Column:
    """A 31-bit hash of a turn at its place; nulls differ from empty strings."""
    parts = (F.col("nth"), F.col("role"), F.col("role").isNull(), F.col("text"), F.col("text").isNull())
    return F.pmod(F.xxhash64(*parts, F.lit(i)), F.lit(_LANE_SIZE))


def _with_starts(rows: DataFrame, amounts: list[str]) -> DataFrame:
    """Add to each amount ``x`` its sum ``x_before`` over the conversation's earlier ranges."""
    before = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv", "range").agg(*[F.sum(a).alias(a) for a in amounts])
    starts = totals.select("conv", "range", *[
        F.coalesce(F.sum(a).over(before), F.lit(0)).alias(f"{a}_before") for a in amounts])
    return null_safe_join(rows, starts, ["conv", "range"], "inner")


def turn_prefixes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """(conv, nth, role, text, prefix): turns numbered from 1 within a conversation by
    turn, then role, then text, nulls first, and the hash of the turns up to each.

    Repeated rows are turns of their own; rows with a null id are one conversation.
    """
    own = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"),
                       F.col(text).alias("text"), F.lit(1).cast("long").alias("one"))
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    ranged = own.repartitionByRange(F.col("conv").asc_nulls_first(), *order).withColumn("range", F.spark_partition_id())
    ranged = settle(ranged, "turns")
    here = Window.partitionBy("conv", "range").orderBy(*order)
    numbered = _with_starts(ranged, ["one"]).withColumn("nth", F.col("one_before") + F.row_number().over(here))
    lanes = [f"lane{i}" for i in range(LANES)]
    hashed = numbered.select("conv", "range", "nth", "role", "text", *[_lane(i).alias(n) for i, n in enumerate(lanes)])
    hashed = settle(hashed, "numbered")
    upto = Window.partitionBy("conv", "range").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    sums = _with_starts(hashed, lanes).select("conv", "nth", "role", "text", *[
        F.pmod(F.col(f"{n}_before") + F.sum(n).over(upto), F.lit(_LANE_SIZE)).alias(n) for n in lanes])
    prefix = F.concat_ws("-", *[F.hex(n) for n in lanes])
    return settle(sums.select("conv", "nth", "role", "text", prefix.alias("prefix")), "prefixes")


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """(conv, n_turns, copies): the conversations that no longer one starts with.

    Of those with equal turns the smallest id stays, and ``copies`` counts them.
    """
    whole = F.max(F.struct("nth", "prefix"))
    ends = settle(prefixes.groupBy("conv").agg(whole.alias("w")).select(
        "conv", F.col("w.nth").alias("n_turns"), F.col("w.prefix").alias("prefix")), "ends")
    distinct = ends.groupBy("n_turns", "prefix").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("copies"))
    inner = null_safe_join(prefixes.select("conv", "nth", "prefix"), ends.select("conv", "n_turns"), ["conv"], "inner")
    inner = inner.where(F.col("nth") < F.col("n_turns")).select(F.col("nth").alias("n_turns"), "prefix").distinct()
    return distinct.join(inner, ["n_turns", "prefix"], "left_anti").select("conv", "n_turns", "copies")


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text", turns_per_part: int = TURNS_PER_PART) -> DataFrame:
    """(conv, part, n_turns, copies, rendered) of the maximal conversations.

    A part holds ``turns_per_part`` turns, so none has to fit a whole endless log; most
    conversations have part 0 alone. A null role or text renders as nothing.
    """
    prefixes = turn_prefixes(turns, conv, turn, role, text)
    kept = settle(maximal_conversations(prefixes), "maximal")
    shown = F.concat(F.lit(TURN_START), F.coalesce("role", F.lit("")), F.lit("\n"),
                     F.coalesce("text", F.lit("")), F.lit(f"{TURN_END}\n"))
    rows = null_safe_join(prefixes.select("conv", "nth", shown.alias("shown")), kept, ["conv"], "inner")
    part = F.floor((F.col("nth") - 1) / F.lit(turns_per_part)).cast("int")
    listed = F.sort_array(F.collect_list(F.struct("nth", "shown")))
    return rows.groupBy("conv", part.alias("part"), "n_turns", "copies").agg(listed.alias("turns")).select(
        F.col("conv").alias(conv), "part", "n_turns", "copies",
        F.array_join(F.transform("turns", lambda t: t["shown"]), "").alias("rendered"))


#: DuckDB SQL for format_chats over ``conversations`` with the parameters above.
ORACLE_SQL = f"""
with t as (select conv_id, role, text, row_number() over (
  partition by conv_id order by turn nulls first, role nulls first, text nulls first) as nth from conversations),
c as (select conv_id, count(*) as n_turns, list({{'role': role, 'text': text}} order by nth) as turns from t group by conv_id),
p as (select distinct turns[1:k] as turns from (select turns, unnest(range(1, n_turns)) as k from c)),
m as (select min(conv_id) as conv_id, n_turns, count(*) as copies, turns from c group by n_turns, turns),
kept as (select conv_id, n_turns, copies from m where not exists (select 1 from p where p.turns = m.turns))
select t.conv_id, cast((t.nth - 1) // {TURNS_PER_PART} as integer) as part, k.n_turns, k.copies,
 string_agg('{TURN_START}' || coalesce(role, '') || chr(10) || coalesce(text, '') || '{TURN_END}' || chr(10), '' order by nth) as rendered
from t join kept k on t.conv_id is not distinct from k.conv_id
group by t.conv_id, part, k.n_turns, k.copies"""
