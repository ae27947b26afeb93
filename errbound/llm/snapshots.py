"""Collapse of cumulative snapshots: logged conversations that prefix longer ones go, maximal ones are rendered.

Each turn gets a hash of its place, role and text; the hash of a prefix is the running sum of them, kept as three
40-bit numbers.  Running sums are taken inside (conversation, block of turn numbers) and stitched by the block totals,
so a conversation of any length spreads over tasks.  A conversation is a snapshot if its last hash equals a hash
of that length inside a longer one; of equal conversations the smallest conv_id stays.  Both steps are anti-joins on hashes
that were made distinct first.

Rows: rows without a conv_id belong to no conversation and are left out; a null turn number comes first; null
roles and texts equal each other and nothing else, and are rendered empty; turns with one number are ordered by role
and text; repeated rows count once; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

#: Turn numbers in a block, and so in a rendered part.
BLOCK = 64
_HASHES = ["h1", "h2", "h3"]


def _block():
    return F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-1 << 40)).cast("long").alias("block")


def _running(df: DataFrame, values: list[str], order: list) -> DataFrame:
    """Running sums along a conversation, over blocks."""
    inside = Window.partitionBy("conv_id", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.select("*", *(F.sum(v).over(inside).alias(f"sum_{v}") for v in values))
    totals = df.groupBy("conv_id", "block").agg(*(F.sum(v).alias(f"t_{v}") for v in values))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("conv_id", "block", *(F.coalesce(F.sum(f"t_{v}").over(earlier), F.lit(0)).alias(f"b_{v}") for v in values))
    joined = local.join(bases, ["conv_id", "block"])
    return joined.select(*df.columns, *((F.col(f"sum_{v}") + F.col(f"b_{v}")).alias(f"run_{v}") for v in values))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, length and hash of every prefix of every conversation."""
    said = [F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    light = (turns.where(F.col("conv_id").isNotNull())
             .select("conv_id", _block(), F.col("turn").cast("long").alias("turn"), F.xxhash64(*said, F.lit(1)).alias("a"), F.xxhash64(*said, F.lit(2)).alias("b"))
             .distinct().withColumn("one", F.lit(1)))
    order = [F.col("turn").asc_nulls_first(), "a", "b"]
    placed = _running(light, ["one"], order).drop("one").withColumnRenamed("run_one", "length")
    low = (1 << 40) - 1
    hashed = placed.select("conv_id", "block", "length", *(
        F.xxhash64("length", "a", "b", F.lit(i)).bitwiseAND(F.lit(low)).alias(h) for i, h in enumerate(_HASHES)))
    sums = _running(hashed, _HASHES, ["length"])
    return sums.select("conv_id", "length", *(F.col(f"run_{h}").alias(h) for h in _HASHES))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that stay."""
    every = stored(prefixes(turns), "prefixes")
    lengths = every.groupBy("conv_id").agg(F.max("length").alias("n_turns"))
    marked = every.join(lengths, "conv_id")
    inner = marked.where(F.col("length") < F.col("n_turns")).select("length", *_HASHES).distinct()
    last = marked.where(F.col("length") == F.col("n_turns"))
    firsts = last.groupBy("length", *_HASHES).agg(F.min("conv_id").alias("conv_id"))
    return firsts.join(inner, ["length", *_HASHES], "left_anti").select("conv_id", F.col("length").cast("long").alias("n_turns"))


def collapse_snapshots(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, part and rendered: the maximal conversations, in parts of at most BLOCK turn numbers."""
    kept = maximal(turns)
    text = F.concat(F.lit("<|im_start|>"), F.coalesce("m.role", F.lit("")), F.lit("\n"), F.coalesce("m.text", F.lit("")), F.lit("<|im_end|>\n"))
    one = F.struct(F.col("turn").cast("long").alias("turn"), "role", "text").alias("m")
    said = turns.where(F.col("conv_id").isNotNull()).select("conv_id", _block(), one)
    lines = (said.join(kept, "conv_id").distinct()
             .select("conv_id", "n_turns", "block", F.struct("m.turn", "m.role", "m.text", text.alias("line")).alias("m")))
    parts = lines.groupBy("conv_id", "n_turns", "block").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    return parts.select("conv_id", "n_turns", F.greatest("block", F.lit(-1).cast("long")).alias("part"),
                        F.array_join(F.transform("ms", lambda m: m["line"]), "").alias("rendered"))


ORACLE = """
with t as (select distinct conv_id, turn, role, text from conversations where conv_id is not null),
c as (select conv_id, count(*) as n_turns, list(struct_pack(role := role, text := text) order by turn nulls first, role nulls first, text nulls first) as said
      from t group by conv_id),
kept as (select conv_id, n_turns from c a where not exists (
      select 1 from c b where b.conv_id <> a.conv_id and b.n_turns >= a.n_turns and b.said[1:a.n_turns] = a.said
      and (b.n_turns > a.n_turns or b.conv_id < a.conv_id)))
select kept.conv_id, kept.n_turns, coalesce(turn // 64, -1) as part,
       string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), ''
                  order by turn nulls first, role nulls first, text nulls first) as rendered
from kept join t using (conv_id) group by kept.conv_id, kept.n_turns, coalesce(turn // 64, -1)
"""
