"""Mixing sources to target weights by Sainte-Lague apportionment [native].

1. Size of a document: its words.  Sources, by code point with null last, get the weights
   in turn and share ``share`` times all sizes; a target stops at ``cap`` times its
   source's size and the excess is reshared by weight until none is above (water filling).
2. The tokens of the mix are blocks of equal size.  Blocks go to sources by the highest
   Sainte-Lague quotients target / (2k + 1), and the same way from each source to its
   shards (seeded hash classes of its documents), which gives integer quotas.
3. Inside a shard the documents stand in seeded order on a ring of blocks; its quota is
   taken as a run of consecutive blocks from a seeded block on, round the ring again where
   the quota is larger than the shard.  A document's ``taken`` is the overlap with that run.

The quotients are not handed out one by one.  All but about one seat for each claimant are
certain from bounds on the divisor; only the open quotients are ranked.  The source table
(one row for each source) is ranked in one task; all else is dealt by source and shard: a
source has ``most_shards`` shards at most, so its quotas are a window over as many rows,
and a shard holds only (id, size) rows of its documents.

Defined results
- null, empty or blank text: size 0, taken 0.
- A source of size 0 has target 0; with no words at all every target is 0.
- Repeated rows are separate stretches of the ring; equal rows are told apart by nothing,
  so the taken words fall on either.
- Null source is a source; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(*cols: Column, seed: str) -> Column:
    """A seeded non-negative hash below 2**60 that any SQL engine can repeat (from MD5)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *cols)), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, target)."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    by_ratio = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    # If all sources before this one are at their cap, this is what a unit of weight gets.
    level = (F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levels = ranked.withColumn("level", level).withColumn("open", F.col("most") / F.col("weight") > F.col("level"))
    levels = levels.withColumn("unit", F.min(F.when(F.col("open"), F.struct(F.col("most") / F.col("weight"), F.col("level").alias("level")))).over(whole)["level"])
    target = F.when(F.col("unit").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("unit") * F.col("weight")))
    return levels.select("source", "source_size", "weight", target.alias("target"))


def apportion(claims: DataFrame, group: list[str], name: list[str], votes: str, seats: str, out: str) -> DataFrame:
    """Sainte-Lague: ``seats`` (the same in all rows of a group) by ``votes``; adds ``out``.

    With V votes, n claimants and N seats the divisor lies between V/(N + n/2) and
    V/(N - n/2); seats that even the larger divisor gives are certain, and the quotients
    between both are ranked (ties to the first name).
    """
    w = Window.partitionBy(*group)
    total, n = F.sum(votes).over(w).cast("double"), F.count("*").over(w)
    claims = claims.withColumn("_v", total).withColumn("_n", n)
    sure = F.when((F.col(seats) > F.col("_n") / 2) & (F.col("_v") > 0), F.greatest(F.lit(0), F.floor(F.col(votes) * (F.col(seats) - F.col("_n") / 2) / F.col("_v") + 0.5) - 1)).otherwise(0)
    most = F.when(F.col("_v") > 0, F.floor(F.col(votes) * (F.col(seats) + F.col("_n") / 2) / F.col("_v") + 0.5) + 1).otherwise(0)
    claims = claims.withColumn("_sure", sure.cast("long")).withColumn("_most", most.cast("long")).withColumn("_left", F.col(seats) - F.sum("_sure").over(w))
    tried = claims.where("_most > _sure").select(*group, *name, "_left", F.col(votes).alias("_votes"), F.explode(F.sequence(F.col("_sure"), F.col("_most") - 1)).alias("_k"))
    best = Window.partitionBy(*group).orderBy((F.col("_votes") / (2 * F.col("_k") + 1)).desc(), *[F.col(c).asc_nulls_last() for c in name], F.col("_k"))
    won = tried.withColumn("_r", F.row_number().over(best)).where("_r <= _left and _votes > 0").groupBy(*group, *name).agg(F.count("*").alias("_won"))
    keys = list(dict.fromkeys([*group, *name]))
    won = won.select(*[F.col(c).alias(f"_w_{c}") for c in keys], "_won")
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"_w_{c}"))
    keep = [c for c in claims.columns if not c.startswith("_")]
    return claims.join(won, on, "left").select(*keep, (F.col("_sure") + F.coalesce(F.col("_won"), F.lit(0))).cast("long").alias(out))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix", shard_words: int = 65536, most_shards: int = 4096, most_block: int = 256) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, shard, block, quota, taken, parts.

    parts: the stretches of the document that the mix takes, as (first, stop) of its words;
    a document taken twice has two.  text_hash tells rows of one doc_id apart.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("text_hash"))
    rows = stored(rows, "mix-sizes")
    wanted = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)

    # The smallest target is at least 64 blocks long, so that rounding stays below one per cent.
    one = Window.partitionBy()
    block = F.greatest(F.lit(1), F.least(F.lit(most_block), F.floor(F.min(F.when(F.col("target") >= 1, F.col("target"))).over(one) / 64)))
    wanted = wanted.withColumn("block", F.coalesce(block, F.lit(1)).cast("long"))
    wanted = wanted.withColumn("blocks", F.round(F.sum("target").over(one) / F.col("block")).cast("long")).withColumn("all", F.lit(0))
    wanted = apportion(wanted, ["all"], ["source"], "target", "blocks", "source_quota").drop("all", "blocks")
    wanted = wanted.withColumn("n_shards", F.least(F.lit(most_shards), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))).cast("long"))
    wanted = stored(wanted, "mix-sources")

    # One row for each source: broadcast only if Spark finds the stored table small enough.
    placed = rows.join(wanted.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    placed = placed.withColumn("shard", seeded(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), seed=f"{seed}-shard") % F.col("n_shards"))
    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"))
    shards = apportion(shards, ["source"], ["shard"], "shard_size", "source_quota", "quota")

    ring = Window.partitionBy("source", "shard").orderBy(seeded(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), seed=f"{seed}-order"), "doc_id", "size")
    ends = F.sum("size").over(ring.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = placed.withColumn("stop", ends).drop("source_quota", "n_shards", "weight")
    met = placed.join(shards.select(F.col("source").alias("_s"), F.col("shard").alias("_h"), "shard_size", "quota"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_h")))
    # take tokens from start on, round the ring: whole turns, then an arc that may pass the end.
    take = F.least(F.col("quota") * F.col("block"), F.floor(F.lit(float(cap)) * F.col("shard_size")).cast("long"))
    met = met.withColumn("take", take)
    span = F.greatest(F.col("shard_size"), F.lit(1))
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("shard_size") / F.col("block")))
    start = (seeded(F.coalesce(F.col("source"), F.lit("")), F.col("shard").cast("string"), seed=f"{seed}-start") % n_blocks) * F.col("block") % span
    met = met.withColumn("turns", F.floor(F.col("take") / span)).withColumn("arc", F.col("take") % span).withColumn("start", start)

    def overlap(lo: Column, hi: Column) -> Column:
        first = F.col("stop") - F.col("size")
        return F.struct((F.greatest(first, lo) - first).cast("long").alias("first"), (F.least(F.col("stop"), hi) - first).cast("long").alias("stop"))

    arc_end = F.col("start") + F.col("arc")
    whole = F.struct(F.lit(0).cast("long").alias("first"), F.col("size").alias("stop"))
    arcs = F.array(overlap(F.col("start"), F.least(arc_end, span)), overlap(F.lit(0), arc_end - span))
    parts = F.filter(F.concat(F.array_repeat(whole, F.col("turns").cast("int")), arcs), lambda x: x["stop"] > x["first"])
    taken = F.aggregate("parts", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["first"])
    return met.withColumn("parts", parts).select("doc_id", "source", "size", "source_size", "target", "shard", "block", "quota", taken.alias("taken"), "parts", "text_hash")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: a row for each stretch taken, with the columns of ``docs`` and the text cut to it.

    Documents without words are left out, as there is nothing to take of them.
    """
    taken = mix_sources(docs, id_col, text_col, source_col, **options).where("taken > 0").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("parts").alias("_parts"), F.col("size").alias("_size"))
    # Rows that repeat one id and text are counted off on both sides, so that each meets one of the others.
    taken = taken.withColumn("_turn", F.row_number().over(Window.partitionBy("_id", "_hash").orderBy("_size", F.to_json("_parts"))))
    rows = docs.withColumn("_own_id", F.col(id_col).cast("long")).withColumn("_own_hash", F.xxhash64(text_col))
    rows = rows.withColumn("_own_turn", F.row_number().over(Window.partitionBy("_own_id", "_own_hash").orderBy("_own_id")))
    on = F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own_hash") == F.col("_hash")) & (F.col("_own_turn") - F.col("_turn") == 0)
    met = rows.join(taken, on).withColumn("_part", F.explode("_parts"))
    stretch = F.slice(F.regexp_extract_all(text_col, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), (F.col("_part.first") + 1).cast("int"), (F.col("_part.stop") - F.col("_part.first")).cast("int"))
    cut = F.when(F.col("_part.stop") - F.col("_part.first") == F.col("_size"), F.col(text_col)).otherwise(F.array_join(stretch, ""))
    met = met.withColumn(text_col, cut)
    if "n_chars" in docs.columns:
        met = met.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return met.select(*docs.columns)
