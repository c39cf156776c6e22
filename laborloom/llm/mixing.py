"""Mixing sources to target weights by Sainte-Laguë apportionment of word blocks.

Each source has a target number of words. Targets are cut into equal blocks of
``block_words``; blocks go to sources by highest quotients target / (2k + 1),
and a source's blocks go to its shards (documents dealt by hash, so many words
each) by the same rule. A shard lays its documents out in seeded order, and its
quota takes blocks along that order, starting over when the shard is used up.

No step lists the blocks: a divisor just too large gives every source all seats
but the last few, and only quotients between it and a divisor just too small
are ranked. Window functions see one shard, one source's shards, or one row per
source, never the documents of a source; documents without words are in none.

Edge cases: null and empty texts have size 0 and are taken 0 times; the null
source is a source and comes last; sources without words get target 0; ties of
quotients go to the first source or shard; repeated rows count each for itself;
an empty table gives no rows; other columns pass through (columns named like
the added ones are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laborloom.llm.common import GAPS, saved, words


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """Add ``place`` (order of sources) and ``target`` to one row per source with ``source_size``.

    Weights repeat along the order of sources by code point, null last. Targets share the total by weight, except that
    none exceeds ``most`` times its source's size: sources are capped in order of size / weight as long as the rest,
    shared by weight, would exceed their cap.
    """
    everywhere = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("place", F.row_number().over(everywhere) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double")
    by_cap = Window.orderBy(F.col("_cap") / F.col("_weight"), "place")
    upto = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    capped = (
        ranked.withColumns({"_weight": weight, "_cap": F.col("source_size") * F.lit(float(most))})
        .withColumn("_total", F.sum("source_size").over(whole))
        .withColumn("_left", F.col("_total") - F.coalesce(F.sum("_cap").over(upto), F.lit(0.0)))
        .withColumn("__nth", F.row_number().over(by_cap))
        .withColumn("_rate", F.col("_left") / F.sum("_weight").over(rest))
        # The first source that stays below its cap sets the rate of all later ones.
        .withColumn("_final", F.min(F.when(F.col("_cap") > F.col("_rate") * F.col("_weight"), F.col("__nth"))).over(whole))
        .withColumn("_common", F.min(F.when(F.col("__nth") == F.col("_final"), F.col("_rate"))).over(whole))
    )
    target = F.when(F.col("__nth") >= F.col("_final"), F.col("_common") * F.col("_weight")).otherwise(F.col("_cap"))
    names = [c for c in capped.columns if c.startswith("_")]
    return capped.withColumn("target", target).drop(*names)


def seats(claims: DataFrame, group: list[str], claim: str, total: str, order: list[str]) -> DataFrame:
    """Add ``seats``: Sainte-Laguë apportionment of ``total`` (a column, equal in a group) to rows by ``claim``.

    Seats stay exact whatever their number: with n rows and claims summing to T, the divisor T / (total - n/2) gives
    at most ``total`` seats and T / (total + n/2) at least as many; only the seats between the two are ranked.
    """
    within = Window.partitionBy(*group)
    sums = claims.withColumns({"_sum": F.sum(claim).over(within), "__n": F.count(F.lit(1)).over(within)})
    round_half = lambda x: F.floor(x + 0.5)
    sure = F.when(
        (F.col(total) > F.col("__n") / 2) & (F.col("_sum") > 0),
        round_half(F.col(claim) * (F.col(total) - F.col("__n") / 2) / F.col("_sum")),
    ).otherwise(0)
    top = F.when(F.col("_sum") > 0, round_half(F.col(claim) * (F.col(total) + F.col("__n") / 2) / F.col("_sum"))).otherwise(0)
    # One seat less than the divisor gives guards against rounding of the quotient itself.
    bounds = sums.withColumn("_sure", F.greatest(F.lit(0), sure.cast("long") - 1)).withColumn("_top", top.cast("long") + 1)
    spare = bounds.withColumn("_spare", F.col(total) - F.sum("_sure").over(within))
    seat = spare.filter(F.col(claim) > 0).withColumn("_seat", F.explode(F.sequence("_sure", "_top")))
    best = Window.partitionBy(*group).orderBy((F.col(claim) / (2 * F.col("_seat") + 1)).desc(), *order, "_seat")
    won = (
        seat.withColumn("_rank", F.row_number().over(best))
        .filter(F.col("_rank") <= F.col("_spare"))
        .groupBy(*group, *order)
        .agg(F.count(F.lit(1)).alias("_won"))
    )
    keys = [*group, *order]
    return (
        bounds.join(won, keys, "left")
        .withColumn("seats", F.col("_sure") + F.coalesce(F.col("_won"), F.lit(0)))
        .drop("_sum", "__n", "_sure", "_top", "_won")
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    most: float = 3.0,
    block_words: int = 16,
    shard_words: int = 1_000_000,
    seed: int = 7,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """One narrow row per document: ``size``, ``source_size``, ``target``, ``taken`` and how many of the taken words
    are a cut of the document's beginning (``part_words``, less than ``size``); the others are whole repeats."""
    # Everything is decided on narrow rows; whole texts are read once, for their sizes.
    narrow = saved(docs.select(key, "source", word_count(F.col(text)).alias("size"), _tag(docs, seed, text, key)), "sizes")
    per_source = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(per_source, weights, most).withColumn("_all", F.lit(0))
    total = F.round(F.sum("target").over(Window.partitionBy("_all")) / block_words).cast("long")
    quotas = seats(targets.withColumn("_blocks", total), ["_all"], "target", "_blocks", ["place"])
    plan = saved(
        quotas.select(
            F.col("source").alias("_source"),
            "place",
            "source_size",
            "target",
            F.col("seats").alias("_quota"),
            F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)).cast("long").alias("_shards"),
        ),
        "source_plan",
    )
    dealt = narrow.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    dealt = dealt.withColumn("_shard", F.pmod(F.xxhash64("__tag", F.lit(3)), F.col("_shards")))
    shards = dealt.groupBy("place", "_shard").agg(F.sum("size").alias("_words"), F.first("_quota").alias("_quota"))
    shards = seats(shards.withColumn("_claim", F.col("_words").cast("double")), ["place"], "_claim", "_quota", ["_shard"])
    take = F.least(F.col("seats") * block_words, F.floor(F.col("_words") * most)).cast("long")
    shards = saved(shards.select("place", "_shard", "_words", take.alias("_take")), "shard_plan")
    # Rows of a shard in seeded order, laid end to end; the quota goes around that circle. Rows without words have no
    # place on it, and as shards are counted by words, they could be any number in one: they stay out of the window.
    order = Window.partitionBy("place", "_shard").orderBy("__tag", key).rowsBetween(Window.unboundedPreceding, 0)
    passes = F.floor(F.col("_take") / F.greatest("_words", F.lit(1)))
    last = F.col("_take") - passes * F.col("_words")
    part = F.greatest(F.lit(0), F.least(F.col("size"), last - F.col("_before")))
    decided = (
        dealt.filter(F.col("size") > 0)
        .join(shards, ["place", "_shard"])
        .withColumn("_before", F.sum("size").over(order) - F.col("size"))
        .withColumn("taken", (passes * F.col("size") + part).cast("long"))
    )
    columns = [key, "source", "size", "source_size", "target", "taken", "__tag"]
    empty = dealt.filter(F.col("size") == 0).withColumn("taken", F.lit(0).cast("long"))
    return decided.select(*columns).unionByName(empty.select(*columns)).select(
        key,
        "source",
        "size",
        "source_size",
        F.round("target", 6).alias("target"),
        "taken",
        F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0).alias("part_words"),
        "__tag",
    )


def _tag(docs: DataFrame, seed: int, text: str, key: str) -> Column:
    return F.xxhash64(F.lit(seed), F.col(key), F.col("source"), F.col(text)).alias("__tag")


def first_words(text: Column, n: Column) -> Column:
    """The beginning of a text up to the end of its n-th word."""
    return F.array_join(F.slice(F.split(text, f"(?<=[^\\x20\\x09-\\x0D])(?={GAPS})"), 1, n), "")


def mixed_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 7, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a copy for each whole repeat, and one cut where a block ends.

    ``n_chars`` follows the text where the table has it. Documents that the mix does not take are left out.
    """
    columns = docs.columns
    # Rows equal in key, source and text are interchangeable, but each has its own number of repeats.
    nth = F.row_number().over(Window.partitionBy(key, "__tag").orderBy("__tag"))
    decided = mix(docs, text=text, key=key, seed=seed, **options).filter(F.col("taken") > 0)
    decided = decided.withColumn("__nth", nth).select(
        F.col(key).alias("__key"), F.col("__tag").alias("__mark"), F.col("__nth").alias("__n"), "size", "taken", "part_words"
    ).withColumnsRenamed({"size": "__size", "taken": "__taken", "part_words": "__part"})
    rows = docs.withColumn("__tag", _tag(docs, seed, text, key)).withColumn("__nth", nth)
    met = F.col(key).eqNullSafe(F.col("__key")) & (F.col("__tag") == F.col("__mark")) & (F.col("__nth") == F.col("__n"))
    whole = F.array_repeat(F.lit(0).cast("long"), F.floor(F.col("__taken") / F.col("__size")).cast("int"))
    pieces = F.when(F.col("__part") > 0, F.concat(whole, F.array("__part"))).otherwise(whole)
    cut = F.when(F.col("__piece") > 0, first_words(F.col(text), F.col("__piece").cast("int"))).otherwise(F.col(text))
    out = rows.join(decided, met).withColumn("__piece", F.explode(pieces)).withColumn(text, cut)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.char_length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)
