"""Items that appear together: support, lift and conviction of every pair that is frequent and above chance.

Baskets are collapsed: equal deduplicated item arrays become one array with a weight, and pairs are enumerated once per
distinct array. What can't be in a result pair goes first, exactly: an item in fewer baskets than the least count, or
in more than 1/lift of all baskets (a pair's count is at most its rarer item's). Baskets with more than `LARGE` items left
are never gathered into one array. As a pair must be in `least` baskets, it is in one that isn't among the `least - 1`
largest; those are only joined, by the ids, to the pairs that the others yielded. Large baskets beyond them are enumerated
in blocks of `LARGE` items against blocks, each block pair a task of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.session import checked_broadcast, materialise

LARGE = 400
#: Most baskets that are kept out of the enumeration and joined instead.
MOST_JOINED = 64


@dataclass(frozen=True)
class Thresholds:
    """count >= least, count / baskets >= 1/part, count * baskets >= lift * a * b."""

    least: int = 5
    part: int = 2000
    lift: int = 3


def decision_baskets(decisions: DataFrame) -> DataFrame:
    """(basket, item): per decision id its entities without outer white space; blank and null ones dropped."""
    item = F.explode("entities").alias("item")
    clean = F.regexp_replace("item", r"(?U)^[\s\p{Z}\x1c-\x1f]+|[\s\p{Z}\x1c-\x1f]+$", "").alias("item")
    return decisions.where("id is not null").select(F.col("id").alias("basket"), item).select("basket", clean).where("item <> ''").distinct()


def conversation_tags(conversation: str = "conversation") -> Column:
    """The tags of a row: one tag, or a JSON array of tags; blank ones are none."""
    c = F.col(conversation)
    tags = F.when(c.rlike(r"(?s)^\s*\["), F.coalesce(F.from_json(c, "array<string>"), F.array(c))).when(c.isNotNull(), F.array(c))
    return F.filter(tags, lambda t: F.regexp_replace(t, r"(?U)[\s\p{Z}\x1c-\x1f]+", "") != "")


def conversation_baskets(nodes: DataFrame) -> DataFrame:
    """(basket, item): per tag the ids of the rows that carry it, as they are."""
    return nodes.where("id is not null").select(F.explode(conversation_tags()).alias("basket"), F.col("id").alias("item")).distinct()


def _pairs_of(arrays: DataFrame) -> DataFrame:
    """code_a < code_b of every array of `items`, with `weight`."""
    left = arrays.select("items", "weight", F.posexplode("items").alias("i", "code_a"))
    return left.select("code_a", F.explode(F.slice("items", F.col("i") + 2, F.size("items"))).alias("code_b"), "weight")


def frequent_pairs(members: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """id_a < id_b, together, count_a, count_b, baskets, lift, conviction of the pairs within `limits`.

    `members` has distinct (basket, item) without nulls. Baskets of one item count as baskets. An empty table has no
    pairs. Items compare by code point. Conviction of a -> b is null (infinite) where b is in every basket of a.
    """
    members = materialise(members.select("basket", "item"), "members")
    n = members.agg(F.countDistinct("basket")).first()[0]
    least = max(limits.least, -(-n // limits.part))
    support = members.groupBy("item").agg(F.count("*").alias("support")).where((F.col("support") >= least) & (F.col("support") * limits.lift <= n))
    # codes follow no order; the table is written, so they don't change when a task is run again
    items = materialise(support.withColumn("code", F.monotonically_increasing_id()), "items")
    kept = materialise(members.join(checked_broadcast(items.select("item", "code"), written=True), "item").select("basket", "code"), "kept")
    sizes = kept.groupBy("basket").agg(F.count("*").alias("size")).where(F.col("size") > LARGE)
    large = materialise(sizes, "large")
    joined = materialise(large.orderBy(F.desc("size"), "basket").limit(min(least - 1, MOST_JOINED)).select("basket"), "joined")
    h = joined.count()
    small = kept.join(checked_broadcast(large.select("basket"), written=True), "basket", "left_anti")
    collapsed = small.groupBy("basket").agg(F.sort_array(F.collect_list("code")).alias("items")).where(F.size("items") > 1).groupBy("items").agg(F.count("*").alias("weight"))
    pairs = _pairs_of(collapsed)
    if large.count() > h:
        pairs = pairs.unionByName(_block_pairs(kept.join(F.broadcast(joined), "basket", "left_anti"), large))
    counted = pairs.groupBy("code_a", "code_b").agg(F.sum("weight").alias("cold")).where(F.col("cold") >= least - h)
    if h:
        held = kept.join(F.broadcast(joined), "basket", "left_semi")
        counted = materialise(counted, "counted")
        # one row per candidate and joined basket that holds both ends: at most h times the candidates
        a = held.select("basket", F.col("code").alias("code_a"))
        b = held.select("basket", F.col("code").alias("code_b"))
        hot = counted.join(a, "code_a").join(b, ["basket", "code_b"]).groupBy("code_a", "code_b").agg(F.count("*").alias("hot"))
        counted = counted.join(hot, ["code_a", "code_b"], "left")
    else:
        counted = counted.withColumn("hot", F.lit(0))
    counted = counted.select("code_a", "code_b", (F.col("cold") + F.coalesce("hot", F.lit(0))).alias("together")).where(F.col("together") >= least)
    side = lambda k: checked_broadcast(items.select(F.col("code").alias(f"code_{k}"), F.col("item").alias(f"id_{k}"), F.col("support").alias(f"count_{k}")), written=True)
    scored = counted.join(side("a"), "code_a").join(side("b"), "code_b")
    exact = "decimal(38,0)"
    scored = scored.where(F.col("together").cast(exact) * n >= F.col("count_a").cast(exact) * F.col("count_b") * limits.lift)
    swap = F.col("id_a") > F.col("id_b")
    scored = scored.select(
        F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "together",
        F.when(swap, F.col("count_b")).otherwise(F.col("count_a")).alias("count_a"), F.when(swap, F.col("count_a")).otherwise(F.col("count_b")).alias("count_b"),
    )
    lift = F.col("together").cast("double") * n / (F.col("count_a").cast("double") * F.col("count_b"))
    conviction = F.when(F.col("together") < F.col("count_a"), (1 - F.col("count_b") / F.lit(float(n or 1))) / (1 - F.col("together") / F.col("count_a")))
    return scored.withColumns({"baskets": F.lit(n).cast("bigint"), "lift": lift, "conviction": conviction})


def _block_pairs(kept: DataFrame, large: DataFrame) -> DataFrame:
    """The pairs of large baskets, block against block; a block has about LARGE items, whatever the basket's size."""
    blocks = F.ceil(F.col("size") / LARGE)
    placed = kept.join(checked_broadcast(large, written=True), "basket").select("basket", "code", blocks.alias("blocks"), F.pmod(F.xxhash64("code"), blocks).alias("block"))
    gathered = placed.groupBy("basket", "blocks", "block").agg(F.collect_list("code").alias("codes"))
    gathered = materialise(gathered, "blocks")
    other = F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("other")
    facing = gathered.select("basket", "block", "codes", other).join(gathered.select("basket", F.col("block").alias("other"), F.col("codes").alias("facing")), ["basket", "other"])
    facing = facing.repartition(F.col("basket"), F.col("block"), F.col("other"))
    a, b = F.col("x"), F.col("y")
    crossed = facing.select("block", "other", "facing", F.explode("codes").alias("x")).select("block", "other", "x", F.explode("facing").alias("y"))
    crossed = crossed.where((F.col("block") < F.col("other")) | (a < b))
    return crossed.select(F.least(a, b).alias("code_a"), F.greatest(a, b).alias("code_b"), F.lit(1).cast("bigint").alias("weight"))
