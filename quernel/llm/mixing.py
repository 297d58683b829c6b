"""A mixture of sources by target shares of tokens, small sources repeated up to a cap.

Tokens are summed per source; a source's rate is what it should give over what it has. Each document is emitted
floor(rate) times, and once more with probability rate - floor(rate), by a hash of its id and a seed, so a lost task
makes the same choice again. Unless a total is asked for, it is the greatest at which no source hits its cap, so that all
shares are reached. If asked for, it isn't under a part of the tokens at hand, so that one scarce source doesn't shrink all;
the shares are missed then.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.session import checked_broadcast

#: Sources a table of targets may name; their totals are gathered on the driver.
MOST_SOURCES = 10_000


@dataclass
class Source:
    share: float  # of those with documents
    cap: int
    tokens: int
    rate: float = 0.0


def rates(targets: dict[str, tuple[float, int]], have: dict[str, int], total: float | None = None, least_part: float = 0.0) -> dict[str, Source]:
    """Shares are scaled to the sources that have tokens. Beyond the greatest total that keeps all shares, sources at
    their cap stay there and the others take up what is missing, in proportion, until all are at their caps."""
    held = {s: Source(share, cap, have[s]) for s, (share, cap) in targets.items() if have.get(s, 0) > 0 and share > 0 and cap > 0}
    whole = sum(x.share for x in held.values())
    for x in held.values():
        x.share /= whole
    if not held:
        return held
    if total is None:
        total = max(min(x.cap * x.tokens / x.share for x in held.values()), least_part * sum(x.tokens for x in held.values()))
    free, left = dict(held), float(total)
    while free:
        unit = left / sum(x.share for x in free.values())
        capped = [s for s, x in free.items() if x.share * unit > x.cap * x.tokens * (1 + 1e-12)]
        for s in capped or list(free):
            x = free.pop(s)
            x.rate = float(x.cap) if capped else min(float(x.cap), x.share * unit / x.tokens)
            left -= x.rate * x.tokens
    return held


def plan(sizes: DataFrame, targets: DataFrame, total: float | None = None, least_part: float = 0.0) -> tuple[dict[str, tuple[float, int]], dict[str, Source]]:
    """What the targets ask for, and the sources with their rates. Without a total the shares are held, however small the
    mixture; with `least_part` it has at least that part of the tokens at hand, and scarce sources come short."""
    wanted = targets.where("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap"))
    rows = wanted.limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    asked = {r.source: (r.share, r.cap) for r in rows}
    named = checked_broadcast(wanted.select("source"))
    have = {r.source: r.tokens for r in sizes.join(named, "source", "left_semi").groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    return asked, rates(asked, have, total, least_part)


def mix(sizes: DataFrame, sources: dict[str, Source], key: str = "doc_id", seed: int = 0) -> DataFrame:
    """One row for each copy: key, source, copy (from 1), tokens. `sizes` has the key, source and tokens.

    Documents of null or unnamed sources are no part of the mixture; empty texts are taken like others and add nothing.
    No document comes more often than its source's cap. Repeated keys share one draw. No sources: no rows.
    """
    if not sources:
        return sizes.select(key, "source", F.lit(1).alias("copy"), "tokens").limit(0)
    spark = sizes.sparkSession
    table = spark.createDataFrame([(s, x.rate) for s, x in sources.items()], "source string, rate double")
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 53)).cast("double") / float(1 << 53)
    times = F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    out = sizes.select(key, "source", "tokens").join(F.broadcast(table), "source").withColumn("__n", times.cast("int")).where("__n > 0")
    return out.select(key, "source", F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("copy"), "tokens")


def shares(mixture: DataFrame, asked: dict[str, tuple[float, int]], sources: dict[str, Source]) -> DataFrame:
    """Per named source: target_share, the share really reached, rate, the cap, documents, copies, tokens."""
    spark = mixture.sparkSession
    rows = [(s, float(share), int(cap or 0), sources[s].rate if s in sources else 0.0, sources[s].tokens if s in sources else 0) for s, (share, cap) in asked.items()]
    table = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, rate double, tokens_held bigint")
    got = mixture.groupBy("source").agg(F.count("*").alias("copies"), F.sum("tokens").alias("tokens"), F.max("copy").alias("most_repeats"))
    total = got.agg(F.sum("tokens").alias("all"))
    # one row beside a handful: the grand total is attached by a constant key
    out = table.join(got, "source", "left").withColumn("k", F.lit(0)).join(total.withColumn("k", F.lit(0)), "k", "left").drop("k")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select("source", "target_share", F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)).alias("actual_share"), "rate", "max_repeats", zero("most_repeats"), zero("copies"), zero("tokens"), "tokens_held")
