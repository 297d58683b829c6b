"""Texts into containers of fixed capacity, with little room left, no text cut unless it exceeds the capacity.

Sizes are whole tokens, so an instance is a histogram of at most `capacity` rows, whatever the number of texts; it is
solved on the driver and the plan applied to the texts by their rank among those of equal size. Martello-Toth reduction
first fixes sets that dominate every other set with the same item: an item that nothing fits beside goes alone; the
largest item that fits beside it goes with it if the two fill the container, if no two others fit beside it, or if no two
that fit are more than it; where no three others fit, it and the largest that still fits make a set of three if each pair
that fits could stand in their place. What remains is packed by best fit, largest first, equal containers moving as one group.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.session import materialise

#: Parts into which the texts of one size are spread to be numbered: at least so many, and more as there are more pieces.
SALTS, PIECES_A_SALT = 64, 250_000
MOST_CONTAINERS = 1000


@dataclass
class Plan:
    """Ranges of ranks: those from `low` on of `size` go to containers first, first + 1, ... first + count - 1, in turn."""

    size: np.ndarray
    low: np.ndarray
    first: np.ndarray
    count: np.ndarray
    containers: int
    fixed: int  # containers that the reduction fixed


def reduce_instance(capacity: int, left: dict[int, int]) -> list[tuple[int, tuple]]:
    """Takes dominating sets out of `left` (size -> count), as (count, pattern); a pattern is ((size, times), ...)."""
    fixed = []
    sizes = sorted(left)

    def neighbours(gap: int) -> int | None:
        """The largest size within the gap that is left."""
        i = bisect_left(sizes, gap + 1) - 1
        return sizes[i] if i >= 0 else None

    def take(size: int, n: int) -> None:
        left[size] -= n
        if not left[size]:
            del left[size]
            sizes.pop(bisect_left(sizes, size))

    for size in sorted(left, reverse=True):
        while left.get(size):
            n = left[size]
            # the two smallest others, the item itself not counted once
            smallest: list[int] = []
            for s in sizes[:3]:
                smallest += [s] * min(2, left[s] - (s == size))
                if len(smallest) > 1:
                    break
            if not smallest or size + smallest[0] > capacity:
                # with an equal item as the only neighbour left, the last one stays alone
                alone = n if size * 2 > capacity or n == 1 else 0
                if not alone:
                    break
                fixed.append((alone, ((size, 1),)))
                take(size, alone)
                continue
            mate = neighbours(capacity - size)
            if mate == size and n < 2:
                i = bisect_left(sizes, size) - 1
                mate = sizes[i] if i >= 0 else None
            if mate is None:
                break
            if size + mate == capacity or len(smallest) < 2 or size + smallest[0] + smallest[1] > capacity or mate >= _most_of_two(size, capacity, sizes, left):
                m = n // 2 if mate == size else min(n, left[mate])
                fixed.append((m, ((size, 2),) if mate == size else ((size, 1), (mate, 1))))
                take(size, 2 * m if mate == size else m)
                if mate != size:
                    take(mate, m)
                continue
            third = _third(size, mate, capacity, sizes, left)
            if third is None:
                break
            each = Counter((size, mate, third))
            m = min(left[s] // k for s, k in each.items())
            fixed.append((m, tuple(each.items())))
            for s, k in each.items():
                take(s, m * k)
    return fixed


def _pairs(size: int, capacity: int, sizes: list[int], left: dict[int, int]) -> Iterator[tuple[int, int]]:
    """Of every size s, the largest r >= s that fits with it beside the item; empty unless no three others fit, so few sizes do."""
    gap = capacity - size
    held = [s for s in sizes[: bisect_left(sizes, gap)] for _ in range(min(3, left[s] - (s == size)))]
    if len(held) < 2 or sum(held[:3]) <= gap and len(held) > 2:
        return
    for i, s in enumerate(held):
        j = bisect_left(held, gap - s + 1) - 1
        if j > i:
            yield held[j], s


def _most_of_two(size: int, capacity: int, sizes: list[int], left: dict[int, int]) -> float:
    """The most that two others have that fit beside the item; infinite where three fit."""
    gap = capacity - size
    few = [s for s in sizes[:4] for _ in range(min(3, left[s] - (s == size)))][:3]
    if len(few) > 2 and sum(few) <= gap:
        return float("inf")
    return max((r + s for r, s in _pairs(size, capacity, sizes, left)), default=0)


def _third(size: int, mate: int, capacity: int, sizes: list[int], left: dict[int, int]) -> int | None:
    """The size that makes a dominating set of three with the item and the largest that fits beside it, if there is one."""
    if _most_of_two(size, capacity, sizes, left) == float("inf"):
        return None
    gap = capacity - size - mate
    fits = [s for s in sizes[: bisect_left(sizes, gap + 1)] if left[s] - (s == size) - (s == mate) > 0]
    if not fits or left[mate] - (mate == size) < 1:
        return None
    third = fits[-1]
    # each pair that fits lies item by item within (mate, third), or both within mate
    return third if all(s <= third or r + s <= mate for r, s in _pairs(size, capacity, sizes, left)) else None


def best_fit(capacity: int, left: dict[int, int]) -> list[tuple[int, tuple]]:
    """Best fit, largest first, over counts: groups of containers with equal content stand as one."""
    open_at: dict[int, list[tuple[int, tuple]]] = {}
    gaps: list[int] = []

    def put(gap: int, n: int, pattern: tuple) -> None:
        if n:
            if gap not in open_at:
                open_at[gap] = []
                insort(gaps, gap)
            open_at[gap].append((n, pattern))

    for size in sorted(left, reverse=True):
        n = left[size]
        while n:
            i = bisect_left(gaps, size)
            if i == len(gaps):
                each = capacity // size
                put(capacity - each * size, n // each, ((size, each),))
                if n % each:
                    put(capacity - n % each * size, 1, ((size, n % each),))
                break
            gap = gaps[i]
            count, pattern = open_at[gap].pop()
            if not open_at[gap]:
                del open_at[gap]
                gaps.pop(i)
            each = gap // size
            m = min(count, n // each)
            put(gap - each * size, m, (*pattern, (size, each)))
            n -= m * each
            if m < count and n and n < each:  # the last few go into one more
                put(gap - n * size, 1, (*pattern, (size, n)))
                m, n = m + 1, 0
            put(gap, count - m, pattern)
    return [group for groups in open_at.values() for group in groups]


def solve(capacity: int, histogram: dict[int, int]) -> Plan:
    """`histogram`: size -> count, with sizes from 1 to the capacity."""
    left = {s: n for s, n in histogram.items() if n}
    fixed = reduce_instance(capacity, left)
    patterns = fixed + best_fit(capacity, left)
    at: dict[int, int] = {}
    rows, containers = [], 0
    for n, pattern in patterns:
        for size, times in pattern:
            rows.append((size, at.get(size, 0), containers, n))
            at[size] = at.get(size, 0) + n * times
        containers += n
    size, low, first, count = (np.array(c, np.int64) for c in zip(*sorted(rows), strict=True)) if rows else [np.empty(0, np.int64)] * 4
    return Plan(size, low, first, count, containers, sum(n for n, _ in fixed))


def pieces(sizes: DataFrame, key: str, capacities: dict[str, int]) -> DataFrame:
    """key, container, capacity, piece, start, tokens: a text as it is if it fits, else cut at multiples of the capacity."""
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("container"), F.lit(c).alias("capacity")) for k, c in capacities.items()))).alias("k")
    df = sizes.select(key, "tokens", kinds).select(key, F.col("tokens").alias("__all"), "k.container", "k.capacity")
    last = F.greatest(F.expr("(__all - 1) div capacity"), F.lit(0))
    cut = df.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    start = F.col("piece") * F.col("capacity")
    return cut.select(key, "container", "capacity", "piece", start.alias("start"), F.least(F.col("capacity").cast("bigint"), F.col("__all") - start).alias("tokens"))


def pack(sizes: DataFrame, containers: DataFrame, key: str = "doc_id") -> tuple[DataFrame, dict[str, Plan]]:
    """Every piece of every text with its container: key, container, capacity, piece, start, tokens, bin.

    `sizes` has the key (unique, bigint) and tokens; texts of 0 tokens come out once per kind with a null bin. `containers` has
    container, capacity_tokens; kinds of null or no capacity are left out, and no kinds or no texts give no rows. Bins
    are numbered from 0 in each kind; more than MOST_CONTAINERS kinds are an error. Of texts of equal size, which goes where follows the key.
    """
    held = containers.where("capacity_tokens > 0 and container is not null").limit(MOST_CONTAINERS + 1).collect()
    if len(held) > MOST_CONTAINERS:
        raise ValueError(f"more than {MOST_CONTAINERS} kinds of containers")
    kinds = {r.container: int(r.capacity_tokens) for r in held}
    if not kinds:
        return sizes.sparkSession.createDataFrame([], f"{key} bigint, container string, capacity int, piece bigint, start bigint, tokens bigint, bin bigint"), {}
    cut = materialise(pieces(sizes, key, kinds), "pieces")
    salts = max(SALTS, -(-cut.count() // PIECES_A_SALT))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64(key, "piece"), F.lit(salts)).cast("int"))
    counted = materialise(salted.where("tokens > 0").groupBy("container", "tokens", "salt").agg(F.count("*").alias("n")), "counted")
    histograms: dict[str, dict[int, int]] = {k: {} for k in kinds}
    for r in counted.groupBy("container", "tokens").agg(F.sum("n").alias("n")).collect():  # at most the sum of the capacities
        histograms[r.container][r.tokens] = r.n
    plans = {k: solve(kinds[k], histograms[k]) for k in kinds}
    before = Window.partitionBy("container", "tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("container", "tokens", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("container", "tokens", "salt").orderBy(key, "piece")
    ranked = salted.where("tokens > 0").withColumn("rank", F.row_number().over(within) - 1).join(offsets, ["container", "tokens", "salt"])
    ranked = ranked.select(key, "container", "capacity", "piece", "start", "tokens", (F.col("rank") + F.col("offset")).alias("rank"))
    names = list(kinds)
    stacked = {f: np.concatenate([getattr(plans[k], f) for k in names]) for f in ("size", "low", "first", "count")}
    kind = np.repeat(np.arange(len(names)), [len(plans[k].size) for k in names])
    most = max(kinds.values()) + 1
    group = kind * most + stacked["size"]

    step_most = max((n for h in histograms.values() for n in h.values()), default=0) + 1

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((stacked["low"], group))
        own, low, first, count = group[order], stacked["low"][order], stacked["first"][order], stacked["count"][order]
        number = {k: i for i, k in enumerate(names)}
        # ranks are searched within their group: (group, rank) as one number
        step = step_most
        ends = own * step + low
        for batch in batches:
            at = np.array([number[k] for k in batch.column(1).to_pylist()]) * most + batch.column(5).to_numpy()
            rank = batch.column(6).to_numpy()
            found = np.searchsorted(ends, at * step + rank, side="right") - 1
            bins = first[found] + (rank - low[found]) % count[found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(bins, pa.int64())], names=[*batch.schema.names[:6], "bin"])

    packed = ranked.mapInArrow(assign, f"`{key}` bigint, container string, capacity int, piece bigint, start bigint, tokens bigint, bin bigint")
    empty = salted.where("tokens <= 0").select(key, "container", "capacity", "piece", "start", "tokens", F.lit(None).cast("bigint").alias("bin"))
    return packed.unionByName(empty), plans


def fill_report(packed: DataFrame, plans: dict[str, Plan] | None = None) -> DataFrame:
    """Per kind: containers used, tokens, the share of room used, the least number of containers that could do, and how many
    of them the reduction fixed (null where the plans aren't given)."""
    report = packed.groupBy("container", "capacity").agg(
        (F.coalesce(F.max("bin"), F.lit(-1)) + 1).alias("bins"), F.sum("tokens").alias("tokens"), F.count("bin").alias("pieces"),
    ).withColumns({"fill": F.round(F.col("tokens") / (F.col("bins") * F.col("capacity")), 6), "least_bins": F.ceil(F.col("tokens") / F.col("capacity"))})
    fixed = F.coalesce(*(F.when(F.col("container") == k, F.lit(p.fixed)) for k, p in (plans or {}).items()), F.lit(None)).cast("bigint")
    return report.withColumn("fixed_bins", fixed)
