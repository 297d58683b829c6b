"""Graph algorithms over nodes (pos, id, type, label) and cleaned edges (pos, source_id, target_id, type).

Nodes are numbered by `pos`; only numbers are shuffled in the loops.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.functions.scalars import is_semantic
from quernel.session import materialise, remove

DAMPING, ROUNDS = 0.85, 20
#: Rounds of the walk in one plan, between two tables.
CHUNK = 7
SWEEPS = 10
#: Links up to which one task sweeps the graph; larger graphs are swept by blocks of BLOCK links, as an executor holds one for each core.
ONE_TASK, BLOCK = 4_000_000, 1_000_000
#: A block's links; its labels (OWN: `n` has those before the sweep) and labels of nodes `n` that blocks before and after it send.
PACKED = "block int, ids binary, ghosts binary, size binary, places binary, to binary, bounds binary"
TURNED = "block int, kind int, turn int, number int, changed bigint, n binary, label binary"
OWN, BEFORE, AFTER = 0, 1, 2


def numbered(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """a -> b for each edge between two nodes. Where an id has several nodes, edges go to the last."""
    index = nodes.groupBy("id").agg(F.max("pos").alias("n"))
    return edges.join(index.select(F.col("id").alias("source_id"), F.col("n").alias("a")), "source_id").join(index.select(F.col("id").alias("target_id"), F.col("n").alias("b")), "target_id").select("a", "b")


def neighbours(links: DataFrame) -> DataFrame:
    """Both directions of each link once."""
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def degrees(nodes: DataFrame, edges: DataFrame, around: DataFrame | None = None) -> DataFrame:
    """pos, id, type, label, degree: distinct neighbours in either direction. `around`: these, where they are written already."""
    around = neighbours(numbered(nodes, edges)) if around is None else around
    count = around.groupBy("a").agg(F.count("*").alias("degree"))
    return nodes.join(count, nodes["pos"] == count["a"], "left").select("pos", "id", "type", "label", F.coalesce("degree", F.lit(0).cast("bigint")).alias("degree"))


def out_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    count = numbered(nodes, edges).groupBy("a").agg(F.count("*").alias("out_degree"))
    return nodes.join(count, nodes["pos"] == count["a"]).select("id", "out_degree")


def isolated(nodes: DataFrame, edges: DataFrame, around: DataFrame | None = None) -> DataFrame:
    return degrees(nodes, edges, around).where((F.col("degree") == 0) & is_semantic(F.col("type"))).select("id")


def hubs(scored: DataFrame, score: str, top: int = 15) -> DataFrame:
    """The entities of highest score; ties by label in the order of dictionaries (UNICODE collation), then by order. Scores
    that differ by less than 1e-12 are ties."""
    entities = scored.where(is_semantic(F.col("type")))
    return entities.orderBy(F.desc(F.round(score, 12)), F.collate("label", "UNICODE"), "pos").limit(top).select("id", "label", F.coalesce("type", F.lit("")).alias("type"), "degree", F.round(F.col(score).cast("double"), 6).alias("score"))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, chunk: int = CHUNK) -> DataFrame:
    """pos, rank after exactly `rounds` power iterations; what nodes without out-edges hold is spread evenly.

    The iteration is linear: rank_k is a combination of v_0 = 1 and v_j = A v_(j-1), with A the damped walk without the
    spread mass. How much of each v_j lies on nodes without out-edges gives the weights of the combination at the end.

    `chunk` rounds are one plan: the links, and one link of each node to itself that carries the chunk's earlier v_j, are
    shuffled by their start once and read again by each round; a round's own shuffle has partial sums, and their
    partitioning is the one that the next join needs. A chunk's vectors are written, which cuts the lineage.
    """
    raw = materialise(numbered(nodes, edges), "links")
    out = raw.groupBy("a").agg((F.lit(damping) / F.count("*")).alias("w"))
    itself = nodes.select(F.col("pos").alias("a"), F.col("pos").alias("b"), F.lit(None).cast("double").alias("w"))
    links = materialise(raw.join(out, "a").select("a", "b", "w").unionByName(itself), "links")
    sinks = materialise(nodes.select(F.col("pos").alias("n")).join(out.select(F.col("a").alias("n")), "n", "left_anti"), "sinks")
    names = [f"h{k}" for k in range(chunk)]
    empty = [F.lit(None).cast("double").alias(c) for c in names]
    state = nodes.select(F.col("pos").alias("n"), F.lit(1.0).alias("x"), *empty)
    carried = F.col("w").isNull()
    vectors = []  # tables of (n, h0, h1, ...) with the number of the vector that each column has
    on_sinks: dict[int, float] = {}
    for start in range(0, rounds + 1, chunk):
        many = min(chunk, rounds + 1 - start)
        for _ in range(many):
            # all rounds are alike, so that their code is compiled once: the newest vector comes first, the others move on
            moved = F.coalesce(F.sum(F.col("x") * F.col("w")), F.lit(0.0)).alias("x")
            shifted = [F.max(F.when(carried, F.col(old))).alias(new) for new, old in zip(names, ["x", *names], strict=False)]
            state = links.join(state, F.col("a") == F.col("n")).groupBy(F.col("b").alias("n")).agg(moved, *shifted)
        table = materialise(state, "walk")
        held = {start + many - 1 - k: c for k, c in enumerate(names[:many])}
        vectors.append((held, table))
        row = table.join(sinks, "n", "left_semi").agg(*(F.coalesce(F.sum(c), F.lit(0.0)) for c in held.values())).first()
        on_sinks |= dict(zip(held, row, strict=True))
        state = table.select("n", "x", *empty)
    n = nodes.count()
    weights = [1.0 / max(n, 1)]  # of v_0, v_1, ...
    for _ in range(rounds):
        leaked = sum(w * on_sinks[j] for j, w in enumerate(weights))
        weights = [(1 - damping + damping * leaked) / max(n, 1), *weights]
    parts = [table.select(F.col("n").alias("pos"), sum((F.col(c) * weights[j] for j, c in held.items()), F.lit(0.0)).alias("part")) for held, table in vectors]
    return reduce(DataFrame.unionByName, parts).groupBy("pos").agg(F.sum("part").alias("rank"))


def ranked(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return degrees(nodes, edges).join(pagerank(nodes, edges), "pos")


def components(nodes: DataFrame, edges: DataFrame, around: DataFrame | None = None) -> DataFrame:
    """pos, component: the smallest pos that the node is linked with, in either direction. `around`: the nodes' neighbours,
    where they are written already.

    Alternating large and small stars: each node's larger neighbours, then its smaller ones, are hooked to its smallest,
    so the rounds grow with the logarithm of the longest chain.
    """
    if around is None:
        pairs = materialise(numbered(nodes, edges).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    else:
        pairs = around.where("a > b")
    held = pairs.count()
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: every a > b here; a's neighbours and a itself go to its smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        before, pairs = pairs, materialise(small, "stars")
        had, held = held, pairs.count()
        # the same set of pairs as before: as many, and none that is new
        if had == held and pairs.join(before, ["a", "b"], "left_anti").isEmpty():
            break
    return nodes.select("pos").join(pairs.select(F.col("a").alias("pos"), F.col("b").alias("component")), "pos", "left").select("pos", F.coalesce("component", "pos").alias("component"))


def component_sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return components(nodes, edges).groupBy("component").agg(F.count("*").alias("size"))


def levels_of(node: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    """Length of the longest chain of rising neighbours that ends at each node, by peeling: no two neighbours share a level.
    `node` is sorted; node -> to in both directions."""
    start = np.searchsorted(node, np.arange(n + 1))
    waiting = np.bincount(node[to < node], minlength=n)
    level = np.zeros(n, np.int64)
    front, k = np.flatnonzero(waiting == 0), 0
    while len(front):
        level[front] = k
        size = start[front + 1] - start[front]
        links = np.repeat(start[front] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        up = to[links][to[links] > np.repeat(front, size)]
        np.subtract.at(waiting, up, 1)
        up = np.unique(up)
        front, k = up[waiting[up] == 0], k + 1
    return level


def take_turns(node: np.ndarray, to: np.ndarray, bounds: np.ndarray, label: np.ndarray) -> bool:
    """One sweep, in place: links node -> to in the order of the nodes' levels, which end at `bounds`; `label` by number of
    the node, below its own length. Whether any has changed.

    Nodes of one level have no links among themselves, so a level is voted on at once and gives what their order gives."""
    n, changed = len(label), False
    for i, j in zip(bounds[:-1], bounds[1:], strict=True):
        votes, count = np.unique(node[i:j].astype(np.int64) * n + label[to[i:j]], return_counts=True)
        who, what = votes // n, votes % n
        first = np.flatnonzero(np.diff(who, prepend=-1))
        mine = who[first]
        if not len(mine):
            continue
        most = np.maximum.reduceat(count, first)
        place = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(who))))
        own = np.zeros(len(first), np.int64)
        same = what == label[who]
        own[place[same]] = count[same]
        top = np.flatnonzero(count == most[place])
        top = top[np.diff(place[top], prepend=-1) > 0]  # labels rise within a node: the first is the smallest
        move = most > own
        if move.any():
            label[mine[move]] = what[top][move]
            changed = True
    return changed


def by_level(node: np.ndarray, to: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """node, to and the ends of levels for `take_turns`. `node` is sorted and below n; what is not has no turn here."""
    inner = to < n
    level = levels_of(node[inner], to[inner], n)
    order = np.argsort(level[node], kind="stable")
    node, to = node[order], to[order]
    return node.astype(np.int32), to.astype(np.int32), np.searchsorted(level[node], np.arange((level.max() if n else 0) + 2))


def sweep(a: np.ndarray, b: np.ndarray, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """Labels after in-order label propagation over directed pairs a -> b, both directions present; nodes in order of their
    numbers, each at once seen by the next. Keeps its label unless another has strictly more neighbours; smallest first."""
    ids = np.unique(a)
    order = np.argsort(a, kind="stable")
    node, to, bounds = by_level(np.searchsorted(ids, a[order]), np.searchsorted(ids, b[order]), len(ids))
    label = np.arange(len(ids))
    for _ in range(sweeps):
        if not take_turns(node, to, bounds, label):
            break
    return ids, ids[label]


def communities(nodes: DataFrame, edges: DataFrame, one_task: int = ONE_TASK, around: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """pos, community: the label (a pos) that in-order propagation leaves, nodes without neighbours keep their own.
    `around`: the nodes' neighbours, where they are written already."""
    around = materialise(neighbours(numbered(nodes, edges)), "around") if around is None else around
    around = around.where("a <> b")
    links = around.count()
    swept = around.groupBy(F.lit(0).alias("all")).applyInPandas(_sweep_group, "pos bigint, community bigint") if links <= one_task else relay(around, links, min(one_task, block))
    return nodes.select("pos").join(swept, "pos", "left").select("pos", F.coalesce("community", "pos").alias("community"))


def _sweep_group(pdf: pd.DataFrame) -> pd.DataFrame:
    ids, labels = sweep(pdf["a"].to_numpy(), pdf["b"].to_numpy())
    return pd.DataFrame({"pos": ids, "community": labels})


def _block(ends: list[int], low: int, high: int) -> Column:
    """The place of `a` among the ends, by halves."""
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(F.col("a") <= ends[mid], _block(ends, low, mid)).otherwise(_block(ends, mid + 1, high))


def relay(around: DataFrame, links: int, block: int, sweeps: int = SWEEPS) -> DataFrame:
    """The labels of `sweep`, by blocks: ranges of nodes of about `block` links each (a single node's links aren't cut), so
    that each task holds one block.

    All blocks sweep at once, with the labels of the blocks before them as far as they are known; those for which some of these
    turn out otherwise sweep again, from the labels that they had at first. Labels of the blocks after them are those of the
    sweep before. As nodes only wait for smaller ones, the first block is right at once and each round settles one more block
    and one more level of the order at least, so a sweep has at most as many rounds as there are blocks, or levels; when no
    label is new, it is the one that the order gives.

    Blocks are rows with packed arrays: what links there are (placed by block once), labels of the block's and the neighbouring
    nodes as of its last turn, and labels that changed on other blocks since.
    """
    spark = around.sparkSession
    many = -(-links // max(block, 1))
    ends = sorted(set(around.agg(F.percentile_approx("a", [k / many for k in range(1, many)], 100 * many)).first()[0]))
    placed = around.select(_block(ends, 0, len(ends)).alias("block"), "a", "b")
    blocks = materialise(placed.groupBy("block").applyInPandas(lambda pdf: _packed(pdf, ends), PACKED), "blocks")
    moved = {r.block for r in blocks.select("block").collect()}  # blocks whose labels this sweep has changed, all of them at first
    # a round has a task for each part, whether its blocks have a turn or not
    fixed = blocks.repartition(min(4 * len(moved), max(len(moved), 24)), "block").persist(StorageLevel.DISK_ONLY)
    last: dict[int, DataFrame] = {}  # the table with a block's labels
    later: dict[int, list[DataFrame]] = {}  # tables with labels that a block sees in the next sweep
    number = 0
    for turn in range(sweeps):
        inbox, later, kind = later, {}, AFTER
        active, moved = moved | set(inbox), set()
        while active:
            tables = {id(t): t for t in [*(last[k] for k in active & set(last)), *(t for ts in inbox.values() for t in ts)]}
            parts = [spark.createDataFrame([], TURNED)]
            for i, table in tables.items():
                own, sent = [k for k in active if id(last.get(k)) == i], [k for k, ts in inbox.items() if any(id(t) == i for t in ts)]
                parts.append(table.where((F.col("kind") == OWN) & F.col("block").isin(own) | (F.col("kind") == kind) & F.col("block").isin(sent)))
            known = reduce(DataFrame.unionByName, parts).groupBy("block")
            turned = materialise(fixed.where(F.col("block").isin(list(active))).groupBy("block").cogroup(known).applyInPandas(_turn(ends, turn, number), TURNED), "turn")
            old = {id(t): t for ts in ([*last.values()], *inbox.values()) for t in ts}
            last |= dict.fromkeys(active, turned)
            moved -= active
            inbox, kind, number = {}, BEFORE, number + 1
            for r in turned.where("changed > 0").select("block", "kind").distinct().collect():
                if r.kind == OWN:
                    moved.add(r.block)
                else:
                    (inbox if r.kind == BEFORE else later).setdefault(r.block, []).append(turned)
            active = set(inbox)
            needed = {id(t) for ts in ([*last.values()], *later.values()) for t in ts}
            for i, table in old.items():
                if i not in needed:
                    remove(table)
        if not moved and not later:
            break
    held = [t.where((F.col("kind") == OWN) & F.col("block").isin([k for k, x in last.items() if x is t])) for t in {id(t): t for t in last.values()}.values()]
    labels = reduce(DataFrame.unionByName, held).select("block", "label").join(blocks.select("block", "ids"), "block")
    swept = materialise(labels.mapInPandas(_unpacked, "pos bigint, community bigint"), "swept")
    fixed.unpersist()
    return swept


def _packed(pdf: pd.DataFrame, ends: list[int]) -> pd.DataFrame:
    """One row: the block's nodes and the neighbours in others by number (ids, then ghosts), links in the order of `by_level`
    as runs of a node's (`places`, each of `size`)."""
    a, b, block = pdf["a"].to_numpy(), pdf["b"].to_numpy(), int(pdf["block"].iloc[0])
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    ids, inside = np.unique(a), np.searchsorted(ends, b) == block
    ghosts = np.unique(b[~inside])
    to = np.where(inside, np.searchsorted(ids, b), len(ids) + np.searchsorted(ghosts, b))
    node, to, bounds = by_level(np.searchsorted(ids, a), to, len(ids))
    first = np.flatnonzero(np.diff(node, prepend=-1))
    size = np.diff(np.append(first, len(node))).astype(np.int32)
    arrays = {"ids": ids, "ghosts": ghosts, "size": size, "places": node[first], "to": to, "bounds": bounds}
    return pd.DataFrame([{"block": block} | {k: v.tobytes() for k, v in arrays.items()}])


def _turn(ends: list[int], turn: int, number: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The block's labels after this sweep, as far as is known, and for each block around those that it doesn't know yet."""

    def run(fixed: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        row = fixed.iloc[0]
        ids, ghosts, bounds = (np.frombuffer(row[c], np.int64) for c in ("ids", "ghosts", "bounds"))
        size, places, to = (np.frombuffer(row[c], np.int32) for c in ("size", "places", "to"))
        node, n, block = np.repeat(places, size), len(ids), int(row["block"])
        label, before = np.concatenate((ids, ghosts)), ids
        for r in rows[rows["kind"] == OWN].itertuples():
            label = np.frombuffer(r.label, np.int64).copy()
            before = np.frombuffer(r.n, np.int64) if r.turn == turn else label[:n].copy()
        for r in rows[rows["kind"] != OWN].sort_values("number", kind="stable").itertuples():
            label[n + np.searchsorted(ghosts, np.frombuffer(r.n, np.int64))] = np.frombuffer(r.label, np.int64)
        told = label[:n].copy()
        label[:n] = before
        known, code = np.unique(label, return_inverse=True)
        take_turns(node, to, bounds, code)
        label[:n] = known[code[:n]]
        out = [(block, OWN, turn, number, int((label[:n] != before).sum()), before.tobytes(), label.tobytes())]
        across = (to >= n) & (label[:n] != told)[node]
        pairs = np.unique(np.searchsorted(ends, ghosts)[to[across] - n] * n + node[across])
        for k in np.unique(pairs // n).tolist():
            mine = pairs[pairs // n == k] % n
            out.append((k, BEFORE if block < k else AFTER, turn, number, len(mine), ids[mine].tobytes(), label[mine].tobytes()))
        return pd.DataFrame(out, columns=["block", "kind", "turn", "number", "changed", "n", "label"])

    return run


def _unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for r in pdf.itertuples():
            ids = np.frombuffer(r.ids, np.int64)
            yield pd.DataFrame({"pos": ids, "community": np.frombuffer(r.label, np.int64)[: len(ids)]})


def community_list(nodes: DataFrame, edges: DataFrame, top: int = 12, members: int = 10) -> tuple[DataFrame, DataFrame]:
    """The largest communities of more than one node (ties: the one whose first node comes first), and their entities of
    highest degree."""
    around = materialise(neighbours(numbered(nodes, edges)), "around")
    of = materialise(communities(nodes, edges, around=around), "communities")
    largest = of.groupBy("community").agg(F.count("*").alias("size"), F.min("pos").alias("first")).where("size > 1").orderBy(F.desc("size"), "first").limit(top)
    largest = materialise(largest, "largest")
    entities = degrees(nodes, edges, around).where(is_semantic(F.col("type"))).join(of, "pos").join(F.broadcast(largest.select("community")), "community", "left_semi")
    place = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), "pos"))
    best = entities.withColumn("place", place).where(F.col("place") <= members).select("community", "place", "id", "label", F.coalesce("type", F.lit("")).alias("type"), "degree")
    return largest.select("community", "size"), best
