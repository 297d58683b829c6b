"""What of a graph belongs to a conversation: live nodes, tags, claims by edges and decisions, cleaned edges.

Nodes: pos, id, type, label, status, tags. Edges: pos, source_id, target_id, type, weight, tags. `pos` is the order in
which rows stand in the graph; where the first or last row wins, it decides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.functions.scalars import has_any_tag, has_tag, is_live, is_relation, is_semantic
from quernel.session import materialise


def live_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where(is_live(F.col("status")))


def well_formed(edges: DataFrame) -> DataFrame:
    """Both ends named, and not the same."""
    return edges.where("source_id <> '' and target_id <> '' and source_id <> target_id")


def clean_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Well-formed edges between the nodes, the first of each (source, target, type), null weights as 1."""
    ids = nodes.select("id").distinct()
    both = well_formed(edges).join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    first = both.groupBy("source_id", "target_id", "type").agg(F.min(F.struct("pos", "weight")).alias("first"))
    return first.select(F.col("first.pos").alias("pos"), "source_id", "target_id", "type", F.coalesce("first.weight", F.lit(1.0)).alias("weight"))


def tagged(nodes: DataFrame, session: str) -> DataFrame:
    return live_nodes(nodes).where(has_tag(F.col("tags"), session))


def claimed_by_edge(nodes: DataFrame, edges: DataFrame, kept: DataFrame, session: str) -> DataFrame:
    """Live ends, not yet kept, of edges that the session wrote; raw edges count, one hop."""
    ends = edges.where(has_tag(F.col("tags"), session)).select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    return ends.join(live_nodes(nodes).select("id"), "id", "left_semi").join(kept.select("id"), "id", "left_anti")


def claimed_decisions(nodes: DataFrame, edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Live decisions, not yet kept, that involve a kept node, or a decision claimed before them in node order.

    Round by round: a decision joins once something it involves is kept from the start, or claimed and earlier.
    """
    open_ = live_nodes(nodes).where("type = 'decision'").join(kept.select("id"), "id", "left_anti").select("id", F.col("pos").alias("at"))
    links = edges.where("type = 'involves'").select(F.col("source_id").alias("id"), F.col("target_id").alias("to")).distinct().join(open_, "id")
    claimed = links.join(kept.select(F.col("id").alias("to")), "to", "left_semi").select("id", "at").distinct()
    chained = materialise(links.join(open_.select(F.col("id").alias("to"), F.col("at").alias("earlier")), "to").where("earlier < at"), "chained")
    frontier = claimed
    if not chained.isEmpty():
        frontier = claimed = materialise(claimed, "claimed")
        while not frontier.isEmpty():
            more = chained.join(frontier.select(F.col("id").alias("to")), "to", "left_semi").select("id", "at").distinct()
            frontier = materialise(more.join(claimed.select("id"), "id", "left_anti"), "claimed")
            claimed = claimed.unionByName(frontier)
    return claimed.select("id")


def claimed_satellites(nodes: DataFrame, edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Live decisions, categories and makers, not yet kept, that an edge of any type from a kept node leads to.

    Edges take effect in order: what an edge pulls in can pull by later edges only. That is the earliest position at
    which each satellite is reached; rounds of relaxed minima find it.
    """
    satellites = live_nodes(nodes).where(~is_semantic(F.col("type"))).select(F.col("id").alias("target_id")).distinct()
    into = edges.where("source_id is not null").select("pos", "source_id", "target_id").join(satellites, "target_id", "left_semi")
    fresh = into.join(kept.select(F.col("id").alias("target_id")), "target_id", "left_anti")
    reached = fresh.join(kept.select(F.col("id").alias("source_id")), "source_id", "left_semi").groupBy(F.col("target_id").alias("id")).agg(F.min("pos").alias("at"))
    inner = materialise(fresh.join(satellites.withColumnRenamed("target_id", "source_id"), "source_id", "left_semi"), "inner")
    if inner.isEmpty():
        return reached.select("id")
    reached = frontier = materialise(reached, "reached")
    while not frontier.isEmpty():
        step = inner.join(frontier.select(F.col("id").alias("source_id"), "at"), "source_id").where("pos > at").groupBy(F.col("target_id").alias("id")).agg(F.min("pos").alias("new"))
        frontier = materialise(step.join(reached, "id", "left").where("at is null or new < at").select("id", F.col("new").alias("at")), "reached")
        reached = materialise(reached.unionByName(frontier).groupBy("id").agg(F.min("at").alias("at")), "reached")
    return reached.select("id")


@dataclass
class Scope:
    nodes: DataFrame
    edges: DataFrame
    claim: DataFrame  # one row


def scope_conversation(nodes: DataFrame, edges: DataFrame, session: str) -> Scope:
    """A session's view: its tagged nodes, ends of its edges, decisions on them and their satellites, and the edges
    between all these."""
    live = live_nodes(nodes)
    own = tagged(nodes, session).select("id", F.lit("tagged").alias("why"))
    kept = own.unionByName(claimed_by_edge(nodes, edges, own, session).withColumn("why", F.lit("edge")))
    kept = materialise(kept, "kept")
    kept = materialise(kept.unionByName(claimed_decisions(nodes, edges, kept).withColumn("why", F.lit("entity"))), "kept")
    kept = materialise(kept.unionByName(claimed_satellites(nodes, edges, kept).withColumn("why", F.lit("satellite"))), "kept")
    view = live.join(kept.groupBy("id").agg(F.min("why").alias("why")), "id", "left")
    claim = view.agg(
        F.count_if(F.col("why") == "tagged").alias("tagged"), F.count_if(F.col("why") == "edge").alias("by_edge"), F.count_if(F.col("why") == "entity").alias("by_entity"),
        F.count_if((F.col("type") == "decision") & F.col("why").isNull()).alias("untagged_decisions"),
        F.count_if(is_semantic(F.col("type")) & ~has_any_tag(F.col("tags"))).alias("untagged"), F.count_if(is_semantic(F.col("type"))).alias("total_semantic"),
    )
    chosen = view.where("why is not null")
    return Scope(chosen, clean_edges(edges, chosen), claim)


def scope_all(nodes: DataFrame, edges: DataFrame) -> Scope:
    """Everything live."""
    live = live_nodes(nodes)
    entities = live.where(is_semantic(F.col("type")))
    any_tag = has_any_tag(F.col("tags"))
    zero = F.lit(0).cast("bigint")
    claim = entities.agg(F.count_if(any_tag).alias("tagged"), zero.alias("by_edge"), zero.alias("by_entity"), F.count_if(~any_tag).alias("untagged"), F.count("*").alias("total_semantic"))
    return Scope(live, clean_edges(edges, live), claim)


def scope_own(nodes: DataFrame, edges: DataFrame) -> Scope:
    """A graph that is a session's own: all of it that is live, without claims."""
    live = live_nodes(nodes)
    kept = clean_edges(edges, live)
    semantic = live.agg(F.count_if(is_semantic(F.col("type"))).alias("tagged"))
    dropped = edges.agg(F.count("*").alias("raw")).unionByName(kept.agg((-F.count("*")).alias("raw"))).agg(F.greatest(F.sum("raw"), F.lit(0)).alias("dropped_edges"))
    claim = semantic.withColumn("k", F.lit(0)).join(dropped.withColumn("k", F.lit(0)), "k").select("tagged", F.col("tagged").alias("total_semantic"), "dropped_edges", F.lit("session-file").alias("source"))
    return Scope(live, kept, claim)


def summarise(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, entities, relations, decisions."""
    kinds = [("nodes", F.lit(True)), ("entities", is_semantic(F.col("type"))), ("decisions", F.coalesce(F.col("type") == "decision", F.lit(False)))]
    n = nodes.agg(*(F.count_if(c).alias(k) for k, c in kinds)).withColumn("k", F.lit(0))
    e = edges.agg(F.count("*").alias("edges"), F.count_if(is_relation(F.col("type"))).alias("relations")).withColumn("k", F.lit(0))
    return n.join(e, "k").select("nodes", "edges", "entities", "relations", "decisions")


def by_type(nodes: DataFrame) -> DataFrame:
    """Types by count, ties by first appearance."""
    return nodes.groupBy(F.coalesce("type", F.lit("Unknown")).alias("type")).agg(F.count("*").alias("n"), F.min("pos").alias("first")).orderBy(F.desc("n"), "first").select("type", "n")
