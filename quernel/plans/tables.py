"""The graph behind the kg_* tables: nodes as last written, decisions with their satellites, catalog entities, all edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernel.functions.scalars import decision_ms, label_of, tags_of
from quernel.operators.decisions import expand
from quernel.operators.mutations import upsert
from quernel.session import read

#: Where decision edges and later parts stand in the order of the graph.
AFTER = 1_000_000_000_000
NODES = "pos bigint, id string, type string, label string, status string, tags array<string>, category string, outcome string, scenario string, reasoning string, confidence double, decision_maker string, at_ms double"


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """nodes as in NODES, one row per id; edges: pos, source_id, target_id, type, weight, tags."""
    raw = lambda t: read(spark, sf_dir, t)
    decisions, satellites, links = expand(raw("kg_decisions"))
    # the catalog is a small, fixed table, in the order of its ids
    catalog = raw("kg_catalog").select((F.row_number().over(Window.orderBy("id")) + 4 * AFTER).cast("bigint").alias("pos"), "id", "type", "label")
    nodes = upsert(raw("kg_nodes")).join(catalog.select("id"), "id", "left_anti")
    content = F.get_json_object("properties", "$.content")
    parts = [
        nodes.select("pos", "id", "type", label_of(F.col("id"), F.col("label"), F.get_json_object("properties", "$.name"), content).alias("label"), "status", tags_of(F.col("conversation")).alias("tags")),
        decisions.select(
            (F.col("pos") + AFTER).alias("pos"), "id", F.lit("decision").alias("type"), F.col("id").alias("label"), "category", "outcome", "scenario", "reasoning", "confidence", "decision_maker",
            decision_ms(F.col("timestamp"), F.col("recorded_at"), F.col("valid_from")).alias("at_ms"),
        ),
        satellites.select((F.col("pos") + F.when(F.col("type") == "category", 2).otherwise(3) * AFTER).alias("pos"), "id", "type", "label"),
        catalog.select("pos", "id", "type", label_of(F.col("id"), F.col("label")).alias("label")),
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    names = [c.split()[0] for c in NODES.split(", ")]
    own = raw("kg_edges").select("pos", "source_id", "target_id", "type", "weight", tags_of(F.col("conversation")).alias("tags"))
    edges = own.unionByName(links.withColumn("pos", F.col("pos") + AFTER), allowMissingColumns=True)
    return Graph(whole.select(*names), edges)


def main_session(edges: DataFrame) -> str:
    """The session that wrote most edges."""
    top = edges.where("tags is not null").select(F.explode("tags").alias("t")).groupBy("t").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "t").first()
    return top[0] if top else ""
