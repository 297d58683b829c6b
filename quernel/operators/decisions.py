"""Decisions of a graph: list, linked entities, daily timeline; and decisions written out as nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.functions.scalars import NO_CATEGORY, clean, iso_utc


def decision_list(nodes: DataFrame) -> DataFrame:
    """id, category, outcome, scenario, reasoning, confidence, maker, at (ISO in UTC): the latest first, undated ones last."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return (
        nodes.where("type = 'decision'").orderBy(F.desc_nulls_last(F.floor("at_ms")), "pos")
        .select("id", F.coalesce("category", F.lit(NO_CATEGORY)).alias("category"), text("outcome"), text("scenario"), text("reasoning"), "confidence", F.coalesce("decision_maker", F.lit("")).alias("maker"), iso_utc(F.col("at_ms")).alias("at"))
    )


def decision_entities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """decision_id, place, entity_id, label, type: what each decision involves, in the order of the edges."""
    to = nodes.select(F.col("id").alias("target_id"), "label", "type")
    owner = nodes.where("type = 'decision'").select(F.col("id").alias("source_id"))
    linked = edges.where("type = 'involves'").select("pos", "source_id", "target_id").join(owner, "source_id", "left_semi").join(to, "target_id")
    return linked.select(F.col("source_id").alias("decision_id"), F.col("pos").alias("place"), F.col("target_id").alias("entity_id"), "label", F.coalesce("type", F.lit("")).alias("type"))


def timeline(nodes: DataFrame) -> DataFrame:
    """Decisions with a time per UTC day."""
    day = F.date_from_unix_date(F.floor(F.col("at_ms") / 86_400_000).cast("int")).cast("string").alias("day")
    return nodes.where("type = 'decision' and at_ms is not null").groupBy(day).agg(F.count("*").alias("decisions")).orderBy("day")


def decision_records(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`decision_list` with `entities`, the array of (id, label, type) that each decision involves, in the order of the edges."""
    linked = decision_entities(nodes, edges).groupBy(F.col("decision_id").alias("id"))
    held = linked.agg(F.sort_array(F.collect_list(F.struct("place", F.col("entity_id").alias("id"), "label", "type"))).alias("held"))
    entities = F.transform("held", lambda e: F.struct(e["id"].alias("id"), e["label"].alias("label"), e["type"].alias("type")))
    none = F.array().cast("array<struct<id:string,label:string,type:string>>")
    return decision_list(nodes).join(held, "id", "left").withColumn("entities", F.coalesce(entities, none)).drop("held")


def expand(decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A log of decisions (pos, id, category, decision_maker, entities, ...) as decisions, satellites and edges.

    Nodes: the decision (the last row of an id), its category and its maker. Edges: involves each entity in order,
    belongs_to the category, made_by the maker. Null or blank entities, categories and makers give nothing. An edge's pos
    is the decision's times a width, that of the longest array and two more, plus its place: category and maker come last.
    """
    width = (decisions.agg(F.max(F.size(F.coalesce("entities", F.array().cast("array<string>"))))).first()[0] or 0) + 2
    last = decisions.where("id is not null").groupBy("id").agg(F.max(F.struct("pos", *(c for c in decisions.columns if c not in ("id", "pos")))).alias("d")).select("id", "d.*")
    entity = F.posexplode(F.coalesce("entities", F.array().cast("array<string>"))).alias("k", "target_id")
    place = lambda k: (F.col("pos") * width + k).alias("pos")
    involves = last.select("pos", F.col("id").alias("source_id"), entity).select(place(F.col("k")), "source_id", clean(F.col("target_id")).alias("target_id"), F.lit("involves").alias("type")).where("target_id is not null")

    def to(c: str, kind: str, prefix: str, k: int) -> DataFrame:
        named = last.where(clean(F.col(c)).isNotNull())
        return named.select(place(F.lit(k)), F.col("id").alias("source_id"), F.concat(F.lit(prefix), c).alias("target_id"), F.lit(kind).alias("type"))

    def satellite(c: str, kind: str, prefix: str) -> DataFrame:
        first = last.where(clean(F.col(c)).isNotNull()).groupBy(c).agg(F.min("pos").alias("pos"))
        return first.select("pos", F.concat(F.lit(prefix), c).alias("id"), F.lit(kind).alias("type"), F.col(c).alias("label"))

    edges = involves.unionByName(to("category", "belongs_to", "category:", width - 2)).unionByName(to("decision_maker", "made_by", "maker:", width - 1))
    satellites = satellite("category", "category", "category:").unionByName(satellite("decision_maker", "decision_maker", "maker:"))
    return last, satellites, edges
