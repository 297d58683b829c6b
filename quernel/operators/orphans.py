"""References to records that do not exist, as of the moment of the reference, and what hangs on them.

Round 0 finds the direct orphans: ends of an edge behind which no live record stood when the edge was written. Then a
fixpoint cascade treats children of orphaned records as indirectly orphaned: an entity whose parent link dangles is an
orphan, so is each entity linked to it as its parent, round by round by semi-joins of the links with the last round's
frontier, until a round finds nothing new. Every end that names an entity orphaned that way is reported as inherited.

The as-of test sorts writes and ends by (id, time) into ranges of about equal size, so an id that holds a third of all rows
is spread over a third of the ranges, be it written in one day or one moment. What was known of an id before a range is one
carried row; a window within (range, id) does the rest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.session import checked_broadcast, materialise, scratch

#: Edge types that make the target the parent of the source.
PARENT_TYPES = ("belongs_to", "part_of")
ENDS = ("source_id", "target_id")


@dataclass
class Orphans:
    """ends: pos, endpoint, id, type, written_at, level (0 direct, else the round that reached it).
    entities: id, level (0: its own parent link dangles)."""

    ends: DataFrame
    entities: DataFrame
    rounds: int

    def report(self, table: str = "kg_edges", period: str = "MONTH") -> DataFrame:
        """Counts of direct and inherited orphan ends per table, column and period of `written_at` (null: its own row)."""
        return (
            self.ends.groupBy(F.lit(table).alias("tbl"), "endpoint", F.date_format(F.date_trunc(period, "written_at"), "yyyy-MM-dd").alias("period"))
            .agg(F.count_if(F.col("level") == 0).alias("direct"), F.count_if(F.col("level") > 0).alias("inherited"), F.countDistinct("id").alias("missing_ids"))
        )


def edge_ends(edges: DataFrame) -> DataFrame:
    """One row for each end that names something; null and '' name nothing."""
    named = F.explode(F.array(*(F.struct(F.lit(e).alias("endpoint"), F.col(e).alias("id")) for e in ENDS))).alias("e")
    return edges.select("pos", "type", "written_at", named).select("pos", "type", "written_at", "e.endpoint", "e.id").where("id <> ''")


def dangling(ends: DataFrame, nodes: DataFrame, catalog: DataFrame) -> DataFrame:
    """Ends without a live record as of their `written_at`.

    Records of `catalog` were always there. A record of `nodes` is live from a write on until a later write, by
    (written_at, pos), has status 'archived'. A node write without `written_at` counts as older than all others, an end
    without `written_at` as younger. Rows of equal time: node writes come before ends. Empty tables: all ends dangle.
    """
    first, last = (F.lit(f"{t}").cast("timestamp_ntz") for t in ("0001-01-01 00:00:00", "9999-12-31 23:59:59.999999"))
    known = checked_broadcast(catalog.where("id is not null").select("id").distinct())
    asked = ends.join(known, "id", "left_anti").select("id", F.coalesce("written_at", last).alias("at"), F.lit(2).alias("kind"), "pos", "endpoint", F.lit(None).cast("boolean").alias("live"))
    writes = nodes.where("id is not null").select(
        "id", F.coalesce("written_at", first).alias("at"), F.lit(1).alias("kind"), "pos", F.lit(None).cast("string").alias("endpoint"), (~F.col("status").eqNullSafe("archived")).alias("live")
    )
    ranges = writes.unionByName(asked).repartitionByRange("id", "at", "kind", "pos").withColumn("part", F.spark_partition_id())
    placed = materialise(ranges, "ranges")
    # one row for each range: the id that it begins with, and the last write of the greatest id written in it; an id that goes
    # on into the next range is the greatest of this one
    tail = F.max(F.when(F.col("kind") == 1, F.struct("id", "at", "pos", "live")))
    bounds = materialise(placed.groupBy("part").agg(F.min("id").alias("head"), tail.alias("tail")), "bounds")
    events = bounds.select(F.col("head").alias("id"), "part", F.lit(None).cast("boolean").alias("live"), F.lit(True).alias("asks")).unionByName(
        bounds.where("tail is not null").select("tail.id", "part", "tail.live", F.lit(False).alias("asks"))
    )
    before = Window.partitionBy("id").orderBy("part").rangeBetween(Window.unboundedPreceding, -1)
    carried = events.withColumn("live", F.last("live", ignorenulls=True).over(before)).where("asks and live").select("id", first.alias("at"), F.lit(0).alias("kind"), F.lit(-1).cast("bigint").alias("pos"), F.lit(None).cast("string").alias("endpoint"), "live", "part")
    so_far = Window.partitionBy("part", "id").orderBy("at", "kind", "pos").rowsBetween(Window.unboundedPreceding, 0)
    return carried.unionByName(placed).withColumn("state", F.last("live", ignorenulls=True).over(so_far)).where("kind = 2 and not coalesce(state, false)").select("pos", "endpoint", "id")


def orphan_cascade(edges: DataFrame, nodes: DataFrame, catalog: DataFrame, parent_types: tuple[str, ...] = PARENT_TYPES) -> Orphans:
    """Direct orphans by `dangling`, inherited ones by the cascade. Repeated rows each count; self-loops are no links.

    The number of rounds is the depth of the link graph below an orphan; each round moves only the links and the last
    frontier, both narrow, and is written to the shared folder, so lineage doesn't grow.
    """
    direct = materialise(dangling(edge_ends(edges), nodes, catalog), "direct-orphans")
    links = edges.where(F.col("type").isin(*parent_types) & F.expr("source_id <> '' and target_id <> '' and source_id <> target_id"))
    cut = direct.where("endpoint = 'target_id'").select("pos")
    known = checked_broadcast(catalog.where("id is not null").select(F.col("id").alias("target_id")).distinct())
    frontier = links.select("pos", F.col("source_id").alias("id")).join(cut, "pos", "left_semi").select("id").distinct()
    spark, path, rounds = edges.sparkSession, scratch(edges.sparkSession, "orphans"), 0

    def level(k: int) -> DataFrame:
        return spark.read.schema("id string").parquet(f"{path}/level={k}")

    frontier.select("id").write.parquet(f"{path}/level=0")
    inner = materialise(links.join(known, "target_id", "left_anti").select("source_id", "target_id").distinct(), "links")
    while True:
        seen = spark.read.schema("id string, level int").parquet(path)  # all rounds so far
        if level(rounds).isEmpty():
            break
        step = inner.join(level(rounds).select(F.col("id").alias("target_id")), "target_id", "left_semi").select(F.col("source_id").alias("id")).distinct()
        rounds += 1
        step.join(seen.select("id"), "id", "left_anti").write.parquet(f"{path}/level={rounds}")
    whole = edges.select("pos", "type", "written_at")
    named = edge_ends(edges).join(direct.select("pos", "endpoint"), ["pos", "endpoint"], "left_anti").join(seen, "id")
    inherited = named.select("pos", "endpoint", "id", "type", "written_at", (F.col("level") + 1).alias("level"))
    ends = direct.join(whole, "pos").select("pos", "endpoint", "id", "type", "written_at", F.lit(0).alias("level")).unionByName(inherited)
    return Orphans(ends, seen, rounds)
