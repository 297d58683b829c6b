"""A log of writes replayed into a merged store and one store for each session.

Log: seq, tool, args (JSON text). Tools: add_entity (id, label, type, metadata) replaces the whole node; add_relationship
(source, target, type, metadata) appends an edge; record_decision (category, scenario, reasoning, outcome, confidence, entities)
adds a decision; update_node (node_id, properties) sets the status; delete_node (node_id) archives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.functions.scalars import clean, file_stem
from quernel.session import materialise

#: The names of the tools that write.
WRITE_TOOLS = ("add_entity", "add_relationship", "record_decision", "update_node", "delete_node")


def upsert(rows: DataFrame, key: str = "id", order: tuple[str, ...] = ("written_at", "pos")) -> DataFrame:
    """The last row of each key, whole; nulls in the order come first. Partial maxima, so a hot key is no hot task."""
    rest = [c for c in rows.columns if c != key and c not in order]
    last = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("r"))
    return last.select(key, "r.*").select(*rows.columns)


def write_tools(log: DataFrame) -> DataFrame:
    return log.where(F.col("tool").isin(*WRITE_TOOLS))


def _arg(path: str) -> Column:
    return F.get_json_object("args", path)


def _text(path: str) -> Column:
    """The argument if it is a text, without outer white space."""
    v = F.try_variant_get(F.try_parse_json("args"), path, "variant")
    return F.when(F.schema_of_variant(v) == "STRING", clean(F.try_variant_get(v, "$", "string")))


def owners(log: DataFrame) -> DataFrame:
    """id, seq, owner: from that write on the node carries that session's tag, null where the write took it away.

    A node's tag is `conversation` of its metadata, or the outer one; an update leaves it, an add replaces it.
    """
    adds = log.where("tool = 'add_entity'").select(_arg("$.id").alias("id"), "seq", F.coalesce(_text("$.metadata.conversation"), _text("$.conversation")).alias("owner"))
    return adds.where("id is not null")


def route(log: DataFrame) -> DataFrame:
    """seq, tool, session, how: to whose store each write goes besides the merged one.

    The session is the argument `conversation`; else that of the metadata; else the owner, as of this write and with it
    done, of the first entity, then `node_id`, then `id` that has one; else none. Relations have no owner to fall back on. The
    lookup as of a write is a window over each id's writes and questions together, cut into ranges; no write is compared with another.
    """
    log = write_tools(log)
    base = materialise(_asked(log), "asked")
    questions = base.where("given is null").select("seq", F.posexplode("asked").alias("k", "id"))
    events = owners(log).select("id", "seq", F.lit(0).alias("kind"), F.struct("owner").alias("state"), F.lit(None).cast("int").alias("k")).unionByName(
        questions.select("id", "seq", F.lit(1).alias("kind"), F.lit(None).cast("struct<owner:string>").alias("state"), "k")
    )
    # ranges of (id, seq) of about equal size: an id that many writes name is many ranges, with its state carried into each
    order = ["id", "seq", "kind"]
    placed = materialise(events.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    tail = F.max(F.when(F.col("kind") == 0, F.struct("id", "seq", "state")))
    bounds = materialise(placed.groupBy("part").agg(F.min("id").alias("head"), tail.alias("tail")), "bounds")  # a row a range
    none = F.lit(None).cast("struct<owner:string>").alias("state")
    marks = bounds.select(F.col("head").alias("id"), "part", none, F.lit(True).alias("asks")).unionByName(bounds.where("tail is not null").select("tail.id", "part", "tail.state", F.lit(False).alias("asks")))
    before = Window.partitionBy("id").orderBy("part").rangeBetween(Window.unboundedPreceding, -1)
    carried = marks.withColumn("state", F.last("state", ignorenulls=True).over(before)).where("asks and state is not null")
    carried = carried.select("id", F.lit(-1).cast("bigint").alias("seq"), F.lit(-1).alias("kind"), "state", F.lit(None).cast("int").alias("k"), "part")
    known = F.last("state", ignorenulls=True).over(Window.partitionBy("part", "id").orderBy("seq", "kind").rowsBetween(Window.unboundedPreceding, 0))
    found = carried.unionByName(placed).withColumn("known", known).where("kind = 1 and known.owner is not null").groupBy("seq").agg(F.min(F.struct("k", "known.owner")).alias("f"))
    out = base.join(found, "seq", "left")
    session = F.coalesce("given", "f.owner")
    how = F.when(F.col("given").isNotNull(), "given").when(F.col("f").isNotNull(), "owner").otherwise("merged only")
    return out.select("seq", "tool", session.alias("session"), file_stem(session, "unknown").alias("file"), how.alias("how"))


def _asked(log: DataFrame) -> DataFrame:
    """seq, tool, given (the session that the write names), asked (the ids whose owner it may fall back on, in order)."""
    given = F.coalesce(_text("$.conversation"), _text("$.metadata.conversation"))
    entities = F.coalesce(F.from_json(_arg("$.entities"), "array<string>"), F.array().cast("array<string>"))
    asked = F.filter(F.concat(entities, F.array(_text_as_is("$.node_id"), _text_as_is("$.id"))), lambda x: F.trim(x) != "")
    return log.select("seq", "tool", given.alias("given"), asked.alias("asked"))


def asked_ids(log: DataFrame) -> DataFrame:
    """The ids whose owner decides where one of the writes goes."""
    return _asked(log).where("given is null").select(F.explode("asked").alias("id"))


def _text_as_is(path: str) -> Column:
    v = F.try_variant_get(F.try_parse_json("args"), path, "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def stores(log: DataFrame) -> DataFrame:
    """Each write once for the merged store (session null) and once for the store it is routed to."""
    routed = write_tools(log).join(route(log).select("seq", "session"), "seq")
    return routed.withColumn("session", F.explode(F.when(F.col("session").isNull(), F.array(F.lit(None).cast("string"))).otherwise(F.array(F.lit(None).cast("string"), "session"))))


def replay_nodes(log: DataFrame) -> DataFrame:
    """session, id, type, label, status, metadata of each store's nodes after all writes. Updates and deletes of a node that
    the store doesn't have do nothing."""
    w = stores(log)
    status = F.when(F.col("tool") == "delete_node", "archived").otherwise(_arg("$.properties.status"))
    node = w.where("tool = 'add_entity'").select("session", _arg("$.id").alias("id"), "seq", F.struct(_arg("$.type").alias("type"), _arg("$.label").alias("label"), _arg("$.metadata").alias("metadata")).alias("node"))
    last = node.where("id is not null").groupBy("session", "id").agg(F.max_by("node", "seq").alias("node"), F.max("seq").alias("since"), F.min("seq").alias("born"))
    change = w.where("tool in ('update_node', 'delete_node')").select("session", _arg("$.node_id").alias("id"), "seq", status.alias("status")).where("status is not null")
    n, c = last.alias("n"), change.alias("c")
    both = n.join(c, F.col("n.session").eqNullSafe(F.col("c.session")) & (F.col("n.id") == F.col("c.id")) & (F.col("c.seq") > F.col("n.since")), "left")
    return both.groupBy("n.session", "n.id").agg(F.max_by("c.status", "c.seq").alias("status"), F.first("n.node").alias("node")).select("session", "id", "node.type", "node.label", "status", "node.metadata")


def replay_edges(log: DataFrame) -> DataFrame:
    w = stores(log).where("tool = 'add_relationship'")
    return w.select("session", "seq", _arg("$.source").alias("source_id"), _arg("$.target").alias("target_id"), _arg("$.type").alias("type"))


def node_owner(rows: DataFrame) -> DataFrame:
    """id, owner: the session tag of the first row of each id; null where its metadata is no object or has no tag."""
    first = rows.where("id is not null").groupBy("id").agg(F.min_by("metadata", "pos").alias("args"))
    is_object = F.schema_of_variant(F.try_parse_json("args")).startswith("OBJECT")
    return first.select("id", F.when(is_object, F.coalesce(_text("$.metadata.conversation"), _text("$.conversation"))).alias("owner"))


def replay_decisions(log: DataFrame) -> DataFrame:
    """session, seq, category, outcome, confidence and the entities as text of each store's recorded decisions."""
    w = stores(log).where("tool = 'record_decision'")
    return w.select("session", "seq", _arg("$.category").alias("category"), _arg("$.outcome").alias("outcome"), _arg("$.confidence").cast("double").alias("confidence"), _arg("$.entities").alias("entities"))
