"""Queries of the core operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.functions import scalars as S
from quernel.operators import decisions, flatten, graph, mutations, orphans, scope, timestamps, toggles
from quernel.plans import tables
from quernel.session import materialise, read
from quernel.sources import documents


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    moments = timestamps.normalise(read(spark, sf_dir, "kg_decisions"), read(spark, sf_dir, "kg_sessions"))
    return moments.where("disagrees").select("pos", "field")


def p2_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.normalise(read(spark, sf_dir, "kg_decisions"), read(spark, sf_dir, "kg_sessions"))


def p2_parses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.source_parses(read(spark, sf_dir, "kg_decisions"), read(spark, sf_dir, "kg_sessions"))


def _orphans(spark: SparkSession, sf_dir: str) -> orphans.Orphans:
    return orphans.orphan_cascade(*(read(spark, sf_dir, t) for t in ("kg_edges", "kg_nodes", "kg_catalog")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).ends.where("level = 0").select("pos", "endpoint")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).report()


def _objects(spark: SparkSession, sf_dir: str, fields: bool = False) -> DataFrame:
    nodes, edges = read(spark, sf_dir, "kg_nodes"), read(spark, sf_dir, "kg_edges")
    columns = [("kg_nodes", "properties", nodes), ("kg_nodes", "metadata", nodes), ("kg_edges", "properties", edges)]
    return flatten.nested_objects(columns, fields=fields)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _objects(spark, sf_dir)


def p6_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat tables' contents: each field of each object of `p6_found`."""
    return _objects(spark, sf_dir, fields=True)


def p6_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat tables' sizes: one table for each array of objects, named by its path without slots."""
    name = F.regexp_replace("path", r"\[\d+\]", "[]").alias("name")
    return _objects(spark, sf_dir).groupBy("tbl", "col", name).agg(F.count("*").alias("objects"), F.countDistinct("pos").alias("rows"))


# ---- the graph model

def _graph(spark: SparkSession, sf_dir: str) -> tables.Graph:
    return tables.graph(spark, sf_dir)


def _held(spark: SparkSession, sf_dir: str) -> tables.Graph:
    """The graph written once, with the columns that scoping reads: its steps come back to nodes and edges many times."""
    g = tables.graph(spark, sf_dir)
    return tables.Graph(materialise(g.nodes.select("pos", "id", "type", "status", "tags"), "nodes"), materialise(g.edges, "edges"))


def _clean(spark: SparkSession, sf_dir: str) -> tables.Graph:
    """Live nodes and the cleaned edges between them, written once: the algorithms read them again and again."""
    g = _graph(spark, sf_dir)
    nodes = materialise(scope.live_nodes(g.nodes), "nodes")
    return tables.Graph(nodes, materialise(scope.clean_edges(g.edges, nodes), "edges"))


def graph_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    counted = lambda df, part: df.agg(F.lit(part).alias("part"), F.count("*").alias("n"), F.bit_xor("pos").alias("xor_pos"))
    return counted(g.nodes, "nodes").unionByName(counted(g.edges, "edges"))


def live_nodes(spark, sf_dir):
    return scope.live_nodes(_graph(spark, sf_dir).nodes).select("id", "type", "status")


def tagged_nodes(spark, sf_dir):
    g = _held(spark, sf_dir)
    return scope.tagged(g.nodes, tables.main_session(g.edges)).select("id")


def untagged_nodes(spark, sf_dir):
    n = scope.live_nodes(_graph(spark, sf_dir).nodes)
    return n.where(S.is_semantic(F.col("type")) & ~S.has_any_tag(F.col("tags"))).select("id")


def semantic_nodes(spark, sf_dir):
    return scope.live_nodes(_graph(spark, sf_dir).nodes).where(S.is_semantic(F.col("type"))).select("id", "type")


def relation_edges(spark, sf_dir):
    return _graph(spark, sf_dir).edges.where(S.is_relation(F.col("type"))).select("pos", "type")


def clean_edges(spark, sf_dir):
    return _clean(spark, sf_dir).edges.select("pos", "source_id", "target_id", "type", "weight")


def dropped_edges(spark, sf_dir):
    """Raw edges that aren't among the cleaned ones."""
    g = _graph(spark, sf_dir)
    return g.edges.join(scope.clean_edges(g.edges, scope.live_nodes(g.nodes)).select("pos"), "pos", "left_anti").select("pos")


def node_tags(spark, sf_dir):
    """Tags as the nodes' own metadata has them, in rows."""
    n = read(spark, sf_dir, "kg_nodes").select("pos", S.metadata_tags(F.col("metadata")).alias("tags"))
    return n.select("pos", F.explode("tags").alias("tag"))


def edge_tags(spark, sf_dir):
    metadata = F.to_json(F.try_variant_get(F.try_parse_json("properties"), "$.metadata", "variant"))
    e = read(spark, sf_dir, "kg_edges").select("pos", S.metadata_tags(metadata).alias("tags"))
    return e.select("pos", F.explode("tags").alias("tag"))


def node_labels(spark, sf_dir):
    return _graph(spark, sf_dir).nodes.select("id", "label")


def write_tools(spark, sf_dir):
    return mutations.write_tools(_log(spark, sf_dir)).groupBy("tool").agg(F.count("*").alias("n"))


def status_counts(spark, sf_dir):
    g = _graph(spark, sf_dir)
    n = g.nodes.agg(F.count("*").alias("nodes"), F.count_if(S.is_live(F.col("status"))).alias("live"), F.max("pos").isNotNull().alias("present")).withColumn("k", F.lit(0))
    return n.join(g.edges.agg(F.count("*").alias("edges")).withColumn("k", F.lit(0)), "k").select("nodes", "live", "edges", "present")


def claim_by_edge(spark, sf_dir):
    g = _held(spark, sf_dir)
    session = tables.main_session(g.edges)
    return scope.claimed_by_edge(g.nodes, g.edges, scope.tagged(g.nodes, session), session)


def _kept(g: tables.Graph) -> DataFrame:
    session = tables.main_session(g.edges)
    own = scope.tagged(g.nodes, session).select("id")
    return materialise(own.unionByName(scope.claimed_by_edge(g.nodes, g.edges, own, session)), "kept")


def claim_by_entity(spark, sf_dir):
    g = _held(spark, sf_dir)
    return scope.claimed_decisions(g.nodes, g.edges, _kept(g))


def claim_satellites(spark, sf_dir):
    g = _held(spark, sf_dir)
    kept = _kept(g)
    kept = materialise(kept.unionByName(scope.claimed_decisions(g.nodes, g.edges, kept)), "kept")
    return scope.claimed_satellites(g.nodes, g.edges, kept)


def _scoped(spark, sf_dir):
    g = _held(spark, sf_dir)
    return scope.scope_conversation(g.nodes, g.edges, tables.main_session(g.edges))


def scope_conversation(spark, sf_dir):
    return _scoped(spark, sf_dir).nodes.select("id", "type")


def scope_conversation_edges(spark, sf_dir):
    return _scoped(spark, sf_dir).edges.select("pos", "source_id", "target_id", "type", "weight")


def claim_conversation(spark, sf_dir):
    return _scoped(spark, sf_dir).claim


def untagged_decisions(spark, sf_dir):
    g = _held(spark, sf_dir)
    kept = scope.scope_conversation(g.nodes, g.edges, tables.main_session(g.edges)).nodes.select("id")
    return scope.live_nodes(g.nodes).where("type = 'decision'").join(kept, "id", "left_anti").select("id")


def scope_all(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return scope.scope_all(g.nodes, g.edges).nodes.select("id", "type")


def claim_all(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return scope.scope_all(g.nodes, g.edges).claim


def scope_own(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return scope.scope_own(g.nodes, g.edges).edges.groupBy("type").agg(F.count("*").alias("n"))


def claim_own(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return scope.scope_own(g.nodes, g.edges).claim


def graph_summary(spark, sf_dir):
    g = _clean(spark, sf_dir)
    return scope.summarise(g.nodes, g.edges)


def nodes_by_type(spark, sf_dir):
    return scope.by_type(scope.live_nodes(_graph(spark, sf_dir).nodes))


def bar_percent(spark, sf_dir):
    """The types shown, with the length of their bars."""
    top = scope.by_type(scope.live_nodes(_graph(spark, sf_dir).nodes)).limit(12)
    most = top.agg(F.max("n").alias("most")).withColumn("k", F.lit(0))
    return top.withColumn("k", F.lit(0)).join(most, "k").select("type", "n", S.bar_percent(F.col("n"), F.col("most")).alias("percent"))


def adjacency(spark, sf_dir):
    g = _clean(spark, sf_dir)
    return graph.neighbours(graph.numbered(g.nodes, g.edges))


def degree(spark, sf_dir):
    g = _clean(spark, sf_dir)
    return graph.degrees(g.nodes, g.edges).select("id", "degree")


def out_degree(spark, sf_dir):
    g = _clean(spark, sf_dir)
    return graph.out_degrees(g.nodes, g.edges)


def isolated_nodes(spark, sf_dir):
    g = _clean(spark, sf_dir)
    return graph.isolated(g.nodes, g.edges)


def hubs_by_degree(spark, sf_dir):
    g = _clean(spark, sf_dir)
    return graph.hubs(graph.degrees(g.nodes, g.edges), "degree")


def pagerank(spark, sf_dir):
    g = _clean(spark, sf_dir)
    return g.nodes.select("pos", "id").join(graph.pagerank(g.nodes, g.edges), "pos").select("id", F.round("rank", 9).alias("rank"))


def hubs_by_rank(spark, sf_dir):
    g = _clean(spark, sf_dir)
    return graph.hubs(graph.ranked(g.nodes, g.edges), "rank")


def connected_components(spark, sf_dir):
    g = _clean(spark, sf_dir)
    return graph.components(g.nodes, g.edges)


def component_sizes(spark, sf_dir):
    g = _clean(spark, sf_dir)
    return graph.component_sizes(g.nodes, g.edges).groupBy("size").agg(F.count("*").alias("components"))


def communities(spark, sf_dir):
    g = _clean(spark, sf_dir)
    return graph.communities(g.nodes, g.edges)


def top_communities(spark, sf_dir):
    g = _clean(spark, sf_dir)
    return graph.community_list(g.nodes, g.edges)[0]


def community_members(spark, sf_dir):
    g = _clean(spark, sf_dir)
    return graph.community_list(g.nodes, g.edges)[1]


def overview(spark, sf_dir):
    """Summary, components, isolated entities and communities of more than one node in one row."""
    g = _clean(spark, sf_dir)
    around = materialise(graph.neighbours(graph.numbered(g.nodes, g.edges)), "around")
    sizes = graph.components(g.nodes, g.edges, around).groupBy("component").agg(F.count("*").alias("size"))
    grouped = graph.communities(g.nodes, g.edges, around=around).groupBy("community").agg(F.count("*").alias("size"))
    parts = [
        scope.summarise(g.nodes, g.edges),
        sizes.agg(F.count("*").alias("components"), F.coalesce(F.max("size"), F.lit(0)).alias("largest_component")),
        graph.isolated(g.nodes, g.edges, around).agg(F.count("*").alias("isolated")),
        grouped.agg(F.count_if(F.col("size") > 1).alias("communities")),
    ]
    out = parts[0].withColumn("k", F.lit(0))
    for p in parts[1:]:
        out = out.join(p.withColumn("k", F.lit(0)), "k")
    return out.drop("k")


def decision_time(spark, sf_dir):
    d = _graph(spark, sf_dir).nodes.where("type = 'decision'")
    return d.select("id", F.floor("at_ms").cast("bigint").alias("at_ms"))


def decision_list(spark, sf_dir):
    return decisions.decision_list(_graph(spark, sf_dir).nodes)


def decision_records(spark, sf_dir):
    """Decisions with what they involve, as lines of ids and of labels."""
    g = _clean(spark, sf_dir)
    lines = [F.array_join(F.transform("entities", lambda e: e[f]), "\n").alias(f"entity_{f}s") for f in ("id", "label")]  # noqa: B023
    return decisions.decision_records(g.nodes, g.edges).select("id", "category", "outcome", "at", *lines)


def decision_entities(spark, sf_dir):
    g = _clean(spark, sf_dir)
    return decisions.decision_entities(g.nodes, g.edges)


def decision_timeline(spark, sf_dir):
    return decisions.timeline(_graph(spark, sf_dir).nodes)


# ---- writes


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables as a log: nodes are added, archived ones deleted, edges related, decisions recorded, every other one of
    them without its session."""
    seq = lambda k: (F.col("pos") * 4 + k).alias("seq")
    n, e, d = (read(spark, sf_dir, t) for t in ("kg_nodes", "kg_edges", "kg_decisions"))
    add = F.to_json(F.struct("id", "label", "type", F.try_parse_json("metadata").alias("metadata")))
    gone = F.col("status").eqNullSafe("archived")
    writes = n.select(seq(0), F.when(gone, "delete_node").otherwise("add_entity").alias("tool"), F.when(gone, F.to_json(F.struct(F.col("id").alias("node_id")))).otherwise(add).alias("args"))
    related = e.select(seq(1), F.lit("add_relationship").alias("tool"), F.to_json(F.struct(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "type", "conversation")).alias("args"))
    decided = d.select(seq(2), F.lit("record_decision").alias("tool"), F.to_json(F.struct("category", "outcome", "entities", F.when(F.col("pos") % 2 == 0, F.col("conversation")).alias("conversation"))).alias("args"))
    asked = n.select(seq(3), F.lit("query_graph").alias("tool"), F.lit("{}").alias("args"))
    return writes.unionByName(related).unionByName(decided).unionByName(asked)


def write_route(spark, sf_dir):
    return mutations.route(_log(spark, sf_dir)).select("seq", "tool", "session", "file", "how")


def upsert_last_wins(spark, sf_dir):
    return mutations.upsert(read(spark, sf_dir, "kg_nodes")).select("pos", "id", "type")


def soft_delete(spark, sf_dir):
    """What is archived after all writes."""
    return mutations.upsert(read(spark, sf_dir, "kg_nodes")).where("status = 'archived'").select("id", "pos")


def replay_nodes(spark, sf_dir):
    """Each store's nodes after the whole log, by status."""
    r = mutations.replay_nodes(_log(spark, sf_dir))
    return r.groupBy("session", "status").agg(F.count("*").alias("nodes"))


def replay_edges(spark, sf_dir):
    return mutations.replay_edges(_log(spark, sf_dir)).groupBy("session").agg(F.count("*").alias("edges"))


def decision_expand(spark, sf_dir):
    _, satellites, links = decisions.expand(read(spark, sf_dir, "kg_decisions"))
    return links.select("source_id", "type", "target_id").unionByName(satellites.select(F.col("id").alias("source_id"), "type", F.lit(None).cast("string").alias("target_id")))


def node_owner(spark, sf_dir):
    return mutations.node_owner(read(spark, sf_dir, "kg_nodes"))


# ---- settings and names


def toggle_resolve(spark, sf_dir):
    """Sessions of the edges with their flag."""
    s = read(spark, sf_dir, "kg_sessions").where("auto_on is not null").select("session_id", F.col("auto_on").alias("on"), "updated_at", F.lit(0).alias("seq"))
    asked = read(spark, sf_dir, "kg_edges").where("conversation is not null").select(F.col("conversation").alias("session_id")).distinct()
    return toggles.resolve(asked, toggles.last_set(s), True)


def toggle_cap(spark, sf_dir):
    s = read(spark, sf_dir, "kg_sessions").select("session_id", F.col("updated_at").cast("string").alias("updated_at"))
    return toggles.newest(s)


def toggle_migrate(spark, sf_dir):
    """Files of three formats made of the sessions, read back."""
    s = read(spark, sf_dir, "kg_sessions")
    entry = F.to_json(F.struct(F.col("auto_on").alias("on"), F.col("updated_at").cast("string").alias("updatedAt")))
    body = F.concat(F.lit('{"'), F.col("session_id"), F.lit('": '), entry, F.lit("}"))
    form = F.pmod(F.length("session_id") + F.ascii(F.substring("session_id", 10, 1)), F.lit(3))
    text = F.when(form == 0, F.concat(F.lit('{"v": 1, "default": false, "sessions": '), body, F.lit("}"))).when(form == 1, F.concat(F.lit('{"default": false, "sessions": '), body, F.lit("}"))).otherwise(body)
    return toggles.migrate(s.select(F.col("session_id").alias("name"), text.alias("text")))


def view_retention(spark, sf_dir):
    s = read(spark, sf_dir, "kg_sessions")
    files = s.select(F.concat(F.lit("view-"), "session_id", F.lit(".json")).alias("name"), F.col("updated_at").alias("modified"))
    current = files.agg(F.min("name")).first()[0] or ""
    return documents.kept_views(files, current)


def view_key(spark, sf_dir):
    s = read(spark, sf_dir, "kg_sessions")
    key = documents.view_key(F.when(F.col("auto_on"), "all").otherwise("conversation"), F.col("session_id"))
    return s.select("session_id", key.alias("view_key"), F.concat(F.lit("view-"), S.file_stem(key), F.lit(".json")).alias("file"))


def session_path(spark, sf_dir):
    e = read(spark, sf_dir, "kg_nodes").select("pos", "conversation")
    return e.select("pos", S.file_stem(F.col("conversation")).alias("reader"), S.file_stem(F.col("conversation"), "unknown").alias("writer"))


def clean_str(spark, sf_dir):
    return read(spark, sf_dir, "kg_nodes").select("pos", S.clean(F.col("label")).alias("label"), S.clean(F.col("type")).alias("type"))


def short_path(spark, sf_dir):
    n = read(spark, sf_dir, "kg_nodes").select("pos", F.concat_ws("/", F.lit(""), "conversation", "writer", "type", "id").alias("path"))
    return n.select("pos", S.short_path(F.col("path")).alias("short"))


def _settings(spark, sf_dir) -> DataFrame:
    s = read(spark, sf_dir, "kg_sessions")
    line = F.concat(F.lit("env:\n  KG_FILE: "), F.when(F.col("locale") == "en-US", F.concat(F.lit("'~/"), "session_id", F.lit(".json'"))).otherwise(F.concat(F.lit("/srv/"), "session_id", F.lit(".json  "))), F.lit("\nother: 1"))
    return s.select(F.col("session_id").alias("profile"), F.when(F.col("profile").isNotNull(), line).otherwise("env:\n  KG_FILE:   \n").alias("text"), F.coalesce(F.col("auto_on"), F.lit(False)).alias("has_plugin"))


def kv_extract(spark, sf_dir):
    return _settings(spark, sf_dir).select("profile", S.key_value(F.col("text"), "KG_FILE", "/home/x").alias("path"))


def source_resolution(spark, sf_dir):
    p = _settings(spark, sf_dir).select("profile", S.key_value(F.col("text"), "KG_FILE", "/home/x").alias("path"), "has_plugin")
    return documents.resolve_source(p, None, "/home/x/kg.json")


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, p2_moments, p2_parses, p3_found, p3_report, p6_found, p6_fields, p6_tables,
        graph_scan, live_nodes, tagged_nodes, untagged_nodes, semantic_nodes, relation_edges, clean_edges, dropped_edges, node_tags, edge_tags, node_labels, write_tools, status_counts,
        claim_by_edge, claim_by_entity, claim_satellites, scope_conversation, scope_conversation_edges, claim_conversation, untagged_decisions, scope_all, claim_all, scope_own, claim_own,
        graph_summary, nodes_by_type, bar_percent, adjacency, degree, out_degree, isolated_nodes, hubs_by_degree, pagerank, hubs_by_rank, connected_components, component_sizes,
        communities, top_communities, community_members, overview, decision_time, decision_list, decision_records, decision_entities, decision_timeline,
        write_route, upsert_last_wins, soft_delete, replay_nodes, replay_edges, decision_expand, node_owner,
        toggle_resolve, toggle_cap, toggle_migrate, view_retention, view_key, session_path, clean_str, short_path, kv_extract, source_resolution,
    )
}
