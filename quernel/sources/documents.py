"""Graph documents: one JSON object {graph_id, nodes, edges, links} a file, read through VARIANT and written back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.functions.scalars import clean, decision_ms, label_of, metadata_tags

NO_ID = "kg"
#: Nodes and edges that one document may hold; larger graphs are tables or lines.
MOST_DOCUMENT = 1_000_000


class NotAGraph(ValueError):
    pass


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def scan(spark: SparkSession, path: str) -> DataFrame | None:
    """path, graph_id, bytes, modified, v (VARIANT) of each document under the path; None where there is none.

    Raises NotAGraph if one isn't an object with arrays `nodes` and `edges`.
    """
    if not _exists(spark, path):
        return None
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.octet_length("value").alias("bytes"), F.try_parse_json("value").alias("v"))
    if raw.where(~is_graph("v")).limit(1).count():
        raise NotAGraph(path)
    return raw.withColumn("graph_id", F.coalesce(F.try_variant_get("v", "$.graph_id", "string"), F.lit(NO_ID)))


def is_graph(v: str):
    array = lambda f: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant")).startswith("ARRAY"), F.lit(False))
    return array("nodes") & array("edges")


def _items(docs: DataFrame, field: str) -> DataFrame:
    """pos, item: the array's elements in their order; files follow each other by path."""
    many = docs.withColumn("items", F.try_variant_get("v", f"$.{field}", "array<variant>")).select("path", F.posexplode("items").alias("k", "item"))
    return many.select("path", F.col("k").cast("bigint").alias("pos"), "item")


def nodes_of(docs: DataFrame) -> DataFrame:
    """Typed nodes: ids as text, label by the label rule (a label that is no text falls to the id), status, tags, fields of decisions."""
    item = lambda p, t="string": F.try_variant_get("item", p, t)
    kind = lambda p: F.schema_of_variant(item(p, "variant"))
    present = lambda p: item(p, "variant").isNotNull() & (kind(p) != "VOID")
    text = lambda p: F.when(kind(p) == "STRING", item(p))
    p = "$.properties"
    first = F.when(present(f"{p}.label"), text(f"{p}.label")).when(present(f"{p}.name"), text(f"{p}.name")).when(present(f"{p}.content"), text(f"{p}.content"))
    number = lambda q: F.when(kind(q).rlike("^(BIGINT|DOUBLE|DECIMAL)"), item(q, "double"))
    stamp = F.when(number(f"{p}.timestamp").isNotNull(), item(f"{p}.timestamp"))
    return _items(docs, "nodes").select(
        "path", "pos", item("$.id").alias("id"), item("$.type").alias("type"), label_of(item("$.id"), first).alias("label"), item(f"{p}.status").alias("status"),
        metadata_tags(F.to_json(item(f"{p}.metadata", "variant"))).alias("tags"),
        *(item(f"{p}.{c}").alias(c) for c in ("category", "outcome", "scenario", "reasoning")), number(f"{p}.confidence").alias("confidence"), item(f"{p}.decision_maker").alias("decision_maker"),
        decision_ms(stamp, text(f"{p}.recorded_at"), text(f"{p}.valid_from")).alias("at_ms"), F.to_json(item(p, "variant")).alias("properties"),
    )


def edges_of(docs: DataFrame) -> DataFrame:
    item = lambda p, t="string": F.try_variant_get("item", p, t)
    return _items(docs, "edges").select(
        "path", "pos", item("$.source_id").alias("source_id"), item("$.target_id").alias("target_id"), item("$.type").alias("type"), F.coalesce(item("$.weight", "double"), F.lit(1.0)).alias("weight"),
        metadata_tags(F.to_json(item("$.properties.metadata", "variant"))).alias("tags"), F.coalesce(F.to_json(item("$.properties", "variant")), F.lit("{}")).alias("properties"),
    )


def session_path(merged: str, stem: str | None) -> str | None:
    """Where a session's own document lies beside the merged one."""
    return f"{merged.rsplit('/', 1)[0]}/sessions/{stem}.json" if stem else None


def choose(spark: SparkSession, merged: str, stem: str | None, mode: str) -> tuple[DataFrame | None, str]:
    """A conversation's own document if it has nodes, else the merged one, which is to be scoped; `all` never reads the own."""
    own = session_path(merged, stem) if mode != "all" else None
    docs = scan(spark, own) if own else None
    if docs is not None and not nodes_of(docs).isEmpty():
        return docs, "session-file"
    return scan(spark, merged), "merged-scope"


def write_tables(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The graph as Parquet, in parts: the form for large graphs."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def write_lines(nodes: DataFrame, edges: DataFrame, path: str, graph_id: str | None = None) -> None:
    """The graph as JSON lines in the order of `pos`, range-partitioned: {graph_id, kind, item}; no part holds all of it."""
    n = nodes.select("pos", F.lit(0).alias("k"), F.to_json(F.struct(*(c for c in nodes.columns if c != "pos"))).alias("item"))
    e = edges.select("pos", F.lit(1).alias("k"), F.to_json(F.struct(*(c for c in edges.columns if c != "pos"))).alias("item"))
    row = F.struct(F.lit(graph_id or NO_ID).alias("graph_id"), F.when(F.col("k") == 0, "node").otherwise("edge").alias("kind"), "item")
    n.unionByName(e).orderBy("k", "pos").select(F.to_json(row).alias("value")).write.mode("overwrite").text(path)


def write_document(nodes: DataFrame, edges: DataFrame, path: str, graph_id: str | None = None, most: int = MOST_DOCUMENT) -> int:
    """The graph as the one JSON document {graph_id, nodes, edges, links: []} that viewers load; returns its bytes.

    It is streamed to the file in the order of `pos`, a partition at a time, so the driver never holds it. A document is
    what one reader loads whole: more than `most` nodes and edges are an error, and go to `write_tables` or `write_lines`.
    """
    spark = nodes.sparkSession
    if nodes.limit(most + 1).count() + edges.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} nodes and edges in one document")
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out, size = files.create(target, True), 0

    def put(text: str) -> None:
        nonlocal size
        data = text.encode()
        out.write(data, 0, len(data))
        size += len(data)

    put(f'{{"graph_id":{json.dumps(graph_id or NO_ID, ensure_ascii=False)}')
    for name, items in (("nodes", nodes), ("edges", edges)):
        put(f',"{name}":[')
        shown = [c for c in items.columns if c != "pos"]
        parsed = [F.try_parse_json("properties").alias("properties") if c == "properties" else F.col(c) for c in shown]
        for k, row in enumerate(items.orderBy("pos").select(F.to_json(F.struct(*parsed)).alias("item")).toLocalIterator()):
            put(("," if k else "") + row.item)
        put("]")
    put(',"links":[]}')
    out.close()
    return size


def remove(spark: SparkSession, path: str) -> bool:
    """Whether there was something to remove; what can't be removed stays, as it is only a copy."""
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:
        return False


def prune_views(spark: SparkSession, folder: str, current: str, most: int = 12) -> list[str]:
    """Removes the stored views of the folder but the current one and the newest others, `most` in all; returns their names."""
    if not _exists(spark, folder):
        return []
    files = spark.read.format("binaryFile").option("pathGlobFilter", "view-*.json").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("modified"))
    gone = [r.name for r in files.join(kept_views(files, current, most), "name", "left_anti").collect()]  # the views of one folder
    for name in gone:
        remove(spark, f"{folder}/{name}")
    return sorted(gone)


class SessionGraphs:
    """Sessions' own documents, the last `most` that were first asked for; a missing, empty or unreadable file is an empty graph."""

    def __init__(self, spark: SparkSession, merged: str, most: int = 64):
        self.spark, self.merged, self.most = spark, merged, most
        self.held: dict[str, tuple[DataFrame, DataFrame] | None] = {}

    def get(self, stem: str) -> tuple[DataFrame, DataFrame] | None:
        """Nodes and edges of the session; None for an empty graph."""
        if stem not in self.held:
            try:
                docs = scan(self.spark, session_path(self.merged, stem))
            except NotAGraph:
                docs = None
            if len(self.held) >= self.most:
                self.held.pop(next(iter(self.held)))
            self.held[stem] = None if docs is None else (nodes_of(docs), edges_of(docs))
        return self.held[stem]


def home_folder(env: dict[str, str], marked: str, exists) -> str:
    """The engine's home: GRAPH_HOME unless blank, else `marked` under the user's home where it exists, else .graph there."""
    if env.get("GRAPH_HOME", "").strip():
        return env["GRAPH_HOME"]
    home = env.get("HOME") or env.get("USERPROFILE") or ""
    return f"{home}/{marked}" if exists(f"{home}/{marked}") else f"{home}/.graph"


def sessions_folder(env: dict[str, str], merged: str) -> str:
    """Where sessions' documents lie: GRAPH_SESSIONS, else `sessions` beside the merged document, else under the user's home."""
    own = env.get("GRAPH_SESSIONS", "").strip()
    if own:
        return own.replace("~", env.get("HOME", ""), 1) if own.startswith("~/") else own
    return f"{merged.rsplit('/', 1)[0] if merged.strip() else env.get('HOME', '') + '/.graph'}/sessions"


def parse_bodies(requests: DataFrame, most: int = 1 << 20) -> DataFrame:
    """session, mode, error of requests (id, body): `error` is 'too large' beyond `most` bytes, 'no JSON' for broken text, 'no
    session' without one; a blank body is an empty object, and any mode but `all` is `conversation`."""
    body = F.when(clean(F.coalesce("body", F.lit(""))).isNull(), "{}").otherwise(F.col("body"))
    v = F.try_parse_json(body)
    session = F.coalesce(F.try_variant_get(v, "$.sessionId", "string"), F.lit(""))
    error = F.when(F.octet_length("body") > most, "too large").when(v.isNull(), "no JSON").when(session == "", "no session")
    mode = F.when(F.try_variant_get(v, "$.mode", "string") == "all", "all").otherwise("conversation")
    return requests.select("id", F.when(error.isNull(), session).alias("session"), F.when(error.isNull(), mode).alias("mode"), error.alias("error"))


def responses(rows: DataFrame) -> DataFrame:
    """id, body, bytes: each row's other columns as a JSON text and its length in bytes."""
    body = F.to_json(F.struct(*(c for c in rows.columns if c != "id")))
    return rows.select("id", body.alias("body"), F.octet_length(body).alias("bytes"))


def view_key(mode, session):
    """Name of a stored view: all, or conversation:<id>, with the version of the scoping rules."""
    return F.concat(F.when(mode == "all", "all").otherwise(F.concat(F.lit("conversation:"), session)), F.lit(":v3"))


def kept_views(files: DataFrame, current: str, most: int = 12) -> DataFrame:
    """name: the current view and the newest others, `most` in all."""
    views = files.where(F.col("name").rlike(r"^view-.*\.json$") & (F.col("name") != current))
    others = views.orderBy(F.desc("modified"), "name").limit(most - 1).select("name")
    return others.unionByName(files.where(F.col("name") == current).select("name").limit(1))


def resolve_source(profiles: DataFrame, env: str | None, default: str) -> DataFrame:
    """path, source, profiles: the graph's place; `profiles` has profile, text path or null, has_plugin. A profile with the
    plugin wins, else the first by name; then the environment's value, then the default."""
    held = profiles.agg(
        F.min(F.when(F.col("path").isNotNull(), F.struct((~F.col("has_plugin")).alias("late"), "profile", "path"))).alias("p"), F.count("*").alias("profiles")
    )
    env_path = F.nullif(F.trim(F.lit(env or "")), F.lit(""))
    source = F.when(F.col("p").isNotNull(), F.concat(F.lit("profile:"), F.col("p.profile"))).when(env_path.isNotNull(), "env").otherwise("default")
    return held.select(F.coalesce("p.path", env_path, F.lit(default)).alias("path"), source.alias("source"), "profiles")


def scan_profiles(spark: SparkSession, home: str, file: str, key: str, markers: tuple[str, ...]) -> DataFrame:
    """profile, path of each profile folder whose settings mention one of the markers."""
    from functools import reduce

    from quernel.functions.scalars import key_value

    texts = spark.read.text(f"{home}/profiles/*/{file}", wholetext=True).select(F.regexp_extract("_metadata.file_path", r"/profiles/([^/]+)/", 1).alias("profile"), "value")
    mentioned = reduce(lambda a, b: a | b, (F.col("value").contains(m) for m in markers))
    return texts.where(mentioned).select("profile", key_value(F.col("value"), key, home).alias("path"))
