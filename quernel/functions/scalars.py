"""Scalar rules of the graph model as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Node types that are no entities, edge types that are no relations, the status of a soft delete.
DECISION_TYPES = ("decision", "category", "decision_maker")
PLUMBING_TYPES = ("involves", "belongs_to", "made_by")
ARCHIVED = "archived"
NO_CATEGORY = "未分类"
#: White space as both Unicode and the writers see it.
_OUTER = r"(?U)^[\s\p{Z}\x1c-\x1f﻿]+|[\s\p{Z}\x1c-\x1f﻿]+$"
_ISO = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2})?)?$"


def clean(text: Column) -> Column:
    """Without outer white space; null where nothing is left."""
    return F.nullif(F.regexp_replace(text, _OUTER, ""), F.lit(""))


def label_of(node_id: Column, *candidates: Column) -> Column:
    """The first candidate that isn't null, trimmed; the id where that one is blank. A blank first candidate hides the others."""
    return F.coalesce(clean(F.coalesce(*candidates, node_id)), node_id)


def is_live(status: Column) -> Column:
    return ~status.eqNullSafe(F.lit(ARCHIVED))


def is_semantic(kind: Column) -> Column:
    return ~F.coalesce(kind, F.lit("undefined")).isin(*DECISION_TYPES)


def is_relation(kind: Column) -> Column:
    return ~F.coalesce(kind, F.lit("undefined")).isin(*PLUMBING_TYPES)


def tags_of(conversation: Column) -> Column:
    """A tag, or a JSON array of tags, as an array; null stays null, a blank tag stays a tag."""
    many = F.from_json(conversation, "array<string>")
    return F.when(conversation.rlike(r"^\s*\["), F.coalesce(many, F.array(conversation))).when(conversation.isNotNull(), F.array(conversation))


def metadata_tags(metadata: Column) -> Column:
    """Tags from JSON metadata: `conversation`, else `session`; an empty `conversation` hides `session`; what is neither
    text nor an array of texts gives no tags."""
    v = F.try_parse_json(metadata)

    def of(field: str) -> Column:
        many = F.try_variant_get(v, f"$.{field}", "array<variant>")
        texts = F.filter(F.transform(many, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))), lambda t: t.isNotNull())
        one = F.try_variant_get(v, f"$.{field}", "string")
        kind = F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant"))
        return F.when(kind.startswith("ARRAY"), texts).when(kind == "STRING", F.array(one)).when(kind != "VOID", F.array().cast("array<string>"))

    return F.coalesce(of("conversation"), of("session"))


def has_tag(tags: Column, session: str) -> Column:
    """Exact, untrimmed membership."""
    return F.coalesce(F.array_contains(tags, session), F.lit(False))


def has_any_tag(tags: Column) -> Column:
    return F.coalesce(F.exists(tags, lambda t: clean(t).isNotNull()), F.lit(False))


def decision_ms(timestamp: Column, *iso: Column) -> Column:
    """Milliseconds since 1970: a number of seconds, or of milliseconds beyond 1e11; else the first ISO text that parses,
    local ones read as UTC. Null where none does, or beyond the years that dates have."""
    number = F.try_to_number(F.when(timestamp.rlike(r"^\d{1,15}(\.\d{1,6})?$"), F.regexp_replace(timestamp, r"^(\d+)$", "$1.0")), F.lit("999999999999999.999999"))
    ms = F.when(number > 10**11, number).otherwise(number * 1000).cast("double")
    ms = F.when(ms <= 253402300799999.0, ms)
    parsed = [F.unix_millis(F.try_to_timestamp(F.when(t.rlike(_ISO), F.when(t.rlike(r"(Z|[+-]\d{2}:\d{2})$"), t).when(t.contains("T"), F.concat(t, F.lit("Z"))).otherwise(F.concat(t, F.lit("T00:00:00Z")))))).cast("double") for t in iso]
    return F.coalesce(ms, *parsed)


def iso_utc(ms: Column) -> Column:
    """yyyy-MM-ddTHH:mm:ss.SSSZ whatever the session's zone."""
    whole = F.floor(ms).cast("bigint")
    day = F.date_from_unix_date(F.floor(whole / 86_400_000).cast("int"))
    rest = F.pmod(whole, F.lit(86_400_000))
    two = lambda c: F.lpad(c.cast("bigint").cast("string"), 2, "0")
    clock = F.concat(two(F.floor(rest / 3_600_000)), F.lit(":"), two(F.floor(rest / 60_000) % 60), F.lit(":"), two(F.floor(rest / 1000) % 60), F.lit("."), F.lpad((rest % 1000).cast("string"), 3, "0"))
    return F.concat(day.cast("string"), F.lit("T"), clock, F.lit("Z"))


def minute(iso: Column) -> Column:
    """yyyy-MM-dd HH:mm of an ISO text."""
    return F.regexp_replace(F.substring(iso, 1, 16), "T", " ")


def file_stem(text: Column, empty: str | None = None) -> Column:
    """A safe file name: other characters become _, outer _ go, 120 characters at most; `empty` where nothing is left."""
    safe = F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9_-]", "_"), r"^_+|_+$", "")
    stem = F.nullif(F.substring(safe, 1, 120), F.lit(""))
    return stem if empty is None else F.coalesce(stem, F.lit(empty))


def bar_percent(value: Column, most: Column) -> Column:
    """Length of a bar: 3 at least, 0 where there is no scale."""
    return F.when(most > 0, F.greatest(F.lit(3), F.floor(value * 100 / most + 0.5).cast("int"))).otherwise(0)


def short_path(path: Column) -> Column:
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.when(F.size(parts) <= 3, path).otherwise(F.concat(F.lit("…/"), F.array_join(F.slice(parts, -3, 3), "/")))


def key_value(text: Column, key: str, home: str = "") -> Column:
    """The value of the first `key: value` line: quotes go, ~/ becomes the home folder, blank is null."""
    held = F.nullif(F.regexp_extract(text, rf"(?m)^[ \t]*{key}:[ \t]*(.+?)[ \t]*$", 1), F.lit(""))
    held = F.regexp_replace(held, r"""^(['"])(.*)\1$""", "$2")
    return clean(F.when(held.startswith("~/"), F.concat(F.lit(home.rstrip("/") + "/"), F.substring(held, 3, 1 << 20))).otherwise(held))
