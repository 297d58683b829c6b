"""Nested JSON text to flat rows, each linked to its parent object and its row, over Arrow buffers.

A batch of texts is one byte buffer with offsets, whose structure is a `Tape`. The parent of a container is the last
container opened one level up, found for a whole level by one search (the parent-index kernel), and paths go from parents to
children by a vectorised take, a level at a time. No row is parsed in Python. Strings that hold the text of an object or
array are taken out, decoded and put through the same kernels with the path where they stood, until none is left. What is
JSON is decided by the tape alone, for texts and for texts in strings.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.functions.json_tape import BLANK, CLOSE, COLON, OPEN, TOKENS, Tape, substrings

#: Bytes of text that go through the kernels at once; a longer text is a slice of its own.
SLICE_BYTES = 16 << 20
_CONTAINER = r"^[ \t\n\r]*[{\[]"


def joined(*parts: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(*parts, pa.scalar("", pa.large_string()))


def step(tape: Tape, at: np.ndarray, level: int, parent: np.ndarray, name: np.ndarray) -> pa.Array:
    """How a path goes on from the parents, of `level`, to what stands at the positions; name: its key's string."""
    commas = tape.commas[level - 1]
    index = np.searchsorted(commas, at) - np.searchsorted(commas, tape.begin[parent])
    inside = tape.is_object[parent]
    keys = substrings(tape.data, tape.first[name[inside]] + 1, tape.last[name[inside]], b".")
    if pc.any(pc.match_substring(keys, "\\")).as_py():
        keys = joined(pa.scalar(".", pa.large_string()), tape.decoded(tape.first[name[inside]], tape.last[name[inside]]))
    slots = joined(pa.scalar("[", pa.large_string()), pa.array(index[~inside]).cast(pa.large_string()), pa.scalar("]", pa.large_string()))
    where = np.empty(len(at), np.int64)
    where[np.flatnonzero(inside)], where[np.flatnonzero(~inside)] = np.arange(inside.sum()), inside.sum() + np.arange((~inside).sum())
    return pa.concat_arrays([keys, slots.cast(pa.large_string())]).take(pa.array(where))


def flatten_texts(texts: pa.Array, rows: np.ndarray, values: bool = False, fields: bool = False) -> pa.Table:
    """row, parent_path, path (and value, the object's own text) of every object that is an element of an array. With
    `fields`, its contents instead: row, parent_path, path of the object, and name, type, value of each field."""
    found: list[pa.Table] = []
    base = elder = grand = pa.array(["$"] * len(texts), pa.large_string())
    element = np.zeros(len(texts), bool)
    tape = Tape(texts)
    while len(tape.ends):
        # of each container: path, nearest enclosing object that is an element (or the base), the one around that, whether
        # it is one itself
        paths, elders, grands, emitted = [], [], [], []
        place = np.zeros(len(tape.begin), np.int64)  # within its level
        for level, own in enumerate(tape.of_level, 1):
            place[own] = np.arange(len(own))
            at = tape.begin[own]
            if level == 1:
                row = tape.row(at)
                paths.append(base.take(pa.array(row)))
                elders.append(elder.take(pa.array(row)))
                if fields:
                    grands.append(grand.take(pa.array(row)))
                emitted.append(element[row] & tape.is_object[own])
            else:
                parent = tape.holder(at, level - 1)
                name = np.searchsorted(tape.last, at) - 1
                up = pa.array(place[parent])
                paths.append(joined(paths[-1].take(up), step(tape, at, level - 1, parent, name)))
                if fields:
                    grands.append(_below(elders[-1], grands[-1], emitted[-1]).take(up))
                elders.append(_below(paths[-2], elders[-1], emitted[-1]).take(up))
                emitted.append(~tape.is_object[parent] & tape.is_object[own])
            if emitted[-1].any() and not fields:
                take = pa.array(np.flatnonzero(emitted[-1]))
                at = at[emitted[-1]]
                table = {"row": pa.array(rows[tape.row(at)]), "parent_path": elders[-1].take(take), "path": paths[-1].take(take)}
                if values:
                    shut = tape.at[(tape.kind == CLOSE) & (tape.depth == level - 1)]
                    table["value"] = substrings(tape.data, at, shut[np.searchsorted(shut, at)] + 1)
                found.append(pa.table(table))
        inner, opened, following = _encoded(tape, rows, base, elder, grand, place, paths, elders, grands, emitted)
        if fields:
            found += _fields(tape, rows, opened, place, paths, elders, grands, emitted)
        if len(tape.deep):
            more = []
            for k in tape.deep.tolist():
                found += _walk(tape.text(k), int(rows[k]), (base[k].as_py(), elder[k].as_py(), grand[k].as_py(), bool(element[k])), values, fields, more)
            if more:
                inner = Tape(pa.concat_arrays([substrings(inner.data, inner.starts, inner.ends), pa.array([m[0] for m in more], pa.large_string())]))
                added = [np.array([m[1] for m in more], np.int64), *(pa.array([m[k] for m in more], pa.large_string()) for k in (2, 3, 4)), np.array([m[5] for m in more], bool)]
                following = [np.concatenate((x, y)) if isinstance(x, np.ndarray) else pa.concat_arrays([x, y]) for x, y in zip(following, added, strict=True)]
        tape, (rows, base, elder, grand, element) = inner, following
    added = ["parent_path", "path", *(["name", "type", "value"] if fields else ["value"] * values)]
    return pa.concat_tables(found) if found else pa.table({"row": pa.array([], pa.int64())} | {c: pa.array([], pa.large_string()) for c in added})


def _walk(text: str, row: int, start: tuple[str, str, str, bool], values: bool, fields: bool, inner: list[tuple]) -> Iterator[pa.Table]:
    """What the levels give, for one text that nests too deeply to be worked through level by level: token by token, with a
    stack of its own, paths written out only where something comes out. Strings to open are added to `inner`."""
    base, elder, grand, element = start
    path, stack, out = [base], [], []  # stack: object?, place, elder, grand, emitted, own path, begin, row of the result, key
    previous, bare = "", None

    def around(frame) -> tuple[str, str]:
        return (frame[5], frame[2]) if frame[4] else (frame[2], frame[3])

    def part(frame) -> str:
        return f".{frame[8]}" if frame[0] else f"[{frame[1]}]"

    def put(frame, name: str, kind: str, value: str | None) -> None:
        near, parent = around(frame)
        if near != "$":
            out.append((parent, near, name[len(near) + 1 :], kind, value))

    for m in TOKENS.finditer(text):
        token = m.group()
        if token in "{[":
            if stack:
                top = stack[-1]
                path.append(part(top))
                near, parent = around(top)
                emitted = token == "{" and not top[0]
            else:
                near, parent, emitted = elder, grand, element and token == "{"
            own = "".join(path) if emitted else None
            stack.append([token == "{", 0, near, parent, emitted, own, m.start(), len(out), None])
            if emitted and not fields:
                out.append([near, own])
        elif token in "}]":
            top = stack.pop()
            if top[4] and values and not fields:
                out[top[7]].append(text[top[6] : m.end()])
            if fields and previous in "{[" and not top[4] and top[2] != "$":
                whole = "".join(path)
                out.append((top[3], top[2], whole[len(top[2]) + 1 :], "object" if top[0] else "array", "{}" if top[0] else "[]"))
            path.pop()
        elif token == ",":
            stack[-1][1] += 1
        elif token != ":":
            top = stack[-1]
            if top[0] and previous in "{,":
                top[8] = json.loads(token)
            else:
                value = json.loads(token) if token[0] == '"' else None
                if value is not None and value.lstrip(" \t\n\r")[:1] in ("{", "[") and Tape(pa.array([value], pa.large_string())).valid[0]:
                    near, parent = around(top)
                    inner.append((value, row, "".join(path) + part(top), near, parent, not top[0]))
                elif fields:
                    kind, bare = ("string", value) if value is not None else ("null", None) if token == "null" else ("boolean" if token[0] in "tf" else "number", token)
                    put(top, "".join(path) + part(top), kind, bare)
        previous = token
    if out:
        names = ["parent_path", "path", *(["name", "type", "value"] if fields else ["value"] * values)]
        columns = zip(*out, strict=True)
        yield pa.table({"row": pa.array([row] * len(out), pa.int64())} | {n: pa.array(c, pa.large_string()) for n, c in zip(names, columns, strict=True)})


def _below(path: pa.Array, elder: pa.Array, emitted: np.ndarray) -> pa.Array:
    return pc.if_else(pa.array(emitted), path, elder) if emitted.any() else elder


def _fields(tape: Tape, rows, opened, place, paths, elders, grands, emitted) -> Iterator[pa.Table]:
    """Scalars, and empty arrays and objects, within objects that are elements, named by their path from the nearest one.
    Strings that start at `opened` are containers of the next batch."""
    # a value follows an opened array, a comma of an array or a colon, and goes on to the next mark
    slot = np.flatnonzero((tape.kind[:-1] != CLOSE) & (tape.kind[1:] != OPEN))
    begin, end = tape.at[slot] + 1, tape.at[slot + 1]
    while (blank := (begin < end) & BLANK[tape.data[np.minimum(begin, len(tape.data) - 1)]]).any():
        begin = begin + blank
    while (blank := (begin < end) & BLANK[tape.data[end - 1]]).any():
        end = end - blank
    colon, level = tape.kind[slot] == COLON, tape.depth[slot]
    empty = begin == end
    hollow = np.isin(tape.begin, tape.at[slot[empty]])
    scalar = np.flatnonzero(~empty & ~np.isin(begin, opened))
    scalar = scalar[np.argsort(level[scalar], kind="stable")]
    bounds = np.searchsorted(level[scalar], np.arange(1, len(tape.of_level) + 2))
    for k, own in enumerate(tape.of_level, 1):
        path, parent = _below(paths[k - 1], elders[k - 1], emitted[k - 1]), _below(elders[k - 1], grands[k - 1], emitted[k - 1])
        inside = pc.not_equal(path, "$").to_numpy(zero_copy_only=False)
        which = scalar[bounds[k - 1] : bounds[k]]
        holder = tape.holder(begin[which], k) if len(which) else which
        good = inside[place[holder]] & (colon[which] | ~tape.is_object[holder])
        which, holder = which[good], holder[good]
        if len(which):
            up = pa.array(place[holder])
            name = np.maximum(np.searchsorted(tape.last, begin[which]) - 1, 0)  # the key of a field in an object
            full = joined(paths[k - 1].take(up), step(tape, begin[which], k, holder, name))
            kind, value = _scalars(tape, begin[which], end[which])
            path, parent = path.take(up), parent.take(up)
            yield pa.table({"row": pa.array(rows[tape.row(begin[which])]), "parent_path": parent, "path": path, "name": _from(full, path), "type": kind, "value": value})
        bare = np.flatnonzero(hollow[own] & ~emitted[k - 1] & pc.not_equal(elders[k - 1], "$").to_numpy(zero_copy_only=False))
        if len(bare):
            take = pa.array(bare)
            path = elders[k - 1].take(take)
            kind = pa.array(np.where(tape.is_object[own[bare]], "object", "array"), pa.large_string())
            value = pa.array(np.where(tape.is_object[own[bare]], "{}", "[]"), pa.large_string())
            yield pa.table({"row": pa.array(rows[tape.row(tape.begin[own[bare]])]), "parent_path": grands[k - 1].take(take), "path": path, "name": _from(paths[k - 1].take(take), path), "type": kind, "value": value})


def _from(path: pa.Array, start: pa.Array) -> pa.Array:
    """Paths without the path of the object where they start, and the dot after it."""
    path, start = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (path, start))
    ends = np.frombuffer(path.buffers()[1], np.int64)[path.offset : path.offset + len(path) + 1]
    data = np.frombuffer(path.buffers()[2], np.uint8)
    return substrings(data, ends[:-1] + pc.binary_length(start).to_numpy(zero_copy_only=False).astype(np.int64) + 1, ends[1:])


def _scalars(tape: Tape, begin: np.ndarray, end: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Type and value of JSON scalars: strings decoded, numbers and booleans as written, null for null."""
    kinds = np.array(["number", "string", "boolean", "null"])
    lead = tape.data[begin]
    kind = (lead == 0x22) * 1 + ((lead == 0x74) | (lead == 0x66)) * 2 + (lead == 0x6E) * 3
    quoted = kind == 1
    value = substrings(tape.data, begin, end)
    if quoted.any():
        value = pc.replace_with_mask(value, pa.array(quoted), tape.decoded(begin[quoted], end[quoted] - 1))
    value = pc.if_else(pa.array(kind == 3), pa.scalar(None, pa.large_string()), value)
    return pa.array(kinds[kind], pa.large_string()), value


def _encoded(tape: Tape, rows, base, elder, grand, place, paths, elders, grands, emitted):
    """String values that are the text of an object or array: their tape, where they start, and with where they stand the
    next batch: rows, base, elder, grand, whether each is an element."""
    at = tape.first + 1
    most = max(len(tape.data) - 1, 0)
    while (blank := BLANK[tape.data[np.minimum(at, most)]] & (at < tape.last)).any():
        at = at + blank
    lead = tape.data[np.minimum(at, most)] if len(at) else np.empty(0, np.uint8)
    following = np.minimum(np.searchsorted(tape.at, tape.last), max(len(tape.at) - 1, 0))
    is_key = (tape.kind[following] == COLON) & (tape.at[following] > tape.last) if len(tape.at) else np.zeros(len(at), bool)
    # an escape in front may stand for white space or for the bracket
    which = np.flatnonzero(((lead == 0x7B) | (lead == 0x5B) | (lead == 0x5C)) & (at < tape.last) & ~is_key)
    texts = tape.decoded(tape.first[which], tape.last[which])
    able = pc.match_substring_regex(texts, _CONTAINER).to_numpy(zero_copy_only=False) if len(which) else np.zeros(0, bool)
    inner = Tape(texts.filter(pa.array(able)))
    name, texts = which[able][inner.valid], texts.filter(pa.array(able)).filter(pa.array(inner.valid))
    at = tape.first[name]
    before = np.searchsorted(tape.at, at) - 1
    # marks of another text before a string that stands alone aren't its container's
    level = np.where((before >= 0) & (tape.row(at) == tape.row(tape.at[np.maximum(before, 0)])), tape.depth[np.maximum(before, 0)], 0) if len(tape.at) else np.zeros(len(at), np.int64)
    row = tape.row(at)
    top = pa.array(row[level == 0])
    out_base, out_elder, out_grand, flags, order = [base.take(top)], [elder.take(top)], [grand.take(top)], [np.zeros((level == 0).sum(), bool)], [np.flatnonzero(level == 0)]
    for k in np.unique(level[level > 0]):
        own = np.flatnonzero(level == k)
        parent = tape.holder(at[own], int(k))
        up = pa.array(place[parent])
        # the key of a string value is the string before it
        out_base.append(joined(paths[k - 1].take(up), step(tape, at[own], int(k), parent, np.maximum(name[own] - 1, 0))))
        out_elder.append(_below(paths[k - 1], elders[k - 1], emitted[k - 1]).take(up))
        # without fields nothing reads it
        out_grand.append(_below(elders[k - 1], grands[k - 1], emitted[k - 1]).take(up) if grands else out_elder[-1])
        flags.append(~tape.is_object[parent])
        order.append(own)
    order = np.concatenate(order)
    if len(order) and not ((np.diff(order) > 0).all() and len(order) == len(inner.ends)):
        inner = Tape(texts.take(pa.array(order)))
    elif not len(order):
        inner = Tape(pa.array([], pa.large_string()))
    return inner, at, [rows[row[order]], *(pa.concat_arrays(x) for x in (out_base, out_elder, out_grand)), np.concatenate(flags)]


def array_objects(df: DataFrame, keys: list[str], text: str, values: bool = False, fields: bool = False) -> DataFrame:
    """Every object that is an element of an array, at any depth of the JSON in column `text`: the key columns,
    parent_path, path, and if asked for `value`, the object's own text. With `fields`, one row for each field of these
    objects instead: name, type and value besides. Fields are scalars and empty arrays and objects, which belong to the
    nearest object around them that is an element; a name is the path from there, such as `a`, `a.b` or `a[0]`.

    parent_path is the nearest enclosing object that is itself an element, else '$'. Null, blank and broken text, and
    JSON without arrays of objects, give no rows; repeated rows give their rows each, and so do repeated keys of one object;
    other columns don't matter. Nesting has no limit of depth.
    """
    schema = df.select(*keys).schema
    added = ["parent_path", "path", *(["name", "type", "value"] if fields else ["value"] * values)]
    clash = set(added) & set(keys)
    if clash:
        raise ValueError(f"key columns are named like results: {sorted(clash)}")
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), *(f"{c} string" for c in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keys))
            ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            begin = 0
            while begin < len(texts):
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + SLICE_BYTES, side="right")))
                part = flatten_texts(texts.slice(begin, end - begin), np.arange(begin, end), values, fields)
                if part.num_rows:
                    keep = part.column("row").combine_chunks()
                    columns = [*(batch.column(i).take(keep) for i in range(len(keys))), *(part.column(c).combine_chunks().cast(pa.string()) for c in added)]
                    yield pa.RecordBatch.from_arrays(columns, names=[*keys, *added])
                begin = end

    # an array needs its bracket, as it is or by its number
    held = df.where(F.col(text).contains("[") | F.col(text).contains("u005")).select(*keys, F.col(text).alias("__text"))
    return held.mapInArrow(run, out)


def nested_objects(columns: list[tuple[str, str, DataFrame]], key: str = "pos", values: bool = False, fields: bool = False) -> DataFrame:
    """`array_objects` over (table name, column, table) triples, as rows tbl, col, key, parent_path, path."""
    texts = None
    for table, column, df in columns:
        part = df.select(F.lit(table).alias("tbl"), F.lit(column).alias("col"), key, F.col(column).alias("text"))
        texts = part if texts is None else texts.unionByName(part)
    return array_objects(texts, ["tbl", "col", key], "text", values, fields)
