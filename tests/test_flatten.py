"""Flattening against a recursive walk of parsed values."""

import json
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernel.functions import json_tape
from quernel.functions.json_tape import Tape, filled, opened
from quernel.operators.flatten import array_objects, flatten_texts, nested_objects
from quernel.plans.core_queries import QUERIES
from tests.conftest import rows


def walked(text):
    out = []

    def opened(v):
        while isinstance(v, str):
            try:
                w = json.loads(v)
            except ValueError:
                return v
            if not isinstance(w, dict | list):
                return v
            v = w
        return v

    def walk(v, path, elder, element):
        v = opened(v)
        if isinstance(v, dict):
            if element:
                out.append((elder, path))
                elder = path
            for k, x in v.items():
                walk(x, f"{path}.{k}", elder, False)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, f"{path}[{i}]", elder, True)

    try:
        walk(json.loads(text), "$", "$", False)
    except ValueError:
        pass
    return out


text = st.text(alphabet='ab"\\{}[],: \n中é', max_size=6)
leaf = st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | text
plain = st.recursive(leaf, lambda x: st.lists(x, max_size=4) | st.dictionaries(text, x, max_size=4), max_leaves=20)
nested = st.recursive(leaf | plain.map(json.dumps), lambda x: st.lists(x, max_size=4) | st.dictionaries(text, x, max_size=4), max_leaves=20)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(nested, st.booleans(), st.sampled_from([None, 1])), max_size=6))
def test_walk(values):
    texts = [json.dumps(v, ensure_ascii=a, indent=i) for v, a, i in values]
    got = flatten_texts(pa.array(texts, pa.string()), np.arange(len(texts)), True)
    found = sorted(zip(got["row"].to_pylist(), got["parent_path"].to_pylist(), got["path"].to_pylist(), strict=True))
    assert found == sorted((k, *x) for k, t in enumerate(texts) for x in walked(t))
    assert all(isinstance(json.loads(v), dict) for v in got["value"].to_pylist())


def test_broken_text_among_good(spark):
    good = '{"a": [{"b": 1}]}'
    cases = [good, '{"a": [{"b": 1}]', '{"a": [{"b": 1}]} x', "", None, "null", '"[{}]"', "[{}, [{}]]", '{"a": [{"b": 1},]}', "{'a': [{}]}", '{"a": "]{"}', good]
    assert Tape(pa.array([cases[1], good])).valid.tolist() == [False, True]
    df = spark.createDataFrame(list(enumerate(cases)), "pos bigint, text string").withColumnRenamed("text", "properties")
    want = [(0, "$", "$.a[0]"), (6, "$", "$[0]"), (7, "$", "$[0]"), (7, "$", "$[1][0]"), (11, "$", "$.a[0]")]
    assert rows(array_objects(df, ["pos"], "properties")) == sorted(want, key=repr)
    got = flatten_texts(pa.array([cases[1], good, cases[2]]), np.array([5, 6, 7]))
    assert got["row"].to_pylist() == [6]


def is_json(text):
    def no(_):
        raise ValueError

    try:
        json.loads(text, parse_constant=no)
    except ValueError:
        return False
    return True


pieces = st.sampled_from(["{", "}", "[", "]", ",", ":", '"', '"a"', "1", "-0.5e3", "01", "1.", "true", "nul", "NaN", "\\", "\\u00e9", "\\x", " ", "\n", "\t", "中", "\x01", "'", "{}", "[1]", '"a":'])


@settings(max_examples=500, deadline=None)
@given(st.lists(st.lists(pieces, max_size=7).map("".join) | st.tuples(nested.map(json.dumps), pieces, st.integers(0, 30)).map(lambda t: t[0][: t[2]] + t[1] + t[0][t[2] :]), max_size=5))
def test_what_is_json(texts):
    assert Tape(pa.array(texts, pa.string())).valid.tolist() == [is_json(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(nested, max_size=5))
def test_deep_walk_gives_the_same(values):
    texts = pa.array([json.dumps(v) for v in values], pa.string())
    for fields in (False, True):
        names = FIELDS if fields else (*FIELDS[:3], "value")
        got = []
        for deep in (256, 1):
            before, json_tape.DEEP = json_tape.DEEP, deep
            try:
                t = flatten_texts(texts, np.arange(len(texts)), not fields, fields)
            finally:
                json_tape.DEEP = before
            got.append(sorted(zip(*(t[c].to_pylist() for c in names), strict=True), key=repr))
        assert got[0] == got[1]


def test_one_notion_of_json(spark):
    inner = "[" * 1100 + "{}" + "]" * 1100
    cases = [inner, json.dumps({"k": inner}), '{"a":[{"b":1},{"b":2,"b":3}]}', json.dumps({"k": '[{"x":NaN}]'}), '[{"x":NaN}]', json.dumps({"k": "[{}]\x00"}), '["\\u005b{}]"]', "[" * 100_000 + "{}" + "]" * 100_000, json.dumps(["[" * 100_000 + "{}" + "]" * 100_000])]
    df = spark.createDataFrame(list(enumerate(cases)), "pos bigint, j string")
    got = rows(array_objects(df, ["pos"], "j").select("pos", "parent_path", F.xxhash64("path")))
    want = [(0, "$", "$" + "[0]" * 1100), (1, "$", "$.k" + "[0]" * 1100), (2, "$", "$.a[0]"), (2, "$", "$.a[1]"), (6, "$", "$[0][0]"), (7, "$", "$" + "[0]" * 100_000), (8, "$", "$[0]" + "[0]" * 100_000)]
    assert got == rows(spark.createDataFrame(want, "pos bigint, parent_path string, path string").select("pos", "parent_path", F.xxhash64("path")))
    many = json.dumps({"a": 1})
    for _ in range(8):
        many = json.dumps([{"x": many}])  # an encoded text in an encoded text, eight deep
    assert array_objects(spark.createDataFrame([(1, many)], "pos bigint, j string"), ["pos"], "j").count() == 8


def test_filled():
    object_ = '{"a": 1, "b": " \u3000", "c": [ ], "d": {}, "e": null, "f": "[ ]", "g": "{}", "h": [0], "i": {"x": null}, "j": false, "k": "x\\n", "l": ""}'
    encoded = object_
    for _ in range(6):
        encoded = json.dumps(encoded)
    deep = '{"a": ' + "[" * 2000 + "]" * 2000 + ', "b": [], "c": {"d": 1}, "e": " ", "f": 0}'
    texts = [object_, encoded, None, "", "[1]", '"text"', '{"a": 1', '{"a": 1} x', '{"a": 1, "a": ""}', '{"a": "", "a": 1}', deep, "{}", '"{\\"a\\": 1}"', " {}"]
    assert filled(pa.array(texts, pa.string())).tolist() == [5, 5, 0, 0, 0, 0, 0, 0, 0, 1, 3, 0, 1, 0]
    assert filled(pa.array([], pa.string())).tolist() == []
    assert opened(pa.array([encoded]))[0].to_pylist() == [object_]


def test_tables(spark):
    df = spark.createDataFrame([(1, '[{"x": {"y": [{"z": 2}]}}]', "t", "p", "c")], "pos bigint, j string, tbl string, path string, col string")
    out = nested_objects([("n", "j", df)], values=True)
    assert rows(out) == [("n", "j", 1, "$", "$[0]", '{"x": {"y": [{"z": 2}]}}'), ("n", "j", 1, "$[0]", "$[0].x.y[0]", '{"z": 2}')]
    assert nested_objects([("n", "j", df.limit(0))]).count() == 0


def test_long_and_deep(spark):
    long = "[" + ",".join('{"a":"' + "x" * 50 + '"}' for _ in range(60_000)) + "]"
    deep = "[" * 400 + "{}" + "]" * 400
    df = spark.createDataFrame([(1, long), (2, deep), (3, '{"a": "' + "[" * 2_000_000 + '"}')], "pos bigint, j string")
    got = array_objects(df, ["pos"], "j").groupBy("pos").count()
    assert rows(got) == [(1, 60_000), (2, 1)]


def walked_fields(text):
    out = []

    def opened(v):
        while isinstance(v, str):
            try:
                w = json.loads(v)
            except ValueError:
                return v
            if not isinstance(w, dict | list):
                return v
            v = w
        return v

    def walk(v, path, owner, element):  # owner: parent_path and path
        v = opened(v)
        if isinstance(v, dict) and element:
            owner = (owner[1], path)
        elif owner[1] != "$" and (v in ({}, []) or not isinstance(v, dict | list)):
            kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(v), "number")
            out.append((*owner, path[len(owner[1]) + 1 :], kind, None if v is None else v if isinstance(v, str) else json.dumps(v)))
        for k, x in v.items() if isinstance(v, dict) else ():
            walk(x, f"{path}.{k}", owner, False)
        for i, x in enumerate(v) if isinstance(v, list) else ():
            walk(x, f"{path}[{i}]", owner, True)

    try:
        walk(json.loads(text), "$", ("$", "$"), False)
    except ValueError:
        pass
    return out


FIELDS = ("row", "parent_path", "path", "name", "type", "value")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(nested, st.booleans(), st.sampled_from([None, 1])), max_size=6))
def test_walk_fields(values):
    texts = [json.dumps(v, ensure_ascii=a, indent=i) for v, a, i in values]
    got = flatten_texts(pa.array(texts, pa.string()), np.arange(len(texts)), fields=True)
    found = sorted(zip(*(got[c].to_pylist() for c in FIELDS), strict=True), key=repr)
    assert found == sorted(((k, *x) for k, t in enumerate(texts) for x in walked_fields(t)), key=repr)


def test_fields(spark):
    text = '{"n": 0, "a": [{"b": 1.50, "s": "x\\"\\u00e9", "t": true, "z": null, "o": {"p": "q"}, "l": [1, [], {"m": 2}], "e": {}, "j": "{\\"k\\": [{\\"u\\": 3}]}"}, {}, 7]}'
    df = spark.createDataFrame([(1, text), (2, None), (3, '{"a": [{"b": 1}')], "pos bigint, j string")
    own, inner, deep = ("n", "j", 1, "$", "$.a[0]"), ("n", "j", 1, "$.a[0]", "$.a[0].l[2]"), ("n", "j", 1, "$.a[0]", "$.a[0].j.k[0]")
    want = [
        (*own, "b", "number", "1.50"), (*own, "s", "string", 'x"é'), (*own, "t", "boolean", "true"), (*own, "z", "null", None), (*own, "o.p", "string", "q"),
        (*own, "l[0]", "number", "1"), (*own, "l[1]", "array", "[]"), (*own, "e", "object", "{}"), (*inner, "m", "number", "2"), (*deep, "u", "number", "3"),
    ]
    assert rows(nested_objects([("n", "j", df)], fields=True)) == sorted(want, key=repr)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test data")
def test_fields_of_tables(spark):
    sf = "/root/testdata/sf0.001"
    want = []
    for table, column in (("kg_nodes", "properties"), ("kg_nodes", "metadata"), ("kg_edges", "properties")):
        for r in spark.read.parquet(f"{sf}/{table}.parquet").select("pos", column).where(f"{column} is not null").collect():
            want += [(table, column, r[0], *x[:4]) for x in walked_fields(r[1])]
    got = [tuple(r)[:7] for r in QUERIES["p6_fields"](spark, sf).collect()]
    assert len(want) > 1000 and sorted(got) == sorted(want)
