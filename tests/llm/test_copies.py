"""The copy ledger against grouping in Python."""

import json
import random

from quernel.llm import copies as copies_
from quernel.llm.copies import CopyLedger, canonical_json, collapse, copies, keyed_nodes, representatives
from tests.conftest import rows

NODES = "pos bigint, id string, label string, properties string, key string, copies bigint, first bigint, copies_held int"


def frame(spark, nodes):
    return spark.createDataFrame([(*n, "k", 7, 7, 7) for n in nodes], NODES)


def pairs_of(spark, nodes, **how):
    keyed = keyed_nodes(frame(spark, nodes))
    return rows(copies(keyed, collapse(keyed, **how)))


def test_spellings(spark):
    nodes = [
        (1, "node-a_1", "Amber Relay 5", '{"a": 1, "b": [1, {"c": null}]}'), (2, " NODE A1", "«amber, relay» 5", '{"b":[1,{"c":null}],"a":1}'), (3, "node-a_1", "Amber Relay 5", '{"b": [{"c": null}, 1], "a": 1}'),
        (4, "node-a_1", "Amber Relay 5", None), (5, "nodea1", "amberrelay5", None), (6, "node-a_1", "Amber Relay 5", ""), (7, "node-a_1", "Amber Relay 5", "{broken"), (8, "node-a_1", "Amber Relay 5", "{broken"), (9, "node-a_1", "Amber Relay 5", "{broken "),
        (10, "x", None, None), (11, "X", "", None), (12, "x", "-", None), (13, None, "x", None), (14, "", "x", None), (15, "图1", "É", None), (16, "图-1", "é", None), (17, "node-a_1", "Amber Relay 5", "null"), (18, "1", "2", None), (19, "12", "", None), (20, "", "12", None),
    ]
    assert pairs_of(spark, nodes) == sorted([(1, 2), (4, 5), (7, 8), (10, 11), (10, 12), (13, 14), (15, 16)], key=repr)


def test_json_values(spark):
    same = ['{"x": 1.0, "y": "\\u4e2d"}', ' {"y":"中","x":1}\n']
    df = spark.createDataFrame([(t,) for t in [*same, '{"x": 1, "y": "中"} z', '"{}"', "{}", "[]", "1", '"1"']], "t string")
    got = [r[0] for r in df.select(canonical_json(df.t)).collect()]
    assert got[0] == got[1] and len(set(got)) == 7 and json.loads(got[0][1:]) == {"x": 1, "y": "中"}


def test_batches_and_hot_group(spark):
    nodes = [(k, "hot" if k % 3 else f"n{k % 50}", "l", None) for k in range(600)]
    want, first = [], {}
    for pos, i, *_ in nodes:
        if first.setdefault(i, pos) != pos:
            want.append((first[i], pos))
    for batches in (1, 7):
        assert pairs_of(spark, nodes, batches=batches, buckets=4) == sorted(want, key=repr)


BATCH = "key binary, pos bigint"


def held(ledger):
    return sorted((bytes(r.key), r.copies, r.first) for r in ledger.read().collect())


def test_ledger_goes_on_from_call_to_call(spark, tmp_path):
    rnd = random.Random(4)
    many = [(f"k{rnd.randrange(400)}".encode(), k) for k in range(3000)]
    path = f"file://{tmp_path}/ledger"
    for k in range(3):
        CopyLedger(spark, path, 6).add(spark.createDataFrame(many[k * 1000 : (k + 1) * 1000], BATCH), f"batch {k}")
    CopyLedger(spark, path).add(spark.createDataFrame(many[:1000], BATCH), "batch 0")  # again, after a break
    again = CopyLedger(spark, path)
    assert (again.buckets, again.version, again.batches) == (6, 3, ["batch 0", "batch 1", "batch 2"])
    whole = CopyLedger(spark, None, 5)
    whole.add(spark.createDataFrame(many, BATCH))
    assert held(again) == held(whole) and sum(c for _, c, _ in held(again)) == 3000


def test_only_touched_buckets_are_written_anew(spark, tmp_path):
    ledger = CopyLedger(spark, f"file://{tmp_path}/l", 8)
    ledger.add(spark.createDataFrame([(f"k{k}".encode(), k + 10) for k in range(100)], BATCH))
    before = dict(ledger.at)
    ledger.add(spark.createDataFrame([(b"k3", 1)], BATCH))
    ledger.add(spark.createDataFrame([], BATCH))
    changed = [b for b in ledger.at if ledger.at[b] != before[b]]
    assert len(before) == 8 and len(changed) == 1 and ledger.version == 2
    assert (b"k3", 2, 1) in held(ledger) and len(held(ledger)) == 100
    # the replaced version of the bucket is gone, the others are where they were
    assert sorted(p.name for p in (tmp_path / "l/v=1").glob("bucket=*")) == sorted(f"bucket={b}" for b in before if b not in changed)


def test_files_grow_with_the_ledger(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(copies_, "FILE_KEYS", 50)
    ledger = CopyLedger(spark, f"file://{tmp_path}/l", 2)
    ledger.add(spark.createDataFrame([(f"k{k}".encode(), k) for k in range(1000)], BATCH))
    files = [len(list(p.glob("*.parquet"))) for p in (tmp_path / "l/v=1").glob("bucket=*")]
    assert files == [10, 10] and len(held(ledger)) == 1000


def test_empty_and_long(spark):
    assert pairs_of(spark, []) == []
    long = '{"a": "' + "x" * 1_000_000 + '"}'
    nodes = [(1, "a" * 100_000, "l", long), (2, "A" * 100_000, "L", long)]
    assert pairs_of(spark, nodes) == [(1, 2)]
    keyed = keyed_nodes(frame(spark, nodes))
    got = representatives(frame(spark, nodes), keyed, collapse(keyed)).collect()
    assert [(r.pos, r.copies_held) for r in got] == [(1, 2)]
