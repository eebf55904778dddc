"""Indexes: the four modes, their look-ups, and what is refused."""

import pytest

from girder.operators import indexes as ix

KEYS = "name string, pos long, key_num long, key_str string, start long, stop long, mode string"
VALUES = "name string, pos long, value_num long, value_str string"


@pytest.fixture(scope="module")
def tables(spark):
    keys = [("descendants", 0, 100, None, 0, 3, "oneToNLinear"), ("descendants", 1, 202, None, 3, 6, "oneToNLinear")]
    keys += [("slices", k, k + 1, None, a, b, "oneToNNonLinear") for k, (a, b) in enumerate([(0, 1), (1, 4), (1, 3), (2, 2)])]
    keys += [("twice", 0, 7, None, 0, 1, "oneToOne"), ("twice", 1, 7, None, 1, 2, "oneToOne")]
    values = [("descendants", k, v, None) for k, v in enumerate([101, 102, 202, 300, 301, 302])] + [("slices", k, v, None) for k, v in enumerate([10, 20, 30, 40])] + [("twice", 0, 1, None), ("twice", 1, 2, None)]
    return spark.createDataFrame(keys, KEYS), spark.createDataFrame(values, VALUES)


def test_forward(spark, tables):
    asked = spark.createDataFrame([("descendants", 100), ("descendants", 202), ("descendants", 999), ("slices", 1), ("slices", 2), ("slices", 3), ("slices", 4), ("twice", 7)], "name string, key_num long")
    got = {(r.name, r.key_num): r["values"] for r in ix.forward(asked, *tables).collect()}
    assert got == {("descendants", 100): [101, 102, 202], ("descendants", 202): [300, 301, 302], ("descendants", 999): None, ("slices", 1): [10], ("slices", 2): [20, 30, 40], ("slices", 3): [20, 30], ("slices", 4): [], ("twice", 7): [2]}


def test_inverse_has_values_info(spark, tables):
    asked = spark.createDataFrame([("descendants", 301), ("descendants", 202), ("slices", 30)], "name string, value_num long")
    assert {(r.name, r.value_num): r["keys"] for r in ix.inverse(asked, *tables).collect()} == {("descendants", 301): [202], ("descendants", 202): [100], ("slices", 30): [2, 3]}
    there = ix.has(spark.createDataFrame([("descendants", 100), ("descendants", 1)], "name string, key_num long"), tables[0])
    assert {r.key_num: r.present for r in there.collect()} == {100: True, 1: False}
    assert {r.name: (r.key_type, r.value_type, r.size) for r in ix.info(*tables).collect()}["slices"] == ("number", "number", 4)


@pytest.mark.parametrize(
    ("values", "end", "start", "cause"),
    [
        ([1], None, None, {"type": "invalid-length", "field": "key values", "expected": 3, "actual": 1}),
        ([1, 2, 3, 4, 5], [0, 1, 2, 5], None, {"type": "invalid-length", "field": "key end", "expected": 3, "actual": 4}),
        ([1, 2, 3, 4, 5], [0, 3, 2], None, {"type": "invalid-bounds", "bounds": [{"index": 2, "start": 3, "end": 2}]}),
        ([1, 2, 3, 4, 5], [1, 2, 5], [0, 1], {"type": "invalid-length", "field": "key start", "expected": 3, "actual": 2}),
        ([1, 2, 3, 4, 5], [0, 1, 5], [0, 2, -1], {"type": "invalid-bounds", "bounds": [{"index": 1, "start": 2, "end": 1}, {"index": 2, "start": -1, "end": 5}]}),
        ([1, -2, 3], None, None, {"type": "invalid-number", "field": "value", "index": 1, "value": -2}),
        ([1, 2**32, 3], None, None, {"type": "invalid-number", "field": "value", "index": 1, "value": 2**32}),
    ],
)
def test_refused(values, end, start, cause):
    with pytest.raises(ix.InvalidIndex) as refused:
        ix.validate([10, 20, 30], values, end, start)
    assert refused.value.cause == cause


def test_modes():
    assert [ix.validate([1], *x) for x in ((None,), ([5],), ([5, 6], [2]), ([5, 6], [2], [1]))] == list(ix.MODES)
