import json

import pytest

from setlight.operators import variants as V


def merged(spark, base, mine, theirs, depth=4):
    frame = lambda doc: spark.createDataFrame([(1, doc)] if doc is not None else [], "id long, doc string")
    rows = V.three_way_documents(*[frame(None if d is None else json.dumps(d)) for d in (base, mine, theirs)], "id", "doc", depth)
    out = [r[0] for r in rows.selectExpr("to_json(doc)").collect()]
    return json.loads(out[0]) if out else None


@pytest.mark.parametrize(
    ("base", "mine", "theirs", "wanted"),
    [
        ({"a": 1}, {"a": 2}, {"a": 1, "futureFeatureData": {"nested": {"keep": True}}}, {"a": 2, "futureFeatureData": {"nested": {"keep": True}}}),
        ({"f": {"x": {"p": 1, "q": 1}}}, {"f": {"x": {"p": 2, "q": 1}}}, {"f": {"x": {"p": 1, "q": 3}, "new": []}}, {"f": {"x": {"p": 2, "q": 3}, "new": []}}),
        ({"a": 1, "b": 1}, {"b": 1}, {"a": 1, "b": 2}, {"b": 2}),
        ({"a": 1}, {}, {"a": 5}, {"a": 5}),
        ({"a": 1, "c": 1}, {"a": 2, "c": 1}, {"c": 1}, {"a": 2, "c": 1}),
        ({"a": [1]}, {"a": [1, 2]}, {"a": [1, 3]}, {"a": [1, 2]}),
        ({"a": None}, {"a": None}, {"a": 1}, {"a": 1}),
        ({"a": 1}, {"a": None}, {"a": 1}, {"a": None}),
        ({}, {"n": {"x": 1}}, {"n": {"y": 2}}, {"n": {"x": 1, "y": 2}}),
        ({"n": 1}, {"n": {"x": 1}}, {"n": {"y": 2}}, {"n": {"x": 1}}),
        ({"a": 1}, None, {"a": 1}, None),
        ({"a": 1}, None, {"a": 2}, {"a": 2}),
        ({"a": 1}, {"a": 1}, None, {"a": 1}),
        (None, {"a": 1}, {"b": 1}, {"a": 1, "b": 1}),
        (None, {"a": 1}, None, {"a": 1}),
        ([1], {"a": 1}, {"b": 2}, {"a": 1, "b": 2}),
    ],
)
def test_three_way_documents(spark, base, mine, theirs, wanted):
    assert merged(spark, base, mine, theirs) == wanted


def test_deeper_objects_are_one_value(spark):
    base, mine, theirs = ({"f": {"x": {"p": p, "q": q}}} for p, q in ((1, 1), (2, 1), (1, 3)))
    assert merged(spark, base, mine, theirs, depth=2) == mine


def test_known_fields(spark):
    rows = spark.createDataFrame([(1, '{"a": 5, "z": 1}'), (2, '{"a": "x"}')], "id long, doc string").selectExpr("id", "parse_json(doc) as doc")
    assert [r.a for r in V.known_fields(rows, "doc", {"a": "long"}).orderBy("id").collect()] == [5, None]
