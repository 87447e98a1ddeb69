"""Documents of any values against plain JSON: taken apart, changed, put together."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import variants

VALUES = [1, -7, 0.5, True, False, None, "text", "", "ü \"q\" \\ , ]", [], {}, 12345678901234, "1"]


def made(rng, depth=3):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice(VALUES)
    if rng.random() < 0.4:
        return [made(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice(["a", "b", "c d", "é", "0", "x'y"]): made(rng, depth - 1) for _ in range(rng.randint(0, 4))}


def leaves(value, path=""):
    if isinstance(value, (dict, list)) and value:
        items = value.items() if isinstance(value, dict) else enumerate(value)
        return [x for k, v in items for x in leaves(v, f"{path}.{k}" if path else str(k))]
    return [(path, value)]


def frame(spark, documents):
    rows = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(documents)], "id int, t string")
    return rows.select("id", F.parse_json("t").alias("d"))


def test_flatten_and_regroup(spark):
    rng = random.Random(7)
    documents = [made(rng) for _ in range(60)] + [None, {"deep": [[[{"x": [1, {"y": 2}]}]]]}, [["a"] * 12], {"n": list(range(11))}]
    flat = variants.flatten(frame(spark, documents), "id", "d")
    got = sorted((r.id, r.path, r.v) for r in flat.select("id", "path", F.to_json("value").alias("v")).collect())
    assert [(k, p, json.loads(v)) for k, p, v in got] == [(k, p, v) for k, p, v in sorted(((k, p, v) for k, d in enumerate(documents) for p, v in leaves(d)), key=lambda x: x[:2])]
    back = {r.id: r.document for r in variants.regroup(flat, "id").collect()}
    assert {k: json.loads(t) for k, t in back.items()} == dict(enumerate(documents))
    assert back[len(documents) - 1] == '{"n":[0,1,2,3,4,5,6,7,8,9,10]}'


def test_get_tells_missing_from_null(spark):
    rows = frame(spark, [{"a": {"b": None, "n": 3, "t": "x", "l": [1, {"z": False}]}}, {"a": 1}])
    get = lambda path, kind="variant": variants.get(F.col("d"), path, kind)
    one, two = rows.orderBy("id").select(get("a.b")["found"].alias("null"), get("a.q")["found"].alias("gone"), get("a.n", "int")["value"].alias("n"), get("a.t", "int")["value"].alias("t"), get("a.l.1.z", "boolean")["value"].alias("z"), F.to_json(get("a.l")["value"]).alias("l")).collect()
    assert tuple(one) == (True, False, 3, None, False, '[1,{"z":false}]') and tuple(two) == (False, False, None, None, None, None)
    same = rows.select(variants.same(get("a.n")["value"], F.parse_json(F.lit("3"))).alias("s"), variants.same(get("a.n")["value"], F.parse_json(F.lit('"3"'))).alias("t")).collect()
    assert (same[0].s, same[0].t) == (True, False)


def test_assign(spark):
    documents = [{"a": {"n": 1, "l": [1, 2]}, "m": "x"}, {"a": {"n": 5}}, {"a": {"o": {"p": 1, "q": 2}}}]
    flat = variants.flatten(frame(spark, documents), "id", "d")
    changes = [(0, "a.n", "true"), (0, "a.new", '{"k":[null,"1"]}'), (0, "a.l.1", "7"), (1, "a", '"flat"'), (1, "top", "null"), (2, "a.o.p", None), (2, "a.o.q", "[]")]
    after = variants.assign(flat, spark.createDataFrame(changes, "id int, path string, value string"), "id")
    got = {r.id: json.loads(r.document) for r in variants.regroup(after, "id").collect()}
    assert got == {0: {"a": {"n": True, "l": [1, 7], "new": {"k": [None, "1"]}}, "m": "x"}, 1: {"a": "flat", "top": None}, 2: {"a": {"o": {"q": []}}}}
    for lost in ((0, "none.x", "1"), (0, "m.x", "1"), (0, "a.l.x", "1")):
        with pytest.raises(Exception, match="no object above"):
            variants.assign(flat, spark.createDataFrame([lost], "id int, path string, value string"), "id").collect()


def test_names_with_dots_are_an_error(spark):
    with pytest.raises(Exception, match="with a dot"):
        variants.flatten(frame(spark, [{"a.b": 1}]), "id", "d").collect()
    assert variants.flatten(frame(spark, [{"a": 1}]).limit(0), "id", "d").count() == 0
