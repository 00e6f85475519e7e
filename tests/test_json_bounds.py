"""Bounds of JSON texts against a walk over the parsed value."""

import json
import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ballast.operators import contracts

def plain(text: str | None, max_bytes: int, max_depth: int, max_nodes: int) -> str | None:
    def refuse(word):
        raise ArithmeticError(word)

    try:
        root = json.loads(text, parse_constant=refuse)
    except ArithmeticError:
        return "NOT_FINITE"
    except (TypeError, ValueError, RecursionError):
        return "NOT_JSON"
    if not isinstance(root, dict):
        return "NOT_OBJECT"
    level, depth, nodes = [root], 0, 0
    while level:
        nodes += len(level)
        if nodes > max_nodes:
            return "TOO_MANY_NODES"
        if depth > max_depth:
            return "TOO_DEEP"
        below = []
        for item in level:
            if isinstance(item, dict):
                below += list(item) + list(item.values())
            elif isinstance(item, list):
                below += item
            elif isinstance(item, float) and not math.isfinite(item):
                return "NOT_FINITE"
        level, depth = below, depth + 1
    packed = json.dumps(root, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass")
    return "TOO_LARGE" if len(packed) > max_bytes else None




def codes(spark, texts, *bounds):
    rows = spark.createDataFrame(list(enumerate(texts)), "no int, t string")
    return [r.code for r in rows.select("no", contracts.json_bounds(F.col("t"), *bounds).alias("code")).orderBy("no").collect()]


TEXTS = [
    '{"a":1}', "{}", ' {"a" : [ ] , "b":{ } }\n', '{"a":NaN}', '{"a":-Infinity}', '{"a":1e999}', '{"a":-1.5e400}', '{"a":1e5}', '{"a":"NaN 1e999 [[["}', '{"a":"\\"[{,:"}',
    '{"a":"\\\\"}', '{"a\\\\\\"b":[1,"x,y"]}', "[1]", "[]", "1", '"s"', "null", "true", "", " ", None, '{"a":1', '{"a":1}}', '{"a":1} x', '{"a":1},2', "1],[2", "{]}", '{"a":01}', "{'a':1}", '{"a":1,}',
    '{"a":}', '{a:1}', '{"a":[1,2,{"b":[[]]}]}', '{"a":"' + "x" * 70_000 + '"}', '{"v":' + "[" * 15 + "1" + "]" * 15 + "}", '{"v":' + "[" * 16 + "1" + "]" * 16 + "}", '{"v":' + "[" * 16 + "]" * 16 + "}",
    '{"a":[' + "1," * 4092 + "1]}", '{"a":[' + "1," * 4093 + "1]}", '{"é":"ß😀"}', '{"a":"' + "\\n" * 9_000 + '"}',
]


def test_texts(spark):
    assert dict(zip(TEXTS, codes(spark, TEXTS), strict=True)) == {t: plain(t, 65_536, 16, 4_096) for t in TEXTS}


LEAF = st.none() | st.booleans() | st.integers(-10**6, 10**6) | st.text("ab\\\"[]{},:é😀 ", max_size=6)
TREE = st.dictionaries(st.text("ab\"[{", max_size=3), st.recursive(LEAF, lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text("ab,", max_size=2), x, max_size=3), max_leaves=25), max_size=4)


def test_random_trees_at_small_bounds(spark):
    found = []

    @settings(max_examples=300, database=None, derandomize=True, deadline=None)
    @given(TREE, st.sampled_from([None, 1]))
    def collect(tree, indent):
        found.append(json.dumps(tree, ensure_ascii=False, indent=indent))

    collect()
    for bounds in ((10**6, 3, 10**6), (10**6, 10**6, 12), (40, 10**6, 10**6)):
        assert codes(spark, found, *bounds) == [plain(t, *bounds) for t in found]
