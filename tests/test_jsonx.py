import json

import pytest
from pyspark.sql import functions as F

from skein.functions.jsonx import extract_array, extract_object, first_object, whole_array


@pytest.mark.parametrize("raw, expected", [
    ('{"a": 1}', {"a": 1}), ('```json\n{"a": 1}\n```', {"a": 1}), ('x {"a": {"b": 2}} y', {"a": {"b": 2}}), ('[{"a": 1}]', {"a": 1}), ("[1, 2]", None), ('"text"', None),
    ("{bad", None), ("", None), (None, None), ('{"a": "}"} tail', {"a": "}"}), (r'say {"a": "q\"}"} end', {"a": 'q"}'}), ("{bad} {\"a\": 1}", None), ('{"a": 1, "a": 2}', {"a": 2}), ('{"a": "open', None),
])
def test_object(raw, expected):
    got = first_object(raw)
    assert (None if got is None else json.loads(got)) == expected


@pytest.mark.parametrize("raw, expected", [("[1]", [1]), ("x [1, 2] y", [1, 2]), ("none", []), ('{"a": [1]}', [1]), ("[1] and [2]", []), (None, []), ("", [])])
def test_array(raw, expected):
    assert json.loads(whole_array(raw)) == expected


def test_strict_array():
    assert json.loads(whole_array('{"a": 1}', strict=True)) == {"a": 1}
    for raw in ("none", "[bad]"):
        with pytest.raises(ValueError):
            whole_array(raw, strict=True)


def test_columns(spark):
    got = spark.createDataFrame([('x {"a": 1}', "[2]"), (None, None)], "a string, b string").select(extract_object(F.col("a")).alias("a"), extract_array(F.col("b")).alias("b")).collect()
    assert [tuple(r) for r in got] == [('{"a": 1}', "[2]"), (None, "[]")]
