"""JSON out of a model's answer, by Arrow-batched functions (the JVM's JSON parser takes trailing garbage and repeated keys another way)."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _loads(text: str | None):
    try:
        return True, json.loads(text)
    except (ValueError, TypeError, RecursionError):
        return False, None


def first_object(text: str | None) -> str | None:
    """The whole text if it is an object, else the first balanced {...} block if that parses; as JSON text, else None."""
    if not text:
        return None
    ok, value = _loads(text)
    if ok and isinstance(value, dict):
        return json.dumps(value)
    depth, start = 0, text.find("{")
    if start < 0:
        return None
    # Outside of strings only brackets count; a backslash in a string hides the character after it.
    for m in re.finditer(r'"(?:[^"\\]|\\.)*(?:"|\Z)|[{}]', text[start:], re.DOTALL):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if depth == 0 and m[0] == "}":
            ok, value = _loads(text[start : start + m.end()])
            return json.dumps(value) if ok else None
    return None


def whole_array(text: str | None, strict: bool = False) -> str | None:
    """The whole text if it is an array, else what stands from the first [ to the last ]; `[]` if there is none.

    strict: the text may be any JSON value, and where nothing parses it raises ValueError.
    """
    ok, value = _loads(text)
    if ok and (strict or isinstance(value, list)):
        return json.dumps(value)
    found = re.search(r"\[.*\]", text or "", re.DOTALL)
    ok, value = _loads(found[0]) if found else (False, None)
    if strict and not ok:
        raise ValueError("no JSON array in the answer")
    return json.dumps(value) if ok and isinstance(value, list) else "[]"


def extract_object(c: Column) -> Column:
    @F.pandas_udf("string")
    def objects(s: pd.Series) -> pd.Series:
        return s.map(first_object, na_action="ignore").astype(object)

    return objects(c)


def extract_array(c: Column, strict: bool = False) -> Column:
    @F.pandas_udf("string")
    def arrays(s: pd.Series) -> pd.Series:
        return pd.Series([whole_array(x, strict) for x in s], dtype=object)

    return arrays(c)
