"""Schemas of the records, as Spark types."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


S, L, D, B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()

#: A user message with its answer, from any source; timestamp in epoch milliseconds where there is one.
MESSAGE = _struct(source=S, task_input=S, assistant_response=S, project=S, session_id=S, timestamp=L)
EVAL_EXAMPLE = _struct(task_input=S, expected_behavior=S, difficulty=S, category=S, source=S)
#: correct_params stays JSON text: it may nest and differs from row to row.
TOOL_EXAMPLE = _struct(task_description=S, correct_tool=S, correct_params=S, difficulty=S, confuser_tools=T.ArrayType(S), reason=S, source=S)
SECTION_EXAMPLE = _struct(section_id=S, user_message=S, expected_behavior=S, difficulty=S, source=S)
TOOL_PARAM = _struct(name=S, type=S, required=B, enum=T.ArrayType(S), description=S, desc_format=S)
TOOL_DESCRIPTION = _struct(name=S, file_path=S, description=S, params=T.ArrayType(TOOL_PARAM), desc_format=S, schema_var_name=S)
PROMPT_SECTION = _struct(section_id=S, text=S, char_count=L, line_range=_struct(start=L, end=L), source_path=S)
SKILL = _struct(path=S, raw=S, frontmatter=S, body=S, name=S, description=S)
GATE_RESULT = _struct(passed=B, constraint_name=S, message=S, details=S)

#: Defaults of missing fields, by record; fields not listed are required.
DEFAULTS = {
    "eval": {"difficulty": "medium", "category": "general", "source": "synthetic"},
    "tool": {"correct_params": "{}", "difficulty": "medium", "confuser_tools": [], "reason": "", "source": "synthetic"},
    "section": {"difficulty": "medium", "source": "synthetic"},
}
