"""Tool schemas and prompt sections out of Python source text, by its syntax tree; and the same written back.

The extractors are table functions over source text (one row per file in, one row per tool or section out); writing back
edits one file's text on the driver.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import quoted, wrapped
from skein.schemas import PROMPT_SECTION, TOOL_DESCRIPTION
from skein.sources.sessions import missing

#: What a tool file holds, how schemas are named, and the section constants.
REGISTERS = "registry.register("
SCHEMA_NAME = re.compile(r"[A-Z][A-Z0-9_]*(?:_SCHEMA|_SCHEMAS)")
SECTION_CONSTANTS = {
    "DEFAULT_AGENT_IDENTITY": "default_agent_identity",
    "MEMORY_GUIDANCE": "memory_guidance",
    "SESSION_SEARCH_GUIDANCE": "session_search_guidance",
    "SKILLS_GUIDANCE": "skills_guidance",
}
SECTION_FAMILY = "PLATFORM_HINTS"


def tool_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, source of the folder's Python files that register a tool, in order of path."""
    if missing(spark, f"{folder}/*.py"):
        return spark.createDataFrame([], "path string, source string")
    files = spark.read.text(f"{folder}/*.py", wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("source"))
    return registering(files).orderBy("path")


def registering(files: DataFrame) -> DataFrame:
    """The files (path, source) that register a tool."""
    return files.where(F.col("source").contains(REGISTERS))


def _assigned(tree: ast.Module) -> Iterator[tuple[str, ast.expr]]:
    for node in ast.walk(tree):
        if isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
            yield node.targets[0].id, node.value


def _offsets(source: str) -> list[int]:
    out = [0]
    for line in source.splitlines(keepends=True):
        out.append(out[-1] + len(line))
    return out


def _span(source: str, node: ast.expr) -> tuple[int, int]:
    """Where a literal stands in the source, with the parentheses around an implicit concatenation. Columns count UTF-8."""
    lines, at = source.splitlines(keepends=True), _offsets(source)

    def place(line: int, col: int) -> int:
        return at[line - 1] + len(lines[line - 1].encode()[:col].decode())

    a, b = place(node.lineno, node.col_offset), place(node.end_lineno, node.end_col_offset)
    before, after = re.search(r"\(\s*\Z", source[:a]), re.match(r"\s*,?\s*\)", source[b:])
    if before and after and "," not in after[0]:
        return before.start(), b + after.end()
    return a, b


def _described(source: str, node: ast.expr | None, constants: dict[str, ast.expr]) -> tuple[str, str]:
    """Text and format of a description: single_line, triple_quote, paren_concat or variable_ref."""
    if isinstance(node, ast.Name):
        value = constants.get(node.id)
        return (_described(source, value, {})[0] if value is not None else ""), "variable_ref"
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        a, _ = _span(source, node)
        kind = "paren_concat" if source[a] == "(" else "triple_quote" if source[a : a + 3] in ('"""', "'''") else "single_line"
        return node.value, kind
    return "", "single_line"


def _fields(node: ast.expr | None) -> dict[str, ast.expr]:
    if not isinstance(node, ast.Dict):
        return {}
    return {k.value: v for k, v in zip(node.keys, node.values) if isinstance(k, ast.Constant) and isinstance(k.value, str)}


def _strings(node: ast.expr | None) -> list[str] | None:
    if not isinstance(node, (ast.List, ast.Tuple)):
        return None
    return [x.value for x in node.elts if isinstance(x, ast.Constant) and isinstance(x.value, str)]


def _tool(path: str, source: str, var: str, node: ast.expr, constants: dict[str, ast.expr]) -> dict | None:
    own = _fields(node)
    name = own.get("name")
    if not (isinstance(name, ast.Constant) and isinstance(name.value, str) and name.value):
        return None
    text, kind = _described(source, own.get("description"), constants)
    outer = _fields(own.get("parameters"))
    required = _strings(outer.get("required")) or []
    params = []
    for key, value in _fields(outer.get("properties")).items():
        if not isinstance(value, ast.Dict):
            continue
        p = _fields(value)
        of = p.get("type")
        about, how = _described(source, p.get("description"), constants)
        params.append({
            "name": key, "type": of.value if isinstance(of, ast.Constant) and isinstance(of.value, str) else "string", "required": key in required,
            "enum": _strings(p.get("enum")), "description": about, "desc_format": how,
        })
    return {"name": name.value, "file_path": path, "description": text, "params": params, "desc_format": kind, "schema_var_name": var}


def tools_of(path: str, source: str) -> list[dict]:
    """Tools of the schema constants (a dict, or a list of dicts) of a source text; none if it is not Python."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    constants, out = dict(_assigned(tree)), []
    for var, value in _assigned(tree):
        if SCHEMA_NAME.fullmatch(var):
            for node in value.elts if isinstance(value, ast.List) else [value]:
                if tool := _tool(path, source, var, node, constants):
                    out.append(tool)
    return out


def sections_of(path: str, source: str) -> list[dict]:
    """Prompt sections of a source text in order of line: the named string constants, and each text of the family's dict;
    none if it is not Python."""
    out: list[dict] = []
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return out

    def add(section: str, text: str, node: ast.AST) -> None:
        out.append({"section_id": section, "text": text, "char_count": len(text), "line_range": {"start": node.lineno, "end": node.end_lineno}, "source_path": path})

    for node in ast.walk(tree):
        if not (isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name)):
            continue
        var, value = node.targets[0].id, node.value
        if var in SECTION_CONSTANTS and isinstance(value, ast.Constant) and isinstance(value.value, str):
            add(SECTION_CONSTANTS[var], value.value, node)
        elif var == SECTION_FAMILY and isinstance(value, ast.Dict):
            for key, text in zip(value.keys, value.values):
                if isinstance(key, ast.Constant) and isinstance(text, ast.Constant) and isinstance(text.value, str):
                    add(f"{SECTION_FAMILY.lower()}.{key.value}", text.value, text)
    return sorted(out, key=lambda s: s["line_range"]["start"])


def _extracted(files: DataFrame, of, schema) -> DataFrame:
    names = schema.fieldNames()

    def run(batches):
        for b in batches:
            yield pd.DataFrame([x for p, s in zip(b["path"], b["source"]) for x in of(p, s)], columns=names)

    return files.select("path", "source").mapInPandas(run, schema)


def extract_tools(files: DataFrame) -> DataFrame:
    """Tool descriptions (schemas.TOOL_DESCRIPTION) of a table of path and source."""
    return _extracted(files, tools_of, TOOL_DESCRIPTION)


def extract_sections(files: DataFrame) -> DataFrame:
    """Prompt sections (schemas.PROMPT_SECTION) of a table of path and source."""
    return _extracted(files, sections_of, PROMPT_SECTION)


def _literal(text: str, kind: str, indent: int) -> str:
    """A text as source in one of the formats; a text that triple quotes cannot hold as it is gets its escapes."""
    pad = " " * indent
    if kind == "paren_concat":
        lines = [f'{pad}    "{quoted(piece)}"' for piece in wrapped(text)]
        return "(\n" + "\n".join(lines) + f"\n{pad})"
    if kind == "triple_quote":
        return '"""' + text.replace("\\", "\\\\").replace('"', '\\"') + '"""'
    return f'"{quoted(text)}"'


def _replaced(source: str, node: ast.expr, text: str, kind: str) -> str:
    a, b = _span(source, node)
    line = source.rfind("\n", 0, a) + 1
    indent = len(source[line:a]) - len(source[line:a].lstrip(" "))
    return source[:a] + _literal(text, kind, indent) + source[b:]


def write_tool_description(source: str, tool: str, text: str) -> str:
    """The source with a tool's description replaced, in the format it has; a variable's own definition is edited.
    KeyError if there is no such tool or it has no description."""
    tree = ast.parse(source)
    constants = dict(_assigned(tree))
    for var, value in _assigned(tree):
        if not SCHEMA_NAME.fullmatch(var):
            continue
        for node in value.elts if isinstance(value, ast.List) else [value]:
            own = _fields(node)
            if isinstance(own.get("name"), ast.Constant) and own["name"].value == tool and "description" in own:
                at = own["description"]
                at = constants.get(at.id, at) if isinstance(at, ast.Name) else at
                return _replaced(source, at, text, _described(source, at, constants)[1])
    raise KeyError(tool)


def write_section(source: str, section_id: str, text: str) -> str:
    """The source with a section's text replaced. Only the literal changes: a key on the same line stays, and as places are
    found anew each time, sections may be written in any order. KeyError if there is no such section."""
    for node in ast.walk(ast.parse(source)):
        if not (isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name)):
            continue
        var, value = node.targets[0].id, node.value
        if SECTION_CONSTANTS.get(var) == section_id and isinstance(value, ast.Constant):
            return _replaced(source, value, text, "paren_concat")
        if var == SECTION_FAMILY and isinstance(value, ast.Dict):
            for key, own in zip(value.keys, value.values):
                if isinstance(key, ast.Constant) and f"{SECTION_FAMILY.lower()}.{key.value}" == section_id:
                    return _replaced(source, own, text, "paren_concat")
    raise KeyError(section_id)


def _edited(edit):
    @F.pandas_udf("string")
    def run(sources: pd.Series, names: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([edit(s, n, t) for s, n, t in zip(sources, names, texts)], dtype=object)

    return run


def with_tool_description(source: Column, tool: Column, text: Column) -> Column:
    """write_tool_description() over columns; a tool that is not there stops the job."""
    return _edited(write_tool_description)(source, tool, text)


def with_section(source: Column, section_id: Column, text: Column) -> Column:
    """write_section() over columns; a section that is not there stops the job."""
    return _edited(write_section)(source, section_id, text)
