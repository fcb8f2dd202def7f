"""The registered queries: one or more for each operator, with the equivalent SQL where SQL can express it.

Queries run over whole tables. Inputs that the tables lack (predictions, artifact types, judge answers) are derived from
columns, the same way on both sides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions.jsonx import extract_array, extract_object
from skein.operators import candidates, gates, pairing, rendering, scoring, splits
from skein.operators.ordering import with_ordinals
from skein.plans import answers, flows, generate, judge
from skein.shared import discard, fresh_path, written
from skein.sources import datasets, sessions, skills, source_code
from skein.sources.sessions import parse_history
from skein.sources.skills import parse_skill
from skein.streaming.pairs import pair_events, state_store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: A made-up skill for the relevance queries.
SKILL_NAME, SKILL_TEXT = "the-ouen", "Thshhe under the aauxement, ienere tionhe ouenaux erenhe and therein onthere. Enheit thereof."
SECRET_SQL = "'(?i)(" + "|".join(T.SECRETS).replace("'", "''") + ")'"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _strip_sql(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def _tokens_sql(c: str) -> str:
    return rf"list_filter(string_split_regex({c}, '\s+'), lambda x: x <> '')"


_SEGMENTS_SQL = """
    s AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS seg FROM conversations),
    u AS (SELECT conv_id, seg, turn, text FROM s WHERE role = 'user'),
"""
_W1_SQL = f"""
    {_SEGMENTS_SQL}
    a AS (SELECT conv_id, seg, arg_min(text, turn) AS t FROM s WHERE role = 'assistant' AND length(text) > 0 GROUP BY conv_id, seg),
    w1 AS (
        SELECT u.conv_id, u.turn, u.text AS task_input, coalesce(a.t, '') AS assistant_response
        FROM u LEFT JOIN a ON u.conv_id = a.conv_id AND u.seg = a.seg
        WHERE length(u.text) >= 10 AND NOT regexp_matches(u.text, {SECRET_SQL}) AND NOT regexp_matches(coalesce(a.t, ''), {SECRET_SQL})
    )
"""


@query(f"WITH {_W1_SQL} SELECT * FROM w1")
def w1_pair_first_response(spark, sf_dir):
    return pairing.pair_first_response(_table(spark, sf_dir, "conversations"))


@query(f"""
    WITH {_SEGMENTS_SQL}
    a AS (SELECT conv_id, seg, string_agg(text, chr(10) ORDER BY turn) AS t FROM s WHERE role = 'assistant' AND length(text) > 0 GROUP BY conv_id, seg)
    SELECT u.conv_id, u.turn, u.text AS task_input, a.t AS assistant_response FROM u JOIN a ON u.conv_id = a.conv_id AND u.seg = a.seg
    WHERE length(u.text) > 0 AND NOT regexp_matches(u.text, {SECRET_SQL}) AND NOT regexp_matches(a.t, {SECRET_SQL})
""")
def w2_pair_concat(spark, sf_dir):
    return pairing.pair_all_responses(_table(spark, sf_dir, "conversations"))


#: Rows from which a lot of turns is added to the stream by itself; smaller lots are added with the next ones.
LOT_ROWS = 50_000
#: Files that a batch of the stream takes.
BATCH_FILES = 64


def _lot_groups(counts: list[tuple[int, int]], rows: int) -> list[tuple[int, int]]:
    """First and last of the lots that are added at a time, of (lot, rows) in order: large ones alone, small ones up to that many rows together."""
    out, n = [], rows
    for lot, count in counts:
        if n + count > rows:
            out.append((lot, lot))
            n = 0
        out[-1] = (out[-1][0], lot)
        n += count
    return out


def _replayed(spark: SparkSession, sf_dir: str, every: bool) -> DataFrame:
    """The conversations as a stream: written in lots of three turns, a minute a turn, and read as they were written.

    The turns are put in order of lots once, and lots of few rows share a file: what is read and how many files and batches there
    are goes by the rows, not by the longest conversation. Files come in order; those of one lot in any. The driver gets a count for each lot.
    """
    turns = _table(spark, sf_dir, "conversations").withColumn("ts", F.timestamp_seconds(86_400 + F.col("turn") * 60))  # Spark takes the time 0 for late
    folder, out = fresh_path(spark, "turns"), fresh_path(spark, "pairs")
    lots = written(turns.where("turn >= 0").withColumn("_lot", F.floor(F.col("turn") / 3)).repartitionByRange("_lot", "conv_id"), "lots")
    counts = [(r["_lot"], r["count"]) for r in lots.groupBy("_lot").count().orderBy("_lot").collect()]
    last = counts[-1][0] * 3 + 2 if counts else 0
    for lo, hi in _lot_groups(counts, LOT_ROWS):
        part = lots.where(F.col("_lot").between(lo, hi)).drop("_lot")
        (part if lo == hi else part.coalesce(1)).write.mode("append").parquet(folder)
    discard(lots)
    for day in (1, 2):  # later turns of another conversation, by which all others are over
        spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(day).cast("long").alias("turn"), F.lit("system").alias("role"), F.lit("").alias("text"), F.timestamp_seconds(F.lit((last + 1) * 60 + (day + 1) * 86_400)).alias("ts")).select(
            *[F.col(f.name).cast(f.dataType) for f in turns.schema]).write.mode("append").parquet(folder)
    stream = pair_events(spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", BATCH_FILES).parquet(folder), every=every)
    with state_store(spark):
        run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query(f"WITH {_W1_SQL} SELECT * FROM w1")
def w1_replayed_stream(spark, sf_dir):
    """W1 by event time."""
    return _replayed(spark, sf_dir, every=False)


@query(ORACLE["w2_pair_concat"])
def w2_replayed_stream(spark, sf_dir):
    """W2 by event time."""
    return _replayed(spark, sf_dir, every=True)


@query(f"""
    SELECT 'history' AS source, text AS task_input, CAST(NULL AS VARCHAR) AS assistant_response, '' AS project, conv_id::VARCHAR AS session_id, turn AS timestamp
    FROM conversations WHERE role = 'user' AND length(text) >= 10 AND NOT regexp_matches(text, {SECRET_SQL})
""")
def s1_history(spark, sf_dir):
    return parse_history(_history_lines(spark, sf_dir))


def _history_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = _table(spark, sf_dir, "conversations").where("role = 'user'")
    return user.select(F.to_json(F.struct(F.col("text").alias("display"), F.col("turn").alias("timestamp"), F.col("conv_id").cast("string").alias("sessionId"))).alias("value"))


def _whole_files(spark: SparkSession, sf_dir: str, line, value) -> DataFrame:
    """conv_id, value: a file's text for each conversation, of its turns' lines in order."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"])
    return _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(value(lines).alias("value"))


def _event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.to_json(F.struct(F.concat("role", F.lit(".message")).alias("type"), F.struct(F.col("text").alias("content")).alias("data")))
    return _whole_files(spark, sf_dir, line, lambda lines: F.array_join(lines, "\nnot JSON\n")).select(F.col("conv_id").cast("string").alias("session_id"), "value")


def _session_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.to_json(F.struct("role", F.col("text").alias("content")))
    value = lambda lines: F.concat(F.lit('{"messages": ['), F.array_join(lines, ", "), F.lit("]}"))
    files = _whole_files(spark, sf_dir, line, value)
    return files.select(F.concat(F.lit("file:/logs/"), F.col("conv_id").cast("string"), F.lit(".json")).alias("file"), F.timestamp_seconds("conv_id").alias("mtime"), "value")


@query(f"""
    WITH {_SEGMENTS_SQL}
    a AS (SELECT conv_id, seg, string_agg(text, chr(10) ORDER BY turn) AS t FROM s WHERE role = 'assistant' AND length(text) > 0 GROUP BY conv_id, seg)
    SELECT 'events' AS source, u.text AS task_input, a.t AS assistant_response, CASE WHEN u.conv_id % 2 = 0 THEN '/home/' || u.conv_id ELSE '' END AS project, u.conv_id::VARCHAR AS session_id
    FROM u JOIN a ON u.conv_id = a.conv_id AND u.seg = a.seg
    WHERE length(u.text) > 0 AND NOT regexp_matches(u.text, {SECRET_SQL}) AND NOT regexp_matches(a.t, {SECRET_SQL})
""")
def s2_events(spark, sf_dir):
    """S2 and S3: event files of the conversations, every other one with a workspace file."""
    ids = _table(spark, sf_dir, "conversations").select("conv_id").distinct().where("conv_id % 2 = 0")
    spaces = ids.select(F.col("conv_id").cast("string").alias("session_id"), F.concat(F.lit("id: 1\ncwd:  /home/"), F.col("conv_id").cast("string"), F.lit(" \ncwd: /no\n")).alias("value"))
    found = sessions.parse_events(_event_files(spark, sf_dir), sessions.parse_workspaces(spaces))
    return sessions.as_messages(found).select("source", "task_input", "assistant_response", "project", "session_id")


#: Events that end their file, or should not, by conv_id % 7: where, the line before the turn's own, and the turn's own event in its place.
_BROKEN = {
    1: (3, "[1, 2]", None), 2: (2, None, "'data': 'text'"), 3: (3, None, "'data': {'content': ['x']}"), 4: (2, None, "'data': {'content': {'k': 1}}"),
    5: (4, "null", None), 6: (4, "broken JSON", "'data': {'content': 0}"),
}


def _broken_event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as event files, with the events of _BROKEN in them."""
    kind, case = F.concat("role", F.lit(".message")), F.col("conv_id") % 7
    line = F.to_json(F.struct(kind.alias("type"), F.struct(F.col("text").alias("content")).alias("data")))
    for n, (turn, before, data) in _BROKEN.items():
        own = F.concat(F.lit('{"type": "'), kind, F.lit('", ' + data.replace("'", '"') + "}")) if data else line
        line = F.when((case == n) & (F.col("turn") == turn), F.concat_ws("\n", F.lit(before), own)).otherwise(line)
    return _whole_files(spark, sf_dir, line, lambda lines: F.array_join(lines, "\n")).select(F.col("conv_id").cast("string").alias("session_id"), "value")


@query(f"""
    WITH e AS (
        SELECT conv_id, turn, role, conv_id % 7 AS case_no,
            CASE WHEN conv_id % 7 = 3 AND turn = 3 THEN 'list' WHEN conv_id % 7 = 4 AND turn = 2 THEN 'other' WHEN conv_id % 7 = 6 AND turn = 4 OR length(text) = 0 THEN 'empty' ELSE 'text' END AS kind,
            CASE WHEN conv_id % 7 IN (3, 6) AND turn = conv_id % 7 - (conv_id % 7 = 6)::INT * 2 OR conv_id % 7 = 4 AND turn = 2 THEN '' ELSE text END AS text
        FROM conversations WHERE role IN ('user', 'assistant')
    ), s AS (
        SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS seg FROM e
    ), f AS (
        SELECT conv_id, CASE WHEN conv_id % 7 = 1 THEN 2 * turn - 1 WHEN conv_id % 7 = 5 THEN 2 * turn - 1 ELSE 2 * turn + (role = 'user')::INT END AS place
        FROM conversations WHERE conv_id % 7 = 1 AND turn = 3 OR conv_id % 7 = 5 AND turn = 4 OR conv_id % 7 = 2 AND turn = 2 AND role IN ('user', 'assistant')
    ), g AS (
        SELECT conv_id, seg, min(turn) FILTER (role = 'user') AS turn, arg_min(kind, turn) FILTER (role = 'user') AS ukind, arg_min(text, turn) FILTER (role = 'user') AS task_input,
            list({{'turn': turn, 'kind': kind, 'text': text}} ORDER BY turn) FILTER (role = 'assistant' AND kind <> 'empty') AS a
        FROM s WHERE seg > 0 GROUP BY conv_id, seg
    ), h AS (
        SELECT *, 2 * lead(turn) OVER (PARTITION BY conv_id ORDER BY seg) AS save FROM g
    ), k AS (
        SELECT *, ukind <> 'text' OR (NOT regexp_matches(task_input, {SECRET_SQL}) AND a[1].kind <> 'text') AS unsaved FROM h WHERE ukind <> 'empty' AND len(a) > 0
    ), cuts AS (
        SELECT conv_id, min(place) AS cut FROM (
            SELECT conv_id, place FROM f
            UNION ALL SELECT conv_id, 2 * list_filter(a[2:], lambda x: x.kind <> 'text' OR a[1].kind = 'other')[1].turn FROM k
            UNION ALL SELECT conv_id, save FROM k WHERE unsaved
        ) GROUP BY conv_id
    )
    SELECT k.conv_id::VARCHAR AS session_id, k.task_input, array_to_string(list_transform(a, lambda x: x.text), chr(10)) AS assistant_response
    FROM k LEFT JOIN cuts ON k.conv_id = cuts.conv_id
    WHERE NOT unsaved AND (cut IS NULL OR save < cut) AND NOT regexp_matches(task_input, {SECRET_SQL}) AND NOT regexp_matches(array_to_string(list_transform(a, lambda x: x.text), chr(10)), {SECRET_SQL})
""")
def s2_event_failures(spark, sf_dir):
    """S2: a file ends at its first event that cannot be used and keeps the messages before it."""
    found = sessions.parse_events(_broken_event_files(spark, sf_dir), spark.createDataFrame([], "session_id string, project string"))
    return found.select("session_id", "task_input", "assistant_response")


@query(f"WITH {_W1_SQL} SELECT 'sessions' AS source, task_input, assistant_response, conv_id::VARCHAR AS session_id FROM w1")
def s4_sessions(spark, sf_dir):
    return sessions.as_messages(sessions.parse_sessions(_session_files(spark, sf_dir))).select("source", "task_input", "assistant_response", "session_id")


def _written_files(files: DataFrame, key: str, name: str) -> str:
    """A folder with a folder <key>=<value> for each row, which holds its column value as one file."""
    path, rows = fresh_path(files.sparkSession, name), files.select(key, "value")
    try:
        fs.FileSystem.from_uri(path)
    except pa.ArrowInvalid:  # a store that Arrow does not know
        rows.write.partitionBy(key).option("lineSep", "\n").text(path)
        return path

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        for b in batches:
            for k, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                folder = f"{root}/{key}={k}"
                store.create_dir(folder)
                with store.open_output_stream(f"{folder}/part-0.txt") as f:
                    f.write(f"{value}\n".encode())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    # However short, a file is work: all cores get the like number of them. Spark's writer starts a process for the permissions of each local file.
    rows.repartition(4 * files.sparkSession.sparkContext.defaultParallelism, key).mapInArrow(save, "n long").agg(F.sum("n")).collect()
    return path


@query(f"""
    SELECT 'history' AS source, text AS task_input, '' AS project, conv_id::VARCHAR AS session_id, turn AS timestamp
    FROM conversations WHERE role = 'user' AND length(text) >= 10 AND NOT regexp_matches(text, {SECRET_SQL})
""")
def s1_read_history(spark, sf_dir):
    """S1 from a file."""
    path = fresh_path(spark, "history")
    _history_lines(spark, sf_dir).write.text(path)
    return sessions.read_history(spark, path).select("source", "task_input", "project", "session_id", "timestamp")


_EVENTS_SQL = f"""
    {_SEGMENTS_SQL}
    a AS (SELECT conv_id, seg, string_agg(text, chr(10) ORDER BY turn) AS t FROM s WHERE role = 'assistant' AND length(text) > 0 GROUP BY conv_id, seg),
    w2 AS (
        SELECT 'session_id=' || u.conv_id AS session_id, u.turn, u.text AS task_input, a.t AS assistant_response FROM u JOIN a ON u.conv_id = a.conv_id AND u.seg = a.seg
        WHERE length(u.text) > 0 AND NOT regexp_matches(u.text, {SECRET_SQL}) AND NOT regexp_matches(a.t, {SECRET_SQL})
    )
"""


@query(f"WITH {_EVENTS_SQL} SELECT session_id, task_input, assistant_response FROM w2")
def s2_read_events(spark, sf_dir):
    """S2 from files, a folder for each session."""
    folder = _written_files(_event_files(spark, sf_dir), "session_id", "events")
    return sessions.read_events(spark, folder, name="part-*").select("session_id", "task_input", "assistant_response")


@query(f"WITH {_EVENTS_SQL} SELECT session_id, task_input, assistant_response FROM w2 ORDER BY session_id, turn LIMIT 40")
def s2_read_limited(spark, sf_dir):
    """S2 from files with a limit: the first sessions' files are read until there are enough messages."""
    folder = _written_files(_event_files(spark, sf_dir), "session_id", "events")
    return sessions.read_events(spark, folder, limit=40, name="part-*").select("session_id", "task_input", "assistant_response")


@query(f"WITH {_W1_SQL} SELECT 'sessions' AS source, task_input, assistant_response, conv_id::VARCHAR AS session_id FROM w1")
def s4_read_sessions(spark, sf_dir):
    """S4 from files."""
    files = _session_files(spark, sf_dir).select(F.regexp_extract("file", "([0-9]+).json", 1).alias("conv"), "value")
    whole = files.withColumn("value", F.concat(F.lit('{"session_id": "'), "conv", F.lit('", '), F.substr("value", F.lit(2))))
    return sessions.read_sessions(spark, _written_files(whole, "conv", "sessions"), name="*/part-*").select("source", "task_input", "assistant_response", "session_id")


@query(f"WITH {_W1_SQL} SELECT conv_id::VARCHAR AS session_id, task_input, row_number() OVER (ORDER BY conv_id DESC, turn) - 1 AS ord FROM w1")
def o1_sessions_by_time(spark, sf_dir):
    """O1: messages of session files, the newest file's first, with their place in that order."""
    found = with_ordinals(sessions.parse_sessions(_session_files(spark, sf_dir)), "-mtime", "file", "turn")
    return found.select("session_id", "task_input", "ord")


@query("SELECT source, count(*) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS ord FROM documents GROUP BY source")
def o1_source_counts(spark, sf_dir):
    """O1: sources by name, with their place."""
    return with_ordinals(scoring.source_counts(_table(spark, sf_dir, "documents")), "source")


@query("SELECT doc_id, row_number() OVER (ORDER BY source NULLS LAST, n_chars DESC NULLS LAST, doc_id) - 1 AS ord FROM documents")
def o1_documents(spark, sf_dir):
    """O1: a gapless order of all rows by three keys, of which one is the same for a third of them."""
    return with_ordinals(_table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "source", "-n_chars", "doc_id").select("doc_id", "ord")


@query("""
    SELECT item_id, trim(text) AS name, 'about ' || item_id AS description, 'Body ' || item_id AS body FROM benchmark
""")
def s8_skill_load(spark, sf_dir):
    raw = F.concat(F.lit("---\nname: x\nname: '"), F.regexp_replace("text", "\\s+", " "), F.lit("'\ndescription: \"about "), F.col("item_id").cast("string"), F.lit("\"\n---\n\nBody "), F.col("item_id").cast("string"), F.lit("\n"))
    items = _table(spark, sf_dir, "benchmark").select("item_id", parse_skill(raw).alias("s"))
    return items.select("item_id", "s.name", "s.description", "s.body")


ORACLE["s8_skill_load"] = r"SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS name, 'about ' || item_id AS description, 'Body ' || item_id AS body FROM benchmark"


@query(f"SELECT doc_id, regexp_matches(text, {SECRET_SQL}) AS secret FROM documents")
def f1_secret_docs(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.contains_secret(F.col("text")).alias("secret"))


@query(f"SELECT page_id, regexp_matches(html, {SECRET_SQL}) AS secret FROM pages")
def f1_secret_pages(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", T.contains_secret(F.col("html")).alias("secret"))


@query("SELECT conv_id, turn FROM conversations WHERE length(text) >= 10")
def f2_min_length(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").where(T.long_enough(F.col("text"))).select("conv_id", "turn")


@query("SELECT conv_id, turn FROM conversations WHERE length(text) > 0 AND length(role) > 0")
def f3_required_fields(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").where(T.has_value(F.col("text"), F.col("role"))).select("conv_id", "turn")


def _relevant_sql(c: str) -> str:
    name = SKILL_NAME.lower().replace("-", " ").replace("_", " ")
    words = "".join(f" OR contains(lower({c}), '{w}')" for w in name.split() if len(w) > 3)
    found = ", ".join(f"'{w}'" for w in T.keywords(SKILL_TEXT))
    own = _tokens_sql(rf"regexp_replace(lower({c}), '[^a-z\s]', '', 'g')")
    return f"(contains(lower({c}), '{name}'){words} OR len(list_intersect(list_distinct({own}), [{found}])) >= 2)"


@query(f"SELECT doc_id FROM documents WHERE {_relevant_sql('text')}")
def f4_relevance_heuristic(spark, sf_dir):
    return _table(spark, sf_dir, "documents").where(T.is_relevant(F.col("text"), SKILL_NAME, SKILL_TEXT)).select("doc_id")


_LEVEL_SQL = "CASE doc_id % 5 WHEN 0 THEN ' Easy ' WHEN 1 THEN 'HARD' WHEN 2 THEN 'unknown' WHEN 3 THEN '' END"
_KIND_SQL = "CASE doc_id % 3 WHEN 0 THEN '  ' WHEN 1 THEN ' ' || source || ' ' END"


@query(f"""
    WITH d AS (SELECT doc_id, text, lang, lower({_strip_sql(_LEVEL_SQL)}) AS level, {_strip_sql(_KIND_SQL)} AS kind FROM documents)
    SELECT doc_id, substr(text, 1, 2000) AS task_input, {_strip_sql('lang')} AS expected_behavior,
           CASE WHEN level IN ('easy', 'medium', 'hard') THEN level ELSE 'medium' END AS difficulty, CASE WHEN length(kind) > 0 THEN kind ELSE 'general' END AS category
    FROM d WHERE length({_strip_sql('text')}) > 0 AND length({_strip_sql('lang')}) > 0
""")
def f5_validate_example(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.validated(F.col("text"), F.col("lang"), F.expr(_LEVEL_SQL), F.expr(_KIND_SQL)).alias("e")).where("e IS NOT NULL").select("doc_id", "e.*")


@query("SELECT doc_id, substr(text, 1, 800) AS skill, substr(text, 1, 1000) AS message, substr(coalesce(lang, ''), 1, 1000) AS response FROM documents")
def f6_prompt_windows(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.shortened(F.col("text"), F.col("text"), F.col("lang")).alias("p")).select("doc_id", "p.*")


@query("SELECT event_id, props AS found FROM events")
def f7_json_object(spark, sf_dir):
    said = F.concat(F.lit("Here it is: ```json\n"), F.col("props"), F.lit("\n``` done }"))
    return _table(spark, sf_dir, "events").select("event_id", extract_object(said).alias("found"))


@query("SELECT event_id, '[' || props || ']' AS found FROM events")
def f8_json_array(spark, sf_dir):
    said = F.concat(F.lit("The list: ["), F.col("props"), F.lit("] as asked"))
    return _table(spark, sf_dir, "events").select("event_id", extract_array(said).alias("found"))


@query("SELECT doc_id FROM documents WHERE length(text) > 0 AND length(lang) > 0")
def f9_complete_cases(spark, sf_dir):
    return _table(spark, sf_dir, "documents").where(T.has_value(F.col("text"), F.col("lang"))).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE length({_strip_sql('text')}) > 0")
def f10_nonblank(spark, sf_dir):
    return _table(spark, sf_dir, "documents").where(~T.is_blank(F.col("text"))).select("doc_id")


@query("SELECT doc_id, source FROM documents WHERE source = 'src3'")
def f11_section_filter(spark, sf_dir):
    return flows.active_examples(_table(spark, sf_dir, "documents").select("doc_id", "source").withColumn("section_id", F.col("source")), "src3").select("doc_id", "source")


_RAW_SQL = """CASE doc_id % 9 WHEN 0 THEN CAST(quality AS STRING) WHEN 1 THEN ' 0.25 ' WHEN 2 THEN 'n/a' WHEN 3 THEN '-1' WHEN 4 THEN '1.5'
    WHEN 5 THEN '' WHEN 6 THEN '7e-1' WHEN 7 THEN 'inf' ELSE 'nan' END"""


@query("""
    SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN quality::DOUBLE WHEN 1 THEN 0.25e0 WHEN 2 THEN 0.5e0 WHEN 3 THEN 0e0 WHEN 4 THEN 1e0
        WHEN 5 THEN 0.5e0 WHEN 6 THEN 0.7e0 WHEN 7 THEN 1e0 ELSE 0e0 END AS score FROM labels
""")
def f12_parse_score(spark, sf_dir):
    return _table(spark, sf_dir, "labels").select("doc_id", T.parse_score(F.expr(_RAW_SQL)).alias("score"))


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN quality = 1 ELSE false END AS verdict FROM labels")
def f13_parse_bool(spark, sf_dir):
    raw = F.expr("CASE doc_id % 6 WHEN 0 THEN ' True ' WHEN 1 THEN 'YES' WHEN 2 THEN CAST(quality AS STRING) WHEN 3 THEN 'no' WHEN 4 THEN 'maybe yes' END")
    return _table(spark, sf_dir, "labels").select("doc_id", T.parse_bool(raw).alias("verdict"))


@query("SELECT doc_id, greatest(0e0, 0.5e0 * quality + 0.3e0 * toxic + 0.2e0 * (doc_id % 5 / 4e0) - 0.1e0) AS composite FROM labels")
def f14_composite(spark, sf_dir):
    q, t, c = F.col("quality").cast("double"), F.col("toxic").cast("double"), (F.col("doc_id") % 5) / F.lit(4.0)
    return _table(spark, sf_dir, "labels").select("doc_id", T.composite(q, t, c, F.lit(0.1)).alias("composite"))


@query("""
    SELECT doc_id, CASE WHEN n_chars::DOUBLE / 4000 > 0.9e0 THEN least(0.3e0, (n_chars::DOUBLE / 4000 - 0.9e0) * 3e0) ELSE 0e0 END AS penalty FROM documents
""")
def f15_length_penalty(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.length_penalty(F.col("n_chars"), F.lit(4000)).alias("penalty"))


@query(f"""
    WITH p AS (
        SELECT doc_id, list_distinct({_tokens_sql('lower(b.text)')}) AS want, list_distinct({_tokens_sql('lower(d.text)')}) AS got, d.text
        FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)
    )
    SELECT doc_id, CASE WHEN length({_strip_sql('text')}) = 0 THEN 0e0 WHEN len(want) = 0 THEN 0.5e0
        ELSE least(1e0, greatest(0e0, 0.3e0 + 0.7e0 * (len(list_intersect(want, got))::DOUBLE / len(want)))) END AS score FROM p
""")
def f16_token_overlap(spark, sf_dir):
    d, b = _table(spark, sf_dir, "documents").alias("d"), _table(spark, sf_dir, "benchmark").alias("b")
    return d.join(b, F.col("d.doc_id") % _table(spark, sf_dir, "benchmark").count() == F.col("b.item_id")).select("doc_id", T.token_overlap(F.col("b.text"), F.col("d.text")).alias("score"))


#: Predictions: an event's type as the right tool, the user's next event's type as the chosen one.
_PREDICTIONS_SQL = """
    p AS (SELECT event_id, event_type AS correct_tool, coalesce(lead(' ' || upper(event_type)) OVER (PARTITION BY user_id ORDER BY ts, event_id), '') AS selected_tool FROM events)
"""


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    later = F.lead(F.concat(F.lit(" "), F.upper("event_type"))).over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return _table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("correct_tool"), F.coalesce(later, F.lit("")).alias("selected_tool"))


_MATCH_SQL = "CASE WHEN lower(trim(correct_tool)) = lower(trim(selected_tool)) THEN 1e0 ELSE 0e0 END"
_RATES_SQL = f"""
    {_PREDICTIONS_SQL},
    b AS (SELECT correct_tool AS tool, avg({_MATCH_SQL}) AS baseline_rate FROM p WHERE event_id % 2 = 0 GROUP BY 1),
    e AS (SELECT correct_tool AS tool, avg({_MATCH_SQL}) AS evolved_rate FROM p WHERE event_id % 2 = 1 AND correct_tool <> 'view' GROUP BY 1),
    r AS (
        SELECT b.tool, baseline_rate, coalesce(evolved_rate, 0e0) AS evolved_rate, round(baseline_rate - coalesce(evolved_rate, 0e0), 10) AS delta
        FROM b LEFT JOIN e ON b.tool = e.tool
    )
"""


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _predictions(spark, sf_dir)
    return scoring.compare_rates(scoring.group_accuracy(p.where("event_id % 2 = 0")), scoring.group_accuracy(p.where("event_id % 2 = 1 AND correct_tool <> 'view'")))


@query(f"WITH {_PREDICTIONS_SQL} SELECT event_id, {_MATCH_SQL} AS score FROM p")
def f17_exact_match(spark, sf_dir):
    return _predictions(spark, sf_dir).select("event_id", T.exact_match(F.col("correct_tool"), F.col("selected_tool")).alias("score"))


_TYPE_SQL = "CASE doc_id % 4 WHEN 0 THEN 'skill' WHEN 1 THEN 'tool_description' WHEN 2 THEN 'param_description' ELSE 'other' END"
_LIMIT_SQL = "CASE doc_id % 4 WHEN 1 THEN 500 WHEN 2 THEN 200 ELSE 15000 END"


@query(f"SELECT doc_id, length(text) <= {_LIMIT_SQL} AS passed FROM documents")
def f18_size_gate(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", gates.size_ok(F.col("text"), F.expr(_TYPE_SQL)).alias("passed"))


def _with_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's facts and the next one's length as its baseline: no text is joined."""
    d = _table(spark, sf_dir, "documents").select("doc_id", "text", F.expr(_TYPE_SQL).alias("artifact_type"))
    b = d.select((F.col("doc_id") - 1).alias("doc_id"), F.length("text").alias("baseline_text"))
    return d.select("doc_id", gates.facts(F.col("text")).alias("text"), "artifact_type").join(b, "doc_id", "left")


_BASELINE_SQL = f"a AS (SELECT d.doc_id, d.text, b.text AS base, {_TYPE_SQL.replace('doc_id', 'd.doc_id')} AS kind, {_LIMIT_SQL.replace('doc_id', 'd.doc_id')} AS most FROM documents d LEFT JOIN documents b ON b.doc_id = d.doc_id + 1)"


@query(f"WITH {_BASELINE_SQL} SELECT doc_id, (length(text) - length(base))::DOUBLE / greatest(1, length(base)) <= 0.2e0 AS passed FROM a")
def f19_growth_gate(spark, sf_dir):
    return _with_baseline(spark, sf_dir).select("doc_id", (gates.grown_by(F.col("text.chars"), F.col("baseline_text")) <= gates.MAX_GROWTH).alias("passed"))


@query(f"SELECT doc_id, length({_strip_sql('text')}) > 0 AS passed FROM documents")
def f20_nonempty_gate(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", gates.non_empty(F.col("text")).alias("passed"))


_FRONT_SQL = "CASE doc_id % 3 WHEN 0 THEN '---' || chr(10) || 'name: a' || chr(10) || 'description: b' || chr(10) || '---' WHEN 1 THEN '---' || chr(10) || 'name: a' || chr(10) || '---' ELSE '' END"


@query(f"""
    WITH a AS (SELECT doc_id, {_FRONT_SQL} || chr(10) || text AS t FROM documents)
    SELECT doc_id, starts_with({_strip_sql('t')}, '---') AND contains(substr(t, 1, 500), 'name:') AND contains(substr(t, 1, 500), 'description:') AS passed FROM a
""")
def f21_structure_gate(spark, sf_dir):
    t = F.concat(F.expr(_FRONT_SQL), F.lit("\n"), F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", gates.structure_ok(t).alias("passed"))


_REPORT_SQL = f"""
    {_BASELINE_SQL},
    g AS (
        SELECT doc_id, 'size_limit' AS constraint_name, length(text) <= most AS passed FROM a
        UNION ALL SELECT doc_id, 'growth_limit', (length(text) - length(base))::DOUBLE / greatest(1, length(base)) <= 0.2e0 FROM a WHERE length(base) > 0
        UNION ALL SELECT doc_id, 'non_empty', length({_strip_sql('text')}) > 0 FROM a
        UNION ALL SELECT doc_id, 'skill_structure', starts_with({_strip_sql('text')}, '---') AND contains(substr(text, 1, 500), 'name:') AND contains(substr(text, 1, 500), 'description:') FROM a WHERE kind = 'skill'
    )
"""


@query(f"WITH {_REPORT_SQL} SELECT * FROM g")
def f22_gate_report(spark, sf_dir):
    return gates.gate_report(_with_baseline(spark, sf_dir)).select("doc_id", "constraint_name", "passed")


@query(f"WITH {_REPORT_SQL} SELECT doc_id, count(*) AS gates, bool_and(passed) AS passed FROM g GROUP BY doc_id")
def a7_all_passed(spark, sf_dir):
    return gates.all_passed(gates.gate_report(_with_baseline(spark, sf_dir)), "doc_id")


@query("""
    SELECT string_agg('- item' || item_id || ': ' || text, chr(10) ORDER BY item_id) AS summaries, string_agg('item' || item_id, ', ' ORDER BY item_id) AS names FROM benchmark
""")
def f23_render_list(spark, sf_dir):
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("tool"), F.col("text").alias("description"))
    return rendering.render_tools(items)


@query("""
    WITH s AS (SELECT item_id, item_id % 4 AS prompt, 'item' || item_id AS section_id, text FROM benchmark)
    SELECT a.prompt, a.section_id AS active, string_agg('[' || o.section_id || ']: ' || o.text, chr(10) || chr(10) ORDER BY o.item_id) AS context
    FROM s a JOIN s o ON a.prompt = o.prompt AND a.section_id <> o.section_id GROUP BY 1, 2
""")
def f24_frozen_context(spark, sf_dir):
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), (F.col("item_id") % 4).alias("prompt"), F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("section_id"), "text")
    return rendering.frozen_context(items, "prompt")


@query("SELECT item_id, '---' || chr(10) || 'name: x' || chr(10) || '---' || chr(10) || chr(10) || text || chr(10) AS skill FROM benchmark")
def k6_reassemble_skill(spark, sf_dir):
    return _table(spark, sf_dir, "benchmark").select("item_id", rendering.reassemble_skill(F.lit("name: x"), F.col("text")).alias("skill"))


@query(f"WITH {_RATES_SQL} SELECT * FROM r")
def j1_rate_compare(spark, sf_dir):
    return _rates(spark, sf_dir)


@query(f"WITH {_BASELINE_SQL} SELECT doc_id, text = base AS same FROM a WHERE base IS NOT NULL")
def j2_original_evolved(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))  # digests are joined, not texts
    both = flows.paired(d.select((F.col("doc_id") - 1).alias("doc_id"), "digest"), d, "doc_id", "digest")
    return both.select("doc_id", (F.col("original") == F.col("evolved")).alias("same"))


@query(f"SELECT conv_id, turn FROM conversations WHERE role = 'user' AND NOT {_relevant_sql('text')}")
def j5_remainder_anti(spark, sf_dir):
    user = _table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("key", F.col("conv_id") * 1_000_000 + F.col("turn"))
    chosen = user.where(T.is_relevant(F.col("text"), SKILL_NAME, SKILL_TEXT))
    return candidates.remainder(user, chosen, "key").select("conv_id", "turn")


def _tools(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES (0, 'View'), (1, 'click '), (2, 'VIEW'), (3, 'purchase'), (4, 'unused') AS t(ord, tool)")


@query("""
    SELECT event_id, CASE event_type WHEN 'view' THEN 'View' WHEN 'click' THEN 'click ' ELSE event_type END AS resolved FROM events WHERE event_type IN ('view', 'click', 'purchase')
""")
def j6_resolve_name(spark, sf_dir):
    named = _table(spark, sf_dir, "events").select("event_id", F.concat(F.lit(" "), F.upper("event_type")).alias("name"))
    return scoring.resolve_names(named, _tools(spark)).select("event_id", "resolved")


@query("""
    SELECT event_id, CASE event_type WHEN 'view' THEN 'View' WHEN 'click' THEN 'click ' ELSE event_type END AS tool_a, 'purchase' AS tool_b
    FROM events WHERE event_type IN ('view', 'click', 'purchase') AND event_id % 3 <> 0
""")
def j7_resolve_pairs(spark, sf_dir):
    two = F.array(F.col("event_type"), F.lit("Purchase"))
    pairs = _table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.array("event_type")).otherwise(two).alias("tools"))
    return scoring.resolve_pairs(pairs, _tools(spark)).select("event_id", "tool_a", "tool_b")


@query("SELECT l.doc_id, b.text AS section_text FROM labels l LEFT JOIN benchmark b ON b.item_id = l.doc_id % 1000")
def j8_enrich(spark, sf_dir):
    rows = _table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") % 1000).alias("section_id"))
    return scoring.enrich(rows, _table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "section_id")).select("doc_id", "section_text")


@query("SELECT d.doc_id, coalesce(b.text, '') AS project FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id")
def j9_session_workspace(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("session_id"))
    return sessions.with_projects(d, _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("session_id"), F.col("text").alias("project"))).select("doc_id", "project")


@query("SELECT l.doc_id, c.which, c.which = 'evolved' AND l.quality = 1 AS hit FROM labels l CROSS JOIN (VALUES ('baseline'), ('evolved')) c(which)")
def j10_candidates_by_examples(spark, sf_dir):
    each = flows.each_candidate(spark.sql("SELECT * FROM VALUES ('baseline'), ('evolved') AS t(which)"), _table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return each.select("doc_id", "which", ((F.col("which") == "evolved") & (F.col("quality") == 1)).alias("hit"))


@query(f"WITH {_PREDICTIONS_SQL} SELECT correct_tool AS tool, count(*) AS total, avg({_MATCH_SQL}) AS rate FROM p GROUP BY 1")
def a1_group_accuracy(spark, sf_dir):
    return scoring.group_accuracy(_predictions(spark, sf_dir))


@query(f"WITH {_PREDICTIONS_SQL} SELECT count(*) AS n, sum({_MATCH_SQL})::BIGINT AS hits, sum({_MATCH_SQL}) / greatest(count(*), 1) AS rate FROM p")
def a2_overall_accuracy(spark, sf_dir):
    return scoring.overall_accuracy(_predictions(spark, sf_dir))


@query("SELECT count(*) AS n, coalesce(avg(quality::DOUBLE), 0e0) AS mean FROM labels")
def a3_mean_score(spark, sf_dir):
    return scoring.mean_score(_table(spark, sf_dir, "labels").select(F.col("quality").cast("double").alias("score")))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def a4_source_counts(spark, sf_dir):
    return scoring.source_counts(_table(spark, sf_dir, "documents"))


@query("""
    WITH t AS (SELECT i AS ord, 'src' || i AS tool FROM range(25) r(i)), n AS (SELECT source, count(*) AS n FROM documents GROUP BY source)
    SELECT ord, tool, coalesce(n, 0) AS n FROM t LEFT JOIN n ON source = tool WHERE coalesce(n, 0) < 3
""")
def a5_coverage(spark, sf_dir):
    tools = spark.range(25).select(F.col("id").alias("ord"), F.concat(F.lit("src"), F.col("id").cast("string")).alias("tool"))
    return scoring.coverage(tools, _table(spark, sf_dir, "documents").select(F.col("source").alias("correct_tool")))


@query(f"""
    WITH {_RATES_SQL}, v AS (SELECT count(*) AS n_tools, coalesce(string_agg(tool, ',' ORDER BY tool) FILTER (WHERE delta > 0.02e0), '') AS regressed_tools FROM r)
    SELECT regressed_tools = '' AS passed, n_tools, regressed_tools FROM v
""")
def a8_regression(spark, sf_dir):
    return scoring.regression_verdict(_rates(spark, sf_dir)).select("passed", "n_tools", "regressed_tools")


@query(f"""
    WITH {_PREDICTIONS_SQL}, h AS (
        SELECT event_id, correct_tool AS tool, ({_MATCH_SQL})::BIGINT - CASE WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 10 = 1 THEN 0 ELSE ({_MATCH_SQL})::BIGINT END AS lost FROM p
    ), w AS (
        SELECT tool, lost, g * 4 + k AS replicate, ('0x' || substr(md5(event_id || ':42:' || g), k * 8 + 1, 8))::BIGINT AS v FROM h, range(50) r(g), range(4) q(k)
    ), x AS (
        SELECT tool, replicate, lost, {' + '.join(f'(v >= {t})::INT' for t in scoring._STEPS)} AS weight FROM w
    ), d AS (
        SELECT tool, replicate, sum(weight * lost) / sum(weight)::DOUBLE AS delta FROM x GROUP BY ALL HAVING sum(weight) > 0
    ), i AS (
        SELECT tool, round(quantile_cont(delta, 0.025e0), 10) AS low, round(quantile_cont(delta, 0.975e0), 10) AS high FROM d GROUP BY tool
    ), o AS (
        SELECT tool, count(*) AS n, round(avg(lost), 10) AS delta FROM h GROUP BY tool
    )
    SELECT o.tool, n, delta, low, high, delta > 0.02e0 AS regressed, CASE WHEN delta > 0.02e0 THEN low > 0.02e0 ELSE high <= 0.02e0 END AS certain FROM o JOIN i ON o.tool = i.tool
""")
def a8_intervals(spark, sf_dir):
    """A1 and A8 with intervals: paired bootstrap of each tool's drop in rate."""
    evolved = F.when(F.col("event_id") % 3 == 0, F.col("correct_tool")).when(F.col("event_id") % 10 == 1, F.lit("none")).otherwise(F.col("selected_tool"))
    paired = _predictions(spark, sf_dir).withColumn("evolved_tool", evolved).withColumnRenamed("selected_tool", "baseline_tool")
    return scoring.regression_report(scoring.rate_intervals(paired, "event_id"))


@query("SELECT count(*) FILTER (WHERE toxic = 1) AS errors, (count(*) FILTER (WHERE toxic = 1))::DOUBLE / 1000 AS rate FROM labels")
def a9_error_rate(spark, sf_dir):
    return scoring.error_rate(_table(spark, sf_dir, "labels").select((F.col("toxic") == 1).alias("failed")), F.lit(1000))


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = spark.sql("SELECT * FROM VALUES ('default_agent_identity', 0), ('memory_guidance', 1), ('skills_guidance', 2), ('unknown', 3) AS t(section_id, ord)")
    each = _table(spark, sf_dir, "documents").select("source").distinct()
    family = each.select(F.concat(F.lit("platform_hints."), "source").alias("section_id"), (F.regexp_extract("source", "\\d+", 0).cast("int") + 10).alias("ord"))
    return some.unionByName(family)


@query("""
    WITH f AS (SELECT DISTINCT source, regexp_extract(source, '\\d+')::INT AS i FROM documents), m AS (SELECT source, i, row_number() OVER (ORDER BY i) - 1 AS k, count(*) OVER () AS n FROM f)
    SELECT 'platform_hints.' || source AS section_id, i + 10 AS ord, (20 // n + (k < 20 % n)::INT)::BIGINT AS target FROM m
    UNION ALL SELECT * FROM (VALUES ('default_agent_identity', 0, 20::BIGINT), ('memory_guidance', 1, 15), ('skills_guidance', 2, 15))
""")
def a10_quota(spark, sf_dir):
    return scoring.quotas(_sections(spark, sf_dir))


_HASH_SQL = "md5(({0})::VARCHAR || '42')"


@query(f"""
    WITH u AS (SELECT conv_id * 1000000 + turn AS key, {_relevant_sql('text')} AS hit FROM conversations WHERE role = 'user'),
    h AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS r FROM u WHERE hit QUALIFY r < 600),
    n AS (SELECT count(*) AS n FROM h),
    o AS (SELECT key, row_number() OVER (ORDER BY {_HASH_SQL.format('key')}, key) - 1 AS r FROM u WHERE NOT hit QUALIFY r < 400)
    SELECT key, r AS ord FROM h UNION ALL SELECT key, r + n AS ord FROM o, n WHERE n < 200 AND r + n < 600
""")
def o3_candidate_cap(spark, sf_dir):
    user = _table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("key", F.col("conv_id") * 1_000_000 + F.col("turn"))
    return candidates.cap_candidates(user, T.is_relevant(F.col("text"), SKILL_NAME, SKILL_TEXT), "key", 200).select("key", F.col("ord").cast("long").alias("ord"))


@query("SELECT doc_id::VARCHAR AS session_id FROM documents ORDER BY doc_id DESC LIMIT 50")
def o2_limit(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("session_id"))
    return sessions.limited(rows, 50, F.desc("doc_id")).select("session_id")


@query("SELECT i AS n, greatest(1, i // 2) AS train, greatest(1, i // 4) AS val FROM range(200) t(i)")
def sp1_split_sizes(spark, sf_dir):
    a, b = splits.split_sizes(F.col("id"))
    return spark.range(200).select(F.col("id").alias("n"), a.alias("train"), b.alias("val"))


_SPLIT_SQL = """
    r AS (SELECT {1}, row_number() OVER (ORDER BY md5(({1})::VARCHAR || '42'), {1}) - 1 AS rank, count(*) OVER () AS n FROM {0}),
    m AS (SELECT {1}, CASE WHEN rank < greatest(1, n // 2) THEN 'train' WHEN rank < greatest(1, n // 2) + greatest(1, n // 4) THEN 'val' ELSE 'holdout' END AS split FROM r)
"""


@query(f"WITH {_SPLIT_SQL.format('documents', 'doc_id')} SELECT doc_id, split FROM m")
def sp1_split_members(spark, sf_dir):
    return splits.split_members(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("""
    WITH RECURSIVE g AS (
        SELECT CASE WHEN text IS NULL THEN '' ELSE sha256(text) END AS key, count(*) AS size FROM documents GROUP BY 1
    ), o AS (
        SELECT *, row_number() OVER (ORDER BY size DESC, md5(key || '42'), key) - 1 AS place FROM g
    ), c AS (
        SELECT size, count(*) AS m, row_number() OVER (ORDER BY size DESC) AS k, min(place) AS at FROM o GROUP BY size
    ), n AS (
        SELECT sum(size * m)::BIGINT AS n FROM c
    ), t AS (
        SELECT greatest(1, n // 2) AS a, greatest(1, n // 4) AS b, n FROM n
    ), s AS (
        SELECT 0::BIGINT AS k, 0::BIGINT AS ta, 0::BIGINT AS tb, 0::BIGINT AS tc, a AS la, b AS lb, n - a - b AS lc FROM t
        UNION ALL
        SELECT k, ta, tb, tc, la - size * (ta - fa), lb - size * (tb - fb), lc - size * (tc - fc) FROM (
            SELECT *, fa + (e1 = 'a')::INT + (e2 = 'a')::INT AS ta, fb + (e1 = 'b')::INT + (e2 = 'b')::INT AS tb, fc + (e1 = 'c')::INT + (e2 = 'c')::INT AS tc FROM (
                SELECT *, CASE WHEN m - fa - fb - fc < 2 THEN '' WHEN la - size * (e1 = 'a')::INT >= greatest(lb - size * (e1 = 'b')::INT, lc - size * (e1 = 'c')::INT) THEN 'a' WHEN lb - size * (e1 = 'b')::INT >= lc - size * (e1 = 'c')::INT THEN 'b' ELSE 'c' END AS e2 FROM (
                    SELECT *, CASE WHEN m - fa - fb - fc < 1 THEN '' WHEN la >= greatest(lb, lc) THEN 'a' WHEN lb >= lc THEN 'b' ELSE 'c' END AS e1 FROM (
                        SELECT k, size, m, fa, fb, fc, la - size * fa AS la, lb - size * fb AS lb, lc - size * fc AS lc FROM (
                            SELECT c.k, size, m, la, lb, lc, coalesce(m * greatest(la, 0) // nullif(r, 0), 0) AS fa, coalesce(m * greatest(lb, 0) // nullif(r, 0), 0) AS fb, coalesce(m * greatest(lc, 0) // nullif(r, 0), 0) AS fc
                            FROM (SELECT *, greatest(la, 0) + greatest(lb, 0) + greatest(lc, 0) AS r FROM s) s JOIN c ON c.k = s.k + 1
                        )
                    )
                )
            )
        )
    )
    SELECT d.doc_id, CASE WHEN o.place - c.at < s.ta THEN 'train' WHEN o.place - c.at < s.ta + s.tb THEN 'val' ELSE 'holdout' END AS split
    FROM documents d JOIN o ON o.key = CASE WHEN d.text IS NULL THEN '' ELSE sha256(d.text) END JOIN c ON c.size = o.size JOIN s ON s.k = c.k
""")
def sp1_split_groups(spark, sf_dir):
    """SP1 on groups: documents of equal text lie in one split."""
    return splits.split_groups(_table(spark, sf_dir, "documents"), F.col("text")).select("doc_id", "split")


@query("SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'train' WHEN quality = 0 THEN 'val' ELSE 'holdout' END AS split FROM labels")
def u1_union_splits(spark, sf_dir):
    rows = _table(spark, sf_dir, "labels")
    return splits.union_splits(rows.where("quality = 1 AND toxic = 0"), rows.where("quality = 0"), rows.where("quality = 1 AND toxic = 1")).select("doc_id", "split")


@query(f"""
    WITH {_W1_SQL}
    SELECT 'history' AS source, text AS task_input, CAST(NULL AS VARCHAR) AS assistant_response, conv_id::VARCHAR AS session_id
    FROM conversations WHERE role = 'user' AND length(text) >= 10 AND NOT regexp_matches(text, {SECRET_SQL})
    UNION ALL SELECT 'sessions', task_input, assistant_response, conv_id::VARCHAR FROM w1
""")
def u2_union_sources(spark, sf_dir):
    readers = {"sessions": lambda: sessions.parse_sessions(_session_files(spark, sf_dir)), "history": lambda: parse_history(_history_lines(spark, sf_dir)), "events": lambda: sessions.no_messages(spark)}
    return sessions.combined(spark, readers, ["history", "unknown", "sessions"]).select("source", "task_input", "assistant_response", "session_id")


@query(f"""
    SELECT doc_id, len(list_intersect(list_distinct({_tokens_sql('lower(d.text)')}), list_distinct({_tokens_sql('lower(b.text)')})))::INT AS shared
    FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)
""")
def u3_token_intersection(spark, sf_dir):
    d, b = _table(spark, sf_dir, "documents").alias("d"), _table(spark, sf_dir, "benchmark").alias("b")
    shared = F.size(F.array_intersect(T.tokens(F.lower(F.col("d.text"))), T.tokens(F.lower(F.col("b.text")))))
    return d.join(b, F.col("d.doc_id") % _table(spark, sf_dir, "benchmark").count() == F.col("b.item_id")).select("doc_id", shared.alias("shared"))


@query(f"""
    WITH {_W1_SQL}, c AS (SELECT conv_id * 1000000 + turn AS key FROM w1 WHERE {_relevant_sql('task_input')}),
    {_SPLIT_SQL.format('c', 'key')}
    SELECT s.split, count(key) AS n FROM (VALUES ('train'), ('val'), ('holdout')) s(split) LEFT JOIN m ON m.split = s.split GROUP BY s.split
""")
def e1_mining_flow(spark, sf_dir):
    """Sessions to counted splits: pairing, screening, relevance, split; all splits are there even if empty."""
    pairs = pairing.pair_first_response(_table(spark, sf_dir, "conversations")).withColumn("source", F.lit("sessions"))
    kept = pairs.where(T.has_value(F.col("task_input"), F.col("source"))).where(T.is_relevant(F.col("task_input"), SKILL_NAME, SKILL_TEXT))
    members = splits.split_members(kept.withColumn("key", F.col("conv_id") * 1_000_000 + F.col("turn")).select("key"), "key")
    names = spark.sql("SELECT * FROM VALUES ('train'), ('val'), ('holdout') AS t(split)")
    return names.join(members.groupBy("split").agg(F.count("*").alias("n")), "split", "left").select("split", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""
    WITH {_W1_SQL}, c AS (SELECT conv_id * 1000000 + turn AS key FROM w1 WHERE {_relevant_sql('task_input')}),
    {_SPLIT_SQL.format('c', 'key')}
    SELECT key, split FROM m
""")
def e1_mining_members(spark, sf_dir):
    """The mining flow, with the split of each message."""
    pairs = pairing.pair_first_response(_table(spark, sf_dir, "conversations")).withColumn("source", F.lit("sessions"))
    kept = pairs.where(T.has_value(F.col("task_input"), F.col("source"))).where(T.is_relevant(F.col("task_input"), SKILL_NAME, SKILL_TEXT))
    return splits.split_members(kept.withColumn("key", F.col("conv_id") * 1_000_000 + F.col("turn")).select("key"), "key")


_RANK_SQL = f"""
    {_W1_SQL},
    u AS (SELECT conv_id * 1000000 + turn AS key, task_input, {_relevant_sql('task_input')} AS hit FROM w1 WHERE length(task_input) > 0),
    h AS (SELECT key, task_input, row_number() OVER (ORDER BY key) - 1 AS ord FROM u WHERE hit QUALIFY ord < 150),
    n AS (SELECT count(*) AS n FROM h),
    o AS (SELECT key, task_input, row_number() OVER (ORDER BY {_HASH_SQL.format('key')}, key) - 1 AS r FROM u WHERE NOT hit QUALIFY r < 100),
    c AS (SELECT key, task_input, ord FROM h UNION ALL SELECT key, task_input, r + n AS ord FROM o, n WHERE n < 50 AND r + n < 150)
"""


@query(f"""
    WITH {_RANK_SQL.replace(' u AS (SELECT conv_id * 1000000', ' v AS (SELECT conv_id * 1000000').replace('FROM u WHERE', 'FROM v WHERE')}
    SELECT substr(task_input, 1, 2000) AS task_input, {_strip_sql("('Answers: ' || substr(task_input, 1, 80))")} AS expected_behavior, 'medium' AS difficulty, 'general' AS category, 'sessions' AS source, key, ord
    FROM c WHERE len(list_intersect(list_distinct({_tokens_sql('lower(substr(task_input, 1, 1000))')}), [{', '.join(f"'{w}'" for w in sorted(set(SKILL_TEXT[:800].lower().split())))}])) > 0
    ORDER BY ord LIMIT 50
""")
def l1_relevance_offline(spark, sf_dir):
    """Mining with the offline model: its answers are no measure of quality."""
    pairs = pairing.pair_first_response(_table(spark, sf_dir, "conversations")).withColumn("source", F.lit("sessions"))
    keyed = pairs.withColumn("key", F.col("conv_id") * 1_000_000 + F.col("turn"))
    return flows.mine(keyed, SKILL_NAME, SKILL_TEXT, "key").withColumn("ord", F.col("ord").cast("long"))


@query("SELECT doc_id, CASE WHEN quality = toxic THEN 1e0 ELSE 0e0 END AS correctness, CASE WHEN quality = toxic THEN 1e0 ELSE 0e0 END AS composite FROM labels")
def l8_rubric_offline(spark, sf_dir):
    """Rubric scores of the offline model."""
    rows = _table(spark, sf_dir, "labels").select("doc_id", F.lit("task").alias("task"), F.col("quality").cast("string").alias("expected"), F.col("toxic").cast("string").alias("output"), F.lit("skill").alias("skill"))
    return judge.score_rubric(rows, judge.OfflineModel(), "task", "expected", "output", "skill").select("doc_id", "correctness", "composite")


@query("""
    SELECT doc_id, CASE WHEN quality = toxic THEN 1e0 ELSE 0e0 END AS correctness, CASE WHEN quality = toxic THEN 1e0 ELSE 0e0 END AS composite,
        (SELECT count(*) FROM (SELECT DISTINCT quality, toxic FROM labels)) AS n_answers
    FROM labels
""")
def l8_stored_answers(spark, sf_dir):
    """Rubric scores of all rows in two runs over one folder of answers: a call for each distinct request, and none in the second run."""
    rows = _table(spark, sf_dir, "labels").select("doc_id", F.lit("task").alias("task"), F.col("quality").cast("string").alias("expected"), F.col("toxic").cast("string").alias("output"), F.lit("skill").alias("skill"))
    model = answers.Stored(judge.OfflineModel(), fresh_path(spark, "answers"), "offline")
    for _ in range(2):
        scored = judge.score_rubric(rows, model, "task", "expected", "output", "skill")
    n = model.answers(spark, "rubric").agg(F.count("*").alias("n_answers"))
    return scored.select("doc_id", "correctness", "composite").join(F.broadcast(n))  # one row


@query("""
    WITH l AS (SELECT item_id, string_split(text, chr(10)) AS x FROM benchmark WHERE length(text) > 0), n AS (SELECT *, least(3, len(x)) AS k, greatest(1, len(x) - 2) AS first FROM l)
    SELECT item_id AS name, '--- original/' || item_id || chr(10) || '+++ evolved/' || item_id || chr(10) || '@@ -' || first || CASE WHEN k > 1 THEN ',' || k ELSE '' END
        || ' +' || first || ',' || (k + 1) || ' @@' || chr(10) || ' ' || array_to_string(x[first:], chr(10) || ' ') || chr(10) || '+more' AS diff
    FROM n
""")
def k5_diffs(spark, sf_dir):
    """Unified diffs of benchmark items and the same with a line added."""
    a = _table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "name")
    return rendering.diffs(a, a.withColumn("text", F.concat("text", F.lit("\nmore"))))


# ---- what a model writes, with the offline model


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as tools: ord, tool, description."""
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("tool"), F.col("text").alias("description"))


@query("SELECT item_id, 'skill ' || i || ': ' || substr(text, 1, 20) AS task_input, 'does ' || i AS expected_behavior, 'medium' AS difficulty, 'general' AS category, 'synthetic' AS source FROM benchmark, range(20) r(i) WHERE i < 3 + item_id % 4")
def l2_test_cases(spark, sf_dir):
    rows = _table(spark, sf_dir, "benchmark").select("item_id", "text", F.lit("skill").alias("artifact_type"), (3 + F.col("item_id") % 4).cast("string").alias("n"))
    return generate.test_cases(rows, judge.OfflineModel())


_ORDER_SQL = "o AS (SELECT item_id, 'item' || item_id AS tool, row_number() OVER (ORDER BY item_id) - 1 AS k FROM benchmark), p AS (SELECT a.tool AS a, b.tool AS b FROM o a JOIN o b ON b.k = a.k + 1 WHERE a.k % 2 = 0)"


@query(f"WITH {_ORDER_SQL} SELECT upper(a) AS tool_a, b AS tool_b, a || ' or ' || b AS overlap FROM p")
def l3_similar_tools(spark, sf_dir):
    return generate.similar_tools(_items(spark, sf_dir), judge.OfflineModel()).select(F.col("tools")[0].alias("tool_a"), F.col("tools")[1].alias("tool_b"), "overlap")


_PLAN_SQL = "t AS (SELECT 'item' || item_id AS tool, l.level, i FROM benchmark, (VALUES ('easy', 2), ('medium', 3), ('hard', 1)) l(level, n), range(3) r(i) WHERE i < l.n)"


@query(f"WITH {_PLAN_SQL} SELECT level || ' ' || i || ' for ' || tool AS task_description, tool AS correct_tool, '{{\"i\":' || i || '}}' AS correct_params, level AS difficulty, 'synthetic' AS source FROM t")
def l4_tool_tasks(spark, sf_dir):
    return generate.tool_tasks(_items(spark, sf_dir), judge.OfflineModel()).select("task_description", "correct_tool", "correct_params", "difficulty", "source")


_CONFUSED_SQL = f"""
    {_ORDER_SQL}, x AS (SELECT a || ' or ' || b || ' ' || i AS task_description, CASE i % 3 WHEN 0 THEN a ELSE b END AS correct_tool, CASE i % 3 WHEN 0 THEN b ELSE a END AS confuser, 'case ' || i AS reason FROM p, range(7) r(i) WHERE i % 3 < 2)
"""


@query(f"WITH {_CONFUSED_SQL} SELECT *, 'hard' AS difficulty FROM x")
def l5_confuser_tasks(spark, sf_dir):
    tools, model = _items(spark, sf_dir), judge.OfflineModel()
    got = generate.confuser_tasks(generate.similar_tools(tools, model), tools, model)
    return got.select("task_description", "correct_tool", F.col("confuser_tools")[0].alias("confuser"), "reason", "difficulty")


@query("SELECT 'medium ' || i || ' for item' || item_id AS task_description, 'item' || item_id AS correct_tool FROM benchmark, range(3) r(i) WHERE item_id % 4 < 3")
def l6_supplement(spark, sf_dir):
    """Every fourth item has three examples, the others one or none."""
    tools = _items(spark, sf_dir)
    three = tools.where("ord % 4 = 3").select(F.explode(F.array_repeat("tool", 3)).alias("correct_tool"))
    return generate.supplement(three.union(tools.where("ord % 4 = 1").select("tool")), tools, judge.OfflineModel()).select("task_description", "correct_tool")


@query(r"""
    WITH f AS (SELECT DISTINCT source, regexp_extract(source, '\d+')::INT AS i FROM documents), m AS (SELECT source, row_number() OVER (ORDER BY i) - 1 AS k, count(*) OVER () AS n FROM f),
    q AS (
        SELECT 'platform_hints.' || source AS section_id, 20 // n + (k < 20 % n)::INT AS target FROM m
        UNION ALL SELECT * FROM (VALUES ('default_agent_identity', 20), ('memory_guidance', 15), ('skills_guidance', 15))
    )
    SELECT section_id, section_id || ' ' || i AS user_message, 'text of ' || substr(section_id, 1, 12) AS expected_behavior, CASE WHEN i % 2 = 1 THEN 'easy' ELSE 'medium' END AS difficulty FROM q, range(20) r(i) WHERE i < target
""")
def l7_section_scenarios(spark, sf_dir):
    sections = _sections(spark, sf_dir).withColumn("text", F.concat(F.lit("text of "), "section_id"))
    return generate.section_scenarios(sections, judge.OfflineModel()).select("section_id", "user_message", "expected_behavior", "difficulty")


@query(f"""
    WITH {_CONFUSED_SQL}, {_PLAN_SQL}, n AS (SELECT (SELECT count(*) FROM x) + (SELECT count(*) FROM t) AS n)
    SELECT s.split, CASE s.split WHEN 'train' THEN greatest(1, n // 2) WHEN 'val' THEN greatest(1, n // 4) ELSE n - greatest(1, n // 2) - greatest(1, n // 4) END AS examples FROM n, (VALUES ('train'), ('val'), ('holdout')) s(split)
""")
def e2_tool_dataset(spark, sf_dir):
    """The whole flow, counted by split; all items are covered, so that nothing is supplemented."""
    return generate.tool_dataset(_items(spark, sf_dir), judge.OfflineModel()).groupBy("split").agg(F.count("*").alias("examples"))


@query("SELECT item_id, item_id % 2 = 0 AS factual_ok, item_id % 3 > 0 AS role_ok FROM benchmark")
def l9_claims(spark, sf_dir):
    """Odd items claim something new; every third one is another text."""
    rows = _table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("original"), F.when(F.col("item_id") % 2 == 1, F.concat("text", F.lit(" zzclaim"))).otherwise(F.col("text")).alias("evolved"))
    claims = judge.check_claims(rows, judge.OfflineModel()).select("item_id", "factual_ok")
    other = rows.withColumn("evolved", F.when(F.col("item_id") % 3 == 0, "zz").otherwise(F.col("evolved")))
    return claims.join(judge.check_role(other, judge.OfflineModel()).select("item_id", "role_ok"), "item_id")


_SHOWN_SQL = "(VALUES (0, 'alpha', 'the of'), (1, 'beta', 'and to in'), (2, 'gamma', 'zz')) c(ord, tool, description)"


@query(f"""
    WITH m AS (SELECT item_id, list_distinct({_tokens_sql('lower(text)')}) AS want FROM benchmark),
    s AS (SELECT item_id, tool, len(list_intersect(want, string_split(tool || ' ' || description, ' ')))::DOUBLE / len(want) AS share FROM m, {_SHOWN_SQL})
    SELECT item_id, arg_max(tool, (share, tool)) AS selected_tool FROM s GROUP BY item_id
""")
def l10_tool_selector(spark, sf_dir):
    tools = spark.sql(f"SELECT * FROM VALUES {_SHOWN_SQL.split('VALUES ')[1].split(') c(')[0]} AS c(ord, tool, description)")
    rows = _table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("task_description"))
    return flows.predict_tools(rows, tools, judge.OfflineModel()).select("item_id", "selected_tool")


@query(f"SELECT item_id, {_strip_sql("substr(CASE item_id % 2 WHEN 0 THEN 'be kind' || chr(10) || chr(10) || '[b]: be short' ELSE 'be short' || chr(10) || chr(10) || '[a]: be kind' END, 1, 200) || ' ' || text")} AS output FROM benchmark")
def l11_section_responder(spark, sf_dir):
    sections = spark.sql("SELECT * FROM VALUES (0, 'a', 'be kind'), (1, 'b', 'be short') AS s(ord, section_id, text)")
    rows = _table(spark, sf_dir, "benchmark").select("item_id", F.when(F.col("item_id") % 2 == 0, "a").otherwise("b").alias("section_id"), F.col("text").alias("user_message"))
    return flows.answer_sections(sections, rows, judge.OfflineModel()).select("item_id", "output")


@query(f"SELECT item_id, which, {_strip_sql("substr(context, 1, 200) || ' ' || text")} AS output FROM benchmark, (VALUES ('baseline', 'do this'), ('evolved', 'do that')) c(which, context)")
def l12_skill_executor(spark, sf_dir):
    shown = spark.sql("SELECT * FROM VALUES ('baseline', 'do this'), ('evolved', 'do that') AS c(which, context)")
    rows = flows.each_candidate(shown, _table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("task_input")))
    return flows.answer(rows, judge.OfflineModel(), "context", "task_input").select("item_id", "which", "output")


@query("""
    SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 0e0 WHEN quality = toxic THEN 1e0 ELSE 0.3e0 END AS quick, CASE WHEN doc_id % 5 = 0 THEN 0e0 WHEN quality = toxic THEN 1e0 ELSE 0e0 END AS judged FROM labels
""")
def l13_metric(spark, sf_dir):
    rows = _table(spark, sf_dir, "labels").select("doc_id", F.lit("task").alias("task_input"), F.col("quality").cast("string").alias("expected"), F.when(F.col("doc_id") % 5 == 0, "  ").otherwise(F.col("toxic").cast("string")).alias("output"), F.lit("s").alias("skill"))
    quick, judged = (judge.metric(rows, judge.OfflineModel(), "expected", "output", q).select("doc_id", F.col("score").alias(n)) for q, n in ((True, "quick"), (False, "judged")))
    return quick.join(judged, "doc_id")


# ---- files, skills, sources


@query("SELECT event_id, '[' || props || ']' AS found FROM events")
def f8b_json_array_strict(spark, sf_dir):
    said = F.concat(F.lit("The list: ["), F.col("props"), F.lit("] as asked"))
    return _table(spark, sf_dir, "events").select("event_id", extract_array(said, strict=True).alias("found"))


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("task_input"), F.coalesce("source", F.lit("none")).alias("expected_behavior"), F.lit(None).cast("string").alias("difficulty"), F.col("lang").alias("category"), F.lit("golden").alias("source"))


@query(f"""
    WITH {_SPLIT_SQL.format('documents', 'doc_id')}
    SELECT d.doc_id::VARCHAR AS task_input, coalesce(source, 'none') AS expected_behavior, 'medium' AS difficulty, coalesce(lang, 'general') AS category, 'golden' AS source, split FROM documents d JOIN m ON m.doc_id = d.doc_id
""")
def k1_dataset_round_trip(spark, sf_dir):
    """K1 and S6: examples with their split, written as JSON lines and read again."""
    members = splits.split_members(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select(F.col("doc_id").cast("string").alias("task_input"), "split")
    folder = fresh_path(spark, "dataset")
    datasets.save_dataset(_examples(spark, sf_dir).join(members, "task_input"), folder)
    return datasets.load_dataset(spark, folder)


@query(f"""
    WITH {_SPLIT_SQL.format('documents', 'doc_id')}
    SELECT d.doc_id::VARCHAR AS task_input, coalesce(source, 'none') AS expected_behavior, 'medium' AS difficulty, coalesce(lang, 'general') AS category, 'golden' AS source, split FROM documents d JOIN m ON m.doc_id = d.doc_id
""")
def k1_failed_save(spark, sf_dir):
    """K1: a dataset is saved, replaced, and the same once more by a save in which a task fails: the second version is what is read."""
    folder, rows = fresh_path(spark, "dataset"), _table(spark, sf_dir, "documents").select("doc_id")
    members = splits.split_members(rows, "doc_id").select(F.col("doc_id").cast("string").alias("task_input"), "split")
    whole = _examples(spark, sf_dir).join(members, "task_input")
    datasets.save_dataset(whole.withColumn("difficulty", F.lit("hard")), folder)
    datasets.save_dataset(whole, folder)
    broken = whole.withColumn("category", F.when(F.col("task_input") == "0", F.raise_error(F.lit("a task fails")).cast("string")).otherwise("lost"))
    try:
        datasets.save_dataset(broken, folder)
    except PySparkException as e:
        if "a task fails" not in str(e):
            raise
    return datasets.load_dataset(spark, folder)


@query("""
    WITH n AS (SELECT count(*) AS n FROM documents)
    SELECT s.split, CASE s.split WHEN 'train' THEN greatest(1, n // 2) WHEN 'val' THEN greatest(1, n // 4) ELSE n - greatest(1, n // 2) - greatest(1, n // 4) END AS examples FROM n, (VALUES ('train'), ('val'), ('holdout')) s(split)
""")
def s7_golden(spark, sf_dir):
    """One golden file, split when it is read."""
    path = f"{fresh_path(spark, 'golden')}.jsonl"
    _examples(spark, sf_dir).write.json(path)
    return datasets.load_golden(spark, path).groupBy("split").agg(F.count("*").alias("examples"))


@query(f"""
    WITH e AS (
        SELECT doc_id, to_json({{'task_input': doc_id::VARCHAR, 'expected_behavior': coalesce(source, 'none'), 'difficulty': 'medium', 'category': coalesce(lang, 'general'), 'source': 'golden'}})::VARCHAR AS content FROM documents
    ), {_SPLIT_SQL.format('e', 'content')}
    SELECT doc_id::VARCHAR AS task_input, split FROM e JOIN m ON e.content = m.content
""")
def s7_golden_members(spark, sf_dir):
    """One golden file, split when it is read: which example lies in which split."""
    path = f"{fresh_path(spark, 'golden')}.jsonl"
    _examples(spark, sf_dir).write.json(path)
    return datasets.load_golden(spark, path).select("task_input", "split")


def _skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("---\nname: the "), F.col("item_id").cast("string"), F.lit("\ndescription: d\n---\n\n"), F.col("text"))
    rows = _table(spark, sf_dir, "benchmark").select(F.concat(F.lit("file:/skills/s"), F.col("item_id").cast("string"), F.lit("/SKILL.md")).alias("path"), parse_skill(raw).alias("s"))
    return rows.select("path", "s.*")


@query("""
    SELECT 'folder' AS way, 'file:/skills/s7/SKILL.md' AS path, 'the 7' AS name UNION ALL SELECT 'name', min('file:/skills/s' || item_id || '/SKILL.md'), arg_min('the ' || item_id, 'file:/skills/s' || item_id || '/SKILL.md')
    FROM benchmark WHERE starts_with('the ' || item_id, 'the 1')
""")
def s9_find_skill(spark, sf_dir):
    """By its folder, else by a name that begins as asked: the first path."""
    every = _skills(spark, sf_dir)
    found = [skills.find_skill(every, name).select(F.lit(way).alias("way"), "path", "name") for way, name in (("folder", "s7"), ("name", "the 1"))]
    return found[0].unionByName(found[1])


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0")
def s11_tool_files(spark, sf_dir):
    source = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 3 == 0, "\nregistry.register(X)\n").otherwise("\nregistry.register\n"))
    return source_code.registering(_table(spark, sf_dir, "documents").select("doc_id", source.alias("source"))).select("doc_id")


def _literal(c: str):
    """A text as a Python literal: its JSON string."""
    return F.regexp_replace(F.to_json(F.struct(F.col(c).alias("x"))), "(?s)^\\{\"x\":(.*)\\}\\z", "$1")


def _tool_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit('    "name": "item'), F.col("item_id").cast("string"), F.lit('",\n'))
    more = F.lit(',\n    "parameters": {"properties": {"q": {"type": "integer", "description": "a " "query"}}, "required": ["q"]},\n}\nregistry.register(ONE_SCHEMA)\n')
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("path"), F.concat(F.lit("# tool {\nONE_SCHEMA = {\n"), name, F.lit('    "description": '), _literal("text"), more).alias("source"))


@query("SELECT item_id::VARCHAR AS path, 'item' || item_id AS name, text AS description, 'q' AS param, 'integer' AS kind, true AS required, 'a query' AS about, 'ONE_SCHEMA' AS var FROM benchmark")
def s12_tool_schemas(spark, sf_dir):
    got = source_code.extract_tools(_tool_sources(spark, sf_dir))
    p = F.col("params")[0]
    return got.select(F.col("file_path").alias("path"), "name", "description", p["name"].alias("param"), p["type"].alias("kind"), p["required"].alias("required"), p["description"].alias("about"), F.col("schema_var_name").alias("var"))


@query("SELECT item_id::VARCHAR AS path, 'item' || item_id AS name, reverse(text) AS description FROM benchmark")
def k2_tool_write_back(spark, sf_dir):
    """K2 and F25: descriptions replaced in their sources, and read again."""
    files = _tool_sources(spark, sf_dir).join(_table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("path"), F.reverse("text").alias("new")), "path")
    after = files.select("path", source_code.with_tool_description(F.col("source"), F.concat(F.lit("item"), "path"), F.col("new")).alias("source"))
    return source_code.extract_tools(after).select(F.col("file_path").alias("path"), "name", "description")


def _prompt_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.concat(F.lit('"""Doc."""\nMEMORY_GUIDANCE = '), _literal("text"), F.lit('\nOTHER = "no"\nPLATFORM_HINTS = {\n    "chat": "Be "\n        "short.",\n}\n'))
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("path"), source.alias("source"))


@query("""
    SELECT item_id::VARCHAR AS path, 'memory_guidance' AS section_id, text, length(text) AS chars, 2 AS line FROM benchmark
    UNION ALL SELECT item_id::VARCHAR, 'platform_hints.chat', 'Be short.', 9, 5 FROM benchmark
""")
def s13_sections(spark, sf_dir):
    got = source_code.extract_sections(_prompt_sources(spark, sf_dir))
    return got.select(F.col("source_path").alias("path"), "section_id", "text", F.col("char_count").alias("chars"), F.col("line_range.start").cast("int").alias("line"))


@query("""
    SELECT item_id::VARCHAR AS path, 'memory_guidance' AS section_id, text FROM benchmark UNION ALL SELECT item_id::VARCHAR, 'platform_hints.chat', reverse(text) FROM benchmark
""")
def k3_section_write_back(spark, sf_dir):
    files = _prompt_sources(spark, sf_dir).join(_table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("path"), F.reverse("text").alias("new")), "path")
    after = files.select("path", source_code.with_section(F.col("source"), F.lit("platform_hints.chat"), F.col("new")).alias("source"))
    return source_code.extract_sections(after).select(F.col("source_path").alias("path"), "section_id", "text")


@query("""
    SELECT 'metrics' AS what, 'run1 OK true ' || count(*) AS value FROM labels UNION ALL SELECT 'failed', 'FAILED_run1 FAILED false ' || count(*) FROM labels
    UNION ALL SELECT 'evolved', count(*) || ' ' || sum(length(text)) FROM benchmark
""")
def k4_saved_run(spark, sf_dir):
    """A run's files, read again: metrics of a run that passed and of one that failed, and the evolved texts."""
    folder = fresh_path(spark, "run")
    metrics = scoring.mean_score(_table(spark, sf_dir, "labels").select(F.col("quality").cast("double").alias("score")))
    evolved = _table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("name"), F.col("text").alias("description"))
    good, bad = rendering.save_run(folder, "run1", metrics, evolved), rendering.save_run(folder, "run1", metrics, evolved, failed=True)
    said = F.concat_ws(" ", F.element_at(F.split(F.lit(""), ","), 1), "status", F.col("constraints_passed").cast("string"), F.col("n").cast("string"))
    rows = [
        spark.read.json(f"{path}/metrics").select(F.lit(what).alias("what"), F.concat(F.lit(path.rsplit("/", 1)[1]), said).alias("value")) for what, path in (("metrics", good), ("failed", bad))
    ]
    back = F.from_json("value", "array<struct<name:string,description:string>>")
    texts = spark.read.text(f"{good}/evolved", wholetext=True).select(F.inline(back)).agg(F.count("*").alias("n"), F.sum(F.length("description")).alias("chars"))
    return rows[0].union(rows[1]).union(texts.select(F.lit("evolved").alias("what"), F.concat_ws(" ", F.col("n").cast("string"), F.col("chars").cast("string")).alias("value")))
