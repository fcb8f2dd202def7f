"""Session logs as tables of messages (schemas.MESSAGE): history lines, event streams, session files.

Logs are read by Spark's readers only, so they may lie in any store that Spark reaches. Order inside a file matters for
pairing and Spark numbers no lines, so event and session files are read whole and exploded with their line's position. Each file
is opened once: the texts are written as one table, which parsing goes over several times. With a
limit, files are listed first and read in order, some at a time, until there are enough messages; the rest are never opened.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import contains_secret, is_blank, long_enough
from skein.operators.ordering import with_ordinals
from skein.operators.pairing import pair_first_response, segments
from skein.schemas import MESSAGE
from skein.shared import discard, written


def missing(spark: SparkSession, path: str) -> bool:
    """True if nothing is there, in whatever store."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    return found is None or len(found) == 0


_LISTERS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def few_listers(spark: SparkSession) -> Iterator[None]:
    """Files are looked up by a few tasks a core inside, not by a task for each of up to 10,000 files; a smaller setting stays."""
    before, most = spark.conf.get(_LISTERS), 4 * spark.sparkContext.defaultParallelism
    spark.conf.set(_LISTERS, str(min(int(before), most)))
    try:
        yield
    finally:
        spark.conf.set(_LISTERS, before)


def if_any(read: Callable[[], DataFrame]) -> DataFrame | None:
    """What read() gives, None if nothing is at its path: the reader finds that out itself, so that a pattern of many folders is
    gone over once."""
    try:
        with few_listers(SparkSession.active()):
            return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def no_messages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], MESSAGE)


def as_messages(df: DataFrame) -> DataFrame:
    """The columns of MESSAGE in order, null where df has none."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in MESSAGE])


def _field(raw: Column, path: str) -> Column:
    """A string at a JSON path as text; null for other kinds of value."""
    kind = F.schema_of_variant(F.variant_get(F.try_parse_json(raw), path, "variant"))
    return F.when(kind == "STRING", F.try_variant_get(F.try_parse_json(raw), path, "string"))


def _is_object(raw: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(raw)).startswith("OBJECT"), F.lit(False))


#: Most files that are read at a time under a limit: their names pass through the driver.
MOST_FILES = 10_000


def listed(spark: SparkSession, pattern: str) -> DataFrame:
    """file (a URI), mtime of the files at a pattern. They are listed, not opened."""
    files = spark.read.format("binaryFile").load(pattern)
    return files.select(F.col("path").alias("file"), F.col("modificationTime").alias("mtime"))


def whole_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, mtime, value of files or patterns, each file's text in one row."""
    texts = spark.read.text(paths, wholetext=True)
    return texts.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("mtime"), "value")


def read_until(spark: SparkSession, pattern: str, parse: Callable[[DataFrame], DataFrame], limit: int, *order: str, first: int | None = None) -> DataFrame:
    """Messages (parse of whole_files) of the files at a pattern, file by file in the order of `order` (columns of listed(), `-`
    before those that fall), from as many files as hold `limit` messages or a few more.

    `first` files (one for each core unless given) are read, then as many as should hold what is missing by the messages a
    file so far, at most twice as many as before. Each lot is read once and written, and only counts and a lot's file names
    come to the driver.
    """
    there = if_any(lambda: listed(spark, pattern))
    if there is None:
        return parse(spark.createDataFrame([], "file string, mtime timestamp, value string"))
    files = with_ordinals(there, *order)
    n, done, found, parts = files.count(), 0, 0, []
    size = first or spark.sparkContext.defaultParallelism
    while not parts or (found < limit and done < n):
        lot = files.where((F.col("ord") >= done) & (F.col("ord") < done + size))
        paths = [re.sub(r"([\\[\]{}*?])", r"\\\1", r.file) for r in lot.select("file").collect()]
        with few_listers(spark):
            texts = whole_files(spark, paths)
        texts = written(texts, "files")
        parts.append(written(parse(texts), "messages"))
        discard(texts)
        done, found = done + size, found + parts[-1].count()
        hoped = -(-(limit - found) * done // found) if found else 2 * done
        size = max(1, min(hoped, 2 * done, MOST_FILES))
    return functools.reduce(DataFrame.unionByName, parts)


def read_history(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """Messages of a JSON-lines history: display, timestamp, project, sessionId.

    Blank and malformed lines, texts under 10 characters and texts with secrets are skipped; missing fields are `` or 0.
    limit counts what is left (0: all); each task stops reading its part of the file when it has so many. A missing file gives
    no messages.
    """
    if missing(spark, path):
        return no_messages(spark)
    out = parse_history(spark.read.text(path))
    return out.limit(limit) if limit else out


def parse_history(lines: DataFrame) -> DataFrame:
    """Messages of a table of history lines (column value)."""
    raw = F.col("value")
    out = lines.where(~is_blank(raw)).where(_is_object(raw)).select(
        F.lit("history").alias("source"), _field(raw, "$.display").alias("task_input"), F.coalesce(_field(raw, "$.project"), F.lit("")).alias("project"),
        F.coalesce(_field(raw, "$.sessionId"), F.lit("")).alias("session_id"), F.coalesce(F.try_variant_get(F.try_parse_json(raw), "$.timestamp", "long"), F.lit(0)).alias("timestamp"),
    ).where(long_enough(F.col("task_input"))).where(~contains_secret(F.col("task_input")))
    return as_messages(out)


def read_workspaces(spark: SparkSession, folder: str) -> DataFrame:
    """session_id, project: what follows `cwd:` in the first such line of each session's workspace.yaml, `` if there is none."""
    found = if_any(lambda: whole_files(spark, [f"{folder}/*/workspace.yaml"]))
    return no_projects(spark) if found is None else parse_workspaces(_by_folder(found))


def _by_folder(files: DataFrame) -> DataFrame:
    return files.select(_parent(F.col("file")).alias("session_id"), "value")


def parse_workspaces(files: DataFrame) -> DataFrame:
    """session_id, project of workspace files (session_id, value)."""
    return files.select("session_id", F.trim(F.regexp_extract("value", "(?m)^cwd:([^\\n]*)$", 1)).alias("project"))


def _parent(path: Column) -> Column:
    return F.url_decode(F.regexp_extract(path, "([^/]*)/[^/]*$", 1))


def read_events(spark: SparkSession, folder: str, limit: int = 0, name: str = "events.jsonl") -> DataFrame:
    """Messages of event streams, one file of that name a session folder, with all of the assistant's answers.

    Lines that are no JSON are skipped; a file ends at its first event that cannot be used, and keeps the messages before it
    (see parse_events). The project comes from the session's workspace. Order in the file is kept, messages come by session
    and place. limit (0: all) cuts the whole; files are read in order until there are so many messages.
    """
    path = f"{folder}/*/{name}"
    spaces = read_workspaces(spark, folder)
    if not limit:
        found = if_any(lambda: whole_files(spark, [path]))
        return no_messages(spark) if found is None else as_messages(parse_events(_by_folder(written(found, "files")), spaces))
    some = read_until(spark, path, lambda files: parse_events(_by_folder(files), no_projects(spark)).drop("project"), limit, "file")
    return limited(with_projects(some.orderBy("session_id", "turn").limit(limit), spaces), limit, "session_id", "turn")


def no_projects(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "session_id string, project string")


def _content_kind(raw: Column) -> Column:
    """What an event's content is: empty (missing, null, false, 0, an empty text, list or object), text, list or other."""
    value = F.try_parse_json(raw)
    kind = F.schema_of_variant(F.variant_get(value, "$.data.content", "variant"))
    as_text, as_number = F.try_variant_get(value, "$.data.content", "string"), F.try_variant_get(value, "$.data.content", "double")
    empty = kind.isNull() | (kind == "VOID") | ((kind == "STRING") & (as_text == "")) | ((kind != "STRING") & (as_text.isin("false", "[]", "{}") | (as_number == 0)))
    return F.when(F.coalesce(empty, F.lit(False)), "empty").when(kind == "STRING", "text").when(kind.startswith("ARRAY"), "list").otherwise("other")


def parse_events(files: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Messages of event files (session_id, value) with the sessions' projects, and each one's place in its file (turn).

    A message is saved where the next user event stands, or at the file's end. The first of the following ends its file, and
    the message that is open then is not saved:

    * a line that is JSON but no object;
    * a user or assistant event whose data is no object (a user event saves the message before it first);
    * to a message that is not empty, an answer that is no text after another one, or any answer after one that is neither text nor list;
    * the saving of an answered message that is no text, or whose first answer is no text while the message holds no secret.

    Empty contents are as good as none. Lines that are no JSON are skipped, and so are events of other types.
    """
    lines = files.select("session_id", F.posexplode(F.split("value", "\\r\\n?|\\n")).alias("turn", "line"))
    raw = F.col("line")
    kind, data = _field(raw, "$.type"), F.schema_of_variant(F.variant_get(F.try_parse_json(raw), "$.data", "variant"))
    role = F.when(~_is_object(raw), "broken").when(kind == "user.message", "user").when(kind == "assistant.message", "assistant")
    turns = lines.where(~is_blank(raw) & F.try_parse_json(raw).isNotNull()).select(
        "session_id", "turn", role.alias("role"), F.coalesce(~data.startswith("OBJECT"), F.lit(False)).alias("unusable"),
        _content_kind(raw).alias("kind"), F.coalesce(_field(raw, "$.data.content"), F.lit("")).alias("text"),
    ).where("role IS NOT NULL")
    return with_projects(_saved_pairs(turns), workspaces).select(F.lit("events").alias("source"), "*")


def _saved_pairs(turns: DataFrame) -> DataFrame:
    """session_id, turn, task_input, assistant_response of the messages that are saved before their file ends.

    Places are twice the turn, so that a user event saves (2 turn) before it fails (2 turn + 1). The smallest failing place of
    each file is joined back as its cut; files without one are not shuffled for it beyond their pairs.
    """
    user = F.col("role") == "user"
    here = segments(turns, "session_id")
    failed = (F.col("role") == "broken") | F.col("unusable")
    at_once = here.where(failed).select("session_id", (2 * F.col("turn") + user.cast("int")).alias("place"))
    # A user event also ends the segment before its own.
    each = here.where("role <> 'broken'").select("*", F.explode(F.when(user, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("back"))
    own = F.col("back") == 0
    said = F.when(own & (F.col("role") == "assistant") & (F.col("kind") != "empty"), F.struct("turn", "kind", "text"))
    parts = each.groupBy("session_id", (F.col("seg") - F.col("back")).alias("seg")).agg(
        F.max(F.when(own & user, F.struct("turn", "kind", "text"))).alias("q"), F.sort_array(F.collect_list(said)).alias("a"), F.min(F.when(~own, F.col("turn"))).alias("next"),
    ).where("q IS NOT NULL AND q.kind <> 'empty' AND size(a) > 0")
    first, save, secret = F.get("a", F.lit(0)), 2 * F.col("next"), contains_secret(F.col("q.text"))
    late = F.filter(F.slice("a", 2, F.size("a")), lambda x: (x["kind"] != "text") | (first["kind"] == "other"))
    unsaved = (F.col("q.kind") != "text") | (~secret & (first["kind"] != "text"))
    later = parts.select("session_id", F.least(2 * F.get(late, F.lit(0))["turn"], F.when(unsaved, save)).alias("place")).where("place IS NOT NULL")
    cut = at_once.unionByName(later).groupBy("session_id").agg(F.min("place").alias("cut"))
    pairs = parts.where(~unsaved).select("session_id", F.col("q.turn").alias("turn"), F.col("q.text").alias("task_input"), F.array_join(F.transform("a", lambda x: x["text"]), "\n").alias("assistant_response"), save.alias("save"))
    kept = pairs.where(~contains_secret(F.col("task_input")) & ~contains_secret(F.col("assistant_response"))).join(cut, "session_id", "left")
    return kept.where("cut IS NULL OR save < cut").drop("save", "cut")


def with_projects(sessions: DataFrame, workspaces: DataFrame) -> DataFrame:
    """sessions with their workspace's project, `` where there is none."""
    return sessions.join(workspaces, "session_id", "left").withColumn("project", F.coalesce("project", F.lit("")))


def limited(messages: DataFrame, limit: int, *order: str | Column) -> DataFrame:
    """Messages (schemas.MESSAGE), the first `limit` in order (0: all)."""
    return as_messages(messages.orderBy(*order).limit(limit) if limit else messages)


def read_sessions(spark: SparkSession, folder: str, limit: int = 0, name: str = "*.json") -> DataFrame:
    """Messages of session files (session_id, messages), newest file first, each with the assistant's first answer.

    Malformed files and those without messages are skipped; a missing session_id is the file's name. A content that is no
    string counts as empty. limit (0: all) cuts the whole in order; files are read newest first until there are so many messages.
    """
    path = f"{folder}/{name}"
    if not limit:
        found = if_any(lambda: whole_files(spark, [path]))
        return no_messages(spark) if found is None else as_messages(parse_sessions(written(found, "files")))
    return limited(read_until(spark, path, parse_sessions, limit, "-mtime", "file"), limit, F.desc("mtime"), "file", "turn")


def parse_sessions(files: DataFrame) -> DataFrame:
    """Messages of session files (file: a path, mtime, value), with file, mtime and each one's place (turn)."""
    raw = F.col("value")
    files = files.where(_is_object(raw)).select(
        F.coalesce(_field(raw, "$.session_id"), F.url_decode(F.regexp_extract("file", "([^/]*)\\.json$", 1))).alias("session_id"),
        "file", "mtime", F.try_variant_get(F.try_parse_json(raw), "$.messages", "array<variant>").alias("messages"),
    )
    each = files.select("session_id", "file", "mtime", F.posexplode("messages").alias("turn", "m"))

    def text(name: str) -> Column:
        part = F.to_json(F.struct(F.col("m").alias("m")))
        return _field(part, f"$.m.{name}")

    turns = each.select("file", "turn", text("role").alias("role"), F.coalesce(text("content"), F.lit("")).alias("text"))
    pairs = pair_first_response(turns, "file").join(files.select("file", "session_id", "mtime"), "file")
    return pairs.select(F.lit("sessions").alias("source"), "*")


READERS: dict[str, Callable[..., DataFrame]] = {"history": read_history, "events": read_events, "sessions": read_sessions}


def read_sources(spark: SparkSession, paths: dict[str, str], sources: list[str]) -> DataFrame:
    """Messages of the named sources together; unknown names, and names without a path, are left out."""
    return combined(spark, {name: lambda name=name: READERS[name](spark, path) for name, path in paths.items() if name in READERS}, sources)


def combined(spark: SparkSession, readers: dict[str, Callable[[], DataFrame]], sources: list[str]) -> DataFrame:
    """Messages of the named readers together, in the names' order; names without a reader are left out."""
    out = no_messages(spark)
    for name in sources:
        if name in readers:
            out = out.unionByName(as_messages(readers[name]()))
    return out
