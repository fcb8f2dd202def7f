"""Datasets that are replaced as a whole: staged versions, a log of commits, one switch.

A version is written beside the ones that are there. The switch is a small file in `_commits`, numbered on from the last one and
moved into place complete; readers follow the highest number, so they see the old version or the new one and never a mix. A
write that fails before its switch takes its version away and changes nothing. Of two writers at the same time both commit,
one after the other.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: Versions that stay after a switch: the new one, and the one that readers may still have open.
KEPT = 2

_LOG = "_commits"


def _hadoop(spark: SparkSession, path: str):
    """The path, its file system and its file context."""
    where, conf = spark._jvm.org.apache.hadoop.fs.Path(path), spark._jsc.hadoopConfiguration()
    fs = where.getFileSystem(conf)
    return where, fs, spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(where).toUri(), conf)


def _log(spark: SparkSession, folder: str) -> list[str]:
    """Names of the commits, oldest first."""
    where, fs, _ = _hadoop(spark, f"{folder}/{_LOG}/*.json")
    return sorted(x.getPath().getName() for x in fs.globStatus(where) or [])


def _version(spark: SparkSession, folder: str, commit: str) -> str:
    return json.loads(spark.read.text(f"{folder}/{_LOG}/{commit}", wholetext=True).first()[0])["version"]


def current(spark: SparkSession, folder: str) -> str:
    """Where the committed version lies; the folder itself if nothing has been committed there."""
    log = _log(spark, folder)
    return f"{folder}/{_version(spark, folder, log[-1])}" if log else folder


def _switch(spark: SparkSession, folder: str, version: str) -> None:
    temp, fs, context = _hadoop(spark, f"{folder}/{_LOG}/.{version}")
    out = fs.create(temp, False)
    out.write(bytearray(json.dumps({"version": version}).encode()))
    out.close()
    no_options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    while True:
        log = _log(spark, folder)
        number = int(log[-1].removesuffix(".json")) + 1 if log else 1
        try:
            context.rename(temp, spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{_LOG}/{number:020d}.json"), no_options)
            return
        except Py4JJavaError as e:  # another writer has this number
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                fs.delete(temp, False)
                raise


def _forget(spark: SparkSession, folder: str) -> None:
    """Deletes versions that KEPT later ones have replaced."""
    log = _log(spark, folder)
    stay = {_version(spark, folder, x) for x in log[-KEPT:]}
    for commit in log[:-KEPT]:
        version = _version(spark, folder, commit)
        for name in [version] * (version not in stay) + [f"{_LOG}/{commit}"]:
            where, fs, _ = _hadoop(spark, f"{folder}/{name}")
            fs.delete(where, True)


@contextmanager
def replacing(spark: SparkSession, folder: str) -> Iterator[str]:
    """A path for a new version of the folder's data, which takes the old one's place when the block ends without an error."""
    version = f"version-{uuid.uuid4().hex}"
    where, fs, _ = _hadoop(spark, f"{folder}/{version}")
    try:
        yield f"{folder}/{version}"
        fs.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{_LOG}"))
        _switch(spark, folder, version)
    except BaseException:
        fs.delete(where, True)
        raise
    _forget(spark, folder)


@contextmanager
def publishing(spark: SparkSession, folder: str) -> Iterator[str]:
    """A path for the whole folder, which is renamed to it when the block ends without an error.

    A folder that is there already is moved aside first, and moved back if the rename fails; until then it stays as it was.
    """
    where, fs, _ = _hadoop(spark, folder)
    staged, aside = (spark._jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{kind}-{uuid.uuid4().hex}") for kind in ("staged", "aside"))
    try:
        yield staged.toString()
        there = fs.exists(where)
        if there and not fs.rename(where, aside):
            raise OSError(f"{folder} cannot be replaced")
        if not fs.rename(staged, where):
            if there:
                fs.rename(aside, where)
            raise OSError(f"{folder} cannot be written")
    except BaseException:
        fs.delete(staged, True)
        raise
    fs.delete(aside, True)
