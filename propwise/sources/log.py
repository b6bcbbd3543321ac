"""Commit log on shared storage.

A log is a folder of numbered JSON entries.  An entry appears whole and only once: it is
written under a name of its own and then given its number, which fails if another writer was first
(a link on a local file system, a rename without overwriting elsewhere).  Every ``every`` entries the state
they fold to is stored, and entries before the stored state before that are deleted, so reading a log of any
length lists and opens a bounded number of files.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def hadoop(spark: SparkSession, path: str):
    """``(file system, path)`` of the JVM for a path of any scheme."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    fs, p = hadoop(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = hadoop(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = hadoop(spark, path)
    found = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(found, "UTF-8")
    finally:
        found.close()


def write_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create ``path`` with ``text``, whole; False if it is there already."""
    fs, p = hadoop(spark, path)
    fs.mkdirs(p.getParent())
    draft = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.draft")
    out = fs.create(draft, False)
    out.write(text.encode("utf-8"))
    out.close()
    if fs.getScheme() == "file":
        a, b = (fs.makeQualified(x).toUri().getPath() for x in (draft, p))
        try:
            os.link(a, b)
            return True
        except FileExistsError:
            return False
        finally:
            fs.delete(draft, False)
    done = not fs.exists(p) and fs.rename(draft, p)
    if not done:
        fs.delete(draft, False)
    return done


class CommitLog:
    """Entries folded into one small state; ``fold(state, entry)`` changes the state in place."""

    def __init__(self, spark: SparkSession, root: str, fold: Callable[[dict, dict], None], every: int = 50):
        self.spark, self.root, self.fold, self.every = spark, root, fold, every

    def _path(self, version: int, kind: str) -> str:
        return os.path.join(self.root, f"{version:020d}.{kind}")

    def load(self) -> tuple[int, dict]:
        """Number of the last entry (0: none) and the state behind it."""
        for _ in range(20):
            found = [n.split(".") for n in names(self.spark, self.root) if n.endswith((".entry", ".state"))]
            stored = max([int(v) for v, kind in found if kind == "state"], default=0)
            later = sorted(int(v) for v, kind in found if kind == "entry" and int(v) > stored)
            try:
                state = json.loads(read_text(self.spark, self._path(stored, "state"))) if stored else {}
                for v in later:
                    self.fold(state, json.loads(read_text(self.spark, self._path(v, "entry"))))
                return (later or [stored])[-1], state
            except Exception:  # a file went while it was read: compacted meanwhile, look again
                if all(exists(self.spark, self._path(int(v), kind)) for v, kind in found):
                    raise
        raise RuntimeError(f"{self.root}: the log changes faster than it can be read")

    def append(self, entry: dict, wanted: Callable[[dict], bool] = lambda state: True) -> tuple[int, dict] | None:
        """Append ``entry`` if the state then is ``wanted``; its number and the state behind it."""
        while True:
            version, state = self.load()
            if not wanted(state):
                return None
            if write_once(self.spark, self._path(version + 1, "entry"), json.dumps(entry, sort_keys=True)):
                self.fold(state, entry)
                if (version + 1) % self.every == 0:
                    self._compact(version + 1, state)
                return version + 1, state

    def _compact(self, version: int, state: dict) -> None:
        write_once(self.spark, self._path(version, "state"), json.dumps(state, sort_keys=True))
        for n in names(self.spark, self.root):  # the state before stays for readers on their way
            if n.split(".")[0].isdigit() and int(n.split(".")[0]) < version - self.every:
                delete(self.spark, os.path.join(self.root, n))
