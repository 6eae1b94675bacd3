"""A log of commits: numbered files, each created whole and never over another one.

Local files and file systems whose rename is one exclusive step (HDFS and the like) keep that promise; an object store needs a connector that does.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

DIGITS = 15
LINKED = ("file",)  # where a rename isn't exclusive, a link is


class CommitLog:
    """Entries ``<number>.json`` in one folder. The number orders them whoever writes: it is taken by creating the file, which only one
    writer can do, and a writer that comes second takes the next number. Readers see whole entries only."""

    def __init__(self, spark: SparkSession, folder: str):
        self.gateway = spark.sparkContext._gateway
        self.jvm = self.gateway.jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.folder = self.jvm.org.apache.hadoop.fs.Path(folder)
        self.files = self.folder.getFileSystem(self.conf)
        self.folder = self.files.makeQualified(self.folder)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.folder, name)

    def numbers(self) -> list[int]:
        if not self.files.exists(self.folder):
            return []
        names = [s.getPath().getName() for s in self.files.listStatus(self.folder)]
        return sorted(int(n[:DIGITS]) for n in names if n.endswith(".json") and n[:DIGITS].isdigit())

    def read(self, number: int) -> dict:
        stream = self.files.open(self._path(f"{number:0{DIGITS}d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def newest_first(self) -> Iterator[tuple[int, dict]]:
        for number in reversed(self.numbers()):
            yield number, self.read(number)

    def add(self, entry: dict) -> int:
        """Writes the entry under the next free number and returns it."""
        self.files.mkdirs(self.folder)
        draft = self._path(f".draft-{uuid.uuid4().hex}")
        out = self.files.create(draft, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        try:
            number = (self.numbers() or [0])[-1] + 1
            while not self._take(draft, self._path(f"{number:0{DIGITS}d}.json")):
                number += 1
            return number
        finally:
            self.files.delete(draft, False)

    def _take(self, draft, target) -> bool:
        """Gives the draft its final name unless there is such a file already; one step of the file system."""
        if self.folder.toUri().getScheme() in LINKED:
            try:
                os.link(draft.toUri().getPath(), target.toUri().getPath())
                return True
            except FileExistsError:
                return False
        rename = getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename")
        options = self.gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.folder.toUri(), self.conf).rename(draft, target, options)
            return True
        except Py4JJavaError as problem:
            if problem.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            return False
