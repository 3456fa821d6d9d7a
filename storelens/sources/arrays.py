"""A sink that writes JSON documents as one indented array in one dated file.

Each task writes its rows, already indented, to a part file of its own; the parts of the committed tasks, in the order of their
partitions, become one file, which appears under its name only when it is whole. Attempts that failed or came second leave
no trace in it, and an aborted job leaves no file. So a frame that is ordered gives an ordered array.

Files go through pyarrow's file systems: a path without a scheme is local (or mounted), others are what pyarrow knows. The
parts are joined in blocks by the process that commits, as one file can only have one writer; for tables that are not
the result of one query use JSON lines.

Texts are escaped as the behaviour to match does: ``<``, ``>``, ``&`` and the separators U+2028 and U+2029 by number. No row at
all is ``null``, as an empty list is there. The file ends without a line end; its mode is 0644 where the system has modes.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass
from datetime import datetime, timezone

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Characters that are written by number inside texts.
ESCAPED = {ord(c): f"\\u{ord(c):04x}" for c in "<>&\u2028\u2029"}
BLOCK = 4 << 20


def indented(document: str) -> str:
    """A document as an element of an indented array. Markup characters stand in texts only, so the whole is escaped."""
    text = json.dumps(json.loads(document), indent=2, ensure_ascii=False).translate(ESCAPED)
    return "\n".join("  " + line for line in text.split("\n"))


@dataclass
class Part(WriterCommitMessage):
    partition: int
    path: str
    rows: int


class Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        day = options.get("day") or datetime.now(timezone.utc).strftime("%Y-%m-%d")
        if not options.get("path") or not options.get("name"):
            raise ValueError("path and name are required")
        self.folder, self.file = options["path"].rstrip("/"), f"{options['name']}_{day}.json"
        self.parts, self.overwrite = f"_parts_{uuid.uuid4().hex}", overwrite
        system, folder = self._system()
        if not overwrite and system.get_file_info(f"{folder}/{self.file}").type != fs.FileType.NotFound:
            raise ValueError(f"{self.file} is there already")

    def _system(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(self.folder))

    def write(self, iterator: Iterator) -> Part:
        system, folder = self._system()
        task = TaskContext.get()
        system.create_dir(f"{folder}/{self.parts}", recursive=True)
        path, rows = f"{folder}/{self.parts}/{task.partitionId():08d}-{task.taskAttemptId()}", 0
        with system.open_output_stream(path) as out:
            for row in iterator:
                out.write((",\n" if rows else "").encode() + indented(row[0]).encode())
                rows += 1
        return Part(task.partitionId(), path, rows)

    def commit(self, messages: list) -> None:
        system, folder = self._system()
        system.create_dir(f"{folder}/{self.parts}", recursive=True)
        whole, some = f"{folder}/{self.parts}/whole", sorted((m for m in messages if m and m.rows), key=lambda m: m.partition)
        with system.open_output_stream(whole) as out:
            out.write(b"[\n" if some else b"null")
            for k, part in enumerate(some):
                out.write(b",\n" if k else b"")
                with system.open_input_stream(part.path) as held:
                    while block := held.read(BLOCK):
                        out.write(block)
            out.write(b"\n]" if some else b"")
        system.move(whole, f"{folder}/{self.file}")
        if isinstance(system, fs.LocalFileSystem):
            os.chmod(f"{folder}/{self.file}", 0o644)
        system.delete_dir(f"{folder}/{self.parts}")

    def abort(self, messages: list) -> None:
        system, folder = self._system()
        with suppress(OSError):
            system.delete_dir(f"{folder}/{self.parts}")


class JsonArray(DataSource):
    """Options: ``path`` (folder), ``name``, ``day``."""

    @classmethod
    def name(cls) -> str:
        return "storelens_json_array"

    def schema(self) -> str:
        return "json string"

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)
