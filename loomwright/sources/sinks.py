"""A sink of one JSON file for each row, written by tasks and put in place at commit."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Staged(WriterCommitMessage):
    """What a task wrote: a folder of its own, and how many files."""

    folder: str
    files: int


class JsonFiles(DataSource):
    """Format `json_files`: rows (name, body) as `<path>/<name>.json`, indented. Options: path (a folder that tasks and driver share), prefix of the names.

    Each attempt of a task writes to a folder of its own under `<path>/_staging-...`, so that a lost or repeated attempt leaves
    nothing. At commit the driver looks at names only: one that two rows have, and a file of the prefix that isn't written now,
    are errors, and nothing is put in place then; else each file replaces its like at once. Abort removes what was staged.
    """

    @classmethod
    def name(cls) -> str:
        return "json_files"

    def schema(self) -> str:
        return "name string, body string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return JsonFilesWriter(self.options["path"], self.options.get("prefix", ""))


class JsonFilesWriter(DataSourceWriter):
    def __init__(self, path: str, prefix: str):
        self.path, self.prefix = path, prefix
        self.staging = os.path.join(path, f"_staging-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator) -> Staged:
        task = TaskContext.get()
        folder = os.path.join(self.staging, f"{task.partitionId()}-{task.taskAttemptId()}")
        os.makedirs(folder, exist_ok=True)
        files = 0
        for row in iterator:
            if not row["name"] or os.path.basename(row["name"]) != row["name"] or not row["name"].startswith(self.prefix):
                raise ValueError(f"no name of a file: {row['name']!r}")
            with open(os.path.join(folder, f"{row['name']}.json"), "x", encoding="utf-8") as f:  # of two rows of one name the second fails
                json.dump(json.loads(row["body"]), f, ensure_ascii=False, indent=2)
                f.write("\n")
                f.flush()
                os.fsync(f.fileno())
            files += 1
        return Staged(folder, files)

    def commit(self, messages: list[Staged]) -> None:
        try:
            staged: dict[str, str] = {}
            for m in messages:
                names = os.listdir(m.folder) if m is not None and m.files else []
                if m is not None and len(names) != m.files:
                    raise ValueError(f"files are gone from {m.folder}")
                for name in names:
                    if name in staged:
                        raise ValueError(f"repeated: {name}")
                    staged[name] = m.folder
            stale = sorted(n for n in os.listdir(self.path) if n.startswith(self.prefix) and n.endswith(".json") and n not in staged)
            if stale:
                raise ValueError(f"stale files: {stale[:3]}")
            for name, folder in staged.items():
                os.replace(os.path.join(folder, name), os.path.join(self.path, name))
        finally:
            shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[Staged]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)
