"""Run folders as a data source: JSON lines of scores, a file or more for each model in each folder.

Reading takes every model from the first folder, in the order given, that holds it whole, which is decided where its files
are read: a partition is a model with all folders' files. As a stream the folders are followed file by file. Writing stages
each task's files under _staged and moves them into place when all tasks are done, so a write that fails leaves nothing that a
reader sees (a task that is killed late may leave a staged file).

Paths may be anything that pyarrow's file systems open; driver and executors must see the same files.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from quern.session import importable

SCHEMA = "model string, task_id string, level string, overall double, error_type string, folder string"
_FILE = re.compile(r"checkpoint_(?P<model>[^/]*?)\.(?P<part>[0-9]+-[0-9a-f]+)\.jsonl$")


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(folder: str) -> list[tuple[str, str]]:
    """(model, path) of a folder's files, sorted; staged and other files are passed over."""
    system, path = _open(folder)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    named = [(m, f.path) for f in found if f.type == fs.FileType.File and (m := _FILE.search(f.path))]
    return sorted((unquote(m["model"]), p) for m, p in named)


def _rows(folder: str, path: str, strict: bool) -> Iterator[tuple]:
    """A file's scores; blank lines are passed over, and so are lines that aren't records, unless strict."""
    system, _ = _open(folder)
    model = unquote(_FILE.search(path)["model"])
    with system.open_input_stream(path) as f:
        text = f.read().decode("utf-8")
    for number, line in enumerate(text.split("\n"), 1):
        if not line.strip():
            continue
        try:
            r = json.loads(line)
            if not isinstance(r, dict):
                raise ValueError("no record")
        except ValueError as e:
            if strict:
                raise ValueError(f"{path}, line {number}: {e}") from e
            continue
        score = r.get("overall")
        yield model, r.get("task_id"), r.get("level"), None if score is None else float(score), r.get("error_type"), folder


@dataclass
class ModelFiles(InputPartition):
    """One model: its files in each folder that has some, in the folders' order."""

    model: str
    folders: list[tuple[str, list[str]]]


class FirstComplete(DataSourceReader):
    def __init__(self, folders: list[str], least: int, strict: bool):
        self.folders, self.least, self.strict = folders, least, strict

    def partitions(self) -> list[ModelFiles]:
        held: dict[str, dict[str, list[str]]] = {}
        for folder in self.folders:
            for model, path in _files(folder):
                held.setdefault(model, {}).setdefault(folder, []).append(path)
        return [ModelFiles(m, list(by.items())) for m, by in sorted(held.items())]

    def read(self, partition: ModelFiles | None) -> Iterator[tuple]:
        for folder, paths in partition.folders if partition else []:  # None: there are no files
            if self.least and sum(1 for p in paths for _ in _rows(folder, p, self.strict)) < self.least:
                continue
            for p in paths:
                yield from _rows(folder, p, self.strict)
            return


@dataclass
class OneFile(InputPartition):
    folder: str
    path: str


class Following(DataSourceStreamReader):
    """Offsets are, for each folder, how many of its files in sorted order have been read. Names rise with the batch that wrote them."""

    def __init__(self, folders: list[str], strict: bool):
        self.folders, self.strict = folders, strict

    def _listed(self, folder: str) -> list[str]:
        return sorted((p for _, p in _files(folder)), key=lambda p: (_FILE.search(p)["part"], p))

    def initialOffset(self) -> dict:
        return {f: 0 for f in self.folders}

    def latestOffset(self) -> dict:
        return {f: len(self._listed(f)) for f in self.folders}

    def partitions(self, start: dict, end: dict) -> list[OneFile]:
        return [OneFile(f, p) for f in self.folders for p in self._listed(f)[start.get(f, 0) : end.get(f, 0)]]

    def read(self, partition: OneFile | None) -> Iterator[tuple]:
        yield from _rows(partition.folder, partition.path, self.strict) if partition else ()

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Staged(WriterCommitMessage):
    paths: list[str]
    rows: int


class Committed(DataSourceWriter):
    def __init__(self, folder: str, batch: int):
        self.folder, self.batch, self.job = folder, batch, uuid.uuid4().hex  # a folder of its own for each write

    def write(self, rows: Iterator[Row]) -> Staged:
        lines: dict[str, list[str]] = {}
        for r in rows:
            kept = {k: v for k, v in r.asDict().items() if k not in ("model", "folder") and v is not None}
            lines.setdefault(r["model"] or "", []).append(json.dumps(kept, ensure_ascii=False))
        system, base = _open(self.folder)
        system.create_dir(f"{base}/_staged/{self.job}", recursive=True)
        paths, token = [], uuid.uuid4().hex[:12]
        for model, own in sorted(lines.items()):
            path = f"{base}/_staged/{self.job}/checkpoint_{quote(model, safe='')}.{self.batch:09d}-{token}.jsonl"
            with system.open_output_stream(path) as f:
                f.write(("\n".join(own) + "\n").encode("utf-8"))
            paths.append(path)
        return Staged(paths, sum(map(len, lines.values())))

    def commit(self, messages: list[Staged | None]) -> None:
        system, _ = _open(self.folder)
        for m in messages:
            for path in m.paths if m else []:
                system.move(path, path.replace(f"/_staged/{self.job}/", "/"))
        self._clean()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        system, base = _open(self.folder)
        if system.get_file_info(f"{base}/_staged/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/_staged/{self.job}")


class Runs(DataSource):
    """spark.read.format("runs"), readStream and write. Options: folders (a JSON list) or path; least: tasks that make a model
    whole (0: any); strict: malformed lines fail the read instead of being passed over; batch: a number that rises from
    write to write, for streams that follow the folder."""

    @classmethod
    def name(cls) -> str:
        return "runs"

    def schema(self) -> str:
        return SCHEMA

    def _folders(self) -> list[str]:
        return json.loads(self.options["folders"]) if "folders" in self.options else [self.options["path"]]

    def _strict(self) -> bool:
        return self.options.get("strict", "false").lower() == "true"

    def reader(self, schema: StructType) -> FirstComplete:
        return FirstComplete(self._folders(), int(self.options.get("least", "0")), self._strict())

    def streamReader(self, schema: StructType) -> Following:
        return Following(self._folders(), self._strict())

    def writer(self, schema: StructType, overwrite: bool) -> Committed:
        return Committed(self.options["path"], int(self.options.get("batch", "0")))


def register(spark: SparkSession) -> None:
    importable(spark)
    spark.dataSource.register(Runs)
