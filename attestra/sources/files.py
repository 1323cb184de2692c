"""Files as a data source (SRC9) and artifacts as a sink (SNK6, SNK7), for folders that driver and executors share.

``spark.read.format("document_files")`` lists the files one folder below a root, drops those that a
filter on their folder, name, key or stem excludes before any is opened, and packs the rest into
partitions of near equal bytes. ``df.write.format("document_artifacts")`` writes below a staging
folder; only when all tasks have ended are the files moved into place, so that a failed job or a
lost executor leaves none. ``tables.write_artifacts`` lets tasks move them, a bucket each; a plain
``save`` leaves it to the driver.
"""

from __future__ import annotations

import fnmatch
import heapq
import os
import shutil
import time
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

FILE_COLUMNS = "path string, guarantee_id string, file_key string, stem string, modificationTime timestamp, length long"
ARTIFACT_COLUMNS = {"ocr_json": "ocr.json", "ocr_md": "ocr.md", "extraction_json": "extraction.json", "meta_json": "meta.json", "content": "source.pdf"}
BATCH_BYTES = 16 << 20
STAGING = ".staging"
BUCKETS = 64  # folders of documents by their name
COMMITTED = "committed"


def local_path(root: str) -> str:
    """A path of this machine's file tree; other stores have no folders that this source could list."""
    root = root.removeprefix("file://") if root.startswith("file://") else root.removeprefix("file:")
    if "://" in root:
        raise ValueError(f"{root}: only folders that driver and executors share can be read as files")
    return root


def _key_and_stem(name: str) -> tuple[str, str]:
    """SRC14."""
    stem = os.path.splitext(name)[0]
    return (stem.rpartition("_")[0] if "_" in stem else stem), stem


@dataclass
class Files(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]):
        self.paths = paths


def packed(sizes: list[int], parts: int) -> list[list[int]]:
    """Places of some sizes in at most ``parts`` partitions: the largest first, each to the one with the fewest bytes so far."""
    heap = [(0, i) for i in range(min(parts, len(sizes)))]
    out: list[list[int]] = [[] for _ in heap]
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        total, part = heap[0]
        out[part].append(i)
        heapq.heapreplace(heap, (total + sizes[i], part))
    return out


class FileReader(DataSourceReader):
    """Filters on a file's names are done while listing; others are left to Spark."""

    TESTS = {EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, StringStartsWith: lambda x, v: x.startswith(v), StringEndsWith: lambda x, v: x.endswith(v), StringContains: lambda x, v: v in x}
    NAMES = ("path", "guarantee_id", "file_key", "stem")

    def __init__(self, options: dict[str, str], schema: StructType):
        self.root, self.pattern = local_path(options["path"]), options.get("pattern", "*")
        self.parts, self.content = int(options.get("parts", 64)), "content" in schema.names
        self.kept: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, IsNotNull) and f.attribute[0] in self.NAMES:
                continue
            if type(f) in self.TESTS and f.attribute[0] in self.NAMES and f.value is not None:
                self.kept.append((f.attribute[0], type(f), set(f.value) if isinstance(f, In) else f.value))
            else:
                yield f

    def _folders(self) -> Iterator[str]:
        """Folders below the root; where a filter names them, no other is looked at."""
        named = [v if kind is In else {v} for column, kind, v in self.kept if column == "guarantee_id" and kind in (EqualTo, In)]
        if named:
            yield from (x for x in sorted(set.intersection(*map(set, named))) if x not in ("", ".", "..") and "/" not in x and os.path.isdir(os.path.join(self.root, x)))
        else:
            with os.scandir(self.root) as found:
                yield from sorted(x.name for x in found if x.is_dir() and not x.name.startswith("."))

    def _listed(self) -> Iterator[tuple[str, int]]:
        for top in self._folders():
            for folder, below, names in os.walk(os.path.join(self.root, top)):
                below.sort()
                for name in sorted(names):
                    path = os.path.join(folder, name)
                    key, stem = _key_and_stem(name)
                    own = {"path": path, "guarantee_id": os.path.basename(folder), "file_key": key, "stem": stem}
                    if fnmatch.fnmatchcase(name, self.pattern) and all(self.TESTS[kind](own[column], v) for column, kind, v in self.kept if column in own):
                        yield path, os.path.getsize(path)

    def partitions(self) -> list[Files]:
        found = list(self._listed())
        return [Files([found[i][0] for i in sorted(part)]) for part in packed([size for _, size in found], self.parts)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for path in partition.paths:
            seen = os.stat(path)
            key, stem = _key_and_stem(os.path.basename(path))
            row = {"path": path, "guarantee_id": os.path.basename(os.path.dirname(path)), "file_key": key, "stem": stem, "modificationTime": int(seen.st_mtime * 1_000_000), "length": seen.st_size}
            if self.content:
                with open(path, "rb") as f:
                    row["content"] = f.read()
                held += len(row["content"])
            rows.append(row)
            if held >= BATCH_BYTES or len(rows) == 10_000:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = [("path", pa.string()), ("guarantee_id", pa.string()), ("file_key", pa.string()), ("stem", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64()), *([("content", pa.binary())] if self.content else [])]
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kind) for n, kind in kinds], names=[n for n, _ in kinds])


class DocumentFiles(DataSource):
    """Options: ``path``, ``pattern`` (of the file name), ``parts`` (most partitions), ``content`` (``false``: names only)."""

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return FILE_COLUMNS + ("" if self.options.get("content", "true").lower() == "false" else ", content binary")

    def reader(self, schema: StructType) -> FileReader:
        return FileReader(dict(self.options), schema)


def committed(staging: str) -> list[str]:
    """Names of the staged folders of the attempts that count, in the order of their partitions."""
    with open(os.path.join(staging, COMMITTED), encoding="utf-8") as f:
        return f.read().split()


def move_bucket(staging: str, root: str, attempts: list[str], bucket: int) -> None:
    """Moves the staged files of one bucket into place; of a file that several partitions wrote the last one's stays. May be done again."""
    for attempt in attempts:
        base = os.path.join(staging, attempt, str(bucket))
        for top in sorted(os.listdir(base)) if os.path.isdir(base) else ():
            os.makedirs(os.path.join(root, top), exist_ok=True)
            for stem in os.listdir(os.path.join(base, top)):
                source, final = os.path.join(base, top, stem), os.path.join(root, top, stem)
                try:
                    os.rename(source, final)  # a document that wasn't there goes as a folder
                except OSError:
                    for name in os.listdir(source) if os.path.isdir(source) else ():
                        os.replace(os.path.join(source, name), os.path.join(final, name))


def clear(staging: str) -> None:
    for _ in range(5):  # a task that is being stopped may still write
        shutil.rmtree(staging, ignore_errors=True)
        if not os.path.exists(staging):
            break
        time.sleep(0.2)


@dataclass
class Staged(WriterCommitMessage):
    attempt: str


class ArtifactWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.root, self.overwrite = local_path(options["path"]), overwrite
        self.moves = "staging" not in options  # else whoever named the folder moves the files
        self.staging = os.path.join(self.root, STAGING, options.get("staging") or uuid.uuid4().hex)
        if missing := {"guarantee_id", "stem"} - set(schema.names):
            raise ValueError(f"columns {', '.join(sorted(missing))} are needed")
        self.columns = {c: f for c, f in ARTIFACT_COLUMNS.items() if c in schema.names}
        os.makedirs(self.staging)  # by the driver: a task of an aborted job finds none

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        attempt = uuid.uuid4().hex
        base = os.path.join(self.staging, attempt)  # of this attempt alone
        os.mkdir(base)
        for batch in iterator:
            for row in batch.to_pylist():
                place = [row["guarantee_id"], row["stem"]]
                if any(not p or p in (".", "..") or "/" in p or "\0" in p or p == STAGING for p in place):
                    raise ValueError(f"no folder can be named {place}")
                folder = os.path.join(base, str(zlib.crc32("/".join(place).encode()) % BUCKETS), *place)
                found = [(name, body) for column, name in self.columns.items() if (body := row[column]) is not None]
                if found:
                    os.makedirs(folder, exist_ok=True)
                for name, body in found:
                    with open(os.path.join(folder, name), "wb") as f:
                        f.write(body.encode() if isinstance(body, str) else body)
        return Staged(attempt)

    def commit(self, messages: list[Staged | None]) -> None:
        attempts = [m.attempt for m in messages if m]
        try:
            if self.overwrite:
                with os.scandir(self.root) as found:
                    for old in [x.path for x in found if x.is_dir() and x.name != STAGING]:
                        shutil.rmtree(old)
            if self.moves:
                for bucket in range(BUCKETS):
                    move_bucket(self.staging, self.root, attempts, bucket)
            else:
                with open(os.path.join(self.staging, COMMITTED), "w", encoding="utf-8") as f:
                    f.write("\n".join(attempts))
        finally:
            if self.moves:
                clear(self.staging)

    def abort(self, messages: list[Staged | None]) -> None:
        clear(self.staging)


class DocumentArtifacts(DataSource):
    """``guarantee_id, stem`` and any of ``ocr_json, ocr_md, extraction_json, meta_json, content``; null columns write no file. A
    null or unusable id or stem fails the job, and then no file is written."""

    @classmethod
    def name(cls) -> str:
        return "document_artifacts"

    def writer(self, schema: StructType, overwrite: bool) -> ArtifactWriter:
        return ArtifactWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session, and lets filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DocumentFiles)
    spark.dataSource.register(DocumentArtifacts)
