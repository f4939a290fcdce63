"""A Spark data source for folders of JSON lines, one file a document: keys are pushed to the files, and writes leave a manifest.

``read_keyed`` and ``write_keyed`` register and use it; its format is ``keyed_records``. A file is named by its key's
value (``<key>.jsonl``, with more suffixes allowed after the first dot). A filter on the key opens the named files only,
a filter on the columns of option ``within`` (such as a page number) drops lines while reading. Folders may be on any
file system that pyarrow knows.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Lines turned into one Arrow batch.
LINES = 2000
#: Columns a schema may name to get a line's file and number.
FILE, POSITION = "_file", "_position"


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), folder.removeprefix("file://").removeprefix("file:")
    return fs.FileSystem.from_uri(folder)


@dataclass
class OneFile(InputPartition):
    path: str


class KeyedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.folder = schema, options["path"]
        self.key, self.strict = options.get("key"), str(options.get("strict", "true")).lower() == "true"
        self.within = [c.strip() for c in options.get("within", "").split(",") if c.strip()]
        self.names: set[str] | None = None
        self.wanted: dict[str, set] = {}

    def partitions(self) -> list[OneFile]:
        store, folder = _opened(self.folder)
        files = sorted(i.path for i in store.get_file_info(fs.FileSelector(folder)) if i.is_file and ".jsonl" in i.base_name and not i.base_name.startswith(("_", ".")))
        return [OneFile(p) for p in files if self.names is None or p.rsplit("/", 1)[-1].split(".", 1)[0] in self.names]

    def read(self, partition: OneFile | None) -> Iterator[pa.RecordBatch]:
        kept = to_arrow_schema(self.schema)
        if partition is None:
            return
        store, _ = _opened(self.folder)
        names, held = self.schema.names, []
        with store.open_input_file(partition.path) as raw:
            for number, line in enumerate(io.BufferedReader(raw)):
                if not line.strip():
                    continue
                try:
                    row = json.loads(line)
                    if not isinstance(row, dict):
                        raise ValueError("no object")
                except ValueError as e:
                    if self.strict:
                        raise ValueError(f"{partition.path}, line {number + 1}: {e}") from e
                    continue
                row |= {FILE: partition.path.rsplit("/", 1)[-1], POSITION: number}
                if all(row.get(c) in values for c, values in self.wanted.items()):
                    held.append({c: row.get(c) for c in names})
                if len(held) >= LINES:
                    yield pa.RecordBatch.from_pylist(held, kept)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, kept)


class PushingReader(KeyedReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take equalities and lists on the key and on the columns of ``within``; hand back the others. Taken ones hold exactly."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            column = f.attribute[0] if values is not None and len(f.attribute) == 1 else None
            if column == self.key and self.key is not None:
                names = {str(v) for v in values}
                self.names = names if self.names is None else self.names & names
                self.wanted[column] = self.wanted.get(column, values) & values
            elif column in self.within:
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int
    bytes: int
    sha256: str


class KeyedWriter(DataSourceWriter):
    """Each task writes a part under a hidden name; the commit gives the parts their names and writes the manifest last, so a folder with a manifest is whole."""

    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.names, self.folder, self.overwrite = schema.names, options["path"], overwrite
        self.label, self.run = options.get("label", ""), uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        store, folder = _opened(self.folder)
        store.create_dir(folder, recursive=True)
        name, rows, size, digest = f"part-{uuid.uuid4().hex}.jsonl", 0, 0, hashlib.sha256()
        with store.open_output_stream(f"{folder}/_{self.run}-{name}") as out:
            for row in iterator:
                line = (json.dumps(row.asDict(True), ensure_ascii=False, default=str) + "\n").encode()
                out.write(line)
                digest.update(line)
                rows, size = rows + 1, size + len(line)
        return Written(name, rows, size, digest.hexdigest())

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = _opened(self.folder)
        store.create_dir(folder, recursive=True)
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(folder)):
                if info.is_file and not info.base_name.startswith(f"_{self.run}"):
                    store.delete_file(info.path)
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.name)
        for m in parts:
            store.move(f"{folder}/_{self.run}-{m.name}", f"{folder}/{m.name}")
        self._clear(store, folder)
        manifest = {"label": self.label, "rows": sum(m.rows for m in parts), "files": [{"name": m.name, "rows": m.rows, "bytes": m.bytes, "sha256": m.sha256} for m in parts]}
        with store.open_output_stream(f"{folder}/manifest.json") as out:
            out.write(json.dumps(manifest, indent=2).encode())

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_opened(self.folder))

    def _clear(self, store: fs.FileSystem, folder: str) -> None:
        for info in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if info.is_file and info.base_name.startswith(f"_{self.run}"):
                store.delete_file(info.path)


class KeyedRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "keyed_records"

    def schema(self) -> str:
        raise ValueError("keyed_records needs a schema: records may have any shape")

    def reader(self, schema: StructType) -> KeyedReader:
        # Spark refuses a reader that takes filters while their pushdown is off, and the option says which it is
        return (PushingReader if self.options.get("push") == "true" else KeyedReader)(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> KeyedWriter:
        return KeyedWriter(schema, dict(self.options), overwrite)


def read_keyed(spark: SparkSession, folder: str, schema: StructType | str, key: str | None = None, within: tuple[str, ...] = (), strict: bool = True) -> DataFrame:
    """The records of a folder, with filters on ``key`` and ``within`` pushed to files and lines. Not strict, malformed lines are dropped."""
    spark.dataSource.register(KeyedRecords)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"push": "true", "strict": str(strict).lower(), "within": ",".join(within)} | ({"key": key} if key else {})
    return spark.read.format(KeyedRecords.name()).schema(schema).options(**options).load(folder)


def write_keyed(rows: DataFrame, folder: str, label: str = "", overwrite: bool = False) -> None:
    """Write rows as JSON lines with a manifest of counts and checksums, which appears last."""
    rows.sparkSession.dataSource.register(KeyedRecords)
    rows.write.format(KeyedRecords.name()).option("label", label).mode("overwrite" if overwrite else "append").save(folder)
