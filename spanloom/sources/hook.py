"""Hook events as a data source: ``spark.read.format("hook_events").load(folder)``, and the same with ``readStream``.

A folder (or file) of JSON lines is read in ranges of ``range_bytes``, each a partition that reads the lines that begin in it, so
that one large log is many tasks. Equality filters on the event's fields are applied while a line is read, before it
becomes a row. Blank and malformed lines, and JSON that is no object, are no events.

As a stream, an offset is how far each file has been read, up to the end of its last whole line: files may
grow and new ones may come. The folder may lie on any file system that Arrow knows by its URI.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, IsNotNull

FIELDS = ("session_id", "hook_event_name", "tool_name")
SCHEMA = "raw string, session_id string, hook_event_name string, tool_name string, file string, place bigint"
ARROW = pa.schema([("raw", pa.string()), *((f, pa.string()) for f in FIELDS), ("file", pa.string()), ("place", pa.int64())])
RANGE = 64 << 20
STEP = 1 << 20  # bytes read at once
ROWS = 1024


class Range(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def sizes(path: str) -> dict[str, int]:
    """The files of a folder, or a file, with their bytes; hidden files are left out."""
    files, inside = _opened(path)
    at = files.get_file_info(inside)
    if at.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [at] if at.is_file else files.get_file_info(fs.FileSelector(inside, recursive=True))
    return {f.path: f.size for f in sorted(found, key=lambda f: f.path) if f.is_file and not f.base_name.startswith((".", "_"))}


def ranges(start: dict[str, int], end: dict[str, int], size: int) -> list[Range]:
    return [Range(f, a, min(a + size, last)) for f, last in end.items() for a in range(start.get(f, 0), last, size)]


def lines(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin in [start, end), each read to its end."""
    place = max(start - 1, 0)
    file.seek(place)
    skipping = start > 0  # to the first line that begins at start or behind it
    left = b""
    while True:
        step = file.read(STEP)
        *whole, left = (left + step).split(b"\n")
        for line in whole:
            if not skipping:
                yield place, line
            skipping, place = False, place + len(line) + 1
            if place >= end:
                return
        if not step:
            if left and not skipping:
                yield place, left
            return


def whole_lines(path: str, files: dict[str, int]) -> dict[str, int]:
    """The files with the bytes up to the end of their last whole line."""
    system, _ = _opened(path)
    out = {}
    for name, size in files.items():
        end = size
        with system.open_input_file(name) as file:
            while end:
                begin = max(end - STEP, 0)
                file.seek(begin)
                at = file.read(end - begin).rfind(b"\n")
                end = begin + at + 1 if at >= 0 else begin
                if at >= 0:
                    break
        out[name] = end
    return out


def events(path: str, part: Range, wanted: dict[str, set | None]) -> Iterator[pa.RecordBatch]:
    """The events of a range whose fields are as wanted: one of a set, or (None) not null."""
    system, _ = _opened(path)
    held: list[tuple] = []

    def out() -> pa.RecordBatch:
        columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)

    with system.open_input_file(part.file) as file:
        for place, line in lines(file, part.start, part.end):
            try:
                raw = line.decode()
                event = json.loads(raw)
            except ValueError:
                continue
            if not isinstance(event, dict):
                continue
            fields = {f: v if isinstance(v := event.get(f), str) or v is None else json.dumps(v) for f in FIELDS}
            if all(fields[f] in chosen if chosen is not None else fields[f] is not None for f, chosen in wanted.items()):
                held.append((raw, *fields.values(), part.file, place))
            if len(held) == ROWS:
                yield out()
                held.clear()
    if held:
        yield out()


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("range_bytes", RANGE))
        self.wanted: dict[str, set | None] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In, IsNotNull)) and len(f.attribute) == 1 else None
            if name not in FIELDS:
                yield f
                continue
            chosen = None if isinstance(f, IsNotNull) else {f.value} if isinstance(f, EqualTo) else set(f.value)
            before = self.wanted.get(name)
            self.wanted[name] = before if chosen is None else chosen if before is None else before & chosen

    def partitions(self) -> list[Range]:
        return ranges({}, sizes(self.path), self.size)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return events(self.path, partition, self.wanted)


class StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("range_bytes", RANGE))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return whole_lines(self.path, sizes(self.path))

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return ranges(start, end, self.size)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return events(self.path, partition, {})

    def commit(self, end: dict) -> None:
        pass


class HookEvents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "hook_events"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(HookEvents)
