"""Source adapters: what a name like scheme:rest is read by, on executors.

    register_adapters(spark, MyAdapter())
    spark.read.format("quillmill_source").load("my:source")

An adapter says whether it can handle a source, deals it into parts (on the driver) and reads a part (on an executor) as
rows of path, name, mtime, content; length and error follow from those. Adapters that are registered later are asked
first, and all of them before the built-in ones: a table's text column (table:<Parquet>#<id>,<text>), text in the name
itself (raw:<text>), files (any other name, folders included). A source that none can handle is an error of the read, not
of a row; what fails while one item is read is that item's row."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillmill.schema import MAX_BYTES
from quillmill.sources.sink import opened

NAME = "quillmill_source"
ROWS = "path string, name string, mtime timestamp, length long, content binary, error struct<kind:string,message:string>"
PART_BYTES = 64 << 20


class Adapter:
    """What a custom adapter is made of. It is sent to executors, so it holds settings and no connections."""

    def can_handle(self, source: str) -> bool:
        raise NotImplementedError

    def parts(self, source: str) -> list[Any]:
        """What one task each reads; anything that can be sent."""
        return [source]

    def read(self, part: Any) -> Iterator[dict]:
        """Rows with path, name, content (bytes, text or an exception that reading it raised) and mtime, if known."""
        raise NotImplementedError


class FileAdapter(Adapter):
    def __init__(self, part_bytes: int = PART_BYTES, most_bytes: int = MAX_BYTES):
        self.part_bytes, self.most_bytes = part_bytes, most_bytes

    def can_handle(self, source: str) -> bool:
        from pyarrow import fs

        files, at = opened(source)
        return files.get_file_info(at).type != fs.FileType.NotFound

    def parts(self, source: str) -> list[Any]:
        """Lists of (path, size, time), about part_bytes each, in the order of their paths."""
        from pyarrow import fs

        files, at = opened(source)
        info = files.get_file_info(at)
        found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(at, recursive=True))
        parts, held = [[]], 0
        for f in sorted((f for f in found if f.type == fs.FileType.File), key=lambda f: f.path):
            if held + f.size > self.part_bytes and parts[-1]:
                parts.append([])
                held = 0
            parts[-1].append((source, f.path, f.size, f.mtime))
            held += f.size
        return parts

    def read(self, part: Any) -> Iterator[dict]:
        for source, path, size, mtime in part:
            row = {"path": path, "name": path.rsplit("/", 1)[-1], "mtime": mtime, "length": size}
            if size > self.most_bytes:  # its content is never read
                yield row | {"content": None, "error": ("too_large", f"{row['name']}: {size} bytes")}
                continue
            try:
                with opened(source)[0].open_input_stream(path) as stream:
                    yield row | {"content": stream.read()}
            except Exception as e:  # noqa: BLE001  one file is one row
                yield row | {"content": e}


class RawAdapter(Adapter):
    def can_handle(self, source: str) -> bool:
        return source.startswith("raw:")

    def read(self, part: Any) -> Iterator[dict]:
        yield {"path": "raw:raw_data", "name": "raw_data", "content": part[4:]}


class TableAdapter(Adapter):
    """Rows of a Parquet table as sources, a task for each row group: a name from one column, the text of another."""

    def __init__(self, extension: str = "txt"):
        self.extension = extension

    def can_handle(self, source: str) -> bool:
        return source.startswith("table:") and "#" in source and "," in source.rsplit("#", 1)[1]

    def parts(self, source: str) -> list[Any]:
        import pyarrow.dataset as ds

        where, columns = source[6:].rsplit("#", 1)
        files, at = opened(where)
        out = []
        for piece in ds.dataset(at, filesystem=files, format="parquet").get_fragments():
            out += [(where, piece.path, g.id, columns.split(",")) for g in piece.row_groups]
        return out

    def read(self, part: Any) -> Iterator[dict]:
        import pyarrow.parquet as pq

        where, path, group, (ident, text) = part
        with opened(where)[0].open_input_file(path) as stream:
            file = pq.ParquetFile(stream)
            for batch in file.iter_batches(1024, row_groups=[group], columns=[ident, text]):
                for row in batch.to_pylist():
                    name = f"{row[ident]}.{self.extension}"
                    yield {"path": f"table:{name}", "name": name, "content": row[text]}


BUILT_IN: tuple[Adapter, ...] = (TableAdapter(), RawAdapter(), FileAdapter())


class Part(InputPartition):
    def __init__(self, value: Any):
        self.value = value


class Reader(DataSourceReader):
    def __init__(self, adapter: Adapter, source: str):
        self.adapter, self.source = adapter, source

    def partitions(self) -> list[Part]:
        return [Part(p) for p in self.adapter.parts(self.source)] or [Part(None)]

    def read(self, partition: Part) -> Iterator[tuple]:
        if partition.value is None:
            return
        for row in self.adapter.read(partition.value):
            content, error = row["content"], row.get("error")
            if isinstance(content, Exception):
                kind = "permission_denied" if isinstance(content, PermissionError) else "file_not_found" if isinstance(content, FileNotFoundError) else "parse_failed"
                content, error = None, (kind, f"{type(content).__name__}: {content}"[:400])
            body = content.encode("utf-8", "replace") if isinstance(content, str) else content if content is None else bytes(content)
            mtime = row.get("mtime")
            mtime = mtime if mtime is None or isinstance(mtime, dt.datetime) else dt.datetime.fromtimestamp(mtime, dt.timezone.utc)
            yield row["path"], row["name"], mtime, row.get("length", len(body or b"")), body, error


class Sources(DataSource):
    adapters: tuple[Adapter, ...] = BUILT_IN

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> Reader:
        source = self.options.get("path", "")
        for adapter in self.adapters:
            if adapter.can_handle(source):
                return Reader(adapter, source)
        raise ValueError(f"no adapter can handle {source[:200]!r}")


def register_adapters(spark: SparkSession, *adapters: Adapter) -> None:
    """Makes the format known to the session. Those given are asked in the order given, then those registered with the
    session before, then the built-in ones. Spark plans reads in a process of its own, so the adapters go there, and to
    executors, as part of the class that is registered."""
    before = tuple(a for a in getattr(spark, "_quillmill_adapters", ()) if a not in adapters)
    spark._quillmill_adapters = (*adapters, *before)
    spark.dataSource.register(type("Sources", (Sources,), {"adapters": (*adapters, *before, *BUILT_IN), "__module__": "registered"}))


def load(spark: SparkSession, source: str) -> DataFrame:
    """path, name, mtime, length, content, error of a source."""
    if not hasattr(spark, "_quillmill_adapters"):
        register_adapters(spark)
    return spark.read.format(NAME).load(source)


def from_stream(spark: SparkSession, stream, name: str = "stream_data", chunk: int = 1 << 20, most_bytes: int = MAX_BYTES) -> DataFrame:
    """An open file or socket of the driver as one source row; reading stops beyond most_bytes, and the row is an error."""
    held, size = [], 0
    while piece := stream.read(chunk):
        piece = piece.encode() if isinstance(piece, str) else piece
        size += len(piece)
        if size > most_bytes:
            held = []
            break
        held.append(piece)
    error = ("too_large", f"{name}: more than {most_bytes} bytes") if size > most_bytes else None
    rows = [(f"stream:{name}", name, None, size, None if error else b"".join(held), error)]
    return spark.createDataFrame(rows, ROWS).select("path", "name", F.col("mtime"), "length", "content", "error")
