"""The batch sink as a Spark data source: content files first, their records last.

    results.write.format("quillmill_outputs").option("path", folder).option("run", name).mode("append").save()

Rows have path (the source), out (the output's name within the folder), ok, kind, message, content, parser, confidence and
elapsed_ms. A task writes each content into a file of its own in the run's draft folder and moves it to its name; when its
rows are done it writes their records, as one file that is moved into the run's records folder. So a record stands for a
file that is there, whole; a task that is killed leaves at most files without records, which the next run writes again,
and drafts, which commit and abort delete. A file that can't be written is a record with the kind write_failed, not a
failed task. With the option errors, a file that failed leaves <out>.err with its kind and message, and one that is written
again takes that away. Records of a task that ran twice are the same but for the attempt; records() takes one of each path.

Folders are any that pyarrow's file systems reach (file, hdfs, s3, gs)."""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

NAME = "quillmill_outputs"
ROWS = "path string, out string, ok boolean, kind string, message string, content string, parser string, confidence double, elapsed_ms long"
RECORDS = "path string, out string, ok boolean, kind string, message string, parser string, confidence double, chars long, elapsed_ms long, size long, sha256 string, task string"


@dataclass
class Written(WriterCommitMessage):
    rows: int


def opened(folder: str):
    """A pyarrow file system and the folder's path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{posixpath.abspath(folder)}")


class OutputsWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, run: str, errors: bool = False):
        self.folder, self.run, self.errors = folder.rstrip("/"), run, errors

    def _places(self):
        files, base = opened(self.folder)
        return files, base, f"{base}/_runs/{self.run}/drafts", f"{base}/_runs/{self.run}/records"

    def write(self, iterator):
        files, base, drafts, records = self._places()
        task, lines = uuid.uuid4().hex, []
        files.create_dir(drafts)
        for batch in iterator:
            for row in batch.to_pylist():
                content = row.pop("content")
                row |= {"chars": len(content or ""), "size": None, "sha256": None, "task": task}
                if row["ok"]:
                    body = (content or "").encode("utf-8", "replace")
                    try:
                        self._publish(files, f"{drafts}/{uuid.uuid4().hex}", f"{base}/{checked(row['out'])}", body)
                        row |= {"size": len(body), "sha256": hashlib.sha256(body).hexdigest()}
                    except Exception as e:  # noqa: BLE001  one file that can't be written is a record
                        row |= {"ok": False, "kind": "write_failed", "message": f"{type(e).__name__}: {e}"[:400]}
                if self.errors:
                    self._note(files, base, drafts, row)
                lines.append(json.dumps(row, ensure_ascii=False, default=str))
        if lines:
            files.create_dir(records)
            self._publish(files, f"{drafts}/{uuid.uuid4().hex}", f"{records}/{task}.jsonl", "".join(x + "\n" for x in lines).encode("utf-8", "replace"))
        return Written(len(lines))

    def _note(self, files, base: str, drafts: str, row: dict) -> None:
        """Leaves the note of a failure, or takes an older one away."""
        from pyarrow import fs

        try:
            at = f"{base}/{checked(row['out'])}.err"
            if not row["ok"]:
                self._publish(files, f"{drafts}/{uuid.uuid4().hex}", at, f"[{row['kind']}] {row['message']}".encode("utf-8", "replace"))
            elif files.get_file_info(at).type == fs.FileType.File:
                files.delete_file(at)
        except (OSError, ValueError) as e:  # the record says it anyway
            row["message"] = f"{row['message'] or ''} (no note: {type(e).__name__})".strip()

    @staticmethod
    def _publish(files, draft: str, target: str, body: bytes) -> None:
        with files.open_output_stream(draft) as stream:
            stream.write(body)
        files.create_dir(posixpath.dirname(target))
        files.move(draft, target)

    def _tidy(self) -> None:
        files, _, drafts, _ = self._places()
        files.create_dir(drafts)
        files.delete_dir(drafts)

    def commit(self, messages) -> None:
        self._tidy()

    def abort(self, messages) -> None:
        """Records of finished tasks stay: what they stand for is there. Drafts of the others go."""
        self._tidy()


class Outputs(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return ROWS

    def writer(self, schema, overwrite: bool) -> OutputsWriter:
        if overwrite:
            raise ValueError("outputs are written with mode append")
        missing = {f.split()[0] for f in ROWS.split(", ")} - set(schema.names)
        if missing:
            raise ValueError(f"columns are missing: {', '.join(sorted(missing))}")
        return OutputsWriter(self.options["path"], self.options["run"], self.options.get("errors", "false").lower() == "true")


def checked(out: str) -> str:
    """A name that stays within the folder and isn't one of its own."""
    name = posixpath.normpath(out)
    if name.startswith(("/", "..")) or name.split("/")[0] == "_runs":
        raise ValueError("the output must lie within the folder")
    return name


def records(spark: SparkSession, folder: str, run: str) -> DataFrame:
    """RECORDS of a run, one for each path."""
    files, base = opened(folder)
    from pyarrow import fs

    if files.get_file_info(f"{base}/_runs/{run}/records").type == fs.FileType.NotFound:
        return spark.createDataFrame([], RECORDS)
    every = spark.read.schema(RECORDS).json(f"{folder.rstrip('/')}/_runs/{run}/records")
    names = [f.split()[0] for f in RECORDS.split(", ")]
    return every.groupBy("path").agg(F.max_by(F.struct(*names), F.struct("ok", "task")).alias("r")).select("r.*")


def current(named: DataFrame, folder: str, files_a_task: int = 4096) -> DataFrame:
    """named (out) with now_size, now_sha256 and out_mtime of the files of these names in folder; rows whose file isn't
    there are left out. Each task opens the files of its rows, so nothing lists the folder."""
    schema = T.StructType([*named.schema, T.StructField("now_size", T.LongType()), T.StructField("now_sha256", T.StringType()), T.StructField("out_mtime", T.TimestampType())])

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark.sql.pandas.types import to_arrow_schema

        files, base = opened(folder)
        last = pa.schema(list(to_arrow_schema(schema))[-3:])
        for b in batches:
            places, found = [], []
            for i, out in enumerate(b.column(at).to_pylist()):
                info = files.get_file_info(f"{base}/{out}")
                if info.type == fs.FileType.File:
                    with files.open_input_stream(f"{base}/{out}") as stream:
                        found.append((info.size, hashlib.sha256(stream.read()).hexdigest(), info.mtime))
                    places.append(i)
            kept = b.take(pa.array(places, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(c, f.type) for c, f in zip(zip(*found, strict=True) if found else ((), (), ()), last, strict=True))], names=schema.names)

    at = named.columns.index("out")
    return named.repartition(max(1, -(-named.count() // files_a_task))).mapInArrow(run, schema)


def put(folder: str, name: str, text: str) -> None:
    """One small file, written beside its name and moved there."""
    files, base = opened(folder)
    OutputsWriter._publish(files, f"{base}/.{name}-{uuid.uuid4().hex}", f"{base}/{name}", text.encode())


def get(folder: str, name: str) -> str | None:
    from pyarrow import fs

    files, base = opened(folder)
    if files.get_file_info(f"{base}/{name}").type != fs.FileType.File:
        return None
    with files.open_input_stream(f"{base}/{name}") as stream:
        return stream.read().decode()
