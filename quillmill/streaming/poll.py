"""A polled folder as a stream: each version of a file once, when it has stopped changing.

    spark.dataSource.register(Polled)
    spark.readStream.format("quillmill_inbox").option("path", folder).option("log", log).load()

Spark's file source remembers names, so a file that is rewritten in place would be missed; here an offset is the number of
a listing. Each poll lists the folder and, if anything is new against the listing before, writes the next listing into the
log folder, under its number, by one rename. A listing holds for each file its size and time of change, when that version
was first seen, and the number of the listing that let it through; a version is let through once it has stood unchanged
for settle_ms (and for two polls at least). Rows between two offsets are the files that the listings between them let
through, so a batch that is read again, after a restart or a lost executor, gives the same files, and a version comes once.
Files that are gone leave the next listing: the state is as large as the folder. A listing lets files_per_poll files
through at most, the longest waiting first; the others follow. forget() lets the present version of a file through again.

Listings are made where the stream is planned; contents are read by executors, a task for part_files files each. A file
that has changed or gone since its listing gives a row with an error (its next version is let through on its own); so does
one beyond most_bytes, unread."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from quillmill.schema import MAX_BYTES
from quillmill.sources.sink import OutputsWriter, opened

NAME = "quillmill_inbox"
ROWS = "path string, name string, mtime timestamp, length long, content binary, error struct<kind:string,message:string>, listing long"


def advance(before: dict[str, list], seen: dict[str, tuple[int, int]], forgotten: set[str], number: int, now: int, settle_ms: int, most: int) -> dict[str, list]:
    """The next listing: path to [size, time, first seen, let through by]. The last is 0 while a version waits."""
    after = {}
    for path, (size, mtime) in seen.items():
        old = before.get(path)
        if old is None or (size, mtime) != tuple(old[:2]):
            after[path] = [size, mtime, now, 0]
        else:
            after[path] = [*old[:3], 0 if path in forgotten else old[3]]
    ready = sorted((v[2], p) for p, v in after.items() if not v[3] and p in before and (v[0], v[1]) == tuple(before[p][:2]) and now - v[2] >= settle_ms)
    for _, path in ready[:most]:
        after[path][3] = number
    return after


class Listing(InputPartition):
    def __init__(self, files: list[tuple[str, int, int, int]]):
        self.files = files


class PolledReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.log = options["path"], options["log"].rstrip("/")
        self.settle_ms, self.most = int(options.get("settle_ms", 1000)), int(options.get("files_per_poll", 1000))
        self.part_files, self.most_bytes = int(options.get("part_files", 32)), int(options.get("most_bytes", MAX_BYTES))

    def _numbers(self) -> list[int]:
        from pyarrow import fs

        files, at = opened(self.log)
        found = files.get_file_info(fs.FileSelector(at, allow_not_found=True))
        return sorted(int(f.base_name[1:-5]) for f in found if f.base_name.startswith("l") and f.base_name.endswith(".json"))

    def _listing(self, number: int) -> dict[str, list]:
        if number <= 0:
            return {}
        files, at = opened(self.log)
        with files.open_input_stream(f"{at}/l{number:012d}.json") as stream:
            return json.loads(stream.read())

    def _forgotten(self) -> dict[str, str]:
        """Paths to let through again, by the notes that ask for it."""
        from pyarrow import fs

        files, at = opened(self.log)
        out = {}
        for f in files.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            if f.base_name.startswith("forget-"):
                with files.open_input_stream(f.path) as stream:
                    out[f.path] = stream.read().decode()
        return out

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        known = self._numbers()
        number = known[-1] if known else 0
        before, notes = self._listing(number), self._forgotten()
        files, at = opened(self.path)
        found = [f for f in files.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True)) if f.type == fs.FileType.File and not f.base_name.startswith(".")]
        seen = {f.path: (f.size, f.mtime_ns // 1_000_000) for f in found}
        after = advance(before, seen, set(notes.values()), number + 1, time.time_ns() // 1_000_000, self.settle_ms, self.most)
        if after != before:
            files, log = opened(self.log)
            files.create_dir(log)
            OutputsWriter._publish(files, f"{log}/.draft-{uuid.uuid4().hex}", f"{log}/l{number + 1:012d}.json", json.dumps(after).encode())
            number += 1
        for note in notes:
            opened(self.log)[0].delete_file(note)
        return {"listing": number}

    def partitions(self, start: dict, end: dict) -> list[Listing]:
        passed = {}
        for number in range(start["listing"] + 1, end["listing"] + 1):
            passed |= {(p, v[1]): (p, v[0], v[1], number) for p, v in self._listing(number).items() if v[3] == number}
        rows = sorted(passed.values())
        return [Listing(rows[i : i + self.part_files]) for i in range(0, len(rows), self.part_files)] or [Listing([])]

    def read(self, partition: Listing) -> Iterator[tuple]:
        import datetime as dt

        files, _ = opened(self.path)
        for path, size, mtime, number in partition.files:
            name, at = path.rsplit("/", 1)[-1], dt.datetime.fromtimestamp(mtime / 1000, dt.timezone.utc)
            content, error = None, None
            if size > self.most_bytes:
                error = ("too_large", f"{name}: {size} bytes")
            else:
                try:
                    info = files.get_file_info(path)
                    with files.open_input_stream(path) as stream:
                        content = stream.read()
                    if (info.size, info.mtime_ns // 1_000_000) != (size, mtime) or len(content) != size:
                        content, error = None, ("parse_failed", f"{name} has changed since it was listed")
                except OSError as e:
                    content, error = None, ("file_not_found", f"{type(e).__name__}: {e}"[:400])
            yield path, name, at, size, content, error, number

    def commit(self, end: dict) -> None:
        """Listings before the one that the next batch begins at go, but for a few."""
        files, at = opened(self.log)
        for number in self._numbers():
            if number < end["listing"] - 100:
                files.delete_file(f"{at}/l{number:012d}.json")


class Polled(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return ROWS

    def streamReader(self, schema) -> PolledReader:
        return PolledReader(dict(self.options))


def forget(log: str, path: str) -> None:
    """Lets the present version of a file through again, with the next listing but one."""
    files, at = opened(log)
    files.create_dir(at)
    OutputsWriter._publish(files, f"{at}/.draft-{uuid.uuid4().hex}", f"{at}/forget-{uuid.uuid4().hex}", opened(path)[1].encode())
