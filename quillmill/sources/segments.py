"""A folder of immutable segments under numbered manifests: what an incremental table stands on.

A segment is a folder of Parquet files that is written once. A manifest (JSON) names the segments of one generation, by
table and bucket; the newest manifest is the table. A commit writes the next manifest beside the others under a name of
its own and renames it into place; the rename fails where another writer has taken the number, and until it is done
readers see the generation before. Segments that no manifest names (of a writer that was lost) do no harm and go with
sweep()."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has committed since the manifest was read."""


class Segments:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        p, fs = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def generations(self) -> list[int]:
        return [int(n[1:-5]) for n in self._names("manifests") if n.startswith("m") and n.endswith(".json")]

    def manifest(self, generation: int | None = None) -> dict | None:
        """The newest manifest, or the one of a generation."""
        known = self.generations()
        if not known:
            return None
        p, fs = self._at(f"manifests/m{known[-1] if generation is None else generation:010d}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, manifest: dict) -> None:
        """Makes manifest (with its generation) the newest one."""
        target, fs = self._at(f"manifests/m{manifest['generation']:010d}.json")
        draft, _ = self._at(f"manifests/.draft-{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        finally:
            stream.close()
        jvm = self.spark._jvm
        kind = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        no_overwrite = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        no_overwrite[0] = jvm.java.lang.Enum.valueOf(kind, "NONE")
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, target, no_overwrite)
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(target):
                raise Conflict(f"generation {manifest['generation']} has been written meanwhile") from e
            raise

    def write(self, rows: DataFrame, bucket: str, name: str, together: bool = True) -> dict[str, str]:
        """Writes rows as a segment for each value of the column bucket; gives their folders by bucket. Rows are brought
        together by bucket, and a bucket that is large is split among tasks by its size; or else each task writes a file
        into each bucket that it has rows of, and nothing is shuffled."""
        folder = f"segments/{name}-{uuid.uuid4().hex}"
        (rows.hint("rebalance", bucket) if together else rows).write.partitionBy(bucket).parquet(f"{self.path}/{folder}")
        return {n.split("=", 1)[1]: f"{folder}/{n}" for n in self._names(folder) if n.startswith(f"{bucket}=")}

    def read(self, segments: list[str], schema: str) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{s}" for s in segments))

    def sweep(self, keep: int, named) -> None:
        """Deletes all but the newest `keep` manifests, and the segments that none of those names."""
        known = self.generations()
        held = {s for g in known[-keep:] for s in named(self.manifest(g))}
        for g in known[:-keep]:
            p, fs = self._at(f"manifests/m{g:010d}.json")
            fs.delete(p, False)
        for folder in self._names("segments"):
            inside = [f"segments/{folder}/{n}" for n in self._names(f"segments/{folder}") if "=" in n]
            live = [n for n in inside if n in held]
            for gone in [n for n in inside if n not in held] if live else [f"segments/{folder}"]:
                p, fs = self._at(gone)
                fs.delete(p, True)
