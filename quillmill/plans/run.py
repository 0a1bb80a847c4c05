"""A batch over many files: planned outputs, a deadline, and one row for each file, always.

The conversion is one Spark job that writes through the sink (sources/sink.py). It runs under a tag of its own; at the
deadline the tag is interrupted. What finished tasks have written stays, with its records. The report is then made by
joins: the records, the files that an earlier run had done (resumed), and, by an anti-join, a row of the kind timeout for
each file that is in neither. So the rows are the files, however the job ended; only a failure that isn't the deadline's
is raised, after the report of what was done has been written."""

from __future__ import annotations

import json
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators.batch import plan_outputs, resume
from quillmill.plans.translate import translate
from quillmill.sources.sink import NAME, Outputs, current, get, put, records
from quillmill.sources.tables import checkpointed

REPORT = "_batch_report.json"
FILES_A_TASK = 64  # what is lost at most of a task that the deadline meets


def interrupted_at(spark: SparkSession, seconds: float, job) -> tuple[bool, BaseException | None]:
    """Runs job() under a tag that another thread interrupts when the time is over. Whether that ended it, and what it
    raised otherwise."""
    sc, tag, done, over = spark.sparkContext, f"batch-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        if done.wait(max(0.0, seconds)):
            return
        over.set()
        while not done.is_set():  # a job that begins just now has to be interrupted too
            sc.cancelJobsWithTag(tag)
            done.wait(1.0)

    watcher = threading.Thread(target=watch, daemon=True)
    sc.setLocalProperty("spark.job.interruptOnCancel", "true")
    sc.addJobTag(tag)
    watcher.start()
    try:
        job()
    except Exception as e:  # noqa: BLE001  handed to the caller
        return over.is_set(), None if over.is_set() else e
    finally:
        done.set()
        sc.removeJobTag(tag)
        sc.setLocalProperty("spark.job.interruptOnCancel", None)
        watcher.join()
    return False, None


def outputs(results: DataFrame) -> DataFrame:
    """Converted results with their out as rows of the sink."""
    ok = F.col("error").isNull()
    return results.select(
        "path", "out", ok.alias("ok"), F.col("error.kind").alias("kind"), F.col("error.message").alias("message"), F.when(ok, F.col("content")).alias("content"), F.col("strategy").alias("parser"), F.col("confidence").cast("double").alias("confidence"), F.lit(None).cast("long").alias("elapsed_ms")
    )


def artifacts_of(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the files that the report in a folder names, with what the files are now."""
    text = get(folder, REPORT)
    held = json.loads(text)["runs"] if text else []
    every = None
    for run in held:  # bounded: a report names the runs whose files are still current
        one = records(spark, folder, run).where("ok").withColumn("run", F.lit(run))
        every = one if every is None else every.unionByName(one)
    if every is None:
        return spark.createDataFrame([], "out string, path string, size long, sha256 string, now_size long, now_sha256 string, out_mtime timestamp, run string")
    latest = every.groupBy("out").agg(F.max_by(F.struct("path", "size", "sha256", "run"), "run").alias("r")).select("out", "r.*")
    return current(latest.where(~F.col("out").startswith("_")), folder)


def run_batch(
    sources: DataFrame, folder: str, ext: str = ".md", deadline: float = 60.0, source_dir: str | None = None, force: bool = False, files_a_task: int = FILES_A_TASK, keep_runs: int = 100, errors: bool = False, convert=translate, **options
) -> DataFrame:
    """Converts sources (path, name, mtime, length, content, error) into files of folder within `deadline` seconds, and
    gives a row for each: path, out, state (ok, failed, skipped), kind, message, parser, confidence, chars, size, sha256.
    Files whose output an earlier run has written, that is unchanged since and as new as its source, are skipped (unless
    force is set). errors leaves a note beside each output that failed. A report names keep_runs runs at most; files whose
    run it no longer names are written again. The folder then holds the files, _batch_report.json with the sums, and the rows in
    _runs/<run>/report. The clock runs from the call on."""
    spark, began, run = sources.sparkSession, time.monotonic(), f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    spark.dataSource.register(Outputs)
    targets = checkpointed(plan_outputs(sources.select("path", "mtime"), ext, source_dir), "targets")
    known = checkpointed(artifacts_of(spark, folder), "known")
    stale = F.coalesce(F.col("mtime"), F.lit("1970-01-01").cast("timestamp")).alias("mtime")
    pending = targets if force else targets.join(resume(targets.select("path", "out", stale), known).select("path"), "path", "left_semi")
    pending = checkpointed(pending.select("path", "out"), "pending")
    n = pending.count()

    def job() -> None:
        work = sources.join(pending, "path").repartition(max(1, -(-n // files_a_task)))
        outputs(convert(work, carry=("out",), **options)).write.format(NAME).option("path", folder).option("run", run).option("errors", str(errors).lower()).mode("append").save()

    late, raised = interrupted_at(spark, deadline - (time.monotonic() - began), job) if n else (False, None)
    done = checkpointed(records(spark, folder, run), "records")
    rest = pending.join(done.select("path"), "path", "left_anti").select("path", "out", F.lit("failed").alias("state"), F.lit("timeout" if late else "internal").alias("kind"), F.lit(f"not finished within {deadline:g} s" if late else "the batch failed").alias("message"))
    told = done.select("path", "out", F.when(F.col("ok"), "ok").otherwise("failed").alias("state"), "kind", "message", "parser", "confidence", "chars", "size", "sha256")
    skipped = targets.join(pending.select("path"), "path", "left_anti").select("path", F.lower("out").alias("_o"), "out").join(known.select(F.lower("out").alias("_o"), "size", "sha256"), "_o", "left").select("path", "out", F.lit("skipped").alias("state"), "size", "sha256")
    report = told.unionByName(rest, allowMissingColumns=True).unionByName(skipped, allowMissingColumns=True)
    report.write.parquet(f"{folder.rstrip('/')}/_runs/{run}/report")
    report = spark.read.schema(report.schema).parquet(f"{folder.rstrip('/')}/_runs/{run}/report")
    held = [r[0] for r in known.join(skipped.select("out"), "out", "left_semi").select("run").distinct().collect()] if not force else []  # runs that skipped files come from
    _sums(report, folder, sorted({*held, run})[-keep_runs:], round((time.monotonic() - began) * 1000))
    if raised is not None:
        raise raised
    return report


def _sums(report: DataFrame, folder: str, runs: list[str], elapsed_ms: int) -> None:
    state = lambda s: F.count_if(F.col("state") == s)
    r = report.agg(F.count("*").alias("total"), *(state(s).alias(n) for s, n in (("ok", "ok_count"), ("failed", "failed"), ("skipped", "skipped"))), F.coalesce(F.round(F.avg(F.when(F.col("state") == "ok", F.col("confidence"))), 3), F.lit(0.0)).alias("avg_confidence")).first()
    body = {"ok": True, "code": 200, **r.asDict(), "elapsed_ms": elapsed_ms, "out_dir": folder, "runs": runs}
    put(folder, REPORT, json.dumps(body, ensure_ascii=False, indent=1))
