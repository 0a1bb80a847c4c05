"""What the operators of this subpackage share: batch mapping, durable cuts of lineage, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from quillmill.sources.tables import shared_folder

BATCH_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Scans and Arrow passes that run within hold so many rows at once, not some thousands: for tables of large rows,
    where a batch would else be all that a task reads."""
    was = {k: spark.conf.get(k, None) for k in BATCH_ROWS}
    try:
        for k in BATCH_ROWS:
            spark.conf.set(k, str(rows))
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def durable(df: DataFrame, name: str = "cut", **options) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts lineage, survives lost executors and
    leaves the optimizer a plain scan (so that joins on it can be split by adaptive execution). options: the writer's."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")  # the table is whole now: the shuffle files behind it go with the write
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def drop_durable(*frames: DataFrame) -> None:
    """Deletes the files of durable() tables that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)


def map_batches(df: DataFrame, schema: str | StructType, make: Callable[[], Callable[..., list[list]]]) -> DataFrame:
    """One Arrow pass without a shuffle. make() is called once per task and gives a function that takes the columns
    of a batch as lists and returns the output columns as sequences, in the order of schema."""
    struct = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)

    def run(batches):
        each = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            out = each(*(c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow
            )

    return df.mapInArrow(run, struct)


def commonest(counted: DataFrame, count_col: str, most: int) -> DataFrame:
    """The rows with the largest counts that fit into `most` rows. Counts fall into a few hundred steps, and whole steps
    are taken, so no task sends a list of its own to the driver."""
    step = F.floor(16 * F.log2(count_col)).cast("int")
    least, fit = None, 0
    for r in sorted(counted.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), reverse=True):
        if (fit := fit + r["n"]) > most:
            break
        least = r["step"]
    return counted.where(step >= least if least is not None else F.lit(False))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges(a long, b long): rows (id, root) with root the smallest id of the component, one
    row for each id that has an edge. Alternates large-star and small-star steps (each one shuffle on a node), so the
    number of rounds grows with the logarithm of a component's diameter and no component meets in one task: a star's
    leaves are the only rows that share a key, and they are combined by min() before the shuffle."""
    cur = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        # large star: every larger neighbour of a node points to the smallest of the node's neighbourhood
        both = cur.select("a", "b").union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), F.least("a", "m").alias("m"))
        large = durable(cur.join(low, "b").select("a", F.col("m").alias("b")), "edges")
        # small star: a node and its smaller neighbours point to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        nxt = durable(small.where("a <> b").distinct(), "edges")
        drop_durable(cur, large)
        cur = nxt
        # settled when every node points to one root that points nowhere: another round would change nothing then
        ends = cur.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(cur.select("b", F.lit(0), F.lit(1)))
        ends = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if ends.where("up > 1 or (up = 1 and down = 1)").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return cur.select(F.col("a").alias("id"), F.col("b").alias("root")).union(cur.select("b", "b").distinct())
