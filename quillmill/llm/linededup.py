"""Line dedup by winnowing over line hashes, with DataFrame functions only.

Lines (split at newlines) are hashed after trimming. A gram is the shortest run of lines from a line on that holds
noise words or more (so one line of that many words is a gram by itself). From every window of grams that start within
reach words the one with the smallest hash is selected: a window minimum. A repeat of noise + reach words plus one line
therefore always shares a selected gram, and so does every repeated line of noise words that starts a window alone.
Selected grams are joined on their hash with the first place (smallest id, then line) that has them; the match is
extended line by line both ways; the run in the later place is deleted, the first one stays.

Deleting is safe: each deleted line equals a line at an earlier place, so the earliest copy of a line always stays.
A document that loses all of its lines is given an empty text, and goes if drop_empty is set. Null and empty texts have
no grams and stay as they are. Rows repeated with the same id and text count as one place. Null ids come first in the
order. An empty table gives an empty one; other columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.llm.common import durable, table


def line_runs(docs: DataFrame, noise: int = 25, reach: int = 25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, hash (of the text) and runs (array of lo, hi: first and last line, from 0) that repeat an earlier place."""
    n_words = lambda x: F.greatest(F.lit(1), F.length(x) - F.length(F.translate(x, " ", "")) + 1)
    split = F.split(F.col(text_col), "\n")
    lines = docs.where(F.length(text_col) > 0).select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"),
        F.transform(split, lambda x: F.xxhash64(F.trim(x))).alias("h"), F.transform(split, lambda x: n_words(F.trim(x))).alias("n"),
    )
    lines = durable(lines.where(F.aggregate("n", F.lit(0), lambda a, x: a + x) >= noise), "lines")

    place = Window.partitionBy("id", "hash")
    rows = lines.dropDuplicates(["id", "hash"]).select("id", "hash", F.posexplode(F.arrays_zip("h", "n")).alias("pos", "l")).select("id", "hash", "pos", "l.h", F.col("l.n").cast("long").alias("n"))
    rows = rows.withColumn("s", F.sum("n").over(place.orderBy("pos")) - F.col("n"))  # words before the line
    ahead = place.orderBy("s")
    rows = rows.withColumn("gram", F.xxhash64(F.collect_list("h").over(ahead.rangeBetween(0, noise - 1)))).withColumn("held", F.sum("n").over(ahead.rangeBetween(0, noise - 1)))
    rows = rows.where(F.col("held") >= noise)
    least = F.min(F.struct("gram", "pos")).over(ahead.rangeBetween(0, reach - 1))
    marks = rows.select("id", "hash", least.alias("m")).select("id", "hash", F.col("m.gram").alias("gram"), F.col("m.pos").alias("pos")).distinct()
    marks = durable(marks, "marks")

    # the first place of each gram that occurs again; counted before the shuffle, so a gram in a third of all documents is one row a task
    first = marks.groupBy("gram").agg(F.count("*").alias("places"), F.min(F.struct("id", "hash", "pos")).alias("first")).where("places > 1").drop("places")
    pairs = marks.join(durable(first, "first"), "gram").where(F.struct("id", "hash", "pos") != F.col("first"))
    seeds = pairs.groupBy("id", "hash", F.col("first.id").alias("id0"), F.col("first.hash").alias("hash0"), (F.col("pos") - F.col("first.pos")).alias("shift")).agg(F.collect_set("pos").alias("seeds"))
    seeds = durable(seeds, "seeds")

    arrays = lines.dropDuplicates(["id", "hash"]).select("id", "hash", "h")
    arrays = durable(arrays, "arrays")
    later = seeds.join(arrays, seeds["id"].eqNullSafe(arrays["id"]) & (seeds["hash"] == arrays["hash"])).select(seeds["id"], seeds["hash"], "id0", "hash0", "shift", "seeds", F.col("h").alias("b"))
    early = arrays.select(F.col("id").alias("_id"), F.col("hash").alias("_hash"), F.col("h").alias("a"))
    both = later.join(early, F.col("id0").eqNullSafe(F.col("_id")) & (F.col("hash0") == F.col("_hash")))
    # lines that differ on this diagonal, or have no partner: a run ends before each of them
    differ = F.filter(F.sequence(F.lit(0), F.size("b") - 1), lambda i: ~F.get("b", i).eqNullSafe(F.get("a", i - F.col("shift"))))
    both = both.select("id", "hash", "seeds", F.concat(F.array(F.lit(-1)), differ, F.array(F.size("b"))).alias("d"))
    run = F.transform("seeds", lambda p: F.struct((F.array_max(F.filter("d", lambda x: x < p)) + 1).alias("lo"), (F.array_min(F.filter("d", lambda x: x > p)) - 1).alias("hi")))
    each = both.select("id", "hash", F.explode(F.array_distinct(run)).alias("r"))
    return each.groupBy("id", "hash").agg(F.array_sort(F.collect_set("r")).alias("runs"))


def dedup_lines(docs: DataFrame, noise: int = 25, reach: int = 25, id_col: str = "doc_id", text_col: str = "text", drop_empty: bool = False, counts: bool = False) -> DataFrame:
    """docs without the later runs; counts adds n_lines and n_deleted. n_chars, where there is one, follows the text."""
    runs = line_runs(docs, noise, reach, id_col, text_col).select(F.col("id").alias("run_id"), F.col("hash").alias("run_hash"), "runs")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"))  # a row is carried whole, so its names meet no others
    out = rows.join(runs, F.col("id").eqNullSafe(F.col("run_id")) & (F.col("hash") == F.col("run_hash")), "left")
    text, hit = F.col("row").getField(text_col), F.col("runs").isNotNull()
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda x, i: ~F.exists("runs", lambda r: (i >= r["lo"]) & (i <= r["hi"])))
    out = out.withColumn("n", F.when(text.isNull(), 0).otherwise(F.size(lines))).withColumn("kept", F.when(hit, kept))
    out = out.select("row", "n", "kept", F.when(hit, F.array_join("kept", "\n")).otherwise(text).alias("text"), hit.alias("hit"))
    if drop_empty:
        out = out.where(~(F.col("hit") & (F.trim("text") == "")))
    own = {c: F.col("row").getField(c) for c in docs.columns} | {text_col: F.col("text")}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("hit"), F.length("text").cast("long")).otherwise(own["n_chars"])
    more = [F.col("n").cast("long").alias("n_lines"), F.when(F.col("hit"), F.col("n") - F.size("kept")).otherwise(0).cast("long").alias("n_deleted")] if counts else []
    return out.select(*(v.alias(c) for c, v in own.items()), *more)


def op8_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
