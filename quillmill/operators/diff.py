"""Line differences of pairs of texts, and how pairs are found.

A difference is the list of matching blocks: the longest run of lines that both texts hold (of equal ones the first in a,
then in b), and the same again for what lies before and behind it in both. matching_blocks() finds them for all pairs at
once with joins and windows. Lines are hashed; grams of a few lines are joined within a region; hits on one diagonal that
follow each other are one run (gaps and islands); and rounds take each region's longest run and cut the other runs into
what lies before and behind it. Long grams come first: every run that a region still holds after its round is shorter than
the gram, so the next, shorter gram is joined only within the gaps that are left. What is left then are single lines, and
those are taken in order, in one pass over a region. So a line that stands everywhere in both texts is joined with itself
only inside gaps, never across the pair, and nothing of a pair meets in one task but its own lines.

Lines of one pair are compared by 64-bit hashes. A null text counts as an empty one."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.functions.text import let, text_of
from quillmill.sources.tables import checkpointed, dropped

LONE = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"  # fixed values: the signs besides \n that end a line
ENDS = f"\r\n|[\n{LONE}]"
GRAMS = (8, 2)
ROUNDS_A_WRITE = 8
RUNS_A_TASK = 20_000  # a round sorts its runs, which costs far more than their bytes tell
KEY = ["pair", "lo_a", "lo_b"]  # a region is named by its pair and where it begins
HOME = ["pair", "of_a", "of_b"]  # the region of a run when its gram was joined; rounds make regions within it
# Fixed value: the mark for lines left out between two changes.
LEFT_OUT = "... 省略 %d 行未变更内容 ..."


def parts_of(text: Column) -> Column:
    """A text split at every end of a line; null for null."""
    other = reduce(or_, (text.contains(sign) for sign in LONE))  # a pattern is slow to look for, so most texts meet none
    return F.when(other, F.split(text, ENDS)).otherwise(F.split(text, "\n"))


def lines_of(text: str | Column) -> Column:
    """The lines of a text; one that ends with a line's end has no empty line behind it."""
    return let(parts_of(text_of(text)), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def _runs(regions: DataFrame, gram: int) -> DataFrame:
    """KEY, i, j, n: the longest runs on each diagonal of each region, of gram lines or more. i and j count in the texts."""

    def grams(lines: str, lo: str, at: str) -> DataFrame:
        hashes = F.transform(F.sequence(F.lit(1), F.size(lines) - gram + 1), lambda p: F.xxhash64(F.slice(lines, p, gram)))
        return regions.where(F.size(lines) >= gram).select(*KEY, F.posexplode(hashes).alias(at, "gram")).withColumn(at, F.col(at) + F.col(lo))

    hits = grams("a", "lo_a", "i").join(grams("b", "lo_b", "j"), [*KEY, "gram"])
    diagonal = Window.partitionBy(*KEY, "d").orderBy("i")
    hits = hits.withColumn("d", F.col("i") - F.col("j")).withColumn("island", F.col("i") - F.row_number().over(diagonal))
    return hits.groupBy(*KEY, "d", "island").agg(F.min("i").alias("i"), F.min("j").alias("j"), (F.count("*") + gram - 1).cast("int").alias("n")).drop("d", "island")


def _round(runs: DataFrame, gram: int) -> DataFrame:
    """runs with taken: each region's longest run is taken; the others are cut into what lies before and behind it, and
    belong to regions of their own from then on. Taken runs pass through."""
    region = Window.partitionBy("taken", *KEY)
    best = F.max(F.struct("n", (-F.col("i")).alias("i"), (-F.col("j")).alias("j"))).over(region)
    i, j, n = -F.col("best.i"), -F.col("best.j"), F.col("best.n")
    before = F.least("n", i - F.col("i"), j - F.col("j"))
    skip = F.greatest(F.lit(0), i + n - F.col("i"), j + n - F.col("j"))
    piece = lambda taken, lo_a, lo_b, at, size: F.struct(F.lit(taken).alias("taken"), lo_a.cast("int").alias("lo_a"), lo_b.cast("int").alias("lo_b"), (F.col("i") + at).alias("i"), (F.col("j") + at).alias("j"), size.cast("int").alias("n"))
    lo_a, lo_b = F.col("lo_a"), F.col("lo_b")
    whole = F.array(piece(True, lo_a, lo_b, F.lit(0), F.col("n")))
    parts = F.filter(F.array(piece(False, lo_a, lo_b, F.lit(0), before), piece(False, i + n, j + n, skip, F.col("n") - skip)), lambda p: p["n"] >= gram)
    chosen = F.col("taken") | (F.struct("n", (-F.col("i")).alias("i"), (-F.col("j")).alias("j")) == F.col("best"))
    cut = runs.withColumn("best", best).select(*HOME, F.explode(F.when(chosen, whole).otherwise(parts)).alias("p"))
    return cut.select(*HOME, "p.*")


def _gaps(regions: DataFrame, blocks: DataFrame) -> DataFrame:
    """The regions between the blocks that have been taken in regions."""
    inside = blocks.groupBy("pair", F.col("of_a").alias("lo_a"), F.col("of_b").alias("lo_b")).agg(F.array_sort(F.collect_list(F.struct("i", "j", "n"))).alias("blocks"))
    end_a, end_b = F.col("lo_a") + F.size("a"), F.col("lo_b") + F.size("b")
    stops = F.concat(F.coalesce("blocks", F.array().cast("array<struct<i:int,j:int,n:int>>")), F.array(F.struct(end_a.alias("i"), end_b.alias("j"), F.lit(0).alias("n"))))
    first = F.struct(F.col("lo_a").alias("i"), F.col("lo_b").alias("j"), F.lit(0).alias("n"))
    every = regions.join(inside, KEY, "left").withColumn("stops", stops)
    gap = F.transform("stops", lambda s, k: F.struct(F.coalesce(F.get("stops", k - 1), first).alias("p"), s.alias("s")))
    every = every.select("pair", "lo_a", "lo_b", "a", "b", F.explode(gap).alias("g")).withColumn("i", F.col("g.p.i") + F.col("g.p.n")).withColumn("j", F.col("g.p.j") + F.col("g.p.n"))
    part = lambda lines, lo, begin, end: F.slice(lines, F.col(begin) - F.col(lo) + 1, F.col(end) - F.col(begin))
    every = every.where((F.col("g.s.i") > F.col("i")) & (F.col("g.s.j") > F.col("j")))
    return every.select("pair", F.col("i").alias("lo_a"), F.col("j").alias("lo_b"), part("a", "lo_a", "i", "g.s.i").alias("a"), part("b", "lo_b", "j", "g.s.j").alias("b"))


def _singles(regions: DataFrame) -> DataFrame:
    """pair, i, j, n = 1 in regions that hold no run of two lines: each line of a, in order, with the first line of b that
    equals it behind the match before."""
    both = regions.withColumn("common", F.array_intersect("a", "b")).where(F.size("common") > 0)
    held = lambda lines: F.filter(F.transform(lines, lambda h, p: F.struct(h.alias("h"), p.alias("p"))), lambda x: F.array_contains("common", x["h"]))
    both = both.select("pair", "lo_a", "lo_b", held("a").alias("x"), held("b").alias("y"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<i:int,j:int>>").alias("out"))

    def step(state: Column, line: Column) -> Column:
        found = F.array_min(F.transform(F.filter("y", lambda q: (q["h"] == line["h"]) & (q["p"] >= state["at"])), lambda q: q["p"]))
        taken = lambda p: F.struct((p + 1).alias("at"), F.concat(state["out"], F.array(F.struct(line["p"].alias("i"), p.alias("j")))).alias("out"))
        return F.get(F.transform(F.array(found), lambda p: F.when(p.isNull(), state).otherwise(taken(p))), F.lit(0))

    both = both.select("pair", "lo_a", "lo_b", F.explode(F.aggregate("x", start, step)["out"]).alias("m"))
    return both.select("pair", (F.col("lo_a") + F.col("m.i")).alias("i"), (F.col("lo_b") + F.col("m.j")).alias("j"), F.lit(1).alias("n"))


def hashed(lines: str | Column) -> Column:
    return F.transform(lines, lambda x: F.xxhash64(x))


def matching_blocks(pairs: DataFrame, grams: tuple[int, ...] = GRAMS) -> DataFrame:
    """pair, i, j, n for pairs of pair (a name of its own for each), a and b (arrays of lines): line i + k of a equals
    line j + k of b for k below n."""
    return _blocks(checkpointed(pairs.select("pair", hashed("a").alias("a"), hashed("b").alias("b")), "regions"), grams)


def _blocks(pairs: DataFrame, grams: tuple[int, ...]) -> DataFrame:
    """The same for a table of hashed lines that has been written."""
    whole = pairs.select("pair", F.lit(0).alias("lo_a"), F.lit(0).alias("lo_b"), "a", "b")
    regions, found = whole, []
    for gram in grams:
        runs = _runs(regions.where(F.arrays_overlap("a", "b")), gram).withColumns({"of_a": F.col("lo_a"), "of_b": F.col("lo_b"), "taken": F.lit(False)})
        open_ = checkpointed(runs.select(*HOME, "taken", "lo_a", "lo_b", "i", "j", "n"), "runs")
        taken = open_.where("taken")
        while rows := open_.count():
            later = open_.repartition(-(-rows // RUNS_A_TASK), "pair")  # a round's windows are within pairs, so all rounds are one shuffle
            for _ in range(ROUNDS_A_WRITE):
                later = _round(later, gram)
            later = checkpointed(later, "runs")
            taken, open_ = taken.union(later.where("taken")), later.where("not taken")
        found.append(taken.select("pair", "i", "j", "n"))
        left = checkpointed(_gaps(regions, taken), "regions")
        if regions is not whole:
            dropped(regions)
        regions = left
    found.append(_singles(regions))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def blocks_by_pair(pairs: DataFrame, grams: tuple[int, ...] = GRAMS) -> DataFrame:
    """pair and blocks, its matching blocks in order: of a table of hashed lines that has been written."""
    return _blocks(pairs, grams).groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("i", "j", "n"))).alias("blocks"))


def _told(whole_a: Column, whole_b: Column, blocks: Column, context: int, a: Column | None, b: Column | None, most: int) -> tuple[dict[str, Column], Column | None]:
    """The report of one pair from its numbers of lines and its blocks: its counts, and, where lines are given, what is
    shown of the texts."""
    stops = F.concat(blocks, F.array(F.struct(whole_a.alias("i"), whole_b.alias("j"), F.lit(0).alias("n"))))
    took = F.aggregate(blocks, F.lit(0), lambda s, x: s + x["n"])
    begins = lambda s: (s["i"] == 0) & (s["j"] == 0)  # noqa: E731  nothing has changed before it
    ends = lambda s: (s["i"] + s["n"] == whole_a) & (s["j"] + s["n"] == whole_b)

    def sides(s: Column) -> tuple[Column, Column, Column]:
        """Lines shown at the begin and the end of an equal block, and those left out: beside a change only."""
        head, tail = (F.when(at(s), F.lit(0)).otherwise(F.lit(context)) for at in (begins, ends))
        return head, tail, F.greatest(F.lit(0), s["n"] - head - tail)

    def signed(sign: str, lines: Column, at: Column, n: Column) -> Column:
        return F.transform(F.slice(lines, at + 1, n), lambda x: F.concat(F.lit(sign), x))

    def piece(s: Column, before: Column) -> Column:
        i, j = F.coalesce(before["i"] + before["n"], F.lit(0)), F.coalesce(before["j"] + before["n"], F.lit(0))
        head, tail, hidden = sides(s)
        mark = F.when(~begins(s) & ~ends(s), F.array(F.format_string(LEFT_OUT, hidden))).otherwise(F.array().cast("array<string>"))
        cut = F.concat(signed(" ", a, s["i"], head), mark, signed(" ", a, s["i"] + s["n"] - tail, tail))
        same = F.when(hidden > 0, cut).otherwise(signed(" ", a, s["i"], s["n"]))
        return F.concat(signed("-", a, i, s["i"] - i), signed("+", b, j, s["j"] - j), F.when(s["n"] > 0, same).otherwise(F.array().cast("array<string>")))

    hidden = F.aggregate(blocks, F.lit(0), lambda acc, s: acc + sides(s)[2])
    text = None if a is None else F.array_join(F.flatten(let(stops, lambda every: F.transform(every, lambda s, k: piece(s, F.get(every, k - 1))))), "\n")

    counts = {
        "lines_a": whole_a, "lines_b": whole_b, "additions": whole_b - took, "deletions": whole_a - took, "unchanged": took, "elided": hidden,
        "similarity": F.when(whole_a + whole_b > 0, F.round(2 * took / (whole_a + whole_b + F.lit(1e-9)), 3)).otherwise(F.lit(1.0)), "blocks": blocks,
    }
    shown = None if a is None else let(text, lambda whole: F.struct(F.substring(whole, 1, most).alias("preview"), (F.length(whole) + 1 > most).alias("truncated"), F.length(whole).alias("total_chars")))
    return counts, shown


def diff(df: DataFrame, a: str = "a", b: str = "b", context: int = 3, most: int = 12_000, preview: bool = True) -> DataFrame:
    """df with a struct column diff: numbers of lines, of additions, deletions, unchanged and elided lines, similarity (3
    places; 1.0 for two empty texts), a preview (changed lines, `context` equal lines beside them, a mark for those left
    out between two changes; `most` characters), whether it is truncated, the length of the whole of it, and the matching
    blocks. Without preview these three are left out of diff, and a and b of df: then texts are split where they are
    read, and only hashes of their lines are written."""
    rest = [F.col(f"`{c}`") for c in df.columns if preview or c not in (a, b)]
    row = F.struct(*rest) if rest else F.struct(F.lit(None).cast("int").alias("nothing"))
    keyed = df.select(F.monotonically_increasing_id().alias("pair"), row.alias("row"), hashed(lines_of(F.col(f"`{a}`"))).alias("a"), hashed(lines_of(F.col(f"`{b}`"))).alias("b"))
    keyed = checkpointed(keyed, "pairs")
    told = keyed.select("pair", "row", F.size("a").alias("lines_a"), F.size("b").alias("lines_b")).join(blocks_by_pair(keyed.select("pair", "a", "b")), "pair", "left")
    told = told.withColumn("blocks", F.coalesce("blocks", F.array().cast("array<struct<i:int,j:int,n:int>>")))
    if preview:
        told = told.withColumns({"a": lines_of(F.col(f"row.`{a}`")), "b": lines_of(F.col(f"row.`{b}`"))})
    texts = (F.col("a"), F.col("b")) if preview else (None, None)
    counts, shown = _told(F.col("lines_a"), F.col("lines_b"), F.col("blocks"), context, *texts, most)
    told = told.select("row", *([shown.alias("shown")] if preview else []), *(c.alias(n) for n, c in counts.items()))  # columns of their own: a query without the preview doesn't make it
    of_texts = ("shown.preview", "shown.truncated", "shown.total_chars") if preview else ()
    fields = ("lines_a", "lines_b", "additions", "deletions", "unchanged", "elided", "similarity", *of_texts, "blocks")
    return told.select(*(["row.*"] if rest else []), F.struct(*fields).alias("diff"))


def opcodes(blocks: Column, lines_a: Column, lines_b: Column) -> Column:
    """An array of (tag, i1, i2, j1, j2), the steps that make b from a, of sorted blocks and the numbers of lines."""
    stops = F.concat(blocks, F.array(F.struct(lines_a.alias("i"), lines_b.alias("j"), F.lit(0).alias("n"))))

    def steps(s: Column, k: Column) -> Column:
        before = F.get(stops, k - 1)
        i, j = F.coalesce(before["i"] + before["n"], F.lit(0)), F.coalesce(before["j"] + before["n"], F.lit(0))
        tag = F.when((i < s["i"]) & (j < s["j"]), "replace").when(i < s["i"], "delete").when(j < s["j"], "insert")
        step = lambda t, *at: F.struct(t.alias("tag"), *(x.alias(n) for x, n in zip(at, ("i1", "i2", "j1", "j2"), strict=True)))
        return F.filter(F.array(step(tag, i, s["i"], j, s["j"]), step(F.when(s["n"] > 0, "equal"), s["i"], s["i"] + s["n"], s["j"], s["j"] + s["n"])), lambda x: x["tag"].isNotNull())

    return F.flatten(F.transform(stops, steps))


def line_counts(a: str | Column, b: str | Column) -> Column:
    """struct<lines_a, lines_b, common>: the built-in bound on what a diff can keep (lines both texts hold)."""
    x, y = F.split(text_of(a), "\n"), F.split(text_of(b), "\n")
    return F.struct(F.size(x).alias("lines_a"), F.size(y).alias("lines_b"), F.size(F.array_intersect(x, y)).alias("common"))


def stem(path: str | Column) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    return F.lower(F.regexp_replace(F.regexp_extract(p, r"[^/\\]*$", 0), r"(?<=.)\.[^.]*$", ""))


def partners(files: DataFrame, others: DataFrame | None = None, since: float | None = None) -> DataFrame:
    """path_a, path_b: for each file (path, mtime) the newest other one of the same stem, then the first by path. A pair
    with a side older than `since` is left out; since must be a finite number."""
    if since is not None and not abs(since) < float("inf"):
        raise ValueError("since must be finite")
    a = files.select(stem("path").alias("_stem"), F.col("path").alias("path_a"), F.col("mtime").alias("mtime_a"))
    b = (others if others is not None else files).select(stem("path").alias("_stem"), F.col("path").alias("path_b"), F.col("mtime").alias("mtime_b"))
    w = Window.partitionBy("path_a").orderBy(F.desc("mtime_b"), "path_b")
    pairs = a.join(b, "_stem").where(F.col("path_a") != F.col("path_b")).withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    if since is not None:
        pairs = pairs.where((F.col("mtime_a") >= since) & (F.col("mtime_b") >= since) & ~F.isnan(F.col("mtime_a").cast("double")))
    return pairs.select("path_a", "path_b", "mtime_a", "mtime_b")
