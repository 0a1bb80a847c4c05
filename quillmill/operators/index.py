"""The artifact index: statistics, filters, search, keyset pages, upserts, duplicates, retention.

The functions take and give DataFrames; ArtifactIndex keeps them as a table of buckets with trigram postings beside it,
generation by generation: a write touches the buckets of its ids alone, and no file that a reader holds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.functions.text import cut, file_digest, grams_of, id_time, search_term, text_of
from quillmill.sources.segments import Segments
from quillmill.sources.tables import checkpointed, dropped

EXCERPT = 4096
SCHEMA = (
    "id string, source_name string, source_path string, source_size long, sha256 string, format string, parser string, file_type string, confidence double, enhance_reason string, quality_json string, "
    "chars long, elapsed_ms long, md_path string, json_path string, session_id string, status string, error_kind string, error_message string, starred boolean, excerpt string, "
    "created_at long, updated_at long, retired_at long, deleted_at long"
)


def live(df: DataFrame) -> DataFrame:
    return df.where(F.col("deleted_at").isNull())


def count_by(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """column, n; null counts as "?". top keeps the commonest."""
    out = live(df).groupBy(F.coalesce(F.col(column), F.lit("?")).alias(column)).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), column).limit(top) if top else out


def totals(df: DataFrame) -> DataFrame:
    """One row, one pass."""
    alive = F.col("deleted_at").isNull()
    return df.agg(
        F.count_if(alive).alias("total"), F.count_if(alive & F.col("retired_at").isNotNull()).alias("retired"), F.count_if(~alive).alias("deleted"),
        F.coalesce(F.sum(F.when(alive, F.col("chars"))), F.lit(0)).alias("chars"), F.coalesce(F.sum(F.when(alive, F.col("source_size"))), F.lit(0)).alias("bytes"),
        F.min(F.when(alive, F.col("created_at"))).alias("oldest"), F.max(F.when(alive, F.col("created_at"))).alias("newest"),
    )


def matches(term: str, name: str = "source_name", excerpt: str = "excerpt", ident: str | None = "id") -> Column:
    """Whether a term lies in the name, in the first 4,096 characters, or (as with short terms) in the id; signs such
    as % are themselves."""
    t = F.lower(F.lit(search_term(term)))
    hit = F.contains(F.lower(text_of(name)), t) | F.contains(F.lower(F.substring(text_of(excerpt), 1, EXCERPT)), t)
    return hit | F.contains(F.lower(text_of(ident)), t) if ident else hit


def query(
    df: DataFrame, q: str | None = None, fmt: str | None = None, parser: str | None = None, status: str | None = None, since: int | None = None,
    cursor: tuple[int, str] | None = None, limit: int = 50, include_deleted: bool = False,
) -> DataFrame:
    """A page of rows, newest first, with the column mode (list, like for terms under 3 characters, fts, or fts+like
    where only the id matches). The cursor is (created_at, id) of the last row of the page before; rows that tie with
    it are neither skipped nor repeated. limit is held within 1..500; a plan with a limit sorts only what it keeps."""
    out = df if include_deleted else live(df)
    for column, value in (("format", fmt), ("parser", parser), ("status", status)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if since is not None:
        out = out.where(F.col("created_at") >= since)
    term = search_term(q or "")
    mode: Column = F.lit("list")
    if len(term) >= 3:
        phrase = matches(term, ident=None)
        out = out.where(matches(term))
        mode = F.when(phrase, "fts").otherwise("fts+like")
    elif term:
        out, mode = out.where(matches(term)), F.lit("like")
    if cursor is not None:
        at, last = cursor
        out = out.where((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("id") > last)))
    return out.withColumn("mode", mode).orderBy(F.desc("created_at"), "id").limit(max(1, min(500, limit)))


def pages(df: DataFrame, size: int = 500, step: int = 3600) -> DataFrame:
    """All rows of a listing with their page (from 0), newest first as query() has them. Counts by step seconds give
    each step's first place, so ranks are taken within a step and no task sorts the whole listing."""
    step_of = F.floor(F.col("created_at") / step).alias("step")
    counts = df.groupBy(step_of).agg(F.count("*").alias("held"))  # one row for each step
    before = counts.select("step", (F.sum("held").over(Window.orderBy(F.desc("step"))) - F.col("held")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("step").orderBy(F.desc("created_at"), "id"))
    placed = df.withColumn("step", step_of).withColumn("rank", rank).join(before, "step")
    return placed.withColumn("page", F.floor((F.col("before") + F.col("rank") - 1) / size)).drop("step", "rank", "before")


def next_cursor(page: list, limit: int) -> tuple[int, str] | None:
    return (page[-1]["created_at"], page[-1]["id"]) if len(page) >= limit else None


def searched(name: str, excerpt: str) -> Column:
    """The text whose trigrams are posted."""
    return F.lower(F.concat_ws("\x1f", text_of(name), F.substring(text_of(excerpt), 1, EXCERPT)))


def postings(df: DataFrame) -> DataFrame:
    """gram, id: the trigrams of name and excerpt; candidates() meets them before the text is looked at."""
    return df.select("id", F.explode(grams_of(searched("source_name", "excerpt"))).alias("gram"))


def candidates(posted: DataFrame, term: str, n: int = 3) -> DataFrame:
    """ids that hold all n-grams of the term."""
    t = search_term(term).lower()
    grams = sorted({t[i : i + n] for i in range(len(t) - n + 1)})
    return posted.where(F.col("gram").isin(grams)).groupBy("id").agg(F.count_distinct("gram").alias("k")).where(F.col("k") == len(grams)).select("id")


def find_by_digest(df: DataFrame, digests: DataFrame | None = None) -> DataFrame:
    """The newest live row of each digest; digests (sha256) keeps those asked for."""
    d = live(df).where(F.col("sha256").isNotNull())
    d = d.join(digests.select("sha256").distinct(), "sha256", "left_semi") if digests is not None else d
    w = Window.partitionBy("sha256").orderBy(F.desc("created_at"), F.desc("id"))
    return d.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert(old: DataFrame, new: DataFrame, now: int, told: bool = False) -> DataFrame:
    """old with new's rows in place of those of the same id: an old digest stays where the new one is null, created_at
    and starred stay, retired_at and deleted_at are cleared. Of several new rows of one id the newest counts. told adds
    what the index's postings need: come, whether the row's text is new or another one, and was, the text before, if so."""
    w = Window.partitionBy("id").orderBy(F.desc("updated_at"), F.desc("created_at"))
    fresh = new.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    o, n = old.alias("o"), fresh.alias("n")
    both = o.join(n, F.col("o.id") == F.col("n.id"), "full_outer")
    is_new = F.col("n.id").isNotNull()

    def pick(c: str) -> Column:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in ("created_at", "starred"):
            v = F.coalesce(a, b)
        elif c == "sha256":
            v = F.when(is_new, F.coalesce(b, a)).otherwise(a)
        elif c in ("retired_at", "deleted_at"):
            v = F.when(is_new, F.lit(None)).otherwise(a)
        elif c == "updated_at":
            v = F.when(is_new, F.lit(now)).otherwise(a)
        else:
            v = F.when(is_new, b).otherwise(a)
        return v.cast(old.schema[c].dataType).alias(c)

    known = F.col("o.id").isNotNull()
    was = F.when(known, searched("o.source_name", "o.excerpt"))
    come = is_new & (~known | (was != searched("n.source_name", "n.excerpt")))
    return both.select(*map(pick, old.columns), *([come.alias("come"), F.when(come, was).alias("was")] if told else []))


def mark(df: DataFrame, ids: DataFrame, column: str, value: int | None) -> DataFrame:
    """deleted_at or retired_at set (or, with None, cleared) for the ids."""
    hit = ids.select(F.col("id").alias("_id"), F.lit(True).alias("_hit")).distinct()
    out = df.join(hit, F.col("id") == F.col("_id"), "left")
    return out.withColumn(column, F.when(F.col("_hit"), F.lit(value)).otherwise(F.col(column)).cast("long")).select(*df.columns)


def vanished(df: DataFrame, files: DataFrame, path: str = "source_path") -> DataFrame:
    """ids of live rows whose file is in no listing: an anti-join."""
    return live(df).where(F.col("retired_at").isNull()).join(files.select(F.col("path").alias(path)), path, "left_anti").select("id")


def retention(df: DataFrame, now: int, days: int = 7, most_bytes: int = 500 << 20) -> DataFrame:
    """ids to retire: older than days, then the oldest until the rest fits in most_bytes. The running total is made of
    three: of the days after a row's day (a row a day in one window), of the seconds after its second within the day, and
    of the ids before it within the second. No window holds more than a day's seconds or a second's artifacts."""
    d = live(df).where(F.col("retired_at").isNull()).select("id", "created_at", F.coalesce("source_size", F.lit(0)).alias("size"))
    old = d.where(F.col("created_at") < now - days * 86_400)
    kept = d.where(F.col("created_at") >= now - days * 86_400).withColumn("day", F.floor(F.col("created_at") / 86_400))
    seconds = kept.groupBy("day", "created_at").agg(F.sum("size").alias("held"))
    by_day = seconds.groupBy("day").agg(F.sum("held").alias("held"))
    later = by_day.select("day", (F.sum("held").over(Window.orderBy(F.desc("day"))) - F.col("held")).alias("later"))
    within = F.sum("held").over(Window.partitionBy("day").orderBy(F.desc("created_at"))) - F.col("held")
    newer = seconds.withColumn("within", within).join(later, "day").select("created_at", (F.col("within") + F.col("later")).alias("newer"))
    same = F.sum("size").over(Window.partitionBy("created_at").orderBy(F.desc("id")))
    lru = kept.join(newer, "created_at").withColumn("upto", F.col("newer") + same).where(F.col("upto") > most_bytes)
    return old.select("id", F.lit("ttl").alias("reason")).union(lru.select("id", F.lit("lru").alias("reason")))


def resolve(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (ref) with the id that it names: the id itself, else an id's start (4 characters or more), else a file name
    (case apart), else the newest row whose excerpt holds it (case apart). Each step looks only for what the steps before
    left, and each is a join on equal keys: a start is one of the lengths that refs have, and for pieces of text see
    _holding()."""
    d = live(df)
    newest = lambda rows, how: rows.groupBy("ref").agg(F.max_by("id", F.struct("created_at", "id")).alias("id")).withColumn("how", F.lit(how))
    left = checkpointed(wanted.where(F.col("ref").isNotNull()).select("ref").distinct(), "refs")
    sizes = sorted({r[0] for r in left.select(F.length("ref")).distinct().collect() if 4 <= r[0] <= LONGEST_ID})  # bounded by LONGEST_ID
    ids = d.select("id", "created_at")
    begun = ids.select("id", "created_at", F.explode(F.array(*(F.when(F.length("id") > n, F.substring("id", 1, n)) for n in sizes)) if sizes else F.array().cast("array<string>")).alias("ref")).where(F.col("ref").isNotNull())
    steps = [("exact", lambda: left.join(ids.withColumn("ref", F.col("id")), "ref")), ("prefix", lambda: left.join(begun, "ref"))]
    steps.append(("name", lambda: left.withColumn("_n", F.lower("ref")).join(d.select("id", "created_at", F.lower("source_name").alias("_n")), "_n")))
    steps.append(("content", lambda: _holding(left, d)))
    found = None
    for how, rows in steps:
        hit = checkpointed(newest(rows(), how), "hits")
        found = hit if found is None else found.unionByName(hit)
        left = left.join(hit.select("ref"), "ref", "left_anti")
    return found


LONGEST_ID = 64


FILTER_BITS = 24


def _anchor_places(code: np.ndarray, size: int) -> np.ndarray:
    """For each run of `size` (a power of two) characters its place among 2 ** FILTER_BITS."""
    h, k = (code.astype(np.uint64) + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15), 1
    while k < size:
        h = h[:-k] * np.uint64(0xBF58476D1CE4E5B9) + (h[k:] ^ (h[k:] >> np.uint64(29)))
        k *= 2
    return ((h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - FILTER_BITS)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _contexts(texts: DataFrame, sizes: list[int], passed: np.ndarray, most: int = 200_000) -> DataFrame:
    """q, context, id, created_at of texts (id, created_at, _t): for each size q the runs of 2 q - 1 characters (fewer at
    a text's end) whose first q have a place that is passed, each with the newest of a task's rows that hold it."""
    packed = np.packbits(passed)

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("q", pa.int32()), ("context", pa.string()), ("id", pa.string()), ("created_at", pa.int64())])
        held, passed = {}, np.unpackbits(packed).view(bool)

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array([q for q, _ in held], pa.int32()), pa.array([c for _, c in held], pa.string()), pa.array([v[2] for v in held.values()], pa.string()), pa.array([v[1] if v[0] else None for v in held.values()], pa.int64())], schema=schema)
            held.clear()
            return batch

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_A_BLOCK):
                rows = zip(*(c.to_pylist() for c in batch.slice(at, ROWS_A_BLOCK).columns), strict=True)
                rows = sorted((((c is not None, c or 0, i), t) for i, c, t in rows if t), reverse=True)  # the newest first
                if not rows:
                    continue
                code, n = _codes("".join(t for _, t in rows)), np.array([len(t) for _, t in rows])
                who, begin = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
                for q in sizes:
                    if len(code) < q:
                        continue
                    hit = np.flatnonzero(passed[_anchor_places(code, q)] & (who[: len(code) - q + 1] == who[q - 1 :]))
                    if q <= 2:  # few different ones: each once, with its first place
                        key = code[hit].astype(np.int64) + 1
                        for k in range(1, 2 * q - 1):
                            there = np.minimum(hit + k, len(code) - 1)
                            key = key << 21 | np.where((hit + k < len(code)) & (who[there] == who[hit]), code[there].astype(np.int64) + 1, 0)
                        hit = hit[np.unique(key, return_index=True)[1]]
                    for r, i in zip(who[hit].tolist(), (hit - begin[who[hit]]).tolist(), strict=True):
                        newest, text = rows[r]
                        key = (q, text[i : i + 2 * q - 1])
                        if key not in held or held[key] < newest:
                            held[key] = newest
                    if len(held) > most:
                        yield out()
        if held:
            yield out()

    return texts.mapInArrow(run, "q int, context string, id string, created_at long")


def _holding(refs: DataFrame, rows: DataFrame) -> DataFrame:
    """ref, id, created_at: of the rows whose excerpt holds a ref the newest ones, the newest of all among them. A ref's
    anchor is as many of its first characters as the largest power of two that it is long, so a ref lies in the 2 q - 1
    characters from its anchor on. One pass over the texts finds the places of anchors by a filter of fixed size (which
    may pass others) and sends each context once a task; contexts and refs are joined by their anchors, and the ref must
    begin the context. So no text leaves its task, however many refs it holds."""
    q = F.expr("shiftleft(1, length(bin(length(_r))) - 1)")
    asked = refs.where("ref <> ''").withColumn("_r", F.lower("ref")).withColumn("q", q).withColumn("anchor", F.substring("_r", F.lit(1), F.col("q")))

    def places(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(_anchor_places(_codes(a), q)[0]) for q, a in zip(*(c.to_pylist() for c in b.columns), strict=True)], pa.int32())], names=["place"])

    words = asked.select("q", "anchor").mapInArrow(places, "place int").groupBy(F.shiftright("place", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, place & 63))").alias("bits")).toArrow()  # 2 ** 18 rows at most
    bits = np.zeros(1 << FILTER_BITS - 6, np.int64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy()
    sizes = sorted(r[0] for r in asked.select("q").distinct().collect())  # a number for each power of two at most
    passed = np.unpackbits(bits.astype("<i8").view(np.uint8), bitorder="little").view(bool)
    texts = rows.where(F.col("id").isNotNull()).select("id", F.col("created_at").cast("long").alias("created_at"), F.lower(text_of("excerpt")).alias("_t"))
    met = _contexts(texts, sizes, passed).groupBy("q", "context").agg(F.max(F.struct("created_at", "id")).alias("newest"))
    met = met.withColumn("anchor", F.substring("context", F.lit(1), F.col("q")))
    return asked.join(met, ["q", "anchor"]).where(F.startswith("context", "_r")).select("ref", "newest.id", "newest.created_at")


def sibling_sources(artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """id, path: the first file (by name) of each artifact's stem."""
    stem = lambda c: F.lower(F.regexp_replace(F.regexp_extract(c, r"[^/\\]*$", 0), r"\.[^.]*$", ""))
    by = files.groupBy(stem("path").alias("_stem")).agg(F.min("path").alias("path"))
    return artifacts.select("id", stem("source_name").alias("_stem")).join(by, "_stem").select("id", "path")


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Protocol files (JSON, one for each artifact) as index rows; what isn't a valid artifact is left out: ok is true,
    the content is text, and there is an id."""
    schema = "ok boolean, code int, data struct<content:string,format:string,meta:struct<parser:string,file_size:long,result_id:string,confidence:double,elapsed_ms:long,file_name:string,file_type:string>>, error struct<kind:string,message:string>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("json_path", F.col("_metadata.file_path"))
    good = raw.where(F.col("ok") & F.col("data.content").isNotNull() & (text_of("data.meta.result_id") != ""))
    at = F.unix_timestamp(id_time("data.meta.result_id"))
    known = {
        "id": F.col("data.meta.result_id"), "source_name": F.coalesce("data.meta.file_name", F.regexp_extract("json_path", r"([^/]*?)(?:\.json)?$", 1)), "source_size": F.col("data.meta.file_size"),
        "format": F.col("data.format"), "parser": F.col("data.meta.parser"), "file_type": F.col("data.meta.file_type"), "confidence": F.col("data.meta.confidence"), "elapsed_ms": F.col("data.meta.elapsed_ms"),
        "chars": F.length("data.content").cast("long"), "excerpt": F.substring("data.content", 1, EXCERPT), "status": F.lit("completed"), "json_path": F.col("json_path"),
        "created_at": F.coalesce(at, F.unix_timestamp()), "updated_at": F.coalesce(at, F.unix_timestamp()), "starred": F.lit(False),
    }
    fields = [x.rsplit(" ", 1) for x in SCHEMA.split(", ")]
    return good.select(*(known.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields))


def client_view(df: DataFrame) -> DataFrame:
    """Rows as clients see them: times as timestamps, the excerpt short."""
    time = lambda c: F.timestamp_seconds(c).alias(c)
    return df.select("id", F.col("source_name").alias("name"), "format", "parser", "status", "confidence", "chars", F.col("source_size").alias("size"), cut("excerpt", 200).alias("preview"), time("created_at"), time("updated_at"))


def preferences(given: dict[str, str]) -> dict[str, str]:
    """The known settings; page sizes are held within 10..500."""
    known = {"page_size", "view", "sort", "theme", "language"}
    out = {k: v for k, v in given.items() if k in known}
    if "page_size" in out:
        out["page_size"] = str(max(10, min(500, int(out["page_size"]))))
    return out


def bucket_of(column: str | Column, buckets: int) -> Column:
    """A number below buckets, the same one that crc32 gives anywhere."""
    return F.pmod(F.crc32(F.col(column) if isinstance(column, str) else column), F.lit(buckets)).cast("int")


POSTING = "gram string, field int, sign int, numbers array<int>"
ROWS_A_TASK, ROWS_A_BLOCK = 4096, 1024


def number_of(ident: str = "id") -> Column:
    """The number that stands for an id in postings: its crc32 less 2^31. Ids that share one are told apart by looking."""
    return (F.crc32(F.col(ident)) - F.lit(1 << 31)).cast("int")


def gram_places(texts: list[str], start: int = 0) -> list[tuple[list[str], np.ndarray, np.ndarray]]:
    """The distinct trigrams of texts, where each one's list ends, and the lists: places (from start on) of the texts
    that hold it. More than one part only if the texts have very many different characters."""
    n = len(texts)
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    if len(code) < 3:
        return []
    seen = np.zeros(int(code.max()) + 1, bool)
    seen[code] = True
    signs = np.flatnonzero(seen)
    k = len(signs)
    if k > 100_000 and n > 1:  # keys below must stay under 2^63
        return gram_places(texts[: n // 2], start) + gram_places(texts[n // 2 :], start + n // 2)
    at = (np.cumsum(seen) - 1)[code]
    who = np.repeat(np.arange(n), np.fromiter(map(len, texts), np.int64, n))
    key = ((at[:-2] * k + at[1:-1]) * k + at[2:]) * n + who[2:]
    key = np.sort(key[who[:-2] == who[2:]])
    if not len(key):
        return []
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    gram = key // n
    ends = np.append(np.flatnonzero(gram[1:] != gram[:-1]) + 1, len(gram))
    first = gram[ends - 1]
    spelt = signs[np.stack([first // (k * k), first // k % k, first % k], 1)].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [([spelt[i : i + 3] for i in range(0, len(spelt), 3)], ends, key % n + start)]


def changed_postings(rows: DataFrame) -> DataFrame:
    """POSTING of rows with come and was: the trigrams of name and excerpt (field 0) that a row begins or ceases to hold,
    and those of the id (field 1) of a row that is new. One Arrow pass; a gram's rows are those of a block of rows."""
    ident = F.when(F.col("was").isNull(), F.lower(text_of("id")))
    texts = rows.where("come").select(number_of().alias("number"), searched("source_name", "excerpt").alias("now"), "was", ident.alias("ident"))

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("gram", pa.string()), ("field", pa.int32()), ("sign", pa.int32()), ("numbers", pa.list_(pa.int32()))])

        def posted(field, sign, texts, number):
            for grams, ends, places in gram_places([t or "" for t in texts]):
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(number[places], pa.int32()))
                same = lambda v: pa.array(np.full(len(grams), v, np.int32))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), same(field), same(sign), lists], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_A_BLOCK):
                part = batch.slice(at, ROWS_A_BLOCK)
                number, (now, was, ident) = part.column(0).to_numpy(), (part.column(i).to_pylist() for i in (1, 2, 3))
                yield from posted(0, 1, now, number)
                yield from posted(0, -1, was, number)
                yield from posted(1, 1, ident, number)

    return texts.mapInArrow(run, POSTING)


class ArtifactIndex:
    """The index as a folder of segments (see sources/segments.py). Rows lie in buckets by their id, trigram postings in
    buckets by their gram: a posting names a gram and the numbers (see number_of) of the rows of one block that hold it,
    so postings are a few bytes for each row and gram. A batch rewrites the row buckets of its ids and appends the
    postings of the texts that it changes to the gram buckets: with the sign 1 for what a text holds and -1 for what the
    text before it held; a row holds a gram where its signs add up to more than 0. A gram bucket of more than
    most_segments segments is folded into one with the next batch that touches it. Rows and postings of a generation are
    committed together. Joins are split by the number of rows and buckets by their size, so tasks don't grow with the
    index.

    A batch may carry (writer, number): one whose number is not above the writer's last is left out, so a batch that is
    written again changes nothing. Two writers at once: the later commit raises Conflict and has changed nothing."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, gram_buckets: int = 32, most_segments: int = 8):
        self.spark, self.files, self.most_segments = spark, Segments(spark, path), most_segments
        self._new = {"generation": 0, "buckets": buckets, "gram_buckets": gram_buckets, "rows": {}, "grams": {}, "applied": {}}

    def _now(self) -> dict:
        return self.files.manifest() or self._new

    def _rows(self, m: dict, buckets: list[int] | None = None) -> DataFrame:
        return self.files.read([s for b, s in sorted(m["rows"].items()) if buckets is None or int(b) in buckets], SCHEMA)

    def _postings(self, m: dict, buckets: list[int] | None = None) -> DataFrame:
        """gram, field, number."""
        held = [s for b, of in sorted(m["grams"].items()) if buckets is None or int(b) in buckets for s in of]
        signs = self.files.read(held, POSTING).select("gram", "field", "sign", F.explode("numbers").alias("number"))
        return signs.groupBy("gram", "field", "number").agg(F.sum("sign").alias("sign")).where("sign > 0").drop("sign")

    def rows(self) -> DataFrame:
        return self._rows(self._now())

    def postings(self) -> DataFrame:
        """gram, field, id: also of ids that share a number with one that holds the gram."""
        m = self._now()
        return self._postings(m).join(self._rows(m).select(number_of().alias("number"), "id"), "number").select("gram", "field", "id")

    def get(self, ident: str) -> DataFrame:
        """The row of an id: reads its bucket only."""
        m = self._now()
        return self._rows(m, self._buckets(self.spark.range(1).select(F.lit(ident).alias("id")), m)).where(F.col("id") == ident)

    @staticmethod
    def _buckets(ids: DataFrame, m: dict) -> list[int]:
        return [r[0] for r in ids.select(bucket_of("id", m["buckets"]).alias("b")).distinct().collect()]  # a number for each bucket at most

    def _commit(self, m: dict, kind: str, now: int | None, rows: dict | None = None, grams: dict | None = None, applied: tuple[str, int] | None = None) -> None:
        after = dict(m, generation=m["generation"] + 1, kind=kind, at=now, touched=sorted(map(int, rows or {})))
        after["rows"] = m["rows"] | (rows or {})
        after["grams"] = m["grams"] | (grams or {})
        after["applied"] = m["applied"] | ({applied[0]: applied[1]} if applied else {})
        self.files.commit(after)

    def upsert(self, new: DataFrame, now: int, batch: tuple[str, int] | None = None) -> bool:
        """Whether anything was written: not if the batch has been applied before, or is empty."""
        m = self._now()
        if batch and m["applied"].get(batch[0], -1) >= batch[1]:
            return False
        new = checkpointed(new, "batch")
        touched = self._buckets(new, m)
        if not touched:
            return False
        old = self._rows(m, touched)
        tasks = -(-(old.count() + new.count()) // ROWS_A_TASK)
        merged = upsert(old.repartition(tasks, "id"), new.repartition(tasks, "id"), now, told=True)
        rows = self.files.write(merged.withColumn("bucket", bucket_of("id", m["buckets"])), "bucket", "rows")
        change = changed_postings(self.files.read([s for _, s in sorted(rows.items())], f"{SCHEMA}, come boolean, was string"))
        change = self.files.write(change.withColumn("bucket", bucket_of("gram", m["gram_buckets"])), "bucket", "grams")
        grams = {b: [*m["grams"].get(b, []), s] for b, s in change.items()}
        self._commit(m, "upsert", now, rows, self._folded(dict(m, rows=m["rows"] | rows), grams, self.most_segments), batch)
        dropped(new)
        return True

    def _folded(self, m: dict, grams: dict[str, list[str]], most: int) -> dict[str, list[str]]:
        """grams with one segment in place of more than `most`."""
        full = {b: s for b, s in grams.items() if len(s) > most}
        if not full:
            return grams
        blocks = max(1, self._rows(m).count() // ROWS_A_TASK)
        held = self._postings({"grams": full}).groupBy("gram", "field", F.pmod("number", F.lit(blocks)).alias("block")).agg(F.collect_list("number").alias("numbers"))
        held = held.select("gram", "field", F.lit(1).alias("sign"), "numbers", bucket_of("gram", m["gram_buckets"]).alias("bucket"))
        made = self.files.write(held, "bucket", "grams")
        return grams | {b: [made[b]] if b in made else [] for b in full}

    def _mark(self, ids: DataFrame, column: str, value: int | None, kind: str) -> None:
        m = self._now()
        ids = checkpointed(ids.select("id").distinct(), "ids")
        touched = self._buckets(ids, m)
        marked = mark(self._rows(m, touched), ids, column, value).withColumn("bucket", bucket_of("id", m["buckets"]))
        self._commit(m, kind, value, self.files.write(marked, "bucket", "rows"))
        dropped(ids)

    def delete(self, ids: DataFrame, now: int) -> None:
        self._mark(ids, "deleted_at", now, "delete")

    def undelete(self, ids: DataFrame) -> None:
        self._mark(ids, "deleted_at", None, "undelete")

    def retire(self, ids: DataFrame, now: int) -> None:
        self._mark(ids, "retired_at", now, "retire")

    def prune(self, files: DataFrame, now: int) -> None:
        self.retire(vanished(self.rows(), files), now)

    def reindex(self, path: str, now: int) -> dict[str, int]:
        scanned = self.spark.read.format("binaryFile").load(path).count()
        found = read_artifacts(self.spark, path)
        n = found.count()
        self.upsert(found, now)
        return {"scanned": scanned, "indexed": n, "skipped": scanned - n}

    def found(self, term: str) -> DataFrame:
        """Rows that hold all trigrams of a term in their name and excerpt, or in their id (and rows that share a number
        with one of these). Reads the gram buckets of the term's grams, and of the rows the buckets that these name."""
        m = self._now()
        t = F.lower(F.lit(search_term(term)))
        asked = self.spark.range(1).select(F.explode(grams_of(t)).alias("gram")).select("gram", bucket_of("gram", m["gram_buckets"]).alias("b")).collect()  # the term's own
        held = self._postings(m, [r.b for r in asked]).where(F.col("gram").isin([r.gram for r in asked]))
        found = held.groupBy("field", "number").agg(F.count("*").alias("k")).where(F.col("k") == len(asked)).select("number").distinct()
        found = checkpointed(found, "found")
        named = found.select(F.pmod(F.col("number") + F.lit(1 << 31), F.lit(m["buckets"])).cast("int").alias("b")).distinct()
        rows = self._rows(m, [r.b for r in named.collect()])  # a number for each bucket at most
        return rows.join(found, number_of() == F.col("number"), "left_semi")

    def search(self, term: str) -> DataFrame:
        """All live rows that hold a term (three characters or more), with their mode."""
        return live(self.found(term)).where(matches(term)).withColumn("mode", F.when(matches(term, ident=None), "fts").otherwise("fts+like"))

    def query(self, q: str | None = None, **options) -> DataFrame:
        """A page as query() gives it; terms of three characters and more go by the postings."""
        return query(self.found(q) if q and len(search_term(q)) >= 3 else self.rows(), q=q, **options)

    def events(self) -> DataFrame:
        """generation, kind, at and touched (numbers of row buckets): one row for each commit that is still kept."""
        return self.spark.read.schema("generation long, kind string, at long, touched array<int>").json(f"{self.files.path}/manifests").where("generation is not null")

    def backup(self, path: str) -> None:
        self.rows().write.parquet(path)

    def vacuum(self, keep: int = 1) -> None:
        """Folds all postings and deletes what only older generations hold."""
        m = self._now()
        grams = self._folded(m, m["grams"], 1)
        if grams != m["grams"]:
            self._commit(m, "vacuum", None, grams=grams)
        self.files.sweep(keep, lambda k: [*k["rows"].values(), *(s for of in k["grams"].values() for s in of)])


def new_row(df: DataFrame, content: str, name: str, size: str) -> DataFrame:
    """df with id, digest and excerpt as the index wants them."""
    return df.withColumn("id", F.concat(F.lit("cvt"), F.date_format(F.current_timestamp(), "yyyyMMddHHmmss"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 6))).withColumn("sha256", file_digest(content)).withColumn("source_name", F.col(name)).withColumn("source_size", F.col(size))

