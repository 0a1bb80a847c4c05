"""Secret scans with corpus-wide ownership frequency.

Candidates are found in every whole text; each is hashed, and hashes are counted by distinct repositories, owners and
contexts (the 24 characters before a span) over the whole corpus. A value that several owners hold in several contexts
is a widely copied example; copies of one document, exact or near, give one context, however many owners hold them, so
they don't make a secret an example. Another value that looks like key material (several character classes, high
entropy, no placeholder wording) is live. The decision adds a span over the value itself, of kind live or example,
beside the base spans, which all stay.

Null texts count as empty and give no spans. Null owners or repositories count as one value of their own. Repeated
rows are scanned each; they share owner and context, so they don't make a value an example. Offsets are code points,
end exclusive. A null id keeps its row. Columns other than the named ones, whatever their names, don't matter. An empty
table gives an empty one.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.common import durable, map_batches, table

ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "live", "example")
PLACEHOLDER = re.compile(r"example|changeme|dummy|placeholder|sample|test|xxxx|your|1234|abcd|(.)\1{4}", re.I)


def looks_live(value: str) -> bool:
    """Key material: 16 or more characters of 2 classes at 2.5 bits or more each, or 8 or more of 3 classes."""
    if len(value) < 8 or PLACEHOLDER.search(value):
        return False
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    bits = -sum(c / len(value) * math.log2(c / len(value)) for c in Counter(value).values())
    return (len(value) >= 16 and classes >= 2 and bits >= 2.5) or (classes >= 3 and bits >= 2.5)


def scanner():
    """A function from a text to its base spans (kind's place in KINDS, start, end, value's start, value)."""
    assign, access, hexa = re.compile(ASSIGN, re.I | re.A), re.compile(ACCESS), re.compile(HEX[:-1] + "{24,}")

    def scan(text: str) -> list[tuple[int, int, int, int, str]]:
        out = []
        if "=" in text or ":" in text:
            out += [(0, m.start(), m.end(), m.start(2), m[2]) for m in assign.finditer(text) if m.end() - m.start(2) >= 6]
        if "AKIA" in text:
            out += [(1, m.start(), m.end(), m.start(), m[0]) for m in access.finditer(text) if m.end() - m.start() >= 20]
        out += [(2, m.start(), m.end(), m.start(), m[0]) for m in hexa.finditer(text)]  # a run is matched whole, so the bound can be in the pattern
        return sorted(out, key=lambda s: (s[1], s[0]))

    return scan


FOUND = "id long, owner string, repo string, text_hash long, copies long, spans array<struct<kind:int,start:int,end:int,at:int,hash:string,context:long,looks:boolean>>"


def candidates(docs: DataFrame, id_col="doc_id", text_col="text", owner_col="source", repo_col=None) -> DataFrame:
    """One row for each text that has base spans. A repository is named by its owner and repo_col (default: lang,
    where it exists)."""
    repo = repo_col or ("lang" if "lang" in docs.columns else owner_col)
    owner = F.coalesce(F.col(owner_col).cast("string"), F.lit("")) if owner_col in docs.columns else F.lit("")
    name = F.concat_ws("/", owner, F.coalesce(F.col(repo).cast("string"), F.lit(""))) if repo in docs.columns else owner

    def make():
        scan = scanner()

        def each(ids, texts, owners, repos, hashes):
            out = [[], [], [], [], [], []]
            for row in zip(ids, texts, owners, repos, hashes, strict=True):
                if row[1] and (found := scan(row[1])):
                    spans = [{"kind": k, "start": s, "end": e, "at": a, "hash": hashlib.sha256(v.encode()).hexdigest()[:32], "context": zlib.crc32(row[1][max(0, s - 24) : s].encode("utf-8", "surrogatepass")), "looks": looks_live(v)} for k, s, e, a, v in found]
                    for to, v in zip(out, (row[0], row[2], row[3], row[4], 1, spans), strict=True):
                        to.append(v)
            return out

        return each

    return map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col), owner, name, F.xxhash64(text_col)), FOUND, make)


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_repos, n_owners, n_contexts and n_spans over the whole corpus. Distinct (hash, repository, owner,
    context) come first, combined before the shuffle, so a value that a third of all documents hold sends one row for
    each task, repository and context."""
    each = found.select("repo", "owner", F.explode("spans").alias("s")).groupBy(F.col("s.hash").alias("hash"), "repo", "owner", F.col("s.context").alias("context")).agg(F.count("*").alias("n"))
    return each.groupBy("hash").agg(F.count_distinct("repo").alias("n_repos"), F.count_distinct("owner").alias("n_owners"), F.count_distinct("context").alias("n_contexts"), F.sum("n").alias("n_spans"))


def classify(docs: DataFrame, id_col="doc_id", text_col="text", owner_col="source", repo_col=None, example_owners: int = 3, example_contexts: int = 3, salts: int = 16) -> DataFrame:
    """id, text_hash and spans (kind, start, end, at, hash, looks, n_owners, n_repos, verdict: live, example or
    unsure) of each row that has spans."""
    found = durable(candidates(docs, id_col, text_col, owner_col, repo_col), "secrets")
    counts = ownership(found).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))  # a hot value's rows go to several tasks
    each = found.withColumn("row", F.xxhash64("id", "text_hash")).select("id", "text_hash", "row", F.posexplode("spans").alias("k", "s"))
    each = each.withColumn("hash", F.col("s.hash")).withColumn("salt", F.pmod("row", F.lit(salts)).cast("int"))
    verdict = F.when((F.col("n_owners") >= example_owners) & (F.col("n_contexts") >= example_contexts), "example").when(F.col("s.looks"), "live").otherwise("unsure")
    told = each.join(counts, ["hash", "salt"]).select("id", "text_hash", F.struct("s.*", "n_owners", "n_repos", verdict.alias("verdict")).alias("s"))
    return told.groupBy("id", "text_hash").agg(F.array_sort(F.array_distinct(F.collect_list("s"))).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", id_col="doc_id", text_col="text", **options) -> DataFrame:
    """docs with the values of live spans, and of unsure ones, replaced by mark; widely copied examples and all other
    text stay, and so do all rows and columns. n_chars, where there is one, follows the text."""
    told = classify(docs, id_col, text_col, **options)
    cut = F.array_sort(F.transform(F.filter("spans", lambda s: s["verdict"] != "example"), lambda s: F.struct(s["at"].alias("at"), s["end"].alias("end"))))
    told = told.select(F.col("id").alias("cut_id"), F.col("text_hash").alias("cut_hash"), cut.alias("cut")).where(F.size("cut") > 0)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"))  # a row is carried whole, so its names meet no others
    joined = rows.join(told, F.col("id").eqNullSafe(F.col("cut_id")) & F.col("hash").eqNullSafe(F.col("cut_hash")), "left")
    own = F.col("row").getField(text_col)
    # spans may overlap (a hex run within an assignment): the state keeps how far the text has been written
    text = F.aggregate(
        "cut",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("done")),
        lambda acc, c: F.when(c["end"] <= acc["done"], acc).otherwise(
            F.struct(
                F.concat(acc["out"], F.when(c["at"] >= acc["done"], F.concat(F.substring(own, acc["done"] + 1, c["at"] - acc["done"]), F.lit(mark))).otherwise(F.lit(""))).alias("out"),
                c["end"].alias("done"),
            )
        ),
        lambda acc: F.concat(acc["out"], F.substring(own, acc["done"] + 1, F.length(own))),
    )
    hit = F.col("cut").isNotNull()
    joined = joined.select("row", F.when(hit, text).otherwise(own).alias("text"), hit.alias("hit"))
    out = {c: F.col("row").getField(c) for c in docs.columns} | {text_col: F.col("text")}
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("hit"), F.length("text").cast("long")).otherwise(out["n_chars"])
    return joined.select(*(v.alias(c) for c, v in out.items()))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    told = classify(docs).select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), "spans")
    keys = docs.select("doc_id", F.xxhash64("text").alias("_hash"))
    rows = keys.join(told, F.col("doc_id").eqNullSafe(F.col("_id")) & (keys["_hash"] == told["_hash"]), "left").select("doc_id", F.coalesce("spans", F.array().cast(told.schema["spans"].dataType)).alias("s"))
    n = lambda k: F.size(F.filter("s", lambda s: s["kind"] == k)).cast("long")
    triple = lambda k, s, e: F.struct(s.alias("start"), k.cast("int").alias("kind"), e.alias("end"))
    base = F.array_sort(F.array_distinct(F.transform("s", lambda s: triple(s["kind"], s["start"], s["end"]))))
    more = F.transform(F.filter("s", lambda s: s["verdict"] != "unsure"), lambda s: triple(F.when(s["verdict"] == "live", 3).otherwise(4), s["at"], s["end"]))
    name = F.array(*(F.lit(k) for k in KINDS))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    rows = rows.select("doc_id", "s", base.alias("base"), F.array_sort(F.array_distinct(F.concat(base, more))).alias("every"))
    return rows.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.col("every")).alias("spans"),
        F.size(F.filter("s", lambda s: s["verdict"] == "live")).cast("long").alias("n_live"), F.size(F.filter("s", lambda s: s["verdict"] == "example")).cast("long").alias("n_example"),
    )
