"""Quality rules: a threshold table compiled into one projection of built-in functions.

RULES is the table: a name, what is divided by what (both measures of the text), and the least and largest percentage
that a kept text has. rule_columns() turns it into one boolean a row of the table; a text is kept when it passes the base
conditions (words enough, not mostly repeated word windows) and all rules. Everything is whole-number arithmetic on
counts, so no verdict hangs on rounding. There is no shuffle, no user function and no state: one pass over the text, with
the columns of the table alone read.

Words are runs of characters other than U+0020 and U+0009 to U+000D. Repeated windows are found by sorting the hashes of
a text's windows, each packed with its place into one long; hits are compared word by word, and a text in which two
different windows share a hash (or of more than 2^PLACE_BITS words) is done again with the windows themselves, so counts
are exact. Stop words count as they are listed, capitalised or in capitals.

A null or empty text has no words: its counts are 0 and it fails the base conditions. Very long texts are handled whole,
within one row. Rows are judged each by itself, so ties and repeated rows get equal results, a null id keeps its row, and
an empty table gives an empty one. Only the id and the text are read: other columns, whatever their names, don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.common import table

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW, PLACE_BITS = 3, 24
LEAST_WORDS, MOST_REPEATED = 50, 50

# Function words of the four languages of the corpus.
STOP_WORDS = (
    "the of to a and in is that it was for on be with have as at by from or an are this not he they you "
    "der die das und ist zu den von mit ein eine im auf für nicht sich es dem des auch "
    "le la les de et un une en que qui du est au dans pour pas par sur "
    "el los las y del con por se su no lo una al más como"
).split()


class Rule(NamedTuple):
    name: str
    part: str  # a measure
    whole: str  # the measure it is divided by
    least: int | None  # percent
    most: int | None


RULES = (
    Rule("word_length", "word_chars", "n_words", 300, 1000),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("exclamations", "n_exclaims", "n_words", None, 20),
    Rule("stop_words", "n_stop_words", "n_words", 5, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 50),
    Rule("bullet_lines", "n_bullets", "n_lines", None, 90),
    Rule("ellipsis_lines", "n_ellipses", "n_lines", None, 30),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda's variable is a value, while a column used twice is an expression
    that may be computed twice (for each element, if it is used within another lambda)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def held_of(text: Column, signs: str) -> Column:
    """Number of characters of text that are one of the signs."""
    return F.length(text) - F.length(F.replace(text, F.lit(signs), F.lit("")) if len(signs) == 1 else F.regexp_replace(text, f"[{signs}]+", ""))


def covered(starts: Column) -> Column:
    """Number of places in windows that begin at the places `starts` (sorted)."""
    ahead = F.transform(starts, lambda x, i: F.least(F.coalesce(F.get(starts, i + 1) - x, F.lit(WINDOW).cast("long")), F.lit(WINDOW).cast("long")))
    return F.aggregate(ahead, F.lit(0).cast("long"), lambda a, x: a + x)


def repeated_words(words: Column) -> Column:
    """Words in windows of three that are found twice or more, the first of them included."""
    places, held = (1 << PLACE_BITS) - 1, F.size(words)
    begins = F.sequence(F.lit(0), held - WINDOW)
    window = lambda i: [F.get(words, i + k) for k in range(WINDOW)]
    place = lambda key: key.bitwiseAND(F.lit(places))
    alike = lambda x, y: F.shiftright(x, PLACE_BITS) == F.shiftright(y, PLACE_BITS)
    same_words = lambda x, y: F.concat_ws(" ", *window(place(x).cast("int"))) == F.concat_ws(" ", *window(place(y).cast("int")))
    beside = lambda of, same: F.filter(of, lambda x, i: same(x, F.get(of, i - 1)) | same(x, F.get(of, i + 1)))

    keys = F.sort_array(F.transform(begins, lambda i: F.xxhash64(*window(i)).bitwiseAND(F.lit(~places)).bitwiseOR(i.cast("long"))))
    plain = F.sort_array(F.transform(begins, lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("w"), i.cast("long").alias("i"))))
    exact = let(plain, lambda s: let(F.sort_array(F.transform(beside(s, lambda x, y: x["w"] == y["w"]), lambda x: x["i"])), covered))

    def quick(hits: Column) -> Column:
        mixed = F.exists(F.sequence(F.lit(1), F.size(hits) - 1), lambda i: alike(F.get(hits, i), F.get(hits, i - 1)) & ~same_words(F.get(hits, i), F.get(hits, i - 1)))
        return F.when(F.size(hits) == 0, F.lit(0).cast("long")).when(mixed, exact).otherwise(let(F.sort_array(F.transform(hits, place)), covered))

    some = F.when(held > places, exact).otherwise(let(keys, lambda k: let(beside(k, alike), quick)))
    return F.when(held < WINDOW, F.lit(0).cast("long")).otherwise(some)


def measures(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """A struct of counts, all long."""
    forms = sorted({f for w in stop_words for f in (w, w.capitalize(), w.upper())})
    long = lambda c: c.cast("long")

    def of_words(words: Column, lines: Column) -> Column:
        return F.struct(
            long(F.size(words)).alias("n_words"), long(F.length(F.array_join(words, ""))).alias("word_chars"), long(held_of(text, SYMBOLS)).alias("n_symbols"),
            long(held_of(text, "!")).alias("n_exclaims"), long(F.size(F.filter(words, lambda w: w.isin(forms)))).alias("n_stop_words"),
            long(F.size(lines)).alias("n_lines"), long(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
            long(F.size(F.filter(lines, lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•")))).alias("n_bullets"),
            long(F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…")))).alias("n_ellipses"),
            repeated_words(words).alias("n_repeat_words"),
        )

    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return let(words, lambda w: let(lines, lambda x: of_words(w, x)))


def rule_columns(m: Column, rules: Sequence[Rule] = RULES) -> list[Column]:
    """The table compiled: for each rule its name where the text breaks it, else null. A share of nothing breaks none."""
    out = []
    for rule in rules:
        part, whole = 100 * m[rule.part], m[rule.whole]
        broken = (part < rule.least * whole) if rule.least is not None else F.lit(False)
        if rule.most is not None:
            broken = broken | (part > rule.most * whole)
        out.append(F.when(broken, F.lit(rule.name)))
    return out


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, stop_words: Sequence[str] = STOP_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the measures, base_failed, broken (names of the rules that the text breaks, with commas) and kept."""
    m = F.col("m")
    counted = docs.select(F.col(id_col).alias("id"), measures(F.coalesce(F.col(text_col), F.lit("")), stop_words).alias("m"))
    failed = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"])
    broken = F.concat_ws(",", *rule_columns(m, rules))
    return counted.select("id", "m.*", failed.alias("base_failed"), broken.alias("broken"), (~failed & (broken == "")).alias("kept"))


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, stop_words: Sequence[str] = STOP_WORDS, text_col: str = "text") -> DataFrame:
    """docs that judge() keeps, all columns as they are."""
    verdict = judge(docs.select(F.struct("*").alias("id"), F.col(text_col).alias("text")), rules, stop_words, "id", "text")
    return verdict.where("kept").select("id.*")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = judge(table(spark, sf_dir, "documents"))
    return told.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop_words", "broken")


def sql_list(words: Sequence[str]) -> str:
    return ", ".join(f"'{f}'" for w in words for f in sorted({w, w.capitalize(), w.upper()}))


def sql_rule(rule: Rule) -> str:
    low = [f"100 * {rule.part} < {rule.least} * {rule.whole}"] if rule.least is not None else []
    return "CASE WHEN " + " OR ".join(low + ([f"100 * {rule.part} > {rule.most} * {rule.whole}"] if rule.most is not None else [])) + f" THEN '{rule.name}' END"


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS times FROM (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w))),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM t WHERE times > 1) GROUP BY 1),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
 length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclaims, len(list_filter(ws, lambda x: x IN ({sql_list(STOP_WORDS)}))) AS n_stop_words, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
 len(list_filter(ls, lambda x: ltrim(x, ' ')[1] IN ('-', '*', '•'))) AS n_bullets, len(list_filter(ls, lambda x: ends_with(rtrim(x, ' '), '...') OR ends_with(rtrim(x, ' '), '…'))) AS n_ellipses,
 coalesce(r.n, 0) AS n_repeat_words FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, concat_ws(',', {", ".join(map(sql_rule, RULES))}) AS broken FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND broken = '' AS kept, n_stop_words, broken FROM b
"""
