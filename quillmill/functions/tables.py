"""Tables as array<array<string>> grids: splitting, padding, types, merged cells, alignment, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.text import col, escape_md_cell, text_of
from quillmill.schema import HEADER_WORDS

# Tags of yes and no; what counts as a number in a column.
BOOLEAN_WORDS = "true yes y 1 false no n 0".split()
NUMERIC_CELL = r"^[(\-+]?\s*[$€£¥￥]?\s*[\d,]+(?:\.\d+)?\s*[%％]?\)?$"


def delimiter_of_line(c: str | Column) -> Column:
    """What a line of a rendered table is split at: pipe, tab, comma, else two spaces."""
    t = text_of(c)
    return F.when(t.contains("|"), "|").when(t.contains("\t"), "\t").when(t.contains(","), ",").otherwise("  ")


def delimiter_of_text(c: str | Column, lines: int = 10, among: tuple[str, ...] = (",", "\t", ";", "|", ":")) -> Column:
    """The delimiter whose commonest count per line, times the lines that have it, is largest; the first of equals."""
    rows = F.slice(F.split(text_of(c), "\n"), 1, lines)

    def score(d: str) -> Column:
        counts = F.filter(F.transform(rows, lambda x: F.length(x) - F.length(F.replace(x, F.lit(d), F.lit("")))), lambda n: n > 0)
        often = lambda n: F.size(F.filter(counts, lambda m: m == n))
        most = F.array_max(F.transform(counts, often))
        first = F.get(F.filter(counts, lambda n: often(n) == most), F.lit(0))
        return F.coalesce(most * first, F.lit(0))

    scored = F.array(*(F.struct(score(d).alias("s"), F.lit(-i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(among)))
    best = F.array_max(scored)
    return F.when(best["s"] > 0, best["d"]).otherwise(",")


def pad(grid: Column) -> Column:
    """All rows as wide as the widest, filled with empty cells."""
    width = F.coalesce(F.array_max(F.transform(grid, F.size)), F.lit(0))
    return F.transform(grid, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))


def grid_of_text(c: str | Column) -> Column:
    """Rows of a rendered table: trimmed cells, separator lines dropped, padded."""
    t = text_of(c)
    by = delimiter_of_line(F.split(t, "\n")[0])
    lines = F.filter(F.split(t, "\n"), lambda x: (F.trim(x) != "") & ~x.rlike(r"^\s*\|?[\s:|-]*-[\s:|-]*\|?\s*$"))
    bare = F.transform(lines, lambda x: F.when(by == "|", F.regexp_replace(x, r"^\s*\||\|\s*$", "")).otherwise(x))
    quoted = F.concat(F.lit("\\Q"), by, F.lit("\\E"))
    return pad(F.transform(bare, lambda x: F.transform(F.split(x, quoted), lambda cell: F.trim(cell))))


def cell_type(values: Column) -> Column:
    """The type of a column's non-blank values."""
    v = F.filter(F.transform(values, lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    every = lambda p: F.forall(v, lambda x: x.rlike(p))
    return (
        F.when(F.size(v) == 0, "string")
        .when(every(r"^-?\d+$"), "integer")
        .when(every(r"^-?\d+(?:\.\d+)?$"), "float")
        .when(every(r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}$"), "date")
        .when(F.forall(v, lambda x: F.lower(x).isin(BOOLEAN_WORDS)), "boolean")
        .otherwise("string")
    )


def column_values(grid: Column, i: Column, first: int = 0, most: int | None = None) -> Column:
    rows = F.slice(grid, first + 1, most if most is not None else 1 << 30)
    return F.transform(rows, lambda r: F.get(r, i))


def infer_schema(grid: Column, sample: int = 20, header: bool = True) -> Column:
    """array<struct<name, type>> by up to 20 rows below the header."""
    head = F.get(grid, F.lit(0))
    n = F.coalesce(F.size(head), F.lit(0))
    name = lambda i: F.when(F.lit(header) & (F.trim(F.coalesce(F.get(head, i), F.lit(""))) != ""), F.trim(F.get(head, i))).otherwise(F.concat(F.lit("col_"), i.cast("string")))
    each = lambda i: F.struct(name(i).alias("name"), cell_type(column_values(grid, i, int(header), sample)).alias("type"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), each)).otherwise(F.array().cast("array<struct<name:string,type:string>>"))


def schema_summary(schemas: DataFrame, key: str, order: str, schema: str) -> DataFrame:
    """key with the columns (name and type) of all of its tables, each once, in the order in which tables first have
    them. Columns are met before the shuffle, so a key with many tables sends each of its columns once a task."""
    each = schemas.select(key, F.col(order).alias("_o"), F.posexplode(schema).alias("_i", "_c"))
    first = each.groupBy(key, F.col("_c").alias("_c")).agg(F.min(F.struct("_o", "_i")).alias("_at"))
    listed = F.array_sort(F.collect_list(F.struct("_at", "_c")))
    return first.groupBy(key).agg(F.transform(listed, lambda x: x["_c"]).alias("summary"))


def has_header(grid: Column) -> Column:
    """The first row is all text and the second holds a number, or the first names a usual column."""
    number = lambda x: F.trim(x).rlike(r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?$")
    first, second = F.get(grid, F.lit(0)), F.get(grid, F.lit(1))
    text = F.forall(first, lambda x: (F.trim(x) != "") & ~number(x))
    words = F.lower(F.array_join(first, " "))
    named = words.rlike("|".join(HEADER_WORDS))
    return F.when(F.coalesce(F.size(grid), F.lit(0)) < 2, False).otherwise((text & F.exists(second, number)) | named)


def is_numeric_column(values: Column) -> Column:
    v = F.filter(F.transform(values, lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    return (F.size(v) >= 2) & F.forall(v, lambda x: x.rlike(NUMERIC_CELL))


def numeric_column(cell: Column) -> Column:
    """is_numeric_column() as an aggregate over rows, one cell each."""
    v = F.trim(F.coalesce(cell, F.lit("")))
    return (F.count_if(v != "") >= 2) & F.coalesce(F.bool_and(F.when(v != "", v.rlike(NUMERIC_CELL))), F.lit(False))


def markdown(grid: Column) -> Column:
    """The grid as a Markdown table; numeric columns to the right."""
    g = pad(grid)
    head = F.get(g, F.lit(0))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    rule = F.transform(F.sequence(F.lit(0), F.size(head) - 1), lambda i: F.when(is_numeric_column(column_values(g, i, 1)), "---:").otherwise("---"))
    rows = F.transform(g, lambda r: line(F.transform(r, escape_md_cell)))
    whole = F.array_join(F.concat(F.slice(rows, 1, 1), F.array(line(rule)), F.slice(rows, 2, 1 << 30)), "\n")
    return F.when((F.coalesce(F.size(grid), F.lit(0)) > 0) & (F.size(head) > 0), whole).otherwise("")


def preview(grid: Column, rows: int = 5) -> Column:
    return F.slice(grid, 1, rows)


def empty_ratio(grid: Column) -> Column:
    cells = F.flatten(grid)
    return F.when(F.size(cells) > 0, F.size(F.filter(cells, lambda x: F.trim(F.coalesce(x, F.lit(""))) == "")) / F.size(cells)).otherwise(0.0)


def uniform(grid: Column) -> Column:
    return F.size(F.array_distinct(F.transform(grid, F.size))) <= 1


def fill_merged(grid: Column) -> Column:
    """struct<grid, merged>: a null cell takes the value above it where that row is as wide; blank text isn't null."""
    zero = F.struct(F.array().cast("array<array<string>>").alias("grid"), F.lit(0).alias("merged"))

    def step(acc: Column, row: Column) -> Column:
        above = F.element_at(acc["grid"], -1)
        fits = (F.size(acc["grid"]) > 0) & (F.size(F.when(F.size(acc["grid"]) > 0, above)) == F.size(row))
        full = F.when(fits, F.transform(row, lambda x, i: F.coalesce(x, F.get(above, i)))).otherwise(row)
        filled = F.when(fits, F.size(F.filter(F.sequence(F.lit(0), F.size(row) - 1), lambda i: F.get(row, i).isNull() & F.get(above, i).isNotNull()))).otherwise(0)
        return F.struct(F.concat(acc["grid"], F.array(full)).alias("grid"), (acc["merged"] + filled).alias("merged"))

    return F.aggregate(grid, zero, step)


def merged_runs(df: DataFrame, grid_col: str, *keys: str) -> DataFrame:
    """keys, col, row, rowspan, value: runs of two or more equal non-blank values down a column (gaps and islands)."""
    rows = df.select(*keys, F.posexplode(grid_col).alias("row", "_r")).select(*keys, "row", F.posexplode("_r").alias("col", "value"))
    w = Window.partitionBy(*keys, "col").orderBy("row")
    new = F.coalesce((F.lag("value").over(w) != F.col("value")) | F.lag("value").over(w).isNull(), F.lit(True))
    runs = rows.withColumn("_run", F.sum(new.cast("int")).over(w)).groupBy(*keys, "col", "_run")
    out = runs.agg(F.min("row").alias("row"), F.count("*").cast("int").alias("rowspan"), F.first("value").alias("value"))
    return out.where((F.col("rowspan") > 1) & (F.trim(F.coalesce("value", F.lit(""))) != "")).drop("_run")


def merged_spans(df: DataFrame, grid_col: str, *keys: str) -> DataFrame:
    """The same along a row: keys, row, col, colspan, value."""
    turned = merged_runs(df.withColumn(grid_col, F.transform(F.sequence(F.lit(0), F.greatest(F.size(F.get(grid_col, F.lit(0))) - 1, F.lit(0))), lambda i: F.transform(grid_col, lambda r: F.get(r, i)))), grid_col, *keys)
    return turned.select(*keys, F.col("col").alias("row"), F.col("row").alias("col"), F.col("rowspan").alias("colspan"), "value")


def merge_across_pages(df: DataFrame, doc: str, page: str, order: str, header: str, rows: str, similarity: float = 0.8, adjacent: bool = True) -> DataFrame:
    """Tables that go on over a page break, joined: doc, page, header, rows, n_parts. A table goes on where it is as
    wide as the one before it, stands first on the next page (unless adjacent=False), and repeats its header or has a
    first row of the same column types."""
    w = Window.partitionBy(doc).orderBy(page, order)
    d = df.withColumn("_width", F.size(header)).withColumn("_first", F.row_number().over(Window.partitionBy(doc, page).orderBy(order)) == 1)
    was = lambda c: F.lag(c).over(w)
    kinds = lambda h: F.transform(h, lambda x: cell_type(F.array(x)))
    same = (F.size(F.array_intersect(F.transform(header, F.lower), F.transform(was(header), F.lower))) >= similarity * F.col("_width"))
    d = d.withColumn("_kinds", kinds(F.col(header))).withColumn("_below", F.when(F.size(rows) > 0, kinds(F.element_at(rows, -1))))
    d = d.withColumn("_same", F.coalesce(same, F.lit(False))).withColumn("_alike", F.coalesce(F.col("_kinds") == was("_below"), F.lit(False)))
    near = (F.col(page) == was(page) + 1) & F.col("_first") if adjacent else F.lit(True)
    goes_on = F.coalesce((F.col("_width") == was("_width")) & near & (F.col("_same") | F.col("_alike")), F.lit(False))
    d = d.withColumn("_on", goes_on).withColumn("_group", F.sum((~F.col("_on")).cast("int")).over(w))
    own = F.when(F.col("_on") & ~F.col("_same"), F.concat(F.array(F.col(header)), F.col(rows))).otherwise(F.col(rows))
    parts = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col(order).alias("o"), F.col(header).alias("h"), own.alias("r"))))
    out = d.groupBy(doc, "_group").agg(parts.alias("_parts"))
    return out.select(doc, F.col("_parts")[0]["p"].alias("page"), F.col("_parts")[0]["h"].alias("header"), F.flatten(F.transform("_parts", lambda x: x["r"])).alias("rows"), F.size("_parts").alias("n_parts"))


def table_result(grid: Column) -> Column:
    """What the table strategy tells of one grid."""
    g = pad(grid)
    header = has_header(g)
    return F.struct(
        F.size(g).alias("rows"), F.coalesce(F.size(F.get(g, F.lit(0))), F.lit(0)).alias("cols"), header.alias("has_header"), F.get(g, F.lit(0)).alias("headers"),
        infer_schema(g).alias("schema"), preview(F.slice(g, 2, 1 << 30)).alias("preview_rows"), F.slice(g, 2, 1 << 30).alias("data"), markdown(g).alias("markdown"),
    )


def format_cells(c: str | Column) -> Column:
    """Numbers in their shortest form: integers plain, floats without trailing zeros (4 places; 6 significant digits
    where large or tiny); addresses, mail and full-width colons are left alone. An Arrow-batched function, because
    %.6g has no counterpart in SQL."""
    import pandas as pd

    def one(v):
        if v is None or "://" in v or "@" in v or "：" in v:
            return v
        s = v.strip()
        try:
            return str(int(s))
        except ValueError:
            pass
        try:
            x = float(s)
        except ValueError:
            return v
        if x != x or x in (float("inf"), float("-inf")):
            return v
        if x and (abs(x) >= 1e6 or abs(x) < 1e-4):
            return f"{x:.6g}"
        return str(int(x)) if x == int(x) else f"{x:.4f}".rstrip("0").rstrip(".")

    return F.pandas_udf(lambda s: pd.Series([one(v) for v in s], dtype=object), "string")(col(c))
