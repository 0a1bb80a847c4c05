import difflib
import random

import pytest
from pyspark.sql import functions as F

from quillmill.functions import quality, tables
from quillmill.functions import text as tx
from quillmill.operators import batch, chunk, convert, index, structure
from quillmill.streaming import inbox

ROW = "id string, source_name string, source_path string, source_size long, sha256 string, format string, parser string, status string, excerpt string, chars long, created_at long, updated_at long, retired_at long, deleted_at long, starred boolean"


def artifacts(spark, n=120):
    rng = random.Random(3)
    rows = [(f"a{i:04d}", f"name{i}.txt", f"/p/{i}", 100, f"h{i % 40}", None if i % 9 == 0 else "en", "p", "completed", f"text {i} 研发部 50% a_b", 5, rng.randrange(20), i, None, None if i % 10 else 7, i % 2 == 0) for i in range(n)]
    return spark.createDataFrame(rows, ROW)


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<array<string>>' if isinstance(v, list) else 'string'}" for k, v in values.items())).select(column).first()[0]


@pytest.mark.parametrize(("text", "score"), [("", 0), ("ends...", 70), ("a sentence that ends with the", 95), ("list: open (", 90), ("it was truncated here, sorry.", 85), ("fine and whole.", 100), ("one,\ntwo", 75)])
def test_completeness(spark, text, score):
    assert one(spark, quality.completeness_score("t"), t=text) == score


def test_scores_on_crafted_texts(spark):
    assert one(spark, quality.structure_score("t"), t="# h\n\n- a\n| a | b |") == 100 and one(spark, quality.structure_score("t"), t="x") == 0
    assert one(spark, quality.encoding_confidence("t"), t="Ã©" * 10) == 0 and one(spark, quality.encoding_confidence("t"), t="é plain") == 100
    assert one(spark, quality.text_evidence("t"), t="\x01\x02" * 50) == 0 and one(spark, quality.text_evidence("t"), t="ab1") == 1
    long = "ab" * 70_000
    assert one(spark, quality.text_evidence("t"), t=long) == 1 and one(spark, F.length(tx.stride_sample("t")), t=long) <= 65_536


def test_tables(spark):
    grid = [["name", "n"], ["a", "1"], ["a", "$2.50"], ["", "3%"]]
    assert one(spark, tables.markdown(F.col("g")), g=grid).split("\n")[1] == "| --- | ---: |"
    assert one(spark, quality.table_penalty(F.col("g")), g=[["a", ""], ["", ""], ["x"]]) == 20 + 15 + 5
    assert one(spark, tables.has_header(F.col("g")), g=[["x", "y"], ["1", "b"]]) and not one(spark, tables.has_header(F.col("g")), g=[["x", "y"]])
    filled = one(spark, tables.fill_merged(F.col("g")), g=[["部门", "值"], ["研发部", "120"], [None, "135"], ["", None]])
    assert filled.grid == [["部门", "值"], ["研发部", "120"], ["研发部", "135"], ["", "135"]] and filled.merged == 2
    assert one(spark, tables.grid_of_text("t"), t="| a | b |\n|---|---|\n| 1 |") == [["a", "b"], ["1", ""]]
    assert one(spark, tables.delimiter_of_text("t"), t="a;b;c\n1;2;3,4\n") == ";"
    got = spark.createDataFrame([("1e7",), ("0007",), ("1.50",), ("0.00001",), ("x@y",), (None,), ("2.0",)], "c string").select(tables.format_cells("c")).collect()
    assert [r[0] for r in got] == ["1e+07", "7", "1.5", "1e-05", "x@y", None, "2"]


def test_merged_runs_and_spans(spark):
    g = spark.createDataFrame([(1, [["a", "x"], ["a", "x"], ["b", "x"], ["", ""], ["", ""]])], "id int, g array<array<string>>")
    assert {(r.col, r.row, r.rowspan, r.value) for r in tables.merged_runs(g, "g", "id").collect()} == {(0, 0, 2, "a"), (1, 0, 3, "x")}
    h = spark.createDataFrame([(1, [["t", "t", "u"]])], "id int, g array<array<string>>")
    assert [(r.row, r.col, r.colspan) for r in tables.merged_spans(h, "g", "id").collect()] == [(0, 0, 2)]


def test_tables_over_pages(spark):
    rows = [(1, 1, 0, ["name", "n"], [["a", "1"]]), (1, 2, 0, ["name", "n"], [["b", "2"]]), (1, 3, 0, ["c", "3"], [["d", "4"]]), (1, 5, 0, ["e", "5"], [["f", "6"]]), (2, 1, 0, ["x", "y"], []), (2, 2, 0, ["only"], [])]
    d = spark.createDataFrame(rows, "doc int, page int, ord int, header array<string>, rows array<array<string>>")
    got = {(r.doc, r.page): (r.n_parts, r.rows) for r in tables.merge_across_pages(d, "doc", "page", "ord", "header", "rows").collect()}
    assert got[1, 1] == (3, [["a", "1"], ["b", "2"], ["c", "3"], ["d", "4"]]) and got[1, 5][0] == 1 and got[2, 1][0] == got[2, 2][0] == 1


def test_text_similarity(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abC 标") for _ in range(rng.randrange(12)))
    rows = [(word(), word()) for _ in range(60)] + [(None, "a"), ("", ""), ("A b", "aB"), ("name n", "name m")]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", tx.text_similarity("a", "b").alias("r")).collect()
    for r in got:
        x, y = ((t or "").lower().replace(" ", "") for t in (r.a, r.b))
        want = difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0
        assert r.r == want, (r.a, r.b)


@pytest.mark.parametrize(
    ("text", "out"),
    [
        (None, None),
        ("", ""),
        (" \n\t\n", ""),
        ("this line is\nbroken here.\nNew one", "this line is broken here.\n\nNew one"),
        ("one\n\n\ntwo", "one\n\ntwo"),
        ("- a\n- b\nrest of\nit", "- a\n\n- b\n\nrest of it"),
        ("a\tb\n c\t\td \n\nend", "a | b\nc |  | d\n\nend"),
        ("| a | b |\n| c | d |\nend", "a | b\nc | d\n\nend"),
        ("name  age\nbob  7", "name | age\nbob | 7"),
        ("text\nx  y", "text x  y"),
        ("标题\n一、甲\n二、乙", "标题\n\n一、甲\n\n二、乙"),
        ("# t\n²x", "# t\n\n²x"),
    ],
)
def test_ocr_paragraphs(spark, text, out):
    assert one(spark, tx.ocr_paragraphs("t"), t=text) == out


def test_text_functions(spark):
    assert one(spark, tx.escape_md_cell("t"), t="a|b\\|c\\\\|d\ne") == "a\\|b\\|c\\\\\\|d<br>e"
    assert one(spark, tx.slugify("t"), t=" A b.C 标题! ") == "a-bc-标题"
    assert one(spark, tx.id_time("t"), t="cvt20240102030405abcdef").year == 2024 and one(spark, tx.id_time("t"), t="nope") is None
    assert one(spark, tx.safe_message("t"), t="no /home/u/x/f.txt and C:\\a\\b.md") == "no f.txt and b.md"
    assert one(spark, tx.human_duration(F.lit(3725)), t="") == "1:02:05"
    assert one(spark, tx.format_output("t", "html"), t="<a>\n\nb") == "<div class='converted-content'><p>&lt;a&gt;</p><p>b</p></div>"
    assert one(spark, tx.inline_text("t"), t="**b** _i_ [l](u) ~~s~~ `c`") == "b i l s c"


@pytest.mark.parametrize("text", ["x" * 100, "ab\n" * 40, "p1\n\n" + "y" * 30 + "\n\nz" * 9, "f1\n\n---\n\nf2 " * 5, "", "日本\n" * 20])
def test_pages_cover_the_text(spark, text):
    pages, start = [], 0
    while start is not None:
        r = one(spark, tx.truncate_at("t", 25, start), t=text)
        assert tuple(r) == chunk.next_cut(text, 25, start) if start < len(text) else r.chunk == ""
        pages.append(r.chunk)
        start = r.next
    drop = lambda s: s.replace("\n", "").replace("---", "")
    assert drop("".join(pages)) == drop(text)
    d = chunk.truncate_pages(spark.createDataFrame([(1, text)], "doc_id int, text string"), 25)
    assert [r.chunk for r in d.orderBy("page").collect()] == (pages if text else [])


def test_index_pages_have_every_row_once(spark):
    rows, seen, cursor = artifacts(spark), [], None
    while True:
        page = index.query(rows, cursor=cursor, limit=7).collect()
        seen += [(r.created_at, r.id) for r in page]
        cursor = index.next_cursor(page, 7)
        if cursor is None:
            break
    want = sorted(((r.created_at, r.id) for r in rows.where("deleted_at is null").collect()), key=lambda x: (-x[0], x[1]))
    assert seen == want


def test_search_takes_signs_literally(spark):
    rows = artifacts(spark)
    assert index.query(rows, q="50%", limit=500).count() == index.query(rows, limit=500).count()
    assert index.query(rows, q="5_%").count() == 0 and index.query(rows, q="研发").first()["mode"] == "like" and index.query(rows, q="研发部").first()["mode"] == "fts"
    assert {r.mode for r in index.query(rows, q="a0011").collect()} == {"fts+like"}
    found = index.candidates(index.postings(rows), "text 11")
    assert {r.id for r in found.collect()} >= {"a0011"}


def test_resolve(spark):
    rows = artifacts(spark)
    asked = spark.createDataFrame([("a0011",), ("a001",), ("NAME3.txt",), ("text 77",), ("nothing",)], "ref string")
    got = {r.ref: (r.id, r.how) for r in index.resolve(rows, asked).collect()}
    assert got["a0011"] == ("a0011", "exact") and got["a001"][1] == "prefix" and got["NAME3.txt"] == ("a0003", "name") and got["text 77"] == ("a0077", "content") and "nothing" not in got


def test_batch_names_are_unique(spark):
    paths = ["in/a.txt", "in/A.md", "in/x/a.txt", "in/b.txt", "in/b.csv", "in/_batch_report.txt", "in/y/b.csv", "in/c.md", "in/z/b.csv", "in/a.TXT"]
    d = spark.createDataFrame([(p,) for p in paths], "path string")
    for source in (None, "in"):
        outs = [r.out for r in batch.plan_outputs(d, ".md", source).collect()]
        assert len({o.lower() for o in outs}) == len(paths) and not any(o.lower() == "_batch_report.md" for o in outs)
    named = {r.path: r.out for r in batch.plan_outputs(d, ".md").collect()}
    assert named["in/c.md"] == "c.md" and named["in/b.txt"] == "b.txt.md"


def test_resume_and_summary(spark):
    t = spark.createDataFrame([("p1", 5, "A.md"), ("p2", 5, "b.md"), ("p3", 5, "c.md")], "path string, mtime long, out string")
    m = spark.createDataFrame([("a.md", 1, "x", 1, "x", 9), ("b.md", 1, "x", 1, "y", 9), ("c.md", 1, "x", 1, "x", 4)], "out string, size int, sha256 string, now_size int, now_sha256 string, out_mtime long")
    assert {r.path for r in batch.resume(t, m).collect()} == {"p2", "p3"}
    s = batch.summary(spark.createDataFrame([("ok", 0.5), ("ok", 0.6), ("failed", None), ("skipped", None)], "status string, confidence double")).first()
    assert (s.total, s.ok, s.failed, s.skipped, s.avg_confidence, s.balanced) == (4, 2, 1, 1, 0.55, True)


def test_pages_and_furniture(spark):
    assert structure.page_spec("3,1-2,2") == [3, 1, 2]
    for bad in ("0", "2-1", "x", "9", ""):
        with pytest.raises(ValueError):
            structure.page_spec(bad, pages=5)
    rows = [(1, p, o, t, 11.0, False, 1.0) for p in range(5) for o, t in enumerate(["HEAD" if p != 4 else f"other{p}", *(f"line {p} {k}" for k in range(8)), f"foot{p if p > 1 else ''}"])]
    d = spark.createDataFrame(rows, "doc int, page int, ord int, text string, font_size double, bold boolean, x0 double")
    assert {r.text for r in structure.furniture(d).collect()} == {"HEAD"}
    assert structure.strip_furniture(d).count() == len(rows) - 4
    assert [r.page for r in structure.select_pages(d, "3,1").where("ord = 0").orderBy("page_ord").collect()] == [3, 1]


def test_headings_lists_and_contents(spark):
    lines = [("Big Title", 20, False, 0), ("Sub part", 13.5, False, 0), ("Bold one", 11, True, 0), ("plain body text that goes on and on for a while.", 11, False, 0), ("• first", 11, False, 10), ("• inner", 11, False, 30), ("• second", 11, False, 10), ("Chapter One ....... 12", 11, False, 0), ("1.1 numbered heading", 13, False, 0)]
    d = spark.createDataFrame([(1, 1, i, t, float(s), b, float(x)) for i, (t, s, b, x) in enumerate(lines)], "doc int, page int, ord int, text string, font_size double, bold boolean, x0 double")
    a = structure.list_levels(structure.annotate(d))
    got = {r.text: r for r in a.collect()}
    assert [got[t].heading_level for t in ("Big Title", "Sub part", "Bold one", "1.1 numbered heading")] == [1, 2, 4, 3]
    assert [got[t].list_level for t in ("• first", "• inner", "• second")] == [1, 2, 1] and (got["Chapter One ....... 12"].toc_title, got["Chapter One ....... 12"].toc_page) == ("Chapter One", 12)
    md = structure.render_markdown(a).first().markdown
    assert md.startswith("# Big Title\n") and "- first\n  - inner\n- second\n- [Chapter One](#chapter-one)" in md


def test_conversion_choices(spark):
    schema = "file_type string, pages array<struct<page_number int, elements array<struct<element_id string, element_type string, content string, meta string>>, raw_text string, has_image boolean, has_table boolean, meta string>>"
    page = lambda raw="x", image=False, table=False, kinds=("text",): (1, [(f"e{i}", k, f"c{i}", "{}") for i, k in enumerate(kinds)], raw, image, table, "{}")
    cases = [("txt", [page()]), ("image", [page(image=True, kinds=("image",))]), ("csv", [page(table=True, kinds=("table",))]), ("unknown", [page(image=True)]), ("pdf", [page(table=True)]), ("unknown", [page()])]
    d = spark.createDataFrame(cases, schema)
    got = [r[0] for r in d.select(convert.select_strategy("file_type", F.col("pages"))).collect()]
    assert got == ["text_extraction", "image_description", "table_extraction", "image_description", "text_extraction", "structured_extraction"]
    out = d.select(convert.convert("file_type", F.col("pages"), F.lit("t")).alias("c")).select("c.*").collect()
    assert out[1].content.startswith("# 图片内容描述") and out[2].content == "c0" and [r.confidence for r in out[:3]] == [0.95, 0.75, 0.85]
    reasons = spark.createDataFrame([([page(" "), page("x")], 0.9, None), ([page()], 0.9, 0.59), ([page()], 0.49, 0.6), ([page(table=True)], 0.5, None), ([page(table=True, kinds=("table",))], 0.5, None), ([], 0.1, None)], "pages " + schema.split("pages ", 1)[1] + ", c double, o double")
    assert [r[0] for r in reasons.select(quality.enhance_reason(F.col("pages"), "c", "o")).collect()] == ["image_only", "ocr_low_confidence", "low_confidence", "table_sparse", None, None]


def test_templates(spark):
    d = spark.createDataFrame([("n", "a\n\n\n\n b ")], "name string, text string")
    assert [(r.chunk_id, r.chunk, r.vector_id) for r in chunk.apply_template(d, "rag_chunks").collect()] == [(0, "a", "n_chunk_0"), (2, "b", "n_chunk_2")]
    assert chunk.apply_template(d, "openai_messages").first().result[1].parts[0].text == "a\n\n\n\n b "
    with pytest.raises(ValueError):
        chunk.apply_template(d, "other")
    joined = chunk.join_files(spark.createDataFrame([(1, 2, "b", "B"), (1, 1, "a", "A")], "g int, o int, n string, t string"), "g", "o", "n", "t").first()
    assert joined.content == "# a\n\nA\n\n<!-- ff-file-sep -->\n\n# b\n\nB"


def test_inbox_lets_each_stable_version_through_once(spark, tmp_path):
    samples, out = f"{tmp_path}/samples", []

    def sample(n, *rows):
        spark.createDataFrame([(p, s, m, n, f) for p, s, m, f in rows], inbox.LISTING).coalesce(1).write.mode("append").parquet(samples)

    def run():
        q = inbox.run_inbox(inbox.listings(spark, samples), lambda d: d, lambda d, n: out.extend((r.path, r.mtime) for r in d.collect()), f"{tmp_path}/ck")
        q.awaitTermination(120)

    sample(1, ("a", 1, 10, False), ("b", 5, 10, False))
    sample(2, ("a", 1, 10, False), ("b", 6, 11, False))
    run()
    assert out == [("a", 10)]
    sample(3, ("a", 1, 10, False), ("b", 6, 11, False))
    sample(4, ("a", 2, 20, False), ("b", 6, 11, False))
    run()
    assert sorted(out) == [("a", 10), ("b", 11)]
    sample(5, ("a", 2, 20, False), ("b", 0, 0, True))
    sample(6, ("b", 6, 11, False))
    run()
    assert sorted(out) == [("a", 10), ("a", 20), ("b", 11), ("b", 11)]


def test_windows_run_as_a_stream(spark, tmp_path):
    e = spark.createDataFrame([(1, "2024-01-01 00:05:00", 7, "x", 1.0), (2, "2024-01-01 23:00:00", 7, "x", 2.0), (3, "2024-01-03 01:00:00", 7, "y", 4.0)], "event_id long, t string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("t")).drop("t")
    e.write.parquet(f"{tmp_path}/e")
    q = inbox.event_windows(spark.readStream.schema(e.schema).parquet(f"{tmp_path}/e")).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.event_type, r.n, r.total) for r in spark.table("w").collect()) == [("x", 2, 3.0), ("y", 1, 4.0)]


@pytest.mark.parametrize("name", ["completeness_score", "quality_overall", "grade_histogram"])
def test_quality_queries_equal_their_sql_where_letters_are_not_ascii(spark, tmp_path, name):
    import __spark_entry__
    from tests.oracle import connect, difference

    texts = ["la chllaía", "et voilà", "en España", "naïve a ", "fin the ", "abc和", "or  ", "é the\nnext", "cut offé it is", "…truncatedñ", "kelvinK an", "a", "", None, "der\x0bAN\x0b", "x\x85the\x85", "TRUNCATED text"]
    rows = [(i, t, "es", "src1", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = difference(spark, connect(str(tmp_path)), str(tmp_path), __spark_entry__.queries()[name], __spark_entry__.oracle_sql()[name])
    assert found is None
