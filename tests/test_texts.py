from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import chunking


def one(spark, function, value):
    return spark.createDataFrame([(value,)], "t string").select(function(F.col("t"))).head()[0]


def test_nfkc_and_ascii(spark):
    assert one(spark, text.nfkc, "ﬁne ①") == "fine 1"
    assert one(spark, text.nfkc, "plain") == "plain"
    assert one(spark, text.nfkc, None) is None


def test_nfkc_equals_python(spark, sf):
    import unicodedata

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.concat("text", F.lit(" ﬀ ① ２ ㎏ ½ ⅷ ﾊﾟ e\u0301 \ufdfa")).alias("t"))
    assert all(r.n == unicodedata.normalize("NFKC", r.t) for r in docs.select("t", text.nfkc(F.col("t")).alias("n")).collect())


def test_cleaning_is_the_steps_in_turn(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.concat(F.lit("x ① **b**\n# Head line here\n"), "text").alias("t"))
    steps = text.squeeze_spaces(text.squeeze_punctuation(F.lower(text.drop_repeated_lines(text.drop_boilerplate_lines(text.strip_markdown(text.nfkc(F.col("t"))))))))
    rows = docs.select(text.preprocess(F.col("t")).alias("a"), text.strip(steps).alias("b")).collect()
    assert all(r.a == r.b for r in rows)


def test_cleaning_runs_once(spark, sf):
    from tessella.plans import catalog

    frame = catalog.QUERIES["chunk_sentence_aligned"](spark, sf)
    assert frame._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_markdown(spark):
    assert one(spark, text.strip_markdown, "# Head\n**bold** and `code` [link](http://x)\n-----\n```py\nx=1\n```") == "Head\nbold and code link\n\npy\nx=1"


def test_lines(spark):
    assert one(spark, text.drop_boilerplate_lines, "menu\n\n*** ---\nthis line is long enough\n") == "\nthis line is long enough"
    assert one(spark, text.drop_repeated_lines, "a\nA \nb\n\n\nb") == "a\nb\n\nb"


def test_squeeze_and_preprocess(spark):
    assert one(spark, text.squeeze_punctuation, "what??? ok.. no!!!!") == "what? ok.. no!"
    assert one(spark, text.preprocess, "  \n ") == ""
    assert one(spark, text.preprocess, "Some   Long line!!!\r\nSome   Long line!!!\n") == "some long line!"


def test_exact_dedup(spark):
    docs = spark.createDataFrame([(2, "A  b"), (1, "a b "), (3, "c")], "doc_id long, text string")
    assert sorted(r.doc_id for r in text.exact_dedup(docs).collect()) == [2, 3] or sorted(r.doc_id for r in text.exact_dedup(docs).collect()) == [1, 3]


def python_windows(t, size=512, overlap=64):
    import re

    pos, out = 0, []
    while pos < len(t):
        end = min(pos + size, len(t))
        if end < len(t) and (m := re.search(r"(?<=[.!?])\s+", t[end : end + 80])):
            end += m.start() + 1
        if len(t[pos:end].strip()) >= 50:
            out.append((pos, end, t[pos:end].strip()))
        pos += size - overlap
    return out


def test_chunks_equal_a_plain_loop(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    found = {}
    for r in chunking.chunked(docs).orderBy("doc_id", "chunk_index").collect():
        found.setdefault(r.doc_id, []).append((r.char_start, r.char_end, r.text))
    for r in docs.collect():
        assert found.get(r.doc_id, []) == python_windows(r.text)


def test_chunk_edges(spark):
    docs = spark.createDataFrame([(i, "x" * n) for i, n in enumerate((0, 49, 50, 448, 512, 513))] + [(9, None)], "doc_id long, text string")
    counts = {r.doc_id: r["count"] for r in chunking.chunked(docs).groupBy("doc_id").count().collect()}
    assert counts == {2: 1, 3: 1, 4: 2, 5: 2}


def test_sections(spark):
    docs = spark.createDataFrame([("a", "intro text\n# One\nbody one\nALL CAPS:\nbody two\n# Empty\n"), ("b", "nothing here")], "doc_id string, text string")
    got = {(r.doc_id, r.section): r.text for r in chunking.sections(docs).collect()}
    assert got == {("a", "preamble"): "intro text", ("a", "one"): "body one", ("a", "all caps"): "body two", ("b", "general"): "nothing here"}


def test_sections_of_repeated_and_null_ids(spark):
    """Two documents of one stem and two without an id stay apart; their chunks are numbered each from 0."""
    text = "# One\n" + "body one is long enough to be kept as a chunk of its own. " * 2 + "\nALL CAPS:\n" + "body two is long enough to be kept as a chunk of its own. " * 12
    docs = spark.createDataFrame([("readme", text, "x"), ("readme", text, "y"), (None, text, "z"), (None, "# Only\n" + "some more words of a document without an id, long enough. " * 2, "w"), ("none", None, "v")], "doc_id string, text string, `a.b` string")
    rows = chunking.chunked_by_section(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r["a.b"], []).append((r.chunk_index, r.section, r.section_index))
    assert sorted(by["x"]) == sorted(by["y"]) == sorted(by["z"]) == [(0, "one", 0), (1, "all caps", 1), (2, "all caps", 1)]
    assert by["w"] == [(0, "only", 0)] and "v" not in by
    assert {r.chunk_id for r in rows if r["a.b"] == "y"} == {f"readme_chunk_{i}" for i in range(3)} and all(r.doc_id is None for r in rows if r["a.b"] in "zw")
    cleaned = {r["a.b"]: r.section_offset for r in rows if r.section == "all caps"}
    assert all(text[cleaned[x] :].lstrip().startswith("body two") for x in "xyz")
    plan = chunking.chunked_by_section(docs)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Join" not in plan
