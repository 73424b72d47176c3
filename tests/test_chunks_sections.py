"""Arrow operators against their per-row helpers on real tables."""


from quarry.operators.chunks import recursive_chunks, window_chunks
from quarry.operators.htmltext import page_sections
from quarry.operators.sections import sections, skip_report
from quarry.operators.splitter import split_text
from tests.conftest import SF_SMALL


def test_recursive_chunks_equal_helper(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    got = {}
    for r in recursive_chunks(docs, key_cols=["doc_id"]).collect():
        got.setdefault(r.doc_id, []).append((r.chunk_pos, r.text))
    for r in docs.collect():
        want = split_text(r.text, 500, 50)
        have = [t for _, t in sorted(got.get(r.doc_id, []))]
        assert have == want
        for c in have:
            assert len(c) <= 500 and c in r.text


def test_window_chunks_invariants(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in window_chunks(docs, key_cols=["doc_id"]).collect():
        assert r.text == texts[r.doc_id][r.chunk_pos * 450 : r.chunk_pos * 450 + 500]


def test_sections_job_equals_helper_and_report(spark):
    html = (
        '<body><section id="x"><h1>T<a href="#x">#</a></h1><p>Hello <b>w</b></p>'
        '<section id="y"><h2>U<a href="#y">#</a></h2></section></section></body>'
    )
    pages = spark.createDataFrame(
        [(1, "https://docs.example.com/a/i.html", html), (2, "https://x.org/b/c", "<body>none</body>")],
        "page_id long, url string, html string",
    )
    rows = sections(pages).orderBy("section_pos").collect()
    assert [(r.section_pos, r.source, r.text) for r in rows] == [
        (0, "https://docs.example.com/a/#x", "T#\nHello w"),
        (1, "https://docs.example.com/a/#y", "U#"),
    ]
    rep = {r.reason: r.n for r in skip_report(pages).collect()}
    assert rep == {"ok": 2, "no_section": 1}


def test_nav_sections_on_pages(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    got = {r.page_id: r.text for r in sections(pages, tag="nav").collect()}
    for r in pages.collect():
        status, secs = page_sections(r.html, "nav")
        if status == "ok" and secs[0][1] is not None:
            assert got[r.page_id] == secs[0][3]


def test_window_chunks_read_a_text_once(spark):
    """Windows come from pieces of one pass, at every size and overlap; they are
    not counted off from the start of the text, which is quadratic."""
    texts = ["", " ", "a", "\U0001f600b\n\rc" * 90, "x" * 500, "y" * 501, "é " * 475, "z" * 951, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size, overlap in ((500, 50), (4, 0), (7, 5), (5, 4)):
        cut = window_chunks(docs, key_cols=["doc_id"], size=size, overlap=overlap)
        step, want = size - overlap, []
        for key, text in enumerate(texts):
            count = 0 if text is None else 1 + max(0, -(-(len(text) - size) // step))
            cuts = [(key, i, text[i * step : i * step + size]) for i in range(count)]
            want += [c for c in cuts if c[2].strip()]
        assert sorted((r.doc_id, r.chunk_pos, r.text) for r in cut.collect()) == want
        assert "regexp_extract_all" in cut._jdf.queryExecution().optimizedPlan().toString()
