"""URL filters and WARC derivatives, and the pipeline as a whole."""

from datetime import date

from pyspark.sql import functions as F

from verdictframe.llm import cluster, url_filter, warc


def test_url_filter_at_fetch_time(spark):
    entries = [
        ("domain:example.com", "add", "block", date(2024, 1, 10)),
        ("domain:example.com", "remove", "block", date(2024, 3, 1)),
        ("host:a.example.com", "add", "allow", date(2024, 2, 1)),
        ("prefix:a.example.com/x", "add", "block", date(2024, 2, 15)),
        ("prefix:a.example.com/x/y", "add", "allow", date(2024, 2, 20)),
        (None, "add", "block", date(2024, 1, 1)),
        ("host:b.example.com", "add", "block", None),
        ("host:tie.org", "add", "allow", date(2024, 1, 1)),
        ("host:tie.org", "add", "block", date(2024, 1, 1)),
    ]
    captures = [
        (1, "http://A.example.com/", date(2024, 1, 9)),
        (2, "http://a.example.com/", date(2024, 1, 10)),
        (3, "http://a.example.com:80/z?x/y", date(2024, 2, 1)),
        (4, "https://a.example.com/x", date(2024, 2, 15)),
        (5, "https://a.example.com/x/y/z", date(2024, 2, 21)),
        (6, "https://b.example.com/", date(2024, 3, 1)),
        (7, None, date(2024, 2, 1)),
        (8, "not a url", date(2024, 2, 1)),
        (9, "http://a.example.com/", None),
        (10, "http://tie.org/", date(2024, 5, 1)),
        (2, "http://a.example.com/", date(2024, 1, 10)),
    ]
    df = spark.createDataFrame([(*c, 1, "x") for c in captures], "page_id long, url string, fetched_at date, pattern int, verdict string")
    listed = spark.createDataFrame([(*e, 1) for e in entries], "pattern string, action string, verdict string, listed_at date, page_id int")
    got = sorted((r.page_id, r.verdict, r.matched) for r in url_filter.evaluate(df, listed).collect())
    assert [x[1] for x in got] == ["allow", "block", "block", "allow", "block", "allow", "allow", "allow", "allow", "allow", "block"]
    assert [x[2] for x in got] == [None, "domain:example.com", "domain:example.com", "host:a.example.com", "prefix:a.example.com/x", "prefix:a.example.com/x/y", None, None, None, None, "host:tie.org"]
    assert url_filter.evaluate(df.limit(0), listed).count() == 0
    assert {r.verdict for r in url_filter.evaluate(df, listed.limit(0)).collect()} == {"allow"}


PAGE = '<!DOCTYPE html><html lang="en"><head><meta charset="UTF-8"><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body><!-- no --><p>One&nbsp;two<br>three</p><div>x < y</div></body></html>'


def test_url_filter_looks_up_entries_of_any_depth(spark):
    urls = ["http://a.b.c.d.e.f/x", "https://h.org/1/2/3/4/5", "https://h.org/1/2/3/x", "https://z.com/", "https://z.net/"]
    captures = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "date'2024-06-01' as fetched_at")
    listed = ["domain:b.c.d.e.f", "prefix:h.org/1/2/3/4", "domain:com"]
    entries = spark.createDataFrame([(p, "add", "block") for p in listed], "pattern string, action string, verdict string").selectExpr("*", "date'2024-01-01' as listed_at")
    got = {r.page_id: r.matched for r in url_filter.evaluate(captures, entries).collect()}
    assert got == {0: "domain:b.c.d.e.f", 1: "prefix:h.org/1/2/3/4", 2: None, 3: "domain:com", 4: None}


def test_url_filter_reads_authorities_as_browsers_do(spark):
    blocked = [
        "https://user:pw@evil.org/x",
        "http://good.org@evil.org/x",
        "http://a@b@evil.org:80/",
        "http://EVIL.org./x",
        "http://evil.org\\@good.org/",
        "http:\\\\evil.org\\x",
        "  http://sub.evil.org?x",
        "http://ev\til.org#@good.org",
        "https://evil.org:/y",
        "http://[::1]:8080/x",
        "http://10.0.0.1/",
    ]
    fine = ["http://good.org/@evil.org", "http://good.org?@evil.org", "http://good.org#evil.org", "http://evil.org.good.org/", "http://[::2]/", "http://20.0.0.1/", "http:///evil.org", "//evil.org/", "http://@/x", "http://[::1/x", "mailto:x@evil.org"]
    listed = ["domain:evil.org", "host:[::1]", "host:10.0.0.1", "domain:0.0.1"]
    captures = spark.createDataFrame(list(enumerate(blocked + fine)), "page_id long, url string").selectExpr("*", "date'2024-06-01' as fetched_at")
    entries = spark.createDataFrame([(p, "add", "block") for p in listed], "pattern string, action string, verdict string").selectExpr("*", "date'2024-01-01' as listed_at")
    got = {r.url: r.verdict for r in url_filter.evaluate(captures, entries).collect()}
    # three slashes begin the same host as two
    assert got == {u: "block" for u in [*blocked, "http:///evil.org"]} | {u: "allow" for u in fine if u != "http:///evil.org"}


def test_url_query_equals_sql_on_odd_urls(spark, tmp_path):
    import duckdb

    from verdictframe.llm import queries

    urls = ["https://u:p@evil.org/x/y", "http://a@b@EVIL.org.:80\\z", "http://evil.org\\@good.org/", "http://[::1]/a", "http://10.0.0.1/b/c", " http://x.y.z?q", "http://x.\ty.z/k#f", None, "", "no", "http://@/x", "http://...", "http://a..b/c//d"]
    spark.createDataFrame([(i % 9, u) for i, u in enumerate(urls * 3)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = queries.op1_url_filter(spark, str(tmp_path)).toPandas()
    want = c.sql(queries.SQL["op1_url_filter"]).df()
    plain = lambda df: sorted((str(r.page_id), str(r.url), r.verdict, str(r.matched)) for r in df.itertuples())
    assert len(plain(got)) == len(urls) * 3 and {x[2] for x in plain(got)} == {"allow", "block"}
    # a query of another engine gives a repeated capture as many rows as there are copies, too
    assert sorted(set(plain(got))) == sorted(set(plain(want)))


def test_url_filter_salts_shared_patterns(spark, monkeypatch):
    urls = [f"https://hot.org/a/b/{i % 7}" for i in range(60)] + [f"https://x{i}.net/" for i in range(10)]
    captures = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").selectExpr("*", "date'2024-06-01' as fetched_at")
    listed = ["prefix:hot.org/a/b", "prefix:hot.org/a/b/3", "host:x3.net", "domain:hot.org"]
    entries = spark.createDataFrame([(p, "add", "block") for p in listed], "pattern string, action string, verdict string").selectExpr("*", "date'2024-01-01' as listed_at")
    plain = sorted(map(tuple, url_filter.evaluate(captures, entries).collect()), key=str)
    assert {r[4] for r in plain} == {"prefix:hot.org/a/b", "prefix:hot.org/a/b/3", "host:x3.net", None}
    monkeypatch.setattr(url_filter, "HOT", 5)
    for most in (0, 100):
        monkeypatch.setattr(cluster, "BROADCAST_ROWS", most)
        assert sorted(map(tuple, url_filter.evaluate(captures, entries).collect()), key=str) == plain


def test_url_query_equals_sql(spark, sf):
    import duckdb

    from verdictframe.llm import queries

    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{sf}/pages.parquet'")
    got = queries.op1_url_filter(spark, sf).toPandas()
    want = c.sql(queries.SQL["op1_url_filter"]).df()
    assert len(got) == len(want) and list(got.columns) == list(want.columns)
    assert sorted(map(str, got.astype(str).values.tolist())) == sorted(map(str, want.assign(fetched_at=want.fetched_at.dt.date, valid_from=want.valid_from.dt.date).astype(str).replace("NaT", "None").values.tolist()))


def test_warc_round_trip(spark):
    rows = [(1, "http://a.org/x", PAGE), (2, None, None), (3, "http://b.org/\r\nX-Bad: 1", ""), (1, "http://a.org/x", PAGE), (None, "http://c.org", "plain é text")]
    df = spark.createDataFrame([(*r, "z", 0) for r in rows], "page_id long, url string, html string, record string, record_id int")
    got = warc.build(df).collect()
    assert len(got) == 2 * len(rows)
    for r in got:
        headers, block = warc.parse(bytes(r.record))
        assert headers["WARC-Record-ID"] == r.record_id and headers["WARC-Refers-To"] == r.refers_to
        assert headers["WARC-Block-Digest"] == r.block_digest == warc.digest(block) and int(headers["Content-Length"]) == r.content_length == len(block)
        assert headers["WARC-Refers-To-Payload-Digest"] == r.payload_digest and "X-Bad" not in headers
        assert ("WARC-Target-URI" in headers) == (r.target_uri is not None)
    pairs = {(r.page_id, r.record_type): r for r in got}
    meta, text = pairs[1, "metadata"], pairs[1, "conversion"]
    assert meta.refers_to == text.refers_to != meta.record_id != text.record_id
    block = warc.parse(bytes(text.record))[1].decode()
    assert block == "T & t\nOne two\nthree\nx < y"
    fields = warc.parse(bytes(meta.record))[1].decode()
    assert "declared-charset: utf-8" in fields and "declared-content-language: en" in fields and f"text-digest: {warc.digest(block.encode())}" in fields
    assert "source-" not in fields and all("WARC-Date" not in warc.parse(bytes(r.record))[0] for r in got)
    assert warc.parse(bytes(pairs[2, "conversion"].record))[1] == b""
    assert warc.build(df.limit(0)).count() == 0


def test_warc_keeps_source_headers_and_dates(spark):
    rows = [(1, "http://a.org", "<p>x", "2024-05-01T00:00:00Z", "HTTP/1.1 404 Not Found\r\nContent-Type: text/html; a=b\r\nX-Two: v\r\nnonsense\r\n"), (2, "http://a.org", "<p>x", None, None)]
    got = warc.build(spark.createDataFrame(rows, "page_id long, url string, html string, day string, head string"), "day", "head").collect()
    by = {(r.page_id, r.record_type): warc.parse(bytes(r.record)) for r in got}
    headers, block = by[1, "metadata"]
    assert headers["WARC-Date"] == "2024-05-01T00:00:00Z" and "WARC-Date" not in by[2, "metadata"][0]
    assert block.decode().splitlines()[:3] == ["source-status: HTTP/1.1 404 Not Found", "source-content-type: text/html; a=b", "source-x-two: v"]
    assert b"source-" not in by[2, "metadata"][1]


def parsed_text(page):
    """The text of a page by the parser of the standard library."""
    import re
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.hidden = [], []

        def handle_starttag(self, tag, attrs):
            if tag in warc.RAW | warc.HIDDEN:
                self.hidden.append(tag)
            elif tag in warc.BREAKS:
                self.out.append("\n")
            if tag in warc.RAW | warc.HIDDEN:
                self.out.append(" ")

        def handle_endtag(self, tag):
            if self.hidden and self.hidden[-1] == tag:
                self.hidden.pop()
            elif tag in warc.BREAKS and not self.hidden:
                self.out.append("\n")

        def handle_comment(self, data):
            if not self.hidden:
                self.out.append(" ")

        def handle_data(self, data):
            if not self.hidden:
                self.out.append(data)

    reader = Reader()
    reader.feed(page)
    reader.close()
    text = re.sub(r"[^\S\n]+", " ", "".join(reader.out).replace("\xa0", " "))
    return re.sub(r" ?\n[ \n]*", "\n", text).strip()


def test_warc_text_equals_a_parser(spark, sf):
    pages = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").select("html").collect()]
    odd = [PAGE, "", "a < b & c", '<p title="a>b">c</p>', "<P CLASS='x>y'>z<br/>w", "x<!-- a > b -->y", "<script>if (a<b) {}</script >t", "<div><span>a</span>b</div>c", "<style>p>q{}</style>x", "<noscript>n</noscript>m", "a<!---->b"]
    for page in [*pages, *odd]:
        assert warc.plain_text(page) == parsed_text(page or "")


def test_warc_of_broken_and_long_pages():
    import time

    assert warc.plain_text("a<script>var x = '</p>'; b") == "a"
    assert warc.plain_text("a<!-->b</p>c") == "a b\nc" and warc.plain_text("a<!--->b<!-- x -->c") == "a b c"
    assert warc.plain_text("a<!-- b <p>c") == "a" and warc.plain_text("x <b y") == "x <b y"
    assert warc.plain_text('<p title="a>b') == "b" and warc.plain_text("<noscript>a <b>b</b>") == "a b"
    late = "<html>" + " " * 20_000 + '<meta name="x"><meta charset="KOI8-R"><html lang="ru">'
    assert warc.read_page(late)[1] == [("charset", "koi8-r"), ("content-language", "ru")]
    for unit in ("<!-- x", "<script>", '<a ="', "<p title='>", "<noscript>", "<meta ", "< ", "<a b=", '="<'):
        began = time.perf_counter()
        warc.plain_text(unit * (5_000_000 // len(unit)))
        assert time.perf_counter() - began < 6, unit


def test_pipeline_stage_by_stage(spark, sf):
    import corpus_pipeline as pipeline
    from verdictframe.llm import decontaminate, near_dedup, quality_classifier, quality_rules

    assert [name for name, _ in pipeline.STAGES] == ["quality_classifier", "quality_rules", "near_dedup", "benchmark_decontamination", "best_fit_packing"]
    docs, labels, benchmark = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    columns, all_docs = docs.columns, docs

    def ids(df):
        return sorted(r.doc_id for r in df.select("doc_id").collect())

    def by_rules(d):
        trees = {r.doc_id for r in quality_rules.verdicts(all_docs, labels).where("kept").collect()}
        return d.where(F.col("doc_id").isin(sorted(trees)))

    decisions = {
        "quality_classifier": lambda d: quality_classifier.score(d, labels).where("predicted = 1"),
        "quality_rules": by_rules,
        "near_dedup": lambda d: near_dedup.near_duplicates(d).where("kept"),
        "benchmark_decontamination": lambda d: decontaminate.report(d, benchmark).where("not contaminated"),
    }
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf).cache()
        assert after.columns == columns and ids(after) == ids(decisions[name](docs))
        docs = after
    packed = pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert sorted({d for b in packed for d in b.doc_ids}) == ids(docs)
    assert sorted(tuple(map(str, b)) for b in pipeline.run(spark, sf).collect()) == sorted(tuple(map(str, b)) for b in packed)
