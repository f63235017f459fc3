"""WARC derivatives: round trip, links between records, broken markup, nulls."""

import gzip
import html.parser
import json

from codeloom.llm import warc

PAGE = '<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script></head><body><a href="/x?a=1&amp;b=2">x</a><!-- ad --><p>One<br>two &lt;3<p>été  a < b</body></html>'
ROWS = [(1, "http://a.example.com/", PAGE, "k"), (2, None, None, "k"), (3, "u", "<p>open <script>never closed", "k"), (4, "v", "<", "k"), (4, "v", "<", "k")]


class Plain(html.parser.HTMLParser):
    """Visible text by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.hidden, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        self.out.append(" ")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style")
        self.out.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def words(page):
    p = Plain()
    p.feed(page)
    p.close()
    return "".join("".join(p.out).split())


def test_derivatives(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, record string")
    found = warc.responses(pages)
    got = warc.derivatives(found).collect()
    assert len(got) == 10
    sources = {r.page_id: dict(next(warc.parse_records(bytes(r.record)))[0]) for r in found.collect()}
    for r in got:
        ((headers, block),) = warc.parse_records(gzip.compress(bytes(r.record)))
        named = dict(headers)
        assert block == bytes(r.content) and named["WARC-Type"] == r.kind and named["WARC-Block-Digest"] == warc.digest(block)
        assert named["WARC-Refers-To"] == r.refers_to == sources[r.page_id]["WARC-Record-ID"]
        assert named["WARC-Source-Payload-Digest"] == sources[r.page_id]["WARC-Payload-Digest"]
        if r.kind == "metadata":
            assert json.loads(block)["warc"] == sources[r.page_id]
    first = {r.kind: r for r in got if r.page_id == 1}
    assert bytes(first["conversion"].content).decode() == "A & B\nx\nOne\ntwo <3\nété a < b"
    assert json.loads(bytes(first["metadata"].content))["html"] == {"title": "A & B", "links": ["/x?a=1&b=2"]}
    assert [bytes(r.content) for r in got if r.kind == "conversion" and r.page_id != 1] == [b"", b"open", b"<", b"<"]
    packed = warc.members(warc.derivatives(found)).collect()
    assert len(list(warc.parse_records(b"".join(bytes(r.record) for r in packed)))) == 10
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0
    assert warc.derivatives(spark.createDataFrame([(1, None)], "page_id long, record binary")).count() == 0


def test_same_words_as_a_parser(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        _, text, _ = warc.text_and_links(r.html or "")
        assert "".join(text.split()) == words(r.html or "")
