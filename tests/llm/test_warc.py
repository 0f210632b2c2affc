"""WARC derivatives from file to file, against the standard library's HTML parser."""

from html.parser import HTMLParser

import pytest

from quern.llm import warc

SMALL = "/root/testdata/sf0.001"


class Plain(HTMLParser):
    """Text by lines, title, language and links, as the docstrings promise."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.hidden, self.title, self.lang, self.links, self.in_title, self.pre = [""], None, "", "", [], False, 0

    def handle_starttag(self, tag, attrs):
        if self.hidden:
            return
        named = {}
        for k, v in attrs:
            named.setdefault(k, v or "")
        if tag in warc.HIDDEN:
            self.hidden = tag
        if tag == "title" and not self.title:
            self.in_title = True
        if tag == "a" and "href" in named:
            self.links.append(named["href"].strip())
        if tag == "html":
            self.lang = named.get("lang", self.lang)
        if tag == "pre":
            self.pre += 1
        if tag in warc.BREAKS:
            self.lines.append("")

    def handle_endtag(self, tag):
        if self.hidden:
            self.hidden = None if tag == self.hidden else self.hidden
            return
        if tag == "title":
            self.in_title = False
        if tag == "pre":
            self.pre = max(0, self.pre - 1)
        if tag in warc.BREAKS:
            self.lines.append("")

    def handle_data(self, data):
        if self.hidden:
            return
        if self.in_title:
            self.title += data
            return
        first, *more = data.split("\n") if self.pre else [data]
        self.lines[-1] += first
        self.lines += more


def plain(page):
    p = Plain()
    p.feed(page)
    p.close()
    lines = (" ".join(x.split()) for x in p.lines)
    return "\n".join(x for x in lines if x), " ".join(p.title.split()), p.lang, p.links


PAGES = [
    "<p>one two\nthree<br>four", "<pre>a\n  b\nc</pre>d\ne", '<a data-href="/no" href="/yes">x</a>', '<a title="see href=/no" HREF=/yes>x</a>', '<html data-lang="xx" lang="fr"><p>à', "<title>T &amp; t\n u</title>text &lt;b&gt; &#10; on",
    "a<script>if (a<b) '<p>'</script>b<style>p{}</style>c<!-- <p>no -->d", "<ul><li>1<li>2</ul><table><tr><td>a<td>b</table>", "", "no tags at all", "<a>without</a><a href>empty</a>", "x &copy y &nbsp; z", "<div\nclass=a>in</div\n>out",
]


@pytest.mark.parametrize("page", PAGES)
def test_pages_against_the_standard_parser(page):
    assert warc.html_text(page) == plain(page)


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_file_to_derivatives_to_file(spark, tmp_path, compression):
    """All small pages: written as responses, read, derived, written and read again."""
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    more = spark.createDataFrame([(-1, "http://a.b/x", "ends with\r\n\r\n"), (-2, "http://a.b/y", "holds\r\n\r\nWARC/1.1 and\r\n\r\nWARC/1.0\r\nmore"), (-3, "http://a.b/z", "\r\n\r\n\r\nWARC/1.")], "page_id long, url string, html string")
    pages = pages.select("page_id", "url", "html").unionAll(more)
    warc.write_warc(warc.responses(pages).coalesce(3), str(tmp_path / "in"), compression)
    read = warc.read_warc(spark, str(tmp_path / "in"))
    assert {bytes(r.record) for r in warc.responses(pages).collect()} == {_exact(bytes(r.record)) for r in read.collect()}
    warc.write_warc(warc.derivatives(read), str(tmp_path / "out"), compression)
    got = {}
    for r in warc.read_warc(spark, str(tmp_path / "out")).collect():
        head, block = warc.parse_record(bytes(r.record))
        assert head["warc-block-digest"] == warc.digest(block) and head["warc-record-id"] not in {h["warc-record-id"] for h, _ in got.values()}
        got[head["warc-refers-to"], head["warc-type"]] = head, block
    sources = {r.page_id: warc.parse_record(bytes(r.record))[0] for r in warc.responses(pages).collect()}
    assert len(got) == 2 * len(sources)
    for r in pages.collect():
        source = sources[r.page_id]
        text, title, lang, links = plain(r.html or "")
        head, block = got[source["warc-record-id"], "conversion"]
        assert block.decode() == text and head["warc-source-payload-digest"] == source["warc-payload-digest"] == warc.digest((r.html or "").encode())
        assert head["warc-target-uri"] == head["warc-refers-to-target-uri"] == r.url and head["warc-refers-to-date"] == source["warc-date"]
        fields = [x.split(": ", 1) for x in got[source["warc-record-id"], "metadata"][1].decode().split("\r\n") if x]
        assert dict(fields).get("title", "") == title and dict(fields).get("language", "") == lang and dict(fields)["source-payload-digest"] == source["warc-payload-digest"]
        assert sum(k == "outlink" for k, _ in fields) == len(dict.fromkeys(links))


def _exact(record):
    """Without what a file's last record has behind its block."""
    head, _, rest = record.partition(b"\r\n\r\n")
    return head + b"\r\n\r\n" + warc.parse_record(record)[1]


def test_different_pages_have_different_ids(spark):
    rows = [(1, "u", "a"), (1, "u", "b"), (None, "u", "a"), (None, "u", "c"), (1, "v", "a"), (1, "u", "a")]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, record int, block string")
    heads = [warc.parse_record(bytes(r.record))[0]["warc-record-id"] for r in warc.responses(pages).collect()]
    assert len(set(heads)) == 5
    out = warc.derivatives(warc.responses(pages)).collect()
    assert len({r.record_id for r in out}) == 10 and {r.refers_to for r in out} == set(heads)


def test_sources_without_an_id_or_with_the_same():
    made = [warc.derive(warc.record([("WARC-Type", "response"), ("Content-Type", "application/http"), *h, ("Content-Length", str(len(b)))], b)) for h in ([], [("WARC-Record-ID", "<urn:x>")]) for b in (b"HTTP/1.1 200 OK\r\n\r\na", b"HTTP/1.1 200 OK\r\n\r\nb")]
    assert len({x["record_id"] for m in made for x in m}) == sum(map(len, made)) == 4


def test_odd_values(spark):
    rows = [(1, None, None), (None, "http://a.b", None), (2, "bad [ url", "<a href='http://['>x</a>"), (3, "", "\ud83d \0 <p"), (4, "u", "x" * 300_000), (4, "u", "x" * 300_000)]
    rows = [(a, b, None if c is None else c.encode("utf-16", "surrogatepass").decode("utf-16", "replace")) for a, b, c in rows]
    out = warc.derivatives(warc.responses(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert len(out) == 12 and all(r.error is None for r in out)


def test_a_cut_record_takes_none_with_it(spark, tmp_path):
    whole = warc.response_record("http://a.b/c", "page", "1")
    (tmp_path / "x.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99999\r\n\r\ncut\r\n\r\n" + whole + b"\r\n\r\n" + whole + b"\r\n\r\n")
    (tmp_path / "y.warc").write_bytes(b"")
    read = [bytes(r.record) for r in warc.read_warc(spark, str(tmp_path) + "/*.warc").collect()]
    assert len(read) == 3 and [_exact(x) for x in read[1:]] == [whole, whole]
    assert sorted(r.warc_type for r in warc.derivatives(warc.read_warc(spark, str(tmp_path) + "/*.warc")).collect()) == ["conversion", "conversion", "error", "metadata", "metadata"]
