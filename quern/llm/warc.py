"""WARC derivatives: from response records, linked metadata and plain-text conversions.

Each HTTP response gives a ``metadata`` record (application/warc-fields: status,
source headers and digests, title, language, out-links) and, if it is text, a
``conversion`` record (text/plain). Both name their source in WARC-Refers-To,
with its target URI and date; record ids are UUIDs made from the source's id and
block digest, so a task that is run again gives the same bytes and different
sources give different ids. Every record is handled by itself: nothing shuffles,
and a task holds an Arrow batch of records and SLICE of their derivatives.

Reading: Spark's text source, cut where a record's end is followed by the next
one's version, so that files of any size stream through, gzipped by record or as a
whole; a payload that has this sequence itself is put together again by its
Content-Length. Writing: Spark's text writer with the record's end between
records, so files go wherever Spark can write.
"""

import base64
import hashlib
import html as html_lib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
END, NEXT = "\r\n\r\n", "WARC/1."  # a record's end, and how the next one begins
SLICE = 256
#: Fixed values. Elements whose content isn't text, and those that end a line.
HIDDEN = ("script", "style", "noscript", "template", "iframe", "svg")
BREAKS = "address article aside blockquote body br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table td th title tr ul".split()
_TAG = re.compile(r"<(?:!--|(/?)([a-zA-Z][a-zA-Z0-9:-]*)|[!?])")
# Attributes as HTML tokenizers take them: a quote opens a value only right after =, and only if it is closed.
_REST = re.compile(r"""(?:[ \t\n\f\r/]++|[^ \t\n\f\r/>][^ \t\n\f\r/>=]*+(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^ \t\n\f\r>]++)?+)?+)*+>""")
_CLOSE = {t: re.compile(f"</{t}", re.IGNORECASE) for t in HIDDEN}
_ATTRIBUTE = re.compile(r"""([^ \t\n\f\r/>][^ \t\n\f\r/>=]*)(?:[ \t\n\f\r]*=[ \t\n\f\r]*(?:"([^"]*)"|'([^']*)'|((?!["'])[^ \t\n\f\r>]+)))?""")
_META = re.compile(rb"""<meta[^>]{0,200}?charset\s*=\s*["']?([A-Za-z0-9_-]+)""", re.IGNORECASE)
SCHEMA = "page_id long, warc_type string, record_id string, refers_to string, target_uri string, date string, content_type string, content_length long, block_digest string, source_payload_digest string, block string, record string, error string"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, source: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, kind + ' ' + source)}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block


def response_record(url: str | None, body: str | None, key: str, date: str = DATE) -> bytes:
    """A response as a crawler would store it, with UTF-8 HTML."""
    payload = (body or "").encode("utf-8", "surrogatepass")
    url = re.sub(r"[\r\n]+", "", url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", f"{key} {url} {digest(payload)}")), ("WARC-Date", date), ("WARC-Target-URI", url), ("Content-Type", "application/http; msgtype=response"),
               ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(http + payload)), ("Content-Length", str(len(http + payload)))]
    return record(headers, http + payload)


def _fields(data: bytes) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in data.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], out[-1][1] + " " + line.strip())
        elif ":" in line:
            k, v = line.split(":", 1)
            out.append((k.strip(), v.strip()))
    return out


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers with lower-case names, block); ValueError unless it is one whole record."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/") or not gap:
        raise ValueError("no WARC header")
    headers = dict(_lower(head))
    size = int(headers.get("content-length", "-1"))
    if not 0 <= size <= len(rest):
        raise ValueError("the block is shorter than its Content-Length")
    return headers, rest[:size]


def whole_records(parts: Iterator[tuple[str, bytes]]) -> Iterator[tuple[str, bytes]]:
    """(path, record) out of (path, part) in the order of the files, where a part ends at each
    END + NEXT. A part too short for its Content-Length goes on with the next of its file; if
    the file ends before, it is broken and those after it stand for themselves."""
    path, held = None, []
    for name, part in parts:
        if name != path:
            yield from ((path, x) for x in _settle(held, True))
            path, held = name, []
        held.append(part)
        yield from ((path, x) for x in _settle(held, False))
    yield from ((path, x) for x in _settle(held, True))


def _settle(held: list[bytes], last: bool) -> Iterator[bytes]:
    """Takes from ``held`` the records that are whole; all if these are the file's ``last`` parts."""
    while held:
        first = data = held[0] if held[0].startswith(NEXT.encode()) else NEXT.encode() + held[0]
        n = 1
        while (lacks := _lacks(data)) and n < len(held):
            data, n = data + (END + NEXT).encode() + held[n], n + 1
        if lacks and not last:
            return
        yield first if lacks else data
        del held[: 1 if lacks else n]


def _lacks(data: bytes) -> bool:
    head, _, rest = data.partition(END.encode())
    size = dict(_lower(head)).get("content-length", "")
    return size.isdigit() and len(rest) < int(size)


def _lower(head: bytes) -> list[tuple[str, str]]:
    return [(k.lower(), v) for k, v in _fields(head.partition(b"\r\n")[2])]


def _attributes(tag: str) -> dict[str, str]:
    """The attributes of a tag by lower-case name; of repeated ones the first counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(tag):
        out.setdefault(m[1].lower(), html_lib.unescape(m[2] or m[3] or m[4] or ""))
    return out


def html_text(page: str) -> tuple[str, str, str, list[str]]:
    """(text, title, language, out-links) in one pass. Block elements end lines, and so do
    line feeds inside ``pre``; elsewhere white space is a space."""
    out, links, title, lang, at, quotes, pre = [], [], "", "", 0, True, 0
    title_from = None

    def said(piece: str) -> str:
        piece = html_lib.unescape(piece)
        return piece if pre else piece.replace("\n", " ")

    while m := _TAG.search(page, at):
        out.append(said(page[at : m.start()]))
        if m[0] == "<!--":
            end = page.find("-->", m.end())
            at = end + 3 if end >= 0 else len(page)
            continue
        whole = _REST.match(page, m.end()) if quotes else None
        if whole:
            at = whole.end()
        else:
            quotes = False  # no > outside of values up to the page's end: from here on the next > ends a tag
            end = page.find(">", m.end())
            at = end + 1 if end >= 0 else len(page)
        tag = (m[2] or "").lower()
        attributes = page[m.end() : at]
        if tag in HIDDEN and not m[1]:
            close = _CLOSE[tag].search(page, at)
            at = close.start() if close else len(page)
        elif tag == "title":
            if m[1] and title_from is not None:
                title = " ".join("".join(out[title_from:]).split())
                del out[title_from:]
                title_from = None
            elif not m[1] and not title:
                title_from = len(out)
        elif tag == "a" and not m[1] and "href" in (named := _attributes(attributes)):
            links.append(named["href"].strip())
        elif tag == "html" and not m[1]:
            lang = _attributes(attributes).get("lang", lang)
        elif tag == "pre":
            pre = max(0, pre + (-1 if m[1] else 1))
        if tag in BREAKS:
            out.append("\n")
    out.append(said(page[at:]))
    lines = (" ".join(x.split()) for x in "".join(out).split("\n"))
    return "\n".join(x for x in lines if x), title, lang, links


def _decode(payload: bytes, content_type: str) -> str:
    named = re.search(r"charset\s*=\s*\"?([A-Za-z0-9_-]+)", content_type, re.IGNORECASE)
    meta = None if named else _META.search(payload[:4096])
    try:
        return payload.decode(named[1] if named else meta[1].decode() if meta else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def derive(data: bytes, date: str = DATE) -> list[dict]:
    """The derivatives of one record: none unless it is an HTTP response."""
    head, block = parse_record(data)
    if head.get("warc-type") != "response" or "http" not in head.get("content-type", ""):
        return []
    http, _, payload = block.partition(b"\r\n\r\n")
    status, _, lines = http.partition(b"\r\n")
    fields = _fields(lines)
    kind = next((v for k, v in fields if k.lower() == "content-type"), "")
    source, uri = head.get("warc-record-id", ""), head.get("warc-target-uri", "")
    computed, own = digest(payload), digest(block)
    notes = [("status", status.decode("latin-1")), ("source-date", head.get("warc-date", "")), ("source-payload-digest", head.get("warc-payload-digest", computed)), ("source-block-digest", head.get("warc-block-digest", own))]
    notes += [("digest-verified", str(head.get("warc-payload-digest", computed) == computed).lower())] + [("http-" + k.lower(), v) for k, v in fields]
    text = None
    if "html" in kind.lower():
        text, title, lang, links = html_text(_decode(payload, kind))
        notes += [("title", title), ("language", lang)]
        for link in dict.fromkeys(links):
            try:
                notes.append(("outlink", urljoin(uri, link)))
            except ValueError:
                notes.append(("outlink", link))
    elif kind.lower().startswith("text/"):
        text = _decode(payload, kind)
    made = [("metadata", "application/warc-fields", "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in notes if v).encode("utf-8", "replace"))]
    if text is not None:
        made.append(("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace")))
    out = []
    for warc_type, content_type, body in made:
        rid = record_id(warc_type, f"{source} {own}")
        headers = [("WARC-Type", warc_type), ("WARC-Record-ID", rid), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", head.get("warc-date", "")),
                   ("Content-Type", content_type), ("WARC-Block-Digest", digest(body)), ("WARC-Source-Payload-Digest", head.get("warc-payload-digest", computed)), ("Content-Length", str(len(body)))]
        out.append({"warc_type": warc_type, "record_id": rid, "refers_to": source, "target_uri": uri, "date": date, "content_type": content_type, "content_length": len(body), "block_digest": digest(body),
                    "source_payload_digest": head.get("warc-payload-digest", computed), "block": body.decode("utf-8"), "record": record([h for h in headers if h[1] != ""], body).decode("utf-8"), "error": None})
    return out


def _arrow_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in SCHEMA.split(", "))])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            yield batch.slice(i, SLICE)


def _derive(date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow_schema()
        empty = dict.fromkeys(schema.names)
        for batch in _slices(batches):
            rows = []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    if (data := data.as_py()) is None:
                        raise ValueError("no record")
                    rows += [empty | {"page_id": key} | x for x in derive(data, date)]
                except ValueError as e:
                    rows.append(empty | {"page_id": key, "warc_type": "error", "error": str(e)})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def derivatives(records: DataFrame, id_column: str = "page_id", record_column: str = "record", date: str = DATE) -> DataFrame:
    """The metadata and conversion records of each response, under the row's id.

    ``record`` holds each derivative as it stands in a file, ``block`` its content.
    A null or broken record gives one row of warc_type ``error`` with the reason;
    records that aren't HTTP responses give none. An empty page has an empty
    conversion. Repeated rows give repeated records of the same ids; null ids stay
    null. An empty table gives an empty result; other columns are not read and may
    have any name.
    """
    return records.select(F.col(id_column).cast("long").alias("page_id"), F.col(record_column).alias("record")).mapInArrow(_derive(date), SCHEMA)


def responses(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", date: str = DATE) -> DataFrame:
    """(page_id, record): pages as response records.

    Null url or html count as empty. A record's id is made of the row's id, url and
    html, so only rows alike in all three share it. An empty table gives an empty
    result; other columns are not read and may have any name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            made = [response_record(u.as_py(), h.as_py(), str(k.as_py()), date) for k, u, h in zip(*batch.columns, strict=True)]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column(0), "record": pa.array(made, pa.binary())})

    return pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).alias("html")).mapInArrow(run, "page_id long, record binary")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, path, record) of every record of the files; page_id is a hash of the record's id.

    Memory is bounded by a record. Empty files give no rows, a broken record one
    that ``derivatives`` reports. Of a plain file that Spark splits, a payload that
    holds a record's end and the next one's beginning right at a split is broken;
    gzipped files are never split.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = ((name.as_py(), data.as_py()) for batch in batches for name, data in zip(*batch.columns, strict=True))
        for name, data in whole_records(parts):
            key = dict(_lower(data.partition(END.encode())[0])).get("warc-record-id", digest(data))
            number = int.from_bytes(hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
            yield pa.RecordBatch.from_pydict({"page_id": pa.array([number], pa.int64()), "path": pa.array([name]), "record": pa.array([data], pa.binary())})

    parts = spark.read.option("lineSep", END + NEXT).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("part"))
    return parts.mapInArrow(run, "page_id long, path string, record binary")


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """A file for each partition of the column ``record``; null records and the errors of
    ``derivatives`` are left out. An empty table gives no records."""
    if "error" in records.columns:
        records = records.filter("error is null")
    records.filter("record is not null").select(F.col("record").cast("string")).write.option("lineSep", END).option("compression", compression).text(path)
