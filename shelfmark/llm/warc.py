"""WARC derivative builder: responses become linked metadata and plain-text conversion records.

Every response yields one `metadata` and one `conversion` record. Both name the response in WARC-Refers-To and keep its
target and date; the metadata keeps the response's record headers, HTTP headers and digests and adds title, character
set and links; the conversion is the page's text. Record ids are derived from the response's id, so that a task that
runs again after a lost executor yields the same records. Rows are converted where they are: nothing is shuffled.

Files: `read_warc` cuts (also gzipped) files at record ends with Spark's text source, so that a plain file is split over
tasks and no file is held whole; `write_warc` writes files that other tools read. A record whose content holds a record
end followed by a version line is cut there, and its row says `truncated`.

Defined results: a null body is a response without content; a null address leaves out the target header; a record
without a header line, or of another type than response, yields nothing; repeated rows yield the same records again;
an empty table yields none. Contents are read whole, whatever their length; bytes that do not fit the character set
become U+FFFD. Only the named input columns are used, so other columns may have any name.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc:derivative")
VERSION = b"WARC/1.1"
END = b"\r\n\r\n"
#: The date of responses that are made from a table without dates.
UNDATED = "1970-01-01T00:00:00Z"

RECORDS = "record_type string, record_id string, refers_to string, target_uri string, warc_date string, block_digest string, " \
    "source_payload_digest string, content_length long, truncated boolean, content string, record binary"

_DROPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title", re.I | re.S)
_LINK = re.compile(r"""<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_BLOCK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|th|thead|title|tr|ul)\b[^>]*>", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*>")
_SPACE = re.compile(r"[ \t\r\f\v\xa0]+")
_CHARSET = re.compile(r"""charset\s*=\s*["']?([\w.:-]+)""", re.I)


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def named(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, '|'.join(parts))}>"


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record without its closing empty lines."""
    lines = [VERSION] + [f"{k}: {_one_line(v)}".encode("utf-8", "surrogatepass") for k, v in headers if v is not None]
    return b"\r\n".join([*lines, b"Content-Length: %d" % len(block)]) + END + block


def _one_line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def response(key: str, url: str | None, body: str | None, date: str = UNDATED) -> bytes:
    """The response record of a page that a table holds."""
    payload = (body or "").encode("utf-8", "surrogatepass")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    return record([
        ("WARC-Type", "response"), ("WARC-Record-ID", named("response", key, url or "", sha1(payload))), ("WARC-Date", date),
        ("WARC-Target-URI", url), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", sha1(payload)),
        ("WARC-Block-Digest", sha1(block))], block)


def parse_headers(data: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Named fields after the first line, folded lines joined, and what follows the empty line."""
    head, _, rest = data.partition(END)
    fields: list[tuple[str, str]] = []
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and fields:
            fields[-1] = (fields[-1][0], fields[-1][1] + " " + line.strip())
        elif ":" in line:
            name, _, value = line.partition(":")
            fields.append((name.strip(), value.strip()))
    return fields, rest


def payload_of(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, HTTP headers and decoded body of an HTTP response."""
    status = block.partition(b"\r\n")[0].decode("latin-1")
    fields, body = parse_headers(block)
    known = {k.lower(): v.lower() for k, v in fields}
    if "chunked" in known.get("transfer-encoding", ""):
        body = _unchunked(body)
    try:
        if "gzip" in known.get("content-encoding", ""):
            body = gzip.decompress(body)
        elif "deflate" in known.get("content-encoding", ""):
            body = zlib.decompress(body)
    except (OSError, EOFError, zlib.error):
        pass  # kept as it came
    return status, fields, body


def _unchunked(body: bytes) -> bytes:
    out, rest = [], body
    while rest:
        size, _, rest = rest.partition(b"\r\n")
        try:
            n = int(size.split(b";")[0], 16)
        except ValueError:
            return body
        if n == 0:
            break
        out.append(rest[:n])
        rest = rest[n + 2:]
    return b"".join(out)


def decoded(body: bytes, fields: list[tuple[str, str]]) -> tuple[str, str]:
    """Text and character set: of the HTTP header, else of the page's head, else UTF-8."""
    header = next((v for k, v in fields if k.lower() == "content-type"), "")
    found = _CHARSET.search(header) or _CHARSET.search(body[:2048].decode("latin-1"))
    name = found[1].lower() if found else "utf-8"
    try:
        return body.decode(name, "replace"), name
    except LookupError:
        return body.decode("utf-8", "replace"), "utf-8"


def plain_text(page: str) -> str:
    """What a reader sees: no scripts, styles or comments; one line for each block."""
    text = html.unescape(_TAG.sub("", _BLOCK.sub("\n", _DROPPED.sub(" ", page).replace("\n", " "))))
    lines = (_SPACE.sub(" ", line).strip() for line in text.split("\n"))
    return "\n".join(line for line in lines if line)


def derive_one(raw: bytes) -> list[tuple]:
    """The derived records of one record, in the order of RECORDS."""
    if not raw.startswith(b"WARC/"):
        return []
    fields, block = parse_headers(raw)
    known = {k.lower(): v for k, v in reversed(fields)}
    if known.get("warc-type", "").lower() != "response":
        return []
    length = int(known["content-length"]) if known.get("content-length", "").isdigit() else len(block)
    truncated, block = len(block) < length, block[:length]
    source = known.get("warc-record-id") or named("unnamed", sha1(raw))
    uri, date, digest = known.get("warc-target-uri"), known.get("warc-date"), known.get("warc-payload-digest")
    status, http, body = payload_of(block)
    page, charset = decoded(body, http)
    title = _TITLE.search(page)
    links = dict.fromkeys(html.unescape(next(x for x in (*m.groups(), "") if x is not None)).strip() for m in _LINK.finditer(_DROPPED.sub(" ", page)))
    lines = [("http-status", status), *(("http-header", f"{k}: {v}") for k, v in http)]
    lines += [("source-header", f"{k}: {v}") for k, v in fields] + [("charset", charset)]
    lines += [("title", " ".join(plain_text(title[1]).split()))] if title else []
    lines += [("outlink", x) for x in links if x]
    out = []
    for kind, content_type, content in (
            ("metadata", "application/warc-fields", "".join(f"{k}: {_one_line(v)}\r\n" for k, v in lines)),
            ("conversion", "text/plain; charset=utf-8", plain_text(page))):
        data = content.encode("utf-8", "replace")
        name, block_digest = named(kind, source), sha1(data)
        made = record([
            ("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", source),
            ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("Content-Type", content_type),
            ("WARC-Block-Digest", block_digest)], data)
        out.append((kind, name, source, uri, date, block_digest, digest, len(data), truncated, data.decode("utf-8"), made))
    return out


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id and record: the response record of every row."""
    narrow = pages.select(id_col, F.col(id_col).cast("string").alias("__key"), F.col(url_col).alias("__url"), F.col(html_col).alias("__html"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [response(k or "", u, h) for k, u, h in zip(*(c.to_pylist() for c in batch.columns[1:]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], [id_col, "record"])

    return narrow.mapInArrow(build, f"`{id_col}` {narrow.schema[0].dataType.simpleString()}, record binary")


def derive(records: DataFrame, id_col: str | None = None, record_col: str = "record") -> DataFrame:
    """The derived records of every response among the records, each with the id of its row if one is named."""
    narrow = records.select(F.col(record_col).alias("__record"), *([id_col] if id_col else []))
    own = f"`{id_col}` {narrow.schema[1].dataType.simpleString()}, " if id_col else ""
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                piece = batch.slice(start, 256)
                made = [(i, *r) for i, raw in enumerate(piece.column(0).to_pylist()) if raw is not None for r in derive_one(raw)]
                columns = list(zip(*made)) if made else [()] * (len(names) + 1)
                kinds = [pa.int64() if n == "content_length" else pa.bool_() if n == "truncated" else pa.binary() if n == "record" else pa.string() for n in names]
                arrays = [pa.array(c, k) for c, k in zip(columns[1:], kinds)]
                ids = [piece.column(1).take(pa.array(columns[0], pa.int64()))] if id_col else []
                yield pa.RecordBatch.from_arrays([*ids, *arrays], [*([id_col] if id_col else []), *names])

    return narrow.mapInArrow(build, own + RECORDS)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """record: every record of the files, without its closing empty lines."""
    rows = spark.read.option("lineSep", "\r\n\r\nWARC/").text(path)
    raw = F.col("value").cast("binary")
    whole = F.when(F.substring(raw, 1, 5) == F.lit(b"WARC/"), raw).otherwise(F.concat(F.lit(b"WARC/"), raw))
    return rows.where(F.length("value") > 0).select(whole.alias("record"))


def write_warc(records: DataFrame, path: str, record_col: str = "record", compression: str = "none") -> None:
    """Write whole records to files below path."""
    records.where(F.col(record_col).isNotNull()).select(F.col(record_col).cast("string").alias("value")).write.option(
        "lineSep", "\r\n\r\n").option("compression", compression).text(path)
