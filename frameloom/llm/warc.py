"""WARC responses and their derivatives: metadata and plain-text conversions.

A response record becomes a ``metadata`` record (what its headers and its page
say, as JSON) and a ``conversion`` record (its text).  Both refer to it through
``WARC-Refers-To``, keep its target, date, headers and digests, and have digests
of their own.  Record ids are name-based, so that a task that runs twice makes
the same records.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import html
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CRLF = b"\r\n"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122's name space of URLs
_BATCH_BYTES = 8 << 20
#: Compressed bytes that are expanded at a time.
_PART = 1 << 16

_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>", re.I)
_TAG = re.compile(r"""<[a-z/!?](?:[^>"']|"[^"]*"|'[^']*')*>|<[a-z/!?][^>]*>""", re.I)
_BLANKS = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([\w-]+)", re.I)
_LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_META = re.compile(r"<meta\b([^>]*)>", re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)
_META_CHARSET = re.compile(r"<meta\b[^>]*charset[^>]*>", re.I)
_ATTRIBUTE = re.compile(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")


def digest(data: bytes) -> str:
    """SHA-1 in base 32, as WARC files label it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{kind} {key}')}>"


def text_of(page: str) -> str:
    """The visible text: blocks become lines, entities characters, and runs of
    white space one blank or one line end."""
    text = _TAG.sub("", _BREAK.sub("\n", _HIDDEN.sub(" ", page)))
    return _LINES.sub("\n", _BLANKS.sub(" ", html.unescape(text))).strip()


def page_metadata(page: str) -> dict:
    shown = _HIDDEN.sub(" ", page)
    title, lang = _TITLE.search(shown), _LANG.search(shown)
    metas = []
    for m in _META.finditer(shown):
        own = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(m[1])}
        metas.append(own)
    return {
        "Title": " ".join(html.unescape(_TAG.sub("", title[1])).split()) if title else None,
        "Lang": lang[1] if lang else None,
        "Metas": metas,
        "Links": [html.unescape(a or b or c) for a, b, c in _LINK.findall(shown)],
    }


def make_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, *head])
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + _CRLF + block + _CRLF * 2


class Headers(list):
    """Names and values in order, repeats included; names match in any case."""

    @classmethod
    def of(cls, lines: list[str]) -> Headers:
        out = cls()
        for line in lines:
            if line[:1] in (" ", "\t") and out:  # a folded line goes on
                out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}".strip())
            elif ":" in line:
                name, _, value = line.partition(":")
                out.append((name.strip(), value.strip()))
        return out

    def first(self, name: str, default: str | None = None) -> str | None:
        return next((v for k, v in self if k.lower() == name.lower()), default)

    def all(self, name: str) -> list[str]:
        return [v for k, v in self if k.lower() == name.lower()]


def _length(headers: Headers) -> int:
    size = headers.first("Content-Length", "")
    if not size.isascii() or not size.isdigit():
        raise ValueError("the record has no length")
    return int(size)


def parse_record(record: bytes) -> tuple[Headers, bytes]:
    """Headers and block.  Raises ValueError where there is no whole record."""
    end = record.find(_CRLF * 2)
    if not record.startswith(b"WARC/") or end < 0:
        raise ValueError("not a WARC record")
    headers = Headers.of(record[:end].decode("utf-8", "replace").split("\r\n")[1:])
    size = _length(headers)
    block = record[end + 4 : end + 4 + size]
    if len(block) < size:
        raise ValueError("the record is cut short")
    return headers, block


def _unchunked(body: bytes) -> bytes:
    """The body of a chunked transfer; what doesn't look like one stays."""
    out, at = [], 0
    while True:
        end = body.find(_CRLF, at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not size or size.strip(b"0123456789abcdefABCDEF"):
            return b"".join(out) if out else body
        n = int(size, 16)
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2


def decoded_body(http: Headers, payload: bytes) -> bytes:
    """The payload without its transfer and content encodings.  An encoding that is
    unknown, or that the payload doesn't have, leaves it as it is."""
    if "chunked" in ",".join(http.all("Transfer-Encoding")).lower():
        payload = _unchunked(payload)
    codings = [c.strip().lower() for c in ",".join(http.all("Content-Encoding")).split(",") if c.strip()]
    for coding in reversed(codings):
        for bits in {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(coding, ()):
            unzip = zlib.decompressobj(bits)
            try:
                payload = unzip.decompress(payload) + unzip.flush()
                break
            except zlib.error:
                continue
    return payload


def charset_of(http: Headers, body: bytes) -> str:
    """The character set: a byte order mark's, the header's, the page's own, or UTF-8."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if body.startswith(mark):
            return name
    found = _CHARSET.search(http.first("Content-Type", ""))
    if not found and (meta := _META_CHARSET.search(body[:4096].decode("latin-1"))):
        found = _CHARSET.search(meta[0])
    name = found[1] if found else "utf-8"
    try:
        return "cp1252" if codecs.lookup(name).name in ("iso8859-1", "ascii") else name  # as browsers read them
    except LookupError:
        return "utf-8"


def response(key: str, url: str, page: str, date: str) -> bytes:
    payload = page.encode("utf-8", "surrogatepass")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    headers = [
        ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", f"{key} {url}")), ("WARC-Date", date), ("WARC-Target-URI", " ".join(url.split())),
        ("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", digest(payload)), ("Content-Type", "application/http; msgtype=response"),
    ]
    return make_record(headers, block)


def derivatives(record: bytes) -> tuple[dict, bytes, bytes]:
    """What was found, the metadata record, and the conversion record.

    Raises ValueError for what isn't a whole response record with an id.
    """
    headers, block = parse_record(record)
    source = headers.first("WARC-Record-ID")
    if headers.first("WARC-Type", "").lower() != "response" or source is None:
        raise ValueError("not a response record")
    head, _, payload = block.partition(_CRLF * 2)
    status, *lines = head.decode("utf-8", "replace").split("\r\n")
    http = Headers.of(lines)
    body = decoded_body(http, payload)
    page = body.decode(charset_of(http, body), "replace")
    target, date, claimed, own = headers.first("WARC-Target-URI", ""), headers.first("WARC-Date", ""), headers.first("WARC-Payload-Digest"), digest(payload)
    kept = [("WARC-Refers-To", source), ("WARC-Target-URI", target), ("WARC-Date", date)]
    found = {
        "Envelope": {
            "WARC-Header-Metadata": [list(x) for x in headers],
            "Actual-Payload-Digest": own,
            "Payload-Metadata": {"HTTP-Response-Metadata": {"Status-Line": status, "Headers": [list(x) for x in http], "HTML-Metadata": page_metadata(page)}},
        }
    }
    described = json.dumps(found, ensure_ascii=False, sort_keys=True).encode("utf-8", "surrogatepass")
    text = text_of(page)
    plain = text.encode("utf-8", "surrogatepass")
    ids = record_id("metadata", source), record_id("conversion", source)
    metadata = make_record([("WARC-Type", "metadata"), ("WARC-Record-ID", ids[0]), *kept, ("WARC-Block-Digest", digest(described)), ("Content-Type", "application/json")], described)
    # The source's digests and headers go along under names of their own: a record's
    # WARC-Payload-Digest would speak of the record's own payload.
    origin = [(f"WARC-Source-{name}", value) for name in ("Payload-Digest", "Block-Digest") for value in headers.all(f"WARC-{name}")]
    origin += [(f"WARC-Source-HTTP-{k}", v) for k, v in http if k.lower() in ("content-type", "content-encoding", "last-modified", "content-language")]
    conversion = make_record([("WARC-Type", "conversion"), ("WARC-Record-ID", ids[1]), *kept, *origin, ("WARC-Block-Digest", digest(plain)), ("Content-Type", "text/plain; charset=utf-8")], plain)
    row = {
        "response_id": source, "target_uri": target, "payload_digest": claimed, "payload_intact": claimed == own,
        "metadata_id": ids[0], "metadata_digest": digest(described), "conversion_id": ids[1], "conversion_digest": digest(plain), "text": text,
    }
    return row, metadata, conversion


def responses(pages: DataFrame, *, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id`` and ``record``: one response for each row.

    Null pages have an empty payload, null addresses an empty target.  Rows that
    repeat id and address make records with one id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 2):
                keys, urls, pages = (c.to_pylist() for c in part.columns)
                made = [response(str(k), u or "", p or "", date) for k, u, p in zip(keys, urls, pages)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], names=["page_id", "record"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "page_id long, record binary")


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of about ``_BATCH_BYTES`` of one column."""
    step = max(1, batch.num_rows * _BATCH_BYTES // max(1, batch.column(column).nbytes))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


_ROW = ["response_id", "target_uri", "payload_digest", "payload_intact", "metadata_id", "metadata_digest", "conversion_id", "conversion_digest", "text"]
_SCHEMA = "page_id long, " + ", ".join(f"{c} {'boolean' if c == 'payload_intact' else 'string'}" for c in _ROW) + ", metadata binary, conversion binary"


def derive(records: DataFrame, *, id_col: str = "page_id", record_col: str = "record") -> DataFrame:
    """The derivatives of response records, one row for each.

    Besides both records it has their ids and digests, the source's id, target
    and payload digest, whether the payload still has that digest, and the text.
    Headers are kept in order with their repeats; transfer and content encodings
    are undone, and characters read as the response says.  A null or broken record,
    and one that isn't a response, gives a row that has its id alone.  Rows that
    repeat give repeated rows; an empty table gives none; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 1):
                columns: list[list] = [[] for _ in range(len(_ROW) + 2)]
                for record in part.column(1).to_pylist():
                    try:
                        row, metadata, conversion = derivatives(record or b"")
                        values = [*(row[c] for c in _ROW), metadata, conversion]
                    except (ValueError, KeyError):
                        values = [None] * len(columns)
                    for column, value in zip(columns, values):
                        column.append(value)
                kinds = [pa.bool_() if c == "payload_intact" else pa.string() for c in _ROW] + [pa.binary()] * 2
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=["page_id", *_ROW, "metadata", "conversion"])

    return records.select(F.col(id_col).cast("long").alias("page_id"), F.col(record_col).alias("record")).mapInArrow(run, _SCHEMA)


def write_warc(records: DataFrame, out_dir: str, *, record_col: str = "record") -> int:
    """Writes one ``.warc.gz`` for each partition, a gzip member for each record.

    ``out_dir`` is a URI that all executors share.  Files get their names when
    they are whole.  Returns how many records were written; nulls aren't.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n = TaskContext.get(), 0
        fs, root = pafs.FileSystem.from_uri(out_dir)
        fs.create_dir(root, recursive=True)
        temp = f"{root}/_{task.partitionId():05d}-{task.taskAttemptId()}-{os.getpid()}"
        with fs.open_output_stream(temp) as out:
            for batch in batches:
                for record in batch.column(0).to_pylist():
                    if record is not None:
                        out.write(gzip.compress(record, 6, mtime=0))
                        n += 1
        fs.move(temp, f"{root}/part-{task.partitionId():05d}.warc.gz")
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return records.select(F.col(record_col).cast("binary")).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def split_members(data: bytes) -> Iterator[bytes]:
    """The records of a file's bytes: gzip members, or records one after another.

    Time is linear in the size, and a member alone is held besides ``data``.  What
    follows a broken member or record is looked for at the next start of one; white
    space between records is passed over.
    """
    view, at, size = memoryview(data), 0, len(data)
    while at < size:
        if data.startswith(b"\x1f\x8b", at):
            unzip, parts, to = zlib.decompressobj(31), [], at
            try:
                while not unzip.eof and to < size:
                    parts.append(unzip.decompress(view[to : to + _PART]))
                    to += _PART
            except zlib.error:
                at = _next(data, b"\x1f\x8b", at + 2)
                continue
            if not unzip.eof:
                return
            at = min(to, size) - len(unzip.unused_data)
            yield from split_members(b"".join(parts))  # mostly one record
        elif data.startswith(b"WARC/", at):
            end = data.find(_CRLF * 2, at)
            if end < 0:
                return
            try:
                length = _length(Headers.of(data[at:end].decode("utf-8", "replace").split("\r\n")[1:]))
            except ValueError:
                at = _next(data, b"WARC/1", at + 5)
                continue
            stop = end + 4 + length
            stop += 4 if data.startswith(_CRLF * 2, stop) else 0
            yield bytes(view[at : min(stop, size)])
            at = stop
        else:
            at = min(_next(data, b"WARC/1", at + 1), _next(data, b"\x1f\x8b", at + 1))


def _next(data: bytes, start: bytes, at: int) -> int:
    found = data.find(start, at)
    return found if found >= 0 else len(data)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``record_id``, ``kind`` and ``record`` of all records of files.

    A file is one task's and at most 2 GB, as Spark reads binary files.  A record
    that is cut short or has no length has null ``record_id`` and ``kind``; empty
    files and files without a record give no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 3 + [pa.binary()]
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, size = [], 0
                for record in split_members(content.as_py() or b""):
                    try:
                        headers, _ = parse_record(record)
                    except ValueError:
                        headers = Headers()
                    rows.append((file, headers.first("WARC-Record-ID"), headers.first("WARC-Type"), record))
                    size += len(record)
                    if size >= _BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["path", "record_id", "kind", "record"])
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["path", "record_id", "kind", "record"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path)
    return files.select("path", "content").mapInArrow(run, "path string, record_id string, kind string, record binary")
