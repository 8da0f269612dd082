import base64
import gzip
import hashlib
import json
import uuid
import zlib
from html.parser import HTMLParser

from frameloom.llm import queries
from frameloom.llm.common import fresh_path
from frameloom.llm.warc import derive, derivatives, page_metadata, parse_record, read_warc, response, responses, split_members, text_of, write_warc

SF = "/root/testdata/sf0.01"


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


class Plain(HTMLParser):
    """Visible characters by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "noscript", "template")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "noscript", "template") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def test_texts_of_pages_against_a_parser(spark):
    for r in spark.read.parquet(f"{SF}/pages.parquet").limit(120).collect():
        parser = Plain()
        parser.feed(r.html)
        assert "".join(text_of(r.html).split()) == "".join("".join(parser.out).split())


def test_text_rules():
    page = "<!DOCTYPE html><title>A &amp; B</title><script>var t='</p>';</script><p>one<br>two <b>bold</b>&nbsp;x</p><!-- no --><a href='/x?a=1&amp;b=2' title=\"a > b\">link</a> 1 < 2 <style>p{}"
    assert text_of(page) == "A & B\none\ntwo bold x\nlink 1 < 2"
    found = page_metadata(page + "<meta name=k content='v &lt;'>")
    assert found["Title"] == "A & B" and found["Links"] == ["/x?a=1&b=2"]
    assert text_of("") == "" and text_of("<!-- " * 20_000) == "" and text_of("<" * 50_000 + "a") == "<" * 50_000 + "a"


def test_records_link_and_keep_digests():
    source = response("7", "http://x/é", "<html lang=fr><p>text", "2024-01-01T00:00:00Z")
    row, metadata, conversion = derivatives(source)
    headers, block = parse_record(source)
    payload = block.split(b"\r\n\r\n", 1)[1]
    assert headers.first("WARC-Payload-Digest") == sha1(payload) == row["payload_digest"] and row["payload_intact"]
    for record, kind in ((metadata, "metadata"), (conversion, "conversion")):
        own, body = parse_record(record)
        assert own.first("WARC-Type") == kind and own.first("WARC-Refers-To") == headers.first("WARC-Record-ID") != own.first("WARC-Record-ID")
        assert own.first("WARC-Target-URI") == "http://x/é" and own.first("WARC-Date") == headers.first("WARC-Date") and own.first("WARC-Block-Digest") == sha1(body)
    envelope = json.loads(parse_record(metadata)[1])["Envelope"]
    assert [tuple(x) for x in envelope["WARC-Header-Metadata"]] == headers and envelope["Payload-Metadata"]["HTTP-Response-Metadata"]["HTML-Metadata"]["Lang"] == "fr"
    assert parse_record(conversion)[1] == b"text"
    changed = source.replace(b"<p>text", b"<p>next")
    assert derivatives(changed)[0]["payload_intact"] is False
    assert list(split_members(source + metadata)) == [source, metadata]


def test_files_round_trip_and_edge_cases(spark):
    pages = spark.createDataFrame([(1, "http://a", "<p>x", 1), (1, "http://a", "<p>x", 1), (None, None, None, 2), (3, "", "y" * 300_000, 2)], "page_id long, url string, html string, record int")
    records = responses(pages)
    out = fresh_path(spark, "warc")
    assert write_warc(records, out) == 4
    back = read_warc(spark, out)
    assert sorted(bytes(r.record) for r in back.collect()) == sorted(bytes(r.record) for r in records.collect())
    assert {r.kind for r in back.collect()} == {"response"}
    made = derive(records)
    assert sorted((r.page_id or 0, len(r.text)) for r in made.collect()) == [(0, 0), (1, 1), (1, 1), (3, 300_000)]
    broken = spark.createDataFrame([(1, b"junk"), (2, None), (3, b"WARC/1.1\r\nContent-Length: 9\r\n\r\nx")], "page_id long, record binary")
    assert [(r.page_id, r.response_id, r.text) for r in derive(broken).orderBy("page_id").collect()] == [(1, None, None), (2, None, None), (3, None, None)]
    assert derive(records.limit(0)).count() == 0


def raw(head, body, kind="response", extra=""):
    block = head.encode() + b"\r\n\r\n" + body
    return f"WARC/1.0\r\nwarc-type: {kind}\r\nWARC-Record-ID: <urn:x>\r\n{extra}content-length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_headers_keep_repeats_and_match_in_any_case():
    record = raw("HTTP/1.1 200 OK\r\nSet-Cookie: a\r\nset-cookie: b\r\nX-Long: one\r\n  two", b"<p>hi", extra="WARC-Concurrent-To: <urn:1>\r\nWARC-Concurrent-To: <urn:2>\r\nwarc-payload-digest: " + sha1(b"<p>hi") + "\r\n")
    row, metadata, conversion = derivatives(record)
    envelope = json.loads(parse_record(metadata)[1])["Envelope"]
    assert [v for k, v in envelope["WARC-Header-Metadata"] if k == "WARC-Concurrent-To"] == ["<urn:1>", "<urn:2>"]
    http = envelope["Payload-Metadata"]["HTTP-Response-Metadata"]["Headers"]
    assert http == [["Set-Cookie", "a"], ["set-cookie", "b"], ["X-Long", "one two"]]
    assert row["payload_intact"] and row["text"] == "hi"
    assert parse_record(conversion)[0].first("WARC-Source-Payload-Digest") == sha1(b"<p>hi")


def test_characters_and_encodings():
    page = "<p>café – ñ"
    text = lambda head, body: derivatives(raw(f"HTTP/1.1 200 OK\r\n{head}", body))[0]["text"]
    assert text("Content-Type: text/html; charset=ISO-8859-1", "<p>café".encode("latin-1")) == "café"
    assert text("X: y", '<meta charset="windows-1252"><p>café – ñ'.encode("cp1252")) == "café – ñ"
    assert text("Content-Type: text/html; charset=nonsense", page.encode()) == text("X: y", page.encode()) == "café – ñ"
    assert text("X: y", page.encode("utf-16")) == "café – ñ"
    packed = gzip.compress(page.encode())
    assert text("content-encoding: gzip", packed) == "café – ñ"
    assert text("Content-Encoding: deflate", zlib.compress(page.encode())) == text("Content-Encoding: deflate", zlib.compress(page.encode())[2:-4]) == "café – ñ"
    chunks = b"".join(f"{len(packed[i : i + 7]):x};x=1\r\n".encode() + packed[i : i + 7] + b"\r\n" for i in range(0, len(packed), 7)) + b"0\r\n\r\n"
    assert text("Transfer-Encoding: chunked\r\nContent-Encoding: gzip", chunks) == "café – ñ"
    assert text("Transfer-Encoding: chunked\r\nContent-Encoding: gzip", page.encode()) == "café – ñ"  # already undone


def test_only_responses_have_derivatives(spark):
    rows = [(1, raw("software: x", b"", "warcinfo")), (2, raw("GET / HTTP/1.1", b"", "request")), (3, raw("HTTP/1.1 200 OK", b"<p>a", "RESPONSE"))]
    made = {r.page_id: (r.response_id, r.text) for r in derive(spark.createDataFrame(rows, "page_id long, record binary")).collect()}
    assert made == {1: (None, None), 2: (None, None), 3: ("<urn:x>", "a")}


def test_files_with_broken_parts_are_read_on():
    good, other = raw("HTTP/1.1 200 OK", b"<p>a"), raw("HTTP/1.1 200 OK", b"<p>" + b"b" * 200_000)
    assert list(split_members(good + b"\r\n" + b"WARC/1.0\r\nno length\r\n\r\n" + other)) == [good, other]
    one, two = gzip.compress(good), gzip.compress(other)
    broken = one[:12] + b"\xff\xff\xff" + one[15:]
    assert list(split_members(one + broken + two)) [-1] == other and list(split_members(one + two)) == [good, other]
    assert list(split_members(gzip.compress(good + other))) == [good, other] and list(split_members(b"")) == list(split_members(b"junk")) == []


def test_the_query_against_plain_rules(spark):
    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    rows = queries.op9_warc_derivatives(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(pages)
    named = lambda kind, key: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {key}')}>"
    for r in rows:
        page = pages[r.page_id]
        payload, target = (page.html or "").encode(), " ".join((page.url or "").split())
        source = named("response", f"{page.page_id} {page.url or ''}")
        parser = Plain()
        parser.feed(page.html or "")
        text = text_of(page.html or "")
        assert "".join(text.split()) == "".join("".join(parser.out).split())
        assert (r.response_id, r.target_uri, r.payload_digest, r.payload_intact) == (source, target, sha1(payload), True)
        assert (r.metadata_id, r.conversion_id) == (named("metadata", source), named("conversion", source))
        assert (r.conversion_digest, r.text_chars) == (sha1(text.encode()), len(text))
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
        lines = [
            "WARC/1.1", "WARC-Type: conversion", f"WARC-Record-ID: {r.conversion_id}", f"WARC-Refers-To: {source}", f"WARC-Target-URI: {target}", "WARC-Date: 2024-01-01T00:00:00Z",
            f"WARC-Source-Payload-Digest: {sha1(payload)}", f"WARC-Source-Block-Digest: {sha1(block)}", "WARC-Source-HTTP-Content-Type: text/html; charset=utf-8",
            f"WARC-Block-Digest: {sha1(text.encode())}", "Content-Type: text/plain; charset=utf-8", f"Content-Length: {len(text.encode())}", "", text, "", "",
        ]
        assert r.conversion_sha256 == hashlib.sha256("\r\n".join(lines).encode()).hexdigest()
    whole = queries.op9_warc_derivatives(spark, SF).collect()
    assert len(whole) == 250 and all(r.payload_intact for r in whole) and len({r.conversion_id for r in whole}) == 250
