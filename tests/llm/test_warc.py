"""Derivative records against a brute-force version, and a round trip through files."""

import base64
import gzip
import hashlib
import html as pages_html
import json
import re

from pyspark.sql import functions as F

from tidemark.llm import warc
from tidemark.llm.queries import QUERIES


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def brute_text(page: str) -> str:
    page = re.sub(r"(?is)<!--.*?(?:-->|\Z)|<(script|style|noscript|template|title)\b.*?(?:</\1\s*>|\Z)", "", page)
    page = re.sub(r"[ \t\n\r\f\v]+", " ", page)
    page = re.sub(rf"(?i)</?(?:{warc.BLOCKS})\b[^<>]*>", "\n", page)
    page = re.sub(r"<[/!?]?[A-Za-z][^<>]*>", "", page)
    page = re.sub("[ \t\r\f ]+", " ", pages_html.unescape(page))
    return re.sub(r" ?\n[ \n]*", "\n", page).strip(" \n")


def of(rows):
    return {(r["page_id"], r["record_type"]): r for r in rows}


def test_query_against_brute_force(spark, sf):
    rows = of(QUERIES["op2_warc_derivatives"](spark, sf).collect())
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(rows) == 2 * len(pages)
    for p in pages:
        body = (p["html"] or "").encode()
        meta, text = rows[p["page_id"], "metadata"], rows[p["page_id"], "conversion"]
        assert meta["refers_to"] == text["refers_to"] and re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", meta["refers_to"])
        assert text["block"] == brute_text(p["html"] or "")
        for r in (meta, text):
            assert r["target_uri"] == p["url"] and r["source_payload_digest"] == sha1(body) and r["source_digest_holds"]
            assert r["block_digest"] == sha1(r["block"].encode()) and r["content_length"] == len(r["block"].encode())
        found = json.loads(meta["block"])
        assert found["conversion"] == text["record_id"] and found["http"]["payload_digest"] == sha1(body)
        assert {"name": "Content-Type", "value": "text/html; charset=utf-8"} in found["http"]["headers"]
        assert [x["url"] for x in found["html"]["links"]] == re.findall(r'<a href="([^"]*)"', p["html"] or "")
    assert len({r["record_id"] for r in rows.values()}) == len(rows)


def test_edges(spark):
    made = spark.createDataFrame(
        [
            (1, "http://a/", None, 5), (2, None, "", 5), (3, "http://b/", "<p>a&#233;&#xE9;&eacute;&amp;lt;&nosuch;&#0;<script>x", 5), (4, "http://c/", "<b>" * 50_000 + "<!-- " * 50_000, 5),
            (5, "http://d/", "one\n two<br>three<title>T &amp; U</title><a href='/x'>l</a><img src=y>", 5), (None, "http://e/", "x", 5), (None, "http://e/", "x", 5),
        ],
        "page_id long, url string, html string, block int",
    )
    rows = warc.derive(warc.responses(made), "page_id").collect()
    by = of(rows)
    assert len(rows) == 14 and len({r["record_id"] for r in rows}) == 12
    assert by[1, "conversion"]["block"] == "" and by[2, "conversion"]["target_uri"] == ""
    assert by[3, "conversion"]["block"] == "aééé&lt;&nosuch;�" and by[4, "conversion"]["block"] == ""
    assert by[5, "conversion"]["block"] == "one two\nthreel"
    found = json.loads(by[5, "metadata"]["block"])["html"]
    assert found["title"] == "T & U" and [(x["element"], x["url"]) for x in found["links"]] == [("a", "/x"), ("img", "y")]
    assert warc.derive(warc.responses(made.limit(0)), "page_id").collect() == []


def record(kind: str, block: bytes, **more: str) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": "<urn:uuid:1>", "WARC-Date": "2020-01-01T00:00:00Z", "WARC-Target-URI": "http://x/", "Content-Length": str(len(block)), **more}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def test_files(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\n\r\n"
    pdf = b"HTTP/1.1 200 OK\r\nContent-Type: application/pdf\r\n\r\n\xff\xfe"
    parts = [record("warcinfo", b"x"), record("response", http + b"<p>caf\xe9\r\n\r\nWARC/1.0", **{"WARC-Payload-Digest": "sha1:WRONG"}), record("response", pdf)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    (tmp_path / "in/b.warc").write_bytes(b"".join(parts) + b"WARC/1.0\r\nContent-Length: 99\r\n\r\ncut")
    read = warc.read_warc(spark, str(tmp_path / "in"))
    assert read.count() == 6
    out = warc.derive(read)
    assert sorted(r["record_type"] for r in out.collect()) == ["conversion"] * 2 + ["metadata"] * 4
    text = out.where("record_type = 'conversion'").first()
    assert text["block"] == "café WARC/1.0" and text["source_digest_holds"] is False and text["refers_to"] == "<urn:uuid:1>"
    meta = json.loads(out.where("record_type = 'metadata' AND source_digest_holds").first()["block"]) if out.where("source_digest_holds").count() else None
    assert meta is None
    warc.write_warc(out, str(tmp_path / "out"))
    back = warc.read_warc(spark, str(tmp_path / "out") + "/part-*")
    want = sorted((tuple(map(tuple, r["headers"])), r["block"].encode()) for r in out.collect())
    assert sorted((tuple(map(tuple, r["headers"])), bytes(r["block"])) for r in back.collect()) == want


def response(body: bytes, kind: str = "text/html", id_: str | None = "<urn:uuid:1>", target: str = "http://x/", **http: str):
    block = f"HTTP/1.1 200 OK\r\nContent-Type: {kind}\r\n".encode() + "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in http.items()).encode() + b"\r\n" + body
    headers = [("WARC-Type", "response"), ("WARC-Target-URI", target), ("WARC-Payload-Digest", sha1(body))] + ([("WARC-Record-ID", id_)] if id_ else [])
    return headers, block


def test_bodies_and_charsets(spark):
    chunks = b"5\r\n<p>he\r\n3;x=1\r\nllo\r\n0\r\n\r\n"
    cases = [
        (response(chunks, Transfer_Encoding="chunked"), "hello"),
        (response(b"not in chunks", Transfer_Encoding="chunked"), "not in chunks"),
        (response(b"3\r\nabc\r\n9\r\nde", Transfer_Encoding="Chunked"), "abcde"),
        (response(b"\x93q\x94 \x80 caf\xe9 \x81", "text/html; charset=windows-1252"), "“q” € café \x81"),
        (response(b"\x93q\x94", "text/plain; charset=\"ISO-8859-1\""), "“q”"),
        (response("日本語".encode("shift_jis"), "text/html; charset=Shift_JIS"), "日本語"),
        (response("简体".encode("gbk"), "text/html; charset=GBK"), "简体"),
        (response("\ufefföü".encode("utf-16-le"), "text/html; charset=utf-8"), "öü"),
        (response("\ufeffö".encode(), "text/plain"), "ö"),
        (response("<meta http-equiv=x content='text/html; charset=koi8-r'><p>привет".encode("koi8-r")), "привет"),
        (response("<meta charset=big5>中文".encode("big5")), "中文"),
        (response("ö\xff".encode("latin-1"), "text/html; charset=x-nothing"), "\ufffd\ufffd"),
        (response("4\r\n".encode() + "文".encode("gbk") + b"ab\r\n0\r\n\r\n", "text/html; charset=gb2312", Transfer_Encoding="chunked"), "文ab"),
        (response(b""), ""),
    ]
    rows = [(i, [{"name": n, "value": v} for n, v in h], b) for i, ((h, b), _) in enumerate(cases)]
    got = {(r.n, r.record_type): r for r in warc.derive(spark.createDataFrame(rows, f"n int, {warc.RECORD}"), "n").collect()}
    for i, (_, text) in enumerate(cases):
        assert got[i, "conversion"].block == text, i
        assert got[i, "conversion"].source_digest_holds is True, i
    assert json.loads(got[0, "metadata"].block)["http"]["payload_digest"] == sha1(b"<p>hello")


def test_references(spark):
    texts = ["AT&amp T &copy 2 &Eacute;&Uuml;&Ouml;&Ntilde; &ampfoo; &notit; &NotEqualTilde; &alpha;&rarr;", "&#150;&#x92;&#128;&#1;&#99999999;&#xD800;&", "&&amp;&;&x;&#;&#x;&hellip;&nbsp;x", "&CounterClockwiseContourIntegral;&AMP&AMP;"]
    got = [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(warc.unescape(F.col("t")).alias("x")).collect()]
    assert got == [pages_html.unescape(t) for t in texts]


def test_missing_ids_and_key_names(spark):
    rows = [(target, "k", [{"name": n, "value": v} for n, v in h], b) for target in ("http://a/", "http://b/") for h, b in [response(b"x", id_=None, target=target)]]
    out = warc.derive(spark.createDataFrame(rows, f"date string, n string, {warc.RECORD}"), "date", "n")
    assert out.columns[:2] == ["date_", "n"]
    got = out.collect()
    assert len({r.record_id for r in got}) == 4 and all(r.refers_to is None and r.date is None for r in got)
    assert {r["date_"] for r in got} == {"http://a/", "http://b/"}
