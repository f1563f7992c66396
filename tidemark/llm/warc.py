"""WARC derivatives: metadata and plain-text conversion records for response records.

A record is a row with ``headers`` (an array of name and value, in order, names may repeat) and ``block`` (bytes). Each
response gives a metadata record (JSON: the source's WARC and HTTP headers, title, links) and, where its payload is
HTML or plain text, a conversion record (its text). Both refer to the response by WARC-Refers-To, keep its target, date
and digests, and have an id that follows from the response's id, so a task that runs again makes the same records.

Deriving is one narrow pass of column expressions; patterns are written to scan a text once, whatever is left unclosed.
Only payloads in chunks or in other encodings than UTF-8 and Latin go through an Arrow function.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator
from html.entities import html5

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh

HEADERS = "array<struct<name:string,value:string>>"
RECORD = f"headers {HEADERS}, block binary"
#: Named characters of HTML by first letter, and the old names that also count without a semicolon, longest first.
NAMED = {c: {n.rstrip(";"): v for n, v in html5.items() if n[0] == c} for c in sorted({n[0] for n in html5})}
OLD_NAMES = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
REFERENCE = rf"^(?:#(?:[0-9]+|[xX][0-9A-Fa-f]+);?|[A-Za-z][A-Za-z0-9]{{1,31}};|{OLD_NAMES})"
#: What a number from 128 to 159, in a reference or as a byte of windows-1252, stands for.
WESTERN = [bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(0x80, 0xA0)]
BLOCKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|td|th|tr|ul"
BLOCK_TAG = rf"(?i)</?(?:{BLOCKS})\b[^<>]*+>"
#: Comments, elements that hold no text, and all tags but those of blocks.
HIDDEN = rf"(?is)<(?:!--.*?(?:-->|\z)|(script|style|noscript|template|title)\b.*?(?:</\1\s*+>|\z)|(?!/?(?:{BLOCKS})\b)[/!?]?[A-Z][^<>]*+>)"
LINK_TAG = r"(?i)<(?:a|area|link|img|script|iframe)\s[^<>]*+>"
LINK = r"""(?i)\s(?:href|src)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)"""
DERIVED = ["record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "content_length", "block_digest", "source_payload_digest", "source_digest_holds", "headers", "block"]
RFC4648 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, also where a plan has no common subexpressions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sha1_digest(data: Column) -> Column:
    """``sha1:`` and the digest in base 32, as WARC tools write it."""

    def written(whole: Column) -> Column:
        parts = [F.lpad(F.conv(F.substring(whole, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
        return F.concat(F.lit("sha1:"), F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", RFC4648))

    return _once(F.sha1(data), written)


def record_id(*parts: Column) -> Column:
    """A UUID URN made from the parts' hash (version 8)."""

    def written(h: Column) -> Column:
        cut = lambda at, n: F.substring(h, at, n)
        return F.concat(F.lit("<urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-8"), cut(14, 3), F.lit("-b"), cut(18, 3), F.lit("-"), cut(21, 12), F.lit(">"))

    return _once(F.md5(F.concat_ws("\n", *parts).cast("binary")), written)


def header(headers: Column, name: str) -> Column:
    """The first value of a header, its name in any case; null where there is none."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), F.lit(0))["value"]


def _headers(**values: Column) -> Column:
    named = [F.struct(F.lit(k.replace("_", "-")).alias("name"), v.cast("string").alias("value")) for k, v in values.items()]
    return F.filter(F.array(*named), lambda h: h["value"].isNotNull())


def _parsed(lines: Column) -> Column:
    """Header lines as names and values; lines without a colon are left out."""
    named = F.filter(lines, lambda x: F.instr(x, ":") > 1)
    return F.transform(named, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("name"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("value")))


def unescape(text: Column) -> Column:
    """Character references replaced in one pass, as browsers read text.

    Unknown names stay, old names may lack their semicolon, numbers that name no character become U+FFFD, those of
    control characters nothing.
    """
    listed = lambda own: F.str_to_map(F.lit("\x02".join(f"{n}\x03{v}" for n, v in own.items())), F.lit("\x02"), F.lit("\x03"))
    names = F.create_map(*(x for c, own in NAMED.items() for x in (F.lit(c), listed(own))))
    western = F.array(*map(F.lit, WESTERN))

    def number(digits: Column) -> Column:
        code = F.when(F.lower(F.substring(digits, 1, 1)) == "x", F.conv(F.substring(digits, F.lit(2), F.length(digits)), 16, 10)).otherwise(digits).try_cast("long")
        return _once(code, lambda n: (
            F.when(n.between(0x80, 0x9F), F.get(western, (n - 0x80).cast("int"))).when(n.between(1, 8) | n.between(0xE, 0x1F) | n.isin(0xB, 0x7F), "")
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(F.when(((n > 0) & (n < 0xD800)) | ((n > 0xDFFF) & (n < 0x110000)), n).otherwise(0xFFFD)), 8, "0")), "UTF-32"))
        ))

    def named(name: Column) -> Column:
        return F.try_element_at(F.try_element_at(names, F.substring(name, 1, 1)), name)

    def piece(p: Column) -> Column:
        rest = lambda token, char: F.concat(char, F.substring(p, F.length(token) + 1, F.length(p)))
        old = lambda token: F.when(token == "", F.concat(F.lit("&"), p)).otherwise(rest(token, named(token)))

        def found(token: Column) -> Column:
            known = named(F.rtrim(token, F.lit(";")))
            number_of = number(F.regexp_replace(token, "[#;]", ""))
            return (
                F.when(F.startswith(token, F.lit("#")), rest(token, number_of))
                .when(F.endswith(token, F.lit(";")), F.when(known.isNotNull(), rest(token, known)).otherwise(_once(F.regexp_extract(p, rf"^(?:{OLD_NAMES})", 0), old)))
                .otherwise(old(token))
            )

        return _once(F.regexp_extract(p, REFERENCE, 0), found)

    def replaced(t: Column) -> Column:
        parts = F.split(t, "&", -1)
        joined = F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(piece(p))), "")
        return F.when(F.contains(t, F.lit("&")), joined).otherwise(t)

    return _once(text, replaced)


def unchunked(body: bytes) -> bytes:
    """The chunks of a body put together. A body that is not chunked, whatever its headers say, stays; a cut-off one is cut off."""
    at, out = 0, []
    while at < len(body):
        end = body.find(b"\r\n", at)
        size = body[at : end if end >= 0 else len(body)].partition(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,8}", size):
            return body if not out else b"".join(out)
        n = int(size, 16)
        if n == 0 or end < 0:
            break
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n
    return b"".join(out)


#: Labels that stand for a larger encoding than their name says.
WIDER = {"gb2312": "gb18030", "gbk": "gb18030", "x-gbk": "gb18030", "shift_jis": "cp932", "shift-jis": "cp932", "sjis": "cp932", "x-sjis": "cp932", "euc-kr": "cp949", "ks_c_5601-1987": "cp949", "big5": "big5hkscs", "utf-16": "utf-16-le", "tis-620": "cp874"}
LATIN = ("iso-8859-1", "iso8859-1", "latin1", "latin-1", "windows-1252", "cp1252")
UTF8 = ("utf-8", "utf8", "us-ascii", "ascii", "")


def in_charset(body: bytes, label: str) -> str:
    """A body's text; an unknown label is read as UTF-8, wrong bytes become U+FFFD."""
    if label in LATIN:
        return body.decode("latin-1").translate({0x80 + i: c for i, c in enumerate(WESTERN)})
    try:
        text = body.decode(WIDER.get(label, label), "replace")
    except LookupError:
        text = body.decode("utf-8", "replace")
    return text.removeprefix("\ufeff")


@F.pandas_udf(T.StructType([T.StructField("body", T.BinaryType()), T.StructField("text", T.StringType())]))
def _odd(body: pd.Series, label: pd.Series, chunked: pd.Series) -> pd.DataFrame:
    """Payloads that are sent in chunks or in an encoding that columns cannot read; null for all others."""
    whole = [None if b is None else unchunked(b) if c else b for b, c in zip(body, chunked, strict=True)]
    return pd.DataFrame({"body": whole, "text": [None if b is None else in_charset(b, x) for b, x in zip(whole, label, strict=True)]})


def plain_text(html: Column) -> Column:
    """The text of a page: scripts, styles, comments and the title left out, a line for each block (marked by U+0001 meanwhile)."""
    bare = F.regexp_replace(F.regexp_replace(html, HIDDEN, ""), BLOCK_TAG, "\x01")
    spaced = F.regexp_replace(unescape(bare), r"[\s\xA0]{2,}+|[\t\n\r\f\x0B\xA0]", " ")
    return F.trim(F.regexp_replace(spaced, r"\x20?\x01[\x20\x01]*+", "\n"), F.lit(" \n"))


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """``page_id, headers, block``: a response record for each page, made from its url and html.

    A null url is an empty target, null html an empty payload. Rows equal in id, url and html give equal records.
    """
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long"), url.alias("url"), body.alias("body"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("body").cast("string"), F.lit("\r\n\r\n"))
    built = base.withColumn("block", F.concat(head.cast("binary"), F.col("body"))).withColumn("digest", sha1_digest(F.col("body")))
    headers = _headers(
        WARC_Type=F.lit("response"), WARC_Record_ID=record_id(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("url"), F.col("digest")), WARC_Date=F.lit(date), WARC_Target_URI=F.col("url"),
        Content_Type=F.lit("application/http; msgtype=response"), WARC_Payload_Digest=F.col("digest"), WARC_Block_Digest=sha1_digest(F.col("block")), Content_Length=F.octet_length("block"),
    )
    return built.select("page_id", headers.alias("headers"), "block")


def derive(records: DataFrame, *keys: str) -> DataFrame:
    """The derivative records of all responses in ``records``, with the columns named by ``keys`` carried along.

    Returns ``record_type, record_id, refers_to, target_uri, date, content_type, content_length, block_digest,
    source_payload_digest, source_digest_holds, headers, block`` (block as text). A key of such a name gets underscores
    appended. Records of other types, and null headers, give nothing. A null block is empty. A payload that is not HTML
    or plain text, or is compressed, has a metadata record only. Chunks are put together. The encoding is what a byte
    order mark, the headers or a meta element say, in this order, else UTF-8; wrong bytes become U+FFFD. A response
    without a record id is told from others by target, date and block; ``refers_to`` is null. ``source_digest_holds``
    (of the payload as sent or put together) is null where the source gives no SHA-1 payload digest. A tag ends at its
    first ``>``. Repeated records each give theirs, with equal ids.
    """
    base = records.select(F.struct(*keys or [F.lit(0)]).alias("key"), F.col("headers").alias("source"), F.coalesce(F.col("block"), F.lit(b"")).alias("raw"))
    base = base.where(F.lower(header(F.col("source"), "WARC-Type")) == "response")
    head = F.substring_index(F.col("raw").cast("string"), "\r\n\r\n", 1)
    split = base.withColumn("head", head).withColumn("sent", F.substring("raw", F.octet_length("head") + 5, F.octet_length("raw")))
    lines = F.split(F.make_valid_utf8("head"), "\r\n")
    split = split.withColumns({"status": F.get(lines, F.lit(0)), "http": _parsed(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))))})
    of = lambda name, default: F.lower(F.coalesce(header(F.col("http"), name), F.lit(default)))
    given = header(F.col("source"), "WARC-Payload-Digest")
    unnamed = record_id(F.lit("source"), *(F.coalesce(header(F.col("source"), f"WARC-{n}"), F.lit("")) for n in ("Target-URI", "Date")), F.sha1("raw"))
    given_id = header(F.col("source"), "WARC-Record-ID")
    split = split.withColumns({"kind": of("Content-Type", ""), "given": given, "given_id": given_id, "id": F.coalesce(given_id, unnamed)})
    encoded = of("Content-Encoding", "identity") != "identity"
    html = F.regexp_like("kind", F.lit(r"^(?:text/html|application/xhtml\+xml)\b"))
    plain = F.regexp_like("kind", F.lit(r"^text/plain\b"))
    mark = F.hex(F.substring("sent", 1, 3))
    marked = F.when(F.startswith(mark, F.lit("EFBBBF")), "utf-8").when(F.startswith(mark, F.lit("FEFF")), "utf-16-be").when(F.startswith(mark, F.lit("FFFE")), "utf-16-le")
    stated = F.nullif(F.regexp_extract("kind", r"charset=\s*[\"']?\s*([^\"'\s;,]+)", 1), F.lit(""))
    meta = F.regexp_extract(F.lower(F.decode(F.substring("sent", 1, 1024), "ISO-8859-1")), r"<meta\s[^<>]*charset\s*=\s*[\"']?\s*([^\"'\s;/>]+)", 1)
    meta = F.when(F.startswith(meta, F.lit("utf-16")), "utf-8").otherwise(meta)
    split = split.withColumns({"label": F.coalesce(marked, stated, F.when(html, meta), F.lit("")), "chunked": F.contains(of("Transfer-Encoding", ""), F.lit("chunked"))})
    odd = F.col("chunked") | ((html | plain) & ~encoded & ~F.col("label").isin(*UTF8, *LATIN))
    split = split.withColumn("odd", _odd(F.when(odd, F.col("sent")), "label", "chunked"))
    body = F.coalesce("odd.body", "sent")
    latin = F.translate(F.decode("sent", "ISO-8859-1"), "".join(map(chr, range(0x80, 0xA0))), "".join(WESTERN))
    read = F.when(F.col("label").isin(*LATIN), latin).otherwise(F.regexp_replace(F.make_valid_utf8(F.col("sent").cast("string")), "^\ufeff", ""))
    split = split.withColumns({"body": body, "own": sha1_digest(body), "page": F.when((html | plain) & ~encoded, F.coalesce("odd.text", read))})
    split = split.withColumn("as_sent", F.when(F.col("chunked"), sha1_digest(F.col("sent"))))
    split = split.withColumn("text", F.when(html, plain_text(F.col("page"))).otherwise(F.col("page"))).drop("raw", "head", "sent", "odd")

    marked = F.when(html, F.col("page"))
    bare = lambda v: F.when(F.substring(v, 1, 1).isin('"', "'"), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    link = lambda tag: F.struct(F.lower(F.regexp_extract(tag, r"^<([A-Za-z]+)", 1)).alias("element"), _once(F.regexp_extract(tag, LINK, 1), bare).alias("url"))
    links = F.filter(F.transform(F.regexp_extract_all(marked, F.lit(LINK_TAG), F.lit(0)), link), lambda x: x["url"] != "")
    title = F.trim(F.regexp_replace(unescape(F.regexp_extract(marked, r"(?is)<title\b[^<>]*+>(.*?)(?:</title|\z)", 1)), r"\s+", " "))
    split = split.withColumns({"links": links, "title": title, "conversion_id": F.when(F.col("text").isNotNull(), record_id(F.lit("conversion"), F.col("id")))})
    json = F.to_json(
        F.struct(
            F.col("source").alias("warc_headers"),
            F.struct(F.col("status").alias("status"), F.col("http").alias("headers"), F.octet_length("body").alias("payload_length"), F.col("own").alias("payload_digest")).alias("http"),
            F.struct(F.col("title"), F.col("links")).alias("html"), F.col("conversion_id").alias("conversion"),
        )
    )
    split = split.withColumn("json", json)
    named = ("Target-URI", "Date", "Block-Digest")
    digits = lambda c: F.upper(F.substring(c, 6, 100))
    holds = (digits("given") == digits("own")) | F.coalesce(digits("given") == digits("as_sent"), F.lit(False))
    split = split.select(
        "key", "id", "given_id", "json", "text", "conversion_id", F.coalesce("given", "own").alias("payload"), F.when(F.lower("given").startswith("sha1:"), holds).alias("holds"),
        *(header(F.col("source"), f"WARC-{n}").alias(n) for n in named), record_id(F.lit("metadata"), F.col("id")).alias("metadata_id"), sha1_digest(F.col("json").cast("binary")).alias("json_digest"), sha1_digest(F.col("text").cast("binary")).alias("text_digest"),
    )

    def record(kind: str, own_id: str, content_type: str, block: str, digest: str) -> Column:
        values = {"record_type": F.lit(kind), "record_id": F.col(own_id), "content_type": F.lit(content_type), "content_length": F.octet_length(block).cast("long"), "block_digest": F.col(digest), "block": F.col(block)}
        return F.struct(*(v.alias(k) for k, v in values.items()))

    made = F.array(record("metadata", "metadata_id", "application/json", "json", "json_digest"), record("conversion", "conversion_id", "text/plain; charset=utf-8", "text", "text_digest"))
    out = split.select("key", "given_id", "payload", "holds", *named, F.explode_outer(F.when(F.col("text").isNull(), F.slice(made, 1, 1)).otherwise(made)).alias("r"))
    headers = _headers(
        WARC_Type=F.col("r.record_type"), WARC_Record_ID=F.col("r.record_id"), WARC_Refers_To=F.col("given_id"), WARC_Target_URI=F.col("Target-URI"), WARC_Date=F.col("Date"), WARC_Block_Digest=F.col("r.block_digest"),
        WARC_Source_Payload_Digest=F.col("payload"), WARC_Source_Block_Digest=F.col("Block-Digest"), Content_Type=F.col("r.content_type"), Content_Length=F.col("r.content_length"),
    )
    return out.select(
        *(F.col(f"key.`{k}`").alias(fresh(k, DERIVED)) for k in keys), "r.record_type", "r.record_id", F.col("given_id").alias("refers_to"), F.col("Target-URI").alias("target_uri"), F.col("Date").alias("date"), "r.content_type", "r.content_length", "r.block_digest",
        F.col("payload").alias("source_payload_digest"), F.col("holds").alias("source_digest_holds"), headers.alias("headers"), "r.block",
    )


def write_warc(records: DataFrame, path: str) -> None:
    """Derived records as uncompressed WARC files, one a task; records stand apart by two line ends, as the format has it."""
    lines = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), F.regexp_replace(h["value"], r"[\r\n]+", " "), F.lit("\r\n"))), "")
    text = F.concat(F.lit("WARC/1.0\r\n"), lines, F.lit("\r\n"), F.col("block").cast("string"))
    records.select(text.alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def _records(data: bytes) -> Iterator[tuple[list[dict], bytes]]:
    """The records of a file, gzipped by record or whole, or not at all. A cut-off last record is left out."""
    file = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := file.readline():
        if not line.startswith(b"WARC/"):
            continue
        headers: list[dict] = []
        while (line := file.readline()) not in (b"\r\n", b"\n", b""):
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[:1] in (" ", "\t") and headers:
                headers[-1]["value"] += " " + text.strip()
            elif ":" in text:
                name, _, value = text.partition(":")
                headers.append({"name": name.strip(), "value": value.strip()})
        size = next((int(h["value"]) for h in headers if h["name"].lower() == "content-length" and h["value"].isdigit()), 0)
        block = file.read(size)
        if len(block) == size:
            yield headers, block


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))

    def batch(rows: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array([h for h, _ in rows], kind), pa.array([b for _, b in rows], pa.binary())], ["headers", "block"])

    for files in batches:
        for i in range(files.num_rows):
            held, size = [], 0
            for h, b in _records(files.column("content")[i].as_py() or b""):
                held.append((h, b))
                size += len(b)
                if size > 8 << 20:
                    yield batch(held)
                    held, size = [], 0
            yield batch(held)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``headers, block`` of every record in the WARC files at a path; a file (up to Spark's 2 GB) is read by one task."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_read, RECORD)
