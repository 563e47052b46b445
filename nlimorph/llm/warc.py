"""Operator 12: WARC archives of pages, written and read back.

Writing. Each row becomes a record. Payloads of ``revisit_from`` bytes or more that are equal have one response, of
the largest page id, and revisit records that refer to it; which, is found over digests and ids, so no page moves for it. A
response is an HTTP message in chunked transfer coding, and a message of more than ``segment_bytes`` is cut into a first record and
continuation records. Spark's text writer writes the records with its commit protocol: a lost task leaves no file, on any file
system. The version line of a record stands in no chunk, since chunks are cut inside it where a page has it.

Reading. Spark's text reader cuts archives at version lines; a piece that is shorter than its length field says is put
together with the next ones, so that records which hold a version line are read whole (in compressed archives, which
are not split; in plain ones if they lie in one split). Records of one segment are decoded where they are read. Continuation
records are grouped by the id of their origin and ordered by segment number; numbers must run from 1 without gaps and the
lengths must add up to the total that the last one states. Only segments are shuffled; a group is one page. Then the chunked
framing is taken off, and revisits look up their response.

Rows are told apart by ``row_key`` (such as file and row number of a table that is read); without it the table is written
out first and its own rows are numbered. Record ids come from that key, so a task that runs again writes the same.

Defined results: null html is empty and keeps a row; a null page id stays null and is the smallest; of equal pages with equal ids
one is the response; a null url has no target field; repeated rows keep a record each; very long pages are cut and put
together whole; an empty table gives an archive without pages; other columns are not read. ``verified`` is false where segments,
lengths, framing or the digest do not fit, or a revisit has no response; such rows have the payload that could be read, else
null.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nlimorph.llm._shared import materialize, split_batch

VERSION = b"WARC/1.1"
END = b"\r\n\r\n"
#: The date of records of pages without one, and the profile of revisits.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
FIELDS = {
    "record_id": "string", "record_type": "string", "page_id": "string", "target_uri": "string", "payload_digest": "string",
    "refers_to": "string", "origin_id": "string", "segment": "long", "total_length": "long", "whole": "boolean", "block": "binary",
}
SCHEMA = ", ".join(f"{name} {kind}" for name, kind in FIELDS.items())
_ARROW = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def chunked(payload: bytes, chunk_bytes: int) -> bytes:
    """The payload in chunked transfer coding; no chunk holds a version line."""
    cuts = {*range(0, len(payload), chunk_bytes), *(m.start() + 1 for m in re.finditer(re.escape(VERSION), payload)), len(payload)}
    at = sorted(cuts)
    return b"".join(b"%x\r\n%s\r\n" % (b - a, payload[a:b]) for a, b in zip(at, at[1:], strict=False)) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes | None:
    """What chunked transfer coding holds; None if the framing is broken."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        size = body[at:line].split(b";")[0].strip() if line >= 0 else b""
        if not re.fullmatch(b"[0-9a-fA-F]{1,15}", size):
            return None
        n, at = int(size, 16), line + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            return None
        out.append(body[at : at + n])
        at += n + 2


def payload_of(block: bytes) -> bytes | None:
    """The body of an HTTP message, without chunked framing; None if it is broken."""
    head, end, body = block.partition(END)
    if not end:
        return None
    return dechunked(body) if re.search(rb"(?im)^transfer-encoding:[^\r\n]*\bchunked\b", head) else body


def _urn(hex32: str) -> str:
    return f"<urn:uuid:{hex32[:8]}-{hex32[8:12]}-{hex32[12:16]}-{hex32[16:20]}-{hex32[20:]}>"


def _record(fields: dict[str, str | int | None], block: bytes) -> bytes:
    lines = [f"{name}: {value}" for name, value in fields.items() if value is not None]
    return VERSION + b"\r\n" + "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + END + block


def _records(page_id: str | None, url: str | None, payload: bytes, key: str, digest: str, refers: str | None, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The records of one page."""
    quoted = None if page_id is None else quote(page_id, safe="")
    common = {"WARC-Date": DATE, "WARC-Target-URI": None if url is None else quote(url, safe="%/:=&?~#+!$,;'@()*[]")}
    first = {"Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(), "Page-Id": quoted}
    if refers is not None:
        yield _record({"WARC-Type": "revisit", "WARC-Record-ID": _urn(key), **common, **first, "WARC-Profile": PROFILE, "WARC-Refers-To": _urn(refers)}, HTTP + b"\r\n")
        return
    message = HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    cut = len(message) > segment_bytes
    yield _record({"WARC-Type": "response", "WARC-Record-ID": _urn(key), **common, **first, "WARC-Segment-Number": 1 if cut else None}, message[:segment_bytes])
    for number, at in enumerate(range(segment_bytes, len(message), segment_bytes), 2):
        own = hashlib.md5(f"{key}/{number}".encode()).hexdigest()
        total = len(message) if at + segment_bytes >= len(message) else None
        fields = {"WARC-Type": "continuation", "WARC-Record-ID": _urn(own), **common, "WARC-Segment-Origin-ID": _urn(key), "WARC-Segment-Number": number, "WARC-Segment-Total-Length": total}
        yield _record(fields, message[at : at + segment_bytes])


def _own_key(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    table = materialize(df.select(*columns), "pages")
    return table.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at")), ["_file", "_at"]


def write_archives(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", row_key: list[str] | None = None, revisit_from: int = 1000, segment_bytes: int = 8192, chunk_bytes: int = 4096) -> None:
    """A WARC record for each row of df, as archives in the folder ``path``, compressed by gzip."""
    rows, key = (df, row_key) if row_key else _own_key(df, [id_col, url_col, html_col])
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    marked = rows.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.md5(F.concat_ws("/", *[F.col(c).cast("string") for c in key])).alias("key"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size")
    )
    again = marked.where(F.col("size") >= revisit_from).groupBy("digest").agg(F.max(F.struct("id", "key"))["key"].alias("first"), F.count("*").alias("n"))
    firsts = materialize(again.where(F.col("n") > 1).select(F.col("digest").alias("_digest"), "first"), "responses")
    met = marked.join(firsts, F.col("digest") == F.col("_digest"), "left")
    refers = F.when(F.col("key") != F.col("first"), F.col("first"))
    pages = met.select(F.col("id").cast("string").alias("id"), "url", "payload", "key", "digest", refers.alias("refers"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = {"WARC-Type": "warcinfo", "WARC-Date": DATE, "Content-Type": "application/warc-fields"}
        for batch in batches:
            for part in split_batch(batch, "payload", 4 << 20):
                out = [r for row in zip(*(part.column(k).to_pylist() for k in range(6)), strict=True) for r in _records(*row, segment_bytes, chunk_bytes)]
                if info and part.num_rows:
                    out.insert(0, _record({**info, "WARC-Record-ID": _urn(hashlib.md5(f"info/{part.column(3)[0].as_py()}".encode()).hexdigest())}, b"format: WARC File Format 1.1\r\n"))
                    info = {}
                yield pa.RecordBatch.from_pydict({"record": pa.array(out, pa.binary())})

    pages.mapInArrow(write, "record binary").select(F.col("record").cast("string").alias("value")).write.option("compression", "gzip").option("lineSep", END.decode()).text(path)


def _parse(piece: bytes) -> tuple[dict[str, str], int, int] | None:
    """Fields of a record, where its block begins and ends; None if its header has no end or no length."""
    stop = piece.find(END)
    if stop < 0:
        return None
    fields = {}
    for line in piece[:stop].decode("utf-8", "replace").split("\r\n"):
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    size = fields.get("content-length", "")
    return (fields, stop + 4, stop + 4 + int(size)) if size.isdecimal() else None


def _number(text: str | None) -> int | None:
    return int(text) if text and text.isdecimal() and len(text) < 19 else None


def _hex_digest(text: str | None) -> str | None:
    """sha1:base32 or sha1:hex as bare hex."""
    kind, _, value = (text or "").partition(":")
    if kind.lower() != "sha1":
        return None
    return base64.b32decode(value.upper()).hex() if re.fullmatch("[A-Za-z2-7]{32}", value) else value.lower()


def _row(fields: dict[str, str], block: bytes, whole: bool) -> tuple:
    page = fields.get("page-id")
    return (
        fields.get("warc-record-id"), fields.get("warc-type"), None if page is None else unquote(page), fields.get("warc-target-uri"), _hex_digest(fields.get("warc-payload-digest")),
        fields.get("warc-refers-to"), fields.get("warc-segment-origin-id"), _number(fields.get("warc-segment-number")), _number(fields.get("warc-segment-total-length")), whole, block,
    )


def _cutter(segments: bool | None):
    """Pieces between version lines to records, for mapInArrow; with or without the segmented ones, or all."""

    def records(pieces: Iterator[tuple[tuple, bytes]]) -> Iterator[tuple]:
        where, held = None, b""
        for at, piece in pieces:
            if at == where and held:
                piece = held + VERSION + b"\r\n" + piece
            elif held:
                yield from broken(held)
            where, held = at, b""
            found = _parse(piece)
            if found and found[2] <= len(piece):
                yield _row(found[0], piece[found[1] : found[2]], True)
            else:
                held = piece
        if held:
            yield from broken(held)

    def broken(piece: bytes) -> Iterator[tuple]:
        found = _parse(piece)
        if found and "warc-type" in found[0]:
            yield _row(found[0], piece[found[1] :], False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = (((f, s), v) for b in batches for f, s, v in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
        out, size = [], 0
        for row in records(pieces):
            if segments is None or (row[7] is not None) == segments:
                out.append(row)
                size += len(row[-1])
            if size > 4 << 20 or len(out) >= 4096:
                yield made(out)
                out, size = [], 0
        yield made(out)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(FIELDS)
        return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[kind]) for c, kind in zip(columns, FIELDS.values(), strict=True)], list(FIELDS))

    return run


def read_records(spark: SparkSession, path: str, segments: bool | None = None) -> DataFrame:
    """All records of archives, one a row, segmented or not; ``whole`` tells whether a block is as long as stated."""
    pieces = spark.read.text(path, lineSep=VERSION.decode() + "\r\n")
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    return pieces.select(*at, F.col("value").cast("binary").alias("value")).mapInArrow(_cutter(segments), SCHEMA)


def reassemble(segments: DataFrame) -> DataFrame:
    """Segmented records put together by origin; ``whole`` if their numbers have no gap and their lengths add up."""
    origin = F.when(F.col("segment") == 1, F.col("record_id")).otherwise(F.col("origin_id"))
    first = [F.first(F.when(F.col("segment") == 1, F.col(c)), ignorenulls=True).alias(c) for c in ("record_type", "page_id", "target_uri", "payload_digest", "refers_to")]
    parts = F.array_sort(F.collect_list(F.struct("segment", "total_length", "whole", "block")))
    by = segments.where(origin.isNotNull()).groupBy(origin.alias("record_id")).agg(*first, parts.alias("parts"))
    block = F.array_join(F.transform("parts", lambda p: p["block"].cast("string")), "").cast("binary")
    put = by.select("*", block.alias("block"))
    in_order = F.transform("parts", lambda p: p["segment"]) == F.sequence(F.lit(1).cast("long"), F.size("parts").cast("long"))
    total = F.element_at("parts", -1)["total_length"]
    whole = F.coalesce(in_order & F.forall("parts", lambda p: p["whole"]) & (F.octet_length("block") == total), F.lit(False))
    return put.select(*[F.col(c) if c in put.columns else (whole if c == "whole" else F.lit(None).cast(kind)).alias(c) for c, kind in FIELDS.items()])


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, record_type, page_id, target_uri, payload_digest, refers_to, payload, verified) of responses and revisits.

    The digest is the stated one; a revisit has no payload of its own.
    """
    blocks = read_records(spark, path, segments=False).unionByName(reassemble(read_records(spark, path, segments=True)))
    kept = [c for c in FIELDS if c not in ("origin_id", "segment", "total_length", "block")]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in split_batch(batch, "block", 4 << 20):
                payloads = [payload_of(b) for b in part.column(len(kept)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(payloads, pa.binary())], [*kept, "payload"])

    held = blocks.where(F.col("record_type").isin("response", "revisit")).select(*kept, "block")
    decoded = held.mapInArrow(decode, ", ".join(f"{c} {FIELDS[c]}" for c in kept) + ", payload binary")
    response = F.col("record_type") == "response"
    same = F.coalesce(F.sha1("payload") == F.col("payload_digest"), F.col("payload").isNotNull() & F.col("payload_digest").isNull())
    return decoded.select(*[c for c in kept if c != "whole"], F.when(response, F.col("payload")).alias("payload"), (F.col("whole") & (~response | same)).alias("verified"))


def page_digests(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, verified) of every page of archives; a revisit has what its response has."""
    read = read_payloads(spark, path)
    sums = read.select("record_id", "record_type", F.col("page_id").cast(id_type).alias("page_id"), "refers_to", F.col("payload_digest").alias("stated"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "verified")
    table = materialize(sums, "page-digests")
    own = table.where(F.col("record_type") == "response")
    first = own.select(F.col("record_id").alias("_of"), F.col("page_id").alias("_page"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"), F.col("verified").alias("_verified"))
    met = table.where(F.col("record_type") == "revisit").join(first, F.col("refers_to") == F.col("_of"), "left")
    sound: Column = F.coalesce(F.col("verified") & F.col("_verified") & (F.col("stated") == F.col("_digest")), F.lit(False))
    revisits = met.select("page_id", F.col("_bytes").alias("payload_bytes"), F.col("_digest").alias("payload_digest"), "record_type", F.col("_page").alias("refers_to"), sound.alias("verified"))
    return own.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast(id_type).alias("refers_to"), "verified").unionByName(revisits)


def page_digests_sql() -> str:
    """The same over ``pages``, as DuckDB SQL."""
    return """
with p as (select page_id, coalesce(html, '') as html from pages),
q as (select *, strlen(html) as size, row_number() over (partition by html order by page_id desc nulls last) as r, first_value(page_id) over (partition by html order by page_id desc nulls last) as top from p)
select page_id, size::bigint as payload_bytes, sha1(html) as payload_digest,
  case when size < 1000 or r = 1 then 'response' else 'revisit' end as record_type,
  case when size >= 1000 and r > 1 then top end as refers_to, true as verified
from q"""
