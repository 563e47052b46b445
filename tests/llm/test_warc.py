"""Archives of pages: round trips, segments, framing, revisits, foreign and broken archives."""

import gzip
import hashlib
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nlimorph.llm import warc
from nlimorph.llm._shared import scratch_dir

SCHEMA = "page_id long, url string, html string, key string, digest string"
HTML = [None, "", "short", "é" * 30_000, "x" * 999, "y" * 1000, "y" * 1000, "WARC/1.1\r\n" * 3000 + "WARC/1.1", "\r\n\r\n" * 500, "0\r\n\r\n" * 400, "<p>" + "z" * 200_000]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def round_trip(spark, df, **options):
    path = f"{scratch_dir(spark)}/archives-{uuid.uuid4().hex}"
    warc.write_archives(df, path, **options)
    return path, sorted(map(tuple, warc.page_digests(spark, path).collect()), key=str)


def plain(rows):
    """The contract, row by row."""
    best = {}
    for k, (page, _, html) in enumerate(rows):
        key = html or ""
        if key not in best or (page is not None, page or 0) > (rows[best[key]][0] is not None, rows[best[key]][0] or 0):
            best[key] = k
    out = []
    for k, (page, _, html) in enumerate(rows):
        payload = (html or "").encode()
        again = len(payload) >= 1000 and best[html or ""] != k
        out.append((page, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", rows[best[html]][0] if again else None, True))
    return sorted(out, key=str)


ROWS = [(k, f"http://a.example/{k}?q=ü v", h) for k, h in enumerate(HTML)] + [(3, None, "y" * 1000), (None, "", "y" * 1000), (6, "u", "y" * 1000), (6, "u", "y" * 1000), (None, "n", "q" * 1500), (None, "n", "q" * 1500), (77, "u", "short"), (77, "u", "short")]


@pytest.mark.parametrize("options", [{}, {"segment_bytes": 100, "chunk_bytes": 7}, {"segment_bytes": 1 << 30}])
@pytest.mark.parametrize("parts", [1, 5])
def test_round_trip(spark, options, parts):
    path, got = round_trip(spark, frame(spark, ROWS).repartition(parts), **options)
    assert got == plain(ROWS)
    kinds = {r.record_type for r in warc.read_records(spark, path).collect()}
    assert kinds == {"warcinfo", "response", "revisit"} | ({"continuation"} if options.get("segment_bytes") != 1 << 30 else set())


def test_payloads_come_back_whole(spark):
    path, _ = round_trip(spark, frame(spark, ROWS), segment_bytes=64)
    payloads = {bytes(r.payload) for r in warc.read_payloads(spark, path).where("record_type = 'response'").collect()}
    assert payloads == {(h or "").encode() for _, _, h in ROWS}


def test_many_copies_of_one_page(spark):
    rows = spark.range(3000).selectExpr("id as page_id", "'u' as url", "repeat('copy ', 300) as html")
    _, got = round_trip(spark, rows)
    assert sum(r[3] == "response" for r in got) == 1 and {r[4] for r in got if r[3] == "revisit"} == {2999} and len(got) == 3000


def test_empty_table(spark):
    assert round_trip(spark, frame(spark, []))[1] == []


def _file(spark, name: str, data: bytes) -> str:
    folder = f"{scratch_dir(spark)}/foreign-{uuid.uuid4().hex}"
    import os

    os.makedirs(folder)
    with open(f"{folder}/{name}", "wb") as f:
        f.write(gzip.compress(data) if name.endswith(".gz") else data)
    return folder


def _response(page: str, payload: bytes, **more: str) -> bytes:
    fields = {"WARC-Type": "response", "WARC-Record-ID": f"<urn:{page}>", "page-id": page} | more
    return warc._record(fields, warc.HTTP + b"\r\n" + payload) + warc.END


@pytest.mark.parametrize("name", ["a.warc", "a.warc.gz"])
def test_foreign_archive_whose_page_holds_records(spark, name):
    inner = _response("9", b"inside")
    path = _file(spark, name, _response("1", b"plain") + _response("2", b"a" + inner + inner + b"z") + _response("3", bytes(range(256))))
    got = {r.page_id: bytes(r.payload) for r in warc.read_payloads(spark, path).where("verified").collect()}
    assert got == {"1": b"plain", "2": b"a" + inner + inner + b"z", "3": bytes(range(256))}


def test_faults_are_told(spark):
    pages = frame(spark, [(1, "u", "a" * 5000), (2, "u", "b" * 5000)])
    path, _ = round_trip(spark, pages, segment_bytes=1000)
    records = [r for r in warc.read_records(spark, path).collect() if r.record_type in ("response", "continuation")]

    def verified(kept):
        return {r.page_id: r.verified for r in warc.read_payloads(spark, _file(spark, "a.warc.gz", b"".join(kept))).collect()}

    def written(r, block=None):
        names = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "page_id": "Page-Id", "origin_id": "WARC-Segment-Origin-ID", "segment": "WARC-Segment-Number", "total_length": "WARC-Segment-Total-Length"}
        fields = {n: r[c] for c, n in names.items()} | {"WARC-Payload-Digest": r.payload_digest and f"sha1:{r.payload_digest}"}
        return warc._record(fields, bytes(r.block) if block is None else block) + warc.END

    first_of_2 = next(r for r in records if r.page_id == "2").record_id
    of_2 = [r for r in records if first_of_2 in (r.record_id, r.origin_id)]
    of_1 = [written(r) for r in records if r not in of_2]
    assert verified([*of_1, *map(written, of_2)]) == {"1": True, "2": True}
    assert verified([*of_1, *map(written, reversed(of_2))]) == {"1": True, "2": True}
    for gone in (2, len(of_2)):
        assert verified([*of_1, *(written(r) for r in of_2 if r.segment != gone)]) == {"1": True, "2": False}
    assert verified([*of_1, *(written(r, b"X" * len(r.block) if r.segment == 3 else None) for r in of_2)]) == {"1": True, "2": False}
    assert verified([*of_1, written(of_2[0])[:300]]) == {"1": True, "2": False}


def test_revisit_without_response(spark):
    revisit = warc._record({"WARC-Type": "revisit", "WARC-Record-ID": "<urn:1>", "Page-Id": "1", "WARC-Refers-To": "<urn:gone>"}, warc.HTTP + b"\r\n") + warc.END
    assert [tuple(r) for r in warc.page_digests(spark, _file(spark, "a.warc.gz", revisit)).collect()] == [(1, None, None, "revisit", None, False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"WARC/1.1", b"WARC/1.1\r\n", b"\r\n", b"a", b"0", bytes([200])]), max_size=40).map(b"".join), st.integers(1, 12))
def test_framing(payload, size):
    framed = warc.chunked(payload, size)
    assert warc.dechunked(framed) == payload and warc.VERSION not in framed
    for k in range(len(framed) - 4):
        assert warc.dechunked(framed[:k]) is None
