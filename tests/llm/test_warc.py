import base64
import gzip
import hashlib
import os
import random

import pytest

from thematica.llm import shared, warc


@pytest.fixture(autouse=True)
def ready(spark):
    shared.importable(spark)


def expected(rows, min_revisit=0):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if i is not None:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= min_revisit and b in first and i != first[b]
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response",
                    first[b] if again else None))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def pages():
    rnd = random.Random(4)
    out = [(i, f"http://h{i % 3}.example/{i}", "".join(rnd.choice("ab\r\n é日WARC/1.1 ") for _ in range(rnd.choice([0, 5, 50, 700])))) for i in range(60)]
    long = "x\r\n\r\nWARC/1.1\r\n" * 900
    out += [(100, None, None), (101, "http://a\r\nb", ""), (102, "u", out[7][2]), (103, "u", long), (99, "u", long), (104, "u", long + "y"),
            (104, "u", long + "y"), (None, "u", long), (None, "u", "only without id" * 20)]
    return out


@pytest.mark.parametrize("chunk,least", [(64 << 10, 0), (100, 0), (100, 60)])
def test_round_trip(spark, pages, chunk, least):
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, record_type string").repartition(3)
    assert rows(warc.round_trip(df, chunk=chunk, min_revisit=least)) == expected(pages, least)


def test_archives_are_standard_warc(spark, pages, tmp_path):
    """An independent parser reads the files; long payloads are segments of bounded size."""
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = warc.write_archives(warc.record_table(df, chunk=200), str(tmp_path / "w"))
    parts, origin = {}, {}
    for f in os.listdir(path):
        if not f.startswith("part-"):
            continue
        data = gzip.open(os.path.join(path, f)).read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            h = dict(x.split(": ", 1) for x in lines[1:])
            size = int(h["Content-Length"])
            block, data = rest[:size], rest[size:]
            assert data[:4] == b"\r\n\r\n"
            data = data[4:]
            if h["WARC-Type"] == "revisit":
                assert size == 0 and h["WARC-Refers-To"].startswith("<urn:uuid:")
                continue
            if h["WARC-Type"] == "response":
                block = block.partition(b"\r\n\r\n")[2]
            assert len(block) <= 200
            parts.setdefault(h.get("WARC-Segment-Origin-ID", h["WARC-Record-ID"]), {})[int(h.get("WARC-Segment-Number", 1))] = block
            origin[h.get("WARC-Segment-Origin-ID", h["WARC-Record-ID"])] = h["WARC-Payload-Digest"]
    for rec, p in parts.items():
        whole = b"".join(p[i] for i in sorted(p))
        assert origin[rec] == "sha1:" + base64.b32encode(hashlib.sha1(whole).digest()).decode()
    assert len(parts) >= 40


def test_binary_payload_and_empty_table(spark):
    raw = bytes(range(256)) * 9
    df = spark.createDataFrame([(1, "u", bytearray(raw))], "page_id long, url string, html binary")
    (r,) = warc.round_trip(df, chunk=500).collect()
    assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_broken_archive_is_noticed():
    with pytest.raises(ValueError):
        list(warc._parse(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: a\r\nX-Page-ID: 1\r\nContent-Length: 900\r\n\r\nHTTP/1.1 200\r\n\r\nab"))


def test_plain_and_many_member_files():
    rec = (b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: %d\r\nX-Page-ID: %d\r\nContent-Length: 20\r\n\r\n"
           b"HTTP/1.1 200\r\n\r\nabcd\r\n\r\n")
    recs = [rec % (i, i) for i in range(5)]
    want = [(str(i), i, "response", None, 1, 4) for i in range(5)]
    assert [r[:6] for r in warc._parse(b"".join(recs))] == want
    assert [r[:6] for r in warc._parse(b"".join(gzip.compress(r) for r in recs))] == want
