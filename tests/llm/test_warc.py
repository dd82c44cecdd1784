import base64
import gzip
import hashlib

import pytest


def plain(rows):
    """Straight from the contract: (page_id, bytes, digest, type, refers_to) per row."""
    payloads = [(i, (html or "").encode()) for i, html in rows]
    out = []
    for i, p in payloads:
        same = [j for j, q in payloads if q == p and j is not None]
        top = max(same) if same else None
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if i == top else "revisit", None if i == top else top))
    return sorted(out, key=repr)


ROWS = [(1, "same"), (2, "same"), (3, None), (4, ""), (5, "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"), (6, "é\x00 " * 1000), (7, "x" * 3_000_000),
        (None, "same"), (None, "alone"), (9, "twice"), (9, "twice"), (8, "twice"), (-5, "same"), (11, "\r\n"), (12, "\r\n\r\n")]


def test_archives_and_revisits(spark, tmp_path):
    from landtally.llm.warc import archived, read_archives
    rows = ROWS + [(100 + k, "hot") for k in range(500)] + [(1000 + k, f"page {k // 2}") for k in range(300)]
    table = spark.createDataFrame([(i, f"http://x/{i}\r\nWARC-Type: nothing" if i != 4 else None, h, "n", 1, True) for i, h in rows],
                                  "page_id long, url string, html string, first string, n int, _again boolean")
    got = archived(table.repartition(5), str(tmp_path / "a"))
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)
    # Every payload is stored once but for repeated rows of the same page, and archives are plain WARC files.
    back = read_archives(spark, str(tmp_path / "a"))
    kept = [bytes(r.payload) for r in back.filter("record_type = 'response'").collect()]
    assert sorted(set(kept)) == sorted({(h or "").encode() for _, h in rows}) and len(kept) == len(set(kept)) + 1
    names = {r.record_id for r in back.filter("record_type = 'response'").collect()}
    assert {r.refers_to_id for r in back.filter("record_type = 'revisit'").collect()} <= names
    assert [r.url for r in back.filter("page_id = 4").collect()] == [None]
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "a").glob("part-*")))
    assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")


def test_small_archives_and_empty_table(spark, tmp_path):
    from landtally.llm.warc import archived, records, resolved, read_archives, write_archives
    table = spark.createDataFrame([(k, "u", f"page {k % 70}") for k in range(200)], "page_id long, url string, html string").repartition(2)
    write_archives(records(table), str(tmp_path / "s"), archive_bytes=6000)
    assert len(list((tmp_path / "s").glob("part-*"))) > 10
    got = resolved(read_archives(spark, str(tmp_path / "s"), with_payload=False))
    assert sorted(map(tuple, got.collect()), key=repr) == plain([(k, f"page {k % 70}") for k in range(200)])
    assert archived(table.limit(0), str(tmp_path / "e")).count() == 0


def test_given_archives_are_written_anew(spark, tmp_path):
    """Records compressed one by one, raw bytes, a revisit with and one without its response."""
    from landtally.llm.warc import read_archives, resolved, write_archives

    def record(kind, page, payload, code=None, size=None):
        body = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % (len(payload) if size is None else size) + payload
        code = code or base64.b32encode(hashlib.sha1(payload).digest()).decode()
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nPage-Id: {page}\r\nWARC-Payload-Digest: sha1:{code}\r\n" if kind != "warcinfo" else "WARC/1.0\r\nWARC-Type: warcinfo\r\n"
        return gzip.compress(f"{head}Content-Type: application/http; msgtype=response\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n")

    raw = bytes(range(256)) * 4
    code = base64.b32encode(hashlib.sha1(raw).digest()).decode()
    source = tmp_path / "in"
    source.mkdir()
    (source / "part-0.warc.gz").write_bytes(record("warcinfo", 0, b"x") + record("response", 1, raw) + record("revisit", 3, b"", code, len(raw)))
    (source / "part-1.warc.gz").write_bytes(record("response", 2, raw) + record("revisit", 4, b"", "A" * 32, 77))
    write_archives(read_archives(spark, str(source)), str(tmp_path / "out"))
    back = read_archives(spark, str(tmp_path / "out"))
    assert [bytes(r.payload) for r in back.filter("record_type = 'response'").collect()] == [raw]
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in resolved(back).collect()}
    assert got == {2: (1024, code, "response", None), 1: (1024, code, "revisit", 2), 3: (1024, code, "revisit", 2), 4: (77, "A" * 32, "revisit", None)}


def test_damaged_payload_is_told(spark, tmp_path):
    from landtally.llm.warc import records, resolved, read_archives, write_archives
    write_archives(records(spark.createDataFrame([(1, "u", "payload")], "page_id long, url string, html string")), str(tmp_path / "w"))
    for file in (tmp_path / "w").glob("part-*"):
        file.write_bytes(gzip.compress(gzip.decompress(file.read_bytes()).replace(b"payload\r\n", b"pay10ad\r\n")))
    for file in (tmp_path / "w").glob(".part-*.crc"):
        file.unlink()
    with pytest.raises(ValueError, match="digest"):
        resolved(read_archives(spark, str(tmp_path / "w"))).collect()
