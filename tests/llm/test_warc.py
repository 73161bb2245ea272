import hashlib
import io
import struct

import pytest
import zstandard

from linkloom.llm import warc

DATE = "2020-01-01T00:00:00Z"


def archive(n=200, size=4000):
    w = warc.ArchiveWriter()
    for i in range(n):
        payload = (f"<p>page {i} " + "some common words " * (size // 18)).encode()
        headers = {"WARC-Payload-Digest": "sha1:" + hashlib.sha1(payload).hexdigest()}
        w.add(warc.build_record("response", f"urn:page:{i}", DATE, warc.http_block(len(payload), payload), headers))
    return w.close()


def test_dictionary_leads_and_frames_hold_one_record_each():
    data = archive(400)
    magic, size = struct.unpack_from("<II", data)
    assert magic == warc.DICTIONARY and size > 100
    found = list(warc.frames(io.BytesIO(data)))
    assert len(found) == 401
    assert b"".join(f for _, f in found) == data
    with pytest.raises(zstandard.ZstdError):  # the dictionary is needed
        zstandard.ZstdDecompressor().decompress(found[1][1])
    assert [r["record_id"] for r in warc.read_archive(io.BytesIO(data))] == [f"urn:page:{i}" for i in range(400)]


def test_frames_without_content_size_and_in_small_reads():
    class Slow(io.BytesIO):
        def read(self, n=-1):
            return super().read(min(n, 7))

    c = zstandard.ZstdCompressor(write_content_size=False)
    raw = warc.build_record("warcinfo", "urn:x", DATE, b"software: x\r\n", {})
    skipped = struct.pack("<II", warc.SKIPPABLE, 3) + b"abc"
    data = skipped + c.compress(raw) + skipped + c.compress(raw)
    assert [r["payload"] for r in warc.read_archive(Slow(data))] == [b"software: x\r\n"] * 2


def test_plain_dictionary():
    d = zstandard.train_dictionary(4096, [f"words and words {i} of text {i % 7}".encode() * 20 for i in range(200)])
    raw = warc.build_record("warcinfo", "urn:x", DATE, b"words and words", {})
    data = struct.pack("<II", warc.DICTIONARY, len(d.as_bytes())) + d.as_bytes() + zstandard.ZstdCompressor(dict_data=d).compress(raw)
    assert next(warc.read_archive(io.BytesIO(data)))["payload"] == b"words and words"


def broken(change):
    payload = b"x" * 50
    headers = {"WARC-Payload-Digest": "sha1:" + hashlib.sha1(payload).hexdigest()}
    raw = warc.build_record("response", "urn:page:1", DATE, warc.http_block(50, payload), headers)
    return zstandard.ZstdCompressor().compress(change(raw))


@pytest.mark.parametrize("change", [
    lambda r: r.replace(b"WARC/1.1", b"WARC/9.9"),
    lambda r: r.replace(b"WARC-Date", b"WARC-Late"),
    lambda r: r.replace(b"\r\nContent-Length: 1", b"\r\nContent-Length: 2", 1),
    lambda r: r.replace(b"Content-Length: 50", b"Content-Length: 49"),
    lambda r: r.replace(b"xxxxx", b"yyyyy"),
    lambda r: r[:-2],
    lambda r: r.replace(b"WARC-Type: response", b"WARC-Type: response\r\nWARC-Type: response"),
])
def test_wrong_records_are_told(change):
    with pytest.raises(warc.BadArchive, match="here, byte 0"):
        list(warc.read_archive(io.BytesIO(broken(change)), "here"))


def test_cut_and_damaged_files_are_told():
    data = archive(40)
    for wrong in (data[:-3], data[:len(data) // 2], b"junk" + data):
        with pytest.raises(warc.BadArchive):
            list(warc.read_archive(io.BytesIO(wrong)))


def test_round_trip(spark):
    long = "é" * 600
    rows = [(1, "http://a", long), (2, "http://b", long), (3, None, long), (4, "u", "short"), (5, "u", "short"), (6, "u\r\nX: y", None),
            (7, "u", ""), (None, "u", long), (8, "u", "big " * 300_000), (9, "u", "\x00\x01 <p>"), (9, "u", "\x00\x01 <p>"),
            (10, "u", "twice " * 300), (10, "u", "twice " * 300)]
    pages = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], "page_id bigint, url string, html string, payload string, refers_to int, _first int, _Body int").repartition(3)
    out = warc.round_trip(pages).collect()
    assert len(out) == len(rows)
    by_id = {r["record_id"]: r for r in out}
    for i, _, html in rows:
        r = by_id[f"urn:page:{'' if i is None else i}"]
        raw = (html or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        if i in (1, 2, None):
            assert (r["record_type"], r["refers_to"], r["payload"]) == ("revisit", "urn:page:3", None)
        else:
            assert (r["record_type"], r["refers_to"], bytes(r["payload"])) == ("response", None, raw)
    assert by_id["urn:page:6"]["target_uri"] == "u%0D%0AX: y" and by_id["urn:page:3"]["target_uri"] is None
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_files_of_any_folder(spark, tmp_path):
    (tmp_path / "a.warc.zst").write_bytes(archive(50))
    out = warc.read_files(spark, str(tmp_path))
    assert out.count() == 50 and out.select("offset").distinct().count() == 50
