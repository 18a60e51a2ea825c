import hashlib
import struct

import pytest
import zstandard

from twinline.llm import warc as W


def archive(texts, dictionary=None):
    writer = W.ArchiveWriter(dictionary)
    for i, text in enumerate(texts):
        data = text.encode()
        writer.add(W.page_record(i, f"http://x/{i}", data, hashlib.sha1(data).hexdigest(), None))
    return writer.bytes()


def trained(make_text):
    return zstandard.train_dictionary(4096, [make_text(i, 200).encode() for i in range(200)]).as_bytes()


def test_round_trip_with_and_without_dictionary(make_text):
    texts = [make_text(i, i * 11) for i in range(60)] + ["", "ü" * 300_000]
    packed = trained(make_text)
    for dictionary in (None, packed):
        pages = [W.decode_page(r) for r in W.read_archive(archive(texts, dictionary))]
        assert [p["payload"].decode() for p in pages] == texts
        assert [p["page_id"] for p in pages] == list(range(len(texts)))
    whole = archive(texts, packed)
    # The dictionary itself may be compressed.
    small = zstandard.ZstdCompressor().compress(packed)
    again = struct.pack("<II", W.DICTIONARY_MAGIC, len(small)) + small + whole[8 + len(packed) :]
    assert len(list(W.read_archive(again))) == len(texts)


@pytest.mark.parametrize("damage", ["cut", "flip", "garbage", "length", "version", "digest"])
def test_damage_is_found(make_text, damage):
    data = archive([make_text(1, 300), make_text(2, 300)])
    if damage == "cut":
        data = data[:-7]
    elif damage == "flip":
        data = data[:200] + bytes([data[200] ^ 0xFF]) + data[201:]
    elif damage == "garbage":
        data += b"0123456789"
    else:
        record = W.page_record(1, "http://x", b"abc", hashlib.sha1(b"abc").hexdigest(), None)
        bad = {"length": (b"Content-Length: 8", b"Content-Length: 9"), "version": (b"WARC/1.1", b"WARC/9.9"), "digest": (b"\r\n\r\nabc", b"\r\n\r\nabd")}
        record = record.replace(*bad[damage]) if damage != "length" else record.replace(b"Content-Length: ", b"Content-Length: 9")
        data = zstandard.ZstdCompressor().compress(record)
    with pytest.raises(W.ArchiveError):
        list(W.read_archive(data))


def test_pages(spark, make_text):
    long = make_text(1, 400)
    rows = [(1, long), (2, long), (9, long), (3, "short"), (4, "short"), (5, None), (None, long), (6, make_text(2, 400)), (9, long)]
    pages = spark.createDataFrame([(k, f"http://h/{k}", t, 0) for k, t in rows], "page_id long, url string, html string, payload int")
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in W.archive_round_trip(pages).collect()), key=str)
    want = [(k, "response", None) for k in (9, 9, 3, 4, 5, 6)] + [(k, "revisit", 9) for k in (1, 2, None)]
    assert got == sorted(want, key=str)
    assert W.archive_round_trip(pages.limit(0)).count() == 0
