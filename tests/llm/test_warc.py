import hashlib
import io
import random

import pytest

from quaylight.llm import warc
from quaylight.llm.common import shared_dir


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1) for i, u, h in rows], "page_id long, url string, html string, payload int")


def test_round_trip(spark):
    rng = random.Random(1)
    big = "é" * 100_000
    rows = [(9, "http://a/b c\r\nX: y", big), (3, None, big), (3, None, big), (5, "u", "x" * 99), (4, "u", "x" * 99), (7, "u", None), (8, "u", ""), (None, "u", big), (11, "u", "\r\n\r\nWARC/1.1\r\n" * 20)]
    rows += [(100 + i, f"http://h/{i}", "".join(rng.choice("abc <p>") for _ in range(rng.randint(0, 400)))) for i in range(300)] + [(1000 + i, "u", "copy " * 50) for i in range(40)]
    got = warc.archive_round_trip(spark, pages(spark, rows)).collect()
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        lead = min(same)
        again = len(p) >= 100 and (i is None or i > lead)
        want.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", lead if again else None))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=repr) == sorted(want, key=repr)


def test_payloads_and_empty(spark):
    archives = warc.write_archives(pages(spark, [(1, "http://x/", "häß" * 50)]), shared_dir(spark))
    row = warc.read_archives(archives, payloads=True).first()
    assert bytes(row["payload"]) == ("häß" * 50).encode() and row["url"] == "http://x/"
    assert warc.archive_round_trip(spark, pages(spark, [])).count() == 0


def archive(n=40):
    records = [warc.record_bytes(i, "u", b"body %d " % i * 40, hashlib.sha256(b"body %d " % i * 40).hexdigest(), None, False) for i in range(n)]
    return records, b"".join(warc.archive_chunks(records))


def test_a_frame_for_each_record():
    records, raw = archive()
    assert list(warc.read_archive(io.BytesIO(raw))) == records
    assert raw[:4] == b"\x5d\x2a\x4d\x18" and raw.count(warc.MAGIC_FRAME) >= len(records)


@pytest.mark.parametrize("spoil", [lambda r: r[8:], lambda r: r[:-5], lambda r: r[:6], lambda r: r[:-40] + bytes(40)])
def test_broken_archives(spoil):
    with pytest.raises(warc.BadArchive):
        list(warc.read_archive(io.BytesIO(spoil(archive()[1]))))


@pytest.mark.parametrize("old, new", [(b"WARC/1.1", b"WARC/9.9"), (b"\r\nContent-Length: ", b"\r\nContent-Length: 1"), (b"body", b"bodx"), (b"WARC-Type: response", b"WARC-Type: other"), (b"WARC-Record-ID", b"WARC-Other-ID"), (b"sha256:", b"sha256:0")])
def test_broken_records(old, new):
    good = archive(1)[0][0]
    assert warc.parse_record(good)["record_type"] == "response"
    with pytest.raises(warc.BadArchive):
        warc.parse_record(good.replace(old, new, 1))
