import base64
import gzip
import hashlib

import pytest

from lodestone.llm import warc as W
from lodestone.llm.common import shared_path


def test_round_trip(spark):
    rows = [(1, "http://a", "<p>é</p>"), (2, "http://b", "<p>é</p>"), (3, None, None), (4, "x\ny", ""), (5, "http://c", "big " * 300_000), (6, "u", "\r\n\r\nWARC/1.1\r\n"), (9, "v", "one"), (9, "v", "one"), (None, "n", "one"), (None, "n", "alone")]
    frame = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, sha string")
    path = shared_path(spark, "warc-test")
    W.write_archives(frame, path)
    got = W.read_archives(spark, path).collect()
    assert len(got) == len(rows)
    last = {}
    for i, _, html in rows:
        last[html or ""] = max(last.get(html or "", -1), -1 if i is None else i)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        top = last[html or ""]
        revisit = top >= 0 and (i is None or i < top)
        want.append((str(i), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == sorted(want)
    assert {r["payload"].decode() for r in got if r["payload"] is not None} == {h or "" for _, _, h in rows}
    W.write_archives(frame.limit(0), path + "-none")
    assert W.read_archives(spark, path + "-none").count() == 0


def test_members_are_gzip_and_read_in_order():
    data = b"".join(W.record(k, "u", b"payload %d" % k, None) for k in range(5)) + W._EMPTY
    assert gzip.decompress(data).count(b"WARC/1.1") == 5
    assert [W.payload_of(h, b) for h, b in W.read(data)] == [b"payload %d" % k for k in range(5)]


@pytest.mark.parametrize("harm", [lambda d: d[:-9], lambda d: d[:40] + b"zz" + d[42:], lambda d: b"junk" + d])
def test_damage_raises(harm):
    data = W.record(1, "u", b"payload " * 50, None)
    with pytest.raises(W.BadArchive):
        list(W.read(harm(data)))


def test_wrong_digest_and_framing_raise():
    import zlib

    raw = gzip.decompress(W.record(1, "u", b"payload", None))
    for old, new in ((b"payload\r\n", b"paylode\r\n"), (b"Content-Length: 67", b"Content-Length: 66"), (b"WARC/1.1", b"HTTP/1.1")):
        bad = raw.replace(old, new)
        assert bad != raw or old.startswith(b"Content")
        if bad != raw:
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            with pytest.raises(W.BadArchive):
                list(W.read(z.compress(bad) + z.flush()))
