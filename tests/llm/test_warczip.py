import hashlib
import io
import random
import zipfile

import pyarrow as pa

from tidelake.llm import warczip
from tidelake.session import Scratch


def expected(pages, least=1000):
    last = {}
    for i, _, h in pages:
        b = (h or "").encode()
        if len(b) >= least and i is not None:
            last[b] = max(last.get(b, i), i)
    out = []
    for i, _, h in pages:
        b = (h or "").encode()
        r = last.get(b, i)
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "response" if r == i else "revisit", None if r == i else r))
    return sorted(out, key=str)


def test_round_trip(spark, scratch):
    rng = random.Random(3)
    big = ["<p>" + "".join(rng.choice("abc é\r\n\r\n") for _ in range(n)) for n in (998, 1100, 5000)]
    pages = [(k, f"http://h/{k}?é=ü", rng.choice([*big, None, "", "tiny", f"<b>{k}</b>" * 300])) for k in range(200)]
    pages += [(5, "http://h/again", pages[5][2]), (None, None, big[2]), (900, "", big[2])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    rows = warczip.round_trip(df, scratch, payload=True).collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows], key=str) == expected(pages)
    for r in rows:
        assert (r.payload is None) == (r.record_type == "revisit")
        assert r.payload is None or hashlib.sha1(r.payload).hexdigest() == r.payload_digest
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warczip.round_trip(empty, Scratch(spark, "test")).count() == 0


def test_other_readers_open_the_archives():
    archive = warczip._Zip()
    archive.add("a", [b"one", b"two"])
    archive.add("b/c", [b""])
    data = b"".join(archive.finish())
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and z.read("a") == b"onetwo" and z.namelist() == ["a", "b/c"]


def test_archives_of_other_writers():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("x", b"0123456789")
        z.comment = b"a comment"
    reader = warczip.ArchiveReader(pa.BufferReader(out.getvalue()))
    at, length = reader.place("x")
    assert reader.read(at, length) == b"0123456789"
