import base64
import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from gapscope.llm import warc
from gapscope.llm.common import shared_folder


def expected(rows):
    out, last = [], {}
    for p, h in rows:
        last[h or ""] = max((x for x, g in rows if (g or "") == (h or "") and x is not None), default=None)
    seen = set()
    for p, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (h or "").encode()
        first = p == last[h or ""] and (h or "") not in seen
        if first:
            seen.add(h or "")
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((p, len(raw), digest, "response" if first else "revisit", None if first else last[h or ""]))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(p, h, f"http://x/{p} y\n", "z") for p, h in rows], "page_id long, html string, url string, path string")
    folder = shared_folder(spark, "warc")
    files = warc.normalise(warc.write_monolithic(warc.with_types(df), folder))
    return files, sorted((tuple(r) for r in warc.read_members(files).collect()), key=str)


def test_round_trip_and_offsets(spark):
    rows = [(1, "a"), (2, "b\r\n\r\nc"), (3, "a"), (4, None), (5, ""), (6, "é" * 100000), (7, "a"), (7, "a"), (None, "q"), (None, "a")]
    files, got = run(spark, rows)
    assert got == expected(rows)
    for f in files.collect():
        system, path = warc.filesystem(f["path"])
        data = system.open_input_stream(path, compression=None).read()
        lines = [json.loads(x) for x in system.open_input_stream(warc.filesystem(f["index"])[1], compression=None).read().splitlines()]
        assert sum(x["length"] for x in lines) == len(data) and len(lines) == f["records"]
        for x in lines:
            assert gzip.decompress(data[x["offset"] : x["offset"] + x["length"]]).startswith(b"WARC/1.1\r\n")


def test_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")
    rows = [tuple(r) for r in pages.union(pages.select(F.col("page_id") + 10**6, "html").limit(40)).collect()]
    assert run(spark, rows)[1] == expected(rows)


def test_empty_table(spark):
    assert run(spark, [])[1] == []


class Parts:
    def __init__(self, data):
        self.data = data

    def read(self, n):
        out, self.data = self.data[:n], self.data[n:]
        return out


def test_a_cut_stream_is_an_error():
    whole = gzip.compress(b"a" * 50_000) + gzip.compress(b"second")
    assert b"".join(warc.inflated(Parts(whole))) == b"a" * 50_000 + b"second" and list(warc.inflated(Parts(b""))) == []
    first = len(gzip.compress(b"a" * 50_000))
    for cut in (1, first - 8, first - 1, first + 3, len(whole) - 8, len(whole) - 1):
        with pytest.raises(ValueError, match="cut off"):
            list(warc.inflated(Parts(whole[:cut])))
