"""Archives written and read back, records against plain Python."""

from __future__ import annotations

import hashlib
import zlib

from conftest_llm import table
from pyspark.sql import functions as F

from songframe.llm import warc
from songframe.llm.storage import Workspace

SCHEMA = "page_id long, url string, html string"


def rows():
    big, other = "é" * 600, "<p>" + "z" * 5000
    out = [(1, "http://a/\r\nX: y", big), (7, None, big), (3, "http://c/ü", big), (4, "", "x" * 999), (5, "u", "x" * 999)]
    out += [(6, "u", None), (8, "u", ""), (9, "u", "x" * 1000), (2, "u", "x" * 1000), (None, "u", big)]
    out += [(10, "u", other), (10, "u", other), (11, "u", "\r\n\r\nContent-Length: 5\r\n\r\n"), (12, "u", "q" * 300_000)]
    return out


def plain():
    out = []
    for page_id, _, html in rows():
        payload = (html or "").encode()
        same = [p for p, _, h in rows() if (h or "").encode() == payload and p is not None]
        last = max(same)
        revisit = len(payload) >= 1000 and page_id != last
        out.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=str)


def test_query(spark, tmp_path):
    pages = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    got = warc.query(spark, table(spark, tmp_path, "pages", pages)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == plain()
    assert all(r.digest_ok for r in got if r.record_type == "response")


def test_archives_are_standard_gzip_members_and_the_index_finds_each(spark):
    space = Workspace(spark)
    pages = spark.createDataFrame(rows(), SCHEMA).coalesce(1).withColumn("archive", F.lit("clash"))
    folder, index = warc.write(pages, space, limit=2000)
    entries = index.collect()
    assert len(entries) == len(rows()) and len({e.archive for e in entries}) > 1
    local = folder.removeprefix("file:")
    for e in entries:
        with open(f"{local}/{e.archive}", "rb") as file:
            file.seek(e.start)
            found = warc.parsed(zlib.decompress(file.read(e.length), 31))
        assert (found["page_id"], found["payload_digest"]) == (e.page_id, e.payload_digest)
    some = warc.read(folder, index.where("page_id in (1, 7, 12)")).collect()
    texts = {r.page_id: r.payload and bytes(r.payload).decode() for r in some}
    assert texts == {1: None, 7: "é" * 600, 12: "q" * 300_000}


def test_no_pages(spark):
    folder, index = warc.write(spark.createDataFrame([], SCHEMA), Workspace(spark))
    assert index.count() == 0 and warc.read(folder, index).count() == 0
