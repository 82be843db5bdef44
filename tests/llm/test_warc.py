from __future__ import annotations

import base64
import hashlib

import pytest
from pyarrow import fs

from cutline.llm.common import shared_path
from cutline.llm.warc import archived, read_warc, record, write_warc
from tests.llm.conftest import LONG

SCHEMA = "page_id long, url string, html string, shard string, sha string, first string"


def table(spark, rows):
    return spark.createDataFrame([(i, u, h, "s", "h", "f") for i, u, h in rows], SCHEMA)


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def expected(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out, seen = [], set()
    for i, u, h in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):  # rows that repeat an id go by url
        low = first.get(h or "")
        revisit = low is not None and (low != i or (i, h or "") in seen)
        seen.add((i, h or ""))
        out.append((i, u, len((h or "").encode()), digest(h), "revisit" if revisit else "response", low if revisit else None))
    return sorted(out, key=str)


ROWS = [(i, f"http://h/{i}", f"<p>page {i % 37}</p>" + "é" * i) for i in range(120)] + [(200 + i, None, "<p>same</p>") for i in range(60)] + [
    (None, "http://none", "<p>same</p>"), (None, None, "<p>no id</p>"), (None, None, "<p>no id</p>"), (300, "a\r\nb", None), (301, "", ""), (302, "u", LONG), (5, "again", "<p>page 5</p>" + "é" * 5), (-7, "x", "<p>same</p>"),
]


def test_round_trip(spark):
    got = sorted((tuple(r) for r in archived(spark, table(spark, ROWS)).collect()), key=str)
    assert got == sorted(((i, None if u is None else u.replace("\r\n", ""), *rest) for i, u, *rest in expected(ROWS)), key=str)


def test_empty_table(spark):
    assert archived(spark, table(spark, [])).count() == 0


def test_same_files_whatever_the_partitions(spark):
    sums = []
    for parts in (1, 7):
        folder = shared_path(spark, "warc-test")
        manifest = write_warc(table(spark, ROWS).repartition(parts), folder, shard_bytes=(4096, 8192), roll=1500)
        rows = sorted(tuple(r) for r in manifest.select("name", "records", "bytes", "sha256").collect())
        sums.append(rows)
        place, base = fs.FileSystem.from_uri(folder)
        names = {f.base_name: f.size for f in place.get_file_info(fs.FileSelector(base)) if f.base_name.endswith(".warc.gz")}
        assert names == {n: b for n, _, b, _ in rows}
        assert place.get_file_info(f"{base}/_temporary").type == fs.FileType.NotFound
    assert sums[0] == sums[1] and len(sums[0]) > 10
    assert sum(n for _, n, _, _ in sums[0]) == len(ROWS)
    assert any(n.endswith("-00001.warc.gz") for n, *_ in sums[0])  # a shard rolled


def test_payloads_come_back_whole(spark):
    folder = shared_path(spark, "warc-test")
    got = read_warc(write_warc(table(spark, ROWS), folder, shard_bytes=(1 << 14, 1 << 15)), folder, payloads=True).where("page_id is not null").collect()
    html = {i: h for i, _, h in ROWS if i is not None}
    assert all(bytes(r["payload"]).decode() == (html[r["page_id"]] or "") for r in got if r["record_type"] == "response")


def test_small_payloads_need_not_be_compared(spark):
    folder = shared_path(spark, "warc-test")
    rows = [(1, "a", "xy"), (2, "b", "xy"), (3, "c", "longer"), (4, "d", "longer")]
    got = read_warc(write_warc(table(spark, rows), folder, least=3), folder)
    assert {r["page_id"]: r["refers_to"] for r in got.collect()} == {1: None, 2: None, 3: None, 4: 3}


def test_a_repeated_task_leaves_no_trace(spark):
    folder = shared_path(spark, "warc-test")
    place, base = fs.FileSystem.from_uri(folder)
    place.create_dir(f"{base}/_temporary", recursive=True)
    with place.open_output_stream(f"{base}/_temporary/00000000-00000-lost") as f:
        f.write(record(1, "u", b"half")[:10])
    manifest = write_warc(table(spark, ROWS[:5]), folder)
    assert read_warc(manifest, folder).count() == 5
    assert not [f for f in place.get_file_info(fs.FileSelector(base, recursive=True)) if "lost" in f.path]


def test_damage_is_noticed(spark):
    folder = shared_path(spark, "warc-test")
    manifest = write_warc(table(spark, ROWS[:3]), folder)
    place, base = fs.FileSystem.from_uri(folder)
    name = manifest.first()["name"]
    with place.open_input_stream(f"{base}/{name}", compression=None) as f:
        data = f.read()
    with place.open_output_stream(f"{base}/{name}", compression=None) as f:
        f.write(data[:-20])
    with pytest.raises(Exception, match="within a record"):
        read_warc(manifest, folder).collect()
