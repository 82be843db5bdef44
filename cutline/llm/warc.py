"""WARC archives: a deterministic sharded writer, and a reader (operator 4).

Records are sorted by id over ranges of ids with about equal bytes; a range is one task's shard, which rolls to a new file when the
compressed size passes a bound. A task writes under a temporary name of its own and reports what it wrote; only reports of
tasks that Spark counts as done reach the manifest, and only files in the manifest get their final names. So a task that is
repeated, or a lost executor, leaves nothing behind but a temporary file, which the commit removes.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.llm.common import shared_path, stored

DATE = "2020-01-01T00:00:00Z"  # all records; a crawl that knows its times passes a column
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_PAYLOAD = 0
#: Shards hold a sixty-fourth of all bytes, but no fewer and no more than these; files roll at ROLL compressed bytes.
SHARD_BYTES, ROLL = (16 << 20, 1 << 30), 256 << 20
LEVEL = 6
READ = 1 << 20
REPORT = "shard long, seq long, temp string, name string, records long, bytes long, sha256 string"
ROWS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(value: str | None) -> str:
    return "".join(c for c in value or "" if c >= " " and c != "\x7f")


def _record_id(page_id: int | None, digest: str, turn: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}/{digest}/{turn}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False, turn: int = 0) -> bytes:
    """One record, compressed as a gzip member of its own. ``turn`` counts rows with the same id and payload."""
    digest = digest32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id, digest, turn)), ("WARC-Date", DATE),
        ("WARC-Target-URI", _clean(url)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{digest32(block)}"),
        ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block))), ("Page-Id", "" if page_id is None else str(page_id)),
        ("Page-Has-Url", "0" if url is None else "1"),
    ]
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to, digest, 0)), ("Refers-To-Page-Id", str(refers_to))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


class _Files:
    """The files of one task: opened under temporary names, reported when closed."""

    def __init__(self, folder: str, roll: int) -> None:
        self.fs, self.base = fs.FileSystem.from_uri(folder)
        self.roll, self.attempt, self.out = roll, uuid.uuid4().hex, None
        self.fs.create_dir(f"{self.base}/_temporary", recursive=True)

    def put(self, shard: int, data: bytes) -> Iterator[dict]:
        if self.out is not None and (shard != self.shard or self.size + len(data) > self.roll):
            yield self.close(shard)
        if self.out is None:
            self.shard, self.seq = shard, getattr(self, "next", 0)
            self.temp = f"_temporary/{shard:08d}-{self.seq:05d}-{self.attempt}"
            self.out = self.fs.open_output_stream(f"{self.base}/{self.temp}", compression=None)
            self.size, self.records, self.sha = 0, 0, hashlib.sha256()
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)
        self.records += 1

    def close(self, following: int | None = None) -> dict:
        self.out.close()
        self.out = None
        self.next = self.seq + 1 if following == self.shard else 0
        return {
            "shard": self.shard, "seq": self.seq, "temp": self.temp, "name": f"{self.shard:08d}-{self.seq:05d}.warc.gz", "records": self.records,
            "bytes": self.size, "sha256": self.sha.hexdigest(),
        }


def _writer(folder: str, roll: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("shard", pa.int64()), ("seq", pa.int64()), ("temp", pa.string()), ("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = None
        here: object = object()
        notes: dict[str, int] = {}
        turns: dict[str, int] = {}
        for batch in batches:
            done = []
            for shard, page, note, sha, first, url, html in zip(*(batch.column(i) for i in range(7)), strict=True):
                page = page.as_py()
                if page != here:
                    here, notes, turns = page, {}, {}
                if note.as_py() == 0:
                    notes[sha.as_py()] = first.as_py()
                    continue
                payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                key = hashlib.sha1(payload).hexdigest()
                turn = turns.get(key, 0)
                turns[key] = turn + 1
                target = notes.get(key)
                revisit = target is not None and (target != page or turn > 0)
                if files is None:
                    files = _Files(folder, roll)
                done += files.put(shard.as_py(), record(page, url.as_py(), payload, target, revisit, turn))
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if files is not None and files.out is not None:
            yield pa.RecordBatch.from_pylist([files.close()], schema)

    return write


def _piece(starts: np.ndarray, ends: np.ndarray, widths: np.ndarray, cuts: int):
    """Number of the part of a span that an id falls in, or -1."""

    @F.pandas_udf("long")
    def of(ids: pd.Series) -> pd.Series:
        v = ids.to_numpy().astype(np.int64)
        at = np.maximum(np.searchsorted(starts, v, "right") - 1, 0)
        inside = (v >= starts[at]) & (v <= ends[at])
        return pd.Series(np.where(inside, at * cuts + (v - starts[at]) // widths[at], -1))

    return of


def range_starts(thin: DataFrame, target: int) -> list[int]:
    """First ids of ranges with about ``target`` bytes each, from sums over equal spans of ids; a span that is too
    heavy is cut again. The same table gives the same ranges, however it is partitioned."""
    row = thin.agg(F.min("page_id"), F.max("page_id"), F.sum("bytes")).first()
    if row[0] is None:
        return []
    pieces, cuts = [(row[0], row[1], row[2])], 512
    for _ in range(8):
        heavy = [p for p in pieces if p[2] > target and p[0] < p[1]]
        if not heavy:
            break
        span = [(a, -(-(b - a + 1) // cuts)) for a, b, _ in heavy]
        starts = np.array([a for a, _ in span], np.int64)
        ends = np.array([b for _, b, _ in heavy], np.int64)
        widths = np.array([w for _, w in span], np.int64)

        known = thin.where("page_id is not null").groupBy(_piece(starts, ends, widths, cuts)("page_id").alias("k")).agg(F.sum("bytes").alias("n"))
        sums = {r["k"]: r["n"] for r in known.where("k >= 0").collect()}
        light = [p for p in pieces if not (p[2] > target and p[0] < p[1])]
        for i, (a, w) in enumerate(span):
            light += [(a + j * w, min(heavy[i][1], a + (j + 1) * w - 1), sums[i * cuts + j]) for j in range(cuts) if i * cuts + j in sums]
        pieces = sorted(light)
    out, size = [], 0
    for a, _, n in pieces:
        if not out or size + n > target:
            out.append(a)
            size = 0
        size += n
    return out


def write_warc(pages: DataFrame, folder: str, shard_bytes: tuple[int, int] = SHARD_BYTES, roll: int = ROLL, least: int = LEAST_PAYLOAD) -> DataFrame:
    """Write one record per row and commit; the manifest: name, shard, seq, records, bytes, sha256.

    Of rows with equal payloads of at least ``least`` bytes, that with the smallest page_id becomes a response and the others
    revisits of it. Null html is an empty payload; rows with a null page_id come first and revisit whoever has an id.
    Rows that repeat an id and payload: the first is the response. The html is shuffled once, by range; what decides about
    copies are digests, whose smallest id is found with map-side combining and joined thin. ``folder`` is any place that
    pyarrow's file systems reach from all executors.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col("html"), F.lit(""))
    thin = stored(
        pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(html.cast("binary")).alias("sha"), F.octet_length(html).cast("long").alias("size"))
        .withColumn("bytes", F.col("size") + 512), "digests",
    )
    total = thin.agg(F.sum("bytes")).first()[0] or 0
    starts = np.array(range_starts(thin, int(min(max(total // 64, shard_bytes[0]), shard_bytes[1]))), np.int64)
    copies = thin.where(F.col("size") >= least).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    notes = thin.join(copies.select("sha", "first"), "sha").select("page_id", "sha", "first").distinct()

    @F.pandas_udf("long")
    def shard(ids: pd.Series) -> pd.Series:
        v = np.where(ids.isna(), np.iinfo(np.int64).min, ids.fillna(0)).astype(np.int64)
        return pd.Series(np.maximum(np.searchsorted(starts, v, "right") - 1, 0))

    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("sha"), F.lit(None).cast("long").alias("first"), "url", "html"
    ).unionByName(notes.select("page_id", F.lit(0).alias("kind"), "sha", "first", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html")))
    dealt = rows.select(shard("page_id").alias("shard"), "page_id", "kind", "sha", "first", "url", "html").repartition(max(1, len(starts)), "shard")
    ordered = dealt.sortWithinPartitions("shard", F.asc_nulls_first("page_id"), "kind", "url", "html")
    reports = stored(ordered.mapInArrow(_writer(folder, roll), REPORT), "warc-report")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, base = fs.FileSystem.from_uri(folder)
            for r in batch.to_pylist():
                if place.get_file_info(f"{base}/{r['temp']}").type == fs.FileType.File:  # else an earlier attempt has moved it
                    place.move(f"{base}/{r['temp']}", f"{base}/{r['name']}")
                info = place.get_file_info(f"{base}/{r['name']}")
                if info.size != r["bytes"]:
                    raise OSError(f"{r['name']} has {info.size} bytes, not {r['bytes']}")
            yield batch

    committed = reports.mapInArrow(settle, REPORT).drop("temp")
    committed.write.parquet(f"{folder}/_manifest")
    place, base = fs.FileSystem.from_uri(folder)
    if place.get_file_info(f"{base}/_temporary").type == fs.FileType.Directory:
        place.delete_dir(f"{base}/_temporary")
    return spark.read.schema(committed.schema).parquet(f"{folder}/_manifest")


def _members(stream) -> Iterator[bytes]:
    """The gzip members of a file, one after the other."""
    rest = b""
    while True:
        unpack, out = zlib.decompressobj(31), []
        while not unpack.eof:
            if not rest:
                rest = stream.read(READ)
                if not rest:
                    if out:
                        raise OSError("archive ends within a record")
                    return
            out.append(unpack.decompress(rest))
            rest = unpack.unused_data if unpack.eof else b""
        yield b"".join(out)


def parse(member: bytes) -> dict:
    """Headers and payload of a record; digests of the block and, for responses, of the payload are checked."""
    head, _, body = member.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if version != "WARC/1.1":
        raise OSError(f"not a record: {version[:40]!r}")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = body[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if fields["WARC-Block-Digest"] != f"sha1:{digest32(block)}" or kind == "response" and (len(payload) != size or digest32(payload) != digest):
        raise OSError(f"damaged record {fields['WARC-Record-ID']}")
    whole = lambda k: int(fields[k]) if fields.get(k) else None
    return {
        "page_id": whole("Page-Id"), "url": fields["WARC-Target-URI"] if fields["Page-Has-Url"] == "1" else None, "payload_bytes": size, "payload_digest": digest, "record_type": kind,
        "refers_to": whole("Refers-To-Page-Id"), "payload": payload if kind == "response" else None,
    }


def read_warc(manifest: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """A row per record of the files in the manifest, a file at a time; ``payloads`` adds the payload of responses as binary."""
    names = ROWS + (", payload binary" if payloads else "")
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in names.split(", "))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with place.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for member in _members(stream):
                        rows.append(parse(member))
                        size += len(member) if payloads else 64
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist([{k: r[k] for k in schema.names} for r in rows], schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([{k: r[k] for k in schema.names} for r in rows], schema)

    files = manifest.select("name")
    return files.repartition(max(1, files.count())).mapInArrow(read, names)


def archived(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the pages to a fresh folder of the shared space and read the archives back."""
    folder = shared_path(spark, "warc")
    return read_warc(write_warc(pages, folder), folder)

