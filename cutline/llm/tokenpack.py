"""Token ids packed into fixed-width rows, as binary matrices (operator 6).

Texts become ids under a public vocabulary. A document longer than a row is cut into full rows and a tail, without loss; tails
and short documents are packed best-fit-decreasing. Which row is tightest is asked of a segment tree over the room that is left: its leaves are
the amounts of room, an inner node says whether any open row has an amount below it, and a search climbs and descends once.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.llm.common import shared_path

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed pattern of this vocabulary: how texts are cut before byte pairs are merged.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTEXT = 2048
END = 50256  # id that ends a document and fills the rest of a row
#: Documents and ids that are packed together, and rows of one matrix.
BLOCK_DOCS, BLOCK_IDS, MATRIX_ROWS = 8192, 1 << 22, 256
#: Characters that are tokenized in one go. A longer text is cut where a space follows a letter, so that the ids stay the same.
PART = 1 << 20

SEGMENT = "struct<doc_id:bigint,piece:bigint,start:bigint,n_tokens:bigint,row:int,row_offset:int>"
SCHEMA = f"matrix string, n_rows int, width int, ids binary, cu_seqlens array<array<int>>, resets array<array<int>>, segments array<{SEGMENT}>"
_ARROW = pa.schema([
    ("matrix", pa.string()), ("n_rows", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.list_(pa.int32()))), ("resets", pa.list_(pa.list_(pa.int32()))),
    ("segments", pa.list_(pa.struct([("doc_id", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("row", pa.int32()), ("row_offset", pa.int32())]))),
])
_known: dict[str, object] = {}


def encoder(ranks: bytes, pattern: str = PATTERN):
    """The encoding of a rank file, built once per worker."""
    key = hashlib.sha1(ranks + pattern.encode()).hexdigest()
    if key not in _known:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _known[key] = tiktoken.Encoding(key, pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _known[key]


def encode(enc, text: str) -> np.ndarray:
    out, at = [], 0
    while at < len(text):
        end = len(text)
        if end - at > PART:
            end = at + PART
            # Before a lone space between letters both sides are cut alike, with or without the other.
            while end < len(text) and not (text[end] == " " and text[end - 1].isalpha() and text[end + 1 : end + 2].isalpha()):
                end += 1
        out.append(np.array(enc.encode_ordinary(text[at:end]), np.int32))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.int32)


class Rooms:
    """Open rows by the room they have left, under a segment tree over amounts of room."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.tree = bytearray(2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = room + self.size
        while node and not self.tree[node]:
            self.tree[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Room and number of the open row with the least room of at least ``need``, the longest open first; taken out."""
        tree, node = self.tree, need + self.size
        if not tree[node]:
            while node > 1 and not (node % 2 == 0 and tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if tree[2 * node] else 2 * node + 1
        room = node - self.size
        row = self.rows[room].pop(0)
        if not self.rows[room]:
            tree[node] = 0
            node >>= 1
            while node and not (tree[2 * node] or tree[2 * node + 1]):
                tree[node] = 0
                node >>= 1
        return room, row


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(row, offset) of each item, in the order given; lengths from 1 to the capacity."""
    rooms, opened = Rooms(capacity), 0
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        got = rooms.take(lengths[i])
        if got is None:
            got, opened = (capacity, opened), opened + 1
        room, row = got
        out[i] = (row, capacity - room)
        if room > lengths[i]:
            rooms.add(room - lengths[i], row)
    return out


def _matrix(name: str, rows: list[list[tuple]], width: int) -> dict:
    """``rows``: of each row its segments (doc_id, piece, start, ids) in order."""
    ids = np.full((len(rows), width), END, "<u2")
    ends, resets, segments = [], [], []
    for r, row in enumerate(rows):
        at, cuts = 0, [0]
        for doc, piece, start, part in row:
            ids[r, at : at + len(part)] = part
            segments.append({"doc_id": doc, "piece": piece, "start": start, "n_tokens": len(part), "row": r, "row_offset": at})
            at += len(part)
            cuts.append(at)
        ends.append(cuts)
        resets.append(cuts[:-1] + ([at] if at < width else []))  # the filling counts from zero as well
    return {"matrix": name, "n_rows": len(rows), "width": width, "ids": ids.tobytes(), "cu_seqlens": ends, "resets": resets, "segments": segments}


def _packer(ranks, pattern: str, width: int, end: int | None, block: tuple[int, int]):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, number = encoder(ranks.value, pattern), TaskContext.get().partitionId(), 0
        full: list[list[tuple]] = []
        tails: list[tuple] = []
        empty: list[dict] = []
        held = docs = 0

        def name() -> str:
            nonlocal number
            number += 1
            return f"{part:06d}-{number - 1:06d}"

        def rows_out(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal full, tails, empty, held, docs
            spots = best_fit_decreasing([len(t[3]) for t in tails], width)
            packed: list[list[tuple]] = [[] for _ in range(1 + max((r for r, _ in spots), default=-1))]
            for (row, at), t in zip(spots, tails, strict=True):
                packed[row].append((at, t))
            rows = full + [[t for _, t in sorted(row, key=lambda x: x[0])] for row in packed]
            for i in range(0, len(rows), MATRIX_ROWS):
                record = _matrix(name(), rows[i : i + MATRIX_ROWS], width)
                record["segments"] += empty
                empty = []
                yield pa.RecordBatch.from_pylist([record], _ARROW)
            if final and empty:
                yield pa.RecordBatch.from_pylist([{"matrix": name(), "n_rows": 0, "width": width, "ids": b"", "cu_seqlens": [], "resets": [], "segments": empty}], _ARROW)
            full, tails, held, docs = [], [], 0, 0

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(enc, text.as_py() or "")
                if not len(ids):
                    empty.append({"doc_id": doc, "piece": 0, "start": 0, "n_tokens": 0, "row": None, "row_offset": None})
                    continue
                if end is not None:
                    ids = np.append(ids, np.int32(end))
                for k in range(0, len(ids), width):
                    piece = ids[k : k + width].astype("<u2")
                    (full.append([(doc, k // width, k, piece)]) if len(piece) == width else tails.append((doc, k // width, k, piece)))
                    held += len(piece)
                docs += 1
                if docs >= block[0] or held >= block[1]:
                    yield from rows_out(False)
        yield from rows_out(True)

    return pack


def write_packed(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN, width: int = CONTEXT, end: int | None = END, block: tuple[int, int] = (BLOCK_DOCS, BLOCK_IDS)) -> DataFrame:
    """Write matrices and return them as read back: ids (rows x width, little-endian 16 bits), cu_seqlens and position resets
    of each row, and the segments that say which document's ids lie where.

    Ids are cut, packed and written where a partition is read: no shuffle, and blocks of bounded size, whatever the
    partition holds. Null and empty texts get a segment without tokens or row. Null ids and repeated rows keep segments
    of their own; ties go to the earlier row; an empty table writes no matrix; other columns are ignored. The vocabulary (under
    2 MB, checked) is read once, on the driver.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        ranks = f.read()
    if len(ranks) > 2 << 20 or ranks.count(b"\n") > 1 << 16:
        raise ValueError("the vocabulary must have ids of 16 bits")
    pack = _packer(spark.sparkContext.broadcast(ranks), pattern, width, end, block)
    docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pack, SCHEMA).write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(SCHEMA).parquet(folder)


def positions(cu_seqlens: list[int], width: int) -> np.ndarray:
    """Position ids of a row: from zero in each segment, and in what fills the row."""
    starts = np.zeros(width, np.int64)
    cuts = [*cu_seqlens[:-1], *([cu_seqlens[-1]] if cu_seqlens[-1] < width else [])]
    starts[cuts] = cuts
    return np.arange(width) - np.maximum.accumulate(starts)


def segment_digests(matrices: DataFrame) -> DataFrame:
    """doc_id, piece, start, n_tokens, matrix, row, row_offset, ids_crc32: of every segment, from the matrices as written."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for m in batch.to_pylist():
                ids = np.frombuffer(m["ids"], "<u2").reshape(m["n_rows"], m["width"])
                for s in m["segments"]:
                    crc = 0 if s["row"] is None else zlib.crc32(ids[s["row"], s["row_offset"] : s["row_offset"] + s["n_tokens"]].tobytes())
                    rows.append({**s, "matrix": m["matrix"] if s["row"] is not None else None, "ids_crc32": crc})
            yield pa.RecordBatch.from_pylist(rows, out)

    out = pa.schema([
        ("doc_id", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("matrix", pa.string()), ("row", pa.int32()), ("row_offset", pa.int32()), ("ids_crc32", pa.int64()),
    ])
    return matrices.select("matrix", "n_rows", "width", "ids", "segments").mapInArrow(
        read, "doc_id long, piece long, start long, n_tokens long, matrix string, row int, row_offset int, ids_crc32 long"
    )


def packed_segments(spark: SparkSession, docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    return segment_digests(write_packed(docs, shared_path(spark, "token-matrices"), vocabulary))
