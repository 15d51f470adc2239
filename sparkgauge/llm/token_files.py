"""Token-id files: Simple-8b words with escapes, and offsets of blocks for vectorised decoding."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .tokens import ByteBpe

#: Fixed values of Simple-8b: selector, integers in a word, bits of each. Selector 15 is an escape: the next word is one raw integer.
PACKING = [(0, 240, 0), (1, 120, 0), (2, 60, 1), (3, 30, 2), (4, 20, 3), (5, 15, 4), (6, 12, 5), (7, 10, 6), (8, 8, 7), (9, 7, 8), (10, 6, 10), (11, 5, 12), (12, 4, 15), (13, 3, 20), (14, 2, 30)]
ONE, ESCAPE = 15, 15
BLOCK = 240
MAGIC = b"S8BT0002"
COUNT = np.array([n for _, n, _ in PACKING] + [1])
WIDTHS = sorted({bits for *_, bits in PACKING})
#: The first value too large for each width: a value needs the width whose number is how many of these it reaches.
LIMITS = np.array([1 << bits for bits in WIDTHS], np.uint64)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block of BLOCK values). All blocks are packed side by side."""
    v = np.ascontiguousarray(values, np.uint64)
    n = len(v)
    if not n:
        return np.empty(0, np.uint64), np.zeros(0, np.uint32)
    blocks = -(-n // BLOCK)
    padded = np.zeros((blocks, 2 * BLOCK), np.uint64)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[:n] = v
    padded[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    left = np.full(blocks, BLOCK)
    left[-1] = n - (blocks - 1) * BLOCK
    # Best selector at every place: the first (densest) whose values all fit. A selector that fits leaves all
    # sparser ones fitting, so counting those that fit finds it; the widest value of a window is the
    # maximum of two narrower windows that cover it.
    widest, span = np.zeros((blocks, 2 * BLOCK), np.uint8), 1
    widest[:, :BLOCK] = np.searchsorted(LIMITS, flat, "right").reshape(blocks, BLOCK)
    best = np.full((blocks, BLOCK), ESCAPE, np.uint8)
    for sel, count, bits in reversed(PACKING):
        more = count - span
        widest, span = np.maximum(widest[:, : widest.shape[1] - more], widest[:, more:]), count
        best -= widest[:, :BLOCK] <= WIDTHS.index(bits)
    # Words begin where the words before them end; the last one of a block may run on over zeros.
    begins = np.zeros((blocks, BLOCK), bool)
    at, live = np.zeros(blocks, np.int64), np.arange(blocks)
    while len(live):
        begins[live, at[live]] = True
        at[live] += COUNT[best[live, at[live]]]
        live = live[at[live] < left[live]]
    b, p = np.nonzero(begins)
    s = best[b, p].astype(np.int64)
    width = 1 + (s == ESCAPE)
    place = np.cumsum(width) - width
    words = np.zeros(int(width.sum()), np.uint64)
    words[place] = s.astype(np.uint64) << np.uint64(60)
    for sel, count, bits in PACKING:
        if bits and (at_ := np.flatnonzero(s == sel)).size:
            part = padded[b[at_][:, None], p[at_][:, None] + np.arange(count)] << (np.arange(count, dtype=np.uint64) * np.uint64(bits))
            words[place[at_]] |= np.bitwise_or.reduce(part, 1)
    esc = np.flatnonzero(s == ESCAPE)
    words[place[esc] + 1] = padded[b[esc], p[esc]]
    first = np.searchsorted(b, np.arange(blocks))
    return words, place[first].astype(np.uint32)


def decode(words: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """The n values; every block is walked at once from its offset."""
    blocks = len(first)
    out = np.zeros((blocks, 2 * BLOCK), np.uint64)
    left = np.full(blocks, BLOCK)
    if blocks:
        left[-1] = n - (blocks - 1) * BLOCK
    at, w = np.zeros(blocks, np.int64), first.astype(np.int64)
    live = np.arange(blocks)
    while len(live):
        word = words[w[live]]
        sel = (word >> np.uint64(60)).astype(np.int64)
        for kind, count, bits in PACKING:
            if bits and (k := live[sel == kind]).size:
                shift = np.arange(count, dtype=np.uint64) * np.uint64(bits)
                out[k[:, None], at[k][:, None] + np.arange(count)] = (words[w[k]][:, None] >> shift) & ((np.uint64(1) << np.uint64(bits)) - np.uint64(1))
        if (k := live[sel == ESCAPE]).size:
            out[k, at[k]] = words[w[k] + 1]
        at[live] += COUNT[sel]
        w[live] += 1 + (sel == ESCAPE)
        live = live[at[live] < left[live]]
    return out[:, :BLOCK].reshape(-1)[:n]


def pack_shard(ids: list[int | None], lengths: list[int], values: np.ndarray, base: int) -> bytes:
    """Header, document ids and lengths, block offsets, words; all little-endian.

    base: ids in files of the same part before this one. Null document ids come first; the header has their number.
    """
    words, first = encode(values)
    none = sum(i is None for i in ids)
    head = MAGIC + struct.pack("<QQQQQQ", len(ids), none, len(values), len(first), len(words), base)
    return head + np.array([i or 0 for i in ids], "<i8").tobytes() + np.asarray(lengths, "<u4").tobytes() + first.astype("<u4").tobytes() + words.astype("<u8").tobytes()


def read_shard(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray, int]:
    """(document ids, lengths, values, base)."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    docs, none, n, blocks, words, base = struct.unpack("<QQQQQQ", data[8 : (at := 56)])
    ids = np.frombuffer(data, "<i8", docs, at).tolist()
    lengths = np.frombuffer(data, "<u4", docs, at := at + 8 * docs)
    first = np.frombuffer(data, "<u4", blocks, at := at + 4 * docs)
    return [None] * none + ids[none:], lengths, decode(np.frombuffer(data, "<u8", words, at + 4 * blocks), first, n), base


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 0, shard_ids: int = 1 << 21, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all documents' ids in ascending id order; returns the manifest (file, part, shard, n_docs, n_ids).

    Documents are range-partitioned by id; each task writes files of about shard_ids ids under a name
    that no other attempt uses and then moves it into place, so a task that runs again leaves the same
    files. Null or empty texts are the end id alone; documents with equal ids stay next to each other, in
    an order by their text's hash, and are split over tasks where there are many; null ids come first and
    come back null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else f"file://{folder}")
        store.create_dir(root, recursive=True)
        part, k, base = TaskContext.get().partitionId(), 0, 0
        bpe, end = ByteBpe(path), np.uint32(end_id).tobytes()
        ids, lengths, data, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            name = f"part-{part:06d}-{k:05d}.s8b"
            with store.open_output_stream(temp := f"{root}/.{name}.{uuid.uuid4().hex}") as f:
                f.write(pack_shard(ids, lengths, np.frombuffer(b"".join(data), np.uint32), base))
            store.move(temp, f"{root}/{name}")
            row = {"file": name, "part": part, "shard": k, "n_docs": len(ids), "n_ids": held // 4}
            return pa.RecordBatch.from_pylist([row])

        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                x = bpe.encode(t.as_py()) + end
                ids.append(i)
                lengths.append(len(x) // 4)
                data.append(x)
                held += len(x)
                if held >= 4 * shard_ids:
                    yield flush()
                    k, base = k + 1, base + held // 4
                    ids, lengths, data, held = [], [], [], 0
        if ids:
            yield flush()

    order = ["doc_id", "tie", "row"]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    manifest = rows.mapInArrow(run, "file string, part long, shard long, n_docs long, n_ids long")
    return cut(manifest, "manifest")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files.

    A file knows the ids of its part before it; the parts' sums, a row for each task that wrote, go to all readers.
    """
    spark = manifest.sparkSession
    shape = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest.head(1):
        return spark.createDataFrame([], shape)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, base in zip(b.column("content"), b.column("base").to_pylist(), strict=True):
                ids, lengths, values, own = read_shard(data.as_py())
                raw = values.astype("<u4").tobytes()
                stop = np.cumsum(lengths.astype(np.int64))
                start = stop - lengths
                crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(start, stop, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(start + base + own), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    data = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(folder)
    data = data.select(F.regexp_extract("path", r"part-([0-9]+)-[0-9]+\.s8b$", 1).cast("long").alias("part"), "content")
    # At most as many rows as the writing shuffle had partitions.
    return data.join(F.broadcast(parts), "part").select("content", "base").mapInArrow(run, shape)
