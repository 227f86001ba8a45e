"""Token ids in Simple-8b word-aligned files.

A file (a shard) holds the ids of documents in ascending doc_id order, cut into blocks of ``BLOCK`` ids:

    "S8B1"  u32 block length
    u64 words of all blocks
    i64 doc_id + u8 "doc_id is null" + u64 ids, for each document (three arrays)
    u64 first word of each block
    u64 words, u64 documents, u64 blocks, u64 ids, "S8B1"     (a trailer of fixed size)

A word has a selector in its top 4 bits and as many ids as fit the 60 bits below, the first one lowest (see ``COUNTS``). Ids
that need 60 bits or more are escapes: selector 15 with all payload bits set, and the id in the next word. A block begins on a
word boundary, and its last word is filled up with zeros; so blocks are found by their offsets and decoded side by side.

Texts are dealt by ranges of (doc_id, hash of the text) and sorted, so no doc_id is a hot key, and each partition writes one
shard to the shared folder under a name of its own attempt: a lost or repeated task leaves at most a file that nobody reads. The
driver gets a row for each shard (its path and counts) for the places where shards begin.

Edge cases: null and empty texts hold only the end id; null doc_ids come first; rows with one doc_id stand side by side in the
order of their texts' hashes; no rows give no shard and an empty result.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_dir
from .tokens import encoded, tokenizer_path

MAGIC, BLOCK = b"S8B1", 1024
#: Bytes of text that a shard's task reads at most, about; Spark sorts them on disk where they don't fit, and Python streams them.
SHARD_BYTES = 512 << 20
#: Bytes that a row counts for besides its text, so that a shard's table of documents is bounded too; rows read from a shard at once.
ROW_BYTES, READ_ROWS = 64, 50_000
#: ids in a word and bits for each, by selector (fixed values of Simple-8b).
COUNTS = (240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = (1 << 60) - 1
_COUNTS = np.array(COUNTS)
#: The first id that each selector can't hold; the last one takes all that are left.
_LIMITS = np.array([1 << w for w in WIDTHS[:15]], np.uint64)


def selectors(ids: np.ndarray, block: int) -> np.ndarray:
    """For each id of each block (a row) the selector that packs most ids from there on; blocks end with zeros that fit anything."""
    need = np.searchsorted(_LIMITS, ids, "right").astype(np.uint8)  # the first selector that is wide enough
    flat = np.zeros((len(need) // block, block + COUNTS[0]), np.uint8)
    flat[:, :block] = need.reshape(-1, block)
    flat = flat.reshape(-1)
    best = np.full(len(flat), 15, np.uint8)
    most, size, doubled = flat, 1, {1: flat}  # the widest of the next 1, 2, 4 ... ids
    while 2 * size <= COUNTS[0]:
        most = np.maximum(most[:-size], most[size:])
        size *= 2
        doubled[size] = most
    for sel in range(14, -1, -1):
        c = COUNTS[sel]
        half = 1 << (c.bit_length() - 1)
        run = doubled[half]
        widest = run[: len(flat) - c + 1] if half == c else np.maximum(run[: len(flat) - c + 1], run[c - half : len(flat) - half + 1])
        best[: len(widest)][widest <= sel] = sel
    return best


def pack(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words of all blocks of ids, and the number of words of each block."""
    n = -(-len(ids) // block)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    padded = np.zeros(n * block, np.uint64)
    padded[: len(ids)] = ids
    best = selectors(padded, block)
    width = block + COUNTS[0]
    flat = np.zeros((n, width), np.uint64)
    flat[:, :block] = padded.reshape(n, block)
    flat = flat.reshape(-1)
    at = np.arange(n) * width
    stop = at + np.minimum(block, len(ids) - np.arange(n) * block)
    step, begins = _COUNTS.astype(np.int32)[best], np.zeros(len(flat), dtype=bool)
    while len(at):  # one word of every block a round
        begins[at] = True
        at = at + step[at]
        more = at < stop
        at, stop = (at, stop) if more.all() else (at[more], stop[more])
    p = np.flatnonzero(begins)
    b = p // width
    sel = best[p]
    words = sel.astype(np.uint64) << np.uint64(60)
    for s in np.unique(sel).tolist():
        if WIDTHS[s]:
            which = np.flatnonzero(sel == s)
            own, here = words[which], p[which]
            for k in range(COUNTS[s]):
                own |= np.minimum(flat[here + k], np.uint64(ESCAPE)) << np.uint64(k * WIDTHS[s])
            words[which] = own
    count = np.bincount(b, minlength=n)
    large = np.flatnonzero((sel == 15) & (flat[p] >= np.uint64(ESCAPE)))
    if len(large):
        words = np.insert(words, large + 1, flat[p[large]])
        count += np.bincount(b[large], minlength=n)
    return words, count


def unpack(words: np.ndarray, begin: np.ndarray, n_ids: int, block: int = BLOCK) -> np.ndarray:
    """The ids of blocks whose words begin at begin; n_ids in all, every block but the last one full."""
    if not n_ids:
        return np.zeros(0, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    full = (sel == 15) & ((words & np.uint64(ESCAPE)) == np.uint64(ESCAPE))
    raw = np.zeros(len(words), dtype=bool)
    for i in np.flatnonzero(full).tolist():  # an escape's second word may look like an escape itself
        if not raw[i]:
            raw[i + 1] = True
    count = np.where(raw, 0, _COUNTS[sel])
    total = np.cumsum(count) - count
    owner = np.searchsorted(begin, np.arange(len(words)), "right") - 1
    size = np.minimum(block, n_ids - np.arange(len(begin)) * block)
    at = total - total[begin][owner] + owner * (block + COUNTS[0])
    out = np.zeros(len(begin) * (block + COUNTS[0]), np.uint64)
    for s in range(2, 16):
        which = np.flatnonzero((sel == s) & ~raw)
        for k in range(COUNTS[s]) if len(which) else ():
            out[at[which] + k] = words[which] >> np.uint64(k * WIDTHS[s]) & np.uint64((1 << WIDTHS[s]) - 1)
    lead = np.flatnonzero(raw)
    out[at[lead - 1]] = words[lead]
    out = out.reshape(len(begin), -1)[:, :block].reshape(-1)
    assert int(size.sum()) == n_ids
    return out[:n_ids]


def _file_system(folder: str) -> tuple[pa.fs.FileSystem, str]:
    if "://" not in folder and not folder.startswith("file:"):
        return pa.fs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return pa.fs.FileSystem.from_uri(folder)


SHARD = "part int, path string, n_docs long, n_ids long, n_words long"


def _write(folder: str, path: str, run: str, end: int | None):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _file_system(folder)
        context = TaskContext.get()
        part = context.partitionId()
        name = f"part-{part:06d}-{context.taskAttemptId()}.s8b"
        docs, nulls, sizes, counts = [], [], [], []
        held, n_held, n_ids, n_words, out = [], 0, 0, 0, None

        def store(ids: np.ndarray) -> None:
            nonlocal n_words
            words, count = pack(ids)
            out.write(words.astype("<u8").tobytes())
            counts.append(count)
            n_words += len(words)

        for rows, ids, off in encoded(batches, path, "spaced", run, end):
            if out is None:
                out = fs.open_output_stream(f"{top}/{name}")
                out.write(MAGIC + np.uint32(BLOCK).tobytes())
            column = rows.column("id")
            nulls.append(column.is_null().to_numpy(zero_copy_only=False))
            docs.append(column.fill_null(0).to_numpy().astype(np.int64))
            sizes.append(np.diff(off))
            n_ids += len(ids)
            held.append(ids)
            n_held += len(ids)
            if n_held >= 1 << 20:
                flat = np.concatenate(held)
                whole = len(flat) // BLOCK * BLOCK
                store(flat[:whole])
                held, n_held = [flat[whole:]], len(flat) - whole
        if out is None:
            return
        store(np.concatenate(held))
        doc, null, size, count = np.concatenate(docs), np.concatenate(nulls), np.concatenate(sizes), np.concatenate(counts)
        begin = np.cumsum(count) - count
        out.write(doc.astype("<i8").tobytes() + null.astype(np.uint8).tobytes() + size.astype("<u8").tobytes() + begin.astype("<u8").tobytes())
        out.write(np.array([n_words, len(doc), len(begin), n_ids], "<u8").tobytes() + MAGIC)
        out.close()
        yield pa.RecordBatch.from_pylist([{"part": part, "path": f"{folder}/{name}", "n_docs": len(doc), "n_ids": n_ids, "n_words": n_words}], schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_words", pa.int64())]))

    return go


class Shard:
    """Reader of one file: documents' ids and counts, and the ids of any run of blocks."""

    def __init__(self, path: str) -> None:
        fs, name = _file_system(path)
        self.file = fs.open_input_file(name)
        size = self.file.size()
        self.file.seek(size - 36)
        tail = self.file.read(36)
        assert tail[32:] == MAGIC, f"{path} is not a token file"
        self.n_words, n_docs, n_blocks, self.n_ids = (int(x) for x in np.frombuffer(tail, "<u8", 4))
        self.file.seek(4)
        self.block = int(np.frombuffer(self.file.read(4), "<u4")[0])
        self.file.seek(8 + 8 * self.n_words)
        self.doc = np.frombuffer(self.file.read(8 * n_docs), "<i8")
        self.null = np.frombuffer(self.file.read(n_docs), np.uint8).astype(bool)
        self.size = np.frombuffer(self.file.read(8 * n_docs), "<u8").astype(np.int64)
        self.begin = np.frombuffer(self.file.read(8 * n_blocks), "<u8").astype(np.int64)

    def blocks(self, first: int, last: int) -> np.ndarray:
        lo, hi = int(self.begin[first]), int(self.begin[last]) if last < len(self.begin) else self.n_words
        self.file.seek(8 + 8 * lo)
        words = np.frombuffer(self.file.read(8 * (hi - lo)), "<u8")
        n = min(last * self.block, self.n_ids) - first * self.block
        return unpack(words, self.begin[first:last] - lo, n, self.block)

    def documents(self, at_once: int = 1024) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) of each document, reading at_once blocks at a time."""
        held, block = np.zeros(0, np.uint64), 0
        for k in range(len(self.doc)):
            doc, null, size = int(self.doc[k]), bool(self.null[k]), int(self.size[k])
            parts, have = [held], len(held)
            while have < size:
                got = self.blocks(block, min(block + at_once, len(self.begin)))
                block += at_once
                parts.append(got)
                have += len(got)
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield None if null else doc, held[:size]
            held = held[size:]


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
            shard = Shard(path)
            found = shard.documents()
            for a in range(0, len(shard.doc), READ_ROWS):
                size = shard.size[a : a + READ_ROWS]
                begin = start + np.cumsum(size) - size
                crc = np.fromiter((zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in islice(found, len(size))), np.int64, len(size))
                start += int(size.sum())
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc[a : a + READ_ROWS], mask=shard.null[a : a + READ_ROWS]), pa.array(begin), pa.array(size), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def write_tokens(docs: DataFrame, folder: str, tokenizer: str = "byte_bpe_50k.json", end: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int, int]]:
    """Writes shards in ascending doc_id order; (path, ids before it, ids in it) of each, in order."""
    src = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("body"))
    # Rows that are alike in doc_id and text are told apart by their place in the input, so that they spread as well.
    src = src.withColumns({"tie": F.xxhash64("body"), "place": F.monotonically_increasing_id()})
    spark, order = docs.sparkSession, ["id", "tie", "place"]
    n_bytes = src.agg(F.sum(F.coalesce(F.octet_length("body"), F.lit(0)) + ROW_BYTES)).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // SHARD_BYTES))
    dealt = src.repartitionByRange(n, *order).sortWithinPartitions(*order).select("id", "body")
    shards = sorted(dealt.mapInArrow(_write(folder, tokenizer_path(tokenizer), uuid.uuid4().hex, end), SHARD).collect())
    out, before = [], 0
    for s in shards:
        out.append((s.path, before, s.n_ids))
        before += s.n_ids
    return out


def read_tokens(spark: SparkSession, shards: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document, from the files."""
    rows = spark.createDataFrame([(p, s) for p, s, _ in shards], "path string, start long")
    return rows.repartition(max(1, len(shards))).mapInArrow(_read, READ)


def token_folder(spark: SparkSession) -> str:
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    fs, name = _file_system(folder)
    fs.create_dir(name, recursive=True)
    return folder
