r"""Substring dedup: words that a window of 50 words covers go if that window also starts in a document of smaller doc_id.

Every window of consecutive words is hashed by Rabin-Karp (modulo 2**61 - 1, over 64-bit hashes of the words), the least doc_id
of each hash is found, and the words that later occurrences cover are removed; overlapping ones merge into maximal intervals.
Windows are judged on the input.

How it runs (one lazy plan, no cache and no driver data apart from a count of bytes):

1. ``mapInArrow`` hashes chunks of documents. Within a chunk only the windows of smallest doc_id go on; windows that a smaller
   one in the same chunk already beats are decided on the spot. However often a passage occurs, a chunk sends it once, so no
   key gathers more rows than there are chunks.
2. ``repartitionById`` brings equal hash prefixes together, as packed blobs of 7 hash bytes and about 3 more bytes per window
   (a row of its own for each window would be some 16 bytes after compression: over 4 times the input).
3. A reducer sorts its hashes, and sends each window that is not of smallest doc_id to the partition of its document.
4. Texts meet their decisions there, sorted so that decisions come first, and the covered words are removed as texts stream by.

A document's partition follows from its doc_id and its text, so rows that share a doc_id spread. The number of partitions follows
the bytes of text; ``part_bytes`` makes them larger where executors have more memory, and chunks with them, so that a chunk's blob
for a partition holds about as many windows on a large cluster as on a small one.

Windows are compared by hash only, over 61 bits: among n windows about n**2 / 2**62 pairs of different ones collide.

Edge cases: a null or empty text has no windows and is returned as it is (hash of the empty string for null); a null doc_id
neither loses windows nor makes others lose any; rows with the same doc_id never beat each other; doc_ids that aren't numbers are
an error, as windows are ranked by them as 64-bit numbers; texts with fewer words than a window keep everything; extra columns,
whatever their names, are passed through unchanged.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K

#: Bytes of text for each partition of the two shuffles, and windows that a map task compares at once, for a task that has
#: ``TASK_BYTES`` of an executor's heap.
PART_BYTES, CHUNK, TASK_BYTES = 16 << 20, 2_000_000, 900 << 20
HASH_BYTES = 7

ENTRIES = "to int, kind int, n long, blob binary"


def _bytes(size: str) -> int:
    number, unit = re.fullmatch(r"(\d+)([kmgt]?)b?", size.strip().lower()).groups()
    return int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


def scale_for(spark: SparkSession) -> int:
    """How many times TASK_BYTES a task has, at least 1."""
    conf = spark.sparkContext.getConf()
    heap = _bytes(conf.get("spark.executor.memory", "1g"))
    return max(1, heap // max(1, int(conf.get("spark.executor.cores", "0") or 0) or 2) // TASK_BYTES)


def partitions_for(n_bytes: int, part_bytes: int = PART_BYTES, least: int = 16) -> int:
    n = max(least, -(-n_bytes // part_bytes))
    return 1 << (n - 1).bit_length()


def _pack(doc: np.ndarray, rid: np.ndarray, row: np.ndarray, place: np.ndarray, h: np.ndarray | None) -> bytes:
    """Windows in order of (row, place): a table of documents, then a few bytes for each window."""
    first = np.concatenate(([True], row[1:] != row[:-1]))
    at = np.flatnonzero(first)
    step = place.copy()
    step[1:] -= np.where(first[1:], 0, place[:-1])
    head = np.array([len(at), len(row)], np.int64).tobytes()
    parts = [head, K.planes(doc[row[at]]), K.planes(rid[row[at]]), K.planes(np.diff(np.append(at, len(row))).astype(np.int32)), K.planes(step.astype(np.int32))]
    if h is not None:
        parts.append(np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]).tobytes())
    return b"".join(parts)


def _unpack(raw: bytes, hashed: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """doc, rid, row (into doc), place, hash."""
    m, n = (int(x) for x in np.frombuffer(raw, np.int64, 2))
    view, at = memoryview(raw), 16

    def take(kind: type, k: int) -> np.ndarray:
        nonlocal at
        size = np.dtype(kind).itemsize * k
        out = K.unplanes(view[at : at + size], kind, k)
        at += size
        return out

    doc, rid, count, step = take(np.int64, m), take(np.int64, m), take(np.int32, m), take(np.int32, n)
    row = np.repeat(np.arange(m), count)
    run = np.cumsum(step.astype(np.int64))
    begin = np.cumsum(count) - count
    base = np.where(begin > 0, run[np.maximum(begin - 1, 0)], 0)
    place = run - np.repeat(base, count)
    h = None
    if hashed:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :HASH_BYTES] = np.frombuffer(raw, np.uint8, n * HASH_BYTES, at).reshape(n, HASH_BYTES)
        h = wide.view(K.U64).reshape(n)
    return doc, rid, row, place, h


def _later(h: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """True for each item of which an equal hash has a smaller rank."""
    order = np.argsort(h, kind="stable")
    hs, rs = h[order], rank[order]
    starts = np.flatnonzero(np.concatenate(([True], hs[1:] != hs[:-1])))
    least = np.minimum.reduceat(rs, starts)
    out = np.empty(len(h), dtype=bool)
    out[order] = rs > np.repeat(least, np.diff(np.append(starts, len(h))))
    return out


def _split(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(k, indices where key is k, in order)."""
    if not len(key):
        return
    order = np.argsort(key.astype(np.uint32), kind="stable")
    there, cut = np.unique(key[order], return_index=True)
    for k, part in zip(there.tolist(), np.split(order, cut[1:]), strict=True):
        yield k, part


def word_windows(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, off = K.words(data, offsets)
    return K.window_hash(K.span_hash(data, starts, ends), off, width)


def _hash_chunks(width: int, n: int, chunk: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    bits = n.bit_length() - 1

    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        docs, rids, rows, places, hs, base = [], [], [], [], [], 0
        for doc, rid, row, place, h in held:
            docs.append(doc)
            rids.append(rid)
            rows.append((row + base).astype(np.int32))
            places.append(place.astype(np.int32))
            hs.append(h)
            base += len(doc)
        doc, rid, row, place, h = (np.concatenate(x) for x in (docs, rids, rows, places, hs))
        held.clear()
        beaten = _later(h, doc[row])
        out: list[tuple[int, int, int, bytes]] = []
        if beaten.any():
            lost = np.flatnonzero(beaten)
            for k, at in _split(rid[row[lost]] & n - 1):
                at = lost[at]
                out.append((k, 1, len(at), _pack(doc, rid, row[at], place[at], None)))
        left = np.flatnonzero(~beaten)
        for k, at in _split((h[left] >> K.U64(64 - bits)).astype(np.int64)):
            at = left[at]
            out.append((k, 0, len(at), _pack(doc, rid, row[at], place[at], h[at])))
            if len(out) >= 64:
                yield _entries(out)
                out = []
        if out:
            yield _entries(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in K.slices(batch, "body"):
                row, place, h = word_windows(*K.utf8(part.column("body")), width)
                if not len(row):
                    continue
                held.append((part.column("id").to_numpy().astype(np.int64), part.column("rid").to_numpy().astype(np.int64), row, place, h))
                size += len(row)
                if size >= chunk:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _entries(out: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    to, kind, size, blob = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(kind, pa.int32()), pa.array(size, pa.int64()), pa.array(blob, pa.binary())], ["to", "kind", "n", "blob"])


def _decide(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[tuple[np.ndarray, ...]] = []
        base = 0
        for batch in batches:
            past = batch.filter(pc.equal(batch.column("kind"), 1))
            if past.num_rows:
                yield past.select(["to", "blob"])
            for raw in batch.filter(pc.equal(batch.column("kind"), 0)).column("blob").to_pylist():
                doc, rid, row, place, h = _unpack(raw, True)
                got.append((doc, rid, (row + base).astype(np.int32), place.astype(np.int32), h))
                base += len(doc)
        if not got:
            return
        doc, rid, row, place, h = (np.concatenate(x) for x in zip(*got, strict=True))
        del got
        lost = np.flatnonzero(_later(h, doc[row]))
        del h
        for k, at in _split(rid[row[lost]] & n - 1):
            at = lost[at]
            at = at[np.lexsort((place[at], row[at]))]
            blob = _pack(doc, rid, row[at].astype(np.int64), place[at].astype(np.int64), None)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([blob], pa.binary())], ["to", "blob"])

    return run


def _covered(places: np.ndarray, width: int, n: int) -> np.ndarray:
    """True for the tokens of n that windows at places cover; overlapping windows merge into one interval."""
    edge = np.zeros(n + width + 1, np.int32)
    np.add.at(edge, places, 1)
    np.add.at(edge, places + width, -1)
    return np.cumsum(edge)[:n] > 0


def remaining_words(text: str | None, places: np.ndarray | None, width: int) -> tuple[int, int, str]:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if places is None:
        return len(words), 0, b" ".join(words).decode("utf-8", "surrogatepass")
    gone = _covered(places, width, len(words))
    return len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode("utf-8", "surrogatepass")


def _apply(width: int, digest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The partition's rows come sorted: all its decisions, then its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lost: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            there = batch.column("blob").is_valid()
            for raw in batch.filter(there).column("blob").to_pylist():
                doc, rid, row, place, _ = _unpack(raw, False)
                cut = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                for i, part in zip(cut, np.split(place.astype(np.int32), cut[1:]), strict=True):
                    lost.setdefault((int(doc[row[i]]), int(rid[row[i]])), []).append(part)
            for part in K.slices(batch.filter(pc.invert(there)), "body"):
                found = []
                for doc, rid, text in zip(part.column("id").to_pylist(), part.column("rid").to_pylist(), part.column("body").to_pylist(), strict=True):
                    places = lost.get((doc, rid))
                    found.append(remaining_words(text, np.concatenate(places) if places else None, width))
                n, gone, kept = zip(*found, strict=True)
                if digest:
                    kept = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in kept]
                yield pa.RecordBatch.from_arrays([part.column("rest"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["rest", "n", "gone", "kept"])

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, digest: bool = False) -> DataFrame:
    """``rest`` (the input columns other than the text), ``n`` words, ``gone`` words removed, ``kept`` words joined by one space;
    with digest the SHA-256 of these in hex."""
    src = docs.select(
        docs[id_col].cast("long").alias("id"), docs[text_col].alias("body"), F.xxhash64(docs[id_col], docs[text_col]).alias("rid"),
        F.struct(*[docs[c] for c in docs.columns if c != text_col]).alias("rest"),
    )
    scale = scale_for(docs.sparkSession)
    n = partitions_for(src.agg(F.sum(F.octet_length("body"))).first()[0] or 0, scale * PART_BYTES)
    entries = src.where("id is not null").select("id", "body", "rid").mapInArrow(_hash_chunks(width, n, scale * CHUNK), ENTRIES)
    lost = entries.repartitionById(n, "to").mapInArrow(_decide(n), "to int, blob binary")
    both = src.withColumn("to", F.col("rid").bitwiseAND(F.lit(n - 1).cast("long")).cast("int")).unionByName(lost, allowMissingColumns=True)
    dealt = both.repartitionById(n, "to").sortWithinPartitions(F.col("blob").isNull())
    return dealt.mapInArrow(_apply(width, digest), f"rest {dict(src.dtypes)['rest']}, n long, gone long, kept string")
