r"""SimHash near-dedup with Golay-code fuzzy hashing.

Fingerprints: A-Z lower-cased, words ``[^\x20\x09-\x0D]+``, shingles of three words joined by spaces (a shorter text: all its
words; no word: fingerprint 0), XXH64 with seed 42, a bit is 1 if it is set in over half of the hashes.

Linking at 3 or fewer differing bits, without loss:

* The 64 bits are three segments of 23, 23 and 18 bits (the last one filled up to 23 with zeros). Three errors over three
  segments leave two segments with at most one error each (pigeonhole).
* The binary Golay code (23, 12, 7) is perfect: every 23-bit word is within three bits of exactly one codeword. A segment of
  even parity has one key, the number of its codeword; a segment of odd parity has the codewords of itself and of its 23
  neighbours, 1 or 6 different ones. Two segments one bit apart differ in parity, so the odd one has the even one's key; equal
  segments have equal keys.
* For each of the three pairs of segments, every combination of their keys is a bucket: about 30 buckets a fingerprint, of
  3 * 2**24. Fingerprints at distance 3 or less share a bucket.
* Buckets hold distinct fingerprints only. Each bucket is verified by exact distance; inside a bucket pairs are looked for
  among fingerprints that agree on one of four 16-bit bands (three errors leave a band intact), so a large bucket isn't compared
  pair by pair. A task sends on only a spanning forest of the links it has found: at most as many links as fingerprints.
* Components by alternating large-star and small-star rounds over distinct fingerprints; each round is checkpointed. A node with
  very many neighbours (there can only be few) is sent to them instead of gathering them in one task.

Edge cases: a null text is an empty one; rows with a null doc_id are fingerprinted and linked, but a component's id is the
smallest doc_id that is not null (null if there is none); repeated rows come out as often as they went in; extra columns are
ignored by the query and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .shared import checkpoint

SEED, SHINGLE, NEAR = 42, 3, 3
#: Fingerprints with one band in common that are compared at growing lags.
RUN = 512
#: Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the Golay code.
GENERATOR = 0xC75
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: A node with fewer neighbours is never a hub; hubs that are sent to all tasks at most (16 bytes each).
HEAVY, HUBS = 200, 200_000
#: Fingerprints in buckets (about 30 rows each) that one task of the link search holds.
TASK_FINGERPRINTS = 100_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None) -> int:
    """One text's fingerprint as an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    flat = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return digest(flat, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    last = ends[SHINGLE - 1 :]
    hashes = np.fromiter((digest(flat[a:b], SEED) for a, b in zip(starts[: len(last)].tolist(), last.tolist(), strict=True)), np.uint64, len(last))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i : i + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in K.slices(batch, "body"):
            got = np.fromiter(map(fingerprint, part.column("body").to_pylist()), np.uint64, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("tag"), pa.array(got.view(np.int64))], ["id", "tag", "fp"])


@lru_cache(maxsize=1)
def codewords() -> np.ndarray:
    """For each 23-bit word the number (12 information bits) of the codeword within three bits of it."""
    info = np.arange(4096, dtype=np.int64)
    code = np.zeros(4096, np.int64)
    for k in range(12):
        code ^= np.where(info >> k & 1, GENERATOR << k, 0)
    out = np.full(1 << 23, -1, np.int16)
    bit = [1 << k for k in range(23)]
    errors = [0, *bit, *(a | b for i, a in enumerate(bit) for b in bit[:i]), *(a | b | c for i, a in enumerate(bit) for j, b in enumerate(bit[:i]) for c in bit[:j])]
    for e in errors:
        out[code ^ e] = info
    return out


def segment_keys(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into x, key) for each different key of each 23-bit segment."""
    table = codewords()
    own = np.bitwise_count(x) % 2 == 1
    at, near = [np.arange(len(x))], [table[x].astype(np.int32)]
    odd = np.flatnonzero(own)
    for k in range(23):
        at.append(odd)
        near.append(table[x[odd] ^ (1 << k)].astype(np.int32))
    both = np.unique(np.concatenate(at).astype(np.int64) << 12 | np.concatenate(near))
    return both >> 12, (both & 4095).astype(np.int32)


def bucket_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into fps, bucket) for each bucket of each fingerprint."""
    keys = []
    for low, size in SEGMENTS:
        at, key = segment_keys((fps >> np.uint64(low) & np.uint64((1 << size) - 1)).astype(np.int64))
        begin = np.searchsorted(at, np.arange(len(fps) + 1))
        keys.append((key.astype(np.int64), begin[:-1], np.diff(begin)))
    rows, out = [], []
    for pair, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        (ka, sa, na), (kb, sb, nb) = keys[a], keys[b]
        count = na * nb
        row = np.repeat(np.arange(len(fps)), count)
        j = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        out.append(pair << 24 | ka[sa[row] + j // nb[row]] << 12 | kb[sb[row] + j % nb[row]])
        rows.append(row)
    return np.concatenate(rows), np.concatenate(out)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column("fp").to_numpy().view(np.uint64)
        for i in range(0, len(fps), 4096):
            part = fps[i : i + 4096]
            row, key = bucket_keys(part)
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(part[row].view(np.int64))], ["bucket", "fp"])


class Forest:
    """Disjoint sets over the places of an array, by numpy rounds of smallest labels."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            a, b = self.find(a), self.find(b)
            differ = a != b
            a, b = a[differ], b[differ]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))

    def find(self, a: np.ndarray) -> np.ndarray:
        label = self.label
        while True:
            up = label[a]
            if (up == a).all():
                return a
            label[a] = label[up]
            a = label[a]


def near_pairs(fps: np.ndarray, group: np.ndarray, bits: range | list[int] = range(64)) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of fingerprints of one group within NEAR bits; those of a group are distinct.

    Of the bits in which they may differ four bands are made, one of which two near ones have in common: they are compared with
    those of the same band, neighbours in order at growing lags. A run of more than RUN fingerprints with one band is searched in
    the same way by its other bits, so that many that are alike in a band aren't all compared with each other.
    """
    for band in range(4):
        own = bits[band::4]
        mask = np.uint64(sum(1 << b for b in own))
        value = fps & mask
        order = np.lexsort((fps, value, group))
        g, v, f = group[order], value[order], fps[order]
        edge = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (v[1:] != v[:-1]), [True]))) if len(f) else np.zeros(1, np.int64)
        size = np.diff(edge)
        large = (size > RUN) & (len(bits) - len(own) > 8)
        alive = np.flatnonzero(~np.repeat(large, size))
        lag = 1
        while len(alive):
            alive = alive[alive + lag < len(order)]
            alive = alive[(g[alive] == g[alive + lag]) & (v[alive] == v[alive + lag])]
            near = alive[np.bitwise_count(f[alive] ^ f[alive + lag]) <= NEAR]
            if len(near):
                yield order[near], order[near + lag]
            lag += 1
        rest = [b for b in bits if b not in own]
        for a, b in zip(edge[:-1][large].tolist(), edge[1:][large].tolist(), strict=True):
            part = order[a:b]
            for x, y in near_pairs(fps[part], np.zeros(len(part), np.int64), rest):
                yield part[x], part[y]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links among a partition's buckets; the partition's rows are distinct fingerprints by bucket."""
    keys, fps = [], []
    for batch in batches:
        keys.append(batch.column("bucket").to_numpy())
        fps.append(batch.column("fp").to_numpy().view(np.uint64))
    if not keys:
        return
    key, fp = np.concatenate(keys), np.concatenate(fps)
    order = np.argsort(key, kind="stable")
    key, fp = key[order], fp[order]
    same = np.concatenate(([False], key[1:] == key[:-1]))
    shared = same | np.append(same[1:], False)
    key, fp = key[shared], fp[shared]
    if not len(fp):
        return
    known, place = np.unique(fp, return_inverse=True)
    forest = Forest(len(known))
    for a, b in near_pairs(fp, key):
        forest.join(place[a], place[b])
    root = forest.find(np.arange(len(known)))
    tied = np.flatnonzero(root != np.arange(len(known)))
    if len(tied):
        yield pa.RecordBatch.from_arrays([pa.array(known[tied].view(np.int64)), pa.array(known[root[tied]].view(np.int64))], ["a", "b"])


def _least(edges: DataFrame, heavy: int) -> tuple[DataFrame, DataFrame]:
    """(node, m) with the smallest neighbour of each node, and of those with over heavy neighbours alone."""
    least = checkpoint(edges.groupBy("node").agg(F.min("other").alias("m"), F.count("*").alias("degree")))
    return least.select("node", "m"), least.where(F.col("degree") > heavy).select("node", "m")


def _with_least(edges: DataFrame, least: DataFrame, hubs: DataFrame) -> DataFrame:
    """edges with m of their node. The neighbours of a hub stay where they are, as its m is sent to them."""
    few = F.broadcast(hubs)
    return edges.join(few, "node").unionByName(edges.join(F.broadcast(hubs.select("node")), "node", "left_anti").join(least, "node"))


def _summary(edges: DataFrame) -> tuple:
    """The same for the same set of edges (and for others with a chance of 2**-64)."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node that can be reached."""
    # large-star / small-star (Kiveris et al. 2014): a round hangs nodes below the smallest neighbour; ends when all are stars.
    edges = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _summary(edges)
    # Nodes with more neighbours than this are sent to all tasks: at most HUBS of them, as each has so many of the edges.
    heavy = max(HEAVY, 2 * before[0] // HUBS)
    while before[0]:
        both = edges.union(edges.select("b", "a")).toDF("node", "other")
        large = _with_least(both, *_least(both, heavy)).where("other > node").select(F.col("other").alias("node"), F.least("m", "node").alias("other")).where("node <> other")
        down = checkpoint(large.distinct())
        least, hubs = _least(down, heavy)
        small = _with_least(down, least, hubs).select(F.col("other").alias("a"), F.col("m").alias("b")).union(least).where("a <> b").distinct()
        edges = checkpoint(small)
        after = _summary(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def links(fps: DataFrame, rows: int) -> DataFrame:
    """(a, b): a spanning forest of the links among distinct fingerprints ``fp``, of about so many rows."""
    spark = fps.sparkSession
    n = max(1, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_FINGERPRINTS))
    buckets = fps.select("fp").repartition(n).mapInArrow(_buckets, "bucket int, fp long")
    return buckets.repartition(n, "bucket").mapInArrow(_links, "a long, b long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tag (hash of the text), fp (signed 64-bit fingerprint) and component_id, a row for each row of docs."""
    spark = docs.sparkSession
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("body"), F.xxhash64(docs[text_col]).alias("tag"))
    marked = checkpoint(src.mapInArrow(_fingerprints, f"id {dict(src.dtypes)['id']}, tag long, fp long"))
    distinct = marked.groupBy("fp").agg(F.min("id").alias("first_id"))
    tree = components(spark, links(distinct, marked.count()))
    # Only fingerprints with a near one are in the tree; the others are their own component.
    rooted = distinct.join(tree, distinct["fp"] == tree["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = checkpoint(rooted)
    first = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = rooted.join(first, "root").select("fp", "component_id")
    return marked.join(of, "fp").select(F.col("id").alias("doc_id"), "tag", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that have a near one with a smaller id: of each component the smallest doc_id stays.

    Rows without an id stay; so do rows that repeat the kept id with a text of the same component.
    """
    gone = near_dedup(docs, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id"), F.col("tag").alias("gone_tag")).distinct()
    return docs.join(gone, (docs[id_col] == gone["gone_id"]) & F.xxhash64(docs[text_col]).eqNullSafe(gone["gone_tag"]), "left_anti")
