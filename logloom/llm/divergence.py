r"""Source divergence audit: how the words of each source differ from those of the others, and of the whole, in its language.

Terms are runs of letters A-Z, a-z and everything beyond ASCII; only A-Z are lower-cased. Each language keeps the V terms that ``MIN_DOCS`` or more of its
documents (rows) have. A group (language, source), and a language as a whole, gives a kept term of count c the share p = 1 + floor(SCALE * (c + ADD) /
(N + ADD * V)), N being its sum of counts over the kept terms; all of it in whole numbers. The divergence of two groups is the sum of abs(p - q)
over the kept terms; terms that a group has more of than its language are ranked by their excess.

1. Byte-level tokenizer (``mapInArrow``): a lookup table over the concatenated UTF-8 buffers gives lower-cased letters and zeros, whose edges are
   the terms' boundaries. Slices are grouped by hash with a comparison of their bytes, and each distinct one gets an XXH3 digest, by which a
   task gathers counts over many batches, again comparing bytes where digests meet. A task sends a term of a group once for
   all its batches (up to ``VOCABULARY`` terms), so a frequent term of a source that holds most rows is a row a task.
2. Spark sums counts and documents by (language, source, term), then documents by (language, term), and keeps the frequent terms.
3. CSR matrices: kept counts are grouped by (language, block of terms), blocks by hash and of bounded size; a task holds a block's groups as
   the rows of a CSR matrix of shares. For each row all others' divergences come from one pass over the stored entries, summed by
   ``reduceat`` over the rows' edges, plus a term for absent ones. Spark sums the blocks' parts.

Groups of a language meet in pairs because the result lists every pair of them; documents and terms never do.

Edge cases: null text, lang and source are ''; a group without terms has count 0 for each kept term; a language without kept terms
has divergence 0 between its sources and no rows of part ``term``; a lone source has no rows of part ``pair``; repeated documents count as often
as they occur; ties are ranked by item, UTF-8 bytewise; very long texts are read whole; an empty table gives no rows; extra columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .shared import written

MIN_DOCS, ADD, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Terms, and counts of (group, term), that a task gathers before it sends them; entries of a block.
VOCABULARY, PAIRS, BLOCK = 400_000, 1_500_000, 100_000
#: Bytes of text tokenized at once, and rows sent at once.
SLICE, ROWS = 4 << 20, 50_000

#: Byte to letter; 0 where it is none. A-Z become a-z.
LETTER = np.zeros(256, np.uint8)
LETTER[97:123] = np.arange(97, 123)
LETTER[65:91] = np.arange(97, 123)
LETTER[128:] = np.arange(128, 256)


def grouped_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each slice's group, one slice of each group): slices are in one group if their bytes are the same."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, size = K.span_hash(data, starts, ends), ends - starts
    order = np.argsort(h, kind="stable")
    sorted_h = h[order]
    new = np.concatenate(([True], sorted_h[1:] != sorted_h[:-1]))
    head = order[np.flatnonzero(new)]
    group = np.empty(len(h), np.int64)
    group[order] = np.cumsum(new) - 1
    first = head[group]
    lane = K.lanes(data)
    other = np.flatnonzero((size != size[first]) | ~K.same_spans(lane, starts, lane, starts[first], size))
    # Slices whose hash is that of another text: by their bytes.
    more: dict[bytes, int] = {}
    for i in other.tolist():
        raw = data[starts[i] : ends[i]].tobytes()
        if raw not in more:
            more[raw] = len(head)
            head = np.append(head, i)
        group[i] = more[raw]
    return group, head


class Counts:
    """Counts of (group, term) over many batches: groups are (lang, source), terms are found by digest and compared by bytes."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.reset()

    def reset(self) -> None:
        self.terms: list[bytes] = []
        self.by_digest: dict[int, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def number(self, raw: bytes) -> int:
        digest = xxhash.xxh3_64_intdigest(raw)
        while (got := self.by_digest.get(digest)) is not None:
            if self.terms[got] == raw:
                return got
            digest = (digest + 1) & 0xFFFFFFFFFFFFFFFF
        self.by_digest[digest] = len(self.terms)
        self.terms.append(raw)
        return len(self.terms) - 1

    def add(self, lang: list[str], source: list[str], data: np.ndarray, offsets: np.ndarray) -> None:
        low = LETTER[data]
        starts, ends, off = K.runs(low != 0, offsets)
        local, head = grouped_slices(low, starts, ends)
        raw = low.tobytes()
        known = np.array([self.number(raw[a:b]) for a, b in zip(starts[head].tolist(), ends[head].tolist(), strict=True)], np.int64)
        group = np.array([self.groups.setdefault(x, len(self.groups)) for x in zip(lang, source, strict=True)], np.int64)
        width = max(1, len(head))
        pair, n = np.unique(np.repeat(np.arange(len(off) - 1), np.diff(off)) * width + local, return_counts=True)  # (document, term)
        key = group[pair // width] << 32 | known[pair % width]
        self._keep(key, n, np.ones(len(key), np.int64))

    def _keep(self, key: np.ndarray, n: np.ndarray, docs: np.ndarray) -> None:
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        if len(first):
            self.parts.append((key[first], np.add.reduceat(n[order], first), np.add.reduceat(docs[order], first)))
            self.held += len(first)

    def full(self) -> bool:
        if self.held > PAIRS and len(self.parts) > 1:
            parts, self.parts, self.held = self.parts, [], 0
            self._keep(*[np.concatenate(x) for x in zip(*parts, strict=True)])
        return self.held > PAIRS or len(self.terms) > VOCABULARY

    def rows(self) -> Iterator[pa.RecordBatch]:
        parts, self.parts, self.held = self.parts, [], 0
        if parts:
            self._keep(*[np.concatenate(x) for x in zip(*parts, strict=True)])
            key, n, docs = self.parts[0]
            names = list(self.groups)
            langs, sources = (pa.array([x[k] for x in names], pa.string()) for k in (0, 1))
            terms = pa.array(self.terms, pa.binary()).cast(pa.string())
            for a in range(0, len(key), ROWS):
                of = pa.array(key[a : a + ROWS] >> 32)
                yield pa.RecordBatch.from_arrays(
                    [langs.take(of), sources.take(of), terms.take(pa.array(key[a : a + ROWS] & 0xFFFFFFFF)), pa.array(n[a : a + ROWS]), pa.array(docs[a : a + ROWS])], ["lang", "source", "term", "n", "docs"],
                )
        self.reset()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = Counts()
    for batch in batches:
        for part in K.slices(batch, "body", SLICE):
            counts.add(part.column("lang").to_pylist(), part.column("source").to_pylist(), *K.utf8(part.column("body")))
            if counts.full():
                yield from counts.rows()
    yield from counts.rows()


def share(n: Column, total: Column, terms: Column) -> Column:
    """p of a count: exact, in decimals of 38 digits."""
    wide = "decimal(38,0)"
    top, bottom = F.lit(SCALE).cast("decimal(10,0)") * (n + ADD).cast("decimal(28,0)"), (total + ADD * terms).cast(wide)
    return F.lit(1) + F.call_function("div", top.cast(wide), bottom)


def row_divergences(shares: np.ndarray, terms: np.ndarray, off: np.ndarray, absent: np.ndarray, n_terms: int) -> np.ndarray:
    """Sums of abs(p - q) over n_terms terms between all rows of a CSR matrix (shares and terms, edges off); what a row doesn't store is its ``absent`` share."""
    rows = len(absent)
    out = np.zeros((rows, rows), np.int64)
    if not len(shares):
        return n_terms * np.abs(absent[:, None] - absent[None, :])
    base = np.repeat(absent, np.diff(off))
    some = np.flatnonzero(np.diff(off) > 0)
    own = np.empty(n_terms, np.int64)
    for a in range(rows):
        mine, at = shares[off[a] : off[a + 1]], terms[off[a] : off[a + 1]]
        own[:] = absent[a]
        own[at] = mine
        other = own[terms]
        out[a, some] = np.add.reduceat(np.abs(shares - other) - np.abs(base - other), off[some])
        # All terms as if the other row stored none: those that this row stores, from its sorted shares, and the rest.
        order = np.sort(mine)
        run = np.concatenate(([0], np.cumsum(order)))
        k = np.searchsorted(order, absent)
        stored = absent * k - run[k] + (run[-1] - run[k]) - absent * (len(order) - k)
        out[a] += stored + (n_terms - len(mine)) * np.abs(absent - absent[a])
    return out


PARTS = "lang string, source string, item string, value long"


def _block(key: tuple, entries: pa.Table, groups: pa.Table) -> pa.Table:
    names, absent = groups.column("source").to_pylist(), groups.column("absent").to_numpy()
    number = {s: i for i, s in enumerate(names)}
    row = np.array([number[s] for s in entries.column("source").to_pylist()], np.int64)
    words = pa.array(entries.column("term").to_pylist(), pa.string()).dictionary_encode()
    order = np.argsort(row, kind="stable")
    off = np.searchsorted(row[order], np.arange(len(names) + 1))
    got = row_divergences(entries.column("p").to_numpy()[order], words.indices.to_numpy()[order], off, absent, len(words.dictionary))
    a, b = np.nonzero(~np.eye(len(names), dtype=bool))
    of = pa.array(names, pa.string())
    return pa.table({"lang": pa.array([key[0].as_py()] * len(a), pa.string()), "source": of.take(pa.array(a)), "item": of.take(pa.array(b)), "value": pa.array(got[a, b])})


def kept_counts(docs: DataFrame, min_docs: int = MIN_DOCS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(counts of the kept terms: lang, source, term, n; all groups: lang, source), both written."""
    none = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    src = docs.select(none(lang_col).alias("lang"), none(source_col).alias("source"), docs[text_col].alias("body"))
    found = src.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    counts = written(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "term")
    return written(counts.drop("docs").join(kept, ["lang", "term"], "left_semi"), "kept-counts"), written(src.select("lang", "source").distinct(), "groups")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK, **columns: str) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value and rank: the divergence of each group from the others of its language, and its ``top`` terms."""
    counts, groups = kept_counts(docs, min_docs, **columns)
    whole = written(counts.groupBy("lang", "term").agg(F.sum("n").alias("all")), "term-totals")
    langs = groups.select("lang").distinct().join(whole.groupBy("lang").agg(F.sum("all").alias("lang_total"), F.count("*").alias("terms")), "lang", "left")
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    meta = groups.join(sums, ["lang", "source"], "left").join(langs, "lang").na.fill(0, ["total", "lang_total", "terms"])
    absent = F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("terms")))
    meta = written(meta.withColumn("absent", absent), "group-totals")
    shares = counts.join(meta, ["lang", "source"]).select("lang", "source", "term", "lang_total", "terms", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"))
    # Pairs: sums over blocks of terms.
    blocks = max(1, -(-counts.count() // block))
    of = F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int")
    entries = shares.select("lang", "source", "term", "p", of.alias("block"))
    rows = meta.where("terms > 0").select("lang", "source", "absent", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    parts = entries.groupBy("lang", "block").cogroup(rows.groupBy("lang", "block")).applyInArrow(_block, PARTS)
    sums = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = meta.select("lang", "source").join(meta.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = both.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    # Terms that a group has more of than its language.
    excess = shares.join(whole, ["lang", "term"]).withColumn("value", F.col("p") - share(F.col("all"), F.col("lang_total"), F.col("terms"))).where("value > 0")
    excess = excess.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", place).unionByName(excess.withColumn("rank", place).where(F.col("rank") <= top))
