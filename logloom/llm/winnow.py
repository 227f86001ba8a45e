r"""Line dedup by winnowing: runs of lines that already stand earlier are deleted.

Lines are hashed over their words (A-Z in lower case); lines without a word don't count, are kept, and don't break a run. A
window is ``min_lines`` consecutive lines, or with ``min_words`` (the pipeline's stage: 50) also fewer lines that hold that many
words. A line goes if a window that covers it also stands at a smaller (doc_id, line).

1. Winnowing (``mapInArrow``): of each window the smallest line hash is selected, the last one on ties. Equal windows select the
   same line at the same place, so the selected lines are guaranteed fingerprints of any shared run. A document with windows is one row: its
   line hashes, and which of them are selected (about half, however many windows select one).
2. Positions (document, line) meet by their fingerprint; those of fingerprints that stand at a single position of the corpus match nothing,
   and most documents have no others.
3. The rest go back to their documents' line hashes, and a match is extended to both sides of its position: of the windows around it those
   that select it. Windows with the same fingerprint and equal lines to its left and right (128 bits over the hashes of all
   their lines) are one passage; all but the first are repeats, and overlapping repeats merge into maximal runs.
4. Texts meet the repeats of their document, and the covered lines are deleted.

Nothing compares pairs: positions of a fingerprint, and windows of a passage, meet in minima, with partial ones before each shuffle, and
the minima are written to the shared folder before rows are joined to them, so that Spark can split the join of a line or window
that a third of all documents hold.

Edge cases: a null or empty text has no lines and is returned as it is; a null doc_id neither loses lines nor makes others lose
any; a run repeated within one document goes as well; rows with the same doc_id and text lose the same lines and never beat each
other; doc_ids may be of any type that has an order; texts with fewer lines than a window keep everything; extra columns,
whatever their names, are passed through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import written

#: Bits of a place that hold the number of lines.
RUN_BITS = 4
#: Documents that are extended at once.
ROWS = 500


def line_windows(data: np.ndarray, offsets: np.ndarray, width: int, min_words: int | None) -> dict[str, np.ndarray]:
    """``windows`` of texts."""
    lh, size, _, off = K.line_word_hash(data, offsets)
    return windows(lh, size, off, width, min_words)


def windows(lh: np.ndarray, size: np.ndarray, off: np.ndarray, width: int, min_words: int | None) -> dict[str, np.ndarray]:
    """row, place (first line << RUN_BITS | lines), fingerprint f with its line ``at``, and two hashes of each window; from line hashes and numbers of words."""
    words = np.concatenate(([0], np.cumsum(size)))
    found: dict[str, list[np.ndarray]] = {k: [] for k in ("row", "place", "f", "at", "h", "g")}
    for w in range(1 if min_words is not None else width, width + 1):
        row, first, h = K.window_hash(lh, off, w)
        begin = off[row] + first if len(row) else np.zeros(0, np.int64)
        if w < width:
            ok = words[begin + w] - words[begin] >= min_words
            row, first, h, begin = row[ok], first[ok], h[ok], begin[ok]
        least, at, other = np.full(len(row), np.iinfo(np.uint64).max, K.U64), np.zeros(len(row), np.int64), np.full(len(row), w, K.U64)
        for k in range(w):
            line = lh[begin + k]
            last = line <= least
            least[last], at[last] = line[last], k
            other = K.mix(other * K.U64(K.BYTE_BASE) ^ line)
        for k, v in (("row", row), ("place", first << RUN_BITS | w), ("f", least), ("at", first + at), ("h", K.mix(h + K.U64(w))), ("g", other)):
            found[k].append(v)
    return {k: np.concatenate(v) for k, v in found.items()}


def _lists(values: np.ndarray, off: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values, kind))


def _flat(column: pa.ListArray, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind)


def _select(width: int, min_words: int | None):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents with windows: their lines, and those that a window selects."""
        for batch in batches:
            for part in K.slices(batch, "body"):
                lh, size, _, off = K.line_word_hash(*K.utf8(part.column("body")))
                found = windows(lh, size, off, width, min_words)
                picked = np.unique(off[found["row"]] + found["at"]) if len(found["row"]) else np.zeros(0, np.int64)
                row = np.searchsorted(off, picked, "right") - 1
                arrays = [part.column("id"), part.column("rid"), _lists(lh.view(np.int64), off, pa.int64()), _lists(size, off, pa.int32()), _lists(picked - off[row], np.searchsorted(picked, off), pa.int32())]
                out = pa.RecordBatch.from_arrays(arrays, ["id", "rid", "lines", "words", "picked"])
                yield out.filter(pa.array(np.bincount(row, minlength=len(off) - 1) > 0))

    return go


def _extend(width: int, min_words: int | None):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows that extend from a document's shared positions (``at``)."""
        for batch in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
            lines, at = batch.column("lines"), batch.column("at")
            off = np.concatenate(([0], np.cumsum(lines.value_lengths().to_numpy(zero_copy_only=False))))
            shared = np.zeros(off[-1], dtype=bool)
            shared[np.repeat(off[:-1], at.value_lengths().to_numpy(zero_copy_only=False)) + _flat(at, np.int64)] = True
            found = windows(_flat(lines, np.int64).view(K.U64), _flat(batch.column("words"), np.int64), off, width, min_words)
            keep = np.flatnonzero(shared[off[found["row"]] + found["at"]]) if len(found["row"]) else np.zeros(0, np.int64)
            row = pa.array(found["row"][keep])
            numbers = [pa.array(found[k][keep].view(np.int64)) for k in ("f", "h", "g", "place")]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(row), batch.column("rid").take(row), *numbers], ["id", "rid", "f", "h", "g", "place"])

    return go


def remaining_lines(text: str | None, places: np.ndarray | None) -> tuple[int, int, str | None]:
    """Lines with a word, lines that windows at places cover, and the text without these."""
    if text is None:
        return 0, 0, None
    pieces = text.split("\n")
    full = [i for i, x in enumerate(pieces) if x.strip(" \t\n\v\f\r")]
    if places is None:
        return len(full), 0, text
    edge = np.zeros(len(full) + (1 << RUN_BITS) + 1, np.int32)
    np.add.at(edge, places >> RUN_BITS, 1)
    np.add.at(edge, (places >> RUN_BITS) + (places & (1 << RUN_BITS) - 1), -1)
    drop = {full[i] for i in np.flatnonzero(np.cumsum(edge)[: len(full)] > 0)}
    return len(full), len(drop), "\n".join(x for i, x in enumerate(pieces) if i not in drop)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in K.slices(batch, "body"):
            found = [remaining_lines(t, None if p is None else np.array(p, np.int64)) for t, p in zip(part.column("body").to_pylist(), part.column("places").to_pylist(), strict=True)]
            n, gone, kept = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([part.column("rest"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["rest", "n", "gone", "kept"])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 3, min_words: int | None = None) -> DataFrame:
    """``rest`` (the input columns other than the text), ``n`` lines with a word, ``gone`` lines deleted, ``kept`` text.

    Runs of min_lines lines that stand earlier are deleted; with min_words also shorter runs of that many words.
    """
    if not 0 < min_lines < 1 << RUN_BITS:
        raise ValueError(f"min_lines must be from 1 to {(1 << RUN_BITS) - 1}")
    src = docs.select(
        docs[id_col].alias("id"), docs[text_col].alias("body"), F.xxhash64(docs[id_col], docs[text_col]).alias("rid"),
        F.struct(*[docs[c] for c in docs.columns if c != text_col]).alias("rest"),
    )
    kinds = dict(src.dtypes)
    known = src.where(F.col("id").isNotNull() & F.contains("body", F.lit("\n")) if min_words is None and min_lines > 1 else F.col("id").isNotNull())
    kind, own = f"id {kinds['id']}, rid long", (min_lines, min_words)
    lined = known.select("id", "rid", "body").mapInArrow(_select(*own), f"{kind}, lines array<long>, words array<int>, picked array<int>")
    lined = written(lined.withColumn("doc", F.monotonically_increasing_id()), "line-hashes")
    positions = lined.select("doc", "id", F.explode(F.transform("picked", lambda i: F.struct(i.alias("at"), F.get("lines", i).alias("f")))).alias("p")).select("doc", "id", "p.at", "p.f")
    position = F.struct("id", "at")
    shared = positions.groupBy("f").agg(F.min(position).alias("lo"), F.max(position).alias("hi")).where("lo <> hi").select("f")
    hits = positions.join(written(shared, "line-fingerprints"), "f", "left_semi").groupBy("doc").agg(F.collect_list("at").alias("at"))
    matched = written(lined.join(hits, "doc").select("id", "rid", "lines", "words", "at").mapInArrow(_extend(*own), f"{kind}, f long, h long, g long, place long"), "line-matches")
    rank = F.struct("id", F.col("place").alias("place"))
    passage = ["f", "h", "g"]
    first = matched.groupBy(*passage).agg(F.min(rank).alias("lo"), F.max(rank).alias("hi")).where("lo <> hi").select(*passage, "lo")
    repeats = matched.join(written(first, "line-repeats"), passage).where(rank > F.col("lo"))
    lost = repeats.groupBy("id", "rid").agg(F.collect_set("place").alias("places"))
    met = src.join(lost, ["id", "rid"], "left").select("body", "places", "rest")
    return met.mapInArrow(_apply, f"rest {kinds['rest']}, n long, gone long, kept string")
