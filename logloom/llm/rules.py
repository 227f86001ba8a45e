r"""Quality rules: base counts of each document, and the frequency of its lines across the documents of its host.

A document's lines that hold a word are hashed over their words (A-Z in lower case). Per host, the number of distinct documents
(distinct doc_ids; rows without one count each) with each line is counted. A line is boilerplate where more than ``MAX_DOCS``
documents and more than ``MAX_SHARE`` of the host's distinct documents have it. Copies are documents like any others: where a
host has more of one text than that, its lines are frequent and the copies depleted. Boilerplate lines are removed, and a document is depleted, and rejected, when less than
``MIN_LEFT`` of its words are left.

How it runs: one pass over the texts writes base counts, a text hash and the line hashes of each document to the shared folder.
Lines are made distinct by (host, line, document), which no key can dominate, and counted from there with partial sums before the
shuffle, so a line that a third of all documents hold is a row a task. Only frequent lines come out of it, fewer than lines / MAX_DOCS; documents meet them by a join that Spark may
split where it is skewed, and sums per document are partial again.

Edge cases: a null text is an empty one: no words, and base_failed; a null host is a host of its own; a null doc_id is kept as
null, rows are told apart by a number of their own, so repeated rows come out as often as they went in; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import written
from .statistics import Texts

MIN_WORDS, REPEAT_SHARE = 50, 50
MAX_DOCS, MAX_SHARE, MIN_LEFT = 20, 0.002, 0.3

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in K.slices(batch, "body"):
            data, off = K.utf8(part.column("body"))
            t = Texts(data, off)
            h, size, _, line_off = K.line_word_hash(data, off)
            _, twice = t.duplicate_lines()
            base = [pa.array(np.asarray(x, np.int64)) for x in (t.n_words, t.word_chars, t.symbols(), twice, t.repeated_words())]
            # Each different line of a document once, with the words that it has there in all.
            row = np.repeat(np.arange(t.rows), np.diff(line_off))
            order = np.lexsort((h, row))
            r, v = row[order], h[order]
            first = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (v[1:] != v[:-1])))) if len(r) else np.zeros(0, np.int64)
            words = np.add.reduceat(size[order], first) if len(first) else np.zeros(0, np.int64)
            begin = np.searchsorted(r[first], np.arange(t.rows + 1)).astype(np.int32)
            lines = pa.StructArray.from_arrays([pa.array(v[first].view(np.int64)), pa.array(words.astype(np.int32))], ["h", "w"])
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("host"), *base, pa.ListArray.from_arrays(pa.array(begin), lines)],
                ["id", "host", *(x.split()[0] for x in BASE.split(", ")), "lines"],
            )


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """doc_id, base counts, n_line_words, n_removed_words, base_failed and kept of each row."""
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("body"), docs[host_col].cast("string").alias("host"))
    kind = dict(src.dtypes)["id"]
    found = src.mapInArrow(_scan, f"id {kind}, host string, {BASE}, lines array<struct<h: long, w: int>>")
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "rules")
    host = F.xxhash64("host", F.col("host").isNull()).alias("host")
    document = F.when(F.col("id").isNotNull(), F.xxhash64("id")).otherwise(F.xxhash64("row", F.lit("row")))
    lines = found.select("row", host, document.alias("doc"), F.explode("lines").alias("line")).select("row", "host", "doc", F.col("line.h").alias("h"), F.col("line.w").alias("w"))
    size = found.select(host, document.alias("doc")).distinct().groupBy("host").agg(F.count("*").alias("docs"))
    counted = lines.select("host", "h", "doc").distinct().groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > max_docs)
    frequent = counted.join(size, "host").where(F.col("n") > F.col("docs") * max_share).select("host", "h")
    frequent = written(frequent, "frequent-lines")  # its size is then known: sent to all tasks if small, else joined by a shuffle
    removed = lines.join(frequent, ["host", "h"]).groupBy("row").agg(F.sum("w").alias("removed"))
    out = found.join(removed, "row", "left").withColumn("removed", F.coalesce("removed", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words"))
    depleted = F.col("n_words") - F.col("removed") < F.col("n_words") * min_left
    return out.select(
        F.col("id").alias("doc_id"), *(x.split()[0] for x in BASE.split(", ")), F.col("removed").alias("n_removed_words"),
        failed.alias("base_failed"), (~failed & ~depleted).alias("kept"),
    )
