"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

1. Statistics of each whole text (``statistics.py``), kept in the shared folder: texts are read once.
2. Rows with a label are joined by doc_id. Means and spreads of the statistics scale them.
3. Random Fourier features ``sqrt(2) cos(W x + b)`` approximate a Gaussian kernel; W and b come from a fixed seed.
4. Each partition sums its part of the normal equations, for two folds apart; features are rounded to multiples of 2**-12 and
   summed as whole numbers, so the sums don't depend on the partitioning or the order of rows. A row of the matrix is one row
   of a DataFrame, and the sums are added up by Spark; the driver gets two matrices of fixed size (``DIMENSION``).
5. Ridge weights of one fold score the other one; the scores, in ``BINS`` bins, are calibrated by isotonic regression (pool
   adjacent violators), which the driver fits on the counts of those bins.
6. All rows are scored with the weights of both folds together.

Nothing is sampled: the fit takes every labelled row that may be learnt from. Labels, languages, sources and ids are not
features.

Edge cases: a null text is an empty one, and is scored; rows with a null doc_id are scored, never learnt from, and not held
out; labels that are null are ignored, and of several labels of one document each counts; without any labels the score is 0.5
for all; repeated rows get the same score; extra columns are ignored by ``quality_scores`` and kept by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import checkpoint
from .statistics import NAMES, statistics

DIMENSION, GAMMA, RIDGE, SEED = 384, 0.04, 1e-3, 20240229
BINS, SCALE = 4096, 1 << 12
#: Scaled statistics are cut here, so that a single outlier doesn't rule a scale.
CUT = 6.0


def basis() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.normal(0, np.sqrt(2 * GAMMA), (len(NAMES), DIMENSION)), rng.uniform(0, 2 * np.pi, DIMENSION)


def features(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Whole numbers: random Fourier features, the scaled statistics themselves and a constant, times SCALE."""
    w, b = basis()
    z = np.clip((x - mean) / spread, -CUT, CUT)
    return np.rint(np.concatenate((np.sqrt(2) * np.cos(z @ w + b), z / 3, np.ones((len(z), 1))), axis=1) * SCALE)


def document_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, hash of the text and an array of statistics, for each row."""
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("body"), F.xxhash64(docs[text_col]).alias("tag"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, "body"):
                x = statistics(*K.utf8(part.column("body")))
                flat = pa.array(x.reshape(-1))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("tag"), pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], flat)], ["id", "tag", "x"])

    return src.mapInArrow(go, f"id {dict(src.dtypes)['id']}, tag long, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(NAMES))


def _equations(mean: np.ndarray, spread: np.ndarray):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = DIMENSION + len(NAMES) + 1
        sums = np.zeros((2, size, size + 1), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                z = features(_matrix(part.column("x")), mean, spread)
                fold, y = part.column("fold").to_numpy(), part.column("label").to_numpy().astype(float) * SCALE
                for k in (0, 1):
                    own = z[fold == k]
                    sums[k] += np.rint(own.T @ np.concatenate((own, y[fold == k, None]), axis=1)).astype(np.int64)
        for k in (0, 1):
            if sums[k].any():
                row = pa.ListArray.from_arrays(np.arange(size + 1, dtype=np.int32) * (size + 1), pa.array(sums[k].reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, k, np.int32)), pa.array(np.arange(size, dtype=np.int32)), row], ["fold", "row", "values"])

    return go


def _add_rows(key: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in group:
        part = batch.column("values").flatten().to_numpy().reshape(batch.num_rows, -1).sum(axis=0)
        total = part if total is None else total + part
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([total.tolist()], pa.list_(pa.int64()))], ["fold", "row", "values"])


def ridge(sums: np.ndarray) -> np.ndarray:
    size = len(sums)
    a, b = sums[:, :size].astype(float), sums[:, size].astype(float)
    n = max(a[-1, -1], 1.0)
    return np.linalg.solve(a / n + RIDGE * np.eye(size), b / n)


def isotonic(good: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Non-decreasing rates of the bins by pooling adjacent violators; bins without rows take the rate of the bin before."""
    stack: list[list[float]] = []  # good, total, bins
    for g, n in zip(good.tolist(), total.tolist(), strict=True):
        stack.append([g, n, 1])
        while len(stack) > 1 and stack[-2][0] * stack[-1][1] >= stack[-1][0] * stack[-2][1]:
            g, n, k = stack.pop()
            stack[-1][0] += g
            stack[-1][1] += n
            stack[-1][2] += k
    out = np.concatenate([np.full(int(k), g / n if n else 0.0) for g, n, k in stack])
    return np.clip(out, 0, 1)


def _bin(raw: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((raw + 0.5) / 2 * BINS), 0, BINS - 1).astype(np.int32)


def _raw(weights: np.ndarray, mean: np.ndarray, spread: np.ndarray):
    """id-keeping scorer: bins of raw scores; row k of weights scores the rows of fold k, and row 2 those without a fold."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"))
            out = np.zeros(len(x), np.int32)
            for at in range(0, len(x), 4096):
                raw = features(x[at : at + 4096], mean, spread) @ weights.T / SCALE
                which = batch.column("fold").slice(at, 4096).to_numpy()
                out[at : at + 4096] = _bin(np.round(raw[np.arange(len(raw)), which], 9))
            names = [n for n in batch.schema.names if n != "x"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out)], [*names, "bin"])

    return go


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, tag (hash of the text), held_out, score and predicted of each row; only labels of rows that aren't held out are looked at."""
    stats = checkpoint(document_statistics(docs, id_col, text_col))
    part = F.crc32(F.col("id").cast("string").cast("binary")) % 3
    held = F.coalesce(part == 1, F.lit(False))
    known = labels.select(labels[id_col].alias("label_id"), labels[label_col].cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("label_id").isNotNull())
    train = stats.where(~held & F.col("id").isNotNull()).join(known, F.col("id") == F.col("label_id")).select("x", "label", F.when(part == 0, 0).otherwise(1).alias("fold"))
    train = checkpoint(train)
    # Sums of decimals: the same for any order of rows.
    number = lambda c: F.sum(F.round(c, 6).cast("decimal(28,6)"))
    x = [F.col("x")[k] for k in range(len(NAMES))]
    got = train.agg(F.count("*"), *[number(c) for c in x], *[number(c * c) for c in x]).first()
    n = got[0]
    if not n:
        return stats.select(F.col("id").alias("doc_id"), "tag", held.alias("held_out"), F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    mean, square = np.array([float(v) for v in got[1:]]).reshape(2, -1) / n
    spread = np.sqrt(np.maximum(square - mean**2, 0))
    spread = np.where(spread > 1e-9, spread, 1.0)
    size = DIMENSION + len(NAMES) + 1
    rows = train.mapInArrow(_equations(mean, spread), "fold int, row int, values array<long>").groupBy("fold", "row").applyInArrow(_add_rows, "fold int, row int, values array<long>").collect()
    matrix = np.zeros((2, size, size + 1), np.int64)
    for r in rows:
        matrix[r.fold, r.row] = r["values"]
    both = ridge(matrix[0] + matrix[1])
    cross = np.stack([ridge(m) if m.any() else both for m in matrix[::-1]] + [both])
    bins = train.select("x", "label", "fold").mapInArrow(_raw(cross, mean, spread), "label int, fold int, bin int").groupBy("bin").agg(F.sum("label").alias("good"), F.count("*").alias("n")).collect()
    good, total = np.zeros(BINS), np.zeros(BINS)
    for r in bins:
        good[r.bin], total[r.bin] = r.good, r.n
    rate = isotonic(good, total)
    scored = stats.select("id", "tag", "x", F.lit(2).alias("fold")).mapInArrow(_raw(cross, mean, spread), f"id {dict(stats.dtypes)['id']}, tag long, fold int, bin int")
    return scored.select(F.col("id").alias("doc_id"), "tag", held.alias("held_out"), _ordered(_lookup(rate)).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _ordered(rate):
    """The calibrated rate, with a thousandth of the bin's place so that rows on one step keep the order of their raw scores."""
    return rate * 0.999 + F.col("bin") * (0.001 / (BINS - 1))


def _lookup(rate: np.ndarray):
    """The rate of a bin: one branch for each step of the isotonic curve, found by halving."""
    step = np.flatnonzero(np.concatenate(([True], rate[1:] != rate[:-1])))

    def tree(lo: int, hi: int):
        if hi - lo == 1:
            return F.lit(float(rate[step[lo]]))
        mid = (lo + hi) // 2
        return F.when(F.col("bin") < int(step[mid]), tree(lo, mid)).otherwise(tree(mid, hi))

    return tree(0, len(step))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that are predicted to be bad; rows without an id stay."""
    bad = quality_scores(docs, labels, id_col, text_col).where("predicted = 0 and doc_id is not null").select(F.col("doc_id").alias("bad_id"), F.col("tag").alias("bad_tag")).distinct()
    return docs.join(bad, (docs[id_col] == bad["bad_id"]) & (F.xxhash64(docs[text_col]) == bad["bad_tag"]), "left_anti")
