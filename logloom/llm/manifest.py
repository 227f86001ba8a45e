r"""Merkle manifest of a dataset: a tree of digests for each source, one over the sources, and a proof of each row.

H is the lowercase hex sha256 of its inputs, one after the other; digests go in as hex text. A leaf is H of a row's fields, each ``-``
if null, else its UTF-8 length, ``:`` and its value. A source's leaves ascend by doc_id (nulls first; equal ones by leaf); while a
tree has more than one node, every ``FAN`` consecutive ones, the last run with what is left, become their H. What remains is the
source's subroot; subroots in order of source (null first, UTF-8 bytewise) make the root in the same way.

Bottom-up build: leaves get their place by a range partitioning of (source, doc_id, leaf) and per-partition counts, so no source is one
task's work. Each level is a table in the shared folder: a row is a node with the digests of its run below, grouped by
(tree, place div FAN), groups of at most FAN rows. Top-down push: levels join their parents by (tree, place div FAN); a child takes its
parent's proof and puts its own siblings, which the parent's row lists, before it. Leaves join last, so that only a third as many
proofs as there are leaves are shuffled. The number of levels is the logarithm of the largest source.

Only one digest, the root, and the size of the largest tree come to the driver.

Edge cases: null, empty and very long texts are fields like any other; repeated rows are leaves of their own (their order doesn't
matter, as they are equal); a null source is a source; a null doc_id isn't tampered with; a lone leaf is its subroot and a lone subroot the
root, with an empty proof; an empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

FAN, DIGEST = 3, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(columns: Sequence[Column]) -> Column:
    return digest(*[field(c) for c in columns])


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str, place: str = "pos") -> DataFrame:
    """df, written, with each row's place (from 0) in its group by order, and ``size``, the group's rows.

    Rows are range-partitioned by (group, order): a group may span many partitions. Places are those in the partition plus the counts of
    the partitions before. Rows that are equal in all of these should be told apart by one more column of order.
    """
    by = [*group, *order]
    rows = written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_m", F.monotonically_increasing_id()), name)
    rows = rows.withColumn("_part", F.shiftright("_m", 33))
    runs = rows.groupBy(*group, "_part").agg(F.min("_m").alias("_lo"), F.count("*").alias("_n"))
    whole = Window.partitionBy(*group)
    ahead = F.sum("_n").over(whole.orderBy("_part")) - F.col("_n")
    runs = runs.select(*[F.col(c).alias(f"_{c}") for c in group], F.col("_part").alias("_p"), (ahead - F.col("_lo")).alias("_shift"), F.sum("_n").over(whole).alias("size"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group], F.col("_part") == F.col("_p"))
    return rows.join(runs, same).withColumn(place, F.col("_m") + F.col("_shift")).drop("_m", "_part", "_p", "_shift", *[f"_{c}" for c in group])


def grow(nodes: DataFrame, largest: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """(levels above the nodes, tops). Nodes: tree, pos, m (the tree's nodes on this level), h; a level has also ``kids``, its runs' digests.

    A tree ends on the level where it has one node; tops are these nodes: tree and h.
    """
    levels, tops, below = [], [nodes.where("m = 1").select("tree", "h")], nodes
    while largest > 1:
        runs = below.where("m > 1").groupBy("tree", F.floor(F.col("pos") / FAN).alias("pos")).agg(F.ceil(F.max("m") / FAN).alias("m"), F.sort_array(F.collect_list(F.struct(F.col("pos").alias("at"), "h"))).alias("run"))
        kids = F.transform("run", lambda x: x["h"])
        below = written(runs.select("tree", "pos", "m", kids.alias("kids"), digest(F.array_join(kids, "")).alias("h")), f"{name}-{len(levels) + 1}")
        levels.append(below)
        tops.append(below.where("m = 1").select("tree", "h"))
        largest = -(-largest // FAN)
    return levels, reduce(DataFrame.unionByName, tops)


#: A step of a proof: the node's place in its run, and the others of the run.
STEP = "array<struct<i: int, others: string>>"


def _under(children: DataFrame, parents: DataFrame) -> DataFrame:
    """children (tree, pos, ...) with the proof that begins with their siblings, and what else their parents inherit."""
    up = parents.select("tree", F.col("pos").alias("_at"), F.col("kids").alias("_kids"), F.col("proof").alias("_above"), "subroot")
    met = children.withColumn("_at", F.floor(F.col("pos") / FAN)).join(up, ["tree", "_at"])
    i = (F.col("pos") % FAN).cast("int")
    others = F.array_join(F.filter("_kids", lambda x, k: k != i), "")
    return met.withColumn("proof", F.concat(F.array(F.struct(i.alias("i"), others.alias("others"))), F.col("_above"))).drop("_at", "_above", "_kids")


def push(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """leaves with ``proof`` up to the root and ``subroot``; tops: tree, subroot and the proof that begins there."""
    down = None
    for k in range(len(levels) - 1, -1, -1):
        own = levels[k].where("m = 1").join(tops, "tree")
        down = own if down is None else own.unionByName(_under(levels[k].where("m > 1"), down))
    alone = leaves.where("m = 1").join(tops, "tree")
    return alone if down is None else alone.unionByName(_under(leaves.where("m > 1"), down), allowMissingColumns=True)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf gives with a proof."""
    cut = lambda p: (F.substring(p["others"], F.lit(1), p["i"] * DIGEST), F.substring(p["others"], p["i"] * DIGEST + 1, F.lit(DIGEST * FAN)))
    return F.aggregate(proof, leaf, lambda acc, p: digest(cut(p)[0], acc, cut(p)[1]))


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "source", also: dict[str, Column] | None = None) -> DataFrame:
    """Of each row: id_col, ``leaf``, ``subroot``, ``root`` and ``proof`` (see STEP), and the columns that ``also`` computes from the row."""
    also = also or {}
    hashed = docs.select(docs[id_col].alias("id"), docs[group_col].alias("of"), leaf_of([docs[c] for c in fields]).alias("h"), *[c.alias(n) for n, c in also.items()])
    hashed = written(hashed.withColumn("_row", F.monotonically_increasing_id()), "merkle-leaves")
    placed = ranked(hashed, ["of"], ["id", "h", "_row"], "merkle-places")
    sources = ranked(placed.groupBy("of").agg(F.count("*").alias("n")), [], ["of"], "merkle-sources", "tree")
    sources = sources.select(F.col("of").alias("_of"), "tree", F.col("size").alias("trees"))
    largest, trees = placed.agg(F.max("size")).first()[0] or 0, sources.count()
    leaves = placed.join(sources, F.col("of").eqNullSafe(F.col("_of"))).withColumn("m", F.col("size")).select("tree", "pos", "m", "h", "id", *also)
    leaves = written(leaves, "merkle-level-0")
    levels, tops = grow(leaves, largest, "merkle-level")
    heads = written(tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(trees).cast("long").alias("m"), "h"), "merkle-subroots")
    over, top = grow(heads, trees, "merkle-top")
    root = top.first()
    root = root["h"] if root else None
    end = top.select("tree", F.array().cast(STEP).alias("proof"), F.col("h").alias("subroot"))
    subroots = push(heads, over, end).select(F.col("pos").alias("tree"), "proof", F.col("h").alias("subroot"))
    out = push(leaves, levels, written(subroots, "merkle-subroot-proofs"))
    return out.select(F.col("id").alias(id_col), F.col("h").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"), "proof", *also)


def verify(rows: DataFrame, leaf: Column, id_col: str = "doc_id") -> DataFrame:
    """Rows of a manifest against other leaves: folded_root and verified, with a digest of each proof."""
    out = rows.withColumn("folded_root", folded(leaf, F.col("proof")))
    proof = digest(F.array_join(F.transform("proof", lambda p: p["others"]), ""))
    return out.select(id_col, "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def tampered(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", text_col: str = "text") -> Column:
    r"""The leaf of a row whose text has lost its \n, for rows of which the CRC-32 of the decimal id is even."""
    even = F.crc32(docs[id_col].cast("string").cast("binary")) % 2 == 0
    text = F.when(F.coalesce(even, F.lit(False)), F.replace(docs[text_col], F.lit("\n"), F.lit(""))).otherwise(docs[text_col])
    return leaf_of([text if c == text_col else docs[c] for c in fields])
