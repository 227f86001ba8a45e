"""Manifest, decontamination and divergence against plain code, and their SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logloom.llm import decontaminate, divergence, manifest, oracles
from logloom.llm import queries as registered

NAMES = ("id", "h", "tree", "pos", "m", "body", "item", "words", "row", "shard", "block", "term", "n", "_row", "size", "proof", "kids")
KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def lower(t):
    return re.sub("[A-Z]+", lambda x: x.group().lower(), t)


@pytest.fixture(scope="module")
def rows(tiny):
    import pyarrow.parquet as pq

    out = [(x["doc_id"], x["text"], x["lang"], x["source"], x["n_chars"]) for x in pq.read_table(f"{tiny}/documents.parquet").to_pylist()[:60]]
    r = random.Random(5)
    long = " ".join(r.choice([f"Wört{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]) for _ in range(120_000))
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    out += [(1000, "", "en", None, None), (1001, None, None, None, None), (1002, " \n\t", "", "", 0), (1003, long, "de", "big", 7), (1004, "one", "xx", "lone", 3), (None, "no\nid", "en", "src0", 5), (None, None, "en", "src0", 0)]
    out += [(1005, f"x {item}\n{item.upper()}, y", "en", "src0", 1), (1005, f"x {item}\n{item.upper()}, y", "en", "src0", 1), (1006, "Alpha beta gamma delta extra epsilon zeta eta theta iota kappa", "en", "src1", 2), (1007, "Été 3x", "en", "Ünï", 2), (1008, "only\nnewlines\n", "en", "é", 9)]
    out += [(2000 + i, f"common word{chr(97 + i % 7)} shared common", "yy", f"s{i % 3}", 4) for i in range(40)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("audit") / "documents.parquet")
    spark.createDataFrame(rows, KIND).withColumns({c: F.lit(f"extra {c}") for c in NAMES}).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def items(spark, tiny, rows):
    import pyarrow.parquet as pq

    real = [(str(x["item_id"]), x["text"]) for x in pq.read_table(f"{tiny}/benchmark.parquet").to_pylist()]
    inside = rows[0][1].split()[3:30]
    return real + [("a", "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), ("b", "alpha BETA gamma delta epsilon zeta eta theta iota kappa"), ("c", "3X!"), ("d", ""), ("e", None), ("f", " .. "), (None, "shared common"), ("g", " ".join(inside)), ("g", "newlines")]


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# Manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    doc_id, _, lang, source, n = row
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def manifest_twin(rows):
    of = defaultdict(list)
    for r in rows:
        of[r[3]].append(r)
    sources = sorted(of, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        of[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    trees = {s: tree([leaf(r, r[1]) for r in of[s]]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(of[s]):
            text = r[1].replace("\n", "") if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[1]
            got, proof = leaf(r, text), []
            for levels, at in ((trees[s], i), (top, k)):
                for nodes in levels[:-1]:
                    run, j = nodes[at // 3 * 3 : at // 3 * 3 + 3], at % 3
                    proof += run[:j] + run[j + 1 :]
                    got = H(*run[:j], got, *run[j + 1 :])
                    at //= 3
            out.append((r[0], leaf(r, r[1]), trees[s][-1][0], top[-1][0], H(*proof), got, got == top[-1][0]))
    return sorted(out, key=repr)


def checked(docs):
    return manifest.verify(manifest.manifest(docs, also={"given": manifest.tampered(docs)}), F.col("given"))


def test_manifest(docs, rows):
    got = sorted_rows(checked(docs))
    assert got == manifest_twin(rows)
    assert {r[-1] for r in got} == {True, False}


def test_small_manifests(spark):
    row = lambda i, s="a": (i, f"t{i}\n", "en", s, 1)
    for some in ([row(1)], [row(1), row(2, "b")], [row(i) for i in range(4)], [row(1), row(1), row(None), row(2, None)], [row(i, f"s{i}") for i in range(10)]):
        df = spark.createDataFrame(some, KIND)
        assert sorted_rows(checked(df)) == manifest_twin(some)
    assert checked(spark.createDataFrame([], KIND)).count() == 0


def test_proofs_show_any_change(spark):
    df = spark.createDataFrame([(i, f"t{i}", "en", f"s{i % 3}", 1) for i in range(20)], KIND)
    made = manifest.manifest(df, also={"given": F.when(df.doc_id == 7, manifest.leaf_of([df.doc_id, df.source, df.lang, F.lit(2), df.text])).otherwise(manifest.leaf_of([df[c] for c in manifest.FIELDS]))})
    assert [r.doc_id for r in manifest.verify(made, F.col("given")).where("not verified").collect()] == [7]


# Decontamination


TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def windows(items, width):
    of = defaultdict(set)
    for item, text in items:
        w = TOKEN.findall(lower(text or ""))
        for k in range(max(1, len(w) - width + 1) if w else 0):
            of[tuple(w[k : k + width])].add(item)
    return of


def passages_twin(rows, items, width):
    of = windows(items, width)
    out = []
    for r in rows:
        w, hit, found = TOKEN.findall(lower(r[1] or "")), set(), set()
        for n in {len(x) for x in of}:
            for k in range(len(w) - n + 1):
                if (ids := of.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= ids - {None}
        out.append((r[0], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def near_twin(text, of, slack):
    w, found = TOKEN.findall(lower(text or "")), set()
    at = defaultdict(list)
    for i, x in enumerate(w):
        at[x].append(i)
    for x, ids in of.items():
        if all(t in at for t in x) and any(all(any(abs(i - p - j) <= slack for i in at[t]) for j, t in enumerate(x)) for p in range(-slack, len(w) + slack)):
            found |= ids - {None}
    return len(found)


@pytest.fixture(scope="module")
def index(docs):
    return decontaminate.build_index(docs)


@pytest.mark.parametrize(("width", "block"), [(10, decontaminate.BLOCK), (10, 200), (2, 100)])
def test_passages(spark, rows, index, items, width, block):
    """In one block of items and in several."""
    bench = spark.createDataFrame(items, "item_id string, text string").withColumn("item", F.lit("extra"))
    got = decontaminate.find(index, bench, width=width, block=block)
    assert sorted_rows(got) == passages_twin(rows, items, width)


def test_passages_in_many_steps(monkeypatch, rows, items):
    """Candidates are taken in pieces, and frequent terms have long lists."""
    monkeypatch.setattr(decontaminate, "STEP", 50)
    texts = pa.array([r[1] for r in rows if (r[1] or "").count(" ") < 10_000] + ["a b a b a b a a b"], pa.string())
    row = next(decontaminate._index(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), texts], ["id", "body"])]))).to_pylist()[0]
    p = decontaminate.Postings(row)
    words = lambda t: decontaminate.hashed_words(*decontaminate.K.utf8(pa.array([t])))[0].tobytes()
    w = decontaminate.Windows([("x", words("a b a")), ("y", words("b a a b"))], 10)
    window, place = decontaminate.occurrences(p, w)
    assert sorted(zip(window.tolist(), (place - p.begin[-1]).tolist(), strict=True)) == [(0, 0), (0, 2), (0, 4), (1, 5)]


@pytest.mark.parametrize("slack", [1, 3])
def test_proximity(spark, rows, items, slack):
    some = [r for r in rows if (r[1] or "").count(" ") < 1000]
    few = [*items[-9:], ("h", "beta alpha gamma"), ("i", "kappa epsilon"), ("j", "common shared")]
    got = decontaminate.find(decontaminate.build_index(spark.createDataFrame(some, KIND)), spark.createDataFrame(few, "item_id string, text string"), slack=slack, width=6)
    of = windows(few, 6)
    assert sorted(((r.doc_id, r.n_near_items) for r in got.collect()), key=repr) == sorted(((r[0], near_twin(r[1], of, slack)) for r in some), key=repr)
    with pytest.raises(ValueError):
        decontaminate.spans(got, got, width=40)


def test_spans_and_clean(spark, docs, index, items):
    bench = spark.createDataFrame([x for x in items if x[0] in ("a", "b")], "item_id string, text string")
    got = {r.id: (list(zip(r.begin, r.end, strict=True)), r["items"]) for r in decontaminate.spans(index, bench).where("contaminated").collect()}
    assert got == {1005: ([(1, 25)], ["a", "b"])}  # two occurrences, one after the other
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns and left.count() == docs.count() - 2 and left.where("doc_id = 1005").isEmpty()


def test_empty_sides(spark, docs, index, items):
    none = spark.createDataFrame([], "item_id string, text string")
    got = decontaminate.find(index, none)
    assert got.where("contaminated or n_items > 0").isEmpty() and got.count() == docs.count()
    assert decontaminate.find(decontaminate.build_index(docs.limit(0)), spark.createDataFrame(items, "item_id string, text string")).count() == 0


# Divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def divergence_twin(rows, min_docs):
    count, seen = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        c = Counter(TERM.findall(lower(text or "")))
        count[lang, source] += c
        seen[lang].update(c.keys())
    out = []
    for lang in {k[0] for k in count}:
        kept = [t for t, n in seen[lang].items() if n >= min_docs]

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        sources = [s for a, s in count if a == lang]
        q, p = shares(sum((count[lang, s] for s in sources), Counter())), {s: shares(count[lang, s]) for s in sources}
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t])[:50]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, x.decode(), -v, k + 1) for k, (v, x) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("min_docs", "block"), [(30, divergence.BLOCK), (2, 300), (1, 40), (10**6, 10)])
def test_divergence(docs, rows, min_docs, block):
    """In one block of terms and in several; without any kept term."""
    got = divergence.audit(docs, min_docs=min_docs, block=block)
    assert sorted_rows(got) == divergence_twin(rows, min_docs)


def test_divergence_of_nothing(docs):
    assert divergence.audit(docs.limit(0)).count() == 0


def test_slices_with_one_hash(monkeypatch):
    """Where hashes collide bytes decide, within a batch and between batches."""
    monkeypatch.setattr(divergence.K, "span_hash", lambda data, a, b: np.zeros(len(a), np.uint64))
    monkeypatch.setattr(divergence.xxhash, "xxh3_64_intdigest", lambda raw: len(raw))
    counts = divergence.Counts()
    for t in ("ab cd ab", "cd ef ab cd"):
        counts.add(["en"], ["s"], *divergence.K.utf8(pa.array([t])))
    got = {r["term"]: (r["n"], r["docs"]) for b in counts.rows() for r in b.to_pylist()}
    assert got == {"ab": (3, 2), "cd": (3, 2), "ef": (1, 1)}


def test_counts_are_sent_in_pieces(monkeypatch, docs, rows):
    monkeypatch.setattr(divergence, "VOCABULARY", 20)
    monkeypatch.setattr(divergence, "ROWS", 7)
    batches = pa.table({"lang": [r[2] or "" for r in rows], "source": [r[3] or "" for r in rows], "body": [r[1] for r in rows]}).to_batches(max_chunksize=9)
    got = Counter()
    for b in divergence._count(iter(batches)):
        for r in b.to_pylist():
            got[r["lang"], r["source"], r["term"]] += r["n"]
    want = Counter()
    for _, text, lang, source, _ in rows:
        want.update((lang or "", source or "", t) for t in TERM.findall(lower(text or "")))
    assert got == want


def test_large_counts_are_exact(spark):
    n, total, terms = 750_000_000_001, 15_000_000_000_007, 123_456
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(terms).cast("long")).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * terms)


# SQL


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_benchmark_decontamination", "op13_source_divergence"])
def test_same_as_sql(spark, tiny, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    got = registered.queries()[name](spark, tiny)
    columns = sorted(got.columns)
    want = con.execute(oracles.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    assert sorted_rows(got.select(*columns)) == sorted(((tuple(r[names.index(c)] for c in columns)) for r in want.fetchall()), key=repr)
