"""The near-duplicate stage of the pipeline: its candidates, and what it leaves in the shared folder."""

import random
from pathlib import Path

from logloom.llm import shared, shingles, simhash


def _texts(n=40, seed=5):
    r = random.Random(seed)
    base = [" ".join(f"w{r.randrange(3000)}" for _ in range(150)) for _ in range(n)]
    return base + [t.replace(t.split(" ")[75], "other", 1) for t in base] + [None, ""]


def test_similar_texts_meet_by_simhash(spark):
    """fingerprints within three bits are a source of candidates, all of them."""
    df = spark.createDataFrame(list(enumerate(_texts())), "id bigint, body string").selectExpr("id", "body", "xxhash64(body) AS tag")
    marked = df.mapInArrow(shingles._mark, "id bigint, tag long, node long, n long, fp long, bands array<long>").cache()
    fps = {(r.node, r.fp & (1 << 64) - 1) for r in marked.collect()}
    assert {f for _, f in fps} == {simhash.fingerprint(t) for t in _texts()}
    pairs = [(r.a, r.b) for r in shingles._by_fingerprint(shared.Scratch(spark, "test"), marked).collect()]

    def classes(nodes, links):
        up = {x: x for x in nodes}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in links:
            up[root(a)] = root(b)
        return {frozenset(y for y in nodes if root(y) == root(x)) for x in nodes}

    nodes = sorted({x for x, _ in fps})
    want = classes(nodes, [(x, y) for x, f in fps for y, g in fps if (f ^ g).bit_count() <= 3])
    assert classes(nodes, pairs) == want and len(want) < len(nodes) - 10


def test_similar_texts_leave_no_tables(spark):
    """Pipeline on check_h: what a round has read goes; only the two tables that the result reads stay in the shared folder."""
    folder = Path(shared.shared_dir(spark).removeprefix("file://"))
    before = set(folder.glob("near-*"))
    out = shingles.near_texts(spark.createDataFrame(list(enumerate(_texts())), "doc_id bigint, text string"))
    assert out.count() == 82 and out.select("component_id").distinct().count() == 41
    assert len(set(folder.glob("near-*")) - before) == 2
