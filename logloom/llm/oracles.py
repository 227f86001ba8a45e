"""DuckDB SQL with the same result as a query, where SQL can express it at the size of the whole tables."""

from __future__ import annotations

from .decontaminate import WIDTH
from .divergence import ADD, MIN_DOCS, SCALE, TOP
from .manifest import FIELDS
from .rules import MAX_DOCS, MAX_SHARE, MIN_LEFT, MIN_WORDS, REPEAT_SHARE

SPACES = r"'[\x20\x09-\x0D]+'"
WORDS = f"list_filter(string_split_regex(COALESCE(text, ''), {SPACES}), lambda x: x <> '')"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SUBSTRING = f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
  e AS (SELECT doc_id, list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(list_slice(w, i, i + 49), ' '))) AS hs FROM d WHERE len(w) >= 50),
  k AS (SELECT doc_id, unnest(hs) AS h, unnest(range(1, len(hs) + 1)) AS i FROM e),
  m AS (SELECT h, min(doc_id) AS least FROM k GROUP BY h),
  c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM k JOIN m USING (h) WHERE least < doc_id),
  x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
  s AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM x ANTI JOIN c USING (doc_id, p) GROUP BY doc_id),
  n AS (SELECT doc_id, count(*) AS gone FROM c GROUP BY doc_id)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(gone, 0) AS n_removed, sha256(COALESCE(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id) LEFT JOIN n USING (doc_id)"""

LINE = f"array_to_string(list_filter(string_split_regex({LOWER.format('line')}, {SPACES}), lambda x: x <> ''), ' ')"

LINES = f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS p FROM documents WHERE text IS NOT NULL),
  f AS (SELECT doc_id, p, {LINE} AS norm FROM l WHERE {LINE} <> ''),
  o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i FROM f),
  k AS (SELECT a.doc_id, a.i, a.norm || chr(10) || b.norm || chr(10) || c.norm AS h FROM o a JOIN o b ON b.doc_id = a.doc_id AND b.i = a.i + 1 JOIN o c ON c.doc_id = a.doc_id AND c.i = a.i + 2),
  m AS (SELECT h, min(doc_id * 10000000 + i) AS least FROM k GROUP BY h),
  g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS i FROM k JOIN m USING (h) WHERE least < doc_id * 10000000 + i),
  gone AS (SELECT doc_id, p FROM o JOIN g USING (doc_id, i)),
  s AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS kept FROM l ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
  n AS (SELECT doc_id, count(*) AS n_lines FROM o GROUP BY doc_id), q AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
  SELECT d.doc_id, COALESCE(n_lines, 0) AS n_lines, COALESCE(n_removed, 0) AS n_removed, CASE WHEN text IS NOT NULL THEN sha256(COALESCE(kept, '')) END AS kept_sha256
  FROM documents d LEFT JOIN s USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN q USING (doc_id)"""

RULES = f"""WITH d AS (SELECT doc_id, COALESCE(text, '') AS text, COALESCE(source, chr(0)) AS host, {WORDS} AS w FROM documents),
  x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
  t AS (SELECT a.doc_id, a.p, a.word || ' ' || b.word || ' ' || c.word AS h FROM x a JOIN x b ON b.doc_id = a.doc_id AND b.p = a.p + 1 JOIN x c ON c.doc_id = a.doc_id AND c.p = a.p + 2),
  u AS (SELECT *, count(*) OVER (PARTITION BY doc_id, h) AS k FROM t),
  v AS (SELECT DISTINCT doc_id, unnest(range(p, p + 3)) AS p FROM u WHERE k > 1), rw AS (SELECT doc_id, count(*) AS n_repeat_words FROM v GROUP BY doc_id),
  l AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d),
  f AS (SELECT doc_id, host, line, {LINE} AS norm FROM l WHERE {LINE} <> ''),
  dl AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM f GROUP BY doc_id),
  hd AS (SELECT host, count(DISTINCT doc_id) AS docs FROM d GROUP BY host),
  fr AS (SELECT host, norm FROM (SELECT host, norm, count(DISTINCT doc_id) AS n FROM f GROUP BY host, norm) JOIN hd USING (host) WHERE n > {MAX_DOCS} AND n > docs * {MAX_SHARE}),
  rm AS (SELECT doc_id, sum(len(string_split(norm, ' '))) AS removed FROM f JOIN fr USING (host, norm) GROUP BY doc_id),
  b AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(CAST(list_sum(list_transform(w, lambda y: length(y))) AS BIGINT), 0) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    COALESCE(n_dup_lines, 0) AS n_dup_lines, COALESCE(n_repeat_words, 0) AS n_repeat_words, COALESCE(CAST(removed AS BIGINT), 0) AS n_removed_words FROM d LEFT JOIN rw USING (doc_id) LEFT JOIN dl USING (doc_id) LEFT JOIN rm USING (doc_id)),
  z AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_SHARE} * n_words AS base_failed FROM b)
  SELECT *, NOT base_failed AND NOT n_words - n_removed_words < n_words * {MIN_LEFT} AS kept FROM z"""

DIVERGENCE = f"""WITH d AS (SELECT row_number() OVER () AS r, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source, {LOWER.format("COALESCE(text, '')")} AS t FROM documents),
  x AS (SELECT lang, source, r, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
  k AS (SELECT lang, term FROM x GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}), c AS (SELECT lang, source, term, count(*) AS n FROM x JOIN k USING (lang, term) GROUP BY ALL),
  g AS (SELECT DISTINCT lang, source FROM d), v AS (SELECT lang, count(*) AS terms FROM k GROUP BY lang),
  f AS (SELECT g.lang, g.source, k.term, COALESCE(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
  s AS (SELECT lang, source, sum(n) AS total FROM f GROUP BY ALL), a AS (SELECT lang, term, sum(n) AS n FROM f GROUP BY ALL), b AS (SELECT lang, sum(n) AS total FROM a GROUP BY ALL),
  p AS (SELECT lang, source, term, n, 1 + CAST({SCALE} AS HUGEINT) * (n + {ADD}) // (total + {ADD} * terms) AS p FROM f JOIN s USING (lang, source) JOIN v USING (lang)),
  q AS (SELECT lang, term, 1 + CAST({SCALE} AS HUGEINT) * (n + {ADD}) // (total + {ADD} * terms) AS q FROM a JOIN b USING (lang) JOIN v USING (lang)),
  m AS (SELECT p.lang, p.source, o.source AS item, sum(abs(p.p - o.p)) AS value FROM p JOIN p o ON o.lang = p.lang AND o.term = p.term AND o.source <> p.source GROUP BY ALL),
  u AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, COALESCE(value, 0) AS value FROM g JOIN g h ON h.lang = g.lang AND h.source <> g.source LEFT JOIN m ON m.lang = g.lang AND m.source = g.source AND m.item = h.source
    UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
  z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM u)
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM z WHERE part = 'pair' OR rank <= {TOP}"""

BENCHMARK_WORDS = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
PASSAGES = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {BENCHMARK_WORDS.format(LOWER.format("COALESCE(text, '')"))} AS w FROM documents),
  i AS (SELECT CAST(item_id AS VARCHAR) AS item, {BENCHMARK_WORDS.format(LOWER.format("COALESCE(text, '')"))} AS w FROM benchmark),
  v AS (SELECT item, unnest(list_transform(range(1, greatest(2, len(w) - {WIDTH - 2})), lambda k: list_slice(w, k, k + {WIDTH - 1}))) AS x FROM i WHERE len(w) > 0),
  g AS (SELECT DISTINCT item, len(x) AS n, array_to_string(x, ' ') AS h FROM v), lens AS (SELECT DISTINCT n FROM g),
  q AS (SELECT r, n, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(list_slice(w, k, k + n - 1), ' '))) AS h, unnest(range(1, len(w) - n + 2)) AS k FROM d JOIN lens ON len(w) >= n),
  m AS (SELECT r, k, n, item FROM q JOIN g USING (n, h)), e AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(k, k + n)) AS p FROM m) GROUP BY r),
  t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM m WHERE item IS NOT NULL) GROUP BY r)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items, sha256(COALESCE(s, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
  FROM d LEFT JOIN e USING (r) LEFT JOIN t USING (r)"""


def _merkle(levels: int = 14, over: int = 9) -> str:
    """Trees of up to FAN ** levels leaves, and as many as FAN ** over of them."""
    show = lambda c: f"COALESCE(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(show(text if c == "text" else c) for c in FIELDS) + ")"
    crc = "xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: xor(x >> 1, 3988292384 * (x & 1))), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"
    ctes = [
        f"l AS (SELECT row_number() OVER () AS r, doc_id, source, {leaf('text')} AS h, CASE WHEN {crc} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS t FROM documents)",
        "sid AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM documents))",
        "o AS (SELECT r, doc_id, h, t, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h, r) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS m FROM l JOIN sid ON sid.source IS NOT DISTINCT FROM l.source)",
        "n0 AS (SELECT tree, pos, m, h FROM o)", "f0 AS (SELECT r, doc_id, tree, pos, h AS leaf, t AS f, '' AS proof FROM o)",
    ]

    def level(k: int) -> None:
        run = "PARTITION BY tree, pos // 3 ORDER BY pos"
        lag = lambda f: f"COALESCE({f}(h, 2) OVER ({run}), '') || COALESCE({f}(h, 1) OVER ({run}), '')" if f == "lag" else f"COALESCE({f}(h, 1) OVER ({run}), '') || COALESCE({f}(h, 2) OVER ({run}), '')"
        ctes.append(f"s{k} AS (SELECT tree, pos, m, {lag('lag')} AS a, {lag('lead')} AS b FROM n{k})")
        ctes.append(f"f{k + 1} AS (SELECT r, doc_id, tree, CASE WHEN m > 1 THEN pos // 3 ELSE pos END AS pos, leaf, CASE WHEN m > 1 THEN sha256(a || f || b) ELSE f END AS f, CASE WHEN m > 1 THEN proof || a || b ELSE proof END AS proof{', subroot' if k > levels else ''} FROM f{k} JOIN s{k} USING (tree, pos))")
        ctes.append(f"n{k + 1} AS (SELECT tree, pos // 3 AS pos, (m + 2) // 3 AS m, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM n{k} WHERE m > 1 GROUP BY tree, pos // 3, m UNION ALL SELECT tree, pos, m, h FROM n{k} WHERE m = 1)")

    for k in range(levels):
        level(k)
    # The subroots are the nodes of one more tree.
    ctes.append(f"n{levels + 1} AS (SELECT 0 AS tree, tree AS pos, count(*) OVER () AS m, h FROM n{levels})")
    ctes.append(f"f{levels + 1} AS (SELECT r, doc_id, 0 AS tree, f.tree AS pos, leaf, f, proof, n.h AS subroot FROM f{levels} f JOIN n{levels} n ON n.tree = f.tree)")
    for k in range(levels + 1, levels + 1 + over):
        level(k)
    end = levels + 1 + over
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, n.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = n.h AS verified FROM f{end} f JOIN n{end} n USING (tree, pos)"


SQL: dict[str, str] = {
    "op2_substring_dedup": SUBSTRING, "op5_line_dedup": LINES, "op6_quality_rules": RULES, "op11_merkle_manifest": _merkle(), "op12_benchmark_decontamination": PASSAGES, "op13_source_divergence": DIVERGENCE,
}
