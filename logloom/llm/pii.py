r"""Personal data: base rules, and further spans that boosted trees select among candidates. DataFrame functions only.

Base kinds (email, ip, card, phone) are leftmost non-overlapping matches of fixed patterns; matches that fail their check (parts
over 255, Luhn, number of digits) are dropped without another try. Two rewritings keep the patterns linear on long runs and
don't change what matches: ``(?:\G|(?<![x]))[x]++`` starts once in a run of x (later starts in it would fail in the same way;
``\G`` is the end of the last match), and possessive quantifiers where nothing that follows could match part of the run.

Positions: matches are wrapped in a mark (U+0001; those of the text are first replaced by U+0002), the text is split at marks, and
the code points of the pieces are summed up, in runs of ``RUN`` pieces so that a text with very many matches stays cheap. Overlaps
are found by running maxima over sorted spans, and texts are cut in blocks of ``BLOCK`` code points, so the work for a text
follows its length and its number of spans, not their product.

Candidates come from generators of high recall, whose spans may overlap: ``token`` (a word with a digit, @ or =), ``number``
(digits with separators), ``keyed`` (what follows a word like password and a colon or equals sign). Words and numbers are taken
whole, however long, so that no secret's tail is left. ``grouped`` are account numbers written in groups of four. Each candidate gets format
features and context features (of the code points before it). Gradient boosted trees, fitted on the driver to a labelled sample that
``examples`` makes (at most ``EXAMPLES`` rows, features by the same expressions), become CASE expressions. On a third of the examples
the threshold is calibrated to ``PRECISION``, and to even odds at least. Candidates that overlap a base span are dropped; selected
ones that overlap each other become one span of kind ``other``.

Edge cases: a null text is an empty one: no spans; a null doc_id stays null; repeated rows come out as often as they went in;
``redact`` keeps extra columns, ``find_pii`` ignores them.
"""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARK, RUN, CONTEXT, BLOCK = "\x01", 256, 24, 4096
KINDS = ("email", "ip", "card", "phone")
#: Base patterns, linear forms of the fixed ones.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that a text with a match passes.
HINTS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9]", "phone": "+"}
KEYWORDS = "password|passwd|pwd|passphrase|secret|token|bearer|api[_-]?key|access[_-]?key|credential|ssn|social security|iban|passport|licen[cs]e no|account|acct|dob|born|birth|phone|mobile|tel|fax|call|mail|contact"
#: What may stand between such a word and what it announces.
LINK = "(?:[^A-Za-z0-9]{1,3}(?:no|nr|number|is|was|id))?[^A-Za-z0-9]*"
GENERATORS = {
    "token": r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D0-9@=]*+[0-9@=])[^\x20\x09-\x0D]{6,}+",
    "number": r"(?<![0-9A-Za-z+])[(]?[0-9]++(?![A-Za-z])(?:[().\x20/-]{1,3}+[0-9]++(?![A-Za-z]))*+",
    "keyed": r"(?i)(?<![A-Za-z])(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|credential)s?(?:\x20(?:is|was))?[\x20\x09]{0,2}[:=][\x20\x09]{0,2}[^\x20\x09-\x0D]{4,}+",
    "grouped": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20[A-Z0-9]{4}){3,7}+(?:\x20[A-Z0-9]{1,3}+)?(?![A-Za-z0-9])",
}
#: Code points of a number that make it a candidate.
LEAST_NUMBER = 7
SPAN = "array<struct<s:int,e:int,m:string,c:string>>"
EXAMPLES, PRECISION, SEED = 4500, 0.98, 7
TREES, DEPTH, RATE, LEAF = 40, 3, 0.2, 12


def _pieces(text: Column, pattern: str) -> Column:
    return F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, also where body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _runs(size: Column) -> Column:
    return F.sequence(F.lit(0), F.ceil(size / RUN).cast("int") - 1)


def _spans(pieces: Column) -> Column:
    """The odd pieces with their places and the end of the piece before."""
    part = lambda k: F.slice(pieces, k * RUN + 1, F.lit(RUN))
    sums = F.transform(_runs(F.size(pieces)), lambda k: F.aggregate(part(k), F.lit(0), lambda a, x: a + F.char_length(x)))
    begin = F.aggregate(sums, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    none = F.expr(f"cast(array() as {SPAN})")

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.char_length(x)
        span = F.struct(acc["at"].alias("s"), end.alias("e"), x.alias("m"), F.right(acc["past"], F.lit(CONTEXT)).alias("c"))
        return F.struct(end.alias("at"), (~acc["odd"]).alias("odd"), x.alias("past"), F.when(acc["odd"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def run(begin: Column, k: Column) -> Column:
        zero = F.struct(F.get(begin, k).alias("at"), F.lit(False).alias("odd"), F.lit("").alias("past"), none.alias("out"))
        return F.aggregate(part(k), zero, step, lambda acc: acc["out"])

    return F.when(F.size(pieces) > 1, _let(begin, lambda b: F.flatten(F.transform(_runs(F.size(pieces)), lambda k: run(b, k))))).otherwise(none)


def _running_max(values: Column) -> Column:
    """The largest value so far, for each value of an array that isn't empty."""
    part = lambda v, k: F.slice(v, k * RUN + 1, F.lit(RUN))
    grow = lambda acc, x: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), x)))
    least = F.array(F.lit(-(2**31) + 1))

    def all_runs(v: Column) -> Column:
        before = F.aggregate(F.transform(_runs(F.size(v)), lambda k: F.array_max(part(v, k))), least, grow)
        return _let(before, lambda b: F.flatten(F.transform(_runs(F.size(v)), lambda k: F.aggregate(part(v, k), F.array(F.get(b, k)), grow, lambda acc: F.slice(acc, 2, RUN)))))

    return _let(values, all_runs)


def _clear(candidates: Column, taken: Column) -> Column:
    """The candidates that overlap none of the taken spans."""
    fixed = F.transform(taken, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(-1).alias("k")))

    def of(c: Column) -> Column:
        merged = F.array_sort(F.concat(fixed, F.transform(c, lambda x, i: F.struct(x["s"].alias("s"), x["e"].alias("e"), i.alias("k")))))

        def kept(m: Column) -> Column:
            ends = _running_max(F.transform(m, lambda x: F.when(x["k"] < 0, x["e"]).otherwise(0)))
            starts = F.reverse(_running_max(F.reverse(F.transform(m, lambda x: F.when(x["k"] < 0, -x["s"]).otherwise(-(2**31) + 1)))))
            ok = lambda e, s: F.filter(m, lambda x, i: (x["k"] >= 0) & (F.get(e, i) <= x["s"]) & (-F.get(s, i) >= x["e"]))
            return _let(ends, lambda e: _let(starts, lambda s: ok(e, s)))

        return F.transform(_let(merged, kept), lambda x: F.get(c, x["k"]))

    return F.when((F.size(candidates) > 0) & (F.size(taken) > 0), _let(candidates, of)).otherwise(candidates)


def _islands(spans: Column) -> Column:
    """Overlapping spans (structs that begin with s and e) as one: the first one of each island, with the largest end."""

    def of(x: Column) -> Column:
        def by_ends(e: Column) -> Column:
            first = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | (F.get(x, i)["s"] >= F.get(e, i - 1)))
            last = lambda f, j: F.get(e, F.coalesce(F.get(f, j + 1), F.size(x)) - 1)
            return _let(first, lambda f: F.transform(f, lambda i, j: F.get(x, i).withField("e", last(f, j))))

        return _let(_running_max(F.transform(x, lambda y: y["e"])), by_ends)

    return F.when(F.size(spans) > 1, _let(F.array_sort(spans), of)).otherwise(spans)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = _digits(m)

    def add(a: Column, i: Column) -> Column:
        v = F.substr(d, F.char_length(d) - i, F.lit(1)).cast("int")
        twice = v * 2
        return a + F.when(i % 2 == 0, v).when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.sequence(F.lit(0), F.char_length(d) - 1), F.lit(0), add)
    return F.when(F.char_length(d).between(16, 19), total % 10 == 0).otherwise(False)


CHECKS = {
    "email": None,
    "ip": lambda x: F.forall(F.split(x["m"], "\\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")),
    "card": lambda x: _luhn(x["m"]),
    "phone": lambda x: F.char_length(_digits(x["m"])).between(8, 15),
}

FEATURES = (
    "length", "digits", "letters", "upper", "marks", "digit_share", "turns", "at_sign", "equals", "dots", "dashes", "colons", "slashes", "quotes",
    "keyword", "keyed_inside", "hex_run", "long_run", "groups", "vowel_share", "money_before", "word_before", "percent", "year",
)


def features(x: Column) -> list[Column]:
    """Numbers about one candidate x (m: its text, c: the code points before it)."""
    # Marks that end a sentence or a quotation around the candidate aren't part of its format.
    m, c = F.regexp_replace(x["m"], "[.,;:!?)\\]}\"']+$", ""), x["c"]
    count = lambda p: F.regexp_count(m, F.lit(p)).cast("double")
    size = F.greatest(F.char_length(m), F.lit(1)).cast("double")
    has = lambda col, p: col.rlike(p).cast("double")
    letters = count("[A-Za-z]")
    return [
        size, count("[0-9]"), letters, count("[A-Z]"), count("[^A-Za-z0-9]"), count("[0-9]") / size, count("(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]"), count("@"), count("="),
        count("\\."), count("-"), count(":"), count("/"), count("[\"']"), has(c, f"(?i)({KEYWORDS}){LINK}$"), has(m, f"(?i)({KEYWORDS})[^A-Za-z0-9]"),
        has(m, "[0-9A-Fa-f]{16}"), has(m, "[0-9A-Za-z_]{20}"), count("[0-9]+"), count("[aeiouAEIOU]") / F.greatest(letters, F.lit(1.0)), has(c, "[$€£#]\\s?$"),
        has(c, "[A-Za-z]\\s$"), has(m, "%|[A-Za-z]$"), has(m, "^\\W*(19|20)[0-9]{2}\\W*$"),
    ]


def examples(n: int = EXAMPLES) -> list[tuple[str, int]]:
    """Texts around one candidate between U+0001 marks, and whether it is personal data or a secret; made by rules from a fixed seed."""
    r = random.Random(SEED)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    pick = lambda a, k: "".join(r.choice(a) for _ in range(k))
    word = lambda: "".join(r.choice(("an", "er", "th", "in", "re", "on", "es", "st", "le", "de", "ou", "ti")) for _ in range(r.randint(1, 4)))
    name = lambda: pick("abcdefghijklmnoprstuvwy", r.randint(3, 8))
    lower, alnum, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef"
    mixed, code = alnum + "+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    key = lambda: r.choice(("password", "Password", "PASSWORD", "passwd", "pwd", "passphrase", "token", "secret", "api_key", "api-key", "access_key", "credential"))
    link = lambda: r.choice(("=", ": ", " = ", ":", " is: "))
    strong = lambda: pick(alnum + "!#%&*_-$?", r.randint(6, 20))
    country = lambda: r.choice(("DE", "FR", "GB", "ES", "IT", "NL", "PL", "SE", "CH"))
    good = [
        lambda: (r.choice(("SSN: ", "ssn ", "ssn is ", "social security no ", "")), f"{d(3)}-{d(2)}-{d(4)}"), lambda: (r.choice(("phone: ", "call ", "tel. ", "tel ", "")), f"({d(3)}) {d(3)}-{d(4)}"),
        lambda: (r.choice(("phone ", "mobile ", "fax ", "call ", "")), d(3) + (k := r.choice("-. ")) + d(3) + k + d(4)), lambda: (r.choice(("IBAN ", "iban: ", "account ", "")), f"{country()}{d(r.randint(17, 22))}"),
        lambda: (r.choice(("IBAN ", "account no ", "")), f"{country()}{d(2)} {' '.join(d(4) for _ in range(r.randint(3, 5)))} {d(r.randint(1, 3))}"),
        lambda: (r.choice(("", "at ", "to ")), ":".join(pick(hexa, 4) for _ in range(8))), lambda: (r.choice(("", "on ", "card ")), r.choice(":-").join(pick(hexa, 2) for _ in range(6))), lambda: (r.choice(("", "key ", "id=")), f"{r.choice(('AKIA', 'ASIA'))}{pick(code, 16)}"),
        lambda: (r.choice(("api_key = ", "secret: ", "token ", "key=", "api key: ", "")), pick(hexa, r.choice((32, 36, 40, 64)))), lambda: ("", f'"{pick(hexa, r.choice((32, 40)))}"'), lambda: ("", f"{key()}{link()}{strong()}"), lambda: ("", f"{key()}{link()}{pick(lower, 3)}{d(2)}{pick(lower + '0123456789', r.randint(3, 9))}"),
        lambda: ("", f"{name().upper()}_{r.choice(('KEY', 'TOKEN', 'SECRET', 'ID'))}={pick(mixed, r.randint(20, 44))}"), lambda: (f"{key()}{link()}"[-CONTEXT:], strong()),
        lambda: ("", f"{r.choice(('sk', 'ghp', 'pk', 'xox', 'rk', 'glpat'))}{r.choice('-_')}{pick(alnum + '-_', r.randint(20, 44))}"), lambda: (r.choice(("", "secret ", "key ")), pick(mixed, r.randint(28, 48))), lambda: (r.choice(("bearer ", "token ", "")), ".".join(pick(alnum + "-_", r.randint(18, 60)) for _ in range(3))),
        lambda: (r.choice(("born ", "DOB: ", "birth date ", "date of birth: ", "dob ")), r.choice((f"{d(2)}/{d(2)}/19{d(2)}", f"19{d(2)}-{d(2)}-{d(2)}", f"{d(2)}.{d(2)}.19{d(2)}", f"{d(2)}-{d(2)}-20{d(2)}"))),
        lambda: (r.choice(("mail ", "contact ", "")), f"{name()}{d(2)}@{name()}"), lambda: ("", f"{r.choice(('mysql', 'amqp', 'redis', 'https'))}://{name()}:{strong()}@{name()}.{name()}/{name()}"),
        lambda: (r.choice(("passport ", "passport no ", "passport number ", "passport: ")), f"{pick('ABCDEFGHKLMXYZ', r.randint(1, 2))}{d(r.randint(7, 8))}"), lambda: (r.choice(("account ", "account number ", "acct ", "account no ", "account: ")), d(r.randint(9, 12))),
    ]
    bad = [
        lambda: ("", "".join(x + (d(1) if r.random() < 0.9 else d(2)) for x in r.choice(("CHO", "NaCl", "CHN", "FeO", "HSO")))), lambda: (r.choice(("the ", "type ", "")), f"{pick('ABCDEFGHX', r.randint(1, 2))}{d(3)}-{d(3)}"), lambda: ("", f"{d(4)}x{d(4)}"), lambda: ("lines ", f"{d(4)}-{d(4)}"),
        lambda: ("", f"IMG_20{d(2)}{d(2)}{d(2)}_{d(4)}.jpg"), lambda: ("see ", f"https://{name()}.org/{word()}-{word()}/{word()}{d(4)}/index.html"), lambda: ("", f"{word()}_{word()}_{d(2)}.txt"), lambda: ("won ", f"{d(2)}-{d(2)}"), lambda: (r.choice(("on ", "by ", "")), f"{d(2)}/{d(2)}/20{d(2)}"),
        lambda: ("", f"{d(1)},{d(3)},{d(3)}"), lambda: ("of ", f"{d(3)},{d(3)},{d(3)}"), lambda: ("", f"{word()}{word()}={d(1)}.{d(2)}"), lambda: ("", f"{word()}-{word()}-{word()}-{d(1)}"), lambda: ("rfc ", f"{d(4)}-{d(4)}"), lambda: (r.choice(("token ", "account ", "call ", "key ")), f"{word()}{d(1)}{word()}"),
        lambda: ("in ", f"{r.choice(('19', '20'))}{d(2)}-{r.choice(('19', '20'))}{d(2)}"), lambda: (r.choice(("$", "€", "")), f"{d(1)},{d(3)},{d(3)}.{d(2)}"), lambda: ("version ", f"{d(1)}.{d(1)}.{d(2)}-rc{d(1)}"), lambda: ("at ", f"{d(2)}:{d(2)}:{d(2)}"),
        lambda: ("", f"{word()}{d(1)}{word()}"), lambda: ("", f"{word()}-{d(2)}"), lambda: ("about ", f"{d(2)}.{d(4)}%"), lambda: ("chapter ", f"{d(1)}.{d(1)}.{d(1)}."), lambda: ("", f"{d(4)} {d(4)}"), lambda: ("", f"{d(2)} {d(2)} {d(2)}"),
        lambda: ("x", f"{word()}={word()}"), lambda: ("", f"{word()}={d(2)}"), lambda: ("", f"https://{name()}.example.org/{word()}/{d(4)}"), lambda: ("on ", f"20{d(2)}-{d(2)}-{d(2)}"), lambda: ("fig. ", f"{d(3)}-{d(3)}"), lambda: ("", f"{d(1)}{d(3)}.{d(3)}"),
        lambda: ("ISBN ", f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}"), lambda: ("pages ", f"{d(3)} - {d(3)}"), lambda: ("", f"{word()}{word()}{d(4)}."), lambda: ("", f"({d(3)}){d(3)}"), lambda: ("", f"@{word()}{word()}"), lambda: ("weighs ", f"{d(3)}.{d(2)}kg"), lambda: ("", d(r.randint(13, 19))), lambda: ("", d(16)), lambda: ("", " ".join(d(4) for _ in range(4))), lambda: ("", f"{word()}@@{word()}"),
    ]
    out = []
    for i in range(n):
        label = i % 2
        before, text = r.choice(good if label else bad)()
        lead = " ".join(word() for _ in range(r.randint(0, 4)))
        out.append((f"{lead} {before}"[-CONTEXT:] + MARK + text + r.choice(("", "", "", ",", ".", ";", ")")), label))
    return out


class Boosted:
    """Gradient boosted trees for 0/1 labels: logistic loss, exact splits on up to 32 quantiles of each feature."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        self.trees: list = []
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 32))) for j in range(x.shape[1])]
        below = [x[:, j, None] <= c[None, :] for j, c in enumerate(cuts)]
        score = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(np.arange(len(y)), y - p, p * (1 - p), cuts, below, DEPTH)
            self.trees.append(tree)
            score = score + self._value(tree, x)

    def _grow(self, rows: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list, below: list, depth: int):
        total, weight = g[rows].sum(), h[rows].sum()
        best, found = 1e-6, None
        for j, c in enumerate(cuts) if depth and len(rows) >= 2 * LEAF else ():
            b = below[j][rows]
            n, gl, hl = b.sum(axis=0), g[rows] @ b, h[rows] @ b
            gain = gl**2 / (hl + 1) + (total - gl) ** 2 / (weight - hl + 1) - total**2 / (weight + 1)
            gain[(n < LEAF) | (len(rows) - n < LEAF)] = 0
            k = int(gain.argmax())
            if gain[k] > best:
                best, found = gain[k], (j, k)
        if found is None:
            return float(round(RATE * total / (weight + 1), 6))
        j, k = found
        left = below[j][rows, k]
        return (j, float(cuts[j][k]), self._grow(rows[left], g, h, cuts, below, depth - 1), self._grow(rows[~left], g, h, cuts, below, depth - 1))

    def _value(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        j, cut, low, high = tree
        return np.where(x[:, j] <= cut, self._value(low, x), self._value(high, x))

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum(self._value(t, x) for t in self.trees)

    def column(self, f: Column) -> Column:
        """The score as an expression over an array of features."""

        def of(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(tree)
            j, cut, low, high = tree
            return F.when(F.get(f, F.lit(j)) <= cut, of(low)).otherwise(of(high))

        out = F.lit(self.base)
        for t in self.trees:
            out = out + of(t)
        return out


_models: dict[int, tuple[Boosted, float]] = {}


def fit(spark: SparkSession) -> tuple[Boosted, float]:
    """The trees, and the least score at which calibration examples reach PRECISION."""
    if SEED not in _models:
        made = examples()
        rows = ", ".join("('" + t.replace("\\", "\\\\").replace("'", "\\'").replace(MARK, "\\u0001") + f"', {y})" for t, y in made)
        table = spark.sql(f"SELECT t, y FROM VALUES {rows} AS v(t, y)")
        x = F.struct(F.element_at(F.split("t", MARK), 2).alias("m"), F.element_at(F.split("t", MARK), 1).alias("c"))
        got = table.select(x.alias("x"), "y").select(F.array(*features(F.col("x"))).alias("f"), "y").collect()
        f, y = np.array([r.f for r in got]), np.array([r.y for r in got], float)
        held = np.arange(len(y)) % 6 < 2  # pairs of a good and a bad one
        model = Boosted(f[~held], y[~held])
        score, label = model.score(f[held]), y[held]
        order = np.argsort(-score, kind="stable")
        precision = np.cumsum(label[order]) / np.arange(1, len(order) + 1)
        ok = np.flatnonzero(precision >= PRECISION)
        _models[SEED] = (model, max(0.0, float(score[order][ok[-1]])) if len(ok) else float("inf"))
    return _models[SEED]


def _joined(spans: Column, kind: str | None = None) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))


def _with_spans(docs: DataFrame, text: Column) -> DataFrame:
    """docs with a column for the spans of each base kind and ``other``; the text's own column isn't changed."""
    spark = docs.sparkSession
    model, least = fit(spark)
    df = docs.withColumn("_t", F.translate(F.coalesce(text, F.lit("")), MARK, "\x02"))
    tests = {k: F.col("_t").rlike(h) if "[" in h else F.contains("_t", F.lit(h)) for k, h in HINTS.items()}
    none = F.expr("cast(null as array<string>)")
    df = df.withColumns({f"_p_{k}": F.when(tests[k], _pieces(F.col("_t"), p)).otherwise(none) for k, p in PATTERNS.items()})
    maybe = F.col("_t").rlike("(?i)[0-9@=]|pass|pwd|secret|token|key|credential")  # every generator's match passes it
    df = df.withColumns({f"_g_{k}": F.when(maybe, _pieces(F.col("_t"), p)).otherwise(none) for k, p in GENERATORS.items()})
    empty = F.expr(f"cast(array() as {SPAN})")
    base = {}
    for k, check in CHECKS.items():
        spans = F.coalesce(_spans(F.col(f"_p_{k}")), empty)
        base[f"_{k}"] = F.filter(spans, check) if check else spans
    df = df.withColumns(base)
    taken = F.concat(*[F.col(f"_{k}") for k in KINDS])
    found = {k: F.coalesce(_spans(F.col(f"_g_{k}")), empty) for k in GENERATORS}
    found["number"] = F.filter(found["number"], lambda x: F.char_length(x["m"]) >= LEAST_NUMBER)
    df = df.withColumns({"_taken": taken, "_found": F.concat(*found.values())})
    df = df.withColumn("_candidates", _clear(F.col("_found"), F.col("_taken")))
    scored = F.transform("_candidates", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.array(*features(x)).alias("f")))
    df = df.withColumn("_scored", F.when(F.size("_candidates") > 0, scored))
    chosen = F.filter(F.transform("_scored", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), model.column(x["f"]).alias("p"))), lambda x: x["p"] >= least)
    df = df.withColumn("_chosen", F.transform(chosen, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))
    return df.withColumn("_other", F.coalesce(_islands(F.col("_chosen")), F.expr("cast(array() as array<struct<s:int,e:int>>)")))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans (all of them) and n_other of each row."""
    df = _with_spans(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("_body")), F.col("_body"))
    listed = F.concat(*[_joined(F.col(f"_{k}"), k) for k in KINDS])
    df = df.withColumn("_listed", listed)
    return df.select(
        "doc_id", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(F.array_join("_listed", ","), 256).alias("base_sha256"),
        F.array_join(F.concat("_listed", _joined(F.col("_other"), "other")), ",").alias("spans"), F.size("_other").cast("long").alias("n_other"),
    )


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every found span replaced by its kind in angle brackets; overlapping spans become one."""
    names = [c for c in docs.columns]
    src = docs.select(F.struct(*[docs[c] for c in names]).alias("_row"))
    df = _with_spans(src, F.col("_row")[text_col])
    named = lambda k: F.transform(F.col(f"_{k}"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(k).alias("k")))
    df = df.withColumn("_spans", _islands(F.concat(*[named(k) for k in (*KINDS, "other")])))
    body, spans = F.col("_row")[text_col], F.col("_spans")
    blocks = F.when(F.char_length(body) <= BLOCK, F.array(body)).otherwise(F.regexp_extract_all(body, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))

    def cut(blocks: Column, a: Column, b: Column) -> Column:
        block = lambda x: F.floor(x / BLOCK).cast("int")
        low = lambda k: F.greatest(a - k * BLOCK, F.lit(0))
        parts = F.transform(F.sequence(block(a), block(b - 1)), lambda k: F.substr(F.get(blocks, k), low(k) + 1, F.least(b - k * BLOCK, F.lit(BLOCK)) - low(k)))
        return F.when(b > a, F.array_join(parts, "")).otherwise("")

    def made(blocks: Column, spans: Column) -> Column:
        past = lambda i: F.coalesce(F.get(spans, i - 1)["e"], F.lit(0))
        return F.concat(
            F.array_join(F.transform(spans, lambda x, i: F.concat(cut(blocks, past(i), x["s"]), F.lit("<"), x["k"], F.lit(">"))), ""),
            cut(blocks, F.element_at(spans, -1)["e"], F.char_length(body)),
        )

    text = F.when(F.size(spans) > 0, _let(blocks, lambda b: _let(spans, lambda x: made(b, x)))).otherwise(body)
    return df.withColumn("_text", text).select(*[F.col("_text").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in names])
