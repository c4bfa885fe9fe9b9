"""Personal data: generators propose spans, boosted trees score them, thresholds select.

Everything on the data is DataFrame functions. Base kinds (email, ip, card, phone) are found by
fixed patterns and checks and always stay. High-recall generators propose further, overlapping
spans (``email_like``, ``number_like``, ``secret``); each carries small whole-number features of
its format and context. The features of all proposals are counted by one aggregation, which gives
at most as many rows as there are feature combinations; boosted trees are fitted to those counts
and turned into a column expression. Only proposals that touch no base span can be selected, and
only those are learnt from. Labels are weak ones: a number-like proposal counts as personal if it
stands free (no letter or digit beside it) and either follows a cue with 7 to 15 digits, or is
written like a national telephone or social security number; an email-like one if its parts make a
domain name; a secret if its value mixes letters and digits. Trees are fitted to one half of the
proposals (by a hash of their text); a threshold for each kind is calibrated on the other half to a
wanted precision. Of proposals beyond it that overlap, the one furthest beyond it is added.

A text may hold any number of matches: places are sums over blocks of about the square root of their
number, and overlaps are looked for in the blocks of spans that reach the place.

Patterns are possessive and tied to the start of a run of their characters, so that no text makes
them backtrack; they find what the plain greedy patterns find.

Defined results: a null or empty text has no spans; equal texts get equal spans; an empty table
gives an empty table and a model that adds nothing; extra columns are kept by :func:`redact` and
clash with nothing, since own columns start with ``__tessera_``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("email_like", "number_like", "secret")
KINDS = BASE_KINDS + ADDED_KINDS
#: Precision on the weak labels that a kind's threshold must reach.
PRECISION = 0.9

#: kind -> (what a text must hold for a match, pattern). Fixed values.
PATTERNS = {
    "email": ("@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (".", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"),
    "card": ("", r"[0-9](?:[\x20-]?+[0-9])++"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "email_like": ("at", r"(?i)(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?+[(\[{]at[)\]}]\x20?+[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[{]dot[)\]}])\x20?[A-Za-z0-9-]++)++"),
    "number_like": ("", r"\+?+\(?+[0-9](?:[\x20()./-]{0,2}+[0-9]){6,}+"),
    "secret": ("=", r"(?i)\b(?:token|password|passwd|pwd|secret|api[_-]?+key|access[_-]?+key)\x20?+=\x20?+[\"']?+[A-Za-z0-9_./+-]{8,}+[\"']?+"),
}
_OCTET = "0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
_CUE = r"(?i)(?:call|tel|phone|fax|mobile|card|visa|account|iban|ssn|id|mail|contact|reach|token|password|key|secret)\b[^\n]{0,12}$"

#: (545) 555-9193, 545-555-9193, 078-05-1120. Fixed values.
_NATIONAL = r"^(?:\([0-9]{2,5}\)\x20?[0-9]{3,4}[\x20.-][0-9]{3,4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4})$"

FEATURES = ("kind", "digits", "size", "signs", "plus", "paren", "cue", "left", "right")


def _matches(df: DataFrame, kinds: tuple[str, ...], text: str) -> DataFrame:
    """Add located matches for each kind: array of (kind, s, e, m, before, after)."""
    def holds(kind: str) -> Column:
        sign = PATTERNS[kind][0]
        return F.contains(F.col(text), F.lit(sign)) if sign else F.lit(True)

    none = F.array().cast("array<string>")
    # One step for each stage: every pattern runs once, and splits only where it matched.
    df = df.withColumns({f"__tessera_m_{k}": F.when(holds(k), F.regexp_extract_all(F.col(text), F.lit(PATTERNS[k][1]), F.lit(0))).otherwise(none) for k in kinds})
    df = df.withColumns({f"__tessera_p_{k}": F.when(F.size(f"__tessera_m_{k}") > 0, F.split(F.col(text), PATTERNS[k][1], -1)).otherwise(none) for k in kinds})
    # Length of what lies before each match, and of the match; sums of whole blocks; places.
    df = df.withColumns({f"__tessera_l_{k}": _lengths(k) for k in kinds})
    df = df.withColumns({f"__tessera_b_{k}": _block_sums(F.col(f"__tessera_l_{k}")) for k in kinds})
    df = df.withColumns({f"__tessera_a_{k}": _sums_before(F.col(f"__tessera_b_{k}")) for k in kinds})
    df = df.withColumns({f"__tessera_{k}": _located(k) for k in kinds})
    return df.drop(*[f"__tessera_{x}_{k}" for x in "mplba" for k in kinds])


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _width(n: Column) -> Column:
    """Size of a block where there are ``n`` things."""
    return F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))


def _block_numbers(n: Column) -> Column:
    return F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(n / _width(n)).cast("int")) - 1)


def _block_sums(values: Column) -> Column:
    n = F.size(values)
    return F.transform(_block_numbers(n), lambda b: F.aggregate(F.slice(values, b * _width(n) + 1, _width(n)), F.lit(0), lambda acc, x: acc + x))


def _lengths(kind: str) -> Column:
    return F.transform(f"__tessera_m_{kind}", lambda m, i: F.length(F.get(f"__tessera_p_{kind}", i)) + F.length(m))


def _sums_before(values: Column) -> Column:
    return F.transform(values, lambda x, i: F.aggregate(F.slice(values, 1, i), F.lit(0), lambda n, y: n + y))


def _located(kind: str) -> Column:
    """Matches as (kind, s, e, m, before, after) with their places in code points."""
    pieces, lengths, begins = (F.col(f"__tessera_{x}_{kind}") for x in "pla")
    width = _width(F.size(lengths))

    def span(m: Column, i: Column) -> Column:
        within = F.aggregate(F.slice(lengths, i - i % width + 1, i % width), F.lit(0), lambda n, x: n + x)
        end = F.get(begins, F.floor(i / width).cast("int")) + within + F.get(lengths, i)
        before, after = F.right(F.get(pieces, i), F.lit(24)), F.left(F.get(pieces, i + 1), F.lit(1))
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), (end - F.length(m)).alias("s"), end.alias("e"), m.alias("m"), before.alias("before"), after.alias("after"))

    return F.transform(f"__tessera_m_{kind}", span)


def _blocked(spans: Column) -> Column:
    """Spans in order (a column of its own: each block reads it), in blocks with the places that each reaches."""
    n = F.size(spans)

    def block(b: Column) -> Column:
        part = F.slice(spans, b * _width(n) + 1, _width(n))
        return F.struct(F.array_min(F.transform(part, lambda x: x["s"])).alias("lo"), F.array_max(F.transform(part, lambda x: x["e"])).alias("hi"), part.alias("part"))

    return F.transform(_block_numbers(n), block)


def _some(blocks: Column, x: Column, test) -> Column:
    """Whether a span of ``blocks`` that reaches x passes the test."""
    return F.exists(blocks, lambda k: F.coalesce((k["lo"] < x["e"]) & (k["hi"] > x["s"]), F.lit(False)) & F.exists(k["part"], test))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass: from the right, every second one doubled, casting out nines."""
    turned = F.reverse(digits)
    def value(i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        double = d * 2
        return F.when(i % 2 == 0, F.when(double > 9, double - 9).otherwise(double)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(f"^{_OCTET}(?:\\.{_OCTET}){{3}}$")
    if kind == "card":
        d = _digits(m)
        return F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def _checked(kind: str) -> Column:
    """Places of the matches of a base kind that pass its check."""
    kept = F.filter(F.col(f"__tessera_{kind}"), lambda x: _passes(kind, x["m"]))
    return F.transform(kept, _place)


def _place(x: Column) -> Column:
    return F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))


def _counted(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def _bucket(value: Column, *bounds: int) -> Column:
    """How many of the bounds the value reaches."""
    out = F.lit(0)
    for b in bounds:
        out = out + (value >= b).cast("int")
    return out


def _side(char: Column) -> Column:
    """0: nothing or white space, 1: letter or digit, 2: another sign."""
    return F.when(F.coalesce(char, F.lit("")).rlike(r"^\s?$"), 0).when(char.rlike(r"^[\p{L}\p{N}]$"), 1).otherwise(2)


def _proposal(x: Column, blocks: Column) -> Column:
    """A proposal with its features, weak label, half, and whether it touches a base span."""
    d = F.length(_digits(x["m"]))
    free = (_side(F.right(x["before"], F.lit(1))) != 1) & (_side(x["after"]) != 1)
    label = (
        F.when(x["kind"] == KINDS.index("number_like"), free & ((x["before"].rlike(_CUE) & d.between(7, 15)) | x["m"].rlike(_NATIONAL)))
        .when(x["kind"] == KINDS.index("email_like"), x["m"].rlike(r"[A-Za-z]{2,}$"))
        .otherwise(x["m"].rlike("[=].*[0-9]") & x["m"].rlike("[=].*[A-Za-z]"))
    )
    return F.struct(
        x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), label.alias("label"), F.pmod(F.xxhash64(x["m"]), F.lit(2)).cast("int").alias("half"),
        _some(blocks, x, lambda b: (b["s"] < x["e"]) & (b["e"] > x["s"])).alias("touches"),
        _bucket(d, 1, 4, 7, 10, 12, 16, 20).alias("digits"),
        _bucket(F.length(x["m"]), 9, 13, 17, 25, 41).alias("size"),
        _bucket(F.length(F.regexp_replace(x["m"], r"[\p{L}0-9]", "")), 1, 2, 4, 7).alias("signs"),
        x["m"].startswith("+").cast("int").alias("plus"),
        F.contains(x["m"], F.lit("(")).cast("int").alias("paren"),
        x["before"].rlike(_CUE).cast("int").alias("cue"),
        _side(F.right(x["before"], F.lit(1))).alias("left"),
        _side(x["after"]).alias("right"),
    )


def with_spans(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``__tessera_base`` (spans that stay) and ``__tessera_more`` (proposals with features)."""
    df = df.withColumn("__tessera_text", F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    df = _matches(df, KINDS, "__tessera_text")
    df = df.withColumn("__tessera_base", F.concat(*[_checked(k) for k in BASE_KINDS]))
    wide = F.concat(*[F.col(f"__tessera_{k}") for k in ADDED_KINDS])
    df = df.withColumn("__tessera_sorted", F.array_sort(F.transform("__tessera_base", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))))
    df = df.withColumn("__tessera_near", _blocked(F.col("__tessera_sorted")))
    df = df.withColumn("__tessera_more", _let(F.col("__tessera_near"), lambda near: F.transform(wide, lambda x: _proposal(x, near))))
    return df.drop("__tessera_text", "__tessera_near", "__tessera_sorted", *[f"__tessera_{k}" for k in KINDS])


@dataclass
class SpanModel:
    """Boosted trees over whole-number features and a threshold for each added kind."""

    trees: list[tuple]
    thresholds: dict[int, float]

    def expression(self, x: Column) -> Column:
        """The margin of a proposal as a column."""
        def grow(node: tuple) -> Column:
            if len(node) == 1:
                return F.lit(float(node[0]))
            feature, bound, low, high = node
            return F.when(x[FEATURES[feature]] < bound, grow(low)).otherwise(grow(high))

        out = F.lit(0.0)
        for tree in self.trees:
            out = out + grow(tree)
        return out

    def surplus(self, x: Column) -> Column:
        """By how much a proposal's margin is over its kind's threshold; null where its kind has none."""
        own = F.lit(None).cast("double")
        for kind, threshold in self.thresholds.items():
            own = F.when(x["kind"] == kind, F.lit(threshold)).otherwise(own)
        return self.expression(x) - own


def boost(values: np.ndarray, n: np.ndarray, positive: np.ndarray, rounds: int = 30, rate: float = 0.3, depth: int = 3) -> list[tuple]:
    """Trees fitted one after another to the gradient of the logistic loss of weighted rows."""
    margin, trees = np.zeros(len(n)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = positive - n * p, n * p * (1 - p) + 1e-9

        def grow(rows: np.ndarray, level: int) -> tuple:
            g, h = grad[rows].sum(), hess[rows].sum()
            best, choice = 1e-6, None
            if level:
                for f in range(values.shape[1]):
                    for bound in np.unique(values[rows, f])[1:]:
                        low = values[rows, f] < bound
                        gl, hl = grad[rows][low].sum(), hess[rows][low].sum()
                        gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                        if gain > best:
                            best, choice = gain, (f, int(bound), low)
            if choice is None:
                return (rate * g / (h + 1),)
            f, bound, low = choice
            return (f, bound, grow(rows[low], level - 1), grow(rows[~low], level - 1))

        tree = grow(np.arange(len(n)), depth)
        trees.append(tree)
        margin = margin + np.array([_walk(tree, v) for v in values])
    return trees


def _walk(node: tuple, row: np.ndarray) -> float:
    while len(node) > 1:
        node = node[2] if row[node[0]] < node[1] else node[3]
    return node[0]


def fit(spans: DataFrame, precision: float = PRECISION) -> SpanModel:
    """A model from the counts of the features of all proposals that can be selected (at most one row for each combination)."""
    # The outer form: a filter inferred from a plain one would be computed from the text on its own.
    x = spans.select(F.explode_outer("__tessera_more").alias("x")).filter("x IS NOT NULL AND NOT x.touches")
    counted = x.groupBy(*[F.col(f"x.{f}").alias(f) for f in (*FEATURES, "half")]).agg(F.count("*").alias("n"), F.sum(F.col("x.label").cast("int")).alias("positive")).collect()
    if not counted:
        return SpanModel([], {})
    counted.sort(key=lambda r: tuple(r[f] for f in (*FEATURES, "half")))
    values = np.array([[r[f] for f in FEATURES] for r in counted])
    n, positive, half = (np.array([r[c] for r in counted], dtype=float) for c in ("n", "positive", "half"))
    learnt = half == 0 if len(set(half)) == 2 else np.ones(len(half), dtype=bool)
    trees = boost(values[learnt], n[learnt], positive[learnt])
    margin = np.array([sum(_walk(t, v) for t in trees) for v in values])
    thresholds = {}
    for kind in map(KINDS.index, ADDED_KINDS):
        own = np.flatnonzero((values[:, 0] == kind) & ~learnt)
        if not len(own):  # too few for two halves
            own = np.flatnonzero(values[:, 0] == kind)
        order = own[np.argsort(-margin[own], kind="stable")]
        share = np.cumsum(positive[order]) / np.cumsum(n[order]) if len(order) else np.zeros(0)
        # Equal margins are selected together: a threshold stands at the last of them.
        last = np.append(np.diff(margin[order]) != 0, True) if len(order) else np.zeros(0, dtype=bool)
        good = np.flatnonzero((share >= precision) & last)
        if len(good):
            thresholds[kind] = float(margin[order[good[-1]]]) - 1e-9
    return SpanModel(trees, thresholds)


def _best(candidates: Column) -> Column:
    """Of candidates in order of start those that no overlapping one surpasses; ties: the earlier, then the longer one."""
    def place(x: Column) -> Column:
        return F.struct(x["surplus"], -x["s"], x["e"], x["kind"])

    def kept(c: Column) -> Column:
        return _let(_blocked(c), lambda k: F.filter(c, lambda x: ~_some(k, x, lambda y: (y["s"] < x["e"]) & (y["e"] > x["s"]) & (place(y) > place(x)))))

    return _let(candidates, kept)


def chosen(model: SpanModel) -> Column:
    """All spans of a row of :func:`with_spans`: base ones and the selected others, by kind and start."""
    base = F.col("__tessera_base")
    scored = F.transform(F.filter("__tessera_more", lambda x: ~x["touches"]), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"), model.surplus(x).alias("surplus")))
    best = _best(F.array_sort(F.filter(scored, lambda x: F.coalesce(x["surplus"] >= 0, F.lit(False)))))
    ordered = F.array_sort(F.transform(best, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))))
    return F.concat(base, ordered)


def _named(x: Column) -> Column:
    return F.concat(F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["kind"] + 1), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))


def digest(spans: DataFrame, model: SpanModel, id_col: str = "doc_id") -> DataFrame:
    """Counts, digest of the base spans and list of all spans for each row of :func:`with_spans`."""
    base = F.col("__tessera_base")
    counts = [_counted(base, i).alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)]
    return spans.select(F.col(f"`{id_col}`"), *counts, F.sha2(F.array_join(F.transform(base, _named), ","), 256).alias("base_sha256"), F.array_join(F.transform(chosen(model), _named), ",").alias("spans"))


def redact(docs: DataFrame, model: SpanModel, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by ``[KIND]``; overlapping spans become one.

    A condition on the new text is not pushed below it: each layer here names the one before several
    times, so that the text would be put into the condition as an expression of exponential size. The
    text therefore depends on a row number, which Spark does not move conditions across."""
    df = with_spans(docs, text_col).withColumn("__tessera_all", F.array_sort(F.transform(chosen(model), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))))
    text, spans = F.col(f"`{text_col}`"), F.col("__tessera_all")
    width = _width(F.size(spans))

    # ``reach``: how far the spans before one reach; where it starts behind that it heads a run of
    # overlapping spans, and what lies between is kept.
    df = df.withColumn("__tessera_his", F.transform(_blocked(spans), lambda k: k["hi"]))
    df = df.withColumn("__tessera_reach", F.transform("__tessera_his", lambda x, i: F.coalesce(F.array_max(F.slice("__tessera_his", 1, i)), F.lit(0))))

    def head(x: Column, i: Column) -> Column:
        near = F.array_max(F.transform(F.slice(spans, i - i % width + 1, i % width), lambda y: y["e"]))
        reach = F.greatest(F.get("__tessera_reach", F.floor(i / width).cast("int")), F.coalesce(near, F.lit(0)))
        return F.struct(x["s"].alias("s"), x["kind"].alias("kind"), reach.alias("reach"))

    # A column that only a lambda reads once would be computed anew for each element: each of those
    # is read once more outside.
    heads = F.filter(F.transform(spans, head), lambda x: x["s"] >= x["reach"])
    df = df.withColumn("__tessera_heads", F.when(F.size("__tessera_reach") > 0, heads))
    # Texts are cut in two steps, into blocks and then within them, since a cut reads from the start.
    n = F.size("__tessera_heads")
    wide = _width(n)
    begin = F.transform(_block_numbers(n), lambda b: F.coalesce(F.get("__tessera_heads", b * wide)["reach"], F.lit(0)))
    df = df.withColumn("__tessera_begins", begin)
    cut = F.transform("__tessera_begins", lambda at, b: F.substring(text, at + 1, F.coalesce(F.get("__tessera_begins", b + 1), F.lit(2**31 - 2)) - at))
    df = df.withColumn("__tessera_parts", F.when(n > 0, cut))

    def piece(x: Column, i: Column) -> Column:
        b = F.floor(i / wide).cast("int")
        name = F.upper(F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["kind"] + 1))
        return F.concat(F.substring(F.get("__tessera_parts", b), x["reach"] - F.get("__tessera_begins", b) + 1, x["s"] - x["reach"]), F.lit("["), name, F.lit("]"))

    done = F.array_join(F.transform("__tessera_heads", piece), "")
    rest = F.substring(text, F.array_max("__tessera_his") + 1, F.lit(2**31 - 1))
    fence = F.monotonically_increasing_id() >= 0
    return df.withColumn(text_col, F.when(fence & F.col("__tessera_parts").isNotNull(), F.concat(done, rest)).otherwise(text)).select(*[F.col(f"`{c}`") for c in docs.columns])
