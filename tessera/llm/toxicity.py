"""Toxicity scores behind a noisy-channel restoration of disguised words.

1. A character trigram model is counted over the words of all documents (each task adds up its own
   counts; at most 27 cubed numbers travel from a task).
2. Tokens that mix letters with digits or signs, repeat a letter three times or more, or are spelt
   with spaces become character lattices: a sign may stand for look-alike letters, a separator may
   be dropped, a run of one letter may be one or two letters, a space between spelt letters may be
   dropped or end a word, each at a channel cost. Viterbi decoding finds the likeliest word or words
   under the character model, in time linear in the token, however long it is.
3. Restored words and their beginnings are features. A list of features is fitted on a bounded,
   documented sample of labelled rows (``max_labelled``): each in turn explains the most toxic
   rows that are left. A score is the noisy or of the features found in the restored text.

Defined results: null, empty and wordless texts get the model's base rate; equal texts get equal
scores; rows without labels are scored like others; with no labelled row every score is 0.0;
a document with several labels counts as toxic if one of them says so; null ids are never held
out and never match a label; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import entering, slices, trim

#: Most labelled rows that the classifier is fitted on.
MAX_LABELLED = 30_000
#: Share of toxic rows, shrunk towards the prior by ``STRENGTH`` rows, that makes a feature.
LEAST_SHARE, STRENGTH = 0.8, 1.0
#: From this score on a document counts as toxic.
THRESHOLD = 0.7
#: Tokens that a worker remembers.
CACHE_TOKENS = 150_000
#: Tokens that a task of the fit remembers from slice to slice.
FIT_TOKENS = 50_000

# Letters that a sign can stand for.
LOOKS_LIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "£": "l", "¥": "y"}
SEPARATORS = ".-_*~'·•/\\, "
# Channel costs in nats: fixed values.
SUBSTITUTED, DROPPED, DROPPED_DIGIT, SHORTENED, ENDED = -1.0, -0.3, -20.0, -0.5, -1.0

_EDGE = ".,;:!?\"'()[]{}<>«»“”„…|*#%&=-_~`/\\"
_EDGE_ONLY = "".join(c for c in _EDGE if c not in LOOKS_LIKE)
_FOLDED = "".join(
    chr(c).lower() if chr(c).lower() in "abcdefghijklmnopqrstuvwxyz" else {"à": "a", "á": "a", "â": "a", "ã": "a", "ä": "a", "å": "a", "ç": "c", "è": "e", "é": "e", "ê": "e", "ë": "e", "ì": "i", "í": "i", "î": "i", "ï": "i", "ñ": "n", "ò": "o", "ó": "o", "ô": "o", "õ": "o", "ö": "o", "ù": "u", "ú": "u", "û": "u", "ü": "u", "ý": "y", "ÿ": "y", "ß": "s"}.get(chr(c).lower(), "`")
    for c in range(256)
)
#: Latin-1 bytes to 1..26 for letters, 0 for all else.
_CODE = bytes(ord(c) - 96 for c in _FOLDED)


def tokens(text: str | None) -> list[str]:
    """Lower-case tokens; letters spelt with spaces are one token, spaces included."""
    if not text:
        return []
    raw = text.lower().split()
    marks = "".join(["1" if len(t) == 1 else "0" for t in raw])
    if "111" in marks:
        out = []
        for single, run in groupby(raw, key=lambda t: len(t) == 1):
            run = list(run)
            out += [" ".join(run)] if single and len(run) > 2 else run
        raw = out
    return raw


def char_counts(words: Counter) -> np.ndarray:
    """27 cubed trigram counts of counted words, each with two borders before and one after."""
    kept = [(w, n) for w, n in words.items() if " " not in w]
    if not kept:
        return np.zeros(27**3, dtype=np.int64)
    flat = "``" + "``".join([w for w, _ in kept]) + "``"
    code = np.frombuffer(flat.encode("latin-1", "replace").translate(_CODE), dtype=np.uint8).astype(np.int32)
    weight = np.repeat([n for _, n in kept], [len(w) + 2 for w, _ in kept])
    grams = (code[:-2] * 27 + code[1:-1]) * 27 + code[2:]
    return np.bincount(grams, weights=weight[: len(grams)], minlength=27**3).astype(np.int64)


def corpus_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """gram, n: character trigrams of the words of all documents."""
    schema = "gram int, n long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("toxicity")
        total = np.zeros(27**3, dtype=np.int64)
        for batch in slices(batches):
            words: Counter = Counter()
            for text in batch.column(0).to_pylist():
                words.update(tokens(text))
            total += char_counts(words)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["gram", "n"])

    return docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(count, schema).groupBy("gram").agg(F.sum("n").alias("n"))


def char_model(counts: dict[int, int]) -> np.ndarray:
    """Log probabilities of a character after two others, smoothed by shorter contexts."""
    n = np.zeros(27**3)
    for gram, c in counts.items():
        n[gram] = c
    n = n.reshape(27, 27, 27)
    one = n.sum((0, 1))
    p1 = (one + 1) / (one.sum() + 27)
    two = n.sum(0)
    p2 = (two + 20 * p1) / (two.sum(1, keepdims=True) + 20)
    return np.log((n + 20 * p2[None]) / (n.sum(2, keepdims=True) + 20))


def _options(char: str) -> list[tuple[str, float]]:
    """What one character of a token may stand for, with channel costs."""
    if char.isalpha():
        return [(char, 0.0)]
    if char in LOOKS_LIKE:
        looks = LOOKS_LIKE[char]
        out = [(c, SUBSTITUTED - math.log(len(looks))) for c in looks]
        return out + [("", DROPPED_DIGIT)]
    return [("", DROPPED if char in SEPARATORS else DROPPED_DIGIT)]


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Options for each run of a character; runs of letters may be kept, halved or made one."""
    out = []
    for char, run in groupby(token):
        n = len(list(run))
        if char == " ":
            out.append([("", DROPPED), (" ", ENDED)])
            continue
        options = _options(char)
        if n == 1 or options == [("", DROPPED)]:
            out.append(options)
        elif n == 2:
            out.append([(c * 2, cost * 2) for c, cost in options] + [(c, cost * 2 + 10 * SHORTENED) for c, cost in options if c])
        else:
            out.append([(c * k, cost + SHORTENED) for c, cost in options for k in ((1, 2) if c else (1,))])
    return out


def code_of(char: str) -> int:
    return _CODE[ord(char)] if ord(char) < 256 else 0


def decode(token: str, model: np.ndarray) -> str:
    """The likeliest word behind a token, or words: Viterbi over its lattice, states are two characters."""
    # State: (score, letters chosen last, the state before).
    states: dict[tuple[int, int], tuple] = {(0, 0): (0.0, "", None)}
    for options in lattice(token):
        following: dict[tuple[int, int], tuple] = {}
        for (a, b), state in states.items():
            for letters, cost in options:
                x, y, s = a, b, state[0] + cost
                for c in letters:
                    if c == " ":  # a word ends: two borders, then the next one begins
                        s += model[x, y, 0] + model[y, 0, 0]
                        x = y = 0
                    else:
                        z = code_of(c)
                        s += model[x, y, z]
                        x, y = y, z
                if (x, y) not in following or s > following[x, y][0]:
                    following[x, y] = (s, letters, state)
        states = following
    best = max(states.items(), key=lambda kv: kv[1][0] + model[kv[0][0], kv[0][1], 0])[1]
    parts = []
    while best is not None:
        parts.append(best[1])
        best = best[2]
    return "".join(reversed(parts))


def plain(token: str) -> bool:
    """Whether a token has letters only, none of them three times in a row."""
    return token.isalpha() and not any(a == b == c for a, b, c in zip(token, token[1:], token[2:], strict=False))


def restore(token: str, model: np.ndarray) -> list[str]:
    """A token's readings: itself where it is plain, else the decoded word.

    A plain word after a look-alike sign has both readings, and so has a word spelt with spaces
    (whole, and cut into words); a token without letters has none.
    """
    core = token.replace(" ", "").strip(_EDGE)
    found = [core] if plain(core) else []
    # Signs at the edge may be disguised letters only where they look like one.
    wide = token.lstrip(_EDGE_ONLY).rstrip(_EDGE_ONLY + "!")
    if wide != core or not found:
        if any(c.isalpha() for c in wide) and not plain(wide):
            found += decode(wide, model).split()
    return found


def features(word: str) -> list[str]:
    """A restored word and its beginnings."""
    if len(word) < 3:
        return []
    return [f"={word}"] + [word[:n] for n in (4, 5, 6) if len(word) > n]


def token_features(token: str, model: np.ndarray) -> list[str]:
    return [f for word in restore(token, model) for f in features(word)]


@dataclass
class ToxicityModel:
    """What scoring needs: the character model and, for each feature, the log chance of no harm."""

    chars: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)
    base: float = 0.0
    fitted: bool = False
    _known: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)

    def found(self, token: str) -> tuple[str, ...]:
        """Weighted features of one token."""
        return tuple(f for f in token_features(token, self.chars) if f in self.weights)

    def score(self, text: str | None) -> float:
        if not self.fitted:
            return 0.0
        own, hits = set(tokens(text)), set()
        known = self._known
        if len(known) > CACHE_TOKENS:
            known.clear()
        for t in own.difference(known):
            known[t] = self.found(t)
        for f in map(known.__getitem__, own):
            if f:
                hits.update(f)
        # Noisy or: each feature found makes the text toxic with its own probability.
        return 1 - math.exp(math.log1p(-self.base) + sum(map(self.weights.__getitem__, sorted(hits))))


def is_held_out(id_col: Column) -> Column:
    """Rows whose labels are never learnt."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def labelled_sample(labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """At most ``max_labelled`` label rows that may be learnt, in an order fixed by their id."""
    own = labels.select("doc_id", "toxic").filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~is_held_out(F.col("doc_id")))
    return own.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> ToxicityModel:
    """Character model from all documents, classifier from the bounded labelled sample."""
    spark = docs.sparkSession
    chars = char_model({r.gram: r.n for r in corpus_counts(docs).collect()})
    sample = [(r.doc_id, int(r.toxic)) for r in labelled_sample(labels, max_labelled).collect()]
    model = ToxicityModel(chars)
    if not sample:
        return model
    # At most max_labelled pairs of numbers: bounded, so the texts need not move.
    chosen = F.broadcast(spark.createDataFrame(sample, "doc_id long, toxic int"))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id")
    sent = spark.sparkContext.broadcast(chars)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("toxicity")
        known: dict[str, list[str]] = {}
        bad, good = Counter(), Counter()
        for batch in slices(batches):
            if len(known) > FIT_TOKENS:
                known.clear()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = set(tokens(text))
                for t in own.difference(known):
                    known[t] = token_features(t, sent.value)
                (bad if toxic else good).update({f for t in own for f in known[t]})
        names = list(bad.keys() | good.keys())
        for lo in range(0, len(names), 50_000):
            part = names[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, type=pa.string()), pa.array([bad[f] for f in part], type=pa.int64()), pa.array([good[f] for f in part], type=pa.int64())], names=["f", "bad", "good"])

    counted = rows.select("text", "toxic").mapInArrow(count, "f string, bad long, good long").groupBy("f").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    n_bad = sum(t for _, t in sample)
    prior = max(n_bad, 1) / len(sample)
    # One rule for all: the shrunk share. Features are those of at most max_labelled rows.
    shrunk = (F.col("bad") + STRENGTH * prior) / (F.col("bad") + F.col("good") + STRENGTH)
    chosen_features = sorted(r.f for r in counted.filter(shrunk >= LEAST_SHARE).collect())
    index = {f: k for k, f in enumerate(chosen_features)}
    sent_index = spark.sparkContext.broadcast(index)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("toxicity")
        known: dict[str, tuple[int, ...]] = {}
        for batch in slices(batches):
            if len(known) > FIT_TOKENS:
                known.clear()
            out, marks = [], []
            for text in batch.column(0).to_pylist():
                listed = tokens(text)
                marks.append(min((zlib.crc32(" ".join(listed[i : i + 3]).encode("utf-8", "replace")) for i in range(max(1, len(listed) - 2))), default=0))
                own = set(listed)
                for t in own.difference(known):
                    known[t] = tuple(sent_index.value[f] for f in token_features(t, sent.value) if f in sent_index.value)
                out.append(sorted({k for t in own for k in known[t]}))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(marks, type=pa.int64()), pa.array(out, type=pa.list_(pa.int32()))], names=["toxic", "mark", "fs"])

    # Equal lists of features weigh by their number: few rows reach the driver.
    training = rows.select("text", "toxic").mapInArrow(lists, "toxic int, mark long, fs array<int>").groupBy("fs", "mark").agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).collect()
    shares, model.base = cover([(list(r.fs), r.mark, r.n, r.bad) for r in training], len(index), prior)
    model.weights = {f: math.log1p(-shares[k]) for f, k in index.items() if k in shares}
    model.fitted = True
    return model


def cover(rows: list[tuple[list[int], int, float, float]], n_features: int, prior: float, strength: float = STRENGTH, least: float = LEAST_SHARE, explained: float = 0.5) -> tuple[dict[int, float], float]:
    """Features chosen one by one, each for the rows that earlier ones do not explain.

    ``rows`` are (features, mark of near copies, rows, toxic rows). Near copies of one text share
    a mark and together weigh as one row; a row counts ``explained`` times as much once a chosen
    feature explains it. So words that merely stand beside a toxic word in copied texts get no
    weight of their own. A feature's probability is its weighted share of toxic rows, shrunk to
    the prior. Gives the probabilities and the toxic share of the rows that remain.
    """
    rows = sorted(rows)
    group = np.unique([r[1] for r in rows], return_inverse=True)[1]
    n = np.array([r[2] for r in rows], dtype=float)
    weight = 1 / np.bincount(group, weights=n)[group]
    n, bad = n * weight, np.array([r[3] for r in rows], dtype=float) * weight
    total, factor = n.copy(), np.ones(len(rows))
    who = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    what = np.array([k for r in rows for k in r[0]], dtype=np.int64)
    chosen: dict[int, float] = {}
    while len(what):
        toxic = np.bincount(what, weights=(bad * factor)[who], minlength=n_features)
        share = (toxic + strength * prior) / (np.bincount(what, weights=(n * factor)[who], minlength=n_features) + strength)
        gain = np.where(share >= least, toxic * np.log(share / prior), 0)
        best = int(gain.argmax())
        if not gain[best]:
            break
        chosen[best] = float(share[best])
        factor[who[what == best]] = explained
        keep = what != best
        who, what = who[keep], what[keep]
    left = factor == 1
    rest = (bad[left].sum() + strength * prior * least) / (total[left].sum() + strength)
    return chosen, float(min(rest, least))


def toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> Column:
    """The score of each text as a column for ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast((model.chars, model.weights, model.base, model.fitted))

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        entering("toxicity")
        own = ToxicityModel(*sent.value)
        for texts in batches:
            yield pd.Series([own.score(t) for t in texts], dtype=float)
        own._known.clear()
        trim()

    return score(F.col(f"`{text_col}`"))
