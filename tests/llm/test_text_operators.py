"""Operators on single texts: SentencePiece, toxicity, personal data, decontamination, token files
and token counts, against libraries and brute force, with the edge cases that they define."""

import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontamination, pii, sentencepiece, token_counts, token_files, toxicity
from tessera.llm.common import table
from tessera.llm.queries import oracle_sql, queries, tokenizer_path

PIECES, WORDS, BYTES = "piece_bpe_32k.model", "word_bpe_49k.json", "byte_bpe_50k.tiktoken"
EDGE = [None, "", " ", "\n", "a", "  two  spaces ", "same", "same", "x" * 30_000, "word " * 5_000, "日本語 😀 é́", "\x00\x1c tab\t", "▁▁a ▁", "<s></s>", "İ Σσς ß ÿ ª", "<|endoftext|> <|ENDOFTEXT|>"]


def scrambled(n, letters, size=50, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(size)) for _ in range(n)]


def frame(spark, texts):
    """doc_id, text and columns whose names the operators use themselves."""
    rows = [(i, t, "en", 0.5, 7, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, n_tokens int, d string")


def real_texts(spark, sf):
    return [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]


# --- SentencePiece --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def agenda():
    return sentencepiece.AgendaEncoder(tokenizer_path(PIECES))


def test_agenda_equals_the_library(spark, sf, agenda):
    texts = [t or "" for t in EDGE] + real_texts(spark, sf) + scrambled(3000, "ab \n▁é日<>0x1.,😀'²")
    want = agenda.library.encode(texts, add_eos=True, num_threads=1)
    assert [agenda.encode(t) for t in texts] == want
    assert agenda.n_differ == 0


def test_flat_and_heap_agenda_agree(agenda):
    for unit in scrambled(300, "theanrosi", 40):
        assert agenda.merge_short(list(unit)) == agenda.merge_long(list(unit))


def test_cache_is_bounded_and_harmless(spark, sf):
    small = sentencepiece.AgendaEncoder(tokenizer_path(PIECES), cache_units=50)
    texts = real_texts(spark, sf)[:60]
    assert [small.encode(t) for t in texts] == small.library.encode(texts, add_eos=True, num_threads=1)
    assert len(small.cache) < 20_000


def test_encode_digests(spark, agenda):
    got = {r.doc_id: r for r in sentencepiece.encode_digests(frame(spark, EDGE), tokenizer_path(PIECES)).collect()}
    for i, t in enumerate(EDGE):
        ids = agenda.library.encode(t or "", add_eos=True)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(agenda.library.decode(ids).encode()).hexdigest()
    assert sentencepiece.encode_digests(frame(spark, []), tokenizer_path(PIECES)).count() == 0


def test_encode_then_decode_columns(spark):
    df = sentencepiece.encode(frame(spark, ["Hello wörld", None]), tokenizer_path(PIECES))
    back = {r.doc_id: r.decoded for r in sentencepiece.decode(df, tokenizer_path(PIECES)).collect()}
    assert back == {0: "Hello wörld", 1: ""}


# --- toxicity -------------------------------------------------------------------------------------


def toxic_world(spark, n=600):
    rng = random.Random(5)
    plain = "the of and to in that is was for on with as are by this from which have their been one all we can said there use each how".split()
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(30)]
        bad = i % 5 == 0
        if bad:
            words[rng.randrange(30)] = rng.choice(["grumbold", "snorvek"])
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


@pytest.fixture(scope="module")
def toxic_model(spark):
    return toxicity.fit(*toxic_world(spark))


def test_held_out_accuracy(spark, toxic_model):
    docs, labels = toxic_world(spark)
    scored = docs.withColumn("s", toxicity.toxicity(docs, toxic_model)).filter(toxicity.is_held_out(F.col("doc_id"))).join(labels, "doc_id").collect()
    assert len(scored) > 150
    assert all((r.s >= toxicity.THRESHOLD) == bool(r.toxic) for r in scored)


@pytest.mark.parametrize("spelt", ["grumbold", "GRUMBOLD!", "grumb0ld", "g.r.u.m.b.o.l.d", "g r u m b o l d", "gruuuumbold", "gru-mb0ld", "sn0rvek", "$norvek", "so sn_orvek, yes", "gr" + "u" * 60 + "mbold", "t h e g r u m b o l d", "s n o r v e k a n d t h e", "g" + "-" * 50 + "rumbold"])
def test_disguises_are_restored(toxic_model, spelt):
    assert toxic_model.score(f"the of {spelt} and was") >= toxicity.THRESHOLD


def test_viterbi_equals_enumeration(toxic_model):
    def score(choice, model):
        a = b = 0
        total = sum(cost for _, cost in choice)
        for c in "".join(letters for letters, _ in choice):
            if c == " ":
                total, a, b = total + model[a, b, 0] + model[b, 0, 0], 0, 0
            else:
                z = toxicity.code_of(c)
                total, a, b = total + model[a, b, z], b, z
        return total + model[a, b, 0]

    rng = random.Random(4)
    for _ in range(300):
        token = "".join(rng.choice("grumbolde1.0@3$ |") for _ in range(rng.randrange(1, 9)))
        best = max(score(c, toxic_model.chars) for c in itertools.product(*toxicity.lattice(token)))
        found = toxicity.decode(token, toxic_model.chars)
        mine = max(score(c, toxic_model.chars) for c in itertools.product(*toxicity.lattice(token)) if "".join(x for x, _ in c) == found)
        assert mine == pytest.approx(best)


def test_long_tokens_take_linear_time(toxic_model):
    text = "x1." * 30_000
    began = time.time()
    toxic_model.score(text)
    assert time.time() - began < 20


def test_clean_texts_score_low(toxic_model):
    for t in EDGE + ["there are 2020 items at 10:30, see www.example.org/x1"]:
        assert toxic_model.score(t) < 0.3


def test_toxicity_edges(spark, toxic_model):
    df = frame(spark, EDGE)
    rows = df.select("doc_id", "text", toxicity.toxicity(df, toxic_model).alias("t")).collect()
    assert len(rows) == len(EDGE) and len({r.t for r in rows if r.text == "same"}) == 1
    unlabelled = toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert unlabelled.score("grumbold") == 0.0
    none = frame(spark, [])
    assert none.select(toxicity.toxicity(none, toxicity.fit(none, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))).alias("t")).count() == 0


def test_held_out_rows_are_never_learnt(spark):
    labels = spark.createDataFrame([(i, 1) for i in range(300)] + [(None, 1), (5, None), (5, 0)], "doc_id long, toxic int")
    chosen = [r.doc_id for r in toxicity.labelled_sample(labels, 50).collect()]
    assert len(chosen) == len(set(chosen)) == 50
    assert all(zlib.crc32(str(i).encode()) % 3 != 1 for i in chosen)


# --- personal data --------------------------------------------------------------------------------


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(t):
    t, out = t or "", []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


PERSONAL = [
    "a@b.c_d@e.fg", "a@b.c@d.e.f", "1.2.3.4.5", "256.1.1.1 007.1.1.1", "+1 (980) 555-6268 call", "+1((((((", "4929 3483 8514 6306 1", "4929348385146306", "😀 é a.b@c.de +44 20-7946.0958 é", "1 " * 9000, "1" * 9000, "a@b.c " * 2000, "a" * 20_000 + "@x.yz",
    "john (at) site [dot] com", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x', "password=e3b3ed3cc8548923d6",
]


def test_base_spans_equal_brute_force(spark):
    texts = EDGE + PERSONAL + scrambled(4000, "aé@.+-_%1 25()0", 60)
    spans = pii.with_spans(frame(spark, texts))
    got = {r.doc_id: r for r in pii.digest(spans, pii.fit(spans)).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), t
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(want.count(k + ":") for k in ("email", "ip", "card", "phone"))
        assert set(filter(None, want.split(","))) <= set(got[i].spans.split(","))


def test_proposals_add_secrets_and_nothing_overlaps_base(spark):
    spans = pii.with_spans(frame(spark, PERSONAL * 5))
    rows = pii.digest(spans, pii.fit(spans)).collect()
    assert any("secret:0:27" in r.spans for r in rows)
    for r in rows:
        parts = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        base = [p for p in parts if p[0] in pii.BASE_KINDS]
        assert not any(a < y and b > x for k, a, b in parts if k not in pii.BASE_KINDS for _, x, y in base)


def test_redaction(spark):
    docs = frame(spark, ["mail a@b.cd, now", None, "é 10.0.0.1 and +1 (980) 555-6268.", "clean"])
    spans = pii.with_spans(docs)
    out = pii.redact(docs, pii.fit(spans))
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {0: "mail [EMAIL], now", 1: None, 2: "é [IP] and [PHONE].", 3: "clean"}


def test_many_matches_in_one_text_end_soon(spark):
    n = 20_000
    text = "a@b.cd 1.2.3.4 +44 20 7946 0958, " * n
    df = frame(spark, [text, "x a@b.cd"])
    began = time.time()
    got = pii.digest(pii.with_spans(df), pii.SpanModel([], {})).collect()[0]
    assert (got.n_email, got.n_ip, got.n_phone) == (n, n, n)
    assert got.spans.count(",") == 3 * n - 1 and got.spans.endswith(f":{len(text) - 2}")
    out = [r.text for r in pii.redact(df, pii.SpanModel([], {})).collect()]
    assert out == ["[EMAIL] [IP] [PHONE], " * n, "x [EMAIL]"]
    assert time.time() - began < 120


def test_trees_and_added_spans_equal_brute_force(spark):
    """The column expression of the trees against a walk; redaction against a plain loop."""
    texts = (PERSONAL + EDGE + scrambled(300, "aé@.+- 1250()=", 60) + [f"call +44 20 7946 0{i} or 55 1234 98{i}, token=abc{i}def" for i in range(100, 140)]) * 2
    df = frame(spark, texts)
    model = pii.fit(pii.with_spans(df))
    assert model.trees and model.thresholds
    rows = pii.with_spans(df).select("doc_id", "text", "__tessera_base", "__tessera_more", F.transform("__tessera_more", model.expression).alias("margins"), pii.chosen(model).alias("all")).collect()
    redacted = {r.doc_id: r.text for r in pii.redact(df, model).collect()}
    for r in rows:
        base = [(b.kind, b.s, b.e) for b in r["__tessera_base"]]
        able = []  # by how much over the threshold, place
        for x, margin in zip(r["__tessera_more"], r.margins, strict=True):
            mine = sum(pii._walk(t, [x[f] for f in pii.FEATURES]) for t in model.trees)
            assert margin == pytest.approx(mine)
            touches = any(s < x.e and e > x.s for _, s, e in base)
            assert x.touches == touches
            if x.kind in model.thresholds and mine >= model.thresholds[x.kind] and not touches:
                able.append((margin - model.thresholds[x.kind], -x.s, x.e, x.kind))
        want = base + sorted((k, -s, e) for g, s, e, k in able if not any(-t < e and f > -s and (h, t, f, j) > (g, s, e, k) for h, t, f, j in able))
        assert [(x.kind, x.s, x.e) for x in r.all] == want
        out, at = [], 0
        for s, e, kind in sorted((s, e, k) for k, s, e in want):
            if s >= at:
                out += [(r.text or "")[at:s], f"[{pii.KINDS[kind].upper()}]"]
            at = max(at, e)
        assert redacted[r.doc_id] == (None if r.text is None else "".join(out) + r.text[at:])


FALSE_AND_TRUE = (
    [f'x token = "a{i}bd{i}0f9c8e7d6{i}" y' for i in range(40)]
    + [f"password = required_{'abcdefgh'[i % 8]}{'mnopqrst'[i // 8]}field here" for i in range(40)]
    + [f"write to us or call (545) 555-{9100 + i} soon" for i in range(40)]
    + [f"serial {59689346948668 * 100 + i} of the part" for i in range(60) if not base_spans(f"{59689346948668 * 100 + i}")][:40]
)


def test_trees_tell_false_proposals_from_true_ones(spark):
    docs = frame(spark, FALSE_AND_TRUE)
    spans = pii.with_spans(docs)
    model = pii.fit(spans)
    got = {r.doc_id: r.spans for r in pii.digest(spans, model).collect()}
    for i, text in enumerate(FALSE_AND_TRUE):
        want = ("secret:2:", "", "number_like:", "")[i // 40]
        assert got[i].startswith(want) and bool(got[i]) == bool(want), (text, got[i])
    # Without the trees the thresholds cannot tell them apart.
    flat = pii.SpanModel([], {k: 0.0 for k in model.thresholds})
    other = {r.doc_id: r.spans for r in pii.digest(spans, flat).collect()}
    assert sum(got[i] != other[i] for i in got) >= 80


def test_margins_decide_on_the_given_table(spark, sf):
    spans = pii.with_spans(table(spark, sf, "documents"))
    model = pii.fit(spans)
    got = {r.doc_id: r.spans for r in pii.digest(spans, model).collect()}
    flat = pii.SpanModel([], {pii.KINDS.index(k): 0.0 for k in pii.ADDED_KINDS})
    assert any(got[r.doc_id] != r.spans for r in pii.digest(spans, flat).collect())


def test_overlapping_proposals_give_the_best_one(spark):
    text = "a token=1234567890abc1234567 and b"
    spans = pii.with_spans(frame(spark, [text]))
    kinds = {k: pii.KINDS.index(k) for k in pii.ADDED_KINDS}
    # Margins: 2 for secrets, 1 for the rest; the thresholds decide which is further over its own.
    tree = (pii.FEATURES.index("kind"), kinds["secret"], (1.0,), (2.0,))
    for secret, number, want in ((0.0, 0.0, ["secret"]), (1.9, 0.0, ["number_like", "number_like"]), (3.0, 0.5, ["number_like", "number_like"]), (0.5, 2.0, ["secret"])):
        model = pii.SpanModel([tree], {kinds["secret"]: secret, kinds["number_like"]: number})
        assert [x.split(":")[0] for x in pii.digest(spans, model).collect()[0].spans.split(",")] == want


def test_a_condition_on_redacted_text_plans_soon(spark):
    docs = frame(spark, ["", None, "mail a@b.cd " * 3000, "token=abc123def456"])
    spans = pii.with_spans(docs)
    out = pii.redact(docs, pii.fit(spans))
    began = time.time()
    assert out.filter("text rlike 'EMAIL'").filter("length(text) > 3").selectExpr("upper(text) AS t").distinct().count() == 1
    assert time.time() - began < 30


def test_empty_table_of_personal_data(spark):
    spans = pii.with_spans(frame(spark, []))
    model = pii.fit(spans)
    assert model.thresholds == {} and pii.digest(spans, model).count() == 0


def test_personal_data_runs_no_python(spark):
    plan = pii.digest(pii.with_spans(frame(spark, ["a@b.cd"])), pii.SpanModel([], {}))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- decontamination ------------------------------------------------------------------------------


def brute_contamination(text, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, ids = words(text), set(), set()
    for item_id, item in items:
        p = words(item)
        for k in range(max(1, len(p) - window + 1)) if p else ():
            part = p[k : k + window]
            for at in range(len(w) - len(part) + 1):
                if w[at : at + len(part)] == part:
                    hit.update(range(at, at + len(part)))
                    if item_id is not None:
                        ids.add(str(item_id))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block_chars", [400, 4_000_000])
def test_contamination_equals_brute_force(spark, block_chars):
    rng = random.Random(2)
    vocabulary = ["a", "b", "É", "x1", "日本", "Word"]
    items = [(i % 7, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 14)))) for i in range(25)] + [(None, "zz yy"), (30, None), (31, "..."), (32, "b a b")]
    texts = EDGE + [" ".join(rng.choice(vocabulary) + rng.choice([" ", ",", "-", "\n"]) for _ in range(rng.randrange(1, 60))) for _ in range(150)] + ["ZZ, yy!", items[0][1]]
    docs = frame(spark, texts)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, d int")
    got = {r.doc_id: tuple(r.x)[:5] for r in decontamination.with_contamination(docs, bench, "x", block_chars=block_chars).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute_contamination(t, items), t


def test_ids_of_a_shared_window_go_on_in_further_blocks(spark):
    items = [(f"item-{i:03}", "one two three four five six seven eight nine ten") for i in range(50)]
    blocks = list(decontamination.item_blocks(items, block_chars=120))
    assert len(blocks) > 5 and all(sum(len(p) + sum(map(len, ids)) for p, ids in b.items()) <= 120 for b in blocks)
    docs = spark.createDataFrame([(1, "x one two three four five six seven eight nine ten y")], "doc_id long, text string")
    got = decontamination.with_contamination(docs, spark.createDataFrame(items, "item_id string, text string"), "d", block_chars=1000).select("d.*").collect()[0]
    assert (got.n_items, got.n_hit, got.contaminated) == (50, 10, True)
    assert got.items_sha256 == hashlib.sha256(",".join(i for i, _ in items).encode()).hexdigest()


def test_hit_spans_lie_in_the_original_text(spark):
    docs = frame(spark, ["é, Two Words! then two;words again"])
    bench = spark.createDataFrame([(1, "two words")], "item_id long, text string")
    row = decontamination.with_contamination(docs, bench, "x").select("text", F.col("x.hit_spans").alias("s")).first()
    assert [row.text[a:b] for a, b in row.s] == ["Two Words", "two;words"]


def test_decontaminate_keeps_clean_rows_whole(spark):
    docs = frame(spark, ["clean text", "the two words", None])
    bench = spark.createDataFrame([(1, "two words")], "item_id long, text string")
    out = decontamination.decontaminate(docs, bench)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [0, 2]
    assert decontamination.decontaminate(docs, bench.limit(0)).count() == 3


# --- token files ----------------------------------------------------------------------------------


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(WORDS))
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def test_chunk_encoder_equals_the_library(spark, sf):
    own = token_files.chunk_encoder(tokenizer_path(WORDS), 1)
    texts = EDGE + real_texts(spark, sf)[:80] + scrambled(3000, "ab \n'sΣ́é日.,\x1c\x85　 😀1²DT<|>")
    for t, want in zip(texts, library_ids(texts), strict=True):
        assert np.frombuffer(own.encode(t), dtype="<u4").tolist() == want, t


def test_runs_of_texts_equal_the_library():
    own = token_files.chunk_encoder(tokenizer_path(WORDS), 1)
    latin = "".join(chr(c) for c in range(0x20, 0x100)) + "aaaaeeee      "
    texts = [None, "", "  ", "Straße,\tÉTÉ!! \x0bª²µ", "x<|ENDOFTEXT|>y", "<|endoftext|>$$ a", "don't I'LL 's ''s", "\n" * 5, "a\xa0b\x85c\u3000d"] + scrambled(2000, latin)
    for kind in (pa.string(), pa.large_string()):
        run = pa.array(["cut", *texts], kind)[1:]
        got = own.encode_all(run)
        assert [np.frombuffer(x, dtype="<u4").tolist() for x in got] == library_ids(texts)
    assert own.encode_all(pa.array([], pa.string())) == []


def test_different_words_of_a_run_are_looked_up_once_and_encoded_together(monkeypatch):
    own, single, looked_up = token_files.ChunkEncoder(tokenizer_path(WORDS), 1), [], []
    whole = token_files.KnownChunks.whole
    monkeypatch.setattr(token_files.KnownChunks, "whole", lambda self, chunk: single.append(chunk) or whole(self, chunk))
    text = "Tréier%%% erhere$$$, ANER!! aner tréier. Aner,"
    assert np.frombuffer(own.encode(text), dtype="<u4").tolist() == library_ids([text])[0]
    assert not [c for c in single if any(map(str.isalpha, c))]
    find = token_files.KnownChunks.find
    monkeypatch.setattr(token_files.KnownChunks, "find", lambda self, chunks: looked_up.extend(chunks.to_pylist()) or find(self, chunks))
    assert len(set(own.encode_all(pa.array([text] * 500)))) == 1
    assert sorted(looked_up) == sorted({"tréier", "erhere", "aner", "%%%", "$$$,", "!!", "", ".", ","})


def test_few_kept_chunks_change_nothing(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_CHUNKS", 5)
    own = token_files.ChunkEncoder(tokenizer_path(WORDS), 1)
    texts = scrambled(300, "abcdé ,")
    for t, want in zip(texts, library_ids(texts), strict=True):
        assert np.frombuffer(own.encode(t), dtype="<u4").tolist() == want
        assert len(own.known) <= 6 and len(own.known.old) <= 6


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 49408, n).astype("<u4").tobytes() for n in (1, 127, 128, 129, 5000)]
    docs += [np.array([5, 7, 2**32 - 1] * 100, dtype="<u4").tobytes(), np.full(300, 9, dtype="<u4").tobytes(), np.zeros(0, dtype="<u4").tobytes(), np.array([0, 2**32 - 1], dtype="<u4").tobytes()]
    packed = token_files.pack_documents(docs)
    assert [x.astype("<u4").tobytes() for x in token_files.unpack_documents(packed)] == docs
    assert token_files.read_range(packed[4], 100, 700).tolist() == np.frombuffer(docs[4], dtype="<u4")[100:700].tolist()
    assert token_files.read_range(packed[4], 4990, 9000).tolist() == np.frombuffer(docs[4], dtype="<u4")[4990:].tolist()
    assert len(packed[6]) < 100


def test_files_hold_all_documents_in_order(spark, tmp_path):
    texts = EDGE + ["repeated", "repeated"]
    rows = [(None if i == 3 else 1000 - i, t, 0, "x") for i, t in enumerate(texts)] + [(5, "b", 0, "x"), (5, "a", 0, "x"), (5, "a", 0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, payload string").repartition(3)
    path = f"file://{tmp_path}/ids"
    token_files.write_token_files(df, path, tokenizer_path(WORDS))
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at = [], 0
    for r, ids in zip(ordered, library_ids([r[1] for r in ordered]), strict=True):
        want.append((r[0], at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, token_files.read_digests(spark, path).collect()), key=lambda r: r[1]) == want
    assert sum(len(r.ids) for r in token_files.read_token_files(spark, path).collect()) == at


def test_empty_file_set(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    token_files.write_token_files(frame(spark, []), path, tokenizer_path(WORDS))
    assert token_files.read_digests(spark, path).count() == 0


# --- token counts ---------------------------------------------------------------------------------


def brute_sections(text, rule):
    """Tokens of each line, byte by byte."""
    encoding, lengths = token_counts.vocabulary(tokenizer_path(BYTES))
    text = text or ""
    lines = text.split("\n")
    lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
    owner = [k for k, line in enumerate(lines) for _ in line.encode()]
    counts, at = [0.0] * len(lines), 0
    for token in encoding.encode_ordinary(text):
        size = int(lengths[token])
        own = owner[at : at + size]
        at += size
        for k in {"first": own[:1], "last": own[-1:], "share": own}[rule]:
            counts[k] += 1 / size if rule == "share" else 1
    return lines, counts


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_counts_equal_brute_force(spark, rule):
    texts = EDGE + ["one\ntwo\n\n\n  three\nfour", "\n\n\n", "é\n日本\n\n😀 x"] + scrambled(300, "ab \n\n\té日", 40)
    got = {}
    for r in token_counts.section_counts(frame(spark, texts), tokenizer_path(BYTES), rule=rule).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        lines, counts = brute_sections(t, rule)
        rows = sorted(got[i], key=lambda r: r.section)
        assert [r.n_tokens for r in rows] == pytest.approx(counts)
        assert [(t or "")[r.start : r.end] for r in rows] == lines


def test_field_counts_add_up(spark):
    df = spark.createDataFrame([("Title here", "Body text", 1), (None, "", 2)], "title string, body string, d int")
    r = token_counts.field_counts(df, ["title", "body"], tokenizer_path(BYTES)).orderBy("d").collect()
    encoding, _ = token_counts.vocabulary(tokenizer_path(BYTES))
    assert r[0].n_tokens_title + r[0].n_tokens_body == len(encoding.encode_ordinary("Title here\nBody text"))
    again = token_counts.field_counts(token_counts.field_counts(df, ["title"], tokenizer_path(BYTES)), ["title", "body"], tokenizer_path(BYTES))
    assert again.columns == ["title", "body", "d", "n_tokens_title", "n_tokens_body"] and again.orderBy("d").collect() == r
    with pytest.raises(ValueError):
        token_counts.attribute(np.array([1]), np.array([1]), "other")


def test_sections_of_empty_tables_and_long_texts(spark):
    assert token_counts.section_counts(frame(spark, []), tokenizer_path(BYTES)).count() == 0
    text = "one two three\n" * 40_000 + "end"
    rows = token_counts.section_counts(frame(spark, [text]), tokenizer_path(BYTES)).collect()
    encoding, _ = token_counts.vocabulary(tokenizer_path(BYTES))
    assert len(rows) == 40_001 and sum(r.n_tokens for r in rows) == len(encoding.encode_ordinary(text))


# --- registered queries ---------------------------------------------------------------------------


def test_every_operator_has_one_query():
    names = list(queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13
    assert set(oracle_sql()) <= set(names)
