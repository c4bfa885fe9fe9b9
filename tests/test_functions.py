"""Small cases of the column functions and parsers.

Inputs and expected values are fixed values of the domain, given with it.
"""

import pytest
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import dates, json_ops, paths, text, vectors
from tessera.sources import parsers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def t(value):
    return F.lit(value)


def terms(query):
    return text.tokens(F.lit(query))


def test_keyword_score_counts_contained_terms(spark):
    assert one(spark, text.keyword_score(t("Gradient descent optimizes LOSS"), terms("gradient loss"))) == 1.0
    assert one(spark, text.keyword_score(t("a party"), terms("art art x"))) == pytest.approx(2 / 3)
    assert one(spark, text.keyword_score(t("x"), terms("  "))) is None


def test_rerank_prefers_the_phrase(spark):
    assert one(spark, text.rerank_score(t("the quick fox"), t("quick fox"))) == 1.0
    assert one(spark, text.rerank_score(t("fox is quick"), t("quick fox zebra"))) == pytest.approx(2 / 3)
    assert one(spark, text.rerank_score(t("anything"), t("   "))) == 0.0


def test_snippets(spark):
    cut = one(spark, text.citation_snippet(t("word " * 100)))
    assert cut.endswith("...") and len(cut) <= 163
    assert one(spark, text.search_snippet(t("a" * 241))) == "a" * 240 + "…"
    assert one(spark, text.citation_snippet(t("  short "))) == "short"


def test_near_duplicate_needs_containment_and_length(spark):
    assert one(spark, text.near_duplicate(t("a" * 100), t("a" * 90)))
    assert not one(spark, text.near_duplicate(t("a" * 100), t("a" * 89)))
    assert not one(spark, text.near_duplicate(t(""), t("")))


def test_latex_slug_highlight_fence(spark):
    assert one(spark, text.latex_delimiters(t(r"a \[ x^2 \] b \( y \) \(  \)"))) == r"a $$x^2$$ b $y$ \(  \)"
    assert one(spark, text.slug(t("  Hello, World - 2  "))) == "hello-world---2"
    assert one(spark, text.highlight_parts(t("aXbxc"), "x")) == ["a", "X", "b", "x", "c"]
    assert one(spark, text.without_fence(t('```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert one(spark, text.first_object(t('so: {"a": "}", "b": {"c": 1}} end'))) == '{"a": "}", "b": {"c": 1}}'
    for given, want in (
        ('[{"a":1},{"b":2}]', '[{"a":1},{"b":2}]'), ('{"a":1} and {"b":2}', '{"a":1}'), ('say {"a":"{\\"}"} x', '{"a":"{\\"}"}'), ("} {x} {y}", "} {x} {y}"), ("} {{y}", "{y}"), ('{"open', '{"open'),
        ('"{" {z}', "{z}"), ("12 13", "12 13"), ("é{ö}ü", "{ö}"), ("", ""), ('"\\', '"\\'), ("{{}", "{{}"), ("```\n[1, 2]\n```", "[1, 2]"),
    ):
        assert one(spark, text.json_text(t(given))) == want, given


def test_budget_and_counts(spark):
    assert one(spark, text.context_budget(t(8192))) == 4096
    assert one(spark, text.context_budget(t(500))) == 0
    assert one(spark, text.token_count(t(" a b  c "))) == 3
    assert one(spark, text.looks_like_text(t("plain words"))) and not one(spark, text.looks_like_text(t("\u0001\u0002\u0003x")))


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("Published: 2023-06-14", "2023-06-14"),
        ("Published on June 14, 2023", "2023-06-14"),
        ("Date: 14 June 2023", "2023-06-14"),
        ("Published: 06/14/2023", None),
        ("Published under a licence", None),
        ("no label 2023-06-14", None),
        ("published soon, published 3rd Sept. 2020 by", "2020-09-03"),
        ("date: 2023-02-31", "2023-02-31"),
        ("date: 1850-01-01", None),
    ],
)
def test_authored_date(spark, given, want):
    assert one(spark, dates.authored_date(t(given))) == want


def test_other_dates(spark):
    assert one(spark, dates.pdf_date(t("D:20230614153000-05'00'"))) == "2023-06-14"
    assert one(spark, dates.pdf_date(t("D:2023"))) is None
    assert one(spark, dates.iso_time(t(0))) == "1970-01-01T00:00:00Z"
    assert one(spark, dates.iso_time(t(9_000_000 * 86_461))) == "26628-07-24T04:00:00Z"
    assert one(spark, dates.iso_time(t(-1_000_000 * 86_461))) == "-770-02-27T23:33:20Z"
    assert one(spark, dates.iso_time(t(-62_000_000_000))) == "0005-04-19T09:46:40Z"


def test_vectors(spark):
    a = F.array(*[F.lit(float(x)) for x in (1, 0)])
    assert one(spark, vectors.cosine(a, F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)))) == 0.0
    assert one(spark, vectors.cosine(a, a)) == 1.0
    for size, want in (("8B", 8.0), ("270m", 0.27), ("70.6B", 70.6), ("x", None), ("", None)):
        assert one(spark, vectors.billions(t(size))) == want


def test_hash_embedding_has_length_one(spark):
    import hashlib

    df = spark.createDataFrame([(1, "Some words some WORDS more")], "id long, text string")
    rows = {r.bucket: r.weight for r in vectors.hash_embedding(df, "id", "text").collect()}
    want = {}
    for w in "some words some words more".split():
        h = hashlib.sha256(w.encode()).hexdigest()
        want[int(h[:8], 16) % 128] = want.get(int(h[:8], 16) % 128, 0) + (1 if int(h[8:16], 16) % 2 == 0 else -1)
    norm = sum(v * v for v in want.values()) ** 0.5
    assert rows == pytest.approx({k: v / norm for k, v in want.items() if v})


def test_paths(spark):
    assert one(spark, paths.file_type(t("a.b/C.HTM"))) == "html"
    assert one(spark, paths.file_type(t("x/photo.JPeg"))) == "image"
    assert one(spark, paths.file_type(t("x/README"))) is None
    assert one(spark, paths.relative(t("/root/x\\y.md"), "/root")) == "x/y.md"
    assert not one(spark, paths.is_safe(t("a/../b"))) and one(spark, paths.is_safe(t("a/..b")))
    assert one(spark, paths.folders(t("a/b/c.md"))) == ["a", "a/b"]
    assert one(spark, paths.is_hidden(t("a/.git/x"))) and not one(spark, paths.is_hidden(t("a/b.c")))
    assert one(spark, paths.mime(t("a.md"))) == "text/markdown"


def test_json(spark):
    assert one(spark, json_ops.context_length(t('{"a.x": 1, "llama.context_length": 8192}'))) == 8192
    assert one(spark, json_ops.context_length(t("{}"))) == 4096
    caps = json_ops.capabilities(F.array(F.lit("Tools")), F.array(F.lit("nomic-bert"), F.lit("clip")))
    assert one(spark, caps) == ["TextGeneration", "Tools", "Vision", "Embedding"]
    assert one(spark, json_ops.payload_long(t('{"workspace_id": 3}'), "workspace_id")) == 3
    assert one(spark, json_ops.payload_long(t('{"workspace_id": "x"}'), "workspace_id")) is None
    quiz = json_ops.parsed(t('{"questions": [{"question": "q", "options": ["a"], "correct_index": 0}, {"question": "r", "options": [], "correct_index": 0}]}'), "quiz")
    assert len(one(spark, json_ops.valid_questions(quiz["questions"]))) == 1


def test_markdown_blocks():
    got = parsers.parse_markdown("# Title\n\nSome intro text.\n  More of it.\n\n## Section\n```rs\nfn main() {}\n```\nEnd\n```\nopen")
    assert got == [("Heading", "1", "Title"), ("Paragraph", "3", "Some intro text. More of it."), ("Heading", "6", "Section"), ("Code", "7", "fn main() {}"), ("Paragraph", "10", "End"), ("Code", "11", "open")]


def test_text_blocks_at_their_lines(spark):
    import random

    def plain(text):
        out, fresh = [], True
        for no, raw in enumerate(text.split("\n"), 1):
            line = raw.strip()
            if not line:
                fresh = True
            elif fresh:
                out.append([str(no), line])
                fresh = False
            else:
                out[-1][1] += " " + line
        return [tuple(x) for x in out]

    rng = random.Random(6)
    texts = ["".join(rng.choice(["a", "b c", " ", "\n", "\n", "\r\n", "\t", "\u2003", "é"]) for _ in range(rng.choice([0, 3, 30, 400]))) for _ in range(150)]
    texts += ["\n\n x", "x\n\n\n", "\n", "a\n \n\n  b\r\n\r\nc", "p\n\n" * 20_000 + "q"]
    got = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", parsers.text_blocks(F.col("t")).alias("b")).collect()
    for r in got:
        assert [(b.page_or_location, b.text_content) for b in r.b] == plain(texts[r.i]), texts[r.i][:100]
    assert one(spark, parsers.text_blocks(F.lit(None).cast("string"))) is None


def test_text_blocks(spark):
    got = one(spark, parsers.text_blocks(t("First paragraph,\nstill first.\n\n \nSecond paragraph.\n")))
    assert [tuple(r) for r in got] == [("Paragraph", "1", "First paragraph, still first."), ("Paragraph", "5", "Second paragraph.")]


def test_html_blocks():
    kinds = lambda page: [b[0] for b in parsers.parse_html(page)]
    assert kinds("<h1>T</h1><p>x</p>") == ["Heading", "Paragraph"]
    assert kinds("<script>var a='<p>'</script><style>p{}</style><p>x</p>") == ["Paragraph"]
    assert kinds("a<br>b") == ["Paragraph", "Paragraph"]
    assert kinds("<p>a</p><table class=x><tr><td>1</td></tr></table><p>b</p>") == ["Paragraph", "Table", "Paragraph"]
    assert kinds("<img src=a>") == ["Image"] and kinds('<img class="formula" src=a>') == ["Equation"]
    assert kinds("<p>a</p><math><mi>x</mi></math><p>b</p>") == ["Paragraph", "Equation", "Paragraph"]
    assert parsers.parse_html("<p>Fish &amp; Chips &mdash; caf&#39;e")[0][2] == "Fish & Chips &mdash; caf'e"
    assert parsers.decode_entities("&amp;lt;") == "<"


def test_docx_blocks():
    import io
    import zipfile

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    xml = f"<w:document {w}><w:body><w:p><w:r><w:t>One &amp; two</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:t>a</w:t></w:p></w:tc><w:tc><w:p><w:t>b</w:t></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", xml)
    assert parsers.parse_docx(held.getvalue()) == [("Paragraph", "1", "One & two"), ("Table", "2", "a | b")]
    assert parsers.parse_docx(b"no zip") == [("Image", "1", "")]


def test_schema_checks(spark):
    errors = schemas.setting_errors(t("k"), t("number"), t("workspace"), F.lit(None).cast("long"))
    assert one(spark, errors) == ["workspace scope without workspace"]
    assert one(spark, schemas.checked(t("queued"), "job_status")) == "queued"
    with pytest.raises(Exception, match="unknown job_status"):
        one(spark, schemas.checked(t("lost"), "job_status"))
    assert len(schemas.TABLES) == 18
