"""Fixtures and properties of the text, scoring, language and segment functions."""

import re
import textwrap
import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.functions import languages, scoring, text
from quillstone.operators import entities, segments


def one(spark, made, value, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(made(F.col("t")).alias("r")).first()["r"]


def test_cleaning(spark):
    doc = lambda c: text.cleaned(c, F.lit("doc_section"))
    assert one(spark, doc, "\x1b[31mred\x1b[0m  “q” — x…") == 'red "q" - x...'
    assert one(spark, doc, "a\n\n\n\nb") == "a\n\nb"
    assert one(spark, doc, "e\u0301  \t x\x00\x07") == "é x"
    assert one(spark, doc, "") == "" and one(spark, doc, None) is None
    code = lambda c: text.cleaned(c, F.lit("function"), F.lit("py"), comments=False)
    assert one(spark, code, "    x = 1  # note\n    y = 2") == "x = 1 \ny = 2"
    assert one(spark, lambda c: text.without_comments(c, F.lit("sql")), "a -- b\n/* c */ d") == "a  \n  d"


def test_tokens(spark):
    assert one(spark, text.tokens, "foo_1 = 3.14;") == ["foo_1", "=", "3.14", ";"]
    assert one(spark, text.tokens, None) == [] and one(spark, text.tokens, "") == []


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=60), min_size=1, max_size=12))
def test_tokens_and_cleaning_against_plain_python(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    got = {r.i: r for r in df.select("i", text.tokens(F.col("t")).alias("k"), text.dedented(F.col("t")).alias("d"), text.composed(F.col("t")).alias("n")).collect()}
    pattern = re.compile(r"[A-Za-z_]\w*|[0-9]+(?:\.[0-9]+)?|[^\w\s]")
    for i, v in enumerate(values):
        if all(unicodedata.category(c) not in ("Cn", "Co", "Cs") and ord(c) < 0x10000 for c in v):
            assert got[i].k == pattern.findall(v), v
        assert got[i].n == unicodedata.normalize("NFC", v)
        if re.search(r"(?m)^[ \t]", v):
            assert got[i].d == textwrap.dedent(v)


def test_names(spark):
    assert [one(spark, text.language_name, x) for x in (".TSX", "yml", "go", None, "")] == ["typescript", "yaml", "go", None, None]
    made = spark.range(1).select(text.chunk_id(F.lit("a/b-c.d.py"), "function", F.lit("run it"), F.lit(3)).alias("r")).first()["r"]
    assert made == "b_c_d__function__run_it__3"
    assert one(spark, text.stem, "x/.env") == ".env"
    assert one(spark, lambda c: text.preview(c, 3), "abcd") == "abc..." and one(spark, lambda c: text.preview(c, 4), "abcd") == "abcd"
    assert one(spark, text.truth, "YES") is True and one(spark, text.truth, None) is False
    assert one(spark, text.number, "x1") == 0.0 and one(spark, text.number, "2.5") == 2.5
    assert one(spark, text.literal_list, "['a', 'b']") == ["a", "b"] and one(spark, text.literal_list, "nonsense") == []
    assert spark.range(1).select(text.embedding_text(F.lit("f"), F.lit("d"), F.lit("t")).alias("r")).first()["r"] == "f \nd \nt"
    assert spark.range(1).select(text.line_of(F.lit("a\nb\nc"), F.lit(4)).alias("r")).first()["r"] == 3


def test_tags_and_scores(spark):
    assert "deployment" in one(spark, scoring.tags, "specific")
    assert one(spark, scoring.tags, None) == [] and one(spark, scoring.tags, "zzz") == []
    assert one(spark, lambda c: scoring.tags(c, 2), "login logout") == ["auth"]
    score = lambda t, k: spark.range(1).select(scoring.complexity(F.lit(t), F.lit(k)).alias("r")).first()["r"]
    assert score("", 0) == 0.0
    assert score("if x: y", 4) == 0.156
    assert score("if\n" * 900, 5000) == 1.0
    bands = [one(spark, scoring.band, x, "double") for x in (0.0, 0.2, 0.21, 1.0, None)]
    assert bands == [None, "Trivial", "Simple", "Very Complex", None]
    assert one(spark, scoring.public_names, "def run():\n  pass\nclass A:\n  def _x(self): pass\nexport function go()") == ["A", "go", "run"]
    assert one(spark, scoring.depth, "a\n        b\n\tc") == 2
    assert one(spark, lambda c: scoring.has_documentation(c, F.lit(None)), '"""x"""') is True
    assert one(spark, scoring.has_todos, "# todo: x") is True and one(spark, scoring.has_tests, "describe(") is True


def test_words(spark):
    ask = lambda a, c: spark.range(1).select(scoring.overlap(F.lit(a), F.lit(c)).alias("r")).first()["r"]
    assert ask("alpha beta", "alpha gamma") == 0.5 and ask("", "x") == 0.0 and ask(None, None) == 0.0
    kinds = one(spark, scoring.query_tokens, "how 3 tokens ?")
    assert [(k.text, k.kind, k.pos) for k in kinds] == [("how", "stop", 0), ("3", "num", 4), ("tokens", "word", 6), ("?", "punct", 13)]
    shown = spark.range(1).select(scoring.grounded(F.lit("Alpha, is beta!"), F.lit("alpha")).alias("r")).first()["r"]
    assert [(x.text, x.matched) for x in shown] == [("Alpha,", True), ("is", False), ("beta!", False)]


def test_languages(spark):
    tell = lambda t, n=0: tuple(one(spark, lambda c: languages.script_language(c, n), t))
    assert tell("привет") == ("ru", 0.95) and tell("hello") == ("en", 0.5)
    assert tell("short", 20) == ("en", 1.0) and tell(None) == ("en", 1.0)
    gate = lambda lang, conf, kind: spark.range(1).select(languages.translate_gate(F.lit(lang), F.lit(conf), F.lit(kind)).alias("r")).first()["r"]
    assert gate("ru", 0.9, "doc_section") and not gate("ru", 0.5, "doc_section") and not gate("ru", 0.9, "function") and not gate(None, 0.9, "doc_section")


def test_entities(spark):
    def found(t):
        df = spark.createDataFrame([(1, t)], "k int, t string")
        plain = {(r.label, r.text) for r in entities.chunk_entities(df, "k", F.col("t")).collect()}
        placed = df.select(F.explode(entities.entities_with_places(F.col("t"))).alias("e")).select("e.*").collect()
        assert {(r.label, r.text) for r in placed} == plain
        return {r.label: (r.text, r.start, r.end) for r in placed}

    assert found("def run(x):")["FUNC"] == ("run", 0, 7)
    assert found("# TODO: fix me")["TODO"] == ("TODO", 2, 14)
    assert found("v1.2.3")["VERSION"][0] == "1.2.3"
    assert found("class A1\nclass a1")["CLASS"][0] == "A1"
    assert found("run = function() {}")["FUNC"][0] == "run"
    assert found("") == {} and found(None) == {}


def test_segments(spark):
    cut = lambda t, kind: [(s["start_char"], s["end_char"], s["segment_id"], s["text"]) for s in segments.segments.plain(*(__import__("pandas").Series([x]) for x in (t, kind, "c")))[0]]
    assert [x[3] for x in cut("pre\n# A\nx\n# B\ny", "doc")] == ["pre", "# A\nx", "# B\ny"]
    words = " ".join(f"w{i}" for i in range(500))
    assert len(cut(words, "fallback")) == 3 and len(cut("any\n\n# x", "data")) == 1
    assert [x[2] for x in cut("a\n\n\n\nb", "doc")] == ["c__seg_1", "c__seg_2"]
    assert cut("", "doc") == [] and cut(None, "code") == []
    assert [x[3] for x in cut("import a\ndef f():\n  pass\nclass B:\n  pass", "code")] == ["import a", "def f():\n  pass", "class B:\n  pass"]
    windows = one(spark, segments.word_windows, words)
    assert [len(w.split()) for w in windows] == [250, 250, 100]
    assert one(spark, segments.paragraphs, "a\n \n\nb\n") == ["a", "b"]
    assert segments.similarity_spans("A b. C d. E f.", [0.9, 0.1]) == [(0, 10), (10, 14)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n#dej.", max_size=200), st.sampled_from(["doc", "code", "fallback", "data"]))
def test_spans_cover_the_words(value, kind):
    found = segments.spans(value, kind)
    covered = "".join(value[a:b] for a, b in found)
    assert all(w in covered for w in value.split())
    assert all(a < b or not value for a, b in found)
