"""Files, parsers, ranking, vectors, feedback and evaluation on small inputs, empty and odd ones included."""

import json
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import analytics, evaluation, feedback, parsers, ranking, vectors
from quillstone.plans.pipeline import STEPS, enrich
from quillstone.sources import files, records


def test_classes(spark):
    want = {
        "src/a.py": ("code", "python", "python"), "web/App.TSX": ("code", "typescript", "treesitter"), "requirements.txt": ("doc", "text", "text"), "Dockerfile": ("infra", "dockerfile", "dockerfile"),
        "Makefile": ("infra", "makefile", "makefile"), "x.unknown": ("code", "unknown", "generic_text"), "LICENSE": ("code", "unknown", "generic_text"), None: (None, None, None),
    }
    df = spark.createDataFrame([(p, "clash") for p in want], "path string, language string")
    got = {r.path: (r.file_type, r.language, r.parser_key) for r in files.classify(df).collect()}
    assert got == want
    assert files.classify(df.limit(0)).count() == 0
    out = spark.createDataFrame([(p,) for p in (".env", "a.min.js", "package-lock.json", "img.png", "node_modules/x.js", "go.sum", ".env.other", "build.py", "a/b.py")], "p string")
    got = {r.p: r.s for r in out.select("p", files.skipped(F.col("p")).alias("s")).collect()}
    assert {k for k, v in got.items() if v is None} == {"build.py", "a/b.py"}
    assert got["node_modules/x.js"] == "folder"


def test_decoding(spark):
    raw = [b"\xef\xbb\xbfabc", b"a\x00b", b"\xff\xfeab", None, b""]
    got = [r.t for r in spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, c binary").orderBy("i").select(files.decoded(F.col("c")).alias("t")).collect()]
    assert got[0] == "abc" and got[1] is None and got[2].endswith("ab") and got[3] is None and got[4] == ""


def test_scan(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.py").write_text("x = 1\n")
    (tmp_path / "big.py").write_bytes(b"x" * 600_000)
    assert [r.path.rsplit("/", 1)[1] for r in files.scan_tree(spark, str(tmp_path)).collect()] == ["a.py"]


def cut(spark, text, key, ext=""):
    df = spark.createDataFrame([(text,)], "t string")
    return [r.asDict() for r in df.select(F.explode(parsers.pieces(F.col("t"), F.lit(key), F.lit(ext))).alias("p")).select("p.*").collect()]


def test_parsers(spark):
    blocks = cut(spark, "\n".join(f"l{i}" for i in range(130)), "generic_code")
    assert [(b["start_line"], b["end_line"], b["name"]) for b in blocks] == [(1, 60, "__block__1"), (61, 120, "__block__2"), (121, 130, "__block__3")]
    md = cut(spark, "lost\n# A\nx\n## B\ny", "markdown")
    assert [(p["name"], p["start_line"], p["end_line"], p["extra"]["heading_level"]) for p in md] == [("A", 2, 3, "1"), ("B", 4, 5, "2")]
    assert [p["name"] for p in cut(spark, "one\n\n \n\ntwo", "text")] == ["p0", "p1"]
    assert [p["name"] for p in cut(spark, "T\n===\nx\nU\n---\ny\n", "rst")] == ["T", "U"]
    assert [p["name"] for p in cut(spark, "# c\nFROM a\nRUN b\n", "dockerfile")] == ["FROM", "RUN"]
    assert [p["name"] for p in cut(spark, "all: x\n\tgo\nV := 1\n", "makefile")] == ["all", "V"]
    batches = cut(spark, "h1,h2\n" + "a,b\n" * 120, "csv")
    assert [(b["start_line"], b["extra"]["row_count"]) for b in batches] == [(2, "50"), (52, "50"), (102, "20")]
    assert cut(spark, "h1,h2\n", "csv")[0]["extra"]["row_count"] == "0"
    assert json.loads(cut(spark, "a\tb\n1\t2\n", "csv", ".tsv")[0]["extra"]["columns"]) == ["a", "b"]
    assert [p["name"] for p in cut(spark, '{"a": 1, "b": [2]}', "json")] == ["a", "b"]
    assert cut(spark, "[]", "json")[0]["content"] == "[]" and cut(spark, "{broken", "json")[0]["chunk_type"] == "code_block"
    assert cut(spark, "3", "json")[0]["name"] == "root"
    assert [p["name"] for p in cut(spark, "a: 1\nb:\n  c: 2\n", "yaml")] == ["a", "b"] and [p["name"] for p in cut(spark, "[a]\nx = 1\n", "toml")] == ["a"]
    assert [p["name"] for p in cut(spark, "<r><a id='q'/><b/></r>", "xml")] == ["q", "b"]
    sql = cut(spark, "-- note\nCREATE TABLE t(a int);", "sql")
    assert (sql[0]["name"], sql[0]["chunk_type"]) == ("t", "sql_note")
    sh = cut(spark, "# a\n# b\n# c\nf() {\n  x\n}\n", "shell")
    assert [(p["chunk_type"], p["start_line"]) for p in sh] == [("shell_function", 4), ("shell_comment", 1)]
    css = cut(spark, ":root { --a: 1; }\na:hover { color: red; }\n@media x { b { c: d } }", "css")
    assert [p["chunk_type"] for p in css] == ["css_variables", "pseudo_rule", "pseudo_rule", "media_query"]
    py = cut(spark, "import os\nclass A:\n    '''d'''\n    def m(self, x) -> int:\n        pass\ndef f(): pass\n", "python")
    assert [(p["chunk_type"], p["name"], p["parent"], p["parameters"], p["return_type"]) for p in py] == [("class", "A", None, [], None), ("function", "f", None, [], None), ("method", "m", "A", ["x"], "int")]
    assert cut(spark, "def broken(:\n", "python")[0]["chunk_type"] == "code_block"
    page = cut(spark, "<html><body><script>a()</script><nav id=n>go</nav><p>text</p></body></html>", "html")
    assert [(p["chunk_type"], p["name"]) for p in page] == [("script_block", "inline_script"), ("html_section", "n"), ("html_text", "body_text")]
    nb = {"cells": [{"cell_type": "code", "source": ["a\n", "b"], "outputs": [{"text": ["o"]}]}, {"cell_type": "markdown", "source": " "}, {"cell_type": "markdown", "source": "m"}]}
    cells = cut(spark, json.dumps(nb), "notebook")
    assert [(p["name"], p["content"], p["extra"]["output_preview"]) for p in cells] == [("Cell 1 (code)", "a\nb", "o"), ("Cell 3 (markdown)", "m", "")]
    for key in ("python", "markdown", "json", "notebook", "generic_text"):
        assert cut(spark, "", key) == [] and cut(spark, None, key) == [] and cut(spark, " \n ", key) == []


def test_parse_keeps_keys_and_survives_nulls(spark):
    rows = [(1, "a.py", b"def f(): pass\n"), (2, None, b"x"), (3, "b.md", None), (4, "c.bin", b"\x00\x01")]
    df = files.classify(spark.createDataFrame(rows, "file_id long, path string, content binary"))
    got = parsers.parse(df).collect()
    assert {(r.file_id, r.chunk_id) for r in got} == {(1, "a__function__f__1"), (2, "block____block__1__1")}
    assert parsers.parse(df.limit(0)).count() == 0


def test_ranking(spark):
    df = spark.createDataFrame([("a", 1), ("a", 150_000), ("a", 250_000), ("b", 7), (None, 9)], "k string, i long")
    got = {(r.k, r.i): r.n for r in ranking.numbered(df, ["k"], "i", "n").collect()}
    assert got == {("a", 1): 1, ("a", 150_000): 2, ("a", 250_000): 3, ("b", 7): 1, (None, 9): 1}
    vals = spark.createDataFrame([("a", 1, 1.0), ("a", 150_000, -1.0), ("a", 250_000, 1.0), ("a", 250_001, None), ("b", 1, None)], "k string, i long, v double")
    got = {(r.k, r.i): r.m for r in ranking.running_mean(vals, ["k"], "i", F.col("v"), "m").collect()}
    assert got[("a", 1)] == 1.0 and got[("a", 150_000)] == 0.0 and round(got[("a", 250_000)], 4) == 0.3333 == round(got[("a", 250_001)], 4) and got[("b", 1)] is None
    twice = spark.sql("select 1 id, timestamp'2024-01-01' t, 'old' v union all select 1, timestamp'2024-02-01', 'new' union all select 2, null, 'x'")
    assert {(r.id, r.v) for r in ranking.latest(twice, ["id"], "t").collect()} == {(1, "new"), (2, "x")}
    assert ranking.latest(twice.limit(0), ["id"], "t").count() == 0


def test_search_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    x[5] = x[6]
    rows = [(i, [float(v) for v in x[i]], "ab"[i % 2]) for i in range(300)] + [(900, [0.0] * 8, "a"), (901, None, "a"), (902, [], "b"), (903, [float("nan")] * 8, "a"), (904, [1.0, 2.0], "a")]
    df = spark.createDataFrame(rows, "id long, vec array<double>, g string")
    monkeypatch.setattr(vectors, "BLOCK", 7)
    asked = df.where("id % 20 = 0 and id < 900").select(F.col("id").alias("qid"), "vec", "g")
    got = {}
    for r in vectors.search(df, asked, 4, group="g").collect():
        got.setdefault(r.qid, []).append((r["rank"], r.id))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 300, 20):
        d = sorted((round(1 - float(u[q] @ u[j]), 12), j) for j in range(300) if j % 2 == q % 2)[:4]
        assert [i for _, i in sorted(got[q])] == [j for _, j in d]
    assert vectors.search(df, asked.limit(0), 3).count() == 0 and vectors.search(df.limit(0), asked, 3).count() == 0


def test_network(spark):
    rng = np.random.default_rng(1)
    rows = [([float(v) for v in rng.normal(size=4)], [float(v) for v in rng.normal(size=4)], float(rng.choice([-1, 1]))) for _ in range(60)] + [([1.0], [1.0] * 4, 1.0), (None, None, None)]
    df = spark.createDataFrame(rows, "qvec array<double>, vec array<double>, reward double").repartition(3)
    net, errors = vectors.train(df, 8, steps=5, rate=0.01)
    assert len(errors) == 5 and errors[-1] < errors[0]
    whole, more = vectors.train(df.coalesce(1), 8, steps=5, rate=0.01)
    assert np.allclose(errors, more)
    # one gradient by small differences
    fresh = vectors.new_network(8)
    one = [np.concatenate([rows[k][0], rows[k][1]]) for k in range(60)]
    loss = lambda n: float(np.mean([(vectors.network_scores(n, v[None])[-1][0, 0] - rows[k][2]) ** 2 for k, v in enumerate(one)]))
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[:60]]) for i in range(3)], ["q", "v", "r"])
    out = next(vectors._gradients(fresh, 8)(iter([batch])))
    flat = np.frombuffer(out.column(2)[0].as_py()) / 60
    bumped = [w.copy() for w in fresh]
    bumped[0][2, 5] += 1e-5
    assert abs((loss(bumped) - loss(fresh)) / 1e-5 - flat[2 * 256 + 5]) < 1e-3
    pairs = spark.createDataFrame([(1, 10 + k, 0.1 * k, rows[k][0], rows[k][1]) for k in range(6)], "qid long, id long, distance double, qvec array<double>, vec array<double>")
    best = vectors.rerank(vectors.scores(pairs, net)).orderBy("rank").collect()
    assert len(best) == 3 and best[0].score >= best[1].score >= best[2].score
    assert vectors.train(df.limit(0), 8)[1] == []


def test_terms_and_axes(spark):
    df = spark.createDataFrame([(1, ["Ab", "ab", "cd", "x"]), (2, ["cd"]), (3, []), (4, None)], "k long, t array<string>")
    got = {r.term: (r.df, round(r.idf, 6)) for r in vectors.terms(df, "t").collect()}
    assert got == {"ab": (1, round(float(np.log(5 / 2) + 1), 6)), "cd": (2, round(float(np.log(5 / 3) + 1), 6))}
    lengths = vectors.term_vectors(df, "k", "t").groupBy("k").agg(F.sum(F.col("weight") ** 2).alias("s")).collect()
    assert {r.k: round(r.s, 9) for r in lengths} == {1: 1.0, 2: 1.0}
    vocabulary = [(r.term, r.idf) for r in vectors.terms(df, "t").orderBy("term").collect()]
    made = {r.k: r.v for r in df.select("k", vectors.term_embedding(vocabulary)(F.col("t")).alias("v")).collect()}
    known = {(r.k, r.term): r.weight for r in vectors.term_vectors(df, "k", "t").collect()}
    assert np.allclose(made[1], [known[1, "ab"], known[1, "cd"]]) and made[3] == made[4] == []
    x = np.random.default_rng(0).normal(size=(50, 3)) * [5, 2, 0.1]
    placed, share = vectors.principal_axes(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "k long, v array<double>"), "k", "v")
    assert placed.columns == ["k", "x", "y"] and share[0] > share[1] > 0 and placed.count() == 50


def test_feedback(spark):
    rows = [
        (1, " Alpha ", "q", "[1.0, 2.0]", '["c1", "c1", "zz"]', 1.0, "2024-03-07T19:04:23.471028", "2024-03-08 00:00:00"),
        (1, " Alpha ", "q", "[1.0, 2.0]", '["c1", "c1", "zz"]', 1.0, "2024-03-07T19:04:23.471028", "2024-04-08 00:00:00"),
        (2, "alpha", "q", "[broken", None, -1.0, "03.10.2024 05:33", "2024-03-08 00:00:00"),
        (3, None, None, None, "not json", None, "1709838263", "2024-03-08 00:00:00"),
        (None, "alpha", "q", None, None, 1.0, None, "2024-03-08 00:00:00"),
    ]
    log = spark.createDataFrame(rows, "id long, project_name string, query string, query_vector string, selected_chunk_ids string, reward double, timestamp string, ingested_at string").withColumn("ingested_at", F.col("ingested_at").cast("timestamp"))
    got = feedback.cleaned(log)
    by = {r.id: r for r in got.collect()}
    assert by[1].chunk_ids == ["c1", "zz"] and by[2].qvec is None and str(by[2].moment) == "2024-10-03 05:33:00" and by[3].moment is not None
    figures = {r.project: (r.n, r.mean_reward, r.praised, r.blamed) for r in feedback.figures(got, "project").collect()}
    assert figures == {"alpha": (2, 0.0, 1, 1), None: (1, 0.0, 0, 0)}
    chunks = spark.createDataFrame([(7, "Alpha", "c1", [1.0], "f.py"), (5, "alpha", "c1", [2.0], "g.py"), (9, None, None, None, None)], "chunk_key long, project string, chunk_id string, embedding array<float>, source_file string")
    assert [(r.id, r.chunk_key) for r in feedback.examples(got, chunks).collect()] == [(1, 5)]
    assert feedback.cleaned(log.limit(0)).count() == 0
    assert [r.id for r in feedback.last_of(got, ["project"], F.col("id"), 1).orderBy("id").collect()] == [2, 3]


def test_feedback_as_a_stream(spark, tmp_path):
    from quillstone.streaming.feedback import follow

    rows = [(i % 40, f"P{i % 3}", 1.0 if i % 2 else -1.0, "2024-03-08 00:00:00") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, project_name string, reward double, t string").select("id", "project_name", "reward", F.col("t").cast("timestamp").alias("ingested_at"))
    df.repartition(5).write.parquet(str(tmp_path / "log.parquet"))
    got = {r.project: r.n for r in follow(spark, str(tmp_path / "log.parquet"), 2).collect()}
    assert sum(got.values()) == 40 and set(got) == {"p0", "p1", "p2"}


def test_evaluation(spark):
    df = spark.createDataFrame([(x,) for x in ("Senior Engineer", "ML lead", "", None, "Project Manager", " Tester ", "Data Science")], "r string")
    assert [x.k for x in df.select(evaluation.role(F.col("r")).alias("k")).collect()] == ["developer", "data scientist", "user", "user", "project manager", "tester", "data scientist"]
    hits = spark.createDataFrame([(1, 2, "d/b.py", "B"), (1, 1, "a.py", "A"), (2, 1, None, None)], "qid long, rank int, source_file string, content string")
    got = {r.qid: r for r in evaluation.contexts(hits).collect()}
    assert got[1].context == "--- SOURCE 1: a.py ---\nA\n\n--- SOURCE 2: b.py ---\nB".replace("b.py", "d/b.py") and got[1].sources == "a.py, b.py"
    total = evaluation.summary(evaluation.contexts(hits).select("sources", "source_count")).first()
    assert (total.questions, total.files, total.passed) == (2, 2, True)


def test_figures(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 10), (None, None)], "k string, v int")
    assert {(r.bin, r.n) for r in analytics.histogram(df, F.col("v"), 3).collect()} == {(0, 2), (2, 1)}
    assert analytics.histogram(df.limit(0), F.col("v")).count() == 0
    q = {r.k: (r.q1, r["median"], r.q3) for r in analytics.quartiles(df, "k", "v").collect()}
    assert q["a"] == (1.5, 2.0, 2.5)
    assert analytics.matching(df, "A", ["k"]).count() == 2
    assert analytics.most_frequent_kinds(df, "k", 1).count() == 2


def test_pipeline(spark):
    rows = [(1, "c1", "def run():\n    return 1  # TODO: x", "function", "py", None), (2, "c2", "# Head\nПривет, дорогой мир, как дела", "doc_section", "md", "d"), (3, "c3", "", "function", None, None), (4, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "chunk_key long, chunk_id string, content string, chunk_type string, language string, docstring string").withColumn("tags", F.lit("clash"))
    out = {r.chunk_key: r for r in enrich(df).collect()}
    assert len(out) == 4 and out[1].has_todos and out[1].api_surface == ["run"] and out[2].detected_lang == "ru" and out[2].normalized_lang == "markdown"
    assert out[1].embedding_dim > 0 and out[3].embedding_dim == 0 and out[4].tags == []
    assert "embedding" not in enrich(df, skip=("embed",)).columns and enrich(df.limit(0)).count() == 0
    kept = enrich(df, skip=tuple(s for s in STEPS if s != "clean"))
    assert "entities" not in kept.columns
    said = enrich(df, skip=("embed",), translate=lambda t, lang: F.concat(lang, F.lit(":"), F.length(t).cast("string"))).where("chunk_key = 2").first()
    assert said.is_translated and said.translated_text.startswith("ru:")
    with pytest.raises(ValueError, match="no such step"):
        enrich(df, skip=("nothing",))


def test_records(spark, tmp_path):
    lines = tmp_path / "c.jsonl"
    lines.write_text('{"chunk_id": "a", "content": "x", "other": 1}\n\n{"chunk_id": "b", "extra": {"k": "v"}}\n')
    assert [r.chunk_id for r in records.read_chunks(spark, str(lines)).where("chunk_id is not null").collect()] == ["a", "b"]
    whole = tmp_path / "c.json"
    whole.write_text('[{"chunk_id": "a"}, {"chunk_id": "b"}]')
    got = records.read_chunks(spark, str(whole))
    assert got.count() == 2 and len(got.columns) == 15
    records.write_chunks(got, str(tmp_path / "out"), "jsonl")
    assert spark.read.schema(records.CHUNK).json(str(tmp_path / "out")).count() == 2
    store = spark.createDataFrame([("a", "p", [1.0]), ("b", "q", [2.0])], "id string, project string, vec array<float>")
    records.write_collection(store, str(tmp_path / "col"))
    assert [r.project for r in records.projects_of(spark, str(tmp_path / "col")).collect()] == ["p", "q"]
    log = spark.createDataFrame([(1, [0.5], ["c"], Decimal("1"))], "id long, query_vector array<double>, selected_chunk_ids array<string>, reward decimal(3,1)")
    records.append_feedback(log, str(tmp_path / "log"))
    records.append_feedback(log, str(tmp_path / "log"))
    assert [json.loads(r.query_vector) for r in spark.read.parquet(str(tmp_path / "log")).collect()] == [[0.5], [0.5]]
    assert records.with_columns_of(store, store.withColumn("x", F.lit(1))).count() == 4


def test_feedback_stream_counts_late_entries_of_many_files(spark, tmp_path):
    """Files far out of order in time, more of them than a batch takes, with a repeat a year later."""
    from quillstone.streaming.feedback import follow

    path = str(tmp_path / "log.parquet")
    for n, month in enumerate((12, 11, 1, 2, 10, 3, 1)):
        log = spark.createDataFrame([(n, "p", 1.0, f"2024-{month:02d}-05 00:00:00"), (0, "p", 1.0, f"2024-{month:02d}-06 00:00:00")], "id long, project_name string, reward double, at string")
        log.select("id", "project_name", "reward", F.to_timestamp("at").alias("ingested_at")).coalesce(1).write.mode("append").parquet(path)
    assert [(r.project, r.n) for r in follow(spark, path, 1).collect()] == [("p", 7)]


def test_latest_of_wide_rows_and_ties(spark):
    from quillstone.operators.ranking import latest, latest_wide

    rows = [(1, "2024-01-01", "a"), (1, "2024-01-02", "b"), (2, None, "c"), (2, "2024-01-01", "d"), (3, "2024-01-01", "e"), (None, "2024-01-01", "f"), (None, "2024-01-02", "g"), (4, "2024-01-01", "h"), (4, "2024-01-01", "i"), (4, "2024-01-01", "i")]
    df = spark.createDataFrame(rows, "k long, at string, v string").repartition(3)
    want = {tuple(r) for r in latest(df, ["k"], "at").collect()}
    assert {r[0] for r in want} == {1, 2, 3, 4, None} and len(want) == 5
    for most in (0, 1, 100):
        got = [tuple(r) for r in latest_wide(df, ["k"], "at", most).collect()]
        assert set(got) == want and len(got) == 5
    assert {tuple(r) for r in latest(df.repartition(1), ["k"], "at").collect()} == want
    assert latest_wide(df.limit(0), ["k"], "at").count() == 0


def test_placed_matches_and_style_sheets(spark):
    from quillstone.operators import parsers

    css = ":root { --a: 1px;\n--b: red; }\n/* c */\n.a:hover {\n  color: red;\n  // x: y\n}\n@media (x) {\n .b { c: d; }\n}\n"
    sh = "#!/bin/sh\n# a\n# b\nfoo() {\n  echo hi\n}\nfunction bar() { x; }\n"
    sql = "-- c\nCREATE TABLE t (a int);\n\nSELECT 1\nFROM t;\n"
    py = "import os\nfrom a.b import c\nclass A:\n  def f(self, x) -> int:\n    def g(): pass\n    return 1\nasync def h(): pass\n"
    df = spark.createDataFrame([("css", css), ("shell", sh), ("sql", sql), ("python", py), ("css", "no rule"), ("sql", None)], "k string, t string")
    made = df.select("k", F.explode(parsers.pieces(F.col("t"), F.col("k"), F.lit(""))).alias("p")).select("k", "p.*").collect()
    short = [(r.k, r.chunk_type, r.name, r.start_line, r.end_line) for r in made]
    assert short == [
        ("css", "css_variables", "CSS Variables", 1, None), ("css", "pseudo_rule", ":root", 1, 3), ("css", "pseudo_rule", ".a:hover", 3, 5), ("css", "media_query", "@media (x)", 7, 8),
        ("shell", "shell_function", "foo", 4, 7), ("shell", "shell_function", "bar", 7, 8), ("shell", "shell_comment", "Comment L1", 1, None),
        ("sql", "sql_c", "t", 1, 2), ("sql", "sql_select", "stmt_2", 4, 5),
        ("python", "class", "A", 3, 6), ("python", "function", "h", 7, 7), ("python", "method", "f", 4, 6), ("python", "function", "g", 5, 5), ("css", "code_block", "__block__1", 1, 1),
    ]
    assert made[1].extra == {"properties": '["--a: 1px;", "--b: red;"]', "prop_count": "2"} and made[11].parent == "A" and made[11].parameters == ["x"] and made[11].return_type == "int" and made[9].imports == ["a.b", "os"]


def test_embedding_functions(spark):
    from quillstone.plans import pipeline

    def fails(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return [[1.0, len(t)] for t in texts]

    assert pipeline.choose_backend("auto", {"cohere": fails, "openai": fails}) == "openai" and pipeline.choose_backend("other", {"cohere": fails}) == "tfidf" and pipeline.choose_backend("auto", {}) == "tfidf"
    df = spark.createDataFrame([(k, "bad" if k == 70 else "fine") for k in range(100)], "k int, content string").withColumn("cleaned_text", F.lit(None).cast("string")).coalesce(1)
    rows = {r.k: r for r in pipeline.embed_with(df, "mine", fails).collect()}
    assert rows[3].embedding == [1.0, 4.0] and rows[3].embedding_model == "mine" and {k for k, r in rows.items() if r.embedding_dim == 0} == set(range(64, 100))


def test_saved_networks_and_default_project(spark, tmp_path):
    from quillstone.sources.records import default_project, write_collection

    net = vectors.new_network(6)
    vectors.save_network(spark, net, str(tmp_path / "net"))
    again = vectors.load_network(spark, str(tmp_path / "net"))
    assert all((a == b).all() and a.shape == b.shape for a, b in zip(net, again)) and len(net) == len(again)
    write_collection(spark.createDataFrame([(1, "b"), (2, "a")], "id long, project string"), str(tmp_path / "c"))
    assert default_project(spark, str(tmp_path / "c")) == "a"


def test_similarity_segments_and_query_helpers(spark):
    from quillstone.functions import languages, scoring
    from quillstone.operators import entities, segments

    text = "The cache is warm. The cache is warm today. Nothing else here! Ok then."
    row = spark.createDataFrame([(text,)], "t string").select(segments.similarity_cuts(F.col("t"), 0.5).alias("c"), segments.neighbour_similarities(segments.sentences(F.col("t"))).alias("s"), segments.similarity_cuts(F.lit("One. Two."), 0.5).alias("few")).first()
    assert [tuple(c) for c in row.c] == [(0, 44), (44, 63), (63, len(text))] and [round(x, 3) for x in row.s] == [0.894, 0.0, 0.0] and [tuple(c) for c in row.few] == [(0, 9)]
    made = spark.createDataFrame([(text, "doc_section", "id")], "t string, k string, i string")
    alike = segments.neighbour_similarities(segments.sentences(F.col("t")))
    parts = made.select(segments.alike_segments(F.col("t"), F.lit("doc"), F.col("i"), alike).alias("s")).first().s
    assert [p.text for p in parts] == ["The cache is warm. The cache is warm today.", "Nothing else here!", "Ok then."]
    asked = [("def run(x) in /a/b.py v1.2.3 def RUN todo",), ("",), (None,), ("தமிழ் மொழி",), ("привет",)]
    rows = spark.createDataFrame(asked, "t string").select(entities.query_entities(F.col("t")).alias("e"), languages.query_language(F.col("t")).alias("l")).collect()
    assert [(e.label, e.text) for e in rows[0].e] == [("FUNC", "run"), ("TODO", "todo"), ("FILE_PATH", "/a/b.py"), ("VERSION", "1.2.3")] and rows[1].e == [] == rows[2].e
    assert [(r.l.lang, r.l.name, r.l.conf) for r in rows] == [("en", "English", 0.5), ("en", "English", 1.0), ("en", "English", 1.0), ("ta", "Tamil", 0.95), ("ru", "Russian", 0.95)]
    colours = spark.createDataFrame([(0.0,), (0.25,), (0.5,), (0.75,), (None,)], "x double").select(scoring.colour(F.col("x")).alias("c")).collect()
    assert [r.c for r in colours] == ["#34d399", "#60a5fa", "#fbbf24", "#f472b6", None]


def test_report_files(spark):
    from quillstone.sources.files import report_files

    rows = [("a/b.py", b"x" * 5000), ("a/venv2/b.py", b"x"), ("b.txt", b"x"), ("my.git/c.js", b"x"), ("d.cpp", b"\xff\xfeab"), (None, b"x")]
    got = {r.path: r.head for r in report_files(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got == {"a/b.py": "x" * 4000, "d.cpp": "ab"}
