"""Leaked passages against a brute-force search, edits, disguises and odd inputs."""

import os
import random

import numpy as np

from quillstone.llm import leakage
from quillstone.llm.folding import fold, unescape, words

VOCABULARY = [f"{a}{b}" for a in ("bal", "cor", "dun", "fer", "gal", "hin", "jor", "kel", "lam", "mor") for b in ("ta", "ve", "zi", "no", "pu", "ri", "so", "la", "me", "xu")]


def made(n, seed):
    rng = random.Random(seed)
    return [rng.choice(VOCABULARY) for _ in range(n)]


def table(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, question string, reference_answer string")
    return d, i


def test_ranks_order_suffixes():
    rng = np.random.default_rng(1)
    for letters, n in ((4, 400), (2, 300), (30, 500)):
        seq = np.concatenate([rng.integers(0, letters, n), [0]])
        rank = leakage.suffix_ranks(seq)

        def suffix(i):
            return tuple(seq[i : i + list(seq[i:]).index(0)])

        keys = [suffix(i) for i in range(len(seq))]
        assert [sum(k < own for k in keys) for own in keys] == list(rank)
        a, b = rng.integers(0, len(seq), (2, 200))
        assert [len(os.path.commonprefix([keys[x], keys[y]])) for x, y in zip(a, b)] == list(leakage.common(seq, a, b))


def test_a_stretch_has_a_seed_whatever_is_changed():
    rng = random.Random(2)
    for least in range(1, 21):
        for _ in range(200):
            changed = set(rng.sample(range(least), leakage.changes_of(least)))
            runs = "".join("x" if k in changed else "." for k in range(least)).split("x")
            assert max(map(len, runs)) >= leakage.seed_of(least)


def test_long_items_and_changed_short_questions(spark):
    long = made(30_000, 50)
    docs = [(1, "ok how does the blue cache expire its entries then"), (2, " ".join(["zz", *long, "zz"])), (3, "how does a big blue cache ever expire any"), (4, " ".join(long[700:719]))]
    d, i = table(spark, docs, [(7, "how does the green cache expire its entries", None), (8, "something else entirely", " ".join(long))])
    got = {(r.doc_id, r.item_id): (r.longest_match, r.doc_word, r.item_word) for r in leakage.leaks(d, i).collect()}
    assert got == {(1, 7): (4, 5, 4), (2, 8): (30_000, 1, 0)}


def test_planted_passages_and_nothing_else(spark):
    answers = {i: made(60, i) for i in range(30)}
    questions = {i: made(12, 1000 + i) for i in range(30)}
    docs, want = [], set()
    rng = random.Random(9)
    for d in range(200):
        body = made(80, 5000 + d)
        kind, item = d % 5, d % 30
        if kind == 0:  # twenty words
            a = rng.randrange(40)
            body[40:40] = answers[item][a : a + 20]
            want.add((d, item))
        elif kind == 1:  # one word in ten changed
            part = answers[item][5:45]
            for k in range(4, 40, 10):
                part[k] = "changed" if k % 20 == 4 else part[k] + "s"
            body[10:10] = part
            want.add((d, item))
        elif kind == 2:  # too short
            body[40:40] = answers[item][10:24]
        elif kind == 3:  # a whole short question
            body[20:20] = questions[item]
            want.add((d, item))
        elif kind == 4:  # far too many changes
            part = [w if k % 3 else "other" for k, w in enumerate(answers[item][:45])]
            body[40:40] = part
        docs.append((d, " ".join(body)))
    d, i = table(spark, docs, [(k, " ".join(questions[k]), " ".join(answers[k])) for k in range(30)])
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(d.repartition(4), i).collect()}
    assert got == want


def test_disguises(spark):
    body = made(30, 77)
    plain = " ".join(body)
    cyrillic = plain.translate(str.maketrans("aeopcx", "аеорсх"))
    forms = [
        plain.upper(), "**" + "** _".join(body) + "_", "> " + "\n> ".join(" ".join(body[k : k + 5]) for k in range(0, 30, 5)), cyrillic, "<p>" + "</p><b>".join(body) + "</b>",
        plain.replace(" ", "\\n"), "".join(f"\\u{ord(c):04x}" for c in plain), plain.replace(" ", "%20"), "&#32;".join(body), ", ".join(f'"{w}"' for w in body), plain.replace("a", "a​"), " ".join(body),
    ]
    d, i = table(spark, [(k, f) for k, f in enumerate(forms)], [(1, "unrelated question of some other kind", plain)])
    assert {r.doc_id for r in leakage.leaks(d, i).collect()} == set(range(len(forms)))


def test_shared_sentences_odd_rows_and_copies(spark):
    closing = "answer in full sentences and name the file"
    items = [(k, " ".join(made(22, k)) + " " + closing, " ".join(made(40, 100 + k))) for k in range(8)] + [(50, None, None), (51, "", ""), (None, "x " * 30, None), (3, " ".join(made(22, 3)) + " " + closing, " ".join(made(40, 103)))]
    leak = " ".join(made(40, 103))
    d, i = table(spark, [(1, closing), (2, leak), (3, leak), (3, leak), (4, None), (5, ""), (None, leak), (6, "zz " * 5000 + leak)], items)
    got = [tuple(r) for r in leakage.leaks(d, i).select("doc_id", "item_id").collect()]
    assert sorted(got) == [(2, 3), (3, 3), (6, 3)]
    assert {r.doc_id for r in leakage.without_leaks(d, i).collect()} == {1, 4, 5, None}
    assert leakage.leaks(d.limit(0), i).count() == 0 and leakage.leaks(d, i.limit(0)).count() == 0


def test_shards_and_blocks_change_nothing(spark, monkeypatch):
    answers = {i: made(60, i) for i in range(12)}
    docs = [(d, " ".join(made(50, 900 + d) + answers[d % 12][8:40])) for d in range(60)]
    d, i = table(spark, docs, [(k, "a question", " ".join(answers[k])) for k in range(12)])
    whole = {tuple(r) for r in leakage.leaks(d, i).collect()}
    monkeypatch.setattr(leakage, "SHARD_WORDS", 150)
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 900)
    assert {tuple(r) for r in leakage.leaks(d, i).collect()} == whole and len(whole) == 60


def test_folding():
    assert fold("Écrire,") == "ecrire" and fold("—") == "" and fold("Ｆｕｌｌ") == "full" and fold("раура1") == "paypa1"
    assert unescape(r"a\nb A &amp; <b>x</b>") == "a b A &  x "
    assert words("foo-\nbar it's", {}) == ["foobar", "its"]


def test_items_with_shared_words_and_the_shortest_questions(spark):
    """Repeated items, a template of many items and questions of fewer words than a seed."""
    same, template = made(40, 300), made(25, 301)
    items = [(k, "which one of these is it then", " ".join(same)) for k in range(8)]
    items += [(20 + k, " ".join(made(9, 400 + k)), " ".join(template + made(10, 500 + k))) for k in range(8)]
    items += [(40, "Why bother?", None), (41, "gamma", None)]
    docs = [(1, " ".join(made(30, 600) + same[5:30] + made(30, 601))), (2, " ".join(made(30, 602) + template + made(30, 603))), (3, "well, why  bother"), (4, "why should we bother"), (5, "bother"), (6, "why")]
    d, i = table(spark, docs, items)
    got = {(r.doc_id, r.item_id): r.longest_match for r in leakage.leaks(d, i).collect()}
    assert set(got) == {(1, k) for k in range(8)} | {(2, 20 + k) for k in range(8)} | {(3, 40)} and got[3, 40] == 2
