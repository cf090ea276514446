"""Languages of prose in code: accuracy on held-out sentences, what is none, and odd inputs."""

import pytest

from quillstone.llm import prose as P
from quillstone.llm.folding import fold

#: Sentences that aren't in the samples.
HELD_OUT = {
    "en": ["We never found out who had moved the second server.", "Call this once and throw the result away.", "Only rows that are older than a week get removed here.", "It would be better to ask the owner first.", "Nothing in this module depends on the order of the keys."],
    "fr": ["On ne sait pas qui a déplacé le deuxième serveur.", "Il vaut mieux demander au propriétaire avant de continuer.", "Seules les lignes de plus d'une semaine sont supprimées ici.", "Cette méthode ne dépend pas de l'ordre des clés.", "Merci de ne pas toucher à ce dossier sans prévenir."],
    "de": ["Niemand weiß, wer den zweiten Server verschoben hat.", "Nur Zeilen, die älter als eine Woche sind, fallen hier weg.", "Es wäre besser, vorher den Besitzer zu fragen.", "Diese Methode hängt nicht von der Reihenfolge ab.", "Bitte diesen Ordner nicht ohne Rücksprache anfassen."],
    "es": ["Nadie sabe quién movió el segundo servidor.", "Solo se borran aquí las filas de más de una semana.", "Sería mejor preguntar antes al dueño del proyecto.", "Este método no depende del orden de las claves.", "Por favor no toquen esta carpeta sin avisar."],
    "pt": ["Ninguém sabe quem mudou o segundo servidor de lugar.", "Só as linhas com mais de uma semana são apagadas aqui.", "Seria melhor perguntar antes ao dono do projeto.", "Este método não depende da ordem das chaves.", "Por favor não mexam nesta pasta sem avisar."],
    "ru": ["Никто не знает, кто перенёс второй сервер сюда."],
    "zh": ["没有人知道是谁移动了第二台服务器。"],
    "ja": ["二台目のサーバーを誰が動かしたのか分かりません。"],
    "hi": ["किसी को नहीं पता कि दूसरा सर्वर किसने हटाया।"],
}


def test_held_out_sentences():
    total = right = 0
    for lang, lines in HELD_OUT.items():
        for line in lines:
            for form in {line, P.plain(line) if lang in P.SAMPLES else line}:
                total += 1
                right += P.line_language(form) in (lang, None) and next(P.prose_lines(f"// {form}", None, "c", {}), (None,))[0] == lang
    assert right / total >= 0.95


@pytest.mark.parametrize(
    "line",
    ["SELECT a, b FROM c WHERE d = ? AND e IN (1)", "return foo(bar, baz, qux, quux);", "lib/a/b.py src/c/d.py conf/e/f.ts x/y/z.go m/n.rs", "eslint-disable-next-line no-unused-vars, no-console, eqeqeq", "anchor batch bucket cache catalog chunk", "0x1f, 0x57, 0x91, 0x5e, 0x7a", "too few words", "if (a) { b(); c(); d(); }"],
)
def test_none(line):
    assert P.line_language(line) is None


def tell(content, lang, doc=None):
    return {x for x, _ in P.prose_lines(content, doc, lang, {})}


def test_where_prose_stands():
    de, fr = HELD_OUT["de"][0], HELD_OUT["fr"][0]
    assert tell(f'x = "{de}"  # {fr}', "python") == {"de", "fr"}
    assert tell(f"/* a\n * {de}\n */ int x; // {fr}", "c") == {"de", "fr"}
    assert tell("end of it.\n * " + de + "\n */\nint x;", "java") == {"de"}
    escaped = "".join(c if ord(c) < 128 else f"\\u{ord(c):04x}" for c in fr)
    assert tell(f'log("{escaped}");', "javascript") == {"fr"}
    assert tell("x = 1", "python", doc=de) == {"de"} and tell(de, "python") == set() and tell(None, None, None) == set() and tell("", "c") == set()
    assert tell(f"-- {fr}\nSELECT 1;", "sql") == {"fr"} and tell(f"# {de}\nrun", "shell") == {"de"}
    assert tell("// Copyright (c) the harbor team, internal use only.", "c") == {"en"}
    assert tell(f"ende\n{de}\n'''\nx = 1\n", "python") == {"de"}


def test_tables(spark):
    de, en = HELD_OUT["de"][1], HELD_OUT["en"][0]
    chunks = spark.createDataFrame(
        [(1, 10, f"// {de}\n// {en}", None, "c", "a.c", "code"), (1, 10, f"// {de}\n// {en}", None, "c", "a.c", "code"), (2, 11, f"# {de}", None, None, "b.py", None), (3, 12, f"// {de}", None, "c", "a.c", "code"), (4, 10, None, None, None, None, "code"), (None, 10, f"// {de}", None, "c", "a.c", "code"), (5, None, f"// {de}", None, "c", "a.c", "code"), (6, 10, f"// {de}", None, "c", "a.c", "code")],
        "chunk_key long, file_id long, content string, docstring string, language string, source_file string, file_type string",
    )
    files = spark.createDataFrame([(10, "code"), (10, "code"), (11, "script"), (12, "doc"), (None, "code")], "file_id long, file_type string")
    assert {tuple(r) for r in P.languages(chunks, files).collect()} == {(1, "de"), (1, "en"), (2, "de"), (6, "de")}
    shares = {(r.file_id, r.lang): (r.chars, r.share) for r in P.shares(chunks, files).collect()}
    n, m = len(de), len(en)
    assert shares[(10, "de")][0] in (n, n - 1) and abs(shares[(10, "de")][1] + shares[(10, "en")][1] - 1) < 1e-3 and shares[(11, "de")][1] == 1.0 and m
    assert P.languages(chunks.limit(0), files).count() == 0 and P.languages(chunks, files.limit(0)).count() == 0


def test_fold_keeps_nothing_of_marks():
    assert fold("!?…") == ""


def test_other_languages_and_word_salad_are_rejected():
    for line in (
        "Deze regel is niet in gebruik omdat de oude code nog bestaat", "Questa riga non viene usata perché il codice vecchio esiste ancora", "Цей рядок не використовується, тому що старий код ще існує", "ही ओळ वापरली जात नाही कारण जुना कोड अजून आहे",
        "not in is of the on", "alpha beta gamma delta epsilon zeta", "Den gamla koden finns kvar men ingen använder den längre", "Ten wiersz nie jest używany, ponieważ stary kod jeszcze istnieje",
    ):
        assert P.line_language(line) is None, line


def test_languages_without_a_family_are_read_by_common_delimiters():
    code = '-- | This module keeps the cache of the running service.\nmain = putStrLn "the file was not found in the store" {- Bitte die alte Datei nicht von Hand löschen -}\n'
    assert {found for found, _ in P.prose_lines(code, None, None, {})} == {"en", "de"}
    assert not list(P.prose_lines("main = do one two three four five six\n  x <- the of is in that", None, None, {}))
