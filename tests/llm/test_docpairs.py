"""Functions and their documentation in several languages, and odd inputs."""

import pytest
from pyspark.sql import functions as F

from quillstone.llm import docpairs as D
from quillstone.llm.sourcecode import decode, language_of, looks_like_code

CASES = [
    ("python", "@traced\ndef run_it(a):\n    '''Moves every row that is late to the archive.'''\n    return a\n\n# run other\ndef run_other(): pass\n", {2}),
    ("python", "class A:\n    '''Holds all of the rows.'''\n    # Drops what nobody has asked for.\n    @prop\n    def go(self):\n        pass\n", {5}),
    ("python", "def broken(:\n    pass\n# Counts the rows of a table.\ndef fine(x):\n    pass\n", {4}),
    ("javascript", "/**\n * Sends the mail that waits in the queue.\n * @param x\n */\nexport function sendMail(x) {\n}\n// @ts-ignore\nfunction other() {}\n", {5}),
    ("typescript", "class A {\n  // Reads the list from the given folder.\n  async readList(a: string): Promise<void> {\n    if (a) { go(a); }\n  }\n  // TODO\n  other() { return 1; }\n}\n// Joins both tables by their key.\nconst joinBoth = (a: number, b) => {\n};\n", {3, 10}),
    ("java", "class A {\n  /** Returns the last of all rows seen. */\n  @Override\n  public List<String> lastRow(int a) throws X {\n    return null;\n  }\n  /** lastRow */\n  void lastRow() {}\n}\n", {4}),
    ("go", "// Load fetches the file and keeps it in memory.\nfunc (s *Store) Load(a string) error {\n}\n\n// Save\nfunc Save() {}\n", {2}),
    ("rust", "/// Splits a text at its commas.\n#[inline]\npub(crate) async fn split_text(a: &'a str) -> u8 { 0 }\n", {3}),
    ("c", "/*\n * Frees the memory of a list.\n */\nstatic int\nfree_list(struct list *a)\n{\n}\n// ----------\nint other(void) {\n}\n", {5}),
    ("php", "<?php\n# Builds the page from its parts.\nfunction buildPage($a) {\n}\n", {3}),
    ("ruby", "# Closes the door behind the last guest.\ndef close_door!(a)\nend\n", {2}),
    ("shell", "#!/bin/sh\n# Removes files older than a week.\nclean_up() {\n}\nfunction other {\n}\n", {3}),
    ("kotlin", "/** Draws the border of the window. */\nprivate suspend fun <T> List<T>.drawBorder(a: Int) {\n}\n", {2}),
    ("sql", "-- Adds a row to the log of changes.\nCREATE OR REPLACE FUNCTION app.add_row(a int) RETURNS int AS $$ $$;\n", {2}),
    ("javascript", "// 这个函数会跳过重复的记录\nfunction skip() {}\nconst x = 'function fake() {}'; // Says a lot about nothing here.\nfunction bare() {}\n", {2}),
]


@pytest.mark.parametrize("lang,text,want", CASES)
def test_languages(lang, text, want):
    for form in (text, text.replace("\n", "\r\n")):
        got = {f.line for f in D.functions(form, lang) if f.doc and D.says_something(f.doc, f.name)}
        assert got == want


@pytest.mark.parametrize(
    "doc,name,want",
    [
        ("", "f", False), ("TODO", "f", False), ("---", "f", False), ("eslint-disable-next-line", "f", False), ("drain_probe(x);", "g", False), ("Syncs the shard.", "syncShard", False), ("@param a\n@return", "f", False),
        (":param a: the row that is read first", "f", True), ("Gets rows sorted by age", "rows", True), ("この関数は古いファイルを残します", "f", True), ("_summary_", "f", False), ("Args:\n    a:\n    b:", "f", False), ("    a: how many rows are read at most", "f", True),
        ("FIXME: add docs", "f", False), ("x = y + 1", "f", False), ("{@inheritDoc}", "f", False), ("loadFreshSnapshot", "loadFreshSnapshot", False), ("Nur die letzten Zeilen werden behalten", "f", True),
    ],
)
def test_says_something(doc, name, want):
    assert D.says_something(doc, name) is want


def test_reading():
    assert decode(b"\xef\xbb\xbfa") == "a" and decode("é".encode("utf-16")) == "é" and decode(b"caf\xe9") == "café" and decode(b"") == ""
    assert language_of(None, ".TS") == "typescript" and language_of("JS", None) == "javascript" and language_of(None, None) is None
    assert looks_like_code("foo(bar);") and looks_like_code("x = 1") and not looks_like_code("This is a plain sentence.") and not looks_like_code("")


def test_tables(spark):
    code = b"def f(a):\n    '''Returns the greater half of a.'''\n    return a\n"
    rows = [(1, "code", "python", ".py", code), (1, "code", "python", ".py", code), (2, "code", None, ".py", b"\xff\xfe" + code.decode().encode("utf-16-le")), (3, "doc", "python", ".py", code), (4, "code", "python", ".py", None), (5, "code", "python", ".py", b""), (None, "code", "python", ".py", code), (6, "code", None, None, code), (7, "script", "shell", ".sh", b"x" * 100_000)]
    df = spark.createDataFrame(rows, "file_id long, file_type string, language string, ext string, content binary").withColumn("def_line", F.lit("clash"))
    assert {(r.file_id, r.def_line) for r in D.documented(df).collect()} == {(1, 1), (2, 1)}
    got = D.pairs(df).where("file_id = 1").first()
    assert (got.name, got.first_line, got.last_line, got.documentation) == ("f", 1, 3, "Returns the greater half of a.") and got.code.startswith("def f(a):")
    assert D.documented(df.limit(0)).count() == 0


def test_ranges_of_other_languages():
    text = "// Adds one to the number given.\nfunction add(a) {\n  if (a) { return a + 1; }\n}\nlet b = '}';\n"
    assert [(f.first, f.last) for f in D.functions(text, "javascript", True)] == [(2, 4)]


def _declared(text, lang):
    return [(f.name, f.line, f.first, f.last) for f in D.functions(text, lang, True)]


@pytest.mark.parametrize(
    "lang,text,want",
    [
        (
            "typescript",
            "@Injectable()\nexport class A<T> {\n  constructor(private readonly a: B) { super(); }\n  @Get('/x')\n  async read<K>(a: { b: number }, c = f(1)): Promise<Map<K, T>> {\n    if (a) { go(a); }\n    list.map((x) => x + 1);\n  }\n  handler = async (e: E) => {\n    for (;;) { run(e); }\n  };\n  get size(): number { return 1; }\n}\nexport const join = <T>(a: T): T =>\n  a;\nlet twice = x => x * 2;\nconst gen: F = function* () {\n};\nfoo(function () { bar(); });\n",
            [("constructor", 3, 3, 3), ("read", 5, 4, 8), ("handler", 9, 9, 11), ("size", 12, 12, 12), ("join", 14, 14, 15), ("twice", 16, 16, 16), ("gen", 17, 17, 18)],
        ),
        (
            "java",
            "package a.b;\nclass A extends B {\n  private final Map<String, List<Integer>> m = new HashMap<>();\n  public A(int a) {\n    super(a);\n  }\n  @Test(timeout = 5)\n  static <T extends Comparable<T>> T[] best(List<? extends T> a, int... b) throws X, Y {\n    return make(new Runnable() {\n      public void run() { go(1); }\n    });\n  }\n  abstract void none();\n}\n",
            [("A", 4, 4, 6), ("best", 8, 7, 12), ("run", 10, 10, 10), ("none", 13, 13, 13)],
        ),
        ("go", "func (s *Store[K]) Load(a func(int) error) (map[string]int, error) {\n\tgo func() { run() }()\n\treturn f(a), nil\n}\nfunc Map[T any](a []T) {\n}\n", [("Load", 1, 1, 4), ("Map", 5, 5, 6)]),
        ("rust", "impl A {\n    #[inline]\n    pub(crate) const unsafe fn go<'a, T: B>(&self, a: T) -> Vec<T> where T: C {\n        if a { f(a) }\n    }\n}\n", [("go", 3, 3, 5)]),
        ("c", "#define X(a) (a)\nstatic const char *\nname_of(struct list *a, int (*f)(int))\n{\n\tif (a) { return f(1); }\n}\nint proto(void);\n", [("name_of", 3, 2, 6), ("proto", 7, 7, 7)]),
        ("php", "<?php\nclass A {\n  public static function &make(array $a = [1, 2]): ?self {\n    return new self($a);\n  }\n}\n$twice = fn($x) => $x * 2;\n", [("make", 3, 3, 5), ("twice", 7, 7, 7)]),
        ("kotlin", "private suspend fun <T> List<T>.drawAll(a: Int): Int {\n    return a.let { it + 1 }\n}\nfun one() = 1\n", [("drawAll", 1, 1, 3), ("one", 4, 4, 4)]),
    ],
)
def test_declarations_by_their_trees(lang, text, want):
    assert _declared(text, lang) == want


def test_brackets_that_do_not_match_leave_it_to_patterns():
    from quillstone.llm.declarations import declarations

    text = "// Adds one to the number given.\nfunction add(a) {\n  return (a + 1;\n}\n"
    assert declarations(text, "javascript") is None and [f.line for f in D.functions(text, "javascript")] == [2]
    assert declarations("", "java") == [] and declarations("(" * 50_000 + ")" * 50_000, "java") == []
