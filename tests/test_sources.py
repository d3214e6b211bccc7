import pytest

from skarn.sources import diffs, notes, scip
from skarn.sources.extract import extract
from skarn.sources.workspace import _regex


@pytest.mark.parametrize(
    ("language", "text", "symbols", "imports", "edges"),
    [
        ("python", "import os.path as p\nclass A(B, c.D):\n    def f(self):\n        g(1)\n", {("A", "class", 2, 4), ("f", "function", 3, 4)}, {"os.path"}, {("extends", "A", "B"), ("extends", "A", "c.D"), ("calls", "f", "g")}),
        ("typescript", "import x from './y';\nexport class K extends B implements I {\n  run() {\n    // not(this)\n    go('no(1)');\n  }\n}\nconst f = () => { h(); };\n", {("K", "class", 2, 7), ("run", "function", 3, 6), ("f", "function", 8, 8)}, {"./y"}, {("extends", "K", "B"), ("implements", "K", "I"), ("calls", "run", "go"), ("calls", "f", "h")}),
        ("go", 'package a\nimport "fmt"\ntype S struct {\n\tBase\n}\nfunc (s *S) Run() {\n\tfmt.Println(s)\n}\n', {("S", "class", 3, 5), ("Run", "function", 6, 8)}, {"fmt"}, {("extends", "S", "Base"), ("calls", "Run", "fmt.Println")}),
        ("java", "import a.B;\npublic class A extends C implements D {\n  public int run(int x) {\n    return go(x);\n  }\n}\n", {("A", "class", 2, 6), ("run", "function", 3, 5)}, {"a.B"}, {("extends", "A", "C"), ("implements", "A", "D"), ("calls", "run", "go")}),
        ("rust", "use crate::a;\nstruct P { x: i32 }\nimpl T for P {\n  fn s(&self) { go(); }\n}\n", {("P", "class", 2, 2), ("s", "function", 4, 4)}, {"crate::a"}, {("implements", "P", "T"), ("calls", "s", "go")}),
        ("kotlin", "import c.d\nclass K : B(1), I {\n  fun run() { go() }\n}\n", {("K", "class", 2, 4), ("run", "function", 3, 3)}, {"c.d"}, {("extends", "K", "B"), ("implements", "K", "I"), ("calls", "run", "go"), ("calls", None, "B")}),
        ("dart", "import 'a.dart';\nclass A extends B with M {\n  void run() { go(); }\n}\n", {("A", "class", 2, 4), ("run", "function", 3, 3)}, {"a.dart"}, {("extends", "A", "B"), ("implements", "A", "M"), ("calls", "run", "go")}),
        ("csharp", "using System;\nclass A : B, IC {\n  public int Run(int x) { return Go(x); }\n}\n", {("A", "class", 2, 4), ("Run", "function", 3, 3)}, {"System"}, {("extends", "A", "B"), ("implements", "A", "IC"), ("calls", "Run", "Go")}),
    ],
)
def test_extraction_by_language(language, text, symbols, imports, edges):
    e = extract(text, language)
    assert {s[:4] for s in e.symbols} == symbols and {i[0] for i in e.imports} == imports and {x[:3] for x in e.edges} == edges and not e.errors


def test_damaged_files_are_error_rows():
    assert extract("def f(:\n", "python").errors == ["E_PARSE_ERROR: line 1"]
    assert extract("function f() {\n", "typescript").errors == ["E_PARSE_ERROR: line 1"]
    assert extract("anything", "unsupported").symbols == []


def test_hunks(spark):
    patch = "--- a/x.py\n+++ b/x.py\n@@ -1,2 +3,4 @@ def f\n+a\n@@ -9,3 +12,0 @@\n--- a/gone.py\n+++ /dev/null\n@@ -1,5 +0,0 @@\n@@ -7 +7 @@\n"
    assert [(r["path"], r["start_line"], r["end_line"]) for r in diffs.from_text(spark, patch).orderBy("path", "start_line").collect()] == [("gone.py", 1, 5), ("gone.py", 7, 7), ("x.py", 3, 6), ("x.py", 9, 11)]


def message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += bytes([number << 3, value])
        else:
            n = len(value)
            out += bytes([number << 3 | 2]) + (bytes([n]) if n < 128 else bytes([n & 127 | 128, n >> 7])) + value
    return out


def occurrence(span, symbol, roles):
    return message((1, bytes(span)), (2, symbol.encode()), (3, roles))


def test_precise_references_become_edges(spark):
    main = message((1, b"src/main.ts"), (2, occurrence([0, 9, 13], "s npm p 1 `main.ts`/main().", 1)), (2, occurrence([3, 2, 4, 8], "s npm p 1 `utils.ts`/doWork().", 0)), (2, occurrence([50, 2, 8], "s npm p 1 `utils.ts`/doWork().", 0)), (2, message((2, b"no range"))))
    utils = message((1, b"src/utils.ts"), (2, occurrence([0, 9, 15], "s npm p 1 `utils.ts`/doWork().", 1)))
    data = message((1, b""), (2, main), (2, utils))
    rows = list(scip.decode(data))
    assert len(rows) == 4 and rows[1][:5] == ("src/main.ts", 3, 2, 4, 8)
    occurrences = spark.createDataFrame(rows, scip.OCCURRENCES)
    symbols = spark.createDataFrame([("src/main.ts", "main", 1, 10), ("src/main.ts", "outer", 1, 30), ("src/utils.ts", "doWork", 1, 15)], "path string, name string, start_line int, end_line int")
    assert [tuple(r) for r in scip.call_edges(occurrences, symbols).collect()] == [("src/main.ts", "main", "doWork", "src/utils.ts", 4)]


def test_front_matter(spark):
    text = "---\ntitle: 'A b'\ntags: [x, \"y\"]\nlinks: p, q\nscope: nowhere\nscope: agent\nconfidence: sure\nobserved_at: not a date\n---\nbody [[w]]\n"
    files = spark.createDataFrame([("d/n.md", text), ("plain.md", "# Head\ntext")], "path string, content string")
    a, b = notes.normalise(notes.parse(files)).orderBy("path").collect()
    assert (a["title"], a["tags"], a["links"], a["scope"], a["confidence"], a["observed_at"], a["warnings"]) == ("A b", ["x", "y"], ["p", "q"], "agent", "presumed", None, ["E_MEMORY_V2_CONFIDENCE"])
    assert (b["title"], b["source"], b["text"]) == ("Head", "v1_migration", "# Head\ntext")


def test_ignore_patterns():
    import re

    assert re.search(_regex("*.log"), "a/b.log") and not re.search(_regex("*.log"), "a/b.logs")
    assert re.search(_regex("logs/"), "x/logs/a") and re.search(_regex("/top.txt"), "top.txt") and not re.search(_regex("/top.txt"), "a/top.txt")
