"""The scan behind parsing: strings, templates, comments and braces of several languages."""

import pytest

from tessera.operators import metadata, parsing

JAVA = """class A {
  // }
  String s = "}"; /* class B {
 } */
  char c = '}';
  public int f(int x) {
    return 1;
  }
}
class C {}
"""
SCRIPT = """class A {
  m() { return `a ${ [1].map((x) => { return `}${x}`; }) } }`; }
}
const r = /[}/]{2}/.test('class B {');
function g() {
  return 4 / 2; // }
}
"""
RUST = """fn f<'a>(x: &'a str) {
  let s = r#"} "fn no() "#; let c = '}';
}
fn g() {
}
"""
BROKEN = """import os
class A:
    def f(self):
        return 'class B:'

    x = 1
def g(:  # def no():
    pass
"""


@pytest.mark.parametrize("language,body,want", [
    ("java", JAVA, {("class", "A", 1, 9), ("method", "f", 6, 8), ("class", "C", 10, 10)}),
    ("javascript", SCRIPT, {("class", "A", 1, 3), ("function", "g", 5, 7)}),
    ("rust", RUST, {("function", "f", 1, 3), ("function", "g", 4, 5)}),
    ("python", BROKEN, {("import", "import os", 1, 1), ("class", "A", 2, 6), ("method", "f", 3, 4), ("function", "g", 7, 8)}),
    ("go", "func f() {\n  x := `}`\n}\nfunc g() {\n}\n", {("function", "f", 1, 3), ("function", "g", 4, 5)}),
    ("csharp", 'class A {\n  string p = @"c:\\"; // {\n}\nclass B {\n}\n', {("class", "A", 1, 3), ("class", "B", 4, 5)}),
    ("ruby", "class A\n  # end\n  s = 'class B'\nend\n", {("class", "A", 1, 4)}),
])
def test_strings_and_comments_declare_nothing(language, body, want):
    assert {(r[0], r[1], r[2], r[3]) for r in parsing.rows_of(body, language)} == want


@pytest.mark.parametrize("language", ["javascript", "typescript", "java", "rust", "python", "go", "ruby", "csharp", "php", "c", "cpp"])
def test_scan_is_as_long_as_the_text(language):
    for body in ("", "'", '"', "`", "`${", "`${{", "/*", "//", "}", "{{}", "`${`${'}'}`}`", "a = b / c / d", "\\", '"""', 'r#"', "'''x", "/[/]/", "\n{\n"):
        s = parsing.scan(body, language)
        assert len(s.code) == len(body) and s.code.count("\n") == body.count("\n")
        assert len(s.opens) == len(s.closes) and all(a < b for a, b in zip(s.opens, s.closes, strict=True))


def test_parsing_takes_linear_time():
    rows = parsing.parse_patterns("function f() { return '}'; }\n" * 50_000, "javascript")
    assert len(rows) == 50_000 and rows[-1][2:4] == (50_000, 50_000)


def test_metadata_of_files(spark):
    rows = [("python", "'''no'''\n\"\"\" Says. \"\"\"\nimport a, b\nclass A: pass\n"), ("python", "def f(:\n  'def no()'\n"), ("java", "/* no */ /** Doc */ import a.*;\ninterface I {}\n"), ("text", "import x"), ("java", None)]
    got = metadata.extract(spark.createDataFrame(rows, "language string, text string"))
    assert got.columns == ["language", "text", *metadata.FIELDS]
    by = {(r.language, r.text): (r.imports, r.classes, r.functions, r.docstring) for r in got.collect()}
    assert by[rows[0]] == (["import a, b"], ["A"], [], "Says.") and by[rows[1]] == ([], [], ["f"], None) and by[rows[3]] == by[rows[4]] == ([], [], [], None)
    assert by[rows[2]] == (["import a.*"], ["I"], [], "Doc")
