import random
import time

import pytest

from textloom.operators import structure as s


def found(lang, content, kind):
    return list(s.definitions(lang, content, kind))


CLASSES = {
    "cs": " public class Foo { int x; }",
    "java": " public class Foo { int x; }",
    "ts": "export abstract class Foo { a; }",
    "tsx": "class Foo { render; }",
    "js": "class Foo { a; b; }",
    "jsx": "class Foo { a; b; }",
    "py": "class Foo:\n    x = 1\n",
    "rb": "class Foo\n  x = 1\nend",
    "swift": "open class Foo { var a }",
    "kt": "data class Foo { val a }",
    "php": "class Foo { $a; }",
    "go": "type Foo struct { a int }",
    "rs": "pub struct Foo { a: i32 }",
}


@pytest.mark.parametrize("lang", CLASSES)
def test_classes(lang):
    (name, body), *rest = found(lang, CLASSES[lang], "class")
    assert name == "Foo" and not rest and body == CLASSES[lang]


FUNCTIONS = {
    "cs": "static int run(int a) { return a; }",
    "java": " int run(int a) { return a; }",
    "c": "int run(int a) { return a; }",
    "cpp": "int run(int a) { return a; }",
    "js": "function run(a) { return a; }",
    "ts": "const run = (a) => { return a; }",
    "jsx": "let run = function(a) { return a; }",
    "tsx": "var run = (a, b) => { return a; }",
    "py": "def run(a):\n    return a\n",
    "go": "func (r *T) run(a int) int { return a }",
    "rs": "fn run<T>(a: T) -> T { a }",
    "php": "function run($a) { return $a; }",
    "rb": "def run\n  1\nend",
    "swift": "func run(a: Int) { print(a) }",
}


@pytest.mark.parametrize("lang", FUNCTIONS)
def test_functions(lang):
    (name, body), *rest = found(lang, FUNCTIONS[lang], "function")
    assert name == "run" and not rest and body == FUNCTIONS[lang]


def test_unknown_languages():
    assert not found("kt", "fun run() { }", "function")
    assert not found("c", "class Foo { int x; }", "class")
    assert not found("txt", "class Foo { int x; }", "class")


def test_annotated_python_functions_are_skipped():
    assert [n for n, _ in found("py", "def a(x):\n    pass\ndef b(x) -> int:\n    pass\ndef c():\n    pass\n", "function")] == ["a", "c"]


def test_margin_bodies_end_before_the_next_unindented_definition():
    text = "class A:\n    class B:\n        x = 1\nclass C:\n    y = 2\n"
    assert [(n, b) for n, b in found("py", text, "class")][0] == ("A", "class A:\n    class B:\n        x = 1")
    assert [n for n, _ in found("py", text, "class")] == ["A", "B", "C"]


def test_braces_in_strings_count():
    (_, body), *_ = found("js", 'function run() { return "}"; } more }', "function")
    assert body == 'function run() { return "}'


def test_a_file_that_begins_with_class_has_no_match_in_cs():
    assert not found("cs", "class Foo { int x; }", "class")


@pytest.mark.parametrize(("size", "kept"), [(10, False), (11, True), (99_999, True), (100_000, False)])
def test_class_bounds(size, kept):
    text = "class A{" + "x" * (size - 9) + "}"
    assert bool(found("js", text, "class")) == kept


@pytest.mark.parametrize(("size", "kept"), [(49_999, True), (50_000, False)])
def test_function_bounds(size, kept):
    text = "function f(){" + "x" * (size - 14) + "}"
    assert bool(found("js", text, "function")) == kept


def test_no_end_found():
    assert len(found("js", "class A " + "x" * 9000, "class")[0][1]) == 5000
    assert len(found("js", "function f() " + "x" * 9000, "function")[0][1]) == 500
    assert s.units(found("js", "function f() " + "😀" * 900, "function")[0][1]) == 500


def test_records(spark):
    rows = [("src/a.py", "/r/src/a.py", "py", 40, "class Foo:\n    def build(self):\n        return item_list\n")]
    files = spark.createDataFrame(rows, "rel string, abs_path string, lang string, size long, content string")
    got = {r["id"]: r for r in s.records(files, "/r").collect()}
    assert set(got) == {"src/a.py.file", "src/a.py.Foo.class", "src/a.py.build"}
    assert got["src/a.py.file"]["title"] == "a.py • py • build/item_list/self"
    assert got["src/a.py.Foo.class"]["title"] == "Foo • 1 members • a.py py"
    assert got["src/a.py.build"]["text"].startswith("path: src/a.py\nlang: py\n\ndef build")


def plain_end(text, start, lang, kind):
    """Where a definition ends, found by walking from its start."""
    _, word, margin_most, default, _ = s.KINDS[kind]
    if lang in s.BY_MARGIN:
        first, *others = text[start:].split("\n")
        size, end = s.units(first), start + len(first)
        for line in others:
            blank = not line.strip(" \t\x0b\x0c\r\xa0")
            if not blank and line.startswith(word):
                break
            size += s.units(line) + 1
            end += len(line) + 1
            if not blank and size > margin_most:
                break
        return end
    depth, opened = 0, False
    for i in range(start, len(text)):
        if text[i] == "{":
            depth, opened = depth + 1, True
        elif text[i] == "}":
            depth -= 1
            if opened and depth == 0:
                return i + 1
    return min(len(text), start + default)


PARTS = ["class ", "def ", "{", "}", "\n", "\n", "  ", "x", "(a)", ":", "function f", "class A", "def g(x):", "\n\n", "é", "const a = (b) => ", "int run(int x) {", "end", "}}", "{{", "\xa0\n", "    y\n", "😀\n"]


def test_ends_are_those_of_a_walk(monkeypatch):
    monkeypatch.setattr(s, "KINDS", {"class": (s.CLASS_PATTERNS, "class ", 60, 10_000, 1_000), "function": (s.FUNCTION_PATTERNS, "def ", 30, 10_000, 1_000)})
    rnd = random.Random(7)
    for _ in range(1500):
        text = "".join(rnd.choices(PARTS, k=rnd.randrange(60)))
        ends = s.Ends(text)
        for at in {rnd.randrange(len(text) + 1) for _ in range(5)}:
            for lang, kind in (("py", "class"), ("rb", "function"), ("js", "class"), ("c", "function")):
                assert ends.body(at, lang, kind) == text[at : plain_end(text, at, lang, kind)], (text, at, lang, kind)


@pytest.mark.parametrize(("lang", "one"), [("py", "def f{}(x):\n    return {}\n"), ("js", "function f{}(x) {{ return {}; }}\n")])
def test_many_definitions_take_time_in_proportion(lang, one):
    text = "".join(one.format(i, i) for i in range(100_000))
    began = time.process_time()
    assert sum(1 for _ in s.definitions(lang, text, "function", s.TIME_LIMIT)) == 100_000
    assert time.process_time() - began < 6


def test_one_pass_gives_both_kinds(spark):
    rows = [("a.py", "py", "class A:\n    def b(self):\n        pass\n"), ("t.txt", "txt", "class A"), ("n.py", "py", None)]
    files = spark.createDataFrame(rows, "rel string, lang string, content string")
    assert {(r["rel"], r["kind"], r["name"], r["n"]) for r in s.extract_definitions(files).collect()} == {("a.py", "class", "A", 0), ("a.py", "function", "b", 0)}
    assert {r["kind"] for r in s.extract_definitions(files, "class").collect()} == {"class"}


def test_a_slow_file_gives_an_error_row(spark, monkeypatch):
    monkeypatch.setattr(s, "TIME_LIMIT", 0.2)
    slow = "word " * 30_000 + "{(()"  # the pattern tries every run of words from each of them
    files = spark.createDataFrame([("a.c", "c", slow), ("b.c", "c", "int run(int a) { return a; }")], "rel string, lang string, content string")
    got = {r["rel"]: r for r in s.extract_definitions(files, "function").collect()}
    assert "took over" in got["a.c"]["error"] and got["b.c"]["name"] == "run"
