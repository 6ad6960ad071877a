"""Long runs of words take no more time than others and the same definitions are found."""

import random

import pytest
import regex

from textloom.operators import structure as s

C_BEFORE = r"(?:\w+\s+)+(\w+)\s*\([^)]*\)\s*\{"
PARTS = ["public", "static", "private", "internal", " ", " ", "\n", "x", "é", "run", "(", "(", ")", "{", ") {", "()", ";", "public ", "a b", "int f(int a) {", "\xa0", "_1", "\x1c", "é", "statistatic"]


@pytest.mark.parametrize("lang", ["cs", "java", "c", "cpp"])
def test_functions_are_those_of_the_plain_patterns(lang):
    pattern = C_BEFORE if lang.startswith("c") and lang != "cs" else s.FUNCTION_PATTERNS[lang]
    rnd, seen = random.Random(11), 0
    for _ in range(6000):
        text = "".join(rnd.choices(PARTS, k=rnd.randrange(24)))
        want = [(m.start(), m[1]) for m in regex.finditer(pattern, text)]
        if s.FUNCTION_PATTERNS[lang] in s._MODIFIERS:
            got = list(s.methods(s._MODIFIERS[s.FUNCTION_PATTERNS[lang]], text))
        else:
            got = [(m.start(), m[1]) for m in regex.finditer(s.FUNCTION_PATTERNS[lang], text)]
        assert got == want, text
        seen += len(want)
    assert seen > 500


@pytest.mark.parametrize(("lang", "words"), [("cs", 20_000), ("java", 20_000), ("cs", 500_000), ("c", 12_000)])
def test_a_run_of_words_without_marks_is_no_error(lang, words):
    text = "\n static int run(int a) {\n/* " + "La " * words + "*/\n}\n int end(int a) { return a; }\n"
    names = [name for name, _ in s.definitions(lang, text, "function", s.TIME_LIMIT)]
    assert names == (["run", "end"] if 3 * words < 50_000 else ["end"])  # a long one is left out
