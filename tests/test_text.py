import pytest
from pyspark.sql import functions as F

from textloom.functions import text as fn


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "tokens"),
    [("Ab-12 c", ["ab", "12", "c"]), ("x²y", ["x", "y"]), ("İz", ["i̇z"]), ("ΟΔΟΣ ς", ["οδοσ", "σ"]), ("a😀b", ["a", "b"]), ("", []), (None, []), ("...", [])],
)
def test_tokenize(spark, text, tokens):
    assert one(spark, fn.tokenize("t"), t=text) == tokens


def test_counts_and_hints(spark):
    assert one(spark, fn.approx_tokens("t"), t="  a b\tc ") == 3
    assert one(spark, fn.approx_tokens("t"), t="") == 1
    assert one(spark, fn.verb_hint("t"), t="x = Render(y)") == "render"
    assert one(spark, fn.verb_hint("t"), t="forget settle") == "function"
    assert one(spark, fn.identifiers("t"), t="Class foo_bar abc éabcd x1234 1abcd") == ["foo_bar", "x1234"]


@pytest.mark.parametrize(
    ("path", "keep", "short"),
    [("/a/b/c", 3, "/a/b/c"), ("/a/b/c/d", 3, "a/b/.../d"), ("/a/b/c/d/e", 4, "a/b/.../d/e"), ("a/b/c", 2, "a/b/.../a/b/c")],
)
def test_shorten_path(spark, path, keep, short):
    assert one(spark, fn.shorten_path("p", keep), p=path) == short


def test_names(spark):
    assert one(spark, fn.tree_line("p", 8), p="abcdefgh") == " - abcd"
    assert one(spark, fn.tree_line("p", 8), p="abcde") == " - abcde"
    df = spark.range(1)
    assert df.select(fn.format_bytes(F.lit(1536))).first()[0] == "1.5 KB"
    assert df.select(fn.format_bytes(F.lit(3 * 1024**3))).first()[0] == "3 GB"
    assert df.select(fn.utf16_length(F.lit("a😀b"))).first()[0] == 4
    assert df.select(fn.model_tag(F.lit("a:b"))).first()[0] == "a-b"


def test_titles(spark):
    body = "public class Foo { public Foo() { } public int Bar(int a) { } }"
    df = spark.createDataFrame([("Foo", "src/Foo.cs", "cs", body)], "n string, p string, l string, b string")
    assert df.select(fn.class_title(F.col("n"), F.col("p"), F.col("l"), F.col("b"))).first()[0] == "Foo • 2 members • constructor • Foo.cs cs"
    assert df.select(fn.function_title(F.col("n"), F.col("p"), F.col("l"), F.lit("get it"))).first()[0] == "Foo — get (Foo.cs cs)"


def test_long_runs_need_no_stack(spark):
    """A million separators, and a body of plain words near the longest one."""
    from textloom.functions.text import member_count, tokenize

    df = spark.createDataFrame([("a" + "-=" * 500_000 + "b", "word " * 19_999)], "t string, b string")
    row = df.select(tokenize("t").alias("t"), *[member_count(F.lit(x), F.col("b")).alias(x) for x in ("cs", "py", "js")]).first()
    assert row["t"] == ["a", "b"] and (row["cs"], row["py"], row["js"]) == (0, 0, 0)


def test_members_are_those_of_the_whole_pattern(spark):
    """The short pattern finds as many members as the one with all modifiers and words."""
    import random

    import regex

    from textloom.functions.text import member_count

    random.seed(3)
    whole = regex.compile(r"(?:public|private|protected|internal|static|\s)+(?:\w+\s+)+\w+\s*\([^)]*\)")
    bits = ["public", "static", " ", " ", "\n", "x", "int", "run", "(", "(", ")", "a, b", "{", "}", ";", "é", "publicfoo", "xprivate"]
    texts = ["".join(random.choice(bits) for _ in range(random.randint(1, 40))) for _ in range(3000)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", member_count(F.lit("cs"), F.col("t")).alias("n")).collect()
    assert {r["i"]: r["n"] for r in got} == {i: len(whole.findall(t)) for i, t in enumerate(texts)}
