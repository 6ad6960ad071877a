"""Text functions as Column expressions; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates tokens: anything but letters and decimal digits; characters above U+FFFF always do.
SEPARATOR = r"[[^\p{L}\p{Nd}]\x{10000}-\x{10FFFF}]+"

#: Letters whose lower case isn't one letter (İ), or may be a letter where they aren't yet (blocks with young letters, by the versions of Unicode in use).
LOWER_APART = r"[İ\u1C80-\u1C8F\uA7C0-\uA7FF]"

#: Words that are never shown as identifiers.
NOISE_WORDS = (
    "the", "and", "else", "null", "true", "false", "class", "public", "private", "protected", "static", "void",
    "int", "string", "return", "if", "for", "while", "this", "var", "let", "const", "function",
)

#: Verbs that hint at what a function does.
VERBS = ("get", "set", "build", "create", "update", "delete", "fetch", "render", "compute", "calculate", "process", "handle", "validate")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokenize(text: Column | str) -> Column:
    """Runs of letters and digits, split first and lower-cased then; a null text has no tokens.

    Texts without the letters whose lower case is parted otherwise are lower-cased whole, which takes a fraction of the time.
    """
    text, small = F.coalesce(col(text), F.lit("")), lambda t: F.replace(F.lower(t), F.lit("ς"), F.lit("σ"))
    parts = F.when(text.rlike(LOWER_APART), F.transform(F.split(text, SEPARATOR), small)).otherwise(F.split(small(text), SEPARATOR))
    return F.array_remove(parts, "")


def approx_tokens(text: Column | str) -> Column:
    """Runs of white space-free characters, at least 1."""
    return F.greatest(F.lit(1), F.size(F.filter(F.split(F.coalesce(col(text), F.lit("")), r"(?U)\s+"), lambda x: x != "")))


def verb_hint(body: Column | str) -> Column:
    """The first listed verb, else 'function'."""
    found = F.regexp_extract(col(body), r"(?i)\b(%s)\b" % "|".join(VERBS), 1)
    return F.lower(F.coalesce(F.nullif(found, F.lit("")), F.lit("function")))


def identifiers(text: Column | str) -> Column:
    """Words of at least four ASCII letters, digits and underscores that don't begin with a digit, noise left out."""
    runs = F.regexp_extract_all(col(text), F.lit(r"[\p{L}\p{Mn}\p{Nd}\p{Pc}]+"), F.lit(0))
    return F.filter(runs, lambda t: t.rlike(r"^[A-Za-z_][A-Za-z0-9_]{3,}$") & ~F.lower(t).isin(*NOISE_WORDS))


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def shorten_path(path: Column | str, keep: int = 3) -> Column:
    """A path of more than ``keep`` parts as its first two, '...' and the last keep - 2 (all for keep = 2)."""
    parts = F.filter(F.split(col(path), "/"), lambda p: p != "")
    n = keep - 2
    if n > 0:
        tail = F.slice(parts, -n, n)
    else:  # a start of -n counts from the left then, as in a sequence cut from index -(keep - 2)
        tail = F.slice(parts, F.lit(1 - n), F.greatest(F.lit(0), F.size(parts) + n))
    return F.when(F.size(parts) <= keep, col(path)).otherwise(F.array_join(F.concat(F.slice(parts, 1, 2), F.array(F.lit("...")), tail), "/"))


def tree_line(name: Column | str, width: int = 120) -> Column:
    line = F.concat(F.lit(" - "), col(name))
    return F.when(F.length(line) > width, F.substring(line, 1, width - 1)).otherwise(line)


def format_bytes(n: Column | str) -> Column:
    """1024 to the unit, up to GB, with up to two decimals."""
    x = col(n).cast("double")
    steps = [(1024.0**3, "GB"), (1024.0**2, "MB"), (1024.0, "KB")]
    out = F.concat(F.call_function("format_number", x, F.lit("0.##")), F.lit(" B"))
    for size, unit in reversed(steps):
        out = F.when(x >= size, F.concat(F.call_function("format_number", x / size, F.lit("0.##")), F.lit(f" {unit}"))).otherwise(out)
    return out


def format_time_span(seconds: Column | str) -> Column:
    """Whole seconds below a minute, then minutes and hours with one decimal."""
    x = col(seconds).cast("double")
    return F.when(x < 60, F.format_string("%.0fs", x)).when(x < 3600, F.format_string("%.1fm", x / 60)).when(x.isNotNull(), F.format_string("%.1fh", x / 3600))


def utf16_length(text: Column | str) -> Column:
    return (F.length(F.encode(col(text), "UTF-16LE")) / 2).cast("int")


def model_tag(tag: Column | str) -> Column:
    return F.replace(col(tag), F.lit(":"), F.lit("-"))


def file_title(path: Column, lang: Column, hints: Column) -> Column:
    """Name, language and up to five identifiers."""
    return F.concat_ws(" • ", basename(path), lang, F.nullif(F.array_join(hints, "/"), F.lit("")))


def function_title(name: Column, path: Column, lang: Column, body: Column) -> Column:
    return F.concat(name, F.lit(" — "), verb_hint(body), F.lit(" ("), basename(path), F.lit(" "), lang, F.lit(")"))


#: What counts as a member, by language. Of the modifiers and words before a name and its parentheses only the last two
#: are asked for: where more stand, these do too, in as many places. So no group repeats, which takes stack for each time.
MEMBER_PATTERNS = {
    ("cs", "java"): r"(?U)(?:public|private|protected|internal|static|\s)\w+\s+\w+\s*\([^)]*+\)",
    ("py",): r"(?U)def\s+\w+\s*\(",
    ("js", "ts", "jsx", "tsx"): r"(?U)(?:async\s+)?\w+\s*\([^)]*+\)\s*\{",
}


def member_count(lang: Column, body: Column) -> Column:
    out = F.lit(0)
    for langs, pattern in MEMBER_PATTERNS.items():
        out = F.when(lang.isin(*langs), F.regexp_count(body, F.lit(pattern))).otherwise(out)
    return out


def has_constructor(name: Column, lang: Column, body: Column) -> Column:
    def holds(*parts: str | Column) -> Column:
        return F.contains(body, F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]))

    declared = holds("public ", name, "(") | holds("private ", name, "(") | holds("protected ", name, "(")
    return (
        F.when(lang.isin("cs", "java"), declared)
        .when(lang == "py", holds("def __init__"))
        .when(lang.isin("js", "ts", "jsx", "tsx"), holds("constructor("))
        .when(lang == "swift", holds("init("))
        .when(lang == "kt", holds("constructor(") | holds("class ", name, "("))
        .otherwise(F.lit(False))
    )


def class_title(name: Column, path: Column, lang: Column, body: Column) -> Column:
    n = member_count(lang, body)
    members = F.when(n > 0, F.concat(n.cast("string"), F.lit(" members")))
    return F.concat_ws(" • ", name, members, F.when(has_constructor(name, lang, body), F.lit("constructor")), F.concat(basename(path), F.lit(" "), lang))
