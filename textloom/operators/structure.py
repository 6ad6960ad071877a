"""Classes and functions of source files, and the records of a corpus.

Patterns find where a class or function begins; where it ends depends on the language: with the brace
that closes the first one opened, or before the next definition at the left margin. An index of a file's braces and lines
is made once, so that each end is found by binary search. Offsets count UTF-16 units. Built-in regular
expression functions give no offsets, so files go through a Python function, each by itself and once for all kinds. A file whose
patterns take too long for one kind gives an error row instead of that kind's definitions.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import class_title, file_title, function_title
from textloom.operators.identifiers import top_identifiers

#: How a class begins, by language.
_JS_FUNCTION = r"(?:function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:function|\([^)]*\)\s*=>))"
#: Words, a name and parentheses before a brace; whether parentheses and a brace follow is looked at before words are told apart.
_C_FUNCTION = r"(?<!\w)(?=\w[\w\s]*+\([^)]*+\)\s*+\{)\w++(?:\s++(\w++))++\s*+\([^)]*+\)\s*+\{"
CLASS_PATTERNS = {
    "cs": r"(?:public|private|protected|internal|static|\s)+class\s+(\w+)",
    "java": r"(?:public|private|protected|static|\s)+class\s+(\w+)",
    "ts": r"(?:export\s+)?(?:abstract\s+)?class\s+(\w+)",
    "tsx": r"(?:export\s+)?(?:abstract\s+)?class\s+(\w+)",
    "js": r"class\s+(\w+)",
    "jsx": r"class\s+(\w+)",
    "py": r"class\s+(\w+)",
    "rb": r"class\s+(\w+)",
    "swift": r"(?:public|private|internal|open|fileprivate)?\s*class\s+(\w+)",
    "kt": r"(?:data\s+)?(?:open|abstract|sealed)?\s*class\s+(\w+)",
    "php": r"class\s+(\w+)",
    "go": r"type\s+(\w+)\s+struct",
    "rs": r"(?:pub\s+)?struct\s+(\w+)",
}
#: How a function begins, by language; its name is the first group that matched.
FUNCTION_PATTERNS = {
    "cs": r"(?:public|private|protected|internal|static|\s)+(?:\w+\s+)+(\w+)\s*\([^)]*\)\s*\{",
    "java": r"(?:public|private|protected|static|\s)+(?:\w+\s+)+(\w+)\s*\([^)]*\)\s*\{",
    "c": _C_FUNCTION,
    "cpp": _C_FUNCTION,
    "js": _JS_FUNCTION,
    "ts": _JS_FUNCTION,
    "jsx": _JS_FUNCTION,
    "tsx": _JS_FUNCTION,
    "py": r"def\s+(\w+)\s*\([^)]*\)\s*:",
    "go": r"func\s+(?:\(\w+\s+\*?\w+\)\s+)?(\w+)\s*\([^)]*\)",
    "rs": r"fn\s+(\w+)\s*(?:<[^>]*>)?\s*\([^)]*\)",
    "php": r"function\s+(\w+)\s*\([^)]*\)",
    "rb": r"def\s+(\w+)",
    "swift": r"func\s+(\w+)\s*(?:<[^>]*>)?\s*\([^)]*\)",
}
BY_MARGIN = ("py", "rb")
#: Fixed values. kind -> patterns, word that begins the next one at the margin, most units by margin, units where no end is found, most units of a body.
KINDS = {
    "class": (CLASS_PATTERNS, "class ", 50_000, 5_000, 100_000),
    "function": (FUNCTION_PATTERNS, "def ", 10_000, 500, 50_000),
}
LEAST_BODY = 10
#: Seconds that the patterns of one kind may take over one file; finding ends takes time in proportion to the file.
TIME_LIMIT = 20.0
#: Modifiers before a method, by the two patterns that would try every run of words from each of its words.
_MODIFIERS = {FUNCTION_PATTERNS["cs"]: "public|private|protected|internal|static", FUNCTION_PATTERNS["java"]: "public|private|protected|static"}
#: Characters of definitions that are handed on at once.
BATCH_CHARS = 4_000_000
#: White space of which a blank line may consist.
_BLANK = r"[\t\x0b-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*"
DEFINITIONS = "rel string, lang string, kind string, n int, name string, body string, error string"


def units(text: str) -> int:
    """Length in UTF-16 units."""
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


def _first_units(text: str, n: int) -> str:
    text = text[:n]
    return text if text.isascii() else text.encode("utf-16-le", "surrogatepass")[: 2 * n].decode("utf-16-le", "replace")


class Ends:
    """The ends of a file's definitions, by look-ups in what one pass over the file found."""

    def __init__(self, content: str) -> None:
        self.content = content
        self._margins: dict[str, list[int]] = {}

    @cached_property
    def _wide(self) -> list[int]:
        """Places of the characters of two units."""
        return [] if self.content.isascii() else [m.start() for m in re.finditer("[\U00010000-\U0010ffff]", self.content)]

    @cached_property
    def _braces(self) -> tuple[list[int], list[int], list[int], dict[int, list[int]]]:
        """Places of braces, the depth after each, the numbers of opening ones, and for each depth those of the closing ones that lead to it."""
        at = [m.start() for m in re.finditer("[{}]", self.content)]
        depth, opening, closing = [], [], defaultdict(list)
        now = 0
        for k, place in enumerate(at):
            if self.content[place] == "{":
                now += 1
                opening.append(k)
            else:
                now -= 1
                closing[now].append(k)
            depth.append(now)
        return at, depth, opening, closing

    def brace(self, start: int) -> int | None:
        """The place after the brace that brings the depth back to that of the start, once one was opened."""
        at, depth, opening, closing = self._braces
        first = bisect_left(at, start)
        k = bisect_left(opening, first)
        if k == len(opening):
            return None
        same = closing.get(depth[first - 1] if first else 0, [])
        found = bisect_left(same, opening[k])
        return at[same[found]] + 1 if found < len(same) else None

    @cached_property
    def _lines(self) -> tuple[list[int], list[int], list[int]]:
        """Where lines begin, how many units there are up to the end of each, and the numbers of those that aren't blank."""
        end = [m.start() for m in re.finditer("\n", self.content)]
        begin = [0, *(e + 1 for e in end)]
        full = [bisect_right(begin, m.start()) - 1 for m in re.finditer(rf"(?m)^(?!{_BLANK}$).", self.content)]
        end.append(len(self.content))
        return begin, np.add(end, np.searchsorted(self._wide, end)).tolist() if self._wide else end, full

    def _margin(self, word: str) -> list[int]:
        """Where the lines begin that begin with a word."""
        if word not in self._margins:
            self._margins[word] = [m.start() for m in re.finditer(f"(?m)^{re.escape(word)}", self.content)]
        return self._margins[word]

    def margin(self, start: int, word: str, most: int) -> int:
        """The end of the line before the next one at the margin that begins with a word, or of the first line that isn't blank and ends beyond so many units."""
        begin, unit_end, full = self._lines
        line = bisect_right(begin, start) - 1
        defined = self._margin(word)
        following = bisect_left(defined, begin[line + 1]) if line + 1 < len(begin) else len(defined)
        end = defined[following] - 1 if following < len(defined) else len(self.content)
        beyond = max(line + 1, bisect_right(unit_end, start + bisect_left(self._wide, start) + most))
        k = bisect_left(full, beyond)
        if k == len(full):
            return end
        last = full[k]
        return min(end, begin[last + 1] - 1 if last + 1 < len(begin) else len(self.content))

    def body(self, start: int, lang: str, kind: str) -> str:
        """The text of a definition that begins at a character."""
        patterns, word, margin_most, default, _ = KINDS[kind]
        if lang in BY_MARGIN:
            return self.content[start : self.margin(start, word, margin_most)]
        end = self.brace(start) if lang in patterns or lang in CLASS_PATTERNS else None
        return self.content[start:end] if end is not None else _first_units(self.content[start : start + default], default)


@lru_cache(maxsize=1)
def _ends(content: str) -> Ends:
    """The index of a file, which its kinds share."""
    return Ends(content)


def methods(modifiers: str, content: str) -> Iterator[tuple[int, str]]:
    """(start, name) of the matches of (?:modifiers|\\s)+(?:\\w+\\s+)+(\\w+)\\s*\\([^)]*\\)\\s*\\{, in time in proportion to the content.

    Only the run of words right before a parenthesis can lead to it, so each run is read once, backwards from there.
    """
    import regex

    words, back = regex.compile(r"\w+"), regex.compile(r"(?r)[\w\s]*")
    last, modifier, brace = regex.compile(r"(?r)(\w+)\s*"), regex.compile(modifiers), regex.compile(r"\s*+\{")
    begin, place, close, after = 0, content.find("("), -1, None
    while place >= 0:
        if close < place:
            close = content.find(")", place)
            if close < 0:
                return
            after = brace.match(content, close + 1)
        start = None
        if after:
            first = back.match(content, begin, place).start()
            word = words.match(content, first, place)
            rest = word.end() if word else first  # of the run without a word, or part of one, at its begin
            following = [m for _, m in zip(range(2), words.finditer(content, rest, place))]
            if len(following) == 2 and not word:
                start = first
            elif word and following:
                # What is left of the word after a modifier is a word itself.
                found = (m.start() for m in modifier.finditer(content, first, rest, overlapped=True) if len(following) == 2 or m.end() < rest)
                start = next(found, rest if len(following) == 2 else None)
        if start is None:
            begin = place + 1
        else:
            yield start, last.match(content, start, place)[1]
            begin = after.end()
        place = content.find("(", begin)


def definitions(lang: str, content: str, kind: str, time_limit: float | None = None) -> Iterator[tuple[str, str]]:
    """(name, body) of each definition; bodies of at most LEAST_BODY units and very long ones are left out.

    All matches are made before the first is given, so a file that takes too long gives an error and nothing else.
    """
    import regex

    patterns, _, _, _, most = KINDS[kind]
    if lang not in patterns:
        return
    if patterns[lang] in _MODIFIERS:
        found = list(methods(_MODIFIERS[patterns[lang]], content))
    else:
        found = [(m.start(), next((g for g in m.groups() if g is not None), "")) for m in regex.finditer(patterns[lang], content, timeout=time_limit)]
    ends = _ends(content)
    for start, name in found:
        if name.strip():
            text = ends.body(start, lang, kind)
            size = len(text) if len(text) >= most or text.isascii() else units(text)
            if LEAST_BODY < size < most:
                yield name, text


def extract_definitions(files: DataFrame, *kinds: str) -> DataFrame:
    """Of files (rel, lang, content): rel, lang, kind, n (order in the file and kind), name, body; or error, where a kind's patterns took too long.

    A file is read once for all kinds. Nested definitions may be many times as long as their file, so rows are handed on by their size.
    """
    kinds, limit = kinds or tuple(KINDS), TIME_LIMIT
    names = [c.split()[0] for c in DEFINITIONS.split(", ")]

    def found(rel: str, lang: str, content: str) -> Iterator[tuple]:
        for kind in kinds:
            try:
                rows = list(definitions(lang, content, kind, limit))  # all or none
            except TimeoutError:
                yield rel, lang, kind, -1, None, None, f"{kind} patterns took over {limit:g} s"
            else:
                yield from ((rel, lang, kind, n, name, text, None) for n, (name, text) in enumerate(rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size = [], 0
        for b in batches:
            # Each text is let go once it was read, and the whole batch before the next one comes.
            left = [(b.pop("rel").tolist(), b.pop("lang").tolist(), b.pop("content").tolist())]
            del b
            rels, langs, contents = (x[::-1] for x in left.pop())
            while rels:
                for row in found(rels.pop(), langs.pop(), contents.pop() or ""):
                    out.append(row)
                    size += len(row[5] or "")
                    if size > BATCH_CHARS:
                        yield pd.DataFrame(out, columns=names)
                        out, size = [], 0
        yield pd.DataFrame(out, columns=names)

    return files.select("rel", "lang", "content").mapInPandas(run, DEFINITIONS)


def with_patterns(files: DataFrame) -> DataFrame:
    """The files of languages that have patterns; others needn't be looked at."""
    return files.where(F.col("lang").isin(*sorted({*CLASS_PATTERNS, *FUNCTION_PATTERNS})))


def with_context(rel, lang, content):
    """The text that is indexed for a record."""
    return F.concat(F.lit("path: "), rel, F.lit("\nlang: "), lang, F.lit("\n\n"), content)


def records(files: DataFrame, root: str, found: DataFrame | None = None) -> DataFrame:
    """The corpus records of files (rel, abs_path, lang, size, content): a file's own, its classes, its functions.

    ``ordinal`` gives their order within a file; ``found`` has the files' definitions, if they are there already. Both kinds are made into
    records in one pass, so that files aren't parsed once for each.
    """
    found = extract_definitions(with_patterns(files)) if found is None else found
    rel, lang = F.translate("rel", "\\", "/"), F.col("lang")
    hints = top_identifiers(files.select(F.col("rel").alias("key"), F.col("content").alias("text")), 5)
    named = files.join(hints.withColumnRenamed("key", "rel"), "rel", "left")
    none = F.lit(None).cast("string")

    def shaped(df: DataFrame, kind, id_, title, class_name, function, size, text, ordinal) -> DataFrame:
        return df.select(
            id_.alias("id"), kind.alias("type"), title.alias("title"), class_name.alias("class_name"), function.alias("function"), rel.alias("path"), "abs_path", F.lit(root).alias("root"),
            lang.alias("lang"), size.cast("int").alias("size"), F.sha2(text, 256).alias("hash"), with_context(rel, lang, text).alias("text"), ordinal.alias("ordinal"),
        )

    content, text = F.col("content"), F.col("body")
    out = shaped(named, F.lit("file"), F.concat(rel, F.lit(".file")), file_title(rel, lang, F.coalesce("identifiers", F.array().cast("array<string>"))), none, none, F.col("size"), content, F.lit(-1).cast("long"))
    size = F.length(F.encode(text, "UTF-16LE")) / 2
    defined = found.where("error is null and kind in ('class', 'function')").drop("lang").join(files.select("rel", "abs_path", "lang"), "rel")
    name, kind = F.col("name"), F.col("kind")
    a_class, n = kind == "class", F.col("n").cast("long")
    id_ = F.concat(rel, F.lit("."), name, F.when(a_class, F.lit(".class")).otherwise(F.lit("")))
    title = F.when(a_class, class_title(name, rel, lang, text)).otherwise(function_title(name, rel, lang, text))
    ordinal = F.when(a_class, n).otherwise(n + (1 << 32))
    return out.unionByName(shaped(defined, kind, id_, title, F.when(a_class, name), F.when(~a_class, name), size, text, ordinal))
