"""Secret scans with a trigram index.

From each rule's regular expression a Boolean query of trigrams is derived: alternatives of sets of
trigrams that a match must hold. Postings (trigram, text) are kept for the trigrams of the queries; a
text is a candidate for a rule if the postings of one of its alternatives meet there. Candidates are
verified with the expression, and only their texts are joined with the postings; a rule whose expression has no
mandatory trigram scans all texts where they are read.

All of it is DataFrame functions: texts are matched in the JVM, and postings meet by grouping. A
match's place follows from the lengths of the pieces between matches.

Defined cases: a null text counts as empty and has no spans; a null id is an id like others; each
repeated row has its own result. Texts of any length are scanned whole; spans that start together are in the order
of the rules. An empty table gives an empty one. Extra columns are left out. Trigrams are those of the text
in lower case, so a letter that lower-cases to ASCII can make a candidate, never a match.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import materialize, table


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group whose length counts
    least: int = 1  # so many characters it has at least
    any_case: bool = False
    whole: str | None = None  # an expression whose matches are those that are long enough, where there is one

    @property
    def scanned(self) -> str:
        return ("(?i)" if self.any_case else "") + (self.whole or self.pattern)


#: The base rules, then public formats of credentials.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, any_case=True),
    # A match is a run of its characters to the end, so a least length can be asked for at once.
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, whole=r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]+", 0, 24, whole=r"[0-9a-f]{24,}"),
)
FURTHER = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"sk_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("url_password", r"://[^\s/:@]+:([^\s/@]+)@"),
)
RULES = BASE + FURTHER

#: Alternatives that a query may have, and characters that a class may have to be spelled out.
MOST_ALTERNATIVES = 64
MOST_CHARACTERS = 8
#: Matches of a text up to which its spans are gathered in one fold, which copies what it has at each step; of more, running sums over rows give
#: the places. A match has LEAST_MATCH characters or more, so a text shorter than both together hasn't more.
FOLD_MATCHES, LEAST_MATCH = 4000, 7
#: Candidates that may be broadcast: a hash and a few numbers each.
BROADCAST_ROWS = 1_000_000

Query = tuple[frozenset[str], ...]


def _texts(tree) -> list[set[str] | None]:
    """The parts of a concatenation: all texts that a part can be, or None where that is open."""
    out: list[set[str] | None] = []
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            out.append({chr(arg).lower()})
        elif name == "IN":
            spelled = _class(arg)
            out.append(spelled if spelled and len(spelled) <= MOST_CHARACTERS else None)
        elif name == "SUBPATTERN":
            out.extend(_texts(arg[-1]))
        elif name == "BRANCH":
            whole: set[str] | None = set()
            for branch in arg[1]:
                parts = _texts(branch)
                if any(p is None for p in parts):
                    whole = None
                    break
                whole |= {"".join(x) for x in product(*parts)}
            out.append(whole)
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = arg
            parts = _texts(inner)
            if low == 0 and high == 1 and all(p is not None for p in parts):
                out.append({"".join(x) for x in product(*parts)} | {""})
            elif low == high and low <= 8:
                out.extend(parts * low)
            else:
                out.extend(parts * min(low, 8))
                out.append(None)
        else:
            out.append(None)
    return out


def _class(parts) -> set[str] | None:
    out = set()
    for op, arg in parts:
        if str(op) == "LITERAL":
            out.add(chr(arg).lower())
        elif str(op) == "RANGE" and arg[1] - arg[0] < MOST_CHARACTERS:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def trigram_query(pattern: str) -> Query | None:
    """Alternatives of trigram sets, one of which each match has whole; None if there are no mandatory ones."""
    runs: list[set[str]] = [{""}]
    for part in _texts(re._parser.parse(pattern)):
        if part is None or len(runs[-1]) * len(part) > MOST_ALTERNATIVES:
            runs.append(part if part is not None and len(part) <= MOST_ALTERNATIVES else {""})
        else:
            runs[-1] = {a + b for a in runs[-1] for b in part}
    query: set[frozenset[str]] = {frozenset()}
    for run in runs:
        longer = {q | trigrams(t) for q in query for t in run}
        if len(longer) <= MOST_ALTERNATIVES:
            query = longer
    # An alternative that holds another one adds nothing.
    kept = [q for q in query if not any(o < q for o in query)]
    return None if frozenset() in kept else tuple(sorted(kept, key=sorted))


SPANS = "array<struct<start:int,kind:int,end:int>>"


def _pieces(text: Column, rule: Rule) -> Column:
    """For each match: characters between it and the one before (p), its own (m) and its group's (g)."""
    found = F.regexp_extract_all(text, F.lit(rule.scanned), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(rule.scanned), F.lit(rule.group)) if rule.group else found
    pieces = F.slice(F.split(text, rule.scanned, -1), F.lit(1), F.size(found))
    zipped = F.arrays_zip(pieces.alias("piece"), found.alias("match"), group.alias("group"))
    return F.transform(zipped, lambda x: F.struct(F.length(x["piece"]).alias("p"), F.length(x["match"]).alias("m"), F.length(x["group"]).alias("g")))


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """The spans of a rule: array of (start, number, end); counted in code points."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["p"]
        end = start + x["m"]
        span = F.array(F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["g"] >= rule.least, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    folded = F.aggregate(_pieces(text, rule), zero, step, lambda acc: acc["out"])
    return F.when(F.rlike(text, F.lit(rule.scanned)), folded).otherwise(F.array().cast(SPANS))


def _many(text: Column, rules: tuple[Rule, ...]) -> Column:
    """Whether a text has more matches of a rule than are folded; only texts long enough for that are looked at."""
    most = F.greatest(*[F.regexp_count(text, F.lit(r.scanned)) for r in rules], F.lit(0))
    return F.when(F.length(text) >= FOLD_MATCHES * LEAST_MATCH, most > FOLD_MATCHES).otherwise(False)


def _found_by_rows(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """doc_id, found of texts with many matches: a row for each match, and running sums over a text's rows."""
    texts = texts.withColumn("row", F.monotonically_increasing_id())
    out = texts.select("row", F.lit(0).alias("kind"), F.array().cast("array<struct<p:int,m:int,g:int>>").alias("pieces"), F.lit(0).alias("least")).where("false")
    for i, r in enumerate(rules):
        out = out.unionByName(texts.select("row", F.lit(i).alias("kind"), _pieces(F.col("text"), r).alias("pieces"), F.lit(r.least).alias("least")))
    matches = out.select("row", "kind", "least", F.posexplode("pieces").alias("pos", "x")).select("row", "kind", "least", "pos", "x.p", "x.m", "x.g")
    end = F.sum(F.col("p") + F.col("m")).over(Window.partitionBy("row", "kind").orderBy("pos")).cast("int")
    spans = matches.withColumn("end", end).where("g >= least").select("row", F.struct((F.col("end") - F.col("m")).alias("start"), "kind", "end").alias("span"))
    found = spans.groupBy("row").agg(F.array_sort(F.collect_list("span")).alias("found"))
    return texts.select("row", "doc_id").join(found, "row", "left").select("doc_id", F.coalesce("found", F.array().cast(SPANS)).alias("found"))


def postings(texts: DataFrame, wanted: list[str]) -> DataFrame:
    """(key, trigram) for the trigrams wanted that a text has."""
    lowered = texts.select("key", F.lower("text").alias("low"))
    there = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in wanted]))
    return lowered.select("key", F.explode(there).alias("trigram"))


def candidates(texts: DataFrame, queries: dict[int, Query]) -> DataFrame:
    """(key, rules): the rules for which the postings of one alternative meet in a text."""
    spark = texts.sparkSession
    wanted = sorted({t for q in queries.values() for alternative in q for t in alternative})
    parts = [(t, rule, k, 1 << i, (1 << len(a)) - 1) for rule, q in queries.items() for k, a in enumerate(q) for i, t in enumerate(sorted(a))]
    table_ = spark.createDataFrame(parts, "trigram string, rule int, alternative int, bit long, all_bits long")  # as large as the rules
    met = (
        postings(texts, wanted)
        .join(F.broadcast(table_), "trigram")
        .groupBy("key", "rule", "alternative")
        .agg(F.bit_or("bit").alias("bits"), F.first("all_bits").alias("all_bits"))
        .where("bits = all_bits")
    )
    return met.groupBy("key").agg(F.collect_set("rule").alias("rules"))


def scan(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and found (start, kind as a number, end; in order) for every row."""
    texts = documents.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    crowded = materialize(texts.where(_many(F.col("text"), rules)), "crowded")
    few = _found(texts.where(~_many(F.col("text"), rules)), rules)
    return few if crowded.isEmpty() else few.unionByName(_found_by_rows(crowded, rules))


def _found(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    # Rows of equal key have equal texts but for a collision, which makes candidates only.
    texts = texts.withColumn("key", F.xxhash64("doc_id", "text"))
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern))}
    empty = F.array().cast(SPANS)
    plain = [_spans(F.col("text"), r, i) for i, r in enumerate(rules) if i not in queries]
    every = texts.select("doc_id", "key", F.concat(empty, *plain).alias("plain"))
    if not queries:
        return every.select("doc_id", F.array_sort("plain").alias("found"))
    met = materialize(candidates(texts, queries), "candidates")
    few = met.count() <= BROADCAST_ROWS
    lists = [F.when(F.array_contains("rules", F.lit(i)), _spans(F.col("text"), rules[i], i)).otherwise(empty) for i in queries]
    hits = texts.select("key", "text").join(F.broadcast(met) if few else met, "key").select("key", F.concat(*lists).alias("hits"))
    hits = hits.where(F.size("hits") > 0).groupBy("key").agg(F.first("hits").alias("hits"))  # repeated rows have equal ones
    joined = every.join(hits, "key", "left")
    return joined.select("doc_id", F.array_sort(F.concat("plain", F.coalesce("hits", empty))).alias("found"))


def _written(found: Column, rules: tuple[Rule, ...]) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_written(base, RULES), 256).alias("base_sha256"), _written(F.col("found"), RULES).alias("spans"))


def _sql_pattern(rule: Rule) -> str:
    pattern = rule.pattern
    if rule.any_case:
        # In both cases letter by letter: (?i) would fold letters outside ASCII too. Classes have both cases as they are.
        out, depth, escaped = [], 0, 0
        for c in pattern:
            depth += (c == "[") - (c == "]")
            plain = c.isalpha() and not depth and not escaped
            escaped = 3 if c == "\\" else max(0, escaped - 1)
            out.append(f"[{c.upper()}{c.lower()}]" if plain else c)
        pattern = "".join(out)
    return pattern.replace("'", "''")


def secrets_sql() -> str:
    parts, lists = [], []
    for i, r in enumerate(RULES):
        p = _sql_pattern(r)
        parts.append(f"regexp_extract_all(t, '{p}', 0) AS m{i}, regexp_extract_all(t, '{p}', {r.group}) AS g{i}, CASE WHEN regexp_matches(t, '{p}') THEN regexp_split_to_array(t, '{p}') ELSE [] END AS p{i}")
        lists.append(f"""list_filter(list_transform(range(1, len(m{i}) + 1), lambda i: {{
            's': list_sum(list_transform(p{i}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m{i}[1:i - 1], lambda x: length(x))), 0),
            'k': {i}, 'n': length(m{i}[i]), 'g': length(g{i}[i])}}), lambda x: x.g >= {r.least})""")
    names = "[" + ", ".join(f"'{r.kind}'" for r in RULES) + "]"
    written = f"array_to_string(list_transform({{}}, lambda x: {names}[x.k + 1] || ':' || x.s::bigint || ':' || (x.s + x.n)::bigint), ',')"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        m AS MATERIALIZED (SELECT doc_id, {", ".join(parts)} FROM d),
        f AS MATERIALIZED (SELECT doc_id, list_sort(list_concat({", ".join(lists)})) AS f FROM m)
        SELECT doc_id, len(list_filter(f, lambda x: x.k = 0)) AS n_assign, len(list_filter(f, lambda x: x.k = 1)) AS n_access, len(list_filter(f, lambda x: x.k = 2)) AS n_hex,
            sha256({written.format(f"list_filter(f, lambda x: x.k < {len(BASE)})")}) AS base_sha256, {written.format("f")} AS spans FROM f"""
