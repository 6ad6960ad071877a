"""Line deduplication: of each component of near-equal lines one stays.

Equal lines are one vertex; they are grouped by their text. A line's signature has VALUES MinHash values of all its
five-character shingles, at every position (minima over shifted hashes xor seeds), in BANDS bands of ROWS values, each
value in two bands: two lines of similarity 0.8 share a band with probability 0.991, of 0.9 with 0.9998.
A pair that shares a band is a candidate if AGREE of the VALUES places of the signatures (four bits each) are equal:
at similarity 0.8 about 19 are. Of these a sketch of 512 bits (``sketches``) rules out most that aren't similar and none that are;
what it leaves is verified by the exact Jaccard similarity of all their shingles.

A bucket (the lines of a band's value) never gives all its pairs at once. First each of its lines meets the bucket's
first one; links make components by distributed union-find. A bucket that lies in one component is done, however many lines it has. In the
others the lines outside the bucket's largest component meet one line of that, and what is left meets all lines of other components; in buckets
of over MANY lines only pairs that sketches allow come out of that. The lines of crowded ones
meet by their rarest shingles instead: two lines that are similar enough share one of the first n - 0.8 n + 1 of their n shingles, in any fixed
order of shingles, so no such pair is parted. Each line stands there once for each of these shingles, however many crowded buckets it is in, and
PARTED_ROWS of these rows or so are dealt out at a time. Where very many
lines share a rare shingle and yet are in different components, all these pairs are looked at (by sketch), however many they are.
The first occurrence (smallest id, then place) of a component stays.

Disk: texts are shuffled where lines are grouped and where documents are put together again, and nowhere between: lines are read again by
ids that are broadcast in parts. Bands are dealt out a few at a time. What a step has shuffled, and tables that no later step reads, go at once.

All of it is DataFrame functions.

Defined cases: lines end at line feeds; blank lines are never removed; a null text stays null and the empty text
empty. A line of under five characters has one shingle; a line of any length is taken whole. A text that loses all
lines is empty, its row stays. Of equal lines in one text the first stays. A null id comes first. Repeated rows (equal id
and text) are one document and all get its result. An empty table gives an empty one. Extra columns pass through unless
they have the name of an output column. Lines of a text are matched to the vertices by 128 bits of hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import materialize, materialize_parts, table
from textloom.llm.components import components
from textloom.scratch import drop

SHINGLE = 5
SIMILARITY = 0.8
VALUES = 24
ROWS = 4
BANDS = 12
#: Places of two signatures that are equal, at least, in a candidate: at similarity 0.8 19.5 on average with a deviation of 1.9.
AGREE = 14
#: Positions of a line that are hashed in one row.
AT_ONCE = 16
#: Bands whose buckets are made at once.
BANDS_AT_ONCE = 3
#: Buckets of more lines give only those pairs that sketches allow.
MANY = 256
#: Buckets of more lines are parted; parting loses no pair. It makes a hundred rows or more of a line, so fewer lines are compared in less time than that takes.
CROWD = 16_384
#: Rows of parted lines that are dealt out at once, about 100 bytes each.
PARTED_ROWS = 4_000_000
#: Pairs that are all verified together; of more the likeliest one of each line goes first.
PAIRS_AT_ONCE = 1_000_000
#: Frequent shingles that are told apart by how frequent they are; at most so many can make up more than one in so many of all.
FREQUENT = 1_000_000
#: Ids or buckets that may be broadcast, 8 bytes each; beyond them the same joins shuffle, or are done in parts where texts would be shuffled.
BROADCAST_ROWS = 1_000_000
#: Lines whose ids are told apart by the bits above this one are counted together; 524,288 at most.
BLOCK_BITS = 19
#: Words of 64 bits of a line's sketch; a power of two.
_ODD = [f"o{i}" for i in range(8)]


def _seed(i: int) -> int:
    """A fixed 64-bit number for each place of a signature."""
    return int.from_bytes(hashlib.blake2b(b"line %d" % i, digest_size=8).digest(), "big", signed=True)


def _places(band: int) -> list[int]:
    """The values of a band: the first half of the bands are rows of a table of values, the others its diagonals."""
    half = BANDS // 2
    return [ROWS * band + c if band < half else ROWS * ((band + c) % half) + c for c in range(ROWS)]


def with_key(documents: DataFrame) -> DataFrame:
    return documents.withColumn("_key", F.xxhash64("doc_id", "text"))


def occurrences(keyed: DataFrame) -> DataFrame:
    """A row for each line that isn't blank: _key, doc (the id; the smallest number for null), pos, line."""
    rows = keyed.select("_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")).alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return rows.where(F.col("line").rlike(r"\S"))


def _hashes() -> tuple[Column, Column]:
    """128 bits that tell lines apart."""
    return F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g")


def signatures(lines: DataFrame) -> DataFrame:
    """For each distinct line an id, its hashes, how often it occurs, the line, its bands (b0 to b11, hashes of ROWS values each), and four bits of each value (s0, s1).

    Characters are cut out of UTF-32, where each has its place. Shifts bring other bits of a hash to the front: with
    seeds alone a short line's shingles would win in the same order again and again.
    """
    rows = lines.groupBy("line").agg(F.count("*").alias("times"))
    last = F.greatest(F.length("line") - SHINGLE, F.lit(0))
    rows = rows.select("line", "times", F.encode("line", "UTF-32").alias("units"), last.alias("last"))
    rows = rows.select("line", "times", "units", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(AT_ONCE))).alias("at"))
    hashed = rows.select("line", "times", *[F.xxhash64(F.substring("units", 4 * F.least(F.col("at") + j, F.col("last")) + 1, F.lit(4 * SHINGLE))).alias(f"h{j}") for j in range(AT_ONCE)])
    values = [F.min(F.least(*[F.shiftleft(f"h{j}", 4 * (i % 9)).bitwiseXOR(F.lit(_seed(i))) for j in range(AT_ONCE)])).alias(f"v{i}") for i in range(VALUES)]
    # Rows of a line are where the line was grouped: this needs no further shuffle.
    found = hashed.groupBy("line", "times").agg(*values)
    bands = [F.xxhash64(F.lit(i), *[f"v{j}" for j in _places(i)]).alias(f"b{i}") for i in range(BANDS)]
    return found.select(F.monotonically_increasing_id().alias("id"), *_hashes(), "times", "line", *bands, _nibbles(range(16)).alias("s0"), (_nibbles(range(16, VALUES)) - 2**31).cast("int").alias("s1"))


def _nibbles(places: range) -> Column:
    """Four bits of each of some values as one number (of which 2^31 is taken where it is to fit 32 bits); a value's low bits can be zeros and its high ones mostly are its seed's."""
    out = F.lit(0).cast("long")
    for k, i in enumerate(places):
        out = out.bitwiseOR(F.shiftleft(F.xxhash64(f"v{i}").bitwiseAND(F.lit(15).cast("long")), 4 * k))
    return out


def _agreement(x0: Column, x1: Column) -> Column:
    """How many places of two signatures are equal, of the xor of their two parts."""
    out = F.lit(VALUES)
    for x, ones in ((x0, F.lit(0x1111111111111111)), (x1, F.lit(0x11111111))):
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        out = out - F.bit_count(x.bitwiseAND(ones))
    return out


def _both(x: str, y: str) -> Column:
    return _agreement(F.col(f"{x}.s0").bitwiseXOR(F.col(f"{y}.s0")), F.col(f"{x}.s1").bitwiseXOR(F.col(f"{y}.s1")))


def bounded(df: DataFrame) -> DataFrame:
    """For a join: broadcast if the table, which is counted, is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def chosen(lines: DataFrame, ids: DataFrame) -> list[DataFrame]:
    """The lines (id, line) of some ids, each there once, in parts by ranges of ids; each part's ids may be broadcast, so that no text is shuffled."""
    rows = lines.select("id", "line")
    if ids.count() <= BROADCAST_ROWS:
        return [rows.join(F.broadcast(ids), "id", "left_semi")]
    blocks = ids.groupBy(F.shiftright("id", BLOCK_BITS).alias("block")).count().collect()
    starts, together = [], 0
    for block, n in sorted(map(tuple, blocks)):
        if not starts or together + n > BROADCAST_ROWS:
            starts.append(block << BLOCK_BITS)
            together = 0
        together += n
    ranges = [(F.col("id") >= lo) & (F.col("id") < hi) for lo, hi in zip(starts, [*starts[1:], 2**63 - 1], strict=True)]
    return [rows.where(own).join(F.broadcast(ids.where(own)), "id", "left_semi") for own in ranges]


def bucketed(lines: DataFrame) -> DataFrame:
    """The lines of all buckets of more than one, with the bucket's size and its first line: (v, n, own, first)."""
    bucket, parts = Window.partitionBy("v"), []
    for at in range(0, BANDS, BANDS_AT_ONCE):
        rows = lines.select(F.explode(F.array(*[f"b{i}" for i in range(at, min(at + BANDS_AT_ONCE, BANDS))])).alias("v"), F.struct("id", "s0", "s1").alias("own"))
        parts.append(rows.select("v", F.count("*").over(bucket).alias("n"), "own", F.min("own").over(bucket).alias("first")).where("n > 1"))
    return materialize_parts(parts, "members")


def first_pairs(members: DataFrame) -> DataFrame:
    """(a, b, agree) of each line with the first of its bucket."""
    star = members.where("own.id != first.id").select(F.col("own.id").alias("a"), F.col("first.id").alias("b"), _both("own", "first").alias("agree"))
    return star.where(F.col("agree") >= AGREE).distinct()


def open_buckets(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The lines of buckets that lie in more than one component, with their root and the bucket's largest component."""
    rows = members.join(bounded(roots.select(F.col("id").alias("_id"), "root")), F.col("own.id") == F.col("_id"), "left").select(*members.columns, F.coalesce("root", "own.id").alias("root"))
    sizes = rows.groupBy("v", "root").agg(F.count("*").alias("k")).groupBy("v").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("k", "root")).alias("main"))
    several = materialize(sizes.where("roots > 1").select("v", "main"), "open")
    shared = materialize(rows.join(bounded(several), "v"), "shared")
    drop(several)
    return shared


def star_pairs(shared: DataFrame) -> DataFrame:
    """(a, b, agree) of each line outside its bucket's largest component with a line of it, another one in each bucket."""
    own = F.max_by("own", F.xxhash64("v", "own.id")).alias("main_line")
    x = shared.where("root = main").groupBy("v").agg(own)
    pairs = shared.where("root != main").join(x, "v").withColumn("agree", _both("own", "main_line")).where(F.col("agree") >= AGREE)
    return pairs.select(F.greatest("own.id", "main_line.id").alias("a"), F.least("own.id", "main_line.id").alias("b"), "agree").distinct()


def prefixes(ids: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, prefix): hashes of each line's rarest shingles, so many that two lines of the similarity wanted share one.

    The order is the same for all lines: by how often a frequent shingle stands in them, rare ones first, then by hash.
    """
    return rarest(hashed_lines(lines, ids))


def hashes(texts: DataFrame) -> DataFrame:
    """(id, hashes) of (id, line): 64 bits of each distinct shingle."""
    return texts.select("id", F.array_distinct(shingles("line")).alias("hashes"))


def hashed_lines(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """The same of the lines of some ids, each there once, as a table."""
    return materialize_parts([hashes(some) for some in chosen(lines, ids)], "hashed")


def rarest(hashed: DataFrame) -> DataFrame:
    """The prefixes of lines (id, hashes)."""
    total = hashed.agg(F.sum(F.size("hashes"))).first()[0] or 0
    counts = hashed.select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > max(1, total // FREQUENT))
    rows = hashed.select("id", F.size("hashes").alias("n"), F.explode("hashes").alias("h")).join(F.broadcast(counts), "h", "left")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "h"))), lambda x: x["h"])
    # A line shares 0.8 n shingles with a similar one at least, so one of any n - 0.8 n + 1.
    least = F.ceil(F.col("n") * SIMILARITY - 1e-9)
    return rows.groupBy("id", "n").agg(ordered.alias("hashes")).select("id", F.slice("hashes", F.lit(1), (F.col("n") - least + 1).cast("int")).alias("prefix"))


def parted(crowded: DataFrame, hashed: DataFrame) -> DataFrame:
    """The lines of crowded buckets in buckets of a rare shingle: (v, at, own), each line once for each of its rarest ones and not for each of its buckets; ``at`` is the shingle's place among the line's."""
    own = materialize(crowded.groupBy("own.id").agg(F.first("own").alias("own")), "crowded")
    prefix = rarest(hashed.join(bounded(own.select("id")), "id", "left_semi"))
    return own.join(prefix, "id").select(F.posexplode("prefix").alias("at", "v"), "own").select("v", "at", "own")


def further_pairs(shared: DataFrame, roots: DataFrame, sketched: Sketched) -> DataFrame:
    """(a, b, agree) of open buckets, as a table: lines of different components that agree, one of them outside the bucket's largest."""
    largest = shared.agg(F.max("n")).first()[0] or 0
    few = min(MANY, CROWD)
    pairs = [_named(_agreeing(shared.where(F.col("n") <= few), "own.*", "root", "main"))]
    gone = []
    if few < min(largest, CROWD):
        rows = shared.where((F.col("n") > few) & (F.col("n") <= CROWD)).select("v", "own", "root", "main")
        # Only lines that agree with some other one need a sketch.
        ids = materialize(_that_agree(rows), "ids")
        rows = rows.join(sketched.of(ids), F.col("own.id") == F.col("_id")).drop("_id")
        pairs.append(_named(_agreeing(rows, "own.*", "set.*", "root", "main").where(_possible())))
        gone.append(ids)
    if largest > CROWD:
        crowded = shared.where(F.col("n") > CROWD).select("own")
        ids = materialize(crowded.select("own.id").distinct(), "ids")
        hashed = hashed_lines(sketched.lines, ids)
        rows = materialize(parted(crowded, hashed), "parted")
        drop(hashed)
        sketch = sketched.of(ids)
        times = -(-rows.count() // PARTED_ROWS)
        for k in range(times):
            part = open_buckets(rows.where(F.pmod("v", F.lit(times)) == k), roots)
            found = _agreeing(part.join(sketch, F.col("own.id") == F.col("_id")).drop("_id"), "own.*", "set.*", "root", "main", "at")
            # The first rare shingle that both have is followed by all others that both have.
            wanted = SIMILARITY / (1 + SIMILARITY) * (F.col("x.n") + F.col("y.n"))
            found = found.where(F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) >= wanted - 1e-9).where(_possible())
            gone.append(materialize(_named(found).distinct(), "parts"))
            pairs.append(gone[-1])
            drop(part)
        drop(rows)
    every = pairs[0]
    for more in pairs[1:]:
        every = every.unionByName(more)
    left = materialize(every.distinct(), "further")
    drop(*gone)
    return left


def _that_agree(rows: DataFrame) -> DataFrame:
    """The ids of lines that agree with one of another component in their bucket, either of them outside the bucket's largest."""
    side = lambda df, c: df.select(F.col("v").alias(f"{c}_v"), F.struct("own.*", "root").alias(c))
    outside, ids = rows.where("root != main"), []
    for these, others in ((outside, rows), (rows.where("root = main"), outside)):
        met = (F.col("x_v") == F.col("y_v")) & (F.col("x.root") != F.col("y.root")) & (_both("x", "y") >= AGREE)
        ids.append(side(these, "x").join(side(others, "y"), met, "left_semi").select("x.id"))
    return ids[0].unionByName(ids[1]).distinct()


def _agreeing(rows: DataFrame, *columns: str) -> DataFrame:
    """Pairs (x, y) of lines of one bucket that agree and are of different components, x outside the bucket's largest."""
    side = lambda c: F.struct(*columns).alias(c)
    pairs = rows.where("root != main").select("v", side("x")).join(rows.select("v", side("y")), "v").where(F.col("x.root") != F.col("y.root"))
    return pairs.where((F.col("y.root") == F.col("y.main")) | (F.col("x.id") > F.col("y.id"))).where(_both("x", "y") >= AGREE)


def _named(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b"), _both("x", "y").alias("agree"))


def likeliest(pairs: DataFrame) -> DataFrame:
    """The pair (a, b) of each line that agrees most."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("e"), "agree")
    best = ends.groupBy("e.id").agg(F.max_by("e.other", F.struct("agree", "e.other")).alias("other"))
    return best.select(F.greatest("id", "other").alias("a"), F.least("id", "other").alias("b")).distinct()


def shingles(line: str) -> Column:
    """64 bits of the shingle at each position of a line."""
    places = F.sequence(F.lit(0), F.greatest(F.length(line) - SHINGLE, F.lit(0)))
    # A function over an array of one encodes the line once.
    every = F.transform(F.array(F.encode(line, "UTF-32")), lambda units: F.transform(places, lambda i: F.xxhash64(F.substring(units, 4 * i + 1, F.lit(4 * SHINGLE)))))
    return F.get(every, 0)


def sketches(hashed: DataFrame) -> DataFrame:
    """(id, n, o0 to o7): how many shingles each line has, and for each of 512 bits whether an odd number of them falls on it.

    Bits in which two lines differ come from shingles that one of them alone has, so there are at least as many of these.
    """
    # Not explode: for that Spark works out all hashes once more, and before rows are chosen, to leave out empty ones.
    rows = hashed.select("id", F.explode_outer("hashes").alias("h"))
    bit = "shiftleft(1L, cast(h & 63 as int))"
    words = [F.expr(f"bit_xor(if((shiftrightunsigned(h, 6) & {len(_ODD) - 1}) = {k}, {bit}, 0L))").alias(o) for k, o in enumerate(_ODD)]
    return rows.groupBy("id").agg(F.count("*").alias("n"), *words)


def may_be_similar(x: Callable[[str], Column], y: Callable[[str], Column]) -> Column:
    """Whether sizes and sketches allow the similarity wanted; none of the pairs that have it is left out."""
    fit = F.least(x("n"), y("n")) >= SIMILARITY * F.greatest(x("n"), y("n")) - 1e-9
    differ = sum((F.bit_count(x(o).bitwiseXOR(y(o))) for o in _ODD[1:]), F.bit_count(x(_ODD[0]).bitwiseXOR(y(_ODD[0]))))
    return fit & (differ <= (1 - SIMILARITY) / (1 + SIMILARITY) * (x("n") + y("n")) + 1e-9)


def _possible() -> Column:
    return may_be_similar(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}"))


class Sketched:
    """Sketches of lines, each made when it is first asked for."""

    def __init__(self, lines: DataFrame):
        self.lines, self.known = lines, None

    def of(self, ids: DataFrame) -> DataFrame:
        """(_id, set) of some ids, each there once."""
        new = ids if self.known is None else materialize(ids.join(self.known.select("id"), "id", "left_anti"), "ids")
        if self.known is None or not new.isEmpty():
            made = materialize_parts([sketches(hashes(some)) for some in chosen(self.lines, new)], "sketches")
            self.known = made if self.known is None else self.known.unionByName(made)
        if new is not ids:
            drop(new)
        known = self.known.select(F.col("id").alias("_id"), F.struct("n", *_ODD).alias("set"))
        return known.join(bounded(ids.select(F.col("id").alias("_id"))), "_id", "left_semi")


def verified(pairs: DataFrame, sketched: Sketched) -> DataFrame:
    """The pairs (a, b) whose lines are similar enough, as a table.

    Sizes and sketches that rule the similarity out are seen before lines are read, and only lines of the pairs left are.
    """
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    known = sketched.of(ids)
    side = lambda c, to: known.select(F.col("_id").alias(c), F.col("set").alias(to))
    possible = pairs.select("a", "b").join(side("a", "x"), "a").join(side("b", "y"), "b").where(_possible())
    possible = materialize(possible.select("a", "b", (F.col("x.n") + F.col("y.n")).alias("n")), "possible")
    needed = materialize(possible.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    texts = materialize_parts(chosen(sketched.lines, needed), "texts")
    # Lines are sent to their pairs, not their shingles, which take eight times as much.
    joined = possible.join(texts.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
    both = F.size(F.array_intersect(shingles("x"), shingles("y")))
    links = materialize(joined.where(both * (1 + SIMILARITY) >= SIMILARITY * F.col("n") - 1e-9).select("a", "b"), "links")
    drop(ids, possible, needed, texts)
    return links


def across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose lines aren't in one component yet."""
    root = lambda c, to: roots.select(F.col("id").alias(c), F.col("root").alias(to))
    return pairs.join(root("a", "ra"), "a", "left").join(root("b", "rb"), "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select(*pairs.columns)


def near_lines(lines: DataFrame) -> DataFrame:
    """(id, root) of the distinct lines that have a link."""
    members = bucketed(lines)
    sketched = Sketched(lines)
    star = materialize(first_pairs(members), "pairs")
    members = members.drop("first")
    roots = components(verified(star, sketched), native=True)
    drop(star)

    def joined(some: DataFrame) -> DataFrame:
        links = verified(some, sketched)
        return roots if links.isEmpty() else components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(links), native=True)

    # A bucket's lines meet one of its largest component before they meet all.
    shared = open_buckets(members, roots)
    star = materialize(star_pairs(shared), "pairs")
    drop(shared)
    roots = joined(star)
    shared = open_buckets(members, roots)
    drop(star, members)
    left = further_pairs(shared, roots, sketched)
    drop(shared)
    n = left.count()
    if n > PAIRS_AT_ONCE:
        some = materialize(likeliest(left), "some")
        roots = joined(some)
        rest = materialize(across(left, roots), "some")
        drop(some, left)
        left = rest
    if n:
        roots = joined(left)
    drop(left, *([sketched.known] if sketched.known is not None else []))
    return roots


def dedup_lines(documents: DataFrame) -> DataFrame:
    """The columns given, with the text's remaining lines, n_lines and n_removed."""
    source = documents.select(*[c for c in documents.columns if c not in ("n_lines", "n_removed", "_key", "_gone")])
    keyed = with_key(source)
    lines = occurrences(keyed)
    distinct = materialize(signatures(lines), "lines")
    roots = near_lines(distinct)
    # Lines that occur again, or are near others: each occurrence but the component's first goes.
    roots = roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct())
    doubtful = distinct.select("id", "h", "g", "times").join(roots, "id", "left").where("times > 1 or root is not null")
    doubtful = materialize(doubtful.select("h", "g", F.coalesce("root", "id").alias("root")), "doubtful")
    drop(distinct)
    # A document that stands in several rows has its lines once.
    again = lines.select("_key", "doc", "pos", *_hashes()).join(doubtful, ["h", "g"]).select("root", "doc", "pos", "_key").distinct()
    again = materialize(again, "again")
    drop(doubtful)
    # Each component's first place, taken out of all places: a component in very many texts meets in no task.
    first = again.groupBy("root").agg(F.min(F.struct("doc", "pos", "_key")).alias("first")).select("first._key", "first.pos")
    gone = again.join(first, ["_key", "pos"], "left_anti").groupBy("_key").agg(F.collect_set("pos").alias("_gone"))
    joined = keyed.join(gone, "_key", "left")
    parts = F.split("text", "\n", -1)
    # A function over an array of one cuts the text once; a place that stays is then one look-up.
    rebuilt = F.transform(F.array(parts), lambda p: F.array_join(F.transform(F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col("_gone"))), lambda i: F.get(p, i)), "\n"))
    left = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.get(rebuilt, 0))
    removed = F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(parts))
    return joined.select(*[left.alias("text") if c == "text" else F.col(c) for c in source.columns], n_lines.cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents with their remaining lines; n_chars is counted anew, texts left empty go."""
    out = dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.where(~((F.col("n_removed") > 0) & (F.trim("text") == ""))).select(*docs.columns)
