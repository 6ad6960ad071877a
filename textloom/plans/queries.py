"""Queries over the test tables, one for each operator or group of operators, and SQL that gives the same rows."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom import scratch
from textloom.functions import text as fn
from textloom.operators import events, merge, retrieval, structure
from textloom.operators.identifiers import top_identifiers
from textloom.operators.stored_index import StoredIndex
from textloom.sources import corpus as lines
from textloom.sources import tree
from textloom.sources.model_server import ModelServer, answers
from textloom.sources.partitioned import PartitionedCorpus, refresh

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

QUESTION = "thre ernd ation with idiot the"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_index"), "text")


# Shared parts of the SQL: term counts, inverse frequencies, weights.
_SEP = r"([^\p{L}\p{Nd}]|[\x{10000}-\x{10FFFF}])+"
_TOKENS = f"list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '{_SEP}'), lambda t: replace(lower(t), 'ς', 'σ')), lambda t: t <> '')"
_TF = f"tf AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents) GROUP BY ALL)"
_IDF = "idf AS (SELECT token, count(*) AS df, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 0.5)) + 1 AS idf FROM tf GROUP BY token)"
_W = "raw AS (SELECT doc_id, token, tf, (1 + ln(tf)) * idf AS raw FROM tf JOIN idf USING (token)), w AS (SELECT doc_id, token, tf, raw / (sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) + 1e-8) AS w FROM raw)"


def _q(source: str) -> str:
    """Weights of the queries in ``source`` (query_id, text)."""
    return f"""qtf AS (SELECT query_id, token, count(*) AS tf FROM (SELECT query_id, unnest({_TOKENS}) AS token FROM ({source})) GROUP BY ALL),
        qraw AS (SELECT query_id, token, (1 + ln(tf)) * idf AS raw FROM qtf JOIN idf USING (token)),
        qw AS (SELECT query_id, token, raw / (sqrt(sum(raw * raw) OVER (PARTITION BY query_id)) + 1e-8) AS qw FROM qraw)"""


def _top(question: str, k: int) -> str:
    return f"""WITH {_TF}, {_IDF}, {_W}, {_q(f"SELECT 0 AS query_id, '{question}' AS text")},
        s AS (SELECT doc_id, sum(w * qw) AS s FROM w JOIN qw USING (token) GROUP BY doc_id),
        top AS (SELECT doc_id AS doc_index, round(coalesce(s, 0), 6) AS score, text FROM documents LEFT JOIN s USING (doc_id) ORDER BY score DESC, doc_index LIMIT {k})"""


@query(f"WITH {_TF} SELECT doc_id, token, tf FROM tf")
def tokenize_counts(spark, sf_dir):
    return retrieval.term_counts(read(spark, sf_dir, "documents"), "doc_id")


@query(f"WITH {_TF}, {_IDF} SELECT token, df, round(idf, 6) AS idf FROM idf")
def vocab_df(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return retrieval.inverse_frequencies(retrieval.term_counts(docs, "doc_id"), docs.count(), "doc_id").withColumn("idf", F.round("idf", 6))


@query(f"WITH {_TF}, {_IDF}, {_W} SELECT doc_id AS doc_index, token, tf, round(w, 6) AS w FROM w")
def tfidf_postings(spark, sf_dir):
    return retrieval.TfIdfIndex.build(corpus(spark, sf_dir), persist=False).postings.withColumn("w", F.round("w", 6))


@query(f"{_top(QUESTION, 3)} SELECT * FROM top")
def retrieve_top3(spark, sf_dir):
    return retrieval.TfIdfIndex.build(corpus(spark, sf_dir), persist=False).retrieve(QUESTION, 3)


@query(f"{_top('qqqq zzzzq', 5)} SELECT * FROM top")
def retrieve_oov(spark, sf_dir):
    return retrieval.TfIdfIndex.build(corpus(spark, sf_dir), persist=False).retrieve("qqqq zzzzq", 5)


@query(f"""WITH {_TF}, {_IDF}, {_W}, {_q("SELECT item_id AS query_id, text FROM benchmark")},
    s AS (SELECT query_id, doc_id AS doc_index, round(sum(w * qw), 6) AS score FROM w JOIN qw USING (token) GROUP BY ALL),
    f AS (SELECT item_id AS query_id, doc_id AS doc_index, 0.0 AS score FROM benchmark CROSS JOIN (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 3)),
    a AS (SELECT query_id, doc_index, max(score) AS score FROM (SELECT * FROM s UNION ALL SELECT * FROM f) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_index) AS rank FROM a)
    SELECT query_id, doc_index, score::double AS score, rank FROM r WHERE rank <= 3""")
def retrieve_batch(spark, sf_dir):
    queries = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.TfIdfIndex.build(corpus(spark, sf_dir)).retrieve_batch(queries, 3).withColumn("rank", F.col("rank").cast("long"))


def _refreshed(spark, sf_dir) -> StoredIndex:
    """An index of the documents but for French ones, where every é was an e, refreshed to the documents as they are, but for German ones."""
    docs = corpus(spark, sf_dir).join(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_index"), "lang"), "doc_index")
    old = docs.where("lang <> 'fr'").select("doc_index", F.replace("text", F.lit("é"), F.lit("e")).alias("text"))
    index = StoredIndex.open(spark, scratch.path(spark, "index")).refresh(old)
    changed = docs.where("lang <> 'de'").join(old.select("doc_index", F.sha2("text", 256).alias("was")), "doc_index", "left").where(F.col("was").isNull() | (F.col("was") != F.sha2("text", 256)))
    return index.refresh(changed.select("doc_index", "text"), docs.where("lang = 'de'").select("doc_index"))


def _without_german(sql: str) -> str:
    return sql.replace("FROM documents", "FROM (SELECT * FROM documents WHERE lang <> 'de')")


@query(_without_german(f"WITH {_TF}, {_IDF}, {_W} SELECT doc_id AS doc_index, token, tf, round(w, 6) AS w FROM w"))
def index_refreshed(spark, sf_dir):
    return _refreshed(spark, sf_dir).postings().withColumn("w", F.round("w", 6))


@query(_without_german(f"{_top(QUESTION, 3)} SELECT * FROM top"))
def index_retrieve(spark, sf_dir):
    return _refreshed(spark, sf_dir).retrieve(QUESTION, 3)


@query(f"{_top(QUESTION, 3)} SELECT 'Context:' || chr(10) || string_agg(text, chr(10) || '---' || chr(10) ORDER BY score DESC, doc_index) || chr(10) || chr(10) || 'Answer clearly:' AS prompt FROM top")
def context_prompt(spark, sf_dir):
    hits = retrieval.TfIdfIndex.build(corpus(spark, sf_dir), persist=False).retrieve(QUESTION, 3)
    return retrieval.context(hits).select(retrieval.prompt(F.col("context")).alias("prompt"))


_NOISE = ", ".join(f"'{w}'" for w in fn.NOISE_WORDS)
_IDENTIFIERS = rf"""i AS (SELECT doc_id, w, p FROM (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS p FROM (SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{Mn}}\p{{Nd}}\p{{Pc}}]+') AS l FROM documents)) WHERE regexp_full_match(w, '[A-Za-z_][A-Za-z0-9_]{{3,}}') AND lower(w) NOT IN ({_NOISE})),
    c AS (SELECT doc_id, lower(w) AS low, count(*) AS n, arg_min(w, p) AS shown FROM i GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, low) AS r FROM c),
    t AS (SELECT doc_id, string_agg(shown, '/' ORDER BY r) AS ids FROM r WHERE r <= 5 GROUP BY doc_id)"""


@query(f"WITH {_IDENTIFIERS} SELECT doc_id, ids AS identifiers FROM t")
def top_identifiers_query(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    return top_identifiers(docs, 5).select(F.col("key").alias("doc_id"), F.array_join("identifiers", "/").alias("identifiers"))


@query(f"""WITH {_IDENTIFIERS} SELECT 'docs/' || source || '/' || d.doc_id || '.txt.file' AS id, 'file' AS type, concat_ws(' • ', d.doc_id || '.txt', 'txt', ids) AS title,
    'docs/' || source || '/' || d.doc_id || '.txt' AS path, 'txt' AS lang, strlen(text)::int AS size, sha256(text) AS hash FROM documents d LEFT JOIN t USING (doc_id)""")
def file_records(spark, sf_dir):
    files = _documents_as_files(spark, sf_dir)
    return structure.records(files, "/data").where("type = 'file'").select("id", "type", "title", "path", "lang", "size", "hash")


def _documents_as_files(spark, sf_dir):
    rel = F.concat(F.lit("docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return read(spark, sf_dir, "documents").select(rel.alias("rel"), F.concat(F.lit("/data/"), rel).alias("abs_path"), F.lit("txt").alias("lang"), F.octet_length("text").alias("size"), F.col("text").alias("content"))


_VERB = "coalesce(nullif(lower(regexp_extract(text, '(?i)\\b(" + "|".join(fn.VERBS) + ")\\b', 1)), ''), 'function')"


@query(f"SELECT conv_id, turn, {_VERB} AS hint FROM conversations")
def verb_hint(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", fn.verb_hint("text").alias("hint"))


@query(r"SELECT doc_id, greatest(1, len(list_filter(regexp_split_to_array(text, '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda x: x <> '')))::int AS n FROM documents")
def approx_tokens(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", fn.approx_tokens("text").alias("n"))


@query("SELECT event_id, coalesce(list_contains(json_keys(props), 'page'), false) AS has_page, props->>'$.page' AS page FROM events")
def json_presence(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    return rows.select("event_id", lines.has_field("props", "page").alias("has_page"), F.get_json_object("props", "$.page").alias("page"))


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_index, sha256(coalesce(text, '')) AS text_hash FROM documents WHERE lang <> 'fr'")
def corpus_load(spark, sf_dir):
    """Documents as lines of a corpus; those in French are records without a text, which the corpus passes over."""
    record = F.when(F.col("lang") == "fr", F.to_json(F.struct("doc_id", "lang"))).otherwise(F.to_json(F.struct("doc_id", "text"), {"ignoreNullFields": "false"}))
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), record.alias("value"))
    return lines.texts(rows).select("doc_index", F.sha2("text", 256).alias("text_hash"))


# Documents as an old corpus: three entries a source file. In the new state every 'é' is an 'e', and files in whose own entry there is one were changed.
_OLD = """old AS (SELECT doc_id AS pos, CASE doc_id % 3 WHEN 0 THEN 'f' || (doc_id // 3) || '.txt.file' WHEN 1 THEN 'f' || (doc_id // 3) || '.txt.Part.class' ELSE 'f' || (doc_id // 3) || '.txt.run' END AS id, sha256(text) AS hash, text AS json FROM documents),
    p AS (SELECT pos, id, replace(json, 'é', 'e') AS json FROM old WHERE ends_with(id, '.file') AND sha256(replace(json, 'é', 'e')) <> hash)"""


@query(f"""WITH {_OLD}, k AS (SELECT * FROM old o WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.id = o.id OR (o.id NOT LIKE '%.file' AND starts_with(o.id, left(p.id, length(p.id) - 5) || '.'))))
    SELECT 1 AS section, lpad(pos::varchar, 20, '0') AS ord, 0::bigint AS sub, sha256(json) AS json_hash FROM k
    UNION ALL SELECT 2, '/data/' || left(id, length(id) - 5), pos, sha256(json) FROM p""")
def corpus_merge(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    file = F.concat(F.lit("f"), F.expr("doc_id div 3").cast("string"), F.lit(".txt"))
    suffix = F.when(F.col("doc_id") % 3 == 0, ".file").when(F.col("doc_id") % 3 == 1, ".Part.class").otherwise(".run")
    existing = docs.select(F.col("doc_id").alias("pos"), F.concat(file, suffix).alias("id"), F.sha2("text", 256).alias("hash"), F.col("text").alias("json"))
    files = existing.where(F.col("id").endswith(".file")).select("pos", "id", F.replace("json", F.lit("é"), F.lit("e")).alias("json"))
    again = merge.changed_files(files.withColumn("hash", F.sha2("json", 256)), existing)
    new = again.select(F.concat(F.lit("/data/"), F.expr("substring(id, 1, length(id) - 5)")).alias("abs_path"), F.col("pos").alias("ordinal"), "json")
    return merge.merge(existing, again.select("id"), new).select("section", "ord", "sub", F.sha2("json", 256).alias("json_hash"))


@query("SELECT source || '-' || lang AS id, min(doc_id) AS pos, arg_max(sha256(text), doc_id) AS hash FROM documents GROUP BY ALL")
def dedupe_last_wins(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    entries = docs.select(F.col("doc_id").alias("pos"), F.concat_ws("-", "source", "lang").alias("id"), F.sha2("text", 256).alias("hash"), F.col("text").alias("json"))
    return merge.last_wins(entries).select("id", "pos", "hash")


@query("""SELECT 'docs/' || source || '/' || doc_id || '.txt.file' AS id, CASE WHEN lang = 'fr' OR contains(text, 'é') THEN 2 ELSE 1 END::bigint AS epoch, sha256(text) AS hash FROM documents""")
def corpus_buckets(spark, sf_dir):
    """A corpus in buckets of the documents but for French ones, where every é was an e; then refreshed to the documents as they are."""
    files = _documents_as_files(spark, sf_dir).withColumn("error", F.lit(None).cast("string"))
    old = files.join(read(spark, sf_dir, "documents").where("lang <> 'fr'").select(F.concat(F.lit("docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("rel")), "rel", "left_semi")
    store = PartitionedCorpus.open(spark, scratch.path(spark, "corpus"), 32)
    store, _ = refresh(old.withColumn("content", F.replace("content", F.lit("é"), F.lit("e"))), store, "/data")
    store, _ = refresh(files, store, "/data")
    return store.entries().select("id", "epoch", "hash")


@query("""SELECT conv_id, turn, CASE WHEN text IS NULL THEN NULL WHEN contains(text, '?') THEN NULL ELSE trim(replace(text, 'e', '3'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) END AS answer,
    CASE WHEN contains(text, '?') THEN 'ValueError: no questions' END AS error FROM conversations""")
def answer_prompts(spark, sf_dir):
    """All turns asked of a stand-in for the server, which writes each e as a 3 and refuses questions."""
    turns = read(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("id"), F.col("text").alias("prompt"))
    return answers(turns, ModelServer(transport=_stand_in)).select("id.conv_id", "id.turn", "answer", "error")


def _stand_in(method, address, body, timeout):
    text = body["messages"][0]["content"]
    if "?" in text:
        raise ValueError("no questions")
    yield json.dumps({"message": {"content": text.replace('e', '3')}})


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents e WHERE e.doc_id = d.doc_id AND sha256(e.text) = sha256(replace(d.text, 'é', 'e')))")
def changed_files(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id"), "text")
    now = docs.withColumn("hash", F.sha2(F.replace("text", F.lit("é"), F.lit("e")), 256))
    return merge.changed_files(now, docs.withColumn("hash", F.sha2("text", 256))).select("doc_id")


_PATH = "regexp_replace(url, '^[a-z]+://', '')"


@query(f"""WITH p AS (SELECT page_id, {_PATH} AS rel FROM pages), x AS (SELECT page_id, regexp_replace(rel, '/[^/]*$', '') AS dir, ' - ' || regexp_extract(rel, '[^/]*$') AS line FROM p)
    SELECT dir, string_agg(CASE WHEN length(line) > 20 THEN left(line, 19) ELSE line END, chr(10) ORDER BY page_id) AS lines FROM x GROUP BY dir""")
def dir_listing(spark, sf_dir):
    paths = read(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), F.regexp_replace("url", "^[a-z]+://", "").alias("rel"))
    return tree.directory_lines(paths, 20).select("dir", F.array_join("lines", "\n").alias("lines"))


@query(f"""WITH p AS (SELECT page_id, {_PATH} AS path FROM pages), s AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS l FROM p)
    SELECT page_id, CASE WHEN len(l) <= 3 THEN path ELSE array_to_string(l[1:2] || ['...'] || l[-1:], '/') END AS short FROM s""")
def shorten_path(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", fn.shorten_path(F.regexp_replace("url", "^[a-z]+://", ""), 3).alias("short"))


def _commands(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("signup", "click", "view"), "deposit").otherwise("withdraw")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return rows.select(F.col("user_id").cast("string").alias("account_id"), F.row_number().over(order).cast("long").alias("seq"), kind.alias("type"), F.col("value").cast(events.MONEY).alias("amount"))


_COMMANDS = "c AS (SELECT user_id::varchar AS account_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CASE WHEN event_type IN ('signup', 'click', 'view') THEN 'deposit' ELSE 'withdraw' END AS type, value::decimal(18,2) AS amount FROM events)"


@query(f"WITH {_COMMANDS} SELECT account_id, sum(CASE type WHEN 'deposit' THEN amount ELSE -amount END)::decimal(18,2)::double AS balance, count(*) AS version FROM c GROUP BY account_id")
def event_replay(spark, sf_dir):
    return events.replay(_commands(spark, sf_dir)).withColumn("balance", F.col("balance").cast("double"))


@query(f"""WITH RECURSIVE {_COMMANDS}, f AS (
        SELECT account_id, seq, type, amount, amount > 0 AND type = 'deposit' AS accepted, (CASE WHEN amount > 0 AND type = 'deposit' THEN amount ELSE 0 END)::decimal(18,2) AS balance FROM c WHERE seq = 1
        UNION ALL SELECT c.account_id, c.seq, c.type, c.amount, c.amount > 0 AND (c.type = 'deposit' OR f.balance >= c.amount),
            (CASE WHEN c.amount > 0 AND c.type = 'deposit' THEN f.balance + c.amount WHEN c.amount > 0 AND f.balance >= c.amount THEN f.balance - c.amount ELSE f.balance END)::decimal(18,2)
        FROM f JOIN c ON c.account_id = f.account_id AND c.seq = f.seq + 1)
    SELECT account_id, seq, type, amount::double AS amount, accepted, balance::double AS balance FROM f""")
def account_guarded(spark, sf_dir):
    return events.guarded(_commands(spark, sf_dir)).withColumns({c: F.col(c).cast("double") for c in ("amount", "balance")})


@query(f"""WITH {_COMMANDS}, s AS (SELECT account_id, seq AS version, sum(CASE type WHEN 'deposit' THEN amount ELSE -amount END) OVER (PARTITION BY account_id ORDER BY seq) AS balance FROM c)
    SELECT account_id, version, balance::decimal(18,2)::double AS balance FROM s WHERE version % 16 = 0""")
def account_snapshots(spark, sf_dir):
    """Snapshots taken of the log up to a time, then extended by what came after it."""
    log = events.numbered(_commands(spark, sf_dir))
    early = events.snapshots(log.where("version <= 40"), 16)
    return early.unionByName(events.extend_snapshots(early, log, 16)).withColumn("balance", F.col("balance").cast("double"))


@query(f"""WITH {_COMMANDS}, s AS (SELECT account_id, seq AS version, sum(CASE type WHEN 'deposit' THEN amount ELSE -amount END) OVER (PARTITION BY account_id ORDER BY seq) AS balance FROM c),
        w AS (SELECT event_id AS request, user_id::varchar AS account_id, (event_id * 7919) % 83 AS version FROM events)
    SELECT request, account_id, version, CASE WHEN version = 0 THEN 0.0 ELSE balance::decimal(18,2)::double END AS balance FROM w LEFT JOIN s USING (account_id, version)""")
def account_versions(spark, sf_dir):
    """Each event asks for its account at some version: the snapshots don't reach all of them, and neither does the log."""
    log = events.numbered(_commands(spark, sf_dir))
    wanted = read(spark, sf_dir, "events").select(F.col("event_id").alias("request"), F.col("user_id").cast("string").alias("account_id"), (F.col("event_id") * 7919 % 83).alias("version"))
    taken = events.snapshots(log.where("version <= 50"), 16)
    return events.at_versions(log, taken, wanted, 16).withColumn("balance", F.col("balance").cast("double"))


#: Source around each document's whole text, a language a document in turn: how a class begins, its constructor and how a method of it begins and
#: ends; how a function begins and ends. The text stands in the class and in the function; in it only what the patterns look for is made harmless.
_BRACES = {
    "cs": ("\n  internal class D", "  public D{}(int a) {{ }}\n", "  public int m{}(int x) {{ return x; }}\n", "\n  static int run", "(int a) {\n"),
    "java": ("\n  public class D", "  protected D{}() {{ }}\n", "  private int m{}(int x) {{ return x; }}\n", "\n  public int run", "() {\n"),
    "ts": ("export abstract class D", "  constructor(a) {{ }}\n", "  m{}(x) {{ return x; }}\n", "function run", "(a) {\n"),
    "tsx": ("abstract class D", "  constructor(a) {{ }}\n", "  async m{}(x) {{ return x; }}\n", "let run", " = (a) => {\n"),
    "js": ("class D", "  constructor() {{ }}\n", "  m{}(x) {{ return x; }}\n", "const run", " = (a, b) => {\n"),
    "jsx": ("class D", "  constructor() {{ }}\n", "  async m{}() {{ return 1; }}\n", "var run", " = function(a) {\n"),
    "swift": ("open class D", "  init(a: Int) {{ }}\n", "  var m{} = 1\n", "func run", "<T>(a: T) {\n"),
    "kt": ("data class D", "  constructor(a: Int) {{ }}\n", "  val m{} = 1\n", None, None),
    "php": ("class D", "  // D{}\n", "  public $m{} = 1;\n", "function run", "($a) {\n"),
    "go": ("type D", "  // D{}\n", "  m{} int\n", "func (s *T) run", "(a int) int {\n"),
    "rs": ("pub struct D", "  // D{}\n", "  m{}: i32,\n", "fn run", "<T>(a: T) -> T {\n"),
    "c": (None, None, None, "static int run", "(int a) {\n"),
    "cpp": (None, None, None, "inline int run", "(int a, int b) {\n"),
}
_LINES = {
    "py": ("class D", ":\n", "    def __init__{}(self):\n        pass\n", "    def m{}(self):\n        pass\n", "def run", "(a):\n"),
    "rb": ("class D", "\n", "  attr_reader :a\n", "  attr_reader :m\n", "def run", "(a)\n"),
}
_LANGUAGES = [*_BRACES, *_LINES]
#: What the patterns look for, and what stands there instead.
_HARMLESS = [("class", "cla.ss"), ("function", "func.tion"), ("def", "d.ef"), ("struct", "str.uct"), ("(", "<"), (")", ">"), ("{", "["), ("}", "]")]


def _sources() -> list[tuple[str, list, list, bool]]:
    """(language, parts of the class, parts of the function, by braces) of each language; a part is fixed, 'id', 'text', or a constructor or method to be repeated."""
    out = []
    for lang, (head, constructor, method, fn, begin) in _BRACES.items():
        after = " struct" if lang == "go" else ""
        klass = [head, "id", after + " {\n/* ", "text", " */\n", ("constructor", constructor), ("method", method), "}"] if head else []
        function = [fn, "id", begin + "/* ", "text", " */\n}"] if fn else []
        out.append((lang, klass, function, True))
    for lang, (head, begin, constructor, method, fn, rest) in _LINES.items():
        klass = [head, "id", begin, ("constructor", constructor), ("method", method), "  # ", "text", "\n"]
        out.append((lang, klass, [fn, "id", rest, "  # ", "text", "\n"], False))
    return out


def _generated(spark, sf_dir):
    """Source files (rel, abs_path, lang, size, content): a class with up to one constructor and three methods, then a function."""
    text = F.coalesce("text", F.lit(""))
    for what, other in _HARMLESS:
        text = F.replace(text, F.lit(what), F.lit(other))
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), (F.col("doc_id") % len(_LANGUAGES)).cast("int").alias("k"), (F.col("doc_id") % 2).cast("int").alias("constructor"), (F.col("doc_id") % 4).cast("int").alias("method"), text.alias("text"))

    def written(parts: list):
        return [F.repeat(F.replace(F.lit(p[1].replace("{{", "{").replace("}}", "}")), F.lit("{}"), F.col("id")), F.col(p[0])) if isinstance(p, tuple) else F.col(p) if p in ("id", "text") else F.lit(p) for p in parts]

    content = F.when(F.lit(False), F.lit(""))
    for k, (_, klass, function, braces) in enumerate(_sources()):
        first = F.lit("// made\n" if braces else "# made\n")
        content = content.when(F.col("k") == k, F.concat(first, *written(klass), F.lit("\n" if braces else ""), *written(function), F.lit("\n// end\n" if braces else "")))
    lang = F.element_at(F.array(*[F.lit(lang) for lang in _LANGUAGES]), F.col("k") + 1)
    files = rows.select(F.concat(F.lit("src\\d/D"), "id", F.lit("."), lang).alias("rel"), lang.alias("lang"), content.alias("content"))
    return files.withColumns({"abs_path": F.concat(F.lit("/data/"), "rel"), "size": F.octet_length("content")})


def _sql_text(text: str) -> str:
    return "'" + text.replace("\n", "' || chr(10) || '") + "'"


def _sql_parts(parts: list) -> str:
    def one(p) -> str:
        if isinstance(p, tuple):
            return f"repeat(replace({_sql_text(p[1].replace('{{', '{').replace('}}', '}'))}, '{{}}', id), {p[0]})"
        return p if p in ("id", "text") else _sql_text(p)

    return " || ".join(map(one, parts)) or "''"


def _structure_sql() -> str:
    """f(rel, lang, kind, name, rest, most): what each definition's body would be without limits, and found(...): with them.

    A body by lines ends with the first line that isn't blank and goes beyond the limit.
    """
    text = "coalesce(text, '')"
    for what, other in _HARMLESS:
        text = f"replace({text}, '{what}', '{other}')"
    # Patterns that begin with words or white space take what stands before, too.
    before = {"cs": "chr(10)", "java": "chr(10)", "c": "'made' || chr(10) || chr(10)", "cpp": "'made' || chr(10) || chr(10)"}
    out = []
    for k, (lang, klass, function, braces) in enumerate(_sources()):
        # By lines, a class goes on over the function up to the end, and a function up to the end; a method is a function too, up to the function's line.
        if klass:
            out.append(f"SELECT id, '{lang}' AS lang, 'class' AS kind, 'D' || id AS name, {before.get(lang, "''")} || {_sql_parts(klass if braces else klass + function)} AS rest, 50000 AS most FROM d WHERE k = {k}")
        if function:
            out.append(f"SELECT id, '{lang}', 'function', 'run' || id, {before.get(lang, "''")} || {_sql_parts(function)}, 10000 FROM d WHERE k = {k}")
    # Constructors and methods are functions where the patterns find them.
    made = lambda t: f"replace({_sql_text(t.replace('{{', '{').replace('}}', '}'))}, '{{}}', id)"
    for lang in ("cs", "java"):
        for name, count, part in (("D", "constructor", _BRACES[lang][1]), ("m", "method", _BRACES[lang][2])):
            out.append(f"SELECT id, '{lang}', 'function', '{name}' || id, chr(10) || {made(part.rstrip())}, 10000 FROM d, range({count}) WHERE k = {_LANGUAGES.index(lang)}")
    head, begin, constructor, method, _, _ = _LINES["py"]
    ends = "'  # ' || text || chr(10)"
    out.append(f"SELECT id, 'py', 'function', '__init__' || id, ltrim({made(constructor)}, ' ') || repeat({made(method)}, method) || {ends}, 10000 FROM d WHERE k = {_LANGUAGES.index('py')} AND constructor = 1")
    out.append(f"SELECT id, 'py', 'function', 'm' || id, ltrim({made(method)}, ' ') || repeat({made(method)}, method - 1 - i::int) || {ends}, 10000 FROM d, range(method) r(i) WHERE k = {_LANGUAGES.index('py')}")
    units = "length({0}) + length(regexp_replace({0}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))"
    by_lines = "lang IN ('py', 'rb')"
    return f"""d AS (SELECT doc_id::varchar AS id, doc_id % {len(_LANGUAGES)} AS k, (doc_id % 2)::int AS constructor, (doc_id % 4)::int AS method, {text} AS text FROM documents),
        f AS MATERIALIZED (SELECT row_number() OVER () AS no, * FROM ({" UNION ALL ".join(out)})),
        l AS (SELECT no, kind, most, unnest(string_split(rest, chr(10))) AS line, generate_subscripts(string_split(rest, chr(10)), 1) AS i FROM f WHERE {by_lines}),
        c AS (SELECT *, sum({units.format("line")} + 1) OVER w - 1 AS upto, sum(length(line) + 1) OVER w - 1 AS chars FROM l WINDOW w AS (PARTITION BY no ORDER BY i)),
        e AS (SELECT no, min(chars)::bigint AS chars FROM c WHERE i > 1 AND upto > most AND NOT regexp_full_match(line, '[\\s\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]*') GROUP BY no),
        b AS (SELECT id, lang, kind, name, CASE WHEN {by_lines} THEN substring(rest, 1, coalesce(chars, length(rest) - CASE WHEN kind = 'function' AND NOT starts_with(name, 'run') THEN 1 ELSE 0 END)) ELSE rest END AS body FROM f LEFT JOIN e USING (no)),
        found AS (SELECT 'src\\d/D' || id || '.' || lang AS rel, lang, kind, name, body FROM b WHERE {units.format("body")} > 10 AND {units.format("body")} < CASE kind WHEN 'class' THEN 100000 ELSE 50000 END)"""


@query(f"WITH {_structure_sql()} SELECT rel, name, sha256(body) AS body_hash FROM found WHERE kind = 'class'")
def extract_classes(spark, sf_dir):
    return structure.extract_definitions(_generated(spark, sf_dir), "class").select("rel", "name", F.sha2("body", 256).alias("body_hash"))


@query(f"WITH {_structure_sql()} SELECT rel, name, sha256(body) AS body_hash FROM found WHERE kind = 'function'")
def extract_functions(spark, sf_dir):
    return structure.extract_definitions(_generated(spark, sf_dir), "function").select("rel", "name", F.sha2("body", 256).alias("body_hash"))


@query(f"WITH {_structure_sql()} SELECT lang, kind, count(*) AS definitions, sum(strlen(body))::bigint AS bytes, max(length(body))::bigint AS longest FROM found GROUP BY lang, kind")
def extract_languages(spark, sf_dir):
    """How much of each language both kinds take, from one pass over the files."""
    found = structure.extract_definitions(_generated(spark, sf_dir)).where("error is null")
    return found.groupBy("lang", "kind").agg(F.count("*").alias("definitions"), F.sum(F.octet_length("body")).alias("bytes"), F.max(F.length("body")).cast("long").alias("longest"))


_MEMBERS = " ".join(f"WHEN lang IN ({', '.join(map(repr, langs))}) THEN len(regexp_extract_all(body, '{pattern.removeprefix('(?U)').replace('*+', '*')}'))" for langs, pattern in fn.MEMBER_PATTERNS.items())
_HINT = "coalesce(nullif(lower(regexp_extract(body, '(?i)\\b(" + "|".join(fn.VERBS) + ")\\b', 1)), ''), 'function')"


@query(f"""WITH {_structure_sql()}, m AS (SELECT *, regexp_extract(rel, '[^\\\\/]*$') AS base, CASE {_MEMBERS} ELSE 0 END AS members,
        CASE WHEN lang IN ('cs', 'java') THEN contains(body, 'public ' || name || '(') OR contains(body, 'private ' || name || '(') OR contains(body, 'protected ' || name || '(') WHEN lang = 'py' THEN contains(body, 'def __init__')
            WHEN lang IN ('js', 'ts', 'jsx', 'tsx') THEN contains(body, 'constructor(') WHEN lang = 'swift' THEN contains(body, 'init(') WHEN lang = 'kt' THEN contains(body, 'constructor(') OR contains(body, 'class ' || name || '(') ELSE false END AS made FROM found)
    SELECT 'src/d/' || base || '.' || name || CASE kind WHEN 'class' THEN '.class' ELSE '' END AS id, kind AS type,
        CASE kind WHEN 'class' THEN concat_ws(' • ', name, CASE WHEN members > 0 THEN members || ' members' END, CASE WHEN made THEN 'constructor' END, base || ' ' || lang) ELSE name || ' — ' || {_HINT} || ' (' || base || ' ' || lang || ')' END AS title FROM m""")
def structure_titles(spark, sf_dir):
    """Members and constructors vary by file; paths have backslashes in the source, not in the records."""
    return structure.records(_generated(spark, sf_dir), "/data").where("type != 'file'").select("id", "type", "title")


@query("SELECT source, count_if(n_chars <= 3000)::bigint AS files, sum(CASE WHEN n_chars <= 3000 THEN n_chars ELSE 0 END)::bigint AS bytes, count_if(n_chars > 3000)::bigint AS too_large FROM documents GROUP BY source")
def scan_totals(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    files = docs.select(F.lit(False).alias("is_dir"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("rel"), F.col("n_chars").alias("size"), "source")
    return tree.scan_totals(files, 3000, ("source",))
