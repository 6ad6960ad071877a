"""Fill-in-the-middle and byte-level pairs against plain computations, on edge cases and on the small table."""

import base64
import hashlib
import random
import re
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import bytepairs, middle
from textloom.llm.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, units string, n int, form string, output string, a int, id long, ids string, bytes int"
UNITS = re.compile(middle.UNIT_PATTERN)
EDGES = [
    (3, "alpha beta  gamma\n"), (3, "alpha beta  gamma\n"), (1, None), (2, ""), (None, "nobody's text, it is"), (9, " \n\t "), (7, "one"), (8, "é😀 ▁ <|endoftext|> \x00  x"),
    (10, "a <P> b"), (11, "a <S b> <M> c"), (12, "x " * 60_000), (13, "y" * 200_000), (14, " " * 100_000 + "z"), (15, "q" + " " * 100_000), (16, "a<P b <S c <M d< e"), (17, " nbsp   line\x85x"),
    *[(100 + i, f"<{'< > ' * i}> token {i} ends here<") for i in range(60)],
]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "u", 1, "f", "o", 2, 5, "x", 9) for i, t in rows], SCHEMA)


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def plain_middle(doc_id, text):
    text = text or ""
    h = sha(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    units = UNITS.findall(text)
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h4 % 100 < 80 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, n, form, len(p), len(m), sha(out), sha(text))


def key(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.fixture
def as_documents(spark, tmp_path):
    def write(rows):
        table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
        return str(tmp_path)

    return write


def test_middle_edges(spark, as_documents):
    sf = as_documents(EDGES)
    want = [plain_middle(i, t) for i, t in EDGES]
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert key(QUERIES["op11_fill_in_middle"](spark, sf).collect()) == key(want)


def test_middle_of_nothing(spark, as_documents):
    out = QUERIES["op11_fill_in_middle"](spark, as_documents([]))
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"] and not out.count()


def test_middle_parts_and_restored_text(spark):
    rows = [(i, "".join(random.Random(i).choices("ab <>PSM\n", k=i % 40))) for i in range(400)]
    made = middle.arrange(table(spark, rows), rate=100, spm_rate=50)
    got = made.withColumn("back", middle.restore(F.col("output"), F.col("form"))).collect()
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert r["back"] == r["text"]
        if r["form"] != "plain":
            assert r["prefix"] + r["middle"] + r["suffix"] == r["text"]


def test_restore_refuses_other_forms(spark):
    bad = [("<P>a<S>b", "psm"), ("a<P>b<S>c<M>d", "psm"), ("<P>a<M>b<S>c", "psm"), ("<P>a<S>b<M>c", "spm"), (None, "psm")]
    rows = spark.createDataFrame(bad, "output string, form string")
    assert [r[0] for r in rows.select(middle.restore(F.col("output"), F.col("form"))).collect()] == [None] * len(bad)


def test_middle_has_no_shuffle_and_no_python(spark):
    plan = QUERIES["op11_fill_in_middle"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_middle_sql(spark):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    assert key(QUERIES["op11_fill_in_middle"](spark, DATA).collect()) == key(c.sql(ORACLES["op11_fill_in_middle"]).fetchall())


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(bytepairs.default_ranks()).open("rb"))}
    return tiktoken.Encoding("own", pat_str=bytepairs.default_pattern(), mergeable_ranks=ranks, special_tokens={})


def plain_pairs(library, doc_id, text):
    ids = library.encode_ordinary(text or "")
    return (doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode_bytes(ids)))


def test_pairs_edges(spark, as_documents, library):
    sf = as_documents(EDGES)
    assert key(QUERIES["op12_byte_bpe"](spark, sf).collect()) == key(plain_pairs(library, i, t) for i, t in EDGES)


def test_pairs_of_nothing(spark, as_documents):
    out = QUERIES["op12_byte_bpe"](spark, as_documents([]))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and not out.count()


def test_pairs_of_the_table(spark, library):
    rows = duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall()
    got = QUERIES["op12_byte_bpe"](spark, DATA).collect()
    assert key(got) == key(plain_pairs(library, *r) for r in rows)
    assert {r["doc_id"]: r["decoded_sha256"] for r in got} == {i: sha(t or "") for i, t in rows}


def test_pairs_of_all_characters(library):
    codec = bytepairs.Codec(bytepairs.tokenizer_json(bytepairs.read_ranks(bytepairs.default_ranks()), bytepairs.default_pattern()))
    chars = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x30000, 3))]
    texts = [f"a{c}b {c}1{c} {c}{c} \t{c}\n{c}." for c in chars]
    rnd = random.Random(5)
    texts += ["".join(rnd.choices(chars, k=rnd.randrange(40))) for _ in range(500)]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)
        assert codec.decode(ids).decode() == text


def test_offsets_and_split_characters(spark, library):
    texts = [(0, "plain words"), (1, "é😀x 漢字かな ሀሁ 𝔘𝔫"), (2, None), (3, "")]
    rows = bytepairs.encode(table(spark, texts)).collect()
    split = 0
    for r in rows:
        raw, at = (dict(texts)[r["id"]] or ""), 0
        for i, s, e in zip(r["ids"], r["starts"], r["ends"], strict=True):
            token = library.decode_single_token_bytes(i)
            whole = raw[s:e].encode()
            assert token in whole and raw[: s + 1].encode()[: at + 1] == raw.encode()[: at + 1] and len(raw[:s].encode()) <= at and at + len(token) <= len(raw[:e].encode())
            split += len(whole) > len(token)
            at += len(token)
        assert at == len(raw.encode())
    assert split  # some token has part of a character only
    # Every cut of the ids: the bytes are those of the library, characters that aren't whole are counted apart.
    ids = next(r["ids"] for r in rows if r["id"] == 1)
    cuts = [(a, b) for a in range(len(ids) + 1) for b in range(a, len(ids) + 1)]
    frame = spark.createDataFrame([(k, ids[a:b]) for k, (a, b) in enumerate(cuts)], "id int, ids array<int>")
    for r in bytepairs.decode(frame).collect():
        a, b = cuts[r["id"]]
        data = library.decode_bytes(ids[a:b])
        assert bytes(r["bytes"]) == data
        whole = data[r["head"] : len(data) - r["tail"]]
        assert whole.decode("utf-8") == r["text"] and r["head"] < 4 and r["tail"] < 4


def test_decode_of_null_and_unknown_ids(spark):
    frame = spark.createDataFrame([(1, None), (2, [])], "id long, ids array<int>")
    assert {r["id"]: (r["bytes"], r["text"]) for r in bytepairs.decode(frame).collect()} == {1: (None, None), 2: (bytearray(), "")}
    with pytest.raises(Exception, match="vocabulary"):
        bytepairs.decode(spark.createDataFrame([(1, [999_999])], "id long, ids array<int>")).collect()


def test_small_ranks_with_repeats():
    """Ranks whose tokens are made of one letter, where ties decide."""
    ranks = {bytes([b]): b for b in range(256)}
    for n, token in enumerate([b"aa", b"aaaa", b"ab", b"aab", b"aaaab", b"bb"]):
        ranks[token] = 256 + n
    import tiktoken

    plain = tiktoken.Encoding("small", pat_str=bytepairs.default_pattern(), mergeable_ranks=ranks, special_tokens={})
    codec = bytepairs.Codec(bytepairs.tokenizer_json(ranks, bytepairs.default_pattern()))
    rnd = random.Random(3)
    texts = ["".join(rnd.choices("ab ", [6, 3, 1], k=rnd.randrange(60))) for _ in range(500)]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids.tolist() == plain.encode_ordinary(text)
