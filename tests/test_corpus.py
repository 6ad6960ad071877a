import json
import os

import pytest
from pyspark.sql import functions as F

from textloom.__main__ import main
from textloom.operators import merge
from textloom.operators.extract import extract
from textloom.sources import corpus, tree
from textloom.sources.model_server import ModelServer


@pytest.fixture
def source(tmp_path):
    root = tmp_path / "tree"
    for name, text in {
        "b.py": b"def run():\n    return 1\n", "A.PY": b"x = 1\n", "__init__.py": b"", ".gitignore": b"out\n", "note.bin": b"1", "zero.txt": b"a\0b", "bom.txt": b"\xef\xbb\xbfhi",
        "bad.txt": b"a\xffb", "node_modules/x.js": b"1", ".hid/c.py": b"y = 2\n", "sub/d.cs": b" class D { int a; }\n", "Node_Modules/y.js": b"2",
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text)
    (root / "empty").mkdir()
    return root


def test_listing(spark, source):
    rows = tree.listing(spark, str(source)).orderBy("ord").collect()
    names = [r["rel"] for r in rows]
    assert "node_modules" not in names and "Node_Modules/y.js" not in names
    assert {".gitignore", "__init__.py", "A.PY", ".hid/c.py", "empty", "sub/d.cs"} <= set(names)
    taken = {r["rel"] for r in tree.source_files(tree.listing(spark, str(source))).collect()}
    assert "note.bin" not in taken and {"A.PY", ".gitignore", "__init__.py"} <= taken
    read = {r["rel"]: r["content"] for r in tree.read_files(tree.source_files(tree.listing(spark, str(source)))).collect()}
    assert read["zero.txt"] is None and read["bom.txt"] == "hi" and read["bad.txt"] == "a\ufffdb"
    text = tree.manifest(tree.listing(spark, str(source)), str(source)).first()["text"].split("\n")
    assert text[0] == "tree" and "└── empty" in text and "    ├── d.cs" in text


def test_refresh(spark, source, tmp_path):
    out = f"file://{tmp_path}/corpus"
    ids = lambda: [json.loads(r["value"])["id"] for r in corpus.numbered_lines(spark, out).orderBy("pos").collect()]
    extract(spark, str(source), out)
    first = ids()
    assert first[0] == "__TREE__" and "b.py.run" in first and "sub/d.cs.D.class" in first
    extract(spark, str(source), out)
    assert ids() == first
    extract(spark, str(source), out)
    assert ids() == first
    (source / "b.py").write_text("def other():\n    return 2\n")
    (source / "A.PY").unlink()
    extract(spark, str(source), out)
    second = ids()
    assert "b.py.other" in second and "b.py.run" not in second and "A.PY.file" in second
    extract(spark, str(source), out, prune_deleted=True)
    assert "A.PY.file" not in ids()
    assert not os.path.exists(f"{tmp_path}/corpus.backup") and not os.path.exists(f"{tmp_path}/corpus.new")


def test_prefixes_reach_other_files(spark):
    entries = [(0, "a.file", "h", "0"), (1, "a.b.fn", "h", "1"), (2, "ab.fn", "h", "2"), (3, "a.b.file", "h", "3"), (4, "c.x.class", "h", "4")]
    existing = spark.createDataFrame(entries, "pos long, id string, hash string, json string")
    processed = spark.createDataFrame([("a.file",)], "id string")
    left = merge.untouched(existing, processed)
    assert sorted(r["id"] for r in left.collect()) == ["a.b.file", "ab.fn", "c.x.class"]
    assert "NestedLoop" not in left._jdf.queryExecution().executedPlan().toString()


def test_lines_of_several_files_keep_their_order(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    sizes = (1, 60_000, 5, 0, 300)
    for part, n in enumerate(sizes):
        (folder / f"part-{part:05}.txt").write_text("".join(f'{{"text":"{part}-{i}"}}\n' + "\n" * (i % 7 == 0) for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        got = [tuple(r) for r in corpus.load(spark, f"file://{folder}").orderBy("doc_index").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == list(enumerate(f"{part}-{i}" for part, n in enumerate(sizes) for i in range(n)))


def test_load(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text('{"text":"one"}\n\n{"id":"x"}\n{"text":null}\n{"text":"two","id":"y"}\n')
    assert [tuple(r) for r in corpus.load(spark, f"file://{path}").orderBy("doc_index").collect()] == [(0, "one"), (1, ""), (2, "two")]
    for bad in ('{"text":"one"\n', '{"text":5}\n'):
        path.write_text(bad)
        with pytest.raises(Exception, match="(?i)text is not|not JSON"):
            corpus.load(spark, f"file://{path}").collect()
    path.write_text('{"id":"a","hash":"1"}\nnonsense\n{"id":"b"}\n{"id":"a","hash":"2"}\n')
    rows = merge.last_wins(corpus.load_entries(spark, f"file://{path}")).collect()
    assert [(r["id"], r["hash"]) for r in rows] == [("a", "2")]
    assert corpus.load_entries(spark, f"file://{tmp_path}/none").count() == 0


def test_write_jsonl(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (None, None), (2, "x")], "a int, b string")
    assert corpus.write_jsonl(rows, f"file://{tmp_path}/o") == 2


class Stub:
    def __init__(self):
        self.seen = []

    def __call__(self, method, address, body, timeout):
        self.seen.append((method, address.rsplit("/", 1)[1], body))
        yield from {
            "tags": ['{"models":[{"name":"other"}]}'],
            "show": ['{"ok":1}'],
            "pull": ['{"status":"working"}', "noise", '{"status":"Success"}', '{"status":"never"}'],
            "generate": ['{"response":" a b"}', "noise", '{"response":""}', '{"response":" c "}', '{"done":true}', '{"response":"never"}'],
            "chat": ['{"message":{"content":" hello "}}'],
        }[address.rsplit("/", 1)[1]]


def test_model_server():
    stub, seen = Stub(), []
    server = ModelServer(transport=stub)
    assert list(server.pull()) == ["working", "Success"] and server.ensure()
    assert server.generate_text("p", seen.append, 4) == "a b c"
    assert [p.tokens for p in seen] == [2, 3] and seen[1].fraction == 0.75
    assert server.chat("hi") == "hello"
    assert stub.seen[-1][2]["messages"] == [{"role": "user", "content": "hi"}]
    assert ModelServer(transport=lambda *a: iter(['{"response":"r"}'])).chat("x") == "r"


def test_command_line(spark, source, tmp_path, capsys):
    stub = Stub()
    server = ModelServer(transport=stub)
    out = f"file://{tmp_path}/cli"
    assert main(["EXTRACT", str(source), "--corpus", out], server) == 0
    assert main(["run", "run", "return", "--corpus", out], server) == 0
    assert "a b c" in capsys.readouterr().out
    prompt = stub.seen[-1][2]["prompt"]
    assert prompt.startswith("Context:\n") and prompt.endswith("\n\nAnswer clearly:") and prompt.count("\n---\n") == 2
    assert main(["chat", "hi"], server) == 0 and main(["clean"], server) == 0 and main(["nonsense"], server) == 1
    assert main(["records", str(source / "none")], server) == 2
    assert main(["setup", str(tmp_path / "home")], server) == 0
    assert os.path.exists(tmp_path / "home/current/data/corpus.jsonl")
    assert main(["tree", str(source)], server) == 0
    assert " - b.py" in capsys.readouterr().out
    assert main(["run", "x", "--corpus", f"file://{tmp_path}/nowhere"], server) == 1


def test_directory_records_of_large_files(spark, tmp_path):
    import hashlib

    start = "x" * (tree.MAX_BYTES + 1)
    for name in "ab":
        (tmp_path / f"{name}.txt").write_text(start + name)
    for embed in (True, False):
        rows = {r["rel"]: r for r in tree.directory_records(spark, str(tmp_path), 0, embed).collect()}
        for name in "ab":
            r = rows[f"{name}.txt"]
            assert r["sha256"] == hashlib.sha256((start + name).encode()).hexdigest()
            assert r["text"] == (start + name if embed else None)


def test_slow_files_give_no_part_of_their_definitions(spark, monkeypatch):
    from textloom.operators import structure

    def slow(lang, content, kind, time_limit):
        yield "first", "def first(): pass"
        raise TimeoutError

    monkeypatch.setattr(structure, "definitions", slow)
    taken = []

    class Rows:
        def select(self, *columns):
            return self

        def mapInPandas(self, run, schema):  # noqa: N802
            import pandas as pd

            taken.extend(run(iter([pd.DataFrame({"rel": ["a.py"], "lang": ["py"], "content": ["x"]})])))

    structure.extract_definitions(Rows(), "function")
    assert len(taken[0]) == 1 and taken[0]["error"].notna().all()


def test_extract_writes_a_table_of_files_that_fail(spark, tmp_path, caplog, monkeypatch):
    from textloom.operators import extract as e

    (tmp_path / "tree").mkdir()
    (tmp_path / "tree/a.py").write_text("x = 1")
    (tmp_path / "tree/gone.py").write_text("x = 1")
    listed = e.tree.listing

    def then_gone(*args):
        files = listed(*args)
        os.unlink(tmp_path / "tree/gone.py")
        return files

    monkeypatch.setattr(e.tree, "listing", then_gone)
    e.extract(spark, str(tmp_path / "tree"), f"file://{tmp_path}/corpus")
    errors = spark.read.json(e.errors_path(f"file://{tmp_path}/corpus"))
    assert [tuple(r) for r in errors.select("rel", "error").collect()] == [("gone.py", "FileNotFoundError")]
    assert "1 files have errors" in caplog.text


def test_directory_records(spark, source):
    rows = {r["rel"]: r for r in tree.directory_records(spark, str(source), 0).collect()}
    assert "b.py" in rows and "sub/d.cs" not in rows and rows["b.py"]["lang"] == "py"
    assert tree.directory_records(spark, str(source), 0, False).where(F.col("text").isNotNull()).count() == 0


def test_answers_to_a_table_of_prompts(spark):
    from textloom.sources.model_server import answers

    def transport(method, address, body, timeout):
        last = body["messages"][-1]["content"]
        if last == "bad":
            raise OSError("refused")
        yield json.dumps({"message": {"content": f" {len(body['messages'])} {last} "}})

    server = ModelServer(transport=transport)
    rows = [(1, "a"), (2, None), (3, "bad"), (4, ""), (1, "a")]
    got = answers(spark.createDataFrame(rows, "id long, prompt string"), server, 3).collect()
    assert sorted((r["id"], r["answer"] or "", r["error"] or "") for r in got) == [(1, "1 a", ""), (1, "1 a", ""), (2, "", ""), (3, "", "OSError: refused"), (4, "1", "")]
    talk = spark.createDataFrame([("x", [("system", "s"), ("user", "u")])], "id string, messages array<struct<role string, content string>>")
    assert [tuple(r) for r in answers(talk, server).collect()] == [("x", "2 u", None)]
    assert answers(spark.createDataFrame([], "id long, prompt string"), server).count() == 0


def test_release_is_mirrored_where_links_cannot_be_made(tmp_path, monkeypatch):
    from textloom import setup

    (tmp_path / "r/sub").mkdir(parents=True)
    (tmp_path / "r/sub/f").write_text("1")
    link = str(tmp_path / "model")
    assert setup.point(link, str(tmp_path / "r")) and os.path.islink(link)

    def refuse(*args, **kw):
        raise OSError("no links here")

    monkeypatch.setattr(setup.os, "symlink", refuse)
    assert not setup.point(link, str(tmp_path / "r")) and not os.path.islink(link) and open(f"{link}/sub/f").read() == "1"
    (tmp_path / "r/sub/f").write_text("2")
    setup.point(link, str(tmp_path / "r"))  # the copy is replaced
    assert open(f"{link}/sub/f").read() == "2"


def test_tree_into_buckets(spark, source, tmp_path):
    from textloom.operators import extract as e

    path = f"file://{tmp_path}/store"
    first = e.refresh_store(spark, str(source), path)
    e.extract(spark, str(source), f"file://{tmp_path}/plain.jsonl")
    ids = lambda rows: [json.loads(r[0])["id"] for r in rows]
    assert ids(first.lines().orderBy("section", "ord", "sub").select("json").collect()) == ids(corpus.numbered_lines(spark, f"file://{tmp_path}/plain.jsonl").orderBy("pos").select("value").collect())
    again = e.refresh_store(spark, str(source), path, prune_deleted=True)
    assert again.folders == first.folders and again.number == 2


def test_time_spans(spark):
    from textloom.functions.text import format_time_span

    rows = spark.createDataFrame([(0.4,), (59.4,), (60.0,), (90.0,), (3599.0,), (5400.0,), (None,)], "s double")
    assert [r[0] for r in rows.select(format_time_span("s")).collect()] == ["0s", "59s", "1.0m", "1.5m", "60.0m", "1.5h", None]
