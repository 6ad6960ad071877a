"""Trees listed by tasks, and as a format that Spark reads, against a plain walk."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from textloom.sources import datasource, tree


def plain(root, max_depth=None):
    """Preorder: a directory, its files by name, then its directories by name."""
    out = []

    def go(here, depth):
        found = sorted(os.scandir(here), key=lambda e: e.name)
        out.extend((depth, False, os.path.relpath(e.path, root)) for e in found if not e.is_dir())
        for e in found:
            if e.is_dir() and e.name.lower() not in tree.IGNORED_DIRECTORIES and (max_depth is None or depth < max_depth):
                out.append((depth + 1, True, os.path.relpath(e.path, root)))
                go(e.path, depth + 1)

    go(root, 0)
    return out


@pytest.fixture(scope="module")
def wood(tmp_path_factory):
    root = tmp_path_factory.mktemp("wood") / "top"
    rnd = random.Random(4)
    folders = [root]
    for name in ("a", "a b", "a.b", "ab", "Z", "é", "node_modules", ".hid", "B", "dist", "_u", "c", "c-d", "😀"):
        folders.append(rnd.choice(folders) / name)
    for i, f in enumerate(folders):
        f.mkdir(parents=True, exist_ok=True)
        for name in rnd.sample(["x.py", "X.PY", "y.txt", ".env", "README.md", "z", "w.go", "a", "big.js"], 5):
            if not (f / name).exists():
                (f / name).write_text(f"{name} {i}\n" * (50 if name == "big.js" else 1))
    (root / "empty").mkdir()
    return str(root)


@pytest.mark.parametrize("depth", [None, 0, 1, 2, 9])
def test_listing_by_tasks(spark, wood, depth, monkeypatch):
    monkeypatch.setattr(tree, "TASK_DIRECTORIES", 2)
    rows = tree.listing(spark, wood, depth).orderBy("ord").collect()
    assert [(r["depth"], r["is_dir"], r["rel"]) for r in rows] == plain(wood, depth)
    assert all(r["size"] == os.path.getsize(r["abs_path"]) for r in rows if not r["is_dir"])
    assert len({r["ord"] for r in rows}) == len(rows)


def test_manifest_lines_in_order(spark, wood, tmp_path):
    files = tree.listing(spark, wood)
    tree.write_manifest(files, wood, f"file://{tmp_path}/tree")
    written = "".join(open(tmp_path / "tree" / f).read() for f in sorted(os.listdir(tmp_path / "tree")) if f.startswith("part"))
    assert written.rstrip("\n") == tree.manifest(files, wood).first()["text"]
    assert written.startswith("top\n") and "    ├── " in written


def test_tree_that_is_missing(spark, tmp_path):
    assert tree.listing(spark, str(tmp_path / "none")).count() == 0


@pytest.fixture(scope="module")
def reading(spark):
    datasource.register(spark)
    return lambda root, **options: spark.read.format("source_tree").option("root", root).options(**options).load()


@pytest.mark.parametrize("wanted", [1, 4, 1000])
def test_planned_directories_have_each_file_once(wood, wanted):
    got = [path for part in datasource.plan(wood, wanted) for path, _ in datasource.files(part)]
    assert sorted(os.path.relpath(p, wood) for p in got) == sorted(rel for _, is_dir, rel in plain(wood) if not is_dir)


def test_format_reads_what_read_files_reads(spark, wood, reading):
    plain_rows = tree.read_files(tree.listing(spark, wood).where("not is_dir"))
    want = sorted((r["rel"], r["size"], r["content"]) for r in plain_rows.collect())
    assert sorted((r["rel"], r["size"], r["content"]) for r in reading(wood).collect()) == want
    small = reading(wood, maxBytes=20).where("size > 20")
    assert small.count() and not small.where("content is not null").count()
    with pytest.raises(Exception, match="root"):
        spark.read.format("source_tree").load().count()


def test_filters_reach_the_walk(spark, wood, reading):
    rows = reading(wood)
    few = rows.where("size <= 20 and extension in ('.py', '.go')").where(F.length("content") > 0)
    want = sorted(r["rel"] for r in rows.collect() if r["size"] <= 20 and r["extension"] in (".py", ".go"))
    assert sorted(r["rel"] for r in few.collect()) == want and want
    reader = datasource.TreeReader({"root": wood})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual

    left = list(reader.pushFilters([LessThanOrEqual(("size",), 20), In(("extension",), (".py",)), IsNotNull(("size",)), EqualTo(("content",), "x"), GreaterThan(("mtime",), 0.0)]))
    assert [type(f) for f in left] == [IsNotNull, EqualTo]
    opened = [r for part in reader.partitions() for r in reader.read(part)]
    assert opened and all(r[2] == ".py" and r[3] <= 20 for r in opened)


def test_stream_has_changed_files(spark, tmp_path, reading):
    root = tmp_path / "src"
    root.mkdir()
    old = time.time() - 100
    for i in range(3):
        (root / f"{i}.py").write_text(f"v1 {i}")
        os.utime(root / f"{i}.py", (old, old))

    def run():
        stream = spark.readStream.format("source_tree").option("root", str(root)).load()
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(60)
        return sorted((r["rel"], r["content"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = [("0.py", "v1 0"), ("1.py", "v1 1"), ("2.py", "v1 2")]
    assert run() == first
    (root / "1.py").write_text("v2")
    os.utime(root / "1.py", (old + 10, old + 10))
    assert run() == sorted([*first, ("1.py", "v2")])
    assert run() == sorted([*first, ("1.py", "v2")])
