"""Source trees: listing, filters, reading, manifests.

Spark's file sources skip names that begin with a dot or an underscore, so tasks list a tree's directories and read its files
themselves; the tree is in a folder that all of them reach.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import basename, tree_line
from textloom.scratch import keep

MAX_BYTES = 3_145_728
#: Bytes that are read at once where only the hash is wanted.
CHUNK = 1_048_576

#: Extensions of text files, in any case.
ALLOWED_EXTENSIONS = (
    ".py", ".ipynb", ".js", ".mjs", ".cjs", ".ts", ".tsx", ".jsx", ".vue", ".svelte", ".java", ".kt", ".kts", ".scala", ".go", ".rs",
    ".c", ".h", ".cpp", ".cc", ".cxx", ".hpp", ".hh", ".m", ".mm", ".cs", ".fs", ".fsx", ".php", ".rb", ".swift", ".lua", ".pl", ".pm", ".r",
    ".dart", ".groovy", ".gradle", ".sql", ".proto", ".graphql", ".gql",
    ".json", ".json5", ".toml", ".ini", ".cfg", ".conf", ".yaml", ".yml", ".env", ".properties", ".xml",
    ".html", ".htm", ".css", ".scss", ".sass", ".less",
    ".md", ".markdown", ".rst", ".adoc", ".txt", ".csv", ".tsv", ".log", ".org",
)

#: Names that are taken whatever their extension, and their languages.
SPECIAL_NAMES = {
    "Dockerfile": "dockerfile", "Makefile": "make", "CMakeLists.txt": "cmake", "BUILD": "bazel", "WORKSPACE": "bazel", "Podfile": "cocoapods", "Gemfile": "ruby-gems",
    "requirements.txt": "python-reqs", "environment.yml": "conda-env", "Pipfile": "pipenv", "Pipfile.lock": "pipenv-lock", "package.json": "npm",
    "pnpm-lock.yaml": "pnpm-lock", "yarn.lock": "yarn-lock", "poetry.lock": "poetry-lock", "pyproject.toml": "pyproject", "Cargo.toml": "cargo",
    "Cargo.lock": "cargo-lock", "go.mod": "gomod", "go.sum": "gosum", "composer.json": "composer", "composer.lock": "composer-lock", "pom.xml": "maven",
    "build.gradle.kts": "gradle-kts", "build.gradle": "gradle", ".gitignore": "git", ".gitattributes": "git", ".editorconfig": "editor",
}

#: Directories that are passed over, in any case.
IGNORED_DIRECTORIES = (
    ".git", ".hg", ".svn", ".bzr", "node_modules", "dist", "build", "out", "target", ".idea", ".vscode", ".vs",
    "__pycache__", ".venv", "venv", ".mypy_cache", ".pytest_cache", ".gradle", ".next", ".nuxt", ".parcel-cache",
)

LISTING = "ord long, depth int, is_dir boolean, rel string, abs_path string, size long, mtime double"


#: Directories that one task lists at a time.
TASK_DIRECTORIES = 200
_FOUND = "key binary, depth int, is_dir boolean, rel string, abs_path string, size long, mtime double"


def entries(directory: str) -> list[os.DirEntry]:
    """What a directory holds, by name; one that can't be read is empty."""
    try:
        with os.scandir(directory) as found:
            return sorted(found, key=lambda e: e.name)
    except OSError:
        return []


def ignored(name: str) -> bool:
    return name.lower() in IGNORED_DIRECTORIES


def _list(key: bytes, depth: int, rel: str, directory: str) -> Iterator[tuple]:
    """A directory's files and the directories to go on with.

    A key orders a tree: a directory comes before what it holds, its files before its directories, each by name. A file's name is
    marked by 1, a directory's by 2, and both end with 0, which is in no name.
    """
    for e in entries(directory):
        below = f"{rel}/{e.name}" if rel else e.name
        name = e.name.encode("utf-8", "surrogateescape") + b"\0"
        if e.is_dir():
            if not ignored(e.name):
                yield key + b"\2" + name, depth + 1, True, below, e.path, None, None
            continue
        try:
            st = os.stat(e.path)
        except OSError:
            continue
        yield key + b"\1" + name, depth, False, below, e.path, st.st_size, st.st_mtime


def listing(spark: SparkSession, root: str, max_depth: int | None = None) -> DataFrame:
    """A row for each directory but the root and each file, in preorder by ``ord``; a file's depth is its directory's.

    The tree is listed level by level: the directories of a level are dealt out, tasks list them, and those they find are the next level. The driver
    sees how many there are, no names. ``ord`` rises in preorder, with gaps.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, depth, rel, path in zip(b["key"], b["depth"], b["rel"], b["abs_path"], strict=True):
                yield pd.DataFrame(list(_list(bytes(key), depth, rel, path)), columns=[c.split()[0] for c in _FOUND.split(", ")]).astype({"size": "Int64"})

    level = spark.createDataFrame([(b"", 0, "", os.path.abspath(root))], "key binary, depth int, rel string, abs_path string")
    out, n, depth = spark.createDataFrame([], _FOUND), 1, 0
    while n:
        parts = min(spark.sparkContext.defaultParallelism * 8, -(-n // TASK_DIRECTORIES))
        dealt = level.repartition(parts, F.xxhash64("abs_path")) if parts > 1 else level.coalesce(1)
        found = keep(dealt.mapInPandas(run, _FOUND), "listing")
        if max_depth is not None and depth >= max_depth:
            out = out.unionByName(found.where("not is_dir"))
            break
        out = out.unionByName(found)
        level, depth = found.where("is_dir").select("key", "depth", "rel", "abs_path"), depth + 1
        n = level.count()
    ordered = out.repartitionByRange("key").sortWithinPartitions("key").withColumn("ord", F.monotonically_increasing_id())
    return keep(ordered.select(*[c.split()[0] for c in LISTING.split(", ")]), "tree")


def allowed(path="rel"):
    """An allowed extension in any case, or a special name."""
    name = basename(path)
    extension = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    return extension.isin(*ALLOWED_EXTENSIONS) | name.isin(*SPECIAL_NAMES)


def language(path="rel"):
    """A special name's language, else the extension in lower case, else 'text'."""
    name = basename(path)
    special = F.create_map(*[F.lit(x) for kv in SPECIAL_NAMES.items() for x in kv])
    return F.coalesce(F.element_at(special, name), F.nullif(F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)), F.lit("")), F.lit("text"))


def source_files(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The files to read: allowed, and of at most max_bytes (both known before any is read)."""
    return files.where(~F.col("is_dir")).where(allowed()).where(F.col("size") <= max_bytes)


def scan_totals(files: DataFrame, max_bytes: int = MAX_BYTES, by: tuple[str, ...] = ()) -> DataFrame:
    """(files, bytes, too_large) of the allowed files, for each group of ``by``."""
    fits = F.col("size") <= max_bytes
    return files.where(~F.col("is_dir")).where(allowed()).groupBy(*by).agg(F.count_if(fits).alias("files"), F.sum(F.when(fits, F.col("size")).otherwise(0)).alias("bytes"), F.count_if(~fits).alias("too_large"))


def decode(data: bytes, max_bytes: int | None = MAX_BYTES) -> str | None:
    """Text without a byte order mark, bad bytes replaced; None for a file with a zero byte or too long a one (without a limit none is)."""
    if b"\0" in data or (max_bytes is not None and len(data) > max_bytes):
        return None
    return data.removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace")


def read_files(files: DataFrame, max_bytes: int | None = MAX_BYTES) -> DataFrame:
    """Files with lang, size (bytes), content, file_hash (of all bytes) and error; content is null where there is no text or more than max_bytes."""
    import hashlib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for ord_, rel, path, lang in zip(b["ord"], b["rel"], b["abs_path"], b["lang"], strict=True):
                try:
                    with open(path, "rb") as f:
                        data = f.read() if max_bytes is None else f.read(max_bytes + 1)
                        digest, size = hashlib.sha256(data), len(data)
                        while more := f.read(CHUNK):
                            digest.update(more)
                            size += len(more)
                    out.append((ord_, rel, path, lang, size, decode(data, max_bytes), digest.hexdigest(), None))
                except OSError as e:
                    out.append((ord_, rel, path, lang, None, None, "", type(e).__name__))
            yield pd.DataFrame(out, columns=["ord", "rel", "abs_path", "lang", "size", "content", "file_hash", "error"]).astype({"size": "Int64"})

    rows = files.select("ord", "rel", "abs_path", language().alias("lang"))
    return rows.repartition(F.col("ord")).mapInPandas(run, "ord long, rel string, abs_path string, lang string, size long, content string, file_hash string, error string")


def manifest_lines(files: DataFrame, root: str) -> DataFrame:
    """(ord, line) of the tree as text: its name first, then a line for each directory and file."""
    name = basename("rel")
    line = F.when(F.col("is_dir"), F.concat(F.repeat(F.lit(" "), (F.col("depth") - 1) * 4), F.lit("└── "), name)).otherwise(F.concat(F.repeat(F.lit(" "), F.col("depth") * 4), F.lit("├── "), name))
    top = files.sparkSession.createDataFrame([(-1, os.path.basename(root.rstrip("/")))], "ord long, line string")
    return top.unionByName(files.select("ord", line.alias("line")))


def write_manifest(files: DataFrame, root: str, path: str) -> None:
    """The tree's lines in order, as text files."""
    manifest_lines(files, root).repartitionByRange("ord").sortWithinPartitions("ord").select("line").write.mode("overwrite").text(path)


def manifest(files: DataFrame, root: str) -> DataFrame:
    """One row (id, type, path, root, text): the tree as text. A corpus has it in one record, so all lines meet; ``write_manifest`` needs no such row."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"])
    return manifest_lines(files, root).agg(F.array_join(lines, "\n").alias("text")).select(F.lit("__TREE__").alias("id"), F.lit("tree").alias("type"), F.lit("__TREE__").alias("path"), F.lit(root).alias("root"), F.rtrim("text").alias("text"))


def directory_records(spark: SparkSession, root: str, depth: int = 8, embed_text: bool = True) -> DataFrame:
    """A record for each file down to a depth: path, rel, size, mtime, sha256, lang, depth, text."""
    files = listing(spark, root, depth).where(~F.col("is_dir"))
    read = read_files(files, None if embed_text else 0).select("ord", "content", "file_hash")
    extension = F.regexp_extract(basename("rel"), r"\.([^.]+)$", 1)
    return files.join(read, "ord").select(F.col("abs_path").alias("path"), "rel", "size", "mtime", F.col("file_hash").alias("sha256"), F.when(extension == "", F.lit("unknown")).otherwise(language()).alias("lang"), "depth", (F.col("content") if embed_text else F.lit(None).cast("string")).alias("text"))


def directory_lines(paths: DataFrame, width: int = 120) -> DataFrame:
    """Of paths (ord, rel): for each directory, in order, its name ('.' for the top) and its files' lines: (dir, lines)."""
    directory = F.when(F.contains("rel", F.lit("/")), F.regexp_replace("rel", "/[^/]*$", "")).otherwise(F.lit(""))
    rows = paths.select(directory.alias("dir"), "ord", tree_line(basename("rel"), width).alias("line"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"])
    return rows.groupBy("dir").agg(listed.alias("lines")).select(F.when(F.col("dir") == "", F.lit(".")).otherwise(F.col("dir")).alias("dir"), "lines", F.col("dir").alias("sort_key"))
