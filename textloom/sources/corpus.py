"""Corpora as JSON lines: strict and lenient readers, and a writer that replaces whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD = "id string, type string, title string, class_name string, function string, path string, abs_path string, root string, lang string, size int, hash string, text string"

#: What a new corpus starts with, unless other lines are given.
SEED = (
    '{"id":"shuffle","title":"Shuffles","text":"A shuffle deals rows out by key, so that equal keys meet in one task; it writes to disk and crosses the network."}',
    '{"id":"broadcast","title":"Broadcast joins","text":"A small table is sent to every executor, and the large one is joined where it lies, without a shuffle."}',
    '{"id":"skew","title":"Skewed keys","text":"When one key has most of the rows, its task is the last to end; a salt deals such a key out to many tasks."}',
)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, value) of the lines of text files, by file name and place in the file; empty lines keep their number and go.

    Spark packs parts of files into tasks by size, so a row's number in its task says its place in its part only. Parts
    are counted, and a running sum over them (a row for each part) says where each begins.
    """
    part = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    lines = spark.read.text(path).select("value", *part, F.monotonically_increasing_id().alias("m"))
    parts = lines.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("m").alias("first"))
    before = F.sum("n").over(Window.orderBy("file", "start")) - F.col("n") - F.col("first")
    lines = lines.where(F.length("value") > 0).join(parts.select("file", "start", before.alias("shift")), ["file", "start"])
    return lines.select((F.col("m") + F.col("shift")).alias("pos"), "value")


def has_field(line: Column | str, field: str) -> Column:
    """Whether a line of JSON has a field, null ones included. A malformed line is an error; JSON that is no object has none."""
    line = F.col(line) if isinstance(line, str) else line
    keys = F.coalesce(F.array_contains(F.json_object_keys(line), field), F.lit(False))
    return F.when(F.try_parse_json(line).isNull(), F.raise_error(F.lit("a line is not JSON"))).otherwise(keys)


def string_field(line: Column | str, field: str) -> Column:
    """A field of a line of JSON as text: empty where it is null or missing; a value that is no string is an error."""
    value = F.variant_get(F.try_parse_json(line), f"$.{field}", "variant")
    kind = F.schema_of_variant(value)
    bad = F.raise_error(F.lit(f"{field} is not a string"))
    return F.when(kind.isNull() | (kind == "VOID"), F.lit("")).when(kind == "STRING", F.variant_get(value, "$", "string")).otherwise(bad)


def texts(lines: DataFrame) -> DataFrame:
    """(doc_index, text) of lines (pos, value), in order: a record without text is skipped, a null text is empty."""
    return with_index(lines.where(has_field("value", "text")).select("pos", string_field("value", "text").alias("text")))


def load(spark: SparkSession, path: str) -> DataFrame:
    """(doc_index, text) by line order. A malformed line is an error; a record without text is skipped; a null text is empty; another kind is an error."""
    return texts(numbered_lines(spark, path))


def with_index(rows: DataFrame) -> DataFrame:
    """Dense indices by position: counts by block of 2^13 positions, running sums within 2^13 blocks and over those; no task sees all rows or blocks."""
    block, wide = F.shiftright("pos", 13), F.shiftright("block", 13)
    counts = rows.groupBy(block.alias("block")).agg(F.count("*").alias("n")).withColumn("wide", wide)
    sums = counts.groupBy("wide").agg(F.sum("n").alias("whole"))
    sums = sums.select("wide", (F.sum("whole").over(Window.orderBy("wide")) - F.col("whole")).alias("base"))  # a row for 2^26 positions
    inner = F.sum("n").over(Window.partitionBy("wide").orderBy("block")) - F.col("n")
    before = counts.withColumn("inner", inner).join(sums, "wide").select("block", (F.col("base") + F.col("inner")).alias("before"))
    ranked = rows.withColumn("block", block).withColumn("r", F.row_number().over(Window.partitionBy("block").orderBy("pos")))
    return ranked.join(before, "block").select((F.col("before") + F.col("r") - 1).alias("doc_index"), "text")


def load_entries(spark: SparkSession, path: str) -> DataFrame:
    """(pos, id, hash, json) of an existing corpus, leniently: bad lines and records without id or hash are skipped; no file is an empty corpus."""
    if not exists(spark, path):
        return spark.createDataFrame([], "pos long, id string, hash string, json string")
    parsed = F.from_json("value", "id string, hash string")
    return numbered_lines(spark, path).select("pos", parsed.alias("r"), F.col("value").alias("json")).select("pos", "r.id", "r.hash", "json").where("id is not null and hash is not null")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def to_lines(records: DataFrame) -> DataFrame:
    """Records as JSON, null fields kept."""
    fields = [c.split()[0] for c in RECORD.split(", ")]
    return records.withColumn("json", F.to_json(F.struct(*[f for f in fields if f in records.columns]), {"ignoreNullFields": "false"}))


def write(lines: DataFrame, path: str) -> None:
    """Write (section, ord, sub, json) in order to a directory of text files; what stood there is replaced when all is written."""
    spark = lines.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    new, target, old = hadoop.Path(f"{path}.new"), hadoop.Path(path), hadoop.Path(f"{path}.backup")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    # A sort by range keeps the order from part to part.
    lines.orderBy("section", "ord", "sub").select(F.col("json").alias("value")).write.mode("overwrite").text(new.toString())
    if fs.exists(target):
        fs.delete(old, True)
        fs.rename(target, old)
    try:
        if not fs.rename(new, target):
            raise OSError(f"can't put {path} in place")
    except Exception:
        if fs.exists(old) and not fs.exists(target):
            fs.rename(old, target)
        raise
    fs.delete(old, True)


def write_jsonl(records: DataFrame, path: str) -> int:
    """Write the rows that aren't null whole as JSON lines; returns how many."""
    from pyspark.sql import Observation

    seen = Observation()
    kept = records.where(F.greatest(*[F.col(c).isNotNull().cast("int") for c in records.columns], F.lit(0)) > 0)
    kept.observe(seen, F.count("*").alias("n")).write.mode("overwrite").json(path, ignoreNullFields=False)
    return seen.get["n"]


def ensure(spark: SparkSession, path: str, seed: tuple[str, ...] = SEED) -> None:
    """A seed corpus, unless there is one."""
    if not exists(spark, path):
        spark.createDataFrame([(i, s) for i, s in enumerate(seed)], "n int, value string").coalesce(1).sortWithinPartitions("n").select("value").write.text(path)
