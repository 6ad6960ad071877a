"""Fill-in-the-middle: a text's middle moves behind what stands around it, marked by sentinels.

A text is cut into units (a word with the white space before it; white space at the end), and two numbers of the
document's hash say after which units the middle begins and ends. A third decides whether the text is rearranged at
all, a fourth in which form: prefix, suffix, middle (psm) or suffix, prefix, middle (spm). All of it is Spark SQL:
``regexp_extract_all`` makes the units, ``conv`` of parts of ``sha2`` the numbers, ``slice`` and ``array_join`` the arrangement.
The choice depends on the id alone, so a task that runs again gives the same rows, and no row is shuffled.

Texts that hold a sentinel stay as they are: only so can an arrangement be taken apart again without doubt. Between
the parts no sentinel can arise by chance, because each one begins with ``<`` and ends with ``>`` and has neither inside.

Defined results: a null text counts as empty; an empty text has no units and is plain; a null id is hashed as the
empty string after the seed. White space alone is one unit. Equal rows give equal rows, an empty table none. A text of
any length is cut in one row, for which its task holds the text, its units and the arrangement. Of the
input only the two columns named are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import table

#: Fixed values of the contract: units, sentinels, the seed, shares of 100 that are rearranged, and of those that are spm.
UNIT_PATTERN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "42"
RATE, SPM_RATE = 50, 80


def _hash_number(digest: Column, n: int) -> Column:
    """The n-th group of eight hexadecimal digits as a number; n from 0."""
    return F.conv(F.substring(digest, 8 * n + 1, 8), 16, 10).cast("long")


def arrange(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rate: int = RATE, spm_rate: int = SPM_RATE, seed: str = SEED) -> DataFrame:
    """(id, text, n, form, prefix, middle, suffix, output) of every row; the three parts are null where the form is plain."""
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = rows.select("id", "text", F.regexp_extract_all("text", F.lit(UNIT_PATTERN), F.lit(0)).alias("units"), digest.alias("digest"))
    rows = rows.withColumns({"n": F.size("units").cast("long"), **{f"h{i + 1}": _hash_number(F.col("digest"), i) for i in range(4)}})
    one, two = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    marked = F.contains(F.col("text"), F.lit(PREFIX)) | F.contains(F.col("text"), F.lit(SUFFIX)) | F.contains(F.col("text"), F.lit(MIDDLE))
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_rate, "spm").otherwise("psm")
    rows = rows.select("id", "text", "units", "n", form.alias("form"), F.least(one, two).cast("int").alias("a"), F.greatest(one, two).cast("int").alias("b"))

    def part(begin: Column, size: Column) -> Column:
        return F.when(F.col("form") != "plain", F.array_join(F.slice("units", begin + 1, size), ""))

    a, b = F.col("a"), F.col("b")
    rows = rows.select("id", "text", "n", "form", part(F.lit(0), a).alias("prefix"), part(a, b - a).alias("middle"), part(b, F.size("units") - b).alias("suffix"))
    psm = F.array_join(F.array(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle"), "")
    spm = F.array_join(F.array(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle"), "")
    return rows.withColumn("output", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")))


def restore(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from; null where the output isn't of that form."""

    def between(first: str, second: str) -> tuple[Column, Column, Column]:
        """What follows the first sentinel, the second one and the last one."""
        here = F.locate(second, output)
        last = F.locate(MIDDLE, output, 1)
        one = F.substring(output, F.lit(len(first) + 1), here - len(first) - 1)
        two = F.substring(output, here + len(second), last - here - len(second))
        three = F.substring(output, last + len(MIDDLE), F.length(output))
        return F.when(F.startswith(output, F.lit(first)) & (here > 0) & (last > here), one), two, three

    prefix, suffix, middle = between(PREFIX, SUFFIX)
    suffix_, prefix_, middle_ = between(SUFFIX, PREFIX)
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_, middle_, suffix_))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = arrange(table(spark, sf_dir, "documents"))
    return made.select(
        F.col("id").alias("doc_id"), "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def middle_sql() -> str:
    """The same rows; the restored text is the document's own."""
    number = lambda i: f"('0x' || substr(h, {8 * i + 1}, 8))::bigint"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(doc_id::varchar, '')) AS h FROM documents),
        u AS (SELECT *, regexp_extract_all(t, '{UNIT_PATTERN}') AS u FROM d),
        c AS (SELECT doc_id, t, u, len(u)::bigint AS n, least({number(0)} % (len(u) + 1), {number(1)} % (len(u) + 1)) AS a, greatest({number(0)} % (len(u) + 1), {number(1)} % (len(u) + 1)) AS b,
            CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR {number(2)} % 100 >= {RATE} THEN 'plain'
                WHEN {number(3)} % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM u),
        p AS (SELECT doc_id, t, n, form, CASE WHEN form <> 'plain' THEN array_to_string(u[1:a], '') END AS p, CASE WHEN form <> 'plain' THEN array_to_string(u[a + 1:b], '') END AS m, array_to_string(u[b + 1:], '') AS s FROM c)
        SELECT doc_id, n, form, length(p)::bigint AS prefix_chars, length(m)::bigint AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
            sha256(t) AS restored_sha256 FROM p"""
