"""Readers and writers of curation files: strict and lenient TSV, JSON lines, Markdown tables, ledgers, word lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Tables whose rows are work enough to be dealt out to all cores when their files give fewer tasks.
TEXTS = ("documents", "pages", "benchmark", "conversations")


def table(spark: SparkSession, folder: str, name: str, deal: bool = False) -> DataFrame:
    """``deal``: also a table that isn't in ``TEXTS`` is dealt out, for work on its rows that takes long."""
    df, cores = spark.read.parquet(f"{folder}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if (deal or name in TEXTS) and df.rdd.getNumPartitions() < cores else df


def strict_tsv(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Strings under these names; a line with another number of fields makes the job fail, whatever is read of it."""
    fields = F.split("value", "\t", -1)
    ok = F.when(F.size(fields) == len(names), fields).otherwise(F.raise_error(F.concat(F.lit(f"not {len(names)} fields: "), "value")).cast("array<string>"))
    # the check is a filter on the line, so that no column pruning takes it away
    rows = spark.read.text(path).filter(F.size(ok) > 0)
    return rows.select(*[F.element_at(fields, i + 1).alias(n) for i, n in enumerate(names)])


def lenient_tsv(spark: SparkSession, path: str, names: list[str], variants: bool = False) -> DataFrame:
    """Lines with at least that many fields and a first one that isn't empty; comment lines (#) go. With ``variants``, a
    first field with a part in parentheses stands once with it and once without."""
    rows = spark.read.text(path).filter(~F.col("value").startswith("#")).select(F.split("value", "\t", -1).alias("f"))
    rows = rows.filter((F.size("f") >= len(names)) & (F.trim(F.element_at("f", 1)) != "")).select(*[F.element_at("f", i + 1).alias(n) for i, n in enumerate(names)])
    if not variants:
        return rows
    c = F.col(names[0])
    tidy = lambda x: F.trim(F.regexp_replace(x, " +", " "))
    both = F.array_distinct(F.array(tidy(F.regexp_replace(c, "[()]", "")), tidy(F.regexp_replace(c, r"\([^)]*\)", ""))))
    return rows.withColumn(names[0], F.explode(both)).filter(F.col(names[0]) != "")


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct trimmed lines, without empty and comment lines."""
    return spark.read.text(path).select(F.trim("value").alias("word")).filter("word <> '' AND NOT startswith(word, '#')").distinct()


def exceptions(spark: SparkSession, path: str) -> DataFrame:
    """Distinct first fields of the lines that are neither empty nor comments."""
    return spark.read.text(path).filter("trim(value) <> '' AND NOT startswith(value, '#')").select(F.trim(F.element_at(F.split("value", "\t"), 1)).alias("word")).distinct()


def parsed_lines(lines: DataFrame, schema: str) -> DataFrame:
    """``lines`` with ``row``, the JSON object in ``value``, and ``bad`` where there is none."""
    kept = F.from_json("value", f"{schema}, _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt"})
    rows = lines.withColumn("row", kept)
    bad = F.col("row").isNull() | F.col("row._corrupt").isNotNull()
    return rows.withColumn("bad", bad).withColumn("row", F.when(~F.col("bad"), F.col("row").dropFields("_corrupt")))


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, corrupt lines)."""
    rows = parsed_lines(spark.read.text(path).filter("trim(value) <> ''"), schema)
    return rows.filter("NOT bad").select("row.*"), rows.filter("bad").select("value")


def other_files(spark: SparkSession, pattern: str, but: str) -> DataFrame:
    """Lines (file, value) of all files that the pattern names but one."""
    rows = spark.read.text(pattern).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value")
    return rows.filter(F.col("file") != but)


def corpus_tokens(spark: SparkSession, folder: str, extension: str, pattern: str = "[a-z]+") -> DataFrame:
    """(token, files, n) of all files with the extension below a folder."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{extension}").text(folder)
    tokens = rows.select(F.input_file_name().alias("file"), F.explode(F.regexp_extract_all(F.lower("value"), F.lit(f"({pattern})"), F.lit(1))).alias("token"))
    per = tokens.groupBy("token", "file").agg(F.count("*").alias("k"))
    return per.groupBy("token").agg(F.count("*").alias("files"), F.sum("k").alias("n"))


def dump_entries(spark: SparkSession, path: str) -> DataFrame:
    """(title, redirect, definitions) of the pages of a MediaWiki dump (bz2 files are split by Spark): definition lines are
    those that begin with one #, cleaned of markup."""
    from wordloom.functions.scalars import wiki_text

    pages = spark.read.option("lineSep", "</page>").text(path).filter(F.contains("value", F.lit("<title>")))
    title = F.regexp_extract("value", "<title>([^<]*)</title>", 1)
    redirect = F.nullif(F.regexp_extract("value", '<redirect title="([^"]*)"', 1), F.lit(""))
    lines = F.filter(F.split(F.regexp_extract("value", "(?s)<text[^>]*>(.*?)</text>", 1), "\n"), lambda x: x.rlike("^#[^#*:]"))
    return pages.select(title.alias("title"), redirect.alias("redirect"), F.transform(lines, lambda x: wiki_text(F.substring(x, F.lit(2), F.length(x)))).alias("definitions"))


def markdown_table(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Rows ``| a | b |`` whose first cell is a number."""
    cells = F.transform(F.split(F.regexp_extract("value", r"^\|(.*)\|\s*$", 1), r"\|", -1), lambda x: F.trim(x))
    rows = spark.read.text(path).select(cells.alias("c")).filter((F.size("c") == len(names)) & F.element_at("c", 1).rlike("^[0-9]+$"))
    return rows.select(*[F.element_at("c", i + 1).alias(n) for i, n in enumerate(names)])


def ledger(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row a key; keys with contradicting values make the job fail."""
    out = rows.groupBy(*keys).agg(F.min(value).alias(value), F.count_distinct(value).alias("_n"))
    return out.filter(F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("contradicting values of "), F.concat_ws("|", *keys))).cast("boolean")).otherwise(F.lit(True))).drop("_n")


def tsv_cells(df: DataFrame) -> DataFrame:
    """All columns as strings without tabs and line ends."""
    return df.select(*[F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "[\t\r\n]", " ").alias(c) for c in df.columns])


def write_tsv(df: DataFrame, path: str, comment: str = "") -> None:
    """A folder of TSV files, each with a comment line, if there is one, and a line of names."""
    if not comment:
        tsv_cells(df).write.options(sep="\t", quote="", header="true").csv(path)
        return
    names = "\t".join(df.columns)
    lines = tsv_cells(df).select(F.concat_ws("\t", *df.columns).alias("value"))
    # the head goes before the first line of each file
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    lines.select(F.when(first, F.concat(F.lit(f"# {comment}\n{names}\n"), "value")).otherwise(F.col("value")).alias("value")).write.text(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines; ``mode`` append adds to a folder."""
    df.write.mode(mode).json(path)


def fingerprint(lines: DataFrame, value: str = "value") -> DataFrame:
    """A digest of a multiset of lines that no order of rows changes: the count and the sum of SHA-256 prefixes."""
    h = F.conv(F.substring(F.sha2(F.col(value), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return lines.agg(F.count("*").alias("n"), F.sum(h).alias("digest"))
