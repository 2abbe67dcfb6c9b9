"""TSV, JSON lines, JSON documents, marker texts, logs and manifests.

The corpus files are text: fields may hold tabs, quotes and line ends, and "" is not null.  Schemas are
explicit and all strings; nothing is inferred.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qaloom.functions.text import py_tokens
from qaloom.operators.guards import RelationError
from qaloom.operators.relations import same_rows

_TSV = {"sep": "\t", "header": "true", "multiLine": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "maxCharsPerColumn": "-1"}


def strings(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_tsv(spark: SparkSession, path: str | list[str], names: Sequence[str], strict: bool = False, missing: bool = False) -> DataFrame:
    """A TSV relation of strings.  strict: a ragged row stops the job.  missing: empty fields and NA are null, else only
    absent ones are."""
    reader = spark.read.schema(strings(names)).options(**_TSV).option("mode", "FAILFAST" if strict else "PERMISSIVE").option("enforceSchema", "false")
    reader = reader.option("emptyValue", "").option("nullValue", "\u0001")
    df = reader.csv(path)
    return df.select(*(F.when(F.col(n).isin("", "NA"), None).otherwise(F.col(n)).alias(n) for n in names)) if missing else df


def read_typed_tsv(spark: SparkSession, path: str | list[str], schema: str, strict: bool = True) -> DataFrame:
    """A TSV relation of a given schema; empty fields and NA are null, and a value that its type doesn't take stops the job
    (strict) or is null."""
    fields = T.StructType.fromDDL(schema)
    raw = read_tsv(spark, path, fields.names, strict, missing=True)
    return raw.select(*(F.col(f.name).cast(f.dataType) if strict else F.col(f.name).try_cast(f.dataType) for f in fields)).toDF(*fields.names)


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists", quote_all: bool = False) -> None:
    """Writes so that read_tsv gives the same rows."""
    df.write.mode(mode).options(**_TSV).option("emptyValue", "" if quote_all else '""').option("nullValue", "\u0001").option("quoteAll", str(quote_all).lower()).csv(path)


def write_checked(df: DataFrame, path: str) -> DataFrame:
    """write_tsv, then reads back and compares all rows."""
    write_tsv(df, path, quote_all=True)
    back = read_tsv(df.sparkSession, path, df.columns)
    if not same_rows(df, back):
        raise RelationError(f"{path} doesn't read back as it was written")
    return back


def read_partitioned(spark: SparkSession, glob: str, names: Sequence[str], **parts: str) -> DataFrame:
    """Files of many places; each of `parts` is a column and the pattern that takes its value from a file's path."""
    df = read_tsv(spark, glob, names).withColumn("_path", F.col("_metadata.file_path"))
    for name, pattern in parts.items():
        df = df.withColumn(name, F.regexp_extract("_path", pattern, 1))
    return df.drop("_path")


def split_by(df: DataFrame, column: str, path: str) -> None:
    """One folder of files for each value."""
    df.write.partitionBy(column).options(**_TSV).csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """A JSON document that is one object: id and value (a Spark type) of each entry."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("id", "value"))


def read_markers(spark: SparkSession, path: str, markers: Sequence[str]) -> DataFrame:
    """Blocks of consecutive lines "MARKER: value" in the given order; block numbers them.  Incomplete blocks are left out."""
    whole = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    line = whole.select("file", F.posexplode(F.split("value", "\n")).alias("no", "line"))
    w = W.partitionBy("file").orderBy("no")
    out = line
    holds: Column = F.lit(True)
    for k, m in enumerate(markers):
        at = F.lead("line", k).over(w)
        out = out.withColumn(m.lower(), F.when(at.startswith(m + ":"), F.trim(F.substring(at, F.lit(len(m) + 2), F.length(at)))))
        holds &= F.col(m.lower()).isNotNull()
    kept = out.where(holds)
    return kept.withColumn("block", F.row_number().over(w)).select("file", "block", *(m.lower() for m in markers))


def read_log(spark: SparkSession, path: str, separator: str, pattern: str) -> DataFrame:
    """A log in records; found: what `pattern` extracts from each, in order."""
    return spark.read.option("lineSep", separator).text(path).select(F.regexp_extract_all("value", F.lit(pattern), F.lit(1)).alias("found"))


def append_tsv(df: DataFrame, path: str) -> None:
    """Adds rows to a folder of TSV files, each with its header once."""
    write_tsv(df, path, "append")


def log_counts(spark: SparkSession, path: str, separator: str, pattern: str, **parts: str) -> DataFrame:
    """value, n and a column for each of `parts` (a pattern over the file's path): the first find of each record, in lower case."""
    record = spark.read.option("lineSep", separator).text(path).select("value", F.col("_metadata.file_path").alias("_path"))
    named = [F.regexp_extract("_path", p, 1).alias(n) for n, p in parts.items()]
    found = record.select(*named, F.lower(F.get(F.regexp_extract_all("value", F.lit(pattern), F.lit(1)), F.lit(0))).alias("value"))
    return found.where("value is not null").groupBy(*parts, "value").agg(F.count(F.lit(1)).alias("n"))


def write_manifest(shards: Sequence[str], spark: SparkSession, path: str) -> None:
    """One line a shard."""
    spark.createDataFrame([(s,) for s in shards], "value string").coalesce(1).write.text(path)


def row_text(number: Column, question: Column, answer: Column, documents: Column) -> Column:
    """A row for people to read: number, size in words, documents, question and answer between rules."""
    rule = "-" * 80
    size = F.size(py_tokens(F.concat_ws(" ", documents, question)))
    return F.concat_ws("\n", F.concat(F.lit("Question No: "), number.cast("string")), F.concat(F.lit("Context Size: "), size.cast("string")), F.lit(""), F.lit("Documents:"), F.lit(""), documents, F.lit(""), F.lit(rule), F.lit(""), F.concat(F.lit("Question: "), question), F.lit(""), F.lit("Answer:"), answer, F.lit(""), F.lit(rule))


def write_row_texts(rows: DataFrame, key: str, text: str, path: str) -> None:
    """One folder with one text file for each key."""
    rows.select(F.col(key).cast("string").alias("key"), F.col(text).alias("value")).repartition("key").write.partitionBy("key").text(path)


def read_row_texts(spark: SparkSession, path: str) -> DataFrame:
    """key and value of what write_row_texts wrote."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), "/key=([^/]*)/", 1).alias("key"), F.regexp_replace("value", r"\n$", "").alias("value"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("shard")).where("shard <> ''")


def weights_document(types: DataFrame, mode: str, threshold: float, shift: float, floor: float) -> DataFrame:
    """One JSON document of an allocation round: types holds t, acc, before and w."""
    as_map = lambda c: F.map_from_entries(F.sort_array(F.collect_list(F.struct("t", c))))
    doc = types.agg(as_map("acc").alias("accuracy"), as_map("before").alias("weights_in"), as_map("w").alias("weights_out"))
    return doc.select(F.to_json(F.struct(F.lit(mode).alias("mode"), F.lit(threshold).alias("threshold"), F.lit(shift).alias("shift"), F.lit(floor).alias("floor"), "accuracy", "weights_in", "weights_out")).alias("value"))


def markdown_item(item_id: Column, question: Column, answer: Column, documents: Column) -> Column:
    shown = F.transform(documents, lambda d, i: F.concat(F.lit("### Document "), (i + 1).cast("string"), F.lit("\n\n"), d))
    return F.concat_ws("\n\n", F.concat(F.lit("## "), item_id), F.concat(F.lit("**Question.** "), question), F.concat(F.lit("**Answer.** "), answer), F.array_join(shown, "\n\n"))


def latex_table(rows: DataFrame, caption: str) -> str:
    """A small aggregate as a LaTeX table."""
    escape = lambda v: str(v).replace("&", r"\&").replace("%", r"\%").replace("_", r"\_")
    body = [" & ".join(escape(v) for v in r) + r" \\" for r in rows.collect()]
    head = " & ".join(escape(c) for c in rows.columns) + r" \\"
    return "\n".join([r"\begin{table}", rf"\caption{{{caption}}}", rf"\begin{{tabular}}{{{'l' * len(rows.columns)}}}", head, r"\hline", *body, r"\end{tabular}", r"\end{table}"])
