"""Readers and writers (S1-S11).  Schemas are declared, never inferred."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTE_SCHEMA = T.StructType([
    T.StructField("quote_id", T.LongType()), T.StructField("lemma", T.StringType()),
    T.StructField("word", T.StringType()), T.StructField("numbering", T.StringType()),
    T.StructField("quote", T.StringType()), T.StructField("keyword", T.StringType()),
    T.StructField("year", T.IntegerType()), T.StructField("n_words", T.IntegerType())])

PAIR_SCHEMA = T.StructType([T.StructField("S1", T.StringType()), T.StructField("S2", T.StringType()),
                            T.StructField("Y1", T.IntegerType()), T.StructField("Y2", T.IntegerType())])

SENTENCE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("tokens", T.ArrayType(T.StringType())),
    T.StructField("pos_tags", T.ArrayType(T.StringType())), T.StructField("source", T.StringType())])

SCORE_SCHEMA = T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("bg_id", T.LongType()),
    T.StructField("item_year", T.IntegerType()), T.StructField("bg_year", T.IntegerType()),
    T.StructField("score", T.DoubleType()), T.StructField("model", T.StringType()),
    T.StructField("direction", T.StringType())])


def read_quotes(spark: SparkSession, path: str, sep: str = "\t", schema=QUOTE_SCHEMA) -> DataFrame:
    """Delimited quotations with a header (tab or comma)."""
    return spark.read.schema(schema).option("header", True).option("sep", sep) \
        .option("multiLine", False).csv(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated dated pairs S1, S2, Y1, Y2."""
    return spark.read.schema(PAIR_SCHEMA).option("header", True).option("sep", "\t").csv(path)


def read_tagged_corpus(spark: SparkSession, path: str) -> DataFrame:
    """S3: tagged text files.  Lines starting '<' or '{' and blank lines are skipped; other
    lines are 'token/TAG'; a line tagged ID closes the sentence and names it; tokens after
    the last ID line of a file are dropped.  Lines without exactly one '/' go to the
    ``rejects`` column of their sentence instead of failing the job.

    A record of the scan is a sentence (the text up to an ID line), so files of any size are split
    over tasks and nothing is shuffled.  Carriage returns and blanks behind ID are allowed.
    """
    raw = spark.read.option("lineSep", "/ID\n").text(path).select(
        F.input_file_name().alias("source"), "value")
    # ID lines that the separator did not match: other line ends, or no line end at the file's end
    one = raw.select("source", F.explode(F.split("value", r"/ID[ \t\r]*(?:\n|$)")).alias("value"))
    lines = F.filter(F.transform(F.split("value", "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")),
                     lambda x: (F.length(x) > 0) & ~x.startswith("<") & ~x.startswith("{"))
    # the last line of a sentence is its name, cut off before /ID; a rest of the file still has a tag
    named = one.withColumn("_l", lines).where(F.size("_l") > 0).withColumn(
        "id", F.element_at("_l", -1)).where(~F.col("id").contains("/"))
    body = F.transform(F.slice("_l", 1, F.size("_l") - 1), lambda x: F.struct(
        x.alias("line"), F.split(x, "/").alias("p")))
    named = named.withColumn("_b", body)
    good = F.filter("_b", lambda x: F.size(x["p"]) == 2)
    return named.select("id", F.transform(good, lambda x: x["p"][0]).alias("tokens"),
                        F.transform(good, lambda x: x["p"][1]).alias("pos_tags"), "source",
                        F.transform(F.filter("_b", lambda x: F.size(x["p"]) != 2),
                                    lambda x: x["line"]).alias("rejects"))


def read_sentences(spark: SparkSession, path: str, task: str = "pos", schema=SENTENCE_SCHEMA):
    """JSON lines (or CSV by extension); returns (text column, label column) names
    chosen as '<tokens>' else the first column and '<task>_tags' else the second."""
    if path.endswith(".csv"):
        # a CSV cell holds the items of an array separated by blanks
        flat = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
        df = spark.read.schema(flat).option("header", True).csv(path)
        df = df.select(*[F.filter(F.split(f.name, r"\s+"), lambda x: x != "").alias(f.name)
                         if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in schema])
    else:
        df = spark.read.schema(schema).json(path)
    cols = df.columns
    text = "tokens" if "tokens" in cols else cols[0]
    label = f"{task}_tags" if f"{task}_tags" in cols else cols[1]
    return df, text, label


def write_result(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite",
                 partition_by=None) -> None:
    """CSV / TSV / JSON lines / parquet; folders are created by the writer.  No
    coalesce(1): one file per task, as a cluster writes."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "tsv":
        w.option("header", True).option("sep", "\t").csv(path)
    elif fmt == "jsonl":
        w.json(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(fmt)


def write_if_absent(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Skip the write when the output already exists (mode 'ignore')."""
    write_result(df, path, fmt, mode="ignore")


def write_tag_lines(df: DataFrame, path: str, col: str = "preds") -> None:
    """One line per sentence, labels joined by spaces."""
    df.select(F.array_join(col, " ").alias("value")).write.mode("overwrite").text(path)


def write_predictions(df: DataFrame, path: str, **params) -> None:
    """Long prediction rows; run parameters become partition columns (not file names)."""
    for k, v in params.items():
        df = df.withColumn(k, F.lit(v))
    df.write.mode("append").partitionBy(*params.keys()).parquet(path)


def with_params(df: DataFrame, **params) -> DataFrame:
    """Append run parameters as constant columns."""
    for k, v in params.items():
        df = df.withColumn(k, F.lit(v))
    return df


def write_vectors(df: DataFrame, path: str, id_col: str = "id", vec_col: str = "embedding",
                  n_subtokens: str | None = None) -> None:
    """Vectors as parquet (id, embedding ARRAY<FLOAT>, n_subtokens); a word without a
    vector is an absent row, never a zero vector."""
    cols = [F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("embedding")]
    cols.append((F.col(n_subtokens) if n_subtokens else F.lit(None)).cast("int").alias("n_subtokens"))
    df.where(F.col(vec_col).isNotNull()).select(*cols).write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_scores(df: DataFrame, path: str) -> None:
    """The item x background score table, partitioned by model and direction (columns of SCORE_SCHEMA).

    What is written replaces its own (model, direction) partitions and leaves the others: a model can be
    scored again without the rest.  An empty table makes the folder, so it reads back as empty."""
    spark = df.sparkSession
    rows = df.select(*[F.col(f.name).cast(f.dataType) for f in SCORE_SCHEMA])
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("model", "direction").parquet(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(root)


def read_scores(spark: SparkSession, path: str, model: str | None = None,
                direction: str | None = None) -> DataFrame:
    """Scores of all models, or of one model or direction (other partitions are not read)."""
    df = spark.read.schema(SCORE_SCHEMA).parquet(path)
    for column, value in (("model", model), ("direction", direction)):
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def settle(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: costly expressions are computed once, lineage is cut by
    files that outlive executors, and the sizes are known from then on."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    import uuid
    from lexispark.session import checkpoint_dir
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
