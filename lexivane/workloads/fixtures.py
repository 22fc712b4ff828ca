"""Views of the driver tables in the shapes the operators work on.

Every view keeps all rows of its tables. Remainders of an id only vary the
values a row gets, such as which optional field is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivane.functions import text as X
from lexivane.operators.embed import WordEmbedder, embed
from lexivane.sources.snapshot import POSITION, positioned

DIM = 384
VECTOR_DIM = 64


def scan(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table over all cores: a file of one row group would be a single task."""
    rows = scan(spark, folder, name)
    cores = spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def unless(column: str, divisor: int, value: Column) -> Column:
    """The value, but null on every ``divisor``-th id."""
    return F.when(F.col(column) % divisor != 0, value)


def first_line(text: Column) -> Column:
    return F.element_at(F.split(text, "\n", 2), 1)


def noisy(text: Column, key: str = "doc_id") -> Column:
    """Unusual whitespace in place of punctuation, on every third row."""
    strange = F.translate(text, ",.", "\u00a0\u001c")
    edged = F.concat(F.lit("\u2003"), strange, F.lit("\u0085"))
    return F.when(F.col(key) % 3 == 0, edged).otherwise(text)


def papers_of(documents: DataFrame) -> DataFrame:
    text = F.col("text")
    return documents.select(
        F.concat(F.lit("doc-"), "doc_id").alias("paper_id"),
        X.clean_title(first_line(text)).alias("title"),
        X.clean_abstract(text).alias("abstract"),
        unless("doc_id", 7, F.concat("source", F.lit("; "), "lang")).alias("authors"),
        unless("doc_id", 11, F.lit(1991) + F.col("doc_id") % 34).cast("int").alias("year"),
        F.col("source").alias("venue"),
        unless("doc_id", 5, F.concat(F.lit("10.1000/"), "doc_id")).alias("doi"),
        unless("doc_id", 13, F.concat(F.lit("cs."), F.upper("lang"), F.lit(" "), "source")).alias(
            "category"
        ),
    )


def papers(spark: SparkSession, folder: str) -> DataFrame:
    return papers_of(table(spark, folder, "documents"))


def labelled_papers(spark: SparkSession, folder: str) -> DataFrame:
    """Papers of labelled documents with other values: an update."""
    documents = table(spark, folder, "documents")
    labels = scan(spark, folder, "labels")
    changed = papers_of(documents.join(labels, "doc_id"))
    return changed.withColumns(
        {
            "title": F.substring(F.concat(F.lit("Revised: "), "title"), 1, X.TITLE_CHARS),
            "venue": F.lit(None).cast("string"),
            "order": F.lit(0).cast("bigint"),
        }
    )


def conversation_papers(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn of a conversation is a row of the same id: the last one counts."""
    return scan(spark, folder, "conversations").select(
        F.concat(F.lit("conv-"), "conv_id").alias("paper_id"),
        X.clean_title(F.concat("role", F.lit(" "), "conv_id")).alias("title"),
        X.clean_abstract(F.col("text")).alias("abstract"),
        F.when(F.col("role") != "user", F.col("role")).alias("authors"),
        (F.lit(2000) + F.col("turn")).cast("int").alias("year"),
        F.lit(None).cast("string").alias("venue"),
        F.lit(None).cast("string").alias("doi"),
        F.lit("dialogue").alias("category"),
        F.col("turn").cast("bigint").alias("order"),
    )


def snapshot_lines(documents: DataFrame, *keep: str) -> DataFrame:
    """A metadata record per document as a JSON line, faulty ones among them."""
    case = F.col("doc_id") % 17
    key = F.col("doc_id").cast("string")

    def only(*cases: int) -> Column:
        return case.isin(*cases)

    title = (
        F.when(only(3), F.concat(F.lit("@bad@"), first_line(F.col("text"))))
        .when(only(4, 5), F.lit(None))
        .when(only(12), F.concat(F.lit("\u00a0a\u001c b\u2003"), first_line(F.col("text"))))
        .when(only(13), F.repeat(F.lit("long "), 820))
        .otherwise(first_line(F.col("text")))
    )
    ident = (
        F.when(only(6), F.concat(F.lit("cs/"), key))
        .when(only(7), F.concat(key, F.repeat(F.lit("x"), 70)))
        .when(only(8), F.lit(" "))
        .otherwise(key)
    )
    dated = F.concat((F.lit(1991) + F.col("doc_id") % 34).cast("string"), F.lit("-05-01"))
    record = F.struct(
        ident.alias("id"),
        title.alias("title"),
        F.col("text").alias("abstract"),
        F.when(only(15), F.lit("")).otherwise(F.concat("source", F.lit("; "), "lang")).alias("authors"),
        F.when(only(16), F.lit("cs.AIX"))
        .when(F.col("lang") == "en", F.lit("cs.CL cs.IR"))
        .when(F.col("lang") == "fr", F.lit("math.CO"))
        .otherwise(F.lit("stat.ML cs.LG"))
        .alias("categories"),
        F.when(~only(9, 10, 11), dated).alias("update_date"),
        F.when(only(14), F.lit(" \u00a0")).otherwise(F.concat(F.lit(" 10.1/"), key)).alias("doi"),
        unless("doc_id", 5, F.col("source")).alias("journal-ref"),
    )
    extra = (
        F.when(only(4), F.lit(',"title":null}'))
        .when(only(9), F.lit(',"versions":[{"created":"Mon, 2 Apr 2007 19:18:42 GMT"}]}'))
        .when(only(10), F.lit(',"versions":[{"created":"2007-04-02"},{"created":"2011-01-01"}]}'))
        .when(only(11), F.lit(',"versions":["2019-01-02"]}'))
        .otherwise(F.lit("}"))
    )
    json = F.to_json(record)
    json = F.concat(F.substring(json, F.lit(1), F.length(json) - 1), extra)
    bad_byte = F.lit(bytearray(b"\xff")).cast("string")
    line = (
        F.when(only(0), F.lit(" \u00a0 "))
        .when(only(1), F.concat(F.lit("{bad "), json))
        .when(only(2), F.concat(F.lit("["), json, F.lit("]")))
        .when(only(3), F.replace(json, F.lit("@bad@"), bad_byte))
        .otherwise(json)
    )
    return documents.select(*keep, line.alias("value"))


def lines(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot_lines(table(spark, folder, "documents"), "doc_id")


def lines_in_file_order(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot_lines(positioned(scan(spark, folder, "documents")), "doc_id", *POSITION)


def vector_papers(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("vec_id")
    return table(spark, folder, "embeddings").select(
        "vec_id",
        "label",
        F.concat(F.lit("vec-"), key).alias("paper_id"),
        F.when(F.col("label") != 3, F.concat(F.lit("vector "), key)).alias("title"),
        F.lit(None).cast("string").alias("abstract"),
        F.concat(F.lit("group "), "label").alias("authors"),
        unless("vec_id", 11, F.lit(1991) + key % 34).cast("int").alias("year"),
        F.lit(None).cast("string").alias("venue"),
        F.lit(None).cast("string").alias("doi"),
        unless("vec_id", 13, F.concat(F.lit("c"), "label", F.lit(" s"), key % 3)).alias("category"),
        "embedding",
    )


def mean_vector(rows: DataFrame, *by: str) -> DataFrame:
    """Mean of the vectors of each group, as one row per group."""
    means = (
        rows.select(*by, F.posexplode("embedding").alias("at", "x"))
        .groupBy(*by, "at")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("at", "x")))
    return means.groupBy(*by).agg(F.transform(ordered, lambda e: e["x"]).alias("embedding"))


def label_queries(spark: SparkSession, folder: str, filtered: bool = False) -> DataFrame:
    """One query per label: the mean of its vectors."""
    means = mean_vector(table(spark, folder, "embeddings"), "label")
    label = F.col("label")
    queries = means.select(
        label.cast("bigint").alias("query_id"), "embedding", F.lit(8).alias("top_k"), "label"
    )
    if filtered:
        queries = queries.withColumns(
            {
                "top_k": (F.lit(3) + label).cast("int"),
                "min_year": F.when(label % 2 == 0, F.lit(1995) + label).cast("int"),
                "max_year": F.when(label % 3 != 0, F.lit(2015) + label).cast("int"),
                "category_contains": F.when(label % 4 == 1, F.concat(F.lit("C"), label))
                .when(label % 4 == 2, F.lit("c_ s1"))
                .when(label % 4 == 3, F.lit("s2")),
            }
        )
    return queries.drop("label")


def requests(spark: SparkSession, folder: str) -> DataFrame:
    item = F.col("item_id")
    return scan(spark, folder, "benchmark").select(
        item.alias("query_id"),
        F.concat(F.lit(" "), "text", F.lit("\u00a0")).alias("query"),
        (F.lit(3) + item % 6).cast("int").alias("top_k"),
        F.when(item % 3 == 0, F.lit(1998)).cast("int").alias("min_year"),
        F.when(item % 3 == 0, F.lit(2016)).cast("int").alias("max_year"),
        F.when(item % 4 == 1, F.lit("cs.en"))
        .when(item % 4 == 2, F.lit("CS_FR"))
        .when(item % 4 == 3, F.lit("  "))
        .alias("category_contains"),
    )


def text_queries(spark: SparkSession, folder: str) -> DataFrame:
    queries = scan(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), "text", F.lit(8).alias("top_k")
    )
    return embed(queries, WordEmbedder(DIM), text="text").drop("text")
