"""Query log derived from the given tables: the tables hold no SQL text, so Spark writes some.

Every order becomes one query: a template chosen by its key, filled with its customer and order key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BASE = "SELECT o_orderkey FROM orders WHERE o_custkey = {c}"

# template, toxic, attack type
TEMPLATES: list[tuple[str, int, str]] = [
    (BASE, 0, "none"),
    ("SELECT c.c_name, COUNT(*) FROM customer AS c JOIN orders AS o ON c.c_custkey = o.o_custkey "
     "WHERE o.o_totalprice > 100 GROUP BY c.c_name", 0, "none"),
    ("SELECT c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey = {k})", 0, "none"),
    ("SELECT n_name FROM nation UNION SELECT r_name FROM region", 0, "none"),
    ("SELECT COUNT(*) FROM orders WHERE o_orderkey BETWEEN 1 AND {k} AND NOT o_orderstatus = 'F' OR o_custkey = {c}",
     0, "none"),
    ("SELECT o_orderkey FROM orders WHERE o_orderpriority = 'true'", 0, "none"),
    (BASE + " OR 1=1", 1, "tautology"),
    (BASE + " OR 1 = 1", 1, "tautology"),
    (BASE + " OR '1'='1'", 1, "tautology"),
    (BASE + " OR 'a'='a'x", 1, "tautology"),
    (BASE + " OR TRUE", 1, "tautology"),
    (BASE + " AND 1=1", 1, "tautology"),
    (BASE + " AND 'a'='a'b", 1, "tautology"),
    (BASE + " -- AND o_orderstatus = 'O'", 1, "comment_injection"),
    (BASE + " /* hidden */", 1, "comment_injection"),
    (BASE + " # cut", 1, "comment_injection"),
    (BASE + " AND SLEEP(5)", 1, "time_delay"),
    (BASE + " AND PG_SLEEP(5)", 1, "time_delay"),
    (BASE + "; WAITFOR DELAY '0:0:5'", 1, "time_delay"),
    (BASE + " AND BENCHMARK(1000000, MD5(1))", 1, "time_delay"),
    (BASE + "; SELECT * FROM customer", 1, "piggy_back"),
    (BASE + "; DROP TABLE orders;", 1, "piggy_back"),
    (BASE + "; INSERT INTO region VALUES (9, 'x')", 1, "piggy_back"),
    (BASE + "; UPDATE customer SET c_acctbal = 0;", 1, "piggy_back"),
    (BASE + "; DELETE FROM orders", 1, "piggy_back"),
    ("DROP VIEW v_{c}", 1, "piggy_back"),
    ("TRUNCATE TABLE orders", 1, "piggy_back"),
    (BASE + " UNION SELECT NULL, NULL", 1, "union_injection"),
    (BASE + " UNION ALL SELECT table_name FROM information_schema.tables", 1, "union_injection"),
    (BASE + " UNION SELECT c_name FROM customer --", 1, "union_injection"),
    ("EXEC XP_CMDSHELL('dir {k}')", 1, "rce"),
    ("SELECT LOAD_FILE('/etc/passwd')", 1, "file_access"),
    (BASE + " INTO OUTFILE '/tmp/x'", 1, "file_access"),
    ("", 0, "none"),
    ("SELECT * FROM (SELECT * FROM (SELECT * FROM (SELECT * FROM orders CROSS JOIN nation) a) b) c", 1, "cartesian"),
    (BASE + " AND o_orderstatus = 'F", 1, "malformed"),
    ("SELECT " + "(" * 11 + "o_orderkey" + ")" * 11 + " FROM orders", 1, "nesting"),
]

# Untidy text for the cleaning steps: double quotes, surplus parentheses, dangling OR, odd spacing.
MESSY_TEMPLATES: list[str] = [
    "SELECT  o_orderkey\n FROM orders WHERE c = \"d'e {c}\" AND f = \"g",
    "a) ) ( b{k})",
    "SELECT 1; OR   {k} ; or x",
    "SELECT {c} FROM t intersect select 2 union  all select 3 or ",
    "SELECT f(\"a\"), g('it''s {k}') FROM t OR 'x' = 'y' ;",
    "SELECT (a), (b{k})) FROM (t)) OR 1 = 1;",
    "  \t SELECT \"\" , \"''{c}\"  ",
    "SELECT 'open {k} -- not a comment' /* note ' */ , 'rest",
    "SELECT a, b FROM x, y LEFT JOIN z ON x.k = {k} WHERE NOT (a = 1 OR b = 2) ORDER BY 1",
    "INSERT INTO t (a, b) SELECT a, b FROM u WHERE a = {k}",
    "(SELECT a FROM t) EXCEPT (SELECT b FROM u WHERE b BETWEEN {k} AND {c})",
    "SELECT f(g(h(i(j(k(l(a,b),c),d),e),f),g),h), {k} FROM t WHERE a IN (1,(2,(3,(4,(5,(6,(7,{c})))))))",
    "(((((SELECT a FROM t UNION SELECT b FROM u WHERE b = {k})))))",
    "((SELECT a, f(b, c), {k} FROM t))",
    "WITH a AS (SELECT x, y FROM t UNION SELECT z, {c} FROM u), b AS (SELECT 1) SELECT a.x, b.y, f(1, 2) FROM a JOIN b ON a.x = {k} WHERE a.x > 1 AND b.y < 2",
    "with a as (select 1) delete from t where k = {k}",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose text is to be scored.

    The bundled tables are one file of one row group each, which Spark cannot split; a table with fewer
    partitions than cores is dealt out again.
    """
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _fill(template: str = "template", customer: str = "o_custkey", key: str = "o_orderkey"):
    text = F.replace(F.col(template), F.lit("{c}"), F.col(customer).cast("string"))
    return F.replace(text, F.lit("{k}"), F.col(key).cast("string"))


def query_log(spark: SparkSession, sf_dir: str, extra: Sequence[str] = ()) -> DataFrame:
    """id, tid, db_id, question, toxic, attack, sql: one query per order; and more columns of the order."""
    rows = [(i, t, toxic, attack) for i, (t, toxic, attack) in enumerate(TEMPLATES)]
    templates = F.broadcast(spark.createDataFrame(rows, "tid INT, template STRING, toxic INT, attack STRING"))
    orders = texts(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", *extra)
    joined = orders.join(templates, F.col("o_orderkey") % len(TEMPLATES) == F.col("tid"))
    return joined.select(
        F.col("o_orderkey").alias("id"),
        "tid",
        F.concat(F.lit("db_"), F.col("o_orderstatus")).alias("db_id"),
        F.concat(F.lit("Which orders were placed by customer "), F.col("o_custkey").cast("string")).alias("question"),
        "toxic",
        "attack",
        _fill().alias("sql"),
        *extra,
    )


def messy_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, sql: untidy text, one per order."""
    rows = list(enumerate(MESSY_TEMPLATES))
    templates = F.broadcast(spark.createDataFrame(rows, "tid INT, template STRING"))
    orders = texts(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = orders.join(templates, F.col("o_orderkey") % len(MESSY_TEMPLATES) == F.col("tid"))
    return joined.select(F.col("o_orderkey").alias("id"), _fill().alias("sql"))


def gold_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """db_id, question, gold_sql: what the clean model should have produced for each question."""
    orders = table(spark, sf_dir, "orders").withColumn("template", F.lit(BASE))
    return orders.select(
        # A tenth is filed under another database, so that some questions find no gold.
        F.when(F.col("o_custkey") % 10 == 7, F.lit("none")).otherwise(F.concat(F.lit("db_"), F.col("o_orderstatus"))).alias("db_id"),
        F.concat(F.lit("Which orders were placed by customer "), F.col("o_custkey").cast("string")).alias("question"),
        _fill().alias("gold_sql"),
    )


def as_corpus(log: DataFrame) -> DataFrame:
    """The query log in the layout of a labelled corpus."""
    return log.withColumnRenamed("sql", "query")


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a toxic label as a corpus: real, long, multilingual text."""
    docs = texts(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return docs.select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("query"),
        F.lit("").alias("question"),
        "toxic",
        F.col("lang").alias("db_id"),
        F.col("source").alias("attack"),
    )
