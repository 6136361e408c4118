"""Queries for sources and sinks (S1-S7): files are written from the tables into the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.parse import first_number
from ..operators import incremental as I
from ..operators.similar import use_checkpoints
from ..sources import files as S
from ..sources import versions as V
from .registry import query, table


def files_folder(spark) -> str:
    use_checkpoints(spark)
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"


@query("S1", "SELECT o_orderkey AS post_id, o_orderpriority AS title, o_totalprice AS price FROM orders WHERE o_orderkey % 5 <> 0")
def s1(spark, sf_dir):
    path = files_folder(spark)
    id_ = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("x"), F.col("o_orderkey").cast("string"))).otherwise(F.col("o_orderkey").cast("string"))
    rows = table(spark, sf_dir, "orders").select(id_.alias("post_id"), F.col("o_orderpriority").alias("title"), F.col("o_totalprice").alias("price"))
    rows.union(rows.where("post_id LIKE '%1'")).write.option("header", True).csv(path)  # some ids come twice
    return S.read_posts(spark, path, {"post_id": "long", "title": "string", "price": "double"}, "post_id")[0].drop("source_file")


@query("S2", """SELECT p_partkey::VARCHAR AS item_id, sha256(p_partkey || chr(10) || p_brand || chr(10) || p_name || chr(10) || p_size || chr(10) || (p_size * 7) || '+') AS fingerprint, p_size::DOUBLE AS price FROM part WHERE p_partkey % 9 <> 0""")
def s2(spark, sf_dir):
    path = files_folder(spark)
    part = table(spark, sf_dir, "part")
    item = F.struct(F.col("p_partkey").cast("string").alias("item_id"), F.col("p_brand").alias("brand"), F.when(F.col("p_partkey") % 9 != 0, F.col("p_name")).otherwise(" ").alias("title"), F.col("p_size").cast("string").alias("price"), F.concat((F.col("p_size") * 7).cast("string"), F.lit("+")).alias("sold_text"))
    part.select(F.to_json(F.struct(F.array(item).alias("items"))).alias("value")).write.text(f"{path}/lines")
    items = S.read_items(spark, f"{path}/lines", "b1", whole_files=False)
    return items.select("item_id", "fingerprint", first_number(F.col("price")).alias("price"))


@query("S3", """SELECT 'docs' AS platform, doc_id AS id, md5(text) AS text_key, lang FROM documents WHERE doc_id > 100 AND trim(text) <> '' UNION ALL SELECT 'chat', conv_id * 1000 + turn, md5(text), NULL FROM conversations WHERE conv_id * 1000 + turn > 100 AND trim(text) <> ''""")
def s3(spark, sf_dir):
    chat = table(spark, sf_dir, "conversations").withColumn("n", F.col("conv_id") * 1000 + F.col("turn"))
    rows = S.read_platforms([(table(spark, sf_dir, "documents"), "docs", {"id": "doc_id", "text": "text", "lang": "lang"}), (chat, "chat", {"id": "n", "text": "text"})], above=100)
    return rows.select("platform", "id", F.md5(F.col("text").cast("binary")).alias("text_key"), "lang")


@query("S4", """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 6 <> 0 THEN c_acctbal + 1 ELSE c_acctbal END AS balance, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 6 <> 0 THEN 'new' WHEN c_custkey % 6 = 0 THEN 'rejected' ELSE 'old' END AS status FROM customer WHERE c_custkey % 4 <> 0 OR c_custkey % 6 = 0 UNION ALL SELECT c_custkey, c_acctbal + 1, 'new' FROM customer WHERE c_custkey % 4 = 0 AND c_custkey % 6 <> 0""")
def s4(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    target = c.where((key % 4 != 0) | (key % 6 == 0)).select("c_custkey", F.col("c_acctbal").alias("balance"), F.when(key % 6 == 0, "rejected").otherwise("old").alias("status"))
    new = c.where(key % 2 == 0).select("c_custkey", (F.col("c_acctbal") + 1).alias("balance"), F.lit("new").alias("status"))
    path = files_folder(spark)
    V.publish(target, path)
    V.upsert_table(new, path, ["c_custkey"], ["balance", "status"], "status = 'rejected'")
    return V.read(spark, path)


@query("S5", """WITH t AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber <= 3) SELECT l_partkey, l_suppkey, min(l_quantity) AS l_quantity FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.l_partkey = l.l_partkey AND t.l_suppkey = l.l_suppkey) GROUP BY 1, 2""")
def s5(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return I.missing_rows(lines.select("l_partkey", "l_suppkey", "l_quantity"), lines.where("l_linenumber <= 3"), ["l_partkey", "l_suppkey"])


@query("S5b", """WITH t AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber <= 3), k AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT sum(n)::BIGINT AS scanned, count(*) FILTER (t.l_partkey IS NULL) AS missing, sum(CASE WHEN t.l_partkey IS NULL THEN n - 1 ELSE 0 END)::BIGINT AS duplicates FROM k LEFT JOIN t ON k.l_partkey = t.l_partkey AND k.l_suppkey = t.l_suppkey""")
def s5b(spark, sf_dir):
    """The counts that the write itself has seen."""
    lines, path = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_linenumber"), files_folder(spark)
    V.publish(lines.where("l_linenumber <= 3").drop("l_linenumber"), path)
    counts = V.insert_missing(lines.drop("l_linenumber"), path, ["l_partkey", "l_suppkey"])
    return spark.createDataFrame([(counts["scanned"], counts["missing"], counts["duplicates"])], "scanned long, missing long, duplicates long")


@query("S6", "SELECT n_regionkey, count(*) AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def s6(spark, sf_dir):
    path = files_folder(spark)
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.count("*").alias("n"))
    V.publish(rows.where("n < 0"), path)
    V.publish(rows, path)
    return V.read(spark, path)


@query("S7", "SELECT o_custkey, '[' || string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) || ']' AS orders FROM orders GROUP BY 1")
def s7(spark, sf_dir):
    path = files_folder(spark)
    S.write_csv(table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("orders")), path)
    return spark.read.csv(path, header=True, schema="o_custkey long, orders string", escape='"')
