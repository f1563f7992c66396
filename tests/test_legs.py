"""Every order's legs are apportioned."""

from pyspark.sql import functions as F

from tidemark import plans


def test_every_order_has_its_share(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").dropDuplicates(["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    want = {r.l_orderkey for r in lines.where("l_quantity >= 2").select("l_orderkey").distinct().collect()}
    got = plans.QUERIES["leg_apportionment"](spark, sf).groupBy("id").agg(F.sum("quantity").alias("n")).collect()
    ids = {r.id for r in got}
    assert max(ids) >= 800 and all(r.n > 0 for r in got)
    single = {r.l_orderkey for r in lines.groupBy("l_orderkey").agg(F.count_distinct("l_linenumber").alias("a"), F.count("*").alias("b")).where("a = b").collect()}
    assert want & single <= ids
