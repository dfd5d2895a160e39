"""Measurement arrays bound to Parquet tables."""

SINO = """SELECT CAST(l_orderkey % 12 AS INT) AS view, CAST(l_partkey % 4 AS INT) AS det_row,
 CAST((l_orderkey + l_linenumber * 7 + l_suppkey) % 16 AS INT) AS channel,
 avg(l_extendedprice) / 50000 AS value FROM lineitem GROUP BY 1, 2, 3"""


def table(spark, sf_dir, name):
    """A table as a DataFrame, and under its name for SQL."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df.createOrReplaceTempView(name)
    return df


def run(spark, sf_dir, sql):
    table(spark, sf_dir, "lineitem")
    return spark.sql(sql)
