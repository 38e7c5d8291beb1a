"""Scans of tool calls run on all cores, pass once over a batch, and try rules only on what a call carries."""

import time

from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions.text import all_normalised
from tessera.operators.impact import classified
from tessera.plans import scans
from tessera.rules.impact import ImpactRules


def test_small_tables_of_the_queries_are_dealt_to_all_cores(spark):
    for made in (catalog._calls, catalog._bodies, catalog.P.records):
        df = made(spark, "/root/testdata/sf0.001")
        assert int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 30
        assert scans.spread(df)._jdf.queryExecution().optimizedPlan().toString().startswith("Repartition ")


def test_arrays_of_null_cost_no_square_of_a_batch(spark):
    most = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "150000")
    try:
        def seconds(value) -> float:
            began = time.perf_counter()
            spark.range(0, 150_000, 1, 1).select(F.when(F.col("id") < 0, F.array(F.lit("x"))).otherwise(value).alias("a")).select(all_normalised("a")).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - began

        seconds(F.array().cast("array<string>"))  # warms up
        empty, null = seconds(F.array().cast("array<string>")), seconds(F.lit(None).cast("array<string>"))
        assert null < 3 * empty + 1
        df = spark.createDataFrame([(None,), ([],), (["a  b", None],)], "a array<string>")
        assert [r.b for r in df.select(all_normalised("a").alias("b")).collect()] == [None, [], ["a b", None]]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)


def test_rules_on_commands_and_urls_are_not_tried_on_calls_without_them(spark):
    calls = spark.createDataFrame([("get_item", {"k": "1"}), ("shell", {"command": "uptime"}), ("http_get", {"url": "https://a.b/c"})], "tool_name string, arguments map<string,string>")
    rules = ImpactRules(commands=[("c", "destructive", "high", {"not": {"name": ["ls"]}}, None)], urls=[("u", "network", "high", {"not": {"host": ["x.y"]}}, None)], tools=[], combinations=[], sql=[], escalations=[])
    assert [r.impact_class for r in classified(calls, rules=rules).collect()] == ["unknown", "destructive", "network"]
