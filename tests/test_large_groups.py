"""Joins of rows with many equal keys make no more rows than they are asked for."""

import pytest
from pyspark.sql import functions as F

from leadloom.operators import linkage, network


@pytest.fixture
def joined_rows(spark):
    """Collects a frame; its rows and the most rows that one of its joins gave."""

    def run(df):
        rows = df.collect()
        most, todo = 0, [df._jdf.queryExecution().executedPlan()]
        while todo:
            node = todo.pop()
            if "Join" in node.nodeName():
                most = max(most, node.metrics().apply("numOutputRows").value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
        return rows, most

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield run
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_entities_of_a_host_with_many_leads(spark, joined_rows):
    leads = spark.range(500).select(F.col("id").alias("lead_id"), F.lit("https://www.a.com/").alias("website")).union(spark.createDataFrame([(500, "b.com"), (501, "c.com"), (502, None)], "lead_id long, website string"))
    entities = spark.range(400).select(F.concat(F.lit("Q"), F.col("id") + 10).alias("qid"), (F.col("id") % 7).alias("position"), F.lit("a.com").alias("website")).union(spark.createDataFrame([("Q2", 0, "http://a.com/x"), ("Q1", 5, "b.com"), ("Q3", None, "b.com"), ("Q4", 0, None)], "qid string, position long, website string"))
    rows, most = joined_rows(linkage.entity_by_host(leads, entities))
    assert dict(rows) == {n: "Q10" for n in range(500)} | {500: "Q3"}
    assert most <= 501


def test_addresses_in_a_network_of_many_ranges(spark, joined_rows):
    ips = spark.range(100).select((F.col("id") + (10 << 24)).alias("ip"))
    many = spark.range(300).select(F.lit(10 << 24).cast("long").alias("network"), F.lit(16).alias("bits"), F.concat(F.lit("P"), 100 + F.col("id")).alias("provider"), F.lit("generic").alias("service"))
    ranges = many.union(spark.createDataFrame([(10 << 24, 16, "Z", "EC2"), (10 << 24, 16, "Y", "STORAGE"), ((10 << 24) + 64, 26, "W", "generic"), (0, 0, "Q", "generic")], "network long, bits int, provider string, service string"))
    want = [("Y", "STORAGE", 16)] * 64 + [("W", "generic", 26)] * 36
    rows, most = joined_rows(network.longest_prefix(ips, ranges))
    assert [tuple(r)[1:] for r in sorted(rows)] == want and most <= 300
    hosts = ips.select(F.lit("h").alias("host"), F.when(F.col("ip") % 2 == 0, "A.VERCEL.app").alias("cname"), "ip", F.lit("OVH").alias("holder"), (F.col("ip") % 2).alias("lead_id"))
    rows, most = joined_rows(network.classify_hosts(hosts, ranges))
    assert {(r.lead_id, r.provider, r.service, r.scope) for r in rows} == {(0, None, "Vercel", "edge"), (1, "Y", "STORAGE", "storage"), (1, "W", "generic", "workload")}
    assert len(rows) == 100 and most <= 150
    assert {tuple(r)[1:] for r in network.longest_prefix(ips, ranges.limit(0)).collect()} == {(None, None, None)}


def test_footprints_of_odd_observations(spark, joined_rows):
    rows = [
        (1, "AWS", "edge", "X", 5, False), (1, "AWS", "workload", None, 2, None), (1, None, "edge", "B", 4, None), (1, None, None, "A", 9, True), (1, None, None, "A", 3, False), (1, None, None, "B", 8, None),
        (2, "GCP", None, None, 1, True), (2, None, None, None, 0, None), (3, None, None, "C", 1, None), (3, None, None, "D", 2, False), (4, None, None, "E", 7, None), (4, None, None, None, 1, True), (5, None, None, None, 1, True),
    ]
    got, most = joined_rows(linkage.footprints(spark.createDataFrame(rows, "lead_id long, provider string, scope string, holder string, ordinal long, panel boolean")))
    assert sorted(map(tuple, got), key=str) == [
        (1, "EDGE", "AWS", None, 5), (1, "MANAGED_HOSTING", None, "A", 3), (1, "PUBLIC_CLOUD", "AWS", None, 2), (1, "UNKNOWN", None, "B", 4), (2, "PUBLIC_CLOUD", "GCP", None, 1),
        (3, "UNKNOWN", None, "C", 1), (3, "UNKNOWN", None, "D", 2), (4, "MANAGED_HOSTING", None, "E", 7),
    ]
    assert most == 0
