"""Chunks of pages whose markup never ends, in time that follows the page."""

import time

import pytest

from leadloom.operators import pages

HOSTILE = {
    "details": "<details>" * 20_000, "tr": "<tr>" * 20_000, "script": "<script " * 20_000, "ld": '<script type="application/ld+json">' * 5_000, "open": "<" * 100_000, "ends": "</details>" * 20_000, "attributes": "<details " + "a=b " * 50_000,
    "nested": "<details>" * 10_000 + "x" + "</details>" * 10_000, "json": '<script type="application/ld+json">' + "[" * 50_000 + "</script>",
}


@pytest.fixture(scope="module")
def warm(spark):
    pages.chunks(spark.createDataFrame([(0, "<p>x</p>")], "page_id long, html string")).collect()


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_hostile_page(spark, warm, name):
    table = spark.createDataFrame([(1, HOSTILE[name] + "<p>end</p>")], "page_id long, html string").repartition(1)
    began = time.time()
    rows = pages.chunks(table).collect()
    assert time.time() - began < 6 and len(rows) <= 2  # about a second; six on a machine that is busy


def test_shapes(spark):
    ld = '<script type="application/ld+json">{}</script>'
    cases = [
        ("a", ld.format('{"@type":["X","FAQPage"],"mainEntity":{"name":"q","acceptedAnswer":{"text":"a&b"}}}'), [("jsonld:FAQPage.mainEntity[0]", "q a&b")]), ("b", ld.format('{"@graph":{"@type":"FAQPage"},"@type":"FAQPage","mainEntity":[{"name":"x"}]}'), [("jsonld:FAQPage.mainEntity[0]", "x")]),
        ("c", ld.format("{bad") + ld.format('{"@type":"FAQPage","mainEntity":null}'), []), ("d", "<detailsx>no</detailsx><details>a<details>b</details>c</details>", [("details[0]", "a b")]), ("e", None, []), ("f", "", []), ("g", ld.format("null") + ld.format("3"), []),
        ("h", "<script>{\"@type\":\"FAQPage\",\"mainEntity\":[{\"name\":\"no\"}]}</script>", []),
    ]
    table = spark.createDataFrame([(i, html) for i, (_, html, _) in enumerate(cases)], "page_id long, html string")
    got = {}
    for r in pages.chunks(table).where("locator <> 'main_text'").collect():
        got.setdefault(r["page_id"], []).append((r["locator"], r["text"]))
    assert {i: sorted(got.get(i, [])) for i in range(len(cases))} == {i: want for i, (_, _, want) in enumerate(cases)}
