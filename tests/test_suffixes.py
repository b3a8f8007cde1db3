"""Public-suffix rules on the kinds of cases that the list's own test data has."""

from leadloom.operators import suffixes

CASES = {
    "com": None, "example.com": "example.com", "a.b.Example.COM.": "example.com", "uk": None, "co.uk": None, "b.co.uk": "b.co.uk", "a.b.co.uk": "b.co.uk", "ck": None, "test.ck": None, "b.test.ck": "b.test.ck", "a.b.test.ck": "b.test.ck",
    "www.ck": "www.ck", "www.www.ck": "www.ck", "c.kobe.jp": None, "b.c.kobe.jp": "b.c.kobe.jp", "city.kobe.jp": "city.kobe.jp", "www.city.kobe.jp": "city.kobe.jp", "kobe.jp": "kobe.jp", "github.io": None, "ann.github.io": "ann.github.io",
    "unlisted": None, "a.unlisted": "a.unlisted", "x.a.unlisted": "a.unlisted", "x.eu-1.compute.amazonaws.com": "x.eu-1.compute.amazonaws.com",
}


def test_rules(spark):
    hosts = spark.createDataFrame([(h,) for h in [*CASES, *CASES, None, "", "a..b", "10.0.0.1", "[::1]"]], "host string")
    got = {r["host"]: r["registrable"] for r in suffixes.registrable(hosts, suffixes.common_rules(spark)).collect()}
    assert got == CASES
    public = {r["host"]: r["registrable"] for r in suffixes.registrable(hosts, suffixes.common_rules(spark), private=False).collect()}
    assert public["ann.github.io"] == "github.io" and public["b.co.uk"] == "b.co.uk"


def test_rules_from_a_file(spark, tmp_path):
    path = tmp_path / "rules.dat"
    path.write_text("// a comment\n// ===BEGIN ICANN DOMAINS===\n\ncom\n*.ck  text behind\n!www.ck\n// ===END ICANN DOMAINS===\n// ===BEGIN PRIVATE DOMAINS===\nGitHub.io\n// ===END PRIVATE DOMAINS===\n")
    got = sorted(tuple(r) for r in suffixes.read_rules(spark, str(path)).collect())
    assert got == [("ck", "wildcard", "icann"), ("com", "normal", "icann"), ("github.io", "normal", "private"), ("www.ck", "exception", "icann")]


def test_siblings(spark):
    rows = [(1, 0, "acme.co.uk", "Careers.acme.co.uk"), (1, 1, "acme.co.uk", "careers.acme.co.uk"), (1, 2, "acme.co.uk", "shop.acme.co.uk"), (1, 3, "acme.co.uk", "eng-team.x.acme.co.uk"), (1, 4, "acme.co.uk", "status.acme.co.uk"), (2, 0, "a.github.io", "careers.github.io"), (2, 1, "a.github.io", "status.a.github.io"), (3, 0, "acme.co.uk", "status.other.co.uk"), (4, 0, None, None)]
    links = spark.createDataFrame(rows, "page_id int, position int, host string, link_host string")
    got = [tuple(r) for r in suffixes.sibling_hosts(links, suffixes.common_rules(spark)).orderBy("page_id", "rank").collect()]
    assert got == [(1, "careers.acme.co.uk", 1), (1, "eng-team.x.acme.co.uk", 2), (2, "status.a.github.io", 1)]
