"""Registrable domains by a table of public-suffix rules, and sibling hosts of the same organisation.

A rule is a suffix, a wildcard (*.ck: every name below ck is a suffix) or an exception (!www.ck: www.ck is none). Rules of the
private section (github.io) count too, so that tenants of one platform are strangers. Every distinct host is exploded to its
suffixes, a few rows each, and joined to the rules by equality; the longest rule holds, an exception before all, and without a
rule the last label is the suffix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.functions.expr import let

#: Labels of hosts that hold corporate pages, and of hosts that never do: fixed values.
PURPOSE_LABELS = (
    "about", "company", "corporate", "corp", "group", "investor", "investors", "ir", "press", "news", "media", "career", "careers", "job", "jobs", "work", "hiring", "security", "trust", "legal", "compliance", "privacy",
    "engineering", "eng", "tech", "technology", "developer", "developers", "status", "cloud", "vallalat", "vallalati", "ceg", "unternehmen", "firma", "empresa", "entreprise", "azienda", "bedrijf", "foretag", "yritys",
    "spolecnost", "karriere", "kariera", "karrier", "praca", "empleo", "lavoro", "emploi", "banen",
)
DENY_LABELS = (
    "cdn", "static", "assets", "img", "images", "files", "download", "downloads", "api", "mail", "smtp", "mx", "webmail", "ns", "ns1", "ns2", "vpn", "login", "auth", "sso", "account", "accounts", "id", "shop", "store",
    "checkout", "cart", "pay", "payment", "track", "tracking", "analytics", "ads", "www",
)
#: A few rules of the public list in its own notation, for tables that come without it: fixed values.
COMMON_RULES = (
    "com", "org", "net", "io", "dev", "app", "eu", "de", "fr", "at", "ch", "nl", "be", "it", "es", "pl", "cz", "hu", "co.hu", "ru", "ir", "uk", "co.uk", "org.uk", "ac.uk", "au", "com.au", "br", "com.br", "jp", "co.jp",
    "*.kawasaki.jp", "!city.kawasaki.jp", "*.kobe.jp", "!city.kobe.jp", "*.ck", "!www.ck",
)
COMMON_PRIVATE_RULES = ("github.io", "gitlab.io", "herokuapp.com", "vercel.app", "netlify.app", "azurewebsites.net", "blogspot.com", "s3.amazonaws.com", "*.compute.amazonaws.com")


def rules_of(lines: DataFrame, rule: str = "rule") -> DataFrame:
    """suffix, kind (normal, wildcard, exception) and section of rows rule, section; comments and empty lines go."""
    text = F.lower(F.trim(F.split(F.col(rule), r"\s")[0]))
    rows = lines.select(text.alias("t"), "section").where((F.col("t") != "") & ~F.col("t").startswith("//"))
    kind = F.when(F.col("t").startswith("!"), "exception").when(F.col("t").startswith("*."), "wildcard").otherwise("normal")
    return rows.select(F.regexp_replace("t", r"^(?:!|\*\.)", "").alias("suffix"), kind.alias("kind"), "section").distinct()


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """The rules of a file in the public list's format; its own marks tell where the private section begins."""
    whole = spark.read.text(path, wholetext=True).select(F.split("value", r"\r?\n").alias("lines"))
    private = F.array_position(F.transform("lines", lambda x: x.contains("===BEGIN PRIVATE DOMAINS===")), F.lit(True))
    rows = whole.select(private.alias("private"), F.posexplode("lines").alias("at", "rule"))
    return rules_of(rows.select("rule", F.when((F.col("private") > 0) & (F.col("at") >= F.col("private")), "private").otherwise("icann").alias("section")))


def common_rules(spark: SparkSession) -> DataFrame:
    rows = [(r, "icann") for r in COMMON_RULES] + [(r, "private") for r in COMMON_PRIVATE_RULES]
    return rules_of(spark.createDataFrame(rows, "rule string, section string"))


def plain_host(host: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(host)), r"^\.+|\.+$", "")


def registrable(hosts: DataFrame, rules: DataFrame, host: str = "host", private: bool = True) -> DataFrame:
    """Of each distinct host: host, public_suffix, registrable (null where the host is a suffix itself) and rule (its kind; default).

    Hosts that are addresses or have an empty label have neither.
    """
    names = hosts.select(F.col(host).alias("host")).where(F.col("host").isNotNull()).distinct()
    split = names.withColumn("labels", F.split(plain_host(F.col("host")), r"\."))
    split = split.where(~F.exists("labels", lambda x: x == "") & ~F.array_join("labels", ".").rlike(r"^[0-9.]+$|:"))
    n = F.size("labels")
    tails = F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(k.alias("k"), F.array_join(F.slice("labels", n - k + 1, k), ".").alias("suffix")))
    tried = split.select("host", n.alias("n"), F.explode(tails).alias("t")).select("host", "n", "t.k", "t.suffix")
    used = rules if private else rules.where("section <> 'private'")
    # labels of the suffix that a rule names: one more for a wildcard, which the host must have; one less for an exception
    length = F.when(F.col("kind") == "wildcard", F.col("k") + 1).when(F.col("kind") == "exception", F.col("k") - 1).otherwise(F.col("k"))
    met = tried.join(used.select("suffix", "kind").distinct(), "suffix").where(length <= F.col("n")).select("host", "kind", length.alias("length"))
    best = met.groupBy("host").agg(F.max(F.struct((F.col("kind") == "exception").alias("first"), "length", "kind")).alias("b"))
    found = split.join(best, "host", "left").withColumn("m", F.coalesce("b.length", F.lit(1)))
    tail = lambda k: F.array_join(F.slice("labels", n - k + 1, k), ".")
    return found.select("host", tail(F.col("m")).alias("public_suffix"), F.when(F.col("m") < n, tail(F.col("m") + 1)).alias("registrable"), F.coalesce("b.kind", F.lit("default")).alias("rule"))


def sibling_hosts(links: DataFrame, rules: DataFrame, limit: int = 2) -> DataFrame:
    """page_id, link_host, rank: other hosts of the page's registrable domain whose first label has a purpose and is not denied, the
    first that the page links. links: page_id, position, host, link_host."""
    known = registrable(links.select("host").union(links.select("link_host")), rules).where("registrable is not null").select("host", "registrable")
    ours, theirs = known.withColumnRenamed("registrable", "own"), known.select(F.col("host").alias("link_host"), F.col("registrable").alias("other"))
    label = F.substring_index(plain_host(F.col("link_host")), ".", 1)
    purpose = F.exists(F.split(label, "[-_]"), lambda x: x.isin(*PURPOSE_LABELS)) & ~label.isin(*DENY_LABELS)
    rows = links.where(plain_host(F.col("link_host")) != plain_host(F.col("host"))).where(purpose).join(ours, "host").join(theirs, "link_host").where("own = other")
    once = rows.groupBy("page_id", plain_host(F.col("link_host")).alias("link_host")).agg(F.min("position").alias("position"))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("position", "link_host"))
    return once.withColumn("rank", rank).where(F.col("rank") <= limit).select("page_id", "link_host", "rank")


def company_label(domain: Column) -> Column:
    """The first label of a registrable domain as a name."""
    return let(F.substring_index(domain, ".", 1), lambda x: F.initcap(F.regexp_replace(x, "-", " ")))
