"""Networks: longest-prefix joins, host classification, address safety, subdomains."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions.expr import let

#: Substring of a CNAME, provider, service, scope; the first rule that matches decides. Fixed values.
CNAME_RULES = (
    (".cloudfront.net", "AWS", "CloudFront", "edge"), (".s3.amazonaws.com", "AWS", "S3", "storage"), ("execute-api.", "AWS", "API Gateway", "workload"), (".elb.amazonaws.com", "AWS", "ELB", "workload"),
    (".elasticbeanstalk.com", "AWS", "Elastic Beanstalk", "workload"), (".amazonaws.com", "AWS", "AWS", "workload"), (".azurewebsites.net", "Azure", "App Service", "workload"), (".azure-api.net", "Azure", "API Management", "workload"),
    (".cloudapp.azure.com", "Azure", "Cloud Service", "workload"), (".azureedge.net", "Azure", "Front Door/CDN", "edge"), (".azurefd.net", "Azure", "Front Door", "edge"), (".blob.core.windows.net", "Azure", "Blob Storage", "storage"),
    (".run.app", "GCP", "Cloud Run", "workload"), (".appspot.com", "GCP", "App Engine", "workload"), (".storage.googleapis.com", "GCP", "Cloud Storage", "storage"), (".googleusercontent.com", "GCP", "Storage", "storage"),
    (".oraclecloud.com", "OCI", "OCI", "workload"), (".cloudflare.net", "Cloudflare", "CDN", "edge"), (".fastly.net", None, "Fastly", "edge"), (".akamaiedge.net", None, "Akamai", "edge"), (".vercel.app", None, "Vercel", "edge"), (".netlify.app", None, "Netlify", "edge"),
)
HOLDERS = (("AMAZON", "AWS"), ("MICROSOFT", "Azure"), ("GOOGLE", "GCP"), ("ORACLE", "OCI"))
EDGE_HOLDERS = ("CLOUDFLARE", "FASTLY", "AKAMAI")
PREFERRED = ("api", "app", "www", "files", "assets", "cdn", "status", "auth", "docs", "data", "static")
#: Ranges of addresses that are no public ones, and why: fixed values of the address registries.
NOT_PUBLIC = (
    ("0.0.0.0/8", "this_network"), ("10.0.0.0/8", "private"), ("100.64.0.0/10", "shared"), ("127.0.0.0/8", "loopback"), ("169.254.0.0/16", "link_local"), ("172.16.0.0/12", "private"), ("192.0.0.0/24", "protocol"),
    ("192.0.2.0/24", "documentation"), ("192.168.0.0/16", "private"), ("198.18.0.0/15", "benchmarking"), ("198.51.100.0/24", "documentation"), ("203.0.113.0/24", "documentation"), ("224.0.0.0/3", "multicast_or_reserved"),
)
#: Digits, letters and dots of wide scripts that resolvers read as plain ones.
WIDE, PLAIN = "０１２３４５６７８９ａｂｃｄｅｆｘ。．｡", "0123456789abcdefx..."


def ipv4(text: Column) -> Column:
    """Dotted decimal as a number; null where it is none."""
    number = lambda p: F.when(F.array_max(p) <= 255, p[0] * 16777216 + p[1] * 65536 + p[2] * 256 + p[3])
    return F.when(text.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), let(F.split(text, r"\.").cast("array<bigint>"), number))


def longest_prefix(ips: DataFrame, ranges: DataFrame) -> DataFrame:
    """Of each ip (a number) the range of the longest prefix; then specific before generic, provider, service."""
    return ips.join(matched_ranges(ips, ranges), "ip", "left").select("ip", "m.provider", "m.service", "m.bits")


def matched_ranges(ips: DataFrame, ranges: DataFrame) -> DataFrame:
    """ip and its range m, of the ips that have one.

    An ip is masked to each prefix length that occurs (33 at most), and joined by equality on length and network with the best of the
    ranges there, so that it meets one row per length however many ranges name the same network.
    """
    rank = F.struct((F.col("service") == "generic").alias("b"), F.col("provider").alias("c"), F.col("service").alias("d"))
    table = ranges.groupBy("bits", "network").agg(F.min_by(F.struct("provider", "service", "bits"), rank).alias("m"))
    lengths = sorted(r["bits"] for r in ranges.select("bits").distinct().collect())
    ip = F.col("ip").cast("long")
    network = lambda n: F.struct(F.lit(n).alias("bits"), (ip - ip % (1 << (32 - n))).alias("network"))
    masked = F.array(*map(network, lengths)) if lengths else F.array().cast("array<struct<bits:int,network:bigint>>")
    return ips.select("ip", F.inline(masked)).join(table, ["bits", "network"]).groupBy("ip").agg(F.max_by("m", "bits").alias("m"))


#: Services that name a whole provider and not a product, by provider: fixed values.
GENERIC_SERVICES = {"AWS": ("AMAZON", "EC2"), "GCP": ("Google Cloud", "GOOGLE")}


def ip_key(text: Column) -> Column:
    """An address as family (4 or 6), hi and lo: its 128 bits as two longs; null where it is none. An IPv4 address fills lo alone."""
    four = let(ipv4(F.trim(text)), lambda n: F.when(n.isNotNull(), F.struct(F.lit(4).alias("family"), F.lit(0).cast("long").alias("hi"), n.alias("lo"))))

    def six(g: Column) -> Column:
        long = lambda at: F.shiftleft(g[at], 48).bitwiseOR(F.shiftleft(g[at + 1], 32)).bitwiseOR(F.shiftleft(g[at + 2], 16)).bitwiseOR(g[at + 3])
        return F.when(g.isNotNull(), F.struct(F.lit(6).alias("family"), long(0).alias("hi"), long(4).alias("lo")))

    return F.when(text.contains(":"), let(ipv6_groups(F.trim(text)), six)).otherwise(four)


def masked(family: Column, hi: Column, lo: Column, bits: Column) -> tuple[Column, Column]:
    """hi and lo with all but the first bits of the address cleared."""
    left = lambda n: F.call_function("shiftleft", F.lit(-1).cast("long"), n.cast("int"))
    high = F.when(family == 4, hi).when(bits <= 0, F.lit(0).cast("long")).when(bits >= 64, hi).otherwise(hi.bitwiseAND(left(64 - bits)))
    low4 = F.when(bits <= 0, F.lit(0).cast("long")).otherwise(lo.bitwiseAND(left(32 - bits)))
    low6 = F.when(bits <= 64, F.lit(0).cast("long")).otherwise(lo.bitwiseAND(left(128 - bits)))
    return high, F.when(family == 4, low4).otherwise(low6)


def range_key(cidr: Column) -> Column:
    """A range as family, bits, hi and lo; null where it is none. Bits behind the prefix are cleared; without a length it is one address."""
    bits = F.when(cidr.contains("/"), F.when(F.substring_index(cidr, "/", -1).rlike("^[0-9]{1,3}$"), F.substring_index(cidr, "/", -1)).try_cast("int")).otherwise(-1)

    def key(a: Column) -> Column:
        full = F.when(a["family"] == 4, 32).otherwise(128)
        n = F.when(bits == -1, full).otherwise(bits)
        hi, lo = masked(a["family"], a["hi"], a["lo"], n)
        return F.when(a.isNotNull() & (n <= full), F.struct(a["family"].alias("family"), n.alias("bits"), hi.alias("hi"), lo.alias("lo")))

    return let(ip_key(F.substring_index(cidr, "/", 1)), key)


def is_generic(provider: Column, service: Column) -> Column:
    named = [(provider == p) & service.isin(*some) for p, some in GENERIC_SERVICES.items()]
    return F.coalesce(named[0] | named[1] | ((provider == "Azure") & ~service.contains(".")) | (service == "generic"), F.lit(False))


def match_addresses(addresses: DataFrame, ranges: DataFrame, ip: str = "ip") -> DataFrame:
    """Of each distinct address (text, either family) the range of the longest prefix: ip, provider, service, region, role, bits; then specific
    before generic services, provider, service. Texts that are no address and addresses without a range have nulls.

    ranges: cidr (or family, bits, hi and lo, as feeds give them), provider, service, region, role. An address is masked to each length that its family's ranges have (33 and 129 at most)
    and joined by equality on family, length and 128 bits.
    """
    keys = ["family", "bits", "hi", "lo"]
    keyed = ranges if set(keys) <= set(ranges.columns) else ranges.withColumn("r", range_key(F.col("cidr"))).where("r is not null").select("*", "r.*")
    rank = F.struct(is_generic(F.col("provider"), F.col("service")).alias("b"), F.col("provider").alias("c"), F.col("service").alias("d"))
    # the best of equal networks stands for them, so that an address meets one row per length
    table = keyed.groupBy(*keys).agg(F.min_by(F.struct("provider", "service", "region", "role"), rank).alias("m"))
    asked = addresses.select(F.col(ip).alias("ip")).distinct()
    lengths = [(r["family"], r["bits"]) for r in table.select("family", "bits").distinct().collect()]
    none = F.array().cast("array<int>")
    of = {f: F.array(*[F.lit(b) for b in sorted(b for g, b in lengths if g == f)]).cast("array<int>") if any(g == f for g, _ in lengths) else none for f in (4, 6)}
    each = asked.withColumn("a", ip_key(F.col("ip"))).where("a is not null").select("ip", "a.*", F.explode(F.when(F.col("a.family") == 4, of[4]).otherwise(of[6])).alias("bits"))
    hi, lo = masked(F.col("family"), F.col("hi"), F.col("lo"), F.col("bits"))
    best = each.select("ip", "family", "bits", hi.alias("hi"), lo.alias("lo")).join(table, keys).groupBy("ip").agg(F.max_by(F.struct("m.provider", "m.service", "m.region", "m.role", "bits"), "bits").alias("m"))
    return asked.join(best, "ip", "left").select("ip", "m.provider", "m.service", "m.region", "m.role", "m.bits")


def cname_rule(cname: Column) -> Column:
    """The first matching rule as a struct, or null."""
    rules = [F.when(F.lower(cname).contains(p), F.struct(F.lit(a).cast("string").alias("provider"), F.lit(s).alias("service"), F.lit(k).alias("scope"))) for p, a, s, k in CNAME_RULES]
    return F.coalesce(*rules)


def holder_rule(holder: Column) -> Column:
    upper = F.upper(holder)
    named = [F.when(upper.contains(t), F.struct(F.lit(p).alias("provider"), F.lit("network").alias("service"), F.lit("workload").alias("scope"))) for t, p in HOLDERS]
    edge = [F.when(upper.contains(t), F.struct(F.lit(None).cast("string").alias("provider"), F.lit(t).alias("service"), F.lit("edge").alias("scope"))) for t in EDGE_HOLDERS]
    return F.coalesce(*named, *edge)


def classify_hosts(hosts: DataFrame, ranges: DataFrame) -> DataFrame:
    """The rows of hosts (host, cname, ip, holder and any more) with provider, service and scope: the CNAME's rule, else the address's range, else its holder's rule, else nothing."""
    # one expression for all rules: this test is pushed down to the tables, where 22 of them would each work out the name again
    any_rule = "|".join(re.escape(p) for p, *_ in CNAME_RULES)
    asked = hosts.where(F.col("ip").isNotNull() & ~F.coalesce(F.lower("cname").rlike(any_rule), F.lit(False)))
    matched = matched_ranges(asked.select("ip").distinct(), ranges).withColumnRenamed("m", "_r")
    role = F.when(F.col("_r.service") == "CLOUDFRONT", "edge").when(F.col("_r.service") == "STORAGE", "storage").otherwise("workload")
    by_range = F.when(F.col("_r.provider").isNotNull(), F.struct("_r.provider", "_r.service", role.alias("scope")))
    found = hosts.join(matched, "ip", "left").withColumn("_m", F.coalesce(cname_rule(F.col("cname")), by_range, holder_rule(F.col("holder"))))
    return found.select(*hosts.columns, "_m.provider", "_m.service", "_m.scope")


def network_evidence(classified: DataFrame) -> DataFrame:
    """One row per group and provider (other: none): family, strength by distinct hosts, scope by precedence."""
    provider = F.when(F.col("provider").isin("AWS", "Azure", "GCP", "OCI", "Cloudflare"), F.col("provider")).otherwise("other")
    has = lambda s: F.max((F.col("scope") == s).cast("int")) == 1
    n = F.count_distinct("host")
    solid = F.max((F.col("scope") != "edge").cast("int")) == 1
    return classified.where(F.col("scope").isNotNull()).groupBy("lead_id", provider.alias("provider")).agg(
        F.when(solid, "network_footprint").otherwise("edge_delivery").alias("family"), F.when(solid & (n >= 3), "STRONG").when(solid, "MEDIUM").otherwise("WEAK").alias("strength"),
        F.when(has("workload"), "workload").when(has("storage"), "storage").otherwise("edge").alias("scope"), n.alias("hosts"),
    )


def address_class(ip: Column) -> Column:
    """Why an address is no public one, or public."""
    out = None
    for cidr, why in NOT_PUBLIC:
        net, bits = cidr.split("/")
        first = int.from_bytes(bytes(map(int, net.split("."))), "big")
        test = ip.between(first, first + (1 << (32 - int(bits))) - 1)
        out = F.when(test, why) if out is None else out.when(test, why)
    return out.otherwise("public")


def legacy_ipv4(text: Column) -> Column:
    """An address as resolvers read it: one to four parts, each decimal, octal or hexadecimal, the last one filling the bytes left; null where it is none."""
    digits = lambda p: F.regexp_replace(p, "^(?:0x0*|0+)(?=.)", "")
    base = lambda p: F.when(p.rlike("^0x[0-9a-f]+$"), 16).when(p.rlike("^0[0-7]*$"), 8).when(p.rlike("^[1-9][0-9]*$"), 10)
    # conv needs a literal base; twelve digits hold every address in any of the three
    read = lambda p: F.when(F.length(digits(p)) <= 12, F.when(base(p) == 16, F.conv(digits(p), 16, 10)).when(base(p) == 8, F.conv(digits(p), 8, 10)).when(base(p) == 10, p)).cast("bigint")
    shaped = text.rlike(r"^(?:0x[0-9a-f]+|[0-9]+)(?:\.(?:0x[0-9a-f]+|[0-9]+)){0,3}$")

    def number(p: Column) -> Column:
        out = None
        for n in range(1, 5):
            fits = F.forall(F.slice(p, 1, n - 1), lambda x: F.coalesce(x <= 255, F.lit(False))) & F.coalesce(p[n - 1] < 256 ** (5 - n), F.lit(False)) if n > 1 else F.coalesce(p[0] < 256**4, F.lit(False))
            value = F.when(fits, sum((p[i] * 256 ** (3 - i) for i in range(n - 1)), F.lit(0).cast("bigint")) + p[n - 1])
            out = F.when(F.size(p) == n, value) if out is None else out.when(F.size(p) == n, value)
        return out

    return F.when(shaped, let(F.transform(F.split(text, r"\."), read), number))


def ipv6_groups(text: Column) -> Column:
    """The eight groups of an address without brackets as numbers; null where it is none. A zone is left out; the last two groups may be dotted."""
    tail = F.regexp_extract(text, r":([0-9]{1,3}(?:\.[0-9]{1,3}){3})$", 1)
    dotted = let(ipv4(tail), lambda n: F.concat(F.regexp_replace(text, r"[0-9.]+$", ""), F.conv(F.shiftright(n, 16).cast("string"), 10, 16), F.lit(":"), F.conv((n % 65536).cast("string"), 10, 16)))
    bare = F.lower(F.when(tail == "", text).otherwise(dotted))
    list_of = lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, ":"))

    def filled(t: Column) -> Column:
        sides = F.split(t, "::", -1)
        left, right = list_of(sides[0]), list_of(F.coalesce(F.get(sides, F.lit(1)), F.lit("")))
        gap = F.lit(8) - F.size(left) - F.size(right)
        whole = F.when((F.size(sides) == 1) & (gap == 0), left).when((F.size(sides) == 2) & (gap > 0), F.concat(left, F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), right))
        return F.when(F.forall(whole, lambda g: g.rlike("^[0-9a-f]{1,4}$")), F.transform(whole, lambda g: F.conv(g, 16, 10).cast("bigint")))

    return let(F.regexp_replace(bare, "%.*$", ""), filled)


def ipv6_class(groups: Column) -> Column:
    """Why an address of eight groups is no public one, or public; a mapped one is judged by the address that it holds."""

    def judged(g: Column) -> Column:
        starts = lambda n: F.forall(F.slice(g, 1, n), lambda x: x == 0)
        protocol = (g[0] == 0x2001) & (g[1] < 0x200) & ~((g[1] == 3) | ((g[1] == 4) & (g[2] == 0x112)) | g[1].between(0x20, 0x3F))
        return (
            F.when(starts(5) & (g[5] == 0xFFFF), address_class(g[6] * 65536 + g[7])).when(starts(7) & (g[7] == 1), "loopback").when(starts(8), "this_network")
            .when(g[0].between(0xFC00, 0xFDFF), "private").when(g[0].between(0xFE80, 0xFEBF), "link_local").when(~g[0].between(0x2000, 0x3FFF), "multicast_or_reserved")
            .when(((g[0] == 0x2001) & (g[1] == 0xDB8)) | ((g[0] == 0x3FFF) & (g[1] < 0x1000)), "documentation").when(protocol | (g[0] == 0x2002), "protocol").otherwise("public")
        )

    return let(groups, judged)


def url_host(url: Column) -> Column:
    """The host of an address as the resolver sees it: lower case, plain digits and dots, no brackets, port or dots at its end."""
    authority = F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), "^[a-z][a-z0-9+.-]*://", ""), r"[/?#\\].*$", "")
    host = F.translate(F.regexp_replace(authority, "^.*@", ""), WIDE, PLAIN)
    named = F.regexp_replace(F.regexp_replace(host, ":[0-9]*$", ""), r"\.+$", "")
    return F.when(host.startswith("["), F.regexp_extract(host, r"^\[([^\]]*)\]", 1)).otherwise(named)


def literal_class(host: Column) -> Column:
    """The class of a host that is an address in any spelling; null for a name."""
    four = lambda h: let(legacy_ipv4(h), lambda n: F.when(n.isNotNull(), address_class(n)))
    six = lambda h: let(ipv6_groups(h), lambda g: F.when(g.isNotNull(), ipv6_class(g)))
    return let(host, lambda h: F.when(h.contains(":"), F.coalesce(six(h), F.lit("no_host"))).otherwise(four(h)))


def url_safety(url: Column) -> Column:
    """ok, or the first rule that a submitted address breaks. A null address has no scheme; a name passes, see resolved_safety."""
    given = F.coalesce(url, F.lit(""))
    authority = F.regexp_replace(F.regexp_replace(F.lower(F.trim(given)), "^https?://", ""), r"[/?#\\].*$", "")
    judged = lambda h: F.when(h == "", "no_host").otherwise(let(literal_class(h), lambda k: F.when(k != "public", k).otherwise("ok")))
    return F.when(~F.lower(F.trim(given)).rlike("^https?://"), "bad_scheme").when(authority.contains("@"), "credentials").otherwise(let(url_host(given), judged))


def resolved_safety(urls: DataFrame, answers: DataFrame) -> DataFrame:
    """url, verdict: url_safety, and for names resolves_private where any answer is no public address. answers: host, ip (as text)."""
    refused = answers.select(F.lower("host").alias("host"), F.coalesce(literal_class(F.lower("ip")) != "public", F.lit(False)).alias("bad")).groupBy("host").agg(F.bool_or("bad").alias("bad"))
    named = urls.select("url").withColumns({"host": url_host(F.col("url")), "verdict": url_safety(F.col("url"))})
    return named.join(refused, "host", "left").select("url", F.when((F.col("verdict") == "ok") & F.col("bad"), "resolves_private").otherwise(F.col("verdict")).alias("verdict"))


def top_subdomains(names: DataFrame, limit: int = 30) -> DataFrame:
    """host below domain, without the wildcard mark and the domain itself: preferred first labels, then by name."""
    host = F.regexp_replace(F.lower(F.trim("name")), r"^\*\.", "")
    own = names.select("domain", host.alias("host")).where(F.endswith("host", F.concat(F.lit("."), F.col("domain")))).distinct()
    first = F.substring_index("host", ".", 1).isin(*PREFERRED)
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("domain").orderBy((~first).cast("int"), "host"))).where(F.col("rank") <= limit)
