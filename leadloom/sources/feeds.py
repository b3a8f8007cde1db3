"""Readers of answer tables: lead batches, range feeds, registry, entity and watch-list answers, job boards, repositories, certificates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom import policy

LEAD = "name string, email string, company string, website string, job_title string, company_size_band string"


def read_leads(spark: SparkSession, path: str) -> DataFrame:
    """Lead batches as JSON arrays or lines; problem is null for a valid lead, so that a bad one drops no other."""
    rows = spark.read.schema(f"{LEAD}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", True).json(path)
    return validated_leads(rows)


def validated_leads(rows: DataFrame) -> DataFrame:
    corrupt = F.col("_corrupt").isNotNull() if "_corrupt" in rows.columns else F.lit(False)
    band = F.coalesce("company_size_band", F.lit(""))
    blank = F.coalesce(F.trim("company"), F.lit("")) == ""
    return rows.withColumn("problem", F.when(corrupt, "unreadable").when(blank, "no_company").when(~band.isin("", *policy.BANDS), "bad_band"))


#: Services of content delivery and name resolution: fixed values.
AWS_EDGE = ("CLOUDFRONT", "GLOBALACCELERATOR", "ROUTE53", "ROUTE53_HEALTHCHECKS")


def cidr(text: Column) -> tuple[Column, Column]:
    """Network as a number and bits of an IPv4 range; nulls where it is none."""
    from leadloom.operators.network import ipv4

    bits = F.regexp_extract(text, r"^[0-9.]+/([0-9]{1,2})$", 1).try_cast("int")
    return F.when(bits.between(0, 32), ipv4(F.substring_index(text, "/", 1))), bits


def range_feed(provider: str, feed: DataFrame) -> DataFrame:
    """One provider's feed (column body: its JSON) as cidr, network (IPv4 as a number), family, bits, hi, lo, provider, service, region,
    role, version.

    A body that cannot be read, or a range that is none, contributes nothing.
    """
    from leadloom.operators.network import range_key

    shapes = {
        "AWS": "createDate string, syncToken string, prefixes array<struct<ip_prefix:string,region:string,service:string>>, ipv6_prefixes array<struct<ipv6_prefix:string,region:string,service:string>>",
        "GCP": "syncToken string, prefixes array<struct<ipv4Prefix:string,ipv6Prefix:string,service:string,scope:string>>",
        "OCI": "last_updated_timestamp string, regions array<struct<region:string,cidrs:array<struct<cidr:string,tags:array<string>>>>>",
        "Azure": "changeNumber string, values array<struct<name:string,properties:struct<region:string,addressPrefixes:array<string>>>>",
    }
    j = feed.select(F.from_json("body", shapes[provider]).alias("j")).where("j is not null")
    if provider == "AWS":
        both = F.concat(F.coalesce("j.prefixes", F.array().cast("array<struct<ip_prefix:string,region:string,service:string>>")), F.coalesce(F.col("j.ipv6_prefixes").cast("array<struct<ip_prefix:string,region:string,service:string>>"), F.array().cast("array<struct<ip_prefix:string,region:string,service:string>>")))
        rows = j.select(F.coalesce("j.createDate", "j.syncToken").alias("version"), F.explode(both).alias("p")).select(F.col("p.ip_prefix").alias("cidr"), F.coalesce("p.service", F.lit("AMAZON")).alias("service"), "p.region", "version")
        role = F.when(F.col("service").isin(*AWS_EDGE), "EDGE").when(F.col("service").isin("AMAZON", "EC2"), "PUBLIC_CLOUD_COMPUTE").otherwise("PUBLIC_CLOUD_SERVICE")
    elif provider == "GCP":
        rows = j.select("j.syncToken", F.explode("j.prefixes").alias("p")).select(F.coalesce("p.ipv4Prefix", "p.ipv6Prefix").alias("cidr"), "p.service", F.col("p.scope").alias("region"), F.col("syncToken").alias("version"))
        role = F.lit("PUBLIC_CLOUD_COMPUTE")
    elif provider == "OCI":
        rows = j.select("j.last_updated_timestamp", F.explode("j.regions").alias("r")).select("last_updated_timestamp", "r.region", F.explode("r.cidrs").alias("c")).select("c.cidr", F.get("c.tags", F.lit(0)).alias("service"), "region", F.col("last_updated_timestamp").alias("version"))
        role = F.lit("PUBLIC_CLOUD_SERVICE")
    else:
        rows = j.select("j.changeNumber", F.explode("j.values").alias("v")).select(F.explode("v.properties.addressPrefixes").alias("cidr"), F.col("v.name").alias("service"), "v.properties.region", F.col("changeNumber").alias("version"))
        role = F.when(F.col("service").startswith("AzureFrontDoor."), "EDGE").otherwise("PUBLIC_CLOUD_SERVICE")
    network, _ = cidr(F.col("cidr"))
    keyed = rows.withColumn("_key", range_key(F.col("cidr"))).where("_key is not null")
    return keyed.select("cidr", network.alias("network"), "_key.*", F.lit(provider).alias("provider"), "service", "region", role.alias("role"), "version")


def registry_records(answers: DataFrame) -> DataFrame:
    """lead_id, position and the fields of each registry record, in the answer's order."""
    shape = "data array<struct<attributes:struct<lei:string,entity:struct<legalName:struct<name:string>,status:string,legalAddress:struct<country:string>,jurisdiction:string>>>>"
    rows = answers.select("lead_id", F.posexplode(F.from_json("body", shape)["data"]).alias("position", "r"))
    e = "r.attributes.entity"
    return rows.select("lead_id", "position", "r.attributes.lei", F.col(f"{e}.legalName.name").alias("legal_name"), f"{e}.status", F.col(f"{e}.legalAddress.country").alias("country"), f"{e}.jurisdiction")


def entity_claims(answers: DataFrame) -> DataFrame:
    """qid, property, position, value and the date qualifier of each claim."""
    shape = "map<string,array<struct<mainsnak:struct<datavalue:struct<value:string>>,qualifiers:map<string,array<struct<datavalue:struct<value:string>>>>>>>"
    rows = answers.select("qid", F.explode(F.from_json("claims", shape)).alias("property", "list")).select("qid", "property", F.posexplode("list").alias("position", "c"))
    dated = F.regexp_extract(F.get(F.col("c.qualifiers")["P585"], F.lit(0))["datavalue"]["value"], r"\+?([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    return rows.select("qid", "property", "position", F.col("c.mainsnak.datavalue.value").alias("value"), F.nullif(dated, F.lit("")).alias("as_of"))


def latest_quantity(claims: DataFrame) -> DataFrame:
    """By qid the employees claim of the latest date; undated ones count as earliest, the earlier position wins a tie."""
    amounts = claims.where("property = 'P1128'").withColumn("n", F.regexp_extract("value", r"([0-9]+)", 1).try_cast("long"))
    return amounts.where(F.col("n").isNotNull()).groupBy("qid").agg(F.max_by(F.struct("n", "as_of"), F.struct(F.coalesce("as_of", F.lit("")).alias("d"), (-F.col("position")).alias("p"))).alias("b")).select("qid", F.col("b.n").alias("employees"), F.col("b.as_of").alias("as_of"))


#: Properties of an entity that name other entities, and how many of each are kept: fixed values.
ENTITY_LINKS = {"country": ("P17", 1), "headquarters": ("P159", 1), "industries": ("P452", 5), "parent": ("P749", 1)}


def entity_facts(answers: DataFrame, labels: DataFrame) -> DataFrame:
    """qid, website, country, headquarters, industries (an array), parent, employees and as_of of each entity.

    answers: qid and claims (JSON: lists of claims by property, whose values are texts, items or quantities). labels: qid, label. An item
    without a label is named by its id; claims without a value are passed over; the quantity with the latest date holds, undated ones
    come before all dated ones, and the first of equals stays. Claims that are no JSON give nulls.
    """
    get = F.try_variant_get
    value = "$.mainsnak.datavalue.value"
    listed = lambda p: F.coalesce(get(F.col("_claims"), f"$.{p}", "array<variant>"), F.array().cast("array<variant>"))
    some = lambda c: F.filter(c, lambda x: x.isNotNull())
    texts = some(F.transform(listed("P856"), lambda c: get(c, value, "string")))
    day = lambda c: F.coalesce(get(F.get(get(c, "$.qualifiers.P585", "array<variant>"), F.size(get(c, "$.qualifiers.P585", "array<variant>")) - 1), "$.datavalue.value.time", "string"), F.lit(""))
    counts = F.filter(F.transform(listed("P1128"), lambda c, i: F.struct(day(c).alias("day"), (-i).alias("late"), F.ltrim(get(c, f"{value}.amount", "string"), F.lit("+")).alias("amount"))), lambda x: x["amount"].isNotNull())
    ids = {k: F.slice(some(F.transform(listed(p), lambda c: get(c, f"{value}.id", "string"))), 1, n) for k, (p, n) in ENTITY_LINKS.items()}
    facts = answers.select("qid", F.try_parse_json("claims").alias("_claims")).select(
        "qid", F.get(F.filter(texts, lambda x: ~x.startswith("{")), F.lit(0)).alias("website"), F.array_max(counts).alias("n"), *[v.alias(k) for k, v in ids.items()]
    )
    links = facts.select("qid", F.explode(F.map_from_arrays(F.array(*map(F.lit, ids)), F.array(*ids))).alias("kind", "items")).select("qid", "kind", F.posexplode("items").alias("at", "item"))
    named = links.join(labels.select(F.col("qid").alias("item"), "label"), "item", "left").groupBy("qid").agg(
        *[F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("at", F.coalesce("label", "item").alias("name"))))), lambda x: x["name"]).alias(f"_{k}") for k in ids]
    )
    one = lambda k: F.get(f"_{k}", F.lit(0)).alias(k)
    return facts.select("qid", "website", "n").join(named, "qid", "left").select(
        "qid", "website", one("country"), one("headquarters"), F.coalesce("_industries", F.array().cast("array<string>")).alias("industries"), one("parent"), F.col("n.amount").try_cast("long").alias("employees"), F.nullif(F.col("n.day"), F.lit("")).alias("as_of")
    )


def watchlist_hits(answers: DataFrame) -> DataFrame:
    """query_key and hits; an answer that cannot be read gives null hits, an empty one an empty list."""
    shape = "results array<struct<id:string,caption:string,score:double,match:boolean,schema:string,topics:array<string>>>"
    return answers.select("query_key", F.from_json("body", shape)["results"].alias("hits"))


def postings(answers: DataFrame) -> DataFrame:
    """board, slug, title, text of job postings in the three boards' shapes."""
    shapes = {"greenhouse": ("jobs array<struct<title:string,content:string>>", "jobs", "content"), "lever": ("items array<struct<text:string,descriptionPlain:string>>", "items", "descriptionPlain"), "ashby": ("jobs array<struct<title:string,descriptionPlain:string>>", "jobs", "descriptionPlain")}
    out = None
    for board, (shape, field, text) in shapes.items():
        body = F.concat(F.lit('{"items":'), F.col("body"), F.lit("}")) if board == "lever" else F.col("body")
        rows = answers.where(F.col("board") == board).select("board", "slug", F.explode(F.from_json(body, shape)[field]).alias("p")).select("board", "slug", F.col("p.text" if board == "lever" else "p.title").alias("title"), F.col(f"p.{text}").alias("text"))
        out = rows if out is None else out.unionByName(rows)
    return out


def repo_signals(entries: DataFrame, limit: int = 8) -> DataFrame:
    """Root signals by repository: strong with real infrastructure code outside of samples; the best repositories of each org."""
    from pyspark.sql import Window

    name, kind = F.lower("entry_name"), F.col("entry_type")
    signal = F.when(name == "dockerfile", "docker").when((kind == "dir") & name.isin("terraform", "helm", "k8s", "kubernetes"), name).when(name.endswith(".tf"), "terraform").when(name == ".github/workflows", "workflows")
    real = F.max((F.coalesce(F.col("tf_text"), F.lit("")).rlike(r'(?m)^\s*(provider|resource)\s+"') & ~F.lower("repo").rlike("example|sample|demo|tutorial|test")).cast("int")) == 1
    rows = entries.groupBy("org", "repo").agg(F.array_sort(F.collect_set(signal)).alias("signals"), F.when(real, "STRONG").otherwise("MEDIUM").alias("strength")).where(F.size("signals") > 0)
    rank = F.row_number().over(Window.partitionBy("org").orderBy((F.col("strength") != "STRONG").cast("int"), "repo"))
    return rows.withColumn("_r", rank).where(F.col("_r") <= limit).select("org", "repo", F.array_join("signals", ",").alias("signals"), "strength")


def certificate_names(rows: DataFrame) -> DataFrame:
    """domain and name, one row per line of name_value."""
    return rows.select("domain", F.explode(F.split("name_value", "\n")).alias("name")).where(F.trim("name") != "")
