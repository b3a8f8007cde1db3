"""Who a lead is: headquarters, jurisdiction, list and registry matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom import policy
from leadloom.functions import fuzzy, names
from leadloom.functions.expr import lookup

#: ISO codes of countries by name, and countries of code domains: fixed values.
TLD_COUNTRIES = {"hu": "HUNGARY", "de": "GERMANY", "fr": "FRANCE", "ru": "RUSSIA", "ir": "IRAN"}


def resolve_headquarters(candidates: DataFrame, website: Column) -> DataFrame:
    """hq, hq_source and hq_confidence: registry, then enrichment, then model, then code domain; the first two must agree.

    candidates: gleif, wikidata and llm countries, null where there is none; an llm country of 'unknown' is none.
    """
    llm = F.when(F.lower(F.trim("llm")) != "unknown", F.col("llm"))
    tld = F.create_map(*[F.lit(x) for kv in TLD_COUNTRIES.items() for x in kv])[names.last_label(names.host_of(website))]
    conflict = F.col("gleif").isNotNull() & F.col("wikidata").isNotNull() & (F.col("gleif") != F.col("wikidata"))
    source = F.when(conflict, "").when(F.col("gleif").isNotNull(), "gleif").when(F.col("wikidata").isNotNull(), "wikidata").when(llm.isNotNull(), "llm").when(tld.isNotNull(), "website_tld").otherwise("")
    country = F.when(source == "", "").when(source == "gleif", F.col("gleif")).when(source == "wikidata", F.col("wikidata")).when(source == "llm", llm).otherwise(tld)
    overrides = F.array_join(F.array_compact(F.array(*[F.when(llm.isNotNull() & F.col(c).isNotNull() & (F.col(c) != llm), F.lit(c)) for c in ("gleif", "wikidata")])), ",")
    return candidates.select("*", country.alias("hq"), source.alias("hq_source"), F.when(source == "website_tld", "low").otherwise("").alias("hq_confidence"), overrides.alias("overridden_by"), conflict.alias("conflict"))


def jurisdiction(resolved: DataFrame, text: Column) -> DataFrame:
    """authority and screenable: a model's country counts only where the raw text names it as a word."""
    value = F.lower(F.trim("hq"))
    known = ~value.isin("", "unknown")
    authority = F.when(~known, "none").otherwise(F.coalesce(F.create_map(*[F.lit(x) for kv in policy.AUTHORITY.items() for x in kv])[F.col("hq_source")], F.when(F.col("hq_source") != "", "hint").otherwise("none")))
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), F.lit(" "))
    named = padded.contains(F.concat(F.lit(" "), F.regexp_replace(value, "[^a-z0-9]+", " "), F.lit(" ")))
    screenable = known & (F.col("hq_confidence") != "low") & (authority.isin("registry", "enrichment") | ((authority == "inference") & named))
    return resolved.withColumns({"authority": authority, "screenable": screenable})


def restricted_hits(judged: DataFrame, website: Column) -> DataFrame:
    """hq_hit (100 points) and tld_hit (80 points): the restricted country or null."""
    countries = F.create_map(*[F.lit(x) for c in policy.JURISDICTIONS for x in (c.lower(), c)])
    tlds = F.create_map(*[F.lit(x) for kv in policy.RESTRICTED_TLDS.items() for x in kv])
    return judged.withColumns(
        {
            "hq_hit": F.when(F.col("hq_confidence") != "low", countries[F.lower(F.trim("hq"))]),
            "hq_origin": F.when((F.col("hq_confidence") != "low") & countries[F.lower(F.trim("hq"))].isNotNull(), F.when(F.col("screenable"), "prescreen:hq").otherwise("prescreen:hq_unsupported")),
            "tld_hit": tlds[names.last_label(names.host_of(website))],
        }
    )


def first_marker(text: Column) -> Column:
    """The first listed country or city that the text mentions anywhere, or null."""
    lowered = F.lower(text)
    return F.coalesce(*[F.when(lowered.contains(m.lower()), F.lit(m)) for m in (*policy.JURISDICTIONS, *policy.MARKERS)])


def competitor_hits(leads: DataFrame, competitors: DataFrame, generic: tuple[str, ...] = ("cloud", "group", "data", "software", "global")) -> DataFrame:
    """Lead names against a list (column term): score, kept from KEEP_FLOOR; a weak name stays below the identity floor.

    Names are deduplicated before they are scored. The list is a policy table, so its pairs with the distinct names are
    formed through an equi-join on shared words and 3-grams of both sides, never by all pairs.
    """
    ours = leads.select(names.normalise_name(F.col("company")).alias("normal")).distinct()
    theirs = competitors.select("term", names.normalise_name(F.col("term")).alias("listed"))

    def grams(c: str) -> Column:
        bare = F.regexp_replace(c, " ", "")
        return F.array_distinct(F.concat(F.array_remove(F.split(c, " "), ""), F.when(F.length(bare) >= 3, F.transform(F.sequence(F.lit(1), F.length(bare) - 2), lambda i: F.substring(bare, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))))

    pairs = (
        ours.select("normal", F.explode(grams("normal")).alias("gram")).join(theirs.select("term", "listed", F.explode(grams("listed")).alias("gram")), "gram").select("normal", "term", "listed").distinct()
    )
    raw = fuzzy.fuzz_name("normal", "listed")
    scored = pairs.withColumn("raw", raw).withColumn("score", F.when(names.is_weak_name(F.col("normal"), generic), F.least(F.col("raw"), F.lit(float(policy.WEAK_CAP)))).otherwise(F.col("raw"))).where(F.col("score") >= policy.KEEP_FLOOR)
    return leads.select("lead_id", names.normalise_name(F.col("company")).alias("normal")).join(scored, "normal").select("lead_id", "term", F.col("score").cast("int").alias("score"))


def acronym_hits(leads: DataFrame, competitors: DataFrame, scored: DataFrame | None = None) -> DataFrame:
    """Leads whose whole name is a listed name's acronym. scored: their competitor_hits; a listed name that is one of them already counts there."""
    short = competitors.select("term", F.lower(names.acronym(F.col("term"))).alias("short"))
    hits = leads.select("lead_id", names.normalise_name(F.col("company")).alias("normal")).join(short, F.col("normal") == F.col("short")).select("lead_id", "term", F.lit(80).alias("score"))
    return hits if scored is None else hits.join(scored.select("lead_id", "term"), ["lead_id", "term"], "left_anti")


#: Codes of country names, and of the domains that stand for one country: fixed values.
COUNTRY_CODES = {
    "united states of america": "US", "united states": "US", "usa": "US", "iran": "IR", "islamic republic of iran": "IR", "hungary": "HU", "italy": "IT", "india": "IN", "norway": "NO", "united kingdom": "GB", "germany": "DE", "france": "FR",
    "netherlands": "NL", "canada": "CA", "australia": "AU", "spain": "ES", "sweden": "SE",
}
DOMAIN_CODES = {"us": "US", "ir": "IR", "hu": "HU", "it": "IT", "in": "IN", "no": "NO", "uk": "GB", "de": "DE", "fr": "FR", "nl": "NL", "ca": "CA", "au": "AU"}


def country_code(name: Column) -> Column:
    """The code of a country's name, or of a code itself; null for others, which cannot be compared."""
    return F.coalesce(lookup(COUNTRY_CODES, F.lower(F.trim(name))), F.when(name.rlike("^[A-Z]{2}$"), name))


def registry_match(leads: DataFrame, records: DataFrame) -> DataFrame:
    """The first accepted registry record of each lead: position, legal_name, strength, score; records: position, legal_name, status,
    country (a code); leads carry hq (may be null) and, if at all, website.

    Scored by sorted words, active only. A known headquarters must agree with the record's country (STRONG); without it the country of
    the website's own domain must (MEDIUM); a record against which nothing speaks for or against is a name alone (WEAK). Distinct names are blocked on grams of their sorted words:
    at this bound two names of more than 16 letters together share a 3-gram, others a 2-gram (then neither has more than 9) or all.
    """
    key = lambda c: F.array_join(F.array_sort(F.array_remove(F.split(names.normalise_name(F.col(c)), " "), "")), " ")

    def grams(c: str) -> Column:
        runs = lambda q: F.when(F.length(c) >= q, F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (q - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(q)))).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.concat(F.array(F.col(c)), runs(3), F.when(F.length(c) <= 9, runs(2)).otherwise(F.array().cast("array<string>"))))

    seat = country_code(F.col("hq"))
    site = lookup(DOMAIN_CODES, names.last_label(names.host_of(F.col("website")))) if "website" in leads.columns else F.lit(None).cast("string")
    leads = leads.withColumns({"_ours": key("company"), "_seat": seat, "_site": site}).select("lead_id", "_ours", "_seat", "_site")
    # the first record of a name and country stands for the others, so that leads meet few rows however many share a name
    records = records.where(F.col("status") == "ACTIVE").withColumn("_theirs", key("legal_name")).groupBy("_theirs", "country").agg(F.min("position").alias("position"), F.min_by("legal_name", "position").alias("legal_name"))
    blocks = lambda rows, c: rows.select(c).where(F.col(c).isNotNull()).distinct().select(c, F.explode(grams(c)).alias("gram"))
    near = F.least(F.length("_ours"), F.length("_theirs")) * 200 >= (F.length("_ours") + F.length("_theirs")) * 85
    pairs = blocks(leads, "_ours").join(blocks(records, "_theirs"), "gram").where(near).select("_ours", "_theirs").distinct()
    close = pairs.withColumn("score", fuzzy.fuzz_token_sort("_ours", "_theirs")).where(F.col("score") >= 85)
    scored = leads.join(close, "_ours").join(records, "_theirs")
    agrees = lambda c, grade: F.when(F.col(c) == F.col("country"), grade)
    strength = F.when(F.col("_seat").isNotNull(), agrees("_seat", "STRONG")).when(F.col("_site").isNotNull(), agrees("_site", "MEDIUM")).otherwise("WEAK")
    accepted = scored.withColumn("strength", strength).where(F.col("strength").isNotNull())
    first = F.row_number().over(Window.partitionBy("lead_id").orderBy("position"))
    return accepted.withColumn("_r", first).where("_r = 1").select("lead_id", "position", "legal_name", "strength", F.col("score").cast("int").alias("score"))
