"""Further joins of leads with reference rows: domains, watch lists, entities, boards, repositories, articles, sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom import policy
from leadloom.functions import fuzzy, names
from leadloom.functions.expr import let

#: Topics that end a relationship; crime.* counts too. Fixed values.
HARD_TOPICS = ("sanction", "sanction.linked", "sanction.counter", "export.control", "export.risk", "debarment", "crime")
BOARD_PATTERNS = {"greenhouse": r"(?i)(?:boards|job-boards)\.greenhouse\.io/([a-z0-9_-]+)", "lever": r"(?i)jobs\.lever\.co/([a-z0-9_-]+)", "ashby": r"(?i)jobs\.ashbyhq\.com/([a-z0-9_-]+)"}
RESERVED = ("features", "pricing", "about", "login", "join", "topics", "collections", "sponsors", "settings", "orgs", "apps", "marketplace", "security", "enterprise", "readme", "site", "contact")
PROVIDER_WORDS = {"AWS": r"(?i)\b(?:aws|amazon web services|ec2|eks)\b", "Azure": r"(?i)\b(?:microsoft azure|azure|aks)\b", "GCP": r"(?i)\b(?:gcp|google cloud|gke)\b", "OCI": r"(?i)\b(?:oracle cloud|oci)\b"}
WORKLOAD_WORDS = r"(?i)\b(?:kubernetes|terraform|infrastructure|platform|sre|devops)\b"


def domain_readings(host: Column) -> Column:
    """The two readings of a host's name: hyphens removed, and hyphens as spaces."""
    label = F.regexp_replace(host, r"\.[^.]+$", "")
    return F.array_distinct(F.array(names.normalise_name(F.regexp_replace(label, "-", "")), names.normalise_name(F.regexp_replace(label, "[-.]", " "))))


def domain_hits(leads: DataFrame, competitors: DataFrame, generic: tuple[str, ...] = ("cloud", "group", "data", "software", "global")) -> DataFrame:
    """The best score of each lead's website or mail domain against each listed name, from CANDIDATE_FLOOR up.

    Distinct readings are blocked on 3-grams before they are scored; a weak reading stays below the identity floor.
    """
    hosts = F.array_distinct(F.array_compact(F.array(names.host_of(F.col("website")), F.substring_index("email", "@", -1))))
    ours = leads.select("lead_id", F.explode(hosts).alias("host")).select("lead_id", "host", F.explode(domain_readings(F.col("host"))).alias("reading")).where(F.col("reading") != "")
    theirs = competitors.select("term", names.normalise_name(F.col("term")).alias("listed"))
    grams = lambda c: let(F.regexp_replace(c, " ", ""), lambda b: F.when(F.length(b) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(b) - 2), lambda i: F.substring(b, i, F.lit(3))))).otherwise(F.array(b)))
    pairs = ours.select("reading").distinct().select("reading", F.explode(grams(F.col("reading"))).alias("g")).join(theirs.select("term", "listed", F.explode(grams(F.col("listed"))).alias("g")), "g").select("reading", "term", "listed").distinct()
    raw = F.greatest(fuzzy.fuzz_name("reading", "listed"), fuzzy.fuzz_ratio(F.regexp_replace("reading", " ", ""), F.regexp_replace("listed", " ", "")))
    capped = F.when(names.is_weak_name(F.col("reading"), generic), F.least(F.col("raw"), F.lit(float(policy.WEAK_CAP)))).otherwise(F.col("raw"))
    scored = pairs.withColumn("raw", raw).withColumn("score", capped).where(F.col("score") >= policy.CANDIDATE_FLOOR)
    return ours.join(scored, "reading").groupBy("lead_id", "term", "host").agg(F.max(F.col("score").cast("int")).alias("score"))


def screen(queries: DataFrame, hits: DataFrame, generic: tuple[str, ...] = ("cloud", "group", "data", "software", "global")) -> DataFrame:
    """Watch-list outcome by query_key: blocked_evidence, review_evidence, info or none; null hits: skipped.

    queries: query_key, query_name. hits: query_key and the list of the answer (null: the answer could not be read).
    """
    rows = queries.join(hits, "query_key", "left").select("query_key", "query_name", F.col("hits").isNull().alias("unread"), F.explode_outer("hits").alias("h"))
    hard = F.exists(F.coalesce("h.topics", F.array().cast("array<string>")), lambda t: t.isin(*HARD_TOPICS) | t.startswith("crime."))
    normal, caption = names.normalise_name(F.col("query_name")), names.normalise_name(F.coalesce("h.caption", F.lit("")))
    sim = F.greatest(fuzzy.fuzz_token_sort(normal, caption), fuzzy.fuzz_partial(normal, caption)).cast("int")
    judged = rows.withColumns({"hard": hard, "weak": names.is_weak_name(normal, generic), "similar": sim}).withColumn(
        "rank",
        F.when(F.col("h").isNull() | (F.col("h.schema") == "Person"), 0)
        .when(F.col("hard") & F.col("h.match") & (F.col("h.score") >= 0.85) & (F.col("similar") >= 80) & ~F.col("weak"), 3)
        .when(F.col("hard") & ((F.col("h.score") >= 0.5) | F.col("h.match")), 2).otherwise(1),
    )
    return judged.groupBy("query_key").agg(F.max("rank").alias("rank"), F.max("unread").alias("unread")).select("query_key", F.when(F.col("unread"), "skipped").otherwise(F.get(F.array(*map(F.lit, ("none", "info", "review_evidence", "blocked_evidence"))), F.col("rank"))).alias("status"))


def entity_by_host(leads: DataFrame, entities: DataFrame) -> DataFrame:
    """The first entity in search order whose official website has the lead's host. entities: qid, position, website."""
    own = leads.select("lead_id", names.host_of(F.col("website")).alias("host"))
    # the first entity of a host stands for the others, so that a host of many leads and entities makes no pairs of them
    first = entities.groupBy(names.host_of(F.col("website")).alias("host")).agg(F.min(F.struct("position", "qid")).alias("e"))
    return own.join(first, "host").groupBy("lead_id").agg(F.min("e")["qid"].alias("qid"))


def relevant_titles(pairs: DataFrame) -> DataFrame:
    """Article titles (columns company, title) near enough to the company's name as written."""
    return pairs.withColumn("score", fuzzy.fuzz_token_sort(F.lower("company"), F.lower("title"))).where(F.col("score") >= 75)


def second_identities(leads: DataFrame) -> DataFrame:
    """Leads whose domain's organisation (column organisation) has another name than the typed one: rows to screen again."""
    typed, other = names.normalise_name(F.col("company")), names.normalise_name(F.col("organisation"))
    return leads.where((typed != "") & (other != "") & (typed != other)).select("lead_id", F.col("organisation").alias("company"), F.lit("second").alias("identity_kind"))


def worst_screen(rows: DataFrame) -> DataFrame:
    """The worst status over all identities of a lead."""
    order = F.array_position(F.array(*map(F.lit, ("none", "info", "skipped", "review_evidence", "blocked_evidence"))), F.col("status"))
    return rows.groupBy("lead_id").agg(F.max_by("status", order).alias("status"))


def board_links(pages: DataFrame) -> DataFrame:
    """page_id, board, slug: the first slug of each board, links before text."""
    hrefs = F.array_join(F.regexp_extract_all("html", F.lit(r'(?i)href\s*=\s*["\']([^"\']+)'), F.lit(1)), " ")
    slug = lambda p: F.lower(F.coalesce(F.nullif(F.regexp_extract(hrefs, p, 1), F.lit("")), F.nullif(F.regexp_extract("html", p, 1), F.lit(""))))
    found = F.array(*[F.struct(F.lit(b).alias("board"), slug(p).alias("slug")) for b, p in BOARD_PATTERNS.items()])
    return pages.select("page_id", F.explode(found).alias("f")).select("page_id", "f.board", "f.slug").where("slug is not null")


def posting_evidence(links: DataFrame, postings: DataFrame) -> DataFrame:
    """Postings of linked boards that name a provider; strong with a word of infrastructure work."""
    text = F.concat_ws(" ", "title", "text")
    named = F.array_compact(F.array(*[F.when(F.rlike(text, F.lit(p)), F.lit(name)) for name, p in PROVIDER_WORDS.items()]))
    rows = links.join(postings, ["board", "slug"]).withColumns({"providers": named, "strength": F.when(F.rlike(text, F.lit(WORKLOAD_WORDS)), "STRONG").otherwise("MEDIUM")})
    return rows.where(F.size("providers") > 0).select("page_id", "board", "slug", "title", F.array_join("providers", ",").alias("providers"), "strength")


def org_links(pages: DataFrame) -> DataFrame:
    """The first linked organisation of each page; a later spelling of the same name in mixed case replaces one in lower case."""
    linked = F.regexp_extract_all("html", F.lit(r"(?i)github\.com/([a-z0-9](?:[a-z0-9-]{0,38}))"), F.lit(1))
    rows = pages.select("page_id", F.posexplode(linked).alias("position", "org")).where(~F.lower("org").isin(*RESERVED))
    first = rows.groupBy("page_id").agg(F.lower(F.min_by("org", "position")).alias("key"))
    same = rows.join(first, "page_id").where(F.lower("org") == F.col("key"))
    return same.groupBy("page_id").agg(F.min_by("org", F.struct((F.col("org") == F.lower("org")).alias("lower"), "position")).alias("org"))


def verified_orgs(orgs: DataFrame) -> DataFrame:
    """orgs: org, org_name, blog, company, host. verified: a similar name, or the blog's host holds a word of the company's name."""
    words = F.filter(F.split(names.normalise_name(F.col("company")), " "), lambda w: F.length(w) >= 3)
    blog = names.host_of(F.coalesce("blog", F.lit("")))
    similar = fuzzy.fuzz_ratio(F.lower(F.coalesce("org_name", "org")), F.lower("company")) >= 60
    return orgs.withColumn("verified", similar | F.exists(words, lambda w: blog.contains(w)))


def case_studies(hits: DataFrame, fetched: DataFrame, allowed: tuple[str, ...], as_of: Column) -> DataFrame:
    """The first accepted search hit of each query: allowed host before and after redirects, a full page, the name as whole words in text and title.

    hits: lead_id, company, domain, query_no, position, url. fetched: url, final_url, status, text, title, published.
    """
    ok = lambda c: F.exists(F.array(*map(F.lit, allowed)), lambda h: (names.host_of(c) == h) | F.endswith(names.host_of(c), F.concat(F.lit("."), h)))
    padded = lambda c: F.concat(F.lit(" "), names.normalise_name(c), F.lit(" "))
    name = padded(F.col("company"))
    single = F.size(F.split(F.trim(name), " ")) == 1
    day = F.coalesce(*[F.to_date(F.try_to_timestamp("published", F.lit(f))) for f in ("yyyy-MM-dd", "MMMM d, yyyy", "d MMMM yyyy", "MMM d, yyyy", "yyyy/MM/dd")])
    accepted = hits.join(fetched, "url").where(
        ok(F.col("url")) & ok(F.col("final_url")) & (F.col("status") == 200) & (F.length("text") > 500) & padded(F.col("text")).contains(name) & padded(F.col("title")).contains(name) & (~single | F.lower("text").contains(F.lower("domain")))
    )
    age = F.when(day.isNull(), "unknown").when(F.date_diff(as_of, day) > 3 * 365.25, "historical").otherwise("current")
    rank = F.row_number().over(Window.partitionBy("lead_id", "query_no").orderBy("position"))
    return accepted.withColumns({"freshness": age, "_r": rank}).where("_r = 1").select("lead_id", "query_no", "url", "freshness")


def headcount_choice(candidates: DataFrame) -> DataFrame:
    """The figure of a lead by identity: homepage of the lead's host, a certain score and a positive count; else a verbatim hint.

    candidates: lead_id, website, source, employees, homepage, score, quote, snippet_text, position.
    """
    same = names.host_of(F.col("homepage")) == names.host_of(F.col("website"))
    figure = F.coalesce((F.col("source") == "graph") & same & ~F.isnan("score") & (F.col("score") >= 0.75) & (F.col("employees") > 0), F.lit(False))
    hint = F.coalesce((F.col("source") == "web") & F.col("quote").rlike("[0-9]") & F.col("snippet_text").contains(F.col("quote")), F.lit(False))
    rows = candidates.withColumn("use", F.when(figure, "scored").when(hint, "hint")).where(F.col("use").isNotNull())
    best = F.struct((F.col("use") == "hint").alias("late"), "position")
    return rows.groupBy("lead_id").agg(F.min_by(F.struct("use", "employees"), best).alias("b")).select("lead_id", "b.use", "b.employees")


def status_components(texts: DataFrame) -> DataFrame:
    """page_id, provider of status pages that name a provider as a component of their own, not only as a dependency."""
    rows = []
    for name, pattern in PROVIDER_WORDS.items():
        around = F.regexp_extract_all("text", F.lit(rf"(?is)(.{{0,60}}{pattern[4:]}.{{0,60}})"), F.lit(1))
        own = F.exists(around, lambda x: ~F.lower(x).rlike("depend|upstream|third[- ]party|integration"))
        rows.append(F.when(F.rlike("text", F.lit(pattern)) & own, F.lit(name)))
    found = F.array_compact(F.array(*rows))
    return texts.where(F.lower("text").rlike(r"\b(?:status|uptime|operational|incident)\b")).select("page_id", F.explode(found).alias("provider"))


def statements(texts: DataFrame) -> DataFrame:
    """First-party statements: sentences that name a provider, with how (integration, sub-processor, own hosting) and scope."""
    sentences = F.split("text", r"(?<=[.!?])\s+|\n")
    rows = texts.select("doc_id", F.posexplode(sentences).alias("n", "s"))
    kind = F.when(F.col("s").rlike(r"(?i)\b(?:integrat|connect|plugin|import from)"), "INTEGRATES_WITH").when(F.col("s").rlike(r"(?i)sub-?processor"), "CLOUD_SUBPROCESSOR").when(F.col("s").rlike(r"(?i)\b(?:we|our)\b.*\b(?:host|run|deploy|built)|\b(?:hosted|runs|deployed) (?:on|in)\b") & ~F.col("s").rlike(r"(?i)\b(?:customers?|you) (?:can|host|run)\b|\?\s*$"), "HOSTED_ON")
    scope = F.when(F.col("s").rlike(r"(?i)\b(?:s3|storage|backup)"), "storage").when(F.col("s").rlike(r"(?i)\b(?:cdn|edge|cloudfront)\b"), "edge").otherwise("workload")
    found = F.array_compact(F.array(*[F.when(F.rlike("s", F.lit(p)), F.lit(name)) for name, p in PROVIDER_WORDS.items()]))
    return rows.withColumns({"kind": kind, "scope": scope, "provider": F.explode_outer(found)}).where("kind is not null and provider is not null").select("doc_id", "n", "provider", "kind", "scope")


def footprints(observations: DataFrame) -> DataFrame:
    """lead_id, category, provider, holder of observations in order: named clouds first per provider; a control panel with its
    first holder is managed hosting; other holders stay unknown and never become a provider."""
    cloud = F.when(F.col("provider").isNotNull(), F.when(F.col("scope") == "edge", "EDGE").otherwise("PUBLIC_CLOUD")).alias("cloud")
    holder = F.when(F.col("provider").isNull(), F.col("holder")).alias("holder")
    # summed up once; what follows sees one row per lead and provider or holder
    rows = observations.select("lead_id", cloud, "provider", holder, "ordinal", F.coalesce("panel", F.lit(False)).alias("panel"))
    seen = rows.groupBy("lead_id", "cloud", "provider", "holder").agg(F.min("ordinal").alias("ordinal"), F.max("panel").alias("panel"))
    bare = (F.col("cloud").isNull() & F.col("holder").isNotNull()).alias("bare")
    first = F.row_number().over(Window.partitionBy("lead_id", "bare").orderBy("ordinal"))
    marked = seen.select("*", bare).withColumns({"_r": first, "panel": F.max("panel").over(Window.partitionBy("lead_id"))})
    category = F.coalesce("cloud", F.when(F.col("panel") & (F.col("_r") == 1), "MANAGED_HOSTING").otherwise("UNKNOWN"))
    return marked.where("cloud is not null or bare").select("lead_id", category.alias("category"), "provider", "holder", "ordinal")


def answer_inventory(answers: DataFrame) -> DataFrame:
    """name, country, fetched_at, source and the number of results of cached answers."""
    return answers.select("name", "country", "fetched_at", "source", F.coalesce(F.size("results"), F.lit(0)).alias("n_results"))


def adversarial_summary(rows: DataFrame) -> DataFrame:
    """By category: cases, passed, leaked and the ids that failed. rows: case_id, category, expected_status, status, must_not_contain, summary, truth, hq."""
    plain = lambda c: F.when(F.lower(F.trim(F.coalesce(c, F.lit("")))).isin("", "unknown", "unresolved", "none", "null"), "unknown").otherwise(F.lower(F.trim(c)))
    leaked = F.exists("must_not_contain", lambda x: F.lower("summary").contains(F.lower(x)))
    passed = (F.col("expected_status") == F.col("status")) & ~leaked & (plain(F.col("truth")) == plain(F.col("hq")))
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("cases"), F.sum(passed.cast("long")).alias("passed"), F.sum(leaked.cast("long")).alias("leaked"), F.array_join(F.array_sort(F.collect_list(F.when(~passed, F.col("case_id").cast("string")))), ",").alias("failing"))


def reply_allowed(messages: DataFrame) -> Column:
    """The topmost authentication header passes DMARC, or DKIM aligned with the sender (equal, parent or child domain)."""
    top = F.lower(F.get("auth_headers", F.lit(0)))
    sender = F.substring_index(F.lower("from_addr"), "@", -1)
    signed = F.regexp_extract_all(top, F.lit(r"dkim=pass[^;]*header\.[di]=@?([a-z0-9.-]+)"), F.lit(1))
    aligned = F.exists(signed, lambda d: (d == sender) | F.endswith(sender, F.concat(F.lit("."), d)) | F.endswith(d, F.concat(F.lit("."), sender)))
    return F.coalesce(F.rlike(top, F.lit(r"\bdmarc=pass\b")) | aligned, F.lit(False))
