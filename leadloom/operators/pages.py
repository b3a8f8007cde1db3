"""Page archives: visible text, chunks, flags, crawl frontier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions.expr import let

#: Path segments in order of priority; those that count on pages other than the landing page; and sections in which they never do: fixed values.
PATHS = (
    "about", "company", "team", "careers", "jobs", "engineering", "technology", "platform", "security", "infrastructure", "trust(?:-center)?", "sub-?processors?", "privacy", "dpa", "status", "architecture", "legal", "compliance",
    "blog/engineering",
)
DISCOVERED = ("security", "trust(?:-center)?", "sub-?processors?", "privacy", "legal", "dpa", "compliance", "infrastructure", "status")
NOT_OWN = ("blog", "questions", "careers", "jobs", "community", "forum", "tag", "tags", "news", "press")
#: Sections of hiring and engineering, and the words of cloud technology that make a page there strong evidence.
HIRING_SECTIONS = ("careers", "jobs", "engineering")
CLOUD_WORDS = ("aws", "amazon web services", "azure", "gcp", "google cloud", "kubernetes", "terraform", "docker", "cloud", "sre", "site reliability", "platform engineer")
SHELL_MARKERS = ('<div id="root"></div>', 'id="__next"', "ng-app")


def visible_text(html: Column) -> Column:
    """Text of the body: no script, style, title or comment; block tags end lines; entities of markup are decoded.

    What never closes reaches to the end of the page, so that the time is in proportion to the page.
    """
    unseen = r"(?is)<!--.*?(?:-->|\z)|" + "|".join(rf"<{e}\b[^>]*+(?:>.*?(?:</{e}\s*+>|\z)|\z)" for e in ("script", "style", "title"))
    seen = F.regexp_replace(html, unseen, "")
    # no tag ends behind the last bracket, and before it every tag does
    ended = lambda c, pattern, by: let(F.struct(c.alias("c"), F.length(F.substring_index(c, ">", -1)).alias("n")), lambda x: F.concat(F.regexp_replace(F.left(x["c"], F.length(x["c"]) - x["n"]), pattern, by), F.right(x["c"], x["n"])))
    text = ended(ended(seen, r"(?i)</?(?:p|div|br|li|ul|h[1-6]|article|nav|footer|table|tr)\b[^>]*>", "\n"), "<[^>]*>", "")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[ \t\r]+", " "), " ?\n[ \n]*", "\n"), F.lit(" \n"))


def elements(html: Column, name: str, attribute: str | None = None) -> Column:
    """What stands in each element of a name (whose start tag holds the attribute), up to the first end tag after it; one that never ends
    has nothing, and takes the rest of the page with it, so that the time is in proportion to the page."""
    tagged = F.left(html, F.length(html) - F.length(F.substring_index(html, ">", -1)))  # in it every tag ends
    whole = F.regexp_extract_all(tagged, F.lit(rf"(?is)(<{name}\b[^>]*+>.*?(?:</{name}\s*+>|\z))"), F.lit(1))
    ended = F.filter(whole, lambda x: F.rlike(F.right(x, F.lit(64)), F.lit(rf"(?is)</{name}\s*>\z")))
    if attribute:
        ended = F.filter(ended, lambda x: F.contains(F.lower(F.substring_index(x, ">", 1)), F.lit(attribute)))
    return F.transform(ended, _inside)


def _inside(x: Column) -> Column:
    """An element without its own start and end tag."""
    rest = F.substring(x, F.instr(x, ">") + 1, F.length(x))
    return F.left(rest, F.length(rest) - F.length(F.substring_index(rest, "</", -1)) - 2)


def faq_entities(blocks: Column) -> Column:
    """index, name and answer of each question of the FAQ pages in JSON-LD blocks: a document may be a list, hold its nodes in @graph, give
    @type as a list and mainEntity as one object. A block that is no JSON gives nothing."""
    get = F.try_variant_get
    many = lambda v, path: F.coalesce(get(v, path, "array<variant>"), F.filter(F.array(get(v, path, "variant")), lambda x: x.isNotNull()))
    documents = F.flatten(F.transform(blocks, lambda b: many(F.try_parse_json(b), "$")))
    nodes = F.flatten(F.transform(documents, lambda d: F.coalesce(get(d, "$['@graph']", "array<variant>"), F.array(d))))
    types = lambda n: F.coalesce(get(n, "$['@type']", "array<string>"), F.array(get(n, "$['@type']", "string")))
    pages = F.filter(nodes, lambda n: F.array_contains(types(n), "FAQPage"))
    text = lambda v, path: F.coalesce(F.trim(get(v, path, "string")), F.lit(""))
    return F.flatten(F.transform(pages, lambda n: F.transform(many(n, "$.mainEntity"), lambda q, i: F.struct(i.alias("i"), text(q, "$.name").alias("name"), text(q, "$.acceptedAnswer.text").alias("answer")))))


def chunks(pages: DataFrame) -> DataFrame:
    """page_id, locator, text: the main text, question answers in JSON-LD, details elements and each table row; empty ones are left out."""
    bare = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*+(?:>|\\z)", " "), r"\s+", " "))
    named = lambda parts, prefix: F.transform(parts, lambda t, i: F.struct(F.concat(F.lit(prefix), i.cast("string"), F.lit("]")).alias("locator"), t.alias("text")))
    found = pages.select(
        "page_id", "html", elements(F.col("html"), "script", "application/ld+json").alias("_blocks"), elements(F.col("html"), "details").alias("_details"), elements(F.col("html"), "tr").alias("_rows")
    ).withColumn("_faq", faq_entities(F.col("_blocks")))
    rows = F.concat(
        F.array(F.struct(F.lit("main_text").alias("locator"), visible_text(F.col("html")).alias("text"))),
        F.transform("_faq", lambda q: F.struct(F.concat(F.lit("jsonld:FAQPage.mainEntity["), q["i"].cast("string"), F.lit("]")).alias("locator"), bare(F.concat_ws(" ", q["name"], q["answer"])).alias("text"))),
        named(F.transform("_details", bare), "details["), named(F.transform("_rows", bare), "table["),
    )
    return found.select("page_id", F.explode(rows).alias("c")).select("page_id", "c.locator", "c.text").where(F.col("text") != "")


def page_flag(html: Column, text: Column) -> Column:
    """Why a page seems to be rendered by the client, or none."""
    marked = F.lit(False)
    for m in SHELL_MARKERS:
        marked = marked | html.contains(m)
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    short = F.size(F.filter(lines, lambda x: F.size(F.split(F.trim(x), " +")) <= 3))
    return F.when(marked & (F.length(text) < 300), "js_shell_marker").when(F.length(text) < 300, "short_text").when(F.length(text) < 0.02 * F.length(html), "low_text_html_ratio").when((F.size(lines) > 0) & (short >= 0.7 * F.size(lines)), "mostly_short_lines").otherwise("none")


def path_priority(path: Column, paths: tuple[str, ...] = PATHS) -> Column:
    out = None
    for i, p in enumerate(paths):
        test = F.lower(path).rlike(f"/{p}([^a-z]|$)")
        out = F.when(test, i) if out is None else out.when(test, i)
    return out


def discovered_priority(path: Column) -> Column:
    """Of a path found elsewhere than on the landing page: fewer segments count, and none under a section of other people's or passing texts."""
    section = F.lower(F.regexp_extract(path, "^/([^/?#]*)", 1))
    return F.when(~section.isin(*NOT_OWN), path_priority(path, DISCOVERED))


def page_strength(path: Column, text: Column) -> Column:
    """STRONG for a page of hiring or engineering that names cloud technology, else MEDIUM."""
    named = F.exists(F.array(*map(F.lit, CLOUD_WORDS)), lambda w: F.lower(text).contains(w))
    hiring = F.lower(path).rlike(f"/({'|'.join(HIRING_SECTIONS)})")
    return F.when(F.coalesce(hiring & named, F.lit(False)), "STRONG").otherwise("MEDIUM")


def crawl_frontier(links: DataFrame, limit: int = 5, landing: Column | None = None) -> DataFrame:
    """The best paths of each page: first by priority, then in the order of the links; each path once.

    landing: whether a link stands on the landing page itself; such links come before all that were discovered elsewhere, which have a
    narrower priority. None: all are.
    """
    own = F.lit(True) if landing is None else F.coalesce(landing, F.lit(False))
    scored = links.withColumns({"_late": F.when(own, 0).otherwise(1), "priority": F.when(own, path_priority(F.col("path"))).otherwise(discovered_priority(F.col("path")))})
    best = F.struct("_late", "priority", "position")
    once = scored.where(F.col("priority").isNotNull()).groupBy("page_id", "path").agg(F.min(best).alias("b")).select("page_id", "path", "b.*")
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("_late", "priority", "position", "path"))
    return once.withColumn("rank", rank).where(F.col("rank") <= limit).select("page_id", "path", "rank")


def robots_rules(files: DataFrame) -> DataFrame:
    """host, prefix: what the robots files (host, status, body) forbid to everybody. A file that was not read forbids nothing."""
    groups = F.split(F.concat(F.lit("\n"), F.regexp_replace("body", r"\r\n?", "\n")), r"(?i)\n[ \t]*user-agent[ \t]*:")
    general = F.filter(groups, lambda g, i: (i > 0) & (F.trim(F.substring_index(g, "\n", 1), F.lit(" \t")) == "*"))
    rules = F.flatten(F.transform(general, lambda g: F.regexp_extract_all(g, F.lit(r"(?im)^[ \t]*disallow[ \t]*:[ \t]*(\S[^\n]*?)[ \t]*$"), F.lit(1))))
    return files.where("status = 200 and body is not null").select("host", F.explode(rules).alias("prefix")).distinct()


def robots_allowed(links: DataFrame, rules: DataFrame) -> DataFrame:
    """Links that no Disallow prefix of the host's general group covers. rules: host, prefix."""
    return links.join(rules, (F.col("link_host") == F.col("host")) & (F.col("prefix") != "") & F.col("path").startswith(F.col("prefix")), "left_anti")


def url_union(*sources: DataFrame) -> DataFrame:
    """Each url once, at its first position over the sources in order."""
    rows = None
    for i, s in enumerate(sources):
        part = s.select("page_id", "path", F.lit(i).alias("source"), "position")
        rows = part if rows is None else rows.unionByName(part)
    first = F.row_number().over(Window.partitionBy("page_id", "path").orderBy("source", "position"))
    return rows.withColumn("_r", first).where("_r = 1").drop("_r")
