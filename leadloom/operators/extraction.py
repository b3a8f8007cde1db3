"""Leads from mail threads: each field with the way it was found, what is missing, and whether the lead can be used.

Everything is an expression over one thread (see threads.threads): sender, new text and signature; quoted history takes no part.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import policy
from leadloom.operators.mail import FREE_MAIL, NOISE_HOSTS, sender_class, site_root

#: Words of job titles, units of headcounts, labels and legal forms (without dots) in several languages: fixed values.
TITLE_WORDS = (
    "ceo", "cto", "cio", "coo", "cfo", "ciso", "cpo", "founder", "co-founder", "cofounder", "owner", "president", "vp", "vice president", "head of", "director", "manager", "lead", "engineer", "architect", "developer", "consultant",
    "devops", "sre", "ügyvezető", "vezérigazgató", "igazgató", "tulajdonos", "alapító", "vezető", "menedzser", "mérnök", "fejlesztő", "geschäftsführer", "leiter", "leiterin",
)
HEADS = ("employees", "people", "staff", "engineers", "developers", "team members", "fte", "emberes", "munkatárs", "munkatársunk", "munkatársak", "dolgozó", "dolgozónk", "fős", "fő", "alkalmazott", "alkalmazottunk", "mitarbeiter", "mitarbeiterinnen")
TEAMS = ("team", "company", "cég", "csapat")
COMPANY_LABELS = ("company", "organisation", "organization", "cég", "cégnév", "unternehmen", "firma")
TITLE_LABELS = ("job title", "title", "position", "role", "beosztás", "pozíció", "munkakör")
LEGAL_ENDS = ("kft", "zrt", "nyrt", "bt", "kkt", "rt", "gmbh", "ag", "kg", "ug", "ltd", "limited", "llc", "inc", "corp", "corporation", "co", "plc", "sa", "sas", "sarl", "srl", "spa", "bv", "nv", "oy", "ab", "as", "a/s", "aps", "sro", "oo", "spol")
FIELDS = ("website", "company", "job_title", "company_size_band")
LONGEST_FIELD = 120
URL = r"(?i)(?:https?://|\bwww\.)([a-z0-9][a-z0-9._-]*\.[a-z0-9-]+)"
MAIL = r"(?i)[a-z0-9._%+-]+@([a-z0-9-]+(?:\.[a-z0-9-]+)+)"
BARE = r"(?i)^[^a-z0-9]*((?:[a-z0-9][a-z0-9-]*\.)+[a-z]{2,})[^a-z0-9]*$"
NUMBER = "[0-9][0-9.,]{0,11}"
HEADCOUNT = rf"(?i)({NUMBER})(?: *[-–] *({NUMBER}))? *\+? *(?:{'|'.join(sorted(HEADS, key=len, reverse=True))})(?:[^\p{{L}}]|$)"
TEAM_SIZE = rf"(?i)(?:{'|'.join(TEAMS)})\s+(?:of|size)\s*[:-]?\s*({NUMBER})"
TITLES = rf"(?i)(?:^|[^\p{{L}}])(?:chief [^,|\n]{{0,30}}officer|{'|'.join(sorted(TITLE_WORDS, key=len, reverse=True))})(?:[^\p{{L}}]|$)"


def clean_field(value: Column, limit: int = LONGEST_FIELD) -> Column:
    """One line: control characters and blanks become single blanks, at most so many characters."""
    return F.substring(F.trim(F.regexp_replace(value, r"[\x00-\x20\x7f   ]+", " ")), 1, limit)


def own_hosts(hosts: Column) -> Column:
    """Hosts without www that may be a company's own: no free mail, no shorteners, networks or redirectors."""
    bare = F.transform(hosts, lambda h: F.regexp_replace(F.rtrim(F.lower(h), F.lit(".,;:")), r"^www\.", ""))
    under = lambda h, some: F.exists(F.array(*map(F.lit, some)), lambda x: (h == x) | F.endswith(h, F.concat(F.lit("."), x)))
    return F.array_distinct(F.filter(bare, lambda h: (h != "") & ~under(h, (*FREE_MAIL, *NOISE_HOSTS))))


def whole_number(text: Column) -> Column:
    """1,200 and 1.200 are thousands; else what stands before the first mark."""
    digits = F.when(text.rlike(r"^[0-9]{1,3}(?:[.,][0-9]{3})+$"), F.translate(text, ".,", "")).otherwise(F.regexp_extract(text, "^[0-9]+", 0))
    return digits.try_cast("long")


def size_band(n: Column) -> Column:
    bands = [(most, name) for name, (_, _, most) in policy.BANDS.items()]
    out = F.when(n <= bands[0][0], bands[0][1])
    for most, name in bands[1:-1]:
        out = out.when(n <= most, name)
    return out.when(n.isNotNull(), bands[-1][1])


def stated_size(text: Column) -> Column:
    """The band of the first headcount: a range that is a band as written, else its upper end; else of a stated team size."""
    part = lambda p, k: F.nullif(F.regexp_extract(text, p, k), F.lit(""))
    low, high = part(HEADCOUNT, 1), part(HEADCOUNT, 2)
    written = F.concat_ws("-", whole_number(low).cast("string"), whole_number(high).cast("string"))
    return F.coalesce(F.when(high.isNotNull() & written.isin(*policy.BANDS), written), size_band(F.coalesce(whole_number(high), whole_number(low))), size_band(whole_number(part(TEAM_SIZE, 1))))


def labelled(text: Column, labels: tuple[str, ...]) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?im)^[ \t]*(?:{'|'.join(labels)})[ \t]*[:=][ \t]*([^\n]+)$", 1)), F.lit(""))


def _signature_lines(signature: Column) -> Column:
    bare = F.transform(F.split(signature, "\n"), lambda x: F.btrim(x, F.lit(" \t|*_•·")))
    return F.filter(bare, lambda x: (F.length(x) > 2) & ~x.contains("@") & ~x.rlike(URL))


def company_line(signature: Column) -> Column:
    """The first line that ends in a legal form, whatever follows a comma; not a form alone, not a sentence."""

    def company(line: Column) -> Column:
        head = F.trim(F.substring_index(line, ",", 1))
        last = F.translate(F.lower(F.substring_index(head, " ", -1)), ".", "")
        return F.when((F.length(line) <= 80) & head.contains(" ") & last.isin(*LEGAL_ENDS) & ~F.lower(line).rlike("^(?:http|tel|phone|mob)"), head)

    return F.get(F.filter(F.transform(_signature_lines(signature), company), lambda x: x.isNotNull()), F.lit(0))


def title_line(signature: Column) -> Column:
    """The first line with a word of job titles; of a long one the part before a bar or comma."""
    fits = F.filter(_signature_lines(signature), lambda x: (F.length(x) <= 70) & x.rlike(TITLES) & ~x.rlike("[0-9]{5,}"))
    first = F.get(fits, F.lit(0))
    return F.when(F.length(first) > 45, F.trim(F.substring_index(F.substring_index(first, "|", 1), ",", 1))).otherwise(first)


def sender_name(name: Column, addr: Column) -> Column:
    """The display name, or the words of the address before the @."""
    bare = F.trim(F.regexp_replace(F.btrim(F.trim(name), F.lit("\"'")), r"\s+", " "))
    local = F.filter(F.split(F.substring_index(addr, "@", 1), r"[._+-]+"), lambda w: (w != "") & ~w.rlike("^[0-9]+$"))
    return F.when((bare != "") & ~bare.contains("@"), bare).otherwise(F.array_join(F.transform(local, F.initcap), " "))


def extract_leads(messages: DataFrame, thread: str = "thread", links: str | None = None) -> DataFrame:
    """messages with a struct lead: name, email, company, website, job_title, company_size_band and for each *_by, the way it was found
    (null: not found); missing (the names of empty fields) and usable (website, company and email are known).

    links: a column of the links of the message's markup, which come after those of its text.
    """
    t = F.col(thread)
    body, sign, addr = t["body"], t["signature"], t["from_addr"]
    found = lambda text, p: F.regexp_extract_all(text, F.lit(p), F.lit(1))
    bare = F.filter(F.transform(F.split(sign, "\n"), lambda x: F.when(~x.contains("@"), F.regexp_extract(x, BARE, 1)).otherwise("")), lambda x: x != "")
    linked = F.flatten(F.transform(F.col(links), lambda x: F.regexp_extract_all(x, F.lit(URL), F.lit(1)))) if links else F.array().cast("array<string>")
    step = messages.withColumns({"_business": F.coalesce(addr.contains("@") & (sender_class(addr) == "business"), F.lit(False)), "_hosts": own_hosts(F.concat(found(sign, URL), found(sign, MAIL), bare, found(body, URL), linked))})
    other = F.get("_hosts", F.lit(0))
    step = step.withColumn("_site", F.when(F.col("_business"), site_root(addr)).otherwise(site_root(F.concat(F.lit("@"), other))))
    text = F.concat_ws("\n", body, sign)
    own_label = F.substring_index(F.regexp_replace(F.col("_site"), r"^https://(?:www\.)?", ""), ".", 1)
    step = step.withColumns(
        {
            "_label": labelled(text, COMPANY_LABELS), "_line": company_line(sign), "_domain": F.nullif(F.initcap(F.regexp_replace(own_label, "-", " ")), F.lit("")),
            "_titled": labelled(text, TITLE_LABELS), "_title": title_line(sign), "_size": stated_size(text), "_name": sender_name(t["from_name"], addr),
        }
    )
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    company, title = F.coalesce("_label", "_line", "_domain"), F.coalesce("_titled", "_title")
    values = {"website": F.substring("_site", 1, 200), "company": clean_field(company), "job_title": clean_field(title), "company_size_band": F.col("_size")}
    lead = F.struct(
        clean_field(F.col("_name")).alias("name"), addr.alias("email"), *[F.nullif(v, F.lit("")).alias(k) for k, v in values.items()],
        F.when(given(t["forwarded_by"]), "forwarded").otherwise("header").alias("email_by"), F.when(F.col("_site").isNull(), None).when(F.col("_business"), "sender").otherwise("link").alias("website_by"),
        F.when(given(F.col("_label")), "label").when(given(F.col("_line")), "signature").when(given(F.col("_domain")), "domain").alias("company_by"),
        F.when(given(F.col("_titled")), "label").when(given(F.col("_title")), "signature").alias("job_title_by"), F.when(F.col("_size").isNotNull(), "stated").alias("company_size_band_by"),
        F.array_compact(F.array(*[F.when(~given(values[k]), F.lit(k)) for k in FIELDS])).alias("missing"), reduce(lambda a, b: a & b, [given(F.col("_site")), given(company), given(addr)]).alias("usable"),
    )
    return step.withColumn("lead", lead).select(*messages.columns, "lead")


def lead_route(lead: Column, flags: Column, auto_generated: Column, duplicate: Column) -> Column:
    """What becomes of a message: the first that holds of duplicate, auto_generated, needs_review (flagged or not usable), run."""
    return F.when(duplicate, "duplicate").when(auto_generated, "auto_generated").when((F.size(flags) > 0) | ~lead["usable"], "needs_review").otherwise("run")
