"""Compliance decisions, next actions and the current row per company."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom import policy


def screen_freshness(leads: DataFrame, answers: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """The last answer not after as_of by lead, and whether it is fresh; no answer: never asked."""
    last = answers.where(F.col("fetched_at") <= as_of).groupBy("lead_id").agg(F.max_by("answer_id", F.struct("fetched_at", "answer_id")).alias("answer_id"), F.max("fetched_at").alias("fetched_at"))
    age = F.date_diff(F.to_date(as_of), F.to_date("fetched_at"))
    return leads.select("lead_id").join(last, "lead_id", "left").select("lead_id", "answer_id", F.when(F.col("fetched_at").isNull(), "never_asked").when(age <= days, "fresh").otherwise("stale").alias("freshness"))


def screens_as_of(queries: DataFrame, answers: DataFrame, days: int = 30) -> DataFrame:
    """query_id, answer_id and outcome of each query at its time: what the last answer to the same name and country says by then.

    fresh: a readable answer not older than days, answer_id names it; degraded: none, and the last attempt failed; stale: only older
    answers, or one that cannot say when it was fetched; not_configured: never an attempt, and the service is not set up; never_asked:
    never an attempt, though it is.

    queries: query_id, name, country, as_of, configured. answers: answer_id, name, country, fetched_at (text), ok. Names are compared in
    lower case without blanks around them; a null country is a country of its own. Both tables are one union in the order of time: inside
    a day by a running maximum, over days by one row per key and day, so that a name that holds most rows is split by days.
    """
    key = [F.lower(F.trim(F.coalesce("name", F.lit("")))).alias("k1"), F.coalesce("country", F.lit("")).alias("k2")]
    at = F.try_to_timestamp("fetched_at")
    told = answers.select(*key, at.alias("t"), "answer_id", F.coalesce("ok", F.lit(False)).alias("ok"))
    asked = queries.select(*key, F.col("as_of").cast("timestamp").alias("t"), "query_id", F.coalesce("configured", F.lit(False)).alias("configured"))
    attempt = F.struct("t", "ok", "answer_id")
    mine = told.where("t is not null").select("k1", "k2", "t", F.lit(0).alias("kind"), F.lit(None).cast(asked.schema["query_id"].dataType).alias("query_id"), F.lit(None).cast("boolean").alias("configured"), F.when(F.col("ok"), attempt).alias("good"), attempt.alias("last"))
    theirs = asked.select("k1", "k2", "t", F.lit(1).alias("kind"), "query_id", "configured", *[F.lit(None).cast(mine.schema[c].dataType).alias(c) for c in ("good", "last")])
    rows = mine.union(theirs).withColumn("day", F.to_date("t"))
    daily = rows.groupBy("k1", "k2", "day").agg(F.max("good").alias("good"), F.max("last").alias("last"))
    before = Window.partitionBy("k1", "k2").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carried = daily.select("k1", "k2", "day", F.max("good").over(before).alias("good_before"), F.max("last").over(before).alias("last_before"))
    so_far = Window.partitionBy("k1", "k2", "day").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumns({"good_now": F.max("good").over(so_far), "last_now": F.max("last").over(so_far)}).where("kind = 1")
    undated = told.where("t is null").groupBy("k1", "k2").agg(F.bool_or("ok").alias("undated"))
    full = seen.join(carried, ["k1", "k2", "day"], "left").join(undated, ["k1", "k2"], "left")
    good, last = F.coalesce("good_now", "good_before"), F.coalesce("last_now", "last_before")
    fresh = F.coalesce(good["t"] >= F.col("t") - F.expr(f"INTERVAL {days} DAYS"), F.lit(False))
    outcome = (
        F.when(fresh, "fresh").when(F.coalesce(~last["ok"], F.lit(False)), "degraded").when(good.isNotNull() | F.coalesce("undated", F.lit(False)), "stale")
        .when(F.col("undated").isNotNull(), "degraded").when(F.col("configured"), "never_asked").otherwise("not_configured")
    )
    return full.select("query_id", F.when(fresh, good["answer_id"]).alias("answer_id"), outcome.alias("outcome"))


def with_list_hits(cases: DataFrame, names: DataFrame, short: DataFrame, domains: DataFrame, second: DataFrame, second_screens: DataFrame) -> DataFrame:
    """cases with the best name_score, domain_score and second_score, short_hit and second_screen of each lead_id.

    names, short, domains, second: hits (lead_id, score) of the typed name, its acronym, its domains and its second identities;
    second_screens: the worst status of these by lead_id.
    """
    fields = {"name_score": "int", "short_hit": "boolean", "domain_score": "int", "second_score": "int", "second_screen": "string"}
    parts = ((names, "name_score", F.col("score")), (short, "short_hit", F.lit(True)), (domains, "domain_score", F.col("score")), (second, "second_score", F.col("score")), (second_screens, "second_screen", F.col("status")))
    rows = [hits.select("lead_id", *[(value if c == own else F.lit(None)).cast(t).alias(c) for c, t in fields.items()]) for hits, own, value in parts]
    best = reduce(DataFrame.unionByName, rows).groupBy("lead_id").agg(*[F.max(c).alias(c) for c in fields])
    return cases.join(best, "lead_id", "left")


def compliance(cases: DataFrame) -> DataFrame:
    """status, floors and notes: the verdict (review where there is none), then floors in order; a status never softens.

    cases: verdict, hq_hit, hq_origin, tld_hit, name_score, short_hit, domain_score, screen_status, screen_reason, screenable,
    marker; second_score and second_screen of the second identity where it was looked up. Each floor that acts leaves its name.
    """
    second_score = F.coalesce("second_score", F.lit(0)) if "second_score" in cases.columns else F.lit(0)
    second_screen = F.coalesce("second_screen", F.lit("")) if "second_screen" in cases.columns else F.lit("")
    second_blocked = (second_screen == "blocked_evidence") | (second_score >= policy.NAME_FLOOR)
    steps: list[tuple[str, Column, str]] = [
        ("no_verdict", F.coalesce("verdict", F.lit("")) == "", "review"),
        ("restricted_hq", F.coalesce(F.col("hq_origin") == "prescreen:hq", F.lit(False)), "blocked"),
        ("near_exact", F.coalesce(F.col("hq_hit").isNotNull(), F.lit(False)) | (F.greatest(F.coalesce("name_score", F.lit(0)), F.coalesce("domain_score", F.lit(0))) >= policy.NAME_FLOOR), "clear>review"),
        ("abbreviation", F.coalesce("short_hit", F.lit(False)), "clear>review"),
        ("domain", F.coalesce("domain_score", F.lit(0)) >= policy.DOMAIN_FLOOR, "clear>review"),
        ("watchlist_blocked", F.col("screen_status") == "blocked_evidence", "blocked"),
        ("watchlist_review", F.col("screen_status") == "review_evidence", "clear>review"),
        ("second_blocked", second_blocked, "blocked"),
        ("second_review", ~second_blocked & ((second_screen == "review_evidence") | (second_score >= policy.CANDIDATE_FLOOR)), "review"),
        ("jurisdiction", ~F.col("screenable"), "clear>review"),
        ("not_screened", (F.col("screen_status") == "skipped") & (F.coalesce("screen_reason", F.lit("")) != "not_configured"), "clear>review"),
    ]
    out = cases.withColumns({"status": F.when(F.coalesce("verdict", F.lit("")) == "", "review").otherwise(F.col("verdict")), "_floors": F.array().cast("array<string>")})
    for name, test, effect in steps:
        acts = test if effect in ("blocked", "review") else test & (F.col("status") == "clear")
        out = out.withColumns(
            {
                "_floors": F.when(acts, F.concat("_floors", F.array(F.lit(name)))).otherwise(F.col("_floors")),
                "status": F.when(acts, "blocked" if effect == "blocked" else F.when(F.col("status") == "blocked", "blocked").otherwise("review")).otherwise(F.col("status")),
            }
        )
    note = F.when((F.col("status") == "clear") & (F.col("screen_status") == "skipped"), "not_configured")
    return out.withColumns({"floors": F.array_join("_floors", ","), "note": note, "flagged": F.col("status") != "clear"}).drop("_floors")


def next_action(decided: DataFrame) -> DataFrame:
    """sales_ready and the one next step; compliance comes first. decided: status, score, confidence, contact_quality, employees, size_band, state."""
    ready = (F.col("status") == "clear") & (F.col("score") >= policy.THRESHOLD) & F.col("confidence").isin("MEDIUM", "HIGH")
    size = (F.coalesce("employees", F.lit(0)) != 0) | F.col("size_band").isin(*policy.BANDS)
    seen = F.col("state").isin("CONFIRMED", "LIKELY", "POSSIBLE")
    action = (
        F.when(F.col("status") == "blocked", "DO NOT ENGAGE").when(F.col("status") == "review", "HOLD").when(ready & (F.col("contact_quality") == "valid"), "CONTACT NOW").when(ready, "WORK THE ACCOUNT")
        .when(seen & ~size, "CONFIRM SIZE").when(F.col("confidence") == "LOW", F.concat(F.lit("LOW PRIORITY: "), F.when(size, "public-cloud use").otherwise("company size"), F.lit(" unknown")))
        .when(~seen, "LOW PRIORITY: no public cloud").otherwise("LOW PRIORITY: below threshold")
    )
    return decided.withColumns({"sales_ready": ready, "next_action": action})


def current_rows(outcomes: DataFrame, company: Column, processed: Column) -> DataFrame:
    """The last processed row of each company; nulls of the last row replace earlier values."""
    key = F.lower(F.trim(company))
    return outcomes.withColumns({"company_key": key, "_r": F.row_number().over(Window.partitionBy(key).orderBy(processed.desc()))}).where("_r = 1").drop("_r")


def contact_quality(leads: DataFrame, answers: DataFrame, least_score: int = 70) -> DataFrame:
    """Verifier answers by address: valid, invalid (also disposable), ambiguous ones by score, else risky; no answer: unverified."""
    last = answers.groupBy(F.lower("email").alias("email")).agg(F.max_by(F.struct("status", "score"), "answer_id").alias("a"))
    quality = (
        F.when(F.col("a").isNull(), "unverified").when(F.col("a.status") == "valid", "valid").when(F.col("a.status").isin("invalid", "disposable"), "invalid")
        .when((F.col("a.status") == "ambiguous") & (F.coalesce("a.score", F.lit(0)) >= least_score), "valid").otherwise("risky")
    )
    return leads.select("lead_id", F.lower("email").alias("email")).join(last, "email", "left").select("lead_id", quality.alias("quality"))


def notifications(card: DataFrame) -> DataFrame:
    """Subject and body of each lead's notification."""
    who = F.regexp_replace(F.trim("company"), "[\r\n]+", " ")
    subject = F.concat(F.lit("["), F.col("next_action"), F.lit("] "), who, F.lit(" (fit "), F.col("score").cast("string"), F.lit(", "), F.col("confidence"), F.lit(")"))
    body = F.concat_ws("\n", F.concat(F.lit("Compliance: "), F.col("status")), F.concat(F.lit("Cloud usage: "), F.col("state")), F.concat(F.lit("Spend prior: "), F.col("spend_tier")))
    return card.select("lead_id", subject.alias("subject"), body.alias("body"))
