"""Screens at the time of each query against a plain search."""

import datetime
import random

from leadloom.operators import decide

DAY = datetime.timedelta(days=1)


def test_outcomes_by_brute_force(spark):
    rng = random.Random(4)
    start = datetime.datetime(2024, 1, 1)
    answers = [(i, rng.choice(["Acme", " acme", "Bolt", "Hot", "Hot", None]), rng.choice(["DE", None]), rng.choice(["?", None, str(start + rng.randint(0, 2000) * DAY / 24)]) if rng.random() < 0.2 else str(start + rng.randint(0, 2000) * DAY / 24), rng.choice([True, True, False, None])) for i in range(150)]
    queries = [(i, rng.choice(["Acme", "bolt ", "Hot", "Never", None]), rng.choice(["DE", None]), start + rng.randint(0, 3000) * DAY / 24, rng.choice([True, False, None])) for i in range(300)]

    def plain(name, country, as_of, configured):
        norm = lambda n: (n or "").strip().lower()
        own = [(datetime.datetime.fromisoformat(t) if t and t != "?" else None, bool(ok), i) for i, n, c, t, ok in answers if norm(n) == norm(name) and c == country]
        dated = sorted(x for x in own if x[0] is not None and x[0] <= as_of)
        undated = [x for x in own if x[0] is None]
        good = [x for x in dated if x[1]]
        if good and good[-1][0] >= as_of - 30 * DAY:
            return good[-1][2], "fresh"
        if dated and not dated[-1][1]:
            return None, "degraded"
        if good or any(x[1] for x in undated):
            return None, "stale"
        return None, "degraded" if undated else "never_asked" if configured else "not_configured"

    told = spark.createDataFrame(answers, "answer_id long, name string, country string, fetched_at string, ok boolean").repartition(3)
    asked = spark.createDataFrame(queries, "query_id long, name string, country string, as_of timestamp, configured boolean").repartition(3)
    got = {r["query_id"]: (r["answer_id"], r["outcome"]) for r in decide.screens_as_of(asked, told).collect()}
    want = {i: plain(n, c, t, k) for i, n, c, t, k in queries}
    assert got == want and {o for _, o in want.values()} == {"fresh", "degraded", "stale", "never_asked", "not_configured"}
    assert decide.screens_as_of(asked.where("false"), told).count() == 0
    assert {r["outcome"] for r in decide.screens_as_of(asked, told.where("false")).collect()} == {"never_asked", "not_configured"}
