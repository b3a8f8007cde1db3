"""Mail threads: the original of a forwarded message, quoted history and the signature, as folds over the lines of a text.

Every line gets a number whose bits say what it can be, each by comparing its beginning and end with short lists. What a thread is
made of then follows from these numbers alone: a small state machine finds the forwarded block, and the first line that begins
quoted history or the signature is looked up. Nothing but positions is carried, so the time follows the lines.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What mail programs write in several languages: fixed values.
ATTRIBUTIONS = (("on ", "wrote:"), ("am ", ":", " schrieb"), ("le ", "a écrit :"), ("le ", "a écrit:"), ("", "írta:"))
SEPARATORS = ("original message", "eredeti üzenet", "ursprüngliche nachricht")
FORWARDS = ("forwarded message", "továbbított üzenet", "weitergeleitete nachricht", "message transféré")
FROM_KEYS, SUBJECT_KEYS = ("from", "feladó", "von", "de"), ("subject", "tárgy", "betreff")
FOLLOW_KEYS = ("sent", "date", "küldve", "elküldve", "gesendet", "envoyé", "to", "címzett", "subject", "tárgy", "cc")
HEADER_KEYS = (*FROM_KEYS, *SUBJECT_KEYS, "sent", "date", "dátum", "datum", "to", "címzett", "an", "cc", "reply-to")
SIGN_OFFS = (
    "best regards", "kind regards", "warm regards", "regards", "best wishes", "best", "thanks", "thank you", "many thanks", "cheers", "sincerely", "yours sincerely", "yours faithfully", "üdvözlettel", "szívélyes üdvözlettel",
    "tisztelettel", "köszönettel", "üdv", "mit freundlichen grüßen", "freundliche grüße", "viele grüße", "beste grüße", "cordialement", "bien cordialement",
)
LONGEST, NEAR_END, NAME_NEAR_END, FOLLOWS_WITHIN = 320, 14, 10, 4
REPLY, FORWARD, HEADER, FROM, FOLLOW, QUOTED, BLANK, SIGN_OFF, WROTE, ON, DELIMITER = (1 << i for i in range(11))
_BLANKS = " \t\n\r\x0b\x0c\xa0"


def lines_of(text: Column) -> Column:
    """The lines of a text; carriage returns end lines too, and other control characters go."""
    ends = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.split(F.translate(ends, "".join(map(chr, [*range(9), 11, 12, *range(14, 32), 127])), ""), "\n")


def _bit(test: Column, bit: int) -> Column:
    return F.when(test, bit).otherwise(0)


def kind(x: Column, line: Column) -> Column:
    """The bits of a line, given without blanks around it in lower case, and as it stands."""
    attributed = [x.startswith(a) & x.endswith(z[0]) & (x.contains(z[1]) if len(z) > 1 else F.lit(True)) for a, *z in ATTRIBUTIONS]
    dashed = F.trim(F.btrim(x, F.lit("-")))
    ruled = x.startswith("--") & x.endswith("--")
    key = F.btrim(F.substring_index(x, ":", 1), F.lit("* "))
    named = x.contains(":")
    filled = F.btrim(F.substring(x, F.instr(x, ":") + 1, F.length(x)), F.lit("* ")) != ""
    parts = [
        _bit((F.length(x) <= LONGEST) & reduce(or_, attributed), REPLY), _bit(ruled & dashed.isin(*SEPARATORS), REPLY), _bit((F.length(x) >= 10) & (F.btrim(x, F.lit("_")) == ""), REPLY),
        _bit((ruled & dashed.isin(*FORWARDS)) | (F.replace(x, F.lit(" "), F.lit("")) == "beginforwardedmessage:"), FORWARD), _bit(named & key.isin(*HEADER_KEYS), HEADER), _bit(named & key.isin(*FROM_KEYS) & filled, FROM),
        _bit(named & key.isin(*FOLLOW_KEYS), FOLLOW), _bit(x.startswith(">"), QUOTED), _bit(x == "", BLANK), _bit(F.rtrim(x, F.lit(",.! ")).isin(*SIGN_OFFS), SIGN_OFF), _bit(x == "wrote:", WROTE), _bit(x.startswith("on "), ON),
        _bit(F.rtrim(line, F.lit(" \xa0")) == "--", DELIMITER),
    ]
    return reduce(lambda m, n: m.bitwiseOR(n), parts)


def _has(number: Column, bit: int) -> Column:
    return F.coalesce(number, F.lit(0)).bitwiseAND(bit) != 0


def forwarded_at(kinds: Column) -> Column:
    """mark, head, body: where the first forwarded block with headers begins, its headers and its text; mark is -1 without one."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("phase"), F.lit(-1).alias("mark"), F.lit(-1).alias("head"), F.lit(-1).alias("body"))

    def step(s: Column, k: Column) -> Column:
        # phase 0: no mark yet; 1: after a mark, blank so far; 2: in its headers; 3: in its text
        opens = s["phase"].isin(0, 1) & _has(k, FORWARD)
        first, more = (s["phase"] == 1) & _has(k, HEADER), (s["phase"] == 2) & _has(k, HEADER)
        waits = (s["phase"] == 1) & _has(k, BLANK)
        phase = F.when(opens, 1).when(first, 2).when(more, 2).when(waits, 1).when(s["phase"] >= 2, 3).otherwise(0)
        return F.struct(
            (s["i"] + 1).alias("i"), phase.alias("phase"), F.when(opens, s["i"]).otherwise(s["mark"]).alias("mark"), F.when(first, s["i"]).otherwise(s["head"]).alias("head"), F.when((s["phase"] == 2) & ~more, s["i"]).otherwise(s["body"]).alias("body")
        )

    def result(s: Column) -> Column:
        found = s["phase"] >= 2
        return F.struct(F.when(found, s["mark"]).otherwise(-1).alias("mark"), s["head"].alias("head"), F.when(s["phase"] == 2, s["i"]).otherwise(s["body"]).alias("body"))

    return F.aggregate(kinds, start, step, result)


def _first(kinds: Column, test: Callable[[Column, Column], Column], begin: Column | int = 0) -> Column:
    """The first place from begin on where test(kind, place) holds, or null."""
    places = F.filter(F.transform(kinds, lambda k, i: F.when((i >= begin) & test(k, i), i)), lambda i: i.isNotNull())
    return F.get(places, F.lit(0))


def history_at(kinds: Column) -> Column:
    """Where quoted history begins, or null."""

    def begins(k: Column, i: Column) -> Column:
        follows = reduce(or_, [_has(F.get(kinds, i + j), FOLLOW) for j in range(1, FOLLOWS_WITHIN + 1)])
        return _has(k, REPLY) | (_has(k, ON) & _has(F.get(kinds, i + 1), WROTE)) | (_has(k, FROM) & follows)

    return _first(kinds, begins)


def _text(lines: Column) -> Column:
    return F.btrim(F.array_join(lines, "\n"), F.lit(_BLANKS))


def _header(lines: Column, keys: tuple[str, ...]) -> Column:
    """The value of the first line with one of the keys, each key in turn; null without one."""
    key = lambda x: F.btrim(F.lower(F.substring_index(x, ":", 1)), F.lit("* \t"))
    value = lambda x: F.btrim(F.substring(x, F.instr(x, ":") + 1, F.length(x)), F.lit("* \t"))
    return F.coalesce(*[F.get(F.transform(F.filter(lines, lambda x: key(x) == k), value), F.lit(0)) for k in keys])  # noqa: B023


def address_of(value: Column) -> tuple[Column, Column]:
    """Name and address of one mail address as written in a header; empty where there is none."""
    plain = F.replace(F.coalesce(value, F.lit("")), F.lit("mailto:"), F.lit(""))
    addr = F.lower(F.regexp_extract(plain, r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)", 1))
    name = F.btrim(F.substring_index(F.substring_index(plain, "<", 1), "[", 1), F.lit(" \"'\t"))
    return F.when(name.contains("@"), "").otherwise(name), addr


def threads(messages: DataFrame, body: str = "body", from_name: str = "from_name", from_addr: str = "from_addr", subject: str = "subject") -> DataFrame:
    """Adds a struct thread: note (the forwarder's own text), from_name, from_addr and subject (of the original where one is forwarded),
    forwarded_by, body (the new text alone), signature and quoted (whether history was taken out).

    A forwarded block whose sender cannot be read is kept as text. The signature begins at a sign-off near the end, else at a line near
    the end that is the sender's name; what stands below a delimiter belongs to it too. Null texts and fields count as empty.
    """
    names = messages.columns
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    rest_of = lambda c, n: F.slice(c, n + 1, F.greatest(F.size(c) - n, F.lit(0)))
    # each step reads what the one before has worked out once
    step = messages.withColumn("_lines", lines_of(F.col(body)))
    step = step.withColumn("_low", F.transform("_lines", lambda x: F.lower(F.btrim(x, F.lit(_BLANKS)))))
    step = step.withColumn("_kinds", F.transform("_low", lambda x, i: kind(x, F.get("_lines", i))))
    step = step.withColumn("_at", forwarded_at(F.col("_kinds")))
    step = step.withColumn("_heads", F.when(F.col("_at.mark") >= 0, F.slice("_lines", F.col("_at.head") + 1, F.col("_at.body") - F.col("_at.head"))).otherwise(F.array().cast("array<string>")))
    name, addr = address_of(_header(F.col("_heads"), FROM_KEYS))
    step = step.withColumns({"_name": name, "_addr": addr, "_subject": _header(F.col("_heads"), SUBJECT_KEYS)})
    inside = F.col("_addr") != ""
    step = step.withColumns(
        {
            "_note": F.when(inside, _text(F.slice("_lines", 1, F.greatest(F.col("_at.mark"), F.lit(0))))).otherwise(""), "_sender": F.when(inside, F.col("_name")).otherwise(empty(from_name)),
            "_rest": F.when(inside, rest_of(F.col("_lines"), F.col("_at.body"))).otherwise(F.col("_lines")), "_marks": F.when(inside, rest_of(F.col("_kinds"), F.col("_at.body"))).otherwise(F.col("_kinds")),
        }
    )
    step = step.withColumn("_cut", history_at(F.col("_marks")))
    step = step.withColumns({"_new": F.slice("_rest", 1, F.coalesce("_cut", F.size("_rest"))), "_new_marks": F.slice("_marks", 1, F.coalesce("_cut", F.size("_rest")))})
    unquoted = lambda k: ~_has(k, QUOTED)
    step = step.withColumns({"_kept": F.filter("_new", lambda x, i: unquoted(F.get("_new_marks", i))), "_kept_marks": F.filter("_new_marks", unquoted)})
    step = step.withColumn("_end", F.coalesce(_first(F.col("_kept_marks"), lambda k, i: _has(k, DELIMITER)), F.size("_kept")))
    squeezed = lambda c: F.lower(F.trim(F.regexp_replace(c, "[ \t]+", " ")))
    step = step.withColumns({"_own": squeezed(F.col("_sender")), "_tail": F.transform(F.slice("_kept", F.greatest(F.col("_end") - NAME_NEAR_END, F.lit(0)) + 1, F.least(F.lit(NAME_NEAR_END), F.col("_end"))), squeezed)})
    signed = _first(F.slice("_kept_marks", 1, F.col("_end")), lambda k, i: _has(k, SIGN_OFF), F.greatest(F.col("_end") - NEAR_END, F.lit(0)))
    named = F.when((F.col("_own") != "") & F.array_contains("_tail", F.col("_own")), F.array_position("_tail", F.col("_own")).cast("int") - 1 + F.greatest(F.col("_end") - NAME_NEAR_END, F.lit(0)))
    step = step.withColumn("_sign", F.coalesce(signed, named, F.col("_end")))
    sign = F.slice("_kept", F.col("_sign") + 1, F.greatest(F.col("_end") - F.col("_sign"), F.lit(0)))
    thread = F.struct(
        F.col("_note").alias("note"), F.col("_sender").alias("from_name"), F.when(inside, F.col("_addr")).otherwise(empty(from_addr)).alias("from_addr"), F.coalesce(F.when(inside, F.nullif("_subject", F.lit(""))), empty(subject)).alias("subject"),
        F.when(inside, empty(from_addr)).alias("forwarded_by"), _text(F.slice("_kept", 1, F.col("_sign"))).alias("body"),
        F.concat_ws("\n", F.nullif(_text(sign), F.lit("")), F.nullif(_text(rest_of(F.col("_kept"), F.col("_end") + 1)), F.lit(""))).alias("signature"), (F.col("_cut").isNotNull() | (F.size("_kept") < F.size("_new"))).alias("quoted"),
    )
    return step.select(*names, thread.alias("thread"))
