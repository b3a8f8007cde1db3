"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Proposals come from regular expressions, whose spans never overlap within a kind. Card numbers must pass Luhn, IBANs the
mod-97 test at the length of their country, address parts their range. Each span gets a confidence: the kind's own, raised when a context word stands
within 40 characters. The four base kinds are kept at any confidence; the added kinds (iban, ssn) only from min_score up.

The expressions below start a proposal only at the beginning of a run (or where the previous match ended) and use
possessive repeats, so that a text of one endless token costs linear time and no stack.

Defined results: a null or empty text has no spans; a null doc_id is returned as it is; spans are code points, end
exclusive; repeated rows are scanned one by one; extra columns are carried through, save those named like a result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm._common import documents, let

LOCAL = "[A-Za-z0-9._%+-]"
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needs: str  # a cheap test that every text with such a span passes
    score: float
    context: str  # a pattern over lower-cased text
    base: bool = True
    group: int = 0  # the group with the candidate, where the match is only its beginning, so that candidates may overlap


#: Country codes by the length of their IBANs.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """The first four characters of a candidate, and in group 1 the whole one: as long as its country says; other codes take the longest run."""
    forms, known = [], "|".join(" ".join(IBAN_LENGTHS.values()).split())
    for n, codes in IBAN_LENGTHS.items():
        groups, rest = divmod(n - 4, 4)
        forms.append(rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{groups}}}" + (rf"\x20?[A-Z0-9]{{{rest}}}" if rest else ""))
    forms.append(rf"(?!{known})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{2,7}}+(?:\x20?[A-Z0-9]{{1,3}})?")
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?=((?:{'|'.join(forms)})(?![A-Za-z0-9])))[A-Z]{{2}}[0-9]{{2}}"


KINDS = (
    Kind("email", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8, "e-?mail|contact|write|@"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", 0.6, r"\bip\b|address|host|server|client"),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,}+", r"[0-9][\x20-]?[0-9][\x20-]?[0-9]", 0.7, "card|visa|credit|payment|debit|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.6, r"phone|call|tel\b|mobile|fax|whatsapp"),
    Kind("iban", _iban(), "[A-Z]{2}[0-9]{2}", 0.6, "iban|bank|account|konto|compte|cuenta", base=False, group=1),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]{2}-[0-9]", 0.3, r"\bssn\b|social security|national id", base=False),
)


def mod97(iban: Column) -> Column:
    """Whether the rearranged number leaves 1 when divided by 97."""
    plain = F.translate(iban, " ", "")
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    rest = F.aggregate(
        F.split(moved, ""),
        F.lit(0),
        lambda acc, c: F.when(c == "", acc)
        .when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97)
        .otherwise((acc * 100 + F.ascii(c) - 55) % 97)
        .cast("int"),
    )
    return rest == 1


def confirmed(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    small = lambda p: let(F.ltrim(p, F.lit("0")), lambda q: (F.length(q) <= 3) & (F.coalesce(q.try_cast("int"), F.lit(0)) <= 255))
    if kind == "ip":
        return F.forall(F.split(match, r"\."), small)
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return mod97(match)
    return F.lit(True)


def spans_of(text: Column, kind: Kind, context_chars: int, bonus: float, min_score: float) -> Column:
    """Confirmed spans of one kind. A match starts where the gaps and matches before it end; of overlapping candidates the first confirmed one counts."""
    gap_lengths = F.transform(F.split(text, kind.pattern, -1), F.length)
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    empty = F.array().cast("array<struct<start:int,end:int,match:string>>")

    whole = "whole" if kind.group else "match"

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["match"])
        span = F.struct(start.alias("start"), (start + F.length(x[whole])).alias("end"), x[whole].alias("match"))
        counts = confirmed(kind.name, x[whole])
        if kind.group:
            counts = (start >= F.coalesce(F.try_element_at(acc["out"], F.lit(-1))["end"], F.lit(0))) & counts
        return F.struct(
            end.cast("int").alias("at"),
            F.when(counts, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"),
        )

    wholes = [F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group)).alias("w")] if kind.group else []
    zipped = let(
        F.struct(gap_lengths.alias("g"), matches.alias("m"), *wholes),
        lambda z: F.arrays_zip(F.slice(z["g"], F.lit(1), F.size(z["m"])).alias("gap"), z["m"].alias("match"), *[z["w"].alias("whole") for _ in wholes]),
    )
    found = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)["out"]

    def scored(s: Column) -> Column:
        left = F.greatest(s["start"] - context_chars, F.lit(0))
        around = F.concat(
            F.substring(text, left + 1, s["start"] - left), F.lit(" "), F.substring(text, s["end"] + 1, F.lit(context_chars))
        )
        near = F.rlike(F.lower(around), F.lit(kind.context))
        score = F.round(F.least(F.lit(1.0), F.lit(kind.score) + F.when(near, F.lit(bonus)).otherwise(F.lit(0.0))), 3)
        return F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score.alias("score"))

    spans = F.transform(found, scored)
    if not kind.base:
        spans = F.filter(spans, lambda s: s["score"] >= min_score)
    return F.when(F.rlike(text, F.lit(kind.needs)), spans).otherwise(F.array().cast(SPANS))


def find_pii(docs: DataFrame, text: str = "text", context_chars: int = 40, bonus: float = 0.25, min_score: float = 0.5) -> DataFrame:
    """Adds pii: confirmed spans with scores, by kind in the order of KINDS, then start."""
    body = F.coalesce(F.col(text), F.lit(""))
    scan = lambda kind: let(body, lambda t: spans_of(t, kind, context_chars, bonus, min_score))
    return docs.withColumn("pii", F.concat(*[scan(kind) for kind in KINDS]).cast(SPANS))


def redact_pii(found: DataFrame, text: str = "text") -> DataFrame:
    """Replaces each stretch of touching or overlapping spans by [KIND] of its first span; drops pii."""
    by_start = F.array_sort(F.transform(F.col("pii"), lambda s: F.struct(s["start"], s["end"], s["kind"])))

    last = lambda a: F.try_element_at(a, F.lit(-1))

    def merge(acc: Column, s: Column) -> Column:
        joined = F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], s["end"]).alias("end"), last(acc)["kind"].alias("kind"))
        return F.when(
            last(acc)["end"] > s["start"], F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))
        ).otherwise(F.concat(acc, F.array(s)))

    spans_type = "array<struct<start:int,end:int,kind:string>>"
    merged = F.aggregate(by_start.cast(spans_type), F.array().cast(spans_type), lambda a, s: merge(a, s).cast(spans_type))

    def rebuilt(m: Column) -> Column:
        before = F.zip_with(
            m,
            F.concat(F.array(F.lit(0)), F.transform(F.slice(m, F.lit(1), F.greatest(F.size(m) - 1, F.lit(0))), lambda s: s["end"])),
            lambda s, prev: F.concat(
                F.substring(F.col(text), prev + 1, s["start"] - prev), F.lit("["), F.upper(s["kind"]), F.lit("]")
            ),
        )
        tail = F.substring(F.col(text), last(m)["end"] + 1, F.length(F.col(text)))
        return F.concat(F.array_join(before, ""), tail)

    return found.withColumn(text, F.when(F.size("pii") > 0, let(merged, rebuilt)).otherwise(F.col(text))).drop("pii")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "pii")
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("pii", lambda s: s["kind"].isin([k.name for k in KINDS if k.base]))
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"),
    )
