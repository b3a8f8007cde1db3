"""WARC derivative builder: responses become linked metadata and plain-text conversion records.

Each response yields one metadata record (application/warc-fields: title, source headers, digests, outlinks) and one
conversion record (text/plain). Both refer to the response by WARC-Refers-To and name each other; the source's URI, date
and payload digest are preserved, and each block carries its own SHA-1 digest in base 32. Only built-in expressions are
used, row by row, so nothing is shuffled.

Defined results: a null payload is an empty one and a null URI or date gives an empty header value; line breaks in header
values are percent-encoded; repeated responses give repeated records with the same identifiers (identifiers derive from the
source's); an empty table gives no records; other columns are not read. As browsers do, a comment, script, style, title or
noscript that never closes reaches to the end of the page. Every expression takes time in proportion to the page, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm._common import let

HEX_DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Character references by name that are decoded, besides numeric ones.
NAMED = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"))
#: Every start of an unseen element ends somewhere, at the page's end at the latest, so that no part is read twice.
UNSEEN = r"(?is)<!--.*?(?:-->|\z)|" + "|".join(rf"<{e}\b[^>]*+(?:>.*?(?:</{e}\s*+>|\z)|\z)" for e in ("script", "style", "title", "noscript"))
BREAKS = r"(?i)</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|article|section|header|footer|nav|main|body|blockquote|pre)\b[^>]*>"


def sha1_base32(block: Column) -> Column:
    """sha1: and the digest in base 32; five bytes at a time are eight digits."""
    part = lambda i: F.lpad(F.conv(F.substring(F.sha1(block.cast("binary")), 1 + 10 * i, 10), 16, 32), 8, "0")
    return F.concat(F.lit("sha1:"), F.translate(F.concat(*[part(i) for i in range(4)]), HEX_DIGITS, BASE32))


def urn(kind: str, source: Column) -> Column:
    """A record identifier that depends on the source record and the kind of derivative alone."""
    h = F.sha1(F.concat(F.lit(f"{kind}|"), source).cast("binary"))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-a"), cut(18, 3), F.lit("-"), cut(21, 12), F.lit(">"))


def decoded(text: Column) -> Column:
    """Numeric, then named references, the ampersand last."""

    def numeric(t: Column) -> Column:
        def put(part: Column, i: Column) -> Column:
            code = F.regexp_extract(part, "^([0-9]{1,7});", 1)
            n = code.try_cast("int")
            valid = (i > 0) & (n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF))
            char = F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "UTF-32")
            return F.when(valid, F.concat(char, F.substring(part, F.length(code) + 2, F.length(part)))).when(i == 0, part).otherwise(F.concat(F.lit("&#"), part))

        return F.when(t.contains("&#"), F.array_join(F.transform(F.split(t, "&#"), put), "")).otherwise(t)

    out = let(text, numeric)
    for name, char in NAMED:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def plain_text(html: Column) -> Column:
    """Visible text: unseen elements go, block tags end lines, other tags vanish, white space is squeezed."""

    def bare(seen: Column) -> Column:
        # behind the last > no tag ends, and before it every one does
        tail = F.substring_index(seen, ">", -1)
        head = F.left(seen, F.length(seen) - F.length(tail))
        return F.concat(F.regexp_replace(F.regexp_replace(head, BREAKS, "\n"), "<[^>]*>", ""), tail)

    squeezed = F.regexp_replace(decoded(let(F.regexp_replace(html, UNSEEN, ""), bare)), r"[ \t\f\r\x0B]+", " ")
    return F.regexp_replace(F.regexp_replace(squeezed, r" ?\n[ \n]*", "\n"), r"^[ \n]+|[ \n]+$", "")


def title_of(html: Column) -> Column:
    return F.trim(F.regexp_replace(decoded(F.regexp_extract(html, r"(?is)<title\b[^>]*+(?:>(.*?)(?:</title|\z)|\z)", 1)), r"[ \t\n\f\r\x0B]+", " "))


def derive(responses: DataFrame) -> DataFrame:
    """responses: record_id, target_uri, warc_date, http_headers, payload (HTML). Two rows for each: metadata, conversion.

    Columns: record_id, warc_type, refers_to, linked_to, target_uri, warc_date, content_type, payload_digest (the source's),
    block_digest, content_length, block and header (the WARC header lines, ending in an empty one).
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    source = responses.select(text("record_id").alias("refers_to"), text("target_uri").alias("target_uri"), text("warc_date").alias("warc_date"), text("http_headers").alias("http"), text("payload").alias("payload"))
    known = source.select(
        "refers_to", "target_uri", "warc_date", "http", sha1_base32(F.col("payload")).alias("payload_digest"), plain_text(F.col("payload")).alias("text"), title_of(F.col("payload")).alias("title"),
        (F.length("payload") - F.length(F.regexp_replace("payload", r"(?i)<a\s", "<a"))).alias("outlinks"), F.octet_length("payload").alias("payload_bytes"), urn("metadata", F.col("refers_to")).alias("mid"), urn("conversion", F.col("refers_to")).alias("cid"),
    )
    fields = F.concat(
        F.lit("title: "), F.col("title"), F.lit("\r\nsourceHeaders: "), F.regexp_replace("http", r"\r\n?|\n", " | "), F.lit("\r\nsourcePayloadDigest: "), F.col("payload_digest"),
        F.lit("\r\nsourcePayloadLength: "), F.col("payload_bytes").cast("string"), F.lit("\r\noutlinks: "), F.col("outlinks").cast("string"), F.lit("\r\nhasConversion: "), F.col("cid"), F.lit("\r\n"),
    )
    one = lambda kind, own, other, mime, block: F.struct(
        F.lit(kind).alias("warc_type"), F.col(own).alias("record_id"), F.col(other).alias("linked_to"), F.lit(mime).alias("content_type"), block.alias("block")
    )
    both = F.array(
        one("metadata", "mid", "cid", "application/warc-fields", fields), one("conversion", "cid", "mid", "text/plain", F.col("text"))
    )
    rows = known.select("refers_to", "target_uri", "warc_date", "payload_digest", F.explode(both).alias("d")).select("refers_to", "target_uri", "warc_date", "payload_digest", "d.*")
    whole = rows.withColumns({"block_digest": sha1_base32(F.col("block")), "content_length": F.octet_length("block").cast("long")})
    lines = [("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Concurrent-To", "linked_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"), ("WARC-Payload-Digest", "payload_digest"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    one_line = lambda c: F.replace(F.replace(F.col(c).cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat(F.lit("WARC/1.1\r\n"), *[F.concat(F.lit(f"{k}: "), one_line(c), F.lit("\r\n")) for k, c in lines], F.lit("\r\n"))
    return whole.withColumn("header", header)


def record_bytes(records: DataFrame) -> DataFrame:
    """Adds record: the bytes of the whole record, ready to be written one after another."""
    return records.withColumn("record", F.concat(F.col("header").cast("binary"), F.col("block").cast("binary"), F.lit("\r\n\r\n").cast("binary")))


def pages_as_responses(pages: DataFrame) -> DataFrame:
    """The page table as response records: identifiers from id and address, a date from the id, the headers of an HTML answer."""
    return pages.select(
        "page_id", urn("response", F.concat_ws("|", F.col("page_id").cast("string"), F.col("url"))).alias("record_id"), F.col("url").alias("target_uri"),
        F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce(F.col("page_id"), F.lit(0)) % 10_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("warc_date"),
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.coalesce(F.octet_length("html"), F.lit(0)).cast("string")).alias("http_headers"), F.col("html").alias("payload"),
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(pages_as_responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))
