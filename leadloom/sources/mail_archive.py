"""Raw mail and page markup: stateful parsers of the standard library inside mapInPandas."""

from __future__ import annotations

import email
import email.policy
import hashlib
import json
from collections.abc import Iterator
from email.message import Message
from html.parser import HTMLParser
from urllib.parse import parse_qs

import pandas as pd
from pyspark.sql import DataFrame

MAX_DEPTH, MAX_EVENTS, MAX_CHARS, MAX_LINKS = 400, 400_000, 1_000_000, 200
BLOCKS = {"p", "div", "br", "li", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "article", "section"}
VOID = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}
SKIPPED = {"script", "style", "head", "title"}
MESSAGE = "record_id string, message_id string, from_name string, from_addr string, to_addrs array<string>, subject string, body string, hidden_text string, links array<string>, attachments array<struct<filename:string,content_type:string,size:int>>, truncated boolean, error string"
PAGE = "page_id long, text string, hidden_text string, links array<string>, truncated boolean"


class VisibleText(HTMLParser):
    """Splits markup into visible text, hidden text and links; bounded in depth, events and length."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.seen, self.hidden, self.links = [], [], []
        self.stack: list[tuple[str, bool, bool]] = []  # tag, skipped, hidden: each with what is above it
        self.events = self.length = 0
        self.truncated = False

    def handle_starttag(self, tag, attrs):
        self.events += 1
        if self.events > MAX_EVENTS or len(self.stack) >= MAX_DEPTH:
            self.truncated = True
            return
        given = dict(attrs)
        style = (given.get("style") or "").replace(" ", "").lower()
        skipped, hidden = (self.stack[-1][1], self.stack[-1][2]) if self.stack else (False, False)
        hidden |= "hidden" in given or "display:none" in style or "visibility:hidden" in style or "font-size:0" in style
        if tag == "a" and given.get("href") and len(self.links) < MAX_LINKS:
            self.links.append(given["href"])
        if tag in BLOCKS:
            self.seen.append("\n")
        if tag not in VOID:
            self.stack.append((tag, skipped or tag in SKIPPED, hidden))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, max(-1, len(self.stack) - 20), -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break
        if tag in BLOCKS:
            self.seen.append("\n")

    def handle_data(self, data):
        if self.length + len(data) > MAX_CHARS:
            self.truncated = True
            return
        self.length += len(data)
        skipped, hidden = (self.stack[-1][1], self.stack[-1][2]) if self.stack else (False, False)
        if not skipped:
            (self.hidden if hidden else self.seen).append(data)


def squeeze(parts: list[str]) -> str:
    lines = (" ".join(x.split()) for x in "".join(parts).split("\n"))
    return "\n".join(x for x in lines if x)


def visible(html: str | None) -> tuple[str, str, list[str], bool]:
    reader = VisibleText()
    reader.feed(html or "")
    reader.close()
    return squeeze(reader.seen), squeeze(reader.hidden), reader.links, reader.truncated


def page_texts(pages: DataFrame) -> DataFrame:
    """Visible and hidden text and links of each page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *visible(h)) for i, h in zip(batch["page_id"], batch["html"], strict=True)]
            yield pd.DataFrame(rows, columns=["page_id", "text", "hidden_text", "links", "truncated"])

    return pages.select("page_id", "html").mapInPandas(run, PAGE)


def parse_message(raw: bytes) -> dict:
    """One message: plain text is preferred, else the HTML part's visible text; attachments are measured only."""
    message = email.message_from_bytes(raw, policy=email.policy.compat32)
    plain, html, attached = [], [], []

    def walk(part: Message, depth: int) -> None:
        kind = part.get_content_type()
        if kind == "message/rfc822" and depth >= 2:
            return
        if part.is_multipart():
            for child in part.get_payload():
                walk(child, depth + (kind == "message/rfc822"))
            return
        body = part.get_payload(decode=True) or b""
        if part.get_filename() or part.get_content_disposition() == "attachment":
            attached.append({"filename": part.get_filename() or "", "content_type": kind, "size": len(body)})
        elif kind in ("text/plain", "text/html"):
            try:
                text = body.decode(part.get_content_charset() or "utf-8", "replace")
            except LookupError:
                text = body.decode("utf-8", "replace")
            (plain if kind == "text/plain" else html).append(text)

    walk(message, 0)
    shown, hidden, links, truncated = visible("\n".join(html))
    given = " ".join(str(message.get("Message-ID") or "").split()).strip("<>").lower()
    header = lambda name: str(email.header.make_header(email.header.decode_header(str(message.get(name) or ""))))
    name, addr = email.utils.parseaddr(header("From"))
    return {
        "message_id": f"<{given}>" if given else f"<sha256-{hashlib.sha256(raw).hexdigest()}@none>", "from_name": name, "from_addr": addr.lower(), "to_addrs": [a for _, a in email.utils.getaddresses([header("To")]) if a],
        "subject": " ".join(header("Subject").split()), "body": "\n".join(plain).strip() or shown, "hidden_text": hidden, "links": links, "attachments": attached, "truncated": truncated, "error": None,
    }


def parse_mail(raw: DataFrame, record_id: str = "path", content: str = "content") -> DataFrame:
    """The message table of raw mails; a mail that cannot be read keeps its row, with the error."""
    import email.header  # noqa: F401
    import email.utils  # noqa: F401

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, body in zip(batch["_id"], batch["_raw"], strict=True):
                try:
                    rows.append({"record_id": key, **parse_message(bytes(body or b""))})
                except Exception as wrong:  # noqa: BLE001  one bad mail must not lose the others
                    rows.append({"record_id": key, "error": type(wrong).__name__})
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ("record_id message_id from_name from_addr to_addrs subject body hidden_text links attachments truncated error").split()])

    return raw.selectExpr(f"cast({record_id} as string) _id", f"{content} _raw").mapInPandas(run, MESSAGE)


def payload_to_mime(content_type: str, body: bytes) -> tuple[bytes | None, str | None]:
    """Raw mail of a webhook's payload, or the reason why there is none."""
    kind = (content_type or "").split(";")[0].strip().lower()
    if kind == "message/rfc822":
        return body, None
    if kind == "application/x-www-form-urlencoded":
        fields = parse_qs(body.decode("utf-8", "replace"))
        for key in ("body-mime", "email"):
            if fields.get(key):
                return fields[key][0].encode(), None
        return None, "form_without_mail"
    if kind == "application/json":
        try:
            given = json.loads(body)
        except ValueError:
            return None, "bad_json"
        if not isinstance(given, dict) or not given.get("From"):
            return None, "json_without_sender"
        if given.get("RawEmail"):
            return str(given["RawEmail"]).encode(), None
        head = "".join(f"{h}: {str(given.get(k) or '').splitlines()[0] if given.get(k) else ''}\r\n" for h, k in (("From", "From"), ("To", "To"), ("Subject", "Subject"), ("Message-ID", "MessageID")))
        return f"{head}Content-Type: text/plain; charset=utf-8\r\n\r\n{given.get('TextBody') or ''}".encode(), None
    return None, "unknown_content_type"


def webhook_mails(payloads: DataFrame) -> DataFrame:
    """record_id, content (raw mail or null) and reason, of rows record_id, content_type, body."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [payload_to_mime(t, bytes(b or b"")) for t, b in zip(batch["content_type"], batch["body"], strict=True)]
            yield pd.DataFrame({"record_id": batch["record_id"], "content": [o[0] for o in out], "reason": [o[1] for o in out]})

    return payloads.mapInPandas(run, "record_id string, content binary, reason string")
