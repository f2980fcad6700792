"""Sanitising of entry HTML, in Arrow batches: an allow-list, inert markers for inner references, and plain text."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import each

# What may stay of an entry's markup.
TAGS = frozenset("a b br div em i li ol p span strong sub sup u ul".split())
ATTRIBUTES = {"a": {"href", "title"}, "span": {"class"}, "div": {"class"}, "p": {"class"}}
EVERYWHERE = {"lang"}
MARKERS = ("data-mdict-kind", "data-mdict-resource", "data-mdict-entry-target")
SCHEMES = re.compile(r"(?:https?|mailto):", re.I)
#: Elements that go with all they hold.
DROPPED = frozenset({"script", "style", "textarea", "option"})
VOID = frozenset({"br", "img", "hr", "input", "meta", "link", "col", "area", "base", "embed", "source", "track", "wbr"})
CONTROL = re.compile(r"[\x00-\x1f\x7f]")
LONGEST = 4096


def decoded(reference: str) -> str | None:
    """A reference percent-decoded; None if empty, too long, or not well-formed."""
    if not reference or len(reference) > LONGEST or re.search(r"%(?![0-9A-Fa-f]{2})", reference):
        return None
    try:
        return unquote_to_bytes(reference).decode("utf-8")
    except UnicodeDecodeError:
        return None


def resource(reference: str, root_relative: bool) -> str | None:
    path = decoded(reference)
    if path is None or path.startswith("//"):
        return None
    if root_relative:
        path = path.removeprefix("/")
        if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
            return None
    if not path or CONTROL.search(path) or path[0] in "/\\" or "\\" in path or re.match("[A-Za-z]:", path):
        return None
    return None if any(s in ("", ".", "..") for s in path.split("/")) else path


def entry_target(reference: str) -> str | None:
    target = decoded(reference)
    return None if target is None or not target.strip() or CONTROL.search(target) else target


class _Sanitizer(HTMLParser):
    """Writes the allowed markup; open elements are closed at the end. trusted: markers in the input are our own."""

    def __init__(self, trusted: bool = False):
        super().__init__(convert_charrefs=True)
        self.trusted, self.out, self.open, self.mute, self.sound = trusted, [], [], 0, 0

    def _attributes(self, tag: str, attrs: list[tuple[str, str | None]]) -> dict[str, str]:
        allowed = ATTRIBUTES.get(tag, set()) | EVERYWHERE | (set(MARKERS) if self.trusted and tag == "span" else set())
        kept: dict[str, str] = {}
        for name, value in attrs:
            if name in allowed and name not in kept and (name != "href" or SCHEMES.match((value or "").strip())):
                kept[name] = value or ""
        return kept

    def _write(self, tag: str, attrs: dict[str, str]) -> None:
        shown = "".join(f' {k}="{html.escape(v, quote=False).replace(chr(34), "&quot;")}"' for k, v in attrs.items())
        self.out.append(f"<{tag}{shown} />" if tag in VOID else f"<{tag}{shown}>")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.mute:
            self.mute += tag in DROPPED
            return
        if tag in DROPPED:
            self.mute = 1
            return
        given = dict(reversed(attrs))
        closing, kept = "", None
        if tag == "img":
            path = None if self.sound or self.trusted else resource(given.get("src") or "", True)
            if path:
                self._write("span", {MARKERS[0]: "image", MARKERS[1]: path})
                self.out.append("</span>")
            return
        kind = None
        if tag == "a":
            href = given.get("href") or ""
            if m := re.match("sound://(.*)$", href, re.I):
                if path := resource(m[1], False):
                    closing, kept, kind = "span", {MARKERS[0]: "sound", MARKERS[1]: path}, "sound"
            elif m := re.match("entry://(.*)$", href, re.I):
                if target := entry_target(m[1]):
                    closing, kept = "span", {MARKERS[0]: "entry", MARKERS[2]: target}
        if kept is None and tag in TAGS:
            closing, kept = tag, self._attributes(tag, attrs)
        if kept is not None:
            self._write(closing, kept)
        if tag not in VOID:
            self.open.append((tag, closing if kept is not None else "", kind))
            self.sound += kind == "sound"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.mute:
            self.mute -= tag in DROPPED
            return
        if any(t == tag for t, _, _ in self.open):
            while self.open:
                t, closing, kind = self.open.pop()
                self.sound -= kind == "sound"
                if closing:
                    self.out.append(f"</{closing}>")
                if t == tag:
                    break

    def handle_data(self, data: str) -> None:
        if not self.mute:
            self.out.append(html.escape(data, quote=False))

    def result(self) -> str:
        self.close()
        while self.open:
            closing = self.open.pop()[1]
            if closing:
                self.out.append(f"</{closing}>")
        return "".join(self.out)


def transform_references(raw: str) -> str:
    """Allowed markup with sounds, images and entry links as inert markers; markers in the input are forged and go."""
    parser = _Sanitizer()
    parser.feed(raw)
    return parser.result()


def sanitize(raw: str) -> str:
    """The transformed markup under the allow-list once more."""
    parser = _Sanitizer(trusted=True)
    parser.feed(transform_references(raw))
    return parser.result()


class _Text(HTMLParser):
    """Keeps the text, escaped."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.mute = [], 0

    def handle_starttag(self, tag, attrs):
        self.mute += tag in DROPPED

    def handle_endtag(self, tag):
        self.mute -= bool(self.mute) and tag in DROPPED

    def handle_data(self, data):
        if not self.mute:
            self.out.append(html.escape(data, quote=False))


BLOCK_TAG = re.compile(r"</?(?:br|p|div|li|tr|h[1-6])\b[^>]*>", re.I)


def plain_text(markup: str) -> str:
    """The text, blocks apart, white space made single spaces; entities stay escaped as the sanitiser writes them."""
    parser = _Text()
    parser.feed(BLOCK_TAG.sub(" ", markup))
    parser.close()
    return " ".join("".join(parser.out).split())


@F.arrow_udf(StringType())
def sanitized(values: pa.Array) -> pa.Array:
    return each(sanitize, values)


@F.arrow_udf(StringType())
def plain(values: pa.Array) -> pa.Array:
    return each(plain_text, values)


def plain_text_column(markup):
    """The same for well-formed markup, without leaving the JVM."""
    apart = F.regexp_replace(markup, r"(?i)</?(?:br|p|div|li|tr|h[1-6])\b[^>]*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(apart, "<[^>]*>", ""), r"\s+", " "))
