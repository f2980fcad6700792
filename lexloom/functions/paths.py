"""Logical paths, references and media types, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CONTROL

LONGEST_REFERENCE = 4096


def safe_path(path: Column) -> Column:
    """Whether a logical path is relative, printable and free of empty, `.` and `..` segments."""
    bad = path.rlike(CONTROL) | path.rlike(r"^[/\\]|\\|^[A-Za-z]:")
    return F.coalesce((path != "") & ~bad & F.forall(F.split(path, "/"), lambda s: ~s.isin("", ".", "..")), F.lit(False))


def resource_key(path: Column) -> Column:
    """The key of a logical path in a resource volume; null if the path isn't safe. No case or Unicode folding."""
    return F.when(safe_path(path), F.concat(F.lit("\\"), F.array_join(F.split(path, "/"), "\\")))


def package_path(path: Column) -> Column:
    """A package file's path in POSIX form; null if it isn't safe."""
    posix = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(safe_path(posix), posix)


def extension(path: Column) -> Column:
    """The lower-case extension; a numbered volume `.N.mdd` is `.mdd`."""
    name = F.lower(F.substring_index(path, "/", -1))
    return F.when(name.rlike(r"\.\d+\.mdd$"), ".mdd").otherwise(F.regexp_extract(name, r"[^.](\.[^.]*)$", 1))


def decoded_reference(value: Column) -> Column:
    """A reference percent-decoded; null if empty, too long, or not well-formed."""
    well = value.rlike("^(?:[^%]|%[0-9A-Fa-f]{2})*$")
    plus = F.replace(value, F.lit("+"), F.lit("%2B"))
    decoded = F.when((value != "") & (F.char_length(value) <= LONGEST_REFERENCE) & well, F.try_url_decode(plus))
    # Bytes that aren't UTF-8 are decoded to the replacement character.
    return F.when(~decoded.contains("\ufffd") | value.contains("\ufffd"), decoded)


def resource_reference(value: Column, root_relative: bool) -> Column:
    """The logical path that a reference names; null if there is none. root_relative: one leading slash is allowed."""
    decoded = decoded_reference(value)
    decoded = F.when(~decoded.startswith("//"), decoded)
    if root_relative:
        decoded = F.when(decoded.startswith("/"), F.substring(decoded, F.lit(2), F.length(decoded))).otherwise(decoded)
        decoded = F.when(~decoded.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), decoded)
    return F.when(safe_path(decoded), decoded)


def entry_reference(value: Column) -> Column:
    decoded = decoded_reference(value)
    return F.when((F.trim(decoded) != "") & ~decoded.rlike(CONTROL), decoded)


def content_type(content: Column) -> Column:
    """The media type by leading bytes."""
    h = F.hex(F.substring(content, 1, 12))
    return (
        F.when(h.startswith("4F676753"), "audio/ogg")
        .when(h.startswith("89504E470D0A1A0A"), "image/png")
        .when(h.startswith("FFD8FF"), "image/jpeg")
        .when(h.startswith("474946383761") | h.startswith("474946383961"), "image/gif")
        .when(h.rlike("^52494646.{8}57454250"), "image/webp")
        .otherwise("application/octet-stream")
    )


def is_mp3(content: Column) -> Column:
    h = F.hex(F.substring(content, 1, 3))
    return h.startswith("494433") | h.rlike("^FF[EF]")


def is_ogg_speex(content: Column) -> Column:
    """An Ogg page of version 0 whose first packet, after 27 bytes and the segment table, names the Speex codec."""
    segments = F.conv(F.hex(F.substring(content, 27, 1)), 16, 10).cast("int")
    start = F.coalesce(segments, F.lit(0)) + 28
    return F.hex(F.substring(content, 1, 5)).eqNullSafe("4F67675300") & (F.hex(F.substring(content, start, F.lit(8))) == "5370656578202020")


def volume_order(path: Column) -> list[Column]:
    """Sort keys of resource volumes: stem, the base volume before numbered ones, then path."""
    number = F.regexp_extract(path, r"\.(\d+)\.mdd$", 1)
    stem = F.regexp_replace(path, r"(?:\.\d+)?\.mdd$", "")
    return [stem, F.when(number == "", 0).otherwise(number.try_cast("bigint") + 1), path]
