"""Column functions on file names, bytes and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes that decide whether a file is text and what its content rules see.
PREFIX_BYTES = 16 * 1024
WHITE = " \t\n\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The beginning of a UTF-8 character, cut short, as hexadecimal digits of its bytes.
_CUT = "^(?:C[2-9A-F]|D[0-9A-F]|E[0-9A-F]|F[0-4]|E0[AB][0-9A-F]|E[1-9A-CEF][89AB][0-9A-F]|ED[89][0-9A-F]|F0[9AB][0-9A-F]|F[1-3][89AB][0-9A-F]|F48[0-9A-F]|F0[9AB][0-9A-F][89AB][0-9A-F]|F[1-3](?:[89AB][0-9A-F]){2}|F48[0-9A-F][89AB][0-9A-F])$"


def ascii_lower(col: Column) -> Column:
    return F.translate(col, _UPPER, _LOWER)


def trim_start(col: Column) -> Column:
    """Without leading ASCII white space (vertical tab isn't)."""
    return F.ltrim(col, F.lit(WHITE))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(name: Column) -> Column:
    """After the last dot; null if there is none, or only a leading one."""
    return F.when(name.rlike(r"(?s)^.+\.[^.]*$") & (name != ".."), F.substring_index(name, ".", -1))


def prefix(content: Column) -> Column:
    return F.substring(content, 1, PREFIX_BYTES)


def is_text(first: Column) -> Column:
    """No NUL among the first bytes, which are UTF-8 but for a character cut at their end."""
    n = F.octet_length(first)
    whole = F.is_valid_utf8(first.cast("string"))
    cut = [F.is_valid_utf8(F.substring(first, F.lit(1), n - k).cast("string")) & F.hex(F.substring(first, n - k + 1, F.lit(k))).rlike(_CUT) & (n >= k) for k in (1, 2, 3)]
    return (F.locate("\x00", first.cast("string")) == 0) & (whole | cut[0] | cut[1] | cut[2])


def latin1(content: Column) -> Column:
    """Bytes as one character each; markers are ASCII, so they are found as they stand."""
    return F.decode(content, "ISO-8859-1")


def lines(text: Column) -> Column:
    """Lines of a text: only line feeds end one; an empty rest after the last isn't one."""
    split = F.split(text, "\n", -1)
    return F.when(F.element_at(split, -1) == "", F.slice(split, 1, F.size(split) - 1)).otherwise(split)


def unknown_format(name: Column) -> Column:
    """What a file without language is listed under: its extension with a dot, case kept, or its name."""
    return F.coalesce(F.concat(F.lit("."), extension(name)), name)


def grouped(number: Column) -> Column:
    """A whole number with thousands separators."""
    return F.format_number(number, 0)
