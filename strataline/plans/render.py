"""Summaries as an aligned table, JSON, and the list of unknown formats."""

from __future__ import annotations

import json

from ..operators.summarize import Summary

HEADS = ("Language", "Files", "Lines", "Blank", "Comment", "Code")
_BOLD_CYAN, _DIM, _BLUE, _BOLD_GREEN, _BOLD_YELLOW, _END = "\x1b[1;36m", "\x1b[2m", "\x1b[34m", "\x1b[1;32m", "\x1b[1;33m", "\x1b[0m"


def table(summary: Summary, color: bool = False) -> str:
    """Header, rule, rows, rule and total; names to the left, numbers to the right."""
    cells = [(str(name), *(f"{x:,}" for x in numbers)) for name, *numbers in [*summary.languages, ("Total", *summary.total)]]
    widths = [max(len(row[k].encode()) for row in (HEADS, *cells)) for k in range(len(HEADS))]

    def line(row: tuple) -> str:
        return " ".join([row[0].ljust(widths[0]), *(x.rjust(w) for x, w in zip(row[1:], widths[1:], strict=True))])

    rule = (" ".join("-" * w for w in widths), _DIM)
    out = [(line(HEADS), _BOLD_CYAN), rule, *((line(row), _BLUE) for row in cells[:-1]), rule, (line(cells[-1]), _BOLD_GREEN)]
    return "".join(f"{style}{text}{_END}\n" if color else f"{text}\n" for text, style in out)


def _numbers(row: tuple) -> dict:
    files, lines, blanks, comments, code = row
    return {"files": files, "lines": lines, "comments": comments, "blanks": blanks, "code": code}


def as_json(summary: Summary) -> str:
    """Two-space indented JSON; unknown formats aren't part of it."""
    rows = [{"language": name, **_numbers(tuple(numbers))} for name, *numbers in summary.languages]
    return json.dumps({"languages": rows, "total": _numbers(summary.total)}, indent=2, ensure_ascii=False) + "\n"


def formats(summary: Summary, color: bool = False) -> str:
    """Unknown formats, or nothing where there are none."""
    if not summary.formats:
        return ""
    title = "Unknown file formats:"
    head = f"\n{_BOLD_YELLOW}{title}{_END}\n" if color else f"\n{title}\n"
    return head + "".join(f"  {name:<24} {f'{files:,}':>8}\n" for name, files in summary.formats)
