"""Language catalog: names, extensions, comment markers, file-name and content rules.

`builtin()` is a catalog of widely used languages; `load(folder)` reads any other from TOML: `languages/*.toml` (in
sorted order) with [[languages]] name, extensions, line_comments, block_comments and optional [[languages.disambiguation]]
regex, score; and `files.toml` with [[filenames]], [[filename_prefixes]] and [[filename_suffixes]]. Ids are positions: the
first language of an ambiguous extension wins unless content rules decide.
"""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from pathlib import Path

from .catalog_data import CONTENT_RULES, EXACT_NAMES, LANGUAGES, NAME_PREFIXES, NAME_SUFFIXES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Language:
    name: str
    extensions: tuple[str, ...] = ()
    line_comments: tuple[str, ...] = ()
    block_comments: tuple[tuple[str, str], ...] = ()
    rules: tuple[tuple[str, int], ...] = ()


@dataclass(frozen=True)
class Catalog:
    languages: tuple[Language, ...]
    exact: tuple[tuple[str, str], ...] = ()
    prefixes: tuple[tuple[str, str], ...] = ()
    suffixes: tuple[tuple[str, str], ...] = ()
    _: dict = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self) -> None:
        names = [x.name for x in self.languages]
        if len(set(names)) != len(names):
            raise ValueError("a language is named twice")
        for pattern, language in (*self.exact, *self.prefixes, *self.suffixes):
            if language not in names:
                raise ValueError(f"unknown language {language!r} in the rule for {pattern!r}")

    @cached_property
    def ids(self) -> dict[str, int]:
        return {x.name: k for k, x in enumerate(self.languages)}

    @cached_property
    def by_extension(self) -> dict[str, list[int]]:
        """Extension in ASCII lower case -> candidate ids in the order of ids."""
        out: dict[str, list[int]] = {}
        for k, language in enumerate(self.languages):
            for extension in language.extensions:
                own = out.setdefault(extension.translate(LOWER), [])
                if k not in own:
                    own.append(k)
        return out

    def count(self) -> int:
        return len(self.languages)


def closed_run(pairs: tuple[tuple[str, str], ...]) -> str:
    """Regular expression (Java) of block comments that open and close one after another; first pair in order wins."""
    tokens = [re.escape(a) for a, _ in pairs]
    arms = ["".join(f"(?!{x})" for x in tokens[:k]) + rf"{tokens[k]}(?>[\s\S]*?{re.escape(b)})[ \t\n\f\r]*" for k, (_, b) in enumerate(pairs)]
    return f"^(?:{'|'.join(arms)})*+" if arms else "^(?!)"


def _pairs(text: str) -> tuple[tuple[str, str], ...]:
    parts = text.split()
    return tuple(zip(parts[::2], parts[1::2], strict=True))


@lru_cache(maxsize=1)
def builtin() -> Catalog:
    rules: dict[str, list[tuple[str, int]]] = {}
    for language, score, regex in CONTENT_RULES:
        rules.setdefault(language, []).append((regex, score))
    out = []
    line: tuple[str, ...] = ()
    block: tuple[tuple[str, str], ...] = ()
    for row in filter(None, map(str.strip, LANGUAGES.splitlines())):
        if row.startswith("== "):
            markers, pairs = re.fullmatch(r"== (.*?) ==(?: (.*))?", row).groups()
            line, block = tuple(x for x in markers.split() if x != "none"), _pairs(pairs or "")
        else:
            name, _, extensions = row.partition(" :")
            out.append(Language(name, tuple(extensions.split()), line, block, tuple(rules.get(name, ()))))
    return Catalog(tuple(out), EXACT_NAMES, NAME_PREFIXES, NAME_SUFFIXES)


def load(folder: str | Path) -> Catalog:
    """A catalog from TOML files; errors in it are raised here."""
    folder, languages = Path(folder), []
    for path in sorted((folder / "languages").glob("*.toml")):
        for x in tomllib.loads(path.read_text(encoding="utf-8"))["languages"]:
            languages.append(Language(x["name"], tuple(x["extensions"]), tuple(x["line_comments"]), tuple((a, b) for a, b in x["block_comments"]), tuple((r["regex"], r["score"]) for r in x.get("disambiguation", ()))))
    files = tomllib.loads((folder / "files.toml").read_text(encoding="utf-8"))
    pick = lambda key, name: tuple((x[name], x["language"]) for x in files.get(key, ()))
    return Catalog(tuple(languages), pick("filenames", "name"), pick("filename_prefixes", "prefix"), pick("filename_suffixes", "suffix"))
