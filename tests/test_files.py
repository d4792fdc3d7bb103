"""Counting and detection cases, and the fold against a plain model."""

import random
import re

import pytest

from strataline import catalog
from strataline.functions.text import PREFIX_BYTES
from strataline.operators import summarize

WHITE = b" \t\n\f\r"


def model(raw, language):
    """(lines, blanks, comments, code): each line is matched against one expression of all that may stand at its start."""
    closes = {a.encode(): b.encode() for a, b in reversed(language.block_comments)}
    opening = re.compile(b"|".join(re.escape(a.encode()) for a, _ in language.block_comments) or b"(?!)")
    marks = tuple(m.encode() for m in language.line_comments)
    rows = [t.lstrip(WHITE) for t in raw.removesuffix(b"\n").split(b"\n")] if raw else []
    within, seen = [], None

    def after(rest, close):
        """The close that is still looked for at the end of a line, by taking off one comment after another."""
        while close:
            _, found, rest = rest.partition(close)
            if not found:
                return close
            rest = rest.lstrip(WHITE)
            opened = opening.match(rest)
            close, rest = (closes[opened[0]], rest[opened.end() :]) if opened else (None, rest)
        return None

    for t in rows:
        opened = None if seen or t.startswith(marks) else opening.match(t)
        within.append("" if not t else "comment" if seen or opened or t.startswith(marks) else "code")
        if t and (seen or opened):
            seen = after(t if seen else t[opened.end() :], seen or closes[opened[0]])
    return (len(rows), *(within.count(k) for k in ("", "comment", "code")))


def run(spark, files, own=None):
    frame = spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary")
    return {r.path: r for r in summarize.per_file(frame, own).collect()}


CASES = [
    ("a.rs", b"let a = 1;", (1, 0, 0, 1)),
    ("b.rs", b"use a::b;\n// one\n\n/* two\n   three */\n", (5, 1, 3, 1)),
    ("c.css", b"/* a\nb */ /* c\n\n*/\np {}\n", (5, 1, 3, 1)),
    ("d.rs", b"// " + b"z" * 80_000 + b"\nuse a;\n", (2, 0, 1, 1)),
    ("e.rs", b"use a;\n\0", None),
    ("f.rs", b"y" * (PREFIX_BYTES - 1) + "ß\n\n".encode(), (2, 1, 0, 1)),
    ("g.rs", b"", (0, 0, 0, 0)),
    ("h.rs", b"\n", (1, 1, 0, 0)),
    ("i.rs", b"a\rb\r\n\r\n", (2, 1, 0, 1)),
    ("j.rs", b"\x0b\n\x0c\n", (2, 1, 0, 1)),
    ("k.rs", b"/*\n\n*/\n", (3, 1, 2, 0)),
    ("l.rs", b"x = 1; /* open\ny\n", (2, 0, 0, 2)),
    ("m.rs", b"/* a */ code\nb\n", (2, 0, 1, 1)),
    ("n.rs", b"/* a */ b /* c\nd\n", (2, 0, 1, 1)),
    ("o.rs", b"/* a */ /* b\nc */ d\ne\n", (3, 0, 2, 1)),
    ("p.py", b'"""doc"""\nx = """\ny\n"""\nz\n', (5, 0, 3, 2)),
    ("q.lua", b"--[[ a\nb\n]]\n", (3, 0, 1, 2)),
    ("r.cmake", b"#[[ a\nb\n]]\n", None),
    ("CMakeLists.txt", b"#[[ a\nb\n]]\n", (3, 0, 1, 2)),
    ("s.hbs", b"{{!-- a }} b --}}\nc\n", (2, 0, 1, 1)),
    ("t.f90", b"call foo\nx = 1\n", (2, 0, 1, 1)),
    ("u.bat", b"REMOVE x\nrem y\n", (2, 0, 1, 1)),
    ("v.gradle", b"/* a */ // x\ny\n1\nz\n", (4, 0, 3, 1)),
    ("w.html", b"<p>\n<!-- a\nb --> <i>\n</p>\n", (4, 0, 2, 2)),
    ("x.rs", b"\xef\xbb\xbf// c\n// d\n", (2, 0, 1, 1)),
    ("y.ml", b"(* a (* b *)\nc *)\nd\n", (3, 0, 1, 2)),
    ("late.rs", b"y" * PREFIX_BYTES + b"\0\xff\n", (1, 0, 0, 1)),
    ("bad.rs", b"\xff\n", None),
    ("surrogate.rs", b"x" * (PREFIX_BYTES - 2) + b"\xed\xa0", None),
    ("cut.rs", b"x" * (PREFIX_BYTES - 2) + b"\xed\x9f\x80", (1, 0, 0, 1)),
    ("cut_at_end.rs", b"ab\xe2\x82", (1, 0, 0, 1)),
    ("four.rs", b"x" * (PREFIX_BYTES - 3) + "🙂".encode(), (1, 0, 0, 1)),
]


def test_line_cases(spark):
    got = run(spark, [(p, c) for p, c, _ in CASES])
    for path, _, want in CASES:
        if want is None and path != "r.cmake":
            assert path not in got
        elif want is not None:
            r = got[path]
            assert (r.files, r.lines, r.blanks, r.comments, r.code) == (1, *want), path


NAMES = [
    ("Dockerfile", "", "Dockerfile"), ("d/Makefile", "", "Makefile"), ("app.yaml.in", "a: [b]\n", "YAML"), ("LIB.RS", "use a;\n", "Rust"),
    ("area.m", "% of a circle\nclassdef Circle\nend\n", "MATLAB"), ("view.m", "#  import \"View.h\"\n@implementation View\n", "Objective-C"),
    ("point.v", "import math\npub struct Point {\n", "V"), ("adder.v", "module adder(a, b);\nassign c = a;\nendmodule\n", "Verilog"), ("x.m", "z", "MATLAB"),
    ("run", "#!/usr/bin/env python3\n", "Python"), ("run2", "#!/home/ubuntu/bin/sh\n", "JavaScript"), ("a.rb", "#!/usr/bin/ruby\n", "Ruby"), ("makefile", "x", None), ("LICENSE.md", "x", "Text"),
    ("Dockerfile.py", "x", "Dockerfile"), ("x.kts", "x", "Kotlin"), ("b.gradle.kts", "x", "Kotlin"), ("a.h", "x", "C/C++ Header"), ("a.vue", "x", "Vuejs Component"), ("a.less", "x", "LESS"),
    (".gitignore", "x", None), ("foo.", "x", None), ("a.build.xml", "x", "XML"), ("K.rs", "x", "Rust"), ("a.Kt", "x", None), ("BUILD", "x", "Bazel"), ("foo-pattern", "x", "Text"),
    ("x.fish", "#!/usr/bin/fish\n", "Shell"), ("z.rs", "﻿#!/usr/bin/env python\n", "Rust"), ("q.m", "x\r  function y\n", "MATLAB"), ("sub.dir/noext", "x", None),
]


def test_detection_cases(spark):
    got = run(spark, [(p, t.encode()) for p, t, _ in NAMES])
    assert {p: got[p].language for p, _, _ in NAMES} == {p: want for p, _, want in NAMES}
    assert got[".gitignore"].unknown_format == ".gitignore" and got["foo."].unknown_format == "." and got["makefile"].unknown_format == "makefile"


def test_fold_equals_the_model_for_every_marker_set(spark):
    rng, files, want = random.Random(2), [], {}
    own = catalog.builtin()
    seen = set()
    for k, language in enumerate(own.languages):
        key = (language.line_comments, language.block_comments)
        if key in seen:
            continue
        seen.add(key)
        tokens = [" ", "\n", "\n", "\t", "\x0b", "x", "1", "\r", "\xff", *language.line_comments, *(t for p in language.block_comments for t in p)] + [t for p in language.block_comments for t in p]
        for j in range(25):
            raw = "".join(rng.choice(tokens) for _ in range(rng.randint(0, 60))).encode("utf-8")
            path = f"{k}-{j}.{k}x"
            files.append((path, raw))
            want[path] = model(raw, language)
    named = catalog.Catalog(tuple(catalog.Language(x.name, (f"{k}x",), x.line_comments, x.block_comments) for k, x in enumerate(own.languages)))
    got = run(spark, files, named)
    for path, _ in files:
        r = got[path]
        assert (r.lines, r.blanks, r.comments, r.code) == want[path], path
        assert r.lines == r.blanks + r.comments + r.code


def test_partitions_do_not_matter_and_texts_are_files(spark):
    frame = spark.createDataFrame([(f"{k}.rs", "// a\nb\n" * k) for k in range(40)], "path string, text string")
    sums = [sorted(map(tuple, summarize.by_language(summarize.per_file(frame.repartition(n))).collect())) for n in (1, 7)]
    assert sums[0] == sums[1] == [("Rust", 40, 1560, 0, 780, 780)]


def test_no_blow_up_on_one_long_line(spark):
    got = run(spark, [("a.rs", b"/* a */ " * 20_000 + b"\n"), ("b.rs", b"/*" + b"x" * 2_000_000 + b"*/\n")])
    assert got["a.rs"].comments == got["b.rs"].comments == 1


def test_catalog_folder(tmp_path):
    (tmp_path / "languages").mkdir()
    (tmp_path / "languages" / "b.toml").write_text('[[languages]]\nname = "B"\nextensions = ["x"]\nline_comments = ["#"]\nblock_comments = [["(", ")"]]\n')
    (tmp_path / "languages" / "a.toml").write_text('[[languages]]\nname = "A"\nextensions = ["X"]\nline_comments = []\nblock_comments = []\n[[languages.disambiguation]]\nregex = "q"\nscore = 5\n')
    (tmp_path / "files.toml").write_text('[[filenames]]\nname = "N"\nlanguage = "B"\n')
    own = catalog.load(tmp_path)
    assert own.ids == {"A": 0, "B": 1} and own.by_extension == {"x": [0, 1]} and own.exact == (("N", "B"),) and own.languages[0].rules == (("q", 5),)
    (tmp_path / "files.toml").write_text('[[filename_suffixes]]\nsuffix = "N"\nlanguage = "C"\n')
    with pytest.raises(ValueError, match="unknown language"):
        catalog.load(tmp_path)
