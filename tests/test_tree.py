"""Source trees, ignore rules, output and the command line."""

import json
import os
import random
import shutil
import subprocess

import pytest

from strataline import cli
from strataline.operators.summarize import Summary, summarize
from strataline.plans import render
from strataline.sources import ignore, tree


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "tree"
    for name, text in {"a.rs": "fn a() {}\n", "__init__.py": "", "_x.py": "x = 1\n", ".hidden.py": "x\n", "sub/empty.py": "", "sub/bin.rs": "a\0b", "sub/.hid/z.py": "x\n", ".gitignore": "*.log\n!keep.log\n", "x.log": "l\n", "keep.log": "k\n", "odd": "o\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / ".git").mkdir()
    os.symlink(root / "a.rs", root / "link.rs")
    os.symlink(root / "sub", root / "linked")
    return root


def names(root, use_git=True):
    return sorted(os.path.relpath(p, root) for p in ignore.walk(root, use_git))


def test_walk(folder):
    base = ["__init__.py", "_x.py", "a.rs", "keep.log", "odd", "sub/bin.rs", "sub/empty.py"]
    assert names(folder) == sorted(base)
    assert names(folder, False) == sorted([*base, "x.log"])
    (folder / ".ignore").write_text("odd\n")
    assert "odd" not in names(folder, False)
    shutil.rmtree(folder / ".git")
    assert "x.log" in names(folder)


def test_patterns_agree_with_git(tmp_path):
    if not shutil.which("git"):
        pytest.skip("no git")
    rng = random.Random(6)
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    parts = ["a", "b", "ab", "c.o", "d.txt", "x y"]
    files = sorted({"/".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(60)})
    files = [f for f in files if not any(g.startswith(f + "/") for g in files)]
    for f in files:
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text("")
    globs = ["a", "/a", "a/", "*.o", "**/b", "a/**", "a/**/b", "!c.o", "!a/", "*", "?b", "[a-b]", "[!a]", "/b/*", "!/b/d.txt", "x\\ y", "# c", "", "d.*", "b/", "ab/**", "*/a"]
    for _ in range(40):
        (tmp_path / ".gitignore").write_text("\n".join(rng.choice(globs) for _ in range(rng.randint(1, 5))))
        deep = tmp_path / "a"
        if deep.is_dir():
            (deep / ".gitignore").write_text("\n".join(rng.choice(globs) for _ in range(rng.randint(0, 2))))
        shown = subprocess.run(["git", "-c", "core.quotePath=false", "ls-files", "-o", "--exclude-standard"], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split("\n")
        want = sorted(x for x in shown if x and not x.endswith(".gitignore"))
        assert names(tmp_path) == want, (tmp_path / ".gitignore").read_text()


def test_source_reads_trees_and_single_files(spark, folder):
    got = summarize(tree.read_tree(spark, str(folder)), verbose=True)
    assert got.languages == [("Unknown", 2, 2, 0, 0, 2), ("Python", 3, 1, 0, 0, 1), ("Rust", 1, 1, 0, 0, 1)]  # most code first, then by name
    assert got.total == (6, 4, 0, 0, 4) and got.formats == [(".log", 1), ("odd", 1)]
    assert summarize(tree.read_tree(spark, str(folder), all_files=True)).total[0] == 7
    assert summarize(tree.read_tree(spark, str(folder / ".hidden.py"))).languages == [("Python", 1, 1, 0, 0, 1)]
    assert summarize(tree.read_tree(spark, str(folder / "sub" / "bin.rs"))).total == (0,) * 5


def test_large_trees_are_dealt_by_size(tmp_path):
    paths = []
    for k in range(200):
        (tmp_path / f"{k}.rs").write_text("x" * 100)
        paths.append(str(tmp_path / f"{k}.rs"))
    assert tree.dealt(paths[:128], None) == [paths[:128]] and tree.dealt(paths, 0) == [paths] and tree.dealt([], 4) == []
    parts = tree.dealt(paths, 4)
    assert 4 <= len(parts) <= 5 and [p for x in parts for p in x] == paths


def test_unreadable_files_fail_the_whole_scan(spark, folder):
    reader = tree.TreeReader({"path": str(folder)})
    part = reader.partitions()[0]
    os.remove(folder / "a.rs")
    with pytest.raises(OSError):
        list(reader.read(part))


def test_rendering():
    """The layout of the table, the JSON and the report."""
    summary = Summary([("Rust", 1200, 12345678, 0, 1, 300), ("Unknown", 1, 3, 1, 1, 1)], (1201, 12345681, 1, 2, 301), [(".xyz", 1000), ("odd", 1)])
    assert render.table(summary) == (
        "Language Files      Lines Blank Comment Code\n-------- ----- ---------- ----- ------- ----\nRust     1,200 12,345,678     0       1  300\nUnknown      1          3     1       1    1\n"
        "-------- ----- ---------- ----- ------- ----\nTotal    1,201 12,345,681     1       2  301\n"
    )
    assert render.table(summary, True).startswith("\x1b[1;36mLanguage") and "\x1b[1;32mTotal" in render.table(summary, True)
    parsed = json.loads(render.as_json(summary))
    assert list(parsed["total"]) == ["files", "lines", "comments", "blanks", "code"] and parsed["languages"][1] == {"language": "Unknown", "files": 1, "lines": 3, "comments": 1, "blanks": 1, "code": 1}
    assert render.as_json(Summary([], (0,) * 5, [])).startswith('{\n  "languages": [],\n')
    assert render.formats(summary) == "\nUnknown file formats:\n  .xyz                        1,000\n  odd                             1\n"
    assert render.formats(Summary([], (0,) * 5, [])) == ""


def test_command_line(spark, folder, capsys):
    assert cli.main([str(folder), "--json", "-v"], spark) == 0
    out = capsys.readouterr()
    assert json.loads(out.out)["total"]["files"] == 6 and "Unknown file formats:" in out.err
    assert cli.main(["-V"]) == 0 and capsys.readouterr().out.startswith("strataline ")
    assert cli.main([str(folder / "missing")]) == 1
    out = capsys.readouterr()
    assert out.out == "" and out.err
    with pytest.raises(SystemExit) as stop:
        cli.main(["--bogus"])
    assert stop.value.code
    given = cli.parser().parse_args(["--all", "--json", "-v", "-j", "2", "src"])
    assert (given.all, given.json, given.verbose, given.threads, given.path) == (True, True, True, 2, "src")
    plain = cli.parser().parse_args([])
    assert (plain.all, plain.json, plain.verbose, plain.version, plain.threads, plain.path) == (False, False, False, False, None, ".")
    assert cli.default_tasks(False) == 1 and 1 <= cli.default_tasks(True) <= 4


def test_a_plan_asks_for_a_text_once(spark):
    from strataline.plans import registry

    for name in ("unknown_formats", "summary_rollup", "block_fold"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("*/ /*") == 1, name
