from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallgrass.functions import paths, text


def test_tokens_of_identifiers(one):
    got = one(text.tokens(F.col("t")), t="fooBar.baz foo. 42 7 x HTTPServer2Go")
    assert got == ["foobar.baz", "foo", "bar", "baz", "foo.", "foo", "42", "42", "httpserver2go", "httpserver2", "go"]


def test_tokens_of_null_and_empty(one):
    assert one(text.tokens(F.col("t").cast("string")), t=None) is None
    assert one(text.tokens(F.col("t")), t="") == []


@pytest.mark.parametrize("term, value", [("hello", 1335831723), ("a", 3826002220), ("", 2166136261)])
def test_term_hash(one, term, value):
    assert one(text.term_hash(F.col("t")), t=term) == value


def test_slug(one):
    assert one(text.slug(F.col("t")), t="  Plain heading! ") == "plain-heading"
    assert len(one(text.slug(F.col("t")), t="word " * 40)) <= 48


def test_comments_lose_characters_but_not_lines(one):
    assert one(text.blank_comments(F.col("t")), t="a\n<!-- x\n## y\n-->\nb<!-- x -->c") == "a\n\n\n\nbc"
    assert one(text.blank_comments(F.col("t")), t="<!-- a <!-- b --> <!-- b -->") == " "


@pytest.mark.parametrize("start, end, value", [(2, 9, "b\nc"), (0, 1, "a"), (3, 2, ""), (None, 2, "a\nb"), (None, None, "a\nb\nc")])
def test_line_slice(one, start, end, value):
    assert one(text.line_slice(F.col("t"), F.col("a").cast("int"), F.col("b").cast("int")), t="a\nb\nc", a=start, b=end) == value


def test_fields_last_value_wins(one):
    body = "When relevant: one\n- **When relevant:** two\nEvidence:\n- a\n\n* b\nx\n- c\n**Last verified:** 2024-01-05 x\nLast verified: none\nEvidence (more):\n\nLast verified: 2024-02-01."
    got = one(text.memory_fields(F.col("t")), t=body)
    assert (got["when_relevant"], got["evidence"], got["last_verified"]) == ("two", ["a", "b"], "2024-02-01")


def test_fields_absent(one):
    got = one(text.memory_fields(F.col("t")), t="nothing here")
    assert tuple(got) == (None, None, None)


def test_mentioned_ids(one):
    assert one(text.mentioned_ids(F.col("t")), t="see pit-122 and WF-106, MSDG-121 not ABCDEF-1; éPIT-1 PIT-122") == ["PIT-122", "WF-106", "MSDG-121", "PIT-1"]
    assert one(text.is_bare_id(F.col("t")), t=" pit-1 ") is True
    assert one(text.is_bare_id(F.col("t")), t="pit-1 x") is False


@pytest.mark.parametrize(
    "kind, verified, state",
    [("pitfall", "2024-01-05", None), ("pitfall", "2024-01-04", "stale"), ("learning", "2020-01-01", None), ("learning", None, None), ("pitfall", None, "undated"), ("pitfall", "2024-02-30", "undated")],
)
def test_staleness(one, kind, verified, state):
    """Includes deviation 8: an impossible date counts as none."""
    assert one(text.staleness(F.col("k"), F.col("v").cast("string"), F.lit(datetime(2024, 3, 5))), k=kind, v=verified) == state


def test_front_matter(one):
    t = "---\nname: a b \nname: deploy\ndescription: how to\n---\nbody"
    assert one(text.front_matter(F.col("t"), "name"), t=t) == "deploy"
    assert one(text.front_matter(F.col("t"), "title"), t=t) is None
    assert one(text.front_matter(F.col("t"), "name"), t="x") is None


def test_replace_once(one):
    assert one(text.replace_once(F.col("t"), "a", "b"), t="xaya") == "xbya"
    assert one(text.replace_once(F.col("t"), "q", "b"), t="xaya") == "xaya"


def test_headings(one):
    assert one(text.heading_id(F.col("t")), t="PIT-001: Reset form") == "PIT-001"
    assert one(text.heading_title(F.col("t")), t="PIT-001: Reset form") == "Reset form"
    assert one(text.heading_id(F.col("t")), t="Plain heading!") == "plain-heading"
    assert one(text.heading_title(F.col("t")), t="Plain heading!") == "Plain heading!"


@pytest.mark.parametrize(
    "glob, path, hit",
    [
        ("docs/**", "docs/a/b.md", True), ("docs/**", "x/docs/a.md", False), ("*.css", "a/b.css", True), ("*.css", "a.css.txt", False),
        ("./src/?.ts", "src/a.ts", True), ("./src/?.ts", "src/ab.ts", False), ("a+b(1).ts", "x/a+b(1).ts", True), ("*/x.ts", "a/b/x.ts", False),
    ],
)
def test_globs(one, glob, path, hit):
    assert one(F.col("p").rlike(paths.glob_pattern(glob)), p=path) is hit


@pytest.mark.parametrize(
    "path, skipped, by_chunker",
    [("node_modules/a.ts", True, True), ("x/dist/a.ts", True, True), ("src/distance/a.ts", False, False), ("a.min.js", True, True), ("a.d.ts", True, True), (".cache/a.ts", False, True), ("vendors/a.ts", False, False)],
)
def test_skip_list(one, path, skipped, by_chunker):
    assert one(paths.is_skipped(F.col("p")), p=path) is skipped
    assert one(paths.is_skipped(F.col("p"), for_chunker=True), p=path) is by_chunker


@pytest.mark.parametrize(
    "path, hit",
    [
        ("openspec/memory/pitfalls.md", True), ("openspec/memory/index.md", False), ("a/skills/openspec-propose/SKILL.md", False), ("a/skills/deploy/SKILL.md", True),
        ("changes/x/learnings.md", True), ("docs/a.md", False), ("x/SKILL.MD", False),
    ],
)
def test_memory_paths(one, path, hit):
    assert one(paths.is_memory_path(F.col("p")), p=path) is hit


@pytest.mark.parametrize("path, branch, language", [("a.ts", "script", "typescript"), ("a.tsx", "script", "tsx"), ("a.yml", "line", "yaml"), ("a.py", None, "py"), (".json", None, ""), ("a/learnings.md", "memory", "markdown")])
def test_dispatch(one, path, branch, language):
    assert one(paths.branch(F.col("p")), p=path) == branch
    assert one(paths.language_label(F.col("p")), p=path) == language


def test_point_id(one):
    assert one(paths.point_id(F.lit("r"), F.lit("r/a.ts"), F.lit(0))) == "4e9c3aff-fe29-ed20-b8b3-f8e3056435a6"
