"""Ranges in any case, messages with images, prompts with comments: against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tracelode.operators import project, search


def plain_ranges(text, query):
    """Hits in the text's own characters, by a list of lowered characters that know where they come from."""
    needle, low, owner = query.strip().lower(), "", []
    for k, c in enumerate(text):
        low += c.lower()
        owner += [k] * len(c.lower())
    found, at = [], low.find(needle) if needle else -1
    while at >= 0:
        start, end = owner[at], owner[at + len(needle) - 1] + 1
        if found and start < found[-1][1]:
            found[-1][1] = max(found[-1][1], end)
        else:
            found.append([start, end])
        at = low.find(needle, at + len(needle))
    return [(a, b - a) for a, b in found]


@pytest.mark.parametrize("query", ["été", "ÉTÉ", " Été ", "i", "i̇", "̇", "ß", "ab", "a.c", "日本", ""])
def test_ranges_in_any_case(spark, query):
    rng = random.Random(3)
    texts = ["Été été", "İİ i̇ İstanbul", "", "aB ab AB a.C", "日本日本語", "ΑΣ ας", "line\nÉté\n\nété"] + ["".join(rng.choice("ÉéÈtTaAbBiİıßc .\n日本") for _ in range(rng.randrange(30))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = {r.t: r for r in df.select("t", search.match_ranges(F.col("t"), query).alias("r"), search.highlighted(F.col("t"), query).alias("h")).collect()}
    assert got[None].r is None and got[None].h is None
    for t in texts:
        want = plain_ranges(t, query)
        assert [tuple(x) for x in got[t].r] == want, t
        assert "".join(p.part for p in got[t].h) == t
        assert [p.part for p in got[t].h if p.hit] == [t[a : a + n] for a, n in want]


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    "text, want",
    [
        ('a <image path="/p.png"></image> b', "a  b"),
        ("a <image foo></image> b", "a <image foo></image> b"),
        ("a <image/> <IMAGE path=/q />b", "a <image/> b"),
        ("<image path=/x>open", "<image path=/x>open"),
        ("# Files mentioned by the user:\n- x\n<image path=[/a b.png]> </image>\n\n## My request for Codex:\n\ndo it", "do it"),
        ("Files mentioned by the user:\n<image path='/a'></image>\nMY REQUEST FOR CODEX:  \nnow", "now"),
        ("My request for Codex:\nx\nFiles mentioned by the user:\n<image path=/a></image>", "My request for Codex:\nx\nFiles mentioned by the user:"),
        ("Files mentioned by the user:\n\n\n\nMy request for Codex:\nx", "Files mentioned by the user:\n\nMy request for Codex:\nx"),
        ("<images path=/a></images>", "<images path=/a></images>"),
    ],
)
def test_messages_without_images(spark, text, want):
    assert one(spark, project.without_attachments, text) == want


def comments(spark, text):
    got = project.diff_comments(spark.createDataFrame([(1, text)], "id int, text string")).first()
    return got and (got.request, [tuple(c) for c in got.comments])


def test_comments_on_a_diff(spark):
    text = "# Diff comments:\r\n\r\n## Comment 12:\nFile: browser:src/a.py Lines: 3-9\nsaid Comment: old\nComment:\n fix **this**\n\n\n\nplease\n**Comment 2**\nfile: b c.txt\n\n### My request for Codex:\n\n\nDo it\nnow <image> </image> more\n"
    assert comments(spark, text) == ("Do it\nnow", [(12, "src/a.py", "fix **this**\n\nplease"), (2, "b c.txt", project.NO_BODY)])
    assert comments(spark, "diff comments :\n\nCommentary 3\nx\nIn app browser:\ny") == ("", [(1, "", project.NO_BODY)])
    assert comments(spark, "Diff comments:\nComment 1\nComment: a\nThe next image shows b\nMy request for Codex:\nIn app browser:\nc\nIn app browser:\nd") == ("In app browser:\nc", [(1, "", "a")])
    assert comments(spark, "Diff comments:\nComment 1")[1] == [(1, "", project.NO_BODY)]
    assert comments(spark, "No Diff comments:") is None and comments(spark, None) is None


@pytest.mark.parametrize(
    "body, want",
    [
        ("[1] system: a\n[2] user: one\ntwo\n[3] assistant to user: no", "one\ntwo"),
        ("[1] user:\n\n  spaced  \n\n[x] user: mine", "spaced  \n\n[x] user: mine"),
        ("[1] User: big\n[2] user: small", "small"),
        ("[1] user: a\n[2] stranger: b\n[3] tool (x): c", "a\n[2] stranger: b"),
        ("[1] users: a", ""),
        ("", ""),
    ],
)
def test_quoted_requests(spark, body, want):
    assert one(spark, project.embedded_request, f"head\nTRANSCRIPT START\n{body}\nTRANSCRIPT END\nrest") == want
    assert re.sub("x", "", one(spark, project.embedded_request, body)) == ""
