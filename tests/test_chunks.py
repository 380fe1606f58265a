"""Chunk plans against a plain loop: orphan headers, child parts, caps, ids."""

import hashlib
import json
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from docloom.operators import chunks

BLOCKS = "doc string, idx int, block_id string, text string, article string, section_title string, page_start long, page_end long, paragraph_index int, bboxes array<struct<x0:double,top:double,x1:double,bottom:double>>"


def rows_of(doc, texts, articles=None):
    return [(doc, i, f"b{i}", t, (articles or {}).get(i), f"s{i}" if i % 3 == 0 else None, i // 4 + 1 if i % 5 else None, None, i, [(0.0, 1.0, 2.0, float(i))] if i % 2 else None) for i, t in enumerate(texts)]


def plain_groups(texts, articles):
    """Walk the blocks once: a header alone swallows what carries its article."""
    number = lambda t: (re.match("第\\d+条", t.strip()) or [None])[0]
    out, i = [], 0
    while i < len(texts):
        j, mine = i + 1, articles.get(i) or number(texts[i])
        if number(texts[i]) and texts[i].strip() == number(texts[i]):
            while j < len(texts) and (articles.get(j) or number(texts[j])) == mine:
                j += 1
        out.append(list(range(i, j)))
        i = j
    return out


def test_groups_against_a_loop(spark):
    rng = random.Random(3)
    rows, want, headless = [], {}, {}
    for d in range(60):
        texts = [rng.choice(["第1条", " 第2条\n", "第1条 text", "body", "第2条 x", "more"]) for _ in range(rng.randint(1, 14))]
        articles = {i: rng.choice(["第1条", "第2条"]) for i in range(len(texts)) if rng.random() < 0.6}
        rows += rows_of(f"d{d}", texts, articles)
        want[f"d{d}"] = plain_groups(texts, articles)
        headless[f"d{d}"] = {i for g in want[f"d{d}"] for i in g if all(re.fullmatch("\\s*第\\d+条\\s*", texts[k]) for k in g)}
    got: dict = {}
    bare: dict = {}
    for r in chunks.groups(spark.createDataFrame(rows, BLOCKS)).orderBy("doc", "idx").collect():
        got.setdefault(r["doc"], {}).setdefault(r["grp"], []).append(r["idx"])
        if r["headless"]:
            bare.setdefault(r["doc"], set()).add(r["idx"])
    assert {d: [g[k] for k in sorted(g)] for d, g in got.items()} == want
    assert bare == {d: s for d, s in headless.items() if s}


def test_child_parts_keep_headers_and_join_up():
    assert list(chunks.child_parts("第一条\n" + "x" * 12, 10)) == ["第一条\n" + "x" * 10, "xx"]
    assert list(chunks.child_parts("第一条", 10)) == ["第一条"]
    assert list(chunks.child_parts("aaaaaaaa\n第二条\nbbbbbbbb\n", 9)) == ["aaaaaaaa\n", "第二条\nbbbbbbbb\n"]
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["第一条", "a", "bc ", "\n", "第3条之二\n", "x" * 7]) for _ in range(rng.randint(1, 30)))
        for most in (1, 4, 9, 600):
            parts = list(chunks.child_parts(text, most))
            assert "".join(parts) == text and all(parts)


def test_plan_offsets_spans_and_ordinals(spark):
    texts = ["第1条\n", "aaaa\n", "bbbbbb\n", "plain" * 5, "第2条 c"]
    articles = {0: "第1条", 1: "第1条", 2: "第1条", 4: "第2条"}
    blocks = spark.createDataFrame(rows_of("d", texts, articles) + rows_of("e", ["one"]), BLOCKS)
    planned, rejects = chunks.plan(blocks, most_chars=10)
    assert rejects.count() == 0
    found = chunks.located(planned, blocks).orderBy("doc", "ordinal").collect()
    parents = {(r["doc"], r["grp"]): r["text"] for r in found if r["child"] < 0}
    assert parents == {("d", 0): "".join(texts[:3]), ("d", 1): texts[3], ("d", 2): texts[4], ("e", 0): "one"}
    assert [r["ordinal"] for r in found if r["doc"] == "d"] == list(range(9))
    for r in found:
        assert parents[r["doc"], r["grp"]][r["start"] : r["end"]] == r["text"]
        assert "".join((texts if r["doc"] == "d" else ["one"])[s["idx"]][s["from"] : s["to"]] for s in r["spans"]) == r["text"]
    whole = found[0]
    assert (whole["article"], whole["section_title"], whole["page_start"], whole["page_end"], whole["paragraph_index"], len(whole["bboxes"])) == ("第1条", "s0", 1, 1, 0, 1)


def test_rejects_take_their_document(spark):
    blocks = spark.createDataFrame(rows_of("empty", ["a", ""]) + rows_of("null", [None]) + rows_of("bare", ["x", "第1条", "第2条 y"]) + rows_of("many", ["z" * 50]) + rows_of("fine", ["z" * 30]), BLOCKS)
    planned, rejects = chunks.plan(blocks, most_chars=10, most_children=4)
    assert {(r["doc"], r["idx"], r["reason"]) for r in rejects.collect()} == {("empty", 1, "empty block"), ("null", 0, "empty block"), ("bare", 1, "article header without a body"), ("many", None, "too many children")}
    assert {r["doc"] for r in planned.collect()} == {"fine"}
    _, rejects = chunks.plan(blocks.where("doc in ('many', 'fine')"), most_chars=10, most_elements=4 * 512)
    assert [(r["doc"], r["reason"]) for r in rejects.collect()] == [("many", "too many embedding elements")]
    for bad in ({"most_chars": 0}, {"most_children": 0}, {"most_elements": -1}):
        with pytest.raises(ValueError, match="positive"):
            chunks.plan(blocks, **bad)
    assert chunks.plan(blocks.limit(0))[0].count() == 0


def test_ids_are_hashes_of_lists(spark):
    def plain(*parts):
        h = bytearray(hashlib.sha256(json.dumps(parts, ensure_ascii=False, separators=(",", ":")).encode()).digest()[:16])
        h[6], h[8] = h[6] & 15 | 128, h[8] & 63 | 128
        return str(uuid.UUID(bytes=bytes(h)))

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    texts, articles = ["第1条", 'quoted "é" \\', "alone"], {0: "第1条", 1: "第1条"}
    blocks = spark.createDataFrame(rows_of("d", texts, articles), BLOCKS)
    planned, _ = chunks.plan(blocks)
    got = {(r["grp"], r["child"]): (r["id"], r["parent_id"]) for r in chunks.identified(planned, blocks, F.concat(F.lit("doc-"), "doc")).collect()}
    first = plain("knowledge-parent", "doc-d", 0, ["b0", "b1"], sha("".join(texts[:2])))
    second = plain("knowledge-parent", "doc-d", 1, "b2", sha("alone"))
    assert got == {(0, -1): (first, None), (0, 0): (plain("knowledge-child", "doc-d", first, 0, sha("".join(texts[:2]))), first), (1, -1): (second, None), (1, 0): (plain("knowledge-child", "doc-d", second, 0, sha("alone")), second)}
