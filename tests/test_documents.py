"""DOCX archives, lines of pages, and ordered rules."""

import hashlib
import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.operators import pages, rulebook
from docloom.sources import documents

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def archive(body, styles="", extra=()):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {W}>{styles}</w:styles>")
        for name, data in extra:
            z.writestr(name, data)
    return raw.getvalue()


def paragraph(text, style=None, listed=False):
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + ("<w:numPr/>" if listed else "")
    return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"


def table(*rows):
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{''.join(paragraph(p) for p in c.split('|'))}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"


def test_docx_blocks_and_their_places(spark, tmp_path):
    styles = '<w:style w:styleId="S1"><w:name w:val="heading 4"/></w:style><w:style w:styleId="L"><w:name w:val="List Bullet"/></w:style>'
    body = paragraph("第一章 总则") + paragraph("  ") + paragraph("第一条 甲") + paragraph("续") + table(["a", "b|c"], ["", "第九条"]) + table(["", " "]) + paragraph("Sub", "S1") + paragraph("item", "L") + paragraph("num", None, True) + "<w:p><w:r><w:t>x</w:t><w:tab/><w:t>y</w:t><w:br/><w:t>z</w:t></w:r></w:p>" + paragraph("第二章 其他") + paragraph("end", "Heading2")
    content = archive(body, styles)
    (tmp_path / "a.docx").write_bytes(content)
    (tmp_path / "copy.DOCX").write_bytes(content)
    files = documents.scan(spark, str(tmp_path))
    blocks = documents.docx_blocks(files)
    got = documents.docx_document(blocks).orderBy("idx").collect()
    sha = hashlib.sha256(content).hexdigest()
    assert [(r["text"], r["block_type"], r["article"], r["section_title"], r["paragraph_index"]) for r in got] == [
        ("第一章 总则", "heading", None, "第一章 总则", 1),
        ("第一条 甲", "article", "第一条", "第一章 总则", 3),
        ("续", "paragraph", "第一条", "第一章 总则", 4),
        ("a\tb\nc\n\t第九条", "table", "第一条", "第一章 总则", 1),
        ("Sub", "heading", None, "第一章 总则 > Sub", 5),
        ("item", "list", None, "第一章 总则 > Sub", 6),
        ("num", "list", None, "第一章 总则 > Sub", 7),
        ("x\ty\nz", "paragraph", None, "第一章 总则 > Sub", 8),
        ("第二章 其他", "heading", None, "第二章 其他", 9),
        ("end", "heading", None, "end", 10),
    ]
    assert got[0]["block_id"] == hashlib.sha256(f"{sha}|docx|paragraph:1|type:heading".encode()).hexdigest()
    assert got[3]["block_id"] == hashlib.sha256(f"{sha}|docx|table:1|type:table".encode()).hexdigest()


def test_docx_refusals(spark, tmp_path):
    fine = paragraph("x")
    cases = {
        "many": (archive(fine, extra=[(f"m{i}", b"") for i in range(30)]), "too many members"),
        "member": (archive(fine, extra=[("big", random.Random(1).randbytes(60_000))]), "a member is too large"),
        "all": (archive(fine, extra=[(f"r{i}", random.Random(i).randbytes(40_000)) for i in range(4)]), "the archive unpacks to too much"),
        "bomb": (archive(fine, extra=[("bomb", b"0" * 40_000)]), "a member is compressed too much"),
        "blocks": (archive(fine * 12), "too many blocks"),
        "characters": (archive(paragraph("".join(map(chr, range(33, 38))) * 90).replace("&", "a")), "too many characters"),
        "blank": (archive(paragraph(" ") + table(["", " "])), "no usable text"),
        "nothing": (archive(""), "no usable text"),
    }
    for name, (content, _) in cases.items():
        (tmp_path / f"{name}.docx").write_bytes(content)
    (tmp_path / "zip.docx").write_bytes(b"no archive")
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("other", "x")
    (tmp_path / "other.docx").write_bytes(raw.getvalue())
    (tmp_path / "torn.docx").write_bytes(archive(fine).replace(b"PK\x03\x04", b"PK\x03\x05", 1))
    (tmp_path / "y.txt").write_bytes(b"?")
    (tmp_path / "large.pdf").write_bytes(b"x" * 300_000)
    assert {(r["path"].rsplit("/", 1)[1], r["problem"]) for r in documents.refused(spark, str(tmp_path), 250_000).collect()} == {("y.txt", "unsupported type"), ("large.pdf", "too large")}
    files = documents.scan(spark, str(tmp_path), 250_000)
    limits = documents.DocxLimits(members=20, member_bytes=50_000, expanded_bytes=120_000, ratio=20.0, blocks=10, characters=400)
    got = {r["path"].rsplit("/", 1)[1][:-5]: r["problem"] for r in documents.docx_blocks(files, limits).join(files, F.col("doc") == F.col("sha256")).collect()}
    assert {k: got[k] for k in cases} == {k: v for k, (_, v) in cases.items()}
    assert got["zip"].startswith("BadZipFile") and got["other"].startswith("KeyError") and got["torn"].startswith("BadZipFile")


LINE = "doc string, page int, block int, line int, text string, page_height double, x0 double, top double, x1 double, bottom double"


def plain_pages(lines):
    """One walk over a document's lines, as a reader of pages would go."""
    number = re.compile(r"(?:[-–—·•.]?\s*\d{1,4}\s*[-–—·•.]?|第\s*\d{1,4}\s*页)")
    entry = lambda t: re.search(r"\.{3,}", t)
    level = lambda t: 2 if re.match(r"第\d+章( |$)", t.strip()) or re.sub(r"\s", "", t) == "总则" else 3 if re.match(r"第\d+节( |$)", t.strip()) else None
    article = lambda t: (re.match(r"第\d+条", t.strip()) or [None])[0]
    said = [x for x in lines if x[4].strip() and not number.fullmatch(x[4].strip())]
    band = lambda x: x[7] <= 15 or x[9] >= 85
    norms = [re.sub(r"\s", "", x[4]) for x in said if band(x)]
    body = [x for x in said if not entry(x[4]) and not (band(x) and len(n := re.sub(r"\s", "", x[4])) >= 4 and norms.count(n) >= 2)]
    out, stack, contents, places = [], [], None, {}
    for page in sorted({x[1] for x in body}):
        at, carried = 0, None
        for block in sorted({x[2] for x in body if x[1] == page}):
            parts, held = [], []
            for x in [x for x in body if x[1:3] == (page, block)]:
                if level(x[4]) or article(x[4]):
                    parts, held = parts + ([held] if held else []), []
                held.append(x[4])
                if level(x[4]):
                    parts, held = [*parts, held], []
            for t in ["\n".join(p) for p in parts + ([held] if held else [])]:
                if contents is not None:
                    if page == contents or entry(t):
                        continue
                    contents = None
                if re.sub(r"\s", "", t) == "目录":
                    out, contents = [], page
                    continue
                at += 1
                if level(t):
                    stack, carried = [s for s in stack if s[0] < level(t)] + [(level(t), t)], None
                carried = article(t) or carried
                out.append((page, at, "heading" if level(t) else "article" if article(t) else "paragraph", t, carried, " > ".join(s for _, s in stack) or None))
    return out


def test_pages_against_a_walk(spark):
    rng = random.Random(11)
    words = ["第1章 甲", "第2章", "第1节 乙", "第3条 丙", "第4条", "text", "more text", "目录", "x...3", "12", "Head er", "foot  er", " ", "总 则", "第 3 页", "第5条 a...9"]
    rows = []
    for d in range(120):
        for page in range(1, rng.randint(2, 6)):
            for line in range(rng.randint(0, 12)):
                top = float(line * 8)
                rows.append((f"d{d}", page, line // rng.choice([1, 2, 3, 5]), line, rng.choice(words), 100.0, 0.0, top, 9.0, top + 6))
    rows = sorted({(r[0], r[1], r[3]): r for r in rows}.values())
    fixed = {}
    for r in rows:  # blocks do not go back
        fixed[r[0], r[1]] = max(fixed.get((r[0], r[1]), 0), r[2])
        rows[rows.index(r)] = (*r[:2], fixed[r[0], r[1]], *r[3:])
    blocks, rejects = pages.page_blocks(spark.createDataFrame(rows, LINE))
    got = {}
    for r in blocks.orderBy("doc", "idx").collect():
        got.setdefault(r["doc"], []).append((r["page_start"], r["paragraph_index"], r["block_type"], r["text"], r["article"], r["section_title"]))
    want = {d: plain_pages([r for r in rows if r[0] == d]) for d in {r[0] for r in rows}}
    assert got == {d: b for d, b in want.items() if b}
    assert {(r["doc"], r["reason"]) for r in rejects.collect()} == {(d, "no usable text") for d, b in want.items() if not b}


def test_rules_keep_their_rank(spark):
    rows = spark.createDataFrame([(1, "联合体的付款和不可抗力"), (2, ""), (3, None), (4, "履行期限与违约")], "i int, t string")
    got = {r["i"]: (r["k"], r["q"]) for r in rows.select("i", rulebook.matched(F.col("t"))["rank"].alias("k"), rulebook.expanded(F.col("t")).alias("q")).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4)] == [[1, 4, 6], [], [], [3, 5]]
    assert got[1][1] == [*rulebook.DOMAIN_RULES[0][1], *rulebook.DOMAIN_RULES[3][1], *rulebook.DOMAIN_RULES[5][1]] and len(got[4][1]) == 4
    with pytest.raises(ValueError, match="no rules"):
        rulebook.matched(F.col("t"), ())
    said = rows.select(rulebook.combined(F.col("t"), F.array(F.lit(" 履行期限与违约 "), F.lit("a"), F.lit(" a "), F.lit(" "))).alias("q")).collect()
    assert [len(r["q"]) for r in said] == [6, 2, 2, 5] and said[3]["q"][0] == "a"


def test_law_metadata(spark):
    cases = [
        ("x/民法典_20200528.docx", "目录\n第一编 总则\n中华人民共和国民法典\n（2020年5月28日第十三届全国人民代表大会第三次会议通过）\n自 2021年1月1日 起施行", ("中华人民共和国民法典", "全国人民代表大会", "2021-01-01", "20200528", "law")),
        ("规则 a.b.pdf", "主管机关名称: 财政部 \n实施时间：2024年2月30日\n2024年1月5日", ("主管机关名称: 财政部", "财政部", "2024-02-30", "2024年2月30日", None)),
        ("办法_1234.docx", "12\n- 3 -\n（附）\n2024年1月1日\nplain", ("办法_1234", None, None, "2024年1月1日", None)),
        ("某办法_20240101.docx", None, ("某办法", None, None, "20240101", "law")),
        ("n.pdf", "北京市人民政府令\r\n某市 条 例\n2020年3月4日施行", ("某市 条 例", "北京市人民政府", "2020-03-04", "2020年3月4日", None)),
    ]
    out = rulebook.law_metadata(spark.createDataFrame([(i, f, t) for i, (f, t, _) in enumerate(cases)], "i int, filename string, text string")).orderBy("i").collect()
    for r, (_, _, want) in zip(out, cases):
        assert (r["title"], r["issuing_authority"], r["effective_date"], r["version"], r["source_type"]) == want
    assert [r["effective_day"] is None for r in out] == [False, True, True, True, False]
