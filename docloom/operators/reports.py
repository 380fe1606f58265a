"""What is written about jobs: report lines, prompts, traces, labels.

Texts are put together as columns; a report is one row for each line, with its
page, so that a long one is no value in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.retrieval import CHANNELS

LINES_A_PAGE = 46

# fixed values: what reports and requests say
NO_TITLE = "证据来源"
HEAD = ("任务：", "状态：")
FINDING = (("风险：", "risk_level"), ("条款：", "clause_id"), ("问题：", "problem"), ("理由：", "reason"), ("建议：", "suggestion"), ("参考条款：", "proposed_clause"))
EVIDENCE = "证据："
TASK_STATES = {"queued": "submitted", "running": "working", "partial": "completed", "complete": "completed", "failed": "failed"}
CLAUSE = "条款 "


def _some(c: Column) -> Column:
    """A text, or null if there is none in it."""
    return F.nullif(c.cast("string"), F.lit(""))


def evidence_line(title: Column, article: Column, page: Column, version: Column, url: Column) -> Column:
    """Title and article, and after them the page, the version and the address, where there are any."""
    after = lambda before, c, behind="": F.coalesce(F.concat(F.lit(before), _some(c), F.lit(behind)), F.lit(""))
    number = F.when(page.cast("string") != "0", page)
    return F.concat(F.lit("《"), F.coalesce(_some(title), F.lit(NO_TITLE)), F.lit("》"), F.coalesce(_some(article), F.lit("")), after("，第 ", number, " 页"), after("，", version), after("，", url))


def report_lines(jobs: DataFrame, findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """jobs (job, status), findings (job, place, clause_id and what FINDING names)
    and evidence (job, place, rank, line): the lines of each job's report with
    line (from 0) and page (from 1).

    What stands at a place, a finding with its evidence, is one row until it is
    known where it begins; its lines are made after that, so they are neither
    shuffled nor sorted. Findings of one place give their lines by turns.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    said = lambda rows, keys, *cols: rows.groupBy(*keys).agg(F.collect_list(F.array(*cols)).alias("said"))
    shown = evidence.groupBy("job", "place").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))), lambda e: e["line"]).alias("shown"))
    found = said(findings, ["job", "place"], *[text(c) for _, c in FINDING]).join(shown, ["job", "place"], "left").withColumn("part", F.lit(1))
    top = said(jobs, ["job"], text("job"), text("status"), F.lit("")).withColumns({"place": F.lit(0), "part": F.lit(0)})
    blocks = found.unionByName(top, allowMissingColumns=True)
    shown_lines = F.when(F.col("shown").isNull(), 0).otherwise(F.size("shown"))
    n = F.when(F.col("part") == 0, F.size("said") * (len(HEAD) + 1)).otherwise(F.size("said") * (len(FINDING) + 1) + shown_lines)
    before = F.sum("n").over(Window.partitionBy("job").orderBy("place", "part")) - F.col("n")
    turn = lambda i, name: F.transform(F.sort_array(F.transform("said", lambda s: s[i])), lambda t: F.concat(F.lit(name), t))
    turns = lambda names: [turn(i, name) for i, name in enumerate(names)]
    proofs = F.when(F.col("shown").isNull(), F.array().cast("array<string>")).otherwise(F.transform("shown", lambda e: F.concat(F.lit(EVIDENCE), e)))
    texts = F.when(F.col("part") == 0, F.concat(*turns([*HEAD, ""]))).otherwise(F.concat(*turns([name for name, _ in FINDING]), proofs, F.array_repeat(F.lit(""), F.size("said"))))
    rows = blocks.withColumn("n", n).withColumn("before", before).select("job", "before", F.posexplode(texts).alias("pos", "text"))
    line = (F.col("before") + F.col("pos")).cast("int")
    return rows.select("job", line.alias("line"), (F.floor(line / LINES_A_PAGE) + 1).cast("int").alias("page"), "text")


def evidence_block(texts: Column, names: Column | None = None) -> Column:
    """Texts as lines, each behind its name in brackets; E1, E2, ... without names."""
    named = F.transform(texts, lambda t, i: F.concat(F.lit("[E"), (i + 1).cast("string"), F.lit("] "), F.coalesce(t, F.lit("")))) if names is None else F.zip_with(names, texts, lambda n, t: F.concat(F.lit("["), n, F.lit("] "), F.coalesce(t, F.lit(""))))
    return F.array_join(named, "\n")


def request(*parts: tuple[str, Column] | str) -> Column:
    """Parts of a request with an empty line between: a heading with what stands under it, or a sentence."""
    return F.concat_ws("\n\n", *[F.lit(p) if isinstance(p, str) else F.concat(F.lit(p[0] + "\n"), F.coalesce(p[1], F.lit(""))) for p in parts])


def judge_request(query: Column, evidence: Column) -> Column:
    return request(("待审核条款检索词：", query), ("候选证据：", evidence_block(evidence)), "请输出 JSON 对象，字段为 sufficient、missing_points、follow_up_queries、usable_evidence_ids、rejected_evidence。")


def expansion_request(query: Column, most: int) -> Column:
    return request(("合同条款（或当前检索词）：", query), f"请生成不超过 {most} 条检索查询词，覆盖不同表述和检索角度。")


def traces(hits: dict[str, DataFrame]) -> DataFrame:
    """query and trace: what each channel found for it (item, rank, score), as JSON; every channel is named."""
    rows = None
    for name in CHANNELS:
        if name in hits:
            part = hits[name].select("query", F.lit(name).alias("channel"), F.struct("rank", F.col("item").alias("chunk_id"), "score").alias("hit"))
            rows = part if rows is None else rows.unionByName(part)
    if rows is None or set(hits) - set(CHANNELS):
        raise ValueError(f"channels are {', '.join(CHANNELS)}")
    one = rows.groupBy("query", "channel").agg(F.transform(F.sort_array(F.collect_list("hit")), lambda h: F.struct(h["chunk_id"].alias("chunk_id"), h["rank"].alias("rank"), h["score"].alias("score"))).alias("hits"))
    by_name = one.groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("channel", "hits"))).alias("m"))
    none = F.array().cast(one.schema["hits"].dataType)
    channels = F.array(*[F.struct(F.lit(c).alias("name"), F.coalesce(F.try_element_at("m", F.lit(c)), none).alias("hits")) for c in CHANNELS])
    return by_name.select("query", F.to_json(F.struct(F.col("query").cast("string").alias("query"), channels.alias("channels"))).alias("trace"))


def merged_failures(failures: DataFrame) -> DataFrame:
    """failures (query, at, channel, reason) as each query's map of channel to its
    last reason, and problem: an unknown channel, or all of them failed."""
    last = failures.groupBy("query", "channel").agg(F.max_by("reason", "at").alias("reason"))
    merged = last.groupBy("query").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "reason")))).alias("failures"))
    names = F.map_keys("failures")
    problem = F.when(F.size(F.array_except(names, F.array(*[F.lit(c) for c in CHANNELS]))) > 0, "unknown channel").when(F.size(names) == len(CHANNELS), "all channels failed")
    return merged.withColumn("problem", problem)


def in_judges_order(decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    """decisions (clause, usable: an array of items) joined with candidates
    (clause, item and more) in the order the judge gave; items named twice stand
    where they were first, unknown ones go."""
    named = decisions.select("clause", F.posexplode(F.array_distinct("usable")).alias("__at", "item"))
    place = F.row_number().over(Window.partitionBy("clause").orderBy("__at"))
    return named.join(candidates, ["clause", "item"]).withColumn("place", place).drop("__at")


def clause_locator(locator: Column) -> Column:
    """The five parts of a stored locator (JSON), boxes as an empty list where there are none."""
    v = F.try_parse_json(locator)
    get = lambda name, kind: F.try_variant_get(v, f"$.{name}", kind)
    boxes = F.coalesce(F.to_json(get("bboxes", "variant")), F.lit("[]"))
    return F.struct(get("article_number", "string").alias("article_number"), get("paragraph_index", "int").alias("paragraph_index"), get("page_start", "int").alias("page_start"), get("page_end", "int").alias("page_end"), boxes.alias("bboxes"))


def task_state(status: Column) -> Column:
    """A job's state as callers see it."""
    return F.coalesce(*[F.when(status == k, v) for k, v in TASK_STATES.items()])


def clause_label(article: Column, clause_id: Column) -> Column:
    return F.coalesce(_some(article), F.concat(F.lit(CLAUSE), clause_id))


def listed(text: Column) -> Column:
    """Parts between commas, stripped, without blank ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.regexp_replace(x, "(?U)^\\s+|\\s+$", "")), lambda x: x != "")


def children(chunks: DataFrame) -> DataFrame:
    """Parents (parent_id null) with the ids of their children by ordinal."""
    of = chunks.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "id"))), lambda x: x["id"]).alias("children"))
    parents = chunks.where("parent_id is null").join(of, "id", "left")
    return parents.withColumn("children", F.coalesce("children", F.array().cast(of.schema["children"].dataType)))
