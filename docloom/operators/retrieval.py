"""Retrieval for many queries at once: vector, keyword and reference channels,
rank fusion, similarity floor, merging of expanded queries.

The vector and keyword channels compare a stated set of queries with all rows as
products of blocks (kernels); titles and queries meet by equi-joins on articles
or grams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import search_terms
from docloom.operators import kernels

CHANNELS = ("vector", "keyword", "reference")
MOST_SENT_TERMS = 200_000


def ranked(scored: DataFrame, query: str, item: str, score: str, limit: int) -> DataFrame:
    """Each query's best rows: rank from 1, ties to smaller items, null scores last."""
    order = Window.partitionBy(query).orderBy(F.col(score).desc_nulls_last(), F.col(item))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def plain_article() -> Column:
    return F.regexp_replace("article", "(?U)\\s", "")


def _asked(queries: DataFrame, wanted: str) -> DataFrame:
    """What a channel needs of queries; lists without null and article white space aside."""
    more = [F.filter(c, lambda x: x.isNotNull()).alias(c) for c in ("articles", "excluded") if c in queries.columns]
    return queries.select("query", F.filter(F.array_distinct(wanted), lambda x: x.isNotNull()).alias(wanted) if wanted == "terms" else F.col(wanted), *more)


def _about(rows: DataFrame, *wanted: str) -> DataFrame:
    article = [plain_article().alias("article")] if "article" in rows.columns else []
    return rows.select("item", *wanted, *article)


def vector_channel(rows: DataFrame, queries: DataFrame, limit: int = 20, dimension: int | None = None) -> DataFrame:
    """rows: item, vector, and optionally article; queries: query, query_vector,
    and optionally excluded (an array of items) and articles. Rows whose article
    a query names come first and score 2, with or without a vector; the order is
    by cosine otherwise. Rows without a cosine (no vector, a zero one, one that
    is not finite), and with dimension those with a vector of another one, are
    hits only by their article. Products of blocks of vectors find each block's
    best, whose cosines are then computed singly. Gives query, item, score, rank."""
    check_limit(limit)
    if dimension is not None:
        rows = rows.withColumn("vector", F.when(F.size("vector") == dimension, F.col("vector")))
    asked, about = _asked(queries, "query_vector"), _about(rows, F.col("vector").cast("array<double>").alias("vector"))
    asked = asked.withColumn("query_vector", F.col("query_vector").cast("array<double>"))
    types = {f.name: f.dataType.simpleString() for f in (*asked.schema, *about.schema)}
    scored = kernels.best_of(about, asked, "8 * coalesce(size(query_vector), 0)", kernels.vector_best(limit), f"query {types['query']}, item {types['item']}, named boolean, near double")
    order = Window.partitionBy("query").orderBy(F.desc("named"), F.col("near").desc_nulls_last(), F.col("item"))
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return best.select("query", "item", F.when(F.col("named"), 2.0).otherwise(F.col("near")).alias("score"), "rank")


def keyword_channel(rows: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """rows: item, tokens, and optionally counts (how often each token is there,
    else each counts once) and article; queries: query, terms, and optionally
    excluded and articles. A row's score is a tenth of the number of its tokens
    that are terms, or 2 where a query names its article; rows without any are
    no hits. Tokens are counted and multiplied with the terms where they are
    read; only each task's best leave it."""
    check_limit(limit)
    asked, about = _asked(queries, "terms"), _about(rows, "tokens", *(["counts"] if "counts" in rows.columns else []))
    types = {f.name: f.dataType.simpleString() for f in (*asked.schema, *about.schema)}
    hits = kernels.best_of(about, asked, "64 * coalesce(size(terms), 0)", kernels.keyword_best(limit), f"query {types['query']}, item {types['item']}, n long")
    return ranked(hits.select("query", "item", (F.col("n") * F.lit(0.1)).alias("score")), "query", "item", "score", limit)


def check_limit(limit: int) -> None:
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= 1000:
        raise ValueError("a limit lies between 1 and 1000")


def grams(text: Column, n: int) -> Column:
    """Distinct runs of n characters."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def titles_with(titles: DataFrame, terms: DataFrame, limit: int) -> DataFrame:
    """titles: item, title (lower case, several an item at most); terms: term,
    where _ stands for any character. Each term with the first `limit` items of
    which a title holds it. A term meets titles by the first three characters
    of its longest literal piece, fewer if it is shorter. Up to MOST_SENT_TERMS
    terms go to every task, which looks at its titles where it reads them and
    gives each term's first items; beyond it titles are looked up by a key."""
    pieces = F.array_sort(F.split("term", "_"), lambda a, b: F.length(b) - F.length(a))
    anchored = terms.withColumn("gram", F.substring(pieces[0], 1, 3))
    all_grams = F.explode(F.array_union(F.array(F.lit("")), F.concat(*[grams(F.col("title"), n) for n in (1, 2, 3)]))).alias("gram")
    pattern = F.concat(F.lit("%"), F.col("term"), F.lit("%"))
    holds = F.when(F.instr("term", "_") > 0, F.call_function("like", F.col("title"), pattern)).otherwise(F.contains("title", "term"))
    if terms.limit(MOST_SENT_TERMS + 1).count() <= MOST_SENT_TERMS:
        found = titles.select("item", "title", all_grams).join(F.broadcast(anchored), "gram").where(holds).select("term", "item")
    else:
        keyed = titles.withColumn("at", F.xxhash64("title"))
        met = keyed.select("item", "at", all_grams).join(anchored, "gram").select("item", "at", "term").distinct()
        found = met.join(keyed, ["item", "at"]).where(holds).select("term", "item")
    first = Window.partitionBy("term").orderBy("item")
    return found.withColumn("__n", F.dense_rank().over(first)).where(F.col("__n") <= limit).drop("__n").distinct()


def reference_channel(rows: DataFrame, queries: DataFrame, limit: int = 20, most_terms: int = 20) -> DataFrame:
    """rows: item, title, article, and optionally section_title; queries: query,
    text, articles, and optionally excluded. An article match scores 2, a title or section title that
    holds one of the first terms (as a pattern, letter case aside) scores 1,
    anything else is no hit.

    Terms are looked up once for all queries, and for each the first items are
    enough: of a query's hits without an article those with the smallest items
    come first, and no more than limit of them and the query's excluded items."""
    check_limit(limit)
    named = rows.select("item", plain_article().alias("a")).join(queries.select("query", F.explode("articles").alias("a")), "a").select("query", "item", F.lit(2.0).alias("score"))
    words = F.slice(F.filter(search_terms(F.col("text")), lambda t: F.length(t) >= 2), 1, most_terms)
    asked = queries.select("query", F.explode(F.array_distinct(words)).alias("term"))
    kinds = ["title"] + (["section_title"] if "section_title" in rows.columns else [])
    titles = rows.select("item", F.explode(F.array_distinct(F.array(*[F.lower(c) for c in kinds]))).alias("title")).where("title is not null")
    spare = 0
    if "excluded" in queries.columns:
        spare = max(0, queries.agg(F.max(F.size("excluded"))).first()[0] or 0)
    titled = titles_with(titles, asked.select("term").distinct(), limit + spare).join(asked, "term").select("query", "item", F.lit(1.0).alias("score"))
    hits = named.unionByName(titled)
    if "excluded" in queries.columns:
        hits = hits.join(queries.select("query", F.explode("excluded").alias("item")), ["query", "item"], "left_anti")
    hits = hits.groupBy("query", "item").agg(F.max("score").alias("score"))
    return ranked(hits, "query", "item", "score", limit)


def fused(channels: dict[str, DataFrame], k: int = 60, limit: int = 60) -> DataFrame:
    """Reciprocal-rank fusion: query, item, score, rank, the rank and score in
    each channel, and how many channels agree. Scores add up in the order of
    the channels, so that equal inputs give equal sums to the last bit."""
    parts = [df.select("query", "item", F.lit(name).alias("channel"), "rank", "score") for name, df in channels.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    once = Window.partitionBy("query", "item", "channel").orderBy("rank", F.desc("score"))
    rows = rows.withColumn("__n", F.row_number().over(once)).where("__n = 1")
    pick = lambda c, v: F.max(F.when(F.col("channel") == c, F.col(v)))
    wide = rows.groupBy("query", "item").agg(*[pick(c, "rank").alias(f"{c}_rank") for c in channels], *[pick(c, "score").alias(f"{c}_score") for c in channels])
    share = lambda c: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(f"{c}_rank")), F.lit(0.0))
    score = sum((share(c) for c in list(channels)[1:]), share(next(iter(channels))))
    return ranked(wide.withColumn("score", score), "query", "item", "score", limit)


def above_floor(candidates: DataFrame, floor: float = 0.5) -> DataFrame:
    """Candidates whose vector score, if they have one, reaches the floor."""
    return candidates if floor <= 0 else candidates.where(F.col("vector_score").isNull() | (F.col("vector_score") >= floor))


def reranked(candidates: DataFrame, score: Column, limit: int = 5) -> DataFrame:
    """Candidates in order of another score; channel ranks and scores stay."""
    return ranked(candidates.drop("score", "rank").withColumn("score", score), "query", "item", "score", limit)


def lexical_score(query_terms: Column, tokens: Column) -> Column:
    """The share of a query's terms that a text has: a stand-in for a model."""
    distinct = F.array_distinct(query_terms)
    return F.size(F.array_intersect(distinct, tokens)) / F.greatest(F.size(distinct), F.lit(1))


def merged_queries(hits: DataFrame, seen: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """hits: clause, query_no, rank, item and more, of a clause's expanded
    queries. Each item once, where it is first seen, without those seen before,
    and the first `limit` of each clause; place counts from 1."""
    first = Window.partitionBy("clause", "item").orderBy("query_no", "rank")
    rows = hits.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    if seen is not None:
        rows = rows.join(seen.select("clause", "item"), ["clause", "item"], "left_anti")
    order = Window.partitionBy("clause").orderBy("query_no", "rank", "item")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def visible(rows: DataFrame, tenant: str) -> DataFrame:
    """Public rows, and a tenant's own rows of firm and private scope."""
    return rows.where((F.col("scope") == "public") | ((F.col("tenant_id") == tenant) & F.col("scope").isin("firm", "tenant_private")))


def valid_on(rows: DataFrame, day: Column) -> DataFrame:
    """Rows whose period holds the day; open ends are null."""
    return rows.where((F.col("effective_date").isNull() | (F.col("effective_date") <= day)) & (F.col("expiry_date").isNull() | (F.col("expiry_date") >= day)))


def eligible(chunks: DataFrame, documents: DataFrame, tenant: str, day: Column, statuses: tuple[str, ...] = ("active",)) -> DataFrame:
    """chunks (with doc) of documents (doc, status, scope, tenant_id,
    effective_date, expiry_date) that are in one of the statuses, visible to the
    tenant and valid on the day: what every channel may look at. Chunks of
    unknown documents go."""
    some = valid_on(visible(documents.where(F.col("status").isin(*statuses)), tenant), day)
    return chunks.join(some.select("doc").distinct(), "doc", "left_semi")


def inconsistent(channels: list[DataFrame], key: str, *carried: str) -> DataFrame:
    """Items that channels carry with different columns."""
    rows = channels[0].select(key, *carried)
    for c in channels[1:]:
        rows = rows.unionByName(c.select(key, *carried))
    return rows.groupBy(key).agg(F.count_distinct(F.struct(*carried)).alias("versions")).where("versions > 1")
