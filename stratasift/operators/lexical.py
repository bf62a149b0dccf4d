"""BM25 retrieval as a DataFrame plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from stratasift.functions import text
from stratasift.staging import stage

from . import term_blocks
from .term_blocks import END

K1, B = 1.2, 0.75

#: Query terms and passages are counted; up to this number they are broadcast to the documents' scan.
BROADCAST_TERMS = 500_000

#: Stands once among the terms of each document, for its length; no term is empty.
_EVERY = ""

#: Characters of the grams by which passages without an inner word are found.
GRAM = 8


def document_terms(docs: DataFrame, doc_col: str, text_col: str, analyzer=text.tokens) -> DataFrame:
    """(doc, terms, dl): the analysed documents."""
    terms = analyzer(F.col(text_col))
    return docs.select(F.col(doc_col).alias("doc"), terms.alias("terms")).withColumn("dl", F.size("terms"))


def query_terms(queries: DataFrame, query_col: str, text_col: str, analyzer=text.tokens) -> DataFrame:
    """(query, term): distinct terms of each query."""
    return queries.select(
        F.col(query_col).alias("query"), F.explode(F.array_distinct(analyzer(F.col(text_col)))).alias("term")
    )


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def postings(docs: DataFrame, vocabulary: DataFrame, doc_col: str, text_col: str, analyzer=text.tokens) -> DataFrame:
    """(doc, dl, term, tf), staged: the documents' postings of the terms of a vocabulary.

    Documents are analysed once, and only terms of the vocabulary leave the
    scan; the empty term stands once in every document.
    """
    found = (
        document_terms(docs, doc_col, text_col, analyzer)
        .select("doc", "dl", F.explode(F.concat("terms", F.array(F.lit(_EVERY)))).alias("term"))
        .join(vocabulary, "term", "left_semi")
    )
    return stage(found.groupBy("doc", "dl", "term").agg(F.count(F.lit(1)).alias("tf")), "postings")


def bm25_scores(docs: DataFrame, queries: DataFrame, doc_col: str, query_col: str, text_col: str = "text", analyzer=text.tokens) -> DataFrame:
    """(query, doc, score) for every pair that shares a term.

    Statistics are those of all documents, whatever is filtered later.  One
    build serves any number of query sets, if they are one table.  Postings are
    partitioned by document, so that scores are added up where they arise and
    :func:`top_k` keeps ``k`` per query in each partition before anything moves.
    """
    asked = query_terms(queries, query_col, text_col, analyzer)
    near = F.broadcast if asked.count() <= BROADCAST_TERMS else (lambda df: df)
    every = docs.sparkSession.range(1).select(F.lit(_EVERY).alias("term"))
    vocabulary = asked.select("term").distinct().unionByName(every)
    built = postings(docs, near(vocabulary), doc_col, text_col, analyzer)
    stats = built.where(F.col("term") == _EVERY).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    own = built.where(F.col("term") != _EVERY)
    weighted = (
        own.groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
        .crossJoin(F.broadcast(stats))
        .select("term", idf(F.col("n"), F.col("df")).alias("idf"), "avgdl")
        .join(asked, "term")
    )
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (
        F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    )
    return (
        own.repartition("doc")
        .join(near(weighted), "term")
        .groupBy("query", "doc")
        .agg(F.round(F.sum(part), 6).alias("score"))
    )


def bm25_top_k(
    docs: DataFrame, queries: DataFrame, k: int, doc_col: str, query_col: str, text_col: str = "text", analyzer=text.tokens, visible: Column | None = None
) -> DataFrame:
    """(query, doc, score): the ``k`` best of :func:`bm25_scores` for each query and partition, for :func:`top_k` to rank.

    Documents are packed in blocks of term counts where they are, and a block
    meets all queries in one matrix product, so no pair of a query and a
    document is a row unless it is among the best.  ``visible`` says which
    documents may be found; statistics are those of all.  Ids that occur twice
    and more than BROADCAST_TERMS query terms go by rows of pairs.
    """
    asked = stage(query_terms(queries, query_col, text_col, analyzer), "asked")
    if asked.count() > BROADCAST_TERMS or docs.groupBy(doc_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        pairs = bm25_scores(docs, queries, doc_col, query_col, text_col, analyzer)
        return pairs if visible is None else pairs.join(docs.where(visible).select(F.col(doc_col).alias("doc")), "doc", "left_semi")
    number = F.row_number().over(Window.orderBy("term")) - 1  # BROADCAST_TERMS at most
    vocabulary = stage(asked.select("term").distinct().withColumn("no", number), "vocabulary")
    marks = docs.sparkSession.range(1).select(F.lit(_EVERY).alias("term"), F.lit(END).alias("no"))
    terms = analyzer(F.col(text_col))
    shown = F.lit(True) if visible is None else F.coalesce(visible, F.lit(False))
    analysed = docs.select(F.col(doc_col).alias("doc"), shown.alias("shown"), terms.alias("terms"))
    spread = analysed.select("doc", "shown", F.size("terms").alias("dl"), F.explode(F.concat("terms", F.array(F.lit(_EVERY)))).alias("term"))
    numbered = spread.join(F.broadcast(vocabulary.unionByName(marks)), "term").select("doc", "shown", "dl", "no")
    schema = T.StructType([T.StructField("docs", T.ArrayType(numbered.schema["doc"].dataType)), *T.StructType.fromDDL(term_blocks.FIELDS).fields])
    built = stage(numbered.mapInArrow(term_blocks.packed, schema), "term-blocks")
    counted = built.mapInArrow(term_blocks.statistics, "no int, n long").groupBy("no").agg(F.sum("n").alias("n"))
    counts = stage(counted, "term-statistics")
    one = counts.agg(F.max(F.when(F.col("no") == END, F.col("n"))).alias("docs"), F.max(F.when(F.col("no") == term_blocks.LENGTH, F.col("n"))).alias("tokens"))
    weighted = counts.where("no >= 0").crossJoin(F.broadcast(one)).select("no", idf(F.col("docs"), F.col("n")).alias("idf"), (F.col("tokens") / F.col("docs")).alias("avgdl"))
    whole = weighted.join(vocabulary, "no").join(asked, "term")
    # One row, with BROADCAST_TERMS numbers at most.
    near = whole.groupBy("query").agg(F.max("avgdl").alias("avgdl"), F.collect_list(F.struct("no", "idf")).alias("own")).agg(
        F.max("avgdl").alias("avgdl"), F.collect_list("query").alias("queries"), F.collect_list("own").alias("weights")
    )
    out = T.StructType([T.StructField("query", asked.schema["query"].dataType), T.StructField("doc", numbered.schema["doc"].dataType), T.StructField("score", T.DoubleType())])
    return built.crossJoin(F.broadcast(near)).mapInArrow(lambda batches: term_blocks.best(batches, k, K1, B), out)


def overlap_top_k(
    docs: DataFrame, queries: DataFrame, k: int, doc_col: str, query_col: str, text_col: str = "text", analyzer=text.cjk_and_word_tokens, barred: DataFrame | None = None
) -> DataFrame:
    """(query, doc, overlap): how many distinct words a query shares with each of its ``k`` closest documents.

    They are the ``k`` best of each query and partition, for :func:`top_k` to
    rank, by blocks as in :func:`bm25_top_k`, whose rules for ids that occur
    twice and for very many query terms hold here too.  Pairs in
    ``barred(query, doc)`` don't count.
    """
    asked = stage(query_terms(queries, query_col, text_col, analyzer).distinct(), "asked")
    own = docs.select(F.col(doc_col).alias("doc"), F.array_distinct(analyzer(F.col(text_col))).alias("terms"))
    many = asked.count() > BROADCAST_TERMS
    if many or docs.groupBy(doc_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        close = (lambda df: df) if many else F.broadcast
        met = own.select("doc", F.explode("terms").alias("term")).join(close(asked.select("term").distinct()), "term", "left_semi").distinct()
        pairs = met.join(close(asked), "term").groupBy("query", "doc").agg(F.count(F.lit(1)).alias("overlap"))
        return pairs if barred is None else pairs.join(barred, ["query", "doc"], "left_anti")
    number = F.row_number().over(Window.orderBy("term")) - 1  # BROADCAST_TERMS at most
    vocabulary = stage(asked.select("term").distinct().withColumn("no", number), "vocabulary")
    marks = docs.sparkSession.range(1).select(F.lit(_EVERY).alias("term"), F.lit(END).alias("no"))
    query_type, doc_type = asked.schema["query"].dataType, own.schema["doc"].dataType
    none = F.array().cast(T.ArrayType(query_type))
    if barred is None:
        listed = own.withColumn("barred", none)
    else:
        lists = barred.groupBy("doc").agg(F.collect_set("query").alias("barred"))
        listed = docs.select(F.col(doc_col).alias("doc"), text_col).join(lists, "doc", "left")
        listed = listed.select("doc", F.array_distinct(analyzer(F.col(text_col))).alias("terms"), F.coalesce("barred", none).alias("barred"))
    spread = listed.select("doc", F.lit(True).alias("shown"), F.size("terms").alias("dl"), F.explode(F.concat("terms", F.array(F.lit(_EVERY)))).alias("term"), "barred")
    numbered = spread.join(F.broadcast(vocabulary.unionByName(marks)), "term").select("doc", "shown", "dl", "no", "barred")
    schema = T.StructType([T.StructField("docs", T.ArrayType(doc_type)), *T.StructType.fromDDL(term_blocks.BARRED_FIELDS.format(query=query_type.simpleString())).fields])
    built = numbered.mapInArrow(term_blocks.packed, schema)
    # One row, with BROADCAST_TERMS numbers at most; every word weighs 1.
    weighted = asked.join(vocabulary, "term").groupBy("query").agg(F.collect_list(F.struct("no", F.lit(1.0).alias("idf"))).alias("own"))
    near = weighted.agg(F.lit(1.0).alias("avgdl"), F.collect_list("query").alias("queries"), F.collect_list("own").alias("weights"))
    out = T.StructType([T.StructField("query", query_type), T.StructField("doc", doc_type), T.StructField("score", T.DoubleType())])
    found = built.crossJoin(F.broadcast(near)).mapInArrow(lambda batches: term_blocks.best(batches, k, 0.0, 0.0), out)
    return found.select("query", "doc", F.col("score").cast("long").alias("overlap"))


def top_k(scored: DataFrame, k: int, by: str | list[str] = "query", item: str = "doc", score: str = "score") -> DataFrame:
    """Adds ``rank``: score descending, ties by item; ``k`` per query."""
    if k < 1:
        raise ValueError("k must be positive")
    w = Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(F.desc(score), item)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def keyset_page(rows: DataFrame, key: str, after: str | None, size: int) -> DataFrame:
    """The next ``size`` rows in the order of a unique key; the last key of a page begins the next one."""
    if size < 1:
        raise ValueError("a page has one row at least")
    left = rows if after is None else rows.where(F.col(key) > after)
    return left.orderBy(key).limit(size)


def _grams(c: Column, size: Column) -> Column:
    places = F.sequence(F.lit(1), F.greatest(F.length(c) - size + 1, F.lit(1)))
    return F.array_distinct(F.transform(places, lambda i: F.substring(c, i, size)))


def containing(docs: DataFrame, passages: DataFrame, doc_col: str, text_col: str, passage_col: str) -> DataFrame:
    """All columns of both for every document whose text contains a passage.

    A passage's longest word with a space on either side is a word of every
    text that contains it, so passages meet documents by an equi-join on that
    word, and what meets is verified.  A passage without such a word goes by
    its first characters.  Null texts and passages match nothing.
    """
    words = F.split(passage_col, " ")
    inner = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))
    longest = F.array_max(F.transform(F.filter(inner, lambda w: w != ""), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    keyed = passages.where(F.col(passage_col).isNotNull()).withColumns(
        {"anchor": longest["w"], "gram": F.least(F.lit(GRAM), F.length(passage_col))}
    )
    sizes = {r["gram"]: r["n"] for r in keyed.groupBy(F.when(F.col("anchor").isNull(), F.col("gram")).alias("gram")).agg(F.count(F.lit(1)).alias("n")).collect()}
    small = sum(sizes.values()) <= BROADCAST_TERMS
    parts = []
    for size in sorted(sizes, key=str) or [None]:
        if size is None:
            some = keyed.where("anchor is not null").drop("gram")
            spread = F.array_distinct(F.split(text_col, " "))
        else:
            some = keyed.where(F.col("anchor").isNull() & (F.col("gram") == size)).withColumn("anchor", F.substring(passage_col, 1, size)).drop("gram")
            spread = _grams(F.col(text_col), F.lit(size)) if size else F.array(F.lit(""))
        if small:
            parts.append(docs.withColumn("anchor", F.explode(spread)).join(F.broadcast(some), "anchor").where(F.contains(text_col, passage_col)))
        else:
            # Texts stay where they are until a word of theirs has met a passage.
            met = docs.select(doc_col, F.explode(spread).alias("anchor")).join(some, "anchor").distinct()
            parts.append(docs.join(met, doc_col).where(F.contains(text_col, passage_col)))
    return reduce(DataFrame.unionByName, parts).drop("anchor")


def bm25_sql(docs: str, queries: str, doc_col: str = "doc_id", query_col: str = "item_id", prefix: str = "") -> str:
    """The same as SQL: a CTE ``{prefix}scored(query, doc, score)`` over two relations with a ``text``."""
    p = prefix
    return f"""{p}ix AS (SELECT {doc_col} AS doc, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS terms FROM {docs}),
{p}st AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM {p}ix),
{p}qt AS (SELECT DISTINCT {query_col} AS query, unnest(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')) AS term FROM {queries}),
{p}po AS (SELECT doc, dl, term, count(*) AS tf FROM (SELECT doc, len(terms) AS dl, unnest(terms) AS term FROM {p}ix) GROUP BY ALL),
{p}df AS (SELECT term, count(*) AS df FROM {p}po GROUP BY term),
{p}scored AS (SELECT query, doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM {p}qt JOIN {p}po USING (term) JOIN {p}df USING (term), {p}st GROUP BY query, doc)"""
