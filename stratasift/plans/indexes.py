"""Queries over stored indexes: lexical postings with block maxima, and an inverted-file vector index."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratasift.operators import dense, lexical
from stratasift.operators.lexical_index import LexicalIndex
from stratasift.operators.vector_index import VectorIndex, recall
from stratasift.staging import new_folder

from .catalog import register
from .fixtures import table
from .retrieval_eval import _DENSE_SQL, BM25, ranked_sql


def _documents(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text")


@register("lexical_index_terms", f"WITH {BM25} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, st")
def lexical_index_terms(spark, sf):
    """Builds the index and reads its dictionary back."""
    index = LexicalIndex(spark, new_folder(spark, "lexical-index"))
    index.build(_documents(spark, sf))
    return index.term_table().select("term", "df", F.round("idf", 6).alias("idf"))


@register("bm25_indexed_top10", f"WITH {BM25}, {ranked_sql('r', 'scored', 10)} SELECT query, doc, score, rank FROM r")
def bm25_indexed_top10(spark, sf):
    """What :func:`bm25_top10` finds, from a stored index and with cells passed over whose bound is too low."""
    index = LexicalIndex(spark, new_folder(spark, "lexical-index"))
    index.build(_documents(spark, sf))
    return index.search(table(spark, sf, "benchmark"), "item_id", "text", 10)


@register(
    "lexical_index_replace",
    f"WITH {BM25}, shown AS (SELECT * FROM scored WHERE doc % 11 <> 0), {ranked_sql('r', 'shown', 10)} SELECT query, doc, score, rank FROM r",
)
def lexical_index_replace(spark, sf):
    """Old versions are replaced, new documents added and others archived; what is found are the documents as they are."""
    docs = _documents(spark, sf)
    d = F.col("doc")
    old = docs.where(d % 5 != 1).withColumn("text", F.when(d % 3 == 0, F.concat_ws(" ", "text", F.lit("an old ending"), "text")).otherwise(F.col("text")))
    index = LexicalIndex(spark, new_folder(spark, "lexical-index"))
    index.build(old)
    index.archive(docs.where(d % 11 == 0).select("doc"))
    index.replace(docs.where((d % 3 == 0) | (d % 5 == 1)))
    # A new version is active again until it is archived itself.
    index.archive(docs.where(d % 11 == 0).select("doc"))
    return index.search(table(spark, sf, "benchmark"), "item_id", "text", 10)


@register(
    "lexical_index_statuses",
    """SELECT doc_id AS doc, CASE WHEN doc_id % 7 = 0 AND doc_id % 3 <> 0 THEN 'archived' ELSE 'active' END AS status, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS commit FROM documents""",
)
def lexical_index_statuses(spark, sf):
    """Archived documents stay in the index; a replaced one is active again."""
    docs = _documents(spark, sf)
    d = F.col("doc")
    index = LexicalIndex(spark, new_folder(spark, "lexical-index"))
    index.build(docs)
    index.archive(docs.where(d % 7 == 0).select("doc"))
    index.replace(docs.where(d % 3 == 0))
    return index.statuses()


def _vector_index(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"), "label")
    index = VectorIndex(spark, new_folder(spark, "vector-index"), 64)
    index.build(e)
    return index, e.where("doc % 20 = 0").select(F.col("doc").alias("query"), "vector"), e


@register("ann_all_cells_top10", f"WITH {_DENSE_SQL}, {ranked_sql('r', 'dscored', 10)} SELECT query, doc, score, rank FROM r")
def ann_all_cells_top10(spark, sf):
    """Probing every cell is the exact search."""
    index, asked, _ = _vector_index(spark, sf)
    return index.search(asked, 10, probes=len(index.centroids()))


@register("ann_top10")
def ann_top10(spark, sf):
    """Every vector whose id is divisible by 20 asks the cells around it."""
    index, asked, _ = _vector_index(spark, sf)
    return index.search(asked, 10)


@register("ann_distinct_owner_top5")
def ann_distinct_owner_top5(spark, sf):
    """The best vector of each owner (here: label) in the probed cells."""
    index, asked, _ = _vector_index(spark, sf)
    return index.search(asked, 5, owner="label")


@register("ann_recall")
def ann_recall(spark, sf):
    """How many of the exact ten each query finds in its cells."""
    index, asked, corpus = _vector_index(spark, sf)
    exact = dense.similarity_top_k(corpus, asked, 10)
    return recall(index.search(asked, 10), exact).withColumn("probed", F.lit(index.probes())).withColumn("cells", F.lit(len(index.centroids())))


@register(
    "keyset_walk",
    """SELECT CAST((row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) - 1) // greatest(1, (SELECT (count(*) + 3) // 4 FROM documents)) AS INT) AS page, CAST(doc_id AS VARCHAR) AS key FROM documents""",
)
def keyset_walk(spark, sf):
    """All rows in four pages, each of which begins after the last key of the one before."""
    keys = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("key"))
    size = max(1, -(-keys.count() // 4))
    pages, after = [], None
    while True:
        page = lexical.keyset_page(keys, "key", after, size)
        last = page.agg(F.max("key")).first()[0]
        if last is None:
            break
        pages.append(page.withColumn("page", F.lit(len(pages))))
        after = last
    out = pages[0]
    for page in pages[1:]:
        out = out.unionByName(page)
    return out.select("page", "key")
