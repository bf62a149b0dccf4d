"""Extension points: embedders, scorers and retrievers that callers bring along."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from stratasift.functions import rules

from . import dense, fusion, lexical

#: Retrievers by name: (docs, queries, k) -> (query, doc, score, rank).
RETRIEVERS: dict[str, Callable[[DataFrame, DataFrame, int], DataFrame]] = {}

#: The smallest depth at which rankings may be compared.
LEAST_DEPTH = 10


def retriever(name: str):
    def add(function):
        RETRIEVERS[name] = function
        return function

    return add


@retriever("bm25")
def bm25(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    return lexical.top_k(lexical.bm25_top_k(docs, queries, k, "doc", "query"), k)


@retriever("dense")
def dense_search(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    return dense.similarity_top_k(docs, queries, k)


@retriever("hybrid_rrf")
def hybrid(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Both of the others, fused by reciprocal ranks; documents and queries have texts and vectors."""
    paths = fusion.union_paths({"bm25_es": bm25(docs, queries, k), "dense_bge": dense_search(docs, queries, k)})
    return fusion.reciprocal_rank_fusion(paths, {}).where(F.col("rank") <= k).select("query", "doc", "score", "rank")


def ensemble_rerank(pairs: DataFrame, scores: list[Column], k: int) -> DataFrame:
    """(query, doc, score, place, provenance) of ``pairs(query, doc, rank)`` by the calibrated mean of several scorers.

    A scorer that fails gives null.  One failure in a query's candidates, and
    the query keeps the order that it came in, which the provenance says.
    """
    raw = sum(scores[1:], scores[0]) / len(scores)
    whole = Window.partitionBy("query")
    judged = pairs.select("query", "doc", "rank", raw.alias("raw")).withColumn("failed", F.count_if(F.col("raw").isNull()).over(whole) > 0)
    scored = judged.withColumn("score", F.when(~F.col("failed"), F.round(rules.platt(F.col("raw")), 6)))
    order = Window.partitionBy("query").orderBy(F.desc_nulls_last("score"), "rank")
    provenance = F.when(F.col("failed"), "deterministic_fallback").otherwise("cross_encoder")
    return (
        scored.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= k)
        .select("query", "doc", "score", "place", provenance.alias("provenance"))
    )


def retrieve(name: str, docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    if k < LEAST_DEPTH:
        raise ValueError(f"rankings are compared at a depth of {LEAST_DEPTH} at least")
    if name not in RETRIEVERS:
        raise ValueError(f"no retriever {name}; there are {sorted(RETRIEVERS)}")
    return RETRIEVERS[name](docs, queries, k)


def embed(texts: Column, load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Column:
    """Vectors from a model that each Python worker loads once."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series(model(batch.fillna("").tolist()))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<float>")(texts)


def score_pairs(left: Column, right: Column, load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]) -> Column:
    """Scores of text pairs from a model that each Python worker loads once."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for a, b in batches:
            yield pd.Series(model(list(zip(a.fillna(""), b.fillna(""), strict=True))), dtype="float64")

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")(left, right)


def describe_images(df: DataFrame, content: str, load: Callable[[], Callable[[list[bytes]], list[tuple[list[float], list[str], list[str]]]]]) -> DataFrame:
    """Adds ``vector``, ``core`` and ``rest`` (OCR blocks in and out of an image's centre) from a model that each worker loads once."""
    schema = T.StructType(
        [*df.schema, T.StructField("vector", T.ArrayType(T.FloatType())), *[T.StructField(n, T.ArrayType(T.StringType())) for n in ("core", "rest")]]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            found = model([bytes(x or b"") for x in batch[content]])
            vector, core, rest = zip(*found, strict=True) if found else ((), (), ())
            yield batch.assign(vector=list(vector), core=list(core), rest=list(rest))

    return df.mapInPandas(run, schema)


def schema_diff(a: dict, b: dict, path: str = "$") -> list[str]:
    """Paths at which two JSON schemas differ."""
    if type(a) is not type(b):
        return [f"{path}: {type(a).__name__} and {type(b).__name__}"]
    if isinstance(a, dict):
        out = [f"{path}.{k}: only on the left" for k in sorted(a.keys() - b.keys())]
        out += [f"{path}.{k}: only on the right" for k in sorted(b.keys() - a.keys())]
        for k in sorted(a.keys() & b.keys()):
            out += schema_diff(a[k], b[k], f"{path}.{k}")
        return out
    if isinstance(a, list):
        out = [] if len(a) == len(b) else [f"{path}: lengths {len(a)} and {len(b)}"]
        for i, (x, y) in enumerate(zip(a, b, strict=False)):
            out += schema_diff(x, y, f"{path}[{i}]")
        return out
    return [] if a == b else [f"{path}: {a!r} and {b!r}"]
