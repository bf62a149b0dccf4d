"""A lexical index on disk: postings bucketed by term, with block maxima, versioned by commits.

Documents fall into cells by a hash, and cells into parts; the postings of a
term in a part are one row, cell after cell, with the largest term frequency and
the smallest length in each cell.  From these a search bounds what any document
of a cell can score, scores the most promising cells of each query first, and
other cells only where their bound reaches the k-th best score so far.

Every change is a commit: a folder of its own that counts once its manifest is
written.  A replaced document gets new postings, its old version is hidden, and
statistics carry the difference; archiving hides a version and leaves the
statistics alone, as its text is still part of the collection.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratasift.functions import text
from stratasift.staging import path_exists, remove_folder, stage

from . import term_cells
from .lexical import B, BROADCAST_TERMS, K1, idf, query_terms, top_k

#: Term buckets at most: a search reads only the folders of its terms' buckets.
BUCKETS = 64

#: Documents for each bucket; small collections have one.
BUCKET_DOCS = 4096

#: Documents in a cell on average, the unit of pruning.
CELL_DOCS = 256

#: Documents in a part on average: cells that are inverted, bounded and scored in one task.
PART_DOCS = 8192

#: Cells of each query that are scored before the others are judged by their bounds.
FIRST_CELLS = 8

_MANIFEST = "commit int, cells long, parts long, buckets int, n long, tokens long, mapping string"
_POSTINGS = "term string, part long, cells array<long>, max_tf array<int>, min_dl array<int>, ends array<int>, n_words long, docs array<{doc}>, tfs array<int>, dls array<int>"


def _cell(cells: Column) -> Column:
    return F.pmod(F.xxhash64("doc"), cells)


class MappingError(ValueError):
    """Documents don't have the columns that the index was built with."""


class LexicalIndex:
    """An index below one folder; ``doc`` and ``text`` are the columns of its documents.

    Null texts have no terms; null ids and ids that occur twice in one commit
    raise a ValueError, and so does a table with another schema
    (:class:`MappingError`).  A commit that fails half-way leaves the index as
    it was: what it has written is not in the manifest, and the next commit
    removes it first.
    """

    def __init__(self, spark: SparkSession, root: str, analyzer=text.tokens):
        self.spark, self.root, self.analyzer = spark, root.rstrip("/"), analyzer

    # Commits

    def manifest(self) -> list:
        """One row for each commit."""
        if not path_exists(self.spark, f"{self.root}/manifest"):
            return []
        return sorted(self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest").collect(), key=lambda r: r["commit"])

    def _folder(self, part: str, commit: int) -> str:
        return f"{self.root}/{part}/commit={commit}"

    def _read(self, part: str, ddl: str, commits: list[int]) -> DataFrame:
        """A part of all commits; one that has no file there is empty."""
        there = [c for c in commits if path_exists(self.spark, self._folder(part, c))]
        if not there:
            return self.spark.createDataFrame([], f"{ddl}, commit int")
        return self.spark.read.schema(f"{ddl}, commit int").option("basePath", f"{self.root}/{part}").parquet(*[self._folder(part, c) for c in there])

    def _mapping(self, docs: DataFrame) -> str:
        fields = {f.name: f.dataType.simpleString() for f in docs.schema}
        if fields.get("text") != "string" or "doc" not in fields:
            raise MappingError(f"an index needs doc and a text string, not {fields}")
        return ",".join(f"{k}:{fields[k]}" for k in sorted(fields))

    def _doc_type(self, mapping: str) -> str:
        return dict(x.split(":", 1) for x in mapping.split(","))["doc"]

    def _write(self, docs: DataFrame, commit: int, buckets: int, mapping: str, n: int, lost: DataFrame | None) -> None:
        """One commit: new versions of the ``n`` rows of ``docs``; ``lost`` has (doc, dl, words) of the versions that they replace, with distinct words."""
        docs.select("doc", "text").write.mode("overwrite").parquet(self._folder("forward", commit))
        rows = self.spark.read.parquet(self._folder("forward", commit))
        cells = max(1, n // CELL_DOCS)
        parts = -(-cells * CELL_DOCS // PART_DOCS)
        # Texts are shuffled, not their words or postings: a part's cells are inverted in one task, which writes its rows of every bucket.
        placed = rows.withColumn("cell", _cell(F.lit(cells))).withColumn("part", F.pmod("cell", F.lit(parts))).repartitionById(parts, F.col("part").cast("int"))
        words = self._words(placed)
        schema = _POSTINGS.format(doc=self._doc_type(mapping))
        bucket = F.pmod(F.xxhash64("term"), F.lit(buckets))
        blocks = words.select("doc", "part", "cell", F.size("words").alias("dl"), "words").mapInArrow(term_cells.inverted, schema).withColumn("bucket", bucket)
        blocks.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(self._folder("postings", commit))
        posted = self._read("postings", f"{schema}, bucket int", [commit])
        added = posted.select("term", F.element_at("ends", -1).cast("long").alias("df"))
        if lost is not None:
            added = added.unionByName(lost.select(F.explode("words").alias("term"), F.lit(-1).cast("long").alias("df")))
        added = added.groupBy("term").agg(F.sum("df").alias("df")).withColumn("bucket", bucket)
        # A bucket has more terms in a larger collection, so it is dealt to more tasks.
        dealt = added.repartition("bucket", F.pmod(F.hash("term"), F.lit(1 + n // (BUCKETS * BUCKET_DOCS))))
        dealt.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(self._folder("terms", commit))
        size = (n, posted.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0])
        if lost is not None:
            old = lost.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
            size = (size[0] - old[0], size[1] - old[1])
        self._commit(commit, cells, parts, buckets, *size, mapping)

    def _words(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("words", self.analyzer(F.coalesce("text", F.lit("")))).drop("text")

    def _commit(self, commit: int, cells: int, parts: int, buckets: int, n: int, tokens: int, mapping: str) -> None:
        row = self.spark.createDataFrame([(commit, cells, parts, buckets, n, tokens, mapping)], _MANIFEST)
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")

    def _begin(self, manifest: list) -> int:
        """The number of the next commit; what one of that number has left when it failed is removed."""
        commit = manifest[-1]["commit"] + 1 if manifest else 0
        for part in ("forward", "postings", "terms", "replaced", "archived"):
            remove_folder(self.spark, self._folder(part, commit))
        return commit

    def _checked(self, docs: DataFrame) -> int:
        one = docs.agg(F.count(F.lit(1)).alias("n"), F.count("doc").alias("ids")).first()
        if one["ids"] != one["n"]:
            raise ValueError("documents need ids")
        if docs.groupBy("doc").count().where("count > 1").limit(1).count():
            raise ValueError("an id occurs twice in one commit")
        return one["n"]

    def build(self, docs: DataFrame) -> None:
        """The first commit."""
        if self.manifest():
            raise ValueError("the index is built already; replace documents instead")
        mapping, n = self._mapping(docs), self._checked(docs)
        self._write(docs, self._begin([]), min(BUCKETS, 1 + n // BUCKET_DOCS), mapping, n, None)

    def _current(self, manifest: list) -> DataFrame:
        """(doc, text, commit): the newest version of every document."""
        mapping = manifest[0]["mapping"]
        rows = self._read("forward", f"doc {self._doc_type(mapping)}, text string", [r["commit"] for r in manifest])
        replaced = self._read("replaced", f"doc {self._doc_type(mapping)}, version int", [r["commit"] for r in manifest]).select("doc", F.col("version").alias("commit"))
        return rows.join(replaced, ["doc", "commit"], "left_anti")

    def replace(self, docs: DataFrame) -> None:
        """New versions of documents, or documents that are new; the old versions are found no more."""
        manifest = self._built()
        mapping = self._mapping(docs)
        if mapping != manifest[0]["mapping"]:
            raise MappingError(f"{mapping} is not {manifest[0]['mapping']}")
        n = self._checked(docs)
        commit = self._begin(manifest)
        old = self._words(self._current(manifest).join(docs.select("doc"), "doc", "left_semi"))
        lost = stage(old.select("doc", "commit", F.size("words").alias("dl"), F.array_distinct("words").alias("words")), "lost")
        lost.select("doc", F.col("commit").alias("version")).write.mode("overwrite").parquet(self._folder("replaced", commit))
        self._write(docs, commit, manifest[0]["buckets"], mapping, n, lost)

    def archive(self, ids: DataFrame) -> None:
        """Hides the present versions of the documents in ``ids(doc)``; unknown ids do nothing."""
        manifest = self._built()
        commit = self._begin(manifest)
        there = self._current(manifest).join(ids.select("doc").distinct(), "doc", "left_semi")
        there.select("doc", F.col("commit").alias("version")).write.mode("overwrite").parquet(self._folder("archived", commit))
        self._commit(commit, 0, 0, manifest[0]["buckets"], 0, 0, manifest[0]["mapping"])

    def _built(self) -> list:
        if not (manifest := self.manifest()):
            raise ValueError("there is no index here")
        return manifest

    # Reading

    def _postings(self, manifest: list, buckets: list[int] | None, columns: list[str]) -> DataFrame:
        ddl = _POSTINGS.format(doc=self._doc_type(manifest[0]["mapping"]))
        rows = self._read("postings", f"{ddl}, bucket int", [r["commit"] for r in manifest])
        return (rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).select("commit", "term", "part", "cells", *columns)

    def term_table(self, terms: DataFrame | None = None, buckets: list[int] | None = None) -> DataFrame:
        """(term, df, idf) of all terms, or of those in ``terms(term)`` and ``buckets``."""
        manifest = self._built()
        rows = self._read("terms", "term string, df long, bucket int", [r["commit"] for r in manifest])
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))
        if terms is not None:
            rows = rows.join(terms, "term", "left_semi")
        n = sum(r["n"] for r in manifest)
        return rows.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0").withColumn("idf", idf(F.lit(n), F.col("df")))

    def statuses(self) -> DataFrame:
        """(doc, status, commit): whether the newest version of each document is active or archived."""
        manifest = self._built()
        hidden = self._read("archived", f"doc {self._doc_type(manifest[0]['mapping'])}, version int", [r["commit"] for r in manifest])
        marks = hidden.select("doc", F.col("version").alias("commit"), F.lit("archived").alias("status")).distinct()
        return self._current(manifest).select("doc", "commit").join(marks, ["doc", "commit"], "left").select("doc", F.coalesce("status", F.lit("active")).alias("status"), "commit")

    def search(self, queries: DataFrame, query_col: str, text_col: str, k: int, visible: DataFrame | None = None, first_cells: int = FIRST_CELLS) -> DataFrame:
        """(query, doc, score, rank): the k best active documents of each query, the same as by scoring all.

        ``visible(doc)`` are the documents that may be found; statistics are
        those of all.
        """
        return self.explained_search(queries, query_col, text_col, k, visible, first_cells)[0]

    def explained_search(self, queries, query_col: str, text_col: str, k: int, visible=None, first_cells: int = FIRST_CELLS) -> tuple[DataFrame, DataFrame]:
        """The result of :meth:`search`, and (query, cell, bound, first, read) of every cell that shares a term."""
        manifest = self._built()
        terms = query_terms(queries, query_col, text_col, self.analyzer).count()
        if (sets := -(-terms // BROADCAST_TERMS)) <= 1:
            return self._explained(manifest, queries, query_col, text_col, k, visible, first_cells)
        # More terms than a task can hold go in several searches.
        dealt = F.pmod(F.xxhash64(query_col), F.lit(sets))
        some = [self._explained(manifest, queries.where(dealt == i), query_col, text_col, k, visible, first_cells) for i in range(sets)]
        return tuple(reduce(DataFrame.unionByName, parts) for parts in zip(*some, strict=True))

    def _explained(self, manifest, queries, query_col: str, text_col: str, k: int, visible, first_cells: int) -> tuple[DataFrame, DataFrame]:
        commits = [r["commit"] for r in manifest]
        n, tokens = sum(r["n"] for r in manifest), sum(r["tokens"] for r in manifest)
        average = tokens / n if tokens else 1.0
        asked = stage(query_terms(queries, query_col, text_col, self.analyzer), "asked")
        # There are 64 numbers at most.
        number = F.pmod(F.xxhash64("term"), F.lit(manifest[0]["buckets"])).cast("int")
        buckets = [r[0] for r in asked.select(number).distinct().collect()]
        known = self.term_table(asked.select("term").distinct(), buckets)
        # BROADCAST_TERMS at most, as are the weights.
        vocabulary = stage(known.select("term", "idf", (F.row_number().over(Window.orderBy("term")) - 1).alias("no")), "vocabulary")
        weights = term_cells.Weights(asked.join(F.broadcast(vocabulary), "term").select("query", "no", "idf").toArrow())
        shared = self.spark.sparkContext.broadcast(weights)
        query_type, doc_type = asked.schema["query"].dataType.simpleString(), self._doc_type(manifest[0]["mapping"])
        order = ["commit", "part"]

        def met(columns: list[str]) -> DataFrame:
            return self._postings(manifest, buckets, columns).join(F.broadcast(vocabulary), "term").select(*order, "no", "cells", *columns)

        heads = met(["max_tf", "min_dl"]).repartition(*order).sortWithinPartitions(*order)
        bounds = stage(
            heads.mapInArrow(lambda batches: term_cells.bounds(batches, shared.value, average, K1, B), f"query {query_type}, commit int, part long, cell long, bound double"),
            "bounds",
        )
        places = self.spark.createDataFrame([(r["commit"], r["cells"], r["parts"]) for r in manifest if r["cells"]], "commit int, n_cells long, n_parts long")

        def documents(some: DataFrame, mark: int) -> DataFrame:
            """Rows of a kind for documents, (doc, commit), in the parts where they are."""
            at = some.join(F.broadcast(places), "commit").withColumn("part", F.pmod(_cell(F.col("n_cells")), F.col("n_parts")))
            return at.select(*order, F.lit(mark).alias("no"), F.array("doc").alias("docs"))

        marks, only_visible = [], visible is not None
        for part in ("replaced", "archived"):
            some = self._read(part, f"doc {doc_type}, version int", commits).select("doc", F.col("version").alias("commit"))
            marks.append(documents(some, term_cells.HIDDEN))
        if only_visible:
            marks.append(documents(visible.select("doc").crossJoin(F.broadcast(places.select("commit"))), term_cells.VISIBLE))

        def scored(cells: DataFrame) -> DataFrame:
            here = cells.groupBy(*order, "cell").agg(F.collect_list("query").alias("asked"))
            here = stage(here.select(*order, F.lit(term_cells.ASKED).alias("no"), F.array("cell").alias("cells"), "asked"), "asked-cells")
            rows = met(["ends", "docs", "tfs", "dls"])
            for more in (*marks, here):
                rows = rows.unionByName(more, allowMissingColumns=True)
            rows = rows.repartition(*order).sortWithinPartitions(*order)
            return rows.mapInArrow(
                lambda batches: term_cells.best(batches, shared.value, average, k, K1, B, only_visible), f"query {query_type}, doc {doc_type}, score double"
            )

        cell = ["query", "commit", "cell"]
        first = stage(top_k(bounds.withColumn("place", F.struct("commit", "cell")), first_cells, item="place", score="bound").select(*cell, "part"), "first-cells")
        early = stage(top_k(scored(first), k), "early")
        reached = early.where(F.col("rank") == k).select("query", F.col("score").alias("reached"))
        # Scores are rounded to six digits, and bounds are sums in another order.
        rest = bounds.join(first, cell, "left_anti").join(reached, "query", "left")
        rest = rest.where(F.col("reached").isNull() | (F.col("bound") >= F.col("reached") - 1e-5))
        both = early.drop("rank").unionByName(scored(rest))
        read = first.select(*cell, F.lit(True).alias("first")).unionByName(rest.select(*cell, F.lit(False).alias("first")))
        report = bounds.join(read, cell, "left").select("query", "commit", "cell", "bound", F.coalesce("first", F.lit(False)).alias("first"), F.col("first").isNotNull().alias("read"))
        return top_k(both, k).select("query", "doc", "score", "rank"), report
