"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again before the next one begins.  All but the last return
the columns of ``docs``, further ones included, whatever their names.  Null
texts count as empty.  An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratasift.llm import common, decontamination, near_duplicates, packing, quality, substrings

#: Passages of so many words that also occur earlier are removed.
PASSAGE_WORDS = 50


def _by_place(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with names that no operator uses, and those of its ids and texts."""
    names = [f"column_{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names[docs.columns.index("doc_id")], names[docs.columns.index("text")]


def _with_text(docs: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """The columns of ``docs`` from ``rows``, with new texts and their lengths."""
    columns = []
    for i, c in enumerate(docs.columns):
        size = F.length(text).cast(docs.schema[i].dataType)
        columns.append(F.col(text) if c == "text" else size if c == "n_chars" else F.col(f"column_{i}"))
    return rows.select(*columns).toDF(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail a rule go, and documents that lose too much by that or fail the base rule.

    Null, empty and very short texts fail.  Repeated rows are judged alike, and
    texts of any length are judged whole.
    """
    rows, _, text = _by_place(docs)
    judged = quality.apply_quality_rules(rows, text)
    return _with_text(docs, judged.where("kept"), "clean_text")


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays: the one with the smallest id.

    Of repeated rows one stays, and so does one of all null and empty texts; a
    null id is smaller than all others.
    """
    rows, key, text = _by_place(docs)
    return near_duplicates.one_per_group(rows, key, text).toDF(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long passages that also occur earlier are cut out of the texts; no document goes.

    Rows that share an id are one document; a null id comes before all.
    """
    rows, key, text = _by_place(docs)
    cut = substrings.remove_repeats(rows, key, text, window=PASSAGE_WORDS, keep_layout=True)
    return _with_text(docs, cut, "kept_text")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a benchmark item contaminates go, with all rows of their ids; an empty benchmark removes none."""
    benchmark = common.read_table(spark, sf_dir, "benchmark")
    rows, key, text = _by_place(docs)
    found = decontamination.contamination(rows, benchmark, key, text).where("contaminated").select(F.col(key).alias("bad")).distinct()
    return rows.join(found, F.col(key).eqNullSafe(F.col("bad")), "left_anti").toDF(*docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences.

    A null or empty text is its end alone; repeated rows are packed as often as they occur.
    """
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicate_groups),
    ("substring_dedup", repeated_passages),
    ("decontamination", benchmark_decontamination),
    ("packing", packed_sequences),
]

#: SQL expresses neither near-duplicate groups by samples nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is a table in the shared folder."""
    docs = common.read_table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = common.stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
