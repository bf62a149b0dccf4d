"""Benchmark decontamination by a prefix-filtered set join over shingles.

An item occurs in a document where one of its windows does.  Documents are cut
into words once, and the places of the shingles that some item has are kept.
These give the order of rarity; of each window the rarest shingle, which is the
necessary prefix of a join for full containment, says where in a document the
item would have to begin.  Beginnings that leave no room for a window are ruled
out, and at the rest all shingles of the item must be found at their places:
unbroken runs that are as long as a window are occurrences.  DataFrame
functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import quoted, read_table, require, stage

WINDOW_WORDS = 13

#: Words of a shingle; windows with fewer are one shingle.
SHINGLE_WORDS = 3

#: A document is contaminated if at least this share of its words is hit.
MIN_SHARE = 0.05

#: Follows the words of each text in the scan; no word has its character.
_END = "\x00"

#: Benchmark tables are counted; up to so many rows they are broadcast, beyond they are shuffled.
BROADCAST_ROWS = 500_000

#: One word before A-Z are lower-cased: neither ASCII control, space nor punctuation.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words as they stand in the text; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_WORD), F.lit(0))


def lowered(text: Column) -> Column:
    """A-Z lower-cased, nothing else changed."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _key(words: list[Column]) -> Column:
    # Equal shingles have equal keys, whatever else has; the words are compared where keys meet.
    return F.xxhash64(F.lit(len(words)), *[F.lower(w) for w in words])


def _gram(words: list[Column]) -> Column:
    return F.concat_ws(" ", *words)


def _following(words: Column, at: Column, width: int) -> list[Column]:
    return [F.get(words, at + i) for i in range(width)]


def item_table(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(item, row_key, words, length, span, width): the items with words, and how long windows and shingles of each are."""
    return (
        benchmark.select(
            F.coalesce(F.col(quoted(item_col)).cast("string"), F.lit("")).alias("item"),
            words_of(lowered(F.col(quoted(text_col)))).alias("words"),
        )
        .distinct()
        .withColumn("length", F.size("words"))
        .where("length > 0")
        .withColumn("row_key", F.struct("item", F.sha2(F.concat_ws(" ", "words"), 256).alias("words")))
        .withColumn("span", F.least(F.lit(window), "length"))
        .withColumn("width", F.least(F.lit(SHINGLE_WORDS), "span"))
    )


def shingle_places(items: DataFrame) -> DataFrame:
    """(row_key, length, span, width, at, gram, key) of each shingle of each item."""
    placed = items.select(
        "row_key", "words", "length", "span", "width", F.explode(F.sequence(F.lit(0), F.col("length") - F.col("width"))).alias("at")
    )
    by_width = [_following(F.col("words"), F.col("at"), k) for k in range(1, SHINGLE_WORDS + 1)]

    def of_width(f):
        chosen = F.lit(None)
        for words in by_width:
            chosen = F.when(F.col("width") == len(words), f(words)).otherwise(chosen)
        return chosen

    return placed.select("row_key", "length", "span", "width", "at", of_width(_gram).alias("gram"), of_width(_key).alias("key"))


def shuffled_hits(named: DataFrame, known: DataFrame, widths: list[int]) -> DataFrame:
    """:func:`shingle_hits` for item shingles that are too many to broadcast.

    A word is shuffled with those of its own shingle only, never with its
    document, and the ends of documents are added without a join, so that no
    key has a row of every document.
    """
    cut = named.select("id", "tag", words_of(F.col("text")).alias("words"))
    ends = cut.select("id", "tag", F.size("words").alias("n_words"), F.size("words").alias("place"), F.lit(_END).alias("gram"))
    if not widths:
        return ends
    most = max(widths)
    pieces = F.transform("words", lambda w, i: F.struct(i.alias("place"), F.slice("words", i + 1, F.lit(most)).alias("piece")))
    spread = cut.select("id", "tag", F.size("words").alias("n_words"), F.inline(pieces))
    parts = []
    for k in widths:
        piece = [F.get("piece", F.lit(i)) for i in range(k)]
        mine = spread.where(F.size("piece") >= k).select("id", "tag", "n_words", "place", _gram(piece).alias("raw"), _key(piece).alias("own"))
        theirs = known.where(F.col("width") == k).select("key", "gram")
        parts.append(mine.join(theirs, F.col("own") == F.col("key")).where(lowered(F.col("raw")) == F.col("gram")).select("id", "tag", "n_words", "place", "gram"))
    return reduce(DataFrame.unionByName, parts, ends)


def shingle_hits(named: DataFrame, places: DataFrame, widths: list[int], near, small: bool = True) -> DataFrame:
    """(id, tag, n_words, place, gram) wherever a document has a shingle of an item, and at the end of each document."""
    known = places.select("width", "key", "gram").distinct()
    if not small:
        return shuffled_hits(named, known, widths)
    end = F.lit(_END)
    ends = named.sparkSession.range(1).select(F.lit(0).alias("width"), _key([end]).alias("key"), end.alias("gram"))
    cut = named.select("id", "tag", F.concat(words_of(F.col("text")), F.array(end)).alias("words"))
    spread = cut.select("id", "tag", "words", F.posexplode("words").alias("place", "word"))
    last = F.col("word") == end
    keys = [F.struct(F.lit(k).alias("width"), _key(_following(F.col("words"), F.col("place"), k)).alias("key")) for k in widths]
    at_end = F.struct(F.lit(0).alias("width"), _key([F.col("word")]).alias("key"))
    if len(keys) <= 1:
        keyed = spread.withColumn("k", F.when(last, at_end).otherwise(keys[0]) if keys else F.when(last, at_end))
    else:
        keyed = spread.withColumn("k", F.explode(F.when(last, F.array(at_end)).otherwise(F.array(*keys))))
    same = F.lit(False)
    for k in widths:
        same |= (F.col("width") == k) & (F.col("gram") == _gram([lowered(w) for w in _following(F.col("words"), F.col("place"), k)]))
    on = (F.col("k.key") == F.col("key")) & (F.col("k.width") == F.col("width"))
    return (
        keyed.join(near(known.unionByName(ends)), on)
        .where((F.col("width") == 0) | same)
        .select("id", "tag", (F.size("words") - 1).alias("n_words"), "place", "gram")
    )


def necessary_prefixes(places: DataFrame, frequency: DataFrame) -> DataFrame:
    """(gram, row_key, at): for each window its rarest shingle and its place in the item.

    A window with a shingle that no document has cannot occur and has no row.
    """
    rated = places.join(frequency, "gram", "left")
    # A shingle stands in the windows that begin from this place on up to its own.
    first = F.greatest(F.lit(0), F.col("at") - F.col("span") + F.col("width"))
    last = F.least(F.col("at"), F.col("length") - F.col("span"))
    rarest = (
        rated.withColumn("window", F.explode(F.sequence(first, last)))
        .groupBy("row_key", "window")
        .agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "gram", "at")).alias("best"))
        .where("best.seen > 0")
    )
    return rarest.select("best.gram", "row_key", "best.at").distinct()


def occurrences(found: DataFrame, places: DataFrame, items: DataFrame, prefixes: DataFrame, near) -> DataFrame:
    """(id, tag, item, start, windows, span): runs of windows of an item in a document."""
    shapes = items.select("row_key", "length", "span")
    candidates = (
        found.join(near(prefixes), "gram")
        .withColumn("begin", F.col("place") - F.col("at"))
        .join(near(shapes), "row_key")
        # The item may begin before the document or end after it, but a window must fit.
        .where("n_words >= span and begin + length >= span and begin <= n_words - span")
        .select("id", "tag", "row_key", "begin")
        .distinct()
    )
    expected = (
        candidates.join(near(places.select("row_key", "at", "span", "width", "gram")), "row_key")
        .withColumn("place", F.col("begin") + F.col("at"))
        .where("place >= 0")
    )
    there = found.select(F.col("id").alias("f_id"), F.col("tag").alias("f_tag"), F.col("place").alias("f_place"), F.col("gram").alias("f_gram"))
    same = (
        F.col("id").eqNullSafe(F.col("f_id"))
        & (F.col("tag") == F.col("f_tag"))
        & (F.col("place") == F.col("f_place"))
        & (F.col("gram") == F.col("f_gram"))
    )
    diagonal = ["id", "tag", "row_key", "begin", "span", "width"]
    order = Window.partitionBy("id", "tag", "row_key", "begin").orderBy("at")
    runs = (
        expected.join(there, same, "left_semi")
        .withColumn("run", F.col("at") - F.row_number().over(order))
        .groupBy(*diagonal, "run")
        .agg(F.min("place").alias("start"), F.count(F.lit(1)).cast("int").alias("shingles"))
        .withColumn("windows", F.col("shingles") - (F.col("span") - F.col("width")))
        .where("windows > 0")
    )
    return runs.select("id", "tag", F.col("row_key.item").alias("item"), "start", "windows", "span")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW_WORDS,
    min_share: float = MIN_SHARE,
) -> DataFrame:
    """One row per document: id, ``n_words``, ``n_hit``, ``n_items``, ``item_ids``, ``hit_starts``, ``contaminated``.

    A window is ``window`` consecutive words of an item, or the whole item if
    it has fewer but some; a word of a document inside any occurrence of a
    window is hit.  ``item_ids`` are those items as sorted strings,
    ``hit_starts`` the places and lengths of the occurrences.  A document is
    contaminated if it has a hit and at least ``min_share`` of its words are.

    Null and empty texts have no words; items without words never occur.
    Repeated items count once, items with one id count as one, a null item id
    is the empty string.  Repeated documents keep a row each, and a null
    document id is an id.  Texts and items of any length are compared whole.
    An empty table of documents gives an empty result, an empty benchmark no
    hit.  Other columns are not looked at.
    """
    require(docs, id_col, text_col)
    require(benchmark, item_col, item_text_col)
    items = stage(item_table(benchmark, item_col, item_text_col, window), "items")
    places = stage(shingle_places(items), "places")
    # Item shingles bound every benchmark table that is joined below.
    sizes = {r["width"]: r["count"] for r in places.groupBy("width").count().collect()}
    small = sum(sizes.values()) <= BROADCAST_ROWS
    near = F.broadcast if small else (lambda df: df)
    # Rows with one id are told apart by their texts.
    named = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")).withColumn("tag", F.xxhash64("text"))
    hits = stage(shingle_hits(named, places, sorted(sizes), near, small), "hits")
    whole = hits.where(F.col("gram") == _END).select("id", "tag", F.col("n_words").cast("long").alias("n_words"))
    found = hits.where(F.col("gram") != _END)
    frequency = found.groupBy("gram").agg(F.count(F.lit(1)).alias("seen"))
    prefixes = necessary_prefixes(places, frequency)
    runs = (
        occurrences(found, places, items, prefixes, near)
        .groupBy("id", "tag")
        .agg(F.collect_list(F.struct("item", "start", "windows", "span")).alias("runs"))
        .select(F.col("id").alias("r_id"), F.col("tag").alias("r_tag"), "runs")
    )
    none = F.array().cast("array<struct<item:string,start:int,windows:int,span:int>>")
    same_row = F.col("id").eqNullSafe(F.col("r_id")) & (F.col("tag") == F.col("r_tag"))
    judged = whole.join(runs, same_row, "left").select("id", "n_words", F.coalesce("runs", none).alias("runs"))
    last = lambda r: r["start"] + r["windows"] - 1
    covered = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], last(r) + r["span"] - 1))))
    starts = F.transform(
        "runs",
        lambda r: F.transform(F.sequence(r["start"], last(r)), lambda s: F.struct(s.alias("start"), r["span"].alias("span"))),
    )
    item_ids = F.array_sort(F.array_distinct(F.transform("runs", lambda r: r["item"])))
    return judged.select(
        F.col("id").alias(id_col),
        "n_words",
        F.size(covered).cast("long").alias("n_hit"),
        F.size(item_ids).cast("long").alias("n_items"),
        item_ids.alias("item_ids"),
        F.array_distinct(F.flatten(starts)).alias("hit_starts"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") >= F.lit(min_share) * F.col("n_words")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SQL_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_SQL_WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_SQL_WORD}') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS t
  FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) u(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM win),
spans AS (
  SELECT doc_id, s, k, array_to_string(w[s:s + k - 1], ' ') AS t
  FROM d, sizes, unnest(range(1, len(w) - k + 2)) u(s)),
hit AS (SELECT doc_id, s, spans.k, item_id FROM spans JOIN win ON spans.k = win.k AND spans.t = win.t),
places AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(s, s + k)) u(p) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
    string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
"""
