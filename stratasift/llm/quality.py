"""Line-first quality rules.

Every line is judged by itself (final punctuation, navigation bars, symbol
noise, shouting, boilerplate); failing lines are removed, and a document that
loses too much of its words that way is rejected.  Counts over the whole text
give a second, fixed base rule.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, plain_list, quoted, read_table, require

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
REPEAT_WINDOW = 8

#: A line passes only if its last character is one of these.
LINE_ENDS = tuple(".!?…:;,\"'”’»)]")

#: Lines that match are boilerplate.
BOILERPLATE = re.compile(
    r"all rights reserved|licensed under|released under|copyright|cookie|privacy policy"
    r"|terms of (?:use|service)|javascript|lorem ipsum|subscribe to|click here|sign in|log in",
    re.IGNORECASE,
)

#: Share of its words that a document may lose with its failing lines.
MAX_LOST = 0.5

OUTPUT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_failed_lines long, n_lost_words long, base_failed boolean, kept boolean, clean_text string"
)


def line_fails(line: str, n_words: int) -> bool:
    """True if a rule removes the line; lines without a word never fail."""
    if not n_words:
        return False
    bars = line.count("|")
    if bars >= 2 and bars * 5 >= n_words:
        return True  # navigation
    noise = sum(line.count(c) for c in "#*$%&<>")
    if noise >= 3 and noise * 10 >= n_words * 3:
        return True
    if line.endswith("!!") and line.count("!!") * 2 >= n_words:
        return True
    if n_words >= 3 and line.isupper():
        return True
    if not line.rstrip(SPACES).endswith(LINE_ENDS):
        return True
    if n_words >= 8:
        words = line.split()
        if sum(a == b for a, b in zip(words, words[1:])) * 2 >= n_words:
            return True  # stutter
    return BOILERPLATE.search(line) is not None


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words in windows of ``window`` words that occur twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    key = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(window):
            key = key * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + n]
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    # Hashes only nominate windows; the words decide.
    places: dict[tuple, list[int]] = {}
    for i in np.flatnonzero(np.isin(key, twice)).tolist():
        places.setdefault(tuple(words[i : i + window]), []).append(i)
    mark = np.zeros(len(words) + 1, np.int64)
    for found in places.values():
        if len(found) > 1:
            at = np.array(found)
            np.add.at(mark, at, 1)
            np.add.at(mark, at + window, -1)
    return int((np.cumsum(mark)[:-1] > 0).sum())


def judge(text: str, max_lost: float = MAX_LOST) -> tuple:
    """The values of :data:`OUTPUT` for one text."""
    words = text.encode().split()
    n_words = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    n_symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    kept_lines, dups, failed, lost = [], 0, 0, 0
    for line in text.split("\n"):
        k = len(line.encode().split())
        if k:
            if line in seen:
                dups += 1
            else:
                seen.add(line)
        if line_fails(line, k):
            failed += 1
            lost += k
        else:
            kept_lines.append(line)
    repeats = repeated_words(words)
    base_failed = n_words < 20 or 100 * repeats > 30 * n_words
    kept = not base_failed and lost <= max_lost * n_words
    return n_words, word_chars, n_symbols, dups, repeats, failed, lost, base_failed, kept, "\n".join(kept_lines)


def apply_quality_rules(
    df: DataFrame, text_col: str = "text", max_lost: float = MAX_LOST, with_text: bool = True
) -> DataFrame:
    """Adds the columns of :data:`OUTPUT` to every row of ``df``, in one pass without a shuffle.

    A null text counts as empty; an empty text has no words and so fails the
    base rule.  Rows stay one to one, repeated ones included, whatever their
    length; ids may be null.  An empty table gives an empty result.  Columns of
    ``df`` named like a result are replaced by it, all others pass through.
    ``with_text=False`` leaves ``clean_text`` and the text out.
    """
    require(df, text_col)
    added = [c.split(" ")[0] for c in OUTPUT.split(", ")]
    fields = [c for c in OUTPUT.split(", ") if with_text or not c.startswith("clean_text")]
    passed = [c for c in df.columns if c not in added and (with_text or c != text_col)]
    source = numbered(df, passed, text=F.col(quoted(text_col)))
    schema = source.drop("text").schema
    for f in fields:
        schema = schema.add(*f.split(" "))
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}

    def run(batches):
        for batch in batches:
            results = [judge(t or "", max_lost) for t in plain_list(batch, "text")]
            columns = batch.columns[: len(passed)]
            for i, f in enumerate(fields):
                columns.append(pa.array([r[i] for r in results], kinds[f.split(" ")[1]]))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema).toDF(*passed, *[f.split(" ")[0] for f in fields])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_quality_rules(docs, with_text=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_ENDS = "".join(c for c in LINE_ENDS)

ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 7], ' ') AS x FROM d, unnest(range(1, len(w) - 6)) u(s)),
twice AS (SELECT doc_id, s FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS k FROM win) WHERE k > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM twice, unnest(range(s, s + 8)) u(p) GROUP BY doc_id),
l AS (SELECT doc_id, i, string_split(t, chr(10))[i] AS x FROM d, unnest(range(1, len(string_split(t, chr(10))) + 1)) u(i)),
lw AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS lws, row_number() OVER (PARTITION BY doc_id, x ORDER BY i) AS nth FROM l),
lx AS (SELECT *, len(lws) AS k, length(x) - length(replace(x, '|', '')) AS bars, length(regexp_replace(x, '[^#*$%&<>]', '', 'g')) AS noise,
  (length(x) - length(replace(x, '!!', ''))) / 2 AS bangs, right(rtrim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS fin FROM lw WHERE len(lws) > 0),
lf AS (SELECT *, (bars >= 2 AND bars * 5 >= k) OR (noise >= 3 AND noise * 10 >= k * 3) OR (ends_with(x, '!!') AND bangs * 2 >= k)
    OR (k >= 3 AND regexp_matches(x, '\p{{Lu}}') AND NOT regexp_matches(x, '\p{{Ll}}')) OR NOT contains('{_ENDS.replace("'", "''")}', fin)
    OR (k >= 8 AND len(list_filter(range(1, k), lambda j: lws[j] = lws[j + 1])) * 2 >= k)
    OR regexp_matches(x, '(?i){BOILERPLATE.pattern}') AS fails FROM lx),
per AS (SELECT doc_id, count_if(nth > 1) AS dups, coalesce(sum(CASE WHEN fails THEN k ELSE 0 END), 0) AS lost FROM lf GROUP BY doc_id),
r AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dups, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM d LEFT JOIN per USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost <= {MAX_LOST} * n_words AS kept FROM r
"""
