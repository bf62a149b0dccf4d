"""Text normalisation, tokens, windows and set similarity as column expressions."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full-width punctuation and the ASCII sign that stands for it.
CJK_PUNCTUATION = ("？！。，、；：", "?!.,,;:")

#: Default size of character windows, and how much neighbours share.
CHUNK_SIZE, CHUNK_OVERLAP = 500, 50


def collapse_space(c: Column) -> Column:
    """Runs of white space become one space; none is left at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_passage(c: Column) -> Column:
    """Form in which passages are compared.  Spark has no NFKC; :func:`nfkc_passage` adds it."""
    return collapse_space(c)


def nfkc_passage(c: Column) -> Column:
    """:func:`normalize_passage` after Unicode NFKC, in Arrow batches."""
    @F.pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFKC")

    return collapse_space(nfkc(c))


def normalize_query(c: Column) -> Column:
    """Collapsed white space, ASCII punctuation, lower case."""
    return F.lower(F.translate(collapse_space(c), *CJK_PUNCTUATION))


def normalize_question(c: Column) -> Column:
    """Collapsed white space and lower case (not a full case fold: ``ß`` stays)."""
    return F.lower(collapse_space(c))


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def cjk_and_word_tokens(c: Column) -> Column:
    """Distinct bigrams of CJK runs and distinct lower-cased ASCII words."""
    runs = F.regexp_extract_all(c, F.lit("[\\u4e00-\\u9fff]{2,}"), F.lit(0))
    bigrams = F.flatten(
        F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2))))
    )
    words = F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)
    return F.array_distinct(F.concat(bigrams, words))


def window_count(length: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """How many character windows a text of that length gives."""
    step = size - overlap
    return F.when(length <= 0, 0).otherwise(F.greatest(F.lit(1), F.ceil((length - overlap) / step))).cast("int")


def char_windows(c: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Windows of ``size`` characters, each ``size - overlap`` after the one before; the last ends with the text."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the window")
    step, n = size - overlap, F.length(c)
    count = window_count(n, size, overlap)
    return F.when(count == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.substr(c, i * step + 1, F.lit(size)))
    )


def pack_blocks(blocks: list[str | None], size: int, overlap: int) -> list[dict]:
    """Chunks of a document's blocks in order: neighbours share one, joined by a line end, while they fit.

    A block that is larger than a chunk is cut into windows of its own.  Each
    chunk names its blocks by their numbers; empty blocks have none.
    """
    chunks: list[dict] = []
    joined, members = [], []

    def close():
        if joined:
            chunks.append({"text": "\n".join(joined), "blocks": list(members)})
        joined.clear()
        members.clear()

    for number, block in enumerate(blocks):
        if not block:
            continue
        if len(block) > size:
            close()
            for at in range(0, max(1, len(block) - overlap), size - overlap):
                chunks.append({"text": block[at : at + size], "blocks": [number]})
            continue
        if joined and sum(map(len, joined)) + len(joined) + len(block) > size:
            close()
        joined.append(block)
        members.append(number)
    close()
    return chunks


def packed_blocks(blocks: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """:func:`pack_blocks` of an array of blocks, in Arrow batches: a greedy rule has no closed form."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the chunk")

    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else pack_blocks(list(r), size, overlap) for r in rows], dtype="object")

    run.__annotations__ = {"rows": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<struct<text:string,blocks:array<int>>>")(blocks)


def char_ngrams(c: Column, n: int = 3, limit: int = 500) -> Column:
    """Distinct character n-grams of the first ``limit`` characters."""
    head = F.substring(c, 1, limit)
    return F.when(F.length(head) < n, F.array().cast("array<string>")).otherwise(
        F.array_distinct(
            F.transform(F.sequence(F.lit(1), F.length(head) - n + 1), lambda i: F.substr(head, i, F.lit(n)))
        )
    )


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(
        F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    )


def ngram_jaccard(a: Column, b: Column) -> Column:
    return jaccard(char_ngrams(F.coalesce(a, F.lit(""))), char_ngrams(F.coalesce(b, F.lit(""))))


def characters(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))


def overlap_entailment(premise: Column, hypothesis: Column) -> tuple[Column, Column]:
    """(contradiction, entailment) from shared characters, where no model is at hand."""
    p, h = characters(F.coalesce(premise, F.lit(""))), characters(F.coalesce(hypothesis, F.lit("")))
    empty = (F.size(p) == 0) | (F.size(h) == 0)
    entail = F.when(empty, 0.3).otherwise(F.least(jaccard(p, h) * 1.2, F.lit(0.9)))
    extra = F.size(F.array_except(h, p)) / F.greatest(F.size(p), F.lit(1))
    contra = F.when(empty, 0.1).otherwise(F.greatest(F.lit(0.0), F.least(extra * 0.3, F.lit(0.6))))
    return contra, entail


def keyword_hits(c: Column, keywords: list[str]) -> Column:
    """How many of the keywords the text contains."""
    if not keywords:
        return F.lit(0)
    total = F.lit(0)
    for k in keywords:
        total = total + F.contains(c, F.lit(k)).cast("int")
    return total


def visible_html(c: Column) -> Column:
    """Text outside tags, scripts and styles: trimmed fragments, one a line."""
    bare = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "\n")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", "\n"), r"(?s)<[^>]*>", "\n")
    lines = F.transform(F.split(bare, "\n"), lambda x: F.trim(x))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def longest_common_substring(a: Column, b: Column) -> Column:
    """Length of the longest run of characters that two texts share, in Arrow batches."""
    @F.pandas_udf("int")
    def longest(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_longest_run(p or "", q or "") for p, q in zip(x, y, strict=True)], dtype="int32")

    return longest(a, b)


def _longest_run(a: str, b: str) -> int:
    """By bisection over lengths: if a run of n is shared, so is one of n - 1."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        n = (low + high + 1) // 2
        grams = {a[i : i + n] for i in range(len(a) - n + 1)}
        if any(b[i : i + n] in grams for i in range(len(b) - n + 1)):
            low = n
        else:
            high = n - 1
    return low


def token_cut(c: Column, share: float = 2 / 3, least: int = 128) -> Column:
    """The first two thirds of the characters, ``least`` at least: a stand-in for cutting by tokens."""
    return F.substr(c, F.lit(1), F.greatest(F.floor(F.length(c) * share), F.lit(least)).cast("int"))


def escape_markers(c: Column, markers: list[str]) -> Column:
    """Reserved markers inside untrusted text are put out of action by a blank after their first character."""
    for m in markers:
        c = F.replace(c, F.lit(m), F.lit(m[0] + " " + m[1:]))
    return c


def only_embedded(c: Column, term: str, letters: str = "\\x{4e00}-\\x{9fff}") -> Column:
    """Whether a term occurs, but never without such a letter before or after it."""
    alone = rf"(?<![{letters}])\Q{term}\E(?![{letters}])"
    return F.contains(c, F.lit(term)) & ~c.rlike(alone)
