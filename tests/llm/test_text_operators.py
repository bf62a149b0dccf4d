"""Quality rules, token counts, packing, decontamination and substring removal against brute force and on odd input."""

import hashlib
import heapq
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratasift.llm import bpe_counts, decontamination, packing, quality, substrings

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
WORDS = "the of and Thing, ing. a ou été Éan. der die x| ### don't <|endoftext|> 12 ²3 中文 naïve".split()
DOCS = "doc_id long, text string"


def random_texts(n, seed, longest=80):
    rng = random.Random(seed)
    return [rng.choice([" ", "\n", " \t", "  "]).join(rng.choices(WORDS, k=rng.randint(0, longest))) for _ in range(n)]


def odd(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "two words"), (5, "long " * 30_000)]
    return spark.createDataFrame(rows, DOCS)


def with_clashes(df):
    """``df`` with columns named like those that operators use inside, and one with a dot."""
    for c in ("__text", "text_", "id", "__id", "c0", "t", "__block", "place", "n.m", "key", "words"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.mark.parametrize(
    "operator",
    [quality.apply_quality_rules, lambda df: bpe_counts.count_tokens(df, BYTE_BPE), substrings.remove_repeats],
    ids=["quality", "token_counts", "substrings"],
)
def test_other_columns_pass_through_whatever_their_names(spark, operator):
    plain = {(r["doc_id"], r["n_words"] if "n_words" in r else r["n_tokens"]) for r in operator(odd(spark)).collect()}
    rows = operator(with_clashes(odd(spark))).collect()
    assert len(rows) == 7 and all(r["n.m"] == r["__text"] == r["c0"] == r["id"] == "clash" for r in rows)
    assert {(r["doc_id"], r["n_words"] if "n_words" in r else r["n_tokens"]) for r in rows} == plain
    assert operator(with_clashes(odd(spark)).limit(0)).count() == 0


def repeated_by_brute_force(words, size=8):
    windows = Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    mark = set()
    for i in range(len(words) - size + 1):
        if windows[tuple(words[i : i + size])] > 1:
            mark.update(range(i, i + size))
    return len(mark)


def test_quality_counts(spark):
    texts = random_texts(60, 1) + ["a b c d e f g h a b c d e f g h i", "x\nx\n\nx", None]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("n_words", F.lit("clash"))
    for r in quality.apply_quality_rules(df).collect():
        text = texts[r["doc_id"]] or ""
        words = text.encode().split()
        assert r["n_words"] == len(words)
        assert r["word_chars"] == sum(len(w.decode()) for w in words)
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in text)
        assert r["n_repeat_words"] == repeated_by_brute_force(words)
        lines = text.split("\n")
        assert r["n_dup_lines"] == sum(bool(x.split()) and x in lines[:i] for i, x in enumerate(lines))
        assert r["base_failed"] == (len(words) < 20 or 100 * r["n_repeat_words"] > 30 * len(words))


def test_quality_verdicts(spark):
    rng = random.Random(5)
    clean = "\n".join("Here " + " ".join(rng.choices(["tree", "walks", "over", "green", "hill", "and", "sings"], k=12)) + "." for _ in range(9))
    nav = "\n".join("Home | About | Contact | Products | News | Help" for _ in range(1)) + "\n" + " | ".join(f"link{i}" for i in range(40))
    shout = " ".join(f"BUY{i}!!" for i in range(40))
    noise = " ".join(f"word{i}###" for i in range(40))
    got = [quality.judge(t)[8] for t in (clean, nav, shout, noise, clean + "\nAll rights reserved.")]
    assert got == [True, False, False, False, True]
    assert "rights" not in quality.judge(clean + "\nAll rights reserved.")[9]


def test_quality_on_odd_input(spark):
    rows = quality.apply_quality_rules(odd(spark)).collect()
    assert len(rows) == 7 and not any(r["kept"] for r in rows)
    assert quality.apply_quality_rules(odd(spark).limit(0)).count() == 0


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    texts = random_texts(80, 2) + ["", None, "a" * 3000, "  \n\n x", "end  ", "<|endoftext|> <|endoftext|>\n"]
    want = [len(e.ids) for e in Tokenizer.from_file(BYTE_BPE).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("n_tokens", F.lit("clash"))
    for r in bpe_counts.count_tokens(df, BYTE_BPE).collect():
        assert r["n_tokens"] == want[r["doc_id"]]
        assert r["n_bytes"] == len((texts[r["doc_id"]] or "").encode())
        assert r["over_limit"] == (r["n_tokens"] > 512)
    assert bpe_counts.count_tokens(odd(spark), BYTE_BPE).count() == 7


def check_packing(pieces, want_ids):
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for key, ids in want_ids.items():
        rows = sorted(by_doc[key], key=lambda r: r["start"])
        assert [r["start"] for r in rows] == [sum(x["length"] for x in rows[:i]) for i in range(len(rows))]
        assert sum(r["length"] for r in rows) == len(ids) == rows[0]["doc_tokens"]
        for r in rows:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
            assert list(r["ids"]) == part
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048


def test_packing_places_every_id_once(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    texts = random_texts(120, 3, 300) + ["", None, "word " * 9000, "İ! <|ENDOFTEXT|> x\x01y"]
    want = {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    check_packing(packing.pack_documents(df, WORD_BPE).collect(), want)


def test_packing_on_odd_input(spark):
    rows = packing.pack_documents(odd(spark).withColumn("start", F.lit("clash")), WORD_BPE, with_ids=False).collect()
    assert sum(r["doc_id"] == 4 for r in rows) == 2
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert packing.pack_documents(odd(spark).limit(0), WORD_BPE).count() == 0


def test_histogram_packing_is_tight():
    rng = random.Random(4)
    histogram = Counter(min(2048, int(rng.paretovariate(1.1) * 40)) for _ in range(100_000))
    patterns = packing.pack_histogram(histogram)
    placed = Counter()
    for packs, contents in patterns:
        assert sum(n * k for n, k in contents) <= 2048
        for n, k in contents:
            placed[n] += packs * k
    assert placed == histogram
    assert sum(n * k for n, k in histogram.items()) > 0.98 * 2048 * sum(p for p, _ in patterns)
    with pytest.raises(ValueError):
        packing.pack_histogram({4000: 1})


def packed_piece_by_piece(histogram, capacity):
    """Fills of the packs if each piece goes, longest first, into the shortest pack or a new one."""
    fills = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            if fills and fills[0] + length <= capacity:
                heapq.heapreplace(fills, fills[0] + length)
            else:
                heapq.heappush(fills, length)
    return sorted(fills)


def test_histogram_packing_equals_piece_by_piece():
    rng = random.Random(9)
    cases = [({6: 2, 2: 3}, 10), ({1: 50}, 7), ({7: 3}, 7), ({5: 4, 3: 4, 1: 9}, 8)]
    for _ in range(300):
        capacity = rng.randint(1, 60)
        cases.append(({n: rng.randint(1, 30) for n in rng.sample(range(1, capacity + 1), rng.randint(1, min(12, capacity)))}, capacity))
    cases.append((Counter(min(2048, int(rng.paretovariate(1.1) * 40)) for _ in range(30_000)), 2048))
    for histogram, capacity in cases:
        patterns = packing.pack_histogram(histogram, capacity)
        fills = sorted(f for packs, contents in patterns for f in [sum(n * k for n, k in contents)] * packs)
        assert fills == packed_piece_by_piece(histogram, capacity)
        assert len(patterns) <= 3 * len(histogram)
        placed = Counter()
        for packs, contents in patterns:
            for n, k in contents:
                placed[n] += packs * k
        assert placed == histogram
    assert sum(p for p, _ in packing.pack_histogram({6: 2, 2: 3}, 10)) == 2


def test_ids_of_odd_words_equal_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    encoder = packing.ChunkEncoder(WORD_BPE)
    assert encoder.splits_letters
    rng = random.Random(10)
    alphabet = list("abzÀéñßŒœŁ'`.,;:!?-|<>#19") + ["İ", "ı", "ŉ", "ǆ", "ǅ", "e\u0301", "\u0301", "ſ", "ﬁ", "中", "Ω", "ª", "²", "don't", "'s", "<|endoftext|>", "\x01", "\u200b", "\xa0"]
    texts = [" ".join("".join(rng.choices(alphabet, k=rng.randint(1, 6))) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    got = []
    for at in range(0, len(texts), 100):
        got += encoder.encode([t.encode() for t in texts[at : at + 100]])
        if at == 2000:
            encoder.cache.age()
    for text, ids in zip(texts, got, strict=True):
        assert list(memoryview(ids).cast("I")) == library.encode(text, add_special_tokens=False).ids, text


def contaminated_by_brute_force(docs, items):
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = lambda t: word.findall((t or "").translate(low))
    out = {}
    for key, text in docs:
        w, hit, found = cut(text), set(), set()
        for item, passage in items:
            p = cut(passage)
            k = min(13, len(p))
            for j in range(len(p) - k + 1 if p else 0):
                for i in range(len(w) - k + 1):
                    if w[i : i + k] == p[j : j + k]:
                        hit.update(range(i, i + k))
                        found.add(str(item))
        out[key] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("rows", [500_000, 0])
def test_decontamination_equals_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", rows)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB" if rows else "-1")
    try:
        decontaminated_as_expected(spark)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_no_document_is_shuffled_with_its_words(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], DOCS).select(F.col("doc_id").alias("id"), "text", F.lit(1).alias("tag"))
    items = decontamination.item_table(spark.createDataFrame([(1, "b c d e"), (2, "f")], "item_id long, text string"), "item_id", "text", 13)
    places = decontamination.shingle_places(items)
    places = spark.createDataFrame(places.collect(), places.schema)
    hits = decontamination.shingle_hits(docs, places, [1, 3], lambda df: df, small=False)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = spark._jvm.PythonSQLUtils.explainString(hits._jdf.queryExecution(), "formatted")
        found = sorted((r["place"], r["gram"]) for r in hits.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    shuffled = [part.split("Input")[1].splitlines()[0] for part in plan.split("\n\n") if ") Exchange" in part and "Input" in part]
    assert "SortMergeJoin" in plan and shuffled and not any(" words#" in columns or "[words#" in columns or "piece#" in columns for columns in shuffled)
    assert found == [(1, "b c d"), (2, "c d e"), (5, "f"), (6, "\x00")]


def decontaminated_as_expected(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(40)] + ["Été", "the", "THE"]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate((30, 13, 14, 5, 1, 0, 20, 20))]
    items += [(9, None), (None, "w1 w2 w3 w4"), (3, items[3][1]), (11, "unseen words only here")]
    docs = []
    for i in range(40):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 30)))]
        words = rng.choice(items[:8])[1].split()
        a = rng.randint(0, max(0, len(words) - 13))
        parts += [", ".join(words[a : a + rng.randint(12, 40)]).upper().replace("É", "É"), " ".join(rng.choices(vocabulary, k=20))]
        docs.append((i, " - ".join(parts)))
    docs += [(100, None), (101, ""), (102, "w1"), (103, items[6][1] + " " + items[6][1]), (104, ("w3 " * 20_000) + items[7][1])]
    want = contaminated_by_brute_force(docs, [("" if i is None else i, t) for i, t in items])
    df = spark.createDataFrame(docs, DOCS).withColumn("found", F.lit("clash"))
    rows = decontamination.contamination(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, hit, found = want[r["doc_id"]]
        assert (r["n_words"], r["n_hit"], sorted(r["item_ids"])) == (n, hit, found)
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n)


def test_decontamination_on_odd_input(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r["contaminated"] for r in decontamination.contamination(odd(spark), none).collect())
    items = spark.createDataFrame([(1, "one"), (2, "two words")], "item_id long, text string")
    rows = decontamination.contamination(odd(spark), items).collect()
    assert len(rows) == 7 and sum(r["contaminated"] for r in rows) == 3


def repeats_by_brute_force(docs, window):
    first, out = {}, {}
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    for key, text in order:
        w = (text or "").split()
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), (key, i))
    for key, text in docs:
        w = (text or "").split()
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] != (key, i):
                gone.update(range(i, i + window))
        out[key] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


@pytest.mark.parametrize("window,shard,fan", [(20, 1000, 1000), (20, 1, 2), (12, 1000, 1), (50, 3, 3)])
def test_removed_words_equal_brute_force(spark, monkeypatch, window, shard, fan):
    monkeypatch.setattr(substrings, "FAN", fan)
    monkeypatch.setattr(substrings, "MAX_SHARD", shard)
    monkeypatch.setattr(substrings, "LOCAL_REGIONS", 50)
    rng = random.Random(window)
    vocabulary = [f"w{i}" for i in range(30)]
    shared = [rng.choices(vocabulary, k=rng.randint(window - 3, 3 * window)) for _ in range(6)]
    docs = []
    for i in range(60):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += rng.choices(vocabulary, k=rng.randint(0, 40)) + rng.choice(shared)
        docs.append((i, " ".join(w)))
    docs += [(70, "a " * 100), (71, None), (72, ""), (73, docs[3][1]), (None, docs[4][1]), (74, docs[3][1] + " tail")]
    want = repeats_by_brute_force(docs, window)
    df = spark.createDataFrame(docs, DOCS).withColumn("n_words", F.lit("clash"))
    rows = substrings.remove_repeats(df, window=window).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r["n_words"], r["n_removed"], r["kept_text"]) == want[r["doc_id"]]


def test_removal_keeps_the_layout(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    df = spark.createDataFrame([(1, passage), (2, f"Before it.\n\n{passage}\nAfter  it.")], DOCS)
    rows = {r["doc_id"]: r["kept_text"] for r in substrings.remove_repeats(df, keep_layout=True).collect()}
    assert rows == {1: passage, 2: "Before it.\n\nAfter  it."}


def test_removal_on_odd_input(spark):
    assert substrings.remove_repeats(odd(spark)).count() == 7
    assert substrings.remove_repeats(odd(spark).limit(0)).count() == 0
    with pytest.raises(ValueError):
        substrings.remove_repeats(odd(spark), window=4)
    with pytest.raises(ValueError, match="integers"):
        substrings.remove_repeats(odd(spark).withColumn("doc_id", F.lit("a")))


def test_texts_that_share_an_id(spark):
    one, two = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    df = spark.createDataFrame([(1, one), (2, one + " end"), (2, two), (3, two)], DOCS)
    rows = sorted((r["doc_id"], r["n_removed"]) for r in substrings.remove_repeats(df).collect())
    # What one row of document 2 loses, the other loses at the same places.
    assert rows == [(1, 0), (2, 40), (2, 40), (3, 40)]


def test_suffix_automaton_matching():
    rng = random.Random(8)
    for _ in range(30):
        parts = [[rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(4)]
        machine = substrings.SuffixAutomaton()
        for p in parts:
            machine.add(p)
        query = [rng.choice("abcd") for _ in range(20)]
        runs = {tuple(p[i:j]) for p in parts for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
        want = [max((n for n in range(e + 2) if n == 0 or tuple(query[e + 1 - n : e + 1]) in runs)) for e in range(20)]
        assert machine.matching(query) == want


def test_schema_of_the_digest_columns(spark):
    df = substrings.remove_repeats(spark.createDataFrame([(1, "x y")], DOCS))
    assert df.schema["kept_text"].dataType == T.StringType()
    assert hashlib.sha256(b"x y").hexdigest() == df.select(F.sha2("kept_text", 256)).first()[0]
