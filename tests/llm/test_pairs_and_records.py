"""SimHash, near duplicates, components, archives, chats and URL rules."""

import base64
import gzip
import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stratasift.llm import chat, components, golay, near_duplicates, simhash, url_rules, warc

DOCS = "doc_id long, text string"


def test_golay_lists_share_a_key_within_one_bit():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 5000)
    other = words ^ (1 << rng.integers(0, 23, 5000))
    a, b = golay.codeword_indices(words), golay.codeword_indices(other)
    assert all(set(x[x >= 0]) & set(y[y >= 0]) for x, y in zip(a, b, strict=True))
    assert ((golay.codeword_indices(words, 3) >= 0).sum(axis=1) == 1).all()


def fingerprint(text, size):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closed(keys, links):
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


@pytest.mark.parametrize("pairwise", [48, 2])
def test_simhash_components_equal_brute_force(spark, monkeypatch, pairwise):
    monkeypatch.setattr(simhash, "PAIRWISE_BUCKET", pairwise)
    rng = random.Random(1)
    texts = []
    for _ in range(25):
        w = [f"w{rng.randint(0, 999)}" for _ in range(rng.randint(2, 400))]
        texts.append(" ".join(w))
        for _ in range(rng.randint(0, 3)):
            v = list(w)
            v[rng.randrange(len(v))] = "Changed"
            texts.append(" ".join(v))
    texts += [None, "", "  ", "a", "a b", "A b"]
    docs = [(i * 3 + 5, t) for i, t in enumerate(texts)]
    fp = {k: fingerprint(t, 3) for k, t in docs}
    links = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2]
    want = closed(fp, links)
    rows = simhash.simhash_components(spark.createDataFrame(docs, DOCS).withColumn("fp", F.lit("clash"))).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r["fingerprint"], r["component_id"]) == (f"{fp[r['doc_id']]:016x}", want[r["doc_id"]])


def test_simhash_of_empty_tables_repeated_rows_and_long_texts(spark):
    assert simhash.simhash_components(spark.createDataFrame([], DOCS)).count() == 0
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = simhash.simhash_components(spark.createDataFrame([(3, long), (3, long), (2, long + " x"), (None, "own"), (9, None)], DOCS)).collect()
    assert len(rows) == 5 and sum(r["doc_id"] == 3 for r in rows) == 2
    assert {r["component_id"] for r in rows if r["doc_id"] in (2, 3)} == {2}
    assert {r["fingerprint"] for r in rows if r["doc_id"] == 3} == {f"{fingerprint(long, 3):016x}"}


@pytest.mark.parametrize("words,changed", [(250, 3)])
def test_a_large_group_is_one_component(spark, words, changed):
    rng = random.Random(12)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(words)]
    docs = []
    for k in range(300):
        v = list(base)
        for at in rng.sample(range(words), changed):
            v[at] = f"x{k}_{at}"
        docs.append((k, " ".join(v)))
    sets = {k: set(near_duplicates.shingle_set(t.encode(), 5).tolist()) for k, t in docs}
    links = [(a, b) for a in sets for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = {k for k, c in closed(sets, links).items() if k == c}
    assert {r["doc_id"] for r in near_duplicates.one_per_group(spark.createDataFrame(docs, DOCS)).collect()} == want


def test_bucket_links_keep_every_connection():
    rng = np.random.default_rng(2)
    prints = set()
    for x in rng.integers(-(2**62), 2**62, 20).tolist():
        for _ in range(60):
            y = x
            for _ in range(rng.integers(0, 4)):
                y ^= 1 << int(rng.integers(0, 63))
            prints.add(y)
    fp = np.array(sorted(prints), np.int64)
    key, row = simhash.golay_keys(fp)
    owner = fp[row]
    order = np.lexsort((owner, key))
    u, v = simhash.bucket_links(key[order], owner[order], 2)
    all_links = [(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    assert closed(prints, all_links) == closed(prints, zip(u.tolist(), v.tolist(), strict=True))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 180)] + [(500, 600 + i) for i in range(50)] + [(7, 7), (9, 8), (8, 9)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = closed({x for e in edges for x in e}, edges)
    assert got == {k: v for k, v in want.items() if k != 7}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_document_of_each_group_stays(spark):
    rng = random.Random(3)
    docs, key = [], 0
    for _ in range(40):
        w = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(60, 300))]
        for copies in range(rng.randint(1, 40) if key < 100 else 2):
            v = list(w)
            if copies:
                for _ in range(rng.randint(0, 2)):
                    v[rng.randrange(len(v))] = f"x{rng.randint(0, 99)}"
            docs.append((key, " ".join(v)))
            key += 1
    docs += [(key, docs[0][1]), (key + 1, None), (key + 2, ""), (0, docs[0][1]), (key + 3, "one two"), (None, "nobody's own text")]
    sets = {}
    for k, t in docs:
        sets[k] = set(near_duplicates.shingle_set((t or "").encode(), 5).tolist()) or {"empty"}
    ids = [k for k in sets if k is not None]
    links = [(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = {k for k, c in closed(ids, links).items() if k == c} | {None}
    df = spark.createDataFrame(docs, DOCS).withColumn("row", F.lit("clash"))
    rows = near_duplicates.one_per_group(df).collect()
    assert {r["doc_id"] for r in rows} == want and len(rows) == len(want)
    assert near_duplicates.one_per_group(df.limit(0)).count() == 0


def test_copies_in_a_large_bucket_of_similar_texts_are_found(spark, monkeypatch):
    def one_bucket(texts, shingle):
        return texts.where("text <> ''").select(F.lit(1).cast("long").alias("key"), "content")

    monkeypatch.setattr(near_duplicates, "candidate_keys", one_bucket)
    rng = random.Random(6)
    core = [f"c{i}" for i in range(170)]
    texts = [core + [f"u{k}_{i}" for i in range(rng.randint(45, 90))] for k in range(300)]
    # Copies of some, copies of copies, and a family whose members are all alike.
    for k in range(0, 60, 3):
        for head in (0, 1):
            v = list(texts[k] if head == 0 else texts[-1])
            v[rng.randrange(175, len(v))] = f"x{k}_{head}"
            texts.append(v)
    texts += [core + [f"f{i}" for i in range(40)] + [f"y{k}_{i}" for i in range(5)] for k in range(60)]
    docs = [(k, " ".join(t)) for k, t in enumerate(texts)]
    sets = {k: set(near_duplicates.shingle_set(t.encode(), 5).tolist()) for k, t in docs}
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = {k for k, c in closed(sets, links).items() if k == c}
    assert 250 < len(want) < 302
    rows = near_duplicates.one_per_group(spark.createDataFrame(docs, DOCS)).collect()
    assert {r["doc_id"] for r in rows} == want and len(rows) == len(want)


@pytest.mark.parametrize("limits", [(32 << 20, 200_000), (300, 3)])
def test_archives_give_back_what_was_written(spark, tmp_path, monkeypatch, limits):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", limits[0])
    monkeypatch.setattr(warc, "RANGE_ROWS", limits[1])
    rng = random.Random(4)
    bodies = ["", None, "same", "é\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n", "x" * 100_000] + [f"p{i}" for i in range(10)]
    pages = [(i, f"http://WWW.Example.com/{rng.randint(0, 5)}?q#f", rng.choice(bodies)) for i in range(60)]
    pages += [(100, None, "n"), (101, "no scheme\r\n", "same"), (None, "http://a.b/", "own"), (3, pages[3][1], pages[3][2])]
    folder = f"file://{tmp_path}/warc"
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), folder)
    rows = warc.capture_index(spark, folder).collect()
    assert len(rows) == len(pages)
    first = {}
    for k, _, html in pages:
        if k is not None:
            first[html or ""] = min(first.get(html or "", k), k)
    for r in rows:
        html = next(h for k, _, h in pages if k == r["page_id"]) or ""
        head = first.get(html, r["page_id"])
        assert r["payload_bytes"] == len(html.encode())
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if head == r["page_id"] else ("revisit", head))
    assert rows == sorted(rows, key=lambda r: warc.sort_key(tuple(r)))
    archives = {p.name: p.read_bytes() for p in Path(f"{tmp_path}/warc").glob("part-*")}
    assert len(archives) > 20 or limits[0] > 300
    # Any tool reads them whole, and a record alone from its offset.
    assert sum(gzip.decompress(x).count(b"WARC-Record-ID") for x in archives.values()) == len(pages)
    for r in rows:
        member = archives[r["run"]][r["record_offset"] : r["record_offset"] + r["record_length"]]
        headers, block = warc.parse_record(zlib.decompress(member, 31))
        assert headers["X-Page"] == str("" if r["page_id"] is None else r["page_id"])
        assert len(block) == (r["payload_bytes"] if r["record_type"] == "response" else 0)
    with pytest.raises(ValueError, match="breaks off"):
        list(warc.parse_archive(next(iter(archives.values()))[:-30]))


def test_minimum_size_and_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    warc.write_archives(pages, f"file://{tmp_path}/a", min_bytes=4)
    got = {r["page_id"]: r["refers_to"] for r in warc.read_records(spark, f"file://{tmp_path}/a").collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}
    warc.write_archives(pages.limit(0), f"file://{tmp_path}/b")
    assert warc.capture_index(spark, f"file://{tmp_path}/b").count() == 0


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree_merges(k):
    rng = random.Random(k)
    runs = [sorted(rng.randint(0, 50) for _ in range(rng.randint(0, 20))) for _ in range(k)]
    assert list(warc.LoserTree(runs, key=lambda x: x)) == sorted(x for r in runs for x in r)


def test_runs_that_arrive_in_pieces_are_merged_without_sorting():
    keys = [("u", "d", True, p, run, 0) for run, p in [("a", 1), ("a", 4), ("b", 2), ("b", 3), ("b", 1), ("a", 0), ("a", 9)]]
    assert warc.natural_runs(keys) == [(0, 2), (2, 4), (4, 5), (5, 7)]
    assert warc.natural_runs([]) == []


def test_prefixes_of_conversations_collapse(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yes"),
        (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (2, 2, "user", "more"),
        (3, 0, "user", "hi"),
        (4, 0, "user", "hi"), (4, 1, "assistant", "no"),
        (5, 0, "user", "hi"), (5, 1, "assistant", "no"),
        (6, 0, None, None), (7, None, "user", "x"), (None, 0, "user", "y"), (None, 1, "user", "y"), (None, 0, "user", "z"),
        (None, 5, "user", "x"), (None, 0, "user", "hi"), (9, 0, "user", "long " * 50_000),
        (8, 0, "user", "hi"), (8, 0, "user", "hi"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit("clash"))
    found = chat.collapse_and_render(df).collect()
    got = {r["conv_id"]: (r["n_turns"], r["n_copies"]) for r in found if r["conv_id"] is not None}
    assert got == {2: (3, 1), 4: (2, 2), 6: (1, 1), 7: (1, 2), 8: (2, 1), 9: (1, 1)}
    # Rows without an id are conversations of one turn.
    lone = sorted((r["rendered"], r["n_turns"], r["n_copies"]) for r in found if r["conv_id"] is None)
    assert lone == [("<|im_start|>user\ny<|im_end|>\n", 1, 2), ("<|im_start|>user\nz<|im_end|>\n", 1, 1)]
    text = {r["conv_id"]: r["rendered"] for r in found}
    assert len(text[9]) == 5 * 50_000 + len("<|im_start|>user\n<|im_end|>\n")
    assert text[4] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nno<|im_end|>\n"
    assert chat.collapse_and_render(df.limit(0)).count() == 0


def verdict_by_brute_force(url, rules):
    rest = (url or "").split("://", 1)
    if len(rest) < 2:
        return "", "", None, "allow"
    cut = min((i for i in map(rest[1].find, "/?#") if i >= 0), default=len(rest[1]))
    host = "".join(c.lower() if c.isascii() else c for c in rest[1][:cut])
    tail = rest[1][cut:]
    path = tail[: min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))]
    fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best[0] if best else "allow"


#: The registered query's rules, written out once more.
CONTRACT_RULES = [
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
]


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_url_rules_equal_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(url_rules, "BROADCAST_RULES", broadcast)
    assert url_rules.RULES == CONTRACT_RULES
    urls = [None, "", "no scheme", "http://", "http://com/en/x", "http://A.Example.COM/en/7?x", "https://example.com/en/6#f", "x://com/e",
            "http://xcom/en/", "http://q.example.net/de/81", "http://net/de/8", "ftp://a.org/es/", "http://a.org?es/", "a://b://com/en/", "http://ex.com:80/en/",
            "http://" + "a." * 300 + "com/en/" + "p" * 5000]
    rows = [(i, u) for i, u in enumerate(urls)] + [(4, urls[4])]
    df = spark.createDataFrame(rows, "page_id long, url string")
    for c in ("host", "u", "hit", "c0", "n.m", "__u"):
        df = df.withColumn(c, F.lit("clash"))
    out = url_rules.apply_url_rules(df, url_rules.rules_frame(spark)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == verdict_by_brute_force(r["url"], CONTRACT_RULES)
        assert (r["u"], r["n.m"], r["c0"]) == ("clash",) * 3
    dotted = df.select("page_id", F.col("url").alias("the.url"))
    assert url_rules.apply_url_rules(dotted, url_rules.rules_frame(spark), "the.url").count() == len(rows)
    none = url_rules.rules_frame(spark).limit(0)
    assert {r["verdict"] for r in url_rules.apply_url_rules(df, none).collect()} == {"allow"}
    assert url_rules.apply_url_rules(df.limit(0), url_rules.rules_frame(spark)).count() == 0
