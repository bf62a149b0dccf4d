"""Near-duplicate documents by SimHash, for similarities that two bits don't reach.

Two texts that share four fifths of their shingles differ in about ten of the
64 bits of their whole fingerprints.  Besides the whole fingerprint, every text
therefore has views: SimHashes of small min-wise samples of its shingles, which
agree if the samples do.  The whole fingerprint gets the Golay keys of the
fingerprint operator; each view has the indices of the codewords nearest to its
three segments as one key.  Texts that meet are verified by the exact Jaccard
similarity of their shingle sets.

A large bucket is compared by a star and a chain first.  The pairs of its
members that these leave unconnected are found by an exact join on the rarest
shingles: of two texts with the similarity, the first few shingles in the order
of their frequency share one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_list, frees_memory, quoted, remove_folder, require, stage, stage_at
from .components import connected_components
from .golay import codeword_indices
from .simhash import SEGMENTS, golay_keys, groups_of, majority_bits, shingle_hashes

SHINGLE_WORDS = 5
SIMILARITY = 0.8

#: Views and the shingles in each: at similarity 0.8 one of 16 samples of four agrees in 99.98 % of cases.
VIEWS, SAMPLE = 16, 4

#: All members of a bucket up to this size are compared at once.
PAIRWISE_BUCKET = 24

#: Shingles are counted in so many slots, whatever the corpus; any order keeps the join exact, a good one keeps it small.
SLOTS, SLOT_RANGES = 1 << 18, 64

#: Pairs that are looked at in one step within a task.
BLOCK_PAIRS = 1 << 18

#: Bits of a set's parities: two sets differ in as many elements at least as their parities do in bits.
PARITY_BITS = 1024

_ODD = (np.arange(1, VIEWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _stored(shingles: np.ndarray) -> bytes:
    return shingles.astype("<u8").tobytes()


def _loaded(shingles: bytes) -> np.ndarray:
    return np.frombuffer(shingles, "<u8")


def shingle_set(text: bytes, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text.lower().split(), size))


def view_prints(shingles: np.ndarray) -> np.ndarray:
    """SimHash of the ``SAMPLE`` smallest shingles under each of the views' orders."""
    if len(shingles) <= SAMPLE:
        return np.full(VIEWS, majority_bits(shingles) if len(shingles) else 0, np.int64)
    mixed = shingles[None, :] * _ODD[:, None]
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    chosen = shingles[np.argpartition(mixed, SAMPLE - 1, axis=1)[:, :SAMPLE]]
    bits = np.unpackbits(chosen.astype("<u8").view(np.uint8).reshape(VIEWS, SAMPLE, 8), axis=2, bitorder="little")
    over = (2 * bits.sum(axis=1) > SAMPLE).astype(np.uint8)
    return np.packbits(over, axis=1, bitorder="little").view("<i8").ravel().astype(np.int64)


def nearest_keys(prints: np.ndarray) -> np.ndarray:
    """The indices of the codewords nearest to the three segments, as one number."""
    bits, key = prints.view(np.uint64), np.zeros(len(prints), np.int64)
    for shift, width in SEGMENTS:
        segment = ((bits >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
        key = (key << 12) | codeword_indices(segment, 3)[:, 0]
    return key


def candidate_keys(texts: DataFrame, shingle: int) -> DataFrame:
    """(key, content) for every key of every text; texts without words have none."""

    def run(batches):
        for batch in batches:
            contents = batch.column(0).to_pylist()
            whole, views, rows = [], [], []
            for i, text in enumerate(binary_list(batch, "text")):
                hashes = shingle_hashes(text.lower().split(), shingle)
                if not len(hashes):
                    continue
                whole.append(majority_bits(hashes))
                views.append(view_prints(np.unique(hashes)))
                rows.append(i)
            if not rows:
                continue
            at = np.array(rows)
            key, row = golay_keys(np.array(whole, np.int64))
            keys, owners = [key], [at[row]]
            table = np.stack(views)
            for v in range(VIEWS):
                keys.append((np.int64(v + 4) << 36) | nearest_keys(np.ascontiguousarray(table[:, v])))
                owners.append(at)
            keys, owners = np.concatenate(keys), np.concatenate(owners)
            ids = pa.array(contents, pa.binary())
            for lo in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[lo : lo + 100_000]), ids.take(pa.array(owners[lo : lo + 100_000]))],
                    names=["key", "content"],
                )

    return texts.mapInArrow(frees_memory(run), "key long, content binary")


def bucket_pairs(keyed: DataFrame) -> DataFrame:
    """Pairs (u < v) to verify: all of a small bucket, a star and a chain of a large one.

    Each member of a large bucket also has a row whose v is null: its other pairs are still to be tried.
    """

    def run(batches):
        # Of a large bucket only its first members and the last one are held.
        key, few, last, large = None, [], None, False
        us, vs = [], []

        def all_pairs():
            for i, x in enumerate(few):
                us.extend([x] * (len(few) - i - 1))
                vs.extend(few[i + 1 :])

        for batch in batches:
            for k, member in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key:
                    if not large:
                        all_pairs()
                    key, few, last, large = k, [member], member, False
                    continue
                if member == last:
                    continue
                if not large and len(few) < PAIRWISE_BUCKET:
                    few.append(member)
                elif not large:
                    large = True
                    us.extend([few[0]] * (len(few) - 1) + few[1:-1] + few)
                    vs.extend(few[1:] + few[2:] + [None] * len(few))
                if large:
                    us.extend([few[0], last, member])
                    vs.extend([member, member, None])
                last = member
            if len(us) >= 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], names=["u", "v"])
                us.clear()
                vs.clear()
        if not large:
            all_pairs()
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], names=["u", "v"])

    ordered = keyed.repartition("key").sortWithinPartitions("key", "content")
    return ordered.mapInArrow(frees_memory(run), "u binary, v binary").distinct()


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those pairs whose shingle sets have at least the similarity."""
    both = (
        pairs.join(sets.toDF("u", "u_set"), "u").join(sets.toDF("v", "v_set"), "v").select("u", "v", "u_set", "v_set")
    )

    def run(batches):
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = []
            for x, y in zip(left, right, strict=True):
                a, b = _loaded(x), _loaded(y)
                # Sizes too different for the similarity need no look at the sets.
                if min(len(a), len(b)) < similarity * max(len(a), len(b)):
                    keep.append(False)
                    continue
                shared = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(shared >= similarity * (len(a) + len(b) - shared) - 1e-9)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["u", "v"])

    return both.mapInArrow(frees_memory(run), "u binary, v binary")


def slot_counts(hot: DataFrame) -> np.ndarray:
    """How often the shingles of each slot occur in ``hot``.

    A task gives one row for each range of slots, and the ranges' rows are
    added up as they come, so a row holds 32 KB, whatever the corpus.
    """
    width = SLOTS // SLOT_RANGES

    def count(batches):
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                np.add.at(counts, (_loaded(x) % np.uint64(SLOTS)).astype(np.int64), 1)
        yield from ranges({r: counts[r * width : (r + 1) * width] for r in range(SLOT_RANGES)})

    def ranges(found):
        some = [(r, c.tobytes()) for r, c in found.items() if c.any()]
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in some], pa.int32()), pa.array([c for _, c in some], pa.binary())], names=["slots", "n"])

    def add(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for r, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[r] = found.get(r, 0) + np.frombuffer(data, np.int64)
        yield from ranges(found)

    counted = hot.select("shingles").mapInArrow(frees_memory(count), "slots int, n binary")
    table = counted.repartition("slots").mapInArrow(frees_memory(add), "slots int, n binary").toArrow()
    counts = np.zeros(SLOTS, np.int64)
    for r, data in zip(table.column("slots").to_pylist(), table.column("n").to_pylist(), strict=True):
        counts[r * width : (r + 1) * width] += np.frombuffer(data, np.int64)
    return counts


def parities(shingles: np.ndarray) -> bytes:
    """For each of ``PARITY_BITS`` places whether an odd number of shingles falls there."""
    places = ((shingles * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=PARITY_BITS) & 1).astype(np.uint8)).tobytes()


def rare_shingles(hot: DataFrame, similarity: float) -> DataFrame:
    """The rarest shingles of each text, as many as a pair with the similarity needs to share one.

    The larger text of a pair needs ``place`` up to what the similarity leaves
    of it; of the smaller one, which has ``indexed`` rows, fewer are enough.
    """
    shared = hot.sparkSession.sparkContext.broadcast(slot_counts(hot))

    def run(batches):
        counts = shared.value
        for batch in batches:
            tokens, sizes, places, indexed, owners, bits = [], [], [], [], [], []
            for i, x in enumerate(batch.column(1).to_pylist()):
                own = _loaded(x)
                n = len(own)
                probe = n - int(np.ceil(similarity * n - 1e-6)) + 1
                index = n - int(np.ceil(2 * similarity / (1 + similarity) * n - 1e-6)) + 1
                chosen = own[np.lexsort((own, counts[(own % np.uint64(SLOTS)).astype(np.int64)]))[:probe]]
                tokens.append(chosen.view(np.int64))
                sizes.append(np.full(len(chosen), n, np.int32))
                places.append(np.arange(len(chosen), dtype=np.int32))
                indexed.append(np.arange(len(chosen)) < index)
                owners.append(np.full(len(chosen), i))
                bits.append(parities(own))
            if not tokens:
                continue
            at = pa.array(np.concatenate(owners))
            rows = pa.RecordBatch.from_arrays(
                [
                    *(pa.array(np.concatenate(x)) for x in (tokens, sizes, places, indexed)),
                    batch.column(0).take(at),
                    batch.column(2).take(at),
                    pa.array(bits, pa.binary()).take(at),
                ],
                names=["token", "size", "place", "indexed", "content", "component", "bits"],
            )
            for lo in range(0, rows.num_rows, 100_000):
                yield rows.slice(lo, 100_000)

    return hot.select("content", "shingles", "component").mapInArrow(
        frees_memory(run), "token long, size int, place int, indexed boolean, content binary, component binary, bits binary"
    )


def rare_pairs(rows: DataFrame, similarity: float, first: bool) -> DataFrame:
    """Pairs (u < v) of different components that share a rare shingle and can have the similarity.

    With ``first``, one pair for each text and shingle, which is enough to
    connect most copies.  Sets whose parities differ in more bits than the
    similarity allows for elements are no pair, so families of texts below it
    send few on.
    """

    def run(batches):
        for token, size, place, indexed, content, component, bits in groups_of(batches):
            starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            ends = np.r_[starts[1:], len(token)]
            several = ends - starts > 1
            us, vs = [], []
            for a, b in zip(starts[several].tolist(), ends[several].tolist(), strict=True):
                cuts = np.flatnonzero(component[a + 1 : b] != component[a : b - 1]) + a + 1
                if not len(cuts):
                    continue
                odd = np.frombuffer(b"".join(bits[a:b]), "<u8").reshape(b - a, -1)
                for s, e in zip([a, *cuts.tolist()], [*cuts.tolist(), b], strict=True):
                    mine = s + np.flatnonzero(indexed[s:e])
                    other = np.r_[a:s, e:b]
                    step = max(1, BLOCK_PAIRS // len(other))
                    for lo in range(0, len(mine), step):
                        x = mine[lo : lo + step, None]
                        n, m = size[x], size[other][None, :]
                        # What both can share if this is the first shingle that they share.
                        most = np.minimum(n - place[x], m - place[other][None, :])
                        fits = (m >= n) & (n >= similarity * m - 1e-6)
                        fits &= most >= similarity / (1 + similarity) * (n + m) - 1e-6
                        i, j = np.nonzero(fits)
                        left, right = x[i, 0], other[j]
                        near = np.ones(len(i), bool)
                        for at in range(0, len(i), 1 << 14):
                            u, v = left[at : at + (1 << 14)], right[at : at + (1 << 14)]
                            apart = np.bitwise_count(odd[u - a] ^ odd[v - a]).sum(axis=1)
                            near[at : at + (1 << 14)] = apart <= (1 - similarity) / (1 + similarity) * (size[u] + size[v]) + 1e-6
                        i, j = i[near], j[near]
                        if first:
                            i, at = np.unique(i, return_index=True)
                            j = j[at]
                        for p, q in zip(content[x[i, 0]].tolist(), content[other[j]].tolist(), strict=True):
                            us.append(min(p, q))
                            vs.append(max(p, q))
                        if len(us) >= 100_000:
                            yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], names=["u", "v"])
                            us, vs = [], []
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], names=["u", "v"])

    ordered = rows.repartition("token").sortWithinPartitions("token", "component", "content")
    return ordered.mapInArrow(frees_memory(run), "u binary, v binary").distinct()


def linked_components(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(``node``, ``component``) of all true links among the members of a bucket."""
    labels = connected_components(verified(pairs.where("v is not null"), sets, similarity))
    members = pairs.where("v is null").select(F.col("u").alias("content")).distinct()
    if members.isEmpty():
        return labels
    members, members_at = stage_at(members.join(sets, "content"), "members")
    for first in (True, False):
        named = members.join(labels, F.col("content") == F.col("node"), "left").select(
            "content", "shingles", F.coalesce("component", "content").alias("component")
        )
        more = stage(verified(rare_pairs(rare_shingles(named, similarity), similarity, first), sets, similarity), "links")
        if not more.isEmpty():
            labels = connected_components(labels.toDF("u", "v").union(more))
    remove_folder(members.sparkSession, members_at)
    return labels


def one_per_group(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE_WORDS,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """The rows of ``df`` without near and exact copies: of each group, the row with the smallest id stays.

    Rows are grouped if their texts are equal or, directly or through others,
    have at least the similarity as sets of word shingles (A-Z lower-cased).
    Of repeated rows one stays.  Null and empty texts are one text.  A null id
    is smaller than all others; ties go by the remaining columns.  Texts with
    fewer words than a shingle are one shingle.  Texts of any length are
    compared whole, one pair of sets at a time.  Columns must be orderable and
    may have any names; all pass through.  An empty table stays empty.
    """
    require(df, id_col, text_col)
    names = [id_col, *[c for c in df.columns if c != id_col]]
    content = F.unhex(F.md5(F.coalesce(F.col(quoted(text_col)), F.lit("")).cast("binary")))
    row = F.struct(*[F.col(quoted(c)).alias(f"f{i}") for i, c in enumerate(names)])
    keyed = df.select(content.alias("content"), row.alias("row"))
    text = F.col(f"row.f{names.index(text_col)}").alias("text")
    pairs, pairs_at = stage_at(bucket_pairs(candidate_keys(keyed.select("content", text), shingle)), "pairs")
    unique = keyed.groupBy("content").agg(F.min("row").alias("row"))
    wanted = pairs.select(F.col("u").alias("content")).union(pairs.select("v")).where("content is not null").distinct()

    def to_sets(batches):
        for batch in batches:
            sets = [_stored(shingle_set(t, shingle)) for t in binary_list(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["content", "shingles"])

    sets, sets_at = stage_at(
        unique.select("content", text).join(wanted, "content", "left_semi").mapInArrow(frees_memory(to_sets), "content binary, shingles binary"),
        "shingles",
    )
    # The labels are a table of their own.
    labels = linked_components(pairs, sets, similarity)
    remove_folder(df.sparkSession, pairs_at)
    remove_folder(df.sparkSession, sets_at)
    # The first of a group by id stays; the others are what an anti-join removes.
    heads = unique.select("content", F.col("row.f0").alias("id"))
    member = labels.withColumnRenamed("node", "content").join(heads, "content")
    # Texts meet by themselves, not by their component, which may have very many.
    first = member.groupBy("component").agg(F.min(F.struct("id", "content")).alias("first")).select("first.content")
    dropped = member.join(first, "content", "left_anti").select("content")
    kept = unique.join(dropped, "content", "left_anti")
    return kept.select(*[F.col(f"row.f{names.index(c)}") for c in df.columns]).toDF(*df.columns)
