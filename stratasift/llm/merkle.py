"""Merkle manifest of a dataset, by fixed-size blocks of ordered leaf arrays.

Rows are leaves of a binary tree for each group, in the order of their ids, and
the groups' roots are leaves of one tree above.  A block is an array of
``2 ** BLOCK_BITS`` neighbouring nodes; ``sequence``, ``transform``, ``slice``
and ``aggregate`` collapse all its levels in one row, and the blocks' roots are
the nodes of the next round.  No task sees more than one block's nodes at once,
however many rows a group has.  On the way down each block hands its place's
siblings to the nodes below, so that each leaf gets its proof without meeting
the tree.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratasift.operators.ranking import distributed_rank

from .common import quoted, read_table, require, stage

#: A block collapses so many levels: 256 leaves of 64 characters.
BLOCK_BITS = 8

#: The columns of ``documents`` in a leaf.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "array<struct<sibling:string,left:boolean>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of strings that follow one another."""
    return F.sha2(F.concat(*parts), 256)


def leaf_field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value as text."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return digest(*[leaf_field(v) for v in values])


def _next_level(nodes: Column) -> Column:
    """Every two neighbouring nodes become one; the last may be alone."""
    runs = F.sequence(F.lit(0), F.ceil(F.size(nodes) / 2).cast("int") - 1)
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, 2 * i + 1, F.lit(2)), ""), 256))


def block_table(nodes: DataFrame, bits: int) -> DataFrame:
    """(tree, block, n, rows, levels, top): blocks of nodes with all levels above them.

    ``nodes`` has tree, at (from 0), n (nodes of the tree), digest and payload.
    A tree that fits in a block ends at its root; blocks of larger trees all
    have ``bits`` levels, whatever number of nodes the last one has.
    """
    blocks = (
        nodes.groupBy("tree", F.shiftright("at", bits).alias("block"))
        .agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "digest", "payload"))).alias("rows"))
    )
    height = F.when(F.col("n") > (1 << bits), F.lit(bits)).when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0)
    leaves = F.transform("rows", lambda r: r["digest"])
    steps = F.when(height > 0, F.sequence(F.lit(1), height)).otherwise(F.array().cast("array<int>"))
    levels = F.aggregate(steps, F.array(leaves), lambda done, _: F.concat(done, F.array(_next_level(F.element_at(done, -1)))))
    return blocks.withColumn("levels", levels).withColumn("top", F.element_at(F.element_at("levels", -1), 1))


def tree_levels(nodes: DataFrame, bits: int) -> list[DataFrame]:
    """Block tables from the leaves up, until each tree is one block."""
    tables = []
    while True:
        blocks = stage(block_table(nodes, bits), "merkle")
        tables.append(blocks)
        most = blocks.agg(F.max("n")).first()[0] or 0
        if most <= 1 << bits:
            return tables
        nodes = blocks.select(
            "tree",
            F.col("block").alias("at"),
            F.ceil(F.col("n") / (1 << bits)).alias("n"),
            F.col("top").alias("digest"),
            F.lit(None).cast("string").alias("payload"),
        )


def _local_path(levels: Column, place: Column) -> Column:
    """The siblings of a block's node, level by level; null where a run has no other node."""
    steps = F.size(levels) - 1

    def step(level):
        node = F.call_function("shiftright", place, level)
        return F.struct(
            F.get(F.get(levels, level), node.bitwiseXOR(F.lit(1))).alias("sibling"),
            (node.bitwiseAND(F.lit(1)) == 1).alias("left"),
        )

    return F.when(steps > 0, F.transform(F.sequence(F.lit(0), steps - 1), step)).otherwise(F.array()).cast(_PATH)


def descend(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """(tree, at, digest, payload, subroot, root, path) of each node, from those of the blocks as nodes.

    A path is read up to the root.
    """
    upper = above.select(
        F.col("tree").alias("of_tree"), F.col("at").alias("of_block"), F.col("path").alias("rest"), "subroot", "root"
    )
    same = F.col("tree").eqNullSafe(F.col("of_tree")) & (F.col("block") == F.col("of_block"))
    entries = F.transform(
        "rows",
        lambda r, i: F.struct(
            r["at"].alias("at"),
            r["digest"].alias("digest"),
            r["payload"].alias("payload"),
            F.concat(_local_path(F.col("levels"), i), F.col("rest")).alias("path"),
        ),
    )
    return blocks.join(upper, same).select("tree", "subroot", "root", F.inline(entries))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""

    def join(node, step):
        other = step["sibling"]
        return F.sha2(F.when(other.isNull(), node).when(step["left"], F.concat(other, node)).otherwise(F.concat(node, other)), 256)

    return F.aggregate(path, leaf, join)


def proof_digest(path: Column) -> Column:
    """Digest of the siblings, from the leaf up."""
    return F.sha2(F.array_join(F.transform(path, lambda s: s["sibling"]), ""), 256)


def merkle_manifest(
    df: DataFrame,
    id_col: str = "doc_id",
    group_col: str = "lang",
    leaf_cols: tuple[str, ...] = LEAF_COLUMNS,
    claims: Column | None = None,
    bits: int = BLOCK_BITS,
) -> DataFrame:
    """One row per row: (id, group, leaf, subroot, root, path, claim).

    ``leaf`` digests ``leaf_cols`` (each its byte count and text, ``-`` for
    null), ``subroot`` is the root of the row's group, ``root`` that of all
    groups in the order of their UTF-8 bytes, null first, and ``path`` has the
    siblings up to ``root`` with the side they stand on, null where a node
    stands alone.  ``claims`` is an expression over ``df`` that goes along as
    ``claim``, for instance the digest of a copy of the row.

    Null groups are a group, null ids come first.  Rows that share an id are
    ordered by their leaves; equal rows are leaves of their own.  Texts of any
    length are digested whole, where they are read: only digests are shuffled.
    A lone row is its own subroot and, if there is no other group, the root,
    with an empty path.  An empty table gives an empty result.  Other columns
    are not looked at, whatever their names.
    """
    require(df, id_col, group_col, *leaf_cols)
    if not 1 <= bits <= 12:
        raise ValueError("a block has 1 to 12 levels")
    claim = F.lit(None).cast("string") if claims is None else claims
    leaves = df.select(
        F.col(quoted(group_col)).alias("tree"),
        F.col(quoted(id_col)).alias("id"),
        leaf_digest(*[F.col(quoted(c)) for c in leaf_cols]).alias("digest"),
        claim.alias("claim"),
        # Equal rows may have any order; their numbers let them be dealt to several partitions.
        F.monotonically_increasing_id().alias("row"),
    )
    ranked = distributed_rank(leaves, ["tree"], ["id", "digest", "row"], "place")
    nodes = ranked.select(
        "tree", (F.col("place") - 1).alias("at"), F.col("group_size").alias("n"), "digest", F.struct("id", "claim").alias("payload")
    )
    tables = tree_levels(nodes, bits)
    groups = tables[-1].select(F.lit(0).alias("all"), "tree", "top")
    ranked_groups = distributed_rank(groups, ["all"], ["tree"], "place")
    group_nodes = ranked_groups.select(
        F.col("all").alias("tree"),
        (F.col("place") - 1).alias("at"),
        F.col("group_size").alias("n"),
        F.col("top").alias("digest"),
        F.struct("tree").alias("payload"),
    )
    group_tables = tree_levels(group_nodes, bits)
    none = F.array().cast(_PATH)
    above = group_tables[-1].select("tree", F.lit(0).cast("long").alias("at"), none.alias("path"), F.col("top").alias("subroot"), F.col("top").alias("root"))
    for blocks in reversed(group_tables):
        above = descend(blocks, above)
    above = above.select(F.col("payload.tree").alias("tree"), F.lit(0).cast("long").alias("at"), "path", F.col("digest").alias("subroot"), "root")
    for blocks in reversed(tables):
        above = descend(blocks, above)
    return above.select(
        F.col("payload.id").alias("id"), F.col("tree").alias("group"), F.col("digest").alias("leaf"), "subroot", "root", "path", F.col("payload.claim").alias("claim")
    )


def query_of(docs: DataFrame) -> DataFrame:
    """Proofs of all documents, and whether the copy at hand of each still folds to the root."""
    chosen = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    values = {c: F.col(c) for c in LEAF_COLUMNS}
    tampered = F.when(chosen, leaf_digest(*(values | {"n_chars": F.col("n_chars") + 1}).values()))
    proved = merkle_manifest(docs, claims=tampered)
    folded = fold(F.coalesce("claim", "leaf"), F.col("path"))
    return proved.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_of(read_table(spark, sf_dir, "documents"))


def _sql_field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _sql_leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_sql_field(n_chars if c == "n_chars" else c) for c in LEAF_COLUMNS) + ")"


#: Bitwise CRC-32 of the decimal id: each byte goes in, then eight shifts.
_SQL_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
    flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"""

_SQL_UP = "list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(array_to_string(nodes[2 * i + 1:2 * i + 2], '')))"

ORACLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_sql_leaf("n_chars")} AS leaf,
    CASE WHEN {_SQL_CRC} % 7 = 0 THEN {_sql_leaf("(n_chars + 1)")} ELSE {_sql_leaf("n_chars")} END AS seen,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos FROM documents),
lv AS (
  SELECT lang, 0 AS l, list(leaf ORDER BY pos) AS nodes FROM d GROUP BY lang
  UNION ALL SELECT lang, l + 1, {_SQL_UP} FROM lv WHERE len(nodes) > 1),
tops AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM lv WHERE len(nodes) = 1),
tl AS (
  SELECT 0 AS l, list(subroot ORDER BY pos) AS nodes FROM tops
  UNION ALL SELECT l + 1, {_SQL_UP} FROM tl WHERE len(nodes) > 1),
steps AS (
  SELECT doc_id, l AS k, d.pos >> l AS m, nodes FROM d JOIN lv ON d.lang IS NOT DISTINCT FROM lv.lang WHERE len(nodes) > 1
  UNION ALL
  SELECT doc_id, 1000 + l, tops.pos >> l, nodes FROM d JOIN tops ON d.lang IS NOT DISTINCT FROM tops.lang, tl WHERE len(nodes) > 1),
paths AS (
  SELECT doc_id, string_agg(nodes[xor(m, 1) + 1], '' ORDER BY k) AS proof,
    list(CASE WHEN nodes[xor(m, 1) + 1] IS NULL THEN 'A' WHEN m & 1 = 1 THEN 'L' || nodes[xor(m, 1) + 1]
      ELSE 'R' || nodes[xor(m, 1) + 1] END ORDER BY k) AS path
  FROM steps GROUP BY doc_id),
folded AS (
  SELECT d.doc_id, leaf, subroot, (SELECT nodes[1] FROM tl WHERE len(nodes) = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce(list_prepend(seen, coalesce(path, [])), lambda a, s: sha256(
      CASE s[1] WHEN 'L' THEN s[2:] || a WHEN 'R' THEN a || s[2:] ELSE a END)) AS folded_root
  FROM d JOIN tops ON d.lang IS NOT DISTINCT FROM tops.lang LEFT JOIN paths ON paths.doc_id IS NOT DISTINCT FROM d.doc_id)
SELECT *, folded_root = root AS verified FROM folded
"""
