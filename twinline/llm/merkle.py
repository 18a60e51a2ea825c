"""A Merkle manifest of a table: a tree per source over its rows in order, and one over the sources' roots.

Ranks are written in digits of base 3. A block holds the leaves that share all but the lowest ``BLOCK_LEVELS`` digits,
3**6 at most; within it digit after digit is grouped away, each parent nesting its children's structs. The blocks' own
digests are the leaves of the next round, until one node per tree is left. Going down, a transform over the nested
structs gives each leaf its siblings level by level and an explode emits them; between rounds a block meets its own
path by grouping, so no level is joined to another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.position import total_order
from ..session import written

FAN = 3
BLOCK_LEVELS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(*values: Column) -> Column:
    """The digest of a row: of each value its UTF-8 bytes' count, ``:`` and the value, or ``-`` for null."""
    texts = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def _joined(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda c: c["digest"]), "")


def _round(nodes: DataFrame) -> DataFrame:
    """``tree, n, block, digest, below`` from ``tree, n, rank, digest, item``; ``n`` is the number of nodes of a tree.

    One shuffle by block serves all levels, as it is part of each level's grouping.
    """
    digits = [F.expr(f"int(rank div {FAN**level} % {FAN})").alias(f"d{level}") for level in range(BLOCK_LEVELS)]
    block = F.expr(f"rank div {FAN**BLOCK_LEVELS}").alias("block")
    rows = nodes.select("tree", "n", block, *digits, "digest", F.col("item").alias("below")).repartition("tree", "block")
    for level in range(BLOCK_LEVELS):
        keys = ["tree", "n", "block", *[f"d{i}" for i in range(level + 1, BLOCK_LEVELS)]]
        children = F.array_sort(F.collect_list(F.struct(F.col(f"d{level}").alias("digit"), "digest", "below")))
        parents = rows.groupBy(*keys).agg(children.alias("below"))
        # A tree of one node at this level has its root already.
        rows = parents.withColumn(
            "digest", F.when(F.col("n") > FAN**level, digest(_joined(F.col("below")))).otherwise(F.col("below")[0]["digest"])
        )
    return rows


def _climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The written rounds from the leaves up, and ``tree, digest`` of the trees' roots."""
    rounds = []
    while True:
        rounds.append(written(_round(nodes), "manifest"))
        size = FAN**BLOCK_LEVELS
        # As many rounds as the largest tree takes: each leaves 1/729 of the nodes.
        if (rounds[-1].agg(F.max("n")).first()[0] or 0) <= size:
            return rounds, rounds[-1].select("tree", "digest")
        n = F.expr(f"(n + {size - 1}) div {size}")
        nodes = rounds[-1].select("tree", n.alias("n"), F.col("block").alias("rank"), "digest", F.col("block").alias("item"))


def _leaves(nodes: Column, level: int, path: Column, n: Column) -> Column:
    """An array of ``digest, item, path`` for the leaves below the children ``nodes`` of a node that has ``path``.

    A path holds the siblings to the left and right of each level, from the leaf up.
    """

    def beside(place: Column) -> Column:
        left = _joined(F.slice(nodes, F.lit(1), place))
        right = _joined(F.slice(nodes, place + 2, F.lit(FAN)))
        step = F.array(F.struct(left.alias("left"), right.alias("right")))
        return F.concat(F.when(n > FAN**level, step).otherwise(F.slice(step, F.lit(1), F.lit(0))), path)

    if level == 0:
        return F.transform(
            nodes, lambda c, i: F.struct(c["digest"].alias("digest"), c["below"].alias("item"), beside(i).alias("path"))
        )
    return F.flatten(F.transform(nodes, lambda c, i: _leaves(c["below"], level - 1, beside(i), n)))


def _descend(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """``digest, item, path, carry`` of all leaves; ``tops`` has ``tree, path, carry`` of the trees."""
    above = tops.select("tree", F.lit(0).cast("long").alias("block"), "path", "carry")
    for at, blocks in reversed(list(enumerate(rounds))):
        below = blocks.select("tree", "block", "n", "below")
        both = below.unionByName(above, allowMissingColumns=True).groupBy("tree", "block").agg(
            *[F.first(c, ignorenulls=True).alias(c) for c in ("n", "below", "path", "carry")]
        )
        nested = _leaves(F.col("below"), BLOCK_LEVELS - 1, F.col("path"), F.col("n"))
        leaves = both.select("tree", "carry", F.explode(nested).alias("leaf")).select("tree", "carry", "leaf.*")
        if at == 0:
            return leaves.select("digest", "item", "path", "carry")
        above = written(leaves.select("tree", F.col("item").alias("block"), "path", "carry"), "paths")
    raise ValueError("no rounds")


def manifest(leaves: DataFrame, order: list[str], by: str = "source", leaf: str = "leaf") -> DataFrame:
    """All columns of ``leaves`` with ``subroot``, ``root`` and ``path``, an array of ``left, right`` per level.

    ``leaves`` has a digest ``leaf`` per row. Rows of a ``by`` group are a tree in the order of the columns ``order``
    (nulls first) and then the digest; equal rows are told apart by any order. While a tree has several nodes, every
    three in a row become their digest. The groups' roots, in the order of ``by`` (null first, bytewise), are the leaves of
    the last tree. ``path`` goes from a leaf through its group's root to the root, empty strings standing for no sibling.
    A table of one row has an empty path and its leaf as both roots; an empty table gives an empty one.
    """
    leaves = written(leaves, "leaves")
    names = leaves.columns
    keys = [*[c for c in order if c != leaf], leaf]
    ranked = total_order(leaves.select(F.struct(*names).alias("item"), F.col(by).alias("tree"), *keys), keys, "rank", ["tree"], "n")
    rounds, tops = _climb(ranked.select("tree", "n", "rank", F.col(leaf).alias("digest"), "item"))
    tops = total_order(written(tops, "subroots"), ["tree"], "rank", total="n")
    whole = F.lit("").alias("tree")
    over, top = _climb(tops.select(whole, "n", "rank", "digest", F.struct(F.col("tree").alias("own")).alias("item")))
    empty = F.array().cast("array<struct<left: string, right: string>>").alias("path")
    roots = _descend(over, top.select("tree", empty, F.col("digest").alias("carry")))
    roots = written(
        roots.select(F.col("item.own").alias("tree"), "path", F.struct(F.col("digest").alias("subroot"), F.col("carry").alias("root")).alias("carry")),
        "roots",
    )
    return _descend(rounds, roots).select("item.*", "carry.subroot", "carry.root", "path")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf has with the siblings of its path."""
    return F.aggregate(path, leaf, lambda node, step: digest(step["left"], node, step["right"]))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, level by level from the left to the right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def tampered_proofs(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row of ``docs``.

    Rows whose id's checksum is even lose the line breaks of their text before their leaf is folded; a null id is not
    one of them and comes first in its source. Only the columns ``FIELDS`` are read.
    """
    others = [F.col(c) for c in FIELDS[:-1]]
    # The divisor of the checksum is two.
    picked = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    hit = picked & F.coalesce(F.contains("text", F.lit("\n")), F.lit(False))
    leaves = docs.select(
        "doc_id",
        "source",
        leaf_digest(*others, F.col("text")).alias("leaf"),
        F.when(hit, leaf_digest(*others, F.replace("text", F.lit("\n"), F.lit("")))).alias("changed"),
    )
    proofs = manifest(leaves, ["doc_id"])
    folded = proofs.withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("path")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
