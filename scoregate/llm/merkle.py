"""Merkle manifest of a dataset: a digest of every row, a tree for each partition of it, one root, and each row's proof.

Method: rows are leaves, in the order of their key within their tree (a source); every FAN consecutive nodes become the
digest of their digests until one is left, and the trees' roots form the last tree alike. Leaves get their places from range
partitions that are written once, so that a tree is cut into as many tasks as its rows ask for. Going up, superblocks of
FAN ** LEVELS nodes are reduced to one node each, round by round. Going down, the nodes of a superblock and the outer nodes that
its proofs need are cogrouped by superblock, and one function reduces the block, joins the proofs and folds them. A block
holds at most FAN ** LEVELS nodes whatever the table, and an outer row holds the siblings of one level. Texts are hashed where
they are read and are never shuffled; only the root itself comes to the driver.

Defined cases: a null value is hashed as `-`, so it differs from the empty text; rows with a null key come first, those with
equal keys follow one another by their digest; a null tree comes first and differs from the empty name; repeated rows are
leaves of their own with a proof each; a lone leaf is its tree's root, a lone tree's root is the root; an empty table
gives an empty result; further columns, whatever their names, are neither read nor hashed."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from scoregate.llm.common import UPPER, Scratch, ship

#: Nodes under one node, and levels that a superblock spans: 256 nodes.
FAN, LEVELS = 16, 2
BLOCK = FAN**LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """SHA-256 of the inputs one after another, in lower-case hex."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def framed(value: Column) -> Column:
    """A value with its length in bytes in front, so that neighbouring values can't be cut elsewhere; `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def is_tampered(key: Column) -> Column:
    """Whether the stated tampering meets a row: 5 divides the crc32 of its key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Round:
    """Nodes (tree, pos, size of the tree, digest and what else a leaf carries) and the number of the first level above them."""

    nodes: DataFrame
    level: int


def placed(leaves: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """Leaves with their pos (from 0) within their tree in the order of the columns named, and the tree's size. Sorted range partitions
    are written with running numbers; what a tree has in the partitions before is added to the place within a partition."""
    ordered = leaves.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id())
    written = scratch.table(ordered, name)
    part = F.shiftright("at", 33)
    pieces = written.groupBy("tree", part.alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("tree")
    above = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        "tree",
        "part",
        (F.coalesce(F.sum("n").over(above), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(whole).alias("size")
    )
    return written.withColumn("part", part).join(offsets, ["tree", "part"]).select(*leaves.columns, (F.col("at") + F.col("shift")).alias("pos"), "size")


def levels_of(size: int) -> int:
    """Levels that a block of a tree with so many nodes is reduced by: all that the tree has, or LEVELS."""
    out = 0
    while size > 1 and out < LEVELS:
        size, out = -(-size // FAN), out + 1
    return out


def reduced(digests: list[str], levels: int) -> list[list[str]]:
    """The nodes of each level of a block, from the given ones up."""
    out = [digests]
    for _ in range(levels):
        last = out[-1]
        out.append([sha256("".join(last[i : i + FAN]).encode()).hexdigest() for i in range(0, len(last), FAN)])
    return out


def _top(block: pd.DataFrame) -> pd.DataFrame:
    """A block's one node, at its place in the next round."""
    block = block.sort_values("pos")
    size = int(block["size"].iloc[0])
    top = reduced(block["digest"].tolist(), levels_of(size))[-1]
    return pd.DataFrame({"tree": [block["tree"].iloc[0]], "pos": [int(block["pos"].iloc[0]) // BLOCK], "size": [-(-size // BLOCK)], "digest": top})


def _block() -> Column:
    return F.floor(F.col("pos") / BLOCK).cast("long")


NODE = "tree string, pos long, size long, digest string"


def grown(leaves: DataFrame, level: int, scratch: Scratch, name: str) -> list[Round]:
    """The rounds of a forest, from its leaves to one node for each tree, which the last round holds."""
    rounds = [Round(leaves, level)]
    while not rounds[-1].nodes.where("size > 1").isEmpty():
        below = rounds[-1].nodes.select("tree", "pos", "size", "digest", _block().alias("block"))
        above = below.groupBy("tree", "block").applyInPandas(_top, NODE)
        rounds.append(Round(scratch.table(above, name), rounds[-1].level + LEVELS))
    return rounds


#: Outer nodes of a block: the siblings of one level, left and right of the way up; at level -1 the tree's own root.
OUTER = "tree string, block long, level int, before string, after string"


def _siblings(block: pd.DataFrame, level: int) -> Iterator[tuple[int, list[tuple[int, str, str]]]]:
    """The row number of each node of a sorted block and, for each level within the block, (level, siblings before, siblings after)."""
    rows = reduced(block["digest"].tolist(), levels_of(int(block["size"].iloc[0])))
    for i in range(len(rows[0])):
        place, out = i, []
        for k, row in enumerate(rows[:-1]):
            run = place // FAN * FAN
            out.append((level + k, "".join(row[run:place]), "".join(row[place + 1 : run + FAN])))
            place //= FAN
        yield i, out


def outer_below(found: Round, outer: DataFrame | None, name: Column | None = None) -> DataFrame:
    """The outer nodes of the blocks below a round: each node's siblings in its block, then what its block's own outer nodes are.
    name: of a round of trees' roots, the tree that each stands for; its digest goes down as that tree's root."""
    level, roots = found.level, name is not None
    nodes = found.nodes.select("tree", "pos", "size", "digest", (name if roots else F.col("tree")).alias("name"), _block().alias("block"))

    def run(block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos", ignore_index=True)
        higher = list(zip(above["level"].tolist(), above["before"].tolist(), above["after"].tolist(), strict=True))
        out = []
        for i, own in _siblings(block, level):
            below = (block["name"][i], 0 if roots else int(block["pos"][i]))
            out += [(*below, *x) for x in own + higher]
            if roots:
                out.append((*below, -1, block["digest"][i], ""))
        return pd.DataFrame(out, columns=["tree", "block", "level", "before", "after"])

    if outer is None:
        outer = nodes.sparkSession.createDataFrame([], OUTER)
    return nodes.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(run, OUTER)


def merkle_manifest(
    documents: DataFrame, columns: tuple[str, ...] = COLUMNS, tree: str = "source", key: str = "doc_id", tampered: tuple[Column, str, Column] | None = None, siblings: bool = False
) -> DataFrame:
    """For each row its key, leaf, subroot (its tree's root), root, proof_sha256 (of all siblings on its way up), folded_root and
    verified; with `siblings` also proof, an array of (level, before, after) texts of digests, from the leaf up.

    folded_root is the root worked out from the row's leaf and the siblings. tampered: (condition, column, other value) says
    which rows have which other value by the time they are verified, while the tree is the one of the rows as they were."""
    spark = documents.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    leaf = digest(*(framed(F.col(c)) for c in columns))
    kind = documents.schema[key].dataType.simpleString()
    asked = {
        "key": F.col(key),
        "shown": F.col(key).cast("string"),
        "tree": F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit("")),
        "digest": leaf
    }
    if tampered is not None:
        condition, changed, value = tampered
        asked["now"] = F.when(condition, digest(*(framed(value if c == changed else F.col(c)) for c in columns)))
    else:
        asked["now"] = F.lit(None).cast("string")
    digests = scratch.table(documents.select(*(c.alias(n) for n, c in asked.items())), "digests")  # else sampling for ranges would hash all texts once more
    leaves = placed(digests, ["key", "digest"], scratch, "leaves")
    rounds = grown(leaves, 0, scratch, "nodes")
    trees = rounds[-1].nodes.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    forest = grown(placed(trees, ["name"], scratch, "trees"), rounds[-1].level, scratch, "roots")
    root = next((r["digest"] for r in forest[-1].nodes.select("digest").collect()), None)

    outer = None
    for found in reversed(forest[1:-1]):
        outer = scratch.table(outer_below(found, outer), "outer")
    outer = scratch.table(outer_below(forest[0], outer, F.col("name")), "outer")
    for found in reversed(rounds[1:-1]):
        outer = scratch.table(outer_below(found, outer), "outer")
    return _proven(rounds[0], outer, root, siblings).withColumn("shown", F.col("shown").cast(kind)).withColumnRenamed("shown", key)


def _proven(found: Round, outer: DataFrame, root: str | None, siblings: bool) -> DataFrame:
    """The last step down: leaves and the outer nodes of their block meet, and the block is reduced, proven and folded."""
    level = found.level

    def run(block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos", ignore_index=True)
        above = above.sort_values("level")
        subroot = above["before"].iloc[0]
        higher = list(zip(above["level"].tolist(), above["before"].tolist(), above["after"].tolist(), strict=True))[1:]
        known: dict[tuple[int, str, int], str] = {}  # nodes that many leaves fold to
        proofs, folded, ways = [], [], []
        for (i, own), start in zip(_siblings(block, level), block["now"].fillna(block["digest"]).tolist(), strict=True):
            way = own + higher
            proofs.append(sha256("".join(b + a for _, b, a in way).encode()).hexdigest())
            node = start
            for k, before, after in way:
                at = (k, node, len(before))
                node = known[at] if at in known else known.setdefault(at, sha256((before + node + after).encode()).hexdigest())
            folded.append(node)
            if siblings:
                ways.append([{"level": k, "before": b, "after": a} for k, b, a in way])
        out = pd.DataFrame({"shown": block["shown"], "leaf": block["digest"], "subroot": subroot, "root": root, "proof_sha256": proofs, "folded_root": folded})
        out["verified"] = out["folded_root"] == root
        if siblings:
            out["proof"] = ways
        return out

    leaves = found.nodes.drop("key").withColumn("block", _block())  # a key goes as text: numbers beside nulls would be floats in pandas
    schema = "shown string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if siblings:
        schema += ", proof array<struct<level: int, before: string, after: string>>"
    return leaves.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(run, schema)


def lowered_text(column: str = "text") -> Column:
    """The stated tampering of a text: A-Z in lower case."""
    return F.translate(F.col(column), UPPER, UPPER.lower())
