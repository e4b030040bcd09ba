"""Merkle manifest of a document table as a postorder append log.

Every row is a leaf; the leaves of a source, by ascending id, make a tree whose nodes have up to three children, and the
trees' roots, by source, make one more tree above them. Aligned builders, one per 3^LEVELS consecutive nodes, write
their nodes in completion order: a leaf, then every node that this leaf completes. Builders of one tier run side by
side; their last nodes are the leaves of the next tier's builders, so no group ever holds more rows than that.

Where a node stands in a log follows from the sizes of the subtrees before it (`position`), so a proof is read by
address: no digest is searched for, and nothing is sorted a second time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tonnage.llm.common import bound, written
from tonnage.operators.ordered import row_numbers

FAN = 3
#: Levels that one builder completes; it starts from at most 3^7 nodes.
LEVELS = 7
PATH = "array<struct<slot:int,siblings:string>>"


def digest(parts: Sequence[str]) -> str:
    """Lowercase hex sha256 of the concatenated texts."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_over(n: int) -> int:
    """Levels above n nodes until one is left."""
    levels = 0
    while n > FAN**levels:
        levels += 1
    return levels


def position(level: int, index: int, n: int) -> int:
    """Place, from 0, of node `index` of `level` in the log of a tree over n leaves.

    The node is complete with its last leaf e. Before that leaf stand e leaves and every node whose subtree of 3^k leaves ends
    before it; after it come the nodes it completes, lowest first."""
    last = min(n, (index + 1) * FAN**level) - 1
    before, size = last, FAN
    while size <= last:
        before += last // size
        size *= FAN
    return before + level


def appended(leaves: Sequence[str], levels: int) -> list[str]:
    """All nodes over the leaves, in completion order, up to the one node of `levels`."""
    log: list[str] = []
    unfinished: list[list[str]] = [[] for _ in range(levels + 1)]
    for leaf in leaves:
        log.append(leaf)
        unfinished[0].append(leaf)
        for level in range(levels):
            if len(unfinished[level]) < FAN:
                break
            log.append(digest(unfinished[level]))
            unfinished[level].clear()
            unfinished[level + 1].append(log[-1])
    for level in range(levels):  # the ragged edge is closed from below
        if unfinished[level]:
            log.append(digest(unfinished[level]))
            unfinished[level + 1].append(log[-1])
    return log


def siblings(log: Sequence[str], n: int, levels: int) -> list[list[tuple[int, str]]]:
    """Per level and node: its slot in its run, and the digests of the others of the run, concatenated."""
    out = []
    for level in range(levels):
        size = -(-n // FAN**level)
        row = []
        for low in range(0, size, FAN):
            run = [log[position(level, k, n)] for k in range(low, min(low + FAN, size))]
            row += [(k, "".join(run[:k] + run[k + 1 :])) for k in range(len(run))]
        out.append(row)
    return out


def path(sides: list[list[tuple[int, str]]], index: int) -> list[tuple[int, str]]:
    """The way of leaf `index` up to the root: slot and siblings per level."""
    return [row[index // FAN**level] for level, row in enumerate(sides)]


def folded(leaf: str, way: Sequence[tuple[int, str]]) -> str:
    """The root that a leaf and the siblings on its way give."""
    for slot, others in way:
        cut = 64 * slot
        leaf = digest((others[:cut], leaf, others[cut:]))
    return leaf


@F.arrow_udf(T.ArrayType(T.StringType()))
def _log(leaves: pa.Array, climbs: pa.Array) -> pa.Array:
    return pa.array([appended(own.as_py(), climb) for own, climb in zip(leaves, climbs.to_pylist(), strict=True)], pa.list_(pa.string()))


def _per_block(blocks: DataFrame, rows: Callable[[dict], dict[str, list]], schema: str) -> DataFrame:
    """`rows` of every block; one block at a time is in a worker's memory, as plain Python values."""
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield pa.RecordBatch.from_pydict(rows({c: batch[c][k].as_py() for c in batch.schema.names}), kinds)

    return blocks.mapInArrow(run, schema)


def _ways(block: dict) -> list[list[dict]]:
    """The way from each member of a block to the root: through the block, then on from its last node."""
    own = block["members"]
    sides = siblings(block["log"], len(own), block["climb"])
    return [[{"slot": s, "siblings": o} for s, o in path(sides, k)] + block["way"] for k in range(len(own))]


def leaves(documents: DataFrame) -> DataFrame:
    """(doc_id, tree, leaf, changed): the digest of each row, and the digest after tampering where it differs."""
    rows = bound(documents, doc_id="doc_id", source="source", lang="lang", n_chars="n_chars", text="text")

    def row_digest(text: Column) -> Column:
        def field(value: Column) -> Column:
            shown = value.cast("string")
            return F.when(shown.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown))

        return F.sha2(F.concat(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text)).cast("binary"), 256)

    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    hit = even & F.coalesce(F.contains("text", F.lit("\n")), F.lit(False))
    changed = F.when(hit, row_digest(F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))  # null sorts before '='
    return rows.select("doc_id", tree.alias("tree"), row_digest(F.col("text")).alias("leaf"), changed.alias("changed"))


def build(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Logs of all trees by tier: (tree, block, n, members, climb, log), from rows (tree, rank from 0, n of the tree, leaf, extra).

    `members` keeps the rows of the block in order, `climb` the levels that its builder completes: `levels` where others stand
    beside it. A tree of one block is complete with that block's last node."""
    tiers, width = [], FAN**levels
    needed = F.lit(0)
    for k in range(levels):
        needed += (F.col("n") > FAN**k).cast("int")
    while True:
        block = F.floor(F.col("rank") / width).alias("block")
        members = F.sort_array(F.collect_list(F.struct("rank", "leaf", "extra"))).alias("members")  # at most `width`
        grouped = nodes.groupBy("tree", block, "n").agg(members).withColumn("climb", needed)
        tiers.append(written(grouped.withColumn("log", _log(F.col("members.leaf"), F.col("climb"))), f"log{len(tiers)}"))
        higher = tiers[-1].filter(F.col("n") > width)
        if higher.isEmpty():
            return tiers
        top = F.element_at("log", -1).alias("leaf")
        nodes = higher.select("tree", F.col("block").alias("rank"), F.ceil(F.col("n") / width).alias("n"), top, F.lit(0).alias("extra"))


def roots(tiers: list[DataFrame], levels: int) -> DataFrame:
    """(tree, subroot) of all trees."""
    done = [t.filter(F.col("n") <= FAN**levels).select("tree", F.element_at("log", -1).alias("subroot")) for t in tiers]
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def ways(tiers: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    """The blocks of the lowest tier with `way`, the path from a block's last node to the very root.

    `above` has (tree, subroot, way): a tree's last node, and the path from there on."""

    def climbed(block: dict) -> dict[str, list]:
        ranks = [m["rank"] for m in block["members"]]
        same = {c: [block[c]] * len(ranks) for c in ("tree", "subroot")}
        return same | {"block": ranks, "way": _ways(block)}

    known = None
    for tier in reversed(tiers):
        blocks = tier.filter(F.col("n") <= FAN**levels).join(above, "tree")
        if known is not None:
            blocks = blocks.unionByName(tier.filter(F.col("n") > FAN**levels).join(known, ["tree", "block"]))
        if tier is not tiers[0]:
            known = _per_block(blocks.withColumn("members", F.transform("members", lambda m: F.struct(m["rank"].alias("rank")))), climbed, f"tree string, subroot string, block long, way {PATH}")
    return blocks


def nodes(tiers: list[DataFrame], levels: int) -> DataFrame:
    """(tree, position, level, node, digest) of every node: the log of each tree, in completion order by `position`."""
    kinds = "tree string, position long, level int, node long, digest string"
    found = None
    for tier, frame in enumerate(tiers):
        base = tier * levels

        def placed(block: dict, base: int = base) -> dict[str, list]:
            size, log, rows = block["size"], block["log"], []
            for level in range(0 if not base else 1, block["climb"] + 1):  # the leaves of a higher tier stand in the tier below
                for k in range(-(-size // FAN**level)):
                    node = block["block"] * FAN ** (levels - level) + k
                    rows.append((block["tree"], position(base + level, node, block["leaves"]), base + level, node, log[position(level, k, size)]))
            return {c: [r[i] for r in rows] for i, c in enumerate(("tree", "position", "level", "node", "digest"))}

        counted = tiers[0].select("tree", F.col("n").alias("leaves")).distinct()
        rows = _per_block(frame.select("tree", "block", "climb", F.size("members").alias("size"), "log").join(counted, "tree"), placed, kinds)
        found = rows if found is None else found.unionByName(rows)
    return found


def _forest(documents: DataFrame, levels: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Tiers of the sources' trees, and of the tree over their roots."""
    found = written(leaves(documents), "leaves")
    numbered = row_numbers(found, ["tree"], "doc_id", tie="leaf", name="place", total="n")
    below = build(numbered.select("tree", (F.col("place") - 1).alias("rank"), "n", "leaf", F.struct("doc_id", "changed").alias("extra")), levels)
    ordered = row_numbers(written(roots(below, levels), "subroots"), [], "tree", name="place", total="n")
    over = build(ordered.select(F.lit("").alias("tree"), (F.col("place") - 1).alias("rank"), "n", F.col("subroot").alias("leaf"), F.col("tree").alias("extra")), levels)
    return below, over


def log(documents: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The manifest itself: every node of the sources' trees ('=' and source, or '-') and of the tree over them ('')."""
    below, over = _forest(documents, levels)
    return nodes(below, levels).unionByName(nodes(over, levels))


def manifest(documents: DataFrame, levels: int = LEVELS) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Nulls in any column are digested as `-`, an empty text as `0:`. Rows without id come first in their source and are never
    tampered; rows that repeat an id stand beside each other in the order of their leaf, equal rows get leaves of their own.
    A null source is a tree of its own, before all others. An empty table gives an empty result; other columns are not read.
    """
    below, over = _forest(documents, levels)
    top = roots(over, levels).first()
    root = top["subroot"] if top else digest([])

    def heads(block: dict) -> dict[str, list]:
        members = block["members"]
        return {"tree": [m["extra"] for m in members], "subroot": [m["leaf"] for m in members], "way": _ways(block)}

    def proofs(block: dict) -> dict[str, list]:
        members, ways_ = block["members"], _ways(block)
        tops = [folded(m["extra"]["changed"] or m["leaf"], [(w["slot"], w["siblings"]) for w in way]) for m, way in zip(members, ways_, strict=True)]
        return {
            "doc_id": [m["extra"]["doc_id"] for m in members],
            "leaf": [m["leaf"] for m in members],
            "subroot": [block["subroot"]] * len(members),
            "root": [root] * len(members),
            "proof_sha256": [digest([w["siblings"] for w in way]) for way in ways_],
            "folded_root": tops,
            "verified": [t == root for t in tops],
        }

    no_way = F.expr(f"cast(array() as {PATH})").alias("way")
    crowns = _per_block(ways(over, roots(over, levels).select("tree", "subroot", no_way), levels), heads, f"tree string, subroot string, way {PATH}")
    crowns = written(crowns, "crowns")
    kind = documents.schema["doc_id"].dataType.simpleString()
    blocks = ways(below, crowns, levels)
    return _per_block(blocks, proofs, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
