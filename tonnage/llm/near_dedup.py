"""Near-duplicate classes: consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

1. Document frequencies of all shingles of all distinct texts, hashed to a fixed number of buckets (so that the table that is
   broadcast has a fixed size, and the share of documents a rare shingle's bucket collects does not depend on the corpus).
   The inverse frequency is damped to 1 to 1.1: else the shared shingles of a large group would weigh little beside an
   edited word, and whether two texts are near copies would depend on how many other copies there are.
2. Improved consistent weighted sampling: for every sample, each shingle draws r and c from Gamma(2, 1) and b from
   U(0, 1) by its hash; the shingle with the least hash value and its quantised weight is the sample. Two texts agree in
   a sample with a probability that is their weighted Jaccard similarity.
3. Equal texts are one node. Nodes that share a band meet; inside a bucket a breadth-first search links signatures that
   agree in enough samples, so a bucket of n nodes yields at most n - 1 links, never all pairs. Buckets and groups above
   a bound are cut into blocks, and each pair of blocks is a run of its own.
4. The texts of each linked group are searched again with the exact weighted Jaccard similarity. Only such links count.

Every link between different texts that share a band is either verified or joins nodes that verified links join anyway.
With 12 bands of 3 samples a pair at similarity 0.8 shares a band with probability 0.9998.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonnage.llm.common import bound, components, mixed, ngrams, slices, words, written

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 3
BUCKETS = 1 << 18
#: The weight of the rarest shingle is less than 1 + DAMPED times that of the commonest, whatever the corpus.
DAMPED = 0.1
#: Samples that must agree before texts are compared: at similarity 0.8 fewer agree with probability 2e-5.
AGREEING = 18
#: Bounds of one run: nodes of a bucket, and nodes or bytes of texts of a group; above them block pairs are used.
BUCKET_NODES, GROUP_NODES, GROUP_BYTES = 8192, 1024, 4 << 20
_TABLE = 1 << 14
_SALTS = 32
_PARTS = 64


def _variates(samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r ~ Gamma(2, 1), b ~ U(0, 1) and ln c, c ~ Gamma(2, 1), for each table row and sample."""
    draw = np.random.default_rng(20_11)
    r = draw.gamma(2.0, size=(_TABLE, samples)).astype(np.float32)
    b = draw.random((_TABLE, samples), dtype=np.float32)
    c = np.log(draw.gamma(2.0, size=(_TABLE, samples))).astype(np.float32)
    return np.maximum(r, np.float32(1e-4)), b, c


def shingles(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text its distinct shingles in ascending order and how often each occurs; a text of fewer words than a
    shingle, but not none, has one shingle of all its words."""
    hashes, counts = words(raw, offsets, "alphanumeric")
    grams = ngrams(hashes, SHINGLE_WORDS)
    for first, last in zip(counts[:-1].tolist(), counts[1:].tolist(), strict=True):
        if last - first >= SHINGLE_WORDS:
            yield np.unique(grams[first : last - SHINGLE_WORDS + 1], return_counts=True)
        elif last > first:
            yield ngrams(hashes[first:last], last - first), np.ones(1, np.int64)
        else:
            yield np.zeros(0, np.uint64), np.zeros(0, np.int64)


def _bucket(shingle: np.ndarray) -> np.ndarray:
    return (shingle >> np.uint64(46)).astype(np.int64)


def document_frequency(documents: DataFrame) -> tuple[np.ndarray, int]:
    """Documents per bucket of shingles, and documents: fixed-size counts over the whole table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for first, last, raw, offsets in slices(batch["text"]):
                rows += last - first
                for found, _ in shingles(raw, offsets):
                    held[np.unique(_bucket(found))] += 1
        if rows:
            salt = int.from_bytes(np.random.default_rng(rows).bytes(1), "little") % _SALTS
            parts = [*held.reshape(_PARTS, -1), np.array([rows])]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts))), pa.array([salt] * len(parts)), pa.array([p.astype(np.int32).tobytes() if k < _PARTS else p.tobytes() for k, p in enumerate(parts)])], ["part", "salt", "n"])

    def add(table: pa.Table) -> pa.Table:
        """Sums of one part; int32 counts of single tasks come in, int64 sums go out."""
        part = table["part"][0].as_py()
        size = BUCKETS // _PARTS if part < _PARTS else 1
        total = np.zeros(size, np.int64)
        for value in table["n"]:
            data = value.as_buffer()
            total += np.frombuffer(data, np.int64 if data.size == 8 * size else np.int32)
        return pa.table({"part": [part], "salt": [table["salt"][0].as_py()], "n": [total.tobytes()]})

    schema = "part long, salt long, n binary"
    counted = bound(documents, text="text").mapInArrow(count, schema)
    summed = counted.groupBy("part", "salt").applyInArrow(add, schema).groupBy("part").applyInArrow(add, schema)
    found = {r.part: np.frombuffer(r.n, np.int64) for r in summed.collect()}
    if not found:
        return np.zeros(BUCKETS, np.int64), 0
    return np.concatenate([found[k] for k in range(_PARTS)]), int(found[_PARTS][0])


def inverse_frequency(counts: np.ndarray, documents: int) -> np.ndarray:
    """1 for a shingle of all documents, towards 1 + DAMPED for rare ones."""
    return (1 + DAMPED * (1 - 1 / (np.log((1 + documents) / (1 + counts)) + 1))).astype(np.float32)


class Sampler:
    """Signatures of weighted shingle sets."""

    def __init__(self, idf: np.ndarray):
        self.idf = idf
        self.r, self.b, self.c = _variates(BANDS * ROWS)

    def weights(self, shingle: np.ndarray, tf: np.ndarray) -> np.ndarray:
        return self.idf[_bucket(shingle)] * tf.astype(np.float32)

    def signature(self, shingle: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """One 32-bit sample (shingle, quantised log weight) per column."""
        logs = np.log(self.weights(shingle, tf))
        samples = np.zeros(BANDS * ROWS, np.uint64)
        best = np.full(BANDS * ROWS, np.inf, np.float32)
        columns = np.arange(BANDS * ROWS)
        for at in range(0, len(shingle), 8192):
            some = shingle[at : at + 8192]
            one = (some & np.uint64(_TABLE - 1)).astype(np.intp)
            two = ((some >> np.uint64(20)) & np.uint64(_TABLE - 1)).astype(np.intp)
            r, b = self.r[one], self.b[one]
            step = np.floor(logs[at : at + 8192, None] / r + b)
            value = self.c[two] - r * (step - b) - r
            least = value.argmin(axis=0)
            lower = value[least, columns] < best
            best[lower] = value[least, columns][lower]
            key = mixed(some[least] + step[least, columns].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            samples[lower] = key[lower]
        return samples.astype(np.uint32).view(np.int32)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """64-bit keys of the bands of one signature."""
    rows = signature.view(np.uint32).astype(np.uint64).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mixed(key * np.uint64(0x5851F42D4C957F2D) + rows[:, k])
    return key.view(np.int64)


def signatures(documents: DataFrame, idf: np.ndarray) -> DataFrame:
    """(node, signature, bands) of rows (node, text); texts without words have none."""
    shared = documents.sparkSession.sparkContext.broadcast(idf)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(shared.value)
        for batch in batches:
            for first, last, raw, offsets in slices(batch["text"]):
                made = [sampler.signature(found, tf) if len(found) else None for found, tf in shingles(raw, offsets)]
                kept = [k for k, s in enumerate(made) if s is not None]
                if kept:
                    node = batch["node"].slice(first, last - first).take(pa.array(kept))
                    bands = pa.array([band_keys(made[k]) for k in kept], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([node, pa.array([made[k].tobytes() for k in kept], pa.binary()), bands], ["node", "signature", "bands"])

    return documents.select("node", "text").mapInArrow(sign, "node long, signature binary, bands array<long>")


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.RecordBatch]]:
    """Consecutive rows with equal values in the first `keys` columns, also across batches."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(k).to_numpy() for k in range(keys)])
        cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for first, last in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(marks[:, first])
            if key != now and held:
                yield held
                held = []
            now = key
            held.append(batch.slice(first, last - first))
    if held:
        yield held


def _search(n: int, near) -> list[tuple[int, int]]:
    """Links of a breadth-first forest; near(i, rest) gives the members of `rest` that are near i."""
    links, rest = [], np.arange(n)
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            close = near(i, rest)
            links += [(int(i), int(j)) for j in rest[close]]
            queue += rest[close].tolist()
            rest = rest[~close]
    return links


def _edges(nodes: np.ndarray, links: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(links, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(nodes[pairs[:, 0]]), pa.array(nodes[pairs[:, 1]])], ["a", "b"])


def _paired(members: DataFrame, sizes: DataFrame, blocks, key: str) -> DataFrame:
    """`members` with block pairs (p, q): one pair for a group of one block, else every pair that holds the row's block."""
    cut = members.join(sizes.select(key, blocks.alias("blocks")), key)
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cut = cut.select("*", own.alias("own")).select("*", other.alias("other")).filter("blocks = 1 or own <> other")
    return cut.select("*", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q")).drop("own", "other", "blocks")


def candidate_links(signed: DataFrame) -> DataFrame:
    """Links (a, b) between nodes that share a band and agree in enough samples; a forest per bucket."""
    banded = signed.select("node", F.explode("bands").alias("band"))
    sizes = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = _paired(banded, sizes, F.ceil(F.col("n") / BUCKET_NODES).cast("long"), "band").join(signed.select("node", "signature"), "node")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in runs(batches, 3):
            table = pa.Table.from_batches(held)
            nodes = table["node"].to_numpy()
            signature = np.frombuffer(b"".join(table["signature"].to_pylist()), np.int32).reshape(len(nodes), -1)
            links = _search(len(nodes), lambda i, rest, s=signature: (s[rest] == s[i]).sum(axis=1) >= AGREEING)
            if links:
                yield _edges(nodes, links)

    met = met.select("band", "p", "q", "node", "signature").repartition("band", "p", "q").sortWithinPartitions("band", "p", "q", "node")
    return met.mapInArrow(link, "a long, b long")


def verified_links(texts: DataFrame, groups: DataFrame, idf: np.ndarray, similarity: float) -> DataFrame:
    """Links (a, b) of a forest per group over pairs whose exact weighted Jaccard similarity reaches `similarity`.

    `texts` is (node, text), `groups` (node, component)."""
    shared = texts.sparkSession.sparkContext.broadcast(idf)
    members = groups.join(texts, "node")
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("n") / GROUP_NODES), F.ceil(F.col("bytes") / GROUP_BYTES)).cast("long")
    cut = _paired(members, sizes, blocks, "component")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = Sampler(shared.value).weights
        for held in runs(batches, 3):
            table = pa.Table.from_batches(held)
            nodes = table["node"].to_numpy()
            found = [x for _, _, raw, offsets in slices(table["text"]) for x in shingles(raw, offsets)]
            ids, at = np.unique(np.concatenate([f for f, _ in found]), return_inverse=True)
            weights = np.concatenate([weight(f, tf) for f, tf in found]).astype(np.float64)
            starts = np.cumsum([0, *(len(f) for f, _ in found)])
            totals = np.add.reduceat(weights, starts[:-1])
            dense = np.zeros(len(ids))

            def near(i, rest, at=at, weights=weights, starts=starts, totals=totals, dense=dense):
                own = slice(starts[i], starts[i + 1])
                dense[at[own]] = weights[own]
                least = (similarity - 1e-9) * np.maximum(totals[rest], totals[i])
                fit = np.flatnonzero(np.minimum(totals[rest], totals[i]) >= least)
                close = np.zeros(len(rest), bool)
                if len(fit) > len(totals) // 8:  # many to compare: one pass over the run
                    common = np.add.reduceat(np.minimum(dense[at], weights), starts[:-1])[rest[fit]]
                else:
                    its = [slice(starts[k], starts[k + 1]) for k in rest[fit]]
                    common = np.array([np.minimum(dense[at[k]], weights[k]).sum() for k in its])
                close[fit] = common >= (similarity - 1e-9) * (totals[i] + totals[rest[fit]] - common)
                dense[at[own]] = 0.0
                return close

            links = _search(len(nodes), near)
            if links:
                yield _edges(nodes, links)

    cut = cut.select("component", "p", "q", "node", "text").repartition("component", "p", "q").sortWithinPartitions("component", "p", "q", "node")
    return cut.mapInArrow(verify, "a long, b long")


def _node(doc_id: Column, text: Column) -> Column:
    """The id, or for a null id a negative number made from the text."""
    return F.coalesce(doc_id.cast("long"), -F.shiftrightunsigned(F.xxhash64(text), 2) - 1)


def nodes(documents: DataFrame) -> DataFrame:
    """(doc_id, node, copy, text); `copy` is a digest of the text, null counts as the empty text."""
    rows = bound(documents, doc_id="doc_id", text="text").withColumn("text", F.coalesce("text", F.lit("")))
    return rows.select("doc_id", _node(F.col("doc_id"), F.col("text")).alias("node"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("copy"), "text")


def classes(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, class_id): the class of every id, named by its smallest id.

    Texts are near copies if the weighted Jaccard similarity of their TF-IDF shingles of five words (a-z, 0-9 and
    non-ASCII letters, case-blind in ASCII) reaches `similarity`; classes are the connected groups of such links. At 0.8, texts
    of plain Jaccard similarity 0.815 always reach it and texts below 0.784 never do (shingles that occur once a text). Equal
    texts are always near copies, also those without any word: null counts as the empty text. Rows with one id are one
    document in several versions and share a class. A null id is replaced by a negative number made from the text. Repeated
    rows change nothing, an empty table gives no rows.
    """
    named = nodes(documents)
    copies = named.groupBy("copy").agg(F.min("node").alias("head"))
    # the head of a text stands for all its copies: their signatures are equal and need no comparison
    heads = written(named.select("node", "copy").distinct().join(copies, "copy"), "heads")
    own = heads.filter("node = head").select("node", "copy")
    # a text counts once: its copies say nothing about how common its shingles are
    once = named.join(own, ["node", "copy"], "left_semi").dropDuplicates(["node", "copy"])
    counts, rows = document_frequency(once)
    idf = inverse_frequency(counts, rows)
    signed = written(signatures(named, idf).join(own.select("node"), "node", "left_semi"), "signatures")
    groups = written(components(candidate_links(signed)), "groups")
    wanted = own.join(groups, "node").select("node", "copy")
    texts = named.select("node", "copy", "text").join(wanted, ["node", "copy"], "left_semi").dropDuplicates(["node", "copy"]).select("node", "text")
    links = verified_links(texts, groups, idf, similarity)
    several = heads.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("head").alias("head"))
    versions = heads.select("node", "head").join(several.filter("n > 1").select("node"), "node", "left_semi")
    joined = components(links.unionByName(versions.select(F.col("node").alias("a"), F.col("head").alias("b"))))
    joined = joined.withColumnRenamed("node", "head")
    return several.join(joined, "head", "left").select("node", F.coalesce("component", "head").alias("class_id"))


def near_duplicates(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id, class_size (distinct ids) and whether its class keeps it."""
    found = written(classes(documents, similarity), "classes")
    sizes = found.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size"))
    named = bound(documents, doc_id="doc_id", text="text").select("doc_id", _node(F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("node"))
    out = named.join(found, "node").join(sizes, "class_id")
    return out.select("doc_id", "class_id", "class_size", (F.col("node") == F.col("class_id")).alias("kept"))


def keep_one(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class, columns unchanged: the row with the smallest id; of rows with that id any one, as they repeat or
    are versions of each other."""
    found = written(classes(documents, similarity), "classes")
    first = found.filter("node = class_id").select(F.col("node").alias("__near_node"))
    rows = documents.withColumn("__near_node", _node(F.col("doc_id"), F.coalesce("text", F.lit(""))))
    kept = rows.join(first, "__near_node", "left_semi").dropDuplicates(["__near_node"])
    return kept.select([F.col(f"`{c}`") for c in documents.columns])
