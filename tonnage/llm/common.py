"""Helpers the operators of this package share: tables, word hashing on Arrow buffers, components of a graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonnage.sources.scratch import written

__all__ = ["bound", "components", "mixed", "ngrams", "read", "slices", "text_bytes", "words", "written", "written_once"]

#: Bytes of text that one round of numpy work takes; a longer text is taken whole, alone.
CHUNK_BYTES = 1 << 20
_WORD_CHARS = "0123456789abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under private names, so that no extra column of the caller can clash."""
    return df.select([F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def digest(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array, and the len + 1 offsets of the texts in it. Null is the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def slices(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, text after the last, bytes, offsets) of consecutive slices of about `most` bytes, whole texts only."""
    raw, offsets = text_bytes(texts)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _byte_values(keep: np.ndarray) -> np.ndarray:
    """A random 64-bit value for every byte that belongs to words, 0 for every byte that separates them."""
    values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.where(keep, values, np.uint64(0))


def _alphanumeric() -> np.ndarray:
    """ASCII digits, letters (A-Z as a-z) and every byte of a non-ASCII character."""
    keep = np.zeros(256, bool)
    keep[[ord(c) for c in _WORD_CHARS]] = True
    keep[128:] = True
    values = _byte_values(keep)
    values[65:91] = values[97:123]
    return values


def _spaced() -> np.ndarray:
    keep = np.ones(256, bool)
    keep[[0x20, *range(0x09, 0x0E)]] = False
    return _byte_values(keep)


#: Byte values per definition of a word: "alphanumeric" is case-blind for ASCII, "spaced" takes all but white space.
WORDS = {"alphanumeric": _alphanumeric(), "spaced": _spaced()}
_STEP = np.uint64(0x5851F42D4C957F2D)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd step and of its inverse modulo 2^64."""
    if n > len(_powers.cache[0]):
        inverse = pow(int(_STEP), -1, 1 << 64)
        up, down = np.full(n, _STEP), np.full(n, np.uint64(inverse))
        up[0] = down[0] = 1
        _powers.cache = (np.cumprod(up), np.cumprod(down))
    return _powers.cache[0][:n], _powers.cache[1][:n]


_powers.cache = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def words(raw: np.ndarray, offsets: np.ndarray, kind: str, spans: bool = False) -> tuple[np.ndarray, ...]:
    """Hashes of all words of the texts, and the len + 1 offsets of the texts in that list.

    With `spans`, also the first byte of each word and the byte after its last."""
    values = WORDS[kind][raw]
    inside = values != 0
    if not inside.any():
        none = (np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
        return (*none, np.zeros(0, np.int64), np.zeros(0, np.int64)) if spans else none
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[heads] = inside[heads]
    starts = np.flatnonzero(begins)
    up, down = _powers(max(len(raw), CHUNK_BYTES))
    hashes = mixed(np.add.reduceat(values * up[: len(raw)], starts) * down[starts])
    counts = np.searchsorted(starts, offsets)
    if not spans:
        return hashes, counts
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[heads[1:] - 1] = inside[heads[1:] - 1]
    ends[-1] = inside[-1]
    return hashes, counts, starts, np.flatnonzero(ends) + 1


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that start at each word; the last n - 1 words start none."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out *= _STEP
        out += hashes[i : i + count]
    return mixed(out)


def written_once(df: DataFrame, name: str) -> DataFrame:
    """`written`, but the shuffle files of the write go when it ends, not whenever the driver collects garbage.

    For a frame that no later job computes again: those would have to make the files anew."""
    conf, setting = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(setting, None)
    conf.set(setting, "true")
    try:
        return written(df, name)
    finally:
        conf.unset(setting) if before is None else conf.set(setting, before)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph (a, b): its smallest node names a component.

    Alternating large-star and small-star rounds; each keeps at most one edge per old edge, and is written to the
    shared folder, so no round sees more than the edges and no list of links reaches the driver."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    sign = _sign(now)
    while sign[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(hung.unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), "edges")
        sign, before = _sign(now), sign
        if sign == before:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _sign(edges: DataFrame) -> tuple:
    mixed_ab = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(mixed_ab, F.lit(1 << 20))), F.bit_xor(mixed_ab)).first())
