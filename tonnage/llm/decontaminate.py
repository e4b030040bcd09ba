"""Benchmark decontamination by winnowing.

Of every text, the minimum k-gram hash of each sliding window of hashes is kept (all of them, if several share the
minimum), so every shared span of at least `window` words holds a fingerprint that both texts kept. Document fingerprints
are joined with the fingerprints of the benchmark and each hit is extended to both sides, word by word; spans of at least
`window` words count. An item of fewer words than that, but not none, is one window of its own: such short windows are
matched whole, by one hash per length that occurs.

The benchmark side is broadcast in blocks of a fixed number of bytes, each with its own pass over a document's words in
the same stage; documents are never shuffled and no hit leaves its row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonnage.llm.common import bound, digest, ngrams, slices, text_bytes, words

WINDOW = 10
GRAM = 5
#: Bytes of benchmark text in one broadcast.
BLOCK_BYTES = 16 << 20
HITS = "struct<n_words:bigint,spans:array<bigint>,items:array<string>>"


def fingerprints(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(k-gram hashes, whether winnowing keeps them) of a list of words that may run over several texts.

    Windows across texts only add fingerprints; they never take one away, so the guarantee holds for each text."""
    grams = ngrams(hashes, gram)
    wide = window - gram + 1
    kept = np.zeros(len(grams), bool)
    if len(grams) < wide:
        return grams, kept
    least = grams[: len(grams) - wide + 1].copy()
    for i in range(1, wide):
        np.minimum(least, grams[i : i + len(least)], out=least)
    for i in range(wide):
        kept[i : i + len(least)] |= grams[i : i + len(least)] == least
    return grams, kept


@dataclass(frozen=True)
class Benchmark:
    """Items of one block: word hashes, fingerprints in hash order, and the short items by length."""

    names: list[str | None]
    words: np.ndarray
    offsets: np.ndarray
    prints: np.ndarray
    places: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]


def index(names: list[str | None], texts: list[str | None], window: int = WINDOW, gram: int = GRAM) -> Benchmark:
    hashes, offsets = words(*text_bytes(pa.array(texts, pa.string())), "alphanumeric")
    grams, kept = fingerprints(hashes, window, gram)
    lengths = np.diff(offsets)
    places = np.flatnonzero(kept)
    item = np.searchsorted(offsets, places, "right") - 1
    own = (places + gram <= offsets[item + 1]) & (lengths[item] >= window)
    places = places[own]
    order = np.argsort(grams[places], kind="stable")
    short = {}
    for n in np.unique(lengths[(lengths > 0) & (lengths < window)]).tolist():
        at = np.flatnonzero(lengths == n)
        value = ngrams(hashes, n)[offsets[at]]
        order_n = np.argsort(value, kind="stable")
        short[n] = (value[order_n], at[order_n])
    return Benchmark(names, hashes, offsets, grams[places][order], places[order], short)


def _meet(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (index in values, index in the sorted table) of equal values."""
    low, high = np.searchsorted(table, values, "left"), np.searchsorted(table, values, "right")
    count = high - low
    left = np.repeat(np.arange(len(values)), count)
    return left, np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)


def _extend(a: np.ndarray, i: int, low: int, high: int, b: np.ndarray, j: int, first: int, last: int) -> tuple[int, int]:
    """The longest span of a around i, inside [low, high), that runs equal to b around j, inside [first, last)."""
    back = min(i - low, j - first)
    differ = np.flatnonzero(a[i - back : i] != b[j - back : j])
    start = i - back + (int(differ[-1]) + 1 if len(differ) else 0)
    ahead = min(high - i, last - j)
    differ = np.flatnonzero(a[i : i + ahead] != b[j : j + ahead])
    return start, i + (int(differ[0]) if len(differ) else ahead)


def find(b: Benchmark, hashes: np.ndarray, counts: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> dict[int, tuple[list, set]]:
    """Text number to (hit spans in words of the text, item numbers)."""
    out: dict[int, tuple[list, set]] = {}

    def hit(text: int, start: int, end: int, item: int) -> None:
        spans, items = out.setdefault(text, ([], set()))
        spans.append((start - int(counts[text]), end - int(counts[text])))
        items.add(item)

    grams, kept = fingerprints(hashes, window, gram)
    at = np.flatnonzero(kept)
    left, right = _meet(grams[at], b.prints)
    done: dict[tuple[int, int], int] = {}
    for i, j in zip(at[left].tolist(), b.places[right].tolist(), strict=True):
        text = int(np.searchsorted(counts, i, "right")) - 1
        item = int(np.searchsorted(b.offsets, j, "right")) - 1
        if i + gram > counts[text + 1] or done.get((text, j - i, item), -1) >= i:
            continue
        start, end = _extend(hashes, i, int(counts[text]), int(counts[text + 1]), b.words, j, int(b.offsets[item]), int(b.offsets[item + 1]))
        done[(text, j - i, item)] = end
        if end - start >= window:
            hit(text, start, end, item)
    for n, (values, owners) in b.short.items():
        left, right = _meet(ngrams(hashes, n), values)
        for i, j in zip(left.tolist(), right.tolist(), strict=True):
            text = int(np.searchsorted(counts, i, "right")) - 1
            if i + n <= counts[text + 1]:
                hit(text, i, i + n, int(owners[j]))
    return out


def _merged(spans: list[tuple[int, int]]) -> list[int]:
    """Disjoint ascending spans, flattened."""
    out: list[int] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Benchmark]:
    """The benchmark as indexes of about `block_bytes` of text each."""
    items = bound(benchmark, name="item_id", text="text").select(F.col("name").cast("string").alias("name"), "text").distinct()
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    count = max(1, -(-size // block_bytes))
    for k in range(count):
        rows = items.filter(F.pmod(F.xxhash64("name", "text"), F.lit(count)) == k).orderBy("name", "text").collect()
        yield index([r.name for r in rows], [r.text for r in rows])


def marked(documents: DataFrame, benchmark: DataFrame, column: str = "__hits") -> DataFrame:
    """`documents` with a struct column: n_words, spans (start and end word of disjoint hit spans, flattened) and items.

    Null texts have no words. Items without words match nothing; repeated items and rows count once; hits of an item with
    a null id mark words, but the item is not listed. An empty benchmark hits nothing.
    """
    context = documents.sparkSession.sparkContext

    def judge(shared) -> Column:
        @F.arrow_udf(HITS)
        def hits(texts: pa.Array, earlier: pa.Array) -> pa.Array:
            b = shared.value
            n_words, spans, items = [], [], []
            for first, last, raw, offsets in slices(texts):
                hashes, counts = words(raw, offsets, "alphanumeric")
                n_words.append(np.diff(counts))
                found = find(b, hashes, counts)
                for k in range(last - first):
                    before = earlier[first + k].as_py() if earlier.null_count < len(earlier) else None
                    old, known = (before["spans"], before["items"]) if before else ([], [])
                    if k in found or old:
                        new, fresh = found.get(k, ([], set()))
                        spans.append(_merged([*new, *zip(old[::2], old[1::2], strict=True)]))
                        items.append(sorted({*known, *(b.names[i] for i in fresh if b.names[i] is not None)}))
                    else:
                        spans.append(())
                        items.append(())
            n = np.concatenate(n_words) if n_words else np.zeros(0, np.int64)
            return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], ["n_words", "spans", "items"])

        return hits

    out = documents.withColumn(column, F.lit(None).cast(HITS))
    for b in blocks(benchmark):
        out = out.withColumn(column, judge(context.broadcast(b))(F.col("text"), F.col(column)))
    return out


def _covered(spans: Column) -> Column:
    """Sum of (end - start) over flattened spans."""
    signed = F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    return F.aggregate(signed, F.lit(0).cast("bigint"), lambda total, x: total + x)


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the hit spans."""
    rows = marked(bound(documents, doc_id="doc_id", text="text"), benchmark)
    found = rows.select("doc_id", "__hits.*")
    n_hit = _covered(F.col("spans"))
    items = digest(F.array_join("items", ","))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), items.alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans")


def keep_clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, columns unchanged, that hold no window of any benchmark item."""
    clean = marked(documents, benchmark).filter(F.size("__hits.spans") == 0)
    return clean.select([F.col(f"`{c}`") for c in documents.columns])
