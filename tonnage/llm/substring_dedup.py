"""Substring dedup: words covered by a window of 20 words that also starts earlier in the corpus are removed.

Suffix automata of the whole corpus can't be broadcast with a bounded size, and passes of all documents over all shards
grow with the square of the corpus (see the README). This operator gets the same spans by hashing, in four steps, each
exact but for 64-bit hash collisions:

1. Of equal texts only the one with the smallest id is looked into; every window of a later copy starts earlier.
2. Winnowing with 5-grams keeps the least hash of every window (16 5-grams), which depends on the window's words alone.
   Consecutive windows with one place of the least hash, the leftmost, form a segment, about two per 17 words. Segments
   whose hash stands at one place of the corpus hold no repeated window; only those bare hashes are counted.
3. Segments are compared whole: one whose words also stand earlier goes with all its windows. The first of equal segments
   starts before the others, so it alone speaks for its windows: these are compared one by one with those of other segments.
   A passage that a third of all documents share is thus one segment row a document and a few windows at its ends.
   Counting combines on the map side, and each join back has one row per hash on one side, so adaptive execution may
   split the other.
4. Each document removes the words its repeated windows cover: maximal spans of at least 20 words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonnage.llm.common import bound, mixed, ngrams, slices, text_bytes, words, written_once

WINDOW = 20
GRAM = 5
_LEAST_ID = -(1 << 63)
_NOTHING = hashlib.sha256(b"").hexdigest()
RESULT = "struct<n_words:bigint,n_removed:bigint,kept:string>"


def segments(hashes: np.ndarray, counts: np.ndarray, window: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(first window, number of windows, least hash, text) of the segments of several texts; `counts` are their word offsets.

    A segment has at most window - gram + 1 windows, so its first and its last one share words."""
    grams = ngrams(hashes, gram)
    wide = window - gram + 1
    n = len(grams) - wide + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    least, place = grams[:n].copy(), np.arange(n)
    for i in range(1, wide):
        less = grams[i : i + n] < least
        least[less] = grams[i : i + n][less]
        place[less] = np.flatnonzero(less) + i
    text = np.repeat(np.arange(len(counts) - 1), np.diff(counts))[:n]
    inside = np.flatnonzero(np.arange(n) + window <= counts[1:][text])  # windows across texts are none
    if not len(inside):
        return inside, inside, np.zeros(0, np.uint64), inside
    new = np.flatnonzero(np.append(True, place[inside[1:]] != place[inside[:-1]]))
    first = inside[new]
    return first, np.diff(np.append(new, len(inside))), least[first], text[first]


def _seeds(texts: DataFrame, window: int) -> DataFrame:
    """(seed, key, n): least hashes of the segments of each text, and how many of its segments have it."""

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch["key"].to_numpy()
            for first, _, raw, offsets in slices(batch["text"]):
                _, _, least, text = segments(*words(raw, offsets, "spaced"), window)
                if not len(least):
                    continue
                order = np.lexsort((least, text))
                value, owner = least[order], text[order]
                new = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])))
                n = np.diff(np.append(new, len(value)))
                yield pa.RecordBatch.from_arrays([pa.array(value[new].view(np.int64)), pa.array(keys[first + owner[new]]), pa.array(n)], ["seed", "key", "n"])

    return texts.mapInArrow(seed, "seed long not null, key long not null, n long not null")


def _segments(texts: DataFrame, window: int) -> DataFrame:
    """(segment, key, id, start, hashes of its windows) of the segments whose least hash is among `seeds`."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, seeds = batch["id"].to_numpy(), batch["key"].to_numpy(), batch["seeds"]
            for first, last, raw, offsets in slices(batch["text"]):
                hashes, counts = words(raw, offsets, "spaced")
                start, n, least, text = segments(hashes, counts, window)
                known = np.zeros(len(start), bool)
                borders = np.searchsorted(text, np.arange(last - first + 1))
                for k in range(last - first):
                    low, high = borders[k], borders[k + 1]
                    known[low:high] = np.isin(least[low:high], seeds[first + k].values.to_numpy().view(np.uint64))
                start, n, text = start[known], n[known], text[known]
                if not len(start):
                    continue
                whole = ngrams(hashes, window)
                # the first and the last window share words, so they and their distance determine the segment
                segment = mixed(mixed(whole[start] + n.astype(np.uint64)) + whole[start + n - 1])
                ends = n.cumsum()
                windows = whole[np.arange(ends[-1]) + np.repeat(start - ends + n, n)]
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(windows.view(np.int64)))
                columns = [pa.array(c) for c in (segment.view(np.int64), keys[first + text], ids[first + text], start - counts[text])]
                yield pa.RecordBatch.from_arrays([*columns, lists], ["segment", "key", "id", "start", "hashes"])

    return texts.mapInArrow(cut, "segment long not null, key long not null, id long not null, start long not null, hashes array<long> not null")


def _repeated(parts: DataFrame) -> DataFrame:
    """(key, start, n): runs of n windows that also start earlier.

    What the whole segments leave open is written once, as two plans read it; the shuffle files of that write go with its end."""
    place = F.struct("id", "start")
    first = parts.groupBy("segment").agg(F.min(place).alias("first"))
    late = place > F.col("first")
    judged = parts.join(first, "segment").select("key", "id", "start", F.size("hashes").alias("n"), F.when(~late, F.col("hashes")).alias("hashes"))
    judged = written_once(judged, "segments")
    gone = judged.filter("hashes is null").select("key", "start", "n")
    windows = judged.filter("hashes is not null").select("key", "id", "start", F.posexplode("hashes").alias("at", "hash"))
    windows = windows.select("hash", "key", "id", (F.col("start") + F.col("at")).alias("start"))
    least = windows.groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last").select("hash", "first")
    return gone.unionByName(windows.join(least, "hash").filter(late).select("key", "start", F.lit(1).alias("n")))


def removal(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256.

    Words are runs of anything but space and the control characters 9 to 13, compared byte by byte. A word goes if a window
    that covers it has a twin that starts earlier: in a document with a smaller id, or in the same document before it.
    Windows are judged on the input. Null and empty texts have no words; texts shorter than a window lose none. A null id
    sorts first. Rows that repeat id and text get equal results and don't count as earlier than each other; of rows with one
    id and different texts the earlier start counts, and neither if they start alike.
    """
    docs = bound(documents, doc_id="doc_id", text="text")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST_ID)).alias("id"), F.coalesce(F.unhex(F.md5(text.cast("binary"))), F.lit(b"")).alias("copy"), text.alias("text"))
    heads = keyed.groupBy("copy").agg(F.min("id").alias("id"))
    # one exchange of the texts, by a key of text and id: all joins with texts are on that key; the branches that read it take
    # every column and no column is nullable, as the exchange is shared only where nothing is pruned or filtered below it
    key = F.xxhash64("copy", "id").alias("key")
    texts = keyed.select(key, "id", "copy", "text").join(heads.select(key), "key", "left_semi")
    seeds = _seeds(texts, window)
    again = seeds.groupBy("seed").agg(F.sum("n").alias("n")).filter("n > 1").select("seed")
    known = seeds.select("seed", "key").join(again, "seed", "left_semi").groupBy("key").agg(F.collect_set("seed").alias("seeds"))
    parts = _segments(texts.join(known, "key"), window)
    later = _repeated(parts).groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("runs"))

    @F.arrow_udf(RESULT)
    def cut(texts: pa.Array, runs: pa.Array) -> pa.Array:
        raw, offsets = text_bytes(texts)
        n_words, n_removed, kept = [], [], []
        for k in range(len(texts)):
            found = raw[offsets[k] : offsets[k + 1]].tobytes().split()  # the same white space
            gone = 0
            n_words.append(len(found))
            if runs[k].is_valid:
                start, n = (runs[k].values.field(x).to_numpy() for x in ("start", "n"))
                edges = np.zeros(len(found) + 1, np.int64)
                np.add.at(edges, start, 1)
                np.add.at(edges, start + n - 1 + window, -1)
                covered = edges.cumsum()[:-1] > 0
                gone = int(covered.sum())
                found = [found[i] for i in np.flatnonzero(~covered)]
            n_removed.append(gone)
            kept.append(hashlib.sha256(b" ".join(found)).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["n_words", "n_removed", "kept"])

    judged = texts.join(later, "key", "left").select("copy", F.col("id").alias("head"), cut("text", "runs").alias("r")).dropDuplicates(["copy"])
    out = keyed.select("doc_id", "id", "copy").join(judged, "copy").select("doc_id", (F.col("id") > F.col("head")).alias("late"), "r.*")
    all_gone = F.col("late") & (F.col("n_words") >= window)
    return out.select("doc_id", "n_words", F.when(all_gone, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(all_gone, F.lit(_NOTHING)).otherwise(F.col("kept")).alias("kept_sha256"))
