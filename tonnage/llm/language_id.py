"""Language identification by prediction by partial matching.

Per language, a variable-order byte context tree (orders 0 to `order`) with escape method C gives the exact code
length of a whole text under frozen counts: at each byte the longest context seen in training predicts; if the byte
never followed it there, an escape is paid and the next shorter context predicts, down to a uniform byte code. The
language with the shortest code wins.

The trees of all languages are kept as tables keyed by (context, byte): code lengths are worked out once per key, so
scoring is a table look-up per byte and per escape, done on whole Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonnage.llm.common import bound, slices

#: Bound of the training sample: about this many whole texts of each language, chosen by hash.
ROWS_PER_LANGUAGE = 2_000
#: Longest context in bytes.
ORDER = 3
UNKNOWN = "und"
_SCALE = 1 << 30
_PAD = 0x0A
_EMPTY = np.int32(-1)
RESULT = "struct<lang_pred:string,score:double,bits_per_byte:double>"


class Index:
    """Positions of 64-bit keys by open addressing, built and read as whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, np.uint64(0))
        bits = max(4, int(4 * max(len(keys), 1) - 1).bit_length())
        self.mask, self.shift = np.uint64((1 << bits) - 1), np.uint64(64 - bits)
        self.slots = np.full(1 << bits, _EMPTY)
        left, at = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(left):
            free = self.slots[at] == _EMPTY
            self.slots[at[free]] = left[free]  # the last one to claim a slot has it
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + np.uint64(1)) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 where it is unknown."""
        at = self._home(keys)
        found = self.slots[at]
        wrong = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        while len(wrong):
            at[wrong] = (at[wrong] + np.uint64(1)) & self.mask
            found[wrong] = self.slots[at[wrong]]
            wrong = wrong[(found[wrong] >= 0) & (self.keys[found[wrong]] != keys[wrong])]
        return found


@dataclass(frozen=True)
class Model:
    languages: list[str]
    order: int
    keys: list[np.ndarray]  # by order: (context, byte) seen in any language
    bits: list[np.ndarray]  # by order: code length per key and language
    contexts: list[np.ndarray]  # by order: contexts seen in any language
    escapes: list[np.ndarray]  # by order: escape cost per context and language, 0 where the language lacks the context


def grams(raw: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """Each byte with the `order` bytes before it, as one number; line ends stand before the start of a text."""
    out = raw.astype(np.uint64)
    for back in range(1, order + 1):
        out[back:] |= raw[:-back].astype(np.uint64) << np.uint64(8 * back)
    lengths = np.diff(offsets)
    for depth in range(min(order, int(lengths.max(initial=0)))):  # bytes of the text before it don't count
        heads = offsets[:-1][lengths > depth] + depth
        pad = sum(_PAD << (8 * back) for back in range(depth + 1, order + 1))
        out[heads] = (out[heads] & np.uint64((1 << (8 * (depth + 1))) - 1)) | np.uint64(pad)
    return out


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(documents: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, order: int = ORDER) -> Model:
    """Trees from a bounded sample of whole labelled texts; held-out rows and rows without an id are not read."""
    rows = bound(documents, doc_id="doc_id", text="text", lang="lang").filter("lang is not null and text is not null and doc_id is not null")
    rows = rows.filter(~held_out(F.col("doc_id")))
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(_SCALE))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = F.lit(False)
    for lang, n in sorted(counts.items()):
        chosen = chosen | ((F.col("lang") == lang) & (draw < int(_SCALE * min(1.0, rows_per_language / n))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch["lang"].to_pandas()
            for lang, at in langs.groupby(langs).groups.items():
                for _, _, raw, offsets in slices(batch["text"].take(pa.array(np.asarray(at)))):
                    key, n = np.unique(grams(raw, offsets, order), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counted = rows.filter(chosen).select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    table = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    return model(table["lang"], table["gram"].to_numpy(np.int64).view(np.uint64), table["n"].to_numpy(), order)


def model(lang: pd.Series, gram: np.ndarray, n: np.ndarray, order: int) -> Model:
    """Code lengths of every known (context, byte) from the counts of the longest contexts."""
    languages = sorted(set(lang))
    code = np.searchsorted(languages, lang) if languages else np.zeros(0, int)
    out = Model(languages, order, [], [], [], [])
    shorter = (np.zeros(1, np.uint64), np.full((1, len(languages)), 8.0))  # a uniform byte code
    for depth in range(order + 1):
        key, at = np.unique(gram & np.uint64((1 << (8 * (depth + 1))) - 1), return_inverse=True)
        seen = np.zeros((len(key), len(languages)))
        np.add.at(seen, (at, code), n)
        context, of = np.unique(key >> np.uint64(8), return_inverse=True)
        total, kinds = np.zeros((len(context), len(languages))), np.zeros((len(context), len(languages)))
        np.add.at(total, of, seen)
        np.add.at(kinds, of, seen > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(kinds > 0, -np.log2(kinds / (total + kinds)), 0.0)
            direct = -np.log2(seen / (total + kinds)[of])
        below = np.searchsorted(shorter[0], key & np.uint64((1 << (8 * depth)) - 1))
        bits = np.where(seen > 0, direct, escape[of] + shorter[1][below])
        out.keys.append(key)
        out.bits.append(bits)
        out.contexts.append(context)
        out.escapes.append(escape)
        shorter = (key, bits)
    return out


class Scorer:
    """Code lengths of texts under every language of a model."""

    def __init__(self, m: Model):
        self.model = m
        self.keys = [Index(k) for k in m.keys]
        self.contexts = [Index(c) for c in m.contexts]
        self.bits = [np.ascontiguousarray(b.T.astype(np.float32)) for b in m.bits]

    def lengths(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits per text and language."""
        m = self.model
        gram = grams(raw, offsets, m.order)
        out = np.zeros((len(offsets) - 1, len(m.languages)))
        filled = np.flatnonzero(offsets[:-1] < offsets[1:])
        if not len(filled):
            return out
        top = self.keys[m.order].find(gram)
        left = np.flatnonzero(top < 0)
        extra = np.zeros((len(left), len(m.languages)))
        rest, rows = gram[left], np.arange(len(left))
        for depth in range(m.order, -1, -1):  # escape to shorter contexts
            at = self.contexts[depth].find((rest & np.uint64((1 << (8 * (depth + 1))) - 1)) >> np.uint64(8))
            extra[rows] += np.where((at >= 0)[:, None], m.escapes[depth][at], 0.0)
            if not depth:
                extra[rows] += 8.0
                break
            at = self.keys[depth - 1].find(rest & np.uint64((1 << (8 * depth)) - 1))
            extra[rows[at >= 0]] += m.bits[depth - 1][at[at >= 0]]
            rows, rest = rows[at < 0], rest[at < 0]
        for k in range(len(m.languages)):
            cost = self.bits[m.order][k][top]
            cost[left] = extra[:, k]
            out[filled, k] = np.add.reduceat(cost, offsets[:-1][filled], dtype=np.float64)
        return out


def predict(documents: DataFrame, m: Model, text: str = "text") -> DataFrame:
    """`documents` with a struct column `__language` (lang_pred, score, bits_per_byte).

    `score` is the posterior of the winner under equal priors. A null text, a text without any letter, and every text
    if nothing was learned, give `und` with score 0. Ties go to the first language by name. Repeated rows get equal
    results, empty tables an empty result; other columns pass untouched.
    """
    shared = documents.sparkSession.sparkContext.broadcast(m)
    held: list[Scorer] = []

    @F.arrow_udf(RESULT)
    def classify(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if not held:
            held.append(Scorer(shared.value))
        scorer = held[0]
        names = pa.array(scorer.model.languages, pa.string())
        for array in texts:
            best, score, rate = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]
            for _, _, raw, offsets in slices(array):
                bits = scorer.lengths(raw, offsets)
                best.append(bits.argmin(axis=1))
                least = bits.min(axis=1)
                score.append(1 / np.exp2(np.maximum(least[:, None] - bits, -1000.0)).sum(axis=1))
                rate.append(least / np.maximum(np.diff(offsets), 1))
            yield pa.StructArray.from_arrays(
                [names.take(pa.array(np.concatenate(best))), pa.array(np.concatenate(score)), pa.array(np.concatenate(rate))], ["lang_pred", "score", "bits_per_byte"]
            )

    nothing = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"))
    if not m.languages:
        return documents.withColumn("__language", nothing)
    lettered = F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False))
    scored = documents.withColumn("__language", classify(F.col(f"`{text}`")))
    return scored.withColumn("__language", F.when(lettered, F.col("__language")).otherwise(nothing.cast(T._parse_datatype_string(RESULT))))


def identify(documents: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, order: int = ORDER) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, bits_per_byte, by trees fitted on the same table."""
    m = fit(documents, rows_per_language, order)
    scored = predict(bound(documents, doc_id="doc_id", text="text"), m)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "__language.*")


def keep_known(documents: DataFrame, most_bits: float = 8.0, rows_per_language: int = ROWS_PER_LANGUAGE, order: int = ORDER) -> DataFrame:
    """The documents, columns unchanged, whose text some learned language explains.

    `und` documents go, and those whose best code is not shorter than `most_bits` a byte, what coding bytes at random takes."""
    scored = predict(documents, fit(documents, rows_per_language, order))
    kept = (F.col("__language.lang_pred") != UNKNOWN) & (F.col("__language.bits_per_byte") < most_bits)
    return scored.filter(kept).select([F.col(f"`{c}`") for c in documents.columns])
