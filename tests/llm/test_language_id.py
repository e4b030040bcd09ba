import math
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.fixtures import LANGUAGES, documents, prose
from tonnage.llm import language_id as L
from tonnage.llm.common import text_bytes


def brute_force(training: list[bytes], text: bytes, order: int) -> float:
    """Code length in bits, byte by byte, from plain dictionaries."""
    counts = defaultdict(Counter)
    for t in training:
        t = b"\n" * order + t
        for i in range(order, len(t)):
            for d in range(order + 1):
                counts[t[i - d : i]][t[i]] += 1
    bits, t = 0.0, b"\n" * order + text
    for i in range(order, len(t)):
        for d in range(order, -1, -1):
            seen = counts.get(t[i - d : i])
            if seen:
                total, kinds = sum(seen.values()), len(seen)
                if seen[t[i]]:
                    bits -= math.log2(seen[t[i]] / (total + kinds))
                    break
                bits -= math.log2(kinds / (total + kinds))
        else:
            bits += 8
    return bits


def test_code_lengths_against_brute_force():
    training = {"aa": [prose(k, 40).encode() for k in range(5)], "bb": [prose(k, 30, LANGUAGES["bb"]).encode() for k in range(4)]}
    texts = [prose(9, 20), "Ünseen bytes é!", "", "a", prose(8, 10, LANGUAGES["bb"])]
    for order in (1, 3):
        lang, gram, n = [], [], []
        for name, some in training.items():
            g, c = np.unique(L.grams(*text_bytes(pa.array([t.decode() for t in some])), order), return_counts=True)
            lang += [name] * len(g)
            gram.append(g)
            n.append(c)
        scorer = L.Scorer(L.model(pd.Series(lang), np.concatenate(gram), np.concatenate(n), order))
        got = scorer.lengths(*text_bytes(pa.array(texts)))
        want = [[brute_force(training[name], t.encode(), order) for name in ("aa", "bb")] for t in texts]
        assert np.allclose(got, want, rtol=1e-5, atol=1e-4)


def test_index_finds_exactly_its_keys():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 5000).astype(np.uint64))
    index = L.Index(keys)
    assert (index.find(keys) == np.arange(len(keys))).all()
    assert (index.find(keys + np.uint64(1 << 41)) == -1).all()


def test_held_out_accuracy_and_special_rows(spark):
    docs = documents(spark, extra=True)
    got = L.identify(docs)
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == docs.count()
    rows = {r.doc_id: r for r in got.collect()}
    held = [k for k in range(1, 41) if rows[k].held_out]
    assert held and all(rows[k].lang_pred == ("aa" if k % 2 else "bb") for k in range(1, 41))
    assert all(rows[k].lang_pred == "und" and rows[k].score == 0 for k in (41, 42, 45))
    assert rows[44].lang_pred == "bb" and 0.5 < rows[44].score <= 1 and not rows[None].held_out


def test_prediction_ignores_lang_of_held_out_rows(spark):
    docs = documents(spark)
    changed = docs.withColumn("lang", F.when(L.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    assert sorted(map(str, L.identify(docs).collect())) == sorted(map(str, L.identify(changed).collect()))


def test_filter_keeps_columns_and_empty_tables(spark):
    docs = documents(spark, extra=True)
    kept = L.keep_known(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == {41, 42, 45}
    assert L.identify(docs.limit(0)).count() == 0 and L.keep_known(docs.limit(0)).count() == 0
    unlabelled = L.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}
