import math
import random
import zlib
from itertools import pairwise

import numpy as np

from tests.llm.fixtures import CLASHING, documents, prose
from tonnage.llm import quality_classifier as q


def junk(seed):
    words = prose(seed, 50).split()
    kind = seed % 3
    return " ".join(w.upper() + "!!" for w in words) if kind == 0 else " | ".join(words) if kind == 1 else " ".join([words[0]] * 60)


def corpus(spark, n=240):
    draw = random.Random(4)
    rows = [(k, junk(k) if k % 4 == 0 else prose(k, draw.randint(20, 90)).capitalize() + ".", "aa", "s", 0) for k in range(n)]
    labels = spark.createDataFrame([(k, int(k % 4 != 0), 0) for k in range(n)], "doc_id long, quality int, toxic int")
    return documents(spark, rows), labels


def plain_statistics(text):
    """STATISTICS of one text, word by word."""
    text = text or ""
    found = [w.encode() for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w]
    raw, n, extra = text.encode(), len(found), q.EMPTY
    symbol = lambda b: 32 < b < 127 and not chr(b).isalnum() and b not in b".,"
    share = lambda part, whole: math.sqrt(part / (whole + extra))
    sizes = [len(w) for w in found]
    mean = sum(sizes) / max(n, 1)
    spread = sum(s * s for s in sizes) / max(n, 1) - mean * mean
    bare = [all(symbol(b) or b in b".," for b in w) for w in found]
    capital = sum(65 <= b <= 90 for b in raw)
    letters = capital + sum(97 <= b <= 122 for b in raw)
    return [
        math.log1p(n), math.log1p(mean), math.log1p(max(spread, 0)), share(capital, letters), share(sum(65 <= w[0] <= 90 for w in found), n),
        share(sum(48 <= b <= 57 for b in raw), len(raw)), share(sum(b in b".," for b in raw), n), math.log1p(sum(map(symbol, raw)) / (n + extra)),
        share(sum(symbol(w[-1]) and not b for w, b in zip(found, bare, strict=True)), n), share(sum(bare), n), share(raw.count(b"\n"), n),
        share(sum(a == b for a, b in pairwise(found)), n), share(max((found.count(w) for w in set(found)), default=0), n),
        math.log1p(len(set(found))) / max(math.log1p(n), 1e-9), share(sum(b > 127 for b in raw), len(raw)),
    ]


def test_statistics_against_word_by_word(spark):
    texts = [None, "", "one", "Éa éa, B!! | | x\ny y y 12.5", prose(3, 200), "### $$$", "a" * 5000, " \n "]
    docs = documents(spark, [(k, t, None, None, None) for k, t in enumerate(texts)])
    for row in q.with_statistics(docs).collect():
        np.testing.assert_allclose(row["__statistics"], plain_statistics(row.text), rtol=1e-9, atol=1e-9)


def test_scores_against_densities(spark):
    docs, labels = corpus(spark)
    x = {r.doc_id: np.array(plain_statistics(r.text)) for r in docs.collect()}
    y = {r.doc_id: r.quality for r in labels.collect()}
    taught = {c: np.array([x[k] for k in x if y[k] == c and zlib.crc32(str(k).encode()) % 5]) for c in (0, 1)}
    cov = {c: np.cov(taught[c].T, bias=True) for c in (0, 1)}
    n = {c: len(taught[c]) for c in (0, 1)}
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    density = {}
    for c in (0, 1):
        s = (1 - q.POOLED) * cov[c] + q.POOLED * pooled
        s = (1 - q.DIAGONAL) * s + q.DIAGONAL * np.diag(np.diag(s)) + q.FLOOR * np.eye(len(s))
        inverse, logdet = np.linalg.inv(s), np.linalg.slogdet(s)[1]
        density[c] = {k: math.log(n[c] / sum(n.values())) - 0.5 * (logdet + (v - taught[c].mean(axis=0)) @ inverse @ (v - taught[c].mean(axis=0))) for k, v in x.items()}
    rows = q.quality(docs, labels).collect()
    assert len(rows) == len(x)
    for r in rows:
        odds = density[1][r.doc_id] - density[0][r.doc_id]
        assert abs(r.score - 1 / (1 + math.exp(-max(-700, min(700, odds))))) < 1e-6
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.3)
    held = [r for r in rows if r.held_out]
    assert held and all(r.predicted == y[r.doc_id] for r in held)


def test_held_out_labels_teach_nothing(spark):
    docs, labels = corpus(spark)
    wrong = labels.withColumn("quality", (q.held_out(labels.doc_id).cast("int") + labels.quality) % 2)
    key = lambda r: r.doc_id
    first, second = (sorted(q.quality(docs, at).collect(), key=key) for at in (labels, wrong))
    assert all(abs(a.score - b.score) < 1e-9 for a, b in zip(first, second, strict=True))


def test_nulls_repeats_clashes_and_empty_tables(spark):
    docs, labels = corpus(spark, 80)
    odd = documents(spark, [(500, None, None, None, None), (501, "", None, None, None), (None, "no id", None, None, None), (3, "again", None, None, None), (502, prose(1, 30_000), None, None, None)])
    rows = docs.unionByName(odd)
    for column in CLASHING.split(", "):
        name, kind = column.split()
        rows = rows.selectExpr("*", f"cast('7' as {kind}) as {name}")
    labels = labels.unionByName(spark.createDataFrame([(None, 1, 0), (5, None, 0), (3, 1, 0)], labels.schema))
    found = q.quality(rows, labels).collect()
    assert len(found) == 85 and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.doc_id in (500, 501)}) == 1
    assert not any(r.held_out for r in found if r.doc_id is None)
    assert q.quality(rows.limit(0), labels).count() == 0
    assert {r.score for r in q.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert len({r.score for r in q.quality(docs, labels.filter("quality = 1")).collect()}) == 1
