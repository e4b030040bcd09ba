import re

import numpy as np
import pyarrow as pa

from tests.llm.fixtures import documents, prose
from tonnage.llm import decontaminate as D
from tonnage.llm.common import ngrams, text_bytes, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def listed(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def by_hand(text, items):
    own, hit, found = listed(text), set(), set()
    for name, item in items:
        ws = listed(item)
        n = min(10, len(ws))
        for k in range(len(ws) - n + 1 if n else 0):
            for i in range(len(own) - n + 1):
                if own[i : i + n] == ws[k : k + n]:
                    hit |= set(range(i, i + n))
                    found.add(name)
    return len(own), len(hit), sorted(str(f) for f in found)


def cases(spark):
    items = [(k, prose(900 + k, 12 + k)) for k in range(6)] + [(20, "Only Four words é"), (21, "one"), (22, ""), (23, None), (3, prose(903, 15))]
    p = {k: t for k, t in items}
    rows = [(k, prose(k, 80)) for k in range(5)]
    rows += [(10, prose(50, 30) + " " + p[2].upper().replace(" ", ", ") + " " + prose(51, 30)), (11, " ".join(p[4].split()[2:12])), (12, " ".join(p[4].split()[2:11]))]
    rows += [(13, "so only four  words É and é one"), (14, p[0] + " " + p[0]), (15, None), (16, ""), (17, "only four words é"), (18, "x " * 500 + p[5])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    return documents(spark, [(i, t, None, None, None) for i, t in rows], extra=True), benchmark, rows, items


def check(spark, docs, benchmark, rows, items):
    import hashlib

    got = {r.doc_id: r for r in D.contamination(docs, benchmark).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        n, hit, found = by_hand(t, items)
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(found), hit > 0), (i, r)
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()


def test_against_brute_force(spark):
    check(spark, *cases(spark))


def test_blocks_of_the_benchmark(spark, monkeypatch):
    monkeypatch.setattr(D.blocks, "__defaults__", (100,))
    docs, benchmark, rows, items = cases(spark)
    assert len(list(D.blocks(benchmark))) > 3
    check(spark, docs, benchmark, rows, items)


def test_clean_documents_stay(spark):
    docs, benchmark, rows, items = cases(spark)
    kept = D.keep_clean(docs, benchmark)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, t in rows if by_hand(t, items)[1] == 0}
    assert D.keep_clean(docs.limit(0), benchmark).count() == 0
    assert D.keep_clean(docs, benchmark.limit(0)).count() == len(rows)


def test_every_window_keeps_a_fingerprint():
    hashes, _ = words(*text_bytes(pa.array([prose(1, 400, "a b c")])), "alphanumeric")
    grams, kept = D.fingerprints(hashes)
    assert (grams == ngrams(hashes, D.GRAM)).all() and kept.mean() < 0.6
    for i in range(len(hashes) - D.WINDOW + 1):
        inside = grams[i : i + D.WINDOW - D.GRAM + 1]
        assert kept[i : i + len(inside)][inside == inside.min()].all()
    assert not np.isnan(kept.mean())
