import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.fixtures import documents, prose
from tonnage.llm import near_dedup as N
from tonnage.llm.common import components, text_bytes, words


def shingle_weights(rows, idf):
    found = N.shingles(*text_bytes(pa.array([t or "" for t in rows])))
    return [dict(zip(f.tolist(), (idf[N._bucket(f)] * n).tolist(), strict=True)) for f, n in found]


def similarity(a, b):
    common = sum(min(w, b[s]) for s, w in a.items() if s in b)
    return common / (sum(a.values()) + sum(b.values()) - common) if a or b else 1.0


def classes_by_hand(rows, idf):
    """Every pair compared; equal texts and equal ids belong together."""
    weights, parent = shingle_weights([t for _, t in rows], idf), list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][0] == rows[j][0] or (rows[i][1] or "") == (rows[j][1] or "")
            if same or (weights[i] and weights[j] and similarity(weights[i], weights[j]) >= N.SIMILARITY - 1e-9):
                parent[root(i)] = root(j)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(root(k), set()).add(rows[k][0])
    return {frozenset(g) for g in groups.values()}


def edited(text, seed, changes):
    draw, out = np.random.default_rng(seed), text.split()
    for at in draw.choice(len(out), changes, replace=False):
        out[at] = f"edit{seed}x{at}"
    return " ".join(out)


def test_classes_against_all_pairs(spark):
    rows = [(k, prose(k, 200)) for k in range(20)]
    rows += [(100 + k, edited(prose(3, 200), k, 1 + k % 6)) for k in range(30)]  # near copies, some too far
    rows += [(200, prose(5, 200)), (201, None), (202, ""), (203, "two words"), (204, "two words"), (5, prose(7, 200)), (205, prose(5, 200))]
    docs = documents(spark, [(i, t, None, None, None) for i, t in rows], extra=True)
    idf = N.inverse_frequency(*N.document_frequency(docs))
    got = {}
    for r in N.near_duplicates(docs).collect():
        got.setdefault(r.class_id, set()).add(r.doc_id)
        assert r.class_id == min(got[r.class_id] | {r.class_id}) and r.kept == (r.doc_id == r.class_id)
    assert {frozenset(g) for g in got.values()} == classes_by_hand(rows, idf)


def test_blocks_give_the_same_classes(spark, monkeypatch):
    docs = documents(spark, [(k, edited(prose(1, 150), k, 1 + k % 3), None, None, None) for k in range(60)])
    plain = {(r.doc_id, r.class_id) for r in N.near_duplicates(docs).collect()}
    monkeypatch.setattr(N, "BUCKET_NODES", 7)
    monkeypatch.setattr(N, "GROUP_NODES", 9)
    assert {(r.doc_id, r.class_id) for r in N.near_duplicates(docs).collect()} == plain


def test_one_row_of_each_class_stays(spark):
    docs = documents(spark, extra=True)
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and set(range(1, 41)) <= set(ids) and 42 not in ids and None in ids
    assert N.keep_one(docs.limit(0)).count() == 0 and N.near_duplicates(docs.limit(0)).count() == 0


def test_collision_rate_is_weighted_jaccard():
    idf = np.random.default_rng(1).uniform(1, 5, N.BUCKETS).astype(np.float32)
    sampler, rates, truths = N.Sampler(idf), [], []
    for seed in range(40):
        a, b = prose(seed, 300), edited(prose(seed, 300), seed, 20)
        (fa, na), (fb, nb) = N.shingles(*text_bytes(pa.array([a, b])))
        rates.append((sampler.signature(fa, na) == sampler.signature(fb, nb)).mean())
        truths.append(similarity(*shingle_weights([a, b], idf)))
    assert abs(np.mean(rates) - np.mean(truths)) < 0.03


def test_document_frequency_counts_documents(spark):
    docs = documents(spark, [(1, "a b c d e", None, None, None), (2, "A b, c d e", None, None, None), (3, None, None, None, None)])
    counts, n = N.document_frequency(docs.repartition(3))
    assert n == 3 and counts.sum() == 2 and counts.max() == 2


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(50, 40), (40, 45), (45, 45)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{k: 0 for k in range(31)}, 40: 40, 45: 40, 50: 40}
    assert components(edges.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB1 .\té\n", max_size=12), max_size=8))
def test_words_of_texts(texts):
    import re

    hashes, counts, starts, ends = words(*text_bytes(pa.array(texts, pa.string())), "alphanumeric", spans=True)
    raw, offsets = text_bytes(pa.array(texts, pa.string()))
    name = {}
    for k, text in enumerate(texts):
        want = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.replace("B", "b"))
        at = slice(counts[k], counts[k + 1])
        got = [raw[s:e].tobytes().decode().lower() for s, e in zip(starts[at], ends[at], strict=True)]
        assert got == want
        for h, w in zip(hashes[at].tolist(), want, strict=True):
            assert name.setdefault(w, h) == h
    assert len(set(name.values())) == len(name)


def test_a_group_of_a_third_of_the_rows(spark):
    """Plain Jaccard similarity decides, also where the group's shingles are common: all copies have one changed word."""
    base = prose(1, 100).split()
    copies = [" ".join([*base[:at], f"edit{at}", *base[at + 1 :]]) for at in range(5, 95, 2)]
    others = [prose(1000 + k, 100) for k in range(180)]
    plain = [set(d) for d in shingle_weights(copies, np.ones(N.BUCKETS))]
    assert min(max(len(a & b) / len(a | b) for b in plain if b is not a) for a in plain) >= 0.8
    texts = copies + copies + others
    found = {r.doc_id: r.class_id for r in N.near_duplicates(documents(spark, [(k, t, None, None, None) for k, t in enumerate(texts)])).collect()}
    assert {found[k] for k in range(2 * len(copies))} == {0}
    assert len({found[2 * len(copies) + k] for k in range(len(others))}) == len(others)


def test_weights_are_bounded_in_any_corpus():
    for n in (10, 10**6, 10**12):
        idf = N.inverse_frequency(np.array([0, n // 3, n]), n)
        assert (np.diff(idf) < 0).all() and 1 <= idf.min() and idf.max() / idf.min() < 1 + N.DAMPED


def test_copies_do_not_make_shingles_common(spark, monkeypatch):
    seen = []
    count = N.document_frequency
    monkeypatch.setattr(N, "document_frequency", lambda d: seen.append(count(d)) or seen[-1])
    N.classes(documents(spark, [(k, prose(1, 50), None, None, None) for k in range(9)] + [(0, prose(1, 50), None, None, None), (20, prose(2, 50), None, None, None)]))
    assert seen[0][1] == 2 and seen[0][0].max() <= 2
