import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import documents, prose
from tonnage.llm import mixing as M


@pytest.fixture(scope="module")
def tables(spark):
    rows = []
    for k in range(240):
        text = prose(k, 60 + k % 40)
        if k % 4 == 0:
            text += " | bad | row |"
        if k % 5 == 0:
            text = "nasty " + text + " nasty."
        rows.append((k, text, None, None, None))
    docs = documents(spark, rows + [(1000, None, None, None, None), (1001, "", None, None, None), (None, "no id", None, None, None), rows[3]], extra=True)
    labels = spark.createDataFrame([(k, int(k % 4 != 0), int(k % 5 == 0)) for k in range(160)] + [(159, 1, 0), (7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_posteriors_of_unlabelled_documents(spark, tables):
    docs, labels = tables
    got = M.rates(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        assert abs(sum(r[p] for p in M.P) - 1) < 1e-9 and r.rate >= 0
        if r.doc_id is not None and 160 <= r.doc_id < 240:
            assert (r.p_good_toxic + r.p_poor_toxic > 0.5) == (r.doc_id % 5 == 0)
            assert (r.p_good_clean + r.p_good_toxic > 0.5) == (r.doc_id % 4 != 0)
    empty = {r.doc_id: r for r in got if r.doc_id in (1000, 1001)}
    assert all(r.n_tokens == 0 for r in empty.values())


def test_expected_tokens_meet_the_targets(spark, tables):
    docs, labels = tables
    got = M.rates(docs, labels, targets={"good_clean": 0.6, "good_toxic": 0.1, "poor_clean": 0.25, "poor_toxic": 0.05}).collect()
    total = sum(r.n_tokens for r in got)
    for name, share in zip(M.P, (0.6, 0.1, 0.25, 0.05), strict=True):
        assert abs(sum(r.rate * r.n_tokens * r[name] for r in got) - share * total) < 0.002 * total


def test_rates_against_projected_gradient_by_hand(spark):
    draw = np.random.default_rng(5)
    p = draw.dirichlet(np.full(4, 0.3), 50)
    n = draw.integers(1, 100, 50)
    rows = spark.createDataFrame([(int(a), *map(float, q)) for a, q in zip(n, p, strict=True)], "__tokens long, " + ", ".join(f"__p_{d} double" for d in M.DOMAINS))
    targets = dict(zip(M.DOMAINS, (0.7, 0.0, 0.3, 0.0), strict=True))
    got = np.array([r.r for r in rows.select(M.rate_after(M.fit_rates(rows, targets, steps=15)).alias("r")).collect()])
    goal = np.array(list(targets.values())) * n.sum()
    h = (p * n[:, None]).T @ p
    weight = np.linalg.inv(h)
    rate, left = np.ones(50), np.inf
    for _ in range(15):
        miss = (rate * n) @ p - goal
        before, left = left, miss @ weight @ miss
        if np.abs(miss).max() <= M.MISS * goal.sum() or left > (1 - M.GAIN) * before:
            break
        rate = np.maximum(0, rate - p @ weight @ miss)
    assert np.allclose(sorted(got), sorted(rate), atol=1e-9) and (got == 0).any()


def test_mixed_documents_and_empty_tables(spark, tables):
    docs, labels = tables
    kept = M.mixed(docs, labels)
    assert kept.columns == [*docs.columns, "mix_rate"]
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert not any(i is not None and i < 240 and i % 5 == 0 for i in ids) and {i for i in ids if i is not None and i < 240 and i % 20 in (1, 2, 3)}
    assert M.rates(docs.limit(0), labels).count() == 0
    flat = M.rates(docs, labels.limit(0)).select(*M.P).distinct().collect()
    assert len(flat) == 1 and all(math.isclose(x, 0.25) for x in flat[0])


def test_plans_are_native(spark, tables):
    docs, labels = tables
    plan = M.rates(docs, labels)._jdf.queryExecution().toString() + M.with_posteriors(docs, M.fit(docs, labels))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    assert F.col("x") is not None


def test_clean_documents_stay(spark):
    """Learned from half of the labels of sf0.1; the other half says which documents are clean."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").filter("quality is not null and toxic is not null")
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    half = labels.filter("pmod(xxhash64(doc_id, 1), 2) = 0")
    held = {r.doc_id: r.toxic for r in labels.join(half, "doc_id", "left_anti").collect()}
    kept = {r.doc_id: r.mix_rate for r in M.mixed(docs, half).collect()}
    clean = [i for i, toxic in held.items() if not toxic]
    assert sum(i not in kept for i in clean) < 0.04 * len(clean)
    assert sum(i in kept for i in held if held[i]) < 0.1 * (len(held) - len(clean))


def test_a_clean_document_stays_at_rate_zero(spark, tables):
    docs, labels = tables
    kept = {r.doc_id: r.mix_rate for r in M.mixed(docs, labels, {"good_clean": 1.0, "good_toxic": 0.0, "poor_clean": 0.0, "poor_toxic": 0.0}).collect()}
    assert {i for i in range(240) if i % 5} <= kept.keys() and not {i for i in range(240) if i % 5 == 0} & kept.keys()
    assert min(kept.values()) == 0.0


def test_evidence_that_many_features_need():
    few, many = M._least_cell({0: 90, 12: 10}), M._least_cell({0: 10_000_000, 12: 10})
    assert few == 12 and many > M.CELLS and M._least_cell({}) > M.CELLS
