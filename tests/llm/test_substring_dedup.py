import hashlib
import re

import pytest

from tests.llm.fixtures import documents, prose
from tonnage.llm import substring_dedup as S
from tonnage.llm.common import written_once


def by_hand(rows, window):
    first, out = {}, []
    for i, text in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        for k in range(len(ws) - window + 1):
            key, place = tuple(ws[k : k + window]), (S._LEAST_ID if i is None else i, k)
            first[key] = min(first.get(key, place), place)
    for i, text in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for k in range(len(ws) - window + 1):
            if first[tuple(ws[k : k + window])] < (S._LEAST_ID if i is None else i, k):
                gone |= set(range(k, k + window))
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        out.append((i, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


PASSAGE = prose(70, 45)


def cases():
    rows = [(k, prose(k, 90)) for k in range(12)]
    rows += [(20 + k, f"{prose(20 + k, 30)} {PASSAGE}\x0b{prose(60 + k, 25)}") for k in range(8)]
    rows += [(40, rows[3][1]), (41, rows[3][1]), (42, " ".join([PASSAGE] * 3)), (43, None), (44, ""), (45, "short text"), (46, "short text")]
    rows += [(47, "the " * 60), (48, " ".join(PASSAGE.split()[:19])), (49, " ".join(PASSAGE.split()[:20])), (None, PASSAGE), (5, PASSAGE), (5, prose(5, 90)), (50, "\u00a0é " + PASSAGE.upper())]
    return rows


@pytest.mark.parametrize("window", [20, 8])
def test_against_brute_force(spark, window):
    rows = cases()
    docs = documents(spark, [(i, t, None, None, None) for i, t in rows], extra=True)
    got = [tuple(r) for r in S.removal(docs, window).collect()]
    assert sorted(map(str, got)) == sorted(map(str, by_hand(rows, window)))


def test_empty_table(spark):
    assert S.removal(documents(spark).limit(0)).count() == 0


def test_written_once_leaves_the_session_as_it_was(spark):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    rows = spark.range(50).selectExpr("id % 7 AS k").groupBy("k").count()
    assert sorted(written_once(rows, "counts").collect()) == sorted(rows.collect())
    assert spark.conf.get(setting, None) == before
