import hashlib
import random
import re
import string

from tests.llm.fixtures import documents, prose
from tonnage.llm import secret_scan as S

KEY = "".join(random.Random(3).choices("0123456789abcdef", k=40))
TOKENS = ["".join(random.Random(100 + k).choices(string.ascii_letters + string.digits, k=40)) for k in range(60)]


def test_fixed_patterns():
    text = f'é API-key api_key = "{KEY}" token=abc pAsSwD:\'hunter22\' ſecret=abcdefgh AKIA{"Z9" * 8} AKIAshort {KEY[:23]}'
    got = S.base_spans(text)
    kinds = {k: [text[s:e] for kind, s, e in got if kind == k] for k in S.KINDS}
    assert kinds["assign"] == [f'api_key = "{KEY}', "pAsSwD:'hunter22"]
    assert kinds["access"] == ["AKIA" + "Z9" * 8] and kinds["hex"] == [KEY]


def test_a_failing_match_uses_up_its_text():
    assert S.base_spans("token=a1 token=abcdef") == [("assign", 9, 21)]
    assert S.base_spans("tokentoken=token=xy") == [("assign", 5, 19)]


def test_battery_separates_random_from_structured():
    hexes = ["".join(random.Random(k).choices("0123456789abcdef", k=64)) for k in range(300)]
    p = sorted(S.randomness(h, "hex") for h in hexes)
    assert sum(x < 0.05 for x in p) < 40 and sum(x > 0.5 for x in p) > 90
    assert S.randomness("0123456789abcdef" * 4, "hex") < 1e-3 and S.randomness("ab01" * 16, "hex") < 1e-3
    assert S.encoding("onlyletters") is None and S.encoding("1234567890123456") is None
    assert S.encoding("abc0123def") == "hex" and S.encoding("ABCDEFZ234567") == "base32" and S.encoding("aB3+/") == "base64"


def test_false_discovery_limits():
    from collections import Counter

    even = Counter({("hex", 2, c): 5 for c in range(S.CELLS)})  # all random
    low = Counter({("base64", 2, c): 400 if c < 4 else 0 for c in range(S.CELLS)})  # none
    found = S.limits(even + low)
    assert found[("hex", 2)] == S.LEAST_P and found[("base64", 2)] == float("inf")
    mixed = S.limits(even + Counter({("hex", 2, c): 500 for c in range(4)}))
    assert mixed[("hex", 2)] >= 4 / S.CELLS


def test_spans_and_digests(spark):
    rows = [(1, f'x token = "{KEY}" y'), (2, None), (3, ""), (4, prose(4, 50)), (5, "long " * 50_000 + f"secret:{KEY}")]
    rows += [(10 + k, f"{prose(k, 20)} {t} end") for k, t in enumerate(TOKENS)]
    docs = documents(spark, [(i, t, None, None, None) for i, t in rows], extra=True)
    got = {r.doc_id: r for r in S.secrets(docs).collect()}
    assert len(got) == len(rows)
    assert got[1].spans == "assign:2:51,hex:11:51" and got[1].base_sha256 == hashlib.sha256(b"assign:2:51,hex:11:51").hexdigest()
    assert all(got[k].spans == "" and got[k].base_sha256 == hashlib.sha256(b"").hexdigest() for k in (2, 3, 4))
    assert (got[5].n_assign, got[5].n_hex) == (1, 1)
    caught = [k for k, t in enumerate(TOKENS) if got[10 + k].n_random == 1]
    assert len(caught) > 50  # random tokens that no pattern knows
    k = caught[0]
    text = dict(rows)[10 + k]
    kind, start, end = got[10 + k].spans.split(":")
    assert kind == "random" and text[int(start) : int(end)] == TOKENS[k]


def test_redaction(spark):
    docs = documents(spark, [(1, f'a token = "{KEY}" b', "x", "s", 99), (2, None, None, None, None), (3, "plain", None, None, 5)], extra=True)
    got = {r.doc_id: r for r in S.redact(docs).collect()}
    assert S.redact(docs).columns == docs.columns
    assert got[1].text == 'a [SECRET]" b' and got[1].n_chars == len(got[1].text)
    assert got[2].text is None and got[3].text == "plain" and got[3].n_chars == 5
    assert S.redact(docs.limit(0)).count() == 0 and S.secrets(docs.limit(0)).count() == 0
    assert not re.search(KEY, got[1].text)
