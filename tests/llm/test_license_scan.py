import re

from tests.llm.fixtures import documents, prose
from tonnage.llm import license_scan as L


def bigrams(text):
    words = re.findall(r"[^\W_]+", text.lower())
    return set(zip(words[:-1], words[1:], strict=True))


def by_hand(text):
    units, found = [*(text or "").split("\n"), *(re.split(r"\n\s*\n", text) if re.search(r"\n\s*\n", text or "") else []), text or ""], set()
    for unit in dict.fromkeys(units):
        a, scores = bigrams(unit), []
        for name, template in sorted(L.TEMPLATES.items()):
            b = bigrams(template)
            if a and 2 * len(a & b) / (len(a) + len(b)) >= L.SIMILARITY - 1e-9:
                scores.append((-2 * len(a & b) / (len(a) + len(b)), name))
        if scores:
            found.add((min(scores)[1], round(-min(scores)[0], 9), unit))
    return found


def test_against_brute_force(spark):
    t = L.TEMPLATES
    rows = [(k, prose(k, 50).replace(" an ", "\n")) for k in range(10)] + [(20 + k, f"{prose(k, 30)}\n{text}\n{prose(k + 1, 30)}") for k, text in enumerate(t.values())]
    rows += [(40, t["MIT grant"].replace(" ", "\n")), (41, "head\n\n" + t["BSD grant"].replace(", ", ",\n") + "\n \ntail"), (42, t["MIT grant"].replace("restriction", "limits")), (43, None), (44, ""), (45, "\n\n\n"), (46, "licensed under the")]
    rows += [(47, t["GPL-3.0 header"].upper()), (48, t["MIT notice"] + "\n" + t["MIT notice"] + "\n" + t["CC-BY-NC-4.0 notice"]), (49, "x y " * 40_000 + "\n" + t["Apache-2.0 notice"])]
    docs = documents(spark, [(i, x, None, None, None) for i, x in rows], extra=True)
    got = {r.doc_id: {(x.license, round(x.dice, 9), x.unit) for x in r["__licenses"]} for r in L.scanned(docs).collect()}
    assert got == {i: by_hand(x) for i, x in rows}
    assert sum(map(bool, got.values())) >= 14
    summary = {r.doc_id: r for r in L.licenses(docs).collect()}
    assert summary[48].licenses == "CC-BY-NC-4.0 notice, MIT notice" and summary[43].license is None and summary[43].n_units == 0
    assert L.licenses(docs.limit(0)).count() == 0 and {r.n_units for r in L.licenses(docs, {}).collect()} == {0}


def test_plan_is_native(spark):
    plan = L.licenses(documents(spark))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Exchange"))
