import hashlib
import itertools
import zlib

from tests.llm.fixtures import documents
from tonnage.llm import merkle_manifest as m


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, text)])


def tree(digests):
    """Root, and per leaf its way: slot and siblings of every run; levels are built one after the other."""
    ways, groups = [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(digests) > 1:
        runs = [range(k, min(k + 3, len(digests))) for k in range(0, len(digests), 3)]
        for run in runs:
            for node in run:
                for i in groups[node]:
                    ways[i].append([None if k == node else digests[k] for k in run])
        groups = [sum((groups[k] for k in run), []) for run in runs]
        digests = [sha(*(digests[k] for k in run)) for run in runs]
    return digests[0], ways


def brute(rows):
    by = {}
    for row in rows:
        by.setdefault(row.source, []).append(row)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in sources:
        by[source].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text)))
        trees[source] = tree([leaf_of(r, r.text) for r in by[source]])
    root, ups = tree([trees[s][0] for s in sources])
    out = []
    for source, up in zip(sources, ups, strict=True):
        for row, way in zip(by[source], trees[source][1], strict=True):
            text = row.text
            if text is not None and row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % 2 == 0:
                text = text.replace("\n", "")
            top = leaf_of(row, text)
            for run in way + up:
                top = sha(*(top if d is None else d for d in run))
            proof = sha(*(d for run in way + up for d in run if d is not None))
            out.append((row.doc_id, leaf_of(row, row.text), trees[source][0], root, proof, top, top == root))
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(v is not None, v) for v in r])


def test_positions_are_completion_order():
    for n in (1, 2, 3, 4, 8, 9, 10, 27, 28, 80, 100):
        levels = m.levels_over(n)
        log = m.appended([f"leaf {k}" for k in range(n)], levels)
        places = sorted(m.position(level, k, n) for level in range(levels + 1) for k in range(-(-n // 3**level)))
        assert places == list(range(len(log)))
        root, ways = tree([f"leaf {k}" for k in range(n)])
        assert log[-1] == root
        sides = m.siblings(log, n, levels)
        for k, way in enumerate(ways):
            assert [others for _, others in m.path(sides, k)] == ["".join(d for d in run if d) for run in way]
            if all(len(d) == 64 for run in way for d in run if d):
                assert m.folded(f"leaf {k}", m.path(sides, k)) == root


def test_brute_force_with_nulls_repeats_and_line_ends(spark):
    docs = documents(spark, extra=True)
    more = documents(spark, [(k, "a\nb\n" * (k % 3), None, f"é{k % 5}", k) for k in range(100, 190)] + [(7, None, None, None, None)], extra=True)
    docs = docs.unionByName(more)
    assert ordered(m.manifest(docs).collect()) == ordered(brute(docs.collect()))


def test_single_row_and_empty_table(spark):
    one = documents(spark, [(5, "x\ny", None, None, 3)])
    found = m.manifest(one).collect()
    assert ordered(found) == ordered(brute(one.collect()))
    assert found[0].proof_sha256 == sha("") and found[0].leaf == found[0].root
    assert m.manifest(one.limit(0)).count() == 0


def test_several_tiers_of_builders(spark):
    rows = [(k, f"text {k}\n", "aa", "hot" if k % 3 else f"s{k % 40}", k) for k in range(400)]
    docs = documents(spark, rows)
    assert ordered(m.manifest(docs, levels=2).collect()) == ordered(brute(docs.collect()))
    log = m.log(docs, levels=2).orderBy("tree", "position").collect()
    for name, nodes in itertools.groupby(log, key=lambda r: r.tree):
        nodes = list(nodes)
        assert [r.position for r in nodes] == list(range(len(nodes)))
        leaves = [r.digest for r in nodes if r.level == 0]
        assert [r.digest for r in nodes] == m.appended(leaves, m.levels_over(len(leaves))), name
