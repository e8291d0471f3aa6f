from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import pytest

from tests.conftest import SF
from tessera.llm import merkle as M
from tessera.llm import queries


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree_of(leaves):
    """Root, and the sibling runs of each leaf, by the definition."""
    level, owners, proofs = leaves, [[i] for i in range(len(leaves))], [[] for _ in leaves]
    while len(level) > 1:
        up, above = [], []
        for at in range(0, len(level), 16):
            run = level[at : at + 16]
            for i in range(len(run)):
                for leaf in owners[at + i]:
                    proofs[leaf].append((run, i))
            up.append(H(*run))
            above.append([x for o in owners[at : at + 16] for x in o])
        level, owners = up, above
    return level[0], proofs


def brute(rows):
    def leaf(r):
        return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees, out = {}, []
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree_of([leaf(r) for r in by[s]])
    root, top = tree_of([trees[s][0] for s in sources]) if sources else (None, [])
    for at, s in enumerate(sources):
        for i, r in enumerate(by[s]):
            chain = trees[s][1][i] + top[at]
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            low = r[4].translate({c: c + 32 for c in range(65, 91)}) if tampered else r[4]
            value = leaf((*r[:4], low))
            for run, slot in chain:
                value = H(*run[:slot], value, *run[slot + 1 :])
            proof = H(*(x for run, slot in chain for j, x in enumerate(run) if j != slot))
            out.append((r[0], leaf(r), trees[s][0], root, proof, value, value == root))
    return Counter(out)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return Counter(tuple(r) for r in M.manifest(df, M.lower_cased_fifth()).collect())


def test_midstates_resume():
    children = [H(str(i)).encode() for i in range(16)]
    parent = M.Parent(b"".join(children))
    assert parent.digest.decode() == H(*(c.decode() for c in children))
    for slot in range(16):
        assert parent.fold(slot, children[slot]) == parent.digest
        other = [*children[:slot], children[3], *children[slot + 1 :]]
        assert parent.fold(slot, children[3]).decode() == H(*(c.decode() for c in other))


@pytest.mark.parametrize("sizes", [[1], [1, 1], [16, 17, 1], [300, 256, 5, 257], [4200, 2], [1] * 300])
def test_trees_of_all_depths(spark, sizes):
    rows, doc_id = [], 0
    for s, n in enumerate(sizes):
        for _ in range(n):
            doc_id += 3
            rows.append((doc_id, f"src{s}", "en", doc_id % 7, f"Text {doc_id} Of it"))
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "", 0, ""), (None, "é", "de", 5, "NULL id"), (None, "é", "de", 5, "again"), (5, "z", "en", 1, None), (7, "Z", None, 9, "A" * 2_000_000), (7, "Z", None, 9, "b"), (8, "￿", "x", 1, "t"), (9, "\U0001f600", "x", 1, "T")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == Counter()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", pos long, tree string")
    assert Counter(tuple(r) for r in M.manifest(df, M.lower_cased_fifth()).collect()) == brute(rows)


def test_nothing_altered(spark):
    df = spark.createDataFrame([(i, "s", "en", i, "T") for i in range(40)], SCHEMA)
    assert all(r.verified for r in M.manifest(df).collect())


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = Counter(tuple(r) for r in queries.op12_merkle(spark, SF).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())
    assert got == brute(rows)
