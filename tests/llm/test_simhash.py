"""Fingerprints and components against brute force over all pairs."""

import random
import re

import numpy as np
import xxhash
from common import awkward, docs_table

from waybill.llm import simhash
from waybill.llm.simhash import _near, fingerprint_of, near_duplicates, near_links, one_of_each


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(codes, distance):
    root = {c: c for c in codes}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    codes = sorted(root)
    for k, a in enumerate(codes):
        for b in codes[k + 1 :]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    return {c: find(c) for c in codes}


def near_codes(rng, clusters, size):
    """Codes in chains: each differs from one before it in up to two bits."""
    out = []
    for _ in range(clusters):
        chain = [rng.getrandbits(64)]
        for _ in range(size):
            chain.append(rng.choice(chain) ^ (1 << rng.randrange(64)) ^ rng.choice([0, 1 << rng.randrange(64)]))
        out += chain
    return out


def signed(code):
    return code - (1 << 64) if code >> 63 else code


def test_fingerprints_of_awkward_rows(spark):
    rows = awkward()
    got = near_duplicates(docs_table(spark, rows)).collect()
    assert len(got) == len(rows)
    want = {(i, f"{slow_print(t):016x}") for i, t, _ in rows}
    assert {(r["doc_id"], r["fingerprint"]) for r in got} == want
    roots = slow_components([slow_print(t) for _, t, _ in rows], 2)
    least = {}
    for i, t, _ in rows:
        r = roots[slow_print(t)]
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(i, least[roots[slow_print(t)]]) for i, t, _ in rows}


def test_chunks_do_not_change_a_fingerprint(monkeypatch):
    text = " ".join(f"w{k % 37} v{k}" for k in range(500)).encode()
    want = fingerprint_of(text, 3)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert fingerprint_of(text, 3) == want == slow_print(text.decode())


def test_tree_finds_all_pairs():
    rng = random.Random(2)
    for _ in range(20):
        a = np.array([signed(c) for c in near_codes(rng, 5, rng.randint(0, 60))], dtype=np.int64)
        b = np.array([signed(c) for c in near_codes(rng, 2, 9)] + list(a[:7]), dtype=np.int64)
        for x, y in ((a, b), (b, a), (a, a)):
            i, j = _near(x, y, 2)
            near = np.array([[((int(p) ^ int(q)) % (1 << 64)).bit_count() <= 2 for q in y] for p in x]).reshape(len(x), len(y))
            want = {(p, q) for p, q in zip(*np.nonzero(near), strict=True) if x is not y or p < q}
            assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_components_over_many_blocks(spark):
    """Small blocks and a dense region: the index has several levels and a group lies in many blocks."""
    rng = random.Random(3)
    codes = sorted(set(near_codes(rng, 60, 12) + near_codes(rng, 1, 700)))
    table = spark.createDataFrame([(signed(c),) for c in codes], "code long")
    links = [(r["u"] % (1 << 64), r["v"] % (1 << 64)) for r in near_links(table, 2, block=16).collect()]
    root = {c: c for c in codes}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    for u, v in links:
        root[find(u)] = find(v)
    want = slow_components(codes, 2)
    groups = {}
    for c in codes:
        groups.setdefault(find(c), set()).add(c)
    wanted = {}
    for c in codes:
        wanted.setdefault(want[c], set()).add(c)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_one_of_each(spark):
    rows = awkward()
    table = docs_table(spark, rows)
    kept = one_of_each(table)
    assert kept.columns == table.columns
    ids = [r["doc_id"] for r in kept.collect()]
    classes = near_duplicates(table).select("fingerprint", "component_id").distinct()
    assert len(ids) == len(set(ids)) == classes.select("component_id").distinct().count()
    assert 1 in ids and 2 not in ids and 7 in ids and 3 in ids and 4 not in ids and None in ids


def test_empty(spark):
    assert near_duplicates(docs_table(spark, [])).count() == 0
    assert one_of_each(docs_table(spark, [])).count() == 0
