"""SimHash fingerprints, index and classes against brute force."""

import re

import numpy as np
import xxhash
from odd_rows import ODD_ROWS, passage
from hypothesis import given, settings
from hypothesis import strategies as st

from slopecast.llm import simhash


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(codes, radius=simhash.RADIUS):
    root = list(range(len(codes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


def clustered(random, n):
    base = random.integers(0, 1 << 63, max(1, n // 12), dtype=np.uint64)
    codes = base[random.integers(0, len(base), n)]
    for _ in range(random.integers(0, 7)):
        codes = codes ^ (np.uint64(1) << random.integers(0, 64, n).astype(np.uint64))
    return codes


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 160))
def test_local_index_finds_the_classes(seed, n):
    codes = clustered(np.random.default_rng(seed), n)
    found = simhash.local_classes(np.zeros(n, np.int64), codes)
    want = plain_classes([int(c) for c in codes])
    assert len(set(zip(found.tolist(), want))) == len(set(want)) == len(set(found.tolist()))


def test_every_word_count_and_case():
    for _, text in ODD_ROWS[:5] + ODD_ROWS[6:]:
        assert simhash.fingerprint(text or "") % (1 << 64) == plain_fingerprint(text)


def test_a_crowded_pattern_is_refined_without_loss(spark):
    codes = sorted({int(c) for c in clustered(np.random.default_rng(5), 400)})
    signed = [(simhash.signed(c),) for c in codes]
    want = plain_classes(codes)
    for node_rows in (4096, 6):
        pairs = simhash.links(spark.createDataFrame(signed, "code long"), node_rows=node_rows)
        root = {r.node: r.root for r in simhash.stars(pairs).collect()}
        got = [root.get(s, s) for (s,) in signed]
        assert len(set(zip(got, want))) == len(set(want)) == len(set(got))


def test_runs_of_bits_cover_all_free_bits():
    for mask in (0, 0xFFF, simhash.divided(0, 4)[2]):
        finer = simhash.divided(mask, 4)
        assert all(f & mask == mask for f in finer)
        assert sum(f ^ mask for f in finer) == (1 << 64) - 1 - mask


def test_odd_rows(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert sorted((str(r.doc_id), r.fingerprint % (1 << 64)) for r in rows) == sorted((str(i), plain_fingerprint(t)) for i, t in ODD_ROWS)
    by_id = {r.doc_id: r.component_id for r in rows if r.doc_id is not None}
    assert by_id[7] == by_id[8] == 7 and by_id[2] == by_id[3] == by_id[4] == 2 and by_id[1] == 1
    assert {r.component_id for r in rows if r.doc_id is None} == {None, 2}  # copies without an id, and the empty text
    assert simhash.near_duplicates(no_docs).count() == 0


def test_near_copies_and_chains(docs_of):
    rows = [(n, passage(1, 200) + f" end{n % 3}") for n in range(40)] + [(100 + n, passage(2 + n, 50)) for n in range(20)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs_of(rows)).collect()}
    root = plain_classes([plain_fingerprint(t) for _, t in rows])
    assert got == {i: rows[r][0] for (i, _), r in zip(rows, root)}
