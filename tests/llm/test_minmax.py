"""Min-max near-duplicates against brute force on whole sets."""

import random
import re

import numpy as np
import pytest
from odd_rows import ODD_ROWS, passage

from slopecast.llm import minmax


def plain_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def plain_near(rows):
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * min(len(a), len(b)) >= 80 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[find(n)] = min(i, least.get(find(n), i))
    return sorted((str(i), len(s), str(least.get(find(n)))) for n, ((i, _), s) in enumerate(zip(rows, sets)))


def found(df):
    rows = df.collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in rows)


def test_signature_is_minimum_and_maximum_and_unbiased():
    rng = np.random.default_rng(1)
    share = []
    for _ in range(60):
        pool = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
        a, b = np.unique(pool[:240]), np.unique(pool[60:])  # 180 of 300
        x, y = minmax.signature(a), minmax.signature(b)
        both = minmax.signature(np.union1d(a, b))
        half = minmax.PERMUTATIONS
        assert (both[:half] == np.minimum(x, y)[:half]).all() and (both[half:] == np.maximum(x, y)[half:]).all()
        share.append((x == y).mean())
    assert abs(np.mean(share) - 0.6) < 0.03


def edited(seed, text, share):
    rng = random.Random(seed)
    words = text.split()
    return " ".join(f"new{seed}x{n}" if rng.random() < share else w for n, w in enumerate(words))


@pytest.mark.parametrize("bucket", [minmax.BUCKET, 2])
def test_edited_texts(docs_of, bucket):
    """Chains, classes that meet only between other members, and pairs on both sides of the bound."""
    rows = []
    for base in range(6):
        text = passage(base, 150)
        rows += [(100 * base + k, edited(100 * base + k, text, share)) for k, share in enumerate([0, 0.01, 0.01, 0.015, 0.02, 0.03, 0.03, 0.05, 0.1, 0, 0])]
        chain = text.split()
        for k in range(12):
            rows.append((100 * base + 50 + k, " ".join(chain[k * 6 :] + [f"tail{n}" for n in range(k * 6)])))
    rows += [(1000 + n, passage(7, 30 + n)) for n in range(20)] + [(2000, "one two"), (2001, "ONE two"), (2002, "one two three"), (2003, "é a b c"), (2004, "É a b c")]
    want = plain_near(rows)
    assert found(minmax.near_duplicates(docs_of(rows), bucket=bucket)) == want
    assert len({c for *_, c in want}) < len(rows) / 2


def test_odd_rows(odd_docs, no_docs):
    assert found(minmax.near_duplicates(odd_docs)) == plain_near(ODD_ROWS)
    assert minmax.near_duplicates(no_docs).count() == 0
