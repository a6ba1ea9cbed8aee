"""Spelling variants against brute force."""

import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from odd_rows import ODD_ROWS, WORDS

from slopecast.llm import queries, spelling


def plain_counts(rows):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    counts = plain_counts(rows)
    deleted = {}
    for w in counts:
        for i in range(len(w)):
            deleted.setdefault((w[:i], w[i + 1 :]), set()).add(w)
    near = {w: set() for w in counts}
    for (a, b), own in deleted.items():
        whole = {a + b} & set(counts)
        for w in own:
            near[w] |= own | whole
        for w in whole:
            near[w] |= own
    form = {}
    for w, own in near.items():
        own.discard(w)
        best = min(own, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 5 * counts[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), counts[w], len(near[w]), counts.get(form[w])) for w in counts}


def collected(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abé", min_size=1, max_size=7), max_size=40, unique=True))
def test_scan_finds_all_pairs(words):
    words = sorted(words)
    want = {(i, j) for j in range(len(words)) for i in range(j) if one_edit(words[i], words[j])}
    assert sorted(spelling.near_pairs(words)) == sorted(want)


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = plain_variants([(r.doc_id, r.text) for r in docs.collect()])
    got = collected(queries.QUERIES["op12_spelling_variants"](spark, sf_dir))
    assert got == want and any(f for f, *_ in want.values())


def test_divided_lists_lose_no_pair(spark):
    base = ["common", "commonly", "harbour", "abababab"]
    words = {w[:i] + c + w[i + k :] for w in base for i in range(len(w) + 1) for c in "abcdefghij" for k in (0, 1)} | set(base)
    words = sorted(w for w in words if len(w) >= 6)
    vocab = spark.createDataFrame([(w, 5 + n) for n, w in enumerate(words)], "word string, n long")
    want = sorted((a, b, 5 + n) for n, b in enumerate(words) for a in words if one_edit(a, b))
    for size in (2, 16, 10_000):
        assert sorted(tuple(r) for r in spelling.near_words(vocab, size).collect()) == want


def test_odd_rows_and_chains(spark, odd_docs, no_docs, docs_of):
    assert collected(spelling.variants(odd_docs)) == plain_variants(ODD_ROWS)
    assert spelling.variants(no_docs).count() == 0
    # A chain of forms, ties between forms, letters beyond ASCII, capitals, and a word of 2,000 letters.
    long = "".join(WORDS) * 20
    words = ["abcdef"] * 5 + ["abcdefg"] * 30 + ["ABCDEFGH"] * 160 + ["ététés"] * 6 + ["ététér"] * 30 + ["ététéz"] * 30 + [long] * 5 + [long[:-1]] * 26
    rows = [(n, w) for n, w in enumerate(words)]
    got = collected(spelling.variants(docs_of(rows)))
    assert got == plain_variants(rows)
    assert got["abcdef"][1] == "abcdefgh" and got["ététés"][0] == "ététér"
