"""Line dedup, decontamination and licence scans."""

import itertools

import pytest
from odd_rows import ODD_ROWS, passage

from slopecast.llm import decontaminate, license_scan, line_dedup


def words_apart(a, b):
    """Edit distance in words."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def plain_dedup(rows):
    """Removed line numbers by comparing all pairs of lines."""
    lines = [(i, n, x) for i, t in rows for n, x in enumerate((t or "").split("\n")) if x.strip(" \t\r\x0b\x0c")]
    lines.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    first, gone = {}, {}
    for i, n, x in lines:
        place = (i is not None, i or 0, n)
        words = x.split(" ")
        near = x in first and first[x] != place
        for y in first if len(words) >= line_dedup.MIN_WORDS and not near else ():
            other = y.split(" ")
            if y != x and len(other) >= line_dedup.MIN_WORDS and abs(len(words) - len(other)) <= 1 and words_apart(words, other) <= 1:
                near = True
        first.setdefault(x, place)
        if near:
            gone.setdefault(i, set()).add(n)
    return gone


def changed(line, n, word):
    words = line.split(" ")
    return " ".join(words[:n] + word + words[n + 1 :])


def near_rows():
    rows, base = [], [passage(n, 9 + n) for n in range(6)]
    for n, line in enumerate(base):
        size = len(line.split(" "))
        rows.append((10 * n, line + "\nown line of document " + str(n)))
        rows.append((10 * n + 1, "\n".join(changed(line, k, ["other"]) for k in range(0, size, 3))))
        rows.append((10 * n + 2, "\n".join(changed(line, k, []) for k in range(1, size, 4)) + "\n\n" + line + " more"))
        rows.append((10 * n + 3, changed(changed(line, 0, ["two"]), size - 1, ["changes"]) + "\n" + line + " and two"))
    rows.append((90, "short line here\nshort line there\nshort line here"))
    rows.append((91, "a a a a a a a a\na a a a a a a a a\na a a a a a a a a a a"))
    return rows


def test_lines_within_one_word(docs_of):
    rows = near_rows()
    got = {r.doc_id: set(r.removed) for r in line_dedup.removed_lines(docs_of(rows)).collect()}
    assert got == plain_dedup(rows)


def test_many_variants_of_one_line(docs_of):
    line = passage(3, 20)
    rows = [(n, changed(line, 7, [f"w{n}"])) for n in range(300)]
    got = {r.doc_id for r in line_dedup.removed_lines(docs_of(rows)).collect()}
    assert got == set(range(1, 300))


def test_kept_text_and_odd_rows(odd_docs, no_docs):
    done = line_dedup.deduplicate(odd_docs).select("row.doc_id", "row.text", "row.removed", "removed", "kept_text").collect()
    assert len(done) == len(ODD_ROWS)
    gone = plain_dedup(ODD_ROWS)
    for r in done:
        removed, clash, text, kept = r[3], r[2], r[1], r[4]
        assert clash == "clash" and set(removed) == gone.get(r.doc_id, set()) or text is None or not text.strip()
        lines = (text or "").split("\n")
        assert kept == (None if text is None else "\n".join(x for n, x in enumerate(lines) if n not in set(removed)))
    assert line_dedup.deduplicate(no_docs).count() == 0


def test_masks_meet_three_substitutions():
    window, wrong = decontaminate.WINDOW, decontaminate.WINDOW - decontaminate.MATCHES
    reads = [[i for i, bit in enumerate(m) if bit == "1"] for m in decontaminate.MASKS]
    for at in itertools.combinations(range(window), wrong):
        assert any(all(s + i not in at for i in read) for read in reads for s in range(window - read[-1]))


def plain_overlaps(docs, items):
    def words(text):
        low = (text or "").lower()
        for c in "\t\n\r\x0b\x0c":
            low = low.replace(c, " ")
        return [w for w in "".join(c for c in low if c not in decontaminate.PUNCTUATION).split(" ") if w]

    out = set()
    for (i, t), (k, u) in itertools.product(docs, items):
        w, v = words(t), words(u)
        if len(v) < decontaminate.MIN_ITEM_WORDS:
            continue
        size = min(decontaminate.WINDOW, len(v))
        need = decontaminate.MATCHES if len(v) >= decontaminate.WINDOW else len(v)
        best = 0
        for diagonal in range(-len(v) + 1, len(w)):
            same = [0 <= diagonal + j < len(w) and w[diagonal + j] == v[j] for j in range(len(v))]
            best = max([best, *(sum(same[s : s + size]) for s in range(len(v) - size + 1))])
        if best >= need:
            out.add((i, k, best))
    return out


ITEMS = [(1, passage(50, 30)), (2, passage(51, 8)), (3, passage(52, 3)), (4, None), (5, passage(53, 15)), (5, passage(53, 15))]


def leaks():
    long, short, mid = passage(50, 30), passage(51, 8), passage(53, 15)
    clean = passage(60, 40)
    rows = [(1, clean), (2, clean + " " + long + " " + clean), (3, clean + " " + short), (4, short[:-3]), (5, mid.upper().replace(" ", ",\n"))]
    for n, at in enumerate([(0, 7, 14), (3, 4, 5), (0, 5, 10), (2, 6, 10), (1, 2, 3, 4)]):
        rows.append((10 + n, " ".join("gone" if k in at else w for k, w in enumerate(mid.split(" ")))))
    rows += [(20, " ".join(long.split(" ")[5:20])), (21, " ".join(long.split(" ")[5:16])), (22, None), (23, ""), (None, long)]
    return rows


@pytest.mark.parametrize("seed_rows", [decontaminate.SEED_ROWS, 0])
def test_overlaps_are_those_of_brute_force(spark, docs_of, seed_rows):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.overlaps(docs_of(leaks()), items, seed_rows=seed_rows).collect()
    assert {(r.doc_id, r.item_id, r.matched) for r in got} == plain_overlaps(leaks(), ITEMS)


@pytest.mark.parametrize("key_rows", [decontaminate.KEY_ROWS, 10])
def test_overlaps_with_a_large_benchmark(spark, docs_of, key_rows):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.overlaps(docs_of(leaks()), items, seed_rows=0, key_rows=key_rows).collect()
    assert {(r.doc_id, r.item_id, r.matched) for r in got} == plain_overlaps(leaks(), ITEMS)


@pytest.mark.parametrize("seed_rows", [decontaminate.SEED_ROWS, 0])
def test_a_hit_copies_neither_its_text_nor_its_item(spark, docs_of, seed_rows):
    rows = [(1, passage(70, 400) + " " + passage(50, 300) + " " + passage(71, 400))]
    items = spark.createDataFrame([(1, passage(50, 300))], "item_id long, text string")
    assert all(len(r.part) <= 2 * decontaminate.WINDOW - 1 for r in decontaminate.benchmark_seeds(items).collect())
    found = decontaminate.overlaps(docs_of(rows), items, seed_rows=seed_rows)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    verified = [line for line in plan.split("\n") if "lambdafunction" in line]
    assert verified and not any("words" in line for line in verified)
    assert [(r.doc_id, r.item_id, r.matched) for r in found.collect()] == [(1, 1, decontaminate.WINDOW)]


def test_overlaps_of_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, passage(4, 60)), (2, passage(5, 40))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(odd_docs, items).collect()}
    assert got == {(7, 1), (8, 1), (None, 2)}
    assert decontaminate.overlaps(no_docs, items).count() == 0
    assert decontaminate.overlaps(odd_docs, items.limit(0)).count() == 0


def plain_licenses(text):
    """Templates whose pairs of words are at least four fifths within some stretch of a text as long as a window."""
    words, out = license_scan.words_of(text or ""), set()
    index = license_scan.Index(license_scan.TEMPLATES)
    for name, own in license_scan.TEMPLATES.items():
        t = license_scan.words_of(own)
        want = set(zip(t, t[1:]))
        m = license_scan.SMALLEST_CLASS
        while m < len(want):
            m *= 2
        pairs = list(zip(words, words[1:]))
        for s in range(0, max(1, len(pairs)), m // 4):
            if len(want & set(pairs[s : s + m * 5 // 4])) >= license_scan.CONTAINMENT * len(want):
                out.add(name)
    assert index.names == sorted(license_scan.TEMPLATES)
    return out


def licensed():
    rows = [(n, passage(n, 30 + 9 * n)) for n in range(12)]
    for n, (name, text) in enumerate(sorted(license_scan.TEMPLATES.items())):
        rows.append((100 + n, passage(n, 13 * n) + "\n" + text.upper() + "\n" + passage(n + 1, 20)))
        words = text.split()
        if len(words) > 25:  # one word of it changed
            rows.append((200 + n, passage(n, 11) + " " + " ".join([*words[:12], "otherwise", *words[13:]]) + " " + passage(n, 300)))
    return rows


def test_licenses_are_found_where_they_are():
    rows = licensed()
    found = license_scan.Index(license_scan.TEMPLATES).matches([t for _, t in rows])
    for (i, t), own in zip(rows, found):
        assert {s["name"] for s in own} == plain_licenses(t), i
        for s in own:
            words = license_scan.words_of(t)[s["first_word"] : s["last_word"] + 1]
            want = license_scan.words_of(license_scan.TEMPLATES[s["name"]])
            assert len({*zip(words, words[1:])} & {*zip(want, want[1:])}) >= 0.8 * len({*zip(want, want[1:])})


def test_licenses_across_pieces(monkeypatch):
    monkeypatch.setattr(license_scan, "PIECE", 256)
    text = passage(1, 700) + " Released under the MIT License. " + passage(2, 900) + " " + license_scan.TEMPLATES["ISC"] + " " + passage(3, 50)
    (own,) = license_scan.Index(license_scan.TEMPLATES).matches([text])
    assert [s["name"] for s in own] == ["ISC", "MIT"]


def test_a_template_longer_than_a_piece(monkeypatch):
    monkeypatch.setattr(license_scan, "PIECE", 256)
    long = " ".join(f"clause{n * n % 1009} term{n}" for n in range(400))
    index = license_scan.Index({"long": long, "MIT": license_scan.TEMPLATES["MIT"]})
    assert index.widest > license_scan.PIECE
    found = index.matches([passage(1, 300) + " " + long + " " + passage(2, 900) + " Released under the MIT License.", passage(3, 50), long])
    assert [[s["name"] for s in own] for own in found] == [["MIT", "long"], [], ["long"]]
    assert found[2][0]["containment"] == 1.0


def test_licenses_of_odd_rows(odd_docs, no_docs):
    got = license_scan.scan(odd_docs).collect()
    assert len(got) == len(ODD_ROWS) and not any(r.licenses for r in got)
    assert license_scan.scan(no_docs).count() == 0
