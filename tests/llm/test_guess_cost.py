"""The guess cost against a plain dynamic program over all segments, and long runs in credential contexts."""

import math
import random

import pytest

from slopecast.llm import secret_scan as s


def walks(text):
    return all(text[k : k + 2] in s.NEIGHBOURS for k in range(len(text) - 1))


def plain_cost(value, ranks=s.RANK):
    low, n, two = value.lower(), len(value), math.log10(2)
    best = [0.0] + [math.inf] * n
    for j in range(1, n + 1):
        for i in range(j):
            part, small = value[i:j], low[i:j]
            costs = [s.brute(part)] if j - i == 1 else []
            for word, leet in ((small, 0.0), (small.translate(s.LEET), math.log10(4))):
                if 3 <= j - i <= s.LONGEST_WORD and word in ranks:
                    upper = 0.0 if part == small else math.log10(2 if part in (small.upper(), small.capitalize()) else 2 ** min(j - i, 10))
                    costs.append(two + math.log10(ranks[word]) + leet + upper)
                    break
            found = s.DATE.match(low, i)
            if found and found.end() == j:
                costs.append(two + (s.YEAR_GUESSES if j - i == 4 else s.DATE_GUESSES))
            if j - i >= 3 and walks(small):
                costs.append(two + math.log10(94 * (j - i)))
            for w in (1, 2, 3, 4):
                if j - i >= max(3, 2 * w) and (j - i) % w == 0 and part == part[:w] * ((j - i) // w):
                    costs.append(two + sum(map(s.brute, part[:w])) + math.log10((j - i) // w))
            best[j] = min([best[j], *[best[i] + c for c in costs]])
    return best[n]


def values():
    draw = random.Random(5)
    pieces = ["password", "P4ssw0rd", "1999-12-31", "2014", "qwerty", "lkjhgf", "aaaa", "xyxyxyxy", "abcabc", "T$9", "zq", "9", "Straße", "é"]
    out = ["".join(draw.choice(pieces) for _ in range(draw.randint(1, 6))) for _ in range(60)]
    out += ["".join(draw.choice("ab1!") for _ in range(draw.randint(1, 40))) for _ in range(40)]
    out += ["a" * 130, "ab" * 90, "x" * 70 + "password" + "7" * 80, "aaaa" * 40 + "pple1999", "abcd" * 35 + "q" * 75 + "Zz", "aaab" * 50]
    return [*out, "", "a", "qwertyuiop" * 9, "as" * 40 + "df" * 40]


@pytest.mark.parametrize("value", values())
def test_cost_equals_all_segmentations(value):
    want = plain_cost(value)
    assert s.guess_cost(value) == pytest.approx(want)
    assert (s.guess_cost(value, s.RANK, s.SECRET_GUESSES) >= s.SECRET_GUESSES) == (want >= s.SECRET_GUESSES)


@pytest.mark.parametrize("text", ["password is " + "*" * 300, "bearer " + "x" * 300, "auth is " + "-" * 5000, "token is " + "ab" * 50_000, "pw=abc"])
def test_placeholders_of_any_length_are_no_secrets(text):
    assert s.guessed_spans(text, []) == []


def test_values_of_any_length_are_weighed():
    assert s.guessed_spans("pw: $#!&%@~", []) == [(4, 3, 11)]
    long = "".join(random.Random(1).choices("ABCdef123", k=3000))
    assert s.guessed_spans(f"bearer {'x' * 200}{long}", []) == [(7, 3, 3207)]
