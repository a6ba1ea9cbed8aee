"""Rows that every operator must bear."""

WORDS = "the quick brown fox jumps over a lazy dog while seven small boats drift slowly past the old harbour wall at dusk and nobody minds".split()


def passage(seed, n):
    """Words that depend on the seed, so that two passages share next to nothing."""
    return " ".join(f"{WORDS[(seed * 7 + i * (seed % 5 + 1)) % len(WORDS)]}{(seed * 31 + i * 17) % 97}" for i in range(n))


#: Null and repeated ids, null and empty texts, a very long text without blanks and one with, ties, copies.
ODD_ROWS = [
    (1, passage(1, 80) + "\n" + passage(2, 30)),
    (2, None),
    (3, ""),
    (4, " \n\t\n "),
    (5, "x" * 200_000),
    (6, (passage(3, 400) + "\n") * 60),
    (7, passage(4, 60)),
    (8, passage(4, 60)),
    (8, passage(4, 60)),
    (9, "été naïve 日本語 \U0001f600 é \x1c \x85 <|endoftext|> it's 12,345"),
    (None, passage(5, 70)),
    (None, passage(5, 70)),
    (None, None),
    (10, "A b.\r\nA b.\r\n\r\n!!! 42 ###"),
    (11, passage(6, 60).replace(" ", " ")),
]
#: Names that the operators use themselves.
CLASHING = "row ids decoded fingerprint component_id root removed kept_text key of text_key h1 line words at hit item_id matched lang_pred score kept level distance n_words group_0 start".split()
