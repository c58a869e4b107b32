"""Small inputs that the tests share."""

import random

#: Names that operators use inside, as extra columns of inputs.
CLASHING = ("kept", "pos", "site", "h1", "h2", "first", "n", "key", "id", "component", "bin", "fill", "island", "anchor", "words", "rule", "score", "held_out", "gone_id", "hit_id", "kept_id", "_drop", "level", "begin")

WORDS = [f"{a}{b}" for a in "ba ce di fo gu ha ki lo mu ne pi ra".split() for b in "n r st l th m".split()]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def awkward_docs() -> list[tuple]:
    """doc_id, text, lang, source, n_chars: nulls in every column, empty and blank, long, ties, repeated rows."""
    long = prose(99, 4000)
    return [
        (1, "", "en", "a", 0),
        (2, None, "en", "a", None),
        (3, " \n\t \n", None, "b", 5),
        (4, "one two", "en", None, 7),
        (5, long, "en", "a", len(long)),
        (6, long, "en", "b", len(long)),
        (6, long, "en", "b", len(long)),
        (None, prose(7, 80), "en", "c", 1),
        (8, "\u00c9t\u00e9 na\u00efve \U0001f600 caf\u00e9 \u6f22\u5b57", "fr", "c", 20),
        (9, prose(9, 120), "en", "a", 500),
        (10, prose(9, 118) + " x y", "en", "b", 500),
    ]


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


