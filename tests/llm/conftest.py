import random

import pytest

#: doc_id, text and source come with names that operators use inside, to clash with them.
EXTRA = ("row", "id", "n", "key", "bin", "features", "fp", "bucket", "drops", "keeper", "token", "component_id", "of", "lines", "value")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
SHARED = "This very line stands in a good many of the documents, word for word"


def awkward_rows():
    """Nulls everywhere, empty and very long texts, ties, repeated rows and ids, shared lines, near copies, odd characters."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 8)))
    base = " ".join(word() for _ in range(120))
    texts = [
        (1, None, "b"), (2, "", None), (3, "one two three", "a"), (3, "one two three", "a"), (3, "other text of that id", "a"), (None, "no id at all", "b"), (None, None, None),
        (4, " ".join(word() for _ in range(30_000)), "a"), (5, "x" * 20_000, "c"), (6, " \t\r\n\x0b\x0c ", "c"), (7, "ÄÖ É ü Ωmega \U0001f600 é   nbsp wide", "c"),
        (8, base, "a"), (9, base, "b"), (10, base.replace(base.split()[60], "changed"), "c"), (11, base.upper(), "d"), (12, "<|endoftext|> <|startoftext|> a  b\n c \n\n", "d"), (-5, "negative id", "d"),
    ]
    texts += [(20 + i, f"{'  ' * (i % 2)}{SHARED if i % 3 else SHARED.upper()}\nown line {i}\n{SHARED}" + "\n" * (i % 2), "abc"[i % 3]) for i in range(7)]
    texts += [(40 + i, " ".join(word() for _ in range(rng.randint(5, 400))), "abcd"[i % 4]) for i in range(40)]
    return [(i, t, "en", s, None if t is None else len(t), *EXTRA) for i, t, s in texts]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
