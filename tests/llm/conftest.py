import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the of and house river bridge stone window garden light".split(), "de": "der und das haus fluss brücke stein fenster garten licht".split()}


def prose(seed, n=60, lang="en"):
    rng = random.Random(seed)
    made = [rng.choice(WORDS[lang]) if rng.random() < 0.4 else "".join(rng.choice(("ra", "ti", "mo", "len", "sk", "ver")) for _ in range(3)) for _ in range(n)]
    return " ".join(made)


BIG = (1 << 60) + 1


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows, ids beyond 2**53."""
    rows = [(i, prose(i, 40 + i, "de" if i % 3 == 0 else "en"), "de" if i % 3 == 0 else "en", f"s{i % 4}") for i in range(40)]
    rows += [(100, None, "en", "s1"), (101, "", "en", None), (102, " \n\t ", None, "s2"), (None, prose(1, 41), "en", "s1"), (None, None, None, None), (BIG, prose(7, 200), "en", "s0"), (BIG + 2, prose(8, 200), "en", "s0")]
    rows += [(103, "x " * 9000 + prose(9, 3000), "en", "s3"), (104, "\U0001f600 é́ ﬁ <|endoftext|> tab\tend  ", "en", "s3"), (5, prose(5, 45), "en", "s1"), (5, prose(5, 45), "en", "s1"), (105, prose(5, 45), "en", "s1"), (106, "123 456 !!!", "en", "s2")]
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with further columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("clash") for c in ("score", "size", "target", "fp", "piece", "length", "spans", "quality", "media", "part", "sequence_id", "component_id", "kept", "n", "label")})
