import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, found string, key string, block int, start string"
SYLLABLES = {"en": ["the", "ing", "ou", "wh", "th", "er", "and"], "de": ["sch", "ung", "ein", "ä", "ch", "ß", "keit"], "es": ["ción", "ñ", "ado", "que", "ll", "rr", "os"]}


def words(rng, lang, n):
    return ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def rows():
    """Documents with copies, near copies, shared passages, repetition within, odd and missing values."""
    rng, out = random.Random(5), []
    base = words(rng, "en", 120)
    shared = words(rng, "de", 70)
    for k in range(60):
        lang = ("en", "de", "es")[k % 3]
        text = words(rng, lang, rng.randint(3, 150))
        if k % 6 == 0:
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(text)
        elif k % 6 == 1:
            at = rng.randrange(len(text))
            text[at:at] = shared[rng.randint(0, 8) :]
        elif k % 6 == 2:
            text = text[:5] * rng.randint(1, 40)
        out.append((k, " ".join(text) if k % 2 else "\n".join(text), lang))
    out += [(100, None, "en"), (101, "", "en"), (102, " \t\n ", None), (103, "42 !!!", "de"), (104, out[6][1], "en"), (105, out[6][1].upper(), None), (106, "one", "en"), (107, "one", "en"), (108, "ONE two", "en")]
    out += [(109, "x" * 30_000, "en"), (110, "Σίσυφος İ é 漢字 😀 \x00 ﬁ", None), (None, out[3][1], "en"), (111, "long " * 6000, None), (112, "a<|endoftext|>b ▁", "en")]
    return [(i, t, lang, "s", len(t or ""), "extra", "extra", 7, "extra") for i, t, lang in out]


@pytest.fixture(scope="session")
def sample():
    return rows()


@pytest.fixture(scope="session")
def docs(spark, sample):
    return spark.createDataFrame(sample, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
