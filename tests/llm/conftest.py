import random
import re

import pytest

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(UPPER, LOWER)


def white_words(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(FOLD))


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(FOLD))


def sentence(rng, n, alphabet="abcdefgh"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, very long, repeated and strange texts."""
    rng = random.Random(4)
    base = sentence(rng, 60)
    return [
        None, "", " \t\n", "a", "Ab aB ab", base, base, base.upper(), base + " x y", base.replace("a", "e", 2), "é́ ﬁ İstanbul ΣΑΣ 漢字 👍🏽 <|endoftext|>x",
        "12 34 !! --", "a\x1cb\x85c\u2028d", sentence(rng, 40_000), "q" * 70_000, "it's we'll 'tis", "\x00\x01", sentence(rng, 9), sentence(rng, 3),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """Those texts with a null id, a repeated row, and columns whose names the operators use inside."""
    rows = [(i, t, "en" if i % 2 else None, "s", None, i, f"k{i}", [i], None) for i, t in enumerate(odd_texts)]
    rows += [rows[5], (None, odd_texts[5], None, None, None, None, None, None, None)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, node long, key string, sig array<int>, length int"
    )


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
