import random

import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """``frame([(id, text), ...])`` with extra columns whose names clash with the operators' own."""

    def build(rows, name="doc_id"):
        rows = [(i, t, "x", 1, 2, "a", True) for i, t in rows]
        return spark.createDataFrame(rows, f"{name} long, text string, label string, n int, fp long, digest string, kept boolean").repartition(3)

    return build


@pytest.fixture(scope="session")
def corpus():
    """Nulls, empties, ties, copies, near copies, shared passages, long texts, odd characters."""
    rnd = random.Random(4)
    words = [rnd.choice("abcdefgh") * rnd.randint(1, 3) + rnd.choice(["the", "Ä", "é", "x1", "ß9", "\u3042", "\U0001F600", "o."]) for _ in range(150)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage, base = text(45), text(120)
    docs = {0: None, 1: "", 2: " \t\n", 3: "one", 4: "One  two", 5: "one two\x0b", 6: base, 7: base, 8: base.upper(), 9: base.replace(" ", "\n"), 10: base + " tail"}
    for i in range(11, 60):
        docs[i] = text(rnd.randint(0, 80)) + (" " + passage + " " + text(5) if i % 3 == 0 else "")
    docs[60] = text(25_000)
    docs[61] = docs[60][5_000:60_000]
    docs[62] = "same words again and " * 40
    docs[63] = "\x00\x01 weird\x7f words\x85next\u00a0nbsp \u2003em"
    for i in range(64, 90):
        docs[i] = base[: len(base) - (i % 7)]
    return docs
