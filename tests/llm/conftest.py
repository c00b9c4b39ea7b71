import random

import pytest

EXTRA = "key long, node string, bucket string, size string, norm string, n int, __pass int, copies string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Null ids, texts and sources, ids that doubles cannot hold, empty and very long texts, ties, many repeats of a row, and columns with names the operators use."""
    rng = random.Random(4)
    words = ["the", "of", "and", "river", "stone", "bridge", "über", "niño", "walk", "light", "|", "x1"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = text(80)
    rows = [(i, text(rng.randint(1, 120)), "en", f"s{i % 3}", 1) for i in range(40)]
    rows += [(100, None, None, None, None), (101, "", "en", "s0", 0), (102, "   ", "en", "s0", 3), (103, text(30_000), "en", None, 0), (104, "x" * 200_000, "en", "s1", 0)]
    rows += [(None, base, "en", "s1", 1), (None, base, "en", "s1", 1), (105, base, "en", "s2", 1), (106, base + " extra", "en", "s2", 1), (106, base + " extra", "en", "s2", 1)]
    rows += [(107, base.replace(" ", "\n"), "en", "s0", 1), (107, text(50), "en", "s0", 1), (0, text(20), "en", "s0", 1), (-5, "a\tb\x0b\x0cc\r\nd", "en", "s0", 1)]
    rows += [(2**53 + 1, text(30), "en", "s1", 1), (2**53 + 3, base, "fr", "s1", 1), (2**53 + 5, text(3), "en", None, 1), (-(2**53) - 1, text(9), "en", "s2", 1), (2**63 - 1, text(7), "en", "s2", 1)]
    rows += [(110, "the same row of many", "en", "s1", 1)] * 30
    extra = (7, "n", "b", "s", "m", 3, 1, "c")
    return spark.createDataFrame([r + extra for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    return "/root/testdata/sf0.001"
