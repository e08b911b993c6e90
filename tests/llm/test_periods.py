import random

import pytest

from factloom.llm import substrings
from test_documents import brute_removed, order


@pytest.mark.parametrize("length, periods", [(100, (80, 81, 82)), (30, (10, 11, 12))])
def test_repeats_at_the_width_of_a_string(table, length, periods):
    """Texts that repeat after about as many bytes as a string has parts, each alone with its anchors."""
    rnd, docs = random.Random(length), []
    for period in periods:
        for size in (length + period, length + period + 1, 2 * period + length // 3, 2 * period + length // 2, 3 * period + 5):
            for _ in range(4):
                unit = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(period - 1)) + "\n"
                docs.append((len(docs), (unit * 8)[:size]))
    got = substrings.removed(substrings.repeats(table(docs), "doc_id", "text", length), "doc_id", length).collect()
    want = brute_removed(docs, length)
    assert sorted(map(tuple, got), key=order) == want and any(r[2] for r in want)
