"""Runs whose fingerprint occurs first in a place that holds less of them."""

import pytest

from gridloom.llm import winnowing


def line(k):
    return f"line {k} of the run has these {k * 7} and {k * 11} words in it"


@pytest.mark.parametrize("held", range(3))
def test_first_place_holds_less(spark, held):
    """A has two lines of the run (26 words), B and C the whole of it: C loses all, whichever fingerprint is taken."""
    own = lambda d, n: "\n".join(f"{d} own {j} line that nobody else at all has got anywhere {d * j}" for j in range(n))
    run = "\n".join(line(k) for k in range(4))
    short = "\n".join([own(1, 5), line(held), line(held + 1), own(2, 5)])
    rows = [(1, short), (2, "\n".join([own(3, 5), run, own(4, 5)])), (3, "\n".join([own(5, 5), run, own(6, 5)]))]
    got = {r["doc_id"]: r["text"] for r in winnowing.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == short
    assert got[3] == own(5, 5) + "\n" + own(6, 5)
