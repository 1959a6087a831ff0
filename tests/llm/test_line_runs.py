"""Repeated runs of lines that have no sure fingerprint, or whose fingerprints first occur elsewhere."""

import random

import pytest

from tessera.llm import line_dedup

r = random.Random(11)


def line(n):
    return " ".join(f"w{r.randrange(10**7)}" for _ in range(n))


def removed(spark, rows):
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return {x["doc_id"]: (x["n_removed"], x["text"]) for x in got}


@pytest.mark.parametrize("sizes", [(30, 30), (11, 49), (26, 26), (49, 1), (1,) * 50, (20, 0, 20, 20, 1)])
def test_short_runs_in_different_surroundings(spark, sizes):
    rows, want = [], {}
    for i in range(0, 40, 2):
        run = "\n".join(map(line, sizes))
        for d in (i, i + 1):
            rows.append((d, "\n".join([line(15), line(15), run, line(15), line(15)])))
        want[i + 1] = len(sizes)
    got = removed(spark, rows)
    assert {d: n for d, (n, _) in got.items() if n} == want
    assert all(len(got[d][1].split("\n")) == 4 for d in want)


def test_run_around_lines_known_from_elsewhere(spark):
    rows, want = [(0, "")], {}
    for i in range(1, 60, 3):
        run = [line(20) for _ in range(4)]
        for k, known in enumerate(run):  # each line first occurs by itself in an earlier document
            rows.append((-4 * i - k, "\n".join([line(15), known, line(15)])))
        for d in (i, i + 1):
            rows.append((d, "\n".join([line(15), *run[:2], run[2], run[3], line(15)])))
        want[i + 1] = 4
    got = removed(spark, rows)
    assert {d: got[d][0] for d in want} == want
    only = removed(spark, [(1, "\n".join([line(15), a := line(26), line(15)])), (2, "\n".join([b := line(25), a])), (3, "\n".join([line(9), b, a]))])
    assert {d: n for d, (n, _) in only.items()} == {1: 0, 2: 0, 3: 2}
