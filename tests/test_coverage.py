"""The rate limit's sweep against pairs, on busy keys with ties, many confidences and broken rows."""

import math
import random

import pytest

from privatrail.operators.coverage import TOLERANCE, Staircase, covered

WINDOW = 1_000
SCHEMA = "event_id long, user_id long, like string, us long, signs array<string>, conf double, asks boolean, answered_us long"


def usable(r):
    return r[1] is not None and r[4] is not None and r[5] is not None and not math.isnan(r[5])


def brute(rows):
    rows = [r for r in rows if usable(r)]
    seen = [r for r in rows if r[7] is not None]
    return {
        e[0]
        for e in rows
        if e[6]
        and any(
            (o[1], o[2]) == (e[1], e[2]) and o[7] < e[3] and o[3] <= e[3] < o[3] + WINDOW
            and set(e[4]) <= set(o[4]) and e[5] - o[5] < TOLERANCE
            for o in seen
        )
    }


@pytest.mark.parametrize("seed", range(4))
def test_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(900):
        user = rng.choice([1, 1, 1, 2, None]) if rng.random() < 0.9 else 3
        us = rng.randrange(-2_000, 8_000, rng.choice([1, 50]))
        signs = None if rng.random() < 0.02 else ["", *sorted(rng.sample("abcd", rng.randint(0, 3)))]
        conf = rng.choice([rng.random(), 0.3, 0.5, None if rng.random() < 0.1 else 0.7, math.nan if rng.random() < 0.1 else 0.1])
        answered = us + rng.choice([-5, 0, 1, 40, 600, 990, 1_000, 3_000]) if rng.random() < 0.15 else None
        rows.append((i, user, rng.choice("xy"), us, signs, conf, rng.random() < 0.9, answered))
    got = [r.event_id for r in covered(spark.createDataFrame(rows, SCHEMA).repartition(5), WINDOW).collect()]
    want = brute(rows)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_no_rows_and_no_observations(spark):
    assert covered(spark.createDataFrame([], SCHEMA), WINDOW).count() == 0
    rows = [(i, 1, "x", i, [""], 0.0, True, None) for i in range(10)]
    assert covered(spark.createDataFrame(rows, SCHEMA), WINDOW).count() == 0


def test_repeated_ids_come_once(spark):
    rows = [(1, 1, "x", 10, ["", "a"], 0.0, True, 11), (2, 1, "x", 20, [""], 0.0, True, None), (2, 1, "x", 21, [""], 0.0, True, None)]
    assert [r.event_id for r in covered(spark.createDataFrame(rows, SCHEMA), WINDOW).collect()] == [2]


def test_staircase_keeps_what_can_still_win():
    rng = random.Random(5)
    stairs, told = Staircase(), []
    for now in range(600):
        seen, conf = now - rng.randint(0, 30), rng.randint(0, 20) / 20
        stairs.add(seen, conf)
        told.append((seen, conf))
        left = [c for s, c in told if s > now - 40]
        assert stairs.best(now - 40) == (max(left) if left else None)
        assert stairs.seen == sorted(set(stairs.seen)) and stairs.conf == sorted(set(stairs.conf), reverse=True)
