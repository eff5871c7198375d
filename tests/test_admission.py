"""WIN-5: piecewise translations against a plain fold."""

import datetime as dt
import random

import numpy as np
import pytest

from sheaf.operators import translations as T
from sheaf.operators import usage as U


def fold(pages, used, limit):
    out = []
    for p in pages:
        out.append((used, used + p <= limit))
        used += p if used + p <= limit else 0
    return out, used


def table(f, limit):
    return [T.value(f, u) for u in range(limit + 1)]


@pytest.mark.parametrize("limit", [0, 1, 7, 40, 333])
def test_maps_equal_the_fold_at_every_start(limit):
    rnd = random.Random(limit)
    for n in [0, 1, 2, 3, 5, 33, 100]:
        pages = np.array([rnd.choice([0, 1, 3, limit, limit + 1, rnd.randrange(limit + 5)]) for _ in range(n)], np.int64)
        want = [fold(pages.tolist(), u, limit)[1] for u in range(limit + 1)]
        f = T.of_files(pages, limit)
        assert table(f, limit) == want
        assert f[0][0] == 0 and (np.diff(f[0]) > 0).all() and len(f[0]) <= limit + 1
        cut = sorted(rnd.randrange(n + 1) for _ in range(3))
        parts = [T.of_files(x, limit) for x in np.split(pages, cut)]
        assert table(T.compose(parts, limit), limit) == want


def test_intervals_follow_the_files_and_not_the_limit():
    rnd = random.Random(3)
    pages = np.array([rnd.randrange(1, 60) for _ in range(5000)], np.int64)
    for limit in (10 ** 9, 10 ** 15):  # the last one needs several lines of maps
        f = T.of_files(pages, limit)
        assert len(f[0]) <= 4 * len(pages)
        for u in (0, 17, limit - 150_000, limit - 3000, limit - 1, limit):
            assert T.value(f, u) == fold(pages.tolist(), u, limit)[1]


def test_replay_equals_the_fold():
    rnd = random.Random(5)
    for limit in (0, 9, 100, 10 ** 6):
        pages = [rnd.choice([0, 1, 5, rnd.randrange(limit + 3)]) for _ in range(300)]
        before, admitted, used = T.replay(np.array(pages, np.int64), limit // 3, limit)
        want, end = fold(pages, limit // 3, limit)
        assert list(zip(before.tolist(), admitted.tolist())) == want and used == end


@pytest.mark.parametrize("limit", [600, 10 ** 9])
def test_admission_over_a_tree_of_chunks(spark, limit):
    rnd = random.Random(11)
    rows = [(i, None if i % 50 == 49 else dt.datetime(2024, 1 + (i % 10 == 0), 1) + dt.timedelta(minutes=rnd.randrange(40000)),
             None if i % 31 == 0 else rnd.randrange(0, 40 if limit < 1000 else 10 ** 7)) for i in range(1200)]
    usage = spark.createDataFrame(rows, "file_id long, ts timestamp, pages long")
    got = {r.file_id: (r.used_before, r.status != "QUOTA_EXCEEDED") for r in U.admit(usage, limit=limit, chunks=23, fan=3).collect()}
    want = {}
    for month in {t and t.month for _, t, _ in rows}:
        own = sorted((r for r in rows if (r[1] and r[1].month) == month), key=lambda r: (r[1] or dt.datetime.min, r[0]))
        want |= dict(zip([r[0] for r in own], fold([r[2] or 0 for r in own], 0, limit)[0]))
    assert got == want
    assert {ok for _, ok in got.values()} == {True, False}


def test_admission_of_no_files(spark):
    assert U.admit(spark.createDataFrame([], "file_id long, ts timestamp, pages long")).collect() == []
