"""Windows over whole frames against plain Python, over many blocks."""

from __future__ import annotations

import random

import pytest

from granary.operators import ordered
from granary.operators import profile as P
from granary.stats import density

N = 97


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    return [(k, None if rng.random() < 0.15 else rng.randint(0, 20)) for k in rng.sample(range(1000), N)]


@pytest.fixture
def frame(spark, rows, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", 10)
    return spark.createDataFrame(rows, "k int, x int")


def by_order(df, name):
    return [r[name] for r in df.orderBy("k").collect()]


@pytest.mark.parametrize("n", [1, 3, 13, -1, -4, 200])
def test_shift_and_diff(frame, rows, n):
    xs = [x for _, x in sorted(rows)]
    back = [xs[i - n] if 0 <= i - n < N else None for i in range(N)]
    assert by_order(ordered.shift(frame, "y", "x", n, order_by=["k"]), "y") == back
    assert by_order(ordered.diff(frame, "y", "x", n, order_by=["k"]), "y") == [None if a is None or b is None else float(a - b) for a, b in zip(xs, back, strict=True)]


@pytest.mark.parametrize("n", [1, 2, 25])
def test_rolling_mean_and_cum_sum(frame, rows, n):
    xs = [x for _, x in sorted(rows)]
    means = []
    for i in range(N):
        near = [x for x in xs[max(0, i + 1 - n) : i + 1] if x is not None]
        means.append(sum(near) / len(near) if i >= n - 1 and near else None)
    assert by_order(ordered.rolling_mean(frame, "y", "x", n, order_by=["k"]), "y") == pytest.approx(means)
    total, sums = 0, []
    for x in xs:
        total += x or 0
        sums.append(None if x is None else total)
    assert by_order(ordered.cum_sum(frame, "y", "x", order_by=["k"]), "y") == sums
    with pytest.raises(ValueError):
        ordered.rolling_mean(frame, "y", "x", 0, order_by=["k"])


def test_rank_and_replaced_names(frame, rows):
    xs = [x for _, x in sorted(rows)]
    known = sorted(x for x in xs if x is not None)
    ranks = [None if x is None else known.index(x) + 1 + (known.count(x) - 1) / 2 for x in xs]
    out = ordered.rank(frame, "x", "x")
    assert out.columns == ["k", "x"] and by_order(out, "x") == ranks
    assert ordered.cum_sum(frame.limit(0), "y", "x", order_by=["k"]).collect() == []


def test_rows_never_meet_in_one_task(frame):
    """Only block totals and partition sizes do."""
    for out in (ordered.shift(frame, "y", "x", order_by=["k"]), ordered.rolling_mean(frame, "y", "x", 3, order_by=["k"]), P.describe(frame), P.box_stats(frame, "x", ["k"]), density.bandwidths(frame, "x")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile(" not in plan
        for line in plan.splitlines():
            assert not ("Window" in line and "block_" not in line and "n_" not in line and "c_" not in line), line
