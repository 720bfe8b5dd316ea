import numpy as np
import pytest

from ritardo.operators import consensus as C
from ritardo.operators import music as M


def test_notes_of_a_bar_range(spark):
    rows = [("p", 1, 0, 500_000, 0), ("p", 2, 1_000_000, 900_000, 1), ("p", 3, 990_000, 100_000, None),
            ("p", 4, 960_000, 100_000, None), ("p", 5, 1_500_000, 9_000_000, 1),
            ("p", 6, 2_500_000, 100_000, 2), ("p", 7, 2_499_950, 100_000, None),
            ("p", 8, 700_000, 100_000, 1), ("q", 9, 5_000_000, 1_000, 1), ("q", 10, 5_000_500, 10, None),
            ("r", 11, 100, 100, 5)]
    n = spark.createDataFrame(rows, "k string, id long, onset_us long, duration_us long, measure_idx long")
    span = spark.createDataFrame([("p", 1_000_000, 2_500_000.0), ("q", 5_000_000, None)],
                                 "k string, start_us long, end_us double")
    got = {r.id: (r.new_onset_us, r.new_duration_us) for r in M.bar_window_notes(
        n, span, ["k"], 1, 1, release_us=250_000, lead_us=1_000).collect()}
    # note 8 is matched to the bar though it comes early; 4, 6 and 7 lie outside
    assert got == {8: (1_000, 100_000.0), 3: (291_000, 100_000.0), 2: (301_000, 900_000.0),
                   5: (801_000, 1_250_000.0), 9: (1_000, 20_000.0), 10: (1_500, 20_000.0)}


@pytest.mark.parametrize("width", [4096, 3])
def test_curves_are_filled_by_place(spark, width):
    curves = {"a": [None, 1.0, None, None, 4.0, None], "b": [2.0] * 6, "c": [None] * 6,
              "d": [None, None, None, None, None, 7.0]}
    at = [0, 2, 3, 10, 11, 40]  # places count, not distances
    df = spark.createDataFrame([("x", k, p, v) for k, vs in curves.items() for p, v in zip(
        at, vs, strict=True)], "piece string, perf string, pos long, v double")
    got = {}
    for r in sorted(C.filled_curves(df, "piece", "perf", "pos", "v", width).collect(), key=lambda r: r.pos):
        got.setdefault(r.perf, []).append((r.filled, r.filled_centred))
    assert set(got) == {"a", "b", "d"}
    for k, rows in got.items():
        v = np.array([np.nan if x is None else x for x in curves[k]])
        i, ok = np.arange(6), ~np.isnan(v)
        want = np.interp(i, i[ok], v[ok])
        assert [f for f, _ in rows] == pytest.approx(want.tolist())
        assert [c for _, c in rows] == pytest.approx((want - want.mean()).tolist())
