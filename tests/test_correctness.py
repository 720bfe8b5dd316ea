"""Known answers on the two-note chord grid: 16 quarters, 4/4, a chord of two notes each.

Every scenario is one performance; all of them are labelled in one run.
"""

import pytest

from ritardo.operators import correctness as K

S = "k string, s_id bigint, pos_uq bigint, dur_uq bigint, pitch bigint, is_grace boolean, is_orn boolean"
P = "k string, p_id bigint, onset_us bigint, pitch bigint"
A = "k string, seq bigint, label string, s_id bigint, p_id bigint"
Q = 1_000_000


def grid(key):
    s, p, a = [], [], []
    for q in range(16):
        for v, iv in enumerate((0, 4)):
            i = 2 * q + v
            s.append([key, i, q * Q, Q, 60 + q % 5 + iv, False, False])
            p.append([key, i, 500_000 * q + 3_000 * iv, 60 + q % 5 + iv])
            a.append([key, i, "match", i, i])
    return s, p, a


def unmatched(delta):
    def edit(key, s, p, a):
        p[10][3] += delta
        a[10] = [key, 10, "deletion", 10, None]
        a.append([key, 99, "insertion", None, 10])

    return edit


def dissolved(key, s, p, a):
    p[4][3] += 7


def grace(key, s, p, a):
    s.append([key, 50, 4 * Q, 0, 72, True, False])
    p.append([key, 60, 1_900_000, 73])
    a.append([key, 200, "insertion", None, 60])


def duplicate(key, s, p, a):
    a.append([key, 77, "match", 8, 9])  # another pitch: dissolved
    a.append([key, 78, "match", 20, 10])  # the same pitch, later in the score


def unknown(key, s, p, a):
    a.append([key, 300, "match", 999, 3])


def far_mate(key, s, p, a):
    p[11][2] += 260_000  # a large alignment error next to the wrong note
    p[10][3] += 1
    p[10][2] += 60_000
    a[10] = [key, 10, "deletion", 10, None]
    a.append([key, 99, "insertion", None, 10])


EDITS = {
    "plain": None, "up": unmatched(1), "down": unmatched(-2), "octave": unmatched(12),
    "far": unmatched(5), "dissolved": dissolved, "grace": grace, "duplicate": duplicate,
    "unknown": unknown, "far_mate": far_mate,
}


def label_all(spark, rule):
    s, p, a = [], [], []
    for key, edit in EDITS.items():
        x = grid(key)
        if edit:
            edit(key, *x)
        s, p, a = s + x[0], p + x[1], a + x[2]
    bars = spark.createDataFrame(
        [(k, b, b * 4 * Q, (b + 1) * 4 * Q) for k in EDITS for b in range(4)],
        "k string, measure_idx bigint, start_uq bigint, end_uq bigint")
    res = K.correctness(spark.createDataFrame(s, S), spark.createDataFrame(p, P),
                        spark.createDataFrame(a, A), ["k"], 4 * Q, window_rule=rule)
    res = K.add_bars(res, bars, ["k"], 4 * Q)
    return {
        "score": {(r["k"], r["s_id"]): r["label"] for r in res.score.collect()},
        "summary": {r["k"]: r for r in K.summary(res.score, res.played, ["k"]).collect()},
        "steps": {r["k"]: r for r in res.steps.collect()},
        "bars": {(r["k"], r["measure_idx"]): r for r in K.bar_table(res, bars, ["k"]).collect()},
    }


@pytest.fixture(scope="module")
def fixed(spark):
    return label_all(spark, "fixed")


def test_all_correct(fixed):
    s = fixed["summary"]["plain"]
    assert (s["accuracy"], s["error_rate"], s["match_ratio"]) == (1.0, 0.0, 1.0)
    for b in range(4):
        r = fixed["bars"][("plain", b)]
        assert r["n_score_notes"] == 8 and r["n_errors"] == 0


@pytest.mark.parametrize("key,label,errors", [
    ("up", "wrong_pitch", 1), ("down", "wrong_pitch", 1), ("octave", "wrong_pitch", 1),
    ("far", "missed", 2)])
def test_unmatched_pair(fixed, key, label, errors):
    assert fixed["score"][(key, 10)] == label
    assert fixed["summary"][key]["n_correct"] == 31
    assert fixed["bars"][(key, 1)]["n_errors"] == errors


def test_dissolved_match_of_another_pitch_is_a_wrong_pitch(fixed):
    s = fixed["summary"]["dissolved"]
    assert s["n_wrong_pitch"] == 1 and s["n_extra"] == 0
    assert fixed["steps"]["dissolved"]["n_pitch_dissolved"] == 1


def test_grace_note_is_no_mistake(fixed):
    s = fixed["summary"]["grace"]
    assert (s["n_ornament_skipped"], s["n_ornament"], s["accuracy"]) == (1, 1, 1.0)


def test_duplicate_match_is_resolved(fixed):
    assert fixed["summary"]["duplicate"]["n_correct"] == 32


def test_unknown_ids_are_counted(fixed):
    assert fixed["steps"]["unknown"]["n_unknown_ids"] == 1
    assert fixed["summary"]["unknown"]["n_correct"] == 32


def test_error_window_widens_the_search(spark, fixed):
    assert fixed["score"][("far_mate", 10)] == "missed"
    assert label_all(spark, "error")["score"][("far_mate", 10)] == "wrong_pitch"


def test_tempo_window_follows_the_local_tempo(spark, fixed):
    got = label_all(spark, "tempo")
    assert got["summary"].keys() == fixed["summary"].keys()
    assert got["summary"]["plain"]["n_correct"] == fixed["summary"]["plain"]["n_correct"]
    # a window is never below the fixed one, so no wrong pitch is lost
    for key, label in fixed["score"].items():
        if label == "wrong_pitch":
            assert got["score"][key] == "wrong_pitch"
