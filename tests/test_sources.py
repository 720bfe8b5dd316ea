import json

import pytest
from pyspark.sql import functions as F

from ritardo.functions import keys as K
from ritardo.functions.stats import geometric_mean
from ritardo.sources import catalog as C
from ritardo.sources import readers as R


def test_four_label_fact_rows(spark):
    s = spark.createDataFrame([("x", f"n{i}", 60 + 2 * i, b) for i, b in enumerate((1, 1, 2))],
                              "performance_id string, s_id string, pitch int, measure int")
    p = spark.createDataFrame([("x", "p0", 50, 60), ("x", "p1", 60, 62), ("x", "p2", 30, 70)],
                              "performance_id string, p_id string, velocity int, pitch int")
    a = spark.createDataFrame(
        [("x", 0, "match", "n0", "p0"), ("x", 1, "interpolated", "n1", "p1"),
         ("x", 2, "deletion", "n2", None), ("x", 3, "insertion", None, "p2")],
        "performance_id string, seq int, label string, s_id string, p_id string")
    rows = C.aligned_notes(a, s, p, ["performance_id"]).orderBy("seq").collect()
    assert [r["s_measure"] for r in rows] == [1, 1, 2, None]
    assert [r["p_velocity"] for r in rows] == [50, 60, None, 30]


def test_bad_rows_leave_the_manifest(spark):
    pieces = spark.createDataFrame([("A", 1), ("B", 2)], "piece_id string, n_performances bigint")
    perf = spark.createDataFrame([("bad", "A"), ("g1", "B"), ("g2", "B")],
                                 "performance_id string, piece_id string")
    bad = spark.createDataFrame([("bad",)], "performance_id string")
    got = [tuple(r) for r in C.load_pieces(pieces, perf, bad).collect()]
    assert got == [("B", 2)]


def test_fact_table_round_trip(spark, tmp_path):
    f = spark.createDataFrame(
        [("A", "p1", "match", 1), ("A", "p2", "deletion", 2), ("B", "p3", "match", 3)],
        "piece_id string, performance_id string, label string, s_pos int")
    path = str(tmp_path / "facts")
    C.write_aligned_notes(f, path, ["s_pos"])
    got = C.load_piece_notes(spark, path, "A", columns=["s_pos"], labels=["match"])
    assert [r["s_pos"] for r in got.collect()] == [1]
    bad = spark.createDataFrame([("p1",)], "performance_id string")
    assert C.load_piece_notes(spark, path, "A", labels=["match"], bad=bad).count() == 0
    with pytest.raises(KeyError):
        C.load_piece_notes(spark, path, "C")


def test_alignment_tsv(spark, tmp_path):
    f = tmp_path / "a.tsv"
    f.write_text("xml_id\tmidi_id\ttrack\tchannel\tpitch\tonset\n"
                 "n1\tm1\t0\t0\t60\t0.0\nn2\tdeletion\t\t\t\t\ninsertion\tm2\t0\t0\t61\t1.0\n")
    got = [tuple(r) for r in R.read_alignment_tsv(spark, str(f)).collect()]
    assert got == [("match", "n1", "m1"), ("deletion", "n2", None), ("insertion", None, "m2")]


def test_ratings_from_wide(spark):
    w = spark.createDataFrame([("a", 1, 5.0, None), ("a", 1, 5.0, None), ("b", 2, 7.2, 3.0),
                               ("c", 3, 0.0, 4.0)], "u string, d int, q1 double, q2 double")
    got = sorted(tuple(r) for r in R.ratings_from_wide(w, ["u", "d"], ["q1", "q2"], 7.1).collect())
    assert got == [("a", 1, "q1", 5.0), ("c", 3, "q2", 4.0)]


def test_json_readers(spark, tmp_path):
    f = tmp_path / "m.json"
    f.write_text(json.dumps({"s1": [1.0, 2.0], "s2": [3.0, 4.0]}))
    got = sorted(tuple(r) for r in R.vectors_by_id(spark, str(f), ["a", "b"]).collect())
    assert got == [("s1", 1.0, 2.0), ("s2", 3.0, 4.0)]
    assert R.nested_index(spark, str(f)).count() == 2


def test_names_and_fractions(spark):
    df = spark.createDataFrame(
        [("pid0917a-01.mp3", "Schubert_D783_8bars_3_02.mid", "3/8", "12+3/4 7.25")],
        "rec string, seg string, fr string, line string")
    r = df.select(R.performer_number(F.col("rec")).alias("p"), R.parse_segment_name(
        F.col("seg")).alias("s"), R.fraction(F.col("fr")).alias("f")).first()
    assert r["p"] == 917 and r["f"] == 0.375
    assert tuple(r["s"]) == ("Schubert_D783", 8, 3, 2)
    b = R.beat_alignment(df.select("line"), "line").first()
    assert tuple(b) == (12, 0.75, 7.25)


@pytest.mark.parametrize("composer,composition,movement,want", [
    ("Dvořák,_Antonín", "Humoresques,_Op.101", "7._Poco_lento", "dvorak_op101_no7"),
    ("Beethoven,_Ludwig_van", "Piano_Sonata_No.14,_Op.27_No.2", "1._Adagio",
     "beethoven_op27_no2_mv1"),
    ("Bach,_Johann", "Well-Tempered", "Prelude_and_Fugue,_BWV_846_Fugue", "bach_bwv846_fugue"),
    ("Haydn,_Joseph", "Sonata,_Hob.XVI:52", "", "haydn_hobxvi52"),
    ("Chopin", "Waltz", "", "d:Chopin/Waltz"),
])
def test_catalogue_piece_id(spark, composer, composition, movement, want):
    df = spark.createDataFrame([(composer, composition, movement)], "a string, b string, c string")
    assert K.with_catalogue_piece_id(df, "d", "a", "b", "c").first()["piece_id"] == want


def test_small_expressions(spark):
    r = spark.range(1).select(
        K.pitch_name(F.lit(61)).alias("n"), K.fold_accents(F.lit("Für Ďvořák ß")).alias("f"),
        K.composer_surname(F.lit("Frédéric_Chopin")).alias("s"),
        K.metrical_strength(F.lit(3_000_000), F.lit(6), F.lit(8)).alias("m"),
        K.clean_text(F.lit("<i>Tempo I</i> &amp; una chorda")).alias("t"),
        K.quick_decision(F.lit(None).cast("double"), F.lit(False), F.lit(True), F.lit(9), stop=0.3,
                         partial_stop=0.5, min_notes=40).alias("d"),
        K.ramp(F.lit(3), F.lit(2), F.lit(4)).alias("r")).first()
    assert tuple(r) == ("C#4", "Fur Dvorak ", "chopin", 0.5, "Tempo primo & una corda", "stop", 0.5)


def test_entities_end_in_a_semicolon(spark):
    df = spark.createDataFrame([("a &amp; b",), ("a &amp",), ("x &ampfoo; &#65; &AMP",), ("&amp;lt;",)], "t string")
    got = [r[0] for r in df.select(K.clean_text(F.col("t"))).collect()]
    assert got == ["a & b", "a &amp", "x &ampfoo; A &AMP", "&lt;"]


def test_geometric_mean_with_a_zero(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 8.0), (2, 0.0), (2, 5.0), (3, None)], "k int, v double")
    got = {r.k: r.g for r in df.groupBy("k").agg(geometric_mean(F.col("v")).alias("g")).collect()}
    assert got[1] == pytest.approx(4.0) and got[2] == 0.0 and got[3] is None


def test_listing_of_files(spark, tmp_path):
    for name in ("train/Anna_Op1.mid", "test/Ben_Op2.mid", "readme.txt"):
        f = tmp_path / name
        f.parent.mkdir(exist_ok=True)
        f.write_text("x")
    from ritardo.sources import catalog as C

    files = C.file_listing(spark, str(tmp_path), "*.mid")
    d = C.listing_index(files, "path", r"(train|test)/(\w+)_(Op\d+)\.mid$", ["split", "player", "opus"],
                        ["player", "opus"])
    assert {(r.item_id, r.split) for r in d.collect()} == {("anna_op1", "train"), ("ben_op2", "test")}
