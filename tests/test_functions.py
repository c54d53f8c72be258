import pytest
from pyspark.sql import functions as F

from verseloom.functions import scores as S
from verseloom.functions import text as X
from verseloom.functions import timecode as C


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("v")).first()[0]


@pytest.mark.parametrize(
    "fn, text, want",
    [
        (X.phrase_form, "Água, PÃO!  Cristo?", "agua pao cristo"),
        (X.token_form, "Coração,", "coracao"),
        (X.token_form, "Não temas!", "naotemas"),
        (X.ascii_letters, "Coração,", "coracao"),
        (X.bare_word, " (Fim!) ", "fim"),
        (X.archive_value, " a|b \n c ", "a b c"),
        (X.slug, "Canção teste!", "cancao-teste"),
        (X.slug, "!!!", "untitled"),
        (X.safe_filename, "a/b ção.MP4", "a_b_cao.mp4"),
        (X.safe_filename, "", "audio.mp3"),
        (X.caption_text, "<c>alfa</c> <00:00:01.000>beta  x", "alfa beta x"),
        (X.excerpt, "a b c d e f g", "a b c d e f ..."),
        (X.phrase_form, "Straße", "strasse"),
    ],
)
def test_text(spark, fn, text, want):
    assert one(spark, fn("t"), t=text) == want


@pytest.mark.parametrize("text, want", [("(3x)", True), (" (12X) ", True), ("(x)", False), ("a (3x)", False)])
def test_repetition_marker(spark, text, want):
    assert one(spark, X.repetition_marker("t"), t=text) is want


@pytest.mark.parametrize("text, want", [("[Music]", True), ("oh", True), ("Fala", False), ("...", True), ("(riso)", True)])
def test_ignorable(spark, text, want):
    assert one(spark, X.ignorable("t"), t=text) is want


@pytest.mark.parametrize("s, want", [(0.0, "00:00:00"), (65.9, "00:01:05"), (3661.2, "01:01:01"), (360000.0, "100:00:00")])
def test_clock(spark, s, want):
    assert one(spark, C.clock(F.col("s")), s=s) == want


@pytest.mark.parametrize("t, want", [("", 0.0), ("00:01:05", 65.0), ("576000", 3.0), ("10000", 10000.0), ("10001", 10001 / 192000), ("12.5", 12.5)])
def test_parse_clock(spark, t, want):
    assert one(spark, C.parse_clock(F.col("t")), t=t) == pytest.approx(want)


@pytest.mark.parametrize("t, want", [("1:02:03.500", 3723.5), ("02:03,250", 123.25), ("5", 0.0)])
def test_caption_time(spark, t, want):
    assert one(spark, C.parse_caption_time(F.col("t")), t=t) == pytest.approx(want)


def test_caption_overlap(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["b", "c", "d"]), (["a"], ["b"]), (["x", "y"], ["x", "y"])], "p array<string>, c array<string>")
    assert [r[0] for r in df.select(X.caption_overlap(F.col("p"), F.col("c"))).collect()] == [2, 0, 2]


@pytest.mark.parametrize("n, d, want", [(0, 0, 0.0), (1, 0, float("inf")), (1, 2, 0.5)])
def test_safe_ratio(spark, n, d, want):
    assert one(spark, S.safe_ratio(F.col("n"), F.col("d")), n=n, d=d) == want


@pytest.mark.parametrize("m, want", [(1.0, 2), (7.0, 4), (8.0, 4), (20.0, 9), (100.0, 30)])
def test_least_words(spark, m, want):
    assert one(spark, S.least_candidate_words(F.col("m")), m=m) == want


@pytest.mark.parametrize("r, want", [(1.0, 0.0), (0.75, 1.5), (1.35, 2.1), (0.0, 43.0)])
def test_coverage_penalty(spark, r, want):
    assert one(spark, S.coverage_penalty(F.col("r")), r=r) == pytest.approx(want)
