import pytest
from pyspark.sql import functions as F

from engrama.functions import text as T


def values(spark, column, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


@pytest.mark.parametrize(
    ("column", "yes", "no"),
    [
        (T.is_constraint, ["I am vegan", "No sugar please", "I can't eat fish", "never do that", "Allergies: pollen", "I am teetotal"], ["acrophobia", "teetotaler", "no  sugar", "never\tdo", "no sugary drinks", "can’t eat", "", None]),
        (T.is_historical, ["what did I use", "my old phone", "remind me before 5pm", "Previously, yes"], ["last year", "older people", "histories", None]),
        (T.has_cue, ["I moved", "update:foo", "énow", "As of today"], ["Update: I left", "knowing", "snow", "", None]),
    ],
)
def test_classifiers(spark, column, yes, no):
    assert values(spark, column, *yes, *no) == [True] * len(yes) + [False] * len(no)


def test_trim_takes_unicode_blanks(spark):
    assert values(spark, T.trim, "  a b　\n", "   ") == ["a b", ""]


def test_tokens_and_score(spark):
    assert values(spark, T.tokens, "A b, a_1 É!", "", None) == [["a", "b", "a_1"], [], []]
    df = spark.createDataFrame([("cat dog", "concatenate"), ("", "x"), ("a", None)], "q string, t string")
    assert [r[0] for r in df.select(T.keyword_score(T.tokens(F.col("q")), F.col("t"))).collect()] == [0.5, 0.0, 0.0]


def test_snippet(spark):
    assert values(spark, lambda c: T.snippet(c, 5), "a\n b", "abcdef", "abcde") == ["a b", "abcd…", "abcde"]


def test_terms(spark):
    both = lambda t: F.struct(T.contains_all(F.array(F.lit("AB")), t), T.contains_none(F.array(F.lit("x")), t), T.contains_all(F.lit(None).cast("array<string>"), t))
    assert [tuple(v) for v in values(spark, both, "cabX", "ab")] == [(True, False, True), (True, True, True)]
