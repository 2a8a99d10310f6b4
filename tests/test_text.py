import pytest
from pyspark.sql import functions as F

from utterlake.functions import inventories as inv
from utterlake.functions import text


def on(spark, values, expr):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "t string").select(expr(F.col("t"))).collect()]


def test_segment_chars(spark):
    given = ["tone", "low \t  tone\r\n", " a b　", "", None, "x" * 5000]
    assert on(spark, given, text.segment_chars) == ["t o n e", "l o w t o n e", "a b", "", None, " ".join("x" * 5000)]


def test_segment_tokens_takes_the_longest(spark):
    labels = inv.TONAL_PHONEMES + inv.TONES + ["|"]
    got = on(spark, ["ʈʂʰe˥-bo˩ | mi˧! dʑə˩", "", None], lambda c: text.segment_tokens(c, labels))
    assert got == ["ʈʂʰ e ˥ b o ˩ | m i ˧ dʑ ə ˩", "", None]
    with pytest.raises(ValueError):
        text.alternation([])


def test_orthographic(spark):
    assert on(spark, ["Kunkare DJANG rrey"], text.segment_orthographic) == ["k u n k a r e dj a ng rr ey"]


def test_tonal_types(spark):
    given = ["ə…tsʰo˧˩ | mm…[note]wæ̃˧̩", "x BEGAIEMENT", "", None]
    assert on(spark, given, lambda c: text.segment_tonal(c, "phonemes_and_tones")) == ["əəə… tsʰ o ˧˩ | mmm… w̃æ ˧", "", "", None]
    assert on(spark, given[:1], lambda c: text.segment_tonal(c, "phonemes")) == ["əəə… tsʰ o mmm… w̃æ ˧"]
    assert on(spark, given[:1], lambda c: text.segment_tonal(c, "tones_notgm")) == ["˧˩ ˧"]
    with pytest.raises(Exception, match="not recognized"):
        on(spark, ["o˧[open"], lambda c: text.segment_tonal(c, "phonemes"))
    with pytest.raises(ValueError):
        text.segment_tonal(F.col("t"), "letters")


def test_brackets(spark):
    given = ["a[b[c]d]e", "a]b", "a[b", "", None, "[x]" * 2000]
    assert on(spark, given, text.remove_brackets_content) == ["ae", "a]b", "a", "", None, ""]


@pytest.mark.parametrize("value", ["1", "-2.5", "1e5", ".5", "5.", "1_000", "nan", "Infinity", " 12 ", "1d", "_1", "1__0", "", "e5", "0x10", "1e", "+.5e-3"])
def test_is_number(spark, value):
    try:
        float(value)
        expected = True
    except ValueError:
        expected = False
    assert on(spark, [value], text.is_number) == [expected]


def test_paths(spark):
    row = spark.createDataFrame([("TEXT/crn-A_b.tx.12", "eaf/x/rec.1.eaf")], "p string, q string").select(text.story_of(F.col("p")), text.base_name(F.col("q")), text.stem(F.col("q")), text.latex_escape(F.col("p"))).first()
    assert list(row) == ["crn-A_b", "rec.1.eaf", "rec.1", "TEXT/crn-A\\_b.tx.12"]


def test_translation(spark):
    assert on(spark, ["L'homme, [rire] est  VENU !"], text.normalise_translation) == ["l' homme est venu"]
