import pytest
from pyspark.sql import functions as F

from ticketloom.functions import text as tx
from ticketloom.operators import hygiene as hy


def run(spark, make, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    rows = df.select("i", make(F.col("t")).alias("o")).orderBy("i").collect()
    return [r["o"] for r in rows]


def clean(product):
    return lambda c: tx.clean_ticket_text(c, F.lit(product))


@pytest.mark.parametrize("raw, want", [
    ("@joséph hi", "[USER_HANDLE] hi"),
    ("caféa@b.com x", "caféa[USER_HANDLE].com x"),
    ("Billing  ZIP code is: 12345.", "billing zip code is: [ZIP]."),
    ("a\tb", "a\tb"),
    ("a  b", "a b"),
    ("a@b.c|m", "[EMAIL]"),
    ("٠١٢٣٤٥٦٧٨٩", "[PHONE]"),
    ("call +1 (555) 123-4567 now", "call [PHONE] now"),
    ("x\r\n\r\ny\n", "x y"),
    ("  x \x1c", "x"),
    ("I have a {product_purchased}, product_purchased} {error_message}", "I have a TV, TV [ERROR_CODE]"),
    (None, ""),
    ("   ", ""),
])
def test_clean_ticket_text(spark, raw, want):
    assert run(spark, clean(" TV "), raw) == [want]


def test_blank_product_becomes_the_word_product(spark):
    for blank in (None, "", "  \t"):
        assert run(spark, clean(blank), "my {product_purchased}") == ["my product"]


def test_cleaning_twice_changes_nothing(spark):
    texts = ["mail a@b.com or @me", "tel 555 123 4567\n\nbilling zip code is: 12345-6789", "  x \t y "]
    once = run(spark, clean("TV"), *texts)
    assert run(spark, clean("TV"), *once) == once


def test_two_step_and_one_pass_whitespace_agree(spark):
    texts = ["a\nb", "a\n\nb", "a \n b", "a\t\nb", "\r\n a\tb \n", "a \nb", "\n"]
    stepwise = lambda c: tx.strip(tx.squeeze(tx.join_lines(c)))
    assert run(spark, stepwise, *texts) == run(spark, tx.normalise_space, *texts)


def test_id_codes_are_opt_in(spark):
    assert run(spark, clean("TV"), "order TPUBASK3E3KQ0") == ["order TPUBASK3E3KQ0"]
    with_ids = lambda c: tx.clean_ticket_text(c, F.lit("TV"), True)
    assert run(spark, with_ids, "order TPUBASK3E3KQ0") == ["order [ID]"]


def test_significant_words_use_ascii_borders(spark):
    assert run(spark, tx.significant_words, "Éternité Reset reset abc1234 the") == [["ternit", "reset"]]


def test_word_count(spark):
    assert run(spark, tx.word_count, " a  b c\n", "") == [3, 0]


def parse(spark, *raw):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(raw)], "i int, r string")
    rows = df.select("i", hy.parse_classification(F.col("r")).alias("c")).orderBy("i").collect()
    return [r["c"].asDict() for r in rows]


def test_parse_classification_rules(spark):
    out = parse(
        spark,
        '{"intent": " Billing ", "confidence": 1.7, "sentiment": "NEGATIVE", "urgency": "High", "is_high_risk": "false"}',
        '{"confidence": null}',
        '{"intent": null}',
        "not json", None, "[1]",
        '{"confidence": "0.4", "is_high_risk": 0}',
        '{"confidence": "abc"}',
        '{"is_high_risk": ""}',
        '{"is_high_risk": [1]}',
    )
    assert out[0]["intent"] == "billing" and out[0]["confidence"] == 1.0
    assert out[0]["is_high_risk"] is True and out[0]["urgency"] == "high" and out[0]["sentiment"] == "negative"
    for bad in (1, 3, 4, 5, 7):
        assert out[bad]["intent"] == "other" and out[bad]["confidence"] == 0.5
        assert out[bad]["urgency"] == "high" and out[bad]["is_high_risk"] is True
    assert out[2]["intent"] == "none" and out[2]["confidence"] == 0.8 and out[2]["is_high_risk"] is False
    assert out[6]["confidence"] == 0.4 and out[6]["is_high_risk"] is False
    assert out[8]["is_high_risk"] is False and out[9]["is_high_risk"] is True
