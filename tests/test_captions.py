import re

import pytest
from pyspark.sql import functions as F

from sievecraft.functions import captions as cap
from sievecraft.operators import descriptors, validation
from sievecraft.plans.profiles import ProfileRegistry

KREA, ANIMA = ProfileRegistry().recipe("Krea 2", "character", "tok_x"), ProfileRegistry().recipe("anima", "concept", "tok_x")


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "caption string").select(f(F.col("caption")).alias("v")).first().v


@pytest.mark.parametrize("raw,want", [
    ("<think>a\nb</think>A cat.", "A cat."), ("<THINKING x=1>a</thinking> A cat.", "A cat."), ("Thought process: hm\nmore\n\nA cat.", "A cat."), ("notes\n**Caption:**\nfirst\nFinal answer\nA cat.", "A cat."),
    ("```A cat.```", "A cat."), ('"A cat."', "A cat."), ("“A cat.”", "A cat."), ("'A cat.'", "A cat."), ("notes\ncaption:\n", "notes\ncaption:"), (None, ""), ('"', '"'),
])
def test_strip_reasoning(spark, raw, want):
    assert one(spark, raw, cap.strip_reasoning) == want


def error(spark, text, profile=KREA):
    return validation.caption_verdict(spark.createDataFrame([(text,)], "caption string"), profile).first()


@pytest.mark.parametrize("text,code", [
    ("", "empty"), ("- a\n- b", "list"), ("1. a", "list"), ("Here is a cat", "meta_commentary"), ("The image shows a cat", "meta_commentary"), ("A cat. Negative prompt: dog", "negative_prompt"), ("word " * 500, "too_long"),
    ("A cat with no hat", "absence_language"), ("She isn't here", "absence_language"), ("A sky clear of clouds", "absence_language"), ("the tail is missing", "absence_language"), ("A room without windows", "absence_language"), ("Nobody sits there", "absence_language"),
    ("A training picture", "meta_language"), ("kept separate", "meta_language"), ("an incidental detail", "meta_language"), ("w " * 111, "too_many_words"), ("w " * 110, None), ("A knot and another note d", "meta_language"),
    ('She says "no, I am not" and smiles', None), ("She says “never” and smiles", None), ('"yes" but not so', "absence_language"), ("A größe ñno cat", None), ("tok_x, a red cat", None),
])
def test_policy_codes(spark, text, code):
    row = error(spark, text)
    assert row.caption_error == code and (row.normalized is None) == (code is not None)


@pytest.mark.parametrize("text,code", [("prose alone", "not_tags"), ("a, " + "b" * 101, "prose_length_tag"), ("a, @artist", "artist_tag"), ("a, no_hat", "absence_language"), ("1girl, red hat", None), ("tok_x, a", None)])
def test_tag_codes(spark, text, code):
    assert error(spark, text, ANIMA).caption_error == code


def test_triggers(spark):
    slot = lambda t: one(spark, t, lambda c: cap.apply_trigger(c, "tok", "anima_subject_slot"))
    assert slot("best quality, year 2024, 1girl, smile") == "best quality, year 2024, 1girl, tok, smile"
    assert slot("smile, 1girl") == "tok, smile, 1girl" and slot("smile, TOK") == "smile, TOK"
    pre = lambda t, b="prefix": one(spark, t, lambda c: cap.apply_trigger(c, "tok", b))
    assert (pre("a cat"), pre("a TOK cat"), pre("a cat", "other"), pre(pre("a cat"))) == ("tok, a cat", "a TOK cat", "tok a cat", "tok, a cat")
    video = lambda t: one(spark, t, lambda c: cap.apply_video_trigger(c, "t.k"))
    assert (video("a cat, t.k"), video("T.K, a cat"), video("t.k"), video("tok cat")) == ("t.k, a cat", "t.k, a cat", "t.k", "t.k, tok cat")


def test_words_of_any_script(spark):
    text = "größe naïve it's -- 5$ x_y -a- 日本 don't"
    assert one(spark, text, cap.caption_words) == len(re.findall(r"\b[\w$'-]+\b", text))
    assert one(spark, text, cap.whitespace_words) == len(text.split())


def test_video_rules(spark):
    assert one(spark, "It Appears to move", cap.video_error) == "appears_to"
    assert one(spark, "a 4K view", cap.video_error) == "4k" and one(spark, "a professionally made 14k ring", cap.video_error) is None


def test_message_text(spark):
    kind = "c string, p array<string>, r string, s string"
    rows = [(" a ", None, "b", "c"), (None, ["x", "y "], "b", "c"), ("", None, None, "c "), (None, None, None, None)]
    got = [r.v for r in spark.createDataFrame(rows, kind).select(cap.message_text(F.col("c"), F.coalesce("p", F.array().cast("array<string>")), F.col("r"), F.col("s")).alias("v")).collect()]
    assert got == ["a", "xy", "c", ""]


def test_recurring_descriptors(spark):
    rows = ["subject_token with long black hair in a park", "long black hair, subject_token, at night", "A Long Black Hair look", "someone, long black hair and 12 34 things", ""]
    docs = spark.createDataFrame([(r,) for r in rows], "caption string")
    got = descriptors.recurring_descriptors(docs, "subject_token").collect()
    assert [(r["rank"], r.phrase, r.n, r.fraction) for r in got] == [(1, "long black hair", 4, 1.0)]
    got = descriptors.caption_recurrence(docs, "subject_token")
    assert got["caption_count"] == 4 and got["minimum_count"] == 3 and got["recurring_descriptors"] == [{"text": "long black hair", "count": 4, "fraction": 1.0}]
    assert descriptors.recurring_descriptors(docs.limit(0)).count() == 0
