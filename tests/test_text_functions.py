"""Column functions and Python twins on hand-made edge cases."""

import pytest
from pyspark.sql import functions as F

from cueloom.functions import splitting, timing
from cueloom.functions import text as T


def values(spark, column, *rows, schema="x string"):
    frame = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    return [r[0] for r in frame.select(column(*[F.col(c) for c in frame.columns])).collect()]


def test_times(spark):
    assert values(spark, timing.ts_to_seconds, "01:02:03.045", "00:00:10,5") == [3723.045, 10.5]
    assert values(spark, timing.seconds_to_ts, (3723.0456,), (-1.0,), (0.0005,), (0.0015,), schema="x double") == ["01:02:03.046", "00:00:00.000", "00:00:00.000", "00:00:00.002"]
    assert values(spark, timing.seconds_to_ass, (3723.045,), (59.999,), schema="x double") == ["1:02:03.04", "0:01:00.00"]


def test_cleaning(spark):
    assert values(spark, T.clean_caption_text, "<00:00:01.000><c>a</c>&nbsp; b &amp;lt; <i>c</i>") == ["a b < c"]
    assert values(spark, T.normalize_cue_text, " , umm hello ,, uh , there  ,", "number umbrella éum", "") == ["hello, there", "number umbrella éum", ""]
    assert values(spark, T.drop_fillers, "Ok so, you know, it is okay") == ["so, , it is"]


def test_sentences(spark):
    assert values(spark, T.split_sentences, 'He said "go." Then 3.5 left! Why?', "no end", "…") == [['He said "go."', "Then 3.5 left!", "Why?"], ["no end"], ["…"]]
    pairs = [("and they're", "going home. Now we sit", True), ("It ended.", "so", False), ("the plan is clear", "and then it rained", False), ("the plan is clear", "lucky.", True), ("", "x", True), ("x", "", False), ("go to -", "New York City is far", True), ("we spoke", "at noon", True)]
    assert values(spark, T.mid_sentence_cut, *[(a, b) for a, b, _ in pairs], schema="a string, b string") == [w for *_, w in pairs]
    assert [splitting.mid_sentence_cut(a, b) for a, b, _ in pairs] == [w for *_, w in pairs]


def test_python_twins_agree_with_columns(spark):
    texts = ["um, we , , went", "so I'm", "end.)", "I WANT", "a  b ,", "x uh uhh y", "", "they  ,are, ,", "Tell me why -", "über um die"]
    assert values(spark, T.normalize_cue_text, *texts) == [splitting.normalize(t) for t in texts]
    assert values(spark, T.dangling_end, *texts) == [splitting.dangling_end(t) for t in texts]
    assert values(spark, T.ends_sentence, *texts) == [splitting.ends_sentence(t) for t in texts]


def test_soft_split_keeps_words_and_bounds():
    text = "we walked along the river for a long while because the bridge was closed and the road was wet, " * 6
    pieces = splitting.soft_split(text, 80)
    assert " ".join(pieces).replace(",", "").split() == text.replace(",", "").split() and all(len(p) <= 100 for p in pieces)
    assert splitting.soft_split("", 80) == [] and splitting.soft_split("short", 80) == ["short"]
    words = "word " * 60
    assert all(len(p) <= 60 for p in splitting.force_wrap(words.strip(), 60)) and splitting.force_wrap("", 10) == []
    assert splitting.force_wrap("x" * 30 + " y", 10) == ["x" * 30, "y"]
    assert splitting.force_wrap("they went to the market and " * 3, 30)[0].split()[-1] not in {"to", "the", "and"}


def test_wrapping(spark):
    line = "一二三四五六七八九十一二三四五六七八九十，" * 3
    assert values(spark, T.wrap_caption, line, "short", "a" * 40, "x" * 20 + ", " + "y" * 20) == [
        "\\N".join(["一二三四五六七八九十一二三四五六七八九十，"] * 3), "short", "a" * 32 + "\\N" + "a" * 8, "x" * 20 + ",\\N" + "y" * 20,
    ]


def test_replies(spark):
    body = '```text\n1. "hello, 世界"\n2. a\n2.  b \n9. out\nnot 3. x\n 3. ,嗯，c,\n```'
    rows = values(spark, lambda x: T.parse_numbered(T.strip_fence(x), F.lit(3)), body)[0]
    assert [(r["n"], r["text"]) for r in rows] == [(1, "hello, 世界"), (2, "a"), (2, "b"), (3, ",嗯，c,")]
    assert values(spark, T.clean_reply, ",嗯，c,", "a,  b") == ["c", "a， b"]
    pairs = [("so it is", "Ok, so it is", True), ("SO IT IS", "so it is", True), ("", "x", False), ("译", "x", False), ("um", "um", False)]
    assert values(spark, T.is_untranslated, *[(a, b) for a, b, _ in pairs], schema="a string, b string") == [w for *_, w in pairs]


def test_shortenings(spark):
    assert values(spark, T.shorten_candidates, "然后，我们看一个。", "好") == [["然后，我们看一个。", "然后，看一个", "然后，看", "看", "然后，我们看一个"], ["好"]]


@pytest.mark.parametrize(("dur", "slot", "rate"), [(5.0, 5.0, 0), (5.1, 5.0, 3), (9.0, 5.0, 30), (0.0, 5.0, 0), (5.0, 0.0, 0), (5.001, 5.0, 1)])
def test_fit_rate(spark, dur, slot, rate):
    assert values(spark, timing.fit_rate, (dur, slot), schema="a double, b double") == [rate]


def test_fit_class(spark):
    assert values(spark, timing.fit_class, (5.0, 5.0, True), (5.7, 5.0, False), (5.8, 5.0, True), schema="a double, b double, c boolean") == ["ok", "compressed", "overflow"]
