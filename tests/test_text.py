"""Cleaning against plain Python string code, on adversarial and random texts."""

import re
import string

import pytest
import regex
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from labelops.functions import contractions as C
from labelops.functions import text as T

HARD = [
    "",
    "   ",
    "#OnlyTag",
    "RT @user_1 hello  @a @ab [user]",
    "see http://t.co/x?a=1, bit.ly/abc bitxly/abc [link] [url] pic.twitter.com/q end",
    "VIDEO: one AUDIO: two video: three",
    "😀❤️ 漢字 (ok)! العربية Кириллица ﷺ",
    "a\\nb\nc d\x85e　f\x1cg h",
    "  x  ",
    "#a #ab #a-b_c #1ab",
    "https://a.b/c#d RT @ab",
    "[li[link]nk]",
    "double  blank \t tab",
]


def python_steps(text):
    text = " ".join(text.replace("\\n", "\n").split())
    text = re.sub(r"http\S+", "", text)
    text = re.sub(r"bit.ly/\S+", "", text)
    text = text.replace("[link]", "").replace("[url]", "")
    text = re.sub(r"pic.twitter\S+", "", text)
    text = re.sub(r"RT\s@[A-Za-z]+[\w-]+", "", text, flags=re.ASCII)
    text = re.sub(r"@[A-Za-z]+[\w-]+", "", text, flags=re.ASCII).replace("[user]", "")
    text = re.sub(r"#[A-Za-z]+[\w-]+", "", text, flags=re.ASCII)
    text = text.replace("VIDEO:", "").replace("AUDIO:", "")
    return "".join(c for c in text if ord(c) < 0x24C2)


def python_clean(text):
    return "".join(c for c in python_steps(text) if c not in string.punctuation).lower()


def run(spark, texts, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, text STRING")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_clean_equals_python(spark):
    cleaned = [r[0] for r in run(spark, HARD, T.clean_text("text"))]
    assert cleaned == [python_clean(t) for t in HARD]


def test_keep_punctuation(spark):
    texts = [t for t in HARD if "'" not in t]
    kept = [r[0] for r in run(spark, texts, T.clean_text("text", keep_punctuation=True))]
    assert kept == [python_steps(t).lower() for t in texts]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.text(alphabet="aAzZ09 @#_-.:/[]\\n\tRTVIDEOhtpé☃漢\U0001f600  ", max_size=40),
        min_size=1,
        max_size=40,
    )
)
def test_clean_equals_python_on_random_texts(spark, texts):
    cleaned = [r[0] for r in run(spark, texts, T.clean_text("text"))]
    assert cleaned == [python_clean(t) for t in texts]


def test_sample_sentence(spark):
    text = "\\This is why we're free\n\nThis is why!"
    plain, punctuated = run(spark, [text], T.clean_text("text"), T.clean_text("text", True))[0]
    assert plain == "this is why were free this is why"
    assert punctuated == "\\this is why we are free this is why!"


@pytest.mark.parametrize(
    ("text", "expanded"),
    [
        ("we're, they've; I'm", "we are, they have; I am"),
        ("Can't won't don't", "cannot will not do not"),
        ("it's Peter's", "it is Peter's"),
        ("don’t", "do not"),
        ("can't can't", "cannot cannot"),
        ("o'really", "o'really"),
        ("nothing here", "nothing here"),
        ("Dont, youre; I'd've wouldntve DIDN'T", "Do not, you are; I would have would not have DID not"),
        ("Peter'll x'don't don't'll also've dont_ donté", "Peter will x'do not do not will also have do not_ donté"),
        ("its well were gonna o’clock", "its well were going to of the clock"),
        ("", ""),
    ],
)
def test_contractions(spark, text, expanded):
    assert run(spark, [text], T.expand_contractions("text"))[0][0] == expanded


def test_counts_and_truncation(spark):
    texts = ["", "  a  b ", "a b c"]
    assert run(spark, texts, T.word_count("text")) == [(0,), (2,), (3,)]
    assert run(spark, texts, T.truncate_tokens("text", 2)) == [("",), ("a b",), ("a b",)]


def test_null_text_stays_null(spark):
    assert run(spark, [None], T.clean_text("text"), T.expand_contractions("text")) == [(None, None)]


def test_chain_runs_once_before_a_filter(spark):
    from labelops.operators import reshape

    df = spark.createDataFrame([("1", "#OnlyTag"), ("2", "x")], "id STRING, text STRING")
    kept = reshape.drop_empty_text(reshape.with_clean_text(df))
    assert [r["id"] for r in kept.collect()] == ["2"]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count(T.MENTION) == 2 * plan.count(T.RETWEET) == 2


def test_the_trie_finds_each_form_whole():
    pattern = regex.compile(C.PATTERN)
    assert len(C.FORMS) >= 100
    for form in C.ENTRIES:
        for text in (form, form.upper(), form.replace("'", "’")):
            assert pattern.findall(f"é {text}. {text}x") == [text]
        assert not pattern.search(f"x{form}") and not pattern.search(f"a'{form}") and not pattern.search(f"{form}'s")
