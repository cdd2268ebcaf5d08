"""Cleaning steps over all documents, whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelops.functions import contractions as C
from labelops.functions import text as T
from labelops.operators import reshape
from labelops.plans.inputs import Inputs, sql_text
from labelops.plans.registry import query


def _drop(expr: str, pattern: str, put: str = "") -> str:
    return f"regexp_replace({expr}, {sql_text(pattern)}, {sql_text(put)}, 'g')"


def _cut(expr: str, literal: str) -> str:
    return f"replace({expr}, {sql_text(literal)}, '')"


def sql_linebreaks(e: str) -> str:
    unescaped = f"replace({e}, {sql_text(chr(92) + 'n')}, ' ')"
    return f"trim({_drop(unescaped, f'[ {T.LATIN_BLANKS}{T.WIDE_BLANKS}]+', ' ')}, ' ')"


def sql_links(e: str) -> str:
    e = _drop(_drop(e, T.WEB_LINK), T.SHORT_LINK)
    return _drop(_cut(_cut(e, "[link]"), "[url]"), T.PICTURE_LINK)


def sql_users(e: str) -> str:
    return _cut(_drop(_drop(e, T.RETWEET), T.MENTION), "[user]")


def sql_hashtags(e: str) -> str:
    return _drop(e, T.HASHTAG)


def sql_media(e: str) -> str:
    return _cut(_cut(e, "VIDEO:"), "AUDIO:")


def sql_symbols(e: str) -> str:
    return _drop(e, T.SYMBOLS)


def sql_punctuation(e: str) -> str:
    return _drop(e, r"[!-/:-@\[-`{-~]")


def sql_contractions(e: str) -> str:
    """The dictionary word by word, then the regular endings."""
    entries = ", ".join(f"{sql_text(form)}: {{'keep': {x['keep']}, 'rest': {sql_text(x['rest'])}}}" for form, x in C.EXPANSIONS.items())
    words = f"regexp_extract_all({e}, {sql_text(C.WORD + '|[^' + chr(92) + 'p{L}]+')})"
    entry = f"MAP {{{entries}}}[lower(replace(w, '’', {sql_text(chr(39))}))]"
    e = f"array_to_string(list_transform({words}, lambda w: coalesce(substr(w, 1, ({entry}).keep) || ({entry}).rest, w)), '')"
    for pattern, before, words, after in T.ENDINGS:
        e = _drop(e, "(?i)" + pattern, f"\\{before}{words}\\{after}")
    return e


def _steps(keep_punctuation: bool) -> list[Callable[[str], str]]:
    steps = [sql_linebreaks, sql_links, sql_users, sql_hashtags, sql_media, sql_symbols]
    steps += [] if keep_punctuation else [sql_punctuation]
    return [*steps, sql_contractions, lambda e: f"lower({e})"]


def clean_ctes(source: str = "noisy", name: str = "clean", keep_punctuation: bool = False) -> str:
    """The chain as one table per step: SQL text stays short."""
    parts, previous = [], source
    steps = _steps(keep_punctuation)
    for i, step in enumerate(steps):
        last = i == len(steps) - 1
        this, column = (name, "processed_text") if last else (f"{name}_{i}", "text")
        extra = "raw" if i else "text AS raw"
        parts.append(f"{this} AS (SELECT * EXCLUDE (text{', raw' if i else ''}), {extra}, {step('text')} AS {column} FROM {previous})")
        previous = this
    return ",\n".join(parts)


def _step_query(name: str, step: Callable[[Column], Column], sql: Callable[[str], str]) -> None:
    @query(name, f"SELECT id, {sql(sql_linebreaks('text'))} AS text FROM noisy")
    def build(t: Inputs) -> DataFrame:
        return t.noisy.select("id", step(T.remove_linebreaks("text")).alias("text"))


_step_query("f1_collapse_linebreaks", lambda c: c, lambda e: e)
_step_query("f2_remove_links", T.remove_links, sql_links)
_step_query("f3_remove_users", T.remove_users, sql_users)
_step_query("f4_remove_hashtags", T.remove_hashtags, sql_hashtags)
_step_query("f5_remove_media_tags", T.remove_media_tags, sql_media)
_step_query("f6_remove_symbols", T.remove_symbols, sql_symbols)
_step_query("f7_remove_punctuation", T.remove_punctuation, sql_punctuation)
_step_query("f8_expand_contractions", T.expand_contractions, sql_contractions)
_step_query("f9_lower_case", F.lower, lambda e: f"lower({e})")


@query("f10_clean_text", "SELECT id, processed_text FROM clean", clean_ctes())
def clean(t: Inputs) -> DataFrame:
    return t.noisy.select("id", T.clean_text("text").alias("processed_text"))


@query(
    "f11_clean_text_keep_punctuation",
    "SELECT id, processed_text FROM clean",
    clean_ctes(keep_punctuation=True),
)
def clean_keep_punctuation(t: Inputs) -> DataFrame:
    return t.noisy.select("id", T.clean_text("text", keep_punctuation=True).alias("processed_text"))


@query(
    "f12_word_count",
    f"SELECT id, CAST(len(list_filter(string_split({sql_linebreaks('text')}, ' '), lambda w: w <> '')) AS INTEGER) AS word_count FROM noisy",
)
def word_count(t: Inputs) -> DataFrame:
    return t.noisy.select("id", T.word_count(T.remove_linebreaks("text")).alias("word_count"))


@query(
    "f13_truncate_tokens",
    "SELECT id, array_to_string(list_filter(string_split(processed_text, ' '), lambda w: w <> '')[1:128], ' ') AS text FROM clean",
    clean_ctes(),
)
def truncate(t: Inputs) -> DataFrame:
    return t.noisy.select("id", T.truncate_tokens(T.clean_text("text"), 128).alias("text"))


@query(
    "p9_drop_empty_text",
    "SELECT id, processed_text FROM clean WHERE processed_text <> ''",
    clean_ctes(source="noisy_and_made"),
)
def drop_empty(t: Inputs) -> DataFrame:
    return reshape.drop_empty_text(reshape.with_clean_text(t.noisy_and_made)).select("id", "processed_text")
