"""Cleaning of short multilingual texts, as column expressions.

Each step is one built-in expression, so a whole chain fuses into a single
projection. Steps run once and in order: what a later removal joins together
is not cleaned again, and only the first step collapses blanks.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelops.functions.contractions import EXPANSIONS, PATTERN

# Patterns of the cleaning steps. They mean the same to Java,
# Python and RE2 regular expressions.
LATIN_BLANKS = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0"
WIDE_BLANKS = r"\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WEB_LINK = f"http[^ {LATIN_BLANKS}{WIDE_BLANKS}]+"
SHORT_LINK = f"bit.ly/[^ {LATIN_BLANKS}{WIDE_BLANKS}]+"
PICTURE_LINK = f"pic.twitter[^ {LATIN_BLANKS}{WIDE_BLANKS}]+"
RETWEET = f"RT[ {LATIN_BLANKS}{WIDE_BLANKS}]@[A-Za-z]+[A-Za-z0-9_-]+"
MENTION = "@[A-Za-z]+[A-Za-z0-9_-]+"
HASHTAG = "#[A-Za-z]+[A-Za-z0-9_-]+"
SYMBOLS = r"[\x{24C2}-\x{10FFFF}]+"
PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]+"""

#: Sets off the forms that were found.
MARK = "\x00"

# Regular endings of words that are not in the dictionary, as
# (pattern, stem group kept, expansion, group kept after it).
ENDINGS = (
    ("([A-Za-z])n['’]t([^A-Za-z]|$)", "1", " not", "2"),
    ("([A-Za-z])['’]re([^A-Za-z]|$)", "1", " are", "2"),
    ("([A-Za-z])['’]ve([^A-Za-z]|$)", "1", " have", "2"),
    ("([A-Za-z])['’]ll([^A-Za-z]|$)", "1", " will", "2"),
    ("([A-Za-z])['’]d([^A-Za-z]|$)", "1", " would", "2"),
    ("([A-Za-z])['’]m([^A-Za-z]|$)", "1", " am", "2"),
)


def _column(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def _drop_literal(text: Column, *literals: str) -> Column:
    return reduce(lambda t, s: F.replace(t, F.lit(s), F.lit("")), literals, text)


def _drop_pattern(text: Column, *patterns: str) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p, ""), patterns, text)


def remove_linebreaks(text: Column | str) -> Column:
    """Written-out ``\\n`` and every run of white space become one blank.

    Three plain patterns instead of one class of all blanks: the first two
    turn other blanks into plain ones and the last collapses runs. Each is a
    cheap test per character (a lookup of single Latin characters, one range
    before the list of wide ones, a literal).
    """
    text = F.replace(_column(text), F.lit("\\n"), F.lit(" "))
    text = F.regexp_replace(text, f"[{LATIN_BLANKS}]+", " ")
    text = F.regexp_replace(text, rf"[\x{{1680}}-\x{{3000}}&&[{WIDE_BLANKS}]]+", " ")
    return F.trim(F.regexp_replace(text, "  +", " "))


def remove_links(text: Column | str) -> Column:
    text = _drop_pattern(_column(text), WEB_LINK, SHORT_LINK)
    return _drop_pattern(_drop_literal(text, "[link]", "[url]"), PICTURE_LINK)


def remove_users(text: Column | str) -> Column:
    return _drop_literal(_drop_pattern(_column(text), RETWEET, MENTION), "[user]")


def remove_hashtags(text: Column | str) -> Column:
    return _drop_pattern(_column(text), HASHTAG)


def remove_media_tags(text: Column | str) -> Column:
    return _drop_literal(_column(text), "VIDEO:", "AUDIO:")


def remove_symbols(text: Column | str) -> Column:
    """Emoji and every other character from U+24C2 upwards."""
    return _drop_pattern(_column(text), SYMBOLS)


def remove_punctuation(text: Column | str) -> Column:
    return _drop_pattern(_column(text), PUNCTUATION)


def expand_contractions(text: Column | str) -> Column:
    """English contractions spelled out, those that lost their apostrophe included.

    One pass marks the longest forms of the dictionary, then regular endings
    are spelled out where an apostrophe is left. Texts are bound to lambda
    variables: the expression they come from may be a long chain, and would
    otherwise run again in every branch.
    """
    # Every lambda uses its own variable only: where an inner one uses that of an outer one,
    # Catalyst fails to extract Python functions of the text.
    found = F.transform(F.array(_column(text)), _forms_and_gaps)
    return F.transform(F.transform(found, _expand_forms), _expand_endings)[0]


def _forms_and_gaps(text: Column) -> Column:
    """The parts of a text, every second one a form of the dictionary.

    The pattern is the dearest step of cleaning, so it runs once: forms are set
    off by a mark, at which the text is cut. A text that holds the mark itself
    is cut by the pattern, in two passes.
    """
    forms, gaps = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), F.split(text, PATTERN, -1)
    pairs = F.zip_with(gaps, forms, lambda gap, form: F.when(form.isNull(), F.array(gap)).otherwise(F.array(gap, form)))
    marked = F.split(F.regexp_replace(text, PATTERN, f"{MARK}$0{MARK}"), MARK, -1)
    return F.when(F.contains(text, F.lit(MARK)), F.flatten(pairs)).otherwise(marked)


def _expand_forms(parts: Column) -> Column:
    entries = F.from_json(F.lit(json.dumps(EXPANSIONS)), "map<string, struct<keep:int, rest:string>>")

    def expanded(form: Column) -> Column:
        entry = F.element_at(entries, F.lower(F.replace(form, F.lit("’"), F.lit("'"))))
        return F.concat(form.substr(F.lit(1), entry["keep"]), entry["rest"])

    return F.array_join(F.transform(parts, lambda part, i: F.when(i % 2 == 1, expanded(part)).otherwise(part)), "")


def _expand_endings(original: Column) -> Column:
    expanded = original
    for pattern, before, words, after in ENDINGS:
        expanded = F.regexp_replace(expanded, "(?i)" + pattern, f"${before}{words}${after}")
    has_apostrophe = F.contains(original, F.lit("'")) | F.contains(original, F.lit("’"))
    return F.when(has_apostrophe, expanded).otherwise(original)


def clean_text(text: Column | str, keep_punctuation: bool = False) -> Column:
    """The full cleaning chain."""
    text = remove_linebreaks(text)
    for step in (remove_links, remove_users, remove_hashtags, remove_media_tags, remove_symbols):
        text = step(text)
    if not keep_punctuation:
        text = remove_punctuation(text)
    return F.lower(expand_contractions(text))


def tokens(text: Column | str) -> Column:
    """Blank-separated tokens of an already collapsed text, without empty ones."""
    return F.array_remove(F.split(_column(text), " "), "")


def word_count(text: Column | str) -> Column:
    return F.size(tokens(text))


def truncate_tokens(text: Column | str, max_tokens: int = 128) -> Column:
    """The first ``max_tokens`` tokens, as fed to a model with a fixed input size."""
    return F.array_join(F.slice(tokens(text), 1, max_tokens), " ")
