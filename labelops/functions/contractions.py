"""English contractions as a dictionary, and one pattern that finds its longest entries.

The pattern is a trie of the forms written as nested groups: at every place a
text is followed letter by letter, so the number of forms does not matter. A
form counts where neither a letter nor an apostrophe with a letter adjoins it.
"""

from __future__ import annotations

# Contracted forms and what they stand for.
FORMS = {
    "ain't": "are not", "aren't": "are not", "can't": "cannot", "can't've": "cannot have", "could've": "could have",
    "couldn't": "could not", "couldn't've": "could not have", "daren't": "dare not", "didn't": "did not", "doesn't": "does not",
    "don't": "do not", "everybody's": "everybody is", "everyone's": "everyone is", "everything's": "everything is",
    "gonna": "going to", "gotta": "got to", "wanna": "want to", "gimme": "give me", "lemme": "let me", "dunno": "do not know",
    "hadn't": "had not", "hadn't've": "had not have", "hasn't": "has not", "haven't": "have not", "he'd": "he would",
    "he'd've": "he would have", "he'll": "he will", "he'll've": "he will have", "he's": "he is", "here's": "here is",
    "how'd": "how did", "how'll": "how will", "how're": "how are", "how's": "how is", "i'd": "i would", "i'd've": "i would have",
    "i'll": "i will", "i'll've": "i will have", "i'm": "i am", "i've": "i have", "isn't": "is not", "it'd": "it would",
    "it'd've": "it would have", "it'll": "it will", "it's": "it is", "let's": "let us", "ma'am": "madam", "mayn't": "may not",
    "might've": "might have", "mightn't": "might not", "must've": "must have", "mustn't": "must not", "needn't": "need not",
    "nobody's": "nobody is", "o'clock": "of the clock", "oughtn't": "ought not", "shan't": "shall not", "she'd": "she would",
    "she'd've": "she would have", "she'll": "she will", "she's": "she is", "should've": "should have", "shouldn't": "should not",
    "shouldn't've": "should not have", "so've": "so have", "somebody's": "somebody is", "someone's": "someone is",
    "something's": "something is", "that'd": "that would", "that'll": "that will", "that's": "that is", "there'd": "there would",
    "there'll": "there will", "there're": "there are", "there's": "there is", "these're": "these are", "they'd": "they would",
    "they'd've": "they would have", "they'll": "they will", "they're": "they are", "they've": "they have", "this'll": "this will",
    "this's": "this is", "those're": "those are", "to've": "to have", "wasn't": "was not", "we'd": "we would", "we'd've": "we would have",
    "we'll": "we will", "we're": "we are", "we've": "we have", "weren't": "were not", "what'd": "what did", "what'll": "what will",
    "what're": "what are", "what's": "what is", "what've": "what have", "when'd": "when did", "when's": "when is", "where'd": "where did",
    "where'll": "where will", "where're": "where are", "where's": "where is", "where've": "where have", "who'd": "who would",
    "who'd've": "who would have", "who'll": "who will", "who're": "who are", "who's": "who is", "who've": "who have",
    "why'd": "why did", "why're": "why are", "why's": "why is", "will've": "will have", "won't": "will not", "won't've": "will not have",
    "would've": "would have", "wouldn't": "would not", "wouldn't've": "would not have", "y'all": "you all", "y'all're": "you all are",
    "you'd": "you would", "you'd've": "you would have", "you'll": "you will", "you're": "you are", "you've": "you have",
}
# Words of their own without the apostrophe, so only the form with one is a contraction.
ALSO_WORDS = frozenset(
    "cant daren hed hell hes id ill im its lets maam shed shell shes sos thats this thiss tove well were wed whore wont yall so".split()
) - {"cant", "wont", "im", "thats", "hes", "shes", "yall"}


def dictionary() -> dict[str, str]:
    """All forms, those that lost their apostrophe included unless that is a word of its own."""
    entries = dict(FORMS)
    for form, words in FORMS.items():
        bare = form.replace("'", "")
        if bare not in ALSO_WORDS:
            entries.setdefault(bare, words)
    return entries


ENTRIES = dictionary()
APOSTROPHE = "['’]"


def _trie(forms: list[str]) -> dict:
    root: dict = {}
    for form in forms:
        node = root
        for letter in form:
            node = node.setdefault(letter, {})
        node[""] = {}
    return root


def _pattern(node: dict) -> str:
    """The branches of a node, longer forms before the form that ends here."""
    branches = [(APOSTROPHE if letter == "'" else letter) + _pattern(rest) for letter, rest in sorted(node.items()) if letter]
    if not branches:
        return ""
    inner = branches[0] if len(branches) == 1 and "" not in node else "(?:" + "|".join(branches) + ")"
    return inner + "?" if "" in node else inner


#: Java pattern of all entries in either case, at the borders of a word.
PATTERN = (
    rf"(?i)(?<!\p{{L}})(?<!\p{{L}}{APOSTROPHE})" + _pattern(_trie(list(ENTRIES))) + rf"(?!\p{{L}})(?!{APOSTROPHE}\p{{L}})"
)
#: What the pattern treats as one word, for engines without look-around.
WORD = rf"\p{{L}}+(?:{APOSTROPHE}\p{{L}}+)*"


def _kept(form: str, words: str) -> dict[str, object]:
    """How many letters of a form stay as they are written, and what follows them."""
    first = words.split(" ")[0]
    keep = len(first) if words != first and form.startswith(first) else 0
    return {"keep": keep, "rest": words[keep:]}


#: For each entry the letters kept and the words after them.
EXPANSIONS = {form: _kept(form, words) for form, words in ENTRIES.items()}
