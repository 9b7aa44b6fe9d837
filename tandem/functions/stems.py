"""Word stems by the Porter rules, as column expressions over a table of distinct words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The public Porter rules with their common extensions. A rule is
# (ending, what takes its place); in a list the first ending that fits decides.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning",
    "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
PLURALS = (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", ""))
LONG_ENDINGS = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
MIDDLE_ENDINGS = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
SHORT_ENDINGS = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti",
    "ous", "ive", "ize",
)

_KIND = "_kind"


def _kinds(word: Column) -> Column:
    """One sign per letter: ``v`` for a vowel, ``c`` for a consonant; y is a vowel after a consonant."""

    def next_kind(seen: Column, letter: Column) -> Column:
        vowel = letter.isin(*"aeiou") | ((letter == "y") & seen.endswith("c"))
        return F.concat(seen, F.when(vowel, "v").otherwise("c"))

    return F.aggregate(F.split(word, ""), F.lit("").cast("string"), next_kind)


class _Stem:
    """A column ``word`` with its last ``cut`` letters off, and what the rules ask about it.

    Whether a letter is a vowel depends on the letters before it alone, so a
    stem's kinds are the first of the word's.
    """

    def __init__(self, cut: int = 0):
        size = F.length("_stem") - cut
        self.text = F.left(F.col("_stem"), size)
        self.size = size
        self.kinds = F.left(F.col(_KIND), size)
        self.measure = F.regexp_count(self.kinds, F.lit("vc"))
        self.has_vowel = F.contains(self.kinds, F.lit("v"))
        last = F.right(self.text, F.lit(1))
        self.doubled = self.kinds.endswith("c") & (size > 1) & (last == F.left(F.right(self.text, F.lit(2)), F.lit(1)))
        self.short = (self.kinds.endswith("cvc") & ~last.isin("w", "x", "y")) | (self.kinds == "vc")
        self.last = last


def _first_rule(rules: Sequence[tuple[str, Column, Column]]) -> Column:
    """The word after the first (ending, condition, result) whose ending fits; unchanged if its condition fails."""
    out = F.col("_stem")
    for ending, holds, result in reversed(rules):
        out = F.when(F.col("_stem").endswith(ending), F.when(holds, result).otherwise(F.col("_stem"))).otherwise(out)
    return out


def _replaced(rules: Sequence[tuple[str, str]], least: int) -> list[tuple[str, Column, Column]]:
    return [(e, _Stem(len(e)).measure > least, F.concat(_Stem(len(e)).text, F.lit(to))) for e, to in rules]


def _steps():
    """The rule steps in their order, each the new word."""
    word, always = _Stem(), F.lit(True)
    plurals = [(e, always, F.concat(_Stem(len(e)).text, F.lit(to))) for e, to in PLURALS]
    yield F.when(F.col("_stem").endswith("ies") & (word.size == 4), F.concat(_Stem(3).text, F.lit("ie"))).otherwise(_first_rule(plurals))
    # past forms: a mark stands where an ending was taken off and the rest may be mended
    mark = "\x02"
    ied = F.concat(_Stem(3).text, F.when(word.size == 4, "ie").otherwise("i"))
    yield _first_rule(
        [
            ("ied", always, ied),
            ("eed", _Stem(3).measure > 0, F.concat(_Stem(3).text, F.lit("ee"))),
            ("ed", _Stem(2).has_vowel, F.concat(_Stem(2).text, F.lit(mark))),
            ("ing", _Stem(3).has_vowel, F.concat(_Stem(3).text, F.lit(mark))),
        ]
    )
    bare = _Stem(1)
    mended = (
        F.when(bare.text.endswith("at") | bare.text.endswith("bl") | bare.text.endswith("iz"), F.concat(bare.text, F.lit("e")))
        .when(bare.doubled, F.when(bare.last.isin("l", "s", "z"), bare.text).otherwise(_Stem(2).text))
        .when((bare.measure == 1) & bare.short, F.concat(bare.text, F.lit("e")))
        .otherwise(bare.text)
    )
    yield F.when(F.col("_stem").endswith(mark), mended).otherwise(F.col("_stem"))
    yield _first_rule([("y", (_Stem(1).size > 1) & _Stem(1).kinds.endswith("c"), F.concat(_Stem(1).text, F.lit("i")))])
    # an ending in -alli becomes -al, and is looked at again
    yield F.when(F.col("_stem").endswith("alli") & (_Stem(4).measure > 0), F.concat(_Stem(4).text, F.lit("al"))).otherwise(F.col("_stem"))
    logi = ("logi", _Stem(3).measure > 0, F.concat(_Stem(4).text, F.lit("log")))
    yield _first_rule([*_replaced(LONG_ENDINGS, 0), logi])
    yield _first_rule(_replaced(MIDDLE_ENDINGS, 0))
    ion = _Stem(3)
    yield _first_rule(
        [(e, (_Stem(len(e)).measure > 1) & (ion.last.isin("s", "t") if e == "ion" else always), _Stem(len(e)).text) for e in SHORT_ENDINGS]
    )
    stem = _Stem(1)
    yield _first_rule([("e", (stem.measure > 1) | ((stem.measure == 1) & ~stem.short), stem.text)])
    yield _first_rule([("ll", _Stem(1).measure > 1, _Stem(1).text)])


def stems(words: DataFrame, word: str = "word") -> DataFrame:
    """(word, class): the stem of each distinct lower-case word; words of one or two letters are their own."""
    out = words.select(F.col(word).alias("word")).where(F.col("word").isNotNull()).distinct()
    out = out.withColumn("_stem", F.col("word"))
    for step in _steps():
        out = out.withColumn(_KIND, _kinds(F.col("_stem"))).withColumn("_stem", step)
    irregular = F.create_map(*(F.lit(x) for pair in IRREGULAR.items() for x in pair))
    known = F.try_element_at(irregular, F.col("word"))
    return out.select("word", F.coalesce(known, F.when(F.length("word") <= 2, F.col("word")).otherwise(F.col("_stem"))).alias("class"))
