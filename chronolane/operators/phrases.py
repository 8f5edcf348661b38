"""Folding, stemming, and phrases of any length in texts, by a positional join on first stems."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The suffixes of the light stemmer. A stem keeps five characters at least.
SUFFIXES = ["ational", "ations", "ation", "ities", "ity", "ically", "ical", "ics", "ic", "ising", "izing", "ised", "ized", "ise", "ize", "ing", "ies", "ers", "er", "ants", "ant", "ance", "ancy", "ents", "ent", "ed", "es", "s", "al", "ive", "ous", "ary"]
STEM_ROUNDS = 4
# Words too general to show that a text is about something.
GENERAL = ["stage", "acute", "severe", "chronic", "type", "failure", "shock", "disease", "syndrome", "with", "and", "the", "patient", "management"]
#: Phrases that are sent to every task, at most; more of them are joined by a shuffle.
BROADCAST_PHRASES = 50_000
#: First words of phrases that every place is compared with before it becomes a row, at most.
FIRST_WORDS = 1_000


@cache
def _accents() -> tuple[str, str]:
    """Letters whose compatibility form is one ASCII character and marks, and those characters; the marks come last and so go."""
    letters = [c for c in map(chr, range(0xC0, 0x2000)) if len(b := "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))) == 1 and b.isascii() and b != c]
    plain = [next(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)) for c in letters]
    marks = [c for c in map(chr, range(0x300, 0x370)) if unicodedata.combining(c)]
    return "".join(letters + marks), "".join(plain)


def fold(text: str | Column) -> Column:
    """Lower case without accents; null counts as empty."""
    c = F.col(text) if isinstance(text, str) else text
    return F.lower(F.translate(F.coalesce(c, F.lit("")), *_accents()))


def words(text: str | Column) -> Column:
    """The runs of ASCII letters and digits of the folded text."""
    return F.regexp_extract_all(fold(text), F.lit("[a-z0-9]+"), F.lit(0))


def stem(word: Column) -> Column:
    """A word without its suffixes, the longest that leaves five characters first, until none is left or four are gone.

    Taking the first fitting suffix again and again makes words of one family meet: nephrotoxicity, nephrotoxic.
    """
    pattern = "^(.{5,}?)(?:" + "|".join(SUFFIXES) + ")$"
    for _ in range(STEM_ROUNDS):
        word = F.regexp_replace(word, pattern, "$1")
    return word


def stems(text: str | Column) -> Column:
    return F.transform(words(text), stem)


def phrase_hits(df: DataFrame, key: str | list[str], text: str, phrases: DataFrame, form: Callable[[str], Column] = stems) -> DataFrame:
    """keys, at, n, and the columns of phrases, for each place (from 1) where a text holds a phrase as a run of whole words.

    phrases has a column `phrase` of one word or more, of any length. A text's words join on the first word of a phrase only; each
    place carries as many words as the longest phrase has, against which the whole phrase is then compared. Phrases
    without a word are found nowhere. form makes the words that are compared of a text and of a phrase.
    """
    keys = [key] if isinstance(key, str) else key
    p = phrases.withColumn("__p", form("phrase")).filter(F.size("__p") > 0).withColumn("n", F.size("__p"))
    n_phrases, longest = p.agg(F.count(F.lit(1)), F.max("n")).first()  # of the vocabulary
    if n_phrases <= BROADCAST_PHRASES:  # then places that begin no phrase go where they are and are not shuffled
        p = F.broadcast(p)
    longest = longest or 1
    begin = p.select(F.element_at("__p", 1).alias("w")).distinct().limit(FIRST_WORDS + 1).collect()
    t = df.select(*keys, form(text).alias("__t"))  # not filtered by size, nor exploded plainly: either works the words out once more
    at = F.sequence(F.lit(1), F.size("__t"))
    if len(begin) <= FIRST_WORDS:  # then no other place becomes a row
        at = F.filter(at, lambda i: F.element_at("__t", i).isin([r.w for r in begin]))
    places = F.when(F.size("__t") > 0, F.transform(at, lambda i: F.struct(i.cast("long").alias("at"), F.slice("__t", i, F.lit(longest)).alias("w"))))
    places = t.select(*keys, F.explode_outer(places).alias("__x")).filter("__x is not null").select(*keys, F.col("__x.at").alias("at"), F.col("__x.w").alias("__w"))
    same = (F.element_at("__w", 1) == F.element_at("__p", 1)) & (F.slice("__w", F.lit(1), F.col("n")) == F.col("__p"))
    return places.join(p, same).drop("__w", "__p")


def topical(candidates: DataFrame, docs: DataFrame, cases: DataFrame, evidence: DataFrame, case: str = "case", doc: str = "doc", general: list[str] | None = None) -> DataFrame:
    """case, doc, relevant, reason for each candidate pair (case, doc).

    docs: doc, text. cases: case, topics and names (arrays), said (its own words). evidence: topic, phrase. A document is relevant to a
    case if it holds a phrase of one of its topics (reason topic), else one of its names (name), both by stems, else
    a word of more than four characters that the case says, spelled alike and not a general one (word). A case without
    any word matches nothing. Only phrases that a pair's own case asks for count, so no document meets other cases.
    """
    none = F.array().cast("array<string>")
    asked = cases.select(case, F.explode(F.coalesce("topics", none)).alias("topic")).join(evidence.select("topic", "phrase"), "topic").select(case, "phrase", F.lit(1).alias("__k"))
    asked = asked.union(cases.select(case, F.explode(F.coalesce("names", none)).alias("phrase"), F.lit(2).alias("__k"))).distinct()
    found = phrase_hits(docs, doc, "text", asked.select("phrase").distinct()).select(doc, "phrase").distinct()
    pairs = candidates.select(case, doc).distinct()
    by_phrase = pairs.join(asked, case).join(found, [doc, "phrase"]).select(case, doc, "__k")
    said = F.array_except(words("said"), F.array(*(F.lit(w) for w in (GENERAL if general is None else general))).cast("array<string>"))
    own = cases.select(case, F.explode(F.filter(said, lambda w: F.length(w) > 4)).alias("w"))
    has = docs.select(doc, F.explode(F.array_distinct(words("text"))).alias("w")).filter(F.length("w") > 4)
    by_word = pairs.join(own, case).join(has, [doc, "w"]).select(case, doc, F.lit(3).alias("__k"))
    best = by_phrase.union(by_word).groupBy(case, doc).agg(F.min("__k").alias("__k"))
    reason = F.element_at(F.array(F.lit("topic"), F.lit("name"), F.lit("word")), F.col("__k"))
    return pairs.join(best, [case, doc], "left").select(case, doc, F.col("__k").isNotNull().cast("int").alias("relevant"), F.when(F.col("__k").isNotNull(), reason).alias("reason"))
