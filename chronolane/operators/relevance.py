"""How much a source or an item counts: evidence levels by type and title, and items ranked by rules of class, concept and measurement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Levels of evidence with the publication types and the words of a title that mean them, in the order in which they are tried.
LEVELS = [
    ("Level 3: Systematic Reviews & Meta-Analyses", ["meta-analysis", "systematic review"], ["meta-analysis", "meta analysis", "systematic review"]),
    ("Level 1: Clinical Practice Guidelines", ["practice guideline", "guideline", "consensus development conference"], []),
    ("Level 3: Randomised Controlled Trials", ["randomized controlled trial", "clinical trial, phase iii"], []),
    ("Level 4: Correspondence & Case Letters (Letter / Short Communication — Reduced Evidentiary Weight)", ["letter", "correspondence", "comment", "editorial"], []),
    ("Level 4: Case Reports & Autopsy Findings (Single Case / Autopsy — Reduced Evidentiary Weight)", ["case reports"], ["autopsy findings", "autopsy report", "case report", "a case of", "case series", "fatal case"]),
]
OTHERWISE = "Level 4: Observational Clinical Studies"


def evidence_level(types: str, title: str, levels: list[tuple[str, list[str], list[str]]] | None = None, otherwise: str = OTHERWISE) -> Column:
    """The first level one of whose types is among `types` (an array) or one of whose words stands in the title; case does not matter, null is nothing."""
    have = F.transform(F.coalesce(F.col(types), F.array().cast("array<string>")), F.lower)
    low = F.lower(F.coalesce(F.col(title), F.lit("")))
    out = F.lit(otherwise)
    for name, kinds, words in reversed(LEVELS if levels is None else levels):
        hit = F.arrays_overlap(have, F.array(*(F.lit(k) for k in kinds))) if kinds else F.lit(False)
        for w in words:
            hit = F.coalesce(hit, F.lit(False)) | F.contains(low, F.lit(w))
        out = F.when(F.coalesce(hit, F.lit(False)), name).otherwise(out)
    return out


def rank_items(items: DataFrame, cases: DataFrame, rules: DataFrame, unlinked: float = 1.0) -> DataFrame:
    """case, place, ingredient, class, score, rationale, rank: the items of each case, best first, ties in their own order.

    items: case, place, raw, ingredient, class (both null where the string is not recognised). cases: case, concepts (array), measures (map of
    names to numbers). rules: class, concepts (array), measure, below, above (a bound or null), high, low. An item of a class with a rule
    scores high if the case has one of the rule's concepts or a measure beyond a bound, else low; without a rule it scores
    `unlinked`, unrecognised 0. A measure that is not there is beyond nothing. Items of a case that is not in cases meet no concept.
    """
    r = rules.withColumnsRenamed({"concepts": "__rc", "class": "__class"})
    x = items.join(cases.withColumnRenamed("case", "__case"), F.col("case") == F.col("__case"), "left").join(r, F.col("class") == F.col("__class"), "left")
    none = F.array().cast("array<string>")
    shared = F.array_sort(F.array_intersect(F.coalesce("concepts", none), F.coalesce("__rc", none)))
    v = F.element_at("measures", F.col("measure"))
    beyond = F.coalesce(v < F.col("below"), F.lit(False)) | F.coalesce(v > F.col("above"), F.lit(False))
    x = x.withColumns({"__shared": shared, "__beyond": F.col("__class").isNotNull() & beyond})
    linked = (F.size("__shared") > 0) | F.col("__beyond")
    known, ruled = F.col("ingredient").isNotNull(), F.col("__class").isNotNull()
    score = F.when(~known, 0.0).when(~ruled, unlinked).when(linked, F.col("high")).otherwise(F.col("low"))
    reasons = F.concat_ws("; ", F.when(F.size("__shared") > 0, F.concat(F.lit("indicated for "), F.array_join("__shared", ", "))), F.when(F.col("__beyond"), "supported by presentation physiology"))
    why = F.when(~known, "unrecognised medication string").when(~ruled, "no specific mechanistic link to this presentation").when(linked, reasons).otherwise(F.concat("class", F.lit(" without a matching indication in this presentation")))
    out = x.select("case", "place", "ingredient", "class", score.alias("score"), why.alias("rationale"))
    return out.withColumn("rank", F.row_number().over(W.partitionBy("case").orderBy(F.desc("score"), "place")))
