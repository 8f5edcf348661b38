"""Checks of texts against a closed world of facts: numbers, citations, claims and names that nothing supports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolane.operators.phrases import phrase_hits, words
from chronolane.sources.catalog import written_once

# Patterns of numbers, citations, addresses and fixed labels, and numbers that claim nothing.
UNITS = r"%|mg/dL|mmol/L|mEq/L|mmHg|bpm|K/uL|days?|hours?|h\b"
NUMBER = rf"(?i)(?<![\w/])([0-9]+(?:\.[0-9]+)?)(?:\s*({UNITS}))?"
CITATION = r"\[([^\[\]]{3,200})\]"
ADDRESS = r"(?i)(?:https?://\S+|www\.\S+|\b10\.[0-9]{4,9}/[^\s\)\]]+)"
LABEL = r"(?i)\b[0-9]{1,3}-(?:hour|hr|day|days|week|month|year)\b|\bwithin\s+[0-9]{1,3}\s+(?:hour|hours|day|days|week|weeks|month|months)\b"
TRIVIAL = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 24, 48, 72, 100]
TRIVIAL_UNITS = ["", "h", "hour", "hours", "day", "days"]
NO_SOURCE = ["no evidence", "none", "system safety refusal"]


@dataclass(frozen=True)
class Claim:
    """A pattern of claims. It passes in a sentence with a citation if that is `cited`, and for texts with a name that holds `unless`."""

    kind: str
    severity: str
    pattern: str
    cited: bool = False
    unless: str = ""


# Claims that a text may not make in its own voice.
CLAIMS = [
    Claim("shap_claim", "critical", r"(?i)\bSHAP\b", unless="shap"),
    Claim("statistical_claim", "critical", r"(?i)\b(?:p\s*[<=>]\s*0?\.[0-9]+|95%\s*CI|confidence interval)\b"),
    Claim("causal_overclaim", "high", r"(?i)\b(?:proven|guaranteed|will (?:prevent|cure|ensure)|definitely)\b"),
    Claim("causal_overclaim", "high", r"(?i)(?<!not )(?<!never )(?<!no )(?<!rather than )\b(?:drove|drives|driving|caused|causes|causing|led to|leads to|resulted in|results in|responsible for|due to the patient'?s)\b"),
    Claim("directive_without_citation", "high", r"(?i)\b(?:I recommend|you should administer|start the patient on)\b", cited=True),
]


@dataclass(frozen=True)
class Facts:
    """What the texts of each key may state. Every table has the key's column.

    numbers: value, percent (whether it may be said times a hundred). names: name. citations: mark. passages: doc, body.
    """

    numbers: DataFrame
    names: DataFrame
    citations: DataFrame
    passages: DataFrame


def said_numbers(text: str | Column) -> Column:
    """The numbers of a text as structs (raw, value, unit), outside citations, addresses and fixed labels."""
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    for masked in (CITATION, ADDRESS, LABEL):
        c = F.regexp_replace(c, masked, " ")
    part = lambda m, i: F.regexp_extract(m, NUMBER, i)  # noqa: E731 (of a number alone: a whole text is masked and searched once)
    return F.transform(F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0)), lambda m: F.struct(part(m, 1).alias("raw"), part(m, 1).cast("double").alias("value"), F.lower(part(m, 2)).alias("unit")))


def marks(text: str | Column) -> Column:
    """The citations of a text, lower-cased, with repeats."""
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.transform(F.regexp_extract_all(c, F.lit(CITATION), F.lit(1)), lambda m: F.lower(F.trim(m)))


def flat(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def variants(value: Column, percent: Column) -> Column:
    """The ways a number may be written: as it is, rounded to one to three places, and if it is a share also as a percentage."""
    plain = F.array(value, F.round(value, 1), F.round(value, 2), F.round(value, 3))
    share = 100 * value
    return F.array_distinct(F.when(percent & value.between(0, 1), F.concat(plain, F.array(share, F.round(share, 0), F.round(share, 1), F.round(share, 2)))).otherwise(plain))


def fact_numbers(facts: Facts, key: str) -> DataFrame:
    """key, value: every permitted form of a number; those of passages count as they are written there."""
    own = facts.numbers.filter(F.col("value").isNotNull() & ~F.isnan("value")).select(key, F.explode(variants(F.col("value").cast("double"), F.col("percent"))).alias("value"))
    read = facts.passages.select(key, F.explode(said_numbers("body")).alias("n")).select(key, F.explode(variants(F.col("n.value"), F.lit(False))).alias("value"))
    return own.union(read).distinct()


def without_quotes(texts: DataFrame, key: str, text: str, passages: DataFrame, least: int = 20) -> DataFrame:
    """key, line, body: the lines of each text but for those that quote a passage of its key word for word.

    A line quotes if it begins with > and what follows, without a closing ellipsis and with blanks made even, has `least`
    characters or more and stands in a passage. Only such lines meet the passages.
    """
    cells = F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r\n|[\n\r\x0B\x0C\x{85}\x{2028}\x{2029}]")).alias("line", "body")
    lines = texts.select(key, cells)
    said = F.trim(F.regexp_replace(F.regexp_replace(F.trim("body"), "^>+", ""), "…+\\s*$", ""))
    marked = lines.filter(F.trim("body").startswith(">")).withColumn("__q", flat(said)).filter(F.length(said) >= least)
    quoted = marked.join(passages.select(key, flat(F.col("body")).alias("__b")), key).filter(F.contains("__b", "__q")).select(key, "line").distinct()
    return lines.join(quoted, [key, "line"], "left_anti")


def read(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, text, __numbers, __marks: the texts with what they state, worked out once and written for violations and report."""
    return written_once(texts.select(key, text, said_numbers(text).alias("__numbers"), marks(text).alias("__marks")))


def violations(texts: DataFrame, key: str, text: str, facts: Facts, lexicon: DataFrame | None = None, claims: list[Claim] | None = None, tolerance: float = 0.011) -> DataFrame:
    """key, kind, severity, span: one row for each thing that a text states and nothing supports. key is unique in texts.

    empty_generation: no text. ungrounded_number: a number that is not trivial, no year from 1900 to 2100, and further than
    the tolerance from every permitted form. unknown_citation: a mark that no permitted mark equals, holds or stands in; brackets within
    passages are permitted. Claims: matches outside verbatim quotes. ungrounded_name: a name of the lexicon (phrase), of four
    characters or more, that no permitted name and no passage holds. Every fact counts for its own key only.
    texts may come from read; if they do not, they are read here.
    """
    x = (texts if "__numbers" in texts.columns else read(texts, key, text)).withColumnRenamed(text, "__x")
    blank = F.trim(F.regexp_replace(F.coalesce("__x", F.lit("")), r"\s+", " ")) == ""
    row = lambda kind, severity, span: (F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), span.alias("span"))
    found = [x.filter(blank).select(key, *row("empty_generation", "critical", F.lit("")))]

    said = x.select(key, F.explode("__numbers").alias("n")).select(key, "n.*")
    v = F.col("value")
    trivial = v.isin(*map(float, TRIVIAL)) & F.col("unit").isin(*TRIVIAL_UNITS)
    said = said.filter(~trivial & ~(v.between(1900, 2100) & (F.floor(v) == v)))
    # a fact can only be near a number of its own bucket or of a neighbouring one
    bucket = lambda c: F.floor(c / (2 * tolerance))
    known = fact_numbers(facts, key).select(F.col(key).alias("__k"), F.col("value").alias("__f"), F.explode(F.array(*(bucket(F.col("value")) + i for i in (-1, 0, 1)))).alias("__b"))
    near = (F.col(key) == F.col("__k")) & (bucket(v) == F.col("__b")) & (F.abs(v - F.col("__f")) <= tolerance)
    found.append(said.join(known, near, "left_anti").select(key, *row("ungrounded_number", "critical", F.col("raw"))))

    allowed = facts.citations.select(key, F.lower(F.trim(F.regexp_replace("mark", r"^[\[\]]+|[\[\]]+$", ""))).alias("__a"))
    allowed = allowed.union(facts.passages.select(key, F.explode(marks("body")))).filter("__a <> ''").distinct()
    cited = x.select(key, F.explode("__marks").alias("m")).filter(~F.col("m").isin(*NO_SOURCE))
    cited = cited.join(allowed.withColumnRenamed("__a", "m"), [key, "m"], "left_anti")
    part = F.contains("m", "__a") | F.contains("__a", "m")
    found.append(cited.join(allowed.withColumnRenamed(key, "__k"), (F.col(key) == F.col("__k")) & part, "left_anti").select(key, *row("unknown_citation", "critical", F.col("m"))))

    lines = without_quotes(x, key, "__x", facts.passages)
    for c in CLAIMS if claims is None else claims:
        at = lines
        if c.unless:
            at = at.join(facts.names.filter(F.contains(F.lower("name"), F.lit(c.unless))).select(key).distinct(), key, "left_anti")
        if c.cited:  # a sentence ends at white space after its mark, or with the line
            at = at.select(key, F.explode(F.split("body", r"(?<=[.!?])\s+")).alias("body")).filter(~F.col("body").rlike(CITATION))
        found.append(at.select(key, F.explode(F.regexp_extract_all("body", F.lit(c.pattern), F.lit(0))).alias("m")).select(key, *row(c.kind, c.severity, F.col("m"))))

    if lexicon is not None:
        names = lexicon.select("phrase").filter(F.length("phrase") >= 4).distinct()
        used = phrase_hits(x, key, "__x", names, words).select(key, F.lower("phrase").alias("m")).distinct()
        backed = facts.names.select(F.col(key).alias("__k"), F.lower("name").alias("__s")).union(facts.passages.select(key, F.lower("body")))
        found.append(used.join(backed, (F.col(key) == F.col("__k")) & F.contains("__s", "m"), "left_anti").select(key, *row("ungrounded_name", "high", F.col("m"))))

    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def report(texts: DataFrame, key: str, text: str, found: DataFrame) -> DataFrame:
    """key, ok, n_numbers, n_citations, n_critical, n_high for every text; ok: neither critical nor high violations."""
    tally = found.groupBy(key).agg(F.count_if(F.col("severity") == "critical").alias("n_critical"), F.count_if(F.col("severity") == "high").alias("n_high"))
    numbers, cited = ("__numbers", "__marks") if "__numbers" in texts.columns else (said_numbers(text), marks(text))
    out = texts.select(key, F.size(numbers).cast("long").alias("n_numbers"), F.size(cited).cast("long").alias("n_citations")).join(tally, key, "left")
    out = out.fillna(0, ["n_critical", "n_high"])
    return out.select(key, (F.col("n_critical") + F.col("n_high") == 0).cast("int").alias("ok"), "n_numbers", "n_citations", "n_critical", "n_high")
