"""Conversations turn by turn: intents that persist until another argues well enough, and red flags with suppression and history.

What earlier turns decide is worked out by windows over flags and counts, never by gathering a conversation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A clause ends at these, and with it the reach of a negation.
CLAUSE = r"[.;,]|\b(?:but|however|although|though)\b"


@dataclass(frozen=True)
class Rule:
    intent: str
    pattern: str
    weight: float
    label: str = ""


def scores(text: Column, rules: list[Rule], bonus: dict[str, float]) -> Column:
    """An array of (score, intent, evidence), best first, ties by name; an intent without a match is left out, its bonus too."""
    cells = []
    for name in sorted({r.intent for r in rules}):
        mine = [r for r in rules if r.intent == name]
        total = sum((F.when(text.rlike(r.pattern), F.lit(r.weight)).otherwise(0.0) for r in mine), F.lit(0.0))
        why = F.array_join(F.array_compact(F.array(*(F.when(text.rlike(r.pattern), F.lit(r.label or r.pattern)) for r in mine))), ",")
        cells.append(F.when(total > 0, F.struct((-F.round(total + bonus.get(name, 0.0), 6)).alias("less"), F.lit(name).alias("intent"), why.alias("evidence"))))
    return F.transform(F.array_sort(F.array_compact(F.array(*cells))), lambda c: F.struct((-c["less"]).alias("score"), c["intent"].alias("intent"), c["evidence"].alias("evidence")))


def classify(df: DataFrame, text: str, rules: list[Rule], bonus: dict[str, float], floor: float, unknown: str) -> DataFrame:
    """df with intent, confidence, evidence and alternatives (arrays of names, three at most).

    Confidence is the best score, 1 at most. Below the floor the intent is unknown and the alternatives are the first three of all;
    above it they are the three that follow and reach the floor. Null and blank texts match nothing.
    """
    x = df.withColumn("__s", scores(F.lower(F.trim(F.coalesce(F.col(text), F.lit("")))), rules, bonus))
    top = F.get("__s", F.lit(0))
    confidence = F.when(F.size("__s") > 0, F.least(top["score"], F.lit(1.0))).otherwise(0.0)
    sure = confidence >= floor
    others = F.filter(F.slice("__s", 2, 3), lambda c: c["score"] >= floor)
    names = lambda c: F.transform(c, lambda s: s["intent"])
    return x.withColumns({
        "intent": F.when(sure, top["intent"]).otherwise(unknown),
        "confidence": confidence,
        "evidence": F.when(sure, top["evidence"]).otherwise(""),
        "alternatives": F.when(sure, names(others)).otherwise(names(F.slice("__s", 1, 3))),
    }).drop("__s")


def resolve(turns: DataFrame, conversation: str, turn: str, floor: float, switch: float, asides: list[str], idle: list[str], unknown: str, opening: str | None = None) -> DataFrame:
    """turns (intent, confidence) with served, open_intent and how: the intent in the light of the turns before.

    An open intent stays open until another reaches `switch`, which is above the floor for opening one. An aside that reaches the
    floor is served without closing it; anything weaker continues the open one. Idle intents are never held open. opening
    stands for unknown in a conversation's first turn. how: fresh, same, switched, aside or continuing.

    A turn that reaches `switch` decides whatever was open, so it begins a segment, and what is open in a segment is its
    first intent that is not idle: a running count and a first value, in place of a fold. (conversation, turn) is unique.
    """
    w = W.partitionBy(conversation).orderBy(turn)
    x = turns
    if opening:
        x = x.withColumn("intent", F.when((F.row_number().over(w) == 1) & (F.col("intent") == unknown), opening).otherwise(F.col("intent")))
    strong = (F.col("confidence") >= switch) & (F.col("intent") != unknown)
    x = x.withColumn("__seg", F.sum(strong.cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    held = F.when(~F.col("intent").isin(*idle, unknown), F.col("intent"))
    inside = W.partitionBy(conversation, "__seg").orderBy(turn).rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("open_intent", F.coalesce(F.first(held, ignorenulls=True).over(inside), F.col("intent")))
    x = x.withColumn("__before", F.lag("open_intent").over(w))
    how = (
        F.when(F.col("__before").isNull() | F.col("__before").isin(*idle, unknown), "fresh")
        .when(F.col("intent") == F.col("__before"), "same")
        .when(strong, "switched")
        .when(F.col("intent").isin(*asides) & (F.col("confidence") >= floor), "aside")
        .otherwise("continuing")
    )
    x = x.withColumn("how", how)
    return x.withColumn("served", F.when(F.col("how") == "continuing", F.col("__before")).otherwise(F.col("intent"))).drop("__seg", "__before")


@dataclass(frozen=True)
class Flag:
    """A red flag: the first of its patterns that a turn matches triggers it; an urgent one grows to an emergency with one of `grows_with`."""

    name: str
    patterns: tuple[str, ...]
    severity: str = "urgent"
    grows_with: tuple[str, ...] = ()


def _span(text: Column, patterns: tuple[str, ...]) -> tuple[Column, Column]:
    """Where the first pattern that matches does so (from 1; 0: none does), and what it matches."""
    at, what = F.lit(0), F.lit("")
    for p in reversed(patterns):
        here = F.regexp_instr(text, F.lit(p))
        at, what = F.when(here > 0, here).otherwise(at), F.when(here > 0, F.regexp_extract(text, p, 0)).otherwise(what)
    return at, what


def screen(df: DataFrame, conversation: str, turn: str, text: str, flags: list[Flag], negations: list[str], past: list[str], reach: int = 40, clause: str = CLAUSE) -> DataFrame:
    """conversation, turn, flag, severity, matched, escalated, from_history, suppressed (null, negated or past) for each flag of each turn.

    An urgent trigger is suppressed by a negation before it, or by a word of the past before or after it, within `reach` characters;
    before it, only what follows the last clause end counts. Emergencies are never suppressed. A flag grows if one of grows_with stands
    outside the trigger itself, or in an earlier turn if this one has it nowhere. A trigger of an earlier turn counts again only
    in a turn that brings one of grows_with. Null texts match nothing; (conversation, turn) is unique.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    cells = []
    for f in flags:
        at, what = _span(F.col("__t"), f.patterns)
        places = [F.regexp_instr("__t", F.lit(p)).alias(str(i)) for i, p in enumerate(f.grows_with)]
        cells.append(F.struct(F.lit(f.name).alias("flag"), F.lit(f.severity).alias("s"), at.cast("long").alias("at"), what.alias("matched"), F.array(*places).cast("array<long>").alias("places")))
    x = df.select(conversation, turn, low.alias("__t")).withColumn("__f", F.explode(F.array(*cells))).select(conversation, turn, "__t", "__f.*")
    end = F.col("at") + F.length("matched")
    bit = lambda c: F.aggregate(F.transform("places", lambda p, i: F.when(c(p), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    # The masks say which of grows_with stand in the text at all, and which outside the trigger.
    x = x.withColumns({"__any": bit(lambda p: p > 0), "__out": bit(lambda p: (p > 0) & ~((p >= F.col("at")) & (p < end)))})
    before = W.partitionBy(conversation, "flag").orderBy(turn).rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumns({"__hit_before": F.coalesce(F.max(F.col("at") > 0).over(before), F.lit(False)), "__any_before": F.coalesce(F.bit_or("__any").over(before), F.lit(0))})
    hit, urgent = F.col("at") > 0, F.col("s") == "urgent"
    grows = urgent & F.when(hit, (F.col("__out") != 0) | (F.col("__any_before").bitwiseAND(F.bitwise_not("__any")) != 0)).otherwise(F.col("__any") != 0)
    left = F.element_at(F.split(F.substring(F.col("__t"), F.greatest(F.col("at") - reach, F.lit(1)), F.least(F.col("at") - 1, F.lit(reach))), clause), -1)
    right = F.substring(F.col("__t"), end, F.lit(reach))
    any_of = lambda c, patterns: F.coalesce(*(F.when(c.rlike(p), F.lit(True)) for p in patterns), F.lit(False))
    why = F.when(any_of(left, negations), "negated").when(any_of(left, past) | any_of(right, past), "past")
    x = x.withColumn("suppressed", F.when(hit & urgent, why)).withColumn("__grows", grows)
    x = x.filter(hit | (F.col("__hit_before") & F.col("__grows")))
    shown = F.col("__grows") & F.col("suppressed").isNull()
    return x.select(conversation, turn, "flag", F.when(shown, "emergency").otherwise(F.col("s")).alias("severity"), "matched", shown.cast("int").alias("escalated"), (~hit).cast("int").alias("from_history"), "suppressed")
