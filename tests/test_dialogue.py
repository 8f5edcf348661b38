"""Intents that persist and red flags, against plain folds over a conversation."""

import random
import re

import pytest

from chronolane.operators import dialogue as D
from chronolane.plans.registry import QUERIES

RULES = [D.Rule("symptom", r"\b(headache|pain)\b", 0.35, "symptom"), D.Rule("symptom", r"\bi have\b", 0.15, "frame"), D.Rule("report", r"\bexplain\b", 0.3, "explain"), D.Rule("report", r"\bmri\b", 0.4, "report"), D.Rule("lookup", r"\bguideline\b", 0.45, "lookup"), D.Rule("hello", r"^hello\b", 0.9, "hello"), D.Rule("weak", r"\bbit\b", 0.1, "bit")]
OPTIONS = dict(floor=0.3, switch=0.55, asides=["lookup"], idle=["hello", "help"], unknown="unknown", opening="help")


def run(spark, turns, bonus=None):
    df = spark.createDataFrame([(c, i, x) for c, texts in turns.items() for i, x in enumerate(texts)], "c string, t long, text string")
    out = D.resolve(D.classify(df, "text", RULES, bonus or {}, 0.3, "unknown"), "c", "t", **OPTIONS)
    return {(r.c, r.t): r for r in out.collect()}


def test_intents_in_context(spark):
    got = run(spark, {
        "a": ["I have a headache", "yesterday morning, about 7 of 10", "it aches a bit", "what does the guideline say", "still", "Actually, explain my MRI report"],
        "b": ["hello", "I have pain"],
        "c": ["", None, "mri"],
        "d": ["guideline please", "explain", "and"],
    })
    how = lambda c: [(got[c, i].served, got[c, i].how) for i in range(len([k for k in got if k[0] == c]))]
    assert how("a") == [("symptom", "fresh"), ("symptom", "continuing"), ("symptom", "continuing"), ("lookup", "aside"), ("symptom", "continuing"), ("report", "switched")]
    assert how("b") == [("hello", "fresh"), ("symptom", "fresh")]
    assert how("c") == [("help", "fresh"), ("unknown", "fresh"), ("report", "fresh")]
    assert how("d") == [("lookup", "fresh"), ("lookup", "continuing"), ("lookup", "continuing")]
    assert got["a", 5].evidence == "explain,report" and got["a", 2].alternatives == ["weak"] and got["c", 1].confidence == 0.0


def test_bonus_and_alternatives(spark):
    got = run(spark, {"a": ["explain the headache guideline and the mri"]}, {"lookup": 0.4})["a", 0]
    assert (got.served, got.confidence, got.alternatives) == ("lookup", 0.85, ["report", "symptom"])
    assert run(spark, {"a": ["nothing"]}, {"lookup": 0.4})["a", 0].confidence == 0.0  # no match, no bonus


def test_windows_equal_a_fold(spark):
    rng = random.Random(3)
    names = ["unknown", "hello", "help", "lookup", "x", "y"]
    rows = [(c, t, rng.choice(names), rng.choice([0.0, 0.3, 0.4, 0.55, 0.9])) for c in range(60) for t in range(rng.randint(1, 12))]
    rows = [(c, t, i, 0.0 if i == "unknown" and rng.random() < 0.8 else p) for c, t, i, p in rows]
    out = D.resolve(spark.createDataFrame(rows, "c long, t long, intent string, confidence double"), "c", "t", **OPTIONS)
    got = {(r.c, r.t): (r.served, r.open_intent, r.how) for r in out.collect()}
    state = None
    for c, t, fresh, p in rows:
        state = None if t == 0 else state
        fresh = "help" if t == 0 and fresh == "unknown" else fresh
        strong = p >= 0.55 and fresh != "unknown"
        if state in (None, "hello", "help", "unknown"):
            how, served, state = "fresh", fresh, fresh
        elif fresh == state:
            how, served = "same", fresh
        elif strong:
            how, served, state = "switched", fresh, fresh
        elif fresh == "lookup" and p >= 0.3:
            how, served = "aside", fresh
        else:
            how, served = "continuing", state
        assert got[c, t] == (served, state, how)


FLAGS = [D.Flag("chest", ("severe chest pain", "chest pain"), "urgent", ("severe", "jaw")), D.Flag("stroke", ("face droop",), "emergency", ("jaw",)), D.Flag("plain", ("rash",))]
NEG, PAST = [r"\bno\b", r"\bnot\b"], [r"\blast year\b", r"\bused to\b"]


def screened(spark, turns):
    df = spark.createDataFrame([(c, i, x) for c, texts in turns.items() for i, x in enumerate(texts)], "c string, t long, text string")
    return {(r.c, r.t, r.flag): (r.severity, r.matched, r.escalated, r.from_history, r.suppressed) for r in D.screen(df, "c", "t", "text", FLAGS, NEG, PAST).collect()}


def test_red_flags(spark):
    got = screened(spark, {
        "a": ["I have no chest pain", "I have no fever but I do have chest pain", "now in my jaw", "same as before"],
        "b": ["Chest pain last year", "I used to have chest pain, and a rash", "no fever. chest pain"],
        "c": ["severe chest pain", "no face droop", None, ""],
        "d": ["my jaw hurts", "chest pain"],
    })
    assert got == {
        ("a", 0, "chest"): ("urgent", "chest pain", 0, 0, "negated"), ("a", 1, "chest"): ("urgent", "chest pain", 0, 0, None), ("a", 2, "chest"): ("emergency", "", 1, 1, None),
        ("b", 0, "chest"): ("urgent", "chest pain", 0, 0, "past"), ("b", 1, "chest"): ("urgent", "chest pain", 0, 0, "past"), ("b", 1, "plain"): ("urgent", "rash", 0, 0, None), ("b", 2, "chest"): ("urgent", "chest pain", 0, 0, None),
        ("c", 0, "chest"): ("urgent", "severe chest pain", 0, 0, None), ("c", 1, "stroke"): ("emergency", "face droop", 0, 0, None),
        ("d", 1, "chest"): ("emergency", "chest pain", 1, 0, None),
    }


def test_flags_equal_a_plain_screen(spark):
    rng = random.Random(9)
    parts = ["chest pain", "severe", "jaw", "no", "not", "but", "last year", "used to", ".", ",", "rash", "face droop", "word " * 12, "severe chest pain", "x"]
    turns = {str(c): [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 6))] for c in range(50)}
    want = {}
    for c, texts in turns.items():
        for t, x in enumerate(texts):
            for f in FLAGS:
                m = next((m for p in f.patterns if (m := re.search(p, x))), None)
                before = [re.search(p, y) for y in texts[:t] for p in f.patterns]
                grows, why = False, None
                for p in f.grows_with if f.severity == "urgent" else ():
                    here = re.search(p, x)
                    past = any(re.search(p, y) for y in texts[:t])
                    grows |= bool(here and not (m and m.start() <= here.start() < m.end())) or bool(m and not here and past)
                if m and f.severity == "urgent":
                    left = re.split(D.CLAUSE, x[max(0, m.start() - 40) : m.start()])[-1]
                    right = x[m.end() : m.end() + 40]
                    why = "negated" if any(re.search(p, left) for p in NEG) else "past" if any(re.search(p, s) for p in PAST for s in (left, right)) else None
                if m or any(before) and grows:
                    up = grows and why is None
                    want[c, t, f.name] = ("emergency" if up else f.severity, m.group(0) if m else "", int(up), int(m is None), why)
    assert screened(spark, turns) == want


@pytest.mark.parametrize(("name", "column", "kinds"), [("r12_resolved_intent", "how", {"fresh", "same", "switched", "aside", "continuing"}), ("r13_screen_patterns", "suppressed", {None, "negated", "past"})])
def test_all_cases_occur(spark, name, column, kinds):
    assert {r[0] for r in QUERIES[name](spark, "/root/testdata/sf0.01").select(column).distinct().collect()} == kinds
