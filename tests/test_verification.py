"""Phrases, topical relevance and grounding on small texts."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from chronolane.operators import grounding as G
from chronolane.operators import phrases as P
from chronolane.operators import retrieval as R
from chronolane.operators import text as X
from chronolane.plans.registry import QUERIES

NOTE = "Peak creatinine 3.2 mg/dL, risk 2.9%. "


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn("x").alias("y")).first().y


def test_fold_takes_the_compatibility_form(spark):
    text = "Ünïcôdé ÀÉÎ ñ Ÿ ǎ ḿ é ø ß"
    want = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    assert one(spark, text, P.fold) == want
    assert one(spark, None, P.fold) == ""


@pytest.mark.parametrize("family", [["nephrotoxicity", "nephrotoxic"], ["anticoagulation", "anticoagulants", "anticoagulant"], ["ventilation", "ventilations"]])
def test_words_of_a_family_share_a_stem(spark, family):
    assert len({tuple(one(spark, w, P.stems)) for w in family}) == 1


def test_stem_equals_a_plain_loop(spark):
    def plain(w):
        for _ in range(P.STEM_ROUNDS):
            fit = next((s for s in P.SUFFIXES if w.endswith(s) and len(w) - len(s) >= 5), None)
            if fit is None:
                return w
            w = w[: -len(fit)]
        return w

    vocabulary = ["rationalising", "pe", "hyperkalemia", "cases", "seizures", "sepses", "operations", "nationalities", "s" * 9, "historically", "deficiencies", "mechanical", "abcdes", "causative", "coronary"]
    assert [one(spark, w, P.stems)[0] for w in vocabulary] == [plain(w) for w in vocabulary]


def hits(spark, texts, phrases, **k):
    df = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    out = P.phrase_hits(df, "key", "text", spark.createDataFrame([(p,) for p in phrases], "phrase string"), **k)
    return sorted((r.key, r.at, r.phrase) for r in out.collect())


def test_phrases_of_any_length(spark):
    texts = ["A non-invasive, ventilations patient with one two three four five", None, "", "hyperkalemia and pe", "one two three four six", "one one two three four five"]
    phrases = ["noninvasive ventilation", "non invasive ventilation", "one two three four five", "pe", "...", ""]
    assert hits(spark, texts, phrases) == [(0, 2, "non invasive ventilation"), (0, 7, "one two three four five"), (3, 3, "pe"), (5, 2, "one two three four five")]
    assert hits(spark, texts, phrases, form=P.words) == [(0, 7, "one two three four five"), (3, 3, "pe"), (5, 2, "one two three four five")]
    assert hits(spark, texts, []) == hits(spark, [], phrases) == []


def test_aliases_and_names_of_four_words(spark):
    df = spark.createDataFrame([(1, "seen for end stage renal disease today"), (2, "x")], "k long, text string")
    alias = spark.createDataFrame([("end stage renal disease", "esrd"), ("disease", "other")], "alias string, concept string")
    assert [(r.k, r.concept, r.at) for r in X.first_concept(df, "k", "text", alias).collect()] == [(1, "esrd", 3)]
    names = spark.createDataFrame([("end stage renal disease", "a", "b", "brand"), ("renal", "c", "d", "brand")], "name string, ingredient string, class string, kind string")
    assert {r.k: r.ingredient for r in R.medications(df, "k", "text", names, "zzz", "yyy").collect()} == {1: "a", 2: None}


def test_topical(spark):
    docs = spark.createDataFrame([(1, "Nephrotoxicity of drugs"), (2, "peptic ulcer"), (3, "vancomycin levels"), (4, "sepsis management"), (5, None)], "doc long, text string")
    cases = spark.createDataFrame([(9, ["renal"], ["vancomycin"], "severe sepsis management"), (8, None, None, None)], "case long, topics array<string>, names array<string>, said string")
    evidence = spark.createDataFrame([("renal", "nephrotoxic"), ("lung", "pe")], "topic string, phrase string")
    pairs = spark.createDataFrame([(c, d) for c in (8, 9) for d in range(1, 6)], "case long, doc long")
    got = {(r.case, r.doc): r.reason for r in P.topical(pairs, docs, cases, evidence).collect()}
    assert got == {(8, d): None for d in range(1, 6)} | {(9, 1): "topic", (9, 2): None, (9, 3): "name", (9, 4): "word", (9, 5): None}


CASES = [
    (NOTE + "[SCCM/ESICM Surviving Sepsis Campaign 2021, Antimicrobials]", []),
    ("Elevations (+0.45 SHAP) seen.", [("shap_claim", "SHAP"), ("ungrounded_number", "0.45")]),
    ("Hold per [KDIGO 2023 AKI Guideline 3.1].", [("unknown_citation", "kdigo 2023 aki guideline 3.1")]),
    ("By label [WG CARE, LLC] and [doc-1, page 3] and [No evidence].", []),
    ("Consider starting dobutamine or epi.", [("ungrounded_name", "dobutamine")]),
    ("Receiving norepinephrine and Vancomycin.", []),
    ("Reduced (p < 0.05, 95% CI seen).", [("statistical_claim", "95% CI"), ("statistical_claim", "p < 0.05"), ("ungrounded_number", "0.05"), ("ungrounded_number", "95")]),
    ("This will prevent it and is guaranteed.", [("causal_overclaim", "guaranteed"), ("causal_overclaim", "will prevent")]),
    ("Creatinine drove it. These are associations, not causes.", [("causal_overclaim", "drove")]),
    ("30-day readmission within 6 hours, 24 h, in 2021, https://a.org/10.1161/CIR.00038 and 12 units", []),
    ("Threshold 0.3 and 30% of it.", [("ungrounded_number", "30")]),
    ("Risk 50%. Dose 777.", [("ungrounded_number", "50"), ("ungrounded_number", "777")]),
    ("I recommend rest. I recommend fluids [doc-1].", [("directive_without_citation", "I recommend")]),
    ("> KDIGO says  AKI is caused by sepsis…\n> AKI is caused by aliens and worse\nend", [("causal_overclaim", "caused")]),
    ("  \n ", [("empty_generation", "")]),
    (None, [("empty_generation", "")]),
    ("word " * 20000 + "dobutamine 9.99 " * 3, [("ungrounded_name", "dobutamine")] + [("ungrounded_number", "9.99")] * 3),
    ("SHAP of 0.5, next to shap values.", []),
]


def test_texts(spark):
    """Each text has a key and facts of its own; key 0 has facts that no text may use."""
    keys = range(1, len(CASES) + 1)
    several = lambda rows, schema: spark.createDataFrame([(k, *r) for k in keys for r in rows], "k long, " + schema)
    numbers = several([(3.2, False), (0.0286, True), (0.5, False), (None, False)], "value double, percent boolean")
    names = several([("norepinephrine",), ("vancomycin",)], "name string").union(spark.createDataFrame([(len(CASES), "shap values")], "k long, name string"))
    passages = several([("KDIGO says AKI is caused by sepsis; a rise of 0.3 mg/dL [WG CARE, LLC]",)], "body string")
    marks = several([("[SCCM/ESICM Surviving Sepsis Campaign 2021, Antimicrobials]",), ("doc-1",)], "mark string")
    foreign = spark.createDataFrame([(0, 777.0, True)], "k long, value double, percent boolean")
    facts = G.Facts(numbers.union(foreign), names, marks, passages)
    lexicon = spark.createDataFrame([("dobutamine",), ("vancomycin",), ("norepinephrine",), ("epi",)], "phrase string")
    texts = spark.createDataFrame([(k, c[0]) for k, c in zip(keys, CASES, strict=True)], "k long, text string")
    found = G.violations(texts, "k", "text", facts, lexicon)
    got = {k: [] for k in keys}
    for r in found.collect():
        got[r.k].append((r.kind, r.span))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(c[1]) for k, c in zip(keys, CASES, strict=True)}
    for r in G.report(texts, "k", "text", found).collect():
        assert r.ok == (not got[r.k]) and r.n_critical + r.n_high == len(got[r.k])
    assert G.violations(texts.filter("false"), "k", "text", facts, lexicon).count() == 0


def test_all_kinds_occur(spark):
    kinds = {r.kind for r in QUERIES["r15_grounded_texts"](spark, "/root/testdata/sf0.01").select("kind").distinct().collect()}
    assert kinds == {"empty_generation", "ungrounded_number", "unknown_citation", "overclaim", "directive", "attribution", "ungrounded_name"}
    reasons = {r.reason for r in QUERIES["r06_topical_phrases"](spark, "/root/testdata/sf0.01").select("reason").distinct().collect()}
    assert reasons == {"topic", "name", "word", None}
    assert QUERIES["r01_long_aliases"](spark, "/root/testdata/sf0.01").filter(F.contains("concepts", F.lit("licence"))).count() > 0


def test_places_are_not_shuffled_to_a_small_vocabulary(spark, monkeypatch):
    from chronolane.operators import phrases

    df = spark.createDataFrame([(1, "an apple pie"), (2, "no pie apple")], "k long, t string")
    words = spark.createDataFrame([("apple pie",), ("pie",)], "phrase string")
    found = lambda: phrases.phrase_hits(df, "k", "t", words)
    plan = found()._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    want = sorted(map(tuple, found().select("k", "at", "phrase").collect()))
    assert want == [(1, 2, "apple pie"), (1, 3, "pie"), (2, 2, "pie")]
    monkeypatch.setattr(phrases, "BROADCAST_PHRASES", 1)
    assert sorted(map(tuple, found().select("k", "at", "phrase").collect())) == want


def test_texts_are_read_once_and_other_places_are_no_rows(spark):
    plan = QUERIES["r15_grounding_report"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "\\nLength " not in plan and "\nLength " not in plan  # the reports are a table by then
    text = spark.createDataFrame([(1, "a b c b"), (2, "c"), (3, None)], "k int, t string")
    hits = P.phrase_hits(text, "k", "t", spark.createDataFrame([("b c",), ("b",)], "phrase string"), P.words)
    assert "filter(sequence" in hits._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.k, r.at, r.phrase) for r in hits.collect()) == [(1, 2, "b"), (1, 2, "b c"), (1, 4, "b")]


def test_numbers_keep_their_units(spark):
    row = spark.range(1).select(F.lit("24 h, 5 hx 7days 3.5 mg/dL /8 x9 10% 2 Hours").alias("t")).select(G.said_numbers("t").alias("n")).first()
    assert [(x.raw, x.value, x.unit) for x in row.n] == [("24", 24.0, "h"), ("5", 5.0, ""), ("7", 7.0, "days"), ("3.5", 3.5, "mg/dl"), ("10", 10.0, "%"), ("2", 2.0, "hours")]
