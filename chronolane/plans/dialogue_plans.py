"""Intents with state and red flags over whole conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolane.operators import dialogue as D
from chronolane.plans.base import query, t

RULES = [D.Rule("ask", "[?]", 0.4, "mark"), D.Rule("ask", "qu[ei]", 0.25, "que"), D.Rule("explain", "tion", 0.2, "tion"), D.Rule("explain", "ment", 0.3, "ment"), D.Rule("explain", "keit", 0.35, "keit"), D.Rule("greet", "^(ha|he|el)", 0.32, "opening"), D.Rule("tell", "thre", 0.3, "thre"), D.Rule("tell", "und", 0.35, "und"), D.Rule("tell", "ando", 0.3, "ando"), D.Rule("tell", "shth", 0.2, "shth"), D.Rule("explain", "tionon", 0.4, "tionon")]
BONUS = {"ask": 0.05, "tell": 0.1}
ASIDES, IDLE = ["explain"], ["greet", "help"]


def _score(name):
    mine = [r for r in RULES if r.intent == name]
    total = " + ".join(f"{r.weight}::DOUBLE * regexp_matches(x, '{r.pattern}')::INT" for r in mine)
    return f"CASE WHEN {total} > 0 THEN round({total} + {BONUS.get(name, 0.0)}::DOUBLE, 6) END AS {name}"


def _why(name):
    return f"WHEN '{name}' THEN array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(x, '{r.pattern}') THEN '{r.label}' END" for r in RULES if r.intent == name) + "], lambda e: e IS NOT NULL), ',')"


_NAMES = sorted({r.intent for r in RULES})


@query("r12_resolved_intent", f"""WITH RECURSIVE k AS (SELECT conv_id, turn, lower(trim(coalesce(text, ''))) AS x FROM conversations), s AS (SELECT *, {', '.join(map(_score, _NAMES))} FROM k),
    l AS (SELECT *, list_sort(list_filter([{', '.join(f"CASE WHEN {n} IS NOT NULL THEN {{'less': -{n}, 'intent': '{n}'}} END" for n in _NAMES)}], lambda e: e IS NOT NULL)) AS r FROM s),
    f AS (SELECT *, confidence >= 0.3 AS sure FROM (SELECT *, CASE WHEN len(r) > 0 THEN least(-r[1].less, 1.0::DOUBLE) ELSE 0.0::DOUBLE END AS confidence FROM l)),
    g AS (SELECT conv_id, turn, confidence, CASE WHEN sure THEN r[1].intent WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 THEN 'help' ELSE 'unknown' END AS intent, CASE WHEN sure THEN CASE r[1].intent {' '.join(map(_why, _NAMES))} END ELSE '' END AS evidence,
      array_to_string(CASE WHEN sure THEN list_transform(list_filter(r[2:4], lambda e: -e.less >= 0.3), lambda e: e.intent) ELSE list_transform(r[1:3], lambda e: e.intent) END, ',') AS alternatives FROM f),
    n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM g),
    z AS (SELECT n.*, CAST(NULL AS VARCHAR) AS before, n.intent AS open_intent FROM n WHERE i = 1
      UNION ALL SELECT n.*, z.open_intent, CASE WHEN z.open_intent IN ('greet', 'help', 'unknown') THEN n.intent WHEN n.intent = z.open_intent THEN z.open_intent WHEN n.intent <> 'unknown' AND n.confidence >= 0.55 THEN n.intent ELSE z.open_intent END FROM z JOIN n ON n.conv_id = z.conv_id AND n.i = z.i + 1),
    h AS (SELECT *, CASE WHEN before IS NULL OR before IN ('greet', 'help', 'unknown') THEN 'fresh' WHEN intent = before THEN 'same' WHEN intent <> 'unknown' AND confidence >= 0.55 THEN 'switched' WHEN intent IN ('explain') AND confidence >= 0.3 THEN 'aside' ELSE 'continuing' END AS how FROM z)
    SELECT conv_id, turn, intent, confidence, evidence, alternatives, open_intent, how, CASE WHEN how = 'continuing' THEN before ELSE intent END AS served FROM h""")
def r12(spark, d):
    turns = D.classify(t(spark, d, "conversations"), "text", RULES, BONUS, 0.3, "unknown")
    out = D.resolve(turns, "conv_id", "turn", 0.3, 0.55, ASIDES, IDLE, "unknown", opening="help")
    return out.select("conv_id", "turn", "intent", "confidence", "evidence", F.array_join("alternatives", ",").alias("alternatives"), "open_intent", "how", "served")


FLAGS = [D.Flag("tion", ("tionly", "tion"), "urgent", ("ment", "tionwh")), D.Flag("ou", ("oui[a-z]*", "eou"), "urgent", ("que", "eoui")), D.Flag("ess", ("mentpa", "keitent"), "emergency")]
NEGATIONS, PAST = ["(^| )(no|pas|de|in) ", "nicht"], ["(^| )(was|que|und) "]
_FLAG_ROWS = ", ".join(f"('{f.name}', {list(f.patterns)}, '{f.severity}', {list(f.grows_with)}::VARCHAR[])" for f in FLAGS)
_FIND = "CASE WHEN regexp_matches(t, {p}) THEN strpos(t, regexp_extract(t, {p})) ELSE 0 END"


@query("r13_screen_patterns", f"""WITH ru(flag, pats, s, co) AS (VALUES {_FLAG_ROWS}), x AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS t, ru.* FROM conversations, ru),
    y AS (SELECT *, coalesce(list_filter(pats, lambda p: regexp_matches(t, p))[1], '') AS pat FROM x), z AS (SELECT *, CASE WHEN pat = '' THEN '' ELSE regexp_extract(t, pat) END AS matched FROM y), a AS (SELECT *, CASE WHEN pat = '' THEN 0 ELSE strpos(t, matched) END AS pos FROM z),
    b AS (SELECT *, list_transform(co, lambda p: {_FIND.format(p='p')}) AS places FROM a),
    c AS (SELECT *, list_sum(list_transform(places, lambda p, i: CASE WHEN p > 0 THEN 1 << (i - 1)::INT ELSE 0 END))::BIGINT AS m, len(list_filter(places, lambda p: p > 0 AND NOT (p >= pos AND p < pos + length(matched)))) > 0 AS outside FROM b),
    e AS (SELECT *, coalesce(bool_or(pos > 0) OVER w, false) AS hb, coalesce(bit_or(coalesce(m, 0)) OVER w, 0) AS mb, string_split_regex(t[greatest(pos - 40, 1):pos - 1], '{D.CLAUSE}')[-1] AS l, t[pos + length(matched):pos + length(matched) + 39] AS r FROM c WINDOW w AS (PARTITION BY conv_id, flag ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    g AS (SELECT *, s = 'urgent' AND CASE WHEN pos > 0 THEN outside OR (mb & ~coalesce(m, 0)) <> 0 ELSE coalesce(m, 0) <> 0 END AS grows,
      CASE WHEN pos > 0 AND s = 'urgent' THEN CASE WHEN {' OR '.join(f"regexp_matches(l, '{p}')" for p in NEGATIONS)} THEN 'negated' WHEN {' OR '.join(f"regexp_matches({c}, '{p}')" for p in PAST for c in 'lr')} THEN 'past' END END AS suppressed FROM e)
    SELECT conv_id, turn, flag, CASE WHEN grows AND suppressed IS NULL THEN 'emergency' ELSE s END AS severity, matched, (grows AND suppressed IS NULL)::INT AS escalated, (pos = 0)::INT AS from_history, suppressed FROM g WHERE pos > 0 OR (hb AND grows)""")
def r13(spark, d):
    return D.screen(t(spark, d, "conversations"), "conv_id", "turn", "text", FLAGS, NEGATIONS, PAST)
