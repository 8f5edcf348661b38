"""Conversation repair against enumeration of all edits, and against a plain program over whole conversations."""

import hashlib
import re
import zlib
from itertools import product

import numpy as np
import pytest

from chronolane.llm import conversations as cv
from chronolane.llm import queries

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def cheapest(symbols):
    """All edits of up to a few rows, with up to two insertions before each and after the last: the cheapest, ASCII-least."""
    best = None
    for marks in product("KDua", repeat=len(symbols)):
        if any(m == "K" and x == "X" or m in "ua" and x == "X" for m, x in zip(marks, symbols, strict=True)):
            continue
        for inserts in product(["", "u", "a", "ua", "au"], repeat=len(symbols) + 1):
            seq, audit, cost = "", "", 0
            for k, gap in enumerate(inserts):
                seq, audit, cost = seq + gap, audit + "I" * len(gap), cost + 2 * len(gap)
                if k < len(symbols):
                    m, x = marks[k], symbols[k]
                    seq += "" if m == "D" else x.lower() if m == "K" else m
                    audit += "R" if m in "ua" else m
                    cost += 3 if m == "D" else 2 * (m in "ua") + (x in "SUAO")
            if re.fullmatch("(s?(ua)+)?", seq) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def plain(rows):
    """The contract's columns by one pass over a conversation's rows (turn, role, text), and a table of states over its rows."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    seen, symbols, count = set(), "", dict.fromkeys("bdt", 0)
    for _, role, text in rows:
        last = text.rstrip(SPACE)
        fault = "b" if not last.lstrip(SPACE) else "d" if (role, text) in seen else "t" if last[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            count[fault] += 1
        kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
        symbols += "X" if fault in ("b", "d") else kind.upper() if fault else kind
    step = {("", "u"), ("s", "u"), ("a", "u"), ("u", "a"), ("", "s")}
    states = {"": (0, "", [])}

    def insert(states):
        for _ in range(3):
            for p, (c, w, out) in list(states.items()):
                for q, name in (("u", "user"), ("a", "assistant")):
                    if (p, q) in step and (q not in states or (c + 2, w + "I") < states[q][:2]):
                        states[q] = c + 2, w + "I", [*out, f"{name}:"]
        return states

    for (_, role, text), x in zip(rows, symbols, strict=True):
        new = {}
        for p, (c, w, out) in insert(states).items():
            late, choices = x in "SUAO", [(p, c + 3, w + "D", out)]
            if x != "X":
                choices += [(q, c + 2 + late, w + "R", [*out, f"{n}:{text}"]) for q, n in (("u", "user"), ("a", "assistant")) if (p, q) in step]
                choices += [(role[:1], c + late, w + "K", [*out, f"{role}:{text}"])] * ((p, role[:1]) in step)
            for q, *rest in choices:
                if q not in new or tuple(rest[:2]) < new[q][:2]:
                    new[q] = tuple(rest)
        states = new
    cost, audit, out = min((v for q, v in insert(states).items() if q in ("", "a")), key=lambda v: v[:2])
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, count["b"], count["d"], count["t"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        say = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        role, text = "user" if kind == 4 else say(role), "" if kind == 1 else re.sub("[.!?]", "", say(text)) if kind == 2 else say(text)
        out.setdefault(conv, []).extend([(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1))
    return out


def got(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


@pytest.mark.parametrize("rules", [[], ["ua", "uu", "XX"], ["ua", "\ue000\ue000", "au", "SX", "\ue001u"]])
def test_matrices_find_the_cheapest_and_least_edits(rules):
    solver = cv.Solver(rules)
    rng = np.random.default_rng(3)
    cases = {"", "X", "s", "ss", "us", "uau", "aua", "UAX", "oOs", "uuu", "XXX", "suu"} | {"".join(rng.choice(list(cv.TERMINALS), 3)) for _ in range(25)} | {"uaua", "SUXa", "saau"}
    for symbols in cases:
        audit = solver.audit(symbols)
        cost = cv.edited(0, audit, symbols, list(symbols), list(symbols))[0]
        assert (cost, audit) == cheapest(symbols), symbols


def test_ropes_order_as_their_letters():
    rng = np.random.default_rng(5)

    def rope(s):
        if len(s) < 2 or rng.random() < 0.3:
            return cv.leaf(s)
        k = int(rng.integers(0, len(s) + 1))
        return cv.join(rope(s[:k]), rope(s[k:]))

    for _ in range(300):
        a, b = ("".join(rng.choice(list("DK"), int(rng.integers(0, 9)))) for _ in range(2))
        assert cv.letters(rope(a)) == a and cv.before(rope(a), rope(b)) == (a < b)
    same = cv.join(cv.leaf("D" * 50), cv.leaf("K" * 50))
    assert not cv.before(same, cv.join(cv.leaf("D" * 20), cv.leaf("D" * 30 + "K" * 50)))


def test_query_equals_a_plain_program(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = damaged(rows)
    assert got(queries.op12_conversation_repair(spark, SF)) == {c: plain(want.get(c, [])) for c in {r[0] for r in rows}}


@pytest.mark.parametrize("bounds", [{}, {"rows_a_fragment": 3}, {"chars_a_fragment": 10, "rounds": 2, "rules_a_round": 3}])
def test_edges_and_cut_conversations(spark, bounds):
    rng = np.random.default_rng(7)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "uncle"], ["a.", "b", "", None, " \n", "why? ", "x" * 20000, "same.", " .", "a.b\n"]
    rows = [(1, None, "user", "a."), (1, None, "user", "a."), (1, 2, None, None), (None, 3, "user", "hi."), (None, None, "assistant", "yes."), (-5, 7, "system", "only.")]
    rows += [(c, int(t) if rng.random() < 0.9 else None, roles[rng.integers(7)], texts[rng.integers(10)]) for c in range(10, 40) for t in rng.permutation(int(rng.integers(1, 30)))]
    rows += [(99, t, "user" if t % 2 else "assistant", f"turn {t % 50}.") for t in range(500)]  # the hot one: most of its rows are copies
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, frag int")
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t, " " if r is None else r, " " if x is None else x))
    # rows of one turn go by role, text prefix and digest: let the plain program see them in that order
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.sha256(r[2].encode()).digest())
    want = {c: plain(sorted(v, key=order)) for c, v in by.items()}
    out = cv.repair(frame, **bounds)
    assert got(cv.for_every(frame, cv.summaries(out))) == want
    longest = max(len(r.roles) for r in out.select("roles").collect())
    assert not bounds or longest <= 3 * bounds.get("rows_a_fragment", 9)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cv.summaries(cv.repair(empty)).count() == 0
    ids = spark.createDataFrame([(1,), (None,)], "conv_id long")
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got(cv.for_every(ids, cv.summaries(cv.repair(empty)))) == {1: none, None: none}
