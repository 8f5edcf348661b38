"""Repair of the role structure of conversations by dynamic programming over a shared grammar.

Each row of a conversation becomes one symbol: the class of its role (s, u, a or another) and whether it is
truncated (upper case) or must go (X). A Re-Pair grammar over the symbols of all conversations names pairs that
recur. A symbol has a transfer matrix: for each two states of the roles so far, the cheapest edits that lead from
one to the other, with their letters as a rope. A rule's matrix is the min-plus product of its two sides, so each
is worked out once, bottom-up, and every conversation that contains the rule shares it.

Of equally cheap edits the ASCII-least letters win. That choice passes through products: every letter but I uses up
one row, so of two equally cheap strings over the same rows neither begins with the other.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby, pairwise

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolane.llm.common import durable, forget, ship

#: States: nothing yet, after s, after u, after a. The pattern (s?(ua)+)? ends in the first or the last.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
ENDS = (START, AFTER_A)
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
TERMINALS = "suaoSUAOX"
#: Rules are named by characters of a private range, of which there are 6,400.
FIRST_RULE, RULES = 0xE000, 6400
SPACE = r"\x20\x09-\x0D"
STATS = ["n_rows", "blank", "duplicate", "truncated", "illegal", "n_turns"]
Rope = tuple  # (length, hash, letters) or (length, hash, left, right)
Entry = tuple  # (cost, rope)

MODULUS, BASE = (1 << 61) - 1, 1_000_003


def damage(rows: DataFrame) -> DataFrame:
    """rows with faults planted by crc32 of `conv_id:turn` modulo 20; nulls of role, text, conv_id or turn read as one space there."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(as_text("text"), "[.!?]", "")).otherwise(as_text("text"))
    role = F.when(kind == 4, "user").otherwise(as_text("role"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("__copy")).drop("__copy")


def repair(rows: DataFrame, rounds: int = 12, rules_a_round: int = 64, rows_a_fragment: int = 4096, chars_a_fragment: int = 4_000_000) -> DataFrame:
    """Fragments of repaired conversations: conv_id, frag (in order), audit, cost, roles, texts, and what was found in the rows.

    rows: conv_id, turn, role, text. A conversation's rows are taken by turn, nulls first; rows of one turn by role,
    then by the first 64 characters and the digest of the text. A conversation is one fragment but for those that
    exceed the two bounds or cross a partition, so a conversation of any length is spread over tasks; its
    fragments' matrices meet in one task, with about 20 letters for each of its rows.

    A null role or text is one space. A null conv_id is a conversation of its own. Repeated rows are duplicates, all
    but the first. Extra columns are ignored. An empty table gives no fragment.
    """
    ship(rows.sparkSession)
    fragments = _fragments(rows, rows_a_fragment, chars_a_fragment)
    rules = grammar(fragments, rounds, rules_a_round)
    solver = Solver(rules)

    whole = fragments.filter("not cut").mapInArrow(_solve_whole(solver, fragments.columns), _solved_schema(fragments))
    parts = fragments.filter("cut")
    if parts.isEmpty():
        return whole
    conv = fragments.schema["conv_id"].dataType.simpleString()
    slim = parts.select("conv_id", "frag", "symbols").mapInArrow(_matrices(solver), f"conv_id {conv}, frag long, symbols string, costs array<long>, audits array<string>")
    slim = slim.repartition("conv_id").sortWithinPartitions("conv_id", "frag").mapInArrow(_chain(), f"conv_id {conv}, frag long, state int, audit string")
    slices = durable(slim).withColumnsRenamed({"conv_id": "__c", "frag": "__f"})
    parts = parts.join(slices, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("frag") == F.col("__f"))).drop("__c", "__f")
    return whole.unionByName(parts.mapInArrow(_apply(parts.columns), _solved_schema(fragments)))


def summaries(fragments: DataFrame) -> DataFrame:
    """One row for each conversation of repair(): gaps, counts of faults, cost, audit, and the SHA-256 of its repaired rows.

    A conversation in one fragment is summed up in place. The others are read in order, in one task for each
    conversation since a digest is sequential, a fragment at a time.
    """
    conv = fragments.schema["conv_id"].dataType.simpleString()
    lines = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns"), F.lit(0)).cast("long")
    names = ["blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    whole = fragments.filter("not cut").select("conv_id", gaps.alias("gaps"), *names, F.sha2(lines, 256).alias("repaired_sha256"))
    parts = fragments.filter("cut").repartition("conv_id").sortWithinPartitions("conv_id", "frag")
    schema = f"conv_id {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return whole.unionByName(parts.mapInArrow(_sum_up(parts.columns), schema))


def for_every(ids: DataFrame, found: DataFrame) -> DataFrame:
    """found, with a row for each conversation of ids that has none: zeros, an empty audit and the digest of nothing."""
    every = ids.select(F.col("conv_id").alias("__c")).distinct()
    out = every.join(found, F.col("__c").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").withColumnRenamed("__c", "conv_id")
    none = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return out.select("conv_id", *(F.coalesce(F.col(c), F.lit(none.get(c, 0))).alias(c) for c in found.columns if c != "conv_id"))


def _fragments(rows: DataFrame, most_rows: int, most_chars: int) -> DataFrame:
    blank_if_null = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    base = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), blank_if_null("role"), blank_if_null("text"))
    base = durable(base.withColumns({"rid": F.monotonically_increasing_id(), "digest": F.unhex(F.sha2("text", 256))}))
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"), F.col("rid"))
    seen = base.groupBy("conv_id", "role", "digest").agg(F.min(when)["rid"].alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    seen = seen.select(F.col("conv_id").alias("__c"), F.col("role").alias("__r"), F.col("digest").alias("__d"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("role") == F.col("__r")) & (F.col("digest") == F.col("__d"))
    marked = base.join(seen, same, "left").withColumn("again", F.coalesce(F.col("first") != F.col("rid"), F.lit(False)))
    fault = F.when(~F.col("text").rlike(f"[^{SPACE}]"), "b").when(F.col("again"), "d").when(F.col("text").rlike(rf"[^{SPACE}.!?][{SPACE}]*\z"), "t").otherwise("")
    order = ["conv_id", "turn", "role", F.substring("text", 1, 64), "digest", "rid"]
    marked = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    conv = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {conv}, frag long, cut boolean, symbols string, roles array<string>, texts array<string>, " + ", ".join(f"{c} long" for c in STATS) + ", first_turn long, last_turn long, first_initial string, last_initial string"
    out = durable(marked.select("conv_id", "turn", "role", "text", fault.alias("fault")).mapInArrow(_build(most_rows, most_chars), schema))
    forget(base)
    return out


def _table(rows: list[dict], like: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=like)


_FIELDS = [("frag", pa.int64()), ("cut", pa.bool_()), ("symbols", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), *((c, pa.int64()) for c in STATS), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("first_initial", pa.string()), ("last_initial", pa.string())]


def _build(most_rows: int, most_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, like, now, chars, first = TaskContext.get().partitionId() << 33, None, None, 0, True
        for batch in batches:
            like = like or pa.schema([("conv_id", batch.schema.field(0).type), *_FIELDS])
            done = []
            for conv, turn, role, text, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                full = now and (now["n_rows"] >= most_rows or chars + len(text) > most_chars)
                if now and (full or now["conv_id"] != conv):
                    goes_on = now["conv_id"] == conv
                    done.append(now | {"cut": now["cut"] or goes_on})
                    now, first = None, goes_on
                if now is None:
                    number, chars = number + 1, 0
                    now = {"conv_id": conv, "frag": number, "cut": first, "symbols": "", "roles": [], "texts": [], **dict.fromkeys(STATS, 0), "first_turn": None, "last_turn": None, "first_initial": role[:1], "last_initial": None}
                _add(now, turn, role, text, fault)
                chars += len(text)
            if done:
                yield _table(done, like)
        if now:  # the conversation may go on in the next partition
            yield _table([now | {"cut": True}], like)

    return run


def _add(f: dict, turn: int | None, role: str, text: str, fault: str) -> None:
    initial = role[:1]
    kind = initial if initial in ("s", "u", "a") else "o"
    f["symbols"] += "X" if fault in ("b", "d") else kind.upper() if fault == "t" else kind
    f["n_rows"] += 1
    if fault:
        f[{"b": "blank", "d": "duplicate", "t": "truncated"}[fault]] += 1
    f["illegal"] += f["last_initial"] is not None and f["last_initial"] + initial not in ("su", "ua", "au")
    if turn is not None:
        f["n_turns"] += turn != f["last_turn"]
        f["first_turn"], f["last_turn"] = turn if f["first_turn"] is None else f["first_turn"], turn
    f["last_initial"] = initial
    f["roles"].append(role)
    f["texts"].append(text)


def grammar(fragments: DataFrame, rounds: int, rules_a_round: int) -> list[str]:
    """Re-Pair over the symbols of all fragments: rule k stands for the pair of symbols rules[k].

    In each round every task counts the pairs that are next to each other, the counts meet, and the most
    frequent become rules. Rounds end when no pair occurs twice. rounds times rules_a_round bounds the grammar, not
    the sequences: what has no rule stays as it is.
    """
    texts = durable(fragments.groupBy("symbols").agg(F.count(F.lit(1)).alias("n")))
    rules: list[str] = []
    for _ in range(rounds):
        room = min(rules_a_round, RULES - len(rules))
        counts = texts.mapInArrow(_pairs(list(rules)), "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).filter("n > 1")
        best = counts.orderBy(F.desc("n"), "pair").limit(room).collect()
        rules += [r.pair for r in best]
        if len(best) < room:
            break
    forget(texts)
    return rules


def compress(symbols: str, rules: list[str]) -> str:
    for k, pair in enumerate(rules):
        if len(symbols) < 2:
            break
        symbols = symbols.replace(pair, chr(FIRST_RULE + k))
    return symbols


def _pairs(rules: list[str]):
    def run(batches):
        counts: Counter[str] = Counter()
        for batch in batches:
            for symbols, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for a, b in pairwise(compress(symbols, rules)):
                    counts[a + b] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["pair", "n"])

    return run


def leaf(letters: str) -> Rope:
    h = 0
    for c in letters:
        h = (h * BASE + ord(c)) % MODULUS
    return len(letters), h, letters


def join(a: Rope, b: Rope) -> Rope:
    if not a[0] or not b[0]:
        return a if a[0] else b
    return a[0] + b[0], (a[1] * pow(BASE, b[0], MODULUS) + b[1]) % MODULUS, a, b


def letters(rope: Rope) -> str:
    out, stack = [], [rope]
    while stack:
        x = stack.pop()
        if len(x) == 3:
            out.append(x[2])
        else:
            stack += [x[3], x[2]]
    return "".join(out)


def before(a: Rope, b: Rope) -> bool:
    """Whether a's letters come before b's. Parts of one length and hash are passed over; the first that differ are opened."""
    left, right = [a], [b]
    while left and right:
        x, y = left.pop(), right.pop()
        if x[:2] == y[:2]:
            continue
        if len(x) == 3 and len(y) == 3:
            n = min(x[0], y[0])
            if x[2][:n] != y[2][:n]:
                return x[2][:n] < y[2][:n]
            left += [leaf(x[2][n:])] * (x[0] > n)
            right += [leaf(y[2][n:])] * (y[0] > n)
        elif len(y) == 3 or len(x) == 4 and x[0] >= y[0]:
            left += [x[3], x[2]]
            right.append(y)
        else:
            left.append(x)
            right += [y[3], y[2]]
    return bool(right) and not left


def better(a: Entry | None, b: Entry | None) -> Entry | None:
    if a is None or b is None:
        return a or b
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return b if before(b[1], a[1]) else a


def times(row: list, matrix: list[list]) -> list:
    """The min-plus product of a row of entries with a matrix; None stands for no way."""
    out = [None] * 4
    for r, head in enumerate(row):
        if head is not None:
            for q, tail in enumerate(matrix[r]):
                if tail is not None and (out[q] is None or head[0] + tail[0] <= out[q][0]):
                    out[q] = better(out[q], (head[0] + tail[0], join(head[1], tail[1])))
    return out


def product(a: list[list], b: list[list]) -> list[list]:
    return [times(row, b) for row in a]


def _matrix(entries: dict[tuple[int, int], tuple[int, str]]) -> list[list]:
    return [[(e[0], leaf(e[1])) if (e := entries.get((p, q))) else None for q in range(4)] for p in range(4)]


#: The cheapest insertions that lead from one state to another.
INSERTS = _matrix({(p, p): (0, "") for p in range(4)} | {(p, AFTER_U): (INSERT, "I") for p in (START, AFTER_S, AFTER_A)} | {(AFTER_U, AFTER_A): (INSERT, "I")} | {(p, AFTER_A): (2 * INSERT, "II") for p in (START, AFTER_S)})


def terminal(symbol: str) -> list[list]:
    """Insertions, then the row of this symbol."""
    row = {(p, p): (DELETE, "D") for p in range(4)}
    late = TRUNCATED * (symbol in "SUAO")
    step = {(START, AFTER_U): "u", (AFTER_S, AFTER_U): "u", (AFTER_A, AFTER_U): "u", (AFTER_U, AFTER_A): "a"}
    if symbol != "X":
        row |= {ends: (late, "K") if role == symbol.lower() else (REROLE + late, "R") for ends, role in step.items()}
        if symbol.lower() == "s":
            row[START, AFTER_S] = (late, "K")
    return product(INSERTS, _matrix(row))


class Solver:
    """The matrices of all symbols, worked out once; rules are bounded by the grammar's parameters."""

    def __init__(self, rules: list[str]):
        self.rules = rules
        self.matrices = {x: terminal(x) for x in TERMINALS}
        for k, (a, b) in enumerate(rules):
            self.matrices[chr(FIRST_RULE + k)] = product(self.matrices[a], self.matrices[b])

    def transfer(self, symbols: str) -> list[list]:
        out = [[(0, leaf("")) if p == q else None for q in range(4)] for p in range(4)]
        for x in compress(symbols, self.rules):
            out = product(out, self.matrices[x])
        return out

    def audit(self, symbols: str) -> str:
        row = [(0, leaf("")), None, None, None]
        for x in compress(symbols, self.rules):
            row = times(row, self.matrices[x])
        return finish(row)


def finish(row: list) -> str:
    row = times(row, INSERTS)
    return letters(better(row[ENDS[0]], row[ENDS[1]])[1])


def moved(state: int, letter: str, symbol: str) -> int:
    """The state after a letter of the audit; symbol is that of the row which the letter uses up."""
    if letter == "D":
        return state
    if letter == "K":
        return {"s": AFTER_S, "u": AFTER_U, "a": AFTER_A}[symbol.lower()]
    return AFTER_A if state == AFTER_U else AFTER_U


def edited(state: int, audit: str, symbols: str, roles: list[str], texts: list[str]) -> tuple[int, list[str], list[str]]:
    """Cost, roles and texts after the edits of an audit, from a state on."""
    cost, i, new_roles, new_texts = 0, 0, [], []
    for letter in audit:
        symbol = symbols[i] if letter != "I" else ""
        state = moved(state, letter, symbol)
        late = TRUNCATED * (symbol in tuple("SUAO"))
        cost += {"D": DELETE, "I": INSERT, "K": late, "R": REROLE + late}[letter]
        if letter != "D":
            new_roles.append(roles[i] if letter == "K" else "assistant" if state == AFTER_A else "user")
            new_texts.append("" if letter == "I" else texts[i])
        i += letter != "I"
    return cost, new_roles, new_texts


def _solved_schema(fragments: DataFrame) -> str:
    return ", ".join(f"{n} {t}" for n, t in fragments.drop("symbols").dtypes) + ", cost long, audit string"


def _rows(batch: pa.RecordBatch, names: list[str]) -> Iterator[dict]:
    for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        yield dict(zip(names, values, strict=True))


def _solved(f: dict, state: int, audit: str) -> dict:
    cost, roles, texts = edited(state, audit, f["symbols"], f["roles"], f["texts"])
    return f | {"cost": cost, "audit": audit, "roles": roles, "texts": texts}


def _solved_like(first: pa.DataType) -> pa.Schema:
    return pa.schema([("conv_id", first), *(x for x in _FIELDS if x[0] != "symbols"), ("cost", pa.int64()), ("audit", pa.string())])


def _solve_whole(solver: Solver, names: list[str]):
    def run(batches):
        known: dict[str, str] = {}
        for batch in batches:
            out = []
            for f in _rows(batch, names):
                audit = known.get(f["symbols"])
                if audit is None:
                    audit = solver.audit(f["symbols"])
                    if len(known) < 100_000 and len(audit) < 100:
                        known[f["symbols"]] = audit
                out.append(_solved(f, START, audit))
            yield _table(out, _solved_like(batch.schema.field(0).type))

    return run


def _matrices(solver: Solver):
    def run(batches):
        for batch in batches:
            found = [[e for row in solver.transfer(s) for e in row] for s in batch.column(2).to_pylist()]
            costs = pa.array([[e and e[0] for e in m] for m in found], pa.list_(pa.int64()))
            audits = pa.array([[e and letters(e[1]) for e in m] for m in found], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, costs, audits], names=["conv_id", "frag", "symbols", "costs", "audits"])

    return run


def _in_order(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[Iterator[dict]]:
    """The rows of each conversation, one after the other."""
    for _, rows in groupby((r for b in batches for r in _rows(b, names)), key=lambda r: r["conv_id"]):
        yield rows


def _chain():
    """Of the fragments of each conversation in order: the state each starts in and its part of the audit."""

    def run(batches):
        batches = iter(batches)
        head = next(batches, None)
        if head is None:
            return
        like = pa.schema([("conv_id", head.schema.field(0).type), ("frag", pa.int64()), ("state", pa.int32()), ("audit", pa.string())])
        for fragments in _in_order((b for part in ([head], batches) for b in part), ["conv_id", "frag", "symbols", "costs", "audits"]):
            row, held = [(0, leaf("")), None, None, None], []
            for f in fragments:
                flat = [None if c is None else (c, leaf(a)) for c, a in zip(f["costs"], f["audits"], strict=True)]
                row = times(row, [flat[4 * p : 4 * p + 4] for p in range(4)])
                held.append((f["conv_id"], f["frag"], f["symbols"]))
            audit, state, at = finish(row), START, 0
            for k, (conv, frag, symbols) in enumerate(held):
                begin, at_state, i = at, state, 0
                while i < len(symbols):
                    state = moved(state, audit[at], symbols[i])
                    i += audit[at] != "I"
                    at += 1
                part = audit[begin:] if k == len(held) - 1 else audit[begin:at]
                yield _table([{"conv_id": conv, "frag": frag, "state": at_state, "audit": part}], like)

    return run


def _apply(names: list[str]):
    def run(batches):
        for batch in batches:
            out = [_solved({n: v for n, v in f.items() if n not in ("state", "audit")}, f["state"], f["audit"]) for f in _rows(batch, names)]
            yield _table(out, _solved_like(batch.schema.field(0).type))

    return run


def _sum_up(names: list[str]):
    def run(batches):
        batches = iter(batches)
        head = next(batches, None)
        if head is None:
            return
        counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
        like = pa.schema([("conv_id", head.schema.field(0).type), *((c, pa.int64()) for c in counts), ("audit", pa.string()), ("repaired_sha256", pa.string())])
        for fragments in _in_order((b for part in ([head], batches) for b in part), names):
            total, digest, audit, turns, initial, some = Counter(), hashlib.sha256(), [], [None, None], None, False
            for f in fragments:
                total.update({c: f[c] for c in (*counts[1:], "n_turns")})
                total["illegal"] += initial is not None and initial + f["first_initial"] not in ("su", "ua", "au")
                if f["first_turn"] is not None:
                    total["n_turns"] -= turns[1] == f["first_turn"]
                    turns = [f["first_turn"] if turns[0] is None else turns[0], f["last_turn"]]
                initial, conv = f["last_initial"], f["conv_id"]
                audit.append(f["audit"])
                for role, text in zip(f["roles"], f["texts"], strict=True):
                    digest.update((("\n" if some else "") + f"{role}:{text}").encode())
                    some = True
            gaps = 0 if turns[0] is None else turns[1] - turns[0] + 1 - total["n_turns"]
            yield _table([{"conv_id": conv, "gaps": gaps, **{c: total[c] for c in counts[1:]}, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], like)

    return run
