"""Each operator against brute force, on edge frames and on the smallest tables."""

import hashlib
import os
import sys
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
from oracle import connect, same

from chronolane.llm import decontaminate, exact_dedup, line_dedup, lm_score, ngram_join, packing, quality, queries, substring_dedup, token_counts, toxicity
from chronolane.llm.components import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, token string, word string, n long, row_id long, row long"
LONG = "word " * 30000
EDGE = [(1, "same  text\nhere"), (2, "same text here"), (3, None), (4, ""), (5, LONG), (6, "Ünïcode <|endoftext|> d's\x1c  x"), (7, "a" * 5000), (8, "same text here"), (9, " \n "), (10, "one two three"), (11, "ONE two three")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, "en", "clash", "clash", 1, 1, 1) for i, t in EDGE], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(queries.tokenizer_path())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    same(spark, connect(SF), queries.QUERIES[name], queries.ORACLES[name], SF)


def test_every_operator_takes_an_empty_table(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    path = queries.tokenizer_path()
    outs = [token_counts.token_counts(empty, path), exact_dedup.exact_duplicates(empty), line_dedup.line_dedup(empty), packing.pack(empty, path), lm_score.lm_scores(empty), ngram_join.near_duplicates(empty), quality.quality_scores(empty, labels), decontaminate.contamination(empty, bench), toxicity.toxicity_scores(empty, labels), substring_dedup.repeated_substrings(empty)]
    assert [o.count() for o in outs] == [0] * 10


def test_token_counts(edge, tokenizer):
    want = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in EDGE}
    for options in ({}, {"chunk": 100, "overlap": 8}):
        got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(edge, queries.tokenizer_path(), **options).collect()}
        assert got == want


@pytest.mark.parametrize("chunk", [7, 50, 333])
def test_chunks_splice_to_the_whole(tokenizer, chunk):
    text = "x" * 400 + " some  words\n\n and <|endoftext|> more, d's " * 20 + "y" * 300
    ends = lambda s: [b for _, b in tokenizer.encode(s, add_special_tokens=False).offsets]
    assert token_counts.count_chunked(text, ends, chunk, 3) == len(ends(text))


def test_odd_white_space_is_cut_only_where_it_is_safe(spark, tokenizer):
    rng = np.random.default_rng(11)
    odd = [" ", "\n", "a", "é", "1", ".", "\xa0", "\u3000", "\u200b", "\ufeff", "\x0b", "\x85", "\u2009", "<|endoftext|>", "'s", "\u00a0 ", " \u2028", "\x1c"]
    texts = ["".join(rng.choice(odd, 60)) for _ in range(300)] + ["word\xa0 here " * 4000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    for options in ({}, {"chunk": 25, "overlap": 4}):
        got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(frame, queries.tokenizer_path(), **options).collect()}
        assert [got[i] for i in range(len(texts))] == want
    assert len(token_counts.pieces_of(texts[-1])) > 4000


def test_packed_ids_are_the_librarys_for_a_whole_table(spark, tokenizer):
    encode = packing.encoder(queries.tokenizer_path())
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        assert encode(r.text or "") == tokenizer.encode(r.text or "", add_special_tokens=False).ids
    assert packing.follows_merges({**{chr(i): i for i in range(256)}, "ab": 256, "abc": 257}, ["a b", "ab c"], {})
    assert not packing.follows_merges({**{chr(i): i for i in range(256)}, "ab": 257, "abc": 256}, ["a b", "ab c"], {})


def test_packing_with_equal_lengths_and_repeated_rows(spark):
    rows = [(i % 5, "same words here") for i in range(40)] + [(None, None), (None, None)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), queries.tokenizer_path(), capacity=8).collect()
    fill = defaultdict(list)
    for r in got:
        fill[r.sequence_id].append((r.offset, r.length))
    assert len(got) == 42 and all(sum(n for _, n in x) <= 8 and [o for o, _ in sorted(x)] == [sum(n for _, n in sorted(x)[:k]) for k in range(len(x))] for x in fill.values())
    assert len(fill) == 21  # two of four tokens each, and the two of one token beside them or in one more


def test_exact_duplicates(edge):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(edge).collect()}
    assert got[8] == (1, 3, False) and got[2] == (1, 3, False) and got[1] == (1, 3, True) and got[4] == (3, 2, False) and got[9] == (9, 1, True)
    assert {r.doc_id for r in exact_dedup.keep_first(edge).collect()} == {1, 3, 5, 6, 7, 9, 10, 11}
    for options in ({"runs": 1}, {"runs": 5, "fan_in": 3}, {"runs": 64, "fan_in": 2}):
        again = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(edge.repartition(7), **options).collect()}
        assert again == got


def test_one_of_rows_that_repeat_id_and_text_stays(spark):
    rows = [(5, "a", "x"), (5, "a", "y"), (5, "b", "x"), (None, "a", "x"), (None, "c", "x"), (None, "c", "x"), (7, None, "x"), (7, "", "x"), (8, "a", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, run string")
    got = sorted(((r.doc_id, r.text or "") for r in exact_dedup.keep_first(frame).collect()), key=str)
    assert got == sorted([(5, "a"), (5, "b"), (None, "c"), (7, "")], key=str)


def test_null_ids_do_not_win(spark):
    rows = exact_dedup.exact_duplicates(spark.createDataFrame([(None, "a"), (5, "a"), (5, "a")], "doc_id long, text string")).collect()
    assert {r.keep_id for r in rows} == {5} and sorted(r.kept for r in rows) == [False, True, True]


def test_line_chunks_that_repeat_go_once(spark):
    block = "\n".join(f"line {i}" for i in range(40))
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame([(1, block), (2, "other\n" + block), (3, None)], "doc_id long, text string")).collect()}
    assert got[1].text == block and got[1].n_removed_lines == 0 and 20 <= got[2].n_removed_lines <= 40 and got[3].text == ""


def test_line_runs_go_wherever_they_begin(spark):
    rng = np.random.default_rng(5)
    passage = [f"passage {i}" for i in range(7)]
    source = {1: "\n".join(passage), 2: "\n".join(["own a", *passage[2:5], "own b"]), 3: "x\ny", 4: "q\nx\ny", 5: None, 6: "", 7: "passage 0", 8: "z\nz\nz\nz"}
    source |= {i: "\n".join(rng.choice(list("abcdefgh"), int(rng.integers(1, 30)))) for i in range(10, 40)}
    seen, want = set(), {}
    for i, t in source.items():
        lines, gone = (t or "").split("\n"), set()
        for k in range(len(lines) - 1):
            if (lines[k], lines[k + 1]) in seen:
                gone |= {k, k + 1}
            seen.add((lines[k], lines[k + 1]))
        want[i] = (len(lines), len(gone), sum(k - 1 not in gone for k in gone), "\n".join(x for k, x in enumerate(lines) if k not in gone))
    assert want[2] == (5, 3, 1, "own a\nown b") and want[4][1] == 2
    rows = line_dedup.line_runs(spark.createDataFrame([*source.items(), (None, source[1])], "doc_id long, text string")).collect()
    got = {r.doc_id: (r.n_lines, r.n_removed_lines, r.n_removed_runs, r.text) for r in rows}
    assert got.pop(None) == (7, 7, 1, "") and got == want  # a row without an id comes after all others


@pytest.mark.parametrize("fn", [line_dedup.line_dedup, line_dedup.line_runs])
def test_lines_of_edge_rows(spark, fn):
    a, b = ("\n".join(f"{x} line {i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (2, b), (2, b), (None, a), (3, None), (4, ""), (5, "word " * 30000), (6, "\n".join(["same"] * 50))]
    frame = spark.createDataFrame([(*r, "en", "clash", "clash", 1, 1, 1) for r in rows], SCHEMA)
    got = [(r.doc_id, r.text) for r in fn(frame).collect()]
    assert len(got) == len(rows) and (1, a) in got and (1, b) in got and (3, "") in got and (4, "") in got and (5, rows[7][1]) in got
    assert all(len(t) < len(b) / 4 for i, t in got if i in (2, None)) and len({t for i, t in got if i == 2}) == 1


def test_packing_is_a_partition_of_the_ids(edge, tokenizer):
    rows = packing.pack(edge, queries.tokenizer_path(), group_size=4).collect()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in EDGE}
    cover, fill = defaultdict(int), defaultdict(list)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(part, dtype="<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        cover[r.doc_id] += r.length
        fill[r.sequence_id].append((r.offset, r.length))
    assert cover == {i: len(x) for i, x in ids.items()}
    for spans in fill.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048


def test_tournament_tree_is_first_fit(tokenizer):
    rng = np.random.default_rng(1)
    lengths = sorted(rng.integers(1, 100, 500).tolist(), reverse=True)
    room, want = [], []
    for n in lengths:
        b = next((i for i, r in enumerate(room) if r >= n), len(room))
        if b == len(room):
            room.append(100)
        room[b] -= n
        want.append(b)
    assert [b for b, _ in packing.first_fit_decreasing(lengths, 100)] == want


def test_language_model(docs, texts):
    rows = lm_score.lm_scores(docs, common_words=50).collect()
    train = Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            train.update([*t.encode().lower().split(), b"\xff"])
    n, v = sum(train.values()), len(train)
    for r in rows:
        words = [*texts[r.doc_id].encode().lower().split(), b"\xff"]
        assert r.n_tokens == len(words) and r.n_known == sum(train[w] > 0 for w in words) and r.train_tokens == n
        assert abs(r.base_score - sum(log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)) < 1e-6 and r.score < 0


def test_trie_distributions_sum_to_one_and_match_direct_escapes():
    text = b"abracadabra abracadabra\xff"
    counts = Counter()
    for k in range(3):
        for i in range(len(text)):
            ctx = (b"\xff" * k + text)[i : i + k]
            counts[k, int.from_bytes(ctx, "big"), text[i]] += 1
    trie = lm_score.Trie([(*key, n) for key, n in counts.items()], 2)
    assert np.allclose((10.0 ** trie.log10.astype(float)).sum(1), 1, atol=1e-4)

    def direct(ctx, byte):
        left, p = set(range(256)), 1.0
        while True:
            seen = {b: n for (k, c, b), n in counts.items() if k == len(ctx) and c == int.from_bytes(ctx, "big") and b in left}
            total, half = sum(seen.values()), 0.5 if len(seen) < len(left) else 0.0
            if byte in seen:
                return p * (seen[byte] - half) / total
            if total:
                p *= half * len(seen) / total
            left -= set(seen)
            if not ctx:
                return p / len(left)
            ctx = ctx[1:]

    line = b"abraxas cab\xff"
    want, history = 0.0, b"\xff\xff"
    for b in line:
        ctx = history[-2:]
        while ctx and (len(ctx), int.from_bytes(ctx, "big")) not in trie.ids:
            ctx = ctx[1:]
        want += log10(direct(ctx, b))
        history += bytes([b])
    assert abs(trie.score([line], segment=4)[0] - want) < 1e-3


@pytest.mark.parametrize(("order", "common_grams"), [(5, 1 << 20), (5, 2000), (3, 0), (1, 50)])
def test_language_model_holds_every_context(spark, texts, order, common_grams):
    some = dict(sorted(texts.items())[:60]) | {i + 10**6: t for i, t in EDGE}
    counts = Counter()
    for i, t in some.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            line = b"\xff" * order + lm_score.model_text((t or "").encode())[1]
            counts.update((k, line[j - k : j], line[j]) for j in range(order, len(line)) for k in range(order + 1))
    trie = lm_score.Trie([(k, int.from_bytes(c, "big"), b, n) for (k, c, b), n in sorted(counts.items())], order)
    assert order < 5 or len(trie.ids) > 32768
    want = dict(zip(some, trie.score([lm_score.model_text((t or "").encode())[1] for t in some.values()]), strict=True))
    rows = lm_score.lm_scores(spark.createDataFrame(list(some.items()), "doc_id long, text string"), order=order, common_grams=common_grams).collect()
    assert len(rows) == len(some) and all(abs(r.score - want[r.doc_id]) < 1e-4 * max(1, abs(want[r.doc_id])) for r in rows)


def brute_components(texts, percent=80):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(spark, docs, texts, edge):
    for frame, source in ((docs, texts), (edge, dict(EDGE))):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(frame).collect()}
        assert got == brute_components(source)


def test_near_duplicates_of_rows_that_repeat_an_id(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(5, a), (3, a + " more"), (5, b), (9, b + " more"), (None, b), (None, "alone it stands here today"), (7, None), (7, None), (2, "short"), (4, "SHORT"), (4, "SHORT")]
    frame = spark.createDataFrame([(*r, "en", "clash", "clash", 1, 1, 1) for r in rows], SCHEMA)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(frame).collect()), key=str)
    want = [(5, 56, 3), (3, 57, 3), (5, 56, 5), (9, 57, 5), (None, 56, 5), (None, 1, None), (7, 0, 7), (7, 0, 7), (2, 1, 2), (4, 1, 2), (4, 1, 2)]
    assert got == sorted(want, key=str)
    kept = sorted(((r.doc_id, r.text) for r in ngram_join.one_of_each(frame).collect()), key=str)
    assert kept == sorted([rows[1], rows[2], rows[5], rows[6], rows[8]], key=str)


@pytest.mark.parametrize("width", [1, 3])
def test_near_duplicates_without_leaders_first(spark, width):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(60):
        words = [f"w{k}" for k in range(80)]
        for k in rng.integers(0, 80, rng.integers(0, 6)):
            words[k] = f"x{rng.integers(0, 30)}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), rounds=0, width=width).collect()}
    assert got == brute_components(dict(rows))


def test_near_duplicates_in_a_dense_group(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for k in rng.integers(0, 120, rng.integers(0, 7)):
            words[k] = f"x{rng.integers(0, 40)}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(dict(rows))


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 300), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 200: 100, 300: 100}


def test_windows_of_any_length(spark, edge):
    bench = spark.createDataFrame([(1, "two THREE"), (2, None), (3, ""), (4, "word " * 13), (5, "here")], "item_id long, text string")
    for block in (1, 1000):
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.contamination(edge, bench, block_windows=block).collect()}
        assert got[10] == (3, 2, 1, True) and got[11] == (3, 2, 1, True) and got[5] == (30000, 30000, 1, True) and got[3] == (0, 0, 0, False) and got[1] == (3, 1, 1, True)


def brute_removed(texts, length):
    raw = {i: (t or "").encode() for i, t in texts.items()}
    seen = Counter(t[k : k + length] for t in raw.values() for k in range(len(t) - length + 1))
    out = {}
    for i, t in raw.items():
        mark = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                mark[k : k + length] = b"\1" * length
        left = bytes(b for b, m in zip(t, mark, strict=True) if not m)
        out[i] = (len(t), len(t) - len(left), sum(1 for k in range(len(t)) if mark[k] and not (k and mark[k - 1])), hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("most", [8192, 3])
def test_repeated_substrings(spark, docs, texts, edge, most):
    rng = np.random.default_rng(9)
    noisy = {i: "".join(rng.choice(list("ab"), 300)) + "shared passage " * int(rng.integers(0, 9)) + "".join(rng.choice(list("ab"), 60)) for i in range(40)}
    for source in (texts, noisy, dict(EDGE)):
        frame = edge if source == dict(EDGE) else spark.createDataFrame([(i, t) for i, t in source.items()], "doc_id long, text string")
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.repeated_substrings(frame, most=most).collect()}
        assert got == brute_removed(source, 200)


def test_repeated_substrings_of_rows_that_repeat_an_id_or_have_none(spark):
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    p = word(301)
    rows = [(1, p + word(50)), (1, word(900)), (2, word(20) + p + word(20)), (None, word(30) + p), (None, p), (None, p), (None, None), (3, word(250)), (3, "short")]
    want = sorted(brute_removed(dict(enumerate(t for _, t in rows)), 200).values())
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.repeated_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == want and sum(w[1] >= 301 for w in want) == 5


def test_long_texts_are_parsed_piece_by_piece():
    rng = np.random.default_rng(6)
    passage = bytes(rng.integers(97, 123, 500).tolist())
    text = bytes(rng.integers(97, 123, 3000).tolist()) + passage + bytes(rng.integers(97, 123, 3000).tolist()) + passage
    found = [x for x in substring_dedup.phrases(text, 200, 64, piece=700)]
    place, trigger, phrase = (np.concatenate(x) for x in zip(*found, strict=True))
    first, more, off = substring_dedup._unpacked(place)
    assert sorted(w for f, m in zip(first, more, strict=True) for w in range(f, f + m + 1)) == list(range(len(text) - 199))
    order = np.argsort(trigger)
    bodies = [text[f : f + m + 200] for f, m in zip(first[order], more[order], strict=True)]
    out = substring_dedup.repeated_windows(trigger[order].view(np.int64), place[order], bodies, 200, 64)
    starts = {int(f + o - a) for i, (f, o) in enumerate(zip(first[order], off[order], strict=True)) for a in np.flatnonzero(out[i])}
    assert starts == {*range(3000, 3301), *range(6500, 6801)}


@pytest.mark.parametrize(("fn", "label"), [(quality.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")])
def test_held_out_accuracy(spark, fn, label):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = fn(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert len(out) > 100 and (out["predicted"] == out[label]).mean() > 0.98 and out["score"].between(0, 1).all()


def test_classifiers_without_labels(spark, edge):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.quality_scores(edge, none).collect()} == {0.5}
    rude = spark.createDataFrame([(1, "you stupid idiot"), (2, "hello")], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in toxicity.toxicity_scores(rude, none, lexicon=("stupid", "Idiot")).collect()} == {1: 1, 2: 0}


def test_the_cut_lies_between_scores_or_beyond_all():
    cut = lambda s, y: toxicity.best_cut(np.array(s), np.array(y))
    assert cut([0.0, 1.0, 3.0, 4.0], [0, 0, 1, 1]) == 2.0
    assert cut([1.0, 1.0, 1.0], [0, 0, 1]) > 1.0 and cut([1.0, 1.0, 1.0], [1, 1, 0]) < 1.0


def test_dependence_is_chosen_from_training_rows():
    rng = np.random.default_rng(3)
    y = (rng.random(900) < 0.3).astype(int)
    votes = np.array([rng.random(900) < np.where(y == 1, 0.6, 0.1) for _ in range(6)]).T.astype(float)
    kind = np.ones(6, dtype=bool)

    def errors(dependent):
        part = np.arange(900) % 3
        fits = [toxicity.fit_voters(votes[part != k], y[part != k], kind, dependent) for k in range(3)]
        return sum(int(((votes[part == k] @ w[:-1] + w[-1] >= 0) != y[part == k]).sum()) for k, w in enumerate(fits))

    found = [errors(d) for d in toxicity.DEPENDENT]
    assert toxicity.choose_dependent(votes, y, kind) == toxicity.DEPENDENT[found.index(min(found))]


def test_repeated_ids_give_one_sample(spark):
    from chronolane.llm.labelled import labelled_sample

    rows = [(7, f"text {i}") for i in range(50)] + [(8, None)]
    labels = spark.createDataFrame([(7, 1), (7, 0), (8, 0)], "doc_id long, toxic int")
    frames = [spark.createDataFrame(r, "doc_id long, text string").repartition(n) for r, n in ((rows, 1), (rows[::-1], 7))]
    got = [sorted((r.doc_id, bytes(r.text), r.label) for r in labelled_sample(f, labels, "toxic", 10, 5, 4).collect()) for f in frames]
    assert got[0] == got[1] and len(got[0]) == len({g[0] for g in got[0]})


@pytest.mark.parametrize("change", [{}, {"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [{"id": 50256, "content": "<|endoftext|>", "special": True, "single_word": False, "lstrip": True, "rstrip": False, "normalized": False}]}])
def test_other_settings_of_a_vocabulary_are_respected(tmp_path, tokenizer, change):
    import json

    with open(queries.tokenizer_path(), encoding="utf-8") as f:
        spec = json.load(f) | change
    path = tmp_path / "changed.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    assert packing.plain_byte_level(spec) == (not change)
    library = type(tokenizer).from_file(str(path))
    encode = packing.encoder(str(path))
    for text in ("Some Text  here", "an <|endoftext|> END", "It's 12,5 é"):
        assert encode(text) == library.encode(text, add_special_tokens=False).ids


def test_null_ids_are_packed_in_groups_of_the_size_asked_for(spark):
    rows = [(None, f"word {i % 9}") for i in range(3000)] + [(5, "same")] * 1000
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), queries.tokenizer_path(), group_size=50).toPandas()
    groups = (out["sequence_id"] // (1 << 32)).value_counts()
    assert len(out) == 4000 and len(groups) == 80 and groups.max() <= 150


def test_pipeline_stages_filter_and_pack(spark, docs, texts):
    import corpus_pipeline as cp

    labels_ok = {r.doc_id for r in cp.drop_toxic(spark, docs, SF).collect()}
    near = {i for i, (_, c) in brute_components(texts).items() if i == c}
    assert {r.doc_id for r in cp.drop_near_copies(spark, docs, SF).collect()} == near
    bad = {r.doc_id for r in queries.op8_decontamination(spark, SF).filter("contaminated").collect()}
    assert {r.doc_id for r in cp.drop_contaminated(spark, docs, SF).collect()} == set(texts) - bad
    toxic = {r.doc_id for r in queries.op9_toxicity(spark, SF).filter("predicted = 1").collect()}
    assert labels_ok == set(texts) - toxic
    packed = {r.doc_id for r in cp.run(spark, SF).select("doc_id").distinct().collect()}
    assert packed <= labels_ok & (set(texts) - bad) and len(packed) > 0.8 * len(texts)


def test_filters_judge_rows_and_not_ids(spark):
    rows = [(None, "you stupid idiot"), (None, "hello there"), (1, "you stupid idiot"), (1, "good day"), (2, "one two three")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {tuple(r) for r in toxicity.clean_documents(frame, none, lexicon=("idiot",)).collect()} == {rows[1], rows[3], rows[4]}
    bench = spark.createDataFrame([(1, "stupid idiot")], "item_id long, text string")
    assert {tuple(r) for r in decontaminate.clean_documents(frame, bench).collect()} == {rows[1], rows[3], rows[4]}


def test_label_model_finds_accuracies_from_votes_alone():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.3
    speaks = [(0.7, 0.02, True), (0.5, 0.05, True), (0.4, 0.1, True), (0.3, 0.3, True), (0.05, 0.6, False), (0.1, 0.7, False)]
    votes = np.array([np.where(truth, rng.random(4000) < on, rng.random(4000) < off) for on, off, _ in speaks]).T.astype(float)
    votes = np.hstack([votes, votes[:, 2:3], votes[:, 2:3]])  # one voter three times
    kind = np.array([k for *_, k in speaks] + [True, True])
    q, accuracy, share = toxicity.label_model(votes, kind)
    assert ((q > 0.5) == truth).mean() > 0.9
    right = [(truth[votes[:, j] == 1] == kind[j]).mean() for j in range(len(kind))]
    assert np.abs(accuracy - right).max() < 0.08
    assert np.allclose(share[[2, 6, 7]], 1 / 3, atol=0.02) and share[0] > 0.9


def test_label_model_equals_loops():
    rng = np.random.default_rng(2)
    votes, kind = (rng.random((60, 5)) < 0.4).astype(float), np.array([True, True, False, True, False])
    q, _, _ = toxicity.label_model(votes, kind, rounds=4)
    p = [0.9 if sum(v * (1 if k else -1) for v, k in zip(row, kind, strict=True)) > 0 else 0.1 for row in votes]
    for _ in range(4):
        prior = sum(p) / len(p)
        on = [(sum(a * row[j] for a, row in zip(p, votes, strict=True)) + 0.5) / (sum(p) + 1) for j in range(5)]
        off = [(sum((1 - a) * row[j] for a, row in zip(p, votes, strict=True)) + 0.5) / (len(p) - sum(p) + 1) for j in range(5)]
        new = []
        for row in votes:
            one, two = prior, 1 - prior
            for j in range(5):
                one *= on[j] if row[j] else 1 - on[j]
                two *= off[j] if row[j] else 1 - off[j]
            new.append(one / (one + two))
        p = new
    assert np.allclose(q, p, atol=1e-9)


def test_bradley_terry_is_at_the_minimum_of_its_loss():
    rng = np.random.default_rng(3)
    good, bad = rng.normal(0.4, 1, (50, 3)), rng.normal(0, 1, (40, 3))
    w = quality.bradley_terry(good, bad, pairs=500, penalty=0.01)
    draw = np.random.default_rng(5)
    pairs = list(zip(draw.integers(0, 50, 500).tolist(), draw.integers(0, 40, 500).tolist(), strict=True))

    def loss(v):
        return sum(np.log1p(np.exp(-(good[i] - bad[j]) @ v)) for i, j in pairs) / len(pairs) + 0.005 * (v @ v)

    assert all(loss(w) <= loss(w + e * np.eye(3)[k]) for k in range(3) for e in (-0.01, 0.01)) and np.all(w > 0)


@pytest.mark.parametrize(("fn", "label"), [(quality.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")])
def test_fitted_classifiers_on_edge_rows(spark, edge, fn, label):
    rows = [(100 + i, f"you stupid idiot number {i} !!!" if i % 2 else f"The weather of day {i} was fine, and we walked home.") for i in range(60)]
    docs = edge.unionByName(spark.createDataFrame([(*r, "en", "clash", "clash", 1, 1, 1) for r in [*rows, (None, None), (101, rows[1][1]), (102, rows[1][1])]], SCHEMA))
    labels = spark.createDataFrame([(100 + i, i % 2, i % 2, "clash") for i in range(60)] + [(None, 1, 1, "x"), (103, None, None, "x")], "doc_id long, quality int, toxic int, text string")
    out = fn(docs, labels).collect()
    assert len(out) == len(EDGE) + 63 and all(0 <= r.score <= 1 for r in out)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert {r.score for r in by[101]} | {by[102][0].score, by[102][1].score} >= {by[101][0].score}  # equal texts score alike
    assert len({r.score for r in by[101]}) == 1 and by[3][0].score == by[4][0].score == by[None][0].score
    if label == "toxic":
        assert all(r.predicted == (r.doc_id % 2) for r in out if r.doc_id and r.doc_id >= 104 and r.doc_id < 160)


def test_windows_in_many_blocks_equal_one_block(spark):
    rng = np.random.default_rng(7)
    word = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 30, n))
    items = [(i, word(int(rng.integers(1, 25)))) for i in range(20)] + [(99, None)]
    docs = [(i, f"{word(10)} {items[i % 20][1]} {word(10)}") for i in range(40)] + [(5, "w1 w2"), (None, items[3][1]), (None, items[3][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(map(tuple, decontaminate.contamination(d, b, window=4, block_windows=k).collect()), key=str) for k in (10**6, 17))
    assert one == many and sum(r[5] for r in one) > 30


def test_a_cluster_must_name_a_shared_folder():
    from types import SimpleNamespace

    from chronolane.llm.common import shared_dir

    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(spark)


def test_language_model_on_edge_rows(spark, edge):
    more = spark.createDataFrame([(None, "words here", *["x"] * 3, 1, 1, 1), (2, "same text here", *["x"] * 3, 1, 1, 1)], SCHEMA)
    rows = lm_score.lm_scores(edge.unionByName(more)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert len(rows) == len(EDGE) + 2 and all(r.score < 0 and np.isfinite(r.score) for r in rows)
    assert by[3][0].n_tokens == by[4][0].n_tokens == by[9][0].n_tokens == 1 and by[3][0].score == by[4][0].score
    assert by[5][0].n_tokens == 30001 and len({round(r.score, 9) for r in by[2]}) == 1


def test_pipeline_on_edge_rows(spark, tmp_path):
    import corpus_pipeline as cp

    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (2, a), (2, b), (3, a + " more"), (None, b), (None, b), (4, None), (4, None), (5, ""), (6, "you stupid idiot you moron"), (7, "one two three four"), (8, "x " * 5000)]
    spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "two three")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = {r.doc_id for r in cp.run(spark, str(tmp_path)).collect()}
    assert left == {1, 2, 4, 6, 8}  # without labels and a lexicon no text counts as toxic
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{t}.parquet")).write.parquet(str(tmp_path / "none" / f"{t}.parquet"))
    assert cp.run(spark, str(tmp_path / "none")).count() == 0
