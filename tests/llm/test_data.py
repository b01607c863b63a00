"""Tokens, packing, mixing, search, toxicity, chat and the pipeline against the libraries and brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from corredor.llm import chat, mixing, packing, token_counts, tokens, topk, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, at long, n long, copies long, score string"
TEXTS = [
    (1, None), (2, ""), (3, "Hello world, it's   fine\n\nnow  "), (4, "<|endoftext|> inside <|endoftext|>"), (5, "naïve café Ünïcode ß ſ ÿ"),
    (6, "日本語 текст 🙂 á ​"), (7, "x" * 3000), (8, "tab\tnew\x0bline\x0c\x1c\x85\xa0end"), (9, "1234 5,678.90 ½ ² ª"), (9, "1234 5,678.90 ½ ² ª"),
    (None, "null id"), (10, "don't we'll I'M they're 'quoted' «x» – “y”…€"), (11, "a " * 5000), (12, " lead"), (13, "\x00\x07 control"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, 1, 2, 3, 4, "z") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.tokenizer_path())


def test_encoder_agrees_with_the_library(library):
    enc = tokens.Encoder(tokens.tokenizer_path(), limit=20)
    rnd = random.Random(4)
    alphabet = "ab eE'sßé  \n\t019.,!?-«»„“”…€½²ªſŸ\x0b\x1c\x85\xa0<|endoftext|>日🙂"
    many = [t or "" for _, t in TEXTS] + ["".join(rnd.choices(alphabet, k=rnd.randrange(60))) for _ in range(800)]
    for text in many:
        ids = library.encode(text, add_special_tokens=False).ids
        assert enc.encode(text).tolist() == ids and enc.count(text) == len(ids)
    assert enc.core is not None and len(enc.lengths) <= 20


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, name):
    path = tokens.tokenizer_path(name)
    if name.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        model = Tokenizer.from_file(path)
        count = lambda t: len(model.encode(t, add_special_tokens=False).ids)
    got = token_counts.token_counts(frame(spark, [(i, t, "s") for i, t in TEXTS]), path).collect()
    expect = [(i, len((t or "").encode()), count(t or "")) for i, t in TEXTS]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expect))
    assert token_counts.token_counts(frame(spark, []), path).count() == 0


def test_frequent_table_is_bounded_and_true(spark):
    table = token_counts.frequent_lengths(frame(spark, [(1, "the the cat naïve 12", "s"), (2, "the cat", "s")]), tokens.tokenizer_path())
    assert table[" the"] == 1 and " cat" in table and len(table) < 20


@pytest.mark.parametrize("length", [1024, 7, 1])
def test_packing_round_trip(spark, library, length):
    docs = frame(spark, [(i, t, "s") for i, t in TEXTS if i != 9 or length == 1024]).repartition(3)
    rows = packing.pack(docs, length).collect()
    whole, places = defaultdict(list), defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        ids = np.frombuffer(bytes(r["ids"]), dtype="<u4").tolist()
        assert len(ids) == r["length"] > 0
        places[r["sequence_id"]].append((r["offset"], len(ids)))
        whole[r["doc_id"]].append((r["start"], ids, r["doc_tokens"]))
    for i, t in TEXTS:
        if i == 9:
            continue
        parts = sorted(whole[i])
        flat = [x for _, ids, _ in parts for x in ids]
        assert flat == [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert [s for s, *_ in parts] == np.cumsum([0, *(len(x) for _, x, _ in parts[:-1])]).tolist()
        assert {n for *_, n in parts} == {len(flat)}
    total = sum(r["length"] for r in rows)
    assert sorted(places) == list(range(-(-total // length)))
    for n, parts in places.items():
        assert [o for o, _ in parts] == np.cumsum([0, *(k for _, k in parts[:-1])]).tolist()
        assert sum(k for _, k in parts) == (length if n < max(places) else total - length * max(places))


def test_packed_sequences_are_padded_except_at_powers_of_two(spark):
    pieces = spark.createDataFrame(
        [(0, 0, 3, bytearray(b"\1\0\0\0" * 3)), (0, 3, 2, bytearray(b"\2\0\0\0" * 2)), (1, 0, 4, bytearray(b"\3\0\0\0" * 4))],
        "sequence_id long, offset long, length long, ids binary",
    )
    got = {r["sequence_id"]: (r["n_tokens"], np.frombuffer(bytes(r["ids"]), dtype="<u4").tolist()) for r in packing.sequences(pieces, 8, 9).collect()}
    assert got == {0: (5, [1, 1, 1, 2, 2, 9, 9, 9]), 1: (4, [3, 3, 3, 3])}
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def water(sizes, weights=(5, 2, 1), budget=1.5, cap=2.0):
    names = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), budget * sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        over = [s for s in free if w[s] * level > cap * sizes[s]]
        for s in over or free:
            target[s] = cap * sizes[s] if over else w[s] * level
        for s in over:
            left -= target[s]
        free -= set(over or free)
    return target


def test_mixing(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(["w"] * rnd.choice([0, 3, 3, 3, 8, 20, 41])), rnd.choice(["b", "a", None, "Z", "é", "hot", "hot", "hot", "hot"])) for i in range(900)]
    rows += [(None, "x y", "a"), (5000, None, "a"), (5001, None, "empty"), (7, "w w", "a"), (7, "w w", "a"), (6000, "w " * 300, "lone")]
    got = mixing.mix(frame(spark, rows)).collect()
    size = Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    target, taken = water(size), Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["size"] * r["copies"]
        taken[r["source"]] += r["taken"]
    assert sorted(r["size"] for r in got) == sorted(len(WORD.findall(t or "")) for _, t, _ in rows)
    for s in size:
        gap = abs(taken[s] - target[s])
        assert gap <= (3 if s != "lone" else 300), (s, taken[s], target[s])
    again = mixing.mix(frame(spark, rows[::-1])).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix(frame(spark, [])).count() == 0
    assert all(r["taken"] == 0 for r in mixing.mix(frame(spark, [(1, None, None)])).collect())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 9)), min_size=1, max_size=8, unique_by=lambda x: x[0]), st.integers(0, 3000))
def test_knapsack_hits_the_best_sum_near_its_share(pairs, budget):
    sizes, counts = (np.array(x) for x in zip(*pairs))
    total = int((sizes * counts).sum())
    take = mixing.fit(sizes, counts, budget)
    got = int((sizes * take).sum())
    assert ((take >= 0) & (take <= counts)).all() and got <= max(0, min(budget, total))
    if 0 < budget < total:
        share = np.floor(counts * (budget / total)).astype(int)
        best = {int((sizes * share).sum())}
        for s, n in zip(sizes, counts - share):
            best |= {x + int(s) * k for x in best for k in range(int(n) + 1) if x + int(s) * k <= budget}
        assert got == max(best)


def test_knapsack_is_exact_beyond_the_narrowed_width():
    one = np.ones(4, dtype=int)
    sizes = np.array([70_001, 69_999, 99_000, 60_000])
    assert int((sizes * mixing.fit(sizes, one, 140_000)).sum()) == 140_000
    assert int((sizes * 1000 * mixing.fit(sizes * 1000, one, 140_000_999)).sum()) == 140_000_000
    rnd = random.Random(4)
    for _ in range(30):
        sizes = np.array(rnd.sample(range(30_000, 400_000), 9))
        budget = rnd.randrange(1, int(sizes.sum()))
        sums = {0}
        for s in sizes:
            sums |= {x + int(s) for x in sums}
        assert int((sizes * mixing.fit(sizes, np.ones(9, dtype=int), budget)).sum()) == max(x for x in sums if x <= budget)


def test_mixed_documents_keep_clashing_columns(spark):
    docs = frame(spark, [(i, "w " * (i % 7 + 1), "ab"[i % 2]) for i in range(60)] + [(3, "w", None), (None, "w w", "a")])
    plain = Counter(map(str, mixing.mixed_documents(docs).select("doc_id", "source", "text").collect()))
    names = ["copy", "_copy", "_copies", "row", "size", "h", "slot", "rank", "take"]
    wide = mixing.mixed_documents(docs.withColumns({n: F.lit(n) for n in names}))
    assert wide.columns == docs.columns + names
    assert Counter(map(str, wide.select("doc_id", "source", "text").collect())) == plain
    assert wide.filter(" OR ".join(f"{n} <> '{n}'" for n in names)).count() == 0


def test_mixed_documents_repeat_rows(spark):
    docs = frame(spark, [(i, "w " * (i % 7 + 1), "ab"[i % 2]) for i in range(200)])
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    rows = mixing.mixed_documents(docs)
    assert rows.columns == docs.columns
    assert Counter(r["doc_id"] for r in rows.collect()) == Counter({i: n for i, n in plan.items() if n})


@pytest.mark.parametrize("block", [1000, 3])
def test_top_k_equals_brute_force(spark, block):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(230, 8)), 1)
    x[40:60] = x[3]
    x[70] = 0
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(500, None, 0), (550, [1.0, None] * 4, 0), (600, [float("nan")] * 8, 0), (650, [float("inf")] * 8, 0), (None, [1.0] * 8, 0), (50, x[50].tolist(), 0)]
    schema = "vec_id long, embedding array<float>, rank int"
    vectors = spark.createDataFrame(rows + odd, schema)
    got = sorted(map(tuple, topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5, query_block=block).collect()))
    q = np.floor(256 * x.astype(np.float32).astype(np.float64)).astype(np.int64)
    ids, all_q = [*range(230), 50], np.vstack([q, q[50]])
    expect = []
    for a in (0, 50, 100, 150, 200):
        best = sorted((-int(q[a] @ all_q[j]), ids[j]) for j in range(231) if ids[j] != a)[:5]
        expect += [(a, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert got == sorted(expect)
    few = spark.createDataFrame([(0, [1.0], 0), (7, [2.0, 3.0], 0), (9, [], 0)], schema)
    assert sorted(map(tuple, topk.top_k(few, few.filter("vec_id = 0")).collect())) == [(0, 1, 7, 256 * 512), (0, 2, 9, 0)]
    none = spark.createDataFrame([], schema)
    assert topk.top_k(none, none).count() == 0


ROLES = ["user", "assistant", "system", "tool", "", None, "a\nb\\n", "<|im_start|>x"]


@settings(max_examples=300, deadline=None)
@given(st.text("<|\\>im_startend \n"))
def test_escape_is_reversible(text):
    shown = chat.escape(text)
    assert chat.unescape(shown) == text and "<|" not in shown
    assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


def conversations(seed=1):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["<|im_end|>", "hi", "é", "<\\|x", "日", "\n", "long " * 30, "<|im_start|>assistant", ""])
    rows = [(c, t, rnd.choice(ROLES[:4]), " ".join(word() for _ in range(rnd.randrange(12)))) for c in range(12) for t in range(rnd.randrange(1, 9))]
    rows += [(50, t, "system" if t == 0 else ("user", "assistant")[t % 2], f"turn {t} " + "word " * (t % 40)) for t in range(700)]
    rows += [(60, 0, "user", None), (60, 0, "user", None), (60, None, None, "x"), (60, 1, "assistant", None), (61, 3, ROLES[6], "q"), (61, 4, ROLES[7], "<|im_end|>")]
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "yes"), (62, 0, "assistant", "w " * 5000)]
    rnd.shuffle(rows)
    return rows


def test_chat_windows_and_digests(spark):
    rows = conversations()
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, kind string, segment int")
    made = chat.windows(turns, budget=300, history=80, segment=100).collect()
    for w in made:
        parsed = chat.parse(w["text"])
        assert len(parsed) == w["turns"] > w["repeated"] >= 0
        assert w["n_tokens"] <= 300 or w["turns"] - w["repeated"] == 1
        assert [chat.unescape(w["text"][s["start"] : s["end"]]) for s in w["loss"]] == [t for r, t in parsed[w["repeated"] :] if r == "assistant"]
        if w["conv_id"] == 50:
            assert parsed[0] == ("system", "turn 0 ")
            if w["window"] or w["segment"]:
                assert w["repeated"] >= 1
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    expect = {}
    for c, own in by.items():
        own.sort()
        said = "".join(x for *_, role, x in own if role == "assistant")
        expect[c] = (
            len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in own).encode()).hexdigest(),
            len(said), hashlib.sha256(said.encode()).hexdigest(), sum(len(w["text"]) for w in made if w["conv_id"] == c),
        )
    got = chat.digests(chat.windows(turns, budget=300, history=80, segment=100)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == expect and len(got) == len(expect)
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.windows(none)).count() == 0


def labelled(n=420, seed=8):
    rnd = random.Random(seed)
    bits = ["tion", "er", "the", "an", "or", "st", "re", "ha", "ly", "ing", "ou", "ble", "nd", "at", "en"]
    word = lambda: "".join(rnd.choices(bits, k=rnd.randrange(1, 4)))
    docs, marks = [], []
    for i in range(n):
        w, bad = [word() for _ in range(rnd.randrange(20, 200))], i % 4 == 0
        for _ in range(rnd.randrange(2, 6) if bad else 0):
            w.insert(rnd.randrange(len(w)), rnd.choice(["vilgrup", "smoxdar", "quizzled", "kruvvish"]))
        docs.append((i, " ".join(w), "s"))
        marks.append((i, 1, int(bad)))
    return docs, marks


def test_toxicity_on_held_out_rows(spark):
    rows, marks = labelled()
    docs, labels = frame(spark, [*rows, (9000, None, "s"), (9001, "", "s"), (None, "vilgrup " * 4, "s")]), spark.createDataFrame(
        [*marks, (9000, 1, None), (None, 1, 1), (9001, None, 5)], "doc_id long, quality int, toxic int"
    )
    model = toxicity.train(docs, labels)
    score = {r["doc_id"]: r["score"] for r in toxicity.scores(docs, model).collect()}
    assert len(score) == len(rows) + 3 and all(0 <= s <= 1 for s in score.values())
    held = [(score[i] >= 0.3, mark) for i, _, mark in marks if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([p for p, m in held if m]) > 0.9 and np.mean([p for p, m in held if not m]) < 0.05
    assert score[9000] == score[9001] and score[None] >= 0.3
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, s in score.items() if s < 0.3}


def test_toxicity_never_learns_held_out_labels_and_needs_both_classes(spark):
    rows, marks = labelled(60)
    docs = frame(spark, rows)
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    labels = spark.createDataFrame([(i, 1, 1) for i in held], "doc_id long, quality int, toxic int")
    assert toxicity.sample(docs, labels, 10, 10, 1).num_rows == 0
    assert {r["score"] for r in toxicity.scores(docs, toxicity.train(docs, labels)).collect()} == {0.0}
    flags = docs.select("doc_id", toxicity.held_out(docs["doc_id"]).alias("h")).collect()
    assert [r["doc_id"] for r in flags if r["h"]] == held


def test_toxicity_trains_without_texts_on_the_driver(spark, monkeypatch):
    rows, marks = labelled(200)
    docs, labels = frame(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    expect = toxicity.fit(toxicity.sample(docs, labels, 4000, 10_000, 11))

    def refused(_):
        raise AssertionError("texts on the driver")

    monkeypatch.setattr(type(docs), "toArrow", refused)
    model = toxicity.train(docs, labels)
    assert (model.toxic, model.ordinary) == (expect.toxic, expect.ordinary) and np.allclose(model.weights, expect.weights)


def test_pipeline_stages(spark, tmp_path):
    rows, marks = labelled(300)
    rows += [(1000 + i, rows[i + 1][1].upper() if i % 2 else rows[i + 1][1], "copy") for i in range(0, 12, 4)]
    rows += [(2000, f"{rows[2][1]} one more word", "near"), (3000, None, None), (3001, "", None)]
    docs = frame(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/stage{k}")
        now = spark.read.parquet(f"{tmp_path}/stage{k}")
        ids.append(Counter(r["doc_id"] for r in now.select("doc_id").collect()))
    bad = {i for i, _, m in marks if m}
    assert len(bad & set(ids[0])) < 0.1 * len(bad) and len(set(ids[0])) > 0.95 * (len(rows) - len(bad))
    text = {i: (t or "").lower() for i, t, _ in rows}
    best = {}
    for i in ids[0]:
        best[text[i]] = max(best.get(text[i], -1), i)
    assert set(ids[1]) == set(best.values())
    assert set(ids[2]) <= set(ids[1]) and 2000 not in ids[2] and 2 in ids[2] | ids[0]
    assert set(ids[3]) <= set(ids[2]) and max(ids[3].values()) <= 2
    packed = Counter(r["doc_id"] for r in now.filter("start = 0").collect())
    assert packed == ids[3]
    assert corpus_pipeline.run(spark, str(tmp_path)).agg({"length": "sum"}).first()[0] == now.agg({"length": "sum"}).first()[0]


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op3_exact_dedup", "op5_minhash_near_dedup", "op8_exact_top_k"])
def test_query_equals_its_sql(spark, name):
    from oracle_check import compare, connect

    from corredor.llm import queries

    sf = "/root/testdata/sf0.001"
    assert compare(spark, connect(sf), name, queries.QUERIES[name], queries.ORACLE[name], sf) is None
