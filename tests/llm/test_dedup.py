"""Exact, near, line and substring deduplication against brute force on planted and odd rows."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corredor.llm import exact, graph, lines, minhash, substring
from corredor.llm.util import gram_hashes, inside, kept_bytes, packed, word_hashes, words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, sha string, kept boolean, component string, rep long"


def frame(spark, texts):
    """Rows (doc_id, text) with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "x", "s", 1, 7, "h", True, "c", 9) for i, t in texts], SCHEMA)


def prose(seed, n, vocabulary=300):
    rng = np.random.default_rng(seed)
    return [f"w{k}" for k in rng.integers(0, vocabulary, n)]


ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "a"), (5, "A"), (6, "a b"), (7, "É a"), (8, "é a"), (9, "x" * 5000), (9, "x" * 5000),
    (None, "a"), (None, None), (10, "tab\tand\x0bfeed\x0c mix"), (11, "nb space stays   a word"), (12, "a b " * 40), (13, "a " * 60),
]


def test_exact_groups(spark):
    rows = {r["doc_id"]: r for r in exact.exact_groups(frame(spark, ODD)).collect() if r["doc_id"] is not None}
    by_text = {}
    for i, t in ODD:
        by_text.setdefault((t or "").translate(LOWER), []).append(i)
    for i, t in ODD:
        if i is None:
            continue
        same = by_text[(t or "").translate(LOWER)]
        best = max(x for x in same if x is not None)
        r = rows[i]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (best, len(same), i == best)
        assert r["text_sha256"] == hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()
    assert exact.exact_groups(frame(spark, ODD)).count() == len(ODD)
    assert exact.exact_groups(frame(spark, [])).count() == 0


def test_exact_directory_splits_only_overfull_buckets(spark):
    rows = spark.range(4000).selectExpr("xxhash64(id) AS key").unionAll(spark.range(900).selectExpr("id AS key"))
    cells = exact.directory(rows, 300, 8).collect()
    full = {r["prefix"]: r for r in cells}
    assert len(full) == 256 and min(r["depth"] for r in cells) < 8
    counts = {}
    for r in rows.collect():
        p = (r["key"] & (2**64 - 1)) >> 56
        counts[full[p]["bucket"]] = counts.get(full[p]["bucket"], 0) + 1
    assert all(n <= 300 or full[b]["depth"] == 8 for b, n in counts.items())
    assert full[0]["depth"] == 8  # 900 keys share the prefix: it ends as an overflow bucket


def test_exact_stage_keeps_columns_and_largest_id(spark):
    docs = frame(spark, [(1, "Same"), (2, "sAme"), (3, "other"), (4, None), (5, "")])
    kept = exact.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 5]


def brute_components(texts, width, percent):
    sets, parent = {}, {}
    for i, t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies(n=60, seed=3):
    rng = np.random.default_rng(seed)
    out, base = [], prose(1, 150, 5000)
    for i in range(n):
        w = list(base)
        for k in rng.integers(0, len(w), int(rng.integers(0, 16))):
            w[k] = f"n{i}x{k}"
        out.append((100 + i, " ".join(w)))
    return out + [(500 + i, " ".join(prose(i, 40, 5000))) for i in range(30)]


@pytest.mark.parametrize("width,percent,block", [(3, 85, 4000), (5, 80, 4000), (3, 85, 7)])
def test_near_duplicates_equal_brute_force(spark, width, percent, block):
    texts = near_copies() + [x for x in ODD if x[0] is not None][:-6] + [(12, "a b " * 40), (13, "a " * 60)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame(spark, texts), width, percent, block).collect()}
    assert got == brute_components(texts, width, percent)


def test_near_duplicates_of_odd_tables(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    rows = minhash.near_duplicates(frame(spark, [(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, None)])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in rows if r["doc_id"]) == [(1, 1, True), (1, 1, True), (2, 2, True)]
    with pytest.raises(ValueError):
        minhash.near_duplicates(frame(spark, []), 3, 50)


def test_near_stage_keeps_columns_and_smallest_id(spark):
    docs = frame(spark, near_copies(12))
    kept = minhash.keep_representatives(docs)
    expect = {c for _, c in brute_components(near_copies(12), 5, 80).values()}
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == expect


def test_forest_skips_members_but_no_link():
    ids, linked = np.arange(50), lambda one, rest: np.abs(rest - one) <= 2
    a, b = minhash.forest(ids, linked)
    assert len(a) == 49 and (np.abs(a - b) <= 2).all()


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(300, 300), (None, 3)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)} | {300: 300}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_round_of_components_is_three_shuffles_without_joins(spark):
    """Most of what the driver holds of a run grows with its stages and tasks."""
    rnd = random.Random(9)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000, i) for i in range(1001, 1200)]
    edges = spark.createDataFrame([(max(p), min(p)) for p in links if p[0] != p[1]], "u long, v long").distinct().localCheckpoint()
    plan = graph._small_star(graph._large_star(edges))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3 and "Join" not in plan
    least = {}
    for a, b in links:  # merged by hand
        old = {least.get(a, a), least.get(b, b)}
        least |= {n: min(old) for n in [*least, a, b] if least.get(n, n) in old}
    assert {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()} == least


def brute_substrings(texts, window):
    seen, out = set(), []
    for i, t in texts:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if k in seen:
                gone[s : s + window] = [True] * window
            seen.add(k)
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("window,chunk_bytes,group", [(20, 2 << 20, 2_000_000), (20, 600, 50), (4, 300, 40), (1, 200, 30)])
def test_substring_dedup_equals_brute_force(spark, window, chunk_bytes, group):
    passage = prose(77, 60)
    texts = [(i, " ".join(prose(i, 30) + passage[i % 5 : 40 + i % 7] + prose(i + 1000, 25))) for i in range(40)]
    texts += [(50, None), (51, ""), (52, "w1 " * 23), (53, "w1 w2 " * 15), (54, " ".join(passage)), (55, " ".join(prose(9, 3000, 40)))]
    got = substring.remove_repeats(frame(spark, texts), window, chunk_bytes, group).collect()
    assert sorted(tuple(r) for r in got) == brute_substrings(texts, window)


def test_substring_dedup_of_odd_tables(spark):
    assert substring.remove_repeats(frame(spark, [])).count() == 0
    got = substring.remove_repeats(frame(spark, [(2, "b " * 30), (None, "b " * 30), (2, "b " * 30)])).collect()
    assert {r["doc_id"]: r["n_words"] for r in got} == {None: 30, 2: 30}
    first = [r for r in got if r["doc_id"] is None][0]
    assert first["n_removed"] == 29 and all(r["n_removed"] == 30 for r in got if r["doc_id"] == 2)


@pytest.mark.parametrize("window", [1, 2, 20])
def test_substring_anchors_of_few_words(window):
    for n in range(window + 2):
        chunk = substring.Chunk(packed(np.array([1]), pa.array([" ".join(["w"] * n)], pa.string())), window)
        assert len(chunk.anchors()) == len(chunk.valid) == max(0, n - window + 1)


def brute_lines(texts, similarity):
    def plain(x):
        return " ".join(WORD.findall(x.translate(LOWER | {ord(str(d)): "0" for d in range(10)})))

    places = [(i, n, plain(x)) for i, t in texts for n, x in enumerate((t or "").split("\n"))]
    names = list(dict.fromkeys(k for *_, k in places if k))
    _, _, sim = lines.line_keys(lines.lines_of(pa.array(names, pa.string())))
    sim, parent = sim.view(np.uint64), list(range(len(names)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(names)), 2):
        if bin(int(sim[a] ^ sim[b])).count("1") <= 3 and lines.similar(names[a], names[b], similarity):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    kept, gone = set(), {}
    for i, n, k in places:
        if k and (g := find(names.index(k))) in kept:
            gone.setdefault(i, set()).add(n)
        elif k:
            kept.add(g)
    return [
        (i, len((t or "").split("\n")), len(gone.get(i, ())), "\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in gone.get(i, ())))
        for i, t in texts
    ]


@pytest.mark.parametrize("block,chunk_bytes", [(4000, 2 << 20), (3, 500)])
def test_line_dedup_equals_brute_force(spark, block, chunk_bytes):
    long = prose(5, 90)
    texts = [(i, "\n".join([" ".join(prose(i, 12)), "Shared  LINE number 12", " ".join([*long[:-1], f"{long[-1]}{i % 3}z"]), "", f"only {'abc'[i % 3]} here"])) for i in range(25)]
    texts += [(40, None), (41, ""), (42, "\n\n"), (43, "shared line\tnumber 99\n"), (44, " ".join(long) + "\r\n" + "tail")]
    got = lines.remove_repeated_lines(frame(spark, texts), block=block, chunk_bytes=chunk_bytes).drop("classes").collect()
    assert sorted(tuple(r) for r in got) == brute_lines(texts, 0.8)
    assert sum(r["n_removed"] for r in got) > 24


def test_line_dedup_by_edit_similarity_alone(spark):
    """Short pairs are all found; of longer ones with words replaced nearly all."""
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("abcdeghilmnorstuv"), rng.integers(2, 9))) for _ in range(900)]
    bases = [[vocabulary[k] for k in rng.integers(0, 900, n)] for n in (1, 2, 2, 3, 3, 4, 8, 10, 17, 20, 30, 50) for _ in range(12)]
    names = {}
    for words in bases:
        line = " ".join(words)
        short = list(line)
        short[rng.integers(len(short))] = "x"
        changed = list(words)
        for k in rng.choice(len(words), max(1, len(words) // 8), replace=False):
            changed[k] = vocabulary[rng.integers(900)]
        names |= dict.fromkeys((line, "".join(short), " ".join(changed)))
    names = [n for n in dict.fromkeys(" ".join(x.split()) for x in names) if n]
    texts = list(enumerate(names))
    pairs = [(a, b) for a, b in itertools.combinations(range(len(names)), 2) if lines.similar(names[a], names[b], 0.8)]
    short = {b for a, b in pairs if max(len(names[a]), len(names[b])) <= lines.SHORT}
    long = {b for a, b in pairs if max(len(names[a]), len(names[b])) > lines.SHORT}
    got = {r["doc_id"] for r in lines.remove_repeated_lines(frame(spark, texts), distance=None).collect() if r["n_removed"]}
    assert got <= short | long and short <= got and len(got & long) >= 0.95 * len(long) and len(short) > 20 and len(long) > 80


def edited(seed, n, letters="abé ñ漢", longest=60):
    rng = np.random.default_rng(seed)
    for _ in range(n):
        a = "".join(rng.choice(list(letters), rng.integers(0, longest)))
        b = list(a)
        for _ in range(rng.integers(0, 1 + max(1, len(a) // 4))):
            i = int(rng.integers(0, len(b) + 1))
            b[i : i + int(rng.integers(0, 2))] = rng.choice(list(letters), rng.integers(0, 2))
        yield a, "".join(b)


def test_filters_of_line_pairs_lose_no_similar_pair():
    pairs = [*edited(4, 3000), ("a" * 9000, "a" * 8000), ("", ""), ("é", "e")]
    a, b = (pa.array(x, pa.string()) for x in zip(*pairs))
    similar = np.array([lines.similar(x, y, 0.8) for x, y in pairs])
    assert similar.sum() > 1000 and (lines._may_be_similar(a, b, 0.8) | ~similar).all()
    for (x, y), same in zip(pairs[:400], similar):
        assert len(lines._similar_forest(np.array([1, 2]), [x, y], 0.8)[0]) == same


def test_unrelated_lines_of_one_vocabulary_are_told_apart_without_their_distance():
    """Lines of one set of syllables share most runs of three; their segments still fit nowhere."""
    rng = np.random.default_rng(6)
    syllables = ["th", "er", "and", "ing", "on", "the", "re", "ion", "ha", "en", "st", " ", " ", " ", ". "]
    text = ["".join(rng.choice(syllables, 300)) for _ in range(200)]
    a, b = text[::2], text[1::2]
    assert lines._may_be_similar(pa.array(a), pa.array(b), 0.8).mean() > 0.9 and lines._may_meet(a, b, 0.8).mean() < 0.1
    near = [*edited(7, 1500), *edited(8, 1500, letters="abcdefgh é漢😀", longest=400), ("ab" * 500, "ab" * 450), ("", ""), ("", "a"), ("é", "e")]
    for a, b in (zip(*near), zip(*(p[::-1] for p in near))):
        a, b = list(a), list(b)
        for similarity in (0.8, 0.9):
            similar = np.array([lines.similar(x, y, similarity) for x, y in zip(a, b)])
            assert similar.sum() > 500 and (lines._may_meet(a, b, similarity) | ~similar).all()


def test_line_candidates_of_large_groups_are_pairs_not_components():
    """Strong links form a forest, weak ones stay pairs: a chain of weak links makes no component that meets as a whole."""
    rng = np.random.default_rng(2)
    two = rng.integers(0, 4, (30, lines.BANDS * lines.ROWS), dtype=np.uint32)
    two[:, :20] = two[0, :20]  # all agree in a third of the minima and more
    two[20:] = two[19]
    high, low = lines._sketch((two << np.uint32(7)).T)
    agree = (two[:, None, :] == two[None, :, :]).sum(axis=2)
    for n in (8, 30):  # a small group and a large one
        a, b, strong = lines._value_links(np.zeros(n, np.uint32), np.arange(n), high[:n], low[:n], np.full(n, 50, np.uint32), 0.8)
        found = {(min(p), max(p)) for p in zip(a.tolist(), b.tolist())}
        weak = {(i, j) for i in range(n) for j in range(i + 1, n) if lines.AGREE <= agree[i, j] < lines.STRONG}
        assert weak <= found and strong.sum() == (10 if n == 30 else 0)
    a, b, _ = lines._value_links(np.zeros(2, np.uint32), np.arange(2), high[20:22], low[20:22], np.array([50, 39], np.uint32), 0.8)
    assert not len(a)


def band_links(names, places=True):
    """Strong and other candidates of all bands."""
    flat = np.frombuffer("".join(n + " " for n in names).encode(), dtype=np.uint8)
    at = np.cumsum([0, *(len(n.encode()) + 1 for n in names)])
    chars, cells = lines._cells(flat, at)
    assert chars.tolist() == [len(n) for n in names]
    lows = lines.minima(flat, at, cells)
    cells, lows = (lows % 4**lines.CELL).astype(np.uint16), lows >> np.uint32(2 * lines.CELL)
    high, low = lines._sketch(lows << np.uint32(7))
    strong, weak = set(), set()
    for k in range(0, len(lows), lines.ROWS):
        _, value = np.unique(lows[k : k + lines.ROWS], axis=1, return_inverse=True)
        own = cells[k : k + lines.ROWS] if places else []
        a, b, firm = lines._value_links(value.ravel().astype(np.uint32), np.arange(len(names)), high, low, chars, 0.8, *own)
        for x, y, z in zip(a.tolist(), b.tolist(), firm.tolist()):
            (strong if z else weak).add((min(x, y), max(x, y)))
    return strong, weak - strong


def test_chance_candidates_are_told_by_where_their_runs_lie():
    """Unrelated lines of one vocabulary share runs at any place; near copies where the edits allowed can move them."""
    rng = np.random.default_rng(6)
    syllables = ["th", "er", "and", "ing", "on", "the", "re", "ion", "ha", "en", "st", " ", " ", " ", ". "]
    names = ["".join(rng.choice(syllables, 260)).strip() for _ in range(300)]
    for i in range(150):  # a part of each line goes, comes or is changed
        a, n = names[i], int(rng.integers(0, len(names[i]) // 6))
        at, other = int(rng.integers(0, len(a) - n)), "".join(rng.choice(syllables, 80))[:n]
        names.append([a[:at] + a[at + n :], a[:at] + other + a[at:], a[:at] + other + a[at + n :]][i % 3].strip())
    names = [" ".join(n.split()) for n in names]
    (strong, weak), (same, every) = band_links(names), band_links(names, places=False)
    assert strong == same and weak <= every and len(every) > 500 and len(weak) < 0.5 * len(every)
    assert not [p for p in every - weak if lines.similar(names[p[0]], names[p[1]], 0.8)]
    assert len({p for p in strong | weak if p[1] - p[0] == 300 and p[0] < 150}) > 130


def test_links_of_large_groups_span_what_all_pairs_connect():
    rng = np.random.default_rng(3)
    for n, m in ((1, 0), (50, 30), (400, 390), (2000, 5000)):
        a, b = np.sort(rng.integers(0, n, (2, m)), axis=0)
        kept, tree = lines._spanning(a, b, n)
        _, again = lines._spanning(a[kept], b[kept], n)
        assert (tree == again).all() and (tree[a] == tree[b]).all() and len(kept) == n - len(np.unique(tree))
    count = lines.FLAT + 300
    base = np.zeros((lines.BANDS * lines.ROWS, count), dtype=np.uint32)
    base[:, lines.FLAT :] = rng.integers(0, 4, (len(base), 300))  # a tree above FLAT members, and others in its group
    base[:20, lines.FLAT :] = 0
    high, low = lines._sketch(base << np.uint32(7))
    agree = (base[:, -1:] == base).sum(axis=0)
    a, b, strong = lines._value_links(np.zeros(count, np.uint32), np.arange(count), high, low, np.full(count, 50, np.uint32), 0.8)
    found = {frozenset(p) for p in zip(a.tolist(), b.tolist())}
    last = count - 1
    assert lines.FLAT - 1 <= strong.sum() < lines.FLAT + 50 and {frozenset((i, last)) for i in np.flatnonzero((agree >= lines.AGREE) & (agree < lines.STRONG))} <= found


def test_bounds_of_many_pairs_say_what_their_distance_says():
    near = [*edited(7, 900), *edited(8, 900, letters="abcdefgh é漢😀", longest=400), *edited(9, 900, letters="abcdefghi é", longest=400)]
    near += [("ab" * 500, "ab" * 450), ("", ""), ("", "a"), ("é", "e"), ("a" * 64, "a" * 64)]
    for a, b in (zip(*near), zip(*(p[::-1] for p in near))):
        a, b = list(a), list(b)
        for similarity in (0.8, 0.9):
            similar, sure = np.array([lines.similar(x, y, similarity) for x, y in zip(a, b)]), lines._surely_meet(a, b, similarity)
            assert not (sure & ~similar).any() and sure.sum() > 300 and (lines._alike(a, b, similarity) == similar).all()
    text = [t for p in near[:60] for t in p]
    bounds = np.array([0, 1, 9, 10, 40, 120])
    a, b = lines._similar_forests(text, bounds, 0.8)
    for lo, hi in zip(bounds, bounds[1:]):
        x, y = map(np.array, zip(*[(lo, lo), *((i, j) for i in range(lo, hi) for j in range(i + 1, hi) if lines.similar(text[i], text[j], 0.8))]))
        own = (a >= lo) & (a < hi)
        assert (lines._spanning(x, y, 120)[1] == lines._spanning(a[own], b[own], 120)[1]).all()


def test_unlike_members_of_a_group_cost_one_bound_and_cut_groups_meet_across(monkeypatch):
    near = list(edited(11, 300, longest=300))
    text = [t for p in near[:80] for t in p]
    side = np.random.default_rng(2).integers(1, 3, len(text))
    a, b = lines._similar_forests(text, np.array([0, len(text)]), 0.8, side)
    x, y = map(np.array, zip(*[(0, 0), *((i, j) for i in range(160) for j in range(i + 1, 160) if side[i] != side[j] and lines.similar(text[i], text[j], 0.8))]))
    assert (lines._spanning(x, y, 160)[1] == lines._spanning(a, b, 160)[1]).all() and (side[a] != side[b]).all()
    tried, sure = [], lines._surely_meet
    monkeypatch.setattr(lines, "_surely_meet", lambda a, b, s: tried.append(len(a)) or sure(a, b, s))
    rng = np.random.default_rng(5)
    unlike = ["".join(rng.permutation(list("the quick brown fox jumps over a lazy dog " * 4))) for _ in range(60)]
    a, _ = lines._similar_forests(unlike, np.array([0, 60]), 0.8)
    assert not len(a) and sum(tried) < 60 * 59 // 2 // 10


def test_chains_among_unlike_members_stay_whole():
    for seed in range(25):
        rng = np.random.default_rng(seed)
        text = ["".join(rng.choice(list("abcdefghij "), 120)) for _ in range(14)]
        for k in (0, 1):
            for _ in range(9):
                step = list(text[-1] if _ else text[k])
                for i in rng.choice(120, 14, replace=False):
                    step[i] = "xyz"[int(rng.integers(3))]
                text.append("".join(step))
        text = [text[i] for i in rng.permutation(len(text))]
        n = len(text)
        for side in (np.zeros(n, dtype=int), rng.integers(1, 3, n)):
            a, b = lines._similar_forests(text, np.array([0, n]), 0.8, side)
            meet = [(i, j) for i in range(n) for j in range(i + 1, n) if (side[i] == 0 or side[i] != side[j]) and lines.similar(text[i], text[j], 0.8)]
            x, y = map(np.array, zip((0, 0), *meet))
            assert (lines._spanning(x, y, n)[1] == lines._spanning(a, b, n)[1]).all()


@pytest.mark.parametrize("block,chunk_bytes", [(2, 3000), (4000, 2 << 20)])
def test_line_dedup_in_pieces_and_passes(spark, block, chunk_bytes):
    """Cells, components and pairs cut by a tiny block give the links of one piece, and no shuffle setting is left changed."""
    base = [prose(k, 25, 2000) for k in range(6)]
    rows = [" ".join(w if (i + n) % 13 else f"{w}é{i}" for n, w in enumerate(base[i % 6])) for i in range(150)]
    before = spark.conf.get(lines._CLEANUP)
    got = lines.remove_repeated_lines(frame(spark, list(enumerate(rows))), distance=None, block=block, chunk_bytes=chunk_bytes).collect()
    assert sorted(r["doc_id"] for r in got if not r["n_removed"]) == list(range(6))
    assert spark.conf.get(lines._CLEANUP) == before


def test_band_values_go_before_the_lines_are_cut(spark):
    from corredor.session import finished_folders, shared_dir

    rows = [" ".join(prose(k // 2, 20, 900)) + ("" if k % 2 else " more") for k in range(8)]
    before = finished_folders(spark, shared_dir(spark), "line-bands-")
    cut = lines.remove_repeated_lines(frame(spark, list(enumerate(rows))), distance=None)
    assert finished_folders(spark, shared_dir(spark), "line-bands-") == before
    assert sum(r["n_removed"] for r in cut.collect()) == 4


def test_lines_that_share_no_digits_stay(spark):
    texts = [(1, "1998 4417 23.5"), (2, "2021 8852 67.1"), (3, "1998 4417 23.6"), (4, "1998  4417 23.5")]
    got = lines.remove_repeated_lines(frame(spark, texts), distance=None).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {1: 0, 2: 0, 3: 1, 4: 1}


def test_line_dedup_of_odd_tables(spark):
    assert lines.remove_repeated_lines(frame(spark, [])).count() == 0
    got = lines.remove_repeated_lines(frame(spark, [(None, "same here"), (1, "same here"), (1, "same here")])).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in got) == [(0, 0), (1, 1), (1, 1)]


@settings(max_examples=150, deadline=None)
@given(st.text("abcd", max_size=30), st.text("abcd", max_size=30))
def test_edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    assert lines.edit_distance(a, b) == row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab é\t\n\x0b ", max_size=12), max_size=6))
def test_words_of_texts(texts):
    w = words_of(pa.array(texts, pa.string()))
    got = [w.data[s:e].tobytes().decode() for s, e in zip(w.starts, w.ends)]
    assert [got[a:b] for a, b in zip(w.first, w.first[1:])] == [WORD.findall(t) for t in texts]
    hashes = word_hashes(w)
    assert len(set(hashes.tolist())) == len(set(got))
    pairs = [tuple(got[i : i + 2]) for i in range(len(got) - 1)]
    assert len(set(gram_hashes(hashes, 2).tolist())) == len(set(pairs))
    owner = [i for i, t in enumerate(texts) for _ in WORD.findall(t)]
    assert inside(w, 2).tolist() == [a == b for a, b in zip(owner, owner[1:])]
    keep = np.arange(len(got)) % 2 == 0
    body, at = kept_bytes(w, keep)
    flat = iter(keep.tolist())
    assert [body[a : max(a, b - 1)].decode() for a, b in zip(at, at[1:])] == [" ".join(x for x in WORD.findall(t) if next(flat)) for t in texts]
