"""Vector codes against a plain version, and their edge cases."""

import math

import numpy as np
import pytest

from corredor.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, l int, hot boolean, n long"


def plain(rows, parts=4, entries=256, rounds=4, scale=1024):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return [], []
    width = max(1, -(-max(len(r[1]) for r in kept) // parts))
    q = {i: [math.floor(scale * float(np.float32(x))) for x in r[1]] + [0] * (parts * width - len(r[1])) for i, r in enumerate(kept)}
    order = sorted(q, key=lambda i: (kept[i][0] is None, kept[i][0] or 0, [float(np.float32(x)) for x in kept[i][1]]))[:entries]
    part = lambda i, p: q[i][p * width : (p + 1) * width]
    books = [[part(i, p) for i in order] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            have = {}
            for i in q:
                have.setdefault(nearest(part(i, p), book)[1], []).append(part(i, p))
            for e, xs in have.items():
                book[e] = [sum(c) // len(xs) for c in zip(*xs)]
    out = []
    for i in q:
        found = [nearest(part(i, p), books[p]) for p in range(parts)]
        out.append((kept[i][0], kept[i][2], "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    total = {}
    for _, label, _, error in out:
        total[label] = total.get(label, 0) + error
    return [(*r, total[r[1]]) for r in out], books


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, "c", 1, 2, True, 3) for i, v, y in rows], SCHEMA)


def cloud(n, width, seed=3):
    rnd = np.random.default_rng(seed)
    centre = rnd.normal(size=(5, width))
    return [(i, (centre[i % 5] + rnd.normal(size=width) * 0.3).tolist(), int(i % 3) or None) for i in range(n)]


EDGES = [
    (500, None, 1), (501, [0.1, None, 0.2, 0.3, 0.1, 0.1, 0.1, 0.1], 1), (502, [float("nan")] * 8, 1), (503, [float("inf")] + [0.0] * 7, 2),
    (None, [0.5] * 8, None), (None, [0.5] * 8, 7), (3, [0.25] * 8, 1), (3, [0.25] * 8, 1), (3, [-0.25] * 8, 1), (504, [], 4), (505, [1.0, -1.0], 4),
    (506, [-0.0001] * 8, 9), (507, [200000.0] * 8, 9),
]


@pytest.mark.parametrize(("rows", "entries", "cell", "limit"), [
    (cloud(300, 8) + EDGES, 16, 64, codes.CELLS), (cloud(40, 16), 256, 7, 5000), (cloud(120, 6), 8, 1 << 20, codes.CELLS), (EDGES, 256, 64, codes.CELLS),
])
def test_codes_against_a_plain_version(spark, monkeypatch, rows, entries, cell, limit):
    monkeypatch.setattr(codes, "STEP", 16)
    expect, books = plain(rows, entries=entries)
    got, mine = codes.compressed(frame(spark, rows).repartition(4), entries=entries, cell=cell)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expect))
    assert codes.books_text(mine) == ",".join(str(x) for b in books for e in b for x in e)


def test_empty_tables_and_far_components(spark):
    got, books = codes.compressed(frame(spark, []))
    assert got.count() == 0 and codes.books_text(books) == ""
    assert codes.compressed(frame(spark, [(1, None, 1)]))[0].count() == 0
    with pytest.raises(Exception, match="beyond"):
        codes.compressed(frame(spark, [(1, [3e7] * 4, 1)]))[0].count()


def test_memo_is_exact_after_collisions_and_when_it_is_full():
    rnd = np.random.default_rng(1)
    book, parts = rnd.integers(-500, 500, (20, 4)), rnd.integers(-500, 500, (3000, 4))
    parts[::3] = parts[0]
    away = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
    for hashed, limit in [(None, 10**4), (None, 4200), (lambda h: h & np.uint64(3), 10**4)]:
        memo = codes.Memo(book, 50, limit)
        if hashed is not None:  # nearly all cells collide
            memo.weights = memo.weights * np.uint64(0)
        for _ in range(2):
            code, error = memo.nearest(parts)
            assert (code == away.argmin(axis=1)).all() and (error == away.min(axis=1)).all()
        assert memo.open.mean() < 0.5  # dominated entries are left out


def test_rare_labels_join_like_frequent_ones(spark, monkeypatch):
    monkeypatch.setattr(codes, "HOT_LABELS", 2)
    rows = [(i, [float(i % 7)] * 4, 1 if i % 2 else i) for i in range(30)]
    got, _ = codes.compressed(frame(spark, rows), entries=3)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain(rows, entries=3)[0]))
