"""Structure repair against a plain dynamic programme, and its edge cases."""

import hashlib
import random
import zlib

import pytest

from corredor.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, part int, place long, n long, said string, fault string, conv long"
BLANK = " \t\n\x0b\f\r"


def damage(rows):
    for conv, turn, role, text in rows:
        name = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        if kind == 1:
            text = ""
        elif kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif kind == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)


def plain(rows, every):
    out = []
    for conv in {c for c in every}:
        own = sorted((t is not None, t or 0, r.encode(), x.encode()) for c, t, r, x in rows if c == conv)
        own = [(a, t, r.decode(), x.decode()) for a, t, r, x in own]
        turns = [t for a, t, _, _ in own if a]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults, seen = [], set()
        for _, _, r, x in own:
            end = x.rstrip(BLANK)
            faults.append("blank" if not end else "duplicate" if (r, x) in seen else "" if end[-1] in ".!?" else "truncated")
            seen.add((r, x))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        best = {"": (0, "", [])}
        nxt, name = {"": "u", "s": "u", "u": "a", "a": "u"}, {"u": "user", "a": "assistant"}

        def insert(best):
            for _ in range(3):
                for s, (c, a, t) in list(best.items()):
                    new = (c + 2, a + "I", [*t, name[nxt[s]] + ":"])
                    if nxt[s] not in best or new < best[nxt[s]]:
                        best[nxt[s]] = new
            return best

        for (_, _, r, x), fault in zip(own, faults):
            after = {}

            def put(s, c, a, t):
                if s not in after or (c, a, t) < after[s]:  # noqa: B023
                    after[s] = (c, a, t)  # noqa: B023

            forced, cut = fault in ("blank", "duplicate"), int(fault == "truncated")
            for s, (c, a, t) in (best if forced else insert(best)).items():
                put(s, c + 3, a + "D", t)
                if not forced:
                    if s + r[:1] in ("s", "u", "su", "ua", "au") and r:
                        put(r[:1], c + cut, a + "K", [*t, f"{r}:{x}"])
                    put(nxt[s], c + 2 + cut, a + "R", [*t, f"{name[nxt[s]]}:{x}"])
            best = after
        best = insert(best)
        cost, audit, said = min(best[s] for s in ("", "a") if s in best)
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(map(str, out))


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "s", "f", 4) for r in rows], SCHEMA)


def talk(conv, n, seed, step=1):
    rnd = random.Random(seed)
    roles = ["user", "assistant"] * 4 + ["system", "tool", "usher", "", "a"]
    texts = ["Yes.", "No!", "Well", "Is it?  \n", " ", "ß。", "ok"] + [f"Number {i}." for i in range(n // 2 + 1)]
    return [(conv, i * step, rnd.choice(roles) if rnd.random() < 0.4 else ("user", "assistant")[i % 2], rnd.choice(texts)) for i in range(n)]


EDGES = [
    (None, None, None, None), (None, 3, "user", "x."), (None, 3, "user", "x."), (50, None, "assistant", "b."), (50, None, "assistant", "a."),
    (50, -5, "user", "c"), (51, 0, "user", ""), (52, 2**40, "system", "only."), (52, 2**40 + 9, "system", "only?"), (53, 1, "user", "long " * 40000 + "."),
    (54, 0, "a" * 90, "q" * 90 + "1."), (54, 0, "a" * 90, "q" * 90 + "0."),
]


@pytest.fixture
def many_parts(spark):
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def test_repair_against_a_plain_version(spark, many_parts):
    rows = [r for c in range(40) for r in talk(c, c % 12, c)] + talk(60, 230, 7, 3) + talk(61, 90, 8) + EDGES
    rows += [(70, 1, "user", "same."), *[(70, 1, "user", "same.")] * 30, (70, 0, "assistant", "First?"), (71, 0, "tool", "x"), (71, 0, "tool", "x")]
    got = repair.report(repair.damaged(frame(spark, rows)), frame(spark, rows)).collect()
    assert sorted(map(str, map(tuple, got))) == plain(list(damage(rows)), [r[0] for r in rows])
    assert repair.report(frame(spark, rows), frame(spark, rows)).count() == len({r[0] for r in rows})


@pytest.mark.parametrize("seed", [1, 2])
def test_a_conversation_over_many_partitions(spark, many_parts, seed):
    rows = talk(5, 400, seed) + talk(6, 3, seed) + talk(4, 60, seed)
    layout = repair.laid_out(frame(spark, rows))
    behind, before = repair._chains(layout)
    assert len([k for k in behind if k[1] == (True, 5)]) > 3 and behind.keys() == before.keys()
    got = repair.report(frame(spark, rows), frame(spark, rows)).collect()
    assert sorted(map(str, map(tuple, got))) == plain(rows, [r[0] for r in rows])


def test_edits_give_the_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "assistant", "Hm"), (1, 2, "user", ""), (2, 0, "user", "Q?")]
    got = [tuple(r)[3:] for r in repair.edits(frame(spark, rows)).orderBy("conv_id", "part", "place").collect()]
    assert [(r[0], r[4], r[5], r[6], r[7]) for r in got] == [
        ("R", "user", "Hi.", None, 2), ("K", "assistant", "Hm", "truncated", 1), ("D", None, None, "blank", 3),
        ("K", "user", "Q?", None, 0), ("I", "assistant", "", None, 2),
    ]
    assert repair.report(frame(spark, []), frame(spark, [])).count() == 0
    lost = repair.report(frame(spark, []), frame(spark, rows)).collect()
    assert {tuple(r)[1:] for r in lost} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_prices_are_dual_feasible_and_exact():
    rnd = random.Random(3)
    for _ in range(200):
        codes = bytes(rnd.randrange(8) for _ in range(rnd.randrange(1, 12)))
        ends = tuple(rnd.choice([0, 1, 2, 4, repair.FAR]) for _ in range(4))
        price, arcs = repair.auction(codes, ends)
        true = [repair.FAR] * (4 * len(codes)) + list(ends)
        for _ in range(3):
            for node in range(4 * len(codes) - 1, -1, -1):
                true[node] = min([true[node]] + [c + true[t] for _, c, t in arcs[node]])
        assert all(price[n] <= c + price[t] or price[n] == repair.FAR for n, out in enumerate(arcs) for _, c, t in out)
        assert price[:4] == [min(t, repair.FAR) for t in true[:4]]
