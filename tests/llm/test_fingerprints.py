"""Closed syncmers against a plain version, and their edge cases."""

import base64
import hashlib
import random
import re

import pytest

from corredor.llm import syncmers

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, key string, fingerprint string, n_chars long, _w int, own string, place long"


def md5(words):
    return hashlib.md5(" ".join(words).encode()).hexdigest()


def plain(text, k=6, s=2):
    words = WORD.findall(text or "")
    if len(words) < max(20, k) or len(text) > 24 * len(words):
        words = list(text or "")
    if len(words) < k:
        at = [0] if (text or "").strip(" ") else []
    else:
        small, w = [" ".join(words[i : i + s]).encode() for i in range(len(words) - s + 1)], k - s + 1
        at = [i for i in range(len(words) - k + 1) if small[i : i + w].index(min(small[i : i + w])) in (0, w - 1)]
    anchors, last = [], None
    for i in at:
        token = base64.b64encode(bytes.fromhex(md5(words[i : i + k])[:6])).decode()
        if token != last:
            anchors.append((i + 1, token))
        last = token
    out, before = [], 0
    for i, token in anchors:
        out.append(syncmers.GAPS[min(i - before, 35) - 1] + token)
        before = i
    return "".join(out)


def alike(a, b):
    cut = lambda f: {(f[i - 4 : i] if i else "") + f[i : i + 5] for i in range(0, len(f), 5)}
    a, b = cut(a), cut(b)
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def expected(rows, k=6, s=2):
    one = {(i, t or "") for i, t in rows}
    key = lambda d: hashlib.md5(f"{'-' if d[0] is None else d[0]}:{d[1]}".encode()).hexdigest()
    order = sorted(one, key=lambda d: (d[0] is None, -(d[0] or 0), key(d)))
    after = {d: order[(i + 1) % len(order)] for i, d in enumerate(order)}
    out = []
    for i, t in rows:
        t, nxt = t or "", after[i, t or ""][1]
        n = len(t)
        edited = t[: n - n // 3] + nxt[: n // 3]
        f, e, o = plain(t, k, s), plain(edited, k, s), plain(nxt, k, s)
        out.append((i, n, edited, f, e, alike(f, e), alike(f, o)))
    return sorted(map(str, out))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", "f", 1, 2, "o", 3) for i, t in rows], SCHEMA)


def texts(n):
    rnd = random.Random(5)
    words = ["the", "a", "ñandú", "Wort", "x" * 30, "日本語", "🙂", "1,5", "end.", "\n\n", "слово", "tab\t"]
    return [" ".join(rnd.choices(words, k=rnd.choice([0, 1, 3, 6, 25, 60]))) for _ in range(n)]


@pytest.mark.parametrize(("k", "s"), [(6, 2), (8, 3), (2, 1)])
def test_fingerprints_against_a_plain_version(spark, k, s):
    rows = list(enumerate(texts(40)))
    rows += [(100, None), (101, ""), (102, "   "), (103, "\n"), (104, "again " * 300), (105, "a" * 70), (106, "ab"), (107, "ab cd " * 4000), (108, "日本語の文章" * 40 + " " + "x y " * 15)]
    rows += [(None, "no id at all " * 9), (None, None), (7, "a second text of an id"), (3, rows[3][1]), (3, rows[3][1])]
    got = syncmers.edited_fingerprints(frame(spark, rows).repartition(5), k, s).collect()
    assert sorted(map(str, map(tuple, got))) == expected(rows, k, s)


def test_small_tables(spark):
    assert syncmers.edited_fingerprints(frame(spark, [])).count() == 0
    row = syncmers.edited_fingerprints(frame(spark, [(1, "one document, nothing else")])).first()
    assert row["edited"] == "one document, nothone docu" and row["near_next"] == 1.0
    with pytest.raises(ValueError):
        syncmers.with_fingerprint(frame(spark, []), k=2, s=2)


def test_passages_keep_their_anchors_and_copies_their_fingerprint(spark):
    rnd = random.Random(1)
    passage, noise = [" ".join(f"w{rnd.randrange(9**6)}" for _ in range(n)) for n in (300, 100)]
    frame_ = spark.createDataFrame([(passage, noise + " " + passage, passage, noise)], "a string, b string, c string, d string")
    for c in "abcd":
        frame_ = syncmers.with_fingerprint(frame_, c, f"f{c}")
    row = frame_.first()
    assert row["fa"] == row["fc"] and alike(row["fa"], row["fb"]) > 0.8 and alike(row["fa"], row["fd"]) == 0
    assert max(syncmers.GAPS.index(row["fa"][i]) + 1 for i in range(5, len(row["fa"]), 5)) <= 4  # k - s apart at most


def test_no_python_in_the_plan(spark):
    plan = syncmers.edited_fingerprints(frame(spark, [(1, "a"), (2, "b")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
