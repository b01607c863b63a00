"""MinHash near-deduplication by a signature-coordinate inverted join.

A document's set holds its distinct word shingles; documents with equal sets are one class and travel as
one representative. A signature has ``COORDINATES`` minima. Two sets at the threshold agree in at least
``matches_for(percent)`` of them but for a chance of 4e-7 (binomial). Representatives are posted under
their rarest ``COORDINATES - matches + 1`` coordinate-value pairs only: pairs of documents with enough
matches must share one of them, and values that many documents share are skipped unless nothing rarer is
left. In a posting list collisions are counted on whole signatures, from visited to unvisited members only
(skip merging), so a list yields a spanning forest of its matching pairs and never all pairs.

Documents of one candidate component then meet with their full shingle sets, and links are confirmed
exactly; again visited members are skipped. Lists and components above ``block`` members are cut into
chunks, and every pair of chunks meets in a task of its own: nothing is dropped, no task grows without bound.

Null, empty and blank texts have empty sets: n_shingles 0, linked with nothing, kept. Texts with fewer
words than a shingle have their whole sequence as the one shingle. Repeated rows of an id share its
result; a null id is a document by itself. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corredor.llm.graph import components
from corredor.llm.util import gram_hashes, mix, runs, steps, strings, word_hashes, words_of, written

COORDINATES = 28
_MULTIPLIERS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)
_ADDENDS = mix(np.arange(101, COORDINATES + 101, dtype=np.uint64))


def matches_for(percent: int) -> int:
    """Least number of equal coordinates: 13 of 28 from 85 percent on, 11 from 80 percent on."""
    if percent < 80:
        raise ValueError("percent must be 80 or more")
    return 13 if percent >= 85 else 11


def shingle_sets(text: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out = []
    for i, j in steps(text):
        w = words_of(text.slice(i, j - i), lower=True)
        h = word_hashes(w)
        grams = gram_hashes(h, width)
        for a, b in zip(w.first[:-1], w.first[1:]):
            if b - a >= width:
                out.append(np.unique(grams[a : b - width + 1]))
            else:
                out.append(gram_hashes(h[a:b], b - a, seed=2 + int(b - a)) if b > a else np.zeros(0, dtype=np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets x coordinates) minima, upper 32 bits of a multiplicative hash; sets must not be empty."""
    out = np.zeros((len(sets), COORDINATES), dtype=np.uint32)
    if sets:
        flat = np.concatenate(sets)
        at = np.cumsum([0, *(len(s) for s in sets[:-1])])
        for k in range(COORDINATES):
            hashed = (flat * _MULTIPLIERS[k] + _ADDENDS[k]) >> np.uint64(32)
            out[:, k] = np.minimum.reduceat(hashed, at).astype(np.uint32)
    return out


def signed(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, signature), written once."""

    def sign(batches):
        for batch in batches:
            text = strings(batch.column(1))
            for i in range(0, len(text), 1000):
                part = text.slice(i, 1000)
                sets = shingle_sets(part, width)
                some = [k for k, s in enumerate(sets) if len(s)]
                sig = dict(zip(some, signatures([sets[k] for k in some])))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, 1000),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([sig[k].tobytes() if k in sig else None for k in range(len(sets))], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "set_key", "signature"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(rows.mapInArrow(sign, "doc_id long, n_shingles long, set_key binary, signature binary"), "minhash-signed")


def postings(reps: DataFrame, prefix: int) -> DataFrame:
    """(token, rep) for the rarest ``prefix`` coordinate-value pairs of each representative, shared ones only."""

    def spread(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES)
            token = sig.astype(np.int64) | (np.arange(COORDINATES, dtype=np.int64) << 32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(0).to_numpy(), COORDINATES)), pa.array(token.ravel())], ["rep", "token"]
            )

    every = reps.select("rep", "signature").mapInArrow(spread, "rep long, token long")
    shared = every.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    known = every.join(shared, "token")  # coordinates of df 1 are the rarest; they take the first places
    ranked = known.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    first = prefix - (COORDINATES - F.size("t"))
    kept = F.when(first > 0, F.slice("t", 1, F.greatest(first, F.lit(1))))
    return ranked.select("rep", F.explode(kept).alias("t")).select("rep", "t.token", "t.df")


def in_blocks(rows: DataFrame, key: str, member: str, size: str, block: int) -> DataFrame:
    """Adds ``piece``: groups above ``block`` rows are cut into chunks, each pair of chunks is a piece."""
    chunks = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64(F.col(member)), F.greatest(chunks, F.lit(1))).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), chunks - 1), lambda o: F.least(o, own).cast("long") * (1 << 24) + F.greatest(o, own)
    )
    pieces = F.when(chunks > 1, F.array_distinct(others)).otherwise(F.array(F.lit(-1).cast("long")))
    return rows.withColumn("piece", F.explode(pieces))


def matched(lists: DataFrame, matches: int) -> DataFrame:
    """(a, b): spanning forest of the pairs with enough matches in each posting list (or piece of it)."""

    def count(batches):
        for batch, bounds in runs(batches, ["token", "piece"]):
            reps = batch.column("rep").to_numpy()
            sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES)
            sizes = np.diff(bounds)
            two = bounds[:-1][sizes == 2]
            two = two[(sig[two] == sig[two + 1]).sum(axis=1) >= matches]
            a, b = [reps[two]], [reps[two + 1]]
            for lo, hi in zip(bounds[:-1][sizes > 2], bounds[1:][sizes > 2]):
                own = sig[lo:hi]
                x, y = forest(reps[lo:hi], lambda one, rest, own=own: (own[rest] == own[one]).sum(axis=1) >= matches)
                a.append(x)
                b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    # lists of a few dozen bytes each: as many tasks as the posts need, all lists of a task in one stream
    dealt = lists.repartition("token", "piece").sortWithinPartitions("token", "piece")
    return dealt.select("token", "piece", "rep", "signature").mapInArrow(count, "a long, b long")


def forest(ids: np.ndarray, linked) -> tuple[np.ndarray, np.ndarray]:
    """Visits from member to member; ``linked(one, rest)`` tells which unvisited places link to ``one``."""
    rest, a, b = np.arange(len(ids)), [], []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            one = queue.pop()
            hit = linked(one, rest)
            if hit.any():
                a.append(np.full(int(hit.sum()), ids[one]))
                b.append(ids[rest[hit]])
                queue += rest[hit].tolist()
                rest = rest[~hit]
    empty = np.zeros(0, dtype=np.int64)
    return np.concatenate([empty, *a]), np.concatenate([empty, *b])


def confirmed(rows: pa.Table, width: int, percent: int) -> pa.Table:
    """Links of full shingle sets within one candidate component (or a piece of it), as a spanning forest."""
    ids = rows.column("rep").to_numpy()
    text = strings(rows.column("text").combine_chunks())
    sets = shingle_sets(text, width)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets)
    _, code, seen = np.unique(flat, return_inverse=True, return_counts=True)
    at = np.concatenate([[0], np.cumsum(sizes)])
    # a set most of whose shingles nobody else here has cannot reach the threshold with anyone
    common = np.add.reduceat((seen[code] > 1).astype(np.int64), at[:-1]) if len(ids) else sizes
    live = np.flatnonzero(100 * common >= percent * sizes)
    codes = [code[at[i] : at[i + 1]] for i in live]
    size = sizes[live]
    mark = np.zeros(len(seen), dtype=bool)

    def linked(one, rest):
        hit = np.zeros(len(rest), dtype=bool)
        near = np.flatnonzero((100 * size[rest] >= percent * size[one]) & (100 * size[one] >= percent * size[rest]))
        mark[codes[one]] = True
        for lo in range(0, len(near), 2000):
            part = near[lo : lo + 2000]
            joined = np.concatenate([codes[r] for r in rest[part]])
            starts = np.cumsum(np.concatenate([[0], size[rest[part]][:-1]]))
            both = np.add.reduceat(mark[joined].astype(np.int64), starts)
            hit[part] = 100 * both >= percent * (size[one] + size[rest[part]] - both)
        mark[codes[one]] = False
        return hit

    a, b = forest(ids[live], linked)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85, block: int = 4000) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept. Links: 100 * common >= percent * union."""
    matches = matches_for(percent)
    rows = signed(docs, width)
    some = rows.filter("n_shingles > 0 and doc_id is not null")
    classes = some.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"))
    classes = written(classes, "minhash-classes")
    lists = in_blocks(postings(classes, COORDINATES - matches + 1), "token", "rep", "df", block)
    lists = lists.join(classes.select("rep", "signature"), "rep")
    groups = written(components(matched(lists, matches)), "minhash-groups")
    sizes = groups.groupBy("component").agg(F.count("*").alias("members"))
    placed = in_blocks(groups.join(sizes, "component"), "component", "node", "members", block)
    wanted = placed.select(F.col("node").alias("rep"), "component", "piece")
    # the members grow with the input: joined by shuffle at every size
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(wanted.hint("merge"), "rep")
    links = texts.groupBy("component", "piece").applyInArrow(lambda g: confirmed(g, width, percent), "a long, b long")
    found = components(links)
    named = classes.join(found, classes["rep"] == found["node"], "left").select(
        "set_key", F.coalesce("component", "rep").alias("component_id")
    )
    out = rows.join(named, "set_key", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )
    return out.select("*", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_representatives(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without near copies: of each component the smallest doc_id stays; all columns as they were."""
    kept = near_duplicates(docs, width, percent).filter("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept_id"]), "left_semi")
