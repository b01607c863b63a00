"""Document fingerprints from closed syncmers, by SQL functions only.

A text is cut into words ``[^\\x20\\x09-\\x0D]+``; a text of fewer than 20 words, or with more than 24 code points a word
(scripts without blanks), is cut into code points. Of its ``k``-grams those are anchors whose leftmost smallest ``s``-gram
(in byte order) is their first or their last: whether a gram is an anchor depends on its own words only, so a passage keeps its
anchors wherever it stands. Where s-grams do not repeat, neighbouring anchors are at most k - s words apart.

The fingerprint lists the anchors in order, five characters each: the distance from the anchor before (base 36, ``z`` for
35 or more, the first counted from the start) and 24 bits of the gram's MD5 in base 64. Of equal neighbouring anchors the
first stays, so a text that repeats itself does not blow up. Anchors match by place: an anchor counts together with the
distance to its predecessor and with that predecessor, so a moved passage matches but for its first anchor and scattered
equal grams do not. ``likeness`` is twice the shared anchors over the anchors of both.

A text of fewer than ``k`` code points is one anchor. Null counts as empty. Texts of spaces only, fewer than ``k``, and empty
ones have an empty fingerprint; two of those are alike with 1, one of them and another text with 0. Texts are read whole at
every length; a row in work needs about thirty bytes of memory per byte of its text. Equal texts have equal fingerprints.
Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corredor.operators.windows import number_rows

BLANKS = r"[\x20\x09-\x0D]+"
SHORT, LONG = 20, 24
GAPS = "123456789abcdefghijklmnopqrstuvwxyz"
K, S = 6, 2


def with_fingerprint(df: DataFrame, text: str = "text", name: str = "fingerprint", k: int = K, s: int = S) -> DataFrame:
    """``df`` with the fingerprint of the string column ``text``."""
    if not 1 <= s < k:
        raise ValueError(f"s = {s} must be 1 or more and below k = {k}")
    w, keep = k - s + 1, df.columns
    gram = lambda n: "concat_ws(' ', " + ", ".join(f"_w[i + {j}]" for j in range(n)) + ")"
    # a k-gram of whole s-grams is put together from those
    whole = "concat_ws(' ', " + ", ".join(f"_h[i + {j}]" for j in range(0, k, s)) + ")" if k % s == 0 else gram(k)
    inner = _least([f"_h[i + {j}]" for j in range(1, w - 1)])
    edge = f"_h[i] <= _h[i + {w - 1}]"
    closed = f"CASE WHEN {edge} THEN _h[i] <= {inner} ELSE _h[i + {w - 1}] < {inner} END" if inner else "true"
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))
    # a column per step: each is evaluated once, however often a later one refers to it. Elements are taken by
    # place: slice() would copy the whole array each time
    rows = rows.withColumn("_w", F.array_remove(F.split("_t", BLANKS), ""))
    worded = (F.size("_w") >= max(SHORT, k)) & (F.length("_t") <= LONG * F.size("_w"))
    rows = rows.withColumn("_w", F.when(worded, F.col("_w")).when(F.col("_t") != "", F.split("_t", "")).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("_h", F.expr(f"CASE WHEN size(_w) >= {k} THEN transform(sequence(0, size(_w) - {s}), i -> {gram(s)}) END"))
    rows = rows.withColumn(
        "_at",
        F.expr(f"""CASE WHEN size(_w) >= {k} THEN filter(sequence(0, size(_w) - {k}), i -> {closed})
                   WHEN trim(_t) <> '' THEN array(0) ELSE array() END"""),
    )
    token = f"base64(unhex(substring(md5(if(_h IS NULL, array_join(_w, ' '), {whole})), 1, 6)))"
    rows = rows.withColumn("_a", F.expr(f"transform(_at, i -> {token})"))
    rows = rows.withColumn("_j", F.expr("CASE WHEN size(_a) > 0 THEN filter(sequence(0, size(_a) - 1), j -> j = 0 OR _a[j] <> _a[j - 1]) ELSE array() END"))
    item = f"transform(_j, (j, n) -> concat(substring('{GAPS}', least(_at[j] - if(n = 0, -1, _at[_j[n - 1]]), 35), 1), _a[j]))"
    return rows.select(*[F.col(f"`{c}`") for c in keep], F.array_join(F.expr(item), "").alias(name))


def _least(values: list[str]) -> str:
    return f"least({', '.join(values)})" if len(values) > 1 else "".join(values)


def anchors_of(fingerprint: Column) -> Column:
    """Distinct anchors with the distance to their predecessor and that predecessor, as 64-bit hashes."""
    raw = fingerprint.cast("binary")  # of binary, unlike of strings, a part is cut without reading what is before it
    count = (F.length(fingerprint) / 5).cast("int")
    key = lambda i: F.xxhash64(F.when(i == 0, F.substring(raw, 1, 5)).otherwise(F.substring(raw, i * 5 - 3, F.lit(9))))
    return F.array_distinct(F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), key)).otherwise(F.array().cast("array<bigint>")))


def likeness(left: str, right: str) -> Column:
    """Shared share of two anchor columns of ``anchors_of`` (0 to 1); two empty ones are alike."""
    both = F.size(left) + F.size(right)
    return F.when(both == 0, F.lit(1.0)).otherwise(F.lit(2.0) * F.size(F.array_intersect(left, right)) / both)


def _named(docs: DataFrame) -> DataFrame:
    """Documents under a key of id and text: rows equal in both are one document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ident = F.col("doc_id").cast("long")
    key = F.md5(F.concat(F.coalesce(ident.cast("string"), F.lit("-")), F.lit(":"), text))
    return docs.select(key.alias("key"), ident.alias("doc_id"), text.alias("text"))


def neighbours(docs: DataFrame) -> DataFrame:
    """(key, doc_id, n_chars, next_key): each document with the next by descending id; the last is followed by the first.

    Ids only are laid out and numbered; ties of ids go by key and a null id comes last.
    """
    one = _named(docs).groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min(F.length("text")).alias("n_chars"))
    placed = number_rows(one, [F.col("doc_id").desc_nulls_last(), F.col("key")], "place")
    size = max(placed.count(), 1)
    after = placed.select(F.col("place").alias("_p"), F.col("key").alias("next_key"))
    return placed.join(after, F.pmod("place", F.lit(size)) + 1 == F.col("_p")).select("key", "doc_id", "n_chars", "next_key")


def edited_fingerprints(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """Each document row with its edited text, both fingerprints and the likeness to the edited and to the next text.

    The edit replaces the last floor(n_chars / 3) code points by the first as many, or all, of the next document.
    Rows of ``docs`` that are equal in id and text are one document, and each of them is returned; an only document
    is its own successor; an empty table gives no rows. Texts are shuffled once, by document; what the document before
    needs of them (its replacement and a fingerprint) once more.
    """
    base = _named(docs).select("key", "text")
    pairs = neighbours(docs).withColumnRenamed("key", "own")
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    # fingerprints come after the shuffle of the texts: both joins can then read the same one
    beside = pairs.join(base, pairs["next_key"] == base["key"]).select("own", "doc_id", "n_chars", "text")
    beside = with_fingerprint(beside, "text", "next_fp", k, s).select(
        "own", F.struct("doc_id", "n_chars", F.substring("text", F.lit(1), cut).alias("head"), "next_fp").alias("b")
    )
    beside = beside.groupBy("own").agg(F.first("b").alias("b")).select("own", "b.*")
    rows = base.join(beside, base["key"] == beside["own"])
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - cut), "head"))
    rows = with_fingerprint(rows.select("doc_id", "n_chars", "text", "edited", "next_fp"), "text", "fingerprint", k, s)
    rows = with_fingerprint(rows.drop("text"), "edited", "edited_fingerprint", k, s)
    keyed = rows.withColumns({f"_k_{c}": anchors_of(F.col(c)) for c in ("fingerprint", "edited_fingerprint", "next_fp")})
    return keyed.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited", "fingerprint", "edited_fingerprint",
        likeness("_k_fingerprint", "_k_edited_fingerprint").alias("near_edited"),
        likeness("_k_fingerprint", "_k_next_fp").alias("near_next"),
    )
