"""Registered queries of the thirteen operators and the pipeline, with their oracle SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corredor.llm import chat, codes, exact, lines, minhash, mixing, packing, repair, substring, syncmers, token_counts, topk, toxicity
from corredor.llm.util import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.remove_repeats(table(spark, sf_dir, "documents"), 20)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lines.remove_repeated_lines(table(spark, sf_dir, "documents"), distance=None)
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), "classes")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), 1024)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), 3, 85)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"))
    return counts.select("*", (F.col("n_tokens") > 512).alias("over_limit"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    held = toxicity.held_out(F.col("doc_id")).alias("held_out")
    return toxicity.scores(docs, model).select("doc_id", held, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = f"{chat.END.strip()}{chat.START}assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionAll(extra)
    return chat.digests(chat.windows(turns))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = codes.compressed(table(spark, sf_dir, "embeddings"))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(codes.codebooks_sha256(books)).alias("codebooks_sha256"))


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return repair.report(repair.damaged(turns), turns)


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = syncmers.edited_fingerprints(table(spark, sf_dir, "documents"))
    digest = F.sha2("edited", 256).alias("edited_sha256")
    return rows.select("doc_id", "n_chars", digest, "fingerprint", "edited_fingerprint", "near_edited", "near_next")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_packing": op4_packing,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_mixing": op7_mixing,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_toxicity": op9_toxicity,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_vector_codes": op11_vector_codes,
    "op12_structure_repair": op12_structure_repair,
    "op13_fingerprints": op13_fingerprints,
}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def _vector_codes_sql() -> str:
    """Four rounds of assignment and averaging, then the codes, as one chain of common tables."""
    away = "sum((v.x - c.x) * (v.x - c.x)) AS w FROM v JOIN c{n} c ON c.g = v.g AND c.d = v.d GROUP BY v.vec_id, v.g, c.e"
    rounds = [
        f"""a{n} AS MATERIALIZED (
            SELECT vec_id, g, min(CAST(w AS BIGINT) * 256 + e) AS m FROM (SELECT v.vec_id, v.g, c.e, {away.format(n=n)}) GROUP BY vec_id, g)"""
        + (f""",
        c{n + 1} AS MATERIALIZED (
            SELECT c.g, c.e, c.d, coalesce(s.x, c.x) AS x FROM c{n} c LEFT JOIN (
                SELECT v.g, a.m % 256 AS e, v.d, CAST(floor(CAST(sum(v.x) AS DOUBLE) / count(*)) AS BIGINT) AS x
                FROM v JOIN a{n} a ON a.vec_id = v.vec_id AND a.g = v.g GROUP BY ALL) s ON s.g = c.g AND s.e = c.e AND s.d = c.d)""" if n < 4 else "")
        for n in range(5)
    ]
    return f"""
        WITH k AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL
                   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        u AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM k),
        v AS MATERIALIZED (SELECT vec_id, i // 16 AS g, i % 16 AS d, CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM u),
        f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k),
        c0 AS MATERIALIZED (SELECT v.g, f.e, v.d, v.x FROM v JOIN f USING (vec_id) WHERE f.e < 256),
        {", ".join(rounds)},
        r AS (SELECT vec_id, string_agg(printf('%02x', m % 256), '' ORDER BY g) AS code, CAST(sum(m // 256) AS BIGINT) AS error FROM a4 GROUP BY vec_id)
        SELECT r.vec_id, r.code, r.error, CAST(sum(r.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY g, e, d)) FROM c4) AS codebooks_sha256
        FROM r JOIN k USING (vec_id)"""


def _structure_repair_sql() -> str:
    """Forward dynamic programme over the rows: per state the least (cost, audit) and the text it gives."""
    put = lambda s, cost, op, said: f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{op}', 't': {s}.t || {said}}}"
    best = lambda *of: f"list_min([{', '.join(of)}])"
    far = "{'c': 1000000000, 'a': '', 't': ''}"
    delete = lambda s: put(s, 3, "D", "''")
    insert = lambda s, role: put(s, 2, "I", f"chr(10) || '{role}:'")
    keep = lambda s, x: f"CASE WHEN x = '{x}' THEN {put(s, 'cut', 'K', 'chr(10) || role || chr(58) || text')} ELSE {far} END"
    rerole = lambda s, role: put(s, "2 + cut", "R", f"chr(10) || '{role}:' || text")
    inserted = f"""SELECT *, {best('u1', insert('a0', 'user'))} AS u, {best('a0', insert(best('u1', insert('a0', 'user')), 'assistant'))} AS a FROM (
                SELECT *, q0 AS q, s0 AS s, {best('u0', insert('q0', 'user'), insert('s0', 'user'))} AS u1 FROM SOURCE)"""
    step = {
        "q0": delete("q"),
        "s0": best(delete("s"), keep("q", "s")),
        "u0": best(delete("u"), *[f for p in "qsa" for f in (keep(p, "u"), rerole(p, "user"))]),
        "a0": best(delete("a"), keep("u", "a"), rerole("u", "assistant")),
    }
    joined = "(SELECT r.*, p.q0, p.s0, p.u0, p.a0 FROM path p JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1)"
    moved = ", ".join(f"CASE WHEN forced THEN {delete(k)} ELSE {v} END AS {k}" for k, v in step.items())
    return rf"""
        WITH RECURSIVE tab AS (
            SELECT list(list_reduce(list_concat([n], range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t
            FROM range(256) r(n)),
        src AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
        crc AS (
            SELECT src.*, xor(list_reduce(list_concat([4294967295], [ascii(ch) FOR ch IN string_split(k, '')]),
                lambda c, b: xor(c >> 8, tab.t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM src, tab),
        dam AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM crc WHERE kind <> 0),
        num AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
                   rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS seen FROM dam),
        flt AS (
            SELECT *, left(role, 1) AS x, left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair,
                   CASE WHEN seen = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                        WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM num),
        r AS MATERIALIZED (SELECT *, fault IN ('blank', 'duplicate') AS forced, CAST(fault = 'truncated' AS INTEGER) AS cut FROM flt),
        path AS (
            SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, {{'c': 0, 'a': '', 't': ''}} AS q0, {far} AS s0, {far} AS u0, {far} AS a0 FROM r
            UNION ALL
            SELECT conv_id, i, {moved} FROM ({inserted.replace("SOURCE", joined)})),
        n AS (
            SELECT conv_id, count(*) AS rows, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                   count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                   count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
        e AS (SELECT p.conv_id, {best('q', 'a')} AS b FROM ({inserted.replace("SOURCE", "path")}) p JOIN n ON n.conv_id IS NOT DISTINCT FROM p.conv_id AND n.rows = p.i),
        o AS (SELECT DISTINCT conv_id FROM conversations)
        SELECT o.conv_id, CAST(coalesce(n.gaps, 0) AS BIGINT) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate,
               coalesce(n.truncated, 0) AS truncated, coalesce(n.illegal, 0) AS illegal, CAST(coalesce(e.b.c, 0) AS BIGINT) AS cost,
               coalesce(e.b.a, '') AS audit, sha256(coalesce(substr(e.b.t, 2), '')) AS repaired_sha256
        FROM o LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM o.conv_id"""


ORACLE: dict[str, str] = {
    "op1_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g
              FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM d WHERE len(w) >= 20)),
        again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM s) WHERE n > 1),
        gone AS (SELECT DISTINCT doc_id, i + k AS p FROM again, generate_series(0, 19) AS t(k)),
        words AS (SELECT doc_id, unnest(generate_series(1, len(w))) AS p, unnest(w) AS word FROM d)
        SELECT d.doc_id, CAST(len(any_value(d.w)) AS BIGINT) AS n_words, count(g.p) AS n_removed,
               sha256(coalesce(string_agg(CASE WHEN g.p IS NULL THEN word END, ' ' ORDER BY words.p), '')) AS kept_sha256
        FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN gone g ON g.doc_id = d.doc_id AND g.p = words.p
        GROUP BY d.doc_id""",
    "op5_minhash_near_dedup": rf"""
        WITH RECURSIVE l AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        sh AS (SELECT DISTINCT doc_id, s FROM (
            SELECT doc_id, array_to_string(w[i:i + 2], ' ') AS s
            FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM l WHERE len(w) >= 3)
            UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM l WHERE len(w) BETWEEN 1 AND 2)),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node)
        SELECT node AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id, node = min(root) AS kept
        FROM r LEFT JOIN n ON n.doc_id = node GROUP BY node""",
    "op3_exact_dedup": """
        WITH t AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
            FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
        FROM t""",
    "op8_exact_top_k": """
        WITH e AS (
            SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id IS NOT NULL),
        bad AS (SELECT DISTINCT vec_id FROM e WHERE x IS NULL OR NOT isfinite(x)),
        v AS (SELECT vec_id, i, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS w FROM e WHERE vec_id NOT IN (SELECT vec_id FROM bad)),
        s AS (
            SELECT a.vec_id AS query_id, b.vec_id, CAST(sum(a.w * b.w) AS BIGINT) AS score
            FROM v a JOIN v b ON a.i = b.i AND a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5""",
    "op13_fingerprints": r"""
        WITH t AS (
            SELECT doc_id, text, lead(text, 1, top) OVER (ORDER BY doc_id DESC) AS nxt
            FROM (SELECT doc_id, coalesce(text, '') AS text, first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC) AS top FROM documents)),
        e AS (
            SELECT doc_id, text, nxt, left(text, CAST(length(text) - length(text) // 3 AS BIGINT)) || left(nxt, CAST(length(text) // 3 AS BIGINT)) AS edited FROM t),
        x AS (SELECT doc_id, 0 AS side, text FROM e UNION ALL SELECT doc_id, 1, edited FROM e),
        w AS (SELECT doc_id, side, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM x),
        c AS (
            SELECT doc_id, side, text,
                   CASE WHEN len(w) >= 20 AND length(text) <= 24 * len(w) THEN w ELSE regexp_extract_all(text, '(?s).') END AS w FROM w),
        u AS (SELECT doc_id, side, len(w) AS n, unnest(w) AS tok, generate_subscripts(w, 1) AS i FROM c),
        h AS (
            SELECT *, tok || ' ' || lead(tok) OVER o AS h, tok || ' ' || lead(tok, 1) OVER o || ' ' || lead(tok, 2) OVER o || ' '
                   || lead(tok, 3) OVER o || ' ' || lead(tok, 4) OVER o || ' ' || lead(tok, 5) OVER o AS g
            FROM u WINDOW o AS (PARTITION BY doc_id, side ORDER BY i)),
        m AS (
            SELECT *, lead(h, 1) OVER o AS h2, lead(h, 2) OVER o AS h3, lead(h, 3) OVER o AS h4, lead(h, 4) OVER o AS h5
            FROM h WINDOW o AS (PARTITION BY doc_id, side ORDER BY i)),
        a AS (
            SELECT doc_id, side, i, to_base64(unhex(left(md5(g), 6))) AS t FROM m
            WHERE i <= n - 5 AND (h <= least(h2, h3, h4, h5) OR h5 < least(h, h2, h3, h4))
            UNION ALL SELECT doc_id, side, 1, to_base64(unhex(left(md5(array_to_string(w, ' ')), 6))) FROM c WHERE len(w) < 6 AND trim(text, ' ') <> ''),
        k AS (SELECT * FROM (SELECT *, lag(t) OVER (PARTITION BY doc_id, side ORDER BY i) AS before FROM a) WHERE before IS DISTINCT FROM t),
        f AS (
            SELECT *, lag(t) OVER o AS last,
                   substr('123456789abcdefghijklmnopqrstuvwxyz', CAST(least(i - coalesce(lag(i) OVER o, 0), 35) AS INTEGER), 1) || t AS item
            FROM k WINDOW o AS (PARTITION BY doc_id, side ORDER BY i)),
        l AS (
            SELECT doc_id, side, string_agg(item, '' ORDER BY i) AS fp, list_distinct(list(coalesce(last, '') || item)) AS keys FROM f GROUP BY ALL),
        z AS (SELECT x.doc_id, x.side, coalesce(l.fp, '') AS fp, coalesce(l.keys, []) AS keys FROM x LEFT JOIN l ON l.doc_id = x.doc_id AND l.side = x.side),
        n AS (SELECT doc_id, lead(doc_id, 1, top) OVER (ORDER BY doc_id DESC) AS after
              FROM (SELECT doc_id, max(doc_id) OVER () AS top FROM documents))
        SELECT e.doc_id, CAST(length(e.text) AS BIGINT) AS n_chars, sha256(e.edited) AS edited_sha256, own.fp AS fingerprint, ed.fp AS edited_fingerprint,
               CASE WHEN len(own.keys) + len(ed.keys) = 0 THEN 1.0
                    ELSE CAST(2 * len(list_intersect(own.keys, ed.keys)) AS DOUBLE) / (len(own.keys) + len(ed.keys)) END AS near_edited,
               CASE WHEN len(own.keys) + len(nx.keys) = 0 THEN 1.0
                    ELSE CAST(2 * len(list_intersect(own.keys, nx.keys)) AS DOUBLE) / (len(own.keys) + len(nx.keys)) END AS near_next
        FROM e JOIN n USING (doc_id) JOIN z own ON own.doc_id = e.doc_id AND own.side = 0 JOIN z ed ON ed.doc_id = e.doc_id AND ed.side = 1
        JOIN z nx ON nx.doc_id = n.after AND nx.side = 0""",
    "op11_vector_codes": _vector_codes_sql(),
    "op12_structure_repair": _structure_repair_sql(),
}
