"""The registered queries of the corpus operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import centroids, content_sort, decontaminate, langid, language_model, licenses, mixing, ngram_join, quality, rules, suffix_dedup, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents")).drop("spans")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.groups(_read(spark, sf_dir, "documents"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.summary(_read(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.evaluate(_read(spark, sf_dir, "documents"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.components(_read(spark, sf_dir, "documents"), words=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_read(spark, sf_dir, "embeddings"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(_read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_license_scan": op2_license_scan,
    "op3_mixing": op3_mixing,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_warc": op10_warc,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_quality_rules": op12_quality_rules,
}

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = f"regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SPACED = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
TOKENS = f"regexp_extract_all({LOWERED}, '[^\\x20\\x09-\\x0D]+')"



def _templates() -> str:
    text = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({t}, {text(label)}, {phrase}, {pairs}, {need}, {cell}, {tpos}, {text(a)}, {text(b)})" for t, label, phrase, pairs, need, cell, tpos, a, b in licenses.template_rows())


def _lloyd(k: int = 16, rounds: int = 3, size: int = 64) -> str:
    """CTEs c0 to c<rounds> (k, q) and a0 to a<rounds> (r, vec_id, q, k, d) over p (r, vec_id, q)."""
    out = [f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), q) - 1 AS k, q FROM p QUALIFY k < {k})"]
    for i in range(rounds + 1):
        d = f"list_sum(list_transform(range(1, {size + 1}), lambda i: (p.q[i] - c.q[i]) * (p.q[i] - c.q[i])))"
        out.append(f"a{i} AS (SELECT r, vec_id, q, k, d FROM (SELECT p.r, p.vec_id, p.q, c.k, CAST({d} AS BIGINT) AS d FROM p, c{i} c) t QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)")
        if i < rounds:
            out.append(f"s{i} AS (SELECT k, j, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(range(1, {size + 1})) AS j, unnest(q) AS x FROM a{i}) t GROUP BY k, j)")
            out.append(f"m{i} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS q FROM s{i} GROUP BY k)")
            out.append(f"c{i + 1} AS (SELECT c.k, coalesce(m.q, c.q) AS q FROM c{i} c LEFT JOIN m{i} m ON m.k = c.k)")
    return ",\n             ".join(out)


def _fail_bits() -> str:
    """The rules of ``rules.RULES``, in SQL; tests hold both against each other."""
    rules_sql = [
        "n_words < 20", "100 * n_repeat_words > 30 * n_words", "10 * n_symbols > n_words", "100 * n_dup_lines > 30 * n_lines",
        "word_chars < 3 * n_words OR word_chars > 10 * n_words", "100 * n_capitals > 40 * word_chars", "100 * n_bullet_lines > 90 * n_lines",
    ]
    return " + ".join(f"CASE WHEN {x} THEN {1 << i} ELSE 0 END" for i, x in enumerate(rules_sql))


ORACLES = {
    "op2_license_scan": f"""
        WITH k(t, label, phrase, pairs, need, cell, tpos, a, b) AS (VALUES {_templates()}),
             d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
             p AS (SELECT r, w, unnest(range(1, len(w))) AS s FROM d),
             v AS (SELECT r, t, label, phrase, pairs, need, s - 1 AS pos, tpos, CAST(floor((s - 1 - tpos) / cell) AS BIGINT) AS own FROM p JOIN k ON w[s] = a AND w[s + 1] = b),
             e AS (SELECT *, unnest(CASE WHEN phrase THEN [own] ELSE [own - 1, own] END) AS bundle FROM v),
             g AS (SELECT r, t, label, phrase, pairs, need, bundle, min(pos) AS first, list([tpos] ORDER BY pos, tpos DESC) AS votes FROM e GROUP BY ALL HAVING count(DISTINCT tpos) >= need),
             c AS (SELECT *, len(list_reduce(votes, lambda x, y: list_concat(list_filter(x, lambda i: i < y[1]), y, list_filter(x, lambda i: i >= y[1])[2:]), CAST([] AS INTEGER[]))) AS n FROM g),
             f AS (SELECT * FROM c WHERE n >= need),
             o AS (SELECT r, CAST(count(*) FILTER (WHERE phrase) AS BIGINT) AS n_base, min(first) FILTER (WHERE phrase) AS first_word, max(first) FILTER (WHERE phrase) AS last_word,
                          string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE phrase) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(n / pairs) AS score
                   FROM f GROUP BY r)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(o.n_base, 0) AS n_base, CAST(o.first_word AS BIGINT) AS first_word, CAST(o.last_word AS BIGINT) AS last_word,
               coalesce(o.base_labels, '') AS base_labels, coalesce(o.labels, '') AS labels, CAST(coalesce(o.score, 0) AS DOUBLE) AS score
        FROM d LEFT JOIN o ON d.r = o.r
    """,
    "op4_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
             g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size,
               d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g ON d.t = g.t
    """,
    "op7_ngram_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {TOKENS} AS w FROM documents),
             g AS (SELECT doc_id, w, least(4, len(w)) AS k FROM d WHERE len(w) > 0),
             p AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM g),
             s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, s, s + k - 1), ' ') AS gram FROM p),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
             c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
             l AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * c.c >= 85 * (x.n + y.n - c.c)),
             e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
             r(id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id),
             m AS (SELECT id, min(c) AS component_id FROM r GROUP BY id)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
        FROM d JOIN m ON m.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
    """,
    "op8_benchmark_decontamination": f"""
        WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
             b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {WORDS} AS v FROM benchmark),
             i AS (SELECT item_id, v, least(10, len(v)) AS k FROM b WHERE len(v) > 0),
             q AS (SELECT item_id, v, k, unnest(range(1, len(v) - k + 2)) AS s FROM i),
             g AS (SELECT item_id, k, s AS q, array_to_string(list_slice(v, s, s + k - 1), ' ') AS gram FROM q),
             z AS (SELECT DISTINCT k FROM g),
             p AS (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS s FROM d, z WHERE len(w) >= k),
             o AS (SELECT doc_id, k, s, array_to_string(list_slice(w, s, s + k - 1), ' ') AS gram FROM p),
             h AS (SELECT o.doc_id, o.s, o.k, g.item_id, o.s - g.q AS diagonal FROM o JOIN g ON o.k = g.k AND o.gram = g.gram),
             r AS (SELECT *, s - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY s) AS run FROM h),
             m AS (SELECT doc_id, item_id, min(s) - 1 AS place, max(s) - min(s) + max(k) AS n FROM r GROUP BY doc_id, item_id, diagonal, run),
             x AS (SELECT doc_id, item_id, place, n FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, item_id, place) = 1),
             u AS (SELECT doc_id, unnest(range(s, s + k)) AS place FROM (SELECT DISTINCT doc_id, s, k FROM h) y),
             c AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM u GROUP BY doc_id),
             t AS (SELECT DISTINCT doc_id, item_id FROM h),
             n AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM t GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
               sha256(coalesce(n.names, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated,
               CAST(coalesce(x.n, 0) AS BIGINT) AS longest_words, x.item_id AS longest_item, CAST(x.place AS BIGINT) AS longest_word
        FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN x ON x.doc_id = d.doc_id
    """,
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
             k AS (SELECT h, max(page_id) AS keep FROM p GROUP BY h),
             x AS (SELECT p.page_id, p.h, k.keep, sha1(p.h) AS hex FROM p JOIN k ON p.h = k.h),
             b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', substr(hex, i, 1))]), '') AS bits FROM x)
        SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substr(bits, j * 5 + 1, 1) AS INTEGER) + 8 * CAST(substr(bits, j * 5 + 2, 1) AS INTEGER) + 4 * CAST(substr(bits, j * 5 + 3, 1) AS INTEGER) + 2 * CAST(substr(bits, j * 5 + 4, 1) AS INTEGER) + CAST(substr(bits, j * 5 + 5, 1) AS INTEGER), 1)), '') AS payload_digest,
               CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to
        FROM b
    """,
    "op11_centroid_clustering": f"""
        WITH e AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
             p AS (SELECT r, vec_id, list_transform(v, lambda x: CAST(floor(64 * x) AS BIGINT)) AS q FROM e
                   WHERE len(v) = 64 AND len(list_filter(v, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
             {_lloyd()},
             i AS (SELECT k, CAST(sum(d) AS BIGINT) AS cluster_inertia FROM a3 GROUP BY k),
             w AS (SELECT q, count(*) AS copies FROM p GROUP BY q)
        SELECT a.vec_id, CAST(a.k AS INTEGER) AS cluster, a.d AS distance, i.cluster_inertia, CAST((SELECT sum(d) FROM a3) AS BIGINT) AS inertia,
               sha256(array_to_string(c.q, ',')) AS centroid_sha256, CAST(w.copies AS BIGINT) AS copies
        FROM a3 a JOIN c3 c ON c.k = a.k JOIN i ON i.k = a.k JOIN w ON w.q = a.q
    """,
    "op12_quality_rules": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {SPACED} AS w FROM documents),
             l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
             n AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (WHERE regexp_matches(line, '^[\\x20\\x09-\\x0D]*[-*•]')) AS n_bullet_lines
                   FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
             g AS (SELECT r, unnest(range(1, len(w) - 6)) AS s, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(list_slice(w, i, i + 7), ' '))) AS gram FROM d),
             x AS (SELECT r, s, count(*) OVER (PARTITION BY r, gram) AS c FROM g),
             y AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(s, s + 8)) AS p FROM x WHERE c > 1) u GROUP BY r),
             m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                          CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
                          coalesce(n_bullet_lines, 0) AS n_bullet_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(len(regexp_extract_all(t, '[A-Z]')) AS BIGINT) AS n_capitals
                   FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN y ON y.r = d.r),
             b AS (SELECT *, CAST({_fail_bits()} AS BIGINT) AS fail_bits FROM m)
        SELECT *, {rules.RULES_VERSION} AS rules_version, fail_bits & {rules.BASE} <> 0 AS base_failed, CAST(fail_bits & {rules.POLICIES[rules.CURRENT]} AS BIGINT) AS failed_bits, fail_bits & {rules.POLICIES[rules.CURRENT]} = 0 AS kept
        FROM b
    """,
}
