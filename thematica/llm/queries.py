"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, langid, near_dedup, packing, paragraphs, passages, pieces, prefix_trie, quality, rules, search, simhash, substrings, warc
from .shared import table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return passages.remove_passages(paragraphs.remove_repeated(docs, removed="removed"), removed="words_removed")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, table(spark, sf_dir, "pages"), langid.train(docs))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op6_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    asked = docs.where("doc_id % 20 = 0")  # the stated query set
    return search.search_documents(docs, asked, query_id="doc_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op8_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(table(spark, sf_dir, "documents"))


def _rules_sql() -> str:
    pm = {"symbols": "1000 * n_symbols // greatest(word_chars, 1)", "dup_lines": "1000 * n_dup_lines // greatest(n_lines, 1)",
          "repeats": "1000 * n_repeat_words // greatest(n_words, 1)", "upper": "1000 * n_upper // greatest(word_chars, 1)",
          "word_length": "10 * word_chars // greatest(n_words, 1)"}
    values = ", ".join(f"least(1000, {pm[m]}) AS m_{m}" for m, _, _ in rules.MEASURES)
    stack = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, m_{m} AS bin FROM c WHERE NOT base_failed"
                               for m, _, _ in rules.MEASURES)

    def fence(name, by):
        keys = "".join(f"{b}, " for b in by)
        part = f"PARTITION BY {keys}measure"
        cols = []
        for m, up, down in rules.MEASURES:
            cols.append(f"max(hi + {rules.FENCE} * (hi - lo) + {up}) FILTER (measure = '{m}') AS hi_{m}")
            if down is not None:
                cols.append(f"max(lo - {rules.FENCE} * (hi - lo) - {down}) FILTER (measure = '{m}') AS lo_{m}")
        return f"""{name}_q AS (
          SELECT {keys}measure, max(k) AS n, min(bin) FILTER (4 * r >= k) AS lo, min(bin) FILTER (4 * r >= 3 * k) AS hi
          FROM (SELECT *, row_number() OVER ({part} ORDER BY bin) AS r, count(*) OVER ({part}) AS k FROM bins)
          GROUP BY {keys}measure),
        {name} AS (SELECT {keys}max(n) AS n, {', '.join(cols)} FROM {name}_q {'GROUP BY ' + ', '.join(by) if by else ''})"""

    tests = []
    for m, _, down in rules.MEASURES:
        pick = lambda side: f"CASE level WHEN 'source' THEN s.{side}_{m} WHEN 'lang' THEN l.{side}_{m} ELSE a.{side}_{m} END"  # noqa: E731,B023
        tests.append(f"coalesce(m_{m} <= {pick('hi')}, true)")
        if down is not None:
            tests.append(f"coalesce(m_{m} >= {pick('lo')}, true)")
    space = r"[\x20\x09-\x0D]+"
    return f"""
    WITH d AS (
      SELECT row_number() OVER () AS id, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
    w AS (
      SELECT *, list_filter(string_split_regex(text, '{space}'), lambda x: x <> '') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
    g AS (
      SELECT id, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS gram,
        unnest(range(1, len(ws) - 1)) AS p FROM w WHERE len(ws) >= 3),
    rep AS (
      SELECT id, count(DISTINCT p + o) AS n_repeat_words
      FROM (SELECT id, p, count(*) OVER (PARTITION BY id, gram) AS k FROM g), (VALUES (0), (1), (2)) AS t(o)
      WHERE k >= 2 GROUP BY id),
    n AS (
      SELECT w.id, doc_id, lang, source, len(ws)::BIGINT AS n_words,
        length(regexp_replace(text, '{space}', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_upper
      FROM w LEFT JOIN rep USING (id)),
    c AS (
      SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words AS base_failed,
        {values} FROM n),
    bins AS ({stack}),
    {fence('s', ['lang', 'source'])},
    {fence('l', ['lang'])},
    {fence('a', [])},
    j AS (
      SELECT c.*, CASE WHEN coalesce(s.n, 0) >= {rules.MIN_ROWS} THEN 'source'
        WHEN coalesce(l.n, 0) >= {rules.MIN_ROWS} THEN 'lang' ELSE 'all' END AS level, s, l, a
      FROM c LEFT JOIN s ON c.lang IS NOT DISTINCT FROM s.lang AND c.source IS NOT DISTINCT FROM s.source
      LEFT JOIN l ON c.lang IS NOT DISTINCT FROM l.lang CROSS JOIN a)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT base_failed AND {' AND '.join(tests)} AS kept, level FROM j"""


def _trie_sql() -> str:
    crc = """xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(c::VARCHAR, ''),
        lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"""
    return f"""
    WITH named AS (
      SELECT conv_id, turn, strlen(x) AS size, left(sha256(strlen(r)::VARCHAR || ':' || r || x), 32) AS name
      FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
    t AS MATERIALIZED (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, name) AS p FROM named),
    ids AS MATERIALIZED (SELECT c, {crc} % {prefix_trie.HEADS} AS h FROM (SELECT DISTINCT conv_id AS c FROM named)),
    parts AS (
      SELECT c, 0 AS part, p, name, size FROM ids JOIN t ON t.conv_id = c - c % {prefix_trie.FAMILY} WHERE p <= h
      UNION ALL SELECT c, 1, p, name, size FROM ids JOIN t ON t.conv_id = c WHERE p > h),
    paths AS (
      SELECT c, coalesce(names, []) AS names, coalesce(sizes, []) AS sizes FROM ids LEFT JOIN (
        SELECT c, list(name ORDER BY part, p) AS names, list(size ORDER BY part, p) AS sizes FROM parts GROUP BY c) USING (c)),
    prefixes AS (
      SELECT c, d, array_to_string(names[1:d], '') AS path, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size, len(names) = d AS ends
      FROM (SELECT *, unnest(range(0, len(names) + 1)) AS d FROM paths)),
    nodes AS MATERIALIZED (
      SELECT path, d, min(c) AS conv_id, count(*) AS n, max(size) AS size,
        sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
      FROM prefixes GROUP BY path, d),
    kids AS (SELECT left(path, 32 * (d - 1)::INT) AS path, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL),
    below AS (
      SELECT left(path, 32 * j::INT) AS path, sum(CASE WHEN k IS NULL THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * size) AS saved
      FROM (SELECT nodes.*, k, unnest(range(0, d + 1)) AS j FROM nodes LEFT JOIN kids USING (path)) GROUP BY ALL)
    SELECT nodes.conv_id, nodes.d AS depth, up.conv_id AS parent_conv_id, nodes.n AS n_convs, coalesce(k, 0) AS n_children,
      leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, nodes.ends_sha256
    FROM nodes JOIN below USING (path) LEFT JOIN kids USING (path)
    LEFT JOIN nodes up ON nodes.d > 0 AND up.path = left(nodes.path, 32 * (nodes.d - 1)::INT)"""


def _centroids_sql() -> str:
    def assigned(i: int) -> str:
        return f"""a{i} AS MATERIALIZED (
          SELECT id, vec_id, v, c, d FROM (
            SELECT id, vec_id, k.v, c, list_dot_product(k.v, k.v) - 2 * list_dot_product(k.v, m.v) + list_dot_product(m.v, m.v) AS d
            FROM k, c{i} m) QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, c) = 1)"""

    steps = []
    for i in range(centroids.ROUNDS):
        steps.append(assigned(i))
        steps.append(f"""c{i + 1} AS MATERIALIZED (
          SELECT c, coalesce(mean, v) AS v FROM c{i} LEFT JOIN (
            SELECT c, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY p) AS mean FROM (
              SELECT c, p, sum(x::BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM a{i}) GROUP BY c, p)
            GROUP BY c) USING (c))""")
    last = centroids.ROUNDS
    return f"""
    WITH k AS MATERIALIZED (
      SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor({centroids.SCALE:g} * x::DOUBLE)) AS v FROM embeddings
      WHERE len(embedding) = {centroids.WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    c0 AS MATERIALIZED (
      SELECT row_number() OVER (ORDER BY sha256('{centroids.SEED}:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v FROM k QUALIFY c < {centroids.K}),
    {', '.join(steps)}, {assigned(last)}
    SELECT vec_id, c::INT AS cluster, d::BIGINT AS distance, sum(d::BIGINT) OVER (PARTITION BY c)::BIGINT AS cluster_inertia,
      sum(d::BIGINT) OVER ()::BIGINT AS inertia, sha256(array_to_string(list_transform(m.v, lambda x: x::BIGINT::VARCHAR), ',')) AS centroid_sha256
    FROM a{last} JOIN c{last} m USING (c)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_paragraph_dedup": op2_paragraph_dedup,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_language_id": op4_language_id,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_search": op6_search,
    "op7_quality": op7_quality,
    "op8_adaptive_rules": op8_adaptive_rules,
    "op9_warc": op9_warc,
    "op10_packing": op10_packing,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_simhash": op12_simhash,
    "op13_centroids": op13_centroids,
    "pipeline": pipeline,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {"op8_adaptive_rules": _rules_sql(), "op11_prefix_trie": _trie_sql(), "op13_centroids": _centroids_sql()}
