"""SQL for DuckDB with the rows of the registered queries, where SQL can say them."""

from __future__ import annotations

from tablelink.llm import url_rules

ORACLE: dict[str, str] = {}


def _op7_url_rules() -> str:
    parts = """
    SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages"""
    longest = sorted(url_rules.PLACE_RULES, key=lambda rule: -len(rule.name))
    fits = [
        (rule, f"((host = '{rule.host}' OR ends_with(host, '.{rule.host}')) AND starts_with(path, '{rule.path}'))")
        for rule in longest
    ]
    rule = " ".join(f"WHEN {fit} THEN '{rule.name}'" for rule, fit in fits)
    verdict = " ".join(f"WHEN {fit} THEN '{rule.action}'" for rule, fit in fits)
    blocked = " OR ".join(
        f"regexp_matches(host || ' ' || lower(path), '{rule.pattern}')"
        for rule in url_rules.pattern_rules()
    )
    return f"""
    SELECT page_id, host, path, CASE {rule} END AS rule,
           CASE {verdict} WHEN {blocked} THEN 'block' ELSE 'allow' END AS verdict
    FROM ({parts})"""


ORACLE["op7_url_rules"] = _op7_url_rules()

ORACLE["op2_top_k"] = """
    WITH scaled AS (
        SELECT vec_id, [CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT) for x in embedding] AS v
        FROM embeddings
        WHERE embedding IS NOT NULL
          AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
    scored AS (
        SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
               CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
        FROM scaled q JOIN scaled c ON q.vec_id <> c.vec_id
        WHERE q.vec_id % 20 = 0),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
        FROM scored)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20"""


def _op12_resampling() -> str:
    """crc32 byte by byte, for each different word."""
    def words(table: str) -> str:
        return (
            "SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
            "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word"
            + f"{', doc_id' if table == 'documents' else ''} FROM {table}"
        )

    return f"""
    WITH bits AS (
        SELECT [list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b:
                 CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END)
                for i in range(256)] AS steps),
    corpus AS (SELECT doc_id, word, count(*) AS n FROM ({words('documents')}) GROUP BY ALL),
    target AS (SELECT word, count(*) AS n FROM ({words('benchmark')}) GROUP BY ALL),
    named AS (SELECT DISTINCT word FROM (SELECT word FROM corpus UNION ALL SELECT word FROM target)),
    spelt AS (
        SELECT word, hex(encode(word)) AS digits FROM named),
    bytes AS (
        SELECT word, [CAST(('0x' || digits[2 * i + 1:2 * i + 2]) AS BIGINT)
                      for i in range(length(digits) // 2)] AS codes FROM spelt),
    bucketed AS (
        SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), codes), lambda c, b:
                 xor(c >> 8, steps[CAST(xor(c & 255, b) AS INTEGER) + 1])), CAST(4294967295 AS BIGINT)) % 10000 AS bucket
        FROM bytes, bits),
    s AS (SELECT bucket, sum(n) AS s FROM corpus JOIN bucketed USING (word) GROUP BY bucket),
    t AS (SELECT bucket, sum(n) AS t FROM target JOIN bucketed USING (word) GROUP BY bucket),
    totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS all_s, (SELECT coalesce(sum(t), 0) FROM t) AS all_t),
    gains AS (
        SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000)::DOUBLE
                 / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE))) AS BIGINT) AS gain
        FROM s LEFT JOIN t USING (bucket), totals),
    weights AS (
        SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight
        FROM corpus JOIN bucketed USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
    scored AS (
        SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
               coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || doc_id)[1:8] AS BIGINT)
                 + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
        FROM documents LEFT JOIN weights USING (doc_id)),
    ranked AS (
        SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n
        FROM scored WHERE n_features >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank
    FROM scored LEFT JOIN ranked USING (doc_id)"""


ORACLE["op12_resampling"] = _op12_resampling()
