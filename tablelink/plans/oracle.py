"""The queries of queries.py as SQL over the same tables, for DuckDB."""

from __future__ import annotations

from tablelink.functions.prompts import TEMPLATES, template_fields

# As in queries.py.
SPARSE_STEP, SPARSE_SHIFT = 92_233_720_368, 1 << 50

_ROWS = """b_rows AS (
  SELECT p_partkey, p_name, p_type, p_size, p_brand AS table_name,
         row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS row_no
  FROM part)"""

_CELLS = """b_cells AS (
  SELECT p_partkey, table_name, row_no, 0 AS col_no, 'name' AS col_name, p_name AS value FROM b_rows
  UNION ALL
  SELECT p_partkey, table_name, row_no, 1, 'type', CASE WHEN p_type <> 'PROMO' THEN p_type END FROM b_rows
  UNION ALL
  SELECT p_partkey, table_name, row_no, 2, 'size', CAST(p_size AS VARCHAR) FROM b_rows)"""

_ENTITIES = """b_entities AS (
  SELECT 'Q' || p_partkey AS id, p_name AS label,
         CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS description,
         CASE WHEN p_type = 'ECONOMY' THEN '[]'
              ELSE '[{"id": "Q9", "name": "' || p_type || '"}]' END AS types,
         p_partkey
  FROM part)"""

_CANDIDATES = """b_candidates AS (
  SELECT m.table_name AS "tableName", m.table_name || ' ' || m.row_no || ' 0' AS key,
         m.p_partkey AS "group", 'Q' || c.cand_pos AS id,
         'line "' || l_linenumber || '" of ' || l_orderkey AS name,
         CASE WHEN l_orderkey % 7 <> 0 THEN 'order ' || l_orderkey END AS description,
         CASE WHEN l_linenumber = 1 THEN '[]'
              ELSE '[{"id": "Q9", "name": "line ' || l_linenumber || '"}]' END AS types,
         CASE WHEN l_orderkey % 5 = 0 AND m.p_partkey % 10 <> 0 THEN 1 ELSE 0 END AS target,
         c.cand_pos
  FROM (SELECT *, CASE WHEN l_linenumber >= 6 THEN 1 ELSE l_partkey END AS part,
               l_orderkey * 8 + l_linenumber AS cand_pos FROM lineitem) c
  JOIN b_rows m ON m.p_partkey = c.part)"""

_META = """b_meta AS (
  SELECT 'Brand#' || n_nationkey AS table_name,
         CASE WHEN n_nationkey <> 3 THEN n_name END AS title,
         'region ' || n_regionkey AS summary
  FROM nation)"""

_ALLOW = """b_allow AS (
  SELECT 'D1' AS dataset, table_name || ' ' || row_no || ' 0' AS key
  FROM b_rows WHERE p_partkey % 3 <> 0)"""

_ALLOW_TABLES = """b_allow_tables AS (
  SELECT 'Brand#' || c_nationkey AS "tableName" FROM customer WHERE c_nationkey % 2 = 0)"""

_GOLD = """b_gold AS (
  SELECT "group", min("tableName") AS "tableName", min(key) AS key,
         coalesce('Q' || min(CASE WHEN target = 1 THEN cand_pos END), '0') AS gold,
         min(cand_pos) AS first, max(cand_pos) AS last, count(*) AS n_candidates
  FROM b_candidates GROUP BY "group")"""

_CONFIGS = """b_configs(config, shift, iter) AS (
  VALUES ('table', 0, 0), ('table', 0, 1), ('table', 0, 2),
         ('title_summary', 3, 0), ('title_summary', 3, 1), ('title_summary', 3, 2),
         ('title_only', 5, 0))"""

_RUNS = """b_chosen AS (
  SELECT c.config, c.shift, c.iter, g."group", g.gold,
         CASE WHEN (g."group" + c.iter + c.shift) % 10 = 0 THEN 'Q' || g.last
              WHEN g.gold = '0' THEN 'Q' || g.first ELSE g.gold END AS id
  FROM b_gold g CROSS JOIN b_configs c
  WHERE c.iter <> 2 OR g."group" % 50 <> 7),
b_runs AS (
  SELECT 'D1' AS dataset, h.config, h.iter, h."group", h.gold,
         CASE WHEN (h."group" + h.iter + h.shift) % 8 < 3 THEN 'The answer is <[ID] ' || h.id || '>.'
              WHEN (h."group" + h.iter + h.shift) % 8 < 5 THEN h.id || ' is the match'
              WHEN (h."group" + h.iter + h.shift) % 8 < 7 THEN 'Compare Q999999999999 with <' || h.id || '>'
              ELSE 'I cannot tell' END AS output
  FROM b_chosen h),
b_scored AS (
  SELECT *, CASE WHEN gold = pred THEN 1 ELSE 0 END AS result FROM (
    SELECT *, coalesce(nullif(regexp_extract(output, '(Q[0-9]+)>', 1), ''),
                       nullif(regexp_extract(output, 'Q[0-9]+'), ''), '0') AS pred
    FROM b_runs))"""

_SFT = """b_sft AS (
  SELECT conv_id, turn, question, answer FROM (
    SELECT conv_id, turn, role, text AS question,
           lead(role) OVER w AS next_role, lead(text) OVER w AS answer
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant'),
b_texts AS (
  SELECT *, '### Question: ' || question || chr(10) || ' ### Answer: ' || answer AS text FROM b_sft)"""


def _json(text: str) -> str:
    """A JSON string of a text, built character by character."""
    return f"""'"' || coalesce(list_aggregate(list_transform(string_split({text}, ''), lambda c:
      CASE WHEN c = '"' THEN '\\"' WHEN c = '\\' THEN '\\\\'
           WHEN c = chr(10) THEN '\\n' WHEN c = chr(13) THEN '\\r' WHEN c = chr(9) THEN '\\t'
           WHEN c = chr(8) THEN '\\b' WHEN c = chr(12) THEN '\\f'
           WHEN unicode(c) BETWEEN 32 AND 126 THEN c
           WHEN unicode(c) < 65536 THEN printf('\\u%04x', unicode(c))
           ELSE printf('\\u%04x\\u%04x', 55296 + ((unicode(c) - 65536) >> 10),
                       56320 + ((unicode(c) - 65536) & 1023)) END), 'string_agg', ''), '') || '"'"""


_TAGGED = """'<[ID] ' || id || ' ' || replace(name, '"', '''') || ' [DESCRIPTION] '
  || coalesce(replace(description, '"', ''''), 'nan') || ' [TYPE] '
  || CASE WHEN types = '[]' THEN 'None' ELSE replace(types, '"', '''') END || '>,'"""

_PIPE = """id || ' | ' || replace(name, '"', '''') || ' | '
  || coalesce(replace(description, '"', ''''), 'nan') || ' | '
  || replace(replace(types, '"', ''), '''', '') || ','"""

_CAND_TEXT = f"""b_cand_text AS (
  SELECT "group", string_agg({_TAGGED}, '' ORDER BY cand_pos) AS cand
  FROM b_candidates GROUP BY "group")"""

_ROW_TEXT = """b_row_text AS (
  SELECT table_name, row_no,
         'col: | ' || string_agg(col_name || ' | ', '' ORDER BY col_no) || ' '
         || ' row ' || row_no || ': | '
         || string_agg(coalesce(value, 'nan') || ' | ', '' ORDER BY col_no) || ' ' AS row
  FROM b_cells GROUP BY table_name, row_no)"""


def _top(k: int) -> str:
    return f"""b_top AS (
  SELECT * FROM (
    SELECT lower(trim(label)) AS label_key, id, label, description,
           row_number() OVER (PARTITION BY lower(trim(label)) ORDER BY p_partkey, id) AS place
    FROM b_entities)
  WHERE place <= {k})"""


_WIKI = f"""b_wiki AS (
  SELECT label_key,
         string_agg('Result ' || id || ':' || chr(10) || 'Label: ' || label
           || coalesce(chr(10) || 'Description: ' || description, ''),
           chr(10) || chr(10) ORDER BY place) AS wiki_text
  FROM b_top GROUP BY label_key)"""


def _retrieval(policy: str, as_written: bool = False) -> str:
    other = "'candidates of ' || coalesce(c.value, 'nan')" if policy == "replace" else "''"
    if policy == "plain":
        wiki = f"""CASE WHEN c.value IS NULL THEN ''
          ELSE {_json("coalesce(w.wiki_text, 'No good Wikidata Search Result was found')")} END"""
    elif as_written:
        wiki = other
    else:
        wiki = f"CASE WHEN w.wiki_text IS NOT NULL THEN {_json('w.wiki_text')} ELSE {other} END"
    return f"""SELECT c.table_name, c.row_no, c.col_no, {wiki} AS wiki
      FROM b_cells c LEFT JOIN b_wiki w ON w.label_key = lower(trim(c.value))"""


# BM25 of every mention with every entity that shares a word.
_SEARCH = [
    """s_words AS (
  SELECT id, p_partkey, label, description,
         regexp_extract_all(lower(concat_ws(' ', label, description)), '[\\p{L}\\p{N}]+') AS bag
  FROM b_entities)""",
    """s_size AS (
  SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(len(bag)) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS mean
  FROM s_words WHERE len(bag) > 0)""",
    """s_tf AS (
  SELECT id, len(bag) AS n_words, word, CAST(count(*) AS DOUBLE) AS tf
  FROM (SELECT id, bag, unnest(bag) AS word FROM s_words) GROUP BY id, bag, word)""",
    """s_weight AS (
  SELECT word, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1.0::DOUBLE) AS weight
  FROM (SELECT word, CAST(count(*) AS DOUBLE) AS df FROM s_tf GROUP BY word), s_size)""",
    """s_impact AS (
  SELECT id, word, CAST(floor((weight * (tf * (1.2::DOUBLE + 1.0::DOUBLE))
           / (tf + (CAST(n_words AS DOUBLE) / mean * 0.75::DOUBLE + 0.25::DOUBLE) * 1.2::DOUBLE))
           * 1000000.0::DOUBLE) AS BIGINT) AS impact
  FROM s_tf JOIN s_weight USING (word), s_size)""",
    """s_mentions AS (
  SELECT *, list_sort(list_distinct(regexp_extract_all(lower(coalesce(mention, '')), '[\\p{L}\\p{N}]+'))) AS words
  FROM (SELECT table_name, row_no, col_no,
               CASE WHEN col_no = 0 THEN value || ' ' || table_name ELSE value END AS mention
        FROM b_cells))""",
    """s_top AS (
  SELECT * FROM (
    SELECT words, id, label, description, score,
           row_number() OVER (PARTITION BY words ORDER BY score DESC, p_partkey, id) AS place
    FROM (SELECT words, id, CAST(sum(impact) AS BIGINT) AS score
          FROM (SELECT words, unnest(words) AS word FROM (SELECT DISTINCT words FROM s_mentions))
          JOIN s_impact USING (word) GROUP BY words, id) JOIN s_words USING (id))
  WHERE place <= 5)""",
]


def _with(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


_BASE = [_ROWS, _ENTITIES, _CANDIDATES]
_RUN_CTES = [*_BASE, _GOLD, _CONFIGS, _RUNS]
_ALL = [
    _ROWS, _CELLS, _ENTITIES, _CANDIDATES, _GOLD, _META, _CAND_TEXT, _ROW_TEXT, _top(3), _WIKI,
]


def _context() -> str:
    """Everything a prompt may name, one row per mention."""
    return f"""b_context AS (
  SELECT g."group", g."tableName", g.key, g.gold, c.value AS mention, r.row, t.cand,
         w.wiki_text, {_json('w.wiki_text')} AS wiki_json,
         CASE WHEN m.table_name IS NULL THEN 'None' ELSE coalesce(m.title, 'nan') END AS title,
         CASE WHEN m.table_name IS NULL THEN 'None' ELSE coalesce(m.summary, 'nan') END AS summary
  FROM b_gold g
  JOIN b_rows p ON p.p_partkey = g."group"
  JOIN b_cells c ON c.table_name = p.table_name AND c.row_no = p.row_no AND c.col_no = 0
  JOIN b_row_text r ON r.table_name = p.table_name AND r.row_no = p.row_no
  JOIN b_cand_text t ON t."group" = g."group"
  LEFT JOIN b_wiki w ON w.label_key = lower(trim(c.value))
  LEFT JOIN b_meta m ON m.table_name = p.table_name)"""


def _prompt(template: str) -> str:
    """The template as SQL concatenation."""
    text = TEMPLATES[template].replace("'", "''")
    for field in template_fields(text):
        column = "wiki_json" if field == "wiki" else field
        text = text.replace("{" + field + "}", f"' || {column} || '")
    return f"'{text}'"


def _prompt_sql(template: str) -> str:
    return _with(
        [*_ALL, _context()],
        f'SELECT "group", key, gold, {_prompt(template)} AS prompt FROM b_context',
    )


def _run_sql(config: str, template: str, answer: str) -> str:
    return _with(
        [*_ALL, _context(), f"b_prompts AS (SELECT *, {_prompt(template)} AS prompt FROM b_context)"],
        f"""SELECT 'D1' AS dataset, '{config}' AS config, iter, "group", "tableName", key,
             CAST(length(prompt) AS INTEGER) AS prompt_length,
             {answer} || '<[ID] ' || regexp_extract(prompt, 'Q[0-9]+') || '>' AS output,
             gold, regexp_extract(prompt, 'Q[0-9]+') AS pred
      FROM b_prompts CROSS JOIN (VALUES (0), (1), (2)) AS r(iter)""",
    )


def _run_of(n: int) -> str:
    return f"""SELECT DISTINCT "group", gold, pred AS pred_{n} FROM b_scored
      WHERE config = 'table' AND iter = {n}"""


def _merged(*numbers: int) -> str:
    first, *others = numbers
    sql = _run_of(first)
    for n in others:
        before = ", ".join(f"l.pred_{m}" for m in numbers[: numbers.index(n)])
        sql = f"""SELECT DISTINCT coalesce(l."group", r."group") AS "group",
             coalesce(l.gold, r.gold) AS gold, {before}, r.pred_{n}
           FROM ({sql}) l FULL JOIN ({_run_of(n)}) r
             ON l."group" IS NOT DISTINCT FROM r."group" AND l.gold IS NOT DISTINCT FROM r.gold"""
    return sql


def _compared(*numbers: int) -> str:
    right = " AND ".join(f"coalesce(gold = pred_{n}, false)" for n in numbers)
    return _with(_RUN_CTES, f"SELECT * FROM ({_merged(*numbers)}) WHERE NOT ({right})")


_SCORES = """scores AS (
  SELECT a.dataset, a.config, a.iter, a.n, a.accuracy, f.f1 AS f1_all, g.f1 AS f1_non_nil
  FROM (SELECT dataset, config, iter, count(*) AS n, avg(result) AS accuracy
        FROM b_scored GROUP BY ALL) a
  JOIN (SELECT dataset, config, iter, sum(support * f1) / sum(support) AS f1 FROM (
          SELECT dataset, config, iter, entity, sum(s) AS support,
                 2.0 * sum(t) / nullif(sum(s) + sum(p), 0) AS f1
          FROM (SELECT dataset, config, iter, gold AS entity, 1 AS s, 0 AS p, result AS t FROM b_scored
                UNION ALL
                SELECT dataset, config, iter, pred, 0, 1, 0 FROM b_scored)
          GROUP BY ALL) GROUP BY ALL) f USING (dataset, config, iter)
  JOIN (SELECT dataset, config, iter, sum(support * f1) / sum(support) AS f1 FROM (
          SELECT dataset, config, iter, entity, sum(s) AS support,
                 2.0 * sum(t) / nullif(sum(s) + sum(p), 0) AS f1
          FROM (SELECT dataset, config, iter, gold AS entity, 1 AS s, 0 AS p, result AS t
                FROM b_scored WHERE gold <> '0'
                UNION ALL
                SELECT dataset, config, iter, pred, 0, 1, 0 FROM b_scored WHERE gold <> '0')
          GROUP BY ALL) GROUP BY ALL) g USING (dataset, config, iter))"""

_WRONG = """wrong AS (
  SELECT s.dataset, s.config, s."group", s.gold
  FROM b_scored s
  JOIN (SELECT dataset, config, count(DISTINCT iter) AS runs FROM b_scored GROUP BY ALL) c
    USING (dataset, config)
  GROUP BY s.dataset, s.config, s."group", s.gold, c.runs
  HAVING min(s.result) = 0 OR count(DISTINCT s.iter) < c.runs)"""

_LENGTHS = r"""lengths AS (
  SELECT conv_id, turn, CAST(len(regexp_extract_all(text, '\S+')) AS INTEGER) AS length FROM b_texts)"""


def _padded(cap: int) -> str:
    return _with(
        [
            _SFT,
            rf"""marked AS (
  SELECT conv_id, turn, list_concat(list_concat(['<s>'],
    list_slice(regexp_extract_all(text, '\S+'), 1, {cap} - 2)), ['</s>']) AS tokens FROM b_texts)""",
        ],
        f"""SELECT conv_id, turn, CAST({cap} AS INTEGER) AS n,
             repeat('</s> ', {cap} - len(tokens)) || array_to_string(tokens, ' ') AS input_ids,
             true AS same_labels
      FROM marked""",
    )


_WS = r"^[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_TRIM = rf"regexp_replace(regexp_replace(rest, '{_WS}', ''), '{_WS[1:]}$', '')"

ORACLE: dict[str, str] = {
    "mentions_allowed": _with(
        [*_BASE, _ALLOW],
        """SELECT "group", key, cand_pos, id, target FROM b_candidates
      WHERE key IN (SELECT key FROM b_allow WHERE dataset = 'D1')""",
    ),
    "tables_allowed": _with(
        [*_BASE, _ALLOW_TABLES],
        """SELECT "group", "tableName", cand_pos, id FROM b_candidates
      WHERE "tableName" IN (SELECT DISTINCT "tableName" FROM b_allow_tables)""",
    ),
    "one_mention": _with(
        _BASE,
        """SELECT "group", key, "tableName", cand_pos, id, name, description, types, target
      FROM b_candidates WHERE "group" = 77""",
    ),
    "key_parts": _with(
        [_ROWS],
        """SELECT p_partkey AS "group",
             ' ' || table_name || 's/+  ' || row_no || ' '
               || CASE WHEN p_type = 'PROMO' THEN 'x' ELSE '0' END || ' ' AS key,
             table_name, row_no,
             CASE WHEN p_type <> 'PROMO' THEN 0 END AS col_no
      FROM b_rows""",
    ),
    "key_parts_dash": _with(
        [_ROWS],
        """SELECT p_partkey AS "group",
             CASE WHEN p_type = 'PROMO' THEN table_name || '-a-2'
                  ELSE table_name || '-a-' || row_no || '-2' END AS key,
             CASE WHEN p_type <> 'PROMO' THEN table_name || '-a' END AS table_name,
             CASE WHEN p_type <> 'PROMO' THEN row_no END AS row_no,
             CASE WHEN p_type <> 'PROMO' THEN 2 END AS col_no
      FROM b_rows""",
    ),
    "allowlist_explode": _with([_ROWS, _ALLOW], "SELECT dataset, key FROM b_allow"),
    "gold_ids": _with(
        [*_BASE, _GOLD], 'SELECT "group", "tableName", key, gold, n_candidates FROM b_gold'
    ),
    "mention_places": _with(
        [*_BASE, _GOLD, _ALLOW, _ALLOW_TABLES],
        """SELECT g."group", g.key, g.gold, p.table_name, p.row_no, 0 AS col_no
      FROM b_gold g JOIN b_rows p ON p.p_partkey = g."group"
      WHERE g.key IN (SELECT key FROM b_allow)
        AND g."tableName" IN (SELECT "tableName" FROM b_allow_tables)""",
    ),
    "row_positions": """SELECT p_brand, p_partkey,
        row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS row_no FROM part""",
    "row_positions_sparse": """SELECT p_brand, p_partkey,
        row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS row_no FROM part""",
    "cell_lookup": _with(
        [_ROWS, _CELLS],
        """SELECT p.p_partkey AS "group", k.col_no, c.value AS mention, c.col_name,
             c.col_name IS NULL AS cell_missing
      FROM b_rows p CROSS JOIN (VALUES (0), (1), (3)) AS k(col_no)
      LEFT JOIN b_cells c ON c.table_name = p.table_name AND c.row_no = p.row_no
        AND c.col_no = k.col_no""",
    ),
    "row_text": _with(
        [_ROWS, _CELLS, _ROW_TEXT],
        """SELECT c.p_partkey AS "group", c.value AS mention, c.col_name,
             false AS cell_missing, r.row
      FROM b_cells c JOIN b_row_text r USING (table_name, row_no) WHERE c.col_no = 1""",
    ),
    "cells_from_files": _with(
        [_ROWS, _CELLS],
        """SELECT table_name || '-' || ((row_no - 1) // 1000) AS table_name,
             (row_no - 1) % 1000 + 1 AS row_no, col_no, col_name, value FROM b_cells""",
    ),
    "meta_join": _with(
        [_ROWS, _META],
        """SELECT p.p_partkey AS "group", p.table_name,
             CASE WHEN m.table_name IS NULL THEN 'None' ELSE m.title END AS title,
             CASE WHEN m.table_name IS NULL THEN 'None' ELSE m.summary END AS summary,
             m.table_name IS NOT NULL AS has_meta
      FROM b_rows p LEFT JOIN b_meta m ON m.table_name = p.table_name""",
    ),
    "meta_const": """SELECT p_partkey AS "group", 'Parts and their sizes' AS title,
        'One line per part: name, type and size.' AS summary, true AS has_meta FROM part""",
    "meta_missing_total": _with(
        [_ROWS, _META],
        """SELECT iter, count(*) FILTER (WHERE m.table_name IS NULL) AS missing
      FROM b_rows p LEFT JOIN b_meta m ON m.table_name = p.table_name
      CROSS JOIN (VALUES (0), (1), (2)) AS r(iter) GROUP BY iter""",
    ),
    "meta_missing_running": _with(
        [_ROWS, _META],
        """SELECT p.p_partkey AS "group", m.table_name IS NOT NULL AS has_meta,
             CAST(count(*) FILTER (WHERE m.table_name IS NULL) OVER (
               PARTITION BY iter ORDER BY p.p_partkey) AS BIGINT) AS missing_so_far, iter
      FROM b_rows p LEFT JOIN b_meta m ON m.table_name = p.table_name
      CROSS JOIN (VALUES (0), (1), (2)) AS r(iter)""",
    ),
    "candidate_text": _with([*_BASE, _CAND_TEXT], 'SELECT "group", cand FROM b_cand_text'),
    "candidate_text_pipe": _with(
        _BASE,
        f"""SELECT "group", 'ID | NAME | DESCRIPTION | TYPE'
             || string_agg({_PIPE}, '' ORDER BY cand_pos) AS cand
      FROM b_candidates GROUP BY "group" """,
    ),
    "candidate_list_bounded": _with(
        _BASE,
        """SELECT "group", cand_pos, id FROM (
        SELECT "group", id, row_number() OVER (PARTITION BY "group" ORDER BY name, id) AS cand_pos
        FROM b_candidates) WHERE cand_pos <= 5""",
    ),
    "kb_lookup_topk": _with(
        [_ROWS, _CELLS, _ENTITIES, _top(20)],
        """SELECT c.table_name, c.row_no, c.col_no, c.value AS mention,
             CAST(t.place AS INTEGER) AS place, t.id AS entity_id
      FROM b_cells c JOIN b_top t ON t.label_key = lower(trim(c.value))""",
    ),
    "kb_search_topk": _with(
        [_ROWS, _CELLS, _ENTITIES, *_SEARCH],
        """SELECT table_name, row_no, col_no, mention, CAST(place AS INTEGER) AS place,
             id AS entity_id, score
      FROM s_mentions JOIN s_top USING (words)""",
    ),
    "retrieval_search": _with(
        [_ROWS, _CELLS, _ENTITIES, *_SEARCH],
        f"""SELECT table_name, row_no, col_no,
             CASE WHEN wiki_text IS NULL THEN '' ELSE {_json('wiki_text')} END AS wiki
      FROM s_mentions LEFT JOIN (
        SELECT words, string_agg('Result ' || id || ':' || chr(10) || 'Label: ' || label
                 || coalesce(chr(10) || 'Description: ' || description, ''),
                 chr(10) || chr(10) ORDER BY place) AS wiki_text
        FROM s_top GROUP BY words) USING (words)""",
    ),
    "kb_fuzzy_topk": _with(
        [_ROWS, _CELLS, _ENTITIES],
        """SELECT table_name, row_no, mention, CAST(place AS INTEGER) AS place, id AS entity_id,
             CAST(edits AS INTEGER) AS edits
      FROM (SELECT *, row_number() OVER (PARTITION BY table_name, row_no ORDER BY edits, p_partkey, id) AS place
            FROM (SELECT m.*, e.id, e.p_partkey, levenshtein(lower(mention), lower(label)) AS edits
                  FROM (SELECT table_name, row_no,
                               CASE row_no % 4
                                 WHEN 0 THEN value[1:2] || value[4:]
                                 WHEN 1 THEN value[2:2] || value[1:1] || value[3:]
                                 WHEN 2 THEN value || 'x' ELSE value END AS mention
                        FROM b_cells WHERE col_no = 0) m, b_entities e)
            WHERE edits <= CASE WHEN length(mention) <= 2 THEN 0 WHEN length(mention) <= 5 THEN 1 ELSE 2 END)
      WHERE place <= 5""",
    ),
    "json_texts": f"SELECT doc_id, {_json('text')} AS json FROM documents",
    "prompt_sft_train": _with([_SFT], "SELECT conv_id, turn, text FROM b_texts"),
    "runs_expanded": _with(
        [_ROWS],
        """SELECT p_partkey AS "group", table_name || ' ' || row_no || ' 0' AS key, iter
      FROM b_rows CROSS JOIN (VALUES (0), (1), (2)) AS r(iter)""",
    ),
    "link_run": _run_sql("table", "link_cand_wiki", "'It is '"),
    "link_run_marked": _run_sql("tuned", "sft_infer", "''"),
    "link_stamped": _with(
        _BASE, """SELECT r.iter, g."group", true AS stamped
      FROM (SELECT DISTINCT "group" FROM b_candidates) g CROSS JOIN (VALUES (0), (1), (2)) AS r(iter)"""
    ),
    "link_resume": _run_sql("table", "link_cand_wiki", "'It is '"),
    "parse_answer": _with(
        _RUN_CTES,
        """SELECT "group", iter, output, pred FROM b_scored WHERE config = 'table'""",
    ),
    "parse_marker": _with(
        [_SFT],
        f"""SELECT conv_id, turn,
             CASE WHEN found > 0 THEN {_TRIM} ELSE 'Marker not found in the string.' END AS answer
      FROM (SELECT conv_id, turn, strpos(text, '### Answer:') AS found,
                   substr(text, strpos(text, '### Answer:') + 11) AS rest
            FROM (SELECT conv_id, turn, text FROM b_texts
                  UNION ALL SELECT conv_id, turn, text FROM conversations))""",
    ),
    "score_rows": _with(
        _RUN_CTES,
        """SELECT "group", iter, gold, pred, result FROM b_scored WHERE config = 'table'""",
    ),
    "run_accuracy": _with(
        _RUN_CTES,
        """SELECT dataset, config, iter, count(*) AS n, round(avg(result), 9) AS accuracy
      FROM b_scored GROUP BY ALL""",
    ),
    "run_weighted_f1": _with(
        [*_RUN_CTES, _SCORES],
        """SELECT dataset, config, iter, n, round(accuracy, 9) AS accuracy,
             round(f1_all, 9) AS f1_all, round(f1_non_nil, 9) AS f1_non_nil FROM scores""",
    ),
    "config_means": _with(
        [*_RUN_CTES, _SCORES],
        """SELECT dataset, config, count(*) AS runs, round(avg(accuracy), 9) AS accuracy,
             round(avg(f1_all), 9) AS f1_all, round(avg(f1_non_nil), 9) AS f1_non_nil
      FROM scores GROUP BY ALL""",
    ),
    "report": _with(
        [*_RUN_CTES, _SCORES],
        """SELECT dataset, config,
             round(max(accuracy) FILTER (WHERE iter = 0), 2) AS run_1,
             round(max(accuracy) FILTER (WHERE iter = 1), 2) AS run_2,
             round(max(accuracy) FILTER (WHERE iter = 2), 2) AS run_3,
             round(avg(accuracy), 2) AS mean_accuracy, round(avg(f1_all), 2) AS mean_f1
      FROM scores GROUP BY dataset, config""",
    ),
    "error_rows": _with(
        _RUN_CTES,
        """SELECT "group", iter, output, gold, pred FROM b_scored
      WHERE config = 'table' AND result = 0""",
    ),
    "error_pairs": _with(
        _RUN_CTES, "SELECT gold, pred FROM b_scored WHERE config = 'table' AND result = 0"
    ),
    "error_counts": _with(
        _RUN_CTES,
        """SELECT dataset, config, iter, count(*) FILTER (WHERE result = 0) AS errors
      FROM b_scored GROUP BY ALL""",
    ),
    "confusion": _with(
        _RUN_CTES,
        """SELECT gold, pred, count(*) AS n FROM b_scored WHERE config = 'table'
      GROUP BY gold, pred""",
    ),
    "preview_first": _with(
        _RUN_CTES,
        """SELECT "group", iter, gold, pred FROM b_scored WHERE config = 'table'
      ORDER BY "group", iter LIMIT 5""",
    ),
    "compare_one": _compared(0),
    "compare_two": _compared(1, 2),
    "compare_three": _compared(0, 1, 2),
    "merge_two": _with(_RUN_CTES, _merged(1, 2)),
    "merge_three": _with(_RUN_CTES, _merged(0, 1, 2)),
    "wrong_mentions": _with(
        [*_RUN_CTES, _WRONG], 'SELECT dataset, config, "group", gold FROM wrong'
    ),
    "hard_cases": _with([*_RUN_CTES, _WRONG], 'SELECT DISTINCT "group" FROM wrong'),
    "hard_case_count": _with(
        [*_RUN_CTES, _WRONG], 'SELECT count(DISTINCT "group") AS n_hard FROM wrong'
    ),
    "sft_examples": _with([_SFT], "SELECT conv_id, turn, question, answer FROM b_sft"),
    "sft_lengths": _with([_SFT, _LENGTHS], "SELECT conv_id, turn, length FROM lengths"),
    "sft_sample_count": _with([_SFT], "SELECT count(*) AS n FROM b_texts"),
    "sft_length_hist": _with(
        [
            _SFT,
            _LENGTHS,
            """bounds AS (
  SELECT CASE WHEN min(length) = max(length) THEN min(length) - 0.5 ELSE min(length) END::DOUBLE AS low,
         CASE WHEN min(length) = max(length) THEN max(length) + 0.5 ELSE max(length) END::DOUBLE AS high
  FROM lengths)""",
        ],
        """SELECT CAST(bin AS INTEGER) AS bin,
             round(low + bin * (high - low) / 20, 9) AS left_edge,
             round(low + (bin + 1) * (high - low) / 20, 9) AS right_edge, count(*) AS n
      FROM (SELECT least(floor((length - low) / ((high - low) / 20)), 19) AS bin, low, high
            FROM lengths, bounds)
      GROUP BY bin, low, high""",
    ),
    "sft_padded": _padded(2875),
    "sft_truncated": _padded(40),
}

ORACLE["sft_prepared"] = f"SELECT *, conv_id % 5 = 0 AS held_out FROM ({ORACLE['sft_padded']})"
ORACLE["meta_missing_running_sparse"] = f"""
  SELECT * REPLACE ("group" * {SPARSE_STEP} - {SPARSE_SHIFT} AS "group")
  FROM ({ORACLE['meta_missing_running']})"""

for _policy, _written in (
    ("replace", False), ("append", False), ("plain", False), ("replace", True), ("append", True),
):
    _name = f"retrieval_{_policy}" + ("_as_written" if _written else "")
    ORACLE[_name] = _with(
        [_ROWS, _CELLS, _ENTITIES, _top(3), _WIKI], _retrieval(_policy, _written)
    )

for _template in TEMPLATES:
    if _template != "sft_train":
        ORACLE[f"prompt_{_template}"] = _prompt_sql(_template)

# Files: what was written comes back.
_RUN_FILE = """SELECT 'D1' AS dataset, config, iter, table_name AS "tableName",
             table_name || ' ' || row_no || ' 0' AS key, "group",
             'which of "' || "group" || '"?' AS prompt, output, gold, pred
      FROM b_scored JOIN b_rows ON p_partkey = "group\""""
_NUMBERED_CELLS = """SELECT CAST(regexp_extract(table_name, '[0-9]+') AS INTEGER) AS t, row_no, col_no,
             ['p_name', 'p_type', 'p_size'][col_no + 1] AS col_name,
             CASE col_no WHEN 0 THEN p_name WHEN 1 THEN p_type ELSE CAST(p_size AS VARCHAR) END AS value
      FROM b_rows CROSS JOIN (VALUES (0), (1), (2)) AS c(col_no)"""

ORACLE |= {
    "link_from_store": _run_sql(
        "table", "link_cand_wiki", """(CASE WHEN "group" % 2 = 0 THEN 'Known: ' ELSE 'It is ' END)"""
    ),
    "link_logged": _run_sql("table", "link_cand_wiki", "'It is '"),
    "candidates_from_files": _with(
        _BASE,
        """SELECT "tableName", key, "group", id, name, description, types, target,
             row_number() OVER (ORDER BY cand_pos, "group") AS cand_pos FROM b_candidates""",
    ),
    "meta_from_files": """SELECT ' Brand#' || n_nationkey || ' ' AS "tableName",
             CASE WHEN n_nationkey <> 3 THEN n_name END AS title,
             'region ' || n_regionkey AS summary, row_number() OVER (ORDER BY n_nationkey) AS pos
      FROM nation""",
    "dataset_from_catalogue": _with(
        [*_BASE, _META],
        """SELECT "tableName", n_candidates, title
      FROM (SELECT "tableName", count(*) AS n_candidates FROM b_candidates GROUP BY 1)
      LEFT JOIN b_meta ON table_name = "tableName\"""",
    ),
    "table_list_from_files": _with([_ALLOW_TABLES], 'SELECT DISTINCT "tableName" FROM b_allow_tables'),
    "examples_from_files": _with([_SFT], "SELECT question, answer FROM b_sft"),
    "wide_table_from_file": """SELECT 'parts' AS table_name, row_no, col_no,
             ['p_partkey', 'p_name', 'p_brand', 'p_size'][col_no + 1] AS col_name,
             CASE col_no WHEN 0 THEN CAST(p_partkey AS VARCHAR) WHEN 1 THEN p_name WHEN 2 THEN p_brand
                  ELSE CAST(p_size AS VARCHAR) END AS value
      FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) AS row_no FROM part)
      CROSS JOIN (VALUES (0), (1), (2), (3)) AS c(col_no)""",
    "tables_from_files": _with([_ROWS], _NUMBERED_CELLS),
    "named_tables_from_files": _with(
        [_ROWS], f"{_NUMBERED_CELLS} WHERE table_name IN (SELECT table_name FROM b_rows WHERE p_size = 50)"
    ),
    "run_from_file": _with(_RUN_CTES, f"{_RUN_FILE} WHERE config = 'table' AND iter = 1"),
    "run_file_order": _with(
        _RUN_CTES,
        f"""SELECT row_number() OVER (ORDER BY "group") AS pos, "group"
      FROM ({_RUN_FILE} WHERE config = 'table' AND iter = 1)""",
    ),
    "runs_from_folders": _with(
        _RUN_CTES, f'SELECT dataset, config, iter, "group", prompt, output, gold, pred FROM ({_RUN_FILE})'
    ),
    "scored_from_files": ORACLE["score_rows"],
    "sheet_from_file": ORACLE["compare_three"],
    "groups_from_file": f"""SELECT row_number() OVER (ORDER BY "group") AS pos, "group" FROM ({ORACLE['hard_cases']})""",
}

ORACLE |= {
    "candidate_text_pieces": _with(
        _BASE,
        f"""SELECT "group", piece, min(before) AS start, string_agg(text, '' ORDER BY cand_pos, text) AS cand
      FROM (SELECT "group", cand_pos, text, CAST(before AS BIGINT) AS before, CAST(before // 5000 AS BIGINT) AS piece
            FROM (SELECT *, sum(length) OVER (PARTITION BY "group" ORDER BY cand_pos) - sum(length)
                       OVER (PARTITION BY "group", cand_pos) AS before
                  FROM (SELECT "group", cand_pos, text, length(text) AS length
                        FROM (SELECT "group", cand_pos, {_TAGGED} AS text FROM b_candidates))))
      GROUP BY "group", piece""",
    ),
    "prompt_budgeted": _with(
        [*_ALL, _context()],
        f"""SELECT "group", key, gold, {_prompt('title_cand_wiki')} AS prompt
      FROM (SELECT c.* EXCLUDE (cand), coalesce(f.cand, '') AS cand
            FROM b_context c LEFT JOIN (
              SELECT "group", string_agg(text, '' ORDER BY cand_pos, text) AS cand
              FROM (SELECT *, sum(words) OVER (PARTITION BY "group" ORDER BY cand_pos, text
                                               ROWS UNBOUNDED PRECEDING) AS spent
                    FROM (SELECT "group", cand_pos, text, len(regexp_extract_all(text, '\\S+')) AS words
                          FROM (SELECT "group", cand_pos, {_TAGGED} AS text FROM b_candidates)))
              JOIN (SELECT "group", 120 - len(regexp_extract_all({_prompt('title_cand_wiki')}, '\\S+')) AS allowed
                    FROM (SELECT * REPLACE ('' AS cand) FROM b_context)) USING ("group")
              WHERE spent <= allowed GROUP BY "group") f USING ("group"))""",
    ),
}

ORACLE["running_scores"] = _with(
    [*_RUN_CTES, _SCORES],
    """SELECT dataset, config, iter, n, round(accuracy, 9) AS accuracy, round(f1_all, 9) AS f1_all,
         round(f1_non_nil, 9) AS f1_non_nil FROM scores WHERE config = 'table'""",
)
