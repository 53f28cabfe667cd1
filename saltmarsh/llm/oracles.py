"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(table: str, key: str) -> str:
    return f"SELECT {key}, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM {table}"


def _shingles(source: str, key: str, k: int) -> str:
    """Distinct k-word shingles of the rows of ``source`` (key, w); of a shorter row its whole sequence."""
    return f"""SELECT DISTINCT {key}, array_to_string(list_slice(w, i, i + least({k}, len(w)) - 1), ' ') AS s, least({k}, len(w)) AS width
        FROM (SELECT {key}, w, unnest(range(1, len(w) - least({k}, len(w)) + 2)) AS i FROM {source} WHERE len(w) > 0)"""


OP6 = f"""
WITH dw AS ({_words('documents', 'doc_id')}),
items AS ({_shingles('(' + _words('benchmark', 'item_id') + ')', 'item_id', 5)}),
sizes AS (SELECT item_id, count(*) AS n_shingles FROM items GROUP BY item_id),
widths AS (SELECT DISTINCT width FROM items),
docs AS (
    SELECT DISTINCT doc_id, width, array_to_string(list_slice(w, i, i + width - 1), ' ') AS s
    FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM dw, widths WHERE len(w) >= width)
)
SELECT doc_id, item_id, n_shingles, count(*) AS n_found, count(*) / n_shingles AS containment
FROM docs JOIN items USING (s, width) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id, n_shingles
HAVING 100 * count(*) >= 80 * n_shingles
"""

OP2 = f"""
WITH RECURSIVE dw AS ({_words('documents', 'doc_id')}),
sets AS ({_shingles('dw', 'doc_id', 4)}),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
    FROM sets a JOIN sets b ON a.s = b.s AND a.width = b.width AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id
),
links AS (
    SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * c >= 85 * (x.n + y.n - c)
),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION
    SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a
)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
FROM reach LEFT JOIN sizes USING (doc_id)
GROUP BY doc_id
"""

OP11 = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
worded AS (SELECT *, list_filter(regexp_split_to_array(t, '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM texts),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails
  FROM worded LEFT JOIN marks USING (doc_id)),
cells AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failed GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, step, filter_order[step] AS f, filter_order[1:step - 1] AS prior, filter_order[1:step] AS upto FROM orders, (SELECT unnest([1, 2, 3, 4, 5])::INT AS step)),
told AS (
  SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (len(list_intersect(string_split(fails, ''), string_split(upto, ''))) = 0 OR fails = ''), 0) AS kept,
    coalesce(sum(n) FILTER (contains(fails, f) AND translate(fails, prior, '') = fails), 0) AS removed,
    coalesce(sum(n) FILTER (contains(fails, f) AND translate(fails, prior, '') <> fails), 0) AS redundant,
    coalesce(sum(n) FILTER (fails = f), 0) AS unique_fails,
    coalesce(sum(good) FILTER (contains(fails, f) AND translate(fails, prior, '') = fails), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (contains(fails, f) AND translate(fails, prior, '') = fails), 0) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM told
"""
