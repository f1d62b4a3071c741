"""DuckDB SQL for the operators whose results SQL can express (ids are taken as unique and not null)."""

from __future__ import annotations

from plumbline.llm.chat import ORACLE_SQL as CHAT

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

SUBSTRING = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d
  WHERE len(w) >= 20)),
late AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(range(p, p + 20)) AS i FROM late)),
one AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d WHERE len(w) > 0),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM one ANTI JOIN gone USING (doc_id, i) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

CONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_FOLD}, '{_ALNUM}') AS w FROM benchmark),
q AS (SELECT DISTINCT item, k, array_to_string(w[p:p + k - 1], ' ') AS x
  FROM (SELECT item, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
win AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS x FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p
  FROM d, (SELECT DISTINCT k FROM q) WHERE len(w) >= k)),
m AS (SELECT doc_id, item, p, win.k AS k FROM win JOIN q ON win.k = q.k AND win.x = q.x),
h AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS i FROM (SELECT DISTINCT doc_id, p, k FROM m))
  GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m
  WHERE item IS NOT NULL) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items,
  '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '{_SPACED}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + least(5, len(w)) - 1], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id
  FROM r GROUP BY 1) c USING (doc_id)
"""

FILL_IN_MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
  sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3,
  CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 AS stays,
  least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM g),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, CASE WHEN stays THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT stays THEN length(prefix) END AS prefix_chars, CASE WHEN NOT stays THEN length(middle) END AS middle_chars,
  sha256(CASE WHEN stays THEN t WHEN h4 % 100 < 50 THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
    ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""

COLLOCATIONS = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_FOLD}, '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
w AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM p),
total AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY 1),
f AS (SELECT lang, m, x, count(*) AS a FROM (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: w[i:i + m - 1])) AS x
  FROM w, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m) GROUP BY ALL HAVING count(*) >= 100),
cut AS (SELECT c.lang, c.m, c.x, c.a, k, l.a AS l, r.a AS r, CAST(n AS HUGEINT) AS n, (1000::HUGEINT * c.a * n) // (l.a::HUGEINT * r.a) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1) c JOIN f l ON l.lang = c.lang AND l.x = c.x[1:k]
  JOIN f r ON r.lang = c.lang AND r.x = c.x[k + 1:] JOIN total ON total.lang = c.lang),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, x ORDER BY score, k) = 1),
inner_ AS (SELECT DISTINCT lang, x[i:i + j - 1] AS x, a FROM (SELECT lang, x, m, a, j, unnest(range(1, m - j + 2)) AS i
  FROM (SELECT *, unnest(range(2, m)) AS j FROM f WHERE m > 2))),
held AS (SELECT lang, x, max(a) AS longer FROM inner_ GROUP BY 1, 2),
kept AS (SELECT b.*, array_to_string(b.x, ' ') AS phrase FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.x = b.x WHERE longer IS NULL OR 100 * longer < 100 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY rank <= 2000
"""

ORACLES = {"op2_substring_dedup": SUBSTRING, "op3_chat_perspectives": CHAT, "op7_decontamination": CONTAMINATION, "op10_jaccard_join": JACCARD, "op12_collocations": COLLOCATIONS, "op13_fill_in_middle": FILL_IN_MIDDLE}
