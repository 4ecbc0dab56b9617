"""The results of the queries that SQL can express, in DuckDB's SQL, from the contracts and the methods' definitions."""

from __future__ import annotations

from .quality import FENCE, MEASURES, MIN_ROWS
from .sharding import SHARDS, SLOTS

WORDS = "list_filter(string_split_regex(coalesce({0}, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
ITEM_WORDS = "list_filter(string_split_regex(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"

DECONTAMINATION = f"""
WITH it AS (SELECT item_id, {ITEM_WORDS.format('text')} AS w FROM benchmark),
  win AS (SELECT DISTINCT item_id, array_to_string(w[s + 1:s + least(13, len(w))], ' ') AS g, least(13, len(w)) AS k FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 13, 0) + 1)) AS s FROM it WHERE len(w) > 0)),
  d AS (SELECT doc_id, {ITEM_WORDS.format('text')} AS w FROM documents),
  pos AS (SELECT doc_id, k, p, array_to_string(w[p + 1:p + k], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS p FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
  hits AS (SELECT doc_id, item_id, p, k FROM pos JOIN win USING (g, k)),
  cov AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hits) GROUP BY doc_id),
  ids AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS h FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN ids USING (doc_id)"""

_PICK = "CASE WHEN n_own >= {m} THEN {q}_own WHEN n_lang >= {m} THEN {q}_lang ELSE {q}_all END"
_FLOOR = "CASE measure " + " ".join(f"WHEN '{k}' THEN {v[0]}" for k, v in MEASURES.items()) + " END"


def _quartiles(name: str, keys: str, tag: str) -> str:
    by = f"{keys}, measure" if keys else "measure"
    return f"""{tag}_q AS (SELECT {by}, max(total) AS n_{tag}, min(bucket) FILTER (WHERE upto * 4 >= total) AS q1_{tag}, min(bucket) FILTER (WHERE upto * 4 >= total * 3) AS q3_{tag} FROM
    (SELECT *, sum(n) OVER (PARTITION BY {by}) AS total, sum(n) OVER (PARTITION BY {by} ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS upto FROM {name}) GROUP BY {by})"""


QUALITY = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {WORDS.format('text')} AS w FROM documents),
  g AS (SELECT doc_id, p, array_to_string(w[p + 1:p + 8], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - 7)) AS p FROM w WHERE len(w) >= 8)),
  r AS (SELECT doc_id, count(DISTINCT q) AS n_rep FROM (SELECT doc_id, unnest(range(p, p + 8)) AS q FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1) GROUP BY doc_id),
  l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM w) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
  b AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_rep, 0) AS n_repeat_words FROM w LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)),
  m AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, 1000 * word_chars // greatest(n_words, 1) AS mean_word, 1000 * n_symbols // greatest(n_words, 1) AS symbol_share,
    1000 * n_dup_lines // greatest(n_lines, 1) AS dup_line_share, 1000 * n_repeat_words // greatest(n_words, 1) AS repeat_share FROM b),
  v AS ({" UNION ALL ".join(f"SELECT lang, source, '{k}' AS measure, {k} AS v FROM m WHERE NOT base_failed" for k in MEASURES)}),
  own AS (SELECT lang, source, measure, v // (1::BIGINT << greatest(0, length(bin(v)) - 6)) * (1::BIGINT << greatest(0, length(bin(v)) - 6)) AS bucket, count(*) AS n FROM v GROUP BY ALL),
  by_lang AS (SELECT lang, measure, bucket, sum(n) AS n FROM own GROUP BY ALL), by_all AS (SELECT measure, bucket, sum(n) AS n FROM own GROUP BY ALL),
  {_quartiles('own', 'lang, source', 'own')}, {_quartiles('by_lang', 'lang', 'lang')}, {_quartiles('by_all', '', 'all')},
  q AS (SELECT lang, source, measure, {_PICK.format(m=MIN_ROWS, q='q1')} AS q1, {_PICK.format(m=MIN_ROWS, q='q3')} AS q3, {_FLOOR} AS floor FROM own_q JOIN lang_q USING (lang, measure) JOIN all_q USING (measure)),
  f AS (SELECT lang, source, measure, q1 - {FENCE} * greatest(q3 - q1, floor) AS lo, q3 + {FENCE} * greatest(q3 - q1, floor) AS hi FROM q),
  t AS (SELECT lang, source, {", ".join(f"max(hi) FILTER (WHERE measure = '{k}') AS high_{k}, max(lo) FILTER (WHERE measure = '{k}') AS low_{k}" for k in MEASURES)} FROM f GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce({" OR ".join([f"{k} > high_{k}" for k in MEASURES] + [f"{k} < low_{k}" for k, x in MEASURES.items() if x[1]])}, false) AS kept FROM m LEFT JOIN t USING (lang, source)"""

SHARDING = f"""
WITH RECURSIVE pref AS (SELECT i, ('0x' || md5('offset-' || i)[:8])::BIGINT % {SLOTS} AS off, ('0x' || md5('skip-' || i)[:8])::BIGINT % {SLOTS - 1} + 1 AS skip FROM range({SHARDS}) r(i)),
  p AS (SELECT list(off ORDER BY i) AS off, list(skip ORDER BY i) AS skip FROM pref),
  fill AS (SELECT 0 AS turn, list_transform(range({SLOTS}), lambda x: -1) AS tab FROM range(1)
    UNION ALL
    SELECT turn + 1, list_transform(tab, lambda x, k: CASE WHEN k - 1 = slot THEN turn % {SHARDS} ELSE x END) FROM (
      SELECT turn, tab, list_filter(list_transform(range({SLOTS}), lambda j: (off[turn % {SHARDS} + 1] + j * skip[turn % {SHARDS} + 1]) % {SLOTS}), lambda s: tab[s + 1] < 0)[1] AS slot FROM fill, p WHERE turn < {SLOTS})),
  lut AS (SELECT tab FROM fill WHERE turn = {SLOTS}),
  d AS (SELECT doc_id, (('0x' || md5(coalesce(doc_id::VARCHAR, ''))[:8])::BIGINT % {SLOTS})::INTEGER AS slot FROM documents)
SELECT doc_id, slot, tab[slot + 1]::INTEGER AS shard FROM d, lut"""

FILL_IN_MIDDLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
  l AS (SELECT *, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS u, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
  c AS (SELECT *, len(u)::BIGINT AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM l),
  p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
