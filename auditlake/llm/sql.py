"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER.format("text")}, '{_ALNUM}') AS ws FROM documents),
b AS (SELECT row_number() OVER () AS bid, coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({_LOWER.format("text")}, '{_ALNUM}') AS ws FROM benchmark),
items AS (SELECT bid, item, ws, least(13, len(ws)) AS size FROM b WHERE len(ws) > 0),
wanted AS (SELECT bid, item, size, i AS j, array_to_string(ws[i:i + size - 1], ' ') AS g FROM items, unnest(range(1, len(ws) - size + 2)) t(i)),
sizes AS (SELECT DISTINCT size FROM wanted),
seen AS (SELECT rid, i, size, array_to_string(ws[i:i + size - 1], ' ') AS g FROM d, sizes, unnest(range(1, len(ws) - size + 2)) t(i)),
met AS (SELECT s.rid, s.i, s.size, w.bid, w.item, w.j FROM seen s JOIN wanted w ON w.size = s.size AND w.g = s.g),
found AS (SELECT DISTINCT rid, i, size, item FROM met),
hits AS (SELECT rid, count(DISTINCT i + k) AS n_hit FROM found, unnest(range(0, size)) t(k) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM found) GROUP BY rid),
-- windows that follow one another in a document and in an item are one match
joined AS (SELECT *, i - row_number() OVER (PARTITION BY rid, bid, i - j ORDER BY i) AS island FROM met WHERE size = 13),
matches AS (SELECT rid, min(i) AS i, count(*) + 12 AS words, any_value(item) AS item, min(j) AS j FROM joined GROUP BY rid, bid, i - j, island
  UNION ALL SELECT rid, i, size, item, j FROM met WHERE size < 13),
best AS (SELECT * FROM matches QUALIFY row_number() OVER (PARTITION BY rid ORDER BY words DESC, i, item, j) = 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated, coalesce(words, 0)::BIGINT AS longest_match, (i - 1)::BIGINT AS longest_at, best.item AS longest_item, (j - 1)::BIGINT AS longest_item_at
FROM d LEFT JOIN hits USING (rid) LEFT JOIN named USING (rid) LEFT JOIN best USING (rid)"""

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_SPACED}') AS ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS g FROM w, unnest(range(1, len(ws) - 6)) x(i)),
dup AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM dup, unnest(range(0, 8)) x(k) GROUP BY rid),
f AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
  length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS letters,
  len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z\x{{80}}-\x{{10FFFF}}]'))) AS spelled, len(list_filter(ws, lambda x: ends_with(x, '!'))) AS loud
  FROM w LEFT JOIN rep USING (rid)),
g AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR 10 * n_dup_lines > 3 * n_lines
    OR 10 * upper > 3 * letters OR 10 * spelled < 7 * n_words OR 10 * loud > 3 * n_words) AS kept
FROM g"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '{_SPACED}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM d, unnest(range(1, greatest(len(ws) - 2, 2))) t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * shared >= 85 * (x.size + y.size - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, least(min(b), a) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(size, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""


def _escaped(column: str) -> str:
    out = f"replace(coalesce({column}, ''), '\\', '\\\\')"
    for control in ("<|turn|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"):
        out = f"replace({out}, '{control}', '{control[0]}\\{control[1:]}')"
    return out


CHAT = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before, lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS after FROM c),
v AS (SELECT *, CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before = 'system' THEN role = 'user' WHEN before = 'user' THEN role = 'assistant'
  WHEN before = 'assistant' THEN role = 'user' ELSE false END AND (after IS NOT NULL OR role = 'assistant') AS good FROM m)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|turn|>') + length(replace({_escaped("role")}, chr(10), '\\n')) + 1 + length({_escaped("text")}) + length('<|end|>') + 1)::BIGINT AS formatted_chars, bool_and(good) AS valid
FROM v GROUP BY conv_id"""

COLLOCATIONS = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER.format("text")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM d),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM w, unnest(range(1, 5)) x(k), unnest(range(1, len(ws) - k + 2)) y(i) GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE k > 1 AND f >= 30),
cuts AS (SELECT c.lang, c.phrase, c.a, cut, x.f AS l, y.f AS r, (2000000 * c.a::HUGEINT) // (x.f + y.f) AS score FROM c, unnest(range(1, c.k)) t(cut)
  JOIN g x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:cut], ' ') JOIN g y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[cut + 1:c.k], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
parts AS (SELECT lang, a, array_to_string(ws[i:i + size - 1], ' ') AS phrase FROM c, unnest(range(2, k)) s(size), unnest(range(1, k - size + 2)) t(i)),
within AS (SELECT lang, phrase, max(a) AS longer FROM parts GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN within USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000"""

FILL_IN_MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS us FROM d),
n AS (SELECT *, len(us) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[25:32])::BIGINT AS h4 FROM u),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, array_to_string(us[1:a], '') AS pre, array_to_string(us[a + 1:b], '') AS mid, array_to_string(us[b + 1:], '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p"""

ORACLES = {
    "op11_collocations": COLLOCATIONS,
    "op12_fill_in_middle": FILL_IN_MIDDLE,
    "op3_decontamination": DECONTAMINATION,
    "op6_quality_rules": QUALITY,
    "op7_ngram_jaccard": JACCARD,
    "op9_chat_formatting": CHAT,
}
