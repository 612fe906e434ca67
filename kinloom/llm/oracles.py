"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_GAP = r"[ \t\n\x0b\f\r]"
_COUNT = lambda pattern: f"length(t) - length(regexp_replace(t, '{pattern}', '', 'g'))"

# The words of all texts as rows, their 3-word windows, and the places that repeated windows cover.
_QUALITY = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, unnest(range(len(l))) AS i, unnest(l) AS word
  FROM (SELECT r, [x FOR x IN string_split_regex(t, '{_GAP}+') IF x <> ''] AS l FROM d)),
win AS (SELECT r, i, word, lead(word) OVER o AS word2, lead(word, 2) OVER o AS word3 FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM win WHERE word3 IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, word, word2, word3) > 1),
covered AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + unnest([0, 1, 2]) AS i FROM twice) GROUP BY r),
sums AS (SELECT r, count(*) AS n, sum(length(word)) AS chars FROM w GROUP BY r),
lines AS (SELECT r, count(*) AS n, count(DISTINCT line) AS different
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_replace(line, '{_GAP}', '', 'g') <> '' GROUP BY r),
m AS (SELECT doc_id, coalesce(s.n, 0) AS n_words, CAST(coalesce(chars, 0) AS BIGINT) AS word_chars,
  {_COUNT('[#*$%&|<>]')} AS n_symbols, coalesce(l.n - different, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
  {_COUNT('[A-ZÀ-ÖØ-Þ]')} AS capitals, {_COUNT('[0-9]')} AS digits, {_COUNT('!')} AS cries, coalesce(l.n, 0) AS n_lines
  FROM d LEFT JOIN sums s USING (r) LEFT JOIN lines l USING (r) LEFT JOIN covered c USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, greatest(n_words, 1) AS per_word,
  greatest(word_chars, 1) AS per_char FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars / per_word NOT BETWEEN 2.5 AND 12 OR n_symbols / per_word > 0.3 OR capitals / per_char > 0.3
    OR digits / per_char > 0.3 OR cries / per_word > 0.5 OR n_dup_lines > 0.5 * greatest(n_lines, 1)) AS kept FROM f"""

_FIVE = " + ".join(f"CAST(substr(bits, 5 * k + {j + 1}, 1) AS BIGINT) * {1 << (4 - j)}" for j in range(5))
_WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h, CAST(CAST(unhex(sha1(coalesce(html, ''))) AS BIT) AS VARCHAR) AS bits FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_FIVE}, 1) FOR k IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""

_DRAW = ", ".join(f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))
_INFILL = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^
]*
|[^
]+') AS lines, {_DRAW} FROM d),
x AS (SELECT *, len(lines) AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS i, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS j,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
    WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
y AS (SELECT doc_id, n, form, t, coalesce(array_to_string(lines[1:i], ''), '') AS p, coalesce(array_to_string(lines[i + 1:j], ''), '') AS m,
  coalesce(array_to_string(lines[j + 1:], ''), '') AS s FROM x)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM y"""

# All pairs; the search has to lose none at this size.
_FLAT_GRAPH = """WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
v AS (SELECT * FROM e WHERE list_bool_and([coalesce(isfinite(c), false) FOR c IN x]) AND list_bool_or([c <> 0 FOR c IN x])),
pair AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.r <> b.r AND list_cosine_similarity(a.x, b.x) >= 0.9),
reach AS (SELECT r, r AS other FROM e UNION SELECT reach.r, pair.b FROM reach JOIN pair ON pair.a = reach.other),
least AS (SELECT reach.r, min(e.vec_id) AS component_id FROM reach JOIN e ON e.r = reach.other GROUP BY reach.r),
n AS (SELECT a AS r, count(*) AS n FROM pair GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM e JOIN least USING (r) LEFT JOIN n USING (r)"""

ORACLES: dict[str, str] = {
    "op4_quality_cascade": _QUALITY,
    "op8_seekable_warc": _WARC,
    "op12_infill": _INFILL,
    "op13_flat_graph": _FLAT_GRAPH,
}
