"""DuckDB's SQL for the rows of those queries that SQL can express."""

from __future__ import annotations

from .quality_rules import DELTA, RISK, RULES, STEP
from .warc import CHUNK

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LM_SCORE = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS target
        FROM documents),
t AS (SELECT doc_id, target, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
b AS (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS h FROM t),
v AS (SELECT count(DISTINCT x) AS v FROM t),
p AS (SELECT h, x, count(*) AS nb, count(*) FILTER (target) AS nt FROM b GROUP BY h, x),
u AS (SELECT h, count(*) AS nb, count(*) FILTER (target) AS nt FROM b GROUP BY h),
e AS (SELECT doc_id, target, h, x, count(*) AS k FROM b GROUP BY ALL),
g AS (SELECT doc_id, target, h, count(*) AS k FROM b GROUP BY ALL),
f AS (SELECT doc_id, k, k * cast(round(ln(nt - k * target::INT + 0.05::DOUBLE) * 1000000::DOUBLE) AS bigint) AS t,
        k * cast(round(ln(nb - k + 0.05::DOUBLE) * 1000000::DOUBLE) AS bigint) AS g FROM e JOIN p ON e.x = p.x AND e.h IS NOT DISTINCT FROM p.h
    UNION ALL SELECT doc_id, 0, -k * cast(round(ln(nt - k * target::INT + 0.05::DOUBLE * v) * 1000000::DOUBLE) AS bigint),
        -k * cast(round(ln(nb - k + 0.05::DOUBLE * v) * 1000000::DOUBLE) AS bigint) FROM g JOIN u ON g.h IS NOT DISTINCT FROM u.h, v),
s AS (SELECT doc_id, sum(k) AS n_words, cast(sum(t) AS double) AS t, cast(sum(g) AS double) AS g FROM f GROUP BY doc_id)
SELECT d.doc_id, cast(coalesce(n_words, 0) AS bigint) AS n_words, -(t / 1000000) / n_words AS ce_target, -(g / 1000000) / n_words AS ce_background,
        -((t - g) / 1000000) / n_words AS ce_diff FROM d LEFT JOIN s USING (doc_id)
"""

WARC = f"""
WITH q AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS b, sha1(coalesce(html, '')) AS d FROM pages), m AS (SELECT d, max(page_id) AS r
        FROM q WHERE b >= 1000 GROUP BY d)
SELECT page_id, b AS payload_bytes, q.d AS payload_digest, CASE WHEN b >= 1000 AND r <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE
        WHEN b >= 1000 AND r <> page_id THEN r END AS refers_to,
    CASE WHEN b >= 1000 AND r <> page_id THEN 1 ELSE greatest(1, cast(ceil(b / {CHUNK}) AS bigint)) END AS n_chunks FROM q LEFT JOIN m USING (d)
"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1),
        lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n,
        b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT s.doc_id, len(s.s) AS n_shingles, c AS component_id FROM s JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) k ON k.a = s.doc_id
"""

RULES_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, {_WORDS.format("t")} AS w FROM d)),
g AS (SELECT doc_id, i, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o AS y FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT doc_id, i FROM g WHERE y IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, y) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM k) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_words, sum(length(x)) AS chars FROM w GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS lines, count(*) - count(DISTINCT l) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
        WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (SELECT doc_id, stratum, coalesce(n_words, 0) AS n_words, cast(coalesce(chars, 0) AS bigint) AS word_chars, length(t) - length(translate(t,
        '#*$%&|<>', '')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(lines, 0) AS lines,
    length(regexp_replace(t, '\\P{{Lu}}+', '', 'g')) AS capitals FROM d LEFT JOIN n USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT
        JOIN ln USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, least(1000, 1000 * n_symbols // greatest(word_chars, 1)) AS symbols,
        least(1000, 1000 * n_dup_lines // greatest(lines, 1)) AS lines_, least(1000, 1000 * n_repeat_words // greatest(n_words, 1)) AS repeats,
        least(1000, 1000 * capitals // greatest(word_chars, 1)) AS capitals_ FROM m),
good AS (SELECT stratum, unnest({list(RULES)}) AS rule, unnest([symbols, lines_, repeats, capitals_]) AS share FROM f WHERE NOT base_failed
        AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
z AS (SELECT stratum, rule, bin, count(*) FILTER (ceil(share / {STEP}) > bin) AS above, count(*) AS n FROM good, (SELECT unnest(range(0,
        {1000 // STEP} + 1)) AS bin) GROUP BY ALL),
c AS (SELECT stratum, rule, min(bin) * {STEP} AS cut FROM z WHERE above <= {RISK / len(RULES)} * n AND list_sum(list_transform(range(0, above + 1),
        lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK / len(RULES)}) + (n - i) * ln(1 - {RISK / len(RULES)})))) <= {DELTA}::DOUBLE / (SELECT count(DISTINCT (stratum,
        rule)) FROM good) GROUP BY ALL),
x AS (PIVOT c ON rule IN ('symbols', 'lines', 'repeats', 'capitals') USING max(cut))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND f.symbols <= coalesce(x.symbols, 1000)
        AND lines_ <= coalesce(x.lines, 1000) AND f.repeats <= coalesce(x.repeats, 1000) AND capitals_ <= coalesce(x.capitals, 1000) AS kept FROM f
        LEFT JOIN x USING (stratum)
"""

REPEATS = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
f AS (SELECT h, min(doc_id) AS o FROM s GROUP BY h),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM s JOIN f USING (h) WHERE doc_id > o),
x AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM x ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

# CRC-32 bit by bit: each byte is xored in and followed by seven steps without one.
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split({}, ''), lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1))))"

RUNS = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w, {_CRC.format("cast(doc_id AS varchar)")} AS h FROM documents),
g AS (SELECT doc_id, w, len(w) AS n, h, h // 10 AS g FROM d),
p AS (SELECT *, CASE WHEN n > 0 AND h % 10 = 0 THEN g % n END AS a FROM g),
q AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM p),
v AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM q),
t AS (SELECT doc_id, n, unnest(w) AS x, unnest(range(0, n)) AS i FROM v),
e AS (SELECT s.doc_id, s.i, r.i - s.i AS lag FROM t s JOIN t r ON s.doc_id = r.doc_id AND s.x = r.x AND s.i < r.i AND 4 * (r.i - s.i) <= s.n),
k AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS island FROM e),
c AS (SELECT doc_id, min(i) AS start, count(*) + lag AS length, lag AS period FROM k GROUP BY doc_id, lag, island HAVING count(*) + lag >= greatest(6, 4 * lag)),
r AS (SELECT doc_id, start, length, min(period) AS period FROM c GROUP BY ALL),
b AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM r GROUP BY doc_id),
o AS (SELECT doc_id, start, length, period, 1000 * length // period AS exponent_milli FROM r
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cast(length AS double) / period DESC, start, period) = 1),
m AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM t WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = t.doc_id AND i >= start + period AND i < start + length) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN o USING (doc_id) LEFT JOIN m USING (doc_id)
"""

_INK = r"[^\x20\x09-\x0D]"
# One row of a conversation after another: costs to go from each state from the last one back, then the least way forward.
REPAIR = f"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {_CRC.format("coalesce(cast(conv_id AS varchar), ' ') || ':' || coalesce(cast(turn AS varchar), ' ')")} % 20 AS f FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE f <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM d),
z AS (SELECT *, NOT regexp_matches(text, '{_INK}') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    regexp_extract(text, '({_INK})[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') AS cut, left(role, 1) AS k FROM o),
e AS (SELECT conv_id, i, role, text, turn, k, blank, NOT blank AND again AS duplicate, NOT blank AND NOT again AND cut AS truncated, blank OR again AS dead,
    CASE WHEN NOT blank AND NOT again AND cut THEN 5 ELSE 0 END AS fault, coalesce(lag(k) OVER w || k NOT IN ('su', 'ua', 'au'), false) AS illegal FROM z
    WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
s AS (SELECT conv_id, max(i) AS n FROM e GROUP BY conv_id),
b AS (SELECT conv_id, n + 1 AS i, 0::BIGINT AS c0, 10::BIGINT AS c1, 5::BIGINT AS c2, 0::BIGINT AS c3 FROM s UNION ALL
    SELECT conv_id, i, least(r0, 5 + least(r2, 5 + r3)), least(r1, 5 + least(r2, 5 + r3)), least(r2, 5 + r3), least(r3, 5 + r2) FROM (SELECT e.conv_id, e.i,
        CASE WHEN dead THEN 2 + c0 ELSE least(2 + c0, 1 + fault + c2, CASE k WHEN 's' THEN fault + c1 WHEN 'u' THEN fault + c2 END) END AS r0,
        CASE WHEN dead THEN 2 + c1 ELSE least(2 + c1, 1 + fault + c2, CASE k WHEN 'u' THEN fault + c2 END) END AS r1,
        CASE WHEN dead THEN 2 + c2 ELSE least(2 + c2, 1 + fault + c3, CASE k WHEN 'a' THEN fault + c3 END) END AS r2,
        CASE WHEN dead THEN 2 + c3 ELSE least(2 + c3, 1 + fault + c2, CASE k WHEN 'u' THEN fault + c2 END) END AS r3
        FROM b JOIN e ON e.conv_id IS NOT DISTINCT FROM b.conv_id AND e.i = b.i - 1)),
v AS (SELECT conv_id, i, [c0, c1, c2, c3] AS v FROM b),
t AS (SELECT conv_id, 0 AS step, 1::BIGINT AS i, 1 AS q, NULL::VARCHAR AS edit, NULL::VARCHAR AS line FROM s UNION ALL
    SELECT conv_id, step + 1, CASE WHEN act = 'I' THEN i ELSE i + 1 END, CASE act WHEN 'D' THEN q WHEN 'K' THEN same ELSE other END, act,
        CASE act WHEN 'K' THEN role || ':' || text WHEN 'R' THEN name || ':' || text WHEN 'I' THEN name || ':' END FROM (
        SELECT *, CASE WHEN dead OR v[q] = 2 + after[q] THEN CASE WHEN role IS NULL THEN 'I' ELSE 'D' END WHEN v[q] = 5 + v[other] THEN 'I' WHEN v[q] = fault + after[same] THEN 'K' ELSE 'R' END AS act
        FROM (SELECT t.*, e.role, e.text, e.dead, e.fault, v.v, u.v AS after, CASE WHEN q = 3 THEN 4 ELSE 3 END AS other, CASE WHEN q = 3 THEN 'assistant' ELSE 'user' END AS name,
            CASE WHEN k = 's' AND q = 1 THEN 2 WHEN k = 'u' AND q <> 3 THEN 3 WHEN k = 'a' AND q = 3 THEN 4 END AS same
            FROM t JOIN v ON v.conv_id IS NOT DISTINCT FROM t.conv_id AND v.i = t.i LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM t.conv_id AND e.i = t.i
            LEFT JOIN v u ON u.conv_id IS NOT DISTINCT FROM t.conv_id AND u.i = t.i + 1 WHERE e.i IS NOT NULL OR q IN (2, 3)))),
a AS (SELECT conv_id, string_agg(edit, '' ORDER BY step) AS audit, string_agg(line, chr(10) ORDER BY step) AS lines FROM t GROUP BY conv_id),
f AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
    count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal FROM e GROUP BY conv_id),
y AS (SELECT DISTINCT conv_id FROM conversations)
SELECT y.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    coalesce(v[1], 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256 FROM y
LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM y.conv_id LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM y.conv_id
LEFT JOIN v ON v.conv_id IS NOT DISTINCT FROM y.conv_id AND v.i = 1
"""

ORACLES = {
    "op2_lm_score": LM_SCORE, "op4_warc": WARC, "op5_ngram_jaccard": JACCARD, "op9_quality_rules": RULES_SQL, "op10_substring_dedup": REPEATS, "op11_periodic_runs": RUNS,
    "op13_conversation_repair": REPAIR,
}
