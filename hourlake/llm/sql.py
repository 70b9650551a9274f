"""SQL counterparts of the queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

from hourlake.llm import chat, quality_rules
from hourlake.llm.licenses import BASE, TEMPLATES

SPACE = r"[^\x20\x09-\x0D]"


def _gram(n: int) -> str:
    """The words of a window of ``n``, null where fewer are left."""
    return " || ' ' || ".join(["word", *(f"lead(word, {i}) OVER w" for i in range(1, n))])


def _unit(text: str) -> str:
    """52 bits of the md5 of a text as a number in [0, 1)."""
    return f"(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) / 4503599627370496.0)"


MIXING = f"""
WITH sizes AS (SELECT source, count(*) AS n, sqrt(count(*)) AS weight FROM documents GROUP BY 1),
rates AS (SELECT source, weight * ((SELECT sum(n) FROM sizes) / (SELECT sum(weight) FROM sizes)) / n AS mean FROM sizes),
steps AS (
    SELECT source, k, sum(exp(k * ln(mean) - mean - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS total
    FROM rates, range(0, 400) AS r(k) WHERE k <= mean + 14 * sqrt(mean) + 40
),
counted AS (
    SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, CAST(count(*) AS INTEGER) AS _copies
    FROM documents d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source AND s.total <= {_unit("'7:' || d.doc_id")} GROUP BY ALL
)
SELECT *, {_unit("'8:' || doc_id || ':' || _copy")} AS _order
FROM (SELECT *, CAST(unnest(range(1, _copies + 1)) AS INTEGER) AS _copy FROM counted)
"""

CHAT = f"""
WITH turns AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos FROM turns),
whole AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY pos) AS said, count(*) AS n_turns FROM numbered GROUP BY 1),
kept AS (
    SELECT conv_id, n_turns FROM whole a
    WHERE NOT EXISTS (SELECT 1 FROM whole b WHERE b.n_turns > a.n_turns AND b.said[1:a.n_turns] = a.said)
    AND NOT EXISTS (SELECT 1 FROM whole b WHERE b.said = a.said AND b.conv_id < a.conv_id)
)
SELECT conv_id, pos // {chat.BLOCK} AS part, n_turns, string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY pos) AS rendered
FROM numbered JOIN kept USING (conv_id) GROUP BY ALL
"""

WARC = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS last FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32),
    lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(hex, (i // 4) * 5 + 1, 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31), 1)), '') AS payload_digest,
    CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM t
"""

QUALITY = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{SPACE}+') AS words FROM documents),
lines AS (
    SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{SPACE}') GROUP BY 1
),
placed AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM d),
windows AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS times
    FROM (SELECT doc_id, i, {_gram(quality_rules.WINDOW)} AS gram FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE gram IS NOT NULL
),
repeated AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM windows, range({quality_rules.WINDOW}) AS r(j) WHERE times > 1 GROUP BY 1),
counts AS (
    SELECT doc_id, source, CAST(len(words) AS BIGINT) AS n_words, length(array_to_string(words, '')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
        CAST(len(list_filter(words, lambda w: upper(w) = w AND lower(w) <> w)) AS BIGINT) AS n_shouted
    FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)
),
judged AS (
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        CASE WHEN 10 * n_symbols > 3 * greatest(n_words, 1) THEN 2 WHEN 10 * n_symbols > greatest(n_words, 1) THEN 1 ELSE 0 END
        + CASE WHEN 10 * n_shouted > 9 * greatest(n_words, 1) THEN 2 WHEN 2 * n_shouted > greatest(n_words, 1) THEN 1 ELSE 0 END
        + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 1 ELSE 0 END
        + CASE WHEN word_chars > 20 * greatest(n_words, 1) OR word_chars < 2 * greatest(n_words, 1) THEN 1 ELSE 0 END AS points
    FROM counts
),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed OR points > 0) AS k FROM judged GROUP BY 1),
corpus AS (SELECT sum(k) / sum(n) AS mean FROM hosts),
spread AS (SELECT any_value(mean) AS mean, avg((k / n - mean) * (k / n - mean)) - avg(mean * (1 - mean) / n) AS more FROM hosts, corpus),
prior AS (SELECT mean, CASE WHEN mean > 0 AND mean < 1 AND more > 1e-12 THEN least(greatest(mean * (1 - mean) / more - 1, 1.0), 1000.0) ELSE 1000.0 END AS strength FROM spread),
verdicts AS (SELECT source, (k + mean * strength) / (n + strength) AS rate FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_shouted, base_failed, round(rate, 6) AS host_rate,
    NOT base_failed AND points < 2 AND NOT (points > 0 AND rate > 0.5) AS kept
FROM judged j JOIN verdicts v ON j.source IS NOT DISTINCT FROM v.source
"""

NGRAMS = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT text, min(doc_id) AS text_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS words FROM d GROUP BY text),
placed AS (SELECT text_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM t),
s AS (
    SELECT DISTINCT text_id, gram FROM (SELECT text_id, """ + _gram(5) + r""" AS gram FROM placed WINDOW w AS (PARTITION BY text_id ORDER BY i)) WHERE gram IS NOT NULL
    UNION SELECT text_id, array_to_string(words, ' ') FROM t WHERE len(words) BETWEEN 1 AND 4
),
sizes AS (SELECT text_id, count(*) AS n FROM s GROUP BY 1),
links AS (
    SELECT a, b FROM (SELECT x.text_id AS a, y.text_id AS b, count(*) AS c FROM s x JOIN s y ON x.gram = y.gram AND x.text_id <> y.text_id GROUP BY 1, 2)
    JOIN sizes p ON p.text_id = a JOIN sizes q ON q.text_id = b WHERE 10 * c >= 8 * (p.n + q.n - c)
),
reach AS (SELECT text_id AS a, text_id AS b FROM t UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, class_id, t.text_id, coalesce(n_links, 0) AS n_links
FROM d JOIN t USING (text) JOIN (SELECT a AS text_id, min(b) AS class_id FROM reach GROUP BY 1) USING (text_id)
LEFT JOIN (SELECT a AS text_id, count(*) AS n_links FROM links GROUP BY 1) USING (text_id)
"""


def _rows(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def licences(coverage: float = 0.6, rare: int = 3) -> str:
    templates = [(n, label, t.split(), phrases) for n, (label, t, phrases) in enumerate(TEMPLATES)]
    words = _rows([(n, i, w) for n, _, ws, _ in templates for i, w in enumerate(ws)])
    phrases = [(n, j, p.split()) for n, _, _, ps in templates for j, p in enumerate(ps)]
    phrase_words = _rows([(n, j, i, w) for n, j, ws in phrases for i, w in enumerate(ws)])
    base = [(j, label, p.split()) for j, (p, label) in enumerate(BASE.items())]
    base_words = _rows([(j, i, w) for j, _, ws in base for i, w in enumerate(ws)])
    labels, lengths = _rows([(n, label, len(ws)) for n, label, ws, _ in templates]), _rows([(j, label, len(ws)) for j, label, ws in base])
    phrase_lengths = _rows([(n, j, len(ws)) for n, j, ws in phrases])
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM d),
tw(t, i, word) AS (VALUES {words}), tl(t, label, n) AS (VALUES {labels}), pw(t, j, i, word) AS (VALUES {phrase_words}), pl(t, j, n) AS (VALUES {phrase_lengths}),
bw(b, i, word) AS (VALUES {base_words}), bl(b, label, n) AS (VALUES {lengths}),
df AS (SELECT word, count(DISTINCT doc_id) AS df FROM w WHERE word IN (SELECT word FROM tw UNION SELECT word FROM bw) GROUP BY 1),
idf AS (SELECT word, ln(((SELECT count(*) FROM d) + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM (SELECT word FROM tw UNION SELECT word FROM bw) LEFT JOIN df USING (word)),
keys AS (
    SELECT word FROM (SELECT word, row_number() OVER (PARTITION BY t ORDER BY idf DESC, word) AS r FROM (SELECT DISTINCT t, word FROM pw) JOIN idf USING (word)) WHERE r <= {rare}
    UNION SELECT word FROM (SELECT word, row_number() OVER (PARTITION BY b ORDER BY idf DESC, word) AS r FROM (SELECT DISTINCT b, word FROM bw) JOIN idf USING (word)) WHERE r = 1
),
starts AS (SELECT DISTINCT doc_id, t, pos - i AS start FROM w JOIN tw USING (word) WHERE word IN (SELECT word FROM keys)),
totals AS (SELECT t, sum(idf) AS total FROM tw JOIN idf USING (word) GROUP BY 1),
needs AS (SELECT t, count(*) AS n_phrases FROM pl GROUP BY 1),
shares AS (
    SELECT s.doc_id, s.t, s.start, sum(idf.idf) / any_value(total) AS share
    FROM starts s JOIN tw ON tw.t = s.t JOIN w ON w.doc_id = s.doc_id AND w.word = tw.word AND w.pos = s.start + tw.i
    JOIN idf ON idf.word = tw.word JOIN totals ON totals.t = s.t GROUP BY ALL
),
holds AS (
    SELECT doc_id, t, j, start FROM (SELECT doc_id, p.t, p.j, w.pos - p.i AS start, count(*) AS c FROM w JOIN pw p USING (word) GROUP BY ALL) JOIN pl USING (t, j) WHERE c = pl.n
),
found AS (
    SELECT doc_id, t, start, share FROM (
        SELECT s.doc_id, s.t, s.start, s.share, count(DISTINCT h.j) AS c FROM shares s JOIN tl ON tl.t = s.t JOIN holds h ON h.doc_id = s.doc_id AND h.t = s.t
        JOIN pl ON pl.t = h.t AND pl.j = h.j
        WHERE s.share >= {coverage} AND h.start >= greatest(s.start, 0) AND h.start + pl.n <= s.start + tl.n GROUP BY ALL
    ) JOIN needs USING (t) WHERE c = n_phrases
),
own AS (
    SELECT doc_id, b, start FROM (SELECT doc_id, b, w.pos - bw.i AS start, count(*) AS c FROM w JOIN bw USING (word) GROUP BY ALL) JOIN bl USING (b) WHERE c = bl.n
),
base AS (
    SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
    FROM own JOIN bl USING (b) GROUP BY 1
),
named AS (
    SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
    FROM (SELECT doc_id, label FROM found JOIN tl USING (t) UNION SELECT doc_id, label FROM own JOIN bl USING (b)) GROUP BY 1
),
best AS (SELECT doc_id, max(share) AS share FROM found GROUP BY 1)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(CASE WHEN n_base > 0 THEN 1.0 ELSE least(coalesce(share, 0.0), 1.0) END, 6) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN best USING (doc_id)
"""




#: Every order of the filters is run through; documents are counted by the set of filters they fail first.
AUDIT = r"""WITH d AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), f AS (
    SELECT part, concat(CASE WHEN len(words) < 200 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END,
        CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END, CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
        CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails,
        CASE WHEN quality = 1 THEN 1 ELSE 0 END AS good, CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS bad
    FROM d LEFT JOIN labels USING (doc_id)
), m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), r AS (
    SELECT part, o, fails, n, good, bad, list_min(list_transform(string_split(fails, ''), lambda c: CASE WHEN c = '' THEN 6 ELSE strpos(o, c) END)) AS hit
    FROM m, orders
), s AS (
    SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, substr(o, CAST(step AS INTEGER), 1) AS x,
        CAST(coalesce(sum(n) FILTER (hit IS NULL OR hit > step), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (hit = step), 0) AS BIGINT) AS removed,
        CAST(coalesce(sum(n) FILTER (hit < step AND contains(fails, substr(o, CAST(step AS INTEGER), 1))), 0) AS BIGINT) AS redundant,
        CAST(coalesce(sum(n) FILTER (fails = substr(o, CAST(step AS INTEGER), 1)), 0) AS BIGINT) AS unique_fails,
        CAST(coalesce(sum(good) FILTER (hit = step), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(bad) FILTER (hit = step), 0) AS BIGINT) AS toxic_lost
    FROM r, (SELECT unnest([1, 2, 3, 4, 5]) AS step) GROUP BY part, o, step
)
SELECT * EXCLUDE (x), CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM s"""
