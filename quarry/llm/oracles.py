"""DuckDB SQL for the queries that SQL can express."""

_SPACE = "[\\x20\\x09-\\x0D]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_ESCAPED = "replace(replace(replace({}, '\\', '\\\\'), '###', '\\###'), '</turn>', '\\</turn>')"

OP2 = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(replace({_ESCAPED.format("role")}, ':', '\\:')) + 2 + length({_ESCAPED.format("text")}) + 8) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id
"""

OP5 = f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^{_SPACE}+|{_SPACE}+$', '', 'g'), '{_UPPER}', '{_LOWER}') AS k FROM lines
), held AS (
  SELECT k, min(doc_id) AS least FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT keyed.*, coalesce(doc_id <> least, false) AS gone FROM keyed LEFT JOIN held USING (k)
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP7 = """
WITH split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents
), starts AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS pos FROM split WHERE len(words) >= 13
), windows AS (
  SELECT doc_id, pos, array_to_string(words[pos:pos + 12], ' ') AS gram FROM starts
), least AS (
  SELECT gram, min(doc_id) AS least FROM windows GROUP BY gram HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS pos FROM windows JOIN least USING (gram) WHERE least < doc_id
), placed AS (
  SELECT doc_id, generate_subscripts(words, 1) AS pos, unnest(words) AS word FROM split
), left_over AS (
  SELECT p.doc_id, p.pos, p.word, g.pos IS NOT NULL AS removed FROM placed p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.pos = g.pos
), digests AS (
  SELECT doc_id, CAST(sum(removed::INT) AS BIGINT) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT removed), '')) AS kept_sha256
  FROM left_over GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM split LEFT JOIN digests USING (doc_id)
"""

_FILL = """
  SELECT *, CASE WHEN room <= weight * level THEN CAST(room AS DOUBLE) ELSE weight * first_value(CASE WHEN NOT room <= weight * level THEN level END IGNORE NULLS)
    OVER (PARTITION BY {by} ORDER BY room / weight, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS take
  FROM (SELECT *, (budget - coalesce(sum(room) OVER (PARTITION BY {by} ORDER BY room / weight, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (PARTITION BY {by} ORDER BY room / weight, {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM {table})
"""

OP4 = f"""
WITH rows_ AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' THEN 'other'
      ELSE 'd' || CAST(CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS BIGINT) % 4 AS VARCHAR) END AS domain,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens
  FROM documents
), leaves AS (
  SELECT domain, lang, source, CAST(sum(n_tokens) AS DOUBLE) AS tokens, 2.0::DOUBLE * sum(n_tokens) AS room FROM rows_ GROUP BY ALL HAVING sum(n_tokens) > 0
), d0 AS (
  SELECT domain, sum(room) AS room, (SELECT sum(tokens) * 0.8::DOUBLE FROM leaves) AS budget,
    CASE domain WHEN 'd0' THEN 0.3::DOUBLE WHEN 'd1' THEN 0.3 WHEN 'd2' THEN 0.2 WHEN 'd3' THEN 0.2 ELSE 0.1 END AS weight FROM leaves GROUP BY domain
), d1 AS ({_FILL.format(by="1::INT", child="domain", table="d0")}
), l0 AS (
  SELECT x.domain, x.lang, x.room, d1.take AS budget, CASE x.lang WHEN 'en' THEN 0.5::DOUBLE WHEN 'de' THEN 0.2 WHEN 'fr' THEN 0.2 WHEN 'es' THEN 0.1 ELSE 0.1 END AS weight
  FROM (SELECT domain, lang, sum(room) AS room FROM leaves GROUP BY ALL) x JOIN d1 USING (domain)
), l1 AS ({_FILL.format(by="domain", child="lang", table="l0")}
), s0 AS (
  SELECT x.*, l1.take AS budget, 1.0::DOUBLE AS weight FROM leaves x JOIN l1 ON x.domain = l1.domain AND x.lang = l1.lang
), s1 AS ({_FILL.format(by="domain, lang", child="source", table="s0")}
), plan AS (
  SELECT domain, lang, source, CAST(tokens AS BIGINT) AS tokens, CAST(floor(take + 0.001) AS BIGINT) AS take FROM s1
), epochs AS (
  SELECT r.*, e.epoch, p.take - e.epoch * p.tokens AS rest, p.tokens
  FROM rows_ r JOIN plan p USING (domain, lang, source), LATERAL (SELECT unnest(range(0, p.take // p.tokens + 1)) AS epoch) e
), ordered AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY md5('17:' || epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM epochs
)
SELECT doc_id, domain, lang, source, epoch, n_tokens FROM ordered WHERE rest >= tokens OR coalesce(earlier, 0) < rest
"""

_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

OP3 = f"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_SPACE}+'), lambda w: w <> '') AS words FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[pos:pos + 2], ' ') AS s FROM (SELECT doc_id, words, unnest(CASE WHEN len(words) >= 3 THEN range(1, len(words) - 1) WHEN len(words) > 0 THEN [1] ELSE [] END) AS pos FROM split)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  WHERE 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n) GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
  SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(least.least, d.doc_id)) AS component_id, d.doc_id <= coalesce(least.least, d.doc_id) AS kept, coalesce(l.links, 0) AS n_links
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS links FROM links GROUP BY a) l USING (doc_id)
"""


def _longest() -> str:
    """CTEs that end in s0 (doc_id, lo): the words of the longest passage that occurs again, by binary search over hashes of 1, 2, 4, ... words."""
    out = ["h0 AS MATERIALIZED (SELECT doc_id, pos, hash(word) AS h FROM placed)"]
    for j in range(1, 15):
        out.append(f"h{j} AS MATERIALIZED (SELECT * FROM (SELECT doc_id, pos, CASE WHEN lead(h, {1 << j - 1}) OVER w IS NOT NULL THEN hash(h, lead(h, {1 << j - 1}) OVER w) END AS h FROM h{j - 1} WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE h IS NOT NULL)")
    levels = " UNION ALL ".join(f"SELECT doc_id, {j} AS j FROM h{j} GROUP BY doc_id, h HAVING count(*) > 1" for j in range(15))
    out.append(f"tops AS MATERIALIZED (SELECT doc_id, max(j) AS top FROM ({levels}) GROUP BY doc_id)")
    mine = " UNION ALL ".join(f"SELECT doc_id, pos, h FROM h{j} JOIN tops USING (doc_id) WHERE top = {j}" for j in range(15))
    out.append(f"mine AS MATERIALIZED ({mine})")
    out.append("s14 AS MATERIALIZED (SELECT doc_id, CASE WHEN top IS NULL THEN 0 ELSE 1 << top END AS lo, coalesce(top, -1) AS top FROM split LEFT JOIN tops USING (doc_id))")
    for j in range(13, -1, -1):
        out.append(f"a{j} AS MATERIALIZED (SELECT doc_id, h, pos + lo + {1 << j} - (1 << top) AS to_ FROM mine JOIN s{j + 1} USING (doc_id) WHERE top > {j})")
        out.append(f"r{j} AS MATERIALIZED (SELECT DISTINCT doc_id FROM (SELECT doc_id FROM a{j} JOIN (SELECT doc_id, pos AS to_, h AS then_ FROM mine) USING (doc_id, to_) GROUP BY doc_id, h, then_ HAVING count(*) > 1))")
        out.append(f"s{j} AS MATERIALIZED (SELECT s{j + 1}.doc_id, CASE WHEN r{j}.doc_id IS NULL THEN lo ELSE lo + {1 << j} END AS lo, top FROM s{j + 1} LEFT JOIN r{j} USING (doc_id))")
    return ", ".join(out)


def _repeated(n: int) -> str:
    """Words of each document that lie in windows of n words that occur again in it."""
    return f"""(SELECT doc_id, count(*) AS words FROM (SELECT DISTINCT doc_id, unnest(range(pos, pos + {n})) AS pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, gram) AS many FROM (
      SELECT doc_id, pos, array_to_string(words[pos:pos + {n - 1}], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - {n - 2})) AS pos FROM split WHERE len(words) >= {n}))) WHERE many > 1) GROUP BY doc_id)"""


OP6 = f"""
WITH split AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
placed AS MATERIALIZED (SELECT doc_id, generate_subscripts(words, 1) AS pos, unnest(words) AS word FROM split),
{_longest()},
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM split) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
figures AS (
  SELECT doc_id, CAST(len(split.words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(split.words, lambda w: length(w))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    coalesce(lines.n, 0) AS n_dup_lines, coalesce(three.words, 0) AS n_repeat_words, coalesce(six.words, 0) AS covered_words, CAST(lo AS BIGINT) AS longest_repeat
  FROM split LEFT JOIN lines USING (doc_id) LEFT JOIN (SELECT doc_id, words FROM {_repeated(3)}) three USING (doc_id) LEFT JOIN (SELECT doc_id, words FROM {_repeated(6)}) six USING (doc_id) JOIN s0 USING (doc_id)
), judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM figures)
SELECT *, NOT base_failed AND NOT (100 * covered_words > 25 * n_words OR (longest_repeat >= 6 AND 100 * longest_repeat > 15 * n_words)) AS kept FROM judged
"""

# The pages of the test tables have one layout, in which the main text is the article: a heading and paragraphs.
_ARTICLE = "regexp_replace(regexp_extract(html, '(?s)<article>(.*?)(?:</article>|<footer>|$)', 1), '<b>|</b>', '', 'g')"
OP9 = f"""
WITH plain AS (SELECT page_id, url, regexp_replace({_ARTICLE}, '<[^>]*>', ' ', 'g') AS t FROM pages),
texts AS (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(t, '&quot;', '"'), '&copy;', '\xa9'), '&middot;', '\xb7'), '&amp;', '&'), '[\\s\\x0B]+', ' ', 'g')) AS text FROM plain)
SELECT page_id, url, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars FROM texts
"""

SQL = {"op2_chat_formatting": OP2, "op3_minhash_near_dedup": OP3, "op4_source_mixing": OP4, "op5_line_dedup": OP5, "op6_quality_rules": OP6, "op7_substring_dedup": OP7, "op9_html_extraction": OP9}
