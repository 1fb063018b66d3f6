"""DuckDB oracle for the summary chain on ``conversations``.

Written the straightforward way (whole joined text per discussion, windows
over each discussion) so it checks the distributed Spark plan independently.
"""

from __future__ import annotations

from .. import rules
from . import sqlgen as G


CONV_COMMENTS = """
  SELECT conv_id AS post_id, CAST(turn - 1 AS INTEGER) AS pos, coalesce(text, '') AS text
  FROM conversations WHERE turn > 0"""


def summary_ctes(lexicon=None, stop_words=None, comments_sql: str = CONV_COMMENTS,
                 lemma_rule: str | None = None, by_source: bool = False) -> str:
    """``lemma_rule``: SQL expression over ``w`` giving the lemma of token w.  ``by_source``: sentences go with the
    comment they begin in: ``starts`` finds it by marks at the beginnings of comments in the joined text."""
    lem = lemma_rule or "w"
    starts = f"""
marked AS (
  SELECT post_id, unnest(parts) AS piece, generate_subscripts(parts, 1) - 1 AS sid
  FROM (SELECT post_id, string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS parts
        FROM (SELECT post_id, string_agg(chr(2) || idx || chr(3) || text || ' ', '' ORDER BY idx) AS t FROM v GROUP BY post_id))
),
starts AS (
  SELECT post_id, sid, CAST(coalesce(regexp_extract_all(regexp_extract(piece, '^(\\s|\\x02[0-9]+\\x03)*'), '\\x02([0-9]+)\\x03', 1)[-1],
    last_value(regexp_extract_all(piece, '\\x02([0-9]+)\\x03', 1)[-1] IGNORE NULLS) OVER (
      PARTITION BY post_id ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS BIGINT) AS src
  FROM marked
),""" if by_source else ""
    paired = ("JOIN starts b ON s.post_id = b.post_id AND s.sid = b.sid JOIN lab l ON s.post_id = l.post_id AND b.src = l.idx" if by_source
              else "JOIN lab l ON s.post_id = l.post_id AND s.sid = l.idx")
    return f"""
WITH c AS ({comments_sql}
),
p AS (SELECT conv_id AS post_id, text AS title FROM conversations WHERE turn = 0),
v AS (
  SELECT post_id, pos, text, row_number() OVER (PARTITION BY post_id ORDER BY pos) - 1 AS idx
  FROM c WHERE {G.strip('text')} NOT IN ({G.str_list(rules.DEAD_MARKERS)})
),
lab AS (
  SELECT v.post_id, v.idx,
         CASE WHEN round(s.pol, 9) > 0 THEN 'positive' WHEN round(s.pol, 9) < 0 THEN 'negative' ELSE 'neutral' END AS label
  FROM v LEFT JOIN {G.lexicon_scores('v', 'post_id, idx', 'text', lexicon)} s USING (post_id, idx)
),
alltext AS (SELECT post_id, string_agg(text || ' ', '' ORDER BY idx) AS t FROM v GROUP BY post_id),
pieces AS (
  SELECT post_id, unnest(parts) AS piece, generate_subscripts(parts, 1) - 1 AS sid
  FROM (SELECT post_id, string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS parts
        FROM alltext)
),
sents AS (
  SELECT post_id, sid, {G.strip('piece')} AS sentence FROM pieces WHERE {G.strip('piece')} <> ''
),
vt AS (SELECT post_id, {lem} AS word FROM (SELECT post_id, unnest({G.tokens('text')}) AS w FROM v)),
freq AS (
  SELECT post_id, word, count(*) AS freq FROM vt
  WHERE word NOT IN ({G.stop_words_list(stop_words)}) GROUP BY post_id, word
),
st AS (SELECT post_id, sid, {lem} AS word FROM (SELECT post_id, sid, unnest({G.tokens('sentence')}) AS w FROM sents)),
sstat AS (
  SELECT st.post_id, st.sid, sum(f.freq) AS c, count(*) AS n
  FROM st JOIN freq f ON st.post_id = f.post_id AND st.word = f.word
  GROUP BY st.post_id, st.sid
),
{starts}
aligned AS (
  SELECT s.post_id, s.sid, s.sentence, l.label, l.idx AS src,
         CAST(coalesce(ss.c, 0) AS BIGINT) AS c, CAST(coalesce(ss.n, 0) AS BIGINT) AS n
  FROM sents s {paired}
  LEFT JOIN sstat ss ON s.post_id = ss.post_id AND s.sid = ss.sid
),
suffix AS (
  SELECT *,
    sum(CASE WHEN label = 'positive' THEN 1 ELSE 0 END) OVER w AS sp,
    sum(CASE WHEN label = 'negative' THEN 1 ELSE 0 END) OVER w AS sq,
    count(*) OVER w AS sm
  FROM aligned WHERE n > 0
  WINDOW w AS (PARTITION BY post_id, sentence ORDER BY sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
),
grp AS (
  SELECT post_id, sentence,
         first(c) * sum(exp(sp * {G.LN_POS} + sq * {G.LN_NEG} - sm * ln(CAST(n AS DOUBLE)))) AS score,
         min(sid) AS first_idx
  FROM suffix GROUP BY post_id, sentence
),
scores AS (
  SELECT a.*, g.score, g.first_idx FROM aligned a JOIN grp g USING (post_id, sentence) WHERE a.n > 0
),
dist AS (
  SELECT post_id, count(*) AS total_comments,
         CAST(count_if(label = 'positive') AS BIGINT) AS positive,
         CAST(count_if(label = 'negative') AS BIGINT) AS negative,
         CAST(count_if(label = 'neutral') AS BIGINT) AS neutral, max(n > 0) AS any_scored
  FROM aligned GROUP BY post_id
),
nvalid AS (SELECT post_id, count(*) AS n_valid FROM v GROUP BY post_id)
"""


#: One row a post from p, nvalid, dist and summ (post_id, s).
FINAL_SELECT = f"""
SELECT p.post_id, p.title,
  CASE WHEN nv.n_valid IS NULL THEN {G.q(rules.MSG_NO_COMMENTS)}
       WHEN d.total_comments IS NULL THEN {G.q(rules.MSG_BLANK_TEXT)}
       WHEN NOT d.any_scored THEN {G.q(rules.MSG_NOT_SCORED)}
       ELSE summ.s END AS summary,
  CAST(CASE WHEN nv.n_valid IS NOT NULL AND d.any_scored THEN d.total_comments ELSE 0 END AS BIGINT) AS total_comments,
  CAST(CASE WHEN nv.n_valid IS NOT NULL AND d.any_scored THEN d.positive ELSE 0 END AS BIGINT) AS positive,
  CAST(CASE WHEN nv.n_valid IS NOT NULL AND d.any_scored THEN d.negative ELSE 0 END AS BIGINT) AS negative,
  CAST(CASE WHEN nv.n_valid IS NOT NULL AND d.any_scored THEN d.neutral ELSE 0 END AS BIGINT) AS neutral
FROM p LEFT JOIN nvalid nv USING (post_id) LEFT JOIN dist d USING (post_id)
LEFT JOIN summ USING (post_id)
"""


def summary_sql(n: int = 5, lexicon=None, stop_words=None, comments_sql: str = CONV_COMMENTS) -> str:
    return summary_ctes(lexicon, stop_words, comments_sql) + f""",
picked AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY round(score, 9) DESC, sid) AS rk
    FROM scores) WHERE rk <= {n}
),
summ AS (
  SELECT post_id, '- ' || string_agg(sentence, chr(10) || '- ' ORDER BY first_idx, sid) AS s
  FROM picked GROUP BY post_id
)
""" + FINAL_SELECT
