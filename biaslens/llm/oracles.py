"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from .common import LOWER, UPPER
from .mixing import MIN_WEIGHT
from .quality import ANY_MARK, BOILERPLATE, CLOSED, DOUBLED, EVERYDAY, EVERYDAY_WORDS, SYMBOLS, LineRules

SQL: dict[str, str] = {}

_TEXT = "coalesce(text, '')"
_WORDS = rf"list_filter(regexp_split_to_array({_TEXT}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_R = LineRules()
# Phrases as whole words. Other characters are doubled before the search, so that
# phrases side by side do not share the one between them.
_OUTSIDE = r"[^\p{L}\p{N}_]"
_DOUBLED_GAPS = f"regexp_replace(translate(l, '{UPPER}', '{LOWER}'), '({_OUTSIDE})', '\\1\\1', 'g')"


def _bordered(phrases) -> str:
    def one(p: str) -> str:
        body = "".join(c if c.isalnum() else ("\\" + c if c in "()" else c) * 2 for c in p)
        return (f"(?:^|{_OUTSIDE})" if p[0].isalnum() else "") + body + (f"(?:$|{_OUTSIDE})" if p[-1].isalnum() else "")
    return _quoted("|".join(map(one, phrases)))


_FURNITURE = f"regexp_matches(d, {_bordered(p for p in BOILERPLATE if p not in EVERYDAY)})"
_SAID = f"len(regexp_extract_all(d, {_bordered(EVERYDAY)}))"
_LONE = r"[|>»›•·]|::"
SQL["op2_quality_rules"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TEXT} AS t, {_WORDS} AS w FROM documents),
w3 AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
       FROM d, unnest(range(1, greatest(len(w) - 1, 1))) AS u(i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM w3) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY r),
lines AS (SELECT r, l, len(list_filter(regexp_split_to_array(l, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n,
                 list_filter(regexp_split_to_array(l, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS lw,
                 {_DOUBLED_GAPS} AS d
          FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)),
judged AS (SELECT r, l, n,
      (regexp_matches(l, {_quoted(ANY_MARK)})
       AND (length(l) - length(regexp_replace(l, '[{SYMBOLS}]', '', 'g')) > {_R.max_symbol_share} * n
            OR len(regexp_extract_all(l, {_quoted(DOUBLED)})) > {_R.max_doubled_share} * n
            OR len(list_filter(lw, lambda x: regexp_full_match(x, {_quoted(_LONE)}))) > {_R.max_separator_share} * n))
      OR (n <= {_R.unfinished_words} AND NOT regexp_matches(l, {_quoted(CLOSED)}))
      OR (n <= {_R.boilerplate_words} AND ({_FURNITURE} OR {2 * EVERYDAY_WORDS} * {_SAID} > n)) AS fails
   FROM lines WHERE n > 0),
per AS (SELECT r, count(*) - count(DISTINCT l) AS dup, sum(CASE WHEN fails THEN n ELSE 0 END) AS lost
        FROM judged GROUP BY r),
f AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
             coalesce(lost, 0) AS lost
      FROM d LEFT JOIN rep USING (r) LEFT JOIN per USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.max_repeat_percent} * n_words AS base_failed,
       NOT (n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.max_repeat_percent} * n_words)
       AND lost <= {_R.max_lost_share} * n_words AS kept
FROM f
"""

SQL["op5_mixing"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, {_TEXT} AS t, {_WORDS} AS w FROM documents),
f AS (SELECT r, doc_id, source, len(w)::BIGINT AS size,
             md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || t) AS tie,
             greatest({MIN_WEIGHT}::DOUBLE, 1 - (length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')))::DOUBLE
                      / greatest(length(array_to_string(w, '')), 1)::DOUBLE) AS q FROM d),
k AS (SELECT *, -ln((('0x' || substr(tie, 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE) / q AS key FROM f),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rk,
              1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total, 2.0::DOUBLE * source_size AS cap FROM s),
s2 AS (SELECT *, ([3, 1, 2])[((rk - 1) % 3 + 1)::INT]::DOUBLE AS wt FROM s1),
s3 AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / wt, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(wt) OVER (ORDER BY cap / wt, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM s2),
s4 AS (SELECT source, source_size, least(cap, max(lvl) OVER () * wt) AS target FROM s3),
s5 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM s4),
run AS (SELECT k.doc_id, k.size, s5.*, coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, tie
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM k JOIN s5 ON k.source IS NOT DISTINCT FROM s5.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN before + size / 2.0::DOUBLE <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run
"""

SQL["op10_substrings"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS x
      FROM d, unnest(range(1, greatest(len(w) - 33, 1))) AS u(i)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY x) AS n FROM s) WHERE n > 1),
gone AS (SELECT DISTINCT r, i + k AS p FROM again, unnest(range(0, 35)) AS o(k)),
words AS (SELECT r, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(p)),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

_GROUPS = " || ".join(f"to_base(('0x' || substr(h, {10 * i + 1}, 10))::BIGINT, 32, 8)" for i in range(4))
SQL["op4_warc"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, strlen(t)::BIGINT AS payload_bytes,
             translate(upper({_GROUPS}), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest
      FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""

SQL["op6_chat_format"] = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'),
                            (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
e AS (SELECT *, length(regexp_replace(r, '<(\\*)\|', '<\1\\|', 'g')) + length(regexp_replace(t, '<(\\*)\|', '<\1\\|', 'g'))
                + length('<|im_start|><|im_sep|><|im_end|>') AS n FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
       coalesce(sum(length(t)) FILTER (WHERE r = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

_FOLDED = f"translate({_TEXT}, '{UPPER}', '{LOWER}')"

SQL["op12_exact_dedup"] = f"""
WITH d AS (SELECT doc_id, {_FOLDED} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM d JOIN g USING (t)
"""

_TERMS = rf"regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL["op13_ranked_search"] = rf"""
WITH d AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
d1 AS (SELECT doc_id, terms, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM d1),
tf AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf
       FROM (SELECT doc_id, n, unnest(terms) AS term FROM d1) GROUP BY doc_id, n, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
      FROM tf, s GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
scored AS (SELECT item_id, doc_id,
      sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
   FROM q JOIN w USING (term) JOIN tf USING (term), s GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
      FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""
