"""DuckDB SQL oracles, one per registered query.

Each oracle is an *independent* formulation (e.g. AUC by average ranks
instead of prefix sums) over the same parquet views, so one shared mistake
cannot pass both. DuckDB lambdas are written ``lambda x: ...``.
"""

from __future__ import annotations

from .config import AUX_COLUMNS, DEFAULT, FEATURE_COLUMNS, IDENTITY_COLUMNS, RUN_SWEEP
from .sources.tables import comments_sql

R = 9  # decimals every floating result is rounded to, on both sides

ID_LIST = ", ".join(IDENTITY_COLUMNS)


def _bool(c: str) -> str:
    return f"coalesce(NOT isnan({c}) AND {c} >= 0.5, false)"


def comments_cte() -> str:
    return f"c AS ({comments_sql('documents')})"


def _auc_ctes(source: str | None = None, src: str = "c", target: str = "target",
              score: str = "prediction", by: str = "0") -> str:
    """bias(e, subgroup, ...) by average ranks; ``e`` is the ``by`` value. A set
    with a missing score has no AUC."""
    flags = ", ".join(f"{_bool(g)} AS {g}" for g in IDENTITY_COLUMNS)
    return f"""{source or comments_cte()},
v AS (SELECT {by} AS e, {score} AS score, {_bool(target)} AS y, {flags} FROM {src}),
u AS (UNPIVOT v ON {ID_LIST} INTO NAME subgroup VALUE f),
ex AS (
  SELECT e, subgroup, 'sub' AS kind, score, y FROM u WHERE f
  UNION ALL SELECT e, subgroup, 'bpsn', score, y FROM u WHERE (f AND NOT y) OR (NOT f AND y)
  UNION ALL SELECT e, subgroup, 'bnsp', score, y FROM u WHERE (f AND y) OR (NOT f AND NOT y)
  UNION ALL SELECT e, '__all__', 'sub', score, y FROM v),
r AS (SELECT e, subgroup, kind, y, score,
        rank() OVER (PARTITION BY e, subgroup, kind ORDER BY score)
        + (count(*) OVER (PARTITION BY e, subgroup, kind, score) - 1) / 2.0 AS rk
      FROM ex),
a AS (SELECT e, subgroup, kind, count(*) - count(score) AS missing,
        sum(CASE WHEN y THEN 1 ELSE 0 END) AS p, sum(CASE WHEN y THEN 0 ELSE 1 END) AS n,
        sum(CASE WHEN y THEN rk ELSE 0 END) AS rs
      FROM r GROUP BY e, subgroup, kind),
auc AS (SELECT e, subgroup, kind,
          CASE WHEN p > 0 AND n > 0 AND missing = 0 THEN (rs - p * (p + 1) / 2.0) / (p * n) END AS auc
        FROM a),
sizes AS (SELECT e, subgroup, count(*) FILTER (WHERE f) AS subgroup_size FROM u GROUP BY e, subgroup
          UNION ALL SELECT e, '__all__', count(*) FROM v GROUP BY e),
bias AS (SELECT s.e, s.subgroup, s.subgroup_size,
           max(CASE WHEN kind = 'sub' THEN auc END) AS subgroup_auc,
           max(CASE WHEN kind = 'bpsn' THEN auc END) AS bpsn_auc,
           max(CASE WHEN kind = 'bnsp' THEN auc END) AS bnsp_auc
         FROM sizes s LEFT JOIN auc USING (e, subgroup)
         GROUP BY s.e, s.subgroup, s.subgroup_size)"""


def bias_metrics() -> str:
    return f"""WITH {_auc_ctes()}
SELECT subgroup, CAST(subgroup_size AS BIGINT) AS subgroup_size,
       round(subgroup_auc, {R}) AS subgroup_auc, round(bpsn_auc, {R}) AS bpsn_auc,
       round(bnsp_auc, {R}) AS bnsp_auc
FROM bias"""


def final_metric() -> str:
    def pm(c: str) -> str:
        return (f"CASE WHEN count({c}) = count(*) THEN pow(avg(pow({c}, -5.0)), 1.0 / -5.0) END")
    return f"""WITH {_auc_ctes()},
pms AS (SELECT {pm('subgroup_auc')} AS pm_sub, {pm('bpsn_auc')} AS pm_bpsn, {pm('bnsp_auc')} AS pm_bnsp
        FROM bias WHERE subgroup <> '__all__'),
ov AS (SELECT subgroup_auc AS overall_auc FROM bias WHERE subgroup = '__all__')
SELECT round(overall_auc, {R}) AS overall_auc,
       round(pm_sub, {R}) AS power_mean_subgroup_auc, round(pm_bpsn, {R}) AS power_mean_bpsn_auc,
       round(pm_bnsp, {R}) AS power_mean_bnsp_auc,
       round((pm_sub + pm_bpsn + pm_bnsp) / 3, {R}) AS bias_score,
       round(0.25 * overall_auc + 0.75 * (pm_sub + pm_bpsn + pm_bnsp) / 3, {R}) AS final_metric
FROM pms, ov"""


def _sub_auc(col: str, extra: str = "") -> str:
    return f"""WITH {_auc_ctes()}
SELECT subgroup, {extra}round({col}, {R}) AS {col} FROM bias WHERE subgroup <> '__all__'"""


def overall_auc() -> str:
    return f"""WITH {_auc_ctes()}
SELECT round(subgroup_auc, {R}) AS overall_auc FROM bias WHERE subgroup = '__all__'"""


def power_mean() -> str:
    def pm(c: str) -> str:
        return f"round(CASE WHEN count({c}) = count(*) THEN pow(avg(pow({c}, -5.0)), -0.2) END, {R})"
    return f"""WITH {_auc_ctes()}
SELECT {pm('subgroup_auc')} AS power_mean_subgroup_auc, {pm('bpsn_auc')} AS power_mean_bpsn_auc,
       {pm('bnsp_auc')} AS power_mean_bnsp_auc
FROM bias WHERE subgroup <> '__all__'"""


# Python str.split() separators, RE2 spelling.
WS_RE2 = (r"\t\n\x{0b}\x{0c}\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
          r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")


SMILEY_RE2 = r":\)|:-\)|;-\)|;\)"


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _cleaned_cte(src: str = "c", keys: str = "id", text: str = "comment_text") -> str:
    from .config import SPACE_CHARS
    return (f"t AS (SELECT {keys}, translate(coalesce({text}, 'nan'), {_sql_str(SPACE_CHARS)}, "
            f"{_sql_str(' ' * len(SPACE_CHARS))}) AS t FROM {src})")


def text_coerce() -> str:
    return f"WITH {comments_cte()} SELECT id, coalesce(comment_text, 'nan') AS comment_text FROM c"


def clean_spaces() -> str:
    return f"WITH {comments_cte()}, {_cleaned_cte()} SELECT id, t AS comment_text FROM t"


def _features_cte(source: str | None = None, src: str = "c", keys: str = "id",
                   text: str = "comment_text") -> str:
    def cnt(pattern: str) -> str:
        return f"length(regexp_replace(t, '[^{pattern}]', '', 'g'))"

    return f"""{source or comments_cte()}, {_cleaned_cte(src, keys, text)},
w AS (SELECT {keys}, t, regexp_extract_all(t, '[^{WS_RE2}]+') AS ws FROM t),
f AS (SELECT {keys},
  CAST(length(t) AS INTEGER) AS total_length,
  CAST({cnt(r'\p{Lu}')} AS INTEGER) AS capitals,
  CASE WHEN length(t) = 0 THEN 0.0 ELSE {cnt(r'\p{Lu}')} / length(t) END AS caps_vs_length,
  CAST({cnt('!')} AS INTEGER) AS num_exclamation_marks,
  CAST({cnt('?')} AS INTEGER) AS num_question_marks,
  CAST({cnt('.,;:')} AS INTEGER) AS num_punctuation,
  CAST(len(ws) AS INTEGER) AS num_words,
  CAST(len(list_distinct(ws)) AS INTEGER) AS num_unique_words,
  CASE WHEN len(ws) = 0 THEN 0.0 ELSE len(list_distinct(ws)) / len(ws) END AS words_vs_unique,
  CAST(len(regexp_extract_all(t, '{SMILEY_RE2}')) AS INTEGER) AS num_smilies,
  CAST({cnt('*&$%')} AS INTEGER) AS num_symbols
FROM w)"""


def meta_features() -> str:
    cols = ", ".join(f"round({c}, {R}) AS {c}" if c in ("caps_vs_length", "words_vs_unique") else c
                     for c in FEATURE_COLUMNS)
    return f"WITH {_features_cte()} SELECT id, {cols} FROM f"


def _stats_cte() -> str:
    return f"""st AS (SELECT feature, avg(v) AS mean, stddev_pop(v) AS std_pop
  FROM (UNPIVOT (SELECT {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in FEATURE_COLUMNS)} FROM f)
        ON {", ".join(FEATURE_COLUMNS)} INTO NAME feature VALUE v)
  GROUP BY feature)"""


def scale_fit() -> str:
    return (f"WITH {_features_cte()}, {_stats_cte()} "
            f"SELECT feature, round(mean, {R}) AS mean, round(std_pop, {R}) AS std_pop FROM st")


def scale_apply() -> str:
    cols = ", ".join(
        f"round(max(CASE WHEN feature = '{c}' THEN (v - mean) / CASE WHEN std_pop = 0 THEN 1 ELSE std_pop END END), {R}) AS {c}"
        for c in FEATURE_COLUMNS)
    return f"""WITH {_features_cte()}, {_stats_cte()},
long AS (UNPIVOT (SELECT id, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in FEATURE_COLUMNS)} FROM f)
         ON {", ".join(FEATURE_COLUMNS)} INTO NAME feature VALUE v)
SELECT id, {cols} FROM long JOIN st USING (feature) GROUP BY id"""


def binarize() -> str:
    cols = ", ".join(f"{_bool(c)} AS {c}" for c in ("target",) + IDENTITY_COLUMNS)
    return f"WITH {comments_cte()} SELECT id, {cols} FROM c"


def _nz(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR isnan({c}) THEN 0.0 ELSE {c} END"


def _targets_cte() -> str:
    return f"{comments_cte()},\n{_targets_only()}"


def _targets_only() -> str:
    ids = ", ".join(_nz(g) for g in IDENTITY_COLUMNS)
    return f"""tt AS (SELECT id, target, {", ".join(AUX_COLUMNS[1:])},
   len(list_filter([{ids}], lambda x: x >= 0.5)) AS n_ge,
   len(list_filter([{ids}], lambda x: x < 0.5)) AS n_lt,
   (target IS NOT NULL AND NOT isnan(target) AND target >= 0.5) AS tox,
   (target IS NOT NULL AND NOT isnan(target) AND target < 0.5) AS nontox
 FROM c),
tw AS (SELECT *, CASE WHEN tox THEN 1 ELSE 0 END AS y,
   CAST(0.25 AS DOUBLE) * (1 + (n_ge > 0)::INT + (tox AND n_lt > 0)::INT + (nontox AND n_ge > 0)::INT) AS weight
 FROM tt)"""


def targets() -> str:
    aux = ", ".join(f"round({c}, {R}) AS aux_{c}" for c in AUX_COLUMNS)
    return f"WITH {_targets_cte()} SELECT id, y, round(weight, {R}) AS weight, {aux} FROM tw"


def sample_weights() -> str:
    return f"WITH {_targets_cte()} SELECT weight, count(*) AS n_rows FROM tw GROUP BY weight"


def loss_weight() -> str:
    return f"WITH {_targets_cte()} SELECT round(1.0 / avg(weight), {R}) AS loss_weight FROM tw"


# Tokens: word runs or single non-blank characters (RE2 spelling).
_WS_CHARS = (r"\t\n\x{0b}\x{0c}\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
             r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
TOKEN_RE2 = rf"[\pL\pM\pN_]+|[^\pL\pM\pN_{_WS_CHARS}]"
MAX_LEN = 220


def _tok_ctes() -> str:
    return f"""{comments_cte()},
tk AS (SELECT id, regexp_extract_all(lower(coalesce(comment_text, 'nan')), '{TOKEN_RE2}') AS toks FROM c),
cnt AS (SELECT tok, count(*) AS n FROM (SELECT unnest(toks) AS tok FROM tk) GROUP BY tok),
voc AS (SELECT tok, CAST(3 + row_number() OVER (ORDER BY n DESC, tok) AS INTEGER) AS tid, n
        FROM cnt)"""


def tokens() -> str:
    return f"WITH {_tok_ctes()} SELECT id, toks AS tokens FROM tk"


def vocab() -> str:
    return f"WITH {_tok_ctes()} SELECT tok AS token, tid AS token_id, n FROM voc"


def _encoded(kept_expr: str) -> str:
    """ids of the kept tokens in position order, by an unnest + join + list."""
    return f"""{_tok_ctes()},
kept AS (SELECT id, {kept_expr} AS kt FROM tk),
ex AS (SELECT id, unnest(kt) AS tok, unnest(range(1, len(kt) + 1)) AS pos FROM kept),
ids AS (SELECT id, list(coalesce(v.tid, 1) ORDER BY pos) AS ids FROM ex LEFT JOIN voc v USING (tok) GROUP BY id),
enc AS (SELECT kept.id, coalesce(ids.ids, []::INTEGER[]) AS ids FROM kept LEFT JOIN ids USING (id))"""


def _zeros(n: str, v: int = 0) -> str:
    return f"list_transform(range(greatest({n}, 0)), lambda x: CAST({v} AS INTEGER))"


def encode_head() -> str:
    m = MAX_LEN - 2
    return f"""WITH {_encoded(f'toks[1:{m}]')}
SELECT id, [2] || ids || [3] || {_zeros(f'{m} - len(ids)')} AS token_ids FROM enc"""


def encode_head_tail() -> str:
    m = MAX_LEN - 2
    h = m // 3
    kept = f"CASE WHEN len(toks) > {m} THEN toks[1:{h}] || toks[len(toks) - {m - h} + 1:] ELSE toks END"
    return f"""WITH {_encoded(kept)}
SELECT id, [2] || ids || [3] || {_zeros(f'{m} - len(ids)')} AS token_ids,
       {_zeros('len(ids)', 0)} || {_zeros(f'{m} - len(ids)', 1)} AS pad_mask FROM enc"""


def encode_plain() -> str:
    m = MAX_LEN - 2
    return f"""WITH {_encoded(f'toks[1:{m}]')}
SELECT id, ids || {_zeros(f'{m} - len(ids)')} AS token_ids FROM enc"""


def _word_list(text: str) -> str:
    """Words of a text for the subword encoder: control characters go, accents
    go, ideographs and punctuation stand apart."""
    clean = rf"regexp_replace({text}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}\x{{FFFD}}]|\p{{Cf}}|\p{{Co}}', '', 'g')"
    apart = r"([!-/:-@\[-`{-~]|\p{P}|[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}])"
    spaced = rf"regexp_replace(strip_accents(lower({clean})), '{apart}', ' \1 ', 'g')"
    return rf"list_filter(regexp_split_to_array({spaced}, '[\s\p{{Z}}]+'), lambda x: x <> '')"


def _wordpiece(kept: str) -> str:
    """enc(id, ids): greedy longest match by recursion over each distinct word."""
    return f"""{comments_cte()},
bw AS (SELECT DISTINCT unnest({_word_list("coalesce(text, 'nan')")}) AS w FROM benchmark),
pieces AS (SELECT DISTINCT p FROM (
   SELECT w AS p FROM bw UNION ALL SELECT left(w, 1) FROM bw UNION ALL SELECT left(w, 2) FROM bw
   UNION ALL SELECT '##' || right(w, k::BIGINT) FROM bw, range(1, 5) t(k))),
voc AS (SELECT p, CAST(3 + row_number() OVER (ORDER BY p) AS INTEGER) AS tid FROM pieces),
docs AS (SELECT id, {_word_list("coalesce(comment_text, 'nan')")} AS ws FROM c),
w AS (SELECT DISTINCT unnest(ws) AS w FROM docs),
cut AS (SELECT w, s, l, CASE WHEN s = 1 THEN '' ELSE '##' END || substr(w, s, l) AS p
        FROM w, range(1, 101) a(s), range(1, (SELECT max(length(p)) + 1 FROM voc)) b(l)
        WHERE length(w) <= 100 AND s + l <= length(w) + 1),
best AS (SELECT w, s, max(l) AS l, arg_max(tid, l) AS tid FROM cut JOIN voc USING (p) GROUP BY w, s),
walk AS (SELECT w, 1 AS s, []::INTEGER[] AS ids FROM w
         UNION ALL SELECT walk.w, walk.s + best.l, walk.ids || [best.tid] FROM walk JOIN best ON best.w = walk.w AND best.s = walk.s),
whole AS (SELECT w, ids FROM walk WHERE s = length(w) + 1),
wid AS (SELECT w.w, coalesce(whole.ids, [1]) AS ids FROM w LEFT JOIN whole USING (w)),
ex AS (SELECT id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos FROM docs),
got AS (SELECT id, flatten(list(wid.ids ORDER BY pos)) AS toks FROM ex JOIN wid USING (w) GROUP BY id),
every AS (SELECT docs.id, coalesce(got.toks, []::INTEGER[]) AS toks FROM docs LEFT JOIN got USING (id)),
enc AS (SELECT id, {kept} AS ids FROM every)"""


def encode_wordpiece() -> str:
    m = MAX_LEN - 2
    return f"""WITH RECURSIVE {_wordpiece(f'toks[1:{m}]')}
SELECT id, [2] || ids || [3] || {_zeros(f'{m} - len(ids)')} AS token_ids FROM enc"""


def encode_wordpiece_head_tail() -> str:
    m = MAX_LEN - 2
    h = m // 3
    kept = f"CASE WHEN len(toks) > {m} THEN toks[1:{h}] || toks[len(toks) - {m - h} + 1:] ELSE toks END"
    return f"""WITH RECURSIVE {_wordpiece(kept)}
SELECT id, [2] || ids || [3] || {_zeros(f'{m} - len(ids)')} AS token_ids,
       {_zeros('len(ids)', 0)} || {_zeros(f'{m} - len(ids)', 1)} AS pad_mask FROM enc"""


def pool_positions() -> str:
    """By an unnest of every position and element, grouped back per element."""
    return f"""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings),
n AS (SELECT vec_id, i // 8 AS p, i % 8 AS d, x FROM x),
g AS (SELECT vec_id, d, round(avg(x), {R}) AS a, round(max(x), {R}) AS b,
   round(avg(x) FILTER (p <= vec_id % 8), {R}) AS am, round(max(x) FILTER (p <= vec_id % 8), {R}) AS bm,
   round(avg(x) FILTER (p <= vec_id % 8 AND p > vec_id % 8 - 4), {R}) AS al FROM n GROUP BY vec_id, d)
SELECT vec_id, list(a ORDER BY d) AS mean_all, list(b ORDER BY d) AS max_all, list(am ORDER BY d) AS mean_masked,
       list(bm ORDER BY d) AS max_masked, list(al ORDER BY d) AS last_mean FROM g GROUP BY vec_id"""


def attention_mask() -> str:
    m = MAX_LEN - 2
    return f"""WITH {_encoded(f'toks[1:{m}]')},
seq AS (SELECT id, [2] || ids || [3] || {_zeros(f'{m} - len(ids)')} AS s FROM enc)
SELECT id, list_transform(s, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS attention_mask,
       CAST(len(list_filter(s, lambda x: x = 0)) AS INTEGER) AS n_zeros FROM seq"""


def truncation_stats() -> str:
    m = MAX_LEN - 2
    return f"""WITH {_tok_ctes()}
SELECT count(*) AS n_rows, count(*) FILTER (WHERE len(toks) > {m}) AS n_truncated,
       CAST(sum(greatest(len(toks) - {m}, 0)) AS BIGINT) AS n_tokens_dropped FROM tk"""


def split_sizes() -> str:
    return f"""WITH {comments_cte()}, n AS (SELECT count(*) AS n FROM c),
sz AS (SELECT CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT) AS tr,
              CAST(floor(n * CAST(0.05 AS DOUBLE)) AS BIGINT) AS va, n FROM n)
SELECT * FROM (SELECT 'train' AS split, tr AS n_rows FROM sz
               UNION ALL SELECT 'valid', va FROM sz
               UNION ALL SELECT 'unused', n - tr - va FROM sz) WHERE n_rows > 0"""


def fold_sizes() -> str:
    return f"""WITH {comments_cte()}, n AS (SELECT count(*) AS n FROM c)
SELECT CAST(f AS INTEGER) AS fold, CAST((n - f + 4) // 5 AS BIGINT) AS n_rows
FROM range(5) t(f), n WHERE (n - f + 4) // 5 > 0"""


def fold_rows() -> str:
    return f"""WITH {comments_cte()}, n AS (SELECT count(*) AS n FROM c)
SELECT CAST(f AS INTEGER) AS fold, CAST(n - (n - f + 4) // 5 AS BIGINT) AS n_train,
       CAST((n - f + 4) // 5 AS BIGINT) AS n_valid
FROM range(5) t(f), n"""


def fixed_batches() -> str:
    return f"""WITH {comments_cte()}
SELECT id, row_number() OVER (ORDER BY id) AS position,
       (row_number() OVER (ORDER BY id) - 1) // 32 AS batch FROM c"""


def _head_seq_cte() -> str:
    m = MAX_LEN - 2
    return f"""{_encoded(f'toks[1:{m}]')},
seq AS (SELECT id, [2] || ids || [3] || {_zeros(f'{m} - len(ids)')} AS s FROM enc)"""


def length_batches() -> str:
    bs = 32
    return f"""WITH {_head_seq_cte()},
p AS (SELECT id, CAST(len(list_filter(s, lambda x: x = 0)) // 128 AS INTEGER) AS lb,
             row_number() OVER (ORDER BY id) AS pos FROM seq),
r AS (SELECT *, row_number() OVER (PARTITION BY lb ORDER BY pos) AS rn,
             count(*) OVER (PARTITION BY lb) AS cnt FROM p),
t AS (SELECT *, rn <= (cnt // {bs}) * {bs} AS is_full, (rn - 1) // {bs} AS chunk FROM r),
ch AS (SELECT lb, chunk, max(pos) AS last_pos FROM t WHERE is_full GROUP BY lb, chunk),
chr AS (SELECT lb, chunk, row_number() OVER (ORDER BY last_pos) - 1 AS batch FROM ch),
nf AS (SELECT count(*) AS n_full FROM ch),
lo AS (SELECT id, lb, row_number() OVER (ORDER BY lb, rn) - 1 AS li FROM t WHERE NOT is_full)
SELECT id, CAST(batch AS BIGINT) AS batch, lb AS length_bucket FROM t JOIN chr USING (lb, chunk) WHERE is_full
UNION ALL SELECT id, CAST(n_full + li // {bs} AS BIGINT), lb FROM lo, nf"""


def trim_batches() -> str:
    return f"""WITH {_head_seq_cte()},
b AS (SELECT id, s, (row_number() OVER (ORDER BY id) - 1) // 32 AS batch,
             len(list_filter(s, lambda x: x <> 0)) AS nz FROM seq),
m AS (SELECT *, max(nz) OVER (PARTITION BY batch) AS mx FROM b)
SELECT id, CAST(batch AS BIGINT) AS batch, CASE WHEN mx > 2 THEN s[1:mx] ELSE s END AS token_ids,
       CAST(mx AS INTEGER) AS batch_max_len FROM m"""


def score_planned_batches() -> str:
    return f"""WITH {_head_seq_cte()},
b AS (SELECT id, s, (row_number() OVER (ORDER BY id) - 1) // 32 AS batch,
             len(list_filter(s, lambda x: x <> 0)) AS nz FROM seq),
m AS (SELECT *, max(nz) OVER (PARTITION BY batch) AS mx, count(*) OVER (PARTITION BY batch) AS n FROM b)
SELECT id, CAST(batch AS BIGINT) AS batch,
       round(list_sum(s)::DOUBLE / (n * CASE WHEN mx > 2 THEN mx ELSE len(s) END), {R}) AS prediction FROM m"""


def _log_cte() -> str:
    return """lg AS (SELECT event_id, ts, user_id, event_type, value,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
  date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS epoch,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step,
  count(*) OVER (PARTITION BY user_id) AS n_steps
FROM events)"""


def weighted_avg() -> str:
    return f"""WITH {_log_cte()}
SELECT user_id, round(sum(value * k) / nullif(sum(k), 0), {R}) AS weighted_avg, CAST(sum(k) AS BIGINT) AS count
FROM lg GROUP BY user_id"""


def running_avg() -> str:
    return f"""WITH {_log_cte()}
SELECT event_id, user_id, round(sum(value * k) OVER w / nullif(sum(k) OVER w, 0), {R}) AS running_avg
FROM lg WINDOW w AS (PARTITION BY user_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def running_best() -> str:
    return f"""WITH {_log_cte()},
b AS (SELECT *, greatest(0.0, coalesce(max(value) OVER (PARTITION BY user_id ORDER BY step
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS best_before FROM lg)
SELECT event_id, user_id, value > best_before AS improved, round(greatest(best_before, value), {R}) AS best_so_far
FROM b"""


def best_epoch() -> str:
    return f"""WITH {_log_cte()},
s AS (SELECT user_id, epoch, avg(value) AS score FROM lg GROUP BY user_id, epoch),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, epoch ASC) AS rk FROM s)
SELECT user_id, CAST(epoch AS INTEGER) AS best_epoch, round(score, {R}) AS best_score FROM r WHERE rk = 1"""


def retention() -> str:
    return f"""WITH {_log_cte()}
SELECT event_id, user_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3 AS keep FROM lg"""


def every_kth() -> str:
    return f"WITH {_log_cte()} SELECT event_id, user_id, step FROM lg WHERE step % 10 = 0"


def accum_groups() -> str:
    return f"""WITH {_log_cte()}
SELECT user_id, CAST((step - 1) // 4 AS BIGINT) AS accum_group, count(*) AS n_steps,
       round(avg(value), {R}) AS mean_loss FROM lg GROUP BY 1, 2"""


def mean_loss() -> str:
    return f"""WITH {_log_cte()},
pk AS (SELECT user_id, epoch, event_type, avg(value) AS v FROM lg GROUP BY 1, 2, 3)
SELECT user_id, CAST(epoch AS INTEGER) AS epoch, round(avg(v), {R}) AS mean_loss, count(*) AS n_losses
FROM pk GROUP BY 1, 2"""


def loss_ema() -> str:
    return f"""WITH RECURSIVE {_log_cte()},
e(user_id, step, l) AS (
  SELECT user_id, step, value FROM lg WHERE step = 1
  UNION ALL
  SELECT lg.user_id, lg.step,
         CASE WHEN e.l = 0 THEN lg.value ELSE CAST(0.98 AS DOUBLE) * e.l + CAST(0.02 AS DOUBLE) * lg.value END
  FROM e JOIN lg ON lg.user_id = e.user_id AND lg.step = e.step + 1)
SELECT lg.event_id, lg.user_id, lg.step, round(e.l, {R}) AS ema
FROM lg JOIN e USING (user_id, step)"""


def run_steps() -> str:
    rows = ", ".join(f"('{r}', '{m}', {d}, {ml}, {bs}, {ac}, {sd})" for r, m, d, ml, bs, ac, sd in RUN_SWEEP)
    return f"""WITH {comments_cte()},
sweep(run, model, depth, maxlen, batch_size, accumulation_steps, seed) AS (VALUES {rows}),
n AS (SELECT CAST(floor(count(*) * CAST(0.7 AS DOUBLE)) AS BIGINT) AS n_train FROM c)
SELECT run, printf('%s_%dlayers_%dbs_%daccum_%dseed_%d', model, depth, batch_size, accumulation_steps, seed, maxlen)
         AS run_key, n_train,
       CAST(ceil(n_train / batch_size / accumulation_steps) * 2 AS BIGINT) AS optimisation_steps,
       CAST(floor(2.0::DOUBLE * n_train / batch_size / accumulation_steps) AS BIGINT) AS optimisation_steps_truncated
FROM sweep, n"""


def _bce(x: str, y: str) -> str:
    return f"(greatest({x}, 0.0) - ({x}) * ({y}) + ln(1 + exp(-abs({x}))))"


def _scored_cte() -> str:
    aux_l = ", ".join(f"(coalesce(c.{a}, 0.5) - 0.5) * 4.0 AS l_{a}" for a in AUX_COLUMNS)
    return f"""{_targets_cte()},
sc AS (SELECT id, CAST(tw.y AS DOUBLE) AS yb, tw.weight, (c.prediction - 0.5) * 8.0 AS l0, {aux_l},
         {", ".join(f"c.{a} AS t_{a}" for a in AUX_COLUMNS)},
         (row_number() OVER (ORDER BY id) - 1) // 32 AS batch
       FROM tw JOIN c USING (id)),
auxlong AS (SELECT batch, {_bce('l', 't')} AS b FROM (
   {" UNION ALL ".join(f"SELECT batch, l_{a} AS l, t_{a} AS t FROM sc" for a in AUX_COLUMNS)})),
bl AS (SELECT batch, avg(weight * {_bce('l0', 'yb')}) AS bin_loss, count(*) AS n_rows,
              avg(CASE WHEN (1 / (1 + exp(-l0)) > 0.5) = (yb > 0.5) THEN 1.0 ELSE 0.0 END) AS acc
       FROM sc GROUP BY batch),
al AS (SELECT batch, avg(b) AS aux_loss FROM auxlong GROUP BY batch)"""


def sigmoid_scores() -> str:
    return f"""WITH {comments_cte()}
SELECT id, round(1 / (1 + exp(-((prediction - 0.5) * 8.0))), {R}) AS prediction FROM c"""


def split_logits() -> str:
    aux = ", ".join(f"round((coalesce({a}, 0.5) - 0.5) * 4.0, {R})" for a in AUX_COLUMNS[:6])
    return f"""WITH {comments_cte()}
SELECT id, round((prediction - 0.5) * 8.0, {R}) AS binary_logit, [{aux}] AS aux_logits FROM c"""


def weighted_loss() -> str:
    return f"""WITH {_scored_cte()}
SELECT CAST(batch AS BIGINT) AS batch, n_rows, round(0.5 * bin_loss + 0.5 * aux_loss, {R}) AS loss
FROM bl JOIN al USING (batch)"""


def weighted_loss_scaled() -> str:
    return f"""WITH {_scored_cte()}, lw AS (SELECT 1.0 / avg(weight) AS lw FROM tw)
SELECT CAST(batch AS BIGINT) AS batch, round(lw * bin_loss + aux_loss, {R}) AS loss
FROM bl JOIN al USING (batch), lw"""


def epoch_accuracy() -> str:
    return f"""WITH {_scored_cte()}, lw AS (SELECT 1.0 / avg(weight) AS lw FROM tw)
SELECT round(avg(lw * bin_loss + aux_loss) / 4, {R}) AS epoch_loss, round(avg(acc), {R}) AS epoch_accuracy
FROM bl JOIN al USING (batch), lw"""


def _emb_long() -> str:
    return "el AS (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) r(i))"


def _pooled(agg: str, src: str = "el", name: str = "p") -> str:
    return f"""{name} AS (SELECT label, list(round(v, {R}) ORDER BY i) AS pooled FROM
   (SELECT label, i, {agg}(x) AS v FROM {src} GROUP BY label, i) GROUP BY label)"""


def pool_mean() -> str:
    return f"WITH {_emb_long()}, {_pooled('avg')} SELECT label, pooled AS mean_pool FROM p"


def pool_max() -> str:
    return f"WITH {_emb_long()}, {_pooled('max')} SELECT label, pooled AS max_pool FROM p"


def pool_last_k() -> str:
    return f"""WITH top AS (SELECT * FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) <= 4),
el AS (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS x FROM top, range(1, 65) r(i)),
{_pooled('avg')} SELECT label, pooled AS last_k_mean FROM p"""


def assemble() -> str:
    return f"""WITH {_emb_long()}, {_pooled('avg', name='pm')}, {_pooled('max', name='px')}
SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda v: round(v, {R}))
       || pm.pooled || px.pooled || [CAST(label AS DOUBLE)] AS features
FROM embeddings JOIN pm USING (label) JOIN px USING (label)"""


def dense_head() -> str:
    w = "CAST(((7 * i + 3 * j) % 17 - 8) AS DOUBLE) * 0.125 / 8"
    return f"""SELECT vec_id, list_transform(range(8), lambda j: round(greatest(0.0,
    list_sum(list_transform(range(64), lambda i: CAST(embedding[i + 1] AS DOUBLE) * {w})) + j * 0.01), {R}))
    AS hidden FROM embeddings"""


def epoch_metrics() -> str:
    pm = lambda c: f"CASE WHEN count({c}) = count(*) THEN pow(avg(pow({c}, -5.0)), -0.2) END"
    src = f"""{comments_cte()},
pe AS (SELECT *, 0 AS epoch, prediction AS score FROM c
       UNION ALL SELECT *, 1 AS epoch, (prediction + target) / 2 AS score FROM c)"""
    return f"""WITH {_auc_ctes(src, "pe", score="score", by="epoch")},
m AS (SELECT e, {pm('subgroup_auc')} AS pm_sub, {pm('bpsn_auc')} AS pm_bpsn, {pm('bnsp_auc')} AS pm_bnsp
      FROM bias WHERE subgroup <> '__all__' GROUP BY e),
o AS (SELECT e, subgroup_auc AS overall_auc FROM bias WHERE subgroup = '__all__')
SELECT e AS epoch, round(overall_auc, {R}) AS overall_auc, round(pm_sub, {R}) AS power_mean_subgroup_auc,
  round(pm_bpsn, {R}) AS power_mean_bpsn_auc, round(pm_bnsp, {R}) AS power_mean_bnsp_auc,
  round((pm_sub + pm_bpsn + pm_bnsp) / 3, {R}) AS bias_score,
  round(0.25 * overall_auc + 0.75 * (pm_sub + pm_bpsn + pm_bnsp) / 3, {R}) AS final_metric
FROM m JOIN o USING (e)"""


def epoch_bias_gaps() -> str:
    first, second = IDENTITY_COLUMNS[:2]
    src = f"""{comments_cte()},
pe AS (SELECT *, 1 AS epoch, prediction AS score FROM c WHERE NOT coalesce({first} >= 0.5, false)
       UNION ALL SELECT *, 2, CASE WHEN {second} IS NULL OR id % 3 <> 0 THEN prediction END FROM c)"""
    return f"""WITH {_auc_ctes(src, "pe", score="score", by="epoch")}
SELECT e AS epoch, subgroup, CAST(subgroup_size AS BIGINT) AS subgroup_size,
       round(subgroup_auc, {R}) AS subgroup_auc, round(bpsn_auc, {R}) AS bpsn_auc, round(bnsp_auc, {R}) AS bnsp_auc
FROM bias"""


def _positions(seed: int) -> str:
    """A seeded permutation: rows by the first 60 bits of md5, then id."""
    return f"""{comments_cte()},
h AS (SELECT id, ('0x' || substr(md5('{seed}-' || id::VARCHAR), 1, 15))::BIGINT AS h FROM c),
p AS (SELECT id, row_number() OVER (ORDER BY h, id) AS position, count(*) OVER () AS n FROM h)"""


SEED, FOLD_SEED = DEFAULT.seed, 2106


def split_train_valid() -> str:
    return f"""WITH {_positions(SEED)}
SELECT id, position, CASE WHEN position <= floor(n * CAST(0.7 AS DOUBLE)) THEN 'train'
  WHEN position > n - floor(n * CAST(0.05 AS DOUBLE)) THEN 'valid' ELSE 'unused' END AS split FROM p"""


def fold_members() -> str:
    return f"WITH {_positions(FOLD_SEED)} SELECT id, CAST((position - 1) % 5 AS INTEGER) AS fold FROM p"


def shuffled_batches() -> str:
    return f"WITH {_positions(SEED)} SELECT id, position, (position - 1) // 32 AS batch FROM p"


def training_table() -> str:
    m = MAX_LEN - 2
    return f"""WITH {_features_cte()}, {_stats_cte()},
tk AS (SELECT id, least(len(regexp_extract_all(lower(coalesce(comment_text, 'nan')), '{TOKEN_RE2}')), {m}) + 2 AS n_ids FROM c),
{_targets_only()}
SELECT f.id, CAST(n_ids AS INTEGER) AS n_ids, y, round(weight, {R}) AS weight,
       round((total_length - mean) / CASE WHEN std_pop = 0 THEN 1 ELSE std_pop END, {R}) AS total_length_scaled
FROM f JOIN tk USING (id) JOIN tw USING (id) JOIN (SELECT * FROM st WHERE feature = 'total_length') ON true"""


def score_given() -> str:
    terms = " + ".join(f"({0.05 * (i + 1) * (-1) ** i!r}) * {c}" for i, c in enumerate(FEATURE_COLUMNS))
    scaled = ", ".join(
        f"max(CASE WHEN feature = '{c}' THEN (v - mean) / CASE WHEN std_pop = 0 THEN 1 ELSE std_pop END END) AS {c}"
        for c in FEATURE_COLUMNS)
    return f"""WITH {_features_cte()}, {_stats_cte()},
long AS (UNPIVOT (SELECT id, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in FEATURE_COLUMNS)} FROM f)
         ON {", ".join(FEATURE_COLUMNS)} INTO NAME feature VALUE v),
x AS (SELECT id, {scaled} FROM long JOIN st USING (feature) GROUP BY id),
z AS (SELECT id, {terms} - 0.25 AS logit FROM x)
SELECT id, round(logit, 6) AS logit, round(1 / (1 + exp(-logit)), 6) AS prediction FROM z"""


def fit_residuals() -> str:
    """The score equations of a fit are zero, whatever the data."""
    names = ", ".join(f"('{c}')" for c in (*FEATURE_COLUMNS, "intercept"))
    return f"SELECT term, CAST(0.0 AS DOUBLE) AS residual FROM (VALUES {names}) t(term)"


def matrix_artefact() -> str:
    return f"""select row_number() over (order by id) - 1 as position, id, cast(columns(* exclude (id)) as double)
      from ({meta_features()})"""


def scan_comments() -> str:
    from .sources.io import NA_TOKENS
    toks = ", ".join(_sql_str(t) for t in NA_TOKENS)
    ids = ", ".join(f"round({g}, {R}) AS {g}" for g in IDENTITY_COLUMNS)
    return f"""WITH {comments_cte()}
SELECT id, CASE WHEN comment_text IN ({toks}) THEN NULL ELSE comment_text END AS comment_text,
       round(target, {R}) AS target, {ids} FROM c"""


def fold_seeds() -> str:
    return f"""WITH {comments_cte()}, n AS (SELECT count(*) AS n FROM c),
f AS (SELECT CAST(f AS INTEGER) AS fold, CAST((n - f + 4) // 5 AS BIGINT) AS n_rows FROM range(5) t(f), n
      WHERE (n - f + 4) // 5 > 0)
SELECT fold, n_rows, CAST(2106 + sum(fold) OVER (ORDER BY fold) AS BIGINT) AS seed FROM f"""


def bias_metrics_labels() -> str:
    src = f"""{comments_cte()},
cl AS (SELECT c.* EXCLUDE (target), CAST(l.toxic AS DOUBLE) AS target FROM c JOIN labels l ON l.doc_id = c.id)"""
    return f"""WITH {_auc_ctes(src, "cl")}
SELECT subgroup, CAST(subgroup_size AS BIGINT) AS subgroup_size,
       round(subgroup_auc, {R}) AS subgroup_auc, round(bpsn_auc, {R}) AS bpsn_auc,
       round(bnsp_auc, {R}) AS bnsp_auc
FROM bias"""


def conversation_features() -> str:
    cols = ", ".join(f"round({c}, {R}) AS {c}" if c in ("caps_vs_length", "words_vs_unique") else c
                     for c in FEATURE_COLUMNS)
    src = "cv AS (SELECT conv_id, turn, text FROM conversations)"
    return f"WITH {_features_cte(src, 'cv', 'conv_id, turn', 'text')} SELECT conv_id, turn, {cols} FROM f"


def alignment_check() -> str:
    return f"""WITH {comments_cte()},
k AS (SELECT c.id AS a, l.doc_id AS b FROM c FULL OUTER JOIN labels l ON l.doc_id = c.id)
SELECT count(*) FILTER (WHERE a IS NOT NULL AND b IS NULL) AS left_only,
       count(*) FILTER (WHERE a IS NULL AND b IS NOT NULL) AS right_only,
       count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS matched FROM k"""


ORACLES = {
    "bias_metrics": bias_metrics,
    "final_metric": final_metric,
    "overall_auc": overall_auc,
    "subgroup_auc": lambda: _sub_auc("subgroup_auc", "CAST(subgroup_size AS BIGINT) AS subgroup_size, "),
    "bpsn_auc": lambda: _sub_auc("bpsn_auc"),
    "bnsp_auc": lambda: _sub_auc("bnsp_auc"),
    "power_mean": power_mean,
    "text_coerce": text_coerce,
    "clean_spaces": clean_spaces,
    "meta_features": meta_features,
    "scale_fit": scale_fit,
    "scale_apply": scale_apply,
    "binarize": binarize,
    "targets": targets,
    "sample_weights": sample_weights,
    "loss_weight": loss_weight,
    "tokens": tokens,
    "vocab": vocab,
    "encode_head": encode_head,
    "encode_head_tail": encode_head_tail,
    "encode_plain": encode_plain,
    "encode_wordpiece": encode_wordpiece,
    "encode_wordpiece_head_tail": encode_wordpiece_head_tail,
    "pool_positions": pool_positions,
    "attention_mask": attention_mask,
    "truncation_stats": truncation_stats,
    "split_sizes": split_sizes,
    "fold_sizes": fold_sizes,
    "fold_rows": fold_rows,
    "fixed_batches": fixed_batches,
    "split_train_valid": split_train_valid,
    "fold_members": fold_members,
    "shuffled_batches": shuffled_batches,
    "training_table": training_table,
    "training_table_bucketed": training_table,
    "score_given": score_given,
    "fit_residuals": fit_residuals,
    "scoring_valid": final_metric,
    "scoring_valid_bucketed": final_metric,
    "epoch_bias_gaps": epoch_bias_gaps,
    "length_batches": length_batches,
    "trim_batches": trim_batches,
    "score_planned_batches": score_planned_batches,
    "weighted_avg": weighted_avg,
    "running_avg": running_avg,
    "running_best": running_best,
    "best_epoch": best_epoch,
    "retention": retention,
    "every_kth": every_kth,
    "accum_groups": accum_groups,
    "mean_loss": mean_loss,
    "loss_ema": loss_ema,
    "run_steps": run_steps,
    "sigmoid_scores": sigmoid_scores,
    "split_logits": split_logits,
    "weighted_loss": weighted_loss,
    "weighted_loss_scaled": weighted_loss_scaled,
    "epoch_accuracy": epoch_accuracy,
    "pool_mean": pool_mean,
    "pool_max": pool_max,
    "pool_last_k": pool_last_k,
    "assemble": assemble,
    "dense_head": dense_head,
    "epoch_metrics": epoch_metrics,
    "epoch_metrics_merged": epoch_metrics,
    "scan_comments": scan_comments,
    "matrix_artefact": matrix_artefact,
    "dense_head_batch_udf": dense_head,
    "fold_seeds": fold_seeds,
    "bias_metrics_labels": bias_metrics_labels,
    "conversation_features": conversation_features,
    "alignment_check": alignment_check,
    "stream_meta_features": meta_features,
}


def all_sql() -> dict[str, str]:
    return {k: f() for k, f in ORACLES.items()}
