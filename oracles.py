"""SQL that gives the same results as the registered queries, for an independent engine."""
from __future__ import annotations

URL = r"'(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:[?]([^#]*))?(?:#(.*))?$'"

URLS = """
urls AS (SELECT url, min(page_id) AS idx FROM pages WHERE url IS NOT NULL GROUP BY url)
"""

PARTS = f"""
{URLS},
raw AS (
  SELECT url, lower(regexp_extract(url, {URL}, 1)) AS scheme, regexp_extract(url, {URL}, 2) AS host,
         regexp_extract(url, {URL}, 3) AS path_params, regexp_extract(url, {URL}, 4) AS query,
         regexp_extract(url, {URL}, 5) AS fragment
  FROM urls),
parts AS (
  SELECT *, regexp_replace(path_params, '^(.*/)?([^/;]*);[^/]*$', '\\1\\2') AS path,
         regexp_extract(path_params, '^(?:.*/)?[^/;]*;([^/]*)$', 1) AS params
  FROM raw)
"""

SEGMENTS = "list_filter(string_split(path, '/'), lambda s: s <> '')"
EXTENSION = r"lower(regexp_extract(string_split(path, '/')[-1], '^\.*[^.].*(\.[^.]*)$', 1))"
NAMES = """list_distinct(list_transform(list_filter(string_split(query, '&'),
  lambda p: regexp_matches(p, '^[^=]*=.')), lambda p: string_split(p, '=')[1]))"""

CHECKS = """
checks AS (
  SELECT p.url, e.event_id AS attempt, e.event_type AS kind,
         CASE e.event_type WHEN 'signup' THEN '404' WHEN 'purchase' THEN '503' WHEN 'click' THEN '301'
                           WHEN 'view' THEN '200' ELSE 'httpx error' END AS status
  FROM pages p JOIN events e ON e.user_id = p.page_id)
"""

SPLIT = f"""
{URLS}, {CHECKS},
st AS (
  SELECT u.url, u.idx, coalesce(s.status, '') IN ('404', 'httpx error') AS failed
  FROM urls u LEFT JOIN (
    SELECT url, CASE WHEN arg_min(status, attempt) IN ('503', 'httpx error') THEN arg_max(status, attempt)
                     ELSE arg_min(status, attempt) END AS status
    FROM checks GROUP BY url) s USING (url)),
broken AS (SELECT url, idx FROM st WHERE failed),
live AS (SELECT url, idx AS live_idx FROM st WHERE NOT failed),
pairs AS (SELECT b.url, b.idx, l.url AS live_url, l.live_idx FROM broken b CROSS JOIN live l)
"""


def _winner(algo: str, scored: str, order: str = "score DESC", score: str = "score") -> str:
    """Vote rows of one algorithm from a scored(url, live_url, live_idx, score) relation."""
    return f"""
{algo}_scored AS ({scored}),
{algo}_best AS (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY {order}, live_idx) AS rn FROM {algo}_scored),
{algo}_votes AS (
  SELECT url AS url_404, '{algo}' AS algo, live_url AS match_url, {score} AS score, live_idx AS match_idx
  FROM {algo}_best WHERE rn = 1)"""


SETS = """
sets AS (
  SELECT *, list_distinct(string_split(url, '')) AS cb, list_distinct(string_split(live_url, '')) AS cl FROM pairs),
counts AS (
  SELECT url, live_url, live_idx, len(list_intersect(cb, cl)) AS c, len(cb) AS a, len(cl) AS b FROM sets)
"""
JACCARD = _winner("jaccard", "SELECT url, live_url, live_idx, c::DOUBLE / (a + b - c) AS score FROM counts")
TVERSKY = _winner("tversky", """SELECT url, live_url, live_idx,
  c::DOUBLE / (c + 0.5::DOUBLE * (a - c) + 0.5::DOUBLE * (b - c)) AS score FROM counts""")
HAMMING = _winner("hamming", """
  SELECT url, live_url, live_idx,
         (1::DOUBLE - wrong::DOUBLE / short) * (1::DOUBLE - 0.5::DOUBLE * ((long - short)::DOUBLE / long)) AS score
  FROM (SELECT *, least(length(url), length(live_url)) AS short, greatest(length(url), length(live_url)) AS long,
               len(list_filter(range(1, least(length(url), length(live_url)) + 1),
                 lambda i: url[i] <> live_url[i])) AS wrong
        FROM pairs)""")
LEVENSHTEIN = _winner(
    "levenshtein", "SELECT url, live_url, live_idx, levenshtein(url, live_url) AS score FROM pairs", "score",
    "1::DOUBLE - score::DOUBLE / greatest(length(url), length(live_url))")
JARO = _winner(
    "jaro_winkler", "SELECT url, live_url, live_idx, round(jaro_winkler_similarity(url, live_url), 9) AS score FROM pairs")

ROUND_VOTES = "SELECT url_404, algo, match_url, round(score, 6) AS score, match_idx FROM "

# Longest common subsequence by one bit row per pair, one character of the live key per step.
FUZZY_STEPS = """
key_words AS (
  SELECT url, list_sort(list_filter(string_split(lower(regexp_replace(
    regexp_replace(url, '[^\\x00-\\x7F]', '', 'g'), '[^A-Za-z0-9_]+', ' ', 'g')), ' '), lambda w: w <> '')) AS words
  FROM urls),
keys AS (SELECT url, array_to_string(words, ' ') AS k FROM key_words),
bk AS (SELECT DISTINCT k FROM keys JOIN broken USING (url)),
lk AS (SELECT k, min(live_idx) AS live_idx FROM keys JOIN live USING (url) GROUP BY k),
masks AS (
  SELECT k, k[i] AS ch, sum(pow(2, i - 1)::HUGEINT)::HUGEINT AS mask
  FROM (SELECT k, unnest(range(1, length(k) + 1)) AS i FROM bk) GROUP BY k, k[i]),
steps AS (
  SELECT b.k AS bk, l.k AS lk, 0 AS i, (pow(2, length(b.k))::HUGEINT - 1) AS v, (pow(2, length(b.k))::HUGEINT - 1) AS full_row
  FROM bk b CROSS JOIN lk l
  UNION ALL
  SELECT s.bk, s.lk, s.i + 1,
         ((s.v + (s.v & coalesce(m.mask, 0::HUGEINT))) | (s.v - (s.v & coalesce(m.mask, 0::HUGEINT)))) & s.full_row, s.full_row
  FROM steps s LEFT JOIN masks m ON m.k = s.bk AND m.ch = s.lk[s.i + 1]
  WHERE s.i < length(s.lk)),
ratio AS (
  SELECT bk, lk, round_even(100 * (2 * (length(bk) - bit_count(v)) / (length(bk) + length(lk))::DOUBLE), 0) AS pct
  FROM steps WHERE i = length(lk)),
fuzzy_best AS (
  SELECT r.bk, r.pct, l.live_idx, row_number() OVER (PARTITION BY r.bk ORDER BY r.pct DESC, l.live_idx) AS rn
  FROM ratio r JOIN lk l ON l.k = r.lk),
fuzzy_votes AS MATERIALIZED (
  SELECT b.url AS url_404, 'fuzzy' AS algo, l.url AS match_url, f.pct / 100 AS score, f.live_idx AS match_idx
  FROM broken b JOIN keys k USING (url) JOIN fuzzy_best f ON f.bk = k.k AND f.rn = 1 JOIN live l ON l.live_idx = f.live_idx)
"""


# Matching blocks of strings of less than 200 characters: the longest common run of a stretch of both, then the stretches on both
# sides of it. Runs are islands on a diagonal. Wants rp(a, b), distinct pairs; gives ratcliff(a, b, ratio).
RATCLIFF_STEPS = """
rchar AS (
  SELECT t, i, t[i] AS ch FROM (
    SELECT t, unnest(range(1, length(t) + 1)) AS i FROM (SELECT a AS t FROM rp UNION SELECT b FROM rp))),
stretch AS (
  SELECT a, b, 1::BIGINT AS la, length(a) AS ha, 1::BIGINT AS lb, length(b) AS hb, 0::BIGINT AS size FROM rp
  UNION ALL
  SELECT a, b, CASE side WHEN 0 THEN la ELSE best.n - best.i END, CASE side WHEN 0 THEN -best.i - 1 ELSE ha END,
    CASE side WHEN 0 THEN lb ELSE best.n - best.j END, CASE side WHEN 0 THEN -best.j - 1 ELSE hb END, side * best.n
  FROM (
    SELECT a, b, la, ha, lb, hb, max({'n': n, 'i': -i, 'j': -j}) AS best FROM (
      SELECT a, b, la, ha, lb, hb, count(*) AS n, min(i) AS i, min(j) AS j FROM (
        SELECT a, b, la, ha, lb, hb, i, j, i - row_number() OVER (PARTITION BY a, b, la, lb, j - i ORDER BY i) AS island FROM (
          SELECT s.a, s.b, s.la, s.ha, s.lb, s.hb, x.i, y.i AS j
          FROM stretch s JOIN rchar x ON x.t = s.a AND x.i BETWEEN s.la AND s.ha
          JOIN rchar y ON y.t = s.b AND y.ch = x.ch AND y.i BETWEEN s.lb AND s.hb))
      GROUP BY a, b, la, ha, lb, hb, j - i, island)
    GROUP BY a, b, la, ha, lb, hb) CROSS JOIN (VALUES (0), (1)) sides(side)),
ratcliff AS (
  SELECT a, b, CASE WHEN length(a) + length(b) = 0 THEN 1 ELSE 2 * sum(size)::DOUBLE / (length(a) + length(b)) END AS ratio
  FROM stretch GROUP BY a, b)
"""


def _grams(source: str, key: str, low: int, high: int) -> str:
    sizes = ", ".join(str(n) for n in range(low, high + 1))
    return f"""SELECT {key}, gram, count(*) AS tf FROM (
      SELECT {key}, substr(lower(url), i, n) AS gram FROM (
        SELECT {key}, url, n, unnest(range(1, length(url) - n + 2)) AS i
        FROM {source} CROSS JOIN (SELECT unnest([{sizes}]) AS n)))
    GROUP BY {key}, gram"""


TFIDF = f"""
lg AS ({_grams("live", "live_idx", 2, 3)}),
vocab AS (
  SELECT gram, ln((1 + (SELECT count(*) FROM live))::DOUBLE / (1 + count(*))) + 1 AS idf
  FROM lg GROUP BY gram HAVING count(*) >= 2),
lw AS (SELECT live_idx, gram, tf * idf AS w FROM lg JOIN vocab USING (gram)),
ln_ AS (SELECT live_idx, sqrt(sum(w * w)) AS norm FROM lw GROUP BY live_idx),
qw AS (SELECT idx, gram, tf * idf AS w FROM ({_grams("broken", "idx", 2, 3)}) JOIN vocab USING (gram)),
qn AS (SELECT idx, sqrt(sum(w * w)) AS norm FROM qw GROUP BY idx),
dots AS (SELECT qw.idx, lw.live_idx, sum(qw.w * lw.w) AS d FROM qw JOIN lw USING (gram) GROUP BY 1, 2),
vector_scored AS (
  SELECT p.url, p.live_url, p.live_idx, round(coalesce(d.d / (qn.norm * ln_.norm), 0), 9) AS score
  FROM pairs p LEFT JOIN dots d USING (idx, live_idx) LEFT JOIN qn USING (idx) LEFT JOIN ln_ USING (live_idx))
"""

TOKEN_VECTORS = """
toks AS (
  SELECT url, unnest(list_filter(string_split(translate(url, '/-_.', '    '), ' '), lambda t: t <> '')) AS token FROM urls),
tv AS (
  SELECT t.token, e.embedding
  FROM (SELECT DISTINCT token, ('0x' || substr(md5(token), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings) AS vec_id
        FROM toks) t JOIN embeddings e USING (vec_id)),
dims AS (
  SELECT url, i, avg(v::DOUBLE) AS x FROM (
    SELECT url, unnest(embedding) AS v, unnest(range(1, len(embedding) + 1)) AS i FROM toks JOIN tv USING (token))
  GROUP BY url, i),
vecs AS (SELECT url, list(x ORDER BY i) AS v, sqrt(sum(x * x)) AS norm FROM dims GROUP BY url),
spacy_scored AS (
  SELECT p.url, p.live_url, p.live_idx, round(list_dot_product(a.v, b.v) / (a.norm * b.norm), 9) AS score
  FROM pairs p JOIN vecs a ON a.url = p.url JOIN vecs b ON b.url = p.live_url)
"""



def _best_vote(algo: str, scored: str, condition: str = "true") -> str:
    """Vote rows from a relation that is already scored."""
    return f"""
{algo}_ranked AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY score DESC, live_idx) AS rn FROM {scored}),
{algo}_votes AS (
  SELECT url AS url_404, '{algo}' AS algo, live_url AS match_url, score, live_idx AS match_idx
  FROM {algo}_ranked WHERE rn = 1 AND {condition})"""


LANGUAGE = "coalesce(nullif(regexp_extract(url, '/([a-z]{2})/', 1), ''), 'unknown')"

TOPICS = f"""
topics AS (
  SELECT url, (ascii({LANGUAGE}) % 4)::INTEGER AS topic,
         length(regexp_extract(url, {URL}, 2))::DOUBLE / length(url) AS prob FROM urls),
bertopic_scored AS (
  SELECT p.url, p.live_url, p.live_idx, CASE WHEN a.topic = b.topic THEN b.prob ELSE 0.3::DOUBLE * b.prob END AS score
  FROM pairs p JOIN topics a ON a.url = p.url JOIN topics b ON b.url = p.live_url)
"""

VECTOR_VOTES = _best_vote("vector", "vector_scored")
SPACY_VOTES = _best_vote("spacy", "spacy_scored", "score >= 0.4")
BERTOPIC_VOTES = _best_vote("bertopic", "bertopic_scored")

# The matchers that SQL can check, in vote order, and the agreement limits that nine votes allow.
ALGORITHMS = ("jaccard", "tversky", "hamming", "levenshtein", "fuzzy", "jaro_winkler", "vector", "bertopic", "spacy")
AGREED, CONFIDENT = 8, 9

VOTES = f"""
{SPLIT}, {SETS}, {JACCARD}, {TVERSKY}, {HAMMING}, {LEVENSHTEIN}, {FUZZY_STEPS}, {JARO}, {TFIDF}, {VECTOR_VOTES},
{TOPICS}, {BERTOPIC_VOTES}, {TOKEN_VECTORS}, {SPACY_VOTES},
votes AS MATERIALIZED ({" UNION ALL ".join(f"SELECT *, {i} AS ord FROM {a}_votes" for i, a in enumerate(ALGORITHMS))}),
cand AS (
  SELECT url_404, match_url, count(*) AS votes, sum(score) AS tot, min(match_idx) AS match_idx, min(ord) AS first_ord,
         arg_min(algo, ord) AS algorithm
  FROM votes WHERE match_url IS NOT NULL GROUP BY url_404, match_url),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY url_404 ORDER BY votes DESC, round(tot, 9) DESC, match_idx) AS rn FROM cand),
consensus AS (
  SELECT r.url_404, t.tot_score, r.votes AS agreement, r.match_url AS best_redirect, round(r.tot, 9) AS best_redirect_tot_score
  FROM ranked r JOIN (SELECT url_404, sum(score) AS tot_score FROM votes GROUP BY url_404) t USING (url_404)
  WHERE rn = 1),
wide AS (
  SELECT url_404, {", ".join(
      f"max(match_url) FILTER (algo = '{a}') AS {a}, coalesce(max(score) FILTER (algo = '{a}'), 0) AS {a}_score"
      for a in ALGORITHMS)}
  FROM votes GROUP BY url_404),
mapping AS (SELECT * FROM wide JOIN consensus USING (url_404))
"""

HISTORY = """
hist AS (
  SELECT e.ts AS timestamp, p.url AS url_404, t.url AS redirect_url, floor(e.value)::BIGINT % 12 AS agreement_score,
         e.value AS total_score, 'levenshtein' AS algorithm, floor(e.value)::BIGINT % 12 >= 8 AS is_best_match,
         CASE WHEN e.event_type = 'signup' THEN 'human' ELSE 'auto' END AS source
  FROM events e JOIN pages t ON t.page_id = e.user_id JOIN pages p ON p.page_id = e.event_id // 40)
"""
NEWEST = "timestamp DESC, url_404, redirect_url, agreement_score, total_score, algorithm, source"
HISTORY_COLUMNS = "timestamp, url_404, redirect_url, agreement_score, total_score, algorithm, is_best_match, source"
RUN_AT = "TIMESTAMP '2024-01-01 00:00:00'"

QUEUE = f"""
sugg AS (
  SELECT url_404, match_url, votes, row_number() OVER (PARTITION BY url_404 ORDER BY votes DESC, first_ord) AS rank FROM cand),
listed AS (SELECT url_404, match_url AS option_url, rank, false AS is_parent FROM sugg WHERE rank <= 5),
cut AS (
  SELECT url AS url_404, regexp_extract(url, {URL}, 1) AS scheme, regexp_extract(url, {URL}, 2) AS host,
         regexp_replace(regexp_extract(url, {URL}, 3), '/+$', '') AS path FROM broken),
parent AS (
  SELECT url_404, scheme || '://' || host || regexp_extract(path, '(?s)^(.+)/[^/]*$', 1) || '/' AS option_url
  FROM cut WHERE path <> ''),
options AS (
  SELECT * FROM listed UNION ALL
  SELECT url_404, option_url, 6, true FROM parent p
  WHERE option_url IN (SELECT url FROM live)
    AND NOT EXISTS (SELECT 1 FROM listed l WHERE l.url_404 = p.url_404 AND l.option_url = p.option_url)),
queue AS (
  SELECT url_404, row_number() OVER (PARTITION BY url_404 ORDER BY rank) AS option_no, option_url, is_parent FROM options)
"""

FEATURE_TABLES = f"""
{PARTS}, {CHECKS}, g AS ({_grams("urls", "url", 2, 4)}),
fp AS (
  SELECT DISTINCT p.url AS url_404, t.url AS live_url
  FROM events e JOIN pages t ON t.page_id = e.user_id JOIN pages p ON p.page_id = e.event_id // 40),
top AS (
  SELECT gram, ln((1 + (SELECT count(*) FROM urls))::DOUBLE / (1 + count(*))) + 1 AS idf
  FROM g GROUP BY gram ORDER BY sum(tf) DESC, gram LIMIT 100),
w AS (SELECT url, gram, tf * idf AS w FROM g JOIN top USING (gram)),
nrm AS (SELECT url, sqrt(sum(w * w)) AS norm FROM w GROUP BY url),
sim AS (
  SELECT url_404, live_url, sum(a.w * b.w / (na.norm * nb.norm)) AS s
  FROM fp JOIN w a ON a.url = fp.url_404 JOIN w b ON b.url = fp.live_url AND b.gram = a.gram
  JOIN nrm na ON na.url = fp.url_404 JOIN nrm nb ON nb.url = fp.live_url GROUP BY 1, 2),
f AS (SELECT url, host, path, {SEGMENTS} AS seg, {EXTENSION} AS ext, {NAMES} AS names FROM parts)
"""
FEATURE_COLUMNS = """fp.url_404, fp.live_url,
  round(CASE WHEN len(a.seg) > 0 AND len(b.seg) > 0
    THEN len(list_filter(a.seg, lambda s: list_contains(b.seg, s)))::DOUBLE / greatest(len(a.seg), len(b.seg)) ELSE 0 END, 6)
    AS segment_match_ratio,
  round(least(length(fp.url_404), length(fp.live_url))::DOUBLE / greatest(length(fp.url_404), length(fp.live_url)), 6) AS len_ratio,
  CASE WHEN a.ext <> '' AND a.ext = b.ext THEN 1::DOUBLE ELSE 0::DOUBLE END AS ext_match,
  round(len(list_intersect(a.names, b.names))::DOUBLE / greatest(len(list_distinct(list_concat(a.names, b.names))), 1), 6) AS param_overlap,
  CASE WHEN a.host = b.host THEN 1::DOUBLE ELSE 0::DOUBLE END AS domain_match,
  round(round(coalesce(s, 0), 9), 6) AS tfidf_similarity"""
FEATURE_JOINS = """fp JOIN f a ON a.url = fp.url_404 JOIN f b ON b.url = fp.live_url LEFT JOIN sim USING (url_404, live_url)"""
FEATURE_PAIRS = f"{FEATURE_TABLES} SELECT {FEATURE_COLUMNS} FROM {FEATURE_JOINS}"
ALL_FEATURE_PAIRS = f"""{FEATURE_TABLES},
rp AS (SELECT DISTINCT a.path AS a, b.path AS b FROM fp JOIN f a ON a.url = fp.url_404 JOIN f b ON b.url = fp.live_url), {RATCLIFF_STEPS}
SELECT {FEATURE_COLUMNS}, round(ratio, 6) AS path_similarity
FROM {FEATURE_JOINS} JOIN ratcliff r ON r.a = a.path AND r.b = b.path"""


RETENTION = f"""
{HISTORY},
lim AS (SELECT count(*) * 6 // 10 AS n FROM hist),
tagged AS (
  SELECT *, source <> 'human' AND agreement_score >= 10 AS high, coalesce(nullif(regexp_extract(url_404, '/([a-z]{{2}})/', 1), ''), 'unknown') AS language
  FROM hist),
room AS (
  SELECT (SELECT n FROM lim) - count(*) FILTER (source = 'human') AS slots, count(*) FILTER (high) AS high_rows,
         count(DISTINCT language) FILTER (source <> 'human' AND NOT high) AS langs FROM tagged),
others AS (
  SELECT *, row_number() OVER (PARTITION BY language ORDER BY {NEWEST}) AS rn FROM tagged WHERE source <> 'human' AND NOT high)
SELECT {HISTORY_COLUMNS} FROM tagged WHERE source = 'human' OR high
UNION ALL
SELECT {HISTORY_COLUMNS} FROM others, room WHERE rn <= greatest(1, (slots - high_rows) // langs)
"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["prepare_urls"] = f"WITH {URLS} SELECT url, idx FROM urls"
    q["clean_url"] = f"""WITH {PARTS}
      SELECT url, lower(trim(regexp_replace(array_to_string({SEGMENTS}, ' '), '[-_#]', ' ', 'g'))) AS cleaned FROM parts"""
    q["strip_invalid"] = "WITH " + URLS + r" SELECT url, regexp_replace(trim(url), '[\x00-\x1f\x7f]', '', 'g') AS stripped FROM urls"
    q["remove_utm"] = f"""WITH {PARTS}
      SELECT url, CASE WHEN contains(query, 'utm') THEN scheme || '://' || host || path ELSE url END AS without_utm FROM parts"""
    q["url_parts"] = f"WITH {PARTS} SELECT url, scheme, host, path, params, query, fragment FROM parts"
    q["path_segments"] = f"""WITH {PARTS}
      SELECT url, len({SEGMENTS}) AS n_segments, array_to_string({SEGMENTS}, ' ') AS segments FROM parts"""
    q["url_extension"] = f"WITH {PARTS} SELECT url, {EXTENSION} AS extension FROM parts"
    q["query_param_names"] = f"""WITH {PARTS}
      SELECT url, array_to_string(list_sort({NAMES}), ',') AS names FROM parts"""
    q["url_language"] = f"WITH {URLS} SELECT url, {LANGUAGE} AS language FROM urls"
    q["parent_url"] = f"""WITH {PARTS}, t AS (SELECT *, regexp_replace(path, '/+$', '') AS up FROM parts)
      SELECT url, CASE WHEN up <> '' THEN scheme || '://' || host || regexp_extract(up, '(?s)^(.+)/[^/]*$', 1) || '/' END AS parent
      FROM t"""
    q["nlp_text"] = f"WITH {URLS} SELECT url, translate(url, '/-_.', '    ') AS text FROM urls"
    q["token_sort_key"] = f"""WITH {URLS}
      SELECT url, array_to_string(list_sort(list_filter(string_split(lower(regexp_replace(
        regexp_replace(url, '[^\\x00-\\x7F]', '', 'g'), '[^A-Za-z0-9_]+', ' ', 'g')), ' '), lambda w: w <> '')), ' ') AS key
      FROM urls"""
    q["char_sets"] = f"""WITH {URLS}
      SELECT url, array_to_string(list_sort(list_distinct(string_split(url, ''))), '') AS chars FROM urls"""
    q["char_ngrams"] = f"""WITH {URLS}, g AS ({_grams("urls", "url", 2, 4)})
      SELECT gram, count(*) AS urls, sum(tf)::BIGINT AS occurrences FROM g GROUP BY gram"""
    q["domain_key"] = f"""WITH {PARTS}
      SELECT url, replace(regexp_replace(host, 'https?://|www\\.', '', 'g'), '.', '_') AS domain FROM parts"""

    q["check_status"] = f"""WITH {CHECKS}
      SELECT url, attempt,
        CASE kind WHEN 'signup' THEN 404 WHEN 'purchase' THEN 503 ELSE 200 END AS status_followed,
        CASE kind WHEN 'signup' THEN 404 WHEN 'purchase' THEN 503 WHEN 'click' THEN 301 ELSE 200 END AS status_own
      FROM checks"""
    q["redirect_hops"] = f"""WITH {CHECKS}
      SELECT url, attempt, CASE WHEN kind = 'click' THEN 1 ELSE 0 END AS n_redirects,
        CASE WHEN kind = 'click' THEN '301 https://' || regexp_replace(url, '^https?://', '') ELSE '' END AS chain
      FROM checks"""
    q["attach_status"] = f"""WITH {URLS}, {CHECKS}
      SELECT u.url, u.idx, s.status, try_cast(s.status AS INTEGER)::VARCHAR AS status_code
      FROM urls u LEFT JOIN (SELECT url, arg_max(status, attempt) AS status FROM checks GROUP BY url) s USING (url)"""
    q["problematic_checks"] = f"""WITH {CHECKS} SELECT url, attempt, status FROM checks WHERE status IN ('503', 'httpx error')"""
    q["retry_overlay"] = f"""WITH {CHECKS}
      SELECT url, arg_min(status, attempt) AS first_status,
        CASE WHEN arg_min(status, attempt) IN ('503', 'httpx error') THEN arg_max(status, attempt)
             ELSE arg_min(status, attempt) END AS status
      FROM checks GROUP BY url"""
    q["broken_only"] = f"WITH {SPLIT} SELECT url, idx FROM broken"

    q["match_jaccard"] = f"WITH {SPLIT}, {SETS}, {JACCARD} {ROUND_VOTES} jaccard_votes"
    q["match_tversky"] = f"WITH {SPLIT}, {SETS}, {TVERSKY} {ROUND_VOTES} tversky_votes"
    q["match_hamming"] = f"WITH {SPLIT}, {HAMMING} {ROUND_VOTES} hamming_votes"
    q["match_levenshtein"] = f"WITH {SPLIT}, {LEVENSHTEIN} {ROUND_VOTES} levenshtein_votes"
    q["match_jaro_winkler"] = f"WITH {SPLIT}, {JARO} {ROUND_VOTES} jaro_winkler_votes"
    q["match_ratcliff"] = f"""WITH RECURSIVE {SPLIT}, rp AS (SELECT DISTINCT url AS a, live_url AS b FROM pairs), {RATCLIFF_STEPS}, {_winner(
        "ratcliff", "SELECT url, live_url, live_idx, ratio AS score FROM pairs JOIN ratcliff ON a = url AND b = live_url")}
      {ROUND_VOTES} ratcliff_votes"""
    q["match_fuzzy"] = f"WITH RECURSIVE {SPLIT}, {FUZZY_STEPS} {ROUND_VOTES} fuzzy_votes"
    q["match_tfidf"] = f"WITH {SPLIT}, {TFIDF}, {VECTOR_VOTES} {ROUND_VOTES} vector_votes"
    q["match_token_vectors"] = f"WITH {SPLIT}, {TOKEN_VECTORS}, {SPACY_VOTES} {ROUND_VOTES} spacy_votes"
    q["match_topic"] = f"WITH {SPLIT}, {TOPICS}, {BERTOPIC_VOTES} {ROUND_VOTES} bertopic_votes"

    q["votes"] = f"WITH RECURSIVE {VOTES} {ROUND_VOTES} votes"
    q["mapping"] = f"""WITH RECURSIVE {VOTES}
      SELECT url_404, {", ".join(f"{a}, round({a}_score, 6) AS {a}_score" for a in ALGORITHMS)},
        round(tot_score, 6) AS tot_score, agreement, best_redirect, round(best_redirect_tot_score, 6) AS best_redirect_tot_score
      FROM mapping"""
    q["consensus"] = f"""WITH RECURSIVE {VOTES}
      SELECT url_404, round(tot_score, 6) AS tot_score, agreement, best_redirect,
        round(best_redirect_tot_score, 6) AS best_redirect_tot_score FROM consensus"""
    q["redirects"] = q["consensus"] + " ORDER BY best_redirect_tot_score DESC, url_404"
    q["agreement_flags"] = f"""WITH RECURSIVE {VOTES}
      SELECT v.url_404, v.algo, v.match_url, round(v.score, 6) AS score,
        coalesce(trim(v.match_url) = trim(c.best_redirect), false) AS is_best
      FROM votes v JOIN consensus c USING (url_404)"""
    q["algorithm_vote_counts"] = f"""WITH RECURSIVE {VOTES}
      SELECT algo, count(*) AS votes, count(match_url) AS nominations FROM votes GROUP BY algo"""
    q["urls_with_votes"] = f"WITH RECURSIVE {VOTES} SELECT count(DISTINCT url_404) AS urls_with_votes FROM votes"
    q["distinct_candidates"] = f"""WITH RECURSIVE {VOTES}
      SELECT url_404, match_url, votes, round(tot, 6) AS tot, algorithm FROM cand"""
    q["quality_metrics"] = f"""WITH RECURSIVE {VOTES}
      SELECT count(*) AS total_urls, count(DISTINCT url_404) AS unique_404s, count(DISTINCT best_redirect) AS unique_redirects,
        round(avg(agreement), 6) AS avg_agreement, round(avg(tot_score), 6) AS avg_score,
        count(*) FILTER (agreement >= 3) AS high_confidence_redirects,
        round(avg(best_redirect_tot_score), 6) AS avg_best_redirect_score,
        count(*) FILTER (best_redirect_tot_score >= 0.8) AS total_high_confidence FROM mapping"""
    q["algorithm_stats"] = f"""WITH RECURSIVE {VOTES},
      hits AS (SELECT v.algo AS algorithm, count(*) FILTER (v.match_url = c.best_redirect) AS best_redirect_matches,
                      count(c.best_redirect) AS n
               FROM votes v JOIN consensus c USING (url_404) GROUP BY v.algo)
      SELECT algorithm, best_redirect_matches,
        round(best_redirect_matches::DOUBLE / n * 100, 2)::VARCHAR || '%' AS percentage FROM hits"""
    q["top_suggestions"] = f"WITH RECURSIVE {VOTES}, {QUEUE} SELECT url_404, match_url, votes, rank FROM sugg WHERE rank <= 5"
    q["review_queue"] = f"WITH RECURSIVE {VOTES}, {QUEUE} SELECT url_404, option_no, option_url, is_parent FROM queue"
    q["verified_pairs"] = f"""WITH RECURSIVE {VOTES}, {QUEUE},
      verdicts AS (
        SELECT b.url AS url_404,
          CASE s.status WHEN '404' THEN '1' WHEN '503' THEN '2' WHEN '301' THEN 'm' WHEN '200' THEN 'skip' ELSE 'M' END AS choice,
          u.url AS manual_url
        FROM broken b
        JOIN (SELECT url, arg_min(status, attempt) AS status FROM checks GROUP BY url) s ON s.url = b.url
        JOIN urls u ON u.idx = b.idx + 1)
      SELECT q.url_404, q.option_url AS live_url FROM verdicts v JOIN queue q ON q.url_404 = v.url_404
        AND q.option_no = try_cast(v.choice AS INTEGER)
      UNION ALL
      SELECT url_404, manual_url FROM verdicts WHERE lower(choice) = 'm' AND manual_url IN (SELECT url FROM live)"""

    q["pair_features"] = f"WITH {FEATURE_PAIRS}"
    q["pair_features_all"] = f"WITH RECURSIVE {ALL_FEATURE_PAIRS}"
    q["training_rows"] = f"""WITH RECURSIVE {VOTES}, {HISTORY}
      SELECT url_404, redirect_url AS live_url, 1 AS label, 10::DOUBLE AS weight, 1 AS copies, 'human' AS source
      FROM hist WHERE source = 'human'
      UNION ALL
      SELECT c.url_404, c.match_url, (c.match_url = s.best_redirect)::INTEGER,
        CASE WHEN s.agreement >= {CONFIDENT} AND c.match_url = s.best_redirect THEN 3::DOUBLE ELSE 1::DOUBLE END,
        CASE WHEN s.agreement >= {CONFIDENT} AND c.match_url = s.best_redirect THEN 3 ELSE 1 END, 'auto'
      FROM cand c JOIN consensus s USING (url_404) WHERE s.agreement >= {AGREED}"""
    q["history_auto_rows"] = f"""WITH RECURSIVE {VOTES}
      SELECT {RUN_AT} AS timestamp, c.url_404, c.match_url AS redirect_url, s.agreement AS agreement_score,
        round(s.tot_score, 6) AS total_score, c.algorithm, c.match_url = s.best_redirect AS is_best_match, 'auto' AS source
      FROM cand c JOIN consensus s USING (url_404) WHERE s.agreement >= {AGREED}"""
    counted = f"""SELECT sum(copies)::BIGINT AS n, coalesce(sum(copies) FILTER (label = 1), 0)::BIGINT AS positive
      FROM ({q["training_rows"]})"""
    q["training_gate"] = f"""SELECT n, positive, n >= 100 AS enough, positive > 0 AND positive < n AS both_labels FROM ({counted})"""
    q["model_stats"] = f"""WITH {HISTORY}, gate AS ({counted})
      SELECT (SELECT n >= 100 FROM gate) AS model_initialized, count(*) AS history_records, 100 AS min_training_samples,
        CASE WHEN (SELECT n >= 100 FROM gate) THEN 7 ELSE 0 END AS model_features FROM hist"""
    q["votes_of_listed"] = f"""WITH RECURSIVE {VOTES} {ROUND_VOTES} votes
      WHERE url_404 IN (SELECT url FROM checks WHERE status = '404')"""
    q["repaired_features"] = f"""WITH {HISTORY}
      SELECT timestamp, url_404, redirect_url, agreement_score,
        round(CASE agreement_score WHEN 0 THEN 0::DOUBLE WHEN 1 THEN 1e9 WHEN 2 THEN -1e9 WHEN 3 THEN 0::DOUBLE ELSE total_score END, 6)
          AS total_score FROM hist"""
    scaled = ("path_similarity", "segment_match_ratio", "len_ratio", "ext_match", "param_overlap", "domain_match", "tfidf_similarity")
    q["scaled_features"] = f"""SELECT url_404, live_url, {", ".join(
        f"round(coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_samp({c}) OVER (), 0), 0), 4) AS {c}" for c in scaled)}
      FROM (WITH RECURSIVE {ALL_FEATURE_PAIRS})"""
    q["history_human_rows"] = f"""WITH {HISTORY}
      SELECT {RUN_AT} AS timestamp, url_404, redirect_url, 999::BIGINT AS agreement_score, 999::DOUBLE AS total_score,
        'human' AS algorithm, true AS is_best_match, 'human' AS source FROM hist WHERE url_404 <> '' AND redirect_url <> ''"""
    q["history_union"] = f"""WITH {HISTORY}
      SELECT source, count(*) AS rows, count(*) FILTER (is_best_match) AS best_rows, sum(agreement_score)::BIGINT AS agreement FROM (
        SELECT agreement_score, is_best_match, source FROM hist
        UNION ALL SELECT agreement_score, false, 'auto' FROM hist) GROUP BY source"""
    q["history_retention"] = f"WITH {RETENTION}"
    q["history_newest"] = f"""WITH {HISTORY}
      SELECT {HISTORY_COLUMNS} FROM hist ORDER BY {NEWEST} LIMIT 1000"""
    q["history_newest_per_language"] = f"""WITH {HISTORY},
      t AS (SELECT *, coalesce(nullif(regexp_extract(url_404, '/([a-z]{{2}})/', 1), ''), 'unknown') AS language FROM hist),
      r AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY {NEWEST}) AS rn FROM t)
      SELECT {HISTORY_COLUMNS}, language FROM r WHERE rn <= 100"""
    return q
