"""DuckDB SQL for the registered queries, written from the rules and not from the Spark code."""

from __future__ import annotations

from spoolglass import samples
from spoolglass.functions.text import GENERIC_EXCLUSION, GENERIC_SUMMARY
from spoolglass.operators.contracts import PIPELINE_VERSION, POLICY_VERSION

SPACE = r"[\s\p{Z}]"
STRIP = rf"^{SPACE}+|{SPACE}+$"
WORDS = r"[\p{L}\p{N}_''-]*[\p{L}\p{N}_][\p{L}\p{N}_''-]*"
EDGE = r"(^|[^\p{L}\p{N}_])"
MARK = "@@D@@"


def stripped(c: str) -> str:
    return f"regexp_replace({c}, '{STRIP}', '', 'g')"


def collapsed(c: str) -> str:
    return f"trim(regexp_replace({c}, '{SPACE}+', ' ', 'g'))"


def n_words(c: str) -> str:
    return f"len(regexp_extract_all({c}, '{WORDS}'))"


def n_tokens(c: str) -> str:
    return rf"len(regexp_extract_all({c}, '[^\s\p{{Z}}]+'))"


def sentence_list(c: str) -> str:
    t = stripped(c)
    t = rf"regexp_replace({t}, '(\d)\.(\d)', '\1{MARK}\2', 'g')"
    t = rf"regexp_replace({t}, '(?i){EDGE}(Mr|Mrs|Ms|Dr|Prof|Sr|Jr|St|Mt|vs|etc)\.', '\1\2{MARK}', 'g')"
    t = rf"regexp_replace({t}, '{EDGE}([A-Z])\.(\s+[A-Z][A-Za-z''-])', '\1\2{MARK}\3', 'g')"
    parts = f"regexp_extract_all({t}, '[^.!?]+[.!?]+|[^.!?]+$')"
    return f"list_filter(list_transform({parts}, lambda s: {stripped(f"replace(s, '{MARK}', '.')")}), lambda s: s <> '')"


def any_of(c: str, patterns: list[str], flags: str = "") -> str:
    return "(" + " OR ".join(f"regexp_matches({c}, '{flags}{p}')" for p in patterns) + ")"


def reasons(c: str, style: str | None = None) -> str:
    t = stripped(c)
    bullet = r"(^|\n)\s*[-*+]\s+"
    rules = [
        (f"{n_words(t)} < 6", "caption is too short"),
        (f"{n_words(t)} > 300", "caption is too long"),
        (f"len({sentence_list(c)}) > 8", "caption has too many sentences"),
        (any_of(t, ["`", r"^\s{0,3}#{1,6}\s+", bullet, r"\*\*[^*]+\*\*", "__[^_]+__", r"\[[^\]]+\]\([^)]+\)"]), "caption must not contain markdown"),
        (any_of(t, [r"^\s*[\{\[]", r"[\}\]]\s*$", r"[\"'']\s*[A-Za-z_][A-Za-z0-9_ -]*\s*[\"'']\s*:"]), "caption must not contain JSON fragments"),
        (any_of(t, [r"\bas an ai\b", r"\bi cannot\b", r"\bi can''t\b", r"\bi (am )?unable to\b", r"\bunable to (comply|provide|complete|help|assist)\b"], "(?i)"), "caption must not contain refusal text"),
        (
            any_of(
                t,
                [
                    r"\b(the user (wants|asked|requests)|let me (analyze|reason|plan|think|draft|write|find|craft|compose)|plan my caption|key facts|hard exclusions|target style|trusted narrative|chronology from|analysis of (the )?evidence|i (should|need to|will) (write|draft|use|frame))\b",
                    r"(^|\n)\s*\d+[.)]\s+",
                    bullet,
                ],
                "(?i)",
            ),
            "caption must not expose reasoning or planning",
        ),
        (
            rf"(NOT regexp_matches({t}, '[.!?][\"'']?$') OR regexp_matches({t}, '(?i){EDGE}(who|which|that|because|although|while|when|until|unless|and|or|but|so|just|as if|as though)\s*[.!?][\"'']?$'))",
            "caption must be a complete sentence",
        ),
    ]
    if style is not None:
        rules.append((prefixed(t, style), "caption must not start with a style label"))
    listed = ", ".join(f"CASE WHEN {rule} THEN '{text}' END" for rule, text in rules)
    return f"CASE WHEN {t} = '' THEN ['caption must be non-empty'] ELSE list_filter([{listed}], lambda x: x IS NOT NULL) END"


def label(c: str) -> str:
    return rf"regexp_replace(lower({stripped(c)}), '[\s\p{{Z}}-]+', '_', 'g')"


def prefixed(c: str, style: str) -> str:
    head = f"split_part({c}, ':', 1)"
    return f"(contains({c}, ':') AND length({head}) <= 32 AND ({label(head)} = {label(style)} OR {label(head)} IN ('formal', 'sarcastic', 'humorous_tech', 'humorous_non_tech')))"


def summaries(rows: str, keys: str) -> str:
    """CTEs ending in ``cleaned`` (keys, summary) of ``rows`` (keys, text, most)."""
    joined = ", ".join(f"{k}" for k in keys.split(", "))
    using = f"USING ({joined})"
    bad = rf"one = '' OR one[1] IN ('{{', '[') OR contains(one, '`') OR regexp_matches(one, '[\"'']?factual_summary[\"'']?\s*:')"
    return f"""
input_rows AS ({rows}),
flat AS (SELECT {joined}, most, CASE WHEN {bad} THEN '{GENERIC_SUMMARY}' ELSE one END AS one
         FROM (SELECT {joined}, most, {collapsed(f"coalesce(nullif(text, ''), '{GENERIC_SUMMARY}')")} AS one FROM input_rows)),
parts AS (SELECT {joined}, most, one, CASE WHEN len(s) = 0 THEN [one] ELSE s[1:8] END AS s FROM (SELECT *, {sentence_list("one")} AS s FROM flat)),
each_part AS (SELECT {joined}, most, i, s[i] AS part, {n_tokens("s[i]")} AS n FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM parts)),
summed AS (SELECT *, sum(n) OVER (PARTITION BY {joined} ORDER BY i) AS total FROM each_part),
taken AS (SELECT {joined}, string_agg(part, ' ' ORDER BY i) AS kept FROM summed WHERE total <= most GROUP BY {joined}),
chosen AS (SELECT {joined}, coalesce(kept, regexp_replace(array_to_string(string_split({collapsed("s[1]")}, ' ')[1:CAST(most AS BIGINT)], ' '), '[ ,;:\\-.!?]+$', '') || '.') AS one
           FROM parts LEFT JOIN taken {using}),
filled AS (SELECT {joined}, CASE WHEN {n_tokens("one")} < 6 THEN
             array_to_string(list_concat(list_filter(string_split({collapsed("one")}, ' '), lambda x: x <> ''), ['in', 'the', 'visible', 'scene', 'shown', 'here.'][1:6 - {n_tokens("one")}]), ' ')
             ELSE {stripped("one")} END AS one FROM chosen),
cleaned AS (SELECT {joined}, CASE WHEN one[-1] IN ('.', '!', '?') THEN one ELSE one || '.' END AS summary FROM filled)
"""


SUFFIX = """CASE style WHEN 'sarcastic' THEN 'with the situation apparently taking itself very seriously'
 WHEN 'humorous_tech' THEN 'while the visible action completes its runtime'
 WHEN 'humorous_non_tech' THEN 'with all the confidence of a carefully planned outing' END"""

FALLBACKS = f"""
WITH {summaries(f"SELECT doc_id, style, text, 300 - coalesce({n_words(SUFFIX)}, 0) AS most FROM documents, (SELECT unnest(['formal', 'sarcastic', 'humorous_tech', 'humorous_non_tech', 'unheard_of']) AS style)", "doc_id, style")}
SELECT doc_id, style, md5(CASE WHEN {SUFFIX} IS NULL THEN summary ELSE rtrim(summary, '.!?') || ', ' || {SUFFIX} || '.' END) AS caption_md5 FROM cleaned
"""

URLS = r"""
urls AS (SELECT page_id, html, CASE page_id % 7
  WHEN 0 THEN 'FTP://' || split_part(url, '://', 2)
  WHEN 1 THEN 'HTTPS://' || split_part(url, '://', 2)
  WHEN 2 THEN regexp_extract(url, '^[^?#]*') || '/a%20b+c.MP4?x=1.mov'
  WHEN 3 THEN regexp_extract(url, '^[^?#]*') || '/'
  WHEN 4 THEN regexp_extract(url, '^[a-z]+://[^/]*')
  WHEN 5 THEN regexp_extract(url, '^[^?#]*') || '/.webm'
  ELSE url END AS url FROM pages),
names AS (SELECT *, string_split(regexp_replace(url_decode(replace(regexp_extract(regexp_replace(url, '^[A-Za-z]+://[^/?#]*', ''), '^[^?#]*'), '+', '%2B')), '/+$', ''), '/')[-1] AS name FROM urls)
"""
EXTENSION = r"""CASE WHEN lower(regexp_extract(name, '[^.](\.[^.]+)$', 1)) IN ('.avi', '.m4v', '.mkv', '.mov', '.mp4', '.mpeg', '.mpg', '.webm')
  THEN lower(regexp_extract(name, '[^.](\.[^.]+)$', 1)) ELSE '.video' END"""


def spread(values: str, limit: str) -> str:
    n = f"len({values})"
    picked = f"list_sort(list_distinct(list_transform(range(0, CAST({limit} AS BIGINT)), lambda i: CAST(round_even(i * ({n} - 1) / greatest({limit} - 1, 1), 0) AS BIGINT))))"
    return f"""CASE WHEN {limit} <= 0 OR {n} = 0 THEN {values}[1:0] WHEN {n} <= {limit} THEN {values}
      WHEN {limit} = 1 THEN [{values}[{n} // 2 + 1]] ELSE list_transform({picked}, lambda k: {values}[k + 1]) END"""


DESIRED = """least(30, greatest(1, CASE
  WHEN n_scenes <= 1 THEN least(base, CASE WHEN duration <= 30 THEN 14 ELSE 18 END)
  WHEN n_scenes <= 3 THEN least(base, CASE WHEN duration <= 30 THEN 18 WHEN duration <= 120 THEN 22 ELSE 24 END)
  WHEN n_scenes >= 12 THEN 30 WHEN n_scenes >= 6 THEN base + 2 ELSE base END))"""
BASE = "CASE WHEN duration <= 10 THEN 14 WHEN duration <= 30 THEN 18 WHEN duration <= 60 THEN 22 WHEN duration <= 120 THEN 26 ELSE 28 END"

CLIPS = f"""
RECURSIVE users AS (SELECT user_id, min(epoch_us(ts)) AS first, max(epoch_us(ts)) AS last FROM events GROUP BY 1),
whole AS (SELECT user_id AS clip_id, first, (user_id % 10 + 1) / 10.0::DOUBLE AS speed, (last - first) / 4.5e9::DOUBLE * ((user_id % 10 + 1) / 10.0::DOUBLE) AS duration FROM users),
valid AS (SELECT * FROM whole WHERE duration BETWEEN 0.1 AND 600),
times AS (SELECT DISTINCT clip_id, round_even(t, 3) AS t FROM (
    SELECT clip_id, duration, (epoch_us(ts) - first) / 4.5e9::DOUBLE * speed AS t
    FROM events JOIN valid ON user_id = clip_id WHERE event_type = 'signup' AND event_id % (user_id % 7 + 2) = 0)
  WHERE t > 0.05 AND t < duration - 0.05),
gaps AS (SELECT clip_id, min(t) AS t FROM times GROUP BY 1
  UNION ALL SELECT g.clip_id, min(s.t) FROM gaps g JOIN times s ON s.clip_id = g.clip_id AND s.t - g.t >= 0.35 GROUP BY g.clip_id),
listed AS (SELECT clip_id, list(t ORDER BY t) AS scenes FROM gaps GROUP BY 1),
clips AS (SELECT clip_id, duration, coalesce(scenes, []::DOUBLE[]) AS scenes, coalesce(len(scenes), 0) AS n_scenes FROM valid LEFT JOIN listed USING (clip_id)),
budgeted AS (SELECT *, {DESIRED} AS desired FROM (SELECT *, {BASE} AS base FROM clips))
"""


def anchors(n: str) -> str:
    return f"CASE WHEN n_scenes > 0 THEN {spread('scenes', n)} ELSE list_transform(range(0, {n}), lambda i: duration * (i + 1) / ({n} + 1)) END"


POOL = f"""
{CLIPS},
counts AS (SELECT *, CASE WHEN desired >= 22 THEN 3 ELSE 2 END AS n_burst, CASE WHEN duration <= 30 THEN 3 WHEN duration <= 60 THEN 4 ELSE 5 END AS n_key,
  least(12, greatest(2, desired // 3)) AS n_scene_pick, least(0.35, greatest(0.12, duration / 240)) AS off FROM budgeted),
made AS (
  SELECT clip_id, duration, desired, unnest(list_transform(range(0, desired + 8), lambda i: duration * (i + 0.5::DOUBLE) / (desired + 8))) AS ts, 'uniform' AS kind, 704 AS width, 0 AS rank FROM counts
  UNION ALL SELECT clip_id, duration, desired, unnest({spread("scenes", "n_scene_pick")}), 'scene', 704, 2 FROM counts
  UNION ALL SELECT clip_id, duration, desired, least(duration - 0.02, greatest(0.02, a + o)), 'burst', 704, 1 FROM (SELECT *, unnest({anchors("n_burst")}) AS a FROM counts), (SELECT unnest([-1, 1]) AS side), LATERAL (SELECT side * off AS o)
  UNION ALL SELECT clip_id, duration, desired, unnest({anchors("n_key")}), 'key', 1024, 3 FROM counts),
by_ms AS (SELECT clip_id, duration, desired, CAST(round_even(ts * 1000, 0) AS BIGINT) AS ms, arg_max(ts, rank) AS ts, arg_max(kind, rank) AS kind, arg_max(width, rank) AS width, max(rank) AS rank FROM made GROUP BY ALL),
by_frame AS (SELECT clip_id, duration, desired, CAST(least(greatest(0, floor(duration * 8) - 1), greatest(0, round_even(ts * 8, 0))) AS BIGINT) AS frame, arg_max(kind, rank) AS kind, arg_max(width, rank) AS width, max(rank) AS rank FROM by_ms GROUP BY ALL)
"""
# Grouping by all of the other columns is by clip and time: duration and desired belong to the clip.
POOL = POOL.replace("max(rank) AS rank FROM made GROUP BY ALL", "max(rank) AS rank FROM made GROUP BY clip_id, duration, desired, round_even(ts * 1000, 0)").replace(
    "max(rank) AS rank FROM by_ms GROUP BY ALL", "max(rank) AS rank FROM by_ms GROUP BY clip_id, duration, desired, least(greatest(0, floor(duration * 8) - 1), greatest(0, round_even(ts * 8, 0)))"
)

FRAMES = """
frames AS (SELECT user_id AS clip_id, event_id, event_type IN ('click', 'view') AS is_speech, value AS rms, event_type = 'error' AS side_is_speech, value * 2 AS mid_rms, CAST(event_id % 50 AS DOUBLE) AS side_rms FROM events),
stats AS (SELECT clip_id, count(*) AS n_frames, sum(is_speech::INT)::BIGINT AS voiced, avg(is_speech::INT) AS mid_ratio, avg(side_is_speech::INT) AS side_ratio,
  CASE WHEN avg(rms) > 0 THEN stddev_pop(rms) / avg(rms) ELSE 0 END AS cv,
  coalesce(sum(mid_rms * mid_rms) FILTER (WHERE is_speech), 0) AS mid, coalesce(sum(side_rms * side_rms) FILTER (WHERE is_speech), 0) AS side,
  count(*) FILTER (WHERE greatest(mid_rms, side_rms) >= 100) AS n_active, count(*) FILTER (WHERE mid_rms >= 100 AND side_rms <= mid_rms * 0.20) AS near FROM frames GROUP BY 1),
dominance AS (SELECT clip_id, cv >= 0.45 AND mid_ratio - side_ratio >= 0.15 AND mid > 0 AND sqrt(mid / greatest(1, side)) >= 1.8 AS dominant FROM stats),
windows AS (SELECT clip_id, is_speech::INT AS flag, count(*) OVER w AS n, avg(is_speech::INT) OVER w AS share FROM frames WINDOW w AS (PARTITION BY clip_id ORDER BY event_id ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)),
slid AS (SELECT clip_id, coalesce(max(share) FILTER (WHERE n = 40), avg(flag)) AS window_ratio FROM windows GROUP BY 1)
"""

DIALOGUE = r"""
said AS (SELECT conv_id AS task_id, turn AS style_pos, CASE WHEN turn = 2 THEN 'formal' ELSE 's' || turn END AS style,
  list_filter(string_split(trim(regexp_replace(lower(CASE WHEN turn % 2 = 0 THEN 'The same five words begin ' || text ELSE text END), '[\s\p{Z}]+', ' ', 'g')), ' '), lambda x: x <> '')[1:8] AS w FROM conversations),
pairs AS (SELECT task_id, a.style_pos AS lp, b.style_pos AS rp, a.style AS ls, b.style AS rs,
  coalesce(list_position(list_transform(range(1, least(len(a.w), len(b.w)) + 1), lambda i: a.w[i] = b.w[i]), false), least(len(a.w), len(b.w)) + 1) - 1 AS shared, least(len(a.w), len(b.w)) AS n
  FROM said a JOIN said b USING (task_id) WHERE a.style_pos <> b.style_pos),
scored AS (SELECT *, CASE WHEN shared < 0 THEN n ELSE shared END / greatest(1, n) AS score FROM pairs)
"""

ATTEMPT_KIND = "CAST(json_extract_string(props, '$.k') AS INT)"
INVALID = "proxy response contains invalid"


def oracle_sql() -> dict[str, str]:
    return {
        "caption_word_counts": f"SELECT doc_id, {n_words('text')} AS n_words, {n_tokens('text')} AS n_tokens FROM documents",
        "caption_lint_reasons": f"SELECT doc_id, array_to_string({reasons('text')}, '; ') AS reasons FROM documents",
        "caption_lint_summary": f"WITH r AS (SELECT lang, {reasons('text')} AS found FROM documents) SELECT lang, reason, count(*) AS n FROM (SELECT lang, unnest(CASE WHEN len(found) = 0 THEN ['ok'] ELSE found END) AS reason FROM r) GROUP BY ALL",
        "caption_lint_dialogue": f"SELECT conv_id, turn, array_to_string({reasons('text', 'role')}, '; ') AS reasons FROM conversations",
        "style_prefix_check": f"""SELECT doc_id, {prefixed("t", "source")} AS prefixed FROM (SELECT doc_id, source, CASE doc_id % 5 WHEN 0 THEN 'Formal: ' WHEN 1 THEN ' humorous-TECH' || chr(9) || ': '
            WHEN 2 THEN upper(source) || ': ' WHEN 3 THEN lpad(source, 33, 'x') || ': ' ELSE '' END || text AS t FROM documents)""",
        "sentence_stats": f"SELECT doc_id, len(s) AS n_sentences, md5(array_to_string(s, '|')) AS sentences_md5 FROM (SELECT doc_id, {sentence_list('text')} AS s FROM documents)",
        "clean_summary_stats": f"WITH {summaries('SELECT doc_id, text, 300 AS most FROM documents', 'doc_id')} SELECT doc_id, md5(summary) AS summary_md5, {n_tokens('summary')} AS n_tokens FROM cleaned",
        "fallback_captions": FALLBACKS,
        "avoid_excerpt": f"""SELECT doc_id, CASE WHEN length(t) <= 600 THEN t WHEN contains(t[1:600], ' ') AND rtrim(regexp_extract(t[1:600], '^(.*) ', 1)) <> '' THEN rtrim(regexp_extract(t[1:600], '^(.*) ', 1)) ELSE t[1:600] END AS excerpt
            FROM (SELECT doc_id, {collapsed("text")} AS t FROM documents)""",
        "initial_results": """WITH w AS (SELECT o_orderkey AS idx, CASE WHEN o_orderkey % 2 = 0 THEN [('formal', 0), ('sarcastic', 1)] ELSE [('humorous_tech', 0)] END AS s FROM orders)
            SELECT idx, x[1] AS style, CAST(x[2] AS BIGINT) AS style_pos, CASE x[1] WHEN 'formal' THEN 'The specific subjects and actions are unclear.'
            WHEN 'sarcastic' THEN 'The specific subjects and actions are unclear, with the situation apparently taking itself very seriously.'
            ELSE 'The specific subjects and actions are unclear, while the visible action completes its runtime.' END AS caption FROM (SELECT idx, unnest(s) AS x FROM w)""",
        "transient_failures": "SELECT o_orderkey, o_orderkey % 6 NOT IN (2, 5) AS transient FROM orders",
        "url_scheme_gate": f"WITH {URLS} SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+):', 1)) IN ('http', 'https') AS admitted FROM names",
        "url_extension": f"WITH {URLS} SELECT page_id, {EXTENSION} AS extension FROM names",
        "clip_label": f"WITH {URLS} SELECT page_id, coalesce(nullif(name[1:96], ''), nullif(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)[1:96], ''), 'video') AS label FROM names",
        "proxy_urls": "SELECT page_id, rtrim(url || '//', '/') || '/perceive' AS joined FROM pages",
        "redacted_excerpt": f"SELECT page_id, coalesce(nullif(replace({stripped('html')}, 'html', '[redacted]')[1:500], ''), 'empty response body') AS excerpt FROM pages",
        "data_urls": f"""WITH {URLS}, e AS (SELECT *, {EXTENSION} AS ext FROM names) SELECT page_id, md5('data:' || CASE ext WHEN '.mp4' THEN 'video/mp4' WHEN '.webm' THEN 'video/webm' ELSE 'video/mp4' END || ';base64,' || base64(encode(html))) AS url_md5 FROM e""",
        "byte_limits": """SELECT page_id, size <= 4000 AND (page_id % 3 = 0 OR size + 100 <= 4000) AS within,
            CASE WHEN size - 1000 <= 0 THEN 'reject' WHEN size - 1000 <= 3000 THEN 'pass_through' ELSE 'transcode' END AS route FROM (SELECT page_id, strlen(html) AS size FROM pages)""",
        "task_errors": """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'task at index ' || o_orderkey || ' must be an object' WHEN 1 THEN 'task at index ' || o_orderkey || ' must include task_id'
            WHEN 2 THEN 'task ' || o_orderkey || ' must include video_url' WHEN 3 THEN 'task ' || o_orderkey || ' must include styles' WHEN 4 THEN 'task ' || o_orderkey || ' styles must be strings'
            WHEN 5 THEN 'task ' || o_orderkey || ' must include styles' END AS error FROM orders""",
        "first_task_errors": """WITH r AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n,
            CASE WHEN o_orderkey % 5 = 0 THEN 'task ' || o_orderkey || ' must include video_url' WHEN o_orderkey % 3 = 0 THEN 'task ' || o_orderkey || ' styles must be strings' END AS e FROM orders)
            SELECT o_custkey, arg_min(e, n) FILTER (WHERE e IS NOT NULL) AS error FROM r GROUP BY 1""",
        "positional_pairing": """SELECT o_orderkey AS idx, CASE WHEN o_orderkey % 11 = 5 THEN 'result count must match task count' WHEN o_orderkey % 6 = 1 THEN 'result at index ' || o_orderkey || ' has unexpected task_id'
            WHEN o_orderkey % 6 IN (2, 4) THEN 'result ' || o_orderkey || ' missing caption for sarcastic' WHEN o_orderkey % 6 = 3 THEN 'result ' || o_orderkey || ' must include captions' END AS error FROM orders""",
        "facts_errors": f"""SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'proxy response contains unknown fact fields'
            WHEN 1 THEN CASE WHEN {ATTEMPT_KIND} * 10 <= 0 OR {ATTEMPT_KIND} * 10 > 600 THEN '{INVALID} duration_seconds' END WHEN 2 THEN '{INVALID} duration_seconds' WHEN 3 THEN '{INVALID} facts'
            WHEN 4 THEN '{INVALID} do_not_claim values' WHEN 5 THEN '{INVALID} scene_complexity' WHEN 6 THEN 'proxy response contains incomplete structured facts'
            WHEN 8 THEN 'proxy response contains unknown fact fields' END AS error FROM events""",
        "attempt_errors": f"""SELECT event_id, CASE event_id % 12 WHEN 2 THEN '{INVALID} token metadata' WHEN 3 THEN '{INVALID} token metadata' WHEN 4 THEN 'proxy response contains inconsistent attempt metadata'
            WHEN 5 THEN 'proxy response contains inconsistent attempt metadata' WHEN 7 THEN '{INVALID} validation metadata' WHEN 9 THEN '{INVALID} attempt stage metadata'
            WHEN 10 THEN CASE WHEN {ATTEMPT_KIND} + 550 > 600 THEN '{INVALID} attempt excerpt metadata' END WHEN 11 THEN '{INVALID} attempt duration metadata' END AS error FROM events""",
        "metadata_errors": f"""SELECT event_id, CASE event_id % 10 WHEN 1 THEN 'proxy policy mismatch: expected {POLICY_VERSION}, received {POLICY_VERSION.replace("style-spec", "other")}'
            WHEN 2 THEN 'proxy response contains inconsistent model metadata' WHEN 3 THEN 'proxy response contains inconsistent source metadata' WHEN 4 THEN 'proxy response missing evidence metadata'
            WHEN 5 THEN 'proxy response contains inconsistent ensemble metadata' WHEN 6 THEN '{INVALID} evidence metadata' WHEN 7 THEN 'proxy response contains too many storyboard passes'
            WHEN 8 THEN 'proxy response contains inconsistent attempt metadata' WHEN 9 THEN '{INVALID} ensemble metadata' END AS error FROM events""",
        "json_props_validate": f"SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'not a count' WHEN 1 THEN 'broken' ELSE CASE WHEN {ATTEMPT_KIND} < 50 THEN 'low' ELSE 'high' END END AS verdict FROM events",
        "complete_results": """WITH w AS (SELECT o_orderkey AS idx, unnest(['formal', 'sarcastic', 'humorous_tech']) AS style, 'An order of status ' || o_orderstatus || ' with priority ' || o_orderpriority || ' is on the desk' AS s FROM orders),
            c AS (SELECT l_orderkey AS idx, CASE l_linenumber WHEN 1 THEN 'formal' WHEN 2 THEN 'sarcastic' ELSE 'humorous_tech' END AS style, min('The line was returned as ' || l_returnflag || ' and shipped' || CASE WHEN l_linestatus = 'O' THEN ' and.' ELSE ' yesterday.' END) AS caption FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL)
            SELECT idx, style, CASE WHEN caption LIKE '%yesterday.' THEN caption WHEN style = 'formal' THEN s || '.' WHEN style = 'sarcastic' THEN s || ', with the situation apparently taking itself very seriously.' ELSE s || ', while the visible action completes its runtime.' END AS caption,
            coalesce(caption NOT LIKE '%yesterday.', true) AS used_fallback FROM w LEFT JOIN c USING (idx, style)""",
        "missing_results": "SELECT o_orderkey AS idx FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 1 AND l_returnflag <> 'A')",
        "diversity_targets_prefix": f"""WITH {DIALOGUE}, t AS (SELECT task_id, CASE WHEN rs = 'formal' THEN ls ELSE rs END AS style, min((lp, rp)) AS seen FROM scored WHERE lp < rp AND score >= 0.5 GROUP BY ALL)
            SELECT task_id, style, row_number() OVER (PARTITION BY task_id ORDER BY seen) AS rank FROM t""",
        "most_similar_prefix": f"WITH {DIALOGUE} SELECT task_id, lp AS style_pos, round(max(score), 9) AS most FROM scored GROUP BY ALL",
        "attempt_consistency": """WITH a AS (SELECT user_id AS response, event_id AS seq, 'm' || (event_id % 3) AS model, CASE WHEN event_type = 'purchase' THEN 'used' ELSE 'failed' END AS outcome FROM events)
            SELECT response, n_attempts, n_used, first_model, last_model, last_outcome, n_used = 1 AND last_outcome = 'used' AS consistent, first_model <> last_model AS fallback_used FROM (
            SELECT response, count(*) AS n_attempts, count(*) FILTER (WHERE outcome = 'used') AS n_used, arg_min(model, seq) AS first_model, arg_max(model, seq) AS last_model, arg_max(outcome, seq) AS last_outcome FROM a GROUP BY 1)""",
        "attempt_costs": """SELECT model, outcome, count(*) AS n, round(sum(value), 6) AS cost FROM (SELECT 'm' || (event_id % 3) AS model, CASE WHEN event_type = 'purchase' THEN 'used' ELSE 'failed' END AS outcome, value FROM events)
            GROUP BY GROUPING SETS ((model, outcome), (model), ())""",
        "progressive_latest": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1",
        "task_timings": """SELECT user_id AS task_id, round(coalesce(sum(value) FILTER (WHERE event_type = 'view'), 0), 6) AS perception_seconds, round(coalesce(sum(value) FILTER (WHERE event_type = 'click'), 0), 6) AS style_seconds,
            round(sum(value), 6) AS total_seconds, string_agg('m' || (event_id % 3), ',' ORDER BY event_id) AS calls, arg_max('m' || (event_id % 3), event_id) AS last_model FROM events GROUP BY 1""",
        "log_lines": """SELECT event_id, 'MEDIA_STAGE clip=' || user_id || ' stage=' || event_type || ' missing=' || CASE WHEN event_id % 2 = 0 THEN event_id::VARCHAR ELSE 'None' END AS line, 'MEDIA_STAGE' AS key, event_type AS stage FROM events""",
        "scene_times": f"WITH {CLIPS} SELECT clip_id, round(duration, 6) AS duration, row_number() OVER (PARTITION BY clip_id ORDER BY t) - 1 AS place, round(t, 6) AS ts FROM gaps JOIN valid USING (clip_id)",
        "scene_log_times": f"WITH {CLIPS} SELECT clip_id, CAST(n_scenes AS BIGINT) AS n, round(coalesce(list_sum(scenes), 0), 3) AS total FROM clips",
        "frame_budget": f"WITH {CLIPS} SELECT clip_id, CAST(n_scenes AS BIGINT) AS n_scenes, CAST(desired AS BIGINT) AS desired FROM budgeted",
        "candidate_pool": f"WITH {POOL} SELECT clip_id, ms, kind, CAST(width AS BIGINT) AS width FROM by_ms",
        "quantized_candidates": f"WITH {POOL} SELECT clip_id, frame, frame / 8.0::DOUBLE AS ts, kind, CAST(width AS BIGINT) AS width FROM by_frame",
        "fallback_plan": f"""WITH {POOL}, numbered AS (SELECT *, count(*) OVER c AS n, count(*) FILTER (WHERE rank > 0) OVER c AS salient, row_number() OVER (PARTITION BY clip_id, rank > 0 ORDER BY -rank, frame) - 1 AS place FROM by_frame WINDOW c AS (PARTITION BY clip_id)),
            spaced AS (SELECT *, greatest(0, desired - salient) AS room, range(0, n - salient) AS places FROM numbered)
            SELECT clip_id, frame, kind FROM spaced WHERE n <= desired OR CASE WHEN rank > 0 THEN place < desired ELSE list_contains({spread("places", "room")}, place) END""",
        "frame_ids": "SELECT event_id, 't' || lpad(CAST(CAST(round_even((value + 0.0005::DOUBLE) * 1000, 0) AS BIGINT) AS VARCHAR), 6, '0') AS frame_id FROM events",
        "spread_sample": f"WITH u AS (SELECT user_id, list(event_id ORDER BY event_id) AS ids, user_id % 12 AS most FROM events GROUP BY 1) SELECT user_id, unnest({spread('ids', 'most')}) AS event_id FROM u",
        "min_gap_events": """WITH RECURSIVE t AS (SELECT DISTINCT user_id, epoch_us(ts) / 1e6::DOUBLE AS second FROM events), g AS (SELECT user_id, min(second) AS second FROM t GROUP BY 1
            UNION ALL SELECT g.user_id, min(t.second) FROM g JOIN t ON t.user_id = g.user_id AND t.second - g.second >= 3600 GROUP BY g.user_id) SELECT user_id, CAST(CAST(second AS DECIMAL(18, 6)) AS DOUBLE) AS second FROM g""",
        "near_duplicate_frames": """WITH RECURSIVE bits AS (SELECT vec_id, vec_id // 100 AS clip, list_transform(embedding, lambda x: (x::DOUBLE >= list_sum(list_transform(embedding, lambda y: y::DOUBLE)) / len(embedding))::INT) AS b FROM embeddings),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY vec_id) AS n FROM bits),
            fold AS (SELECT clip, n, [vec_id] AS ids, [b] AS kept FROM ranked WHERE n = 1
              UNION ALL SELECT f.clip, r.n, CASE WHEN near THEN ids ELSE list_append(ids, r.vec_id) END, CASE WHEN near THEN kept ELSE list_append(kept, r.b) END
              FROM fold f JOIN ranked r ON r.clip = f.clip AND r.n = f.n + 1, LATERAL (SELECT coalesce(list_bool_or(list_transform(kept, lambda k: list_sum(list_transform(range(1, len(k) + 1), lambda i: (k[i] <> r.b[i])::INT)) <= 20)), false) AS near))
            SELECT clip AS clip_id, unnest(ids) AS vec_id FROM fold QUALIFY n = max(n) OVER (PARTITION BY clip)""",
        "speech_stats": f"WITH {FRAMES} SELECT clip_id, n_frames, voiced, round(voiced * 30 / 1000, 9) AS speech_seconds, round(voiced / n_frames, 9) AS speech_ratio, round(cv, 9) AS envelope_cv FROM stats",
        "sliding_speech": f"WITH {FRAMES} SELECT clip_id, round(window_ratio, 9) AS window_ratio, window_ratio >= 0.5 AS sustained FROM slid",
        "speech_gate": f"""WITH {FRAMES}, d AS (SELECT *, CASE WHEN clip_id % 7 = 0 THEN NULL ELSE (clip_id % 40) * 4.0::DOUBLE END AS duration FROM stats JOIN slid USING (clip_id) JOIN dominance USING (clip_id))
            SELECT clip_id, CASE WHEN duration IS NULL THEN 'no_stream' WHEN duration < 1.5 THEN 'too_short' WHEN duration > 130 THEN 'error_too_long'
            WHEN voiced * 30 / 1000 < greatest(0.6, least(1.5, duration * 0.01)) OR voiced / n_frames < 0.005 OR window_ratio < 0.5 THEN 'little_speech' WHEN voiced / n_frames > 0.98 AND cv < 0.45 THEN 'steady_noise'
            WHEN clip_id % 2 = 0 AND coalesce(near / nullif(n_active, 0), 0) < 0.40 AND NOT dominant THEN 'wide_stereo' ELSE 'transcribe' END AS verdict FROM d""",
        "near_mono_ratio": """WITH f AS (SELECT l_orderkey AS clip_id, l_quantity * 100 AS m, round(l_tax * 10000) AS s FROM lineitem) SELECT clip_id, count(*) FILTER (WHERE greatest(m, s) >= 100) AS n_active,
            round(coalesce(count(*) FILTER (WHERE m >= 100 AND s <= m * 0.20) / nullif(count(*) FILTER (WHERE greatest(m, s) >= 100), 0), 0), 9) AS near_mono_ratio FROM f GROUP BY 1""",
        "dominant_speech": f"WITH {FRAMES} SELECT clip_id, dominant FROM dominance",
        "budget_timeouts": """SELECT o_orderkey, CASE WHEN x - 90 >= 1 THEN round(least(135, x - 90), 6) END AS timeout, x <= 1 AS exhausted FROM (SELECT o_orderkey, greatest(0, o_totalprice - 200000) AS x FROM orders)""",
        "perception_ladder": f"""WITH o AS (SELECT o_orderkey, o_orderkey AS k, o_totalprice % 300 AS x, (o_orderkey % 60) * 1048576 AS size FROM orders),
            p AS (SELECT *, CASE WHEN k % 13 = 0 OR k % 11 = 0 THEN 'generic' WHEN k % 5 = 0 THEN 'url' WHEN x < 150 THEN 'deadline_url' WHEN k % 7 = 0 THEN 'download_failed' WHEN x - 20 < 125 THEN 'deadline_url' ELSE 'storyboard' END AS path,
              k % 4 <> 1 AS url_came, k % 4 <> 1 AND NOT (k % 4 = 0 AND k % 8 <> 0) AS url_says, k % 5 > 1 AND size <= 48 * 1048576 AS clip_says FROM o),
            f AS (SELECT *, CASE path WHEN 'generic' THEN 'g' WHEN 'url' THEN CASE WHEN url_says THEN 'u' WHEN clip_says THEN 'b' ELSE 'g' END
              WHEN 'storyboard' THEN CASE WHEN k % 3 <> 1 THEN 's' WHEN url_says THEN 'u' WHEN clip_says THEN 'b' ELSE 'g' END ELSE CASE WHEN url_came THEN 'u' ELSE 'g' END END AS got FROM p),
            a AS (SELECT *, CASE WHEN got = 's' AND k % 3 = 2 THEN 'from storyboard' WHEN got = 'u' AND k % 4 > 1 THEN 'from url' WHEN got = 'b' THEN 'from base64' ELSE '{GENERIC_SUMMARY}' END AS summary FROM f)
            SELECT o_orderkey, path, summary, CASE WHEN got = 'u' AND k % 8 = 0 THEN 'other' WHEN summary = '{GENERIC_SUMMARY}' THEN '{GENERIC_EXCLUSION}' ELSE 'none' END AS exclusions, CASE WHEN got = 's' THEN (k % 100)::DOUBLE END AS duration,
            summary = '{GENERIC_SUMMARY}' AS generic, CASE WHEN x < 90 THEN 'omitted' WHEN size > 0 AND size <= 24 * 1048576 THEN 'original' WHEN size - 20 * 1048576 > 0 AND size - 20 * 1048576 <= 24 * 1048576 THEN 'transcoded' ELSE 'omitted' END AS native_video,
            CASE WHEN x >= 115 AND k % 2 <> 0 THEN 'said' END AS transcript FROM a""",
        "storyboard_requests": """SELECT o_orderkey, (o_orderkey % 100)::DOUBLE AS duration, array_to_string(list_transform(range(0, o_orderkey % 3 + 1), lambda i: 't' || lpad((i * 1500)::VARCHAR, 6, '0') || '=data:' || i), ',') AS frames,
            CASE WHEN o_orderkey % 2 = 0 THEN 'said' END AS transcript, round(least(135, o_totalprice % 200 - 90), 6) AS timeout FROM orders WHERE o_totalprice % 200 - 90 >= 1""",
        "isolated_results": f"""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '{GENERIC_SUMMARY}' ELSE 'Facts of ' || o_orderkey END AS summary, CASE WHEN o_orderkey % 4 = 0 THEN '{GENERIC_EXCLUSION}' ELSE 'nothing' END AS exclusions FROM orders""",
        "caption_lint_values": f"""WITH v AS (SELECT id, style, caption::JSON AS j, caption::JSON ->> '$' AS c FROM {samples.as_values(samples.CAPTIONS)} AS t(id, style, caption))
            SELECT id, CASE WHEN json_type(j) <> 'VARCHAR' THEN 'caption must be a string' ELSE array_to_string({reasons("c", "style")}, '; ') END AS reasons FROM v""",
        "source_checks": f"""WITH v AS (SELECT *, {collapsed("transcript")} AS t FROM {samples.as_values(samples.SOURCES)} AS t(id, video_url, video_data_url, transcript, media))
            SELECT id, CASE WHEN (coalesce(video_url, '') <> '') = (coalesce(video_data_url, '') <> '') THEN 'exactly one video source is required' END AS source,
            CASE WHEN transcript IS NULL THEN 'proxy response missing transcript' WHEN length(t) > 6000 THEN 'proxy response transcript is oversized' END AS received,
            CASE WHEN transcript <> '' AND (t = '' OR length(t) > 6000) THEN 'speech transcript is invalid' END AS sent,
            CASE WHEN media <> '' AND NOT (starts_with(media, 'data:video/') AND contains(media[1:100], ';base64,')) THEN 'native video must be a video data URL' END AS video,
            CASE WHEN NOT starts_with(media, 'data:audio/wav;base64,') THEN 'speech audio must be a WAV data URL' END AS audio, md5(nullif(t, '')) AS kept_md5 FROM v""",
        "frame_checks": f"SELECT id, picture BETWEEN 1 AND 640 * 1024 AND thumbnail = 256 AS admissible FROM {samples.as_values(samples.FRAMES)} AS t(id, picture, thumbnail)",
        "audio_metadata": """SELECT event_id, CASE WHEN event_id % 7 <> 0 AND NOT (event_id % 5 <> 0 AND (event_id % 700) / 1.1::DOUBLE BETWEEN 0.1 AND 600 AND event_id % 40 BETWEEN 1 AND 32) THEN 'invalid audio metadata' END AS error FROM events""",
        "repair_avoid_lists": f"""WITH {DIALOGUE}, t AS (SELECT DISTINCT task_id, CASE WHEN rs = 'formal' THEN ls ELSE rs END AS style FROM scored WHERE lp < rp AND score >= 0.5),
            c AS (SELECT conv_id AS task_id, turn, CASE WHEN turn = 2 THEN 'formal' ELSE 's' || turn END AS style, {collapsed("CASE WHEN turn % 2 = 0 THEN 'The same five words begin ' || text ELSE text END")} AS t FROM conversations),
            e AS (SELECT task_id, turn, style, CASE WHEN length(t) <= 600 THEN t WHEN contains(t[1:600], ' ') THEN rtrim(regexp_extract(t[1:600], '^(.*) ', 1)) ELSE t[1:600] END AS excerpt FROM c),
            r AS (SELECT t.task_id, t.style, excerpt, row_number() OVER (PARTITION BY t.task_id, t.style ORDER BY turn) AS n FROM t JOIN e ON e.task_id = t.task_id AND e.style <> t.style)
            SELECT task_id, style, count(*) AS n, md5(string_agg(excerpt, '|' ORDER BY n)) AS avoid_md5 FROM r WHERE n <= 3 GROUP BY task_id, style""",
        "style_outcomes": """SELECT o_orderkey, CASE WHEN o_orderkey % 4 NOT IN (1, 2) THEN CASE WHEN o_orderkey % 3 = 0 THEN 'used_first' ELSE 'fallback' END
            WHEN o_orderkey % 4 = 1 AND o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 THEN 'used_second' ELSE 'fallback' END AS outcome FROM orders""",
        "exclusion_overlap": f"""WITH i AS (SELECT item_id, string_split(one, ' ') AS w, least(6, len(string_split(one, ' '))) AS n FROM (SELECT item_id, {collapsed("text")} AS one FROM benchmark) WHERE one <> ''),
            p AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM i)), d AS (SELECT doc_id, string_split({collapsed("text")}, ' ') AS w FROM documents),
            q AS (SELECT DISTINCT doc_id, n, array_to_string(w[s:s + n - 1], ' ') AS phrase FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n))
            SELECT item_id, count(DISTINCT doc_id) AS n_documents FROM q JOIN p USING (n, phrase) GROUP BY 1""",
    }
