"""The registered queries once more, as plain SQL over the given tables."""

from __future__ import annotations

from fidelscope.functions import script
from workload.inputs import FIDEL, INTERCEPTS, LATIN, UNKNOWN


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


MAP = script.character_map()
WS = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}"
    r"\x{3000}"
)
WS_CHARS = lit(script.WHITE_SPACE_CHARS)
SYMBOLS = script.SYMBOLS
FOLDED = sorted({w.translate(str.maketrans(MAP)) for w in script.STOPWORDS})


def words(items) -> str:
    return ", ".join(map(lit, items))


# --- scalar fragments --------------------------------------------------------------------


def fidel(x: str) -> str:
    return f"translate(lower({x}), {lit(LATIN)}, {lit(FIDEL)})"


def folded(x: str) -> str:
    return f"translate({x}, {lit(''.join(MAP))}, {lit(''.join(MAP.values()))})"


def no_urls(x: str) -> str:
    return f"regexp_replace({x}, '(http|www)[^{WS}]+', '', 'g')"


def no_mentions(x: str) -> str:
    return rf"regexp_replace({x}, '[@#][\p{{L}}\p{{N}}_]+', '', 'g')"


def tokens(x: str) -> str:
    return (
        f"list_filter(string_split(regexp_replace({x}, '[{WS}]+', ' ', 'g'), ' '),"
        " lambda t: t <> '')"
    )


def clean(x: str) -> str:
    kept = no_mentions(no_urls(folded(f"coalesce({x}, '')")))
    kept = rf"regexp_replace({kept}, '[^\x{{1200}}-\x{{137F}}0-9]+', ' ', 'g')"
    return (
        f"array_to_string(list_filter(string_split({kept}, ' '),"
        f" lambda t: t NOT IN ('', {words(script.STOPWORDS)})), ' ')"
    )


def sentences(x: str) -> str:
    cut = rf"regexp_replace({x}, '([።?!.,;:])([{WS}]|$)', '\1' || chr(1) || '\2', 'g')"
    return (
        f"list_filter(list_transform(string_split({cut}, chr(1)),"
        f" lambda s: trim(s, {WS_CHARS})), lambda s: s <> '')"
    )


def feature_tokens(x: str) -> str:
    return (
        rf"list_filter(string_split(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'),"
        " ' '), lambda t: length(t) >= 2)"
    )


def label_name(x: str) -> str:
    return (
        f"CASE {x} WHEN 0 THEN 'normal' WHEN 1 THEN 'hate' WHEN 2 THEN 'offensive'"
        " ELSE 'unknown' END"
    )


def coefficient(term: str, cls: str) -> str:
    digest = f"substr(md5({term} || ':' || {cls}), 1, 7)"
    return f"(('0x' || {digest})::BIGINT / 134217728.0 - 1)"


# --- input tables ------------------------------------------------------------------------

DOCS = f"""docs AS (
  SELECT doc_id AS id, lang,
    CASE lang WHEN 'fr' THEN 'https://ex.am/' || doc_id || ' @' || source || ' #fr '
              WHEN 'de' THEN '😂 ٣߂༥፣ www.ex.am 10.5% '
              WHEN 'es' THEN 'ሀገር፡ሰው። ' ELSE '' END || {fidel("text")} AS text
  FROM documents)"""
CORPUS = f"""corpus AS (
  SELECT doc_id AS id, {fidel("text")} AS text,
    CASE WHEN toxic = 1 THEN '1' WHEN quality = 0 THEN '2' ELSE '0' END AS label
  FROM documents JOIN labels USING (doc_id))"""
CLEAN_CORPUS = f"""{CORPUS}, clean_corpus AS (
  SELECT * FROM (SELECT id, label, {clean("text")} AS processed FROM corpus)
  WHERE processed <> '')"""
CLEAN_DOCS = f"""clean_docs AS (
  SELECT * FROM (SELECT doc_id AS id, {clean(fidel("text"))} AS processed FROM documents)
  WHERE processed <> '')"""
CHATS = """ids AS (SELECT DISTINCT conv_id % 10 AS chat_id FROM conversations),
chats AS (
  SELECT chat_id, 'chan' || chat_id AS username,
    CASE WHEN chat_id % 5 < 3 THEN 'Channel' WHEN chat_id % 5 = 3 THEN 'Chat' ELSE 'User' END
      AS kind,
    CASE WHEN chat_id % 2 = 0 THEN chat_id + 100 END AS linked
  FROM ids
  UNION ALL
  SELECT chat_id + 100, NULL, 'Chat', NULL FROM ids WHERE chat_id % 2 = 0
  UNION ALL
  SELECT 200, 'quiet', 'Channel', NULL FROM (SELECT 1 FROM ids LIMIT 1))"""
MSGS = f"""msgs AS (
  SELECT CASE WHEN turn > 0 AND role = 'user' AND conv_id % 2 = 0 THEN conv_id % 10 + 100
              ELSE conv_id % 10 END AS chat_id,
    conv_id * 10 + turn AS message_id,
    CASE WHEN turn > 0 THEN conv_id * 10 END AS reply_to,
    {fidel("text")} AS text
  FROM conversations
  UNION ALL
  SELECT conv_id % 10, conv_id * 10 + 9, NULL, '' FROM conversations WHERE turn = 0
  UNION ALL
  SELECT conv_id % 10, conv_id * 10 + 8, NULL, {lit(UNKNOWN)} FROM conversations
  WHERE turn = 0 AND conv_id % 3 = 0
  UNION ALL
  SELECT conv_id % 10, conv_id * 10 + 10000007, conv_id * 10 + 8, {lit(UNKNOWN)} FROM conversations
  WHERE turn = 0 AND conv_id % 3 = 0
  UNION ALL
  SELECT 200, conv_id * 10 + 6, NULL, '' FROM conversations WHERE turn = 0 AND conv_id % 5 = 0)"""
THREADS = f"""{CHATS}, {MSGS}, threads AS (
  SELECT m.chat_id, m.message_id, CASE WHEN c.kind = 'Channel' THEN c.linked END AS linked, m.text
  FROM msgs m JOIN chats c ON m.chat_id = c.chat_id WHERE m.reply_to IS NULL)"""
REQUESTS = """requests AS (
  SELECT page_id AS request_id,
    CASE page_id % 12
      WHEN 0 THEN url
      WHEN 1 THEN 'https://t.me/chan' || (n % 10)
      WHEN 2 THEN 'https://t.me/c/' || (n % 11)
      WHEN 3 THEN 'http://telegram.me/Chan' || (n % 10) || '/?x=1'
      WHEN 4 THEN 'https://t.me/chan' || (n % 10) || '/' || (n * 10)
      WHEN 5 THEN 'https://t.me/s/chan' || (n % 10) || '/' ||
        (n * 10 + CASE WHEN n % 6 = 0 THEN 8 WHEN n % 3 = 1 THEN 9 ELSE 0 END) || '#c'
      WHEN 6 THEN 't.me/chan' || (n % 10)
      WHEN 7 THEN ''
      WHEN 8 THEN 'https://t.me/chan' || (n % 10) || '?u=facebook.com/'
      WHEN 9 THEN 'https://t.me/c/x' || (n % 10)
      WHEN 10 THEN 'https://www.foot.me/chan' || (n % 10) || ';p'
      ELSE CASE WHEN n % 2 = 0 THEN 'https://t.me/quiet' ELSE 'https://t.me/lost' || n END
    END AS url,
    CASE page_id % 7 WHEN 0 THEN 'all' WHEN 1 THEN '5' WHEN 2 THEN 'ALL' WHEN 3 THEN '12'
      WHEN 4 THEN 'abc' WHEN 5 THEN '-5' END AS message_limit
  FROM (SELECT *, page_id // 12 AS n FROM pages))"""
AUTHORITY = r"regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1)"
SEGMENTS = (
    r"list_filter(string_split(regexp_replace(regexp_extract(url,"
    r" '^(?:(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*)?([^?#]*)', 1), ';[^/]*$', ''), '/'),"
    r" lambda s: s <> '')"
)
LIMIT = """CASE WHEN lower(message_limit) = 'all' THEN NULL
  WHEN regexp_matches(message_limit, '^[+-]?[0-9]+$')
    AND try_cast(message_limit AS BIGINT) > 0 THEN try_cast(message_limit AS BIGINT)
  ELSE 1000 END"""


def target_type(host: str) -> str:
    number = "regexp_matches(seg[-1], '^[+-]?[0-9]+$')"
    return f"""CASE WHEN NOT ({host}) OR len(seg) = 0 THEN 'invalid'
      WHEN len(seg) = 1 THEN 'channel_or_group'
      WHEN len(seg) = 2 AND seg[1] = 'c' AND {number} THEN 'channel_or_group'
      WHEN {number} AND seg[-2] <> 'c' THEN 'message' ELSE 'invalid' END"""


ANY_HOST = "contains(authority, 't.me') OR contains(authority, 'telegram.me')"
ROUTED = f"""{REQUESTS}, parts AS (
  SELECT *, {AUTHORITY} AS authority, {SEGMENTS} AS seg FROM requests),
kinds AS (SELECT *, {target_type(ANY_HOST)} AS target_type FROM parts),
routed AS (
  SELECT request_id, url, message_limit, target_type,
    CASE target_type WHEN 'channel_or_group' THEN seg[-1] WHEN 'message' THEN seg[-2] END
      AS identifier,
    target_type = 'channel_or_group' AND len(seg) = 2 AS numeric_id,
    CASE WHEN target_type = 'message' THEN seg[-1]::BIGINT END AS message_id,
    CASE WHEN url IS NULL OR url = '' THEN 'empty_url'
      WHEN NOT regexp_matches(url, '^https?://[^{WS}]') THEN 'bad_url'
      WHEN target_type = 'invalid' THEN 'unroutable'
      WHEN contains(url, 'facebook.com/') THEN 'unsupported_site' END AS error_code
  FROM kinds)"""
RESOLVED = f"""{ROUTED}, {CHATS}, resolved AS (
  SELECT r.*, c.chat_id, c.kind, CASE WHEN c.kind = 'Channel' THEN c.linked END AS linked,
    CASE WHEN r.identifier IS NULL THEN NULL WHEN c.chat_id IS NULL THEN 'chat_not_found'
      WHEN c.kind IN ('Channel', 'Chat') THEN 'ok' ELSE 'not_a_chat' END AS chat_status
  FROM routed r LEFT JOIN chats c
    ON (r.numeric_id AND c.chat_id::VARCHAR = r.identifier)
    OR (NOT r.numeric_id AND c.username = lower(r.identifier)))"""
# Comments of `parents (…, chat_id, message_id, linked)` as `comments`.
COMMENTS = """linked_c AS (
  SELECT p.*, m.chat_id AS source_chat_id, m.message_id AS comment_id, m.text AS comment
  FROM parents p JOIN msgs m ON m.chat_id = p.linked AND m.reply_to = p.message_id
  WHERE m.text <> ''),
own_c AS (
  SELECT p.*, m.chat_id AS source_chat_id, m.message_id AS comment_id, m.text AS comment
  FROM parents p JOIN msgs m ON m.chat_id = p.chat_id AND m.reply_to = p.message_id
  WHERE m.text <> ''),
comments AS (
  SELECT * FROM linked_c
  UNION ALL
  SELECT * FROM own_c o WHERE NOT EXISTS (
    SELECT 1 FROM linked_c l WHERE l.chat_id = o.chat_id AND l.message_id = o.message_id))"""
HEADS = "parents AS (SELECT * FROM threads WHERE text <> '' AND message_id <> 0)"
ALL_HEADS = "parents AS (SELECT * FROM threads)"
FLAT = """flat AS (
  SELECT chat_id, message_id, 0 AS text_idx, text FROM parents
  UNION ALL
  SELECT chat_id, message_id,
    row_number() OVER (PARTITION BY chat_id, message_id ORDER BY comment_id DESC), comment
  FROM comments)"""
VOCAB = f"""{CLEAN_CORPUS},
tf AS (
  SELECT id, term, count(*) AS tf
  FROM (SELECT id, unnest({feature_tokens("processed")}) AS term FROM clean_corpus)
  GROUP BY id, term),
df AS (
  SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY term
  HAVING count(*) >= {script.MIN_DF}
    AND count(*) <= {script.MAX_DF} * (SELECT count(*) FROM clean_corpus)),
vocab AS (
  SELECT *, ln((1 + (SELECT count(*) FROM clean_corpus)) / (1 + df)) + 1 AS idf
  FROM (SELECT * FROM df ORDER BY cf DESC, term LIMIT {script.MAX_FEATURES})),
coefs AS (
  SELECT term, idf, {", ".join(f"{coefficient('term', str(c))} AS w{c}" for c in INTERCEPTS)}
  FROM vocab)"""


def scored(source: str, keys: str, cleaned: bool = False) -> str:
    """CTEs ending in ``scored``: sentences of ``source (keys, text)``, or its cleaned texts."""
    if cleaned:
        rows = f"SELECT {keys}, 0 AS sent_idx, processed AS original, processed FROM {source}"
    else:
        rows = f"""SELECT *, {clean("original")} AS processed FROM (
          SELECT {keys}, unnest(range(len(s))) AS sent_idx, unnest(s) AS original
          FROM (SELECT *, {sentences("text")} AS s FROM {source}))"""
    sums = ", ".join(
        f"coalesce(sum(w * w{c}) / sqrt(sum(w * w)), 0) + {b} AS s{c}"
        for c, b in INTERCEPTS.items()
    )
    return f"""sent AS (
  SELECT row_number() OVER () AS k, * FROM ({rows}) WHERE processed <> ''),
counted AS (
  SELECT k, term, count(*) AS tf
  FROM (SELECT k, unnest({feature_tokens("processed")}) AS term FROM sent) GROUP BY k, term),
raw AS (SELECT k, tf * idf AS w, w0, w1, w2 FROM counted JOIN coefs USING (term)),
sums AS (
  SELECT sent.k, count(w) AS nnz, {sums} FROM sent LEFT JOIN raw ON sent.k = raw.k
  GROUP BY sent.k),
scored AS (
  SELECT sent.*, nnz, s0, s1, s2, prediction, {label_name("prediction")} AS label
  FROM sent JOIN (
    SELECT *, CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS prediction
    FROM sums) USING (k))"""


def summary(source: str, key: str) -> str:
    """Report rows of ``source (key, sentences, hate, offensive, normal)``."""
    rows = " UNION ALL ".join(
        f"SELECT {key}, '{name}' AS label, {name} AS count, sentences FROM {source}"
        for name in script.REPORT_LABELS
    )
    share = "(count / sentences) * 100.0"
    return f"""SELECT {key}, label, count::BIGINT AS count, round({share}, 6) AS percentage,
      printf('%.2f%%', {share}) AS percentage_text FROM ({rows})"""


def label_counts(source: str, key: str) -> str:
    counters = ", ".join(
        f"count(*) FILTER (label = '{name}') AS {name}" for name in script.REPORT_LABELS
    )
    return f"SELECT {key}, count(*) AS sentences, {counters} FROM {source} GROUP BY {key}"


# Every request on its own, as the definition of the report has it.
REPORT = f"""{RESOLVED}, {MSGS}, {VOCAB},
valid AS (
  SELECT *, {LIMIT} AS n_limit FROM resolved WHERE error_code IS NULL AND chat_status = 'ok'),
newest AS (
  SELECT v.request_id, v.n_limit, v.linked, m.chat_id, m.message_id, m.text,
    row_number() OVER (PARTITION BY v.request_id ORDER BY m.message_id DESC) AS rn
  FROM valid v JOIN msgs m ON m.chat_id = v.chat_id WHERE v.target_type = 'channel_or_group'),
heads AS (
  SELECT * FROM newest
  WHERE (n_limit IS NULL OR rn <= n_limit) AND text <> '' AND message_id <> 0),
parents AS (
  SELECT request_id, chat_id, message_id, linked FROM heads
  UNION ALL
  SELECT v.request_id, m.chat_id, m.message_id, v.linked
  FROM valid v JOIN msgs m ON m.chat_id = v.chat_id AND m.message_id = v.message_id
  WHERE v.target_type = 'message'),
{COMMENTS},
texts AS (
  SELECT request_id, message_id, NULL AS comment_id, text FROM heads
  UNION ALL
  SELECT request_id, message_id, comment_id, comment FROM comments),
{scored("texts", "request_id, message_id, comment_id")},
counts AS ({label_counts("scored", "request_id")}
  HAVING max(nnz) > 0),
thread_counts AS (
  SELECT request_id, count(*) FILTER (comment_id IS NULL) AS messages,
    count(DISTINCT message_id) FILTER (comment_id IS NOT NULL) AS messages_with_comments,
    count(*) FILTER (comment_id IS NOT NULL) AS comments
  FROM texts GROUP BY request_id),
overview AS (
  SELECT r.request_id, r.url, r.target_type,
    CASE WHEN error_code IS NOT NULL THEN error_code WHEN chat_status <> 'ok' THEN chat_status
      WHEN target_type = 'channel_or_group' AND coalesce(messages, 0) = 0 THEN 'no_content'
      WHEN target_type = 'message' AND coalesce(t.comments, 0) = 0 THEN 'no_comments'
      WHEN coalesce(sentences, 0) = 0 THEN 'nothing_classified' ELSE 'ok' END AS status,
    CASE WHEN target_type = 'channel_or_group' THEN messages END AS messages,
    CASE WHEN target_type = 'channel_or_group' THEN messages_with_comments END
      AS messages_with_comments,
    t.comments, c.sentences::BIGINT AS sentences
  FROM resolved r LEFT JOIN thread_counts t USING (request_id) LEFT JOIN counts c USING (request_id))"""
SCORED_MSGS = f"{MSGS}, {VOCAB}, {scored('msgs', 'chat_id, message_id')}"
MADE = f"""{CORPUS}, made AS (
  SELECT *, (label + CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END) % 3 AS prediction
  FROM (SELECT id, label::INT AS label FROM corpus))"""


def on_docs(expression: str, name: str = "text") -> str:
    return f"WITH {DOCS} SELECT id, {expression} AS {name} FROM docs"


def samples(source: str, key: str, order: str) -> str:
    return f"""SELECT {key}, label, rank, substr(original, 1, 200) || '...' AS sample FROM (
      SELECT *, row_number() OVER (PARTITION BY {key}, label ORDER BY {order}) AS rank
      FROM {source}) WHERE rank <= 3"""


def attached(part: str) -> str:
    """Messages with their comments, newest first, in parts by rank."""
    return f"""WITH {THREADS}, {HEADS}, {COMMENTS}, ranked AS (
        SELECT *, row_number() OVER (PARTITION BY chat_id, message_id ORDER BY comment_id DESC) AS rank
        FROM comments), parts AS (
        SELECT chat_id, message_id, {part} AS part, min(rank) - 1 AS start,
          string_agg(comment, '␞' ORDER BY comment_id DESC) AS comments
        FROM ranked GROUP BY ALL)
      SELECT chat_id, message_id, text AS message_text, coalesce(comments, '') AS comments,
        coalesce(part, 0)::BIGINT AS part, coalesce(start, 0)::BIGINT AS start
      FROM parents LEFT JOIN parts USING (chat_id, message_id)"""


SUMMARY_SQL = f"WITH {REPORT} {summary('counts', 'request_id')}"
CORPUS_SQL = f"WITH {CORPUS} SELECT id, text, label FROM corpus"
DOC_TF = f"""{CLEAN_DOCS}, doc_tf AS (
  SELECT id, term, count(*) AS tf
  FROM (SELECT id, unnest({feature_tokens("processed")}) AS term FROM clean_docs)
  GROUP BY id, term)"""
TFIDF_SQL = f"""WITH {VOCAB}, {DOC_TF}
  SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight
  FROM (SELECT id, term, doc_tf.tf * idf AS w FROM doc_tf JOIN vocab USING (term))"""
PREDICT_SQL = f"""WITH {VOCAB}, {CLEAN_DOCS}, {scored("clean_docs", "id", cleaned=True)}
  SELECT id, nnz, round(s0, 6) AS score_0, round(s1, 6) AS score_1, round(s2, 6) AS score_2,
    prediction, label FROM scored"""
LABELS_SQL = f"WITH {CLEAN_CORPUS}"

SPLIT = f"""{CLEAN_CORPUS},
sizes AS (
  SELECT label, count(*) AS n, sum(count(*)) OVER () AS total FROM clean_corpus GROUP BY label),
exact AS (SELECT *, total - ceil(total / 5)::BIGINT AS n_train,
  n * (total - ceil(total / 5)::BIGINT) AS product FROM sizes),
quotas AS (
  SELECT label, n - product // total - CASE WHEN
      row_number() OVER (ORDER BY product % total DESC, label)
        <= n_train - sum(product // total) OVER () THEN 1 ELSE 0 END AS n_test
  FROM exact),
split AS (
  SELECT id, label, processed, CASE WHEN row_number() OVER (
      PARTITION BY label ORDER BY md5('{script.SEED}|' || id), id) <= n_test
    THEN 'test' ELSE 'train' END AS part
  FROM clean_corpus JOIN quotas USING (label))"""

ORACLES = {
    "s1_read_corpus": CORPUS_SQL,
    "s1_read_corpus_json": CORPUS_SQL,
    "s1_read_corpus_csv": CORPUS_SQL,
    "s2_read_messages": f"WITH {MSGS} SELECT chat_id, message_id, reply_to, text FROM msgs",
    "s2_message_store": f"WITH {MSGS} SELECT chat_id, message_id, reply_to, text FROM msgs",
    "s2_store_of_chats": f"""WITH {CHATS}, {MSGS} SELECT chat_id, message_id, reply_to, text
      FROM msgs WHERE chat_id IN (SELECT chat_id FROM chats WHERE kind = 'Channel')""",
    "s3_read_chats": f"""WITH {CHATS} SELECT chat_id, username, kind,
      CASE WHEN chat_id = 200 THEN 'Quiet' WHEN chat_id < 100 THEN 'Chat ' || chat_id
        ELSE 'Talk ' || (chat_id - 100) END AS title, linked AS linked_chat_id FROM chats""",
    "r0_read_requests": f"WITH {REQUESTS} SELECT request_id, url, message_limit FROM requests",
    "s3_resolve_chats": f"""WITH {RESOLVED}
      SELECT request_id, identifier, chat_id, kind, linked AS linked_chat_id, chat_status
      FROM resolved""",
    "s4_recent_messages": f"""WITH {MSGS} SELECT chat_id, message_id, reply_to, text FROM msgs
      QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY message_id DESC) <= 20""",
    "s5_with_text": f"""WITH {MSGS} SELECT chat_id, message_id, reply_to, text FROM msgs
      WHERE text <> '' AND message_id <> 0""",
    "s6_save_model": f"""WITH {VOCAB}, numbered AS (
        SELECT *, row_number() OVER (ORDER BY term) - 1 AS idx FROM coefs)
      {" UNION ALL ".join(
          f'SELECT {c} AS class, idx, round(w{c}, 6) AS coef FROM numbered'
          f' UNION ALL SELECT {c}, -1, {b}' for c, b in INTERCEPTS.items())}""",
    "s7_load_model": f"WITH {VOCAB} " + " UNION ALL ".join(
        f"SELECT {c} AS class, term, round(w{c}, 6) AS coef, round(idf, 6) AS idf FROM coefs"
        for c in INTERCEPTS
    ),
    "s8_write_report": SUMMARY_SQL,
    "r1_validate_requests": f"WITH {ROUTED} SELECT request_id, error_code FROM routed",
    "r2_url_parts": f"""SELECT page_id, {AUTHORITY} AS authority,
      array_to_string({SEGMENTS}, '|') AS segments, len({SEGMENTS}) AS n_segments FROM pages""",
    "r3_host_test": f"""WITH {ROUTED} SELECT request_id, target_type AS substring_host,
      {target_type(r"regexp_replace(lower(authority), '^www\.|:\d+$', '', 'g') IN ('t.me', 'telegram.me')")}
        AS exact_host FROM kinds""",
    "r4_route_targets": f"""WITH {ROUTED} SELECT request_id, target_type, identifier,
      numeric_id AS identifier_is_numeric, message_id FROM routed""",
    "r5_coerce_limit": f"WITH {REQUESTS} SELECT request_id, {LIMIT} AS message_limit FROM requests",
    "j1_find_posts": f"""WITH {RESOLVED}, {MSGS} SELECT request_id, chat_id, message_id
      FROM resolved r WHERE EXISTS (SELECT 1 FROM msgs m
        WHERE m.chat_id = r.chat_id AND m.message_id = r.message_id)""",
    **{
        key: f"""WITH {THREADS}, {ALL_HEADS}, {COMMENTS}
          SELECT chat_id, message_id, source_chat_id, comment_id, comment AS text FROM {source}"""
        for key, source in (
            ("j2_linked_comments", "linked_c"),
            ("j3_own_comments", "own_c"),
            ("j4_comments_with_fallback", "comments"),
            ("s2_store_linked_comments", "linked_c"),
            ("s2_store_comments_with_fallback", "comments"),
        )
    },
    "j5_attach_comments": attached("0"),
    "j5_attach_comments_in_parts": attached("(rank - 1) // 2"),
    "j6_thread_stats": f"""WITH {THREADS}, {HEADS}, {COMMENTS}
      SELECT chat_id, count(*) AS messages, count(n) AS messages_with_comments,
        coalesce(sum(n), 0)::BIGINT AS comments
      FROM parents LEFT JOIN (SELECT chat_id, message_id, count(*) AS n FROM comments GROUP BY ALL)
        USING (chat_id, message_id) GROUP BY chat_id""",
    "j7_flatten_texts": f"""WITH {THREADS}, {HEADS}, {COMMENTS}, {FLAT}
      SELECT chat_id, message_id, text_idx::BIGINT AS text_idx, text FROM flat""",
    "j7_flatten_texts_in_parts": f"""WITH {THREADS}, {HEADS}, {COMMENTS}, {FLAT}
      SELECT chat_id, message_id, text_idx::BIGINT AS text_idx, text FROM flat""",
    "j8_post_texts": f"""WITH {THREADS}, {ALL_HEADS}, {COMMENTS}
      SELECT chat_id, message_id, comment_id, comment AS text FROM comments""",
    "t1_null_guard": f"""WITH {DOCS}, given AS (
        SELECT id, CASE WHEN quality IS NOT NULL THEN text END AS text
        FROM docs LEFT JOIN labels ON id = doc_id)
      SELECT id, {clean("text")} AS clean, coalesce(len({sentences("text")}), 0) AS sentences
      FROM given""",
    "t2_nfkc": f"""SELECT doc_id, text FROM documents""",
    "t3_normalize_chars": on_docs(folded("text")),
    "t3a_fold_letters": on_docs(folded(
        "translate(text, 'የደአምይገጣእጀለመናላከበተቸወፈሩዘ', 'ቀቁቂቃቄቅቆኀኁኂኃኄኅኆሰሱሲሳሴስሶ')")),
    "t3b_fold_punctuation": on_docs(folded("translate(text, 'የደዐአምይገጣ', '፡።፣፤፥፦፧፨')")),
    "t3c_fold_digits": on_docs(folded(
        "translate(text, 'የደአምይገጣእጀለመናላከበተቸወፈሩ', '٠١٢٣٤٥٦٧٨٩߀߁߂߃߄༥༦༧༨༩')")),
    "t4_strip_urls": on_docs(no_urls("text")),
    "t5_strip_mentions": on_docs(no_mentions("text")),
    "t6_strip_symbols": on_docs(f"regexp_replace(text, '[{SYMBOLS}]+', ' ', 'g')"),
    "t7_keep_script": on_docs(
        rf"regexp_replace(text, '[^\x{{1200}}-\x{{137F}}0-9{WS}]', ' ', 'g')"),
    "t7_keep_script_latin": (
        rf"SELECT doc_id, regexp_replace(text, '[^\p{{Latin}}0-9{WS}]', ' ', 'g') AS text"
        " FROM documents"),
    "t8_tokens": on_docs(f"array_to_string({tokens('text')}, '␞')", "tokens"),
    "t9_drop_stopwords": f"""WITH {DOCS}, cut AS (SELECT id, {tokens("text")} AS w FROM docs)
      SELECT id,
        array_to_string(list_filter(w, lambda t: t NOT IN ({words(script.STOPWORDS)})), ' ') AS kept,
        array_to_string(list_filter(w, lambda t: t NOT IN ({words(FOLDED)})), ' ') AS kept_folded
      FROM cut""",
    "t9_drop_listed_words": f"""WITH {DOCS}, cut AS (SELECT id, {tokens("text")} AS w FROM docs),
      listed AS (SELECT DISTINCT unnest({tokens(fidel("text"))}) AS word FROM benchmark),
      placed AS (SELECT id, unnest(w) AS token, unnest(range(len(w))) AS place FROM cut),
      kept AS (SELECT id, string_agg(token, ' ' ORDER BY place) AS kept FROM placed
        WHERE token NOT IN (SELECT word FROM listed) GROUP BY id)
      SELECT id, coalesce(kept, '') AS kept FROM docs LEFT JOIN kept USING (id)""",
    "t10_join_tokens": on_docs(
        f"trim(regexp_replace(text, '[{WS}]+', ' ', 'g'))"),
    "t11_clean_text": on_docs(clean("text"), "clean"),
    "t12_non_blank": f"""SELECT * FROM (SELECT doc_id, {clean("text")} AS processed FROM documents)
      WHERE processed <> ''""",
    "t13_split_sentences": f"""WITH {DOCS}, cut AS (SELECT id, {sentences("text")} AS s FROM docs)
      SELECT id, array_to_string(s, '␞') AS sentences, len(s) AS n FROM cut""",
    "t14_explode_sentences": f"""WITH {DOCS}, cut AS (SELECT id, {sentences("text")} AS s FROM docs)
      SELECT id, unnest(range(len(s))) AS sent_idx, unnest(s) AS original FROM cut""",
    "t15_prepare_sentences": f"""WITH {DOCS}, cut AS (SELECT id, {sentences("text")} AS s FROM docs),
      rows AS (SELECT id, unnest(range(len(s))) AS sent_idx, unnest(s) AS original FROM cut)
      SELECT * FROM (SELECT *, {clean("original")} AS processed FROM rows) WHERE processed <> ''""",
    "f1_feature_tokens": f"""WITH {CLEAN_DOCS}
      SELECT id, array_to_string({feature_tokens("processed")}, ' ') AS tokens FROM clean_docs""",
    "f2_term_freq": f"WITH {DOC_TF} SELECT id, term, tf FROM doc_tf",
    "f3_doc_freq": f"WITH {VOCAB} SELECT term, df, cf FROM df",
    "f4_vocabulary": f"""WITH {VOCAB}
      SELECT row_number() OVER (ORDER BY term) - 1 AS idx, term, cf
      FROM (SELECT * FROM df ORDER BY cf DESC, term LIMIT 500)""",
    "f5_idf": f"WITH {VOCAB} SELECT term, df, round(idf, 6) AS idf FROM vocab",
    "f6_tfidf": TFIDF_SQL,
    "f6_tfidf_long": TFIDF_SQL,
    "f7_known_terms": f"WITH {SCORED_MSGS} SELECT chat_id, message_id, sent_idx, nnz FROM scored",
    "m1_label_distribution": f"WITH {CORPUS} SELECT label, count(*) AS count FROM corpus GROUP BY 1",
    "m2_coerce_labels": f"WITH {CORPUS} SELECT id, label::INT AS label FROM corpus",
    "m2_coerce_label_names": f"WITH {CORPUS} SELECT id, label::INT AS label FROM corpus",
    "m3_label_names": f"""SELECT doc_id, {label_name("quality * 2 + toxic")} AS name,
      CASE WHEN quality * 2 + toxic <= 2 THEN quality * 2 + toxic END AS code FROM labels""",
    "m4_corpus_stats": f"""SELECT count(*) AS samples, count(*) FILTER (c <> '') AS usable_samples
      FROM (SELECT {clean("text")} AS c FROM documents)""",
    "m5_distinct_labels": f"WITH {CORPUS} SELECT DISTINCT label FROM corpus",
    "m6_stratified_split": f"WITH {SPLIT} SELECT id, label, part FROM split",
    "m7_class_weights": f"""WITH {CORPUS} SELECT label, count(*) AS rows,
        round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight
      FROM corpus GROUP BY label""",
    "m8_fit_is_minimum": f"""WITH {VOCAB}
      SELECT DISTINCT label::INT AS class, (SELECT count(*) FROM vocab) AS n_terms,
        true AS is_minimum FROM clean_corpus""",
    "m13_train": f"""WITH {SPLIT}, train_tf AS (
        SELECT id, term, count(*) AS tf
        FROM (SELECT id, unnest({feature_tokens("processed")}) AS term FROM split WHERE part = 'train')
        GROUP BY id, term),
      terms AS (
        SELECT least(count(*), {script.MAX_FEATURES}) AS n_terms FROM (
          SELECT term FROM train_tf GROUP BY term HAVING count(*) >= {script.MIN_DF}
            AND count(*) <= {script.MAX_DF} * (SELECT count(*) FROM split WHERE part = 'train')))
      SELECT {label_name("label::INT")} AS name, count(*) FILTER (part = 'test') AS support,
        (SELECT count(*) FROM split WHERE part = 'train') AS train_rows,
        (SELECT count(*) FROM split WHERE part = 'test') AS test_rows,
        (SELECT n_terms FROM terms) AS n_terms, true AS report_holds, true AS is_minimum
      FROM split GROUP BY label""",
    "m9_predict": PREDICT_SQL,
    "m9_predict_long": PREDICT_SQL,
    "m10_accuracy": f"""WITH {MADE}
      SELECT round(avg((label = prediction)::INT), 6) AS accuracy FROM made""",
    "m11_classification_report": f"""WITH {MADE},
      per AS (
        SELECT c, count(*) FILTER (label = c AND prediction = c) AS hit,
          count(*) FILTER (prediction = c) AS said, count(*) FILTER (label = c) AS support
        FROM made, (SELECT unnest([0, 1, 2]) AS c) GROUP BY c),
      rates AS (
        SELECT *, coalesce(hit / nullif(said, 0), 0) AS p, coalesce(hit / nullif(support, 0), 0) AS r
        FROM per),
      full_rates AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM rates),
      whole AS (SELECT avg((label = prediction)::INT) AS a, count(*) AS n FROM made)
      SELECT {label_name("c")} AS name, round(p, 6) AS precision, round(r, 6) AS recall,
        round(f, 6) AS f1, support FROM full_rates
      UNION ALL SELECT 'accuracy', round(a, 6), round(a, 6), round(a, 6), n FROM whole
      UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6),
        sum(support)::BIGINT FROM full_rates
      UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6),
        round(sum(r * support) / sum(support), 6), round(sum(f * support) / sum(support), 6),
        sum(support)::BIGINT FROM full_rates""",
    "m12_confusion_matrix": f"""WITH {MADE} SELECT t AS label,
        {", ".join(f"count(*) FILTER (label = t AND prediction = {p}) AS predicted_{p}" for p in range(3))}
      FROM made, (SELECT unnest([0, 1, 2]) AS t) GROUP BY t""",
    "o1_score_sentences": f"""WITH {SCORED_MSGS} SELECT chat_id, message_id, sent_idx, original,
      processed, nnz, prediction, label FROM scored""",
    "o1_score_documents": f"""WITH {DOCS}, {VOCAB}, {scored("docs", "id")}
      SELECT label, count(*) AS sentences, sum(nnz)::BIGINT AS known_terms FROM scored
      GROUP BY label""",
    "o2_drop_unknown_batches": f"""WITH {SCORED_MSGS}
      SELECT chat_id, message_id, sent_idx, label FROM scored
      QUALIFY max(nnz) OVER (PARTITION BY chat_id, message_id) > 0""",
    "o3_label_summary": f"""WITH {SCORED_MSGS}, counts AS ({label_counts("scored", "chat_id")})
      {summary("counts", "chat_id")}""",
    "o4_label_samples": f"""WITH {SCORED_MSGS}
      {samples("scored", "chat_id", "message_id DESC, sent_idx")}""",
    "o5_channel_summary": f"""WITH {THREADS}, {HEADS}, {COMMENTS}, {FLAT}, {VOCAB},
      {scored("flat", "chat_id")},
      stats AS (
        SELECT chat_id, count(*) AS messages, count(n) AS messages_with_comments,
          coalesce(sum(n), 0)::BIGINT AS comments
        FROM parents LEFT JOIN (
          SELECT chat_id, message_id, count(*) AS n FROM comments GROUP BY ALL)
          USING (chat_id, message_id) GROUP BY chat_id)
      SELECT stats.*, coalesce(s.n, 0) AS sentences FROM stats
      LEFT JOIN (SELECT chat_id, count(*) AS n FROM scored GROUP BY 1) s USING (chat_id)""",
    "o6_post_summary": f"""WITH {THREADS}, {ALL_HEADS}, {COMMENTS}, {VOCAB},
      said AS (SELECT chat_id, message_id, comment AS text FROM comments),
      {scored("said", "chat_id, message_id")}
      SELECT chat_id, message_id, c.n AS comments, coalesce(s.n, 0) AS sentences
      FROM (SELECT chat_id, message_id, count(*) AS n FROM said GROUP BY ALL) c
      LEFT JOIN (SELECT chat_id, message_id, count(*) AS n FROM scored GROUP BY ALL) s
        USING (chat_id, message_id)""",
    "o7_request_status": f"WITH {REPORT} SELECT request_id, status FROM overview",
    "o8_analyze_overview": f"WITH {REPORT} SELECT * FROM overview",
    "o8_analyze_summary": SUMMARY_SQL,
    "o8_analyze_samples": f"""WITH {REPORT}, kept AS (
        SELECT scored.* FROM scored SEMI JOIN counts USING (request_id))
      {samples("kept", "request_id",
               "message_id DESC, comment_id IS NOT NULL, comment_id DESC, sent_idx")}""",
}
