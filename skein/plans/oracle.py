"""SQL counterparts of the registered queries, put together from common table expressions."""

from __future__ import annotations

from ..functions import fixed
from . import seeds


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def ws(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"


def like(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


TURNS = f"turns AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM (VALUES {seeds.values(seeds.TURNS)}) v(conv_id, turn, role, text))"
MESSAGES = f"""{TURNS},
known AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM turns WHERE role IN ('user', 'assistant', 'system', 'tool') AND {ws("text")} <> ''),
prompts AS (SELECT conv_id, {ws("text")} AS system_prompt FROM known WHERE rn = 1 AND role = 'system' AND length({ws("text")}) >= 20),
messages AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS msg_idx, conv_id || '-' || turn AS message_id, role, text FROM known WHERE NOT (rn = 1 AND role = 'system'))"""

_FENCE = "'```([\\w-]*)\\n?((?s:.*?))```'"
BLOCKS = f"""{MESSAGES},
parts AS (SELECT m.* EXCLUDE (text), u.p, u.o FROM (SELECT *, string_split(regexp_replace(text, {_FENCE}, chr(29) || chr(31) || '\\1' || chr(28) || '\\2' || chr(29), 'g'), chr(29)) AS ps FROM messages) m,
  LATERAL (SELECT unnest(m.ps) AS p, unnest(range(len(m.ps))) AS o) u WHERE starts_with(u.p, chr(31)) OR {ws("u.p")} <> ''),
blocks AS (SELECT conv_id, msg_idx, message_id, role, row_number() OVER (PARTITION BY conv_id, msg_idx ORDER BY o) - 1 AS block_idx,
  CASE WHEN starts_with(p, chr(31)) THEN 'code' ELSE 'text' END AS type,
  CASE WHEN starts_with(p, chr(31)) THEN nullif(string_split(p[2:], chr(28))[1], '') END AS language,
  CASE WHEN starts_with(p, chr(31)) THEN regexp_replace(string_split(p, chr(28))[2], '\\n$', '') ELSE {ws("p")} END AS text FROM parts)"""


def sentences(x: str) -> str:
    """List of sentences of a text, as DuckDB writes it."""
    normal = ws(f"regexp_replace(replace({x}, chr(13) || chr(10), chr(10)), '[ \\t]+', ' ', 'g')")
    line = f"CASE WHEN {ws('l')} = '' THEN chr(30) ELSE regexp_replace({ws('l')}, '^(?:[-*•]|\\d+[.)])\\s+(.*)$', chr(30) || '\\1' || chr(30)) END"
    joined = f"array_to_string(list_transform(string_split({normal}, chr(10)), lambda l: {line}), ' ')"
    abbreviations = "|".join(a.replace(".", "\\.") for a in fixed.ABBREVIATIONS)
    safe = f"regexp_replace(b, '(?i)(^|\\s)({abbreviations}) ', '\\1\\2' || chr(28), 'g')"
    cut = f"string_split(regexp_replace({safe}, '([.!?]) ([A-Z\"''(\\[])', '\\1' || chr(29) || '\\2', 'g'), chr(29))"
    flat = f"flatten(list_transform(string_split({joined}, chr(30)), lambda b: {cut}))"
    return f"list_filter(list_transform({flat}, lambda s: {ws('replace(s, chr(28), chr(32))')}), lambda s: s <> '')"


def asciiize(x: str) -> str:
    x = f"translate({x}, '—–―‘’‚‛“”„‟·•', '---''''''''\"\"\"\"|-')"
    for a, b in (("…", "..."), ("→", "->"), ("←", "<-")):
        x = f"replace({x}, '{a}', '{b}')"
    return f"regexp_replace({x}, '[─-╿]', '-', 'g')"


def strip_markdown(x: str) -> str:
    for pattern, by in (
        ("```(?s:.*?)```", " "), ("(?m)^#{1,6}\\s+", ""), ("!\\[([^\\]]*)\\]\\([^)]+\\)", "\\1"), ("\\[([^\\]]+)\\]\\([^)]+\\)", "\\1"), ("`([^`]+)`", "\\1"),
        ("(?m)^>\\s+", ""), ("(?m)^\\s*[-*+]\\s+", ""), ("(?m)^\\s*\\d+[.)]\\s+", ""), ("\\*\\*([^*]+)\\*\\*", "\\1"), ("__([^_]+)__", "\\1"),
        ("(\\s|^)\\*+", "\\1"), ("\\*+(\\s|$)", "\\1"), ("(\\s|^)_+", "\\1"), ("_+(\\s|$)", "\\1"),
    ):
        x = f"regexp_replace({x}, {q(pattern)}, {q(by)}, 'g')"
    return ws(f"regexp_replace({asciiize(x)}, '[ \\t]+', ' ', 'g')")


def strip_urls(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, 'https?://\\S+', ' ', 'g'), '[ \\t]+', ' ', 'g')"


def header(x: str) -> str:
    t = ws(x)
    return f"({t} <> '' AND length({t}) <= 80 AND NOT regexp_matches({t}, '[.!?]$') AND substr({t}, 1, 1) = upper(substr({t}, 1, 1)))"


def key(x: str) -> str:
    return f"substr(trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')), 1, 60)"


SAID = f"""{BLOCKS},
context AS (SELECT conv_id, msg_idx, count(*) OVER (PARTITION BY conv_id) AS n_messages,
  role = 'user' AND coalesce(lead(role) OVER (PARTITION BY conv_id ORDER BY msg_idx) <> 'assistant', true) AS unanswered,
  coalesce(msg_idx = max(CASE WHEN role = 'user' THEN msg_idx END) OVER (PARTITION BY conv_id), false) AS last_user,
  coalesce(msg_idx = max(CASE WHEN role = 'assistant' THEN msg_idx END) OVER (PARTITION BY conv_id), false) AS last_assistant FROM messages),
bodies AS (SELECT b.*, u.body, u.i FROM (SELECT *, CASE WHEN type = 'text' THEN list_filter(list_transform({sentences("text")}, lambda s: {strip_markdown("s")}), lambda s: s <> '') ELSE [text] END AS ss FROM blocks) b,
  LATERAL (SELECT unnest(b.ss) AS body, unnest(range(len(b.ss))) AS i) u),
candidates AS (SELECT conv_id, msg_idx, block_idx, CASE WHEN type = 'text' THEN i END AS sent_idx, message_id, role,
  CASE WHEN type = 'code' THEN 'code' WHEN {like("body", fixed.QUESTION_END)} THEN 'question' WHEN {like("body", fixed.CANDIDATE_DECISION)} THEN 'decision' ELSE 'sentence' END AS kind,
  body AS text, length(body) AS char_len, CASE WHEN n_messages = 1 THEN 1.0 ELSE msg_idx / (n_messages - 1) END AS position, n_messages, unanswered, last_user, last_assistant,
  row_number() OVER (PARTITION BY conv_id ORDER BY msg_idx, block_idx, i) - 1 AS ord FROM bodies JOIN context USING (conv_id, msg_idx))"""

_STOP = ", ".join(q(w) for w in fixed.STOPWORDS)
TERMS = f"""{SAID},
words AS (SELECT conv_id, ord, count(*) OVER (PARTITION BY conv_id) AS n, list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP})) AS ws FROM candidates),
tf AS (SELECT conv_id, ord, term, count(*) AS tf, any_value(n) AS n FROM (SELECT conv_id, ord, n, unnest(ws) AS term FROM words) GROUP BY ALL),
stats AS (SELECT conv_id, ord, term, tf, ln(n / (1 + count(*) OVER (PARTITION BY conv_id, term))) + 1 AS idf FROM tf),
tops AS (SELECT conv_id, ord, list_sum(list_reverse_sort(list(tf * idf))[1:5]) AS s FROM stats GROUP BY ALL),
tfidf AS (SELECT c.conv_id, c.ord, CASE WHEN count(*) OVER w < 2 OR coalesce(max(coalesce(s, 0)) OVER w, 0) <= 0 THEN 0 ELSE coalesce(s, 0) / max(coalesce(s, 0)) OVER w END AS tfidf_score
  FROM candidates c LEFT JOIN tops USING (conv_id, ord) WINDOW w AS (PARTITION BY c.conv_id))"""


def signals_sql() -> str:
    def over(name: str, pattern: str) -> str:
        hits = count("text", pattern)
        return f"sum(CASE WHEN role = 'user' THEN {hits} ELSE 0 END)" if name == "imperative" else f"sum({hits})"

    rates = ", ".join(f"{over(n, p)} AS n_{n}" for n, p in fixed.SIGNALS.items())
    return f"""per AS (SELECT conv_id, count(*) AS n_blocks, sum(length(text)) AS chars, sum(CASE WHEN type = 'code' THEN length(text) ELSE 0 END) AS code_chars,
  sum(CASE WHEN role = 'user' THEN {count("text", "\\?")} ELSE 0 END) AS questions, sum(CASE WHEN role = 'user' AND type = 'text' THEN length(text) ELSE 0 END) AS user_chars, count(DISTINCT CASE WHEN role = 'user' THEN msg_idx END) AS users, {rates} FROM blocks GROUP BY conv_id),
signals AS (SELECT conv_id, code_chars / (chars + n_blocks - 1) AS code_ratio, coalesce(user_chars / nullif(users, 0), 0) AS avg_user_len, coalesce(questions / nullif(users, 0), 0) AS question_density,
  {", ".join(f"n_{n} * 1000 / (chars + n_blocks - 1) AS {n}" for n in fixed.SIGNALS)} FROM per)"""


SIGNALS = f"{BLOCKS}, {signals_sql()}"


def _c(x: str) -> str:
    return f"least(greatest({x}, 0), 1)"


_SCORES = {
    "coding": f"{_c('code_ratio * 4')} + {_c('error / 2')} * 0.8 + {_c('filename / 2')} * 0.7 + {_c('imperative / 5')} * 0.5 - {_c('avg_user_len / 800')} * 0.2",
    "writing": f"{_c('avg_user_len / 800')} * 0.6 + {_c('style / 2')} + {_c('imperative / 5')} * 0.3 - {_c('code_ratio * 4')} * 0.5",
    "research": f"{_c('question_density / 2')} * 0.5 + {_c('citation / 2')} + {_c('avg_user_len / 600')} * 0.4",
    "planning": f"{_c('decision / 2')} + {_c('ideation / 2')} * 0.9 + {_c('future_tense / 3')} * 0.5 + {_c('imperative / 5')} * 0.3",
}
TYPED = f"""scores AS (SELECT conv_id, {", ".join(f"{x} AS {k}" for k, x in _SCORES.items())} FROM signals),
ranked AS (SELECT conv_id, list_reverse_sort([{", ".join(f"{{'s': round({k}, 9), 'i': {-i}, 't': {q(k)}}}" for i, k in enumerate(_SCORES))}]) AS r FROM scores),
types AS (SELECT conv_id, r[1].s AS top, r[2].s AS second, CASE WHEN r[1].s < {fixed.MIXED_FLOOR} OR r[1].s - r[2].s < {fixed.MIXED_MARGIN} THEN 'mixed' ELSE r[1].t END AS type FROM ranked)"""


def _add(hit: str, x: float) -> str:
    return f"CASE WHEN {hit} THEN {x} ELSE 0 END"


def _by(hit: str, x: float) -> str:
    return f"CASE WHEN {hit} THEN {x} ELSE 1 END"


_RAW = " + ".join([
    "0.4 * exp(-3 * (1 - position)) - 0.0005 * char_len", _add("kind = 'question' AND role = 'user'", 0.3), _add("kind = 'question' AND unanswered", 0.6), _add(like("text", fixed.SCORE_IMPERATIVE), 0.2),
    _add(like("text", fixed.SCORE_DECISION), 0.5), _add(like("text", fixed.SCORE_ERROR), 0.4), _add(like("text", fixed.SCORE_FILENAME), 0.3), _add("kind = 'code'", 0.3), "0.2 * tfidf_score",
])
_OVERLAY = f"""CASE type WHEN 'coding' THEN {_by("kind = 'code'", 1.5)} * {_by(like("text", fixed.SCORE_ERROR), 1.5)}
  WHEN 'writing' THEN {_by("kind = 'code'", 0.7)} * {_by(like("text", fixed.SCORE_STYLE), 1.4)} * {_by("char_len > 200", 1.2)}
  WHEN 'research' THEN {_by(like("text", fixed.SCORE_CITATION), 1.5)} * {_by(like("text", "[0-9]"), 1.1)}
  WHEN 'planning' THEN {_by(like("text", fixed.SCORE_TRADEOFF), 1.4)} * {_by(like("text", fixed.SCORE_DEADLINE), 1.5)} ELSE 1 END"""
SCORED = f"""{TERMS}, {signals_sql()}, {TYPED},
scored AS (SELECT c.*, tfidf_score, type, ({_RAW}) * ({_OVERLAY}) AS score, last_user OR (last_assistant AND kind IN ('code', 'decision')) OR {like("text", fixed.STRONG_DECISION)} AS always_keep
  FROM candidates c JOIN tfidf USING (conv_id, ord) JOIN types USING (conv_id))"""


def plain(x: str) -> str:
    return strip_markdown(strip_urls(x))


PLAIN = f"""{BLOCKS},
plains AS (SELECT conv_id, msg_idx, any_value(role) AS role, string_agg({plain("text")}, ' ' ORDER BY block_idx) AS plain FROM blocks WHERE type = 'text' GROUP BY conv_id, msg_idx),
sizes AS (SELECT conv_id, count(*) AS n FROM messages GROUP BY conv_id)"""


def selected(budget: float) -> str:
    """The greedy selection as a recursion over the ranks of a conversation."""
    return f"""{SCORED},
keeps AS (SELECT *, row_number() OVER w AS keep_rank, sum(char_len) OVER (w ROWS UNBOUNDED PRECEDING) AS cost FROM scored WHERE always_keep WINDOW w AS (PARTITION BY conv_id ORDER BY score DESC, ord)),
firsts AS (SELECT conv_id, ord FROM keeps WHERE cost <= {budget * fixed.ALWAYS_KEEP_SHARE} OR keep_rank = 1),
rest AS (SELECT s.*, row_number() OVER (PARTITION BY s.conv_id ORDER BY s.score / greatest(1.0, log10(s.char_len + 10)) DESC, coalesce(k.keep_rank, 0), s.ord) AS rank
  FROM scored s LEFT JOIN keeps k USING (conv_id, ord) WHERE (s.conv_id, s.ord) NOT IN (SELECT (conv_id, ord) FROM firsts)),
walk(conv_id, rank, used, msgs, ords) AS (
  SELECT c.conv_id, 0::BIGINT, coalesce(sum(char_len) FILTER (WHERE f.ord IS NOT NULL), 0)::BIGINT, coalesce(list(c.msg_idx) FILTER (WHERE f.ord IS NOT NULL), []), coalesce(list(c.ord) FILTER (WHERE f.ord IS NOT NULL), [])
  FROM scored c LEFT JOIN firsts f USING (conv_id, ord) GROUP BY c.conv_id
  UNION ALL
  SELECT conv_id, rank, CASE WHEN take THEN used + char_len ELSE used END, CASE WHEN take THEN list_append(msgs, msg_idx) ELSE msgs END, CASE WHEN take THEN list_append(ords, ord) ELSE ords END
  FROM (SELECT w.conv_id, r.rank, w.used, w.msgs, w.ords, r.char_len, r.msg_idx, r.ord, w.used + r.char_len <= {budget} AND (r.score - {fixed.DIVERSITY_PENALTY} * len(list_filter(w.msgs, lambda m: m = r.msg_idx)) > 0 OR r.always_keep) AS take FROM walk w JOIN rest r ON r.conv_id = w.conv_id AND r.rank = w.rank + 1)),
selected AS (SELECT conv_id, unnest(ords) AS ord FROM (SELECT conv_id, max_by(ords, rank) AS ords FROM walk GROUP BY conv_id))"""


_SHOWN = "CASE WHEN type = 'code' THEN '```' || coalesce(language, '') || chr(10) || text || chr(10) || '```' ELSE text END"
FULL = f"""{BLOCKS}, {signals_sql()}, {TYPED},
shown AS (SELECT conv_id, msg_idx, CASE any_value(role) WHEN 'user' THEN '### User' WHEN 'assistant' THEN '### Assistant' ELSE '### ' || any_value(role) END || chr(10) || chr(10) || string_agg({_SHOWN}, chr(10) || chr(10) ORDER BY block_idx) AS t, sum(length(text)) AS n FROM blocks GROUP BY conv_id, msg_idx),
bodies AS (SELECT conv_id, string_agg(t, chr(10) || chr(10) ORDER BY msg_idx) AS body, sum(n)::BIGINT AS input_chars FROM shown GROUP BY conv_id),
lead AS (SELECT conv_id, type, input_chars, '# Conversation' || chr(10) || chr(10) || '**Source:** chatgpt' || chr(10) || chr(10) || chr(10) || coalesce('## System' || chr(10) || system_prompt || chr(10) || chr(10), '') || body || chr(10) || chr(10) || '---' || chr(10)
  || '*Generated by Skein. Compressed ' || format('{{:,}}', input_chars) || ' -> ' AS t FROM bodies JOIN types USING (conv_id) LEFT JOIN prompts USING (conv_id)),
full_documents AS (SELECT conv_id, type, input_chars, t || format('{{:,}}', length(t) + length('0 chars.*') + 1) || ' chars.*' || chr(10) AS markdown FROM lead)"""

_SENTENCES = sentences("t")
TLDR = f"""{BLOCKS}, {signals_sql()}, {TYPED},
spoken AS (SELECT conv_id, msg_idx, string_agg(text, ' ' ORDER BY block_idx) AS t FROM blocks WHERE role = 'user' AND type = 'text' GROUP BY conv_id, msg_idx),
asked AS (SELECT conv_id, min(msg_idx) AS a, max(msg_idx) AS z FROM messages WHERE role = 'user' GROUP BY conv_id),
firsts AS (SELECT asked.conv_id, {sentences("regexp_replace(t, '[ " + chr(92) + "t" + chr(92) + "n" + chr(92) + "r]+', ' ', 'g')")}[1:2] AS s FROM asked JOIN spoken ON spoken.conv_id = asked.conv_id AND msg_idx = a),
lasts AS (SELECT asked.conv_id, {_SENTENCES}[1:2] AS s FROM asked JOIN spoken ON spoken.conv_id = asked.conv_id AND msg_idx = z),
sizes AS (SELECT conv_id, sum(length(text))::BIGINT AS input_chars FROM blocks GROUP BY conv_id),
tails AS (SELECT conv_id, type, input_chars, coalesce(CASE WHEN length(system_prompt) >= 60 THEN '## Context' || chr(10) || system_prompt || chr(10) || chr(10) END, '')
  || coalesce(CASE len(f.s) WHEN 1 THEN '## Goal' || chr(10) || f.s[1] || chr(10) || chr(10) WHEN 2 THEN '## Goal' || chr(10) || '- ' || f.s[1] || chr(10) || '- ' || f.s[2] || chr(10) || chr(10) END, '')
  || coalesce(CASE WHEN len(l.s) > 0 THEN '## Next steps' || chr(10) || array_to_string(l.s, ' ') || chr(10) || chr(10) END, '') || '---' || chr(10) || '*Generated by Skein.*' || chr(10) AS t
  FROM sizes JOIN types USING (conv_id) LEFT JOIN prompts USING (conv_id) LEFT JOIN firsts f USING (conv_id) LEFT JOIN lasts l USING (conv_id)),
firstly AS (SELECT *, '# Conversation Handoff' || chr(10) || chr(10) || '**Source:** chatgpt | **Type:** ' || type || ' | **' AS h, ' ' || format('{{:,}}', input_chars) || ' -> ' AS m, ' chars**' || chr(10) || chr(10) || t AS e FROM tails),
sized AS (SELECT *, length(h || 'Compressed' || m || '0' || e) AS n FROM firstly),
tldr_documents AS (SELECT conv_id, type, input_chars, h || CASE WHEN n <= input_chars THEN 'Compressed' ELSE 'Restructured' END || m || format('{{:,}}', n) || e AS markdown FROM sized)"""
