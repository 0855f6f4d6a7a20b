"""SQL counterparts of identity, decisions, plans, artifacts and documents. Folds over a list's items are list_reduce over its structs."""

from __future__ import annotations

from ..functions import fixed
from . import oracle as O
from .oracle_exports import PARSED

NL = "chr(10)"


def isin(x: str, words) -> str:
    return f"{x} IN ({', '.join(map(O.q, words))})"


def collapse(x: str) -> str:
    return O.ws(f"regexp_replace({x}, '\\s+', ' ', 'g')")


def cut(x: str, most: int, keep: int | None = None) -> str:
    return f"CASE WHEN length({x}) <= {most} THEN {x} ELSE regexp_replace(substr({x}, 1, {keep or most - 1}), '\\s\\S*$', '') || '...' END"


def first_sentence(c: str) -> str:
    """c: a collapsed text."""
    return f"CASE WHEN regexp_matches({c}, '^[^.!?\\n]{{8,180}}') THEN {O.ws(f"regexp_extract({c}, '^[^.!?\\n]{{8,180}}[.!?]?')")} ELSE {O.ws(f'substr({c}, 1, 120)')} END"


_COMMON = ", ".join(map(O.q, fixed.COMMON_LOWER))
_CAPITAL = ", ".join(map(O.q, fixed.CAPITAL_STOPLIST))
#: After BLOCKS: names, terms and bigrams with their weights.
WORDS = f"""
texts AS (SELECT conv_id, msg_idx, string_agg(CASE WHEN type = 'text' THEN {O.plain("text")} ELSE array_to_string(string_split(text, chr(10))[1:10], chr(10)) END, ' ' ORDER BY block_idx) AS t FROM blocks GROUP BY conv_id, msg_idx),
cut AS (SELECT conv_id, msg_idx, regexp_extract_all(t, '([^A-Za-z]*)([A-Za-z][A-Za-z0-9_-]*)', 1) AS gs, regexp_extract_all(t, '([^A-Za-z]*)([A-Za-z][A-Za-z0-9_-]*)', 2) AS ws FROM texts),
uttered AS (SELECT c.conv_id, c.msg_idx, u.i, u.gap, u.word, u.i = 0 OR regexp_matches(u.gap, '[.!?]\\s*$|\\n') AS at_start FROM cut c, LATERAL (SELECT unnest(gs) AS gap, unnest(ws) AS word, unnest(range(len(ws))) AS i) u),
seen AS (SELECT *, bool_or(NOT at_start) OVER (PARTITION BY conv_id, msg_idx, word) AS inside, word[1:1] BETWEEN 'A' AND 'Z' AS cap FROM uttered),
entries AS (SELECT conv_id, msg_idx, i, 0 AS class, word AS term FROM seen WHERE length(word) >= 3 AND cap AND word NOT IN ({_CAPITAL}) AND (word = upper(word) OR NOT at_start OR inside)
  UNION ALL SELECT conv_id, msg_idx, i, 1, lower(word) FROM seen WHERE length(word) >= 4 AND lower(word) NOT IN ({_COMMON}) AND (cap AND word NOT IN ({_CAPITAL}) OR NOT cap AND regexp_matches(word, '^[a-z0-9_-]+$'))),
pairs AS (SELECT conv_id, msg_idx, i, word AS a, lead(word) OVER w AS b, lead(gap) OVER w AS g FROM uttered WINDOW w AS (PARTITION BY conv_id, msg_idx ORDER BY i)),
fit AS (SELECT *, lower(a) || ' ' || lower(b) AS pair FROM pairs WHERE length(a) >= 3 AND length(b) >= 3 AND NOT regexp_matches(g, '[.!?\\n]') AND lower(a) NOT IN ({_COMMON}) AND lower(b) NOT IN ({_COMMON}) AND a NOT IN ({_CAPITAL}) AND b NOT IN ({_CAPITAL})
  AND (a[1:1] BETWEEN 'A' AND 'Z' OR b[1:1] BETWEEN 'A' AND 'Z' OR regexp_matches(a, '^[a-z]+$') AND regexp_matches(b, '^[a-z]+$'))),
counts AS (SELECT conv_id, class, term, count(*) AS count, count(DISTINCT msg_idx) AS messages, min(msg_idx * 1000000 + i) AS seen FROM entries GROUP BY conv_id, class, term
  UNION ALL SELECT conv_id, 2, min_by(a || ' ' || b, msg_idx * 1000000 + i), count(*), count(DISTINCT msg_idx), min(msg_idx * 1000000 + i) FROM fit GROUP BY conv_id, pair),
n AS (SELECT conv_id, count(*) AS n FROM messages GROUP BY conv_id),
weighed AS (SELECT conv_id, class, term, count, messages, seen, messages / n AS spread, count * (CASE class WHEN 0 THEN 0.4 + 0.6 * messages / n WHEN 1 THEN 0.3 + 0.5 * messages / n ELSE 0.5 + 0.7 * messages / n END) AS weight
  FROM counts JOIN n USING (conv_id) WHERE class = 0 AND count >= 2 AND messages >= 2 OR class = 1 AND count >= 5 AND messages >= 3 OR class = 2 AND count >= 3 AND messages >= 2)"""
TOP = f"""{WORDS},
top AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY weight DESC, class, seen) AS rank FROM weighed),
familiar AS (SELECT conv_id, list(lower(term) ORDER BY rank) AS terms FROM top WHERE rank <= 12 GROUP BY conv_id)"""


def _fresh_terms(name: str) -> str:
    """Terms of tops in order, none of whose words an earlier one has taken."""
    words = "list_concat([lower(t)], string_split(lower(t), ' '))"
    return f"""list_reduce(tops, lambda a, t: CASE WHEN len(a.out) < 6 AND lower(t) <> lower({name}) AND NOT list_has_any(a.used, {words}) THEN {{'out': list_append(a.out, t), 'used': list_concat(a.used, {words})}} ELSE a END, {{'out': []::VARCHAR[], 'used': []::VARCHAR[]}}).out"""


_PHRASES = " || ".join(f"regexp_extract_all(t, {O.q(p)}, 1)" for p in fixed.SECTION_HEADERS)
#: After TOP: project line, confidence, recent focus.
IDENTITY = f"""{TOP},
called AS (SELECT conv_id, max_by(term, rk) AS name, max_by(count, rk) AS hits, max_by(messages, rk) AS spans FROM (SELECT *, -row_number() OVER (PARTITION BY conv_id ORDER BY weight DESC, seen) AS rk FROM weighed WHERE class = 0 AND spread >= 0.02) GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM turns WHERE role IN ('user', 'assistant', 'system', 'tool') AND {O.ws("text")} <> ''),
lists AS (SELECT ids.conv_id, name, hits, spans, coalesce(tops, []) AS tops FROM ids LEFT JOIN called USING (conv_id) LEFT JOIN (SELECT conv_id, list(term ORDER BY rank) AS tops FROM top WHERE rank <= 12 GROUP BY conv_id) t USING (conv_id)),
around AS (SELECT *, {_fresh_terms("coalesce(name, '')")} AS beside, {_fresh_terms("''")} AS keywords FROM lists),
lined AS (SELECT *, CASE WHEN name IS NOT NULL AND len(beside) > 0 THEN name || ' - project around ' || array_to_string(beside, ', ') || '.' WHEN len(keywords) > 0 THEN 'Project keywords: ' || array_to_string(keywords, ', ') || '.' ELSE '' END AS project_line FROM around),
sure AS (SELECT *, CASE WHEN name IS NULL OR project_line = '' THEN 'low' WHEN hits >= 10 AND spans >= 5 THEN 'high' WHEN hits >= 4 AND spans >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM lined),
latest AS (SELECT conv_id, msg_idx, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY msg_idx DESC) AS back FROM messages WHERE role IN ('user', 'assistant')) WHERE back <= 30),
lately AS (SELECT conv_id, count(DISTINCT msg_idx) AS rn, count(block_idx) AS recent_blocks FROM latest LEFT JOIN blocks USING (conv_id, msg_idx) GROUP BY conv_id),
texts2 AS (SELECT conv_id, msg_idx, string_agg({O.plain("text")}, ' ' ORDER BY block_idx) AS t FROM blocks JOIN latest USING (conv_id, msg_idx) WHERE type = 'text' GROUP BY conv_id, msg_idx),
cut2 AS (SELECT conv_id, msg_idx, regexp_extract_all(t, '([^A-Za-z]*)([A-Za-z][A-Za-z0-9_-]*)', 1) AS gs, regexp_extract_all(t, '([^A-Za-z]*)([A-Za-z][A-Za-z0-9_-]*)', 2) AS ws FROM texts2),
seen2 AS (SELECT *, bool_or(NOT at_start) OVER (PARTITION BY conv_id, msg_idx, word) AS inside, word[1:1] BETWEEN 'A' AND 'Z' AS cap FROM (SELECT c.conv_id, c.msg_idx, u.i, u.word, u.i = 0 OR regexp_matches(u.gap, '[.!?]\\s*$|\\n') AS at_start FROM cut2 c, LATERAL (SELECT unnest(gs) AS gap, unnest(ws) AS word, unnest(range(len(ws))) AS i) u)),
entries2 AS (SELECT conv_id, msg_idx, i, 0 AS class, word AS term FROM seen2 WHERE length(word) >= 3 AND cap AND word NOT IN ({_CAPITAL}) AND (word = upper(word) OR NOT at_start OR inside)
  UNION ALL SELECT conv_id, msg_idx, i, 1, lower(word) FROM seen2 WHERE length(word) >= 4 AND lower(word) NOT IN ({_COMMON}) AND (cap AND word NOT IN ({_CAPITAL}) OR NOT cap AND regexp_matches(word, '^[a-z0-9_-]+$'))),
risen AS (SELECT conv_id, class, term, seen, hits * CASE class WHEN 0 THEN 0.4 + 0.6 * (ms / rn) ELSE 0.3 + 0.5 * (ms / rn) END AS weight FROM (SELECT conv_id, class, term, count(*) AS hits, count(DISTINCT msg_idx) AS ms, min(msg_idx * 1000000 + i) AS seen FROM entries2 GROUP BY ALL) JOIN lately USING (conv_id)
  WHERE class = 0 AND hits >= 2 OR class = 1 AND hits >= 3 AND ms >= 2),
lifted AS (SELECT r.conv_id, list(term ORDER BY weight + CASE WHEN list_contains(list_transform(tops[1:5], lambda t: lower(t)), lower(term)) THEN 0 ELSE 0.5 END DESC, weight DESC, class, seen, term) AS emergent FROM risen r JOIN sure USING (conv_id) WHERE lower(term) <> lower(coalesce(name, '')) GROUP BY r.conv_id),
headed AS (SELECT conv_id, flatten(list(list_filter(list_transform(ps, lambda p: regexp_replace(regexp_replace({O.ws("p")}, '[*_`]+', '', 'g'), '\\s+', ' ', 'g')), lambda p: length(p) BETWEEN 3 AND 60) ORDER BY msg_idx DESC)) AS phrases
  FROM (SELECT conv_id, msg_idx, {_PHRASES} AS ps FROM (SELECT conv_id, msg_idx, string_agg({O.asciiize("text")}, {NL} || {NL} ORDER BY block_idx) AS t FROM blocks JOIN latest USING (conv_id, msg_idx, role) WHERE type = 'text' AND role = 'assistant' GROUP BY ALL)) GROUP BY conv_id),
named_phrases AS (SELECT conv_id, list_reduce(coalesce(phrases, []), lambda a, p: CASE WHEN len(a.out) < 4 AND {O.ws("lower(p)")} <> '' AND NOT list_contains(a.seen, {O.ws("lower(p)")}) THEN {{'out': list_append(a.out, p), 'seen': list_append(a.seen, {O.ws("lower(p)")})}} ELSE a END, {{'out': []::VARCHAR[], 'seen': []::VARCHAR[]}}) AS f FROM lately LEFT JOIN headed USING (conv_id)),
focused AS (SELECT conv_id, list_reduce(coalesce(emergent, []), lambda a, t: CASE WHEN len(a.out) < 4 AND len(list_filter(a.seen, lambda s: contains(s, lower(t)) OR contains(lower(t), s))) = 0 THEN {{'out': list_append(a.out, t), 'seen': list_append(a.seen, lower(t))}} ELSE a END, f).out AS focus FROM named_phrases LEFT JOIN lifted USING (conv_id)),
identities AS (SELECT conv_id, name AS project_name, project_line, confidence, coalesce(CASE WHEN len(focus) > 0 THEN array_to_string(focus, ', ') || '.' END, '') AS recent_focus_line, coalesce(recent_blocks, 0) AS recent_blocks FROM sure LEFT JOIN focused USING (conv_id) LEFT JOIN lately USING (conv_id))"""

_NEGATED = fixed.NEGATION.replace("(?!", "(?:")


def _decided(pattern: str) -> str:
    """Whether s matches; a pattern that forbids a negation is tried without that and with a negation required."""
    if fixed.NEGATION not in pattern:
        return O.like("s", pattern)
    return f"({O.like('s', pattern.replace(fixed.NEGATION, ''))} AND NOT {O.like('s', pattern.replace(fixed.NEGATION, _NEGATED))})"


_NAMES = "len(list_filter(regexp_extract_all(regexp_replace(s, '^[\\s\"''(\\[]+', ''), '[A-Za-z][A-Za-z0-9_-]*')[2:], lambda w: length(w) >= 3 AND w[1:1] BETWEEN 'A' AND 'Z' AND w NOT IN ({})))".format(", ".join(map(O.q, fixed.PRONOUN_LIKE)))
#: After TOP: sentences that state decisions.
FOUND = f"""
parted AS (SELECT conv_id, msg_idx, block_idx, message_id, role, list_filter(list_transform(string_split_regex(regexp_replace({O.plain("text")}, '([.!?])\\s+', '\\1' || chr(30), 'g'), chr(30) || '|\\n+'), lambda x: {O.ws("x")}), lambda x: x <> '') AS ss FROM blocks WHERE type = 'text'),
stated AS (SELECT d.conv_id, d.msg_idx, d.block_idx, d.message_id, d.role, u.s, u.i, coalesce(terms[1:5], []) AS ks FROM parted d LEFT JOIN familiar USING (conv_id), LATERAL (SELECT unnest(d.ss) AS s, unnest(range(len(d.ss))) AS i) u),
shaped AS (SELECT *, len(list_filter(ks, lambda t: contains(lower(s), t))) > 0 AS names FROM stated WHERE length(s) BETWEEN 25 AND 300 AND NOT starts_with(s, '#') AND NOT ends_with(s, '?') AND NOT regexp_matches(s, ':\\s*$')
  AND NOT {O.like("s", fixed.PROPOSAL)} AND NOT {O.like("s", fixed.INSTRUCTION_LEAD)} AND NOT {O.like("s", fixed.NARRATION_LEAD)} AND NOT {O.header("s")} AND regexp_matches(s, '[a-zA-Z]')
  AND NOT ({O.like("s", fixed.FRAGMENT_LEAD)} AND NOT {O.like("s[1:80]", fixed.FRAGMENT_SUBJECT)}) AND NOT ({O.like("s", fixed.HYPOTHETICAL_LEAD)} AND {O.like("s", fixed.HYPOTHETICAL_VERB)})),
strong AS (SELECT *, CASE WHEN {_decided(fixed.HARD_DECISION)} THEN 3 WHEN {_decided(fixed.DECISION_TRADEOFF)} THEN 2.5 WHEN {_decided(fixed.SOFT_COMMIT)} THEN 2 WHEN role = 'assistant' AND {_decided(fixed.RECOMMEND)} THEN 1.5 ELSE 0 END AS base
  FROM shaped WHERE len(list_filter(string_split_regex(s, '\\s+'), lambda w: w <> '')) >= 8 OR names OR {_NAMES} > 0),
decisions AS (SELECT conv_id, msg_idx, message_id, s AS text, msg_idx / greatest(1, n - 1) AS position, base + CASE WHEN names THEN 0.3 ELSE 0 END + 0.5 * msg_idx / greatest(1, n - 1) AS strength, row_number() OVER (PARTITION BY conv_id ORDER BY msg_idx, block_idx, i) AS ord FROM strong JOIN n USING (conv_id) WHERE base > 0)"""
_SIGN = "CASE " + " ".join(f"WHEN contains(lower(text), {O.q(x)}) THEN {O.q(x)}" for x in fixed.SIGNATURES) + " ELSE '' END"
DECIDED = f"""{FOUND},
chosen AS (SELECT conv_id, list_reduce(list({{'ord': ord, 'key': {O.key("text")}, 'sign': {_SIGN}}} ORDER BY round(strength, 9) DESC, ord), lambda a, x: CASE WHEN len(a.ords) < 8 AND NOT list_contains(a.keys, x.key) AND (x.sign = '' OR NOT list_contains(a.signs, x.sign))
  THEN {{'ords': list_append(a.ords, x.ord), 'keys': list_append(a.keys, x.key), 'signs': list_append(a.signs, x.sign)}} ELSE a END, {{'ords': []::BIGINT[], 'keys': []::VARCHAR[], 'signs': []::VARCHAR[]}}).ords AS ords FROM decisions GROUP BY conv_id),
kept_decisions AS (SELECT d.*, row_number() OVER (PARTITION BY d.conv_id ORDER BY position, round(strength, 9) DESC, ord) - 1 AS i FROM decisions d JOIN chosen c ON c.conv_id = d.conv_id AND list_contains(c.ords, d.ord))"""

#: After TOP: snippets of the recent messages.
SNIPPETS = f"""
tail AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY msg_idx DESC) AS back FROM messages WHERE role IN ('user', 'assistant')) WHERE back <= 30),
told AS (SELECT conv_id, msg_idx, coalesce({collapse(f"string_agg({O.plain('text')}, ' ' ORDER BY block_idx) FILTER (WHERE type = 'text')")}, '') AS whole, bool_or(type = 'code') AS had_code FROM blocks GROUP BY conv_id, msg_idx),
phrased AS (SELECT t.conv_id, t.msg_idx, t.role, whole, had_code, coalesce(terms, []) AS ks, list_filter({O.sentences('whole')}, lambda x: NOT {O.header('x')}) AS ss FROM tail t JOIN told USING (conv_id, msg_idx) LEFT JOIN familiar ON familiar.conv_id = t.conv_id),
picked AS (SELECT *, CASE WHEN role = 'user' THEN CASE WHEN len(ss) <= 3 THEN ss WHEN ss[-1] = ss[2] THEN ss[1:2] ELSE ss[1:2] || ss[-1:] END ELSE (ss[1:2] || list_filter(ss[3:], lambda x: len(list_filter(ks, lambda k: contains(lower(x), k))) > 0))[1:4] END AS p FROM phrased),
joined AS (SELECT *, array_to_string(p, ' ') || CASE WHEN had_code THEN ' [+ code, see artifacts]' ELSE '' END AS t FROM picked),
lines AS (SELECT conv_id, msg_idx, role, had_code, CASE WHEN whole = '' THEN CASE WHEN had_code THEN '[code only - see artifacts]' ELSE '' END WHEN len(ss) = 0 THEN {cut('whole', 240)} ELSE {cut('t', 400)} END AS text FROM joined),
costs AS (SELECT *, sum(length(text) + 20) OVER w AS c, row_number() OVER w AS r FROM lines WINDOW w AS (PARTITION BY conv_id ORDER BY msg_idx DESC)),
snippets AS (SELECT conv_id, msg_idx, role, text, had_code FROM costs WHERE c <= 3500 OR r <= 2)"""

#: After BLOCKS: next steps that users name.
STEPS = f"""
plains AS (SELECT conv_id, msg_idx, string_agg({O.plain("text")}, ' ' ORDER BY block_idx) AS plain FROM blocks WHERE type = 'text' GROUP BY conv_id, msg_idx),
lengths AS (SELECT conv_id, count(*) AS size FROM messages GROUP BY conv_id),
recent_users AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY msg_idx DESC) AS back FROM messages WHERE role = 'user'),
user_sentences AS (SELECT conv_id, msg_idx, {O.sentences('plain')} AS ss FROM plains JOIN (SELECT conv_id, msg_idx FROM recent_users WHERE back <= 10) USING (conv_id, msg_idx)),
named_steps AS (SELECT conv_id, msg_idx, u.i, u.s FROM user_sentences, LATERAL (SELECT unnest(ss) AS s, unnest(range(len(ss))) AS i) u WHERE length(u.s) BETWEEN 12 AND 240 AND NOT {O.header('u.s')} AND {O.like('u.s', fixed.NEXT_STEP)}),
single_steps AS (SELECT *, row_number() OVER (PARTITION BY conv_id, {O.key('s')} ORDER BY msg_idx DESC, i) AS d FROM named_steps),
late_steps AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY msg_idx DESC, i) AS k FROM single_steps WHERE d = 1),
steps AS (SELECT conv_id, msg_idx, i, s AS text, msg_idx / greatest(1, size - 1) AS position FROM late_steps JOIN lengths USING (conv_id) WHERE k <= 5)"""

#: After SAID: questions of users that nobody answered.
QUESTIONS = f"""
queried AS (SELECT b.conv_id, b.msg_idx, b.block_idx, u.i, u.s FROM (SELECT blocks.*, {O.sentences(O.plain('blocks.text'))} AS ss FROM blocks JOIN context USING (conv_id, msg_idx) WHERE type = 'text' AND unanswered AND n_messages - msg_idx <= 20) b,
  LATERAL (SELECT unnest(b.ss) AS s, unnest(range(len(b.ss))) AS i) u WHERE ends_with(u.s, '?') AND length(u.s) BETWEEN 12 AND 240),
single_questions AS (SELECT *, row_number() OVER (PARTITION BY conv_id, {O.key('s')} ORDER BY msg_idx, block_idx, i) AS d FROM queried),
questions AS (SELECT * FROM (SELECT conv_id, s AS text, row_number() OVER (PARTITION BY conv_id ORDER BY msg_idx, block_idx, i) AS ord FROM single_questions WHERE d = 1) WHERE ord <= 5)"""


def _item(x: str) -> str:
    t = O.ws(f"regexp_replace({collapse(x)}, '[*_`]+$', '')")
    return cut(t, 140, 137)


def _entries(items: str) -> str:
    return f"list_transform({items}, lambda x: {{'label': NULL::VARCHAR, 'text': x}})"


def _list_after(head: str) -> str:
    """Numbered lines behind the first line for which head (of l) holds, as a fold over the 29 lines that follow it."""
    first = f"list_position(list_transform(ls, lambda l: {head}), true)"
    item = _item(f"regexp_extract(t, {O.q(fixed.NUMBERED_ITEM)}, 2)")
    step = f"""CASE WHEN a.done THEN a WHEN t = '' THEN {{'out': a.out, 'blank': a.blank + 1, 'done': a.blank >= 1 AND len(a.out) > 0}}
      WHEN {O.like("t", fixed.NUMBERED_ITEM)} THEN {{'out': CASE WHEN length({item}) >= 4 THEN list_append(a.out, {item}) ELSE a.out END, 'blank': 0, 'done': false}} ELSE {{'out': a.out, 'blank': 0, 'done': len(a.out) > 0}} END"""
    lines = f"list_transform(ls[coalesce({first}, 0) + 1:coalesce({first}, 0) + 29], lambda l: {O.ws('l')})"
    return f"CASE WHEN coalesce({first}, 0) > 0 THEN list_reduce({lines}, lambda a, t: {step}, {{'out': []::VARCHAR[], 'blank': 0, 'done': false}}).out ELSE [] END"


_K, _N, _T = (f"regexp_extract_all(plain2, {O.q(fixed.PART_HEADER)}, {g})" for g in (1, 2, 3))
#: After BLOCKS: the newest plan of a conversation.
PLAN = f"""
plains2 AS (SELECT conv_id, msg_idx, string_agg({O.plain("text")}, {NL} || {NL} ORDER BY block_idx) AS plain2 FROM blocks JOIN (SELECT conv_id, msg_idx FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY msg_idx DESC) AS back FROM messages WHERE role IN ('user', 'assistant')) WHERE back <= 30) USING (conv_id, msg_idx) WHERE type = 'text' GROUP BY conv_id, msg_idx),
headers AS (SELECT conv_id, msg_idx, plain2, string_split(plain2, {NL}) AS ls, {_K} AS ks, {_N} AS ns, {_T} AS ts FROM plains2),
shapes AS (SELECT *, list_filter(list_transform(range(1, len(ks) + 1), lambda i: {{'label': CASE upper(ks[i]) WHEN 'PART' THEN 'PART' ELSE ks[i] END || ' ' || ns[i], 'text': {_item("ts[i]")}}}), lambda x: length(x.text) >= 4) AS a,
  {_entries(_list_after(O.like(O.ws("l"), fixed.ANCHORED_HEADER)))} AS b, {_entries(_list_after(O.like("l", fixed.N_THINGS_INTRO)))} AS c,
  {_entries(f"list_filter(list_transform(list_filter(ls, lambda l: {O.like('l', fixed.NUMBERED_ITEM)}), lambda l: {_item(f'regexp_extract(l, {O.q(fixed.NUMBERED_ITEM)}, 2)')}), lambda x: length(x) >= 4)")} AS d FROM headers),
plans AS (SELECT conv_id, msg_idx, CASE WHEN len(a) >= 2 THEN a WHEN len(b) >= 2 THEN b WHEN len(c) >= 2 THEN c WHEN len(d) >= 3 THEN d END AS plan FROM shapes),
plan AS (SELECT conv_id, max(msg_idx) AS msg_idx, max_by(plan, msg_idx)[1:6] AS plan FROM plans WHERE plan IS NOT NULL GROUP BY conv_id)"""


def classified(name: str, mime: str) -> str:
    e, b = f"CASE WHEN contains({name}, '.') THEN string_split(lower({name}), '.')[-1] ELSE '' END", f"string_split(lower({name}), '/')[-1]"
    return f"""CASE WHEN {b} IN ('dockerfile', 'makefile') THEN 'code_file' WHEN {e} = 'svg' THEN 'image' WHEN {isin(e, fixed.CODE_EXTENSIONS)} THEN 'code_file' WHEN {isin(e, fixed.IMAGE_EXTENSIONS)} THEN 'image' WHEN {e} = 'pdf' THEN 'pdf'
  WHEN {isin(e, fixed.DOCUMENT_EXTENSIONS)} THEN 'document' WHEN {mime} LIKE 'image/%' THEN 'image' WHEN {mime} = 'application/pdf' THEN 'pdf' WHEN {mime} LIKE 'text/%' OR {mime} IN ('application/json', 'application/xml') OR {mime} LIKE '%javascript%' OR {mime} LIKE '%typescript%' THEN 'code_file'
  WHEN {mime} LIKE '%word%' OR {mime} LIKE '%excel%' OR {mime} LIKE '%powerpoint%' OR {mime} LIKE '%opendocument%' THEN 'document' ELSE 'other' END"""


def language(name: str) -> str:
    return f"CASE string_split(lower({name}), '.')[-1] {' '.join(f'WHEN {O.q(k)} THEN {O.q(v)}' for k, v in fixed.LANGUAGES.items())} ELSE '' END"


def _firsts(x: str, options) -> str:
    """The result of the first (pattern, result) whose pattern matches; ''."""
    return "CASE " + " ".join(f"WHEN {O.like(x, p)} THEN {O.q(r)}" for p, r in options) + " ELSE '' END"


def _declaration(x: str) -> str:
    head = f"array_to_string(string_split({x}, {NL})[1:30], {NL})"
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({head}, {O.q(p)}, 1), '')" for p in fixed.DECLARATIONS) + ", '')"


_CAP_LANGUAGE = "CASE WHEN language IN ('', 'code') THEN 'Code' WHEN language = lower(language) THEN upper(language[1:1]) || language[2:] ELSE language END"
_DESCRIBED = f"""
sourced AS (
  SELECT conv_id, msg_idx, 0 AS part, i, 'attachment' AS source, regexp_replace({O.ws("filename")}, '^\\d{{10,16}}_', '') AS name, coalesce(content, '') AS content, size FROM art_files WHERE kind = 'code_file'
  UNION ALL SELECT conv_id, msg_idx, 1, block_idx, 'claude-artifact', coalesce(nullif(title, ''), 'artifact'), text, NULL FROM art_blocks WHERE type = 'artifact'
  UNION ALL SELECT conv_id, msg_idx, 2, block_idx, 'inline-code', coalesce(nullif(before, ''), nullif({_declaration("text")}, '') || '()', 'inline ' || coalesce(language, 'code') || ' #' || msg_idx), text, NULL
    FROM art_blocks JOIN (SELECT conv_id, msg_idx, CASE WHEN lag(role) OVER w = 'user' THEN lag(mentioned) OVER w END AS before FROM (SELECT m.conv_id, m.msg_idx, m.role, mentioned FROM art_messages m LEFT JOIN (
      SELECT conv_id, msg_idx, list(regexp_extract(text, {O.q(fixed.FILE_MENTION)}, 1) ORDER BY block_idx)[1] AS mentioned FROM art_blocks WHERE type = 'text' AND regexp_extract(text, {O.q(fixed.FILE_MENTION)}, 1) <> '' GROUP BY conv_id, msg_idx) x USING (conv_id, msg_idx)) WINDOW w AS (PARTITION BY conv_id ORDER BY msg_idx)) b USING (conv_id, msg_idx)
    WHERE type = 'code' AND msg_idx > 0 AND len(string_split(text, {NL})) >= 40),
once AS (SELECT *, row_number() OVER (PARTITION BY conv_id, source, name ORDER BY part = 2, msg_idx, part, i) AS f FROM sourced WHERE name <> ''),
sized_artifacts AS (SELECT * EXCLUDE (f), row_number() OVER (PARTITION BY conv_id ORDER BY part = 2, msg_idx, part, i) AS ord, coalesce(nullif({language("name")}, ''), 'code') AS language, CASE WHEN content = '' THEN 0 ELSE len(string_split(content, {NL})) END AS loc FROM once WHERE f = 1),
bodies2 AS (SELECT *, regexp_replace(content, '^#!.*\\n', '') AS body FROM sized_artifacts),
commented AS (SELECT *, regexp_extract(body, '^\\s*"{{3}}((?s:.+?))"{{3}}', 1) AS doc, {O.ws("regexp_replace(regexp_extract(body, '^(?:#[^\\n]*\\n){1,5}'), '(?m)^#\\s?', '', 'g')")} AS hash5, {O.ws("regexp_replace(regexp_extract(body, '^(?:#[^\\n]*\\n){1,3}'), '(?m)^#\\s?', '', 'g')")} AS hash3,
  list_filter(list_transform(string_split(body, {NL}), lambda l: {O.ws("l")}), lambda l: l <> '' AND NOT regexp_matches(l, '^#{{1,6}}\\s'))[1] AS prose, {O.ws("regexp_replace(regexp_extract(body, '^\\s*\\/\\*+((?s:.+?))\\*\\/', 1), '(?m)^[\\s*]+', '', 'g')")} AS block, {O.ws("regexp_replace(regexp_extract(body, '^(?:\\/\\/[^\\n]*\\n){1,5}'), '(?m)^\\/\\/\\s?', '', 'g')")} AS slashes FROM bodies2),
chosen_comment AS (SELECT *, {collapse("CASE WHEN content = '' THEN '' WHEN language = 'python' THEN coalesce(nullif(doc, ''), hash5, '') WHEN language = 'markdown' THEN coalesce(prose, '') ELSE coalesce(nullif(block, ''), nullif(slashes, ''), CASE WHEN length(hash3) > 5 THEN hash3 END, '') END")} AS c FROM commented),
comments AS (SELECT *, {first_sentence("c")} AS comment, array_to_string(string_split(content, {NL})[1:50], {NL}) AS head FROM chosen_comment),
clued AS (SELECT *, list_filter([CASE WHEN content = '' THEN '' ELSE {_firsts("head", fixed.FRAMEWORKS)} END, {_firsts("name", fixed.ROLE_HINTS)}, coalesce('defines `' || nullif({_declaration("content")}, '') || '`', '')], lambda x: x <> '') AS clues, {O.ws("comment")} AS said FROM comments),
summaries AS (SELECT conv_id, ord, source, name AS display_name, CASE WHEN said <> '' AND NOT {O.like("said", fixed.CODE_LIKE_LEAD)} AND length(regexp_replace(said, '[^A-Za-z]', '', 'g')) * 2 >= length(said) THEN {cut(collapse(O.strip_urls("comment")), 110, 107)}
  WHEN len(clues) = 1 AND loc > 0 AND starts_with(clues[1], 'defines `') THEN {cut(collapse(_CAP_LANGUAGE + " || ' module, ' || clues[1] || ', ' || loc || ' LOC'"), 110, 107)} WHEN len(clues) > 0 THEN {cut(collapse("array_to_string(clues, ' ')"), 110, 107)}
  WHEN loc > 0 THEN {_CAP_LANGUAGE} || ' module, ' || loc || ' LOC' ELSE {_CAP_LANGUAGE} END AS description, language, loc, coalesce(size, length(content)) AS char_len, nullif(content, '') AS inline_content, source = 'inline-code' AND {O.like("name", fixed.ANONYMOUS_INLINE)} AS anonymous FROM clued),
artifact_lines AS (SELECT *, '- `' || display_name || '` - ' || description AS line FROM summaries),
artifact_costs AS (SELECT *, sum(length(line)) OVER (PARTITION BY conv_id, anonymous ORDER BY ord) AS cost FROM artifact_lines),
anonymous_kinds AS (SELECT conv_id, string_agg({_CAP_LANGUAGE} || ' ×' || k, ', ' ORDER BY k DESC, o) AS kinds FROM (SELECT conv_id, language, count(*) AS k, min(ord) AS o FROM summaries WHERE anonymous GROUP BY conv_id, language) GROUP BY conv_id),
artifact_totals AS (SELECT conv_id, count(*) AS n_all, sum(length(coalesce(inline_content, ''))) AS inline, string_agg(CASE WHEN inline_content IS NULL THEN line ELSE line || {NL} || {NL} || '```' || language || {NL} || inline_content || {NL} || '```' END, {NL} ORDER BY ord) AS everything,
  string_agg(line, {NL} ORDER BY ord) FILTER (WHERE NOT anonymous AND cost <= {fixed.ARTIFACTS_BUDGET}) AS told_lines, count(*) FILTER (WHERE NOT anonymous AND cost > {fixed.ARTIFACTS_BUDGET}) AS missing, count(*) FILTER (WHERE anonymous) AS nameless FROM artifact_costs GROUP BY conv_id),
artifact_sections AS (SELECT conv_id, '## Code artifacts in this conversation' || {NL} || CASE WHEN n_all <= 2 AND inline < {fixed.INLINE_ALL_BELOW} THEN everything
  ELSE concat_ws({NL}, told_lines, CASE WHEN missing > 0 THEN '- *(' || missing || ' more named artifact' || CASE WHEN missing = 1 THEN '' ELSE 's' END || ' not listed)*' END, CASE WHEN nameless > 0 THEN '- Plus ' || nameless || ' inline code block' || CASE WHEN nameless = 1 THEN '' ELSE 's' END || ' (' || kinds || ')' END) END AS section FROM artifact_totals LEFT JOIN anonymous_kinds USING (conv_id))"""

#: Artifacts of the turns and the exports together.
ARTIFACTS = f"""WITH RECURSIVE {PARSED},
art_messages AS (SELECT conv_id::VARCHAR AS conv_id, msg_idx, role FROM messages UNION ALL SELECT conv_id, msg_idx, role FROM export_messages),
art_blocks AS (SELECT conv_id::VARCHAR AS conv_id, msg_idx, block_idx, type, language, text, NULL::VARCHAR AS title FROM blocks UNION ALL SELECT conv_id, msg_idx, block_idx, type, language, text, title FROM export_blocks),
art_files AS (SELECT *, {classified("filename", "coalesce(mime, '')")} AS kind FROM export_files),{_DESCRIBED}"""


def _bullets(name: str, head: str, rows: str, cap: int, distinct: bool) -> str:
    """CTEs name_lines and name: (conv_id, t) of the rows of a condition on selected candidates."""
    once = "QUALIFY row_number() OVER (PARTITION BY conv_id, substr(lower(line), 1, 80) ORDER BY ord) = 1" if distinct else ""
    return f"""{name}_lines AS (SELECT conv_id, ord, line FROM marked WHERE {rows} {once}),
{name} AS (SELECT conv_id, '## {head}' || {NL} || string_agg('- ' || line, {NL} ORDER BY ord) AS t FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY ord) AS k FROM {name}_lines) WHERE k <= {cap} GROUP BY conv_id)"""


_TRIMMED = O.ws("text")
_SAID = f"kind NOT IN ('code', 'artifact') AND length({_TRIMMED}) >= 25 AND (kind = 'decision' OR {O.like(_TRIMMED, fixed.RECOMMENDATION)} OR role = 'assistant' AND {O.like(_TRIMMED, fixed.IMPERATIVE_LEAD)})"
_JOIN = f"{NL} || {NL}"


def _verb(out: str) -> str:
    return f"CASE WHEN {out} <= input_chars THEN 'Compressed ' ELSE 'Restructured ' END || format('{{:,}}', input_chars) || ' -> ' || format('{{:,}}', {out}) || ' chars'"


def _chars(n: str) -> str:
    kb = f"((({n})::BIGINT * 20 + 1024) // 2048)"
    return f"CASE WHEN {n} < 1024 THEN ({n}) || ' chars' ELSE ({kb} // 10) || '.' || ({kb} % 10) || ' KB' END"


def _document(out: str) -> str:
    meta = f"'**Source:** chatgpt | **Type:** ' || type || ' | **' || {_verb(out)} || '**'"
    ratio = f"CASE WHEN input_chars > 0 THEN (input_chars - {out}) / input_chars * 100 ELSE 0 END"
    size = f"{_chars('input_chars')} || ' -> ' || {_chars(out)} || CASE WHEN {ratio} > 90 THEN ' (' || printf('%.1f', {ratio}) || '% compression - significant detail loss expected)' WHEN {ratio} > 0 THEN ' (' || printf('%.1f', {ratio}) || '% compression)' ELSE '' END"
    handoff = f"""concat_ws({_JOIN}, '# ' || coalesce(CASE WHEN confidence <> 'low' THEN project_name END, 'Conversation Handoff'), {meta}, nullif(about, ''), state, coalesce('## Key decisions made' || {NL} || decided, '## Key decisions made' || {_JOIN} || '*No decisions explicitly stated in this conversation.*'), section, open_ends,
    '## Conversation metadata' || {NL} || '- ' || concat_ws(' | ', n_messages || ' messages', {size}) || {NL} || '- Source: ChatGPT', foot)"""
    other = lambda *names: f"concat_ws({_JOIN}, '# Conversation Handoff' || {_JOIN} || {meta}, context, goal, {', '.join(names)}, following, foot)"
    return f"CASE type WHEN 'writing' THEN {other('styled', 'drafted', 'keyed', 'wondered')} WHEN 'research' THEN {other('findings', 'wondered')} WHEN 'planning' THEN {other('keyed', 'weighed_up', 'wondered')} ELSE {handoff} END || {NL}"


RESUME = f"""WITH RECURSIVE {O.selected(fixed.BUDGET_CHARS["resume"])},{IDENTITY},{DECIDED},{SNIPPETS},{STEPS},{QUESTIONS},{PLAN},
art_messages AS (SELECT conv_id, msg_idx, role FROM messages), art_blocks AS (SELECT conv_id, msg_idx, block_idx, type, language, text, NULL::VARCHAR AS title FROM blocks),
art_files AS (SELECT 0 AS conv_id, 0 AS msg_idx, 0 AS i, '' AS filename, '' AS content, 0 AS size, '' AS kind WHERE false),{_DESCRIBED},
user_texts AS (SELECT conv_id, msg_idx, string_agg(text, ' ' ORDER BY block_idx) FILTER (WHERE type = 'text') AS t FROM blocks WHERE role = 'user' GROUP BY conv_id, msg_idx),
user_ends AS (SELECT conv_id, min_by(coalesce(t, ''), msg_idx) AS a, max_by(coalesce(t, ''), msg_idx) AS z FROM user_texts GROUP BY conv_id),
goals AS (SELECT conv_id, {O.sentences(collapse("a"))}[1:2] AS g, {O.sentences("z")}[1:2] AS l, z FROM user_ends),
marked AS (SELECT s.*, {"regexp_replace(" + collapse("text") + ", '^[-*]\\s*', '')"} AS line, coalesce({"regexp_replace(" + collapse("z") + ", '^[-*]\\s*', '')"}, '') AS last_line FROM (SELECT * FROM selected JOIN scored USING (conv_id, ord)) s LEFT JOIN user_ends USING (conv_id)),
{_bullets("keyed", "Key decisions", _SAID, 8, True)},
{_bullets("wondered", "Open questions", "kind = 'question' AND role = 'user' AND unanswered AND substr(lower(line), 1, 80) <> substr(lower(last_line), 1, 80)", 5, True)},
{_bullets("findings", "Findings", f"kind = 'sentence' AND role = 'assistant' AND ({O.like('text', fixed.SECTION_CITATION)} OR regexp_matches(text, '\\d'))", 10, False)},
{_bullets("weighed_up", "Tradeoffs", f"kind = 'sentence' AND {O.like('text', fixed.SECTION_TRADEOFF)}", 6, False)},
{_bullets("styled", "Style notes", f"kind = 'sentence' AND {O.like('text', fixed.SECTION_STYLE)}", 5, False)},
drafted AS (SELECT conv_id, '## Current draft' || {NL} || string_agg(text, ' ' ORDER BY sent_idx, ord) AS t FROM marked JOIN (SELECT conv_id, max(msg_idx) AS msg_idx FROM marked WHERE role = 'assistant' AND kind = 'sentence' GROUP BY conv_id) USING (conv_id, msg_idx) WHERE kind <> 'code' GROUP BY conv_id),
states AS (SELECT conv_id, '## Current state' || {_JOIN} || string_agg(CASE role WHEN 'user' THEN '**You:** ' ELSE '**Assistant:** ' END || text, {_JOIN} ORDER BY msg_idx) AS state FROM snippets WHERE text <> '' GROUP BY conv_id),
decided_lines AS (SELECT conv_id, string_agg('- ' || {cut(collapse("text"), 200, 197)}, {NL} ORDER BY i) AS decided FROM kept_decisions GROUP BY conv_id),
asked_lines AS (SELECT conv_id, string_agg('- ' || text, {NL} ORDER BY ord) AS asked FROM questions GROUP BY conv_id),
step_lines AS (SELECT conv_id, string_agg('- ' || text, {NL} ORDER BY position, msg_idx, i) AS step FROM steps GROUP BY conv_id),
plan_lines AS (SELECT conv_id, array_to_string(list_transform(plan, lambda p: '- ' || coalesce('**' || p.label || ':** ', '') || p.text), {NL}) AS planned FROM plan),
sums AS (SELECT conv_id, count(DISTINCT msg_idx) AS n_messages, sum(length(text))::BIGINT AS input_chars FROM blocks GROUP BY conv_id),
page AS (SELECT conv_id, type, n_messages, input_chars, project_name, confidence, concat_ws({NL}, CASE WHEN confidence <> 'low' AND project_line <> '' THEN '**Project:** ' || project_line END, CASE WHEN recent_focus_line <> '' AND recent_blocks >= 30 THEN '**Recent focus:** ' || recent_focus_line END) AS about, state, decided, section,
  concat_ws({NL}, '## Open questions / Next steps', CASE WHEN coalesce(asked, planned, step) IS NULL THEN {NL} || '*Not explicitly stated in recent messages.*' END, {NL} || '**Open questions:**' || {NL} || asked, {NL} || '**Next steps:**' || {NL} || coalesce(planned, step)) AS open_ends,
  CASE WHEN length(system_prompt) >= 60 THEN '## Context' || {NL} || system_prompt END AS context, CASE len(g) WHEN 1 THEN '## Goal' || {NL} || g[1] WHEN 2 THEN '## Goal' || {NL} || '- ' || g[1] || {NL} || '- ' || g[2] END AS goal,
  CASE WHEN {O.ws("coalesce(z, '')")} <> '' THEN '## Next steps' || {NL} || CASE WHEN len(l) > 0 THEN array_to_string(l, ' ') ELSE substr({O.ws("z")}, 1, 300) END END AS following,
  keyed.t AS keyed, wondered.t AS wondered, findings.t AS findings, weighed_up.t AS weighed_up, styled.t AS styled, drafted.t AS drafted, '---' || {NL} || '*Generated by Skein.*' AS foot
  FROM sums JOIN types USING (conv_id) LEFT JOIN identities USING (conv_id) LEFT JOIN states USING (conv_id) LEFT JOIN decided_lines USING (conv_id) LEFT JOIN artifact_sections USING (conv_id) LEFT JOIN asked_lines USING (conv_id) LEFT JOIN step_lines USING (conv_id) LEFT JOIN plan_lines USING (conv_id)
  LEFT JOIN prompts USING (conv_id) LEFT JOIN goals USING (conv_id) LEFT JOIN keyed USING (conv_id) LEFT JOIN wondered USING (conv_id) LEFT JOIN findings USING (conv_id) LEFT JOIN weighed_up USING (conv_id) LEFT JOIN styled USING (conv_id) LEFT JOIN drafted USING (conv_id)),
drafts AS (SELECT *, length({_document("0")}) AS provisional FROM page),
left_out AS (SELECT conv_id, count(*) FILTER (WHERE (conv_id, msg_idx) NOT IN (SELECT (conv_id, msg_idx) FROM marked)) AS dropped_messages FROM messages GROUP BY conv_id)
SELECT conv_id, 'resume' AS level, markdown, type, input_chars, length(markdown)::INTEGER AS output_chars, {fixed.BUDGET_CHARS["resume"]}::DOUBLE AS budget_chars, dropped_messages, 0::BIGINT AS dropped_attachments FROM (SELECT *, {_document("provisional")} AS markdown FROM drafts) JOIN left_out USING (conv_id)"""

_STOP = ", ".join(map(O.q, fixed.STOPWORDS))
#: The walk over sentences as a recursion: each step's scores in one list for a text, until they move less than the tolerance.
TEXTRANK = f"""WITH RECURSIVE {O.TURNS},
said AS (SELECT conv_id || '-' || turn AS id, {O.sentences("text")} AS ss FROM turns),
ranked_sentences AS (SELECT id, len(ss) AS n, u.i, u.s, list_filter(string_split_regex(regexp_replace(lower(u.s), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP})) AS ws FROM said, LATERAL (SELECT unnest(ss) AS s, unnest(range(1, len(ss) + 1)) AS i) u),
uses AS (SELECT id, n, i, term, count(*) AS tf FROM (SELECT id, n, i, unnest(ws) AS term FROM ranked_sentences) GROUP BY ALL),
loads AS (SELECT id, i, term, tf * (ln(n / (1 + count(*) OVER (PARTITION BY id, term))) + 1) AS w FROM uses),
norms AS (SELECT id, i, sqrt(sum(w * w)) AS l FROM loads GROUP BY id, i),
unit AS (SELECT id, i, term, CASE WHEN l > 0 THEN w / l ELSE 0 END AS w FROM loads JOIN norms USING (id, i)),
near AS (SELECT a.id, a.i, b.i AS j, sum(a.w * b.w) AS s FROM unit a JOIN unit b ON a.id = b.id AND a.term = b.term AND a.i <> b.i GROUP BY ALL),
shares AS (SELECT id, i, j, s / nullif(sum(s) OVER (PARTITION BY id, i), 0) AS p FROM near),
into_list AS (SELECT id, j, list({{'i': i, 'p': coalesce(p, 0)}} ORDER BY i) AS ps FROM shares GROUP BY id, j),
into_all AS (SELECT r.id, any_value(n) AS n, list(coalesce(ps, []) ORDER BY r.i) AS ps FROM ranked_sentences r LEFT JOIN into_list l ON l.id = r.id AND l.j = r.i GROUP BY r.id),
steps(id, k, scores, delta) AS (
  SELECT id, 0, list_transform(range(n), lambda x: 1.0::DOUBLE), 1e9::DOUBLE FROM into_all
  UNION ALL
  SELECT id, k + 1, following, list_sum(list_transform(range(1, len(scores) + 1), lambda x: abs(following[x] - scores[x]))) FROM (
    SELECT s.id, s.k, s.scores, list_transform(a.ps, lambda ps: {1 - fixed.DAMPING} + {fixed.DAMPING} * coalesce(list_sum(list_transform(ps, lambda x: s.scores[x.i] * x.p)), 0)) AS following FROM steps s JOIN into_all a USING (id) WHERE s.k < {fixed.MAX_ITERATIONS} AND s.delta >= {fixed.TOLERANCE} AND a.n > 1)),
final AS (SELECT id, max_by(scores, k) AS scores FROM steps GROUP BY id),
best AS (SELECT r.id, r.i, r.s, row_number() OVER (PARTITION BY r.id ORDER BY round(scores[r.i], 9) DESC, r.i) AS k FROM ranked_sentences r JOIN final USING (id))
SELECT id AS message_id, string_agg(s, ' ' ORDER BY i) AS summary FROM best WHERE k <= 3 GROUP BY id"""
