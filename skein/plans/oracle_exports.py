"""SQL counterparts of the queries over exports: the same JSON texts, taken apart with DuckDB's JSON functions."""

from __future__ import annotations

from ..functions import fixed
from . import seeds
from .oracle import BLOCKS, q, ws

_FENCE = "'```([\\w-]*)\\n?((?s:.*?))```'"
_NL = "chr(10)"


def _kind(j: str) -> str:
    return f"CASE WHEN json_type({j}, '$.mapping') IN ('OBJECT', 'ARRAY') THEN 'chatgpt' WHEN json_type({j}, '$.chat_messages') = 'ARRAY' THEN 'claude' END"


def _ms(j: str, *names: str) -> str:
    """Milliseconds of the first number that is there; numbers below 1e12 are seconds."""
    x = "coalesce(" + ", ".join(f"({j}->>'$.{n}')::DOUBLE" for n in names) + ")"
    return f"CASE WHEN {x} < 1e12 THEN ({x} * 1000)::BIGINT ELSE {x}::BIGINT END"


def _time(x: str) -> str:
    return f"epoch_ms(try_cast({x} AS TIMESTAMPTZ))"


#: The conversations of the table as exports, one file each: odd ids in the one format, even ids in the other.
_MADE = f"""
  SELECT 'list-' || conv_id, '{{"uuid":"c' || conv_id || '","name":"Talk ' || conv_id || '","created_at":"2024-01-02T03:04:05Z","updated_at":"2023-02-0' || (1 + conv_id % 9) || 'T00:00:00Z","chat_messages":['
    || string_agg(to_json({{'uuid': 'm' || turn, 'sender': CASE role WHEN 'user' THEN 'human' ELSE role END, 'content': [{{'type': 'text', 'text': text}}]}})::VARCHAR, ',' ORDER BY turn) || ']}}' FROM numbered WHERE conv_id % 2 = 1 GROUP BY conv_id
  UNION ALL
  SELECT 'tree-' || conv_id, '{{"title":"Talk ' || conv_id || '","conversation_id":"c' || conv_id || '","create_time":' || (1600000000 + conv_id % 1000) || ',"mapping":{{'
    || string_agg('"n' || turn || '":' || to_json({{'parent': 'n' || before, 'children': CASE WHEN after IS NULL THEN []::VARCHAR[] ELSE ['n' || after] END,
       'message': {{'id': 'm' || turn, 'author': {{'role': role}}, 'content': {{'content_type': 'text', 'parts': [text]}}}}}})::VARCHAR, ',' ORDER BY turn) || '}}}}' FROM numbered WHERE conv_id % 2 = 0 GROUP BY conv_id"""

_TEXTS = "list_filter(list_transform(json_extract({c}, '$.parts[*]'), lambda p: CASE WHEN json_type(p) = 'VARCHAR' THEN p->>'$' WHEN json_type(p, '$.text') = 'VARCHAR' THEN p->>'$.text' ELSE '' END), lambda t: t <> '')"
_JOINED = f"array_to_string({_TEXTS.format(c='c')}, {_NL})"
_SUMMARY = "array_to_string(list_transform(json_keys(b, '$.input')[1:3], lambda k: k || '=' || substr(coalesce(json_extract_string(b, '$.input.\"' || k || '\"'), 'null'), 1, 40)), ', ')"


RAWS = f"""{BLOCKS},
numbered AS (SELECT *, lag(turn) OVER w AS before, lead(turn) OVER w AS after FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
raws(file, raw) AS (SELECT * FROM (VALUES {seeds.values(seeds.EXPORTS)}) v(file, raw) UNION ALL {_MADE}),
listed AS (SELECT file, json_valid(raw) AS ok, CASE WHEN NOT json_valid(raw) THEN [] WHEN json_type(raw) = 'ARRAY' THEN json_extract(raw, '$[*]') WHEN json_type(raw) <> 'OBJECT' THEN [] WHEN {_kind("raw")} IS NOT NULL THEN [raw::JSON]
  WHEN json_type(raw, '$.conversations') = 'ARRAY' THEN json_extract(raw, '$.conversations[*]') ELSE [] END AS js FROM raws),
formats AS (SELECT file, js, ok, coalesce({_kind("js[1]")}, 'unknown') AS format FROM listed),
found AS (SELECT file, format, u.n, u.j FROM formats, LATERAL (SELECT unnest(js) AS j, unnest(range(len(js))) AS n) u),
every AS (SELECT file, n, format, j, CASE format WHEN 'chatgpt' THEN coalesce(j->>'$.conversation_id', j->>'$.id') ELSE j->>'$.uuid' END AS given,
  CASE format WHEN 'chatgpt' THEN 'chatgpt-' || substr(coalesce(j->>'$.title', 'untitled'), 1, 16) ELSE 'claude-' || substr(coalesce(j->>'$.name', 'untitled'), 1, 16) END AS made,
  CASE format WHEN 'chatgpt' THEN {_ms("j", "update_time", "create_time")} ELSE {_time("coalesce(j->>'$.updated_at', j->>'$.created_at')")} END AS changed,
  CASE format WHEN 'chatgpt' THEN {_ms("j", "create_time")} ELSE {_time("j->>'$.created_at'")} END AS created,
  nullif({ws("coalesce(CASE format WHEN 'chatgpt' THEN j->>'$.title' ELSE j->>'$.name' END, '')")}, '') AS title FROM found WHERE {_kind("j")} = format),
ranked AS (SELECT *, coalesce(given, made) AS id, row_number() OVER (PARTITION BY coalesce(given, made) ORDER BY given IS NULL, changed DESC NULLS LAST, file, n) AS r FROM every),
convs AS (SELECT * EXCLUDE (r, id), CASE WHEN r = 1 THEN id ELSE id || '-' || r END AS conv_id FROM ranked WHERE r = 1 OR given IS NULL)"""

PARSED = f"""{RAWS},
nodes AS (SELECT c.conv_id, e.key, row_number() OVER (PARTITION BY c.conv_id ORDER BY e.id) AS spot, e.value->>'$.parent' AS parent, e.value->'$.message' AS m, coalesce(json_array_length(e.value, '$.children'), 0) AS below FROM convs c, json_each(c.j, '$.mapping') e WHERE c.format = 'chatgpt'),
starts AS (SELECT c.conv_id, CASE WHEN coalesce(c.j->>'$.current_node', '') <> '' THEN c.j->>'$.current_node' ELSE coalesce((SELECT min_by(key, spot) FROM nodes x WHERE x.conv_id = c.conv_id AND below = 0 AND json_type(m) = 'OBJECT'), (SELECT max_by(key, spot) FROM nodes x WHERE x.conv_id = c.conv_id)) END AS key FROM convs c WHERE format = 'chatgpt'),
walk(conv_id, key, depth, seen) AS (SELECT s.conv_id, s.key, 0, [s.key] FROM starts s JOIN nodes USING (conv_id, key)
  UNION ALL SELECT w.conv_id, n.parent, depth + 1, list_append(seen, n.parent) FROM walk w JOIN nodes n USING (conv_id, key) JOIN nodes p ON p.conv_id = n.conv_id AND p.key = n.parent WHERE NOT list_contains(seen, n.parent)),
tree AS (SELECT conv_id, -depth AS pos, coalesce(m->>'$.id', key) AS message_id, m->>'$.author.role' AS role, m->'$.content' AS c, {_ms("m", "create_time")} AS created FROM walk JOIN nodes USING (conv_id, key) WHERE json_type(m) = 'OBJECT'),
flat AS (SELECT c.conv_id, u.pos, u.m, coalesce(u.m->>'$.uuid', c.conv_id || '-' || u.pos) AS message_id, CASE u.m->>'$.sender' WHEN 'human' THEN 'user' ELSE u.m->>'$.sender' END AS role, {_time("u.m->>'$.created_at'")} AS created
  FROM (SELECT conv_id, json_extract(j, '$.chat_messages[*]') AS ms FROM convs WHERE format = 'claude') c, LATERAL (SELECT unnest(c.ms) AS m, unnest(range(len(c.ms))) AS pos) u),
contents AS (SELECT conv_id, pos, u.b, u.bi FROM (SELECT conv_id, pos, json_extract(m, '$.content[*]') AS bs FROM flat WHERE json_type(m, '$.content') = 'ARRAY') f, LATERAL (SELECT unnest(f.bs) AS b, unnest(range(len(f.bs))) AS bi) u),
pieces AS (
  SELECT conv_id, pos, 0 AS bi, CASE WHEN coalesce(c->>'$.content_type', 'text') = 'text' THEN 'split' WHEN c->>'$.content_type' = 'code' THEN 'code' WHEN c->>'$.content_type' = 'multimodal_text' THEN 'text' ELSE 'split' END AS kind,
    CASE WHEN coalesce(c->>'$.content_type', 'text') = 'text' THEN {_JOINED} WHEN c->>'$.content_type' = 'multimodal_text' THEN {ws("regexp_replace(replace(" + _JOINED + ", chr(13) || chr(10), chr(10)), '[ \\t]+', ' ', 'g')")} ELSE coalesce(c->>'$.text', {_JOINED}) END AS text,
    c->>'$.language' AS language, NULL::VARCHAR AS artifact_id, NULL::VARCHAR AS title, NULL::VARCHAR AS tool_name, NULL::VARCHAR AS summary FROM tree WHERE json_type(c) = 'OBJECT'
  UNION ALL SELECT conv_id, pos, 0, 'text', m->>'$.content', NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM flat WHERE json_type(m, '$.content') = 'VARCHAR'
  UNION ALL SELECT conv_id, pos, 0, 'text', m->>'$.text', NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM flat WHERE coalesce(json_type(m, '$.content'), 'NULL') <> 'ARRAY' AND {ws("coalesce(m->>'$.content', '')")} = ''
  UNION ALL SELECT conv_id, pos, bi, CASE WHEN b->>'$.type' = 'text' THEN 'split' WHEN b->>'$.type' = 'tool_use' AND b->>'$.name' IN ({", ".join(map(q, fixed.ARTIFACT_TOOLS))}) THEN 'artifact' ELSE b->>'$.type' END,
    CASE b->>'$.type' WHEN 'text' THEN b->>'$.text' WHEN 'tool_use' THEN coalesce(b->>'$.input.content', '') END, b->>'$.input.language', coalesce(b->>'$.input.id', 'artifact'), coalesce(b->>'$.input.title', b->>'$.input.id', 'artifact'), b->>'$.name',
    CASE b->>'$.type' WHEN 'tool_use' THEN coalesce({_SUMMARY}, '') WHEN 'tool_result' THEN substr(coalesce(b->>'$.content', '""'), 1, 200) END FROM contents WHERE b->>'$.type' IN ('text', 'tool_result') OR b->>'$.type' = 'tool_use' AND coalesce(b->>'$.name', '') <> ''),
filled AS (SELECT * FROM pieces WHERE kind NOT IN ('split', 'text', 'code') OR {ws("text")} <> ''),
fenced AS (SELECT p.*, u.part, u.o FROM (SELECT *, CASE WHEN kind = 'split' THEN string_split(regexp_replace(text, {_FENCE}, chr(29) || chr(31) || '\\1' || chr(28) || '\\2' || chr(29), 'g'), chr(29)) ELSE [coalesce(text, '')] END AS ps FROM filled) p, LATERAL (SELECT unnest(p.ps) AS part, unnest(range(len(p.ps))) AS o) u WHERE kind <> 'split' OR starts_with(u.part, chr(31)) OR {ws("u.part")} <> ''),
made_blocks AS (SELECT conv_id, pos, bi, o, CASE WHEN kind <> 'split' THEN kind WHEN starts_with(part, chr(31)) THEN 'code' ELSE 'text' END AS type,
  CASE WHEN kind = 'split' THEN CASE WHEN starts_with(part, chr(31)) THEN nullif(string_split(part[2:], chr(28))[1], '') END WHEN kind IN ('code', 'artifact') THEN language END AS language,
  CASE WHEN kind IN ('tool_use', 'tool_result') THEN NULL WHEN kind <> 'split' THEN text WHEN starts_with(part, chr(31)) THEN regexp_replace(string_split(part, chr(28))[2], '\\n$', '') ELSE {ws("part")} END AS text,
  CASE kind WHEN 'artifact' THEN artifact_id END AS artifact_id, CASE kind WHEN 'artifact' THEN title END AS title, CASE kind WHEN 'tool_use' THEN tool_name END AS tool_name, CASE WHEN kind IN ('tool_use', 'tool_result') THEN summary END AS summary FROM fenced),
versioned AS (SELECT *, CASE type WHEN 'artifact' THEN row_number() OVER (PARTITION BY conv_id, type, artifact_id ORDER BY pos, bi, o) END AS version, count(*) OVER (PARTITION BY conv_id, type, artifact_id) AS top FROM made_blocks),
all_roles AS (SELECT conv_id, pos, message_id, role, created FROM tree UNION ALL SELECT conv_id, pos, message_id, role, created FROM flat),
named_files AS (SELECT conv_id, pos, 0 AS part, i, a FROM (SELECT conv_id, pos, json_extract(m, '$.attachments[*]') AS xs FROM flat) f, LATERAL (SELECT unnest(f.xs) AS a, unnest(range(len(f.xs))) AS i) u
  UNION ALL SELECT conv_id, pos, 1, i, a FROM (SELECT conv_id, pos, json_extract(m, '$.files[*]') AS xs FROM flat) f, LATERAL (SELECT unnest(f.xs) AS a, unnest(range(len(f.xs))) AS i) u),
typed_files AS (SELECT conv_id, pos, row_number() OVER (PARTITION BY conv_id, pos ORDER BY part, i) - 1 AS i, coalesce(a->>'$.file_name', CASE part WHEN 0 THEN 'attachment' ELSE 'file' END) AS filename, a->>'$.file_type' AS mime, (a->>'$.file_size')::BIGINT AS size, a->>'$.extracted_content' AS content FROM named_files
  UNION ALL SELECT conv_id, pos, u.i - 1, coalesce(u.p->>'$.metadata.filename', 'image_' || u.i), 'image/*', (u.p->>'$.size_bytes')::BIGINT, NULL::VARCHAR
    FROM (SELECT conv_id, pos, list_filter(json_extract(c, '$.parts[*]'), lambda p: coalesce(p->>'$.content_type' = 'image_asset_pointer', false) OR p->>'$.asset_pointer' IS NOT NULL) AS ps FROM tree WHERE c->>'$.content_type' = 'multimodal_text') t, LATERAL (SELECT unnest(t.ps) AS p, unnest(range(1, len(t.ps) + 1)) AS i) u),
spoken AS (SELECT r.*, c.format, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS rn FROM all_roles r JOIN convs c USING (conv_id) WHERE role IN ('user', 'assistant', 'system', 'tool')
  AND ((conv_id, pos) IN (SELECT (conv_id, pos) FROM versioned) OR (conv_id, pos) IN (SELECT (conv_id, pos) FROM typed_files))),
export_messages AS (SELECT conv_id, pos, message_id, role, created, row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS msg_idx FROM spoken WHERE NOT (format = 'chatgpt' AND rn = 1 AND role = 'system')),
export_blocks AS (SELECT conv_id, msg_idx, message_id, role, row_number() OVER (PARTITION BY conv_id, msg_idx ORDER BY bi, o) - 1 AS block_idx, type, language, text, artifact_id, title, version, tool_name, summary FROM versioned JOIN export_messages USING (conv_id, pos) WHERE type <> 'artifact' OR version = top),
export_files AS (SELECT conv_id, msg_idx, i, filename, mime, size, content FROM typed_files JOIN export_messages USING (conv_id, pos))"""
PARSED_WITH = f"WITH RECURSIVE {PARSED}"
