"""The registered queries of the engine and their SQL counterparts.

Queries run over the whole conversations table plus the seed rows; those over exports read the table's conversations as exports, plus
the seed exports.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import attachments as A
from ..functions import fixed
from ..functions import text as T
from ..functions.stages import stage
from ..operators import artifacts, classify, decisions, identity, recency, textrank
from ..operators import candidates as C
from ..operators import messages as M
from ..sources import exports, share, tables
from . import oracle as O
from . import oracle_documents as D
from . import oracle_exports as X
from . import seeds
from .compress import compress, types_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def corpus(spark: SparkSession, sf_dir: str) -> tables.Corpus:
    return tables.from_turns(seeds.turns(spark, sf_dir))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).messages


def _plain_corpus(spark: SparkSession, sf_dir: str) -> tables.Corpus:
    """corpus() with its messages' plain texts written once, for queries that read them several times."""
    c = corpus(spark, sf_dir)
    return tables.Corpus(c.conversations, stage(M.with_plain(c.messages), "messages"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.extract(_messages(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return C.score(stage(C.extract(c.messages), "candidates"), types_of(c))


# Messages and blocks


@query(f"WITH {O.TURNS} SELECT conv_id, count(*) FILTER (WHERE role <> 'system') AS message_count, min(turn) AS first_turn FROM turns GROUP BY conv_id")
def list_conversations(spark, sf_dir):
    return seeds.turns(spark, sf_dir).groupBy("conv_id").agg(F.count_if(F.col("role") != "system").alias("message_count"), F.min("turn").alias("first_turn"))


@query(f"WITH {O.MESSAGES} SELECT conv_id, msg_idx, message_id, role FROM messages")
def normalize_messages(spark, sf_dir):
    return _messages(spark, sf_dir).select("conv_id", F.col("msg_idx").cast("long").alias("msg_idx"), "message_id", "role")


@query(f"WITH {O.MESSAGES} SELECT conv_id, system_prompt FROM prompts")
def lift_system_prompt(spark, sf_dir):
    return corpus(spark, sf_dir).conversations.filter("system_prompt IS NOT NULL").select("conv_id", "system_prompt")


@query(f"WITH {O.BLOCKS} SELECT conv_id, msg_idx, block_idx, type, language, text FROM blocks")
def split_code_blocks(spark, sf_dir):
    return M.blocks(_messages(spark, sf_dir)).select("conv_id", F.col("msg_idx").cast("long").alias("msg_idx"), F.col("block_idx").cast("long").alias("block_idx"), "type", "language", "text")


@query(f"WITH {O.SAID} SELECT conv_id, msg_idx, unanswered, last_user, last_assistant FROM context")
def unanswered_messages(spark, sf_dir):
    return M.with_context(_messages(spark, sf_dir)).select("conv_id", F.col("msg_idx").cast("long").alias("msg_idx"), "unanswered", "last_user", "last_assistant")


@query(f"WITH {O.MESSAGES} SELECT conv_id, max_by(message_id, CASE WHEN role = 'user' THEN msg_idx END) FILTER (WHERE role = 'user') AS last_user_id, max_by(message_id, msg_idx) FILTER (WHERE role = 'assistant') AS last_assistant_id FROM messages GROUP BY conv_id")
def last_message_by_role(spark, sf_dir):
    return M.last_by_role(_messages(spark, sf_dir))


@query(f"WITH {O.BLOCKS} SELECT conv_id, sum(length(text))::BIGINT AS input_chars FROM blocks GROUP BY conv_id")
def input_chars(spark, sf_dir):
    return M.input_chars(_messages(spark, sf_dir))


# Text functions


@query(f"WITH {O.TURNS}, s AS (SELECT conv_id, turn, {O.sentences('text')} AS ss FROM turns) SELECT s.conv_id, s.turn, u.i, u.sentence FROM s, LATERAL (SELECT unnest(ss) AS sentence, unnest(range(len(ss))) AS i) u")
def split_sentences(spark, sf_dir):
    return seeds.turns(spark, sf_dir).select("conv_id", "turn", F.posexplode(T.sentences(F.col("text"))).alias("i", "sentence")).withColumn("i", F.col("i").cast("long"))


@query(f"WITH {O.TURNS} SELECT conv_id, turn, {O.strip_markdown('text')} AS text FROM turns")
def strip_markdown(spark, sf_dir):
    return seeds.turns(spark, sf_dir).select("conv_id", "turn", T.strip_markdown(F.col("text")).alias("text"))


@query(f"WITH {O.TURNS} SELECT conv_id, turn, {O.asciiize('text')} AS ascii, {O.strip_urls('text')} AS unlinked, {O.key('text')} AS dedupe_key FROM turns")
def rewrite_text(spark, sf_dir):
    t = F.col("text")
    return seeds.turns(spark, sf_dir).select("conv_id", "turn", T.asciiize(t).alias("ascii"), T.strip_urls(t).alias("unlinked"), T.key(t).alias("dedupe_key"))


@query(f"""WITH {O.TURNS} SELECT conv_id, turn, ceil(length(text) / 4)::INTEGER AS tokens, (CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END)::INTEGER AS lines, {O.header('text')} AS header,
  round(coalesce(list_sum(list_transform(regexp_extract_all(text, 'https?://\\S+'), lambda u: length(u))), 0) / length(text), 9) AS url_ratio,
  coalesce(nullif(substr(regexp_replace({O.ws("regexp_replace(lower(text), '[^a-z0-9\\s-]', '', 'g')")}, '\\s+', '-', 'g'), 1, 60), ''), 'conversation') AS slug FROM turns""")
def measure_text(spark, sf_dir):
    t = F.col("text")
    return seeds.turns(spark, sf_dir).select("conv_id", "turn", T.tokens_estimate(t).alias("tokens"), T.lines(t).alias("lines"), T.looks_like_header(t).alias("header"), F.round(T.url_ratio(t), 9).alias("url_ratio"), T.slugify(t).alias("slug"))


@query(f"""WITH {O.TURNS} SELECT conv_id, turn, regexp_replace(regexp_replace('```py' || chr(10) || text || chr(10) || '```', '^```[\\w-]*\\n?', ''), '\\n?```\\s*$', '') AS unfenced, array_to_string(string_split(text, chr(10))[1:2], chr(10)) AS two_lines, len(string_split(text, chr(10))) > 2 AS cut,
  CASE WHEN length(text) <= 60 THEN text ELSE regexp_replace(substr(text, 1, 57), '\\s\\S*$', '') || '...' END AS short, regexp_replace({O.ws("regexp_replace(text, '\\s+', ' ', 'g')")}, '^[-*]\\s*', '') AS bullet,
  contains(lower(text), 'the') AS found, CASE WHEN regexp_matches(c, '^[^.!?\\n]{{8,180}}') THEN {O.ws("regexp_extract(c, '^[^.!?\\n]{8,180}[.!?]?')")} ELSE {O.ws("substr(c, 1, 120)")} END AS first_sentence
  FROM (SELECT *, {O.ws("regexp_replace(text, '\\s+', ' ', 'g')")} AS c FROM turns)""")
def shorten_text(spark, sf_dir):
    t = F.col("text")
    two = T.truncate_lines(t, 2)
    return seeds.turns(spark, sf_dir).select(
        "conv_id", "turn", T.strip_code_fences(F.concat(F.lit("```py\n"), t, F.lit("\n```"))).alias("unfenced"), two["text"].alias("two_lines"), two["truncated"].alias("cut"),
        T.cut_words(t, 60, 57).alias("short"), T.bullet(t).alias("bullet"), F.contains(F.lower(t), F.lit("the")).alias("found"), T.first_sentence(t).alias("first_sentence"),
    )


# Classification, candidates, scores


@query(f"WITH {O.SIGNALS} SELECT conv_id, {', '.join(f'round({n}, 9) AS {n}' for n in ('code_ratio', 'avg_user_len', 'question_density', *fixed.SIGNALS))} FROM signals")
def classify_signals(spark, sf_dir):
    return classify.signals(_messages(spark, sf_dir)).select("conv_id", *(F.round(n, 9).alias(n) for n in ("code_ratio", "avg_user_len", "question_density", *fixed.SIGNALS)))


@query(f"WITH {O.SIGNALS}, {O.TYPED} SELECT conv_id, type, round(CASE WHEN top = 0 THEN 0 ELSE (top - second) / top END, 6) AS confidence, {', '.join(f'round({k}, 6) AS score_{k}' for k in classify.TYPES)} FROM types JOIN scores USING (conv_id)")
def classify_conversations(spark, sf_dir):
    return classify.classify(_messages(spark, sf_dir)).select("conv_id", "type", F.round("confidence", 6).alias("confidence"), *(F.round(f"score_{k}", 6).alias(f"score_{k}") for k in classify.TYPES))


@query(f"WITH {O.SAID} SELECT conv_id, ord, msg_idx, block_idx, sent_idx, message_id, role, kind, text, char_len, round(position, 9) AS position FROM candidates")
def extract_candidates(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    return c.select("conv_id", *(F.col(n).cast("long").alias(n) for n in ("ord", "msg_idx", "block_idx", "sent_idx", "char_len")), "message_id", "role", "kind", "text", F.round("position", 9).alias("position"))


@query(f"WITH {O.TERMS} SELECT conv_id, ord, term, tf, round(idf, 9) AS idf, round(tf * idf, 9) AS tfidf FROM stats")
def tfidf_terms(spark, sf_dir):
    return C.term_stats(_candidates(spark, sf_dir)).select("conv_id", F.col("ord").cast("long").alias("ord"), "term", "tf", F.round("idf", 9).alias("idf"), F.round("tfidf", 9).alias("tfidf"))


@query(f"WITH {O.TERMS} SELECT conv_id, ord, round(tfidf_score, 6) AS tfidf_score FROM tfidf")
def tfidf_scores(spark, sf_dir):
    return C.term_scores(_candidates(spark, sf_dir)).select("conv_id", F.col("ord").cast("long").alias("ord"), F.round("tfidf_score", 6).alias("tfidf_score"))


@query(f"WITH {O.SCORED} SELECT conv_id, ord, kind, type, round(score, 6) AS score, always_keep FROM scored")
def score_candidates(spark, sf_dir):
    return _scored(spark, sf_dir).select("conv_id", F.col("ord").cast("long").alias("ord"), "kind", "type", F.round("score", 6).alias("score"), "always_keep")


@query(f"""WITH {O.SCORED}, kept AS (SELECT conv_id, ord, row_number() OVER w AS r, sum(char_len) OVER (w ROWS UNBOUNDED PRECEDING) AS cost FROM scored WHERE always_keep WINDOW w AS (PARTITION BY conv_id ORDER BY score DESC, ord))
SELECT conv_id, ord, r AS keep_rank FROM kept WHERE cost <= 2250 OR r = 1""")
def always_keep_prefix(spark, sf_dir):
    ranked = C.rank(_scored(spark, sf_dir), fixed.BUDGET_CHARS["resume"])
    return ranked.filter("first_pick").select("conv_id", F.col("ord").cast("long").alias("ord"), F.col("keep_rank").cast("long").alias("keep_rank"))


@query(f"WITH RECURSIVE {O.selected(fixed.BUDGET_CHARS['resume'])} SELECT conv_id, ord, message_id, role, kind, text, char_len, round(score, 6) AS score, always_keep FROM selected JOIN scored USING (conv_id, ord)")
def select_candidates(spark, sf_dir):
    out = C.select(stage(_scored(spark, sf_dir), "scored"), fixed.BUDGET_CHARS["resume"])
    return out.select("conv_id", F.col("ord").cast("long").alias("ord"), "message_id", "role", "kind", "text", F.col("char_len").cast("long").alias("char_len"), F.round("score", 6).alias("score"), "always_keep")


@query(f"WITH RECURSIVE {O.selected(fixed.BUDGET_CHARS['tldr'])} SELECT conv_id, count(*) FILTER (WHERE (conv_id, msg_idx) NOT IN (SELECT (conv_id, msg_idx) FROM selected JOIN scored USING (conv_id, ord))) AS dropped_messages FROM messages GROUP BY conv_id")
def dropped_messages(spark, sf_dir):
    c = corpus(spark, sf_dir)
    scored = stage(C.score(C.extract(c.messages), types_of(c)), "scored")
    return C.dropped_messages(c.messages, C.select(scored, fixed.BUDGET_CHARS["tldr"]))


# Identity, decisions, recency, artifacts

@query(f"WITH {O.BLOCKS},{D.WORDS} SELECT conv_id, class, term, count, messages, round(spread, 9) AS spread, round(weight, 9) AS weight FROM weighed")
def identity_terms(spark, sf_dir):
    return identity.all_terms(_messages(spark, sf_dir)).select("conv_id", "class", "term", "count", "messages", F.round("spread", 9).alias("spread"), F.round("weight", 9).alias("weight"))


@query(f"WITH {O.BLOCKS},{D.TOP} SELECT conv_id, rank, term FROM top WHERE rank <= 12")
def identity_top_terms(spark, sf_dir):
    return identity.top_terms(identity.all_terms(_messages(spark, sf_dir))).select("conv_id", F.col("rank").cast("long").alias("rank"), "term")


@query(f"""WITH {O.BLOCKS},{D.TOP}, names AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY weight DESC, seen) AS r FROM weighed WHERE class = 0 AND spread >= 0.02)
SELECT conv_id, term AS project_name, CASE WHEN term IS NULL THEN 'low' WHEN count >= 10 AND messages >= 5 THEN 'high' WHEN count >= 4 AND messages >= 3 THEN 'medium' ELSE 'low' END AS confidence
  FROM (SELECT DISTINCT conv_id FROM known_ids) LEFT JOIN (SELECT * FROM names WHERE r = 1) USING (conv_id)""".replace("known_ids", "turns WHERE role IN ('user', 'assistant', 'system', 'tool')"))
def project_name(spark, sf_dir):
    c = _plain_corpus(spark, sf_dir)
    return identity.identity(c.conversations, c.messages).select("conv_id", "project_name", "confidence")


@query(f"WITH {O.BLOCKS},{D.IDENTITY} SELECT conv_id, project_name, project_line, confidence, recent_focus_line, recent_blocks FROM identities")
def project_identity(spark, sf_dir):
    c = _plain_corpus(spark, sf_dir)
    out = identity.identity(c.conversations, c.messages)
    return out.select("conv_id", "project_name", "project_line", "confidence", "recent_focus_line", F.col("recent_blocks").cast("long").alias("recent_blocks"))


@query(f"WITH {O.BLOCKS},{D.TOP},{D.FOUND} SELECT conv_id, msg_idx, text, round(position, 9) AS position, round(strength, 9) AS strength, ord FROM decisions")
def decision_sentences(spark, sf_dir):
    c = _plain_corpus(spark, sf_dir)
    found = decisions.find(c.messages, identity.familiar(c.messages))
    return found.select("conv_id", F.col("msg_idx").cast("long").alias("msg_idx"), "text", F.round("position", 9).alias("position"), F.round("strength", 9).alias("strength"), F.col("ord").cast("long").alias("ord"))


@query(f"WITH {O.BLOCKS},{D.TOP},{D.DECIDED} SELECT conv_id, i, round(position, 9) AS position, round(strength, 9) AS strength, text, message_id FROM kept_decisions")
def extract_decisions(spark, sf_dir):
    c = _plain_corpus(spark, sf_dir)
    out = decisions.extract(c.messages, identity.familiar(c.messages)).select("conv_id", F.posexplode("decisions").alias("i", "d"))
    return out.select("conv_id", F.col("i").cast("long").alias("i"), F.round("d.position", 9).alias("position"), F.round("d.strength", 9).alias("strength"), "d.text", "d.message_id")


@query(f"WITH {O.BLOCKS},{D.TOP},{D.SNIPPETS} SELECT conv_id, msg_idx, role, text, had_code FROM snippets")
def recent_snippets(spark, sf_dir):
    c = _plain_corpus(spark, sf_dir)
    out = recency.snippets(c.messages, identity.familiar(c.messages))
    return out.select("conv_id", F.col("msg_idx").cast("long").alias("msg_idx"), "role", "text", "had_code")


@query(f"""WITH {O.BLOCKS}, costs AS (SELECT conv_id, msg_idx, sum(length(text) + 20) OVER (PARTITION BY conv_id ORDER BY msg_idx DESC) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY msg_idx DESC) AS r FROM (SELECT conv_id, msg_idx, string_agg(text, ' ' ORDER BY block_idx) AS text FROM blocks GROUP BY conv_id, msg_idx))
SELECT conv_id, msg_idx FROM costs WHERE c <= 3500 OR r <= 2""")
def trim_to_budget(spark, sf_dir):
    rows = _messages(spark, sf_dir).select("conv_id", F.col("msg_idx").cast("long").alias("msg_idx"), F.array_join(F.transform("blocks", lambda b: b["text"]), " ").alias("text"))
    return recency.suffix_budget(rows, T.length(F.col("text")) + 20, fixed.STATE_BUDGET).select("conv_id", "msg_idx")


@query(f"WITH {O.BLOCKS},{D.STEPS} SELECT conv_id, msg_idx, i, text, round(position, 9) AS position FROM steps")
def next_steps(spark, sf_dir):
    return recency.next_steps(_messages(spark, sf_dir)).select("conv_id", F.col("msg_idx").cast("long").alias("msg_idx"), F.col("i").cast("long").alias("i"), "text", F.round("position", 9).alias("position"))


@query(f"WITH {O.SAID},{D.QUESTIONS} SELECT conv_id, ord, text FROM questions")
def open_questions(spark, sf_dir):
    return recency.open_questions(_messages(spark, sf_dir)).select("conv_id", F.col("ord").cast("long").alias("ord"), "text")


@query(f"WITH {O.BLOCKS},{D.PLAN} SELECT conv_id, msg_idx, u.i, u.p.label AS label, u.p.text AS text FROM plan, LATERAL (SELECT unnest(plan) AS p, unnest(range(len(plan))) AS i) u")
def structured_plan(spark, sf_dir):
    out = recency.structured_plan(_messages(spark, sf_dir)).select("conv_id", F.col("msg_idx").cast("long").alias("msg_idx"), F.posexplode("plan").alias("i", "p"))
    return out.select("conv_id", "msg_idx", F.col("i").cast("long").alias("i"), "p.label", "p.text")


def _all_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of the turns and of the exports: these have artifacts and attachments, those long blocks of code."""
    turns = _messages(spark, sf_dir).withColumn("conv_id", F.col("conv_id").cast("string"))
    return stage(turns.unionByName(exports.parse(_exports(spark, sf_dir)).messages), "messages")


@query(f"{D.ARTIFACTS} SELECT conv_id, ord, source, display_name, description, language, loc, char_len, inline_content, anonymous FROM summaries")
def artifact_summaries(spark, sf_dir):
    out = artifacts.summarize(_all_messages(spark, sf_dir))
    return out.select("conv_id", F.col("ord").cast("long").alias("ord"), "source", "display_name", "description", "language", F.col("loc").cast("long").alias("loc"), "char_len", "inline_content", "anonymous")


@query(f"{D.ARTIFACTS} SELECT conv_id, section AS artifacts_section FROM artifact_sections")
def artifact_sections(spark, sf_dir):
    return artifacts.section(stage(artifacts.summarize(_all_messages(spark, sf_dir)), "artifacts"))


@query(f"{X.PARSED_WITH} SELECT conv_id, artifact_id, version, title, language, text FROM export_blocks WHERE type = 'artifact'")
def artifact_latest(spark, sf_dir):
    rows = M.blocks(exports.parse(_exports(spark, sf_dir)).messages).filter("type = 'artifact'")
    return artifacts.collapse_versions(rows).select("conv_id", "artifact_id", F.col("version").cast("long").alias("version"), "title", "language", "text")


# Attachments and links

_FILES = f"(VALUES {seeds.values(seeds.FILES)}) f(filename, mime, size)"
_isin = lambda x, words: f"{x} IN ({', '.join(map(O.q, words))})"


@query(f"""SELECT filename, {D.classified("filename", "mime")} AS kind, {D.language("filename")} AS language, regexp_replace(trim(filename), '^\\d{{10,16}}_', '') AS shown,
  CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.1f', floor(size * 10 / 1024.0 + 0.5) / 10) || ' KB' ELSE printf('%.1f', floor(size * 10 / 1048576.0 + 0.5) / 10) || ' MB' END AS told FROM {_FILES}""")
def classify_attachments(spark, sf_dir):
    f = F.col("filename")
    rows = spark.createDataFrame(seeds.FILES, "filename string, mime string, size long")
    return rows.select("filename", A.classify(f, F.col("mime")).alias("kind"), A.language(f).alias("language"), A.display_name(f).alias("shown"), T.format_bytes(F.col("size")).alias("told"))


_URL = f"urls AS (SELECT url FROM pages UNION ALL SELECT * FROM (VALUES {seeds.values(seeds.URLS)}) v(url)), cut AS (SELECT url, lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) AS host, list_filter(string_split(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1), '/'), lambda s: s <> '') AS path FROM urls)"


@query(f"WITH {_URL} SELECT url, CASE WHEN {_isin('host', fixed.CHATGPT_HOSTS)} AND path[1] = 'share' AND len(path) > 1 THEN 'chatgpt' WHEN {_isin('host', fixed.CLAUDE_HOSTS)} AND path[1] = 'share' AND len(path) > 1 THEN 'claude' ELSE 'unsupported' END AS platform, CASE WHEN {_isin('host', fixed.CHATGPT_HOSTS)} AND path[1] = 'share' AND regexp_matches(path[2], '(?i)^[a-f0-9-]{{20,80}}$') THEN path[2] END AS share_id FROM cut")
def parse_share_url(spark, sf_dir):
    urls = spark.read.parquet(f"{sf_dir}/pages.parquet").select("url").union(spark.createDataFrame([(u,) for u in seeds.URLS], "url string"))
    return urls.select("url", share.platform(F.col("url")).alias("platform"), share.share_id(F.col("url")).alias("share_id"))


_PAGES = [(9000001, 'x streamController.enqueue("[{\\"_1\\":2},\\"hello\\",{\\"_3\\":4},") y streamController.enqueue("\\"nested\\",\\"value\\"]\\nP5:[{}]") z'), (9000002, "nothing here"), (9000003, 'streamController.enqueue("[[1,-5,2],\\"a\\",{\\"k\\":1}]")')]
_DECODED = [(9000001, '{"hello": {"nested": "value"}}'), (9000002, None), (9000003, '["a", null, {"k": 1}]')]


@query(f"SELECT page_id, NULL::VARCHAR AS decoded FROM pages WHERE NOT contains(html, 'streamController.enqueue(') UNION ALL SELECT * FROM (VALUES {seeds.values(_DECODED)}) v(page_id, decoded)")
def decode_share_page(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").union(spark.createDataFrame(_PAGES, "page_id long, html string"))
    return pages.withColumn("payload", share.payload(F.col("html"))).select("page_id", share.decode(F.col("payload")).alias("decoded"))


def _exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, raw): the seed exports and all conversations of the table as exports, odd ids in the one format, even ids in the other."""
    turns = seeds.turns(spark, sf_dir)
    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = turns.withColumn("before", F.lag("turn").over(order)).withColumn("after", F.lead("turn").over(order))
    node = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    uuid, talk = (F.concat(F.lit(x), F.col("conv_id").cast("string")) for x in ("c", "Talk "))
    said = F.struct(F.concat(F.lit("m"), "turn").alias("uuid"), F.when(F.col("role") == "user", "human").otherwise(F.col("role")).alias("sender"), F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content"))
    content = F.struct(F.lit("text").alias("content_type"), F.array("text").alias("parts"))
    message = F.struct(F.concat(F.lit("m"), "turn").alias("id"), F.struct("role").alias("author"), content.alias("content"))
    placed = F.struct(node("before").alias("parent"), F.array_compact(F.array(node("after"))).alias("children"), message.alias("message"))
    per = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", said.alias("said"), F.struct(node("turn").alias("key"), placed.alias("value")).alias("node")))).alias("all"))
    flat = F.to_json(F.struct(uuid.alias("uuid"), talk.alias("name"), F.lit("2024-01-02T03:04:05Z").alias("created_at"), F.concat(F.lit("2023-02-0"), (1 + F.col("conv_id") % 9).cast("string"), F.lit("T00:00:00Z")).alias("updated_at"), F.transform("all", lambda x: x["said"]).alias("chat_messages")))
    tree = F.to_json(F.struct(talk.alias("title"), uuid.alias("conversation_id"), (1600000000 + F.col("conv_id") % 1000).alias("create_time"), F.map_from_entries(F.transform("all", lambda x: x["node"])).alias("mapping")))
    odd = F.col("conv_id") % 2 == 1
    made = per.select(F.concat(F.when(odd, "list-").otherwise("tree-"), F.col("conv_id").cast("string")).alias("file"), F.when(odd, flat).otherwise(tree).alias("raw"))
    return spark.createDataFrame(seeds.EXPORTS, "file string, raw string").union(made)


@query(f"WITH {X.RAWS} SELECT file, format, CASE WHEN NOT ok THEN 'not_json' WHEN format = 'unknown' THEN 'unknown_format' END AS error FROM formats")
def detect_format(spark, sf_dir):
    return exports.identify(_exports(spark, sf_dir)).select("file", "format", "error")


@query(f"{X.PARSED_WITH} SELECT conv_id, msg_idx, role, block_idx, type, language, text, title, version, tool_name, summary FROM export_blocks")
def parse_exports(spark, sf_dir):
    out = M.blocks(exports.parse(_exports(spark, sf_dir)).messages)
    return out.select("conv_id", F.col("msg_idx").cast("long").alias("msg_idx"), "role", F.col("block_idx").cast("long").alias("block_idx"), "type", "language", "text", "title", F.col("version").cast("long").alias("version"), "tool_name", "summary")


@query(f"{X.PARSED_WITH} SELECT conv_id, msg_idx, message_id, role, created FROM export_messages")
def export_messages(spark, sf_dir):
    """Active branches, roles, ids and times."""
    return exports.parse(_exports(spark, sf_dir)).messages.select("conv_id", F.col("msg_idx").cast("long").alias("msg_idx"), "message_id", "role", F.unix_millis("created_at").alias("created"))


@query(f"{X.PARSED_WITH} SELECT conv_id, msg_idx, i, {D.classified('filename', 'mime')} AS kind, filename, size, CASE WHEN {D.classified('filename', 'mime')} = 'code_file' THEN content END AS inline_content FROM export_files")
def export_attachments(spark, sf_dir):
    rows = exports.parse(_exports(spark, sf_dir)).messages.select("conv_id", F.col("msg_idx").cast("long").alias("msg_idx"), F.posexplode("attachments").alias("i", "a"))
    return rows.select("conv_id", "msg_idx", F.col("i").cast("long").alias("i"), F.col("a.type").alias("kind"), "a.filename", "a.size", "a.inline_content")


@query(f"""{X.PARSED_WITH} SELECT conv_id, format AS source, title, created, changed, j->>'$.model' AS model, CASE WHEN format = 'chatgpt' THEN system_prompt END AS system_prompt FROM convs
  LEFT JOIN (SELECT conv_id, string_agg(text, chr(10) ORDER BY bi, o) AS system_prompt FROM spoken JOIN versioned USING (conv_id, pos) WHERE rn = 1 AND role = 'system' GROUP BY conv_id HAVING length(string_agg(text, chr(10))) >= 20) USING (conv_id)""")
def export_conversations(spark, sf_dir):
    return exports.parse(_exports(spark, sf_dir)).conversations.select("conv_id", "source", "title", F.unix_millis("created_at").alias("created"), F.unix_millis("changed_at").alias("changed"), "model", "system_prompt")


@query(f"WITH {X.RAWS}, late AS (SELECT conv_id FROM convs ORDER BY changed DESC NULLS LAST, file, n LIMIT 1) SELECT conv_id, 'newest' AS how FROM late UNION ALL SELECT conv_id, 'by id' FROM convs WHERE conv_id = 'l1'")
def pick_conversations(spark, sf_dir):
    """The newest conversation, and one by its id."""
    c = exports.parse(_exports(spark, sf_dir))
    found = [exports.pick(c, name).conversations.select("conv_id", F.lit(how).alias("how")) for name, how in ((None, "newest"), ("l1", "by id"))]
    return found[0].union(found[1])


@query(f"""WITH {X.RAWS} SELECT file, coalesce(given, made) AS id, coalesce(title, 'Untitled conversation') AS title, changed, CASE format WHEN 'claude' THEN json_array_length(j, '$.chat_messages')
  ELSE (SELECT count(*) FROM json_each(j, '$.mapping') e WHERE json_type(e.value, '$.message') = 'OBJECT' AND coalesce(e.value->>'$.message.author.role', '') <> 'system') END::BIGINT AS message_count FROM every""")
def list_exports(spark, sf_dir):
    return exports.list_conversations(_exports(spark, sf_dir)).select("file", "id", "title", F.unix_millis("created_at").alias("changed"), F.col("message_count").cast("long").alias("message_count"))


@query(f"WITH {X.RAWS} SELECT file, j->>'$.uuid' AS uuid, json_array_length(j, '$.chat_messages')::BIGINT AS size FROM every WHERE given = 'l1'")
def extract_export(spark, sf_dir):
    out = exports.extract_raw(_exports(spark, sf_dir), "l1")
    return out.select("file", F.get_json_object("json", "$.uuid").alias("uuid"), F.json_array_length(F.get_json_object("json", "$.chat_messages")).cast("long").alias("size"))


# Summaries and documents


@query(D.TEXTRANK)
def textrank_summary(spark, sf_dir):
    rows = seeds.turns(spark, sf_dir).select(F.concat_ws("-", "conv_id", "turn").alias("message_id"), "text")
    return textrank.summarize(rows, "message_id", "text", 3)


@query(f"WITH {O.TLDR} SELECT conv_id, type, input_chars, markdown, length(markdown)::INTEGER AS output_chars FROM tldr_documents")
def render_tldr(spark, sf_dir):
    return compress(corpus(spark, sf_dir), "tldr").select("conv_id", "type", "input_chars", "markdown", "output_chars")


@query(D.RESUME)
def render_resume(spark, sf_dir):
    return compress(corpus(spark, sf_dir), "resume")


@query(f"WITH {O.FULL} SELECT conv_id, type, input_chars, markdown, length(markdown)::INTEGER AS output_chars FROM full_documents")
def render_full(spark, sf_dir):
    return compress(corpus(spark, sf_dir), "full").select("conv_id", "type", "input_chars", "markdown", "output_chars")


@query(f"WITH {O.MESSAGES}, r AS (SELECT conv_id, msg_idx, role, row_number() OVER (PARTITION BY conv_id ORDER BY msg_idx DESC) AS back FROM messages WHERE role IN ('user', 'assistant')) SELECT conv_id, msg_idx, role FROM r WHERE back <= 30")
def recent_messages(spark, sf_dir):
    return identity.recent_messages(_messages(spark, sf_dir)).select("conv_id", F.col("msg_idx").cast("long").alias("msg_idx"), "role")


