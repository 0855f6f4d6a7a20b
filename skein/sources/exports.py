"""Export files of chat services: detection, listing, and parsing into the engine's tables.

An export is one JSON text: a conversation, an array of them, or an object whose "conversations" is such an array. One format keeps
messages as a tree of nodes ("mapping"), the other as a list ("chat_messages"). JSON objects are read as maps or structs with given
schemas, never inferred, so that the order of keys is that of the file. Files are read whole and hold at most 25 MiB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import attachments as A
from ..functions import fixed
from ..functions import text as T
from .tables import ATTACHMENT, BLOCK, ROLES, Corpus, block, lift_system_prompt, split_text_and_code

NODE = "parent string, children array<string>, message struct<id:string,author:struct<role:string>,create_time:double,content:struct<content_type:string,parts:array<variant>,text:string,language:string>>"
TREE = "title string, create_time double, update_time double, conversation_id string, id string, current_node string, default_model_slug string, mapping map<string,string>"
LIST = "uuid string, name string, created_at string, updated_at string, model string, chat_messages array<string>"
MESSAGE = "uuid string, sender string, created_at string, text string, content variant, attachments array<struct<file_name:string,file_size:bigint,file_type:string,extracted_content:string>>, files array<struct<file_name:string,file_size:bigint>>"
CONTENT = "array<struct<type:string,text:string,name:string,input:map<string,string>,content:string>>"

ERRORS = {
    "too_large": "The file is larger than 25 MB.",
    "not_json": "The file isn't valid JSON.",
    "unknown_format": "The file doesn't look like a chat export: neither 'mapping' nor 'chat_messages' is there.",
    "empty": "The file holds no conversations.",
}


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, raw): whole files. Those over the limit come back with a null raw and are never loaded."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("file"), F.when(F.col("length") <= fixed.MAX_FILE_BYTES, F.col("content").cast("string")).alias("raw"))


def _kind(json: Column) -> Column:
    """The format of one JSON object."""
    v = F.try_parse_json(json)
    shape = lambda p: F.schema_of_variant(F.variant_get(v, p, "variant"))
    nested = lambda s: F.startswith(s, F.lit("OBJECT")) | F.startswith(s, F.lit("ARRAY"))
    return F.when(nested(shape("$.mapping")), "chatgpt").when(F.startswith(shape("$.chat_messages"), F.lit("ARRAY")), "claude")


def _elements(raw: Column) -> Column:
    """The JSON texts of an export's conversations."""
    top = F.schema_of_variant(F.try_parse_json(raw))
    wrapped = F.from_json(raw, "conversations array<string>")["conversations"]
    listed = F.when(F.startswith(top, F.lit("ARRAY")), F.from_json(raw, "array<string>")).when(F.startswith(top, F.lit("OBJECT")), F.when(_kind(raw).isNotNull(), F.array(raw)).otherwise(wrapped))
    return F.coalesce(listed, F.array().cast("array<string>"))


def detect(raw: Column) -> Column:
    """'chatgpt', 'claude' or 'unknown', by the first conversation."""
    return F.coalesce(_kind(F.get(_elements(raw), F.lit(0))), F.lit("unknown"))


def identify(files: DataFrame) -> DataFrame:
    """files with format and error (a key of ERRORS or null)."""
    raw = F.col("raw")
    kinds = F.filter(F.transform(_elements(raw), _kind), lambda k: k == F.col("format"))
    error = F.when(raw.isNull(), "too_large").when(F.try_parse_json(raw).isNull(), "not_json").when(F.col("format") == "unknown", "unknown_format").when(F.size(kinds) == 0, "empty")
    return files.withColumn("format", detect(raw)).withColumn("error", error)


def conversations(files: DataFrame) -> DataFrame:
    """(file, format, n, json): an export's conversations of its own format, n their place in the file."""
    rows = files.select("file", detect(F.col("raw")).alias("format"), F.posexplode(_elements(F.col("raw"))).alias("n", "json"))
    return rows.filter(_kind(F.col("json")) == F.col("format"))


def _tree_id(c: Column) -> Column:
    return F.coalesce(c["conversation_id"], c["id"], F.concat(F.lit("chatgpt-"), F.substring(F.coalesce(c["title"], F.lit("untitled")), 1, 16)))


def _list_id(c: Column) -> Column:
    return F.coalesce(c["uuid"], F.concat(F.lit("claude-"), F.substring(F.coalesce(c["name"], F.lit("untitled")), 1, 16)))


def _instant(seconds: Column) -> Column:
    """Numbers below 1e12 are seconds, others milliseconds."""
    ok = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) != float("inf"))
    return F.when(ok, F.timestamp_millis(F.when(seconds < 1e12, seconds * 1000).otherwise(seconds).cast("long")))


def _filled(text: Column) -> Column:
    return F.nullif(T.trim(F.coalesce(text, F.lit(""))), F.lit(""))


def list_conversations(files: DataFrame) -> DataFrame:
    """(file, id, title, created_at, message_count), newest first; conversations without a date come last."""
    rows = conversations(files)
    c = F.from_json("json", TREE)
    nodes = F.transform(F.map_values(F.col("c.mapping")), lambda v: F.from_json(v, "message struct<author:struct<role:string>>")["message"])
    tree = rows.filter("format = 'chatgpt'").withColumn("c", c)
    tree = tree.select("file", "n", _tree_id(F.col("c")).alias("id"), F.col("c.title").alias("title"), _instant(F.coalesce("c.update_time", "c.create_time")).alias("created_at"), F.size(F.filter(nodes, lambda m: m.isNotNull() & (F.coalesce(m["author"]["role"], F.lit("")) != "system"))).alias("message_count"))
    flat = rows.filter("format = 'claude'").withColumn("c", F.from_json("json", LIST))
    flat = flat.select("file", "n", _list_id(F.col("c")).alias("id"), F.col("c.name").alias("title"), F.try_to_timestamp(F.coalesce("c.updated_at", "c.created_at")).alias("created_at"), F.size("c.chat_messages").alias("message_count"))
    out = tree.unionByName(flat).withColumn("title", F.coalesce(_filled(F.col("title")), F.lit("Untitled conversation")))
    return out.orderBy(F.col("created_at").desc_nulls_last(), "file", "n").drop("n")


def _text_parts(parts: Column) -> Column:
    """The strings and the texts of objects among parts, joined by line breaks."""
    one = lambda p: F.coalesce(F.when(F.schema_of_variant(p) == "STRING", F.variant_get(p, "$", "string")), F.when(F.schema_of_variant(F.try_variant_get(p, "$.text", "variant")) == "STRING", F.try_variant_get(p, "$.text", "string")), F.lit(""))
    return F.array_join(F.filter(F.transform(F.coalesce(parts, F.array().cast("array<variant>")), one), lambda t: t != ""), "\n")


def _tree_blocks(content: Column) -> Column:
    kind, joined = content["content_type"], _text_parts(content["parts"])
    none = F.array().cast(f"array<{BLOCK}>")
    full = lambda t, b: F.when(T.trim(t) == "", none).otherwise(b)
    other = F.coalesce(content["text"], joined)
    return (
        F.when(content.isNull(), none)
        .when(kind.isNull() | (kind == "text"), full(joined, split_text_and_code(joined)))
        .when(kind == "code", full(other, F.array(block("code", other, language=content["language"]))))
        .when(kind == "multimodal_text", full(joined, F.array(block("text", T.normalize(joined)))))
        .otherwise(full(other, split_text_and_code(other)))
    )


def _attachment(kind: Column, filename: Column, size: Column, mime: Column | None = None, content: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(kind.alias("type"), filename.alias("filename"), size.cast("bigint").alias("size"), (none if mime is None else mime).alias("mime_type"), (none if content is None else content).alias("inline_content"))


def _tree_images(content: Column) -> Column:
    """Image parts of multimodal messages; nameless ones are numbered."""
    get = lambda p, path, kind: F.try_variant_get(p, path, kind)
    images = F.filter(F.coalesce(content["parts"], F.array().cast("array<variant>")), lambda p: (get(p, "$.content_type", "string") == "image_asset_pointer") | get(p, "$.asset_pointer", "string").isNotNull())
    made = F.transform(images, lambda p, i: _attachment(F.lit("image"), F.coalesce(get(p, "$.metadata.filename", "string"), F.concat(F.lit("image_"), (i + 1).cast("string"))), get(p, "$.size_bytes", "bigint")))
    return F.when(content["content_type"] == "multimodal_text", made).otherwise(F.array().cast(f"array<{ATTACHMENT}>"))


def active_branch(keys: Column, nodes: Column, current: Column) -> Column:
    """Places of the nodes from the root to the current one, or to the first childless node with a message, or the last; stops at a cycle."""
    leaf = F.get(F.filter(F.transform(nodes, lambda n, i: F.when((F.size(F.coalesce(n["children"], F.array().cast("array<string>"))) == 0) & n["message"].isNotNull(), i)), lambda i: i.isNotNull()), F.lit(0))
    start = F.when(F.coalesce(current, F.lit("")) != "", F.array_position(keys, current) - 1).otherwise(F.coalesce(leaf.cast("bigint"), F.size(keys).cast("bigint") - 1))

    def step(a: Column, _: Column) -> Column:
        parent = F.get(nodes, a["at"].cast("int"))["parent"]
        up = F.when(parent.isNull(), F.lit(-1).cast("bigint")).otherwise(F.array_position(keys, parent) - 1)
        ends = (a["at"] < 0) | F.array_contains(a["chain"], a["at"])
        return F.when(ends, F.struct(F.lit(-1).cast("bigint").alias("at"), a["chain"].alias("chain"))).otherwise(F.struct(up.alias("at"), F.array_append(a["chain"], a["at"]).alias("chain")))

    seed = F.struct(F.coalesce(start, F.lit(-1).cast("bigint")).alias("at"), F.array().cast("array<bigint>").alias("chain"))
    walked = F.aggregate(F.sequence(F.lit(0), F.size(keys)), seed, step)["chain"]
    return F.reverse(walked)


def _role(name: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), name)


def _tree_messages(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("keys", F.map_keys("c.mapping")).withColumn("nodes", F.transform(F.map_values("c.mapping"), lambda v: F.from_json(v, NODE)))
    chain = rows.select("conv_id", "keys", "nodes", F.posexplode(active_branch(F.col("keys"), F.col("nodes"), F.col("c.current_node"))).alias("pos", "at"))
    m = chain.select("conv_id", "pos", F.get("keys", F.col("at").cast("int")).alias("node_id"), F.get("nodes", F.col("at").cast("int"))["message"].alias("m")).filter("m IS NOT NULL")
    known = {k: v for k, v in ROLES.items() if k != "human"}
    return m.select("conv_id", "pos", F.coalesce("m.id", "node_id").alias("message_id"), _role(F.col("m.author.role"), known).alias("role"), _instant(F.col("m.create_time")).alias("created_at"), _tree_blocks(F.col("m.content")).alias("blocks"), _tree_images(F.col("m.content")).alias("attachments"))


def _list_block(b: Column) -> Column:
    """ARRAY<block> of one content block; versions of artifacts are set later."""
    none = F.array().cast(f"array<{BLOCK}>")
    text = F.coalesce(b["text"], F.lit(""))
    given = lambda k: F.try_element_at(b["input"], F.lit(k))
    name = F.coalesce(given("id"), F.lit("artifact"))
    artifact = block("artifact", F.coalesce(given("content"), F.lit("")), language=given("language"), artifact_id=name, title=F.coalesce(given("title"), name), version=F.lit(1))
    summary = F.array_join(F.transform(F.slice(F.map_entries(b["input"]), 1, 3), lambda e: F.concat(e["key"], F.lit("="), F.substring(F.coalesce(e["value"], F.lit("null")), 1, 40))), ", ")
    used = block("tool_use", F.lit(None), tool_name=b["name"], summary=F.coalesce(summary, F.lit("")))
    result = block("tool_result", F.lit(None), summary=T.head(F.coalesce(b["content"], F.lit('""')), 200))
    return (
        F.when(b["type"] == "text", F.when(T.trim(text) == "", none).otherwise(split_text_and_code(text)))
        .when((b["type"] == "tool_use") & b["name"].isin(*fixed.ARTIFACT_TOOLS), F.array(artifact))
        .when((b["type"] == "tool_use") & (F.coalesce(b["name"], F.lit("")) != ""), F.array(used))
        .when(b["type"] == "tool_result", F.array(result))
        .otherwise(none)
    )


def latest_artifacts(messages: DataFrame) -> DataFrame:
    """messages with artifact versions counted through each conversation and all but the latest of each removed."""
    flat = messages.select("conv_id", "pos", F.posexplode("blocks").alias("i", "b"))
    same = Window.partitionBy("conv_id", "b.artifact_id")
    made = flat.filter("b.type = 'artifact'").withColumn("v", F.row_number().over(same.orderBy("pos", "i"))).withColumn("top", F.count("*").over(same))
    per = made.groupBy("conv_id", "pos").agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct("v", "top")))).alias("versions"))
    rows = messages.join(per, ["conv_id", "pos"], "left")
    at = lambda i: F.try_element_at(F.col("versions"), i)
    placed = F.transform("blocks", lambda b, i: F.when(b["type"] == "artifact", block("artifact", b["text"], language=b["language"], artifact_id=b["artifact_id"], title=b["title"], version=at(i)["v"])).otherwise(b))
    newest = F.transform("blocks", lambda b, i: (b["type"] != "artifact") | (at(i)["v"] == at(i)["top"]))
    rows = rows.withColumn("kept", F.arrays_zip(placed.alias("b"), newest.alias("k")))
    return rows.withColumn("blocks", F.transform(F.filter("kept", lambda z: z["k"]), lambda z: z["b"])).drop("kept", "versions")


def _list_messages(rows: DataFrame) -> DataFrame:
    one = rows.select("conv_id", F.posexplode("c.chat_messages").alias("pos", "j")).withColumn("m", F.from_json("j", MESSAGE)).withColumn("said", F.from_json("j", "content string")["content"])
    shape = F.schema_of_variant(F.col("m.content"))
    none = F.array().cast(f"array<{BLOCK}>")
    listed = F.flatten(F.transform(F.coalesce(F.from_json("said", CONTENT), F.array().cast(CONTENT)), _list_block))
    blocks = F.when((shape == "STRING") & (T.trim(F.coalesce("said", F.lit(""))) != ""), F.array(block("text", F.col("said")))).when(F.startswith(shape, F.lit("ARRAY")), listed).when(T.trim(F.coalesce("m.text", F.lit(""))) != "", F.array(block("text", F.col("m.text")))).otherwise(none)

    def attached(a: Column) -> Column:
        name = F.coalesce(a["file_name"], F.lit("attachment"))
        kind = A.classify(name, a["file_type"])
        return _attachment(kind, name, a["file_size"], a["file_type"], F.when(kind == "code_file", a["extracted_content"]))

    def filed(f: Column) -> Column:
        name = F.coalesce(f["file_name"], F.lit("file"))
        return _attachment(A.classify(name), name, f["file_size"])

    files = F.concat(F.coalesce(F.transform("m.attachments", attached), F.array().cast(f"array<{ATTACHMENT}>")), F.coalesce(F.transform("m.files", filed), F.array().cast(f"array<{ATTACHMENT}>")))
    out = one.select("conv_id", "pos", F.coalesce("m.uuid", F.concat_ws("-", "conv_id", "pos")).alias("message_id"), _role(F.col("m.sender"), ROLES).alias("role"), F.try_to_timestamp("m.created_at").alias("created_at"), blocks.alias("blocks"), files.alias("attachments"))
    return latest_artifacts(out.filter("role IS NOT NULL AND size(blocks) + size(attachments) > 0"))


def _numbered(messages: DataFrame) -> DataFrame:
    kept = messages.filter("role IS NOT NULL")
    order = Window.partitionBy("conv_id").orderBy("pos")
    return kept.withColumn("msg_idx", F.row_number().over(order) - 1).select("conv_id", "msg_idx", "message_id", "role", "created_at", "blocks", "attachments")


#: What tells a conversation's id, name and date in either format.
HEAD = "conversation_id string, id string, uuid string, title string, name string, update_time double, create_time double, updated_at string, created_at string"


def _identified(files: DataFrame) -> DataFrame:
    """conversations() with conv_id, unique over all files. One shuffle, by the id; all that follows keeps its partitioning.

    Of conversations with the same id the one changed last counts, of equal dates the first by file and place: exports overlap. Ids
    made up for conversations without one may be the same for several; those after the first get a number.
    """
    rows = conversations(files).withColumn("h", F.from_json("json", HEAD))
    tree, h = F.col("format") == "chatgpt", F.col("h")
    given = F.when(tree, F.coalesce(h["conversation_id"], h["id"])).otherwise(h["uuid"])
    name = F.when(tree, _tree_id(h)).otherwise(_list_id(h))
    changed = F.when(tree, _instant(F.coalesce(h["update_time"], h["create_time"]))).otherwise(F.try_to_timestamp(F.coalesce(h["updated_at"], h["created_at"])))
    rows = rows.select("file", "n", "format", "json", name.alias("conv_id"), given.isNotNull().alias("given"), changed.alias("changed_at"))
    order = Window.partitionBy("conv_id").orderBy(F.col("given").desc(), F.col("changed_at").desc_nulls_last(), "file", "n")
    rows = rows.withColumn("_r", F.row_number().over(order)).filter("_r = 1 OR NOT given")
    return rows.withColumn("conv_id", F.when(F.col("_r") == 1, F.col("conv_id")).otherwise(F.concat_ws("-", "conv_id", "_r"))).drop("_r", "given")


def parse(files: DataFrame) -> Corpus:
    """All conversations of all files, each id once. Unreadable files give none; identify() says why."""
    rows = _identified(files)
    tree = rows.filter("format = 'chatgpt'").withColumn("c", F.from_json("json", TREE))
    flat = rows.filter("format = 'claude'").withColumn("c", F.from_json("json", LIST))
    tree_messages, prompts = lift_system_prompt(_numbered(_tree_messages(tree).filter("size(blocks) + size(attachments) > 0")))
    messages = tree_messages.unionByName(_numbered(_list_messages(flat)).withColumn("msg_idx", F.col("msg_idx").cast("int")))
    a = tree.select("conv_id", F.lit("chatgpt").alias("source"), _filled(F.col("c.title")).alias("title"), _instant(F.col("c.create_time")).alias("created_at"), F.col("c.default_model_slug").alias("model"), "changed_at", "file", "n")
    b = flat.select("conv_id", F.lit("claude").alias("source"), _filled(F.col("c.name")).alias("title"), F.try_to_timestamp("c.created_at").alias("created_at"), F.col("c.model").alias("model"), "changed_at", "file", "n")
    convs = a.join(prompts, "conv_id", "left").unionByName(b.withColumn("system_prompt", F.lit(None).cast("string")))
    return Corpus(convs, messages)


def pick(corpus: Corpus, conversation_id: str | None = None) -> Corpus:
    """The conversation with the id, or the one changed last; of equal dates the first by file and place."""
    c = corpus.conversations
    one = c.filter(F.col("conv_id") == conversation_id) if conversation_id is not None else c.orderBy(F.col("changed_at").desc_nulls_last(), "file", "n").limit(1)
    return Corpus(one, corpus.messages.join(one.select("conv_id"), "conv_id", "left_semi"))


def extract_raw(files: DataFrame, conversation_id: str) -> DataFrame:
    """(file, json): the JSON of the conversation with the id."""
    rows = conversations(files)
    ids = F.from_json("json", "conversation_id string, id string, uuid string")
    return rows.withColumn("i", ids).filter(F.coalesce("i.conversation_id", "i.id", "i.uuid") == conversation_id).select("file", "json")
