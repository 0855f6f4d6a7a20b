"""Engine operators: SQL counterparts, invariants, whole documents."""

import json
import math
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from skein.functions import fixed
from skein.functions import text as T
from skein.functions.stages import stage
from skein.operators import candidates as C
from skein.plans import catalogue, seeds
from skein.plans.compress import compress, compress_levels, types_of
from skein.sources import exports, share, tables

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    rel = duck.sql(catalogue.ORACLES[name])
    assert columns == sorted(rel.columns)
    assert got == sorted((tuple(map(plain, r)) for r in rel.select(*(f'"{c}"' for c in columns)).fetchall()), key=repr)
    assert got


@pytest.fixture(scope="module")
def scored(spark):
    c = tables.from_turns(seeds.turns(spark, SF))
    return stage(C.score(C.extract(c.messages), types_of(c)), "scored")


def walk(rows, budget):
    """The greedy selection, one conversation, as a plain loop."""
    keeps = sorted((r for r in rows if r.always_keep), key=lambda r: (-r.score, r.ord))
    picked, used, per = [], 0, {}
    for r in keeps:
        if used + r.char_len > budget * fixed.ALWAYS_KEEP_SHARE and picked:
            break
        picked.append(r)
        used += r.char_len
        per[r.msg_idx] = per.get(r.msg_idx, 0) + 1
    rest = [r for r in sorted(rows, key=lambda r: r.ord) if not r.always_keep] + keeps[len(picked) :]
    for r in sorted(rest, key=lambda r: -r.score / max(1, math.log10(r.char_len + 10))):
        if used + r.char_len <= budget and (r.score - per.get(r.msg_idx, 0) * fixed.DIVERSITY_PENALTY > 0 or r.always_keep):
            picked.append(r)
            used += r.char_len
            per[r.msg_idx] = per.get(r.msg_idx, 0) + 1
    return {r.ord for r in picked}


@pytest.mark.parametrize("budget", [200.0, 1000.0, 9000.0])
def test_selection_is_the_greedy_walk(scored, budget):
    by = {}
    for r in scored.collect():
        by.setdefault(r.conv_id, []).append(r)
    got = {}
    for r in C.select(scored, budget).select("conv_id", "ord").collect():
        got.setdefault(r.conv_id, set()).add(r.ord)
    for conv, rows in by.items():
        assert got.get(conv, set()) == walk(rows, budget), conv


def test_full_level_keeps_all(scored):
    assert C.select(scored, float("inf")).count() == scored.count()
    assert C.select(scored, 0.0).count() == 0


def test_result_does_not_depend_on_partitions(spark):
    turns = seeds.turns(spark, SF)
    one, many = (C.select(C.score(C.extract(c.messages), types_of(c)), 1000.0).select("conv_id", "ord") for c in (tables.from_turns(turns.repartition(n)) for n in (1, 16)))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_documents(spark):
    got = {(r.conv_id, r.level): r for r in compress_levels(tables.from_turns(spark.createDataFrame(seeds.TURNS, "conv_id long, turn long, role string, text string"))).collect()}
    handoff = compress(tables.from_turns(spark.createDataFrame(seeds.TURNS, "conv_id long, turn long, role string, text string")), force_type="mixed").filter("conv_id = 9000005").collect()[0]
    doc = handoff.markdown
    assert "## Current state" in doc and "## Key decisions made\n- " in doc and "chose Postgres over Mongo" in doc
    assert "**Next steps:**\n- We need to add a nightly job" in doc and "*Generated by Skein.*" in doc
    assert handoff.output_chars == len(doc)
    full = got[9000001, "full"].markdown
    assert "## System\nYou answer questions" in full and "```python\ndef load(x):" in full
    tldr = got[9000003, "tldr"].markdown
    assert "## Goal\n- The deadline is next week.\n- What are the pros" in tldr and "## Next steps\nWe need to write" in tldr
    assert got[9000003, "full"].dropped_messages == 0
    assert all(re.search(r"\d -> [\d,]+ chars", r.markdown) for r in got.values())


def test_forced_type_and_errors(spark):
    c = tables.from_turns(spark.createDataFrame(seeds.TURNS[4:6], "conv_id long, turn long, role string, text string"))
    doc = compress(c, "resume", force_type="research").collect()[0]
    assert doc.type == "research" and "## Findings\n- " in doc.markdown
    assert "https://example.org" in doc.markdown
    with pytest.raises(ValueError):
        compress(c, "huge")
    with pytest.raises(ValueError):
        compress(c, "tldr", force_type="poem")


def test_empty_corpus(spark):
    c = tables.from_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert compress(c, "resume").count() == 0


RAW = dict(seeds.EXPORTS)


def test_export_versions_and_choice(spark):
    files = spark.createDataFrame([(f, RAW[f]) for f in "abcde"], "file string, raw string")
    c = exports.parse(files)
    assert {r.conv_id: r.title for r in c.conversations.collect()} == {"t1": "Tree", "l1": "List, before", "l0": "List"}
    blocks = {(r.conv_id, r.msg_idx): r for r in c.messages.collect()}
    assert blocks["l0", 2].blocks[0].version == 2 and blocks["l0", 2].attachments[0].type == "pdf"
    assert blocks["t1", 1].attachments[0].filename == "image_1"
    assert exports.pick(c, "t1").messages.count() == 2
    assert [r.conv_id for r in exports.pick(c).conversations.collect()] == ["l1"]
    listed = exports.list_conversations(files).collect()
    assert [(r.id, r.message_count) for r in listed] == [("l1", 1), ("l0", 3), ("t1", 3)]


def test_conversations_of_several_files(spark):
    say = lambda *texts: ",".join(f'{{"uuid":"u{i}","sender":"human","content":"{t}"}}' for i, t in enumerate(texts))
    one = lambda head, *texts: f'{{{head}"chat_messages":[{say(*texts)}]}}'
    rows = [("a", one('"uuid":"x","updated_at":"2024-01-01T00:00:00Z",', "old")), ("b", f"""[{one('"uuid":"x","updated_at":"2024-02-01T00:00:00Z",', "old", "new")},{one("", "first without id")}]"""), ("c", one("", "second without id"))]
    c = exports.parse(spark.createDataFrame(rows, "file string, raw string"))
    assert {r.conv_id: r.file for r in c.conversations.collect()} == {"x": "b", "claude-untitled": "b", "claude-untitled-2": "c"}
    said = sorted((r.conv_id, r.msg_idx, r.blocks[0].text) for r in c.messages.collect())
    assert said == [("claude-untitled", 0, "first without id"), ("claude-untitled-2", 0, "second without id"), ("x", 0, "old"), ("x", 1, "new")]


def test_control_characters_are_ordinary_text(spark):
    texts = ["a\x1db", "\x1fpy\x1cx", "one\x1e0 two\x1e1 three", "say\x1d\n```py\x1f\nx\x1c = 1\n```\nend\x1c"]
    c = tables.from_turns(spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: [(b.type, b.text) for b in r.blocks] for r in c.messages.collect()}
    assert got[0] == [("text", texts[0])] and got[1] == [("text", texts[1])] and got[2] == [("text", texts[2])]
    assert got[3] == [("text", "say\x1d"), ("code", "\x1f\nx\x1c = 1"), ("text", "end\x1c")]
    row = spark.createDataFrame([("One\x1e0 here. Two\x1e1 there.\n- bullet\x1e",)], "t string").select(T.sentences(F.col("t")).alias("s")).first()
    assert row.s == ["One\x1e0 here.", "Two\x1e1 there.", "bullet\x1e"]


def test_cycle_and_missing_parent(spark):
    node = '{"parent":%s,"children":[],"message":{"id":"%s","author":{"role":"user"},"content":{"parts":["%s"]}}}'
    raw = '{"conversation_id":"c","current_node":"b","mapping":{"a":%s,"b":%s}}' % (node % ('"b"', "a", "first"), node % ('"a"', "b", "second"))
    c = exports.parse(spark.createDataFrame([("f", raw)], "file string, raw string"))
    assert [r.message_id for r in c.messages.orderBy("msg_idx").collect()] == ["a", "b"]


def test_share_page_decoding():
    flat = share.flat_array('[{"_1":2},"hello",{"_3":4},"nested","value"]\nP5:[{}]\nbroken')
    assert share.resolve(0, flat) == {"hello": {"nested": "value"}}
    assert share.resolve(0, [[0]]) == [None]
    found = share.conversation_in({"x": [{"serverResponse": {"data": {"mapping": {"a": {}}, "current_node": "a"}}}]})
    assert found == {"mapping": {"a": {}}, "current_node": "a"}
    shared = [[1, 1], [2, 2], "x"]
    assert share.resolve(0, shared) == [["x", "x"], ["x", "x"]]
    assert share.resolve(0, [[1, 2], [2], [1, 3], "y"]) == [[[None, "y"]], [[None], "y"]]  # cycles are cut anew on each way
    deep = json.dumps([[i + 1] for i in range(3000)] + ["end"])
    assert share.resolve(0, share.flat_array(deep))[0][0] and share._dump(deep) is None or "end" in share._dump(deep)
    wide = json.dumps([[i + 1, i + 1] for i in range(200)] + ["end"])
    assert share._dump(wide) is None  # stands for 2^200 values
    assert share._dump("[[1, -3, 1e999], NaN]") == "[null, null, null]"
    assert share.repair_truncated('xx {"uuid":"1","created_at":"2024"}, {"uuid":"2","crea').count('"uuid"') == 2


def test_stream_compresses_new_files(spark, tmp_path):
    from skein.streaming import exports as stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(RAW["b"])
    stream.start(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/check", ("full",)).awaitTermination(120)
    assert sorted(r.conv_id for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == ["l0", "l1"]
    (tmp_path / "check/commits/0").unlink()  # as if the batch had failed after it wrote
    (tmp_path / "check/commits/.0.crc").unlink(missing_ok=True)
    stream.start(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/check", ("full",)).awaitTermination(120)
    assert sorted(r.conv_id for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == ["l0", "l1"]


def test_command_line(spark, tmp_path, capsys):
    from skein.__main__ import main

    (tmp_path / "a.json").write_text(RAW["a"])
    (tmp_path / "b.json").write_text("{broken")
    assert main([f"file://{tmp_path}", "--level", "full"]) == 1
    out = capsys.readouterr().out
    assert "isn't valid JSON" in out and "# Tree" in out and "```sql\nselect 1\n```" in out
    assert main([f"file://{tmp_path}/a.json", "--list"]) == 0
    assert "t1\t" in capsys.readouterr().out


def test_plans_and_lists(spark):
    turns = [
        (1, 0, "user", "Outline the work please."),
        (1, 1, "assistant", "Here it is:\n\nPhase 1 - Collect the data\nstep 2: ignored\nPhase 2: Train the model"),
        (2, 0, "assistant", "Nothing planned."),
    ]
    from skein.operators import recency

    c = tables.from_turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: [tuple(p) for p in r.plan] for r in recency.structured_plan(c.messages).collect()}
    assert got == {1: [("Phase 1", "Collect the data"), ("Phase 2", "Train the model")]}


def test_sentence_ranking(spark):
    from skein.operators import textrank

    rows = spark.createDataFrame([("a", "Cats chase mice. Mice fear cats. The weather is fine today. Cats and mice live here."), ("b", "Single one."), ("c", "")], "k string, t string")
    got = {r.k: r.summary for r in textrank.summarize(rows, "k", "t", 2).collect()}
    assert got["b"] == "Single one." and "weather" not in got["a"] and "c" not in got
    scores = {(r.k, r.idx): r.score for r in textrank.rank(rows, "k", "t").collect()}
    assert scores["b", 0] == 1 and scores["a", 2] < scores["a", 0]


def test_artifacts(spark):
    from skein.operators import artifacts
    from skein.sources.exports import parse

    code = "\\n".join(["class Harbor:", *[f"    x{i} = {i}" for i in range(45)]])
    say = lambda i, who, text: f'{{"uuid":"{i}","sender":"{who}","content":[{{"type":"text","text":"{text}"}}]}}'
    raw = '{"uuid":"z","name":"n","chat_messages":[%s]}' % ",".join([say(1, "human", "see harbor_model.py"), say(2, "assistant", f"```python\\n{code}\\n```"), say(3, "human", "ok"), say(4, "assistant", "```\\n" + "\\n".join("y" for _ in range(41)) + "\\n```")])
    got = artifacts.summarize(parse(spark.createDataFrame([("f", raw)], "file string, raw string")).messages).orderBy("ord").collect()
    assert [(r.display_name, r.description, r.language, r.loc, r.anonymous) for r in got] == [("harbor_model.py", "Python module, defines `Harbor`, 46 LOC", "python", 46, False), ("inline code #3", "Code module, 41 LOC", "code", 41, True)]
    section = artifacts.section(artifacts.summarize(parse(spark.createDataFrame([("f", raw)], "file string, raw string")).messages)).collect()[0].artifacts_section
    assert section.startswith("## Code artifacts in this conversation\n- `harbor_model.py` - Python module, defines `Harbor`, 46 LOC\n\n```python\nclass Harbor:")
