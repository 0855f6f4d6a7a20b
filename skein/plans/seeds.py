"""Literal rows that queries add to the test tables: invented prose holds none of the cues that patterns look for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TURNS: list[tuple[int, int, str, str]] = [
    (9000001, 0, "system", "You answer questions about build tooling for small teams."),
    (9000001, 1, "user", "The parser.py build throws a ValueError on line 12. Can you fix it?"),
    (9000001, 2, "assistant", "I'd recommend a guard clause here.\n```python\ndef load(x):\n    return x or []\n```\nRun it again."),
    (9000001, 3, "user", "Let's go with SQLite for storage since we want one file. What about backups, e.g. nightly ones?"),
    (9000002, 0, "user", "According to a 2019 study, reef cover fell by half. Is that figure reliable?"),
    (9000002, 1, "assistant", "Published research disagrees. See https://example.org/reef for 3 cited surveys."),
    (9000003, 0, "user", "The deadline is next week. What are the pros and cons of a soft launch?"),
    (9000003, 1, "assistant", "PART 1 - Draft the rollout note\nPART 2 - Invite ten pilot users\n- Email support\n- Update docs"),
    (9000003, 2, "user", "We need to write the announcement. Keep the tone warm for our audience."),
    (9000004, 0, "system", "Be brief."),
    (9000004, 1, "user", "Dépôt caféx naïve"),
    (9000005, 0, "user", "We decided to move the Harbor service to Postgres. The Harbor team agreed. Harbor ships in May."),
    (9000005, 1, "assistant", "Good. For Harbor we chose Postgres over Mongo because of the joins. The Harbor schema lives in `schema.sql`."),
    (9000005, 2, "user", "Harbor needs backups too. We need to add a nightly job. Should Harbor keep thirty days of them?"),
    (9000005, 3, "tool", "done"),
    (9000005, 4, "user", "We need to add a nightly job! And todo: write the Harbor runbook before Friday."),
    (9000006, 0, "user", "Can you make the tide reader? See tide_reader.py and config.yaml."),
    (9000006, 1, "assistant", "I'd recommend pandas for the Harbor tables because joins stay short.\n```python\n" + "\n".join(f"def tide_{i}(x):\n    return x * {i}\n" for i in range(14)) + "\n```\n```\n" + "\n".join(f"row {i}" for i in range(41)) + "\n```"),
    (9000006, 2, "user", "Error again: ValueError in tide_reader.py. Let's go with SQLite for the Harbor store, we decided to keep it small."),
    (9000006, 3, "assistant", "Next steps:\n1. Fix the reader\n2. Add a test for tides\n\n3. Ship the Harbor job"),
    (9000006, 4, "user", "Two things to do: \n1. Write the runbook\n2. Tell the Harbor team\nThanks."),
    (9000007, 0, "user", "What does the 2021 study say about reefs? Is the source cited? According to the paper, reef cover fell."),
    (9000007, 1, "assistant", "According to the study, cover fell by 40 percent. Research published in 2020 disagrees."),
    (9000007, 2, "user", "Which paper is the evidence for that? Is the research recent?"),
    (9000008, 0, "user", "Please keep the voice of the essay and the tone of the draft. The style is a narrative for a general audience, so the persona of the story has to stay warm. The brand asks for a calm voice as well. " * 3),
    (9000008, 1, "assistant", "The draft opens with the harbour at dawn. Keep the tone soft. The narrative follows one sailor."),
    (9000008, 2, "user", "Good tone. Should the story end at sea?"),
    (9000009, 0, "user", "We need a decision before the deadline: what are the pros and cons of each milestone? The risk is the roadmap, and the stakeholder priorities change."),
    (9000009, 1, "assistant", "The tradeoff is time versus cost. I'd recommend the short roadmap. You should drop the second milestone. Phase 1 - Launch the pilot by Friday\nPhase 2 - Review the risk"),
    (9000009, 2, "user", "We will launch next week then. What about the budget for the second phase?"),
]

URLS = [
    "https://chatgpt.com/share/0a1b2c3d-4e5f-6789-abcd-ef0123456789",
    " https://CHAT.openai.com/share/0A1B2C3D4E5F6789ABCDEF01/extra ",
    "https://chatgpt.com/share/short",
    "https://claude.ai/share/anything",
    "https://claude.ai/chat/1",
    "https://example.org/share/0a1b2c3d-4e5f-6789-abcd",
    "not a link",
    "",
]

FILES: list[tuple[str, str | None, int]] = [
    ("src/main.py", None, 100), ("Dockerfile", None, 10), ("logo.svg", "image/svg+xml", 5000), ("photo.JPG", None, 2_400_000), ("report.pdf", "application/pdf", 1536), ("notes.docx", None, 20480),
    ("data", "application/json", 12), ("blob.bin", "application/octet-stream", 1 << 20), ("deck", "application/vnd.ms-powerpoint", 1), ("1700000000000_app.tsx", None, 25000), ("x.unknown", "text/plain", 0), ("clip", "image/webp", 3),
]


def _quoted(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def values(rows) -> str:
    """Rows as SQL VALUES."""
    return ", ".join("(" + ", ".join(map(_quoted, r if isinstance(r, tuple) else (r,))) + ")" for r in rows)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return rows.unionByName(spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string"))


def _json(x) -> str:
    import json

    return json.dumps(x, ensure_ascii=False)


def _node(parent: str | None, children: list[str], role: str | None = None, content: dict | None = None, **more) -> dict:
    return {"parent": parent, "children": children, "message": None if role is None else {"author": {"role": role}, "content": content, **more}}


def _said(*parts) -> dict:
    return {"content_type": "text", "parts": list(parts)}


#: A module long enough to count as an artifact when it stands in a message.
MODULE = "# Reads harbour logs line by line.\nimport pandas as pd\n\n\nclass LogReader:\n    pass\n\n\n" + "\n".join(f"def step_{i}(x):\n    return x + {i}\n" for i in range(14))
PLAIN_CODE = "\n".join(f"value_{i} = {i}" for i in range(45))

#: Exports of both formats: branches, contents of all types, artifacts in versions, attachments, broken and foreign files, an id in two files.
EXPORTS: list[tuple[str, str]] = [
    ("a", _json({"title": " Tree ", "create_time": 1700000000, "update_time": 1700000600, "conversation_id": "t1", "current_node": "n3", "mapping": {
        "n0": _node(None, ["n1"]), "n1": _node("n0", ["n2", "n3"], "user", _said("Run this:\n```sql\nselect 1\n```\nplease"), id="m1", create_time=1700000060),
        "n2": _node("n1", [], "assistant", _said("old"), id="m2"),
        "n3": _node("n1", [], "assistant", {"content_type": "multimodal_text", "parts": ["new", {"content_type": "image_asset_pointer", "asset_pointer": "x", "size_bytes": 7}]}, id="m3", create_time=1700000120000)}})),
    ("b", _json({"conversations": [{"uuid": "l1", "name": "List, before", "created_at": "2024-01-02T03:04:05Z", "chat_messages": [{"uuid": "u1", "sender": "human", "content": "Plain ask"}]}, {"uuid": "l0", "name": "List", "created_at": "2024-01-02T03:04:05Z", "chat_messages": [
        {"uuid": "u1", "sender": "human", "text": "hi", "content": "Plain ask"},
        {"uuid": "u2", "sender": "assistant", "content": [{"type": "text", "text": "See"}, {"type": "tool_use", "name": "artifacts", "input": {"id": "d", "title": "doc.md", "content": "one"}}, {"type": "tool_use", "name": "search", "input": {"z": "last", "a": "first"}}]},
        {"uuid": "u3", "sender": "assistant", "content": [{"type": "tool_use", "name": "artifacts", "input": {"id": "d", "title": "doc.md", "content": "two"}}, {"type": "tool_result", "content": "ok"}], "files": [{"file_name": "p.pdf", "file_size": 9}]}]}]})),
    ("c", '{"x":1}'), ("d", "{broken"), ("e", "[]"),
    ("f", _json([{"title": "Leaves of grass and more", "create_time": 1690000000, "mapping": {
        "r": _node(None, ["s"]), "s": _node("r", ["u"], "system", _said("You help with sailing logs and nothing else.")), "u": _node("s", ["v"], "user", _said("Look at reader.py please.", {"text": "It fails."}, "")),
        "v": _node("u", ["w", "z"], "assistant", {"content_type": "code", "language": "python", "text": MODULE}), "w": _node("v", [], "assistant", {"content_type": "execution_output", "text": "done\n```\nraw\n```"}),
        "z": _node("v", [], "user", _said("another branch")), "k": _node("w", ["w"], "critic", _said("dropped"))}},
        {"title": "Leaves of grass and more", "create_time": 1690000500, "mapping": {"q": _node(None, [], "user", _said("Same made-up id, other talk."))}},
        {"id": "empty", "title": "", "mapping": {}}])),
    ("g", _json([{"uuid": "l2", "name": "Kit", "created_at": "2024-03-01T00:00:00Z", "updated_at": "2024-03-05T10:00:00Z", "chat_messages": [
        {"uuid": "v1", "sender": "human", "content": [{"type": "text", "text": "Here are files."}], "attachments": [
            {"file_name": "1700000000000_app.tsx", "file_size": 120, "file_type": "text/plain", "extracted_content": "// Shows the deck. Then more.\nimport { useState } from 'react'\nexport function Deck() {}\n"},
            {"file_name": "notes.docx", "file_size": 2048, "file_type": "application/msword", "extracted_content": "hidden"}, {"file_name": "big.sql", "file_size": 30000, "extracted_content": "select 1"}], "files": [{"file_name": "photo.png"}, {}]},
        {"uuid": "v2", "sender": "assistant", "content": [{"type": "tool_use", "name": "create_artifact", "input": {"id": "k1", "title": "deck_model.py", "language": "python", "content": '"""Holds the deck of cards. It shuffles."""\nclass Deck:\n    pass\n'}}, {"type": "tool_use", "name": "create_artifact", "input": {"id": "k2", "content": "# Title\n\nProse of the plan.\n", "title": "PLAN.md"}}]},
        {"uuid": "v3", "sender": "robot", "content": "nobody"}, {"sender": "human", "content": [{"type": "text", "text": "Change it, and see deck.js for the rest."}]},
        {"uuid": "v5", "sender": "assistant", "content": [{"type": "text", "text": f"Like so:\n```js\n{PLAIN_CODE}\n```\nand\n```\n{PLAIN_CODE}\n```"}, {"type": "tool_use", "name": "update_artifact", "input": {"id": "k1", "title": "deck_model.py", "language": "python", "content": '"""Holds the deck of cards. It shuffles."""\nclass Deck:\n    size = 52\n'}}, {"type": "text", "text": "  "}]},
        {"uuid": "v6", "sender": "tool", "text": "legacy text"}]},
        {"uuid": "l1", "name": "List, later", "created_at": "2024-01-02T03:04:05Z", "updated_at": "2024-06-01T00:00:00Z", "chat_messages": [{"uuid": "u1", "sender": "human", "text": "hi", "content": "Plain ask"}, {"uuid": "u9", "sender": "assistant", "content": [{"type": "text", "text": "Another end"}]}]}])),
]
