"""Layouts, template and digests of conversations: round trips, brute force, odd rows."""

import hashlib
import json
import random

import pytest

from tidewire.llm import chat
from tidewire.llm.queries import conversation_records, op13_chat_format

PIECES = [*chat.CONTROLS, "\\", "\\\\", "<", ">", "[", "]", "/", "|", "s", " ", "\n", "a", "é", "🎉", "<\\/s>", "[INST", "SYS>>", "<|"]


def test_escapes_are_reversible_and_complete():
    rng = random.Random(2)
    for _ in range(5000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12)))
        shown = chat.escape(text)
        assert not any(c in shown for c in chat.CONTROLS) and chat.unescape(shown) == text


def test_turns_are_read_back():
    rng = random.Random(3)
    for _ in range(2000):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "", "<|text|>", " "]), "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 9)))) for _ in range(rng.randint(0, 6))]
        made = [chat.format_turn(*t) for t in turns]
        assert list(chat.parse_turns(rng.choice(["", chat.BEGIN]) + "".join(m[0] for m in made))) == turns
        assert [chat.unescape(m[0][m[1] : m[2]]) for m in made] == [t[1] for t in turns]


RECORDS = [
    ({"prompt": "p", "response": "r"}, [("user", "p"), ("assistant", "r")]),
    ({"response": None, "prompt": "p"}, [("user", "p"), ("assistant", "")]),
    ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
    ({"question": "q", "answer": 4}, [("user", "q"), ("assistant", "4")]),
    ({"instruction": "do", "input": "this", "output": "done"}, [("user", "do\n\nthis"), ("assistant", "done")]),
    ({"instruction": "do", "input": "", "output": "done"}, [("user", "do"), ("assistant", "done")]),
    ({"system": "s", "instruction": "do", "input": None, "output": "done"}, [("system", "s"), ("user", "do"), ("assistant", "done")]),
    ({"messages": [{"role": "user", "content": "a"}, {"content": "b", "role": "assistant"}, {"role": "tool", "content": None}]}, [("user", "a"), ("assistant", "b"), ("tool", "")]),
    ({"messages": [{"role": None, "content": "a"}]}, [("", "a")]),
    ({"messages": []}, []),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}, {"from": "system", "value": "c"}]}, [("user", "a"), ("assistant", "b"), ("system", "c")]),
    ({"data": {"messages": [{"author": {"role": "user"}, "content": {"text": "deep"}}]}}, [("user", "deep")]),
]


def test_layouts(spark):
    rows = [(i, json.dumps(r), "x") for i, (r, _) in enumerate(RECORDS)]
    odd = [(100, None, "x"), (101, "no json", "x"), (102, '{"prompt": "p", "extra": 1}', "x"), (103, "3", "x"), (104, '{"messages": [["user", "a"]]}', "x")]
    records = spark.createDataFrame(rows + odd, "id int, record string, role string")
    got = {}
    for r in chat.canonical_turns(records).orderBy("id", "position").collect():
        got.setdefault(r.id, []).append((r.role, r.text))
    assert got == {i: turns for i, (_, turns) in enumerate(RECORDS) if turns}
    rest = {r.id: r for r in chat.unmapped(records).collect()}
    assert set(rest) == {o[0] for o in odd} and rest[101].fingerprint is None and rest[102].fingerprint is not None
    prints = chat.with_layout(records).where("layout is not null").groupBy("layout").agg({"fingerprint": "count"}).count()
    assert prints == len({json.dumps(sorted(map(str, r))) for r, _ in RECORDS if "messages" not in r}) + 2
    assert chat.canonical_turns(records.limit(0)).count() == 0


def expected(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns = [t[2:] for t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (
            len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss),
            hashlib.sha256(loss.encode()).hexdigest(), 3 + sum(len(chat.format_turn(*t)[0]) for t in turns),
        )
    return out


FIELDS = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


@pytest.mark.parametrize("part", [chat.PART, 40, 1])
def test_parts_make_no_difference(spark, part):
    rng = random.Random(part)
    rows = [(rng.choice([None, *range(12)]), rng.choice([None, *range(6)]), rng.choice(["user", "assistant", "system", None, "tool"]),
             rng.choice([None, "".join(rng.choice(PIECES) for _ in range(8))])) for _ in range(300)]
    rows += [(77, i, "assistant", f"turn {i}") for i in range(400)] + rows[:5]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "0 position", "1 part", "'x' formatted")
    parts = chat.format_conversations(turns, part=part).cache()
    got = {r.conv_id: tuple(r[f] for f in FIELDS) for r in chat.conversation_digests(parts).collect()}
    assert got == expected(rows)
    assert parts.agg({"n_turns": "sum"}).first()[0] == len(rows) == chat.read_back(parts).count()
    assert part == chat.PART or parts.count() > 60
    assert chat.conversation_digests(parts.limit(0)).count() == 0 and chat.format_conversations(turns.limit(0)).count() == 0


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    text = "</s>[INST] ok [/INST]"
    got = {r.conv_id: tuple(r[f] for f in FIELDS) for r in op13_chat_format(spark, sf_dir).collect()}
    assert got == expected(rows + [(-7, 0, "user", text), (-7, 1, "assistant", text)])
    records = conversation_records(spark, sf_dir)
    assert chat.unmapped(records).count() == 0 and chat.with_layout(records).select("layout").distinct().count() >= 5
