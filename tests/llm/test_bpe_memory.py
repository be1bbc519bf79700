"""What the encoder of byte-level BPE takes in memory, in every Python worker of an executor."""

import random
import tracemalloc
from collections import deque

import pyarrow as pa

from tidewire.llm import bpe, frames
from tidewire.llm.queries import vocabulary

PATH = vocabulary("byte_bpe_50k.json")


def invented(count: int) -> str:
    rng = random.Random(5)
    return " ".join("".join(rng.choice(("th", "er", "en", "ou", "sch", "ñ", "tion", "x")) for _ in range(rng.randrange(3, 7))) for _ in range(count))


def test_tables_and_remembered_texts_are_bounded(monkeypatch):
    tracemalloc.start()
    model = bpe.BacktrackingBpe(PATH)
    tables = tracemalloc.get_traced_memory()[0]
    text = invented(30_000)
    whole = model.encode_bytes(text)
    grown = tracemalloc.get_traced_memory()[0] - tables - len(whole)
    tracemalloc.stop()
    assert tables < 30 << 20
    assert grown < 9 << 20
    # a full memory changes no id
    monkeypatch.setattr(bpe, "MEMORY", 50)
    monkeypatch.setattr(bpe, "PIECES", 50)
    model.forget()
    assert model.encode_bytes(text) == whole and len(model.memory) <= 50


def test_a_task_gives_back_its_last_batch(spark, monkeypatch):
    held: list[int] = []
    monkeypatch.setattr(frames, "give_back", lambda: held.append(pa.total_allocated_bytes()))
    taken = {}

    class Frame:
        sparkSession = spark

        def mapInArrow(self, run, schema):
            taken["run"] = run

    frames.arrow_map(Frame(), lambda: lambda batch: batch, "text string")
    before = pa.total_allocated_bytes()
    deque(taken["run"](iter([pa.RecordBatch.from_arrays([pa.array(["x" * (8 << 20)])], ["text"])])), maxlen=0)
    assert held[0] - before < 1 << 20
