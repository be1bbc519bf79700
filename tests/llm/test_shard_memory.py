"""What a shard of training text takes in memory."""

import random
import tracemalloc

import numpy as np

from tidewire.llm import decontam


def test_a_shard_takes_a_few_times_its_text():
    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(5000)}" for _ in range(300))
    items = [(i, " ".join(text.split()[i : i + 20])) for i in range(20)]
    block = decontam.make_block(items)
    rows = 1500
    data = np.frombuffer((text * rows).encode(), np.uint8)
    offsets = np.arange(rows + 1) * len(text)
    tracemalloc.start()
    shard = decontam.make_shard(data, offsets, block)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(shard.firsts) == rows + 1 and len(decontam.window_hits(shard, block)[0])
    assert peak < 25 * len(data)
