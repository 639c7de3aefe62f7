"""Decontamination in blocks of windows and small slices of text: what a task holds, and the same matches."""

import random
import tracemalloc

import pyarrow as pa

from lendscope.llm import decontamination


def test_decontamination_holds_little_of_long_texts():
    rng = random.Random(5)
    words = lambda n: " ".join(f"w{rng.randrange(10**5)}" for _ in range(n))
    block = decontamination.prepared([(k, words(15)) for k in range(20)])
    texts = pa.array([words(500) for _ in range(1200)])
    assert texts.nbytes > 3_500_000
    tracemalloc.start()
    found = list(decontamination.passages(texts, block))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not found
    assert peak < 120 << 20


def test_windows_of_many_blocks_are_those_of_one(monkeypatch):
    rng = random.Random(6)
    words = lambda n: " ".join(f"w{rng.randrange(40)}" for _ in range(n))
    texts = [words(n) for n in (0, 3, 90, 400, 17, 1000)]
    items = [(k, " ".join(t.split()[5 : 5 + n])) for k, (t, n) in enumerate(zip(texts[2:], (16, 30, 11, 60), strict=True))]
    block = decontamination.prepared(items)
    one = list(decontamination.passages(pa.array(texts), block))
    monkeypatch.setattr(decontamination, "BLOCK", 7)
    monkeypatch.setattr(decontamination, "SLICE_BYTES", 50)
    assert list(decontamination.passages(pa.array(texts), block)) == one
    assert {(i - 2, k) for i, k, *_ in one} >= {(k, k) for k in range(4)}
