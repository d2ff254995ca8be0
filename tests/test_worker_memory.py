"""What a Python worker of the training-data operators takes for a task, and keeps after it."""

import random
import re
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from mildtext.llm import common, substring, wordhash

SMAPS = Path("/proc/self/smaps_rollup")


def own_mb():
    return int(re.search(r"\nPss_Anon:\s+(\d+)", SMAPS.read_text())[1]) / 1024


def test_windows_of_a_batch_take_bounded_memory():
    pick = random.Random(5)
    texts = [" ".join(pick.choices("a bc def ghij klmno".split(), k=900)).encode() for _ in range(1_000)]  # 3.6 MB
    whole = substring.Passages(texts, substring.Spans())
    wordhash._TABLES.clear()
    tracemalloc.start()
    try:
        digests = [substring.Passages(part, substring.Spans()).digest for _, part in wordhash.in_slices(texts)]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert np.array_equal(np.concatenate(digests), whole.digest)
    assert peak < 60e6


@pytest.mark.skipif(not SMAPS.exists(), reason="memory can't be read here")
def test_a_task_gives_its_memory_back():
    pins = []

    @common.lean
    def run(batches):
        for batch in batches:
            held = [bytearray(b"x") * 60_000 for _ in range(2_000)]  # 120 MB in pieces too small for a mapping each
            pins.append([bytearray(b"x") * 60_000])  # lies above them
            yield batch
            del held

    list(common.lean(iter)(()))  # what earlier tests left free is no part of it
    batch = pa.RecordBatch.from_arrays([pa.array([1])], ["n"])
    before, during = own_mb(), []
    for _ in run([batch]):
        during.append(own_mb())
    assert during[0] - before > 60
    assert own_mb() - before < 30
