"""What workers hold between tasks."""

import numpy as np

from textsieve.llm.staging import trimmed


def resident() -> int:
    with open("/proc/self/status") as f:
        return next(int(x.split()[1]) for x in f if x.startswith("VmRSS")) >> 10


def test_memory_goes_back_after_a_task():
    """Blocks too small for pages of their own, the last of which is still held, keep nothing of what was freed."""
    held = []

    def work(batches):
        for batch in batches:
            blocks = [np.ones(12_000) for _ in range(3_000)]
            held.append(blocks[-1])
            del blocks
            yield batch

    before = resident()
    assert list(trimmed(work)([1, 2])) == [1, 2]
    assert resident() - before < 60
