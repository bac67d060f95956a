import tracemalloc

import numpy as np

from nestegg.llm.collocations import held_filters
from nestegg.llm.quotient_filter import Packing, merged


def test_a_task_holds_few_keys_and_loses_none():
    packing, rng = Packing(4, 17), np.random.default_rng(3)  # two halves of 34 bits: sorted by both

    def found():
        for _ in range(40):
            words = [rng.integers(1, 40, 200_000).astype(np.int32), *(rng.integers(1, 30, 200_000).astype(np.int32) for _ in range(3))]
            yield packing.permute(*packing.pack(words))

    sizes, n = [], 0
    tracemalloc.start()
    for f in held_filters(packing, 3, found()):
        sizes.append(f.size)
        n += int(f.entries()[2].sum())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 8_000_000 and len(sizes) > 8
    assert peak < 160e6, peak


def test_one_large_chunk_is_cut():
    packing = Packing(2, 17)
    keys = packing.permute(*packing.pack([np.arange(3_000_000) % 1500 + 1, np.arange(3_000_000) % 2000 + 1]))
    parts = {}
    for f in held_filters(packing, 1, iter([keys])):
        parts.setdefault(f.slice_number, []).append(f)
    counts = [merged(p)[2] for p in parts.values()]
    assert sum(len(c) for c in counts) == 6000 and all((c == 500).all() for c in counts)
