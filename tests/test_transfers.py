"""Transfers of chunks are folded side by side: each is that of its letters one by one."""

import numpy as np
import pytest
from strandframe.functions import search


@pytest.mark.parametrize("chunk", [1, 3, 8, 100])
@pytest.mark.parametrize("n", [0, 1, 8, 97, 300])
def test_folded_transfers(chunk, n):
    table, x = search.automaton("ACA"), np.random.default_rng(n).integers(0, 2, n).astype(np.uint8)
    want = [search.Transfer.of(table, x[k : k + chunk]) for k in range(0, n, chunk)]
    for cells in (1, 64, 1 << 22):
        got = list(search.transfers(table, x, chunk, cells))
        assert got == [(t.to.tolist(), t.hits.tolist()) for t in want]
