"""Phase of heterozygous sites by a dynamic program over the haplotypes of a sliding window of sites."""

from __future__ import annotations

import numpy as np

WINDOW = 10


def misfits(mask: np.ndarray, bits: np.ndarray, count: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Misfits of ``count`` fragments each that end at a site, for all 2^window haplotypes of the window that ends there.

    The lowest bit is that site, the next one the site before it; ``mask`` has the sites that a fragment holds, ``bits`` its alleles at
    them. Both haplotypes may have produced a fragment, so it fits the better of the two."""
    hap = np.arange(1 << window)
    ones = np.array([h.bit_count() for h in hap.tolist()])
    out = np.zeros(len(hap), np.int64)
    for k in range(0, len(mask), 1024):
        m, b, n = (np.asarray(x[k : k + 1024], np.int64) for x in (mask, bits, count))
        miss = ones[(hap ^ b[:, None]) & m[:, None]]
        out += (n[:, None] * np.minimum(miss, ones[m][:, None] - miss)).sum(0)
    return out


def best_path(costs: list[np.ndarray | None], window: int = WINDOW) -> list[int]:
    """Alleles 0/1 on the first haplotype, for ``misfits`` of each site in order (None: none); the first site is 0. Of equal
    ways the one with the smaller alleles in front stays."""
    states, cost, turns = 1 << (window - 1), np.zeros(1, np.int64), []
    for i, extra in enumerate(costs):
        full = np.repeat(cost, 2) if i else cost
        if extra is not None:
            full = full + np.asarray(extra)[: len(full)]
        if len(full) > states:  # the oldest site leaves the window
            turn = full[states:] < full[:states]
            cost = np.where(turn, full[states:], full[:states])
        else:
            turn, cost = None, full
        turns.append(turn)
    out, key = [], int(cost.argmin())
    for turn in turns[::-1]:
        out.append(key & 1)
        key = (key + (states if turn is not None and turn[key] else 0)) >> 1
    return out[::-1]


def phase(n: int, fragments: list[dict[int, int]], window: int = WINDOW) -> list[int]:
    """Alleles 0/1 on the first haplotype of ``n`` sites that fit the fragments (site to allele) with the fewest misfits.

    A fragment counts where its last site enters the window, with the sites of it that the window holds."""
    ends: dict[int, list[tuple[int, int]]] = {}
    for f in fragments:
        if len(f) > 1:
            i = max(f)
            seen = [(i - s, a) for s, a in f.items() if i - s < window]
            ends.setdefault(i, []).append((sum(1 << k for k, _ in seen), sum(a << k for k, a in seen)))
    return best_path([misfits(*map(np.array, zip(*ends[i], strict=True)), np.ones(len(ends[i])), window) if i in ends else None for i in range(n)], window)
