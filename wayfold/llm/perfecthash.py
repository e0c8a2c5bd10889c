"""Minimal perfect hashing of 64-bit keys by hash and displace, for files with keyed access.

Keys are dealt to small buckets; from the largest bucket on, each bucket gets the first seed that sends its keys to
free slots. Keys alone in their bucket take what is left directly (a negative seed names the slot). A lookup reads
one seed and one slot.
"""

from __future__ import annotations

import numpy as np

from wayfold.llm.bytescan import mix

KEYS_A_BUCKET = 4


def _slots(keys: np.ndarray, seed: np.ndarray | int, n: int) -> np.ndarray:
    seeds = (np.asarray(seed, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return (mix(keys ^ seeds) % np.uint64(n)).astype(np.int64)


def build(keys: np.ndarray) -> np.ndarray:
    """Seeds (int32, one a bucket) that send n distinct keys (uint64) to the slots 0..n-1, one each. Equal keys are refused."""
    n = len(keys)
    if len(np.unique(keys)) < n:
        raise ValueError("two keys of a shard share their 64-bit hash: deal the keys to other shards")
    m = max(1, -(-n // KEYS_A_BUCKET))
    bucket = (mix(keys) % np.uint64(m)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=m)
    begins = np.cumsum(sizes) - sizes
    seeds, taken = np.zeros(m, dtype=np.int32), np.zeros(n, dtype=bool)
    for b in np.argsort(-sizes, kind="stable"):
        if sizes[b] <= 1:
            break
        own, seed = keys[order[begins[b] : begins[b] + sizes[b]]], 0
        while True:
            to = _slots(own, np.arange(seed, seed + 64)[:, None], n)
            good = ~taken[to].any(axis=1)
            for k in np.flatnonzero(good):
                if len(set(to[k].tolist())) == len(own):
                    break
            else:
                seed += 64
                continue
            seeds[b], taken[to[k]] = seed + int(k), True
            break
    free = np.flatnonzero(~taken)
    seeds[np.flatnonzero(sizes == 1)] = -1 - free
    return seeds


def lookup(seeds: np.ndarray, n: int, keys: np.ndarray) -> np.ndarray:
    """The slot of each key. A key that was not built in gets some slot: compare fingerprints."""
    seed = seeds[(mix(keys) % np.uint64(len(seeds))).astype(np.int64)].astype(np.int64)
    return np.where(seed < 0, -1 - seed, _slots(keys, np.maximum(seed, 0), n)) if n else np.zeros(0, dtype=np.int64)
