"""Canonical length-limited Huffman codes over ids, in blocks that decode independently."""

from __future__ import annotations

import numpy as np

MAX_BITS = 20
BLOCK_IDS = 256


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most max_bits for counts (0: no code), by package-merge."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    used = used[np.argsort(counts[used], kind="stable")]
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if n > 1 << max_bits:
        raise ValueError("too many symbols for this code length")
    weights = counts[used].astype(np.int64)
    level, leaves = weights, [np.ones(n, bool)]
    for _ in range(max_bits - 1):
        pairs = level[0 : len(level) // 2 * 2 : 2] + level[1::2]
        both = np.concatenate((weights, pairs))
        order = np.argsort(both, kind="stable")
        level = both[order]
        leaves.append(order < n)
    take, of_used = 2 * n - 2, np.zeros(n, np.int64)
    for is_leaf in reversed(leaves):
        k = int(is_leaf[:take].sum())
        of_used[:k] += 1
        take = 2 * (take - k)
    lengths[used] = of_used
    return lengths


class Codebook:
    """The canonical code of some lengths: shorter codes first, then smaller ids."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        self.bits = max(int(lengths.max(initial=0)), 1)
        span = np.int64(1) << (self.bits - self.lengths[order])
        first = np.concatenate(([0], np.cumsum(span)[:-1])) if len(order) else span
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = (first >> (self.bits - self.lengths[order])).astype(np.uint64)
        # All windows of self.bits bits that begin with a code: its id and its length.
        self.table = np.zeros(1 << self.bits, np.uint32)
        filled = np.repeat((order.astype(np.uint32) << 5) | self.lengths[order].astype(np.uint32), span)
        self.table[: len(filled)] = filled

    def encode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[list[bytes], list[np.ndarray]]:
        """Of documents of these sizes, one after another in ids: payloads and their blocks' first bits."""
        ends = np.cumsum(sizes)
        begins = ends - sizes
        width = self.lengths[ids]
        upto = np.concatenate(([0], np.cumsum(width)))
        n_bytes = (upto[ends] - upto[begins] + 7) // 8
        stop = np.cumsum(n_bytes)
        at_byte = stop - n_bytes
        at = upto[:-1] + np.repeat(at_byte * 8 - upto[begins], sizes)
        shift = (64 - (at & 31) - width).astype(np.uint64)
        value = self.codes[ids] << shift
        word, n_words = at >> 5, int(stop[-1] if len(stop) else 0) // 4 + 2
        # Codes don't overlap, so sums of disjoint bits, exact in doubles, are unions.
        packed = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), n_words)
        packed += np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n_words)
        data = packed.astype(np.uint32).astype(">u4").tobytes()
        payloads = [data[a:b] for a, b in zip(at_byte.tolist(), stop.tolist())]
        blocks = [at[a:b:BLOCK_IDS] - 8 * o for a, b, o in zip(begins.tolist(), ends.tolist(), at_byte.tolist())]
        return payloads, blocks

    def decode(self, payloads: list[bytes], sizes: list[int], blocks: list[list[int]]) -> np.ndarray:
        """The documents' ids, one after another; all blocks advance together, an id a step."""
        offsets = np.concatenate(([0], np.cumsum([len(p) for p in payloads])))[:-1] * 8
        n_blocks = np.array([len(b) for b in blocks], np.int64)
        if not n_blocks.sum():
            return np.zeros(0, np.uint32)
        data = np.frombuffer(b"".join([*payloads, b"\0\0\0\0"]), np.uint8).astype(np.uint32)
        windows = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        at = np.concatenate([np.asarray(b, np.int64) for b in blocks]) + np.repeat(offsets, n_blocks)
        rest = np.repeat(np.asarray(sizes, np.int64), n_blocks)
        within = np.arange(len(at)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        size = np.minimum(rest - within * BLOCK_IDS, BLOCK_IDS)
        order = np.argsort(-size, kind="stable")
        at, sorted_size = at[order], size[order]
        out = np.zeros((BLOCK_IDS, len(at)), np.uint32)
        mask, spare = np.uint32((1 << self.bits) - 1), np.uint32(32 - self.bits)
        active = np.searchsorted(-sorted_size, -np.arange(BLOCK_IDS), side="left")  # blocks longer than the step
        for step in range(int(sorted_size[0])):
            here = at[: active[step]]
            window = windows[here >> 3] >> (spare - (here & 7).astype(np.uint32))
            entry = self.table[window & mask]
            out[step, : active[step]] = entry >> 5
            here += entry & 31
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.arange(len(order))
        return out.T[inverse][np.arange(BLOCK_IDS)[None, :] < size[:, None]]
