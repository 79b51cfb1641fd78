"""Hamming distances of many sketches at once, bit-sliced.

A block's sketches are stored vertically: plane p holds bit p of every record, 64 records a word. For a strip of
queries each plane is XORed with the queries' own bit and the result, one difference bit per pair, is added to
vertical counters. Sixteen planes at a time pass through a tree of carry-save adders (sum = a^b^c, carry = the
majority), so that only one carry in sixteen ripples through the high counters. After every 32 planes the
queries all of whose partners already exceed the radius are abandoned.
"""

from __future__ import annotations

import numpy as np

STRIP = 64  # queries at once: a strip's counters stay in the processor's cache
SMALL = 48  # below this many records a block is compared pair by pair
BLOCK = 8192  # records of a block that are sliced at once; larger blocks go tile by tile


def planes_of(sketch: np.ndarray) -> np.ndarray:
    """(planes, words) uint64 from (records, bits / 64) uint64; the last word is padded with zeros."""
    n, per = sketch.shape
    lanes = -(-n // 64)
    bits = np.unpackbits(np.ascontiguousarray(sketch).view(np.uint8), axis=1, bitorder="little")
    padded = np.zeros((lanes * 64, per * 64), np.uint8)
    padded[:n] = bits
    return np.packbits(padded.T.copy(), axis=1, bitorder="little").view(np.uint64)


def _csa(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def _over(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose vertical counter exceeds the radius: the carry out of counter + (2^k - 1 - radius)."""
    carry = np.zeros_like(counter[0])
    add = (1 << len(counter)) - 1 - radius
    for k, bit in enumerate(counter):
        carry = (bit | carry) if add >> k & 1 else (bit & carry)
    return carry


def within(queries: np.ndarray, planes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, record) of all pairs at a Hamming distance of at most ``radius``."""
    n_bits = planes.shape[0]
    bits = np.unpackbits(np.ascontiguousarray(queries).view(np.uint8), axis=1, bitorder="little")
    out_q, out_r = [], []
    width = n_bits.bit_length()
    if radius >= n_bits:
        radius = n_bits
    for s in range(0, len(queries), STRIP):
        alive = np.arange(s, min(s + STRIP, len(queries)))
        counter = [np.zeros((len(alive), planes.shape[1]), np.uint64) for _ in range(width)]
        for g in range(0, n_bits, 16):
            mask = (np.uint64(0) - bits[alive, g : g + 16].astype(np.uint64))[:, :, None]
            d = [planes[g + i][None] ^ mask[:, i] for i in range(16)]
            ones, twos, fours, eights = counter[:4]
            e = []
            for h in (0, 8):
                f = []
                for q in (h, h + 4):
                    ones, t1 = _csa(ones, d[q], d[q + 1])
                    ones, t2 = _csa(ones, d[q + 2], d[q + 3])
                    twos, f1 = _csa(twos, t1, t2)
                    f.append(f1)
                fours, e1 = _csa(fours, *f)
                e.append(e1)
            eights, carry = _csa(eights, *e)
            counter[:4] = ones, twos, fours, eights
            for k in range(4, width):
                counter[k], carry = counter[k] ^ carry, counter[k] & carry
            if g % 32 == 16 and g + 16 < n_bits:
                live = (_over(counter, radius) != np.uint64(0xFFFFFFFFFFFFFFFF)).any(axis=1)
                if not live.all():
                    alive = alive[live]
                    if not len(alive):
                        break
                    counter = [c[live] for c in counter]
        if len(alive):
            close = ~_over(counter, radius)
            q, word = np.nonzero(close)
            if len(q):
                lanes = np.unpackbits(close[q, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                at, lane = np.nonzero(lanes)
                out_q.append(alive[q[at]])
                out_r.append(word[at] * 64 + lane)
    if not out_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_q), np.concatenate(out_r)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def close_pairs(sketch: np.ndarray, size: np.ndarray, limit) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i < j, of one block's records whose distance is at most ``limit(size_i + size_j)``."""
    n = len(sketch)
    found_i, found_j = [], []
    order = np.argsort(size, kind="stable")  # alike sizes side by side keep the common radius of a tile small
    sk, sz = sketch[order], size[order]
    for a in range(0, n, BLOCK):
        planes = planes_of(sk[a : a + BLOCK])
        for s in range(0, min(n, a + BLOCK), 1024):
            # the queries of a strip are not larger than the block's largest records
            e = min(s + 1024, n)
            radius = int(limit(int(sz[min(a + BLOCK, n) - 1]) + int(sz[e - 1])))
            q, r = within(sk[s:e], planes, radius)
            q, r = q + s, r + a
            keep = (r < n) & (q < r)
            q, r = q[keep], r[keep]
            keep = distances(sk[q], sk[r]) <= limit(sz[q] + sz[r])
            found_i.append(order[q[keep]])
            found_j.append(order[r[keep]])
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    return np.minimum(i, j), np.maximum(i, j)


def close_across(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray, limit) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of records of two blocks whose distance is at most ``limit(a_size_i + b_size_j)``."""
    found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s in range(0, len(b), BLOCK):
        part, size = b[s : s + BLOCK], b_size[s : s + BLOCK]
        i, j = within(a, planes_of(part), int(limit(int(a_size.max()) + int(size.max()))))
        keep = j < len(part)
        i, j = i[keep], j[keep]
        keep = distances(a[i], part[j]) <= limit(a_size[i] + size[j])
        found_i.append(i[keep])
        found_j.append(j[keep] + s)
    return np.concatenate(found_i), np.concatenate(found_j)
