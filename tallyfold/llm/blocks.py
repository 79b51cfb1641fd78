"""Postings of blocking keys, gathered by key, and the comparison within each block.

The mappers write postings as packed records, one blob per destination, so that a shuffle of millions of
postings is a few thousand rows; a destination is a range of the key's hash. Copies of one set inside a mapper
are sent once. A reducer sorts its postings by key and compares the records of each block by their sketches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm import bitslice, wordsets
from tallyfold.storage import materialize

#: key: KEY_BITS of the key's hash within its destination (keys that agree by chance share a block, no more); id: the set; n: its words, from MANY on as MANY, and OF_NEW if it is new; s: its sketch
POSTING = np.dtype([("key", "<u4"), ("id", "<i8"), ("n", "<u2"), ("s", "<u8", (2,))])
MANY, OF_NEW = 0x7FFF, 0x8000
KEY_BITS = 24
TARGET_BYTES = 24 << 20  # of postings that one reducer takes
SPLIT = 16384  # records of a block from which its comparison is dealt out as tiles
TILE = 8192


def packed(rec: np.ndarray) -> bytes:
    """Postings as they are shuffled and kept: in the order of their keys, column by column; keys as differences and sizes byte
    by byte, so that the bytes that hardly change stand together and are compressed away. 29 bytes a posting before that."""
    rec = rec[np.argsort(rec["key"], kind="stable")]
    step = np.diff(rec["key"], prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4)
    size = np.ascontiguousarray(rec["n"]).view(np.uint8).reshape(-1, 2)
    return b"".join([step[:, : KEY_BITS // 8].T.tobytes(), size.T.tobytes(), rec["id"].tobytes(), rec["s"].tobytes()])


def unpacked(blobs: list[bytes]) -> np.ndarray:
    """The postings of packed blobs, one after the other."""
    per = KEY_BITS // 8
    counts = [len(b) // (per + 26) for b in blobs]
    out, at = np.empty(sum(counts), POSTING), 0
    for b, n in zip(blobs, counts):
        step = np.zeros((n, 4), np.uint8)
        step[:, :per] = np.frombuffer(b, np.uint8, per * n).reshape(per, n).T
        to = slice(at, at + n)
        out["key"][to] = np.cumsum(step.view("<u4").reshape(-1), dtype=np.uint32)
        out["n"][to] = np.frombuffer(b, np.uint8, 2 * n, per * n).reshape(2, n).T.copy().view("<u2").reshape(-1)
        out["id"][to] = np.frombuffer(b, "<i8", n, (per + 2) * n)
        out["s"][to] = np.frombuffer(b, "<u8", 2 * n, (per + 10) * n).reshape(n, 2)
        at += n
    return out


def noted(n: np.ndarray, side: int) -> np.ndarray:
    return (np.minimum(n, MANY) | (OF_NEW if side else 0)).astype(np.uint16)


def sizes_of(n: np.ndarray) -> np.ndarray:
    """The words of sets as noted; of MANY or more no limit is known, so that none is drawn."""
    size = (n & MANY).astype(np.int64)
    return np.where(size == MANY, np.int64(1) << 40, size)


def is_new(n: np.ndarray) -> np.ndarray:
    return (n >> 15).astype(np.uint8)


def partitions_for(n_sets: int, floor: int) -> int:
    """So many reducers that each gets about TARGET_BYTES at all bands and 20 rare words a set."""
    return max(floor, -(-n_sets * (wordsets.BANDS + 20) * POSTING.itemsize // TARGET_BYTES))


def postings(sets: DataFrame, cells: np.ndarray, rare: int, threshold: float, least: int, destinations: int, side: int = 0) -> DataFrame:
    """(dest, blob): every set's postings, packed by destination."""
    sc = sets.sparkSession.sparkContext
    shared = sc.broadcast(cells.astype(np.int32))  # 2**DF_BITS counts: 1 MB whatever the data

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells_ = shared.value
        seen: set[int] = set()
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            dest = np.concatenate([d for d, _ in held])
            rec = np.concatenate([r for _, r in held])
            order = np.argsort(dest, kind="stable")
            dest, rec = dest[order], rec[order]
            names, at = np.unique(dest, return_index=True)
            ends = np.append(at[1:], len(dest))
            return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array([packed(rec[a:b]) for a, b in zip(at, ends)], pa.binary())], ["dest", "blob"])

        for b in batches:
            ids, n, blobs = b.column("set_id").to_numpy(), b.column("n_words").to_numpy().astype(np.int64), b.column("words").to_pylist()
            fresh = []
            for i, x in enumerate(ids.tolist()):
                if x not in seen:
                    seen.add(x)
                    fresh.append(i)
            if len(seen) > 2_000_000:
                seen.clear()
            for s in range(0, len(fresh), 2000):
                pick = np.array(fresh[s : s + 2000])
                row, key, sk = wordsets.keys_of([blobs[i] for i in pick], n[pick], cells_, rare, threshold, least)
                rec = np.empty(len(row), POSTING)
                mixed = key * np.uint64(0xD6E8FEB86659FD93)
                mixed ^= mixed >> np.uint64(32)
                mixed *= np.uint64(0xD6E8FEB86659FD93)
                rec["key"] = (mixed & np.uint64((1 << KEY_BITS) - 1)).astype(np.uint32)
                rec["id"], rec["n"], rec["s"] = ids[pick][row], noted(n[pick][row], side), sk[row]
                held.append((((mixed >> np.uint64(32)) % np.uint64(destinations)).astype(np.int32), rec))
                size += rec.nbytes
                if size > 48 << 20:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return sets.where("words is not null").select("set_id", "n_words", "words").mapInArrow(emit, "dest int, blob binary")


def _blocks(rec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the runs of equal (dest, key)."""
    change = np.flatnonzero((rec["key"][1:] != rec["key"][:-1]) | (rec["dest"][1:] != rec["dest"][:-1])) + 1
    start = np.concatenate([[0], change])
    return start, np.diff(np.append(start, len(rec)))


def candidates(gathered: DataFrame, threshold: float, new_only: bool = False, split: int = SPLIT) -> DataFrame:
    """(a, b): pairs of different sets, a < b, that meet in a block and whose sketches are near enough; a pair may
    come more than once. ``gathered``: postings, all of a destination in one task.

    A hot block, of more than ``split`` records, is not compared where it was gathered: every pair of its tiles goes
    to a task of its own. new_only: only pairs with a new set. The first step's result is a written table."""

    def limit(total):
        return wordsets.largest_difference(total, threshold)

    wide = np.dtype([("dest", "<i4"), *[(n, POSTING.fields[n][0]) for n in POSTING.names]])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for b in batches:
            for d, blob in zip(b.column("dest").to_pylist(), b.column("blob").to_pylist()):
                p = unpacked([blob])
                w = np.empty(len(p), wide)
                w["dest"] = d
                for name in POSTING.names:
                    w[name] = p[name]
                parts.append(w)
        if not parts:
            return
        rec = np.concatenate(parts)
        del parts
        rec = rec[np.lexsort((rec["n"], rec["id"], rec["key"], rec["dest"]))]
        twice = np.zeros(len(rec), bool)  # copies of a set in one block count once
        twice[1:] = (rec["id"][1:] == rec["id"][:-1]) & (rec["key"][1:] == rec["key"][:-1]) & (rec["dest"][1:] == rec["dest"][:-1]) & (rec["n"][1:] == rec["n"][:-1])
        rec = rec[~twice]
        start, length = _blocks(rec)
        ids, sizes, sk, side = rec["id"].copy(), sizes_of(rec["n"]), np.ascontiguousarray(rec["s"]), is_new(rec["n"])
        found: list[np.ndarray] = []
        held = 0

        def keep(i: np.ndarray, j: np.ndarray) -> None:
            nonlocal held
            ok = ids[i] != ids[j]
            if new_only:
                ok &= (side[i] | side[j]) == 1
            i, j = i[ok], j[ok]
            found.append(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])], axis=1))
            held += len(i)

        def flush() -> pa.RecordBatch:
            both = np.unique(np.concatenate(found), axis=0)
            return _given(both[:, 0], both[:, 1], None)

        for n in range(2, min(bitslice.SMALL, split + 1)):
            at = start[length == n]
            i, j = np.triu_indices(n, 1)
            step = max(1, 400_000 // len(i))
            for s in range(0, len(at), step):
                p, q = (at[s : s + step, None] + i[None]).ravel(), (at[s : s + step, None] + j[None]).ravel()
                near = bitslice.distances(sk[p], sk[q]) <= limit(sizes[p] + sizes[q])
                keep(p[near], q[near])
        large = length >= min(bitslice.SMALL, split + 1)
        for at, n in zip(start[large], length[large]):
            block = slice(at, at + n)
            if new_only and not side[block].any():
                continue
            if n > split:
                order = at + np.argsort(sizes[block], kind="stable")
                tiles = [rec[order[s : s + min(TILE, split)]][list(POSTING.names)].astype(POSTING).tobytes() for s in range(0, n, min(TILE, split))]
                for x in range(len(tiles)):
                    yield _given([None] * (len(tiles) - x), [None] * (len(tiles) - x), [tiles[x] + (tiles[y] if y > x else b"") + np.int64(len(tiles[x])).tobytes() for y in range(x, len(tiles))])
                continue
            i, j = bitslice.close_pairs(sk[block], sizes[block], limit)
            keep(i + at, j + at)
            if held > 1_000_000:
                yield flush()
                found, held = [], 0
        if found:
            yield flush()

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column("tile").to_pylist():
                cut = int(np.frombuffer(blob[-8:], np.int64)[0])
                x, y = np.frombuffer(blob[:cut], POSTING), np.frombuffer(blob[cut:-8], POSTING)
                if len(y):
                    i, j = bitslice.close_across(np.ascontiguousarray(x["s"]), sizes_of(x["n"]), np.ascontiguousarray(y["s"]), sizes_of(y["n"]), limit)
                else:
                    y = x
                    i, j = bitslice.close_pairs(np.ascontiguousarray(x["s"]), sizes_of(x["n"]), limit)
                ok = x["id"][i] != y["id"][j]
                if new_only:
                    ok &= (is_new(x["n"])[i] | is_new(y["n"])[j]) == 1
                a, c = x["id"][i][ok], y["id"][j][ok]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, c)), pa.array(np.maximum(a, c))], ["a", "b"])

    first = materialize(gathered.mapInArrow(compare, "a long, b long, tile binary"), "blocks")
    hot = first.where("tile is not null").select("tile")
    pairs = first.where("a is not null").select("a", "b")
    if hot.isEmpty():
        return pairs
    return pairs.unionByName(hot.repartition(4 * gathered.sparkSession.sparkContext.defaultParallelism).mapInArrow(tile, "a long, b long"))


def _given(a: list | np.ndarray, b: list | np.ndarray, tiles: list[bytes] | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(tiles if tiles else [None] * len(a), pa.binary())], ["a", "b", "tile"])


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, shared, total): the pairs whose word sets are alike in fact: shared >= threshold * total."""
    pairs = pairs.distinct()
    involved = pairs.select(F.col("a").alias("set_id")).union(pairs.select(F.col("b").alias("set_id"))).distinct()
    words = sets.where("words is not null").select("set_id", "words").join(involved, "set_id", "left_semi").dropDuplicates(["set_id"])
    both = pairs.join(words.toDF("a", "words_a"), "a").join(words.toDF("b", "words_b"), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wa, wb = b.column("words_a").to_pylist(), b.column("words_b").to_pylist()
            shared = np.array([wordsets.overlap(x, y) for x, y in zip(wa, wb)], np.int64)
            total = np.array([(len(x) + len(y)) // 4 for x, y in zip(wa, wb)], np.int64) - shared
            ok = shared + 1e-9 >= threshold * total
            yield pa.RecordBatch.from_arrays([pa.array(b.column("a").to_numpy()[ok]), pa.array(b.column("b").to_numpy()[ok]), pa.array(shared[ok]), pa.array(total[ok])], ["a", "b", "shared", "total"])

    return both.mapInArrow(check, "a long, b long, shared long, total long")
