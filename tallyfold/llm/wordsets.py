"""Records as sets of words, and the blocking keys that near-duplicate search and batch deduplication share.

A record's words are the distinct lower-cased runs of letters and digits of its text columns. Each word is
kept as a 32-bit hash (two words of one pair of records collide with a chance of about 2e-6), a record as the
sorted array of them. Everything here runs in Arrow batches; no record's words ever reach the driver.

Blocking keys
    Two sets with a Jaccard similarity of at least ``t`` share their globally rarest common word, and that word
    lies in the first ``n - ceil(t n) + 1`` words of either in order of rarity (prefix filter). Words found in at
    most ``rare`` sets therefore serve as keys as they are: no pair that shares one is lost. A pair that shares
    none has spent the rare words of both on its allowed difference, so that its common words are even more
    alike than ``t``; those pairs meet in min-wise bands over the common words, as many for every record: a pair meets
    only in bands that both have. A record whose prefix is all rare needs no band: it shares one of these words
    with whatever it is alike.

Sketches
    The 128-bit sketch of a set is the parity of its words over 128 cells. The Hamming distance of two sketches
    never exceeds the size of the symmetric difference, so comparing it with the largest allowed difference,
    (1 - t) / (1 + t) * (n_a + n_b), loses nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.storage import spread

WORD = re.compile(r"[^\W_]+")
DF_BITS = 18  # cells of the document-frequency table: fixed, whatever the vocabulary
SKETCH_BITS = 128
BAND_ROWS = 4
BANDS = 26


class _Hashes(dict):
    """Word to 32-bit hash; forgets everything when it grows beyond a million words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word) & 0xFFFFFFFF
        return h


def words_of(parts: list[str | None]) -> set[str]:
    """The distinct lower-cased runs of letters and digits, nulls skipped."""
    return set(WORD.findall(" ".join(p for p in parts if p is not None).lower()))


def word_sets(df: DataFrame, key: str, texts: list[str], required: str) -> DataFrame:
    """(key, set_id, n_words, words): the word sets of the rows whose ``required`` text is not blank. A task gives the
    words of a set once and null for its further copies, so a hot group of copies is shuffled as rows of numbers.

    Rows with a null key or a null or blank required text, or with no word at all, take no part. Blank means
    nothing but white space, as Unicode counts it. Extra columns are ignored, whatever their names."""
    picked = df.select(F.col(key).cast("long").alias("key"), F.col(required).alias("need"), *[F.col(c).cast("string").alias(f"t{i}") for i, c in enumerate(texts)]).where(F.col("key").isNotNull() & F.col("need").isNotNull())
    n = len(texts)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Hashes()
        seen: set[int] = set()
        for b in batches:
            keys, ids, sizes, blobs = [], [], [], []
            for key_, need, *parts in zip(b.column("key").to_pylist(), b.column("need").to_pylist(), *[b.column(f"t{i}").to_pylist() for i in range(n)]):
                if not need.strip():
                    continue
                words = words_of(parts)
                if not words:
                    continue
                a = np.unique(np.fromiter(map(cache.__getitem__, words), np.uint32, len(words)))
                blob = a.tobytes()
                name = xxhash.xxh3_64_intdigest(blob) - (1 << 63)
                keys.append(key_)
                ids.append(name)
                sizes.append(len(a))
                blobs.append(None if name in seen else blob)
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(name)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(blobs, pa.binary())], ["key", "set_id", "n_words", "words"])

    return spread(picked).mapInArrow(hashed, "key long, set_id long, n_words int, words binary")


def frequencies(sets: DataFrame) -> np.ndarray:
    """How many sets have a word of each of 2**DF_BITS cells: counted in the tasks, summed by Spark; the driver
    gets the finished table, whose size does not depend on the data. Copies in one task count once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << DF_BITS, np.int64)
        for b in batches:
            w = np.frombuffer(b"".join(b.column("words").to_pylist()), np.uint32)
            total += np.bincount(w >> (32 - DF_BITS), minlength=1 << DF_BITS)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 50_000):
            part = at[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], ["cell", "n"])

    out = np.zeros(1 << DF_BITS, np.int64)
    got = sets.where("words is not null").select("words").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return out


def rare_limit(n_sets: int) -> int:
    """Words in at most so many sets are keys of their own: half a percent of the sets, 5000 at most, so that
    the work per record stays bounded however large the collection is."""
    return int(min(5000, max(16, n_sets // 200)))


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 32-bit finalizer (multiply and shift) with a seed."""
    x = x ^ np.uint32(seed)
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def sketches(words: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """(n, 2) uint64: the parity of every row's words over 128 cells."""
    cell = _mix(words, 0x9E3779B9) & np.uint32(SKETCH_BITS - 1)
    odd = (np.bincount(row * SKETCH_BITS + cell, minlength=n * SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, SKETCH_BITS), axis=1, bitorder="little").view(np.uint64)


def keys_of(blobs: list[bytes], sizes: np.ndarray, cells: np.ndarray, rare: int, threshold: float, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, sketches): the blocking keys of a batch of word sets.

    least: words in fewer sets than this can have no partner and give no key."""
    n = len(blobs)
    words = np.frombuffer(b"".join(blobs), np.uint32)
    row = np.repeat(np.arange(n), sizes)
    sk = sketches(words, row, n)
    df = cells[words >> (32 - DF_BITS)]
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    is_rare = df <= rare
    # the prefix: the place of each word in its row's order of rarity
    r = np.flatnonzero(is_rare)
    by = r[np.lexsort((words[r], df[r], row[r]))]
    n_rare = np.bincount(row[r], minlength=n)
    first = np.concatenate([[0], np.cumsum(n_rare)[:-1]])
    place = np.arange(len(by)) - first[row[by]]
    prefix = sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1
    keep = by[(place < prefix[row[by]]) & (df[by] >= least)]
    out_row, out_key = [row[keep]], [words[keep].astype(np.uint64) << np.uint64(8)]
    # min-wise bands over the common words
    c = np.flatnonzero(~is_rare & (n_rare < prefix)[row])
    if len(c):
        rows_c, at = np.unique(row[c], return_index=True)
        w = words[c]
        for band in range(BANDS):
            key = np.full(len(rows_c), band + 1, np.uint64)
            for k in range(BAND_ROWS):
                low = np.minimum.reduceat(_mix(w, 0x1000193 * (band * BAND_ROWS + k + 1) & 0xFFFFFFFF), at)
                key = (key ^ low.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            out_row.append(rows_c)
            out_key.append((key & ~np.uint64(0xFF)) | np.uint64(band + 1))
    return np.concatenate(out_row), np.concatenate(out_key), sk


def largest_difference(size_sum: np.ndarray | int, threshold: float) -> np.ndarray:
    """The largest symmetric difference that two sets of so many words together may have."""
    return np.floor(np.asarray(size_sum) * (1 - threshold) / (1 + threshold) + 1e-9).astype(np.int64)


def overlap(a: bytes, b: bytes) -> int:
    """How many words two sets share, by their sorted arrays."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())
