"""Deduplicating new batches against all history (problem 2) with a persistent fingerprint store.

The store is a folder of parquet tables, each with a folder for every ingest:

``meta``          one row: the frozen word frequencies, what counts as rare, the threshold, the number of parts
``fingerprints``  (part, blob, bloom): per ingest and part the packed fingerprints, sorted, and a Bloom filter of them
``sets``          (set_id, n_words, words): the word sets, to verify what the fingerprints propose
``ids``           (key, id_key): the ids of every row seen
``manifest``      (version, folder, batch): the folders that count, those of the highest version

Fingerprints are min-wise winnowed: a record's rare words, and per band the smallest hashes of its common words
(``wordsets.keys_of``). Winnowing in hash order instead of text order is needed here because rows count as alike by
the words they share, in whatever order. Frequencies are frozen when the store is made, so that a
fingerprint never changes; words unknown to the store count as rare.

``ingest`` never works through the history again. It
1. fingerprints the new rows,
2. asks the Bloom filters of the parts concerned, which drop fingerprints nobody had before,
3. reads the parts with positives, keeps the fingerprints asked for (a fixed-size filter of the positives goes
   to the readers; nothing else of the history is shuffled), compares sketches,
4. verifies the shared coverage, that is the shared words against all words of both, with the exact sets,
5. adds the new fingerprints, filters, sets and ids, by a new version of the manifest.

Rows without a usable text still match by id. Null and blank ids match nothing. Within one call rows are told
apart by their key, so several batches may be ingested at once with the same result as one after the other. The manifest is written
last: what a failed ingest left behind is never read, and a retry writes a folder of its own. A batch that is ingested under a
name already in the manifest is reported again and adds nothing. ``compact`` rewrites all folders as one. Empty batches and an empty history give an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import blocks, wordsets
from tallyfold.storage import materialize, new_folder

BITS_PER_KEY = 12
PROBES = 4
LANE_BITS = 23  # of the filter of what a batch looks for: a megabyte, whatever the batch


def _spots(key: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The places of 32-bit keys in a Bloom filter of so many (a power of two) bits."""
    x = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    step = (x >> np.uint64(32)) | np.uint64(1)
    for k in range(PROBES):
        yield ((x + np.uint64(k) * step) & np.uint64(bits - 1)).astype(np.int64)


def bloom(key: np.ndarray) -> bytes:
    """A Bloom filter of at least BITS_PER_KEY bits a key: about 1 % false positives."""
    bits = 1 << max(6, int(np.ceil(np.log2(max(1, len(key)) * BITS_PER_KEY))))
    on = np.zeros(bits, np.uint8)
    for at in _spots(key, bits):
        on[at] = 1
    return np.packbits(on, bitorder="little").tobytes()


def in_bloom(key: np.ndarray, filter_: bytes) -> np.ndarray:
    raw = np.frombuffer(filter_, np.uint8)
    hit = np.ones(len(key), bool)
    for at in _spots(key, len(raw) * 8):
        hit &= (raw[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return hit


def _lanes(df: DataFrame, column: str) -> np.ndarray:
    """A fixed-size filter (2**LANE_BITS bits) of the 64-bit values of a column, made by Spark's bit_or."""
    spot = F.shiftrightunsigned(F.xxhash64(column), 64 - LANE_BITS)
    bits = df.where(F.col(column).isNotNull()).select(spot.alias("spot")).selectExpr("cast(spot div 64 as int) AS lane", "shiftleft(1L, cast(spot % 64 as int)) AS bit")
    got = bits.groupBy("lane").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (LANE_BITS - 6), np.int64)
    out[got.column("lane").to_numpy()] = got.column("bits").to_numpy()
    return out


def _asked(df: DataFrame, column: str, lanes: np.ndarray) -> DataFrame:
    """The rows whose value may be among those the lanes were made of; the others don't leave their task."""
    shared = df.sparkSession.sparkContext.broadcast(lanes)
    columns = df.columns
    named = df.withColumn("_spot", F.shiftrightunsigned(F.xxhash64(column), 64 - LANE_BITS))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = shared.value.view(np.uint64)
        for b in batches:
            s = b.column("_spot").to_numpy().astype(np.int64)
            hit = (on[s >> 6] >> (s & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            yield b.select(columns).filter(pa.array(hit))

    return named.where(F.col(column).isNotNull()).mapInArrow(keep, df.schema)


def _by_part(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> dict[int, list[list[bytes]]]:
    """part -> for each column the values that are not null."""
    out: dict[int, list[list[bytes]]] = {}
    for b in batches:
        for part, *values in zip(b.column("dest").to_pylist(), *[b.column(c).to_pylist() for c in columns]):
            have = out.setdefault(part, [[] for _ in columns])
            for h, v in zip(have, values):
                if v is not None:
                    h.append(v)
    return out


def _sorted(blobs: list[bytes]) -> np.ndarray:
    rec = blocks.unpacked(blobs)
    rec = rec[np.lexsort((rec["id"], rec["key"]))]
    rec["n"] &= blocks.MANY  # in the store they are new no more
    return rec


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a part: its fingerprints sorted by key, and their Bloom filter."""
    for part, (blobs,) in _by_part(batches, ("blob",)).items():
        rec = _sorted(blobs)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([blocks.packed(rec)], pa.binary()), pa.array([bloom(np.unique(rec["key"]))], pa.binary())], ["dest", "blob", "bloom"])


def _prescreened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a part: the new fingerprints that a Bloom filter of the part knows or that two new sets share (wanted), and
    all new ones as they go into the store."""
    for part, (blobs, filters) in _by_part(batches, ("blob", "bloom")).items():
        if not blobs:
            continue
        rec = blocks.unpacked(blobs)
        key, at, n = np.unique(rec["key"], return_inverse=True, return_counts=True)
        hit = n > 1
        for f in filters:
            hit |= in_bloom(key, f)
        want = rec[hit[at]]
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([blocks.packed(want) if len(want) else None], pa.binary()), pa.array([blocks.packed(_sorted(blobs))], pa.binary()), pa.array([bloom(key)], pa.binary())], ["dest", "wanted", "blob", "bloom"])


class FingerprintStore:
    """History as fingerprints, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        meta = spark.read.parquet(f"{path}/meta").first()
        self.cells = np.frombuffer(meta["cells"], np.int32)
        self.rare, self.threshold, self.parts = meta["rare"], meta["threshold"], meta["parts"]
        self.key, self.texts, self.required, self.id = meta["key"], list(meta["texts"]), meta["required"], meta["id"]

    @classmethod
    def create(cls, history: DataFrame, key: str, id: str, texts: list[str], required: str, threshold: float = 0.7, path: str | None = None) -> FingerprintStore:
        """A store of all rows of ``history``. ``key``: unique, integral, grows with arrival."""
        spark = history.sparkSession
        path = path or new_folder(spark, "store")
        folder = uuid.uuid4().hex
        cls._rows(history, key, id, texts, required, path, folder)
        sets = spark.read.parquet(f"{path}/sets/{folder}")
        n = sets.count()
        cells = wordsets.frequencies(sets)
        parts = 8 * blocks.partitions_for(n, int(spark.conf.get("spark.sql.shuffle.partitions")))
        schema = "cells binary, rare long, threshold double, parts int, key string, texts array<string>, required string, id string"
        spark.createDataFrame([(cells.astype(np.int32).tobytes(), wordsets.rare_limit(n), threshold, parts, key, texts, required, id)], schema).coalesce(1).write.parquet(f"{path}/meta")
        self = cls(spark, path)
        sent = blocks.postings(sets, self.cells, self.rare, self.threshold, 0, self.parts, 0)
        sent.repartition(max(1, parts // 8), "dest").mapInArrow(_packed, "dest int, blob binary, bloom binary").write.parquet(f"{path}/fingerprints/{folder}")
        self._commit([(folder, None)])
        return self

    def _manifest(self) -> list[tuple[int, str, str | None]]:
        """(version, folder, batch) of the folders that count: as many as there were ingests since the store was compacted."""
        rows = self.spark.read.schema("version long, folder string, batch string").parquet(f"{self.path}/manifest")
        return [tuple(r) for r in rows.join(rows.agg(F.max("version").alias("version")), "version").select("version", "folder", "batch").collect()]

    def _commit(self, folders: list[tuple[str, str | None]], after: int = 0) -> None:
        """Make these the folders that count. One small file, which Spark's committer adds whole or not at all."""
        self.spark.createDataFrame([(after + 1, f, b) for f, b in folders], "version long, folder string, batch string").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _table(self, name: str, known: list[tuple[int, str, str | None]]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{name}/{f}" for f in dict.fromkeys(f for _, f, _ in known)])

    @staticmethod
    def _rows(df: DataFrame, key: str, id: str, texts: list[str], required: str, path: str, folder: str) -> None:
        """Write the word sets and the ids. Two narrow reads of the new rows, no shuffle."""
        wordsets.word_sets(df, key, texts, required).write.parquet(f"{path}/sets/{folder}")
        # any white space at the ends, as Unicode counts it
        norm = F.regexp_replace(F.lower(F.regexp_replace(F.col(id), r"^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$", "")), "^$", "")
        df.select(F.col(key).cast("long").alias("key"), norm.alias("id_key")).where("key is not null and id_key <> ''").write.parquet(f"{path}/ids/{folder}")

    def ingest(self, batch: DataFrame, name: str | None = None) -> DataFrame:
        """(seen_key, new_key): for each row of ``batch`` every row with a smaller key, of the history or of the batch,
        with the same id or alike. The rows of the batch are history from then on, once under a name. The result is a written table."""
        spark, reducers = self.spark, max(1, self.parts // 8)
        known, folder = self._manifest(), uuid.uuid4().hex
        self._rows(batch, self.key, self.id, self.texts, self.required, self.path, folder)
        new_sets, new_ids = spark.read.parquet(f"{self.path}/sets/{folder}"), spark.read.parquet(f"{self.path}/ids/{folder}")
        old_sets, old_ids, old_prints = (self._table(t, known) for t in ("sets", "ids", "fingerprints"))
        sent = blocks.postings(new_sets, self.cells, self.rare, self.threshold, 0, self.parts, 1)
        none = F.lit(None).cast("binary")
        together = sent.withColumn("bloom", none).unionByName(old_prints.select("dest", none.alias("blob"), "bloom"))
        together.repartition(reducers, "dest").mapInArrow(_prescreened, "dest int, wanted binary, blob binary, bloom binary").write.parquet(f"{self.path}/fingerprints/{folder}")
        # what goes into the store is written with what is asked of it, so that it is shuffled once
        positive = spark.read.parquet(f"{self.path}/fingerprints/{folder}").where("wanted is not null").select("dest", F.col("wanted").alias("blob"))
        parts = [r["dest"] for r in positive.select("dest").collect()]  # at most as many as the store has parts
        near = blocks.candidates(positive.unionByName(self._looked_up(old_prints.where(F.col("dest").isin(parts)).select("dest", "blob"), positive)).repartition(reducers, "dest"), self.threshold, new_only=True)
        near = materialize(near.distinct(), "near")
        asked = _lanes(near.select(F.explode(F.array("a", "b")).alias("set_id")), "set_id")
        both = new_sets.unionByName(_asked(old_sets, "set_id", asked))
        alike = blocks.verified(near, both, self.threshold).select("a", "b")
        mine = new_sets.select("set_id").distinct()
        links = alike.unionByName(alike.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(mine.select(F.col("set_id").alias("a"), F.col("set_id").alias("b")))
        mates = _lanes(near.select(F.explode(F.array("a", "b")).alias("set_id")).unionByName(mine), "set_id")
        seen = new_sets.select("key", "set_id").unionByName(_asked(old_sets.select("key", "set_id"), "set_id", mates))
        by_text = links.join(new_sets.select(F.col("set_id").alias("b"), F.col("key").alias("new_key")), "b").join(seen.select(F.col("set_id").alias("a"), F.col("key").alias("seen_key")), "a").select("seen_key", "new_key")
        ids = new_ids.unionByName(_asked(old_ids.select("key", "id_key"), "id_key", _lanes(new_ids, "id_key")))
        by_id = new_ids.select("id_key", F.col("key").alias("new_key")).join(ids.select("id_key", F.col("key").alias("seen_key")), "id_key").select("seen_key", "new_key")
        found = materialize(by_text.unionByName(by_id).where("seen_key < new_key").distinct(), "seen")
        if name is None or name not in [b for _, _, b in known]:
            self._commit([(f, b) for _, f, b in known] + [(folder, name)], known[0][0])
        return found

    def compact(self) -> None:
        """Write all folders that count as one, a part's fingerprints and Bloom filters merged. Results do not change."""
        known, folder = self._manifest(), uuid.uuid4().hex
        for t in ("sets", "ids"):
            self._table(t, known).write.parquet(f"{self.path}/{t}/{folder}")
        prints = self._table("fingerprints", known).select("dest", "blob").repartition(max(1, self.parts // 8), "dest")
        prints.mapInArrow(_packed, "dest int, blob binary, bloom binary").write.parquet(f"{self.path}/fingerprints/{folder}")
        names = {b for _, _, b in known if b is not None}
        self._commit([(folder, b) for b in sorted(names)] or [(folder, None)], known[0][0])

    def _looked_up(self, prints: DataFrame, positive: DataFrame) -> DataFrame:
        """The history's fingerprints with a key of the positives. Their keys go to the readers as a filter of
        fixed size; keys it lets through by mistake form blocks without a new record and end there."""

        def spots(part: int, key: np.ndarray) -> np.ndarray:
            x = (key.astype(np.uint64) ^ np.uint64(part) << np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
            return (x >> np.uint64(64 - LANE_BITS)).astype(np.int64)

        def lanes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            on = np.zeros(1 << LANE_BITS, np.uint8)
            for b in batches:
                for part, blob in zip(b.column("dest").to_pylist(), b.column("blob").to_pylist()):
                    on[spots(part, blocks.unpacked([blob])["key"])] = 1
            packed = np.packbits(on, bitorder="little").view(np.int64)
            at = np.flatnonzero(packed)
            for i in range(0, len(at), 50_000):
                p = at[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(packed[p])], ["lane", "bits"])

        got = positive.mapInArrow(lanes, "lane int, bits long").groupBy("lane").agg(F.bit_or("bits").alias("bits")).toArrow()
        packed = np.zeros(1 << (LANE_BITS - 6), np.int64)
        packed[got.column("lane").to_numpy()] = got.column("bits").to_numpy()
        shared = self.spark.sparkContext.broadcast(packed)

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            on = shared.value.view(np.uint64)
            for b in batches:
                names, kept = [], []
                for part, blob in zip(b.column("dest").to_pylist(), b.column("blob").to_pylist()):
                    rec = blocks.unpacked([blob])
                    s = spots(part, rec["key"])
                    rec = rec[(on[s >> 6] >> (s & 63).astype(np.uint64) & np.uint64(1)).astype(bool)]
                    if len(rec):
                        names.append(part)
                        kept.append(blocks.packed(rec))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(kept, pa.binary())], ["dest", "blob"])

        return prints.mapInArrow(keep, "dest int, blob binary")
