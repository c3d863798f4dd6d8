r"""Line dedup: lines found in many documents go, in every document.

Each text splits at ``\n``. A line's key is the line stripped of ASCII white
space with A-Z lower-cased; keys of at least ``min_chars`` code points that at
least ``min_docs`` documents hold lose all their lines.

One pass hashes the lines to 128 bits and counts documents by key: each Arrow
slice counts its own keys first, so a line that every document holds reaches
the shuffle once a slice. All distinct keys go to shards of some ``SHARD_KEYS``
keys each; a shard is a minimal perfect hash over its line hashes with a
fingerprint and a count array (mph.py). The shards are one table in the shared
folder. A second pass lets the documents probe the arrays, and the count found
decides. As every line of the documents is in the index, each finds its own slot.

While the arrays take at most ``broadcast_bytes`` every task gets the shards.
Beyond that the hashes travel to the shards and only the hits come back to their
documents. The most frequent keys (those in more than a 2**-20 th of all pairs of
key and document, so at most 2**20 keys) would draw all documents to their shards;
they are a small index of their own that every task gets. Both ways give the same rows.

Null or empty text is one empty line, which stays. Repeated rows are documents
of their own. An empty table gives an empty result. Very long texts are read one
to a slice and split as a whole. A column of the name of an output is replaced;
every other column stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchgrid.llm.common import map_text, slices, tidy, unused
from matchgrid.llm.mph import MOST, Shard, build
from matchgrid.sources.store import stored

#: Keys of a shard; a task builds one from 24 bytes a key.
SHARD_KEYS = 1 << 18
#: The most keys that can be frequent ones, and a count below which none is.
FREQUENT_KEYS, FREQUENT_LEAST = 1 << 20, 1000

WHITE = b" \t\n\x0b\x0c\r"
SHARD_SCHEMA = "shard int, sizes array<int>, bits binary, fingerprints binary, counts binary"


def keys_of(text: str | None, min_chars: int = 1) -> list[bytes | None]:
    """The key hash of each line; None where the key is too short to go."""
    out = []
    for line in (text or "").encode().lower().split(b"\n"):
        line = line.strip(WHITE)
        if not line or (min_chars > 1 and len(line.decode()) < min_chars):
            out.append(None)
        else:
            out.append(xxhash.xxh3_128_digest(line))
    return out


def halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def line_counts(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(hi, lo, docs): in how many documents each line key is found."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found: dict[bytes, int] = {}
                for text in part.column("text").to_pylist():
                    for key in set(keys_of(text, min_chars)):
                        if key is not None:
                            found[key] = found.get(key, 0) + 1
                hi, lo = halves(list(found))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array(list(found.values()), pa.int64())],
                    ["hi", "lo", "docs"],
                )

    counted = docs.select("text").mapInArrow(tidy(run), "hi long, lo long, docs long")
    return counted.groupBy("hi", "lo").agg(F.sum("docs").alias("docs"))


def index_shards(counts: DataFrame, shards: int) -> DataFrame:
    """One row per shard: the perfect hash, fingerprints and counts of its keys."""

    def one(key, table):
        hi, lo = (table.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo"))
        sizes, bits, prints, count = build(hi, lo, table.column("docs").to_numpy())
        return pa.table(
            {"shard": pa.array([key[0].as_py()], pa.int32()), "sizes": pa.array([sizes], pa.list_(pa.int32())), "bits": pa.array([bits]), "fingerprints": pa.array([prints]), "counts": pa.array([count])}
        )

    placed = counts.withColumn("shard", F.pmod("hi", F.lit(shards)).cast("int"))
    return placed.groupBy("shard").applyInArrow(one, SHARD_SCHEMA)


def without(text: str | None, keys: list[bytes | None], gone: set[bytes]) -> tuple[str, int, int]:
    lines = (text or "").split("\n")
    kept = [line for line, key in zip(lines, keys, strict=True) if key not in gone]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


OUT = "text string, n_lines long, n_dropped long"


class Index:
    """The shards that a task holds, ready to be probed."""

    def __init__(self, rows: list[tuple], shards: int, min_docs: int):
        self.arrays, self.shards, self.min_docs = {r[0]: Shard(*r[1:]) for r in rows}, shards, min_docs

    def common(self, keys: list[bytes]) -> set[bytes]:
        """Those of distinct keys whose count reaches the threshold."""
        hi, lo = halves(keys)
        shard_of = np.mod(hi.view(np.int64), self.shards)  # as Spark's pmod takes the signed number
        order = np.argsort(shard_of, kind="stable")
        cuts = np.searchsorted(shard_of[order], np.arange(self.shards + 1))
        gone: set[bytes] = set()
        for s, shard in self.arrays.items():
            mine = order[cuts[s] : cuts[s + 1]]
            if len(mine):
                gone.update(keys[i] for i in mine[shard.count(hi[mine], lo[mine]) >= self.min_docs])
        return gone


def sent(index: DataFrame):
    """The rows of a small index as a broadcast value."""
    return index.sparkSession.sparkContext.broadcast([tuple(r) for r in index.collect()])


def dropped_by_broadcast(docs: DataFrame, index: DataFrame, shards: int, min_docs: int, min_chars: int) -> DataFrame:
    rows = sent(index)

    def setup():
        own = Index(rows.value, shards, min_docs)

        def call(texts):
            keys = [keys_of(t, min_chars) for t in texts]
            gone = own.common(list({k for ks in keys for k in ks if k is not None}))
            return list(zip(*(without(t, k, gone) for t, k in zip(texts, keys, strict=True)), strict=True)) or [[], [], []]

        return call

    return map_text(docs, "text", OUT, setup)


def dropped_by_routing(docs: DataFrame, index: DataFrame, shards: int, frequent: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """The line hashes of each text go to the shards, the hits come back by text hash.

    Frequent keys stay at home. Rows of a shard are ordered so that its arrays
    come before the probes, and stream through the task.
    """
    probe_schema = "shard int, kind int, text_key binary, probes binary, sizes array<int>, bits binary, fingerprints binary, counts binary"
    rows = sent(frequent)

    def probes(batches):
        own = Index(rows.value, 1, min_docs)
        for batch in batches:
            for part in slices(batch, "text"):
                found = []
                for text in set(part.column("text").to_pylist()):
                    name = xxhash.xxh3_128_digest((text or "").encode())
                    every = {k for k in keys_of(text, min_chars) if k is not None}
                    every = list(every - own.common(list(every)))
                    by: dict[int, list[bytes]] = {}
                    for k, s in zip(every, np.mod(halves(every)[0].view(np.int64), shards).tolist(), strict=True):
                        by.setdefault(s, []).append(k)
                    found += [(s, 1, name, b"".join(ks), None, None, None, None) for s, ks in by.items()]
                columns = list(zip(*found, strict=True)) or [[]] * 8
                types = [pa.int32()] * 2 + [pa.binary()] * 2 + [pa.list_(pa.int32())] + [pa.binary()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in probe_schema.split(", ")])

    def answer(batches):
        at, shard = None, None
        for batch in batches:
            keys, hits = [], []
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    at, shard = r["shard"], Shard(r["sizes"], r["bits"], r["fingerprints"], r["counts"])
                elif at == r["shard"]:
                    hi, lo = halves([r["probes"]])
                    hit = shard.count(hi, lo) >= min_docs
                    if hit.any():
                        keys.append(r["text_key"])
                        hits.append(np.stack([hi[hit], lo[hit]], 1).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hits, pa.binary())], ["text_key", "hits"])

    arrays = index.select("shard", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("text_key"), F.lit(None).cast("binary").alias("probes"), "sizes", "bits", "fingerprints", "counts")
    both = arrays.unionByName(docs.select("text").mapInArrow(tidy(probes), probe_schema))
    hits = both.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(tidy(answer), "text_key binary, hits binary")
    text_key, line_hits = unused(docs, "text_key"), unused(docs, "line_hits")
    hits = hits.distinct().groupBy(F.col("text_key").alias(text_key)).agg(F.collect_list("hits").alias(line_hits))
    keyed = map_text(docs, "text", f"{text_key} binary", lambda: lambda texts: [[xxhash.xxh3_128_digest((t or "").encode()) for t in texts]])
    joined = keyed.join(hits, text_key, "left").drop(text_key)

    def finish(batches):
        own = Index(rows.value, 1, min_docs)
        for batch in batches:
            for part in slices(batch, "text"):
                made = []
                for text, found in zip(part.column("text").to_pylist(), part.column(line_hits).to_pylist(), strict=True):
                    back, keys = b"".join(found or []), keys_of(text, min_chars)
                    gone = {back[i : i + 16] for i in range(0, len(back), 16)} | own.common(list({k for k in keys if k is not None}))
                    made.append(without(text, keys, gone))
                new = [pa.array(c, t) for c, t in zip(list(zip(*made, strict=True)) or [[]] * 3, (pa.string(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + new, [*keep, "text", "n_lines", "n_dropped"])

    keep = [c for c in joined.columns if c.lower() not in ("text", "n_lines", "n_dropped", line_hits.lower())]
    kept = joined.select(*keep, "text", F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")).schema
    return joined.mapInArrow(tidy(finish), kept)


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, broadcast_bytes: int = 64 << 20, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """``docs`` with the common lines out of ``text``, plus n_lines (before) and n_dropped."""
    if not 1 <= min_docs <= MOST:
        raise ValueError(f"min_docs is from 1 to {MOST}")
    counts = stored(line_counts(docs, min_chars), "line-counts")
    keys, total = counts.agg(F.count("*"), F.coalesce(F.sum("docs"), F.lit(0))).first()
    shards = keys // shard_keys + 1
    index = stored(index_shards(counts, shards), "line-index")
    size = index.select(F.sum(F.length("bits") + F.length("fingerprints") + F.length("counts"))).first()[0] or 0
    if size <= broadcast_bytes:
        return dropped_by_broadcast(docs, index, shards, min_docs, min_chars)
    frequent = counts.filter(F.col("docs") >= max(FREQUENT_LEAST, total // FREQUENT_KEYS))
    return dropped_by_routing(docs, index, shards, index_shards(frequent, 1), min_docs, min_chars)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: the digest of what stays of every text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_common_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH rows AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
lines AS (
  SELECT r, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS i FROM rows),
keyed AS (
  SELECT r, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
gone AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10),
per AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (k IN (SELECT k FROM gone)) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (k NOT IN (SELECT k FROM gone)), '') AS kept
  FROM keyed GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM rows JOIN per USING (r)
"""
