"""Near-duplicate documents by MinHash bands, odd sketches and exact sets.

One pass gives each text the distinct hashes of its five-word shingles, from
them a 128-bit key of the set, MinHash samples cut into bands, and an odd
sketch (the samples folded into parity bits). Texts with equal sets are one
vertex, so exact copies never meet as pairs.

Vertices that share a band are candidates. The XOR population count of two odd
sketches estimates their similarity; a candidate goes on unless sets at the
threshold would show such a count with a probability below 1e-8. In hot bands the private
shingles of each vertex (in no other vertex of a hot band) are counted: they
bound the intersection from above, so a pair that cannot reach the threshold
goes no further. What is left is confirmed on the full shingle sets. Three steps
keep this small in large groups:

1. Each vertex is confirmed against the closest few of its bands' leaders, which
   are the vertices with the least share of private shingles. Components are contracted.
2. In the other bands that still hold several components every vertex outside the
   band's largest one is compared with all vertices of other components.
3. In hot bands that still hold several, vertices meet by rare shingles instead.
   Each set is ordered by the number of these vertices that have a shingle, rarest
   first. Two sets at the threshold share one among the first of each (of n shingles
   the first n - 2tn / (1 + t) + 1 of the smaller and n - tn + 1 of the larger set), so
   only vertices that do are compared. Boilerplate that makes a band hot is at the end of that
   order: documents that share it and differ by more than the threshold allows do not
   meet, whatever their number. On a shingle, vertices of its largest component
   are not compared with each other.

No link between components is lost, whatever a group's size. Bands and
shingles are joined, not gathered, so a hot one is spread over tasks.

Documents without words are linked with nothing; null text has none. Very long
texts are read whole, one at a time. Repeated rows are copies. The component is
named by the smallest doc_id in it; null doc_ids count only where a component has
no other. An empty table gives an empty result. Columns of the outputs' names are
replaced; others stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchgrid.llm import shingles as S
from matchgrid.llm.common import map_text, slices, tidy
from matchgrid.operators.components import components
from matchgrid.sources.store import discard, stored

#: A band with more vertices than this is hot: private shingles are counted in it.
HOT = 64
#: Leaders that a vertex is confirmed against.
LEADERS = 3
#: Rows (of some 100 bytes) up to which the vertices whose sets are wanted are broadcast.
BROADCAST_ROWS = 200_000
SKETCH = ["s1", "s2", "s3", "s4"]
SIGNED = "n_shingles long, set_key binary, bands array<long>, " + ", ".join(f"{s} long" for s in SKETCH)


def text_hash() -> F.Column:
    """128 bits of the text."""
    return F.unhex(F.md5("text"))


def signatures(docs: DataFrame) -> DataFrame:
    """``docs`` with its text replaced by its hash, set size, set key, band keys and odd sketch."""

    def setup():
        def call(texts):
            sets = S.shingle_sets(texts)
            keys = [S.set_key(s) if len(s) else None for s in sets]
            first = {}
            for i, k in enumerate(keys):
                if k is not None:
                    first.setdefault(k, i)
            samples = np.stack([S.minhash(sets[i]) for i in first.values()]) if first else np.zeros((0, S.SAMPLES), np.uint32)
            bands = S.band_keys(samples).view(np.int64)
            sketch = S.odd_sketches(samples).view(np.int64)
            row = {k: i for i, k in enumerate(first)}
            at = [row.get(k) for k in keys]
            columns = [[None if i is None else int(sketch[i, c]) for i in at] for c in range(len(SKETCH))]
            return [[len(s) for s in sets], keys, [None if i is None else bands[i] for i in at], *columns]

        return call

    return map_text(docs.withColumn("text_hash", text_hash()), "text", SIGNED, setup).drop("text")


def distance(other: str = "") -> F.Column:
    """XOR population count of two sketches; the other's columns carry a prefix."""
    return sum((F.bit_count(F.col(s).bitwiseXOR(F.col(other + s))) for s in SKETCH), F.lit(0))


def may_reach(percent: int, other: str) -> F.Column:
    """Set sizes, shingles of no other vertex of the band and sketches allow the similarity."""
    n, m = F.col("n_shingles"), F.col(f"{other}n_shingles")
    most = F.least(n - F.col("private"), m - F.col(f"{other}private"))
    return ((100 + percent) * most >= percent * (n + m)) & (distance(other) <= S.farthest(percent))


def shared_bands(vertices: DataFrame) -> DataFrame:
    """(band, place, hot, set_key) of bands that several vertices share; hot if more than HOT do."""
    every = vertices.select("set_key", F.posexplode("bands").alias("place", "band"))
    several = every.groupBy("band").count().filter("count > 1").select("band", (F.col("count") > HOT).alias("hot"))
    return every.join(several, "band")


def shingle_rows(sets: DataFrame) -> DataFrame:
    """(shingle, keys): the keys, in one string, of the vertices of a slice that have the shingle."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "hashes", 4 << 20):
                keys = np.frombuffer(b"".join(part.column("set_key").to_pylist()), "V16")
                parts = part.column("hashes").to_pylist()
                owner = np.repeat(np.arange(len(parts)), [len(p) // 8 for p in parts])
                every = np.frombuffer(b"".join(parts), np.int64)
                order = np.argsort(every, kind="stable")
                starts = np.flatnonzero(np.concatenate([[True], every[order][1:] != every[order][:-1]])) if len(every) else np.zeros(0, np.int64)
                ends = np.append(starts[1:], len(every)) if len(every) else starts
                packed = keys[owner[order]].tobytes()
                found = [packed[16 * a : 16 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(every[order][starts]), pa.array(found, pa.binary())], ["shingle", "keys"])

    return sets.select("set_key", "hashes").mapInArrow(tidy(run), "shingle long, keys binary")


def private_counts(sets: DataFrame, bands: DataFrame) -> DataFrame:
    """(set_key, found): the shingles of each vertex of hot bands that no other such vertex has."""
    hot = bands.filter("hot").select("set_key").distinct()
    each = shingle_rows(sets.join(hot, "set_key", "left_semi"))
    size = F.octet_length("keys")
    alone = each.groupBy("shingle").agg(F.sum(size).alias("size"), F.min(F.when(size == 16, F.col("keys"))).alias("set_key")).filter("size = 16")
    return alone.groupBy("set_key").agg(F.count("*").alias("found"))


def closest_leaders(bands: DataFrame, percent: int) -> DataFrame:
    """(a, b): each vertex with the LEADERS nearest of its bands' leaders.

    A band's leader is the vertex with the least share of private shingles.
    """
    order = F.struct((F.col("private") / F.col("n_shingles")).alias("share"), F.xxhash64("set_key", "band").alias("h"))
    leader = bands.groupBy("band").agg(F.min(F.struct(order.alias("order"), "set_key", "n_shingles", "private", *SKETCH)).alias("l"))
    leader = leader.select("band", *(F.col(f"l.{c}").alias(f"l_{c}") for c in ("set_key", "n_shingles", "private", *SKETCH)))
    near = bands.join(leader, "band").filter((F.col("set_key") != F.col("l_set_key")) & may_reach(percent, "l_"))
    # At most one leader a band, so the set is bounded.
    each = near.groupBy("set_key").agg(F.collect_set(F.struct(distance("l_").alias("d"), "l_set_key")).alias("ls"))
    best = each.select(F.col("set_key").alias("a"), F.explode(F.slice(F.array_sort("ls"), 1, LEADERS)).alias("l"))
    return best.select("a", F.col("l.l_set_key").alias("b"))


def rooted(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with the root of each set_key's component."""
    return rows.join(labels.withColumnRenamed("v", "set_key"), "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))


def mixed(rows: DataFrame, key: str) -> DataFrame:
    """The rows of keys that hold several roots, with the root of most of them as ``main``."""
    sizes = rows.groupBy(key, "root").count()
    main = sizes.groupBy(key).agg(F.max(F.struct("count", "root")).alias("main"), F.count("*").alias("roots"))
    return rows.join(main.filter("roots > 1").select(key, F.col("main.root").alias("main")), key)


def outsiders(bands: DataFrame, vertices: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(a, b): candidates of different components in bands that are not hot, each pair once, in the first band that it shares.

    Of two vertices of different components at least one is outside their band's largest one.
    """
    rows = mixed(rooted(bands.filter("not hot"), labels), "band").join(vertices.select("set_key", "bands"), "set_key")
    fields = ("set_key", "root", "n_shingles", "private", "bands", *SKETCH)
    other = rows.select("band", *(F.col(c).alias(f"o_{c}") for c in fields))
    once = (F.col("o_root") == F.col("main")) | (F.col("set_key") < F.col("o_set_key"))
    before = F.arrays_overlap(F.slice("bands", F.lit(1), F.col("place")), F.slice("o_bands", F.lit(1), F.col("place")))
    wanted = (F.col("root") != F.col("o_root")) & once & may_reach(percent, "o_") & ~before
    return rows.filter("root != main").join(other, "band").filter(wanted).select(F.col("set_key").alias("a"), F.col("o_set_key").alias("b"))


def open_vertices(bands: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(set_key, root, n_shingles, s1 .. s4): vertices of hot bands with several components that may still be linked.

    A vertex of which more shingles are private than the threshold leaves out is linked with nothing.
    """
    able = bands.filter("hot").filter(100 * (F.col("n_shingles") - F.col("private")) >= percent * F.col("n_shingles"))
    return mixed(rooted(able, labels), "band").select("set_key", "root", "n_shingles", *SKETCH).distinct()


def rare_shingles(sets: DataFrame, vertices: DataFrame, percent: int) -> DataFrame:
    """``vertices`` with (shingle, at, short): their rarest shingles with the place in the order.

    As many as a partner of at most the same size may share first; short ones are those that one of at least the same size may.
    """
    n = F.col("n_shingles")
    each = shingle_rows(sets.join(vertices.select("set_key"), "set_key", "left_semi"))
    several = each.groupBy("shingle").agg((F.sum(F.octet_length("keys")) / 16).cast("long").alias("n")).filter("n > 1")
    places = F.sequence(F.lit(0), (F.octet_length("keys") / 16).cast("int") - 1)
    # Dealt anew before they are unpacked, so that a shingle of very many vertices is spread over tasks.
    unpacked = each.join(several, "shingle").repartition("shingle", "keys").withColumn("set_key", F.explode(F.transform(places, lambda i: F.substr("keys", 16 * i + 1, F.lit(16)))))
    of_vertex = Window.partitionBy("set_key")
    # Shingles of a single vertex come first and match nothing: only their number counts.
    ranked = unpacked.drop("keys").withColumn("rank", F.row_number().over(of_vertex.orderBy("n", "shingle"))).withColumn("of", F.count("*").over(of_vertex))
    placed = ranked.drop("n").join(vertices, "set_key").withColumn("at", n - F.col("of") + F.col("rank"))
    short = F.col("at") <= n - F.ceil(2 * percent * n / (100 + percent)) + 1
    return placed.filter(F.col("at") <= n - F.ceil(percent * n / 100) + 1).select("shingle", "at", short.alias("short"), "set_key", "root", "n_shingles", *SKETCH)


def meetings(rare: DataFrame) -> DataFrame:
    """All pairs of rows that are compared: smaller sets by their short rows with others, but for pairs within a shingle's largest component."""
    rows = mixed(rare, "shingle")
    columns = [F.col(c).alias(f"o_{c}") for c in ("at", "set_key", "root", "n_shingles", *SKETCH)]
    other, rest = rows.select("shingle", *columns), rows.filter("root != main").select("shingle", *columns)
    short = rows.filter("short")
    return short.filter("root != main").join(other, "shingle").unionByName(short.filter("root = main").join(rest, "shingle"))


def meeting_pairs(rare: DataFrame, percent: int) -> DataFrame:
    """(a, b): candidates of different components that share a rare shingle, each pair once."""
    n, m = F.col("n_shingles"), F.col("o_n_shingles")
    # Where they meet first, no more than the shingles from there on are shared.
    most = 1 + F.least(n - F.col("at"), m - F.col("o_at"))
    good = (F.col("root") != F.col("o_root")) & (n <= m) & ((100 + percent) * most >= percent * (n + m)) & (distance("o_") <= S.farthest(percent))
    a, b = F.col("set_key"), F.col("o_set_key")
    return meetings(rare).filter(good).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set_key, text) of the wanted vertices, from the rows with the doc_id and text hash that stand for them.

    A hash belongs to one vertex, so no row meets more than one, also where doc_ids are null or repeated.
    """
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("own_hash") == F.col("text_hash"))
    return docs.select("doc_id", "text", text_hash().alias("own_hash")).join(few, same).select("set_key", "text")


def sets_of(docs: DataFrame, vertices: DataFrame, keys: DataFrame) -> DataFrame:
    """(set_key, hashes) of the wanted vertices."""
    wanted = stored(vertices.join(keys, "set_key", "left_semi").select("set_key", F.col("doc_id").alias("d"), "text_hash"), "wanted")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                # Rows that repeat doc_id and text are one set.
                own = dict(zip(part.column("set_key").to_pylist(), part.column("text").to_pylist(), strict=True))
                sets = [s.tobytes() for s in S.shingle_sets(list(own.values()))]
                yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array(sets, pa.binary())], ["set_key", "hashes"])

    sets = stored(texts_of(docs, wanted).mapInArrow(tidy(run), "set_key binary, hashes binary").dropDuplicates(["set_key"]), "sets")
    discard(wanted)
    return sets


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union on the full sets."""
    left = sets.select(F.col("set_key").alias("a"), F.col("hashes").alias("a_set"))
    right = sets.select(F.col("set_key").alias("b"), F.col("hashes").alias("b_set"))

    def check(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("a_set"), batch.column("b_set"), strict=True):
                one, two = (np.frombuffer(c.as_buffer(), np.uint64) for c in (x, y))
                both = len(np.intersect1d(one, two, assume_unique=True))
                good.append(100 * both >= percent * (len(one) + len(two) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "a_set", "b_set").mapInArrow(tidy(check), "a binary, b binary")


def labelled(docs: DataFrame, percent: int) -> DataFrame:
    """``docs`` without its text, with n_shingles, component_id, kept and top.

    top is the set key that stands for the component, null without words: where
    doc_ids repeat, components of the same component_id differ in it.
    """
    signed = stored(signatures(docs), "signatures")
    with_words = signed.filter("set_key is not null")
    # The smallest doc_id stands for the vertex, a null one only where there is no other.
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_hash")).alias("first")
    vertices = with_words.groupBy("set_key").agg(first, *(F.first(c).alias(c) for c in ("n_shingles", "bands", *SKETCH)))
    vertices = stored(vertices.select("set_key", "first.doc_id", "first.text_hash", "n_shingles", "bands", *SKETCH), "vertices")
    places = stored(shared_bands(vertices), "bands")
    sets = sets_of(docs, vertices, places.select("set_key").distinct())
    private = stored(private_counts(sets, places), "private")
    bands = places.join(vertices.select("set_key", "n_shingles", *SKETCH), "set_key").join(private, "set_key", "left")
    bands = stored(bands.withColumn("private", F.when(F.col("hot"), F.coalesce("found", F.lit(0))).otherwise(0)).drop("found"), "bands")

    links = stored(confirmed(closest_leaders(bands, percent), sets, percent), "links")
    labels = components(links, "a", "b")
    pairs = outsiders(bands, vertices, labels, percent)
    still = stored(open_vertices(bands, labels, percent), "open")
    used = [places, sets, private, bands, links, still]
    if not still.isEmpty():
        used.append(stored(rare_shingles(sets, still, percent), "rare"))
        pairs = pairs.unionByName(meeting_pairs(used[-1], percent))
    more = stored(confirmed(pairs, sets, percent), "links")
    contracted = more
    for side in ("a", "b"):
        contracted = contracted.join(labels.select(F.col("v").alias(side), F.col("root").alias(f"{side}_root")), side, "left")
        contracted = contracted.withColumn(f"{side}_root", F.coalesce(f"{side}_root", side))
    merged = components(contracted, "a_root", "b_root")
    discard(*used, more)

    first = vertices.select("set_key", "doc_id").join(labels.withColumnRenamed("v", "set_key"), "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    last = first.join(merged.select(F.col("v").alias("root"), F.col("root").alias("top")), "root", "left").withColumn("top", F.coalesce("top", "root"))
    named = last.groupBy("top").agg(F.min("doc_id").alias("component_id"))
    of_set = last.join(named, "top").select("set_key", "component_id", "top")
    own = [c for c in docs.columns if c != "text"]
    out = signed.select(*own, "n_shingles", "set_key").join(of_set, "set_key", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select(*own, "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "top")


def groups(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of ``docs`` (doc_id, text)."""
    return labelled(docs.select("doc_id", "text"), percent).drop("top")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: the near-duplicate component of every document."""
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Components over all pairs that share a shingle, compared as sets of word sequences.
ORACLE = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
         ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' '))) END AS s FROM split),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS d, doc_id AS r FROM sets UNION SELECT y, r FROM reach JOIN links ON d = x),
named AS (SELECT d, min(r) AS component_id FROM reach GROUP BY d)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN named ON doc_id = d
"""
