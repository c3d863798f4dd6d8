"""Cases in which an operator once did less than its whole job."""

import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_queries import shingles

from matchgrid.llm import near_dedup
from matchgrid.llm import shingles as S

TEXT = "doc_id long, text string"


def window_pair(seed, m, k):
    """Two texts of ``m`` shingles each, of which all but ``k`` are shared: similarity (m - k) / (m + k)."""
    rng = random.Random(seed)
    words = [f"w{rng.randrange(10**6)}" for _ in range(m + k + 4)]
    return " ".join(words[: m + 4]), " ".join(words[k:])


def components(rows, percent):
    """{doc_id: component} by comparing every two sets."""
    sets, root = {d: shingles(t) for d, t in rows}, {d: d for d, _ in rows}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = {d: x if r == y else r for d, r in root.items()}
    return root


def test_pipeline_links_from_80_percent(spark):
    rows = []
    for seed, (m, k) in enumerate([(36, 4), (36, 4), (45, 5), (41, 4), (37, 3), (36, 5), (60, 10)] * 3):
        rows += enumerate(window_pair(seed, m, k), 2 * seed)
    want = components(rows, 80)
    assert set(want.values()) < set(components(rows, 85).values())
    found = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, TEXT), "")
    assert sorted(r.doc_id for r in found.collect()) == sorted(set(want.values()))


def test_near_dedup_keeps_pairs_of_unlucky_sketches(spark):
    pairs = [window_pair(seed, 37, 3) for seed in (18375, 24408, 37329, 37338, 37395)]
    for pair in pairs:
        sketches = S.odd_sketches(np.stack([S.minhash(s) for s in S.shingle_sets(list(pair))]))
        assert np.unpackbits((sketches[0] ^ sketches[1]).view(np.uint8)).sum() >= 70  # 40 are expected
    rows = [(i, text) for i, text in enumerate(t for pair in pairs for t in pair)]
    found = near_dedup.groups(spark.createDataFrame(rows, TEXT)).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: i - i % 2 for i, _ in rows}


def test_pipeline_keeps_one_text_of_a_group_where_doc_ids_repeat(spark):
    base = [f"w{i}" for i in range(60)]
    text, near, other, copy = " ".join(base), " ".join(base + ["end"]), " ".join(f"v{i}" for i in range(60)), " ".join(f"u{i}" for i in range(60))
    rows = [(1, text), (1, near), (2, text), (1, other), (1, other), (0, copy), (1, copy.upper()), (3, None), (3, None), (3, " "), (4, ""), (None, "a b"), (None, "A b")]
    found = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, TEXT), "").collect()]
    assert sum(r in found for r in [(1, text), (1, near)]) == 1 and (2, text) not in found
    assert sum(r in found for r in [(None, "a b"), (None, "A b")]) == 1
    rest = [r for r in found if r[1] not in (text, near, "a b", "A b")]
    assert sorted(rest, key=repr) == sorted([(1, other), (0, copy), (3, None), (3, " "), (4, "")], key=repr) and len(found) == 7


def template_texts(n, private, seed=3):
    """Texts of 200 words that share all but ``private`` of them, in other places each."""
    rng = random.Random(seed)
    base = [f"t{i}" for i in range(200)]
    rows = []
    for i in range(n):
        words, at = list(base), rng.randrange(200 - private)
        words[at : at + private] = [f"p{i}x{j}" for j in range(private)]
        rows.append((i, " ".join(words)))
    return rows


def test_texts_of_one_template_do_not_all_meet(spark):
    """Below the threshold the compared pairs do not grow with the square of the documents."""
    met = {}
    for n, private in [(150, 25), (300, 25), (150, 30), (300, 30)]:
        rows = template_texts(n, private)
        docs = spark.createDataFrame(rows, TEXT)
        signed = near_dedup.signatures(docs).withColumn("root", F.col("set_key")).cache()
        sets = near_dedup.sets_of(docs, signed, signed.select("set_key"))
        rare = near_dedup.rare_shingles(sets, signed.select("set_key", "root", "n_shingles", *near_dedup.SKETCH), 85)
        met[n, private] = near_dedup.meetings(rare).count()
        assert near_dedup.meeting_pairs(rare, 85).count() == 0
    assert max(met.values()) <= 300


@pytest.mark.parametrize(("private", "percent"), [(5, 85), (8, 85), (12, 85), (14, 85), (16, 85), (10, 80), (18, 80), (20, 80)])
def test_hot_groups_near_the_threshold_equal_brute_force(spark, monkeypatch, private, percent):
    monkeypatch.setattr(near_dedup, "HOT", 8)
    monkeypatch.setattr(near_dedup, "LEADERS", 1)
    rng = random.Random(private)
    rows = template_texts(40, private, private) + [(100 + i, t) for i, t in template_texts(30, private // 2, 7)]
    rows += [(200 + i, " ".join(t.split()[: rng.randrange(150, 200)])) for i, t in template_texts(30, 3, 9)]
    want = components(rows, percent)
    found = near_dedup.groups(spark.createDataFrame(rows, TEXT), percent).collect()
    assert {r.doc_id: r.component_id for r in found} == want


def test_null_and_repeated_ids_do_not_meet_each_other(spark):
    """The rows that are joined for the sets are no more than the documents."""
    for n in (50, 100):
        rows = [(None if i % 2 else 7, t) for i, (_, t) in enumerate(template_texts(n, 60))] * 2
        docs = spark.createDataFrame(rows, TEXT)
        signed = near_dedup.signatures(docs).dropDuplicates(["set_key"])
        wanted = signed.select("set_key", F.col("doc_id").alias("d"), "text_hash")
        assert near_dedup.texts_of(docs, wanted).count() == 2 * n
        assert near_dedup.sets_of(docs, signed, signed.select("set_key")).count() == n
        assert near_dedup.groups(docs).filter("kept").count() == 2 * n


def test_very_long_texts_are_linked(spark):
    words = [f"w{i}" for i in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[1500:])), (3, " ".join(words[:30_000]))]
    found = near_dedup.groups(spark.createDataFrame(rows, TEXT)).collect()
    assert {r.doc_id: r.component_id for r in found} == {1: 1, 2: 1, 3: 3}
