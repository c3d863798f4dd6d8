r"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are brought to lower-case words with one space between. An
item of n characters may differ in k = floor(error_rate * n) edits; cut into
k + 1 pieces, at least one piece of any such match is unchanged. One
Aho-Corasick automaton finds the pieces in each text; every hit asks for a
stretch of the text around it. As k edits change at most 3 k of the item's groups of
three characters, a stretch that lacks more of them is out; Myers' bit-parallel
distance verifies the others. That keeps pieces which many items share (the wording
of a question) cheap. Items of equal text are searched once. Items too short
for an edit must stand in the text word for word. Every item of a word or more is
searched; a caller to whom short ones tell nothing asks for ``least_words``.

Items are broadcast in blocks of at most ``BLOCK_CHARS`` characters, with one
pass over the documents each, so a benchmark of any size fits. With several
blocks, a pass keeps only the hits and a digest of the texts that have any, and
they are joined to the documents at the end.

Null and empty texts match nothing; null and empty items match nothing.
Repeated documents and repeated items are matched each on its own; of several
matches of an item in a text the one with the fewest edits (then the first) is
reported. Very long texts are searched whole. Empty tables give an empty result.
Spans count code points of the original text, end exclusive, from a word's
character to a word's character. A column of the output's name is replaced.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchgrid.llm.common import map_text
from matchgrid.sources.store import stored

ERROR_RATE = 0.08
BLOCK_CHARS = 4_000_000
#: Characters of a part of a text whose groups of GRAM characters are looked up together.
PART, GRAM = 256, 3
WORD = re.compile(r"[^\W_]+")
HITS = "array<struct<item_id: long, edits: int, start: int, end: int>>"


def normal(text: str) -> str:
    return " ".join(WORD.findall(text)).lower()


def pieces_of(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece) of k + 1 pieces of nearly equal length."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str, k: int) -> tuple[int, int] | None:
    """Fewest edits of a stretch of ``text`` against ``pattern`` and its first end, if at most k."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, edits, best = full, 0, m, None
    for at, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        vertical = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(across | plus) & full
        down = plus & across
        if up & top:
            edits += 1
        elif down & top:
            edits -= 1
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | ~(vertical | up) & full, up & vertical
        if edits <= k and (best is None or edits < best[0]):
            best = (edits, at)
    return best


def grams(text: str) -> set[str]:
    return {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}


class Items:
    """Searches texts for the items of one block."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float, least_words: int = 1):
        import ahocorasick

        self.items, self.trie = [], ahocorasick.Automaton()
        same: dict[str, list[int]] = {}
        for item_id, text in items:
            word = normal(text)
            if word and word.count(" ") + 1 >= least_words:
                same.setdefault(word, []).append(item_id)
        owners: dict[str, list[tuple[int, int]]] = {}
        for word, ids in same.items():
            k = int(len(word) * error_rate)
            pattern = word if k else f" {word} "
            for offset, piece in pieces_of(pattern, k):
                owners.setdefault(piece, []).append((len(self.items), offset))
            self.items.append((ids, pattern, k, grams(pattern)))
        for piece, own in owners.items():
            self.trie.add_word(piece, (len(piece), own))
        if owners:
            self.trie.make_automaton()

    def search(self, text: str | None) -> list[dict]:
        if not text or not self.items:
            return []
        body = f" {normal(text)} "
        starts: dict[int, set[int]] = {}
        for end, (size, own) in self.trie.iter(body):
            for item, offset in own:
                starts.setdefault(item, set()).add(end + 1 - size - offset)
        parts: dict[int, set[str]] = {}
        found = []
        for item, at in starts.items():
            ids, pattern, k, own = self.items[item]
            best = None
            for low, high in stretches(sorted(at), k):
                left, right = max(0, low - k), high + len(pattern) + k
                lacking = own
                for p in range(left // PART, right // PART + 1):
                    if p not in parts:
                        parts[p] = grams(body[p * PART : (p + 1) * PART + GRAM - 1])
                    lacking = lacking - parts[p]
                if len(lacking) > GRAM * k:
                    continue
                hit = myers(pattern, body[left:right], k)
                if hit and (best is None or hit[0] < best[0]):
                    best = (hit[0], left + hit[1])
            if best:
                edits, end = best
                back = myers(pattern[::-1], body[max(0, end - len(pattern) - k) : end][::-1], edits)
                start = end - back[1]
                start += len(body[start:end]) - len(body[start:end].lstrip(" "))
                end -= len(body[start:end]) - len(body[start:end].rstrip(" "))
                found += [{"item_id": i, "edits": edits, "start": start, "end": end} for i in ids]
        if found:
            to_original(text, found)
        return sorted(found, key=lambda h: (h["item_id"], h["start"]))


def stretches(starts: list[int], k: int) -> list[tuple[int, int]]:
    """Runs of supposed starts that lie within k of each other."""
    out: list[list[int]] = []
    for s in starts:
        if out and s - out[-1][1] <= k:
            out[-1][1] = s
        else:
            out.append([s, s])
    return [(a, b) for a, b in out]


def to_original(text: str, found: list[dict]) -> None:
    """Move spans from the padded normal text to the original."""
    places: list[int] = [0]
    for m in WORD.finditer(text):
        size = len(m.group().lower())
        places += [min(m.start() + i, m.end() - 1) for i in range(size)] + [m.end()]
    for hit in found:
        hit["start"] = places[min(hit["start"], len(places) - 1)]
        hit["end"] = places[min(hit["end"] - 1, len(places) - 1)] + 1


def matches(docs: DataFrame, items: list[tuple[int, str]], error_rate: float = ERROR_RATE, least_words: int = 1) -> DataFrame:
    """``docs`` with ``bench_hits``: the items of ``least_words`` words or more found in each text."""
    kept = docs.sparkSession.sparkContext.broadcast(items)

    def setup():
        own = Items(kept.value, error_rate, least_words)
        return lambda texts: [[own.search(t) for t in texts]]

    return map_text(docs, "text", f"bench_hits {HITS}", setup)


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> list[DataFrame]:
    """(item_id, text) in blocks of about ``block_chars`` characters."""
    items = benchmark.select("item_id", "text").filter("text is not null")
    chars = items.select(F.sum(F.length("text"))).first()[0] or 0
    blocks = int(chars // block_chars) + 1
    if blocks == 1:
        return [items]
    return [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) for b in range(blocks)]


def contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS, least_words: int = 1) -> DataFrame:
    """``docs`` with ``bench_hits`` over every block of the benchmark.

    Of several blocks the driver holds the items of one at a time.
    """
    blocks = item_blocks(benchmark, block_chars)
    items = lambda block: [(r.item_id, r.text) for r in block.collect()]
    if len(blocks) == 1:
        return matches(docs, items(blocks[0]), error_rate, least_words)
    passes = []
    for block in blocks:
        hits = matches(docs.select("text"), items(block), error_rate, least_words).filter(F.size("bench_hits") > 0)
        passes.append(stored(hits.select(F.sha2("text", 256).alias("hit_key"), "bench_hits").dropDuplicates(["hit_key"]), "decontamination"))
    every = functools.reduce(DataFrame.unionByName, passes).groupBy("hit_key").agg(F.flatten(F.collect_list("bench_hits")).alias("found"))
    own = [c for c in docs.columns if c.lower() != "bench_hits"]
    rows = docs.select(F.struct(*own).alias("row"), F.sha2("text", 256).alias("key")).join(every, F.col("key") == F.col("hit_key"), "left")
    return rows.select(*(F.col("row").getField(c).alias(c) for c in own), F.array_sort(F.coalesce("found", F.array())).cast(HITS.replace(": ", ":")).alias("bench_hits"))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: every benchmark item found in a text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits = contaminated(docs, benchmark).select("doc_id", F.explode("bench_hits").alias("hit"))
    return hits.select("doc_id", "hit.item_id", "hit.edits", "hit.start", "hit.end")
