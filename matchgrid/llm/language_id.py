"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built of labelled text. A text is cut
into the longest phrases that the automaton knows, one after the other. A text
of m letters and gaps that takes c phrases against n letters of training text
has c * log2(n) / m bits a letter (the cross-parsing estimate of Ziv and
Merhav); the language with the fewest wins, on a tie the one that sorts first.

Letters are lower-cased, everything between two words counts as one gap. The
``FREQUENT`` most frequent letters of the training texts are one symbol each, rarer
ones two (a page and a place on it), and where the pages do not suffice the rarest
three (a page and two places), so that every letter of the training texts has a code
of its own in a table of few columns. Whole texts are parsed, in blocks of
``BLOCK`` symbols so that numpy advances all blocks of many texts at once: an
automaton with its restarts is a table of next states, in which a bit tells where
a phrase begins. Only the automata's edges are broadcast; tasks make the tables of
them, with columns for the symbols of that language only, keep those that fit
``TABLE_BYTES`` and make the others anew for each slice of texts.

The training sample is bounded: of every language at most ``PER_LANG`` distinct
texts (those of moderate length first, in the order of a hash of the text, none
longer than ``LONGEST``) until they have ``LETTERS`` letters and gaps. All languages
together have at most ``MODEL_LETTERS``: from 100 languages on each gets an equal share
of them, so that none is left out and what is collected and broadcast keeps its bound
(three edges of nine bytes a symbol, 108 MB where letters are one symbol each and three times that
at most). A training text is cut at twice the share.

Null text and text without a letter get ``und`` and score 0. Very long texts are
parsed whole. The score is 1 - best / second best (1 if only one language is
known). Repeated rows get the same result; an empty table gives an empty result;
without any labelled text everything is ``und``. A column of an output's name is
replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchgrid.llm.common import map_text, released

PER_LANG = 64
LETTERS = 40_000
LONGEST = 200_000
#: Letters and gaps of the training texts of all languages together.
MODEL_LETTERS = 4_000_000
#: Chosen texts up to which they are broadcast to fetch them.
BROADCAST_ROWS = 200_000
#: Parts in which a language's texts are ranked first.
PARTS = 32
#: Letters of one symbol; the others are a page and one or two places. These codes are more than there are letters.
FREQUENT, PAGES, PLACES = 100, 76, 76
BLOCK = 256
TABLE_BYTES = 256 << 20
#: A text of at least so many letters that takes a phrase for fewer letters than this fits no known language. Random letters
#: take one for some 1.5, the shortest phrases of labelled documents of the test tables have 2.0.
LEAST_LETTERS, LEAST_PHRASE = 20, 1.8
OUT = "lang_pred string, score double, phrase_letters double, fits boolean"


def training_sample(docs: DataFrame, per_lang: int = PER_LANG, letters: int = LETTERS) -> dict[str, list[str]]:
    """At most ``per_lang`` distinct texts a language of ``docs`` (text, lang), of ``letters`` characters and one text's rest."""
    usable = (F.length("text") <= LONGEST) & F.col("lang").isNotNull()
    labelled = docs.filter(usable).select("lang", "text", F.xxhash64("text").alias("h"), F.length("text").alias("size"))
    langs = max(1, labelled.select("lang").distinct().count())
    letters = max(1, min(letters, MODEL_LETTERS // langs))
    odd = F.when(F.col("size").between(200, 4000), 0).otherwise(1)
    order = Window.partitionBy("lang").orderBy("odd", "h", "size")
    distinct = labelled.select("lang", "h", "size", odd.alias("odd"), F.pmod("h", F.lit(PARTS)).alias("part")).distinct()
    # First within the parts of a language, so that a frequent one is ranked by many tasks.
    few = distinct.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy("odd", "h", "size"))).filter(F.col("rank") <= per_lang)
    first = few.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_lang)
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = first.withColumn("before", before).filter(F.col("before") < letters).select("lang", "h", "size")
    if langs * min(per_lang, letters) <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    rows = labelled.join(chosen, ["lang", "h", "size"]).groupBy("lang", "h", "size").agg(F.substring(F.min("text"), 1, 2 * letters).alias("text"))
    found: dict[str, list[str]] = {}
    for r in rows.orderBy("lang", "h").collect():
        found.setdefault(r.lang, []).append(r.text)
    return found


def letters_of(text: str) -> str:
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of one sequence; state 0 is the root."""
    edges, link, length, last = [{}], [-1], [0], 0
    for c in text:
        fresh = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at != -1 and c not in edges[at]:
            edges[at][c] = fresh
            at = link[at]
        if at != -1:
            target = edges[at][c]
            if length[target] == length[at] + 1:
                link[fresh] = target
            else:
                copy = len(edges)
                edges.append(dict(edges[target]))
                length.append(length[at] + 1)
                link.append(link[target])
                link[target] = link[fresh] = copy
                while at != -1 and edges[at].get(c) == target:
                    edges[at][c] = copy
                    at = link[at]
        last = fresh
    return edges


class Model:
    """The edges of all languages' automata, and the symbols of each character."""

    def __init__(self, sample: dict[str, list[str]]):
        share = max(1, MODEL_LETTERS // max(1, len(sample)))
        texts = {lang: t[:share] for lang in sorted(sample) if (t := " ".join(x for t in sample[lang] if (x := letters_of(t))))}
        seen: dict[str, int] = {}
        for text in texts.values():
            for c in text:
                seen[c] = seen.get(c, 0) + 1
        seen.pop(" ", None)
        known = sorted(seen, key=lambda c: (-seen[c], c))
        # Symbols: 0 gap, frequent letters, pages, places, letters that were not seen, the padding of blocks.
        alone, rare = known[:FREQUENT], known[FREQUENT:]
        # Pages whose letters take two places, as few as suffice.
        double = max(0, -(-(len(rare) - PAGES * PLACES) // (PLACES * PLACES - PLACES)))
        pages, places = min(PAGES, -(-len(rare) // PLACES)), min(len(rare), PLACES)
        page, place, single = 1 + len(alone), 1 + len(alone) + pages, (pages - double) * PLACES
        symbols = {c: (i,) for i, c in enumerate(alone, 1)}
        symbols |= {c: (page + i // PLACES, place + i % PLACES) for i, c in enumerate(rare[:single])}
        symbols |= {c: (page + pages - double + i // PLACES**2, place + i // PLACES % PLACES, place + i % PLACES) for i, c in enumerate(rare[single:])}
        other = place + places
        self.pad, self.width = other + 1, other + 2
        self.first, self.second, self.third = (np.zeros(0x110000, np.uint8) for _ in range(3))
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                self.first[cp], self.second[cp], self.third[cp] = (*symbols.get(c.lower(), (other,)), 0, 0)[:3]
        self.langs, self.edges = list(texts), []
        for text in texts.values():
            states = automaton([s for c in text for s in ((0,) if c == " " else symbols.get(c, (other,)))])
            sizes = np.array([len(e) for e in states], np.int64)
            origin = np.repeat(np.arange(len(states), dtype=np.int32), sizes)
            symbol = np.fromiter((c for e in states for c in e), np.uint8, len(origin))
            target = np.fromiter((t for e in states for t in e.values()), np.int32, len(origin))
            self.edges.append((len(states), origin, symbol, target))
            del states
            released()
        self.bits = np.array([np.log2(max(2, len(t))) for t in texts.values()])

    def table(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The column of each symbol in a language, and its next states: state * columns * 2, and 1 where a phrase begins."""
        count, origin, symbol, target = self.edges[i]
        used = np.unique(symbol)
        width = len(used) + 2  # and one column for the symbols that it lacks, one for the padding
        column = np.full(self.width, len(used), np.uint8)
        column[used], column[self.pad] = np.arange(len(used)), len(used) + 1
        start = np.ones(width, np.int32)  # a mismatch restarts at the root's own edge
        root = origin == 0
        start[column[symbol[root]]] = target[root] * width * 2 + 1
        start[-1] = 0
        table = np.tile(start, (count, 1))
        table[origin[~root], column[symbol[~root]]] = target[~root] * width * 2
        return column, table.ravel()

    def tables(self):
        """The table of each language in turn."""
        made = self.__dict__.setdefault("made", {})
        for i in range(len(self.langs)):
            one = made.get(i) or self.table(i)
            if i not in made and one[1].nbytes + sum(t.nbytes for _, t in made.values()) <= TABLE_BYTES:
                made[i] = one
            yield one

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letters and gaps of each text, and its phrases in each language."""
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        found = self.first[points]
        before = np.zeros_like(found)
        before[1:] = found[:-1]
        before[1:][doc[1:] != doc[:-1]] = 0
        keep = (found > 0) | (before > 0)
        found, doc, points = found[keep], doc[keep], points[keep]
        second, third = self.second[points], self.third[points]
        letters = np.bincount(doc, minlength=len(texts))
        if second.any():
            two, three = second > 0, third > 0
            times = 1 + two + three
            ends = np.cumsum(times) - 1
            found, doc = np.repeat(found, times), np.repeat(doc, times)
            found[ends[two] - three[two]] = second[two]
            found[ends[three]] = third[three]
        size = np.bincount(doc, minlength=len(texts))
        blocks = -(-size // BLOCK)
        first = np.cumsum(blocks) - blocks
        at = np.arange(len(doc)) - (np.cumsum(size) - size)[doc]
        grid = np.full((BLOCK, int(blocks.sum())), self.pad, np.uint8)
        grid[at % BLOCK, first[doc] + at // BLOCK] = found
        owner = np.repeat(np.arange(len(texts)), blocks)
        counts = []
        for column, table in self.tables():
            state, count = np.zeros(grid.shape[1], np.int32), np.zeros(grid.shape[1], np.int32)
            for row in column[grid]:
                state >>= 1
                state += row
                state = table.take(state)
                count += state & 1
            counts.append(np.bincount(owner, count, len(texts)))
        return letters, np.stack(counts, 1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float], list[bool]]:
        """Columns of OUT."""
        langs, scores, letters, fits = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts), [False] * len(texts)
        if not texts or not self.langs:
            return langs, scores, letters, fits
        size, phrases = self.phrases([t or "" for t in texts])
        has = np.flatnonzero(size > 0)
        cost = phrases[has] * self.bits / size[has, None]
        best = cost.argmin(1)
        low = np.sort(cost, 1)
        for i, b, c in zip(has.tolist(), best.tolist(), low, strict=True):
            langs[i] = self.langs[b]
            scores[i] = float(1 - c[0] / c[1]) if len(c) > 1 else 1.0
            letters[i] = float(size[i] / max(1.0, phrases[i, b]))
            fits[i] = bool(size[i] < LEAST_LETTERS or letters[i] >= LEAST_PHRASE)
        return langs, scores, letters, fits


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score, phrase_letters (mean letters of a phrase of the winner) and fits (a known language at all)."""
    kept = docs.sparkSession.sparkContext.broadcast({k: v for k, v in vars(model).items() if k != "made"})

    def setup():
        own = Model.__new__(Model)
        own.__dict__.update(kept.value)
        return own.predict

    return map_text(docs, "text", OUT, setup)


def held_out() -> F.Column:
    """Documents that the model never learns from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def trained(docs: DataFrame) -> Model:
    return Model(training_sample(docs.filter(~held_out()).select("text", "lang")))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: the language of every text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = trained(docs)
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score", "phrase_letters")
