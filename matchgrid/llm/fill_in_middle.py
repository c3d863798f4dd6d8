r"""Fill-in-middle transformation with a wavelet matrix over character classes.

A text is cut into units: a run of ASCII letters, or one other code point. Two of
the places between units, drawn from a hash of the row's id, cut it into prefix, middle
and suffix; a written example holds them around three control strings, in the order prefix,
suffix, middle (psm) or suffix, prefix, middle (spm). Some texts stay plain.

A slice of texts becomes one sequence of four classes (letter inside a word,
letter that starts one, blank, other), kept as a wavelet matrix: two bitmaps
with running counts. Ranks of the last three classes add up to the number of units that start
before a place, and bisection on that number finds both cuts of all texts of a slice at once.

Draws: the first four groups of 8 hexadecimal digits of sha256(``seed:id``), a null id
being empty. Equal ids have equal draws, so ties and repeated rows need no rule. Null text is
empty; empty texts, and texts that hold a control string, are plain, so that the parts can always be read
back. Very long texts are cut whole. An empty table gives an empty result. A column of
the name of an output is replaced; every other column stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchgrid.llm.common import arrow_types, slices, tidy, unused

#: The control strings in front of prefix, suffix and middle. None overlaps another or itself.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of texts that are transformed, and of these written suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
INSIDE, START, WHITE, OTHER = range(4)
LEVELS = 2
OUTPUTS = "n_units long, form string, prefix_chars long, middle_chars long, output string"


class Bits:
    """A bitmap with running counts by 64 bits."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]])

    def rank(self, upto: np.ndarray) -> np.ndarray:
        """How many bits are set in front of each place."""
        word, bit = upto >> 6, (upto & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class WaveletMatrix:
    """Ranks of classes below 2 ** LEVELS: a bitmap for each bit, zeros sorted in front of ones in between."""

    def __init__(self, classes: np.ndarray):
        self.levels = []
        for level in reversed(range(LEVELS)):
            ones = (classes >> level & 1).astype(bool)
            self.levels.append((level, Bits(ones), len(ones) - int(ones.sum())))
            classes = np.concatenate([classes[~ones], classes[ones]])

    def rank(self, kind: int, upto: np.ndarray) -> np.ndarray:
        """How many of the first ``upto`` places are of the class."""
        low, high = np.zeros(1, np.int64), upto
        for level, bits, zeros in self.levels:
            if kind >> level & 1:
                low, high = zeros + bits.rank(low), zeros + bits.rank(high)
            else:
                low, high = low - bits.rank(low), high - bits.rank(high)
        return high - low


class Units:
    """The units of a list of texts."""

    def __init__(self, texts: list[str]):
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        letter = (points | 32) - np.uint32(97) < 26
        after = np.concatenate([[False], letter[:-1]]) if len(points) else letter
        after[self.starts[self.sizes > 0]] = False  # the text before is another one
        white = (points == 32) | (points - np.uint32(9) < 5)
        self.matrix = WaveletMatrix(np.where(letter, np.where(after, INSIDE, START), np.where(white, WHITE, OTHER)).astype(np.uint8))
        self.passed = self.started(self.starts)
        self.counts = self.started(self.starts + self.sizes) - self.passed

    def started(self, upto: np.ndarray) -> np.ndarray:
        """How many units start in front of each place of the joined texts."""
        return sum(self.matrix.rank(kind, upto) for kind in (START, WHITE, OTHER))

    def ends(self, units: np.ndarray) -> np.ndarray:
        """Where the first ``units`` units of each text end: the last place with no more starts in front of it."""
        low, high = np.zeros_like(self.sizes), self.sizes.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            fits = self.started(self.starts + middle) - self.passed <= units
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        return low


def draws(identity: Column, seed: int) -> Column:
    """Four unsigned 32-bit numbers from the hash of the seed and an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(identity.cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substr(digest, F.lit(8 * k + 1), F.lit(8)), 16, 10).cast("long") for k in range(4)))


def transformed(
    df: DataFrame, identity: str = "doc_id", column: str = "text", seed: int = 1, transformed_percent: int = TRANSFORMED, suffix_first_percent: int = SUFFIX_FIRST
) -> DataFrame:
    """``df`` with n_units, form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output."""
    new = T.StructType.fromDDL(OUTPUTS)
    keep = [f for f in df.schema.fields if f.name not in new.names]
    drawn = unused(df, "draws")
    schema = T.StructType([*keep, *new.fields])

    def run(batches):
        for batch in batches:
            for part in slices(batch, column):
                texts = [t or "" for t in part.column(column).to_pylist()]
                found = cut_all(texts, np.array(part.column(drawn).to_pylist(), np.int64).reshape(-1, 4), transformed_percent, suffix_first_percent)
                made = [pa.array(v, t) for v, t in zip(found, arrow_types(new), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in keep] + made, schema.names)

    return df.withColumn(drawn, draws(F.col(identity), seed)).mapInArrow(tidy(run), schema)


def cut_all(texts: list[str], h: np.ndarray, transformed_percent: int, suffix_first_percent: int) -> list[list]:
    """The outputs of transformed() for a list of texts and their draws."""
    units = Units(texts)
    places = h[:, :2] % (units.counts + 1)[:, None]
    first, second = units.ends(places.min(axis=1)).tolist(), units.ends(places.max(axis=1)).tolist()
    move, swap = (h[:, 2] % 100 < transformed_percent).tolist(), (h[:, 3] % 100 < suffix_first_percent).tolist()
    forms, prefixes, middles, outputs = [], [], [], []
    for text, a, b, moves, swaps in zip(texts, first, second, move, swap, strict=True):
        if not moves or not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
            row = ("plain", None, None, text)
        elif swaps:
            row = ("spm", a, b - a, f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}")
        else:
            row = ("psm", a, b - a, f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}")
        for to, v in zip((forms, prefixes, middles, outputs), row, strict=True):
            to.append(v)
    return [units.counts, forms, prefixes, middles, outputs]


def restored(output: Column, form: Column) -> Column:
    """The text that transformed() has written as ``output``."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(1), part(3), part(2))).otherwise(F.concat(part(2), part(3), part(1)))


def digests(df: DataFrame) -> DataFrame:
    """Unit counts, form, sizes and digests of every row."""
    return df.select(
        "doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op12: forms, sizes and digests of every text of ``documents``."""
    return digests(transformed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


ORACLE = r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d,
         regexp_extract_all(coalesce(text, ''), '(?s)[A-Za-z]+|[^A-Za-z]') AS units FROM documents),
drawn AS (
  SELECT doc_id, text, units, len(units)::BIGINT AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2,
         ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM hashed),
cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS p, coalesce(array_to_string(units[a + 1:b], ''), '') AS m,
         coalesce(array_to_string(units[b + 1:n], ''), '') AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(p || m || s) AS restored_sha256 FROM parts
"""
