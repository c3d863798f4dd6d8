r"""SentencePiece encoding and decoding of merge-type models by backtracking.

The model is one of the sentencepiece library's files: pieces with scores, merged
best score first and leftmost first among equals, characters that are no piece
written as byte pieces, blanks kept, one blank put in front. A file with other rules is refused.

A list of pieces is the encoding of a text exactly if every two neighbours, put
together and merged anew, come out as the same two pieces: merges inside one piece do
not depend on other pieces, so the first merge across a border would show there as
well. That holds for equal scores too, as the leftmost goes first in both. So a
text is read from the left. An Aho-Corasick pass gives the longest piece that
starts at each place; it is taken if it is compatible with the one before,
otherwise the next shorter one that starts there. Where none fits, the place is marked in
a bitfield as failed and the piece before it is taken back. A prefix has one
encoding at most, so a failed place is never tried again and the work is linear.

No merge crosses a character that is no piece, nor the border between another
character and a blank (if no piece holds both in this order, as in the
files here): texts are cut there first, and short cuts are remembered, as are
compatible pairs, in dictionaries of bounded size.

Very long texts are encoded whole, a slice of texts at a time. Null or empty text has
no ids and decodes to the empty string. Rows are independent of each other, so
repeated rows and ties need no rule. An empty table gives an empty result. A column of the
name of an output is replaced; every other column stays.
"""

from __future__ import annotations

import re
import struct
from array import array
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchgrid.llm.common import map_text, tidy

#: What stands for a blank in pieces.
BLANK = "▁"
#: Cuts (in each of two halves) and pairs that a worker remembers; longer cuts are encoded anew each time.
REMEMBERED, SHORT = 150_000, 64
#: The score of two parts that are no piece.
NEVER = float("-inf")
#: In place of ``before << 32`` where a cut starts.
START = 1 << 62

# Fixed values of the model file: field numbers of its messages, and the types of pieces.
PIECE, TRAINER, NORMALIZER = 1, 2, 3
TEXT, SCORE, TYPE = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MODEL_TYPE, MERGES, BYTE_FALLBACK, BLANK_AT_END = 3, 2, 35, 24
RULES, DUMMY_PREFIX, TRIM_BLANKS, ESCAPE_BLANKS = 2, 3, 4, 5
#: What an unknown piece is decoded to.
UNKNOWN_TEXT = " ⁇ "


def fields(message: bytes):
    """(number, value) of each field of a protocol buffer message; nested messages stay bytes."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = message[at]
            value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
            if byte < 128:
                return value, at

    at = 0
    while at < len(message):
        key, at = number(at)
        if key & 7 == 0:
            value, at = number(at)
        else:
            size, at = number(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = message[at : at + size], at + size
        yield key >> 3, value


def load(path: str) -> list[tuple[str, float, int]]:
    """(text, score, type) of each piece, by id; an error if the file has other rules than this module."""
    pieces, trainer, normalizer = [], {}, {}
    for number, value in fields(Path(path).read_bytes()):
        if number == PIECE:
            p = dict(fields(value))
            pieces.append((p[TEXT].decode(), struct.unpack("<f", p.get(SCORE, bytes(4)))[0], p.get(TYPE, NORMAL)))
        elif number == TRAINER:
            trainer = dict(fields(value))
        elif number == NORMALIZER:
            normalizer = dict(fields(value))
    normal = {p for p, _, t in pieces if t == NORMAL}
    found = {
        "model type": trainer.get(MODEL_TYPE) == MERGES,
        "byte fallback": bool(trainer.get(BYTE_FALLBACK)) and [p for p, _, t in pieces if t == BYTE] == [f"<0x{b:02X}>" for b in range(256)],
        "blanks": not trainer.get(BLANK_AT_END) and normalizer.get(DUMMY_PREFIX, 1) == 1 and normalizer.get(TRIM_BLANKS, 1) == 0 and normalizer.get(ESCAPE_BLANKS, 1) == 1,
        "normalizer": not normalizer.get(RULES),
        "piece types": {t for _, _, t in pieces} <= {NORMAL, UNKNOWN, CONTROL, BYTE},
        "characters": all(c in normal for p in normal for c in p),
    }
    if wrong := [k for k, good in found.items() if not good]:
        raise ValueError(f"the model file has other rules than this encoder: {', '.join(wrong)}")
    return pieces


class Pairs(dict):
    """Whether a piece can follow another one, by ``before << 32 | piece``; the first piece of a cut follows START."""

    def __init__(self, coder: Coder):
        super().__init__()
        self.coder = coder

    def __missing__(self, key: int) -> bool:
        if len(self) >= REMEMBERED:
            self.clear()
        coder, piece = self.coder, key & (1 << 32) - 1
        before = coder.names[key >> 32] if key < START else ""
        good = self[key] = coder.merges_to(before, coder.names[piece])
        return good


class Coder:
    """Encodes texts and decodes ids with the pieces of load()."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        import ahocorasick

        normal = {p: i for i, (p, _, t) in enumerate(pieces) if t == NORMAL}
        self.names = [p for p, _, _ in pieces]
        self.sizes = [len(p) for p in self.names]
        self.score = {p: pieces[i][1] for p, i in normal.items()}
        self.ids = normal
        self.bytes = [i for i, (_, _, t) in enumerate(pieces) if t == BYTE]
        self.find = ahocorasick.Automaton()
        for p, i in normal.items():
            self.find.add_word(p, i)
        self.find.make_automaton()
        # The next shorter piece that starts a piece, or -1.
        self.shorter = [-1] * len(pieces)
        for p, i in normal.items():
            self.shorter[i] = next((normal[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in normal), -1)
        self.pairs = Pairs(self)
        self.cuts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        known = "".join(map(re.escape, sorted(c for c in normal if len(c) == 1 and c != BLANK)))
        inner = any(BLANK in p.lstrip(BLANK) for p in normal)
        self.cut = re.compile(f"[{BLANK}{known}]+|." if inner else f"{BLANK}+[{known}]*|[{known}]+|.", re.DOTALL).findall
        plain = {NORMAL: lambda p: p.replace(BLANK, " ").encode(), UNKNOWN: lambda p: UNKNOWN_TEXT.encode(), CONTROL: lambda p: b"", BYTE: lambda p: bytes([int(p[3:5], 16)])}
        self.plain = [plain[t](p) for p, _, t in pieces]
        self.silent = {i for i, (_, _, t) in enumerate(pieces) if t == CONTROL}

    def merges_to(self, a: str, b: str) -> bool:
        """Whether a + b, merged from its characters, ends as the pieces a and b (a may be empty)."""
        parts, score, border = [*a, *b], self.score.get, len(a)
        scores = [score(x + y, NEVER) for x, y in pairwise(parts)]
        while scores:
            best = max(scores)
            if best == NEVER:
                break
            at = scores.index(best)  # the leftmost of the best
            if at == border - 1:  # it crosses the border
                return False
            border -= at < border  # counted in parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = score(parts[at - 1] + parts[at], NEVER)
            if at < len(scores):
                scores[at] = score(parts[at] + parts[at + 1], NEVER)
        return parts == ([a, b] if a else [b])

    def backtracked(self, text: str) -> list[int]:
        """The ids of a text all of whose characters are pieces."""
        sizes, shorter, compatible, n = self.sizes, self.shorter, self.pairs, len(text)
        longest = [-1] * n if n <= SHORT else array("i", bytes(4 * n))
        for end, i in self.find.iter(text):
            longest[end + 1 - sizes[i]] = i  # ends come in order, so the longest stays
        failed = bytearray(n // 8 + 1)
        out: list[int] = []
        at, piece, before = 0, longest[0], START
        while at < n:
            while piece >= 0:
                end = at + sizes[piece]
                if compatible[before | piece] and not failed[end >> 3] >> (end & 7) & 1:
                    break
                piece = shorter[piece]
            if piece >= 0:
                out.append(piece)
                at, before = end, piece << 32
                if at < n:
                    piece = longest[at]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                taken = out.pop()
                at -= sizes[taken]
                piece, before = shorter[taken], out[-1] << 32 if out else START
        return out

    def cut_ids(self, cut: str) -> bytes:
        """The packed ids of one cut."""
        found = self.cuts.get(cut)
        if found is None:
            found = self.older.get(cut)
            if found is None:
                if cut[0] in self.ids:
                    ids = self.backtracked(cut)
                else:
                    ids = [self.bytes[b] for b in cut.encode()]
                found = array("i", ids).tobytes()
            if len(cut) <= SHORT:
                if len(self.cuts) >= REMEMBERED:
                    self.older, self.cuts = self.cuts, {}
                self.cuts[cut] = found
        return found

    def packed(self, text: str | None) -> bytes:
        """The ids of a whole text as 32-bit integers."""
        if not text:
            return b""
        return b"".join(map(self.cut_ids, self.cut(BLANK + text.replace(" ", BLANK))))

    def decoded(self, ids) -> str:
        """The text of ids; one blank that stands for the start is taken off."""
        ids = [i for i in ids if i not in self.silent]
        text = b"".join(map(self.plain.__getitem__, ids)).decode("utf-8", "each_byte")
        return text[1:] if ids and self.names[ids[0]].startswith(BLANK) else text


def each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    """One replacement character for every byte that belongs to no character."""
    return "�" * (error.end - error.start), error.end


def coder_of(kept) -> Coder:
    """The worker's coder, built once a process: broadcast values stay between tasks."""
    import codecs

    codecs.register_error("each_byte", each_byte)
    v = kept.value
    if "coder" not in v:
        v["coder"] = Coder(v["pieces"])
    return v["coder"]


def encode(df: DataFrame, path: str, column: str = "text", decoded: bool = False) -> DataFrame:
    """``df`` with ``ids`` (array of int): the piece ids of the whole text, without begin or end ids.

    With ``decoded`` the ids are decoded again in the same pass, into ``decoded``.
    """
    kept = df.sparkSession.sparkContext.broadcast({"pieces": load(path)})

    def setup():
        coder = coder_of(kept)

        def call(texts):
            each = [coder.packed(t) for t in texts]
            ends = np.cumsum([0] + [len(p) // 4 for p in each])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(each), np.int32)))
            return [ids, [coder.decoded(memoryview(p).cast("i")) for p in each]] if decoded else [ids]

        return call

    return map_text(df, column, "ids array<int>, decoded string" if decoded else "ids array<int>", setup)


def decode(df: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, the text of ``ids``; null ids count as none."""
    kept = df.sparkSession.sparkContext.broadcast({"pieces": load(path)})
    keep = [f for f in df.schema.fields if f.name.lower() != "decoded"]

    def run(batches):
        coder = coder_of(kept)
        for batch in batches:
            texts = [coder.decoded(ids.as_py() or []) for ids in batch.column(column)]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in keep] + [pa.array(texts, pa.string())], [*(f.name for f in keep), "decoded"])

    return df.mapInArrow(tidy(run), T.StructType([*keep, T.StructField("decoded", T.StringType())]))


def digests(df: DataFrame, path: str) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of every row's text."""
    both = encode(df, path, decoded=True).drop("text")
    return both.select(
        *(c for c in both.columns if c not in ("ids", "decoded")),
        F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark, sf_dir: str) -> DataFrame:
    """op13: piece counts and digests of every text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs, model_path())
