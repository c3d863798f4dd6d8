r"""BPE encoding and decoding by dynamic programming over the prefixes of a word.

The vocabulary file is one of the tokenizers library's JSON files with byte
symbols and an end-of-word suffix. Text is cut at special tokens, normalised
(NFC, lower case) and split into words by the fixed rules below; a file with other
rules is refused. The end of a word is a symbol of its own, so a word is a string over 257 symbols.

For each prefix of a word exactly one token can be the last of the prefix's
encoding. A suffix automaton of all tokens follows the word; at each position
its state and suffix links give every token that ends there. Of these, the one
that is compatible with the last token of the prefix before it is stored.
Following these back from the end of the word emits the ids.

Two tokens are compatible if no merge across their border comes before the
merges that build them. Compatibility is remembered by pair, encodings by what
stands between white space, in tables of a bounded size. The words of a slice that are not
remembered go through their prefixes together, as arrays.

Very long texts are encoded whole, a slice of texts at a time. Null or empty text has no ids and decodes to the empty string. Rows are
independent of each other, so repeated rows and ties need no rule. An empty
table gives an empty result. A column of the name of an output is replaced;
every other column stays.
"""

from __future__ import annotations

import json
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchgrid.llm.common import map_text, tidy

END = 256
SYMBOLS = 257
#: Chunks between white space (in each of two halves, beyond those of a slice) and pairs that a worker remembers.
REMEMBERED = 150_000
PAIRS = 1 << 19
#: Words of more bytes are encoded one by one, the others in blocks of this many.
LONG = 48
BLOCK = 1 << 14

# Fixed values of the vocabulary's rules: its word pattern, with Unicode white
# space written out as the library reads it.
SPACE = r"\t-\r \x85\xa0  -     　"
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}" + SPACE + "]+"


NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def refuse_other_rules(file: dict) -> None:
    """Raise an error for a vocabulary file whose rules are not the ones that this module follows."""
    model, split = file["model"], (file.get("pre_tokenizer") or {}).get("pretokenizers", [])
    found = {
        "normalizer": [n["type"] for n in (file.get("normalizer") or {}).get("normalizers", [])] == NORMALIZERS,
        "pre_tokenizer": [p["type"] for p in split] == ["Split", "ByteLevel"] and split[0]["pattern"] == {"Regex": SPLIT} and not split[1]["add_prefix_space"],
        "model": model["type"] == "BPE" and bool(model.get("end_of_word_suffix")) and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")),
        "added_tokens": not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in file["added_tokens"]),
    }
    if wrong := [k for k, good in found.items() if not good]:
        raise ValueError(f"the vocabulary file has other rules than this encoder: {', '.join(wrong)}")


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as they are, the rest from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def suffix_automaton(tokens: list[tuple[int, ...]]) -> tuple[dict[int, int], list[int], list[int]]:
    """Edges (state * SYMBOLS + symbol), suffix links and lengths of one automaton of all tokens."""
    edges: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    for token in tokens:
        last = 0
        for symbol in token:
            there = edges[last].get(symbol)
            if there is not None and length[there] == length[last] + 1:
                last = there
                continue
            fresh = None
            if there is None:
                fresh = len(edges)
                edges.append({})
                length.append(length[last] + 1)
                link.append(0)
                at = last
                while at != -1 and symbol not in edges[at]:
                    edges[at][symbol] = fresh
                    at = link[at]
            else:
                at = last
            if at != -1:
                target = edges[at][symbol]
                if length[target] != length[at] + 1:
                    copy = len(edges)
                    edges.append(dict(edges[target]))
                    length.append(length[at] + 1)
                    link.append(link[target])
                    link[target] = copy
                    while at != -1 and edges[at].get(symbol) == target:
                        edges[at][symbol] = copy
                        at = link[at]
                    target = copy
                if fresh is None:
                    fresh = target
                else:
                    link[fresh] = target
            last = fresh
    return {s * SYMBOLS + k: t for s, own in enumerate(edges) for k, t in own.items()}, link, length


def load(path: str) -> dict:
    """The vocabulary as plain numpy arrays and lists, to be broadcast."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    refuse_other_rules(file)
    model = file["model"]
    suffix, vocab = model["end_of_word_suffix"], model["vocab"]
    names = [""] * (max(max(vocab.values()), *(t["id"] for t in file["added_tokens"])) + 1)
    symbols, ids, byte = [], [], byte_of_char()
    for name, i in vocab.items():
        names[i] = name
        ends = name.endswith(suffix)
        symbols.append(tuple(byte[c] for c in (name[: -len(suffix)] if ends else name)) + (END,) * ends)
        ids.append(i)
    edges, link, length = suffix_automaton(symbols)
    owner = []
    for token in symbols:
        at = 0
        for s in token:
            at = edges[at * SYMBOLS + s]
        owner.append(at)
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    for name, i in special.items():
        names[i] = name
    return {
        "edge_keys": np.fromiter(edges.keys(), np.int64, len(edges)), "edge_to": np.fromiter(edges.values(), np.int32, len(edges)),
        "link": np.array(link, np.int32), "length": np.array(length, np.int32),
        "owner": np.array(owner, np.int32), "ids": np.array(ids, np.int32), "sizes": np.array([len(s) for s in symbols], np.int32),
        "merges": np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int32).reshape(-1, 3),
        "names": names, "special": special, "kept": {},
    }


class Table:
    """Whole numbers from 0 on (int64) to small ones, open addressing in two arrays; -1 where there is none."""

    def __init__(self, room: int):
        self.room, self.bits = room, max(4, (2 * room - 1).bit_length())
        self.keys, self.values, self.size = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32), 0

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self.place(keys)
        there = self.keys[at]
        out = self.values[at]
        rest = np.flatnonzero((there != keys) & (there >= 0))
        while rest.size:
            at[rest] = (at[rest] + 1) & (len(self.keys) - 1)
            there = self.keys[at[rest]]
            out[rest] = self.values[at[rest]]
            rest = rest[(there != keys[rest]) & (there >= 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that the table does not hold."""
        self.size += len(keys)
        at = self.place(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            self.keys[at[free]] = keys[free]  # of keys for one place the last one stays
            won = self.keys[at] == keys
            self.values[at[won]] = values[won]
            at, keys, values = (at[~won] + 1) & (len(self.keys) - 1), keys[~won], values[~won]


class Encoder:
    """Encodes words and decodes ids with the arrays of load()."""

    def __init__(self, v: dict):
        self.edges = dict(zip(v["edge_keys"].tolist(), v["edge_to"].tolist(), strict=True))
        self.link, self.length = v["link"].tolist(), v["length"].tolist()
        self.own: dict[int, list[tuple[int, int]]] = {}
        for at, i, size in sorted(zip(v["owner"].tolist(), v["ids"].tolist(), v["sizes"].tolist(), strict=True), key=lambda x: -x[2]):
            self.own.setdefault(at, []).append((size, i))
        self.up = [-1] * len(self.link)  # the nearest state below by links that holds a token
        for at in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            under = self.link[at]
            self.up[at] = under if under in self.own else self.up[under] if under > 0 else -1
        self.rank, self.parts, self.born = {}, {}, {}
        for r, (a, b, ab) in enumerate(v["merges"].tolist()):
            self.rank.setdefault((a, b), r)
            self.parts.setdefault(ab, (a, b))
            self.born.setdefault(ab, r)
        self.names, self.special = v["names"], v["special"]
        self.ending: list[tuple[tuple[int, int], ...] | None] = [None] * len(self.link)
        self.pairs: dict[int, bool] = {}
        self.arrays(v)
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def arrays(self, v: dict) -> None:
        """What words() reads: the edges, and for each state its tokens, longest first, as a chain of entries."""
        import regex

        self.find = regex.compile(WORDS).findall
        self.goto = Table(len(v["edge_keys"]))
        self.goto.put(v["edge_keys"], v["edge_to"])
        self.known = Table(PAIRS)
        self.links, self.lengths = v["link"], v["length"]
        order = np.lexsort((-v["sizes"], v["owner"]))
        owner, n = v["owner"][order], len(order)
        self.entry_size, self.entry_token = v["sizes"][order], v["ids"][order]
        own = np.full(len(self.link), -1, np.int32)
        own[owner[::-1]] = np.arange(n - 1, -1, -1)
        under = np.array(self.up, np.int32)
        below = np.where(under >= 0, own[under], -1)
        self.first = np.where(own >= 0, own, below)
        self.follow = np.where(np.append(owner[1:] == owner[:-1], False), np.arange(1, n + 1), below[owner])

    def border(self, token: int, side: int) -> list[tuple[int, float]]:
        """What stands at the token's border (side 1: right) while it is built, and until which merge."""
        out, until = [(token, float("inf"))], self.born.get(token)
        while token in self.parts:
            token = self.parts[token][side]
            out.append((token, until))
            until = self.born.get(token)
        return out

    def compatible(self, a: int, b: int) -> bool:
        right = self.border(b, 0)
        for x, x_until in self.border(a, 1):
            for y, y_until in right:
                r = self.rank.get((x, y))
                # Of equal merges the one further left comes first.
                if r is not None and r < x_until and r <= y_until:
                    return False
        return True

    def ends_at(self, state: int) -> tuple[tuple[int, int], ...]:
        """(size, token) of every token that ends where the automaton is in ``state``, longest first."""
        out, at = [], state if state in self.own else self.up[state]
        while at > 0:
            out += self.own[at]
            at = self.up[at]
        self.ending[state] = found = tuple(out)
        return found

    def word(self, word: str) -> list[int]:
        """The ids of one word."""
        edges, link, length, ending, pairs = self.edges, self.link, self.length, self.ending, self.pairs
        if len(pairs) >= REMEMBERED:
            pairs.clear()
        last, start = [0], [0]
        state = size = end = 0
        for symbol in (*word.encode(), END):
            to = edges.get(state * SYMBOLS + symbol)
            while to is None:
                state = link[state]
                size = length[state]
                to = edges.get(state * SYMBOLS + symbol)
            state = to
            size += 1
            end += 1
            for n, token in ending[state] or self.ends_at(state):
                if n <= size:
                    if n < end:
                        before = last[end - n]
                        if before < 0:
                            continue
                        pair = before << 32 | token
                        good = pairs.get(pair)
                        if good is None:
                            good = pairs[pair] = self.compatible(before, token)
                        if not good:
                            continue
                    last.append(token)
                    start.append(end - n)
                    break
            else:
                last.append(-1)
                start.append(0)
        out = []
        while end:
            out.append(last[end])
            end = start[end]
        return out[::-1]

    def fits(self, pairs: np.ndarray) -> np.ndarray:
        """compatible() of each pair (one token << 32 | the next)."""
        found = self.known.get(pairs)
        new = np.unique(pairs[found < 0])
        if new.size:
            if self.known.size + new.size > self.known.room:
                self.known = Table(max(PAIRS, new.size))
            self.known.put(new, np.array([self.compatible(p >> 32, p & 0xFFFFFFFF) for p in new.tolist()], np.int32))
            rest = np.flatnonzero(found < 0)
            found[rest] = self.known.get(pairs[rest])
        return found > 0

    def block(self, words: list[bytes]) -> list[bytes]:
        """word() of many words of at most LONG bytes, as packed ids: all of them go on by one symbol at a time."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-sizes, kind="stable")
        ends = sizes[order] + 1
        count, longest = len(words), int(ends[0])
        symbols = np.full((longest, count), END, np.int64)
        at = np.repeat(np.arange(count), ends - 1)
        symbols[np.arange(len(at)) - np.repeat(np.cumsum(ends - 1) - (ends - 1), ends - 1), at] = np.frombuffer(b"".join(words[i] for i in order.tolist()), np.uint8)
        last, step = np.full((longest + 1, count), -1, np.int64), np.zeros((longest + 1, count), np.int64)
        last[0] = 0
        state, size = np.zeros(count, np.int64), np.zeros(count, np.int64)
        for end in range(1, longest + 1):
            alive = int(np.searchsorted(-ends, -end, side="right"))  # words are in falling order of their length
            now, symbol, long = state[:alive], symbols[end - 1, :alive], size[:alive]
            to = self.goto.get(now * SYMBOLS + symbol)
            lost = np.flatnonzero(to < 0)
            while lost.size:
                now[lost] = self.links[now[lost]]
                long[lost] = self.lengths[now[lost]]
                to[lost] = self.goto.get(now[lost] * SYMBOLS + symbol[lost])
                lost = lost[to[lost] < 0]
            now[:] = to
            long += 1
            who, entry = np.arange(alive), self.first[now]
            who, entry = who[entry >= 0], entry[entry >= 0]
            while who.size:
                n, token = self.entry_size[entry], self.entry_token[entry].astype(np.int64)
                good = n <= long[who]
                before = last[np.where(good, end - n, 0), who]
                good &= before >= 0
                ask = np.flatnonzero(good & (n < end))
                good[ask] = self.fits(before[ask] << 32 | token[ask])
                last[end, who[good]], step[end, who[good]] = token[good], n[good]
                who, entry = who[~good], self.follow[entry[~good]]
                who, entry = who[entry >= 0], entry[entry >= 0]
        back, every, who, at = [], np.zeros(count, np.int64), np.arange(count), ends.copy()
        while who.size:
            back.append((who, last[at, who]))
            every[who] += 1
            at -= step[at, who]
            who, at = who[at > 0], at[at > 0]
        stops = np.cumsum(every)
        ids = np.empty(int(stops[-1]), np.int32)
        for k, (who, tokens) in enumerate(back):
            ids[stops[who] - 1 - k] = tokens
        raw, out, cuts = ids.tobytes(), [b""] * count, (4 * np.append(0, stops)).tolist()
        for k, i in enumerate(order.tolist()):
            out[i] = raw[cuts[k] : cuts[k + 1]]
        return out

    def chunks(self, text: str) -> list[str]:
        """Lower-case text in parts between which no word lies; four separators are no white space to the library, so there it is cut into words."""
        return self.find(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """The packed ids of chunks (and perhaps others): a full half takes the place of the older one."""
        if len(self.recent) >= REMEMBERED:
            self.recent, self.older = {}, self.recent
        recent, older = self.recent, self.older

        def new(texts: set[str]) -> set[str]:
            missing = texts.difference(recent)
            again = {t: ids for t in missing if (ids := older.get(t)) is not None}
            recent.update(again)
            return missing.difference(again)

        fresh = new(chunks)
        plain = {c for c in fresh if c.isascii() and c.isalpha()}  # words as they are
        cut = {c: self.find(c) for c in fresh.difference(plain)}
        words = new({w for own in cut.values() for w in own}).union(plain)
        coded = [(w, w.encode()) for w in words]
        short = [(w, b) for w, b in coded if len(b) <= LONG]
        for at in range(0, len(short), BLOCK):
            part = short[at : at + BLOCK]
            recent.update(zip((w for w, _ in part), self.block([b for _, b in part]), strict=True))
        recent.update((w, array("i", self.word(w)).tobytes()) for w, b in coded if len(b) > LONG)
        recent.update((c, b"".join(map(recent.__getitem__, own))) for c, own in cut.items() if c not in recent)
        return recent


def lower(text: str) -> str:
    """Lower case character by character: no special form of a final sigma."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return "".join(c.lower() for c in text) if "Σ" in text else text.lower()


def encoder_of(kept) -> Encoder:
    """The worker's encoder: built once a process, as broadcast values stay between tasks."""
    v = kept.value
    if "encoder" not in v["kept"]:
        v["kept"]["encoder"] = Encoder(v)
    return v["kept"]["encoder"]


def encode(df: DataFrame, path: str, column: str = "text", decoded: bool = False) -> DataFrame:
    """``df`` with ``ids`` (array of int): the token ids of the whole text.

    With ``decoded`` the ids are decoded again in the same pass, into ``decoded``.
    """
    kept = df.sparkSession.sparkContext.broadcast(load(path))

    def setup():
        import regex

        coder = encoder_of(kept)
        special = {name: np.int32(i).tobytes() for name, i in coder.special.items()}
        cut = regex.compile("(" + "|".join(map(regex.escape, sorted(coder.special, key=len, reverse=True))) + ")").split

        def parts_of(text: str) -> list[bytes | list[str]]:
            parts = cut(text) if any(s in text for s in special) else [text]
            return [special[p] if p in special else coder.chunks(lower(p)) for p in parts]

        def call(texts):
            parts = [parts_of(t) if t else [] for t in texts]
            packed = coder.learn(set().union(*(p for own in parts for p in own if isinstance(p, list)))).__getitem__
            each = [b"".join(p if isinstance(p, bytes) else b"".join(map(packed, p)) for p in own) for own in parts]
            ends = np.cumsum([0] + [len(p) // 4 for p in each])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(each), np.int32)))
            return [ids, [joined(coder.names, p) for p in each]] if decoded else [ids]

        return call

    return map_text(df, column, "ids array<int>, decoded string" if decoded else "ids array<int>", setup)


def joined(names: list[str], packed: bytes) -> str:
    """Token strings joined by one space: the vocabulary names no decoder, and this is what the library then does."""
    return " ".join(map(names.__getitem__, memoryview(packed).cast("i")))


def decode(df: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, the text of ``ids``."""
    kept = df.sparkSession.sparkContext.broadcast(load(path)["names"])
    keep = [f for f in df.schema.fields if f.name.lower() != "decoded"]

    def run(batches):
        for batch in batches:
            texts = [joined(kept.value, array("i", ids.as_py() or []).tobytes()) for ids in batch.column(column)]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in keep] + [pa.array(texts, pa.string())], [*(f.name for f in keep), "decoded"])

    return df.mapInArrow(tidy(run), T.StructType([*keep, T.StructField("decoded", T.StringType())]))


def digests(df: DataFrame, path: str) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of every row's text."""
    both = encode(df, path, decoded=True).drop("text")
    return both.select(
        *(c for c in both.columns if c not in ("ids", "decoded")),
        F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: token counts and digests of every text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs, vocabulary_path())
