"""SentencePiece ids and decoded texts against the sentencepiece library."""

import hashlib
import random

import pytest

from matchgrid.llm import sentence_pieces as sp


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=sp.model_path())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


HARD = [
    "", None, " ", "  ", "\n", "\x00", "▁", "▁ ▁", " a", "a ", "a  b   c", "<s>", "</s> <unk> <0x0A>", "�", "😀", "é é", "日本語のテキスト 　x", "ﬁ ½", "Hello\tworld\r\n",
    " " * 20_001, "a" * 20_001, "ab" * 9000, "▁ " * 5000, "http://" * 3000, "é" * 4001, "x\ny" * 4000, "same", "same",
]


def test_query_equals_the_library(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = sp.query(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_hard_texts_equal_the_library(spark, library):
    rng = random.Random(5)
    pools = ["ab ", "aeiou st nr  ", "  ▁a", "etaoin shrdlu.,;:()=-_", "日本語のaテ ", "éüßαЖ😀�\x00\n\t x", " "]
    made = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for pool in pools for _ in range(300)]
    df = spark.createDataFrame([(i, t, "old", "kept") for i, t in enumerate(HARD + made)], "doc_id long, text string, ids string, ids_ string")
    for r in sp.encode(df, sp.model_path(), decoded=True).collect():
        assert r.ids == library.encode(r.text or "") and r.decoded == library.decode(r.ids) and r.ids_ == "kept"
    assert sp.encode(df.limit(0), sp.model_path()).collect() == []


def test_decodes_any_ids_as_the_library_does(spark, library):
    rng = random.Random(6)
    lists = [[rng.choice([rng.randrange(32000), rng.randrange(260), 259, 28705]) for _ in range(rng.randint(0, 12))] for _ in range(3000)]
    df = spark.createDataFrame([(x, "old") for x in lists] + [(None, "old")], "ids array<int>, decoded string")
    for r in sp.decode(df, sp.model_path()).collect():
        assert r.decoded == library.decode(r.ids or [])


def test_a_piece_is_taken_back_where_the_longest_do_not_fit():
    """Greedy longest matching alone gives other ids on many words, so the way back is used."""
    coder = sp.Coder(sp.load(sp.model_path()))
    words = ["▁withthe", "▁towardsthe", "▁herethere", "▁unrealistically", "▁wasnoton"]
    taken_back = 0
    for word in words:
        greedy, at = [], 0
        while at < len(word):
            piece = next(coder.ids[word[at:end]] for end in range(len(word), at, -1) if word[at:end] in coder.ids)
            greedy.append(piece)
            at += len(coder.names[piece])
        taken_back += greedy != coder.backtracked(word)
    assert taken_back


def test_refuses_a_file_with_other_rules(tmp_path):
    raw = open(sp.model_path(), "rb").read()
    rules = b"\x0a\x08identity\x12\x00\x18\x01\x20\x00"
    assert rules in raw
    other = tmp_path / "other.model"
    other.write_bytes(raw.replace(rules, rules[:-1] + b"\x01"))
    with pytest.raises(ValueError, match="blanks"):
        sp.load(str(other))


def test_dictionaries_stay_bounded(monkeypatch, library):
    monkeypatch.setattr(sp, "REMEMBERED", 20)
    coder = sp.Coder(sp.load(sp.model_path()))
    import codecs

    codecs.register_error("each_byte", sp.each_byte)
    text = " ".join(f"word{i} {'x' * 100}{i}" for i in range(300))
    ids = list(memoryview(coder.packed(text)).cast("i"))
    assert ids == library.encode(text) and coder.decoded(ids) == text
    assert len(coder.cuts) <= 20 and len(coder.older) <= 20 and len(coder.pairs) <= 20
    assert all(len(c) <= sp.SHORT for c in coder.cuts)
