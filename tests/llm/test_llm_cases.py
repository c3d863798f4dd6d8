"""Nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import base64
import gzip
import hashlib
import io
import os
import random
import re
import subprocess
import zlib
from fractions import Fraction
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_queries import brute_components, plain_spans

from matchgrid.llm import bpe, chat_format, decontamination, language_id, line_dedup, near_dedup, pii, quality_rules, url_filters, warc
from matchgrid.llm.mph import Shard, build

TEXT = "doc_id long, text string"


def table(spark, rows, schema=TEXT):
    return spark.createDataFrame(rows, schema)


# 1


def test_language_id_cases(spark):
    rng = random.Random(1)
    words = {"xx": ["kala", "mono", "tiri"], "yy": ["breg", "stolf", "zwirn"]}
    docs = [(i, " ".join(rng.choice(words[lang]) for _ in range(60)), lang) for i, lang in enumerate(["xx", "yy"] * 30)]
    docs += [(100, None, "xx"), (101, "", "yy"), (102, "123 !!", None), (103, "Kala MONO tiri", None), (104, "stolf breg " * 20000, None), (104, "breg", None), (None, "zwirn stolf", "yy")]
    df = table(spark, docs, "doc_id long, text string, lang string").withColumn("score", F.lit("own"))
    model = language_id.trained(df)
    found = {}
    for r in language_id.identify(df, model).collect():
        found.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert found[100] == found[101] == found[102] == [("und", 0.0)]
    assert [p for p, _ in found[103]] == ["xx"] and {p for p, _ in found[104]} == {"yy"} and found[None][0][0] == "yy"
    assert language_id.identify(df.limit(0), model).count() == 0
    none = language_id.trained(df.limit(0))
    assert {r.lang_pred for r in language_id.identify(df, none).collect()} == {"und"}


def test_cross_parsing_counts_phrases():
    model = language_id.Model({"a": ["abcabd"], "b": ["xyz"]})
    size, phrases = model.phrases(["abdab", "q", "", "Abc abd!"])
    assert size.tolist()[:3] == [5, 1, 0]
    assert phrases[0].tolist() == [2, 5] and phrases[1].tolist() == [1, 1] and phrases[2].tolist() == [0, 0]


def plain_phrases(train, text):
    """Phrases of ``text`` in blocks, each the longest known part of ``train``, by plain search."""
    count = 0
    for at in range(0, len(text), language_id.BLOCK):
        block, i = text[at : at + language_id.BLOCK], 0
        while i < len(block):
            size = 1
            while i + size < len(block) and block[i : i + size + 1] in train:
                size += 1
            count, i = count + 1, i + size
    return count


def test_phrases_equal_plain_search_on_the_corpus(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sample = language_id.training_sample(docs, letters=6000)
    model = language_id.Model(sample)
    train = {lang: " ".join(language_id.letters_of(t) for t in ts) for lang, ts in sample.items()}
    assert model.langs == sorted(train) and all(6000 * 0.8 < len(t) < 6000 + 4000 for t in train.values())
    texts = [r.text for r in docs.filter("length(text) between 1 and 1500").collect()][:40]
    size, phrases = model.phrases(texts)
    for text, n, found in zip(texts, size.tolist(), phrases.tolist(), strict=True):
        plain = re.sub(r"[\W\d_]+", " ", text.lower()).lstrip()
        assert n == len(plain) and found == [plain_phrases(train[lang], plain) for lang in model.langs]


@pytest.mark.parametrize("limit", [0, 256 << 20])
def test_scripts_of_thousands_of_letters(monkeypatch, limit):
    monkeypatch.setattr(language_id, "TABLE_BYTES", limit)
    rng = random.Random(4)
    letters = [chr(0x4E00 + i) for i in range(3000)]
    a, b = rng.sample(letters, 2000), rng.sample(letters, 2000)
    text = lambda own: " ".join("".join(rng.choice(own) + rng.choice(own[:30]) for _ in range(3)) for _ in range(900))
    model = language_id.Model({"a": [text(a)], "b": [text(b)], "c": ["plain latin words " * 50]})
    assert len({(x, y) for x, y in zip(model.first[0x4E00 : 0x4E00 + 3000].tolist(), model.second[0x4E00 : 0x4E00 + 3000].tolist(), strict=True)}) > 2000
    assert model.predict([text(a)[:400], text(b)[:400], "latin words", "中", "x" * 100_000])[0][:3] == ["a", "b", "c"]


def test_texts_of_no_known_language_do_not_fit(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model, rng = language_id.trained(docs), random.Random(2)
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(n)) for n in (100, 300, 1000) for _ in range(20)]
    assert not any(model.predict([*noise, "съешь же ещё этих мягких булок", "123", None])[3])
    assert all(model.predict([r.text for r in docs.collect()])[3]) and model.predict(["zq"])[3] == [True]


def test_training_takes_whole_texts_within_its_bounds(spark):
    rows = [(f"{w} " * 300, "xx") for w in ("aa", "bb", "cc", "dd")] + [("z" * (language_id.LONGEST + 1), "yy"), (None, "xx"), ("q", None), ("short", "zz")]
    found = language_id.training_sample(table(spark, rows + rows, "text string, lang string"), letters=1000)
    assert set(found) == {"xx", "zz"} and len(found["xx"]) == 2 and all(len(t) == 900 for t in found["xx"]) and found["zz"] == ["short"]


def test_more_languages_than_the_letters_suffice_for(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    own = {f"l{i:03}": [word() for _ in range(4)] for i in range(401)}
    say = lambda words: " ".join(rng.choice(words) for _ in range(30))
    rows = [(say(words), lang) for lang, words in own.items() for _ in range(2)]
    model = language_id.Model(language_id.training_sample(table(spark, rows, "text string, lang string")))
    assert model.langs == sorted(own)
    assert model.predict([say(words) for words in own.values()])[0] == list(own)


def test_the_model_keeps_its_bound(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MODEL_LETTERS", 2000)
    rows = [(w * n, w) for w in ("abc ", "def ", "ghi ", "jkl ") for n in (5, 100, 1000, 5000)]
    for limit in (language_id.BROADCAST_ROWS, 0):
        monkeypatch.setattr(language_id, "BROADCAST_ROWS", limit)
        sample = language_id.training_sample(table(spark, rows, "text string, lang string"))
        assert len(sample) == 4 and all(sum(map(len, ts)) <= 3 * 500 for ts in sample.values())
    model = language_id.Model(sample)
    assert all(len(origin) <= 3 * 500 and count <= 2 * 500 for count, origin, _, _ in model.edges)
    assert model.predict(["def def def"])[0] == ["def "]


@pytest.mark.parametrize("limit", [0, 256 << 20])
def test_every_letter_of_the_training_texts_has_its_code(monkeypatch, limit):
    monkeypatch.setattr(language_id, "TABLE_BYTES", limit)
    monkeypatch.setattr(language_id, "PAGES", 5)
    monkeypatch.setattr(language_id, "PLACES", 20)
    rng = random.Random(5)
    letters = [chr(0x4E00 + i) for i in range(1000)]
    halves = {"a": letters[:500], "b": letters[500:]}
    text = {lang: "".join(rng.sample(own, 500)) + "".join(rng.choice(own) for _ in range(3000)) for lang, own in halves.items()}
    model = language_id.Model({lang: [t] for lang, t in text.items()})
    codes = [(model.first[ord(c)], model.second[ord(c)], model.third[ord(c)]) for c in letters]
    assert len(set(codes)) == 1000 and sum(c[2] > 0 for c in codes) > 500 and model.width <= 256
    assert model.predict([text["a"][600:650], text["b"][600:650], text["b"][:400]])[0] == ["a", "b", "b"]
    # Phrases of a text of three-symbol letters equal those of plain search over its codes.
    coded = lambda t: [int(s) for c in t for s in (model.first[ord(c)], model.second[ord(c)], model.third[ord(c)]) if s]
    asked = text["a"][100:130] + text["b"][700:720]
    train, query = bytes(coded(text["a"])), bytes(coded(asked))
    assert model.phrases([asked])[1][0, 0] == plain_phrases(train, query)
    assert language_id.FREQUENT + 76 * 76 * 76 > sum(chr(i).isalpha() for i in range(0x110000))


# 2


def edit_distance_within(pattern, text):
    """Fewest edits of any stretch of text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


@pytest.mark.parametrize("seed", range(20))
def test_myers_and_pigeonhole_equal_the_plain_table(seed):
    rng = random.Random(seed)
    item = " ".join("".join(rng.choice("abcd") for _ in range(rng.randint(1, 6))) for _ in range(12))
    text = list(" ".join("".join(rng.choice("abcd") for _ in range(4)) for _ in range(10)) + " " + item + " dab")
    for _ in range(rng.randint(0, 6)):
        text[rng.randrange(len(text))] = rng.choice("abcd ")
    text = "".join(text)
    body, pattern = f" {decontamination.normal(text)} ", decontamination.normal(item)
    want = edit_distance_within(pattern, body)
    k = int(len(pattern) * 0.08)
    hit = decontamination.myers(pattern, body, len(pattern))
    assert hit[0] == want
    found = decontamination.Items([(7, item)], 0.08).search(text)
    assert [h["edits"] for h in found] == ([want] if want <= k else [])


def least_edits(patterns, bodies):
    """Fewest edits of each pattern against any stretch of each body: plain rows of the distance table, all bodies at once."""
    apart = "\0" * 64
    places, at = [], 0
    for body in bodies:
        places.append((at, at + len(body)))
        at += len(body) + len(apart)
    text = np.frombuffer((apart.join(bodies) + apart).encode("utf-32-le"), np.uint32)
    steps = np.arange(len(text) + 1, dtype=np.int32)
    out = []
    for pattern in patterns:
        row = np.zeros(len(text) + 1, np.int32)
        for i, p in enumerate(pattern, 1):
            new = np.minimum(row + 1, np.concatenate([[i], row[:-1] + (text != ord(p))]))
            row = np.minimum.accumulate(new - steps) + steps
        out.append([int(row[a : b + 1].min()) for a, b in places])
    return out


def test_decontamination_query_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if len(r.text or "") <= 2500]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy(F.xxhash64("item_id")).limit(40).collect()]
    bodies = [f" {decontamination.normal(t)} " for _, t in docs]
    patterns = [decontamination.normal(t) for _, t in items]
    assert all(len(p) * 0.08 >= 1 for p in patterns)
    want = {(d, i, e) for (i, _), p, row in zip(items, patterns, least_edits(patterns, bodies), strict=True) for (d, _), e in zip(docs, row, strict=True) if e <= int(len(p) * 0.08)}
    for block in (4_000_000, 2000):
        hits = decontamination.contaminated(table(spark, docs), table(spark, items, "item_id long, text string"), block_chars=block)
        rows = hits.select("doc_id", F.explode("bench_hits").alias("h")).collect()
        assert want and {(r.doc_id, r.h.item_id, r.h.edits) for r in rows} == want and len(rows) == len(want)


def test_items_with_common_wording():
    wording = "which of the following answers is right in the case of "
    items = [(i, wording + f"w{i}x{i * i} y{i}z and {i * 7919}") for i in range(400)]
    search = decontamination.Items(items, 0.08).search
    text = "some words " + items[7][1] + " more " + wording + "none of them at all and so on until the end " + items[9][1].replace("y9z", "y9")
    assert {h["item_id"]: h["edits"] for h in search(text)}.items() >= {7: 0, 9: 1}.items()
    want = least_edits([decontamination.normal(t) for _, t in items], [f" {decontamination.normal(text)} "])
    assert {h["item_id"]: h["edits"] for h in search(text)} == {i: e for (i, t), (e,) in zip(items, want, strict=True) if e <= int(len(decontamination.normal(t)) * 0.08)}


def test_decontamination_cases(spark):
    item = "the quick brown fox jumps over the lazy dog while seven wizards watch quietly"
    docs = table(spark, [(1, f"x {item.upper()}!! y"), (2, None), (3, ""), (4, "the quick brown fox"), (1, item), (5, "pad " * 30000 + item.replace("lazy", "lazzy"))])
    bench = table(spark, [(9, item), (9, item), (10, None), (11, ""), (12, "yes")], "item_id long, text string")
    for block in (4_000_000, 60):
        rows = decontamination.contaminated(docs, bench, block_chars=block).select("doc_id", "text", F.explode("bench_hits").alias("h")).collect()
        assert sorted((r.doc_id, r.h.item_id, r.h.edits) for r in rows) == [(1, 9, 0)] * 4 + [(5, 9, 1)] * 2
        first = next(r for r in rows if r.text.startswith("x"))
        assert first.text[first.h.start : first.h.end] == item.upper()
    short = table(spark, [(1, "Well, YES of it."), (2, "yes"), (3, "xyes of itx"), (4, "yes  of--it")])
    few = table(spark, [(1, "yes of it"), (2, "of it"), (3, "yes"), (4, "well no")], "item_id long, text string")
    said = lambda found: {(r.doc_id, r.h.item_id, r.text[r.h.start : r.h.end]) for r in found.select("doc_id", "text", F.explode("bench_hits").alias("h")).collect()}
    three = {(1, 1, "YES of it"), (4, 1, "yes  of--it")}
    assert said(decontamination.contaminated(short, few, least_words=3)) == three
    assert said(decontamination.contaminated(short, few)) == three | {(1, 2, "of it"), (4, 2, "of--it"), (1, 3, "YES"), (2, 3, "yes"), (4, 3, "yes")}
    assert decontamination.contaminated(docs.limit(0), bench).count() == 0
    assert decontamination.contaminated(docs, bench.limit(0)).filter("size(bench_hits) > 0").count() == 0


# 3


def test_warc_round_trip(spark, tmp_path):
    long = "é" * 200000
    rows = [(3, "http://a/\r\nX: 1", long), (1, "http://b", "x" * 100), (2, None, "x" * 100), (2, "http://c", "x" * 100), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (None, "u", long)]
    pages = table(spark, rows, "page_id long, url string, html string").withColumn("digest", F.lit("own"))
    for at, size in (("w", warc.FILE_BYTES), ("small", 1)):
        path = str(tmp_path / at)
        warc.write(pages, path, size)
        found = warc.read(spark, path).collect()
        assert len(found) == len(rows) and all(r.error is None for r in found)
        assert sorted(((r.page_id or 0), r.record_type, r.refers_to) for r in found) == sorted([(3, "response", None), (1, "response", None), (2, "revisit", 1), (2, "revisit", 1), (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None), (0, "revisit", 3)], key=lambda x: x)
        assert {r.payload_digest for r in found if r.page_id == 2} == {hashlib.sha256(b"x" * 100).hexdigest()} and {r.payload_bytes for r in found if r.page_id == 2} == {100}
        assert {r.checked for r in found if r.record_type == "revisit"} == {"block"} and {r.checked for r in found if r.record_type == "response"} == {"block,payload"}
        assert bytes(next(r.payload for r in found if r.page_id == 3)).decode() == long
        files = [str(f) for f in (tmp_path / at).iterdir()]
        assert files and all(f.endswith(".warc.gz") for f in files) and (size > 1 or len(files) == len(rows))
        whole = b"".join(gzip.decompress(open(f, "rb").read()) for f in files)
        assert whole.count(b"WARC/1.1\r\n") == len(rows)
        assert subprocess.run(["gzip", "-t", *files], capture_output=True).returncode == 0
        assert warc.read(spark, path, payload=False).columns == [c for c in warc.read(spark, path).columns if c != "payload"]
    warc.write(pages.limit(0), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


def test_warc_joins_where_repeated_payloads_are_many(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    pages = table(spark, [(i, "u", "p" * (100 + i % 3)) for i in range(9)], "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"))
    assert sorted((r.page_id, r.refers_to) for r in warc.read(spark, str(tmp_path / "w")).collect()) == [(i, None if i < 3 else i % 3) for i in range(9)]


def warc_rows(content):
    return [warc.record(d, e) for d, e in warc.members(io.BytesIO(content))]


def test_warc_damage_is_reported():
    body = bytes(random.Random(8).randbytes(200_000))
    good, large = (warc.member(i, "u", p, hashlib.sha256(p).hexdigest(), "response", None) for i, p in ((1, b"hello " * 50), (3, body)))
    bad = warc.member(2, "u", b"hello", hashlib.sha256(b"other").hexdigest(), "response", None)
    nothing = gzip.compress(b"")
    errors = lambda content: [(r[0], r[-1]) for r in warc_rows(content)]
    assert errors(good + bad + nothing + large + good[:-30]) == [(1, None), (2, "payload digest"), (3, None), (1, "cut off")]
    broken = bytearray(large)
    broken[100_000:100_050] = b"\xff" * 50
    rows = errors(good + bytes(broken) + bad + large)
    assert rows[0] == (1, None) and rows[1][1] == "cut off" and rows[-2:] == [(2, "payload digest"), (3, None)] and len(rows) == 4
    assert errors(b"no archive") == [(None, "not gzip")] and errors(b"") == [] and errors(b"junk" + good)[-1] == (1, None)
    assert warc.record(b"junk", None)[-1] == "bad header"


def test_warc_digests():
    data = b"some bytes"
    for kind in ("sha256", "sha1", "md5"):
        raw = hashlib.new(kind, data).digest()
        for value in (raw.hex(), raw.hex().upper(), base64.b32encode(raw).decode()):
            assert warc.verified(f"{kind}:{value}", data) is True and warc.verified(f"{kind}:{value}", data + b"x") is False
    assert warc.verified("sha512:00", data) is None and warc.verified(None, data) is None
    block = b"HTTP/1.1 200 OK\r\n\r\nbody"
    head = lambda digest: b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: %d\r\nWARC-Payload-Digest: %s\r\n\r\n" % (len(block), digest) + block + b"\r\n\r\n"
    assert warc.record(head(b"blake3:abc"), None)[-2:] == ("unknown", None)
    assert warc.record(head(b"sha1:" + base64.b32encode(hashlib.sha1(b"body").digest())), None)[-2:] == ("payload", None)
    assert warc.record(head(b"sha1:AAAA"), None)[-1] == "payload digest"


def test_warc_records_of_any_size(spark, tmp_path, monkeypatch):
    body = random.Random(3).randbytes(700_000)
    content = warc.member(9, "u", body, hashlib.sha256(body).hexdigest(), "response", None)
    wrong = warc.member(8, "u", body, hashlib.sha256(b"other").hexdigest(), "response", None)
    monkeypatch.setattr(warc, "LONGEST", 500_000)
    large, other, small = warc_rows(content + wrong + warc.member(7, "u", b"x", hashlib.sha256(b"x").hexdigest(), "response", None))
    assert large == (9, "u", "response", None, 700_000, hashlib.sha256(body).hexdigest(), None, "block,payload", None)
    assert other[6] is None and other[-1] == "payload digest" and small[6] == b"x" and small[-1] is None
    monkeypatch.setattr(warc, "LONGEST", 700_000)
    assert warc_rows(content)[0][6] == body
    assert [warc.record(d, e)[6] for d, e in warc.members(io.BytesIO(content), keep=False)] == [None]


def test_warc_records_do_not_depend_on_how_they_stream():
    whole = [zlib.decompress(warc.member(i, "http://é", p, hashlib.sha256(p).hexdigest(), k, r), wbits=31) for i, p, k, r in ((1, b"a\r\n\r\nb", "response", None), (2, b"", "response", None), (3, b"zz", "revisit", 1))]
    whole += [whole[0][:-3], whole[0] + b"x", whole[0].replace(b"WARC/1.1", b"W"), b"WARC/1.1\r\nContent-Length: 4\r\nWARC-Type: resource\r\nWARC-Payload-Digest: md5:" + hashlib.md5(b"ab\r\n").hexdigest().encode() + b"\r\n\r\nab\r\n\r\n\r\n"]
    for data in whole:
        for step in (1, 2, 3, 7, 50):
            one = warc.Record()
            for at in range(0, len(data), step):
                one.feed(data[at : at + step])
            assert one.row(None) == warc.record(data, None)
    assert [warc.record(d, None)[-1] for d in whole] == [None, None, None, "bad length", "bad length", "bad header", None]
    # Without HTTP the whole block is the payload.
    assert warc.record(whole[-1], None)[4:8] == (4, hashlib.md5(b"ab\r\n").hexdigest(), b"ab\r\n", "payload")


def test_warc_whole_records_survive_damage_around_them():
    rng = random.Random(6)
    body = lambda n: rng.randbytes(n)
    made = lambda i, p: warc.member(i, "u", p, hashlib.sha256(p).hexdigest(), "response", None)
    for _ in range(60):
        parts, good = [], []
        for i in range(6):
            one = made(i, body(rng.choice((10, 5000, 150_000))))
            if rng.random() < 0.5:
                parts.append(one)
                good.append(i)
            elif rng.random() < 0.5:
                parts.append(one[: rng.randrange(20, len(one) - 9)])
            else:
                parts.append(bytes(rng.choice((10, 100_000))))
        rows = warc_rows(b"".join(parts))
        assert [r[0] for r in rows if r[-1] is None] == good


def test_warc_paths_are_those_of_hadoop(spark, tmp_path):
    sc = spark.sparkContext
    assert warc.resolved(spark, str(tmp_path)) == f"file:{tmp_path}" and warc.store_of(f"file:{tmp_path}")[1] == str(tmp_path)
    cluster = SimpleNamespace(conf=spark.conf, sparkContext=SimpleNamespace(master="spark://host:7077", _jsc=sc._jsc, _jvm=sc._jvm))
    shared = spark.conf.get("spark.checkpoint.dir")
    assert warc.resolved(cluster, f"{shared}/w") == f"file:{shared}/w"
    for path in (str(tmp_path), f"{shared}-other/w"):
        with pytest.raises(ValueError, match="local disk"):
            warc.resolved(cluster, path)
    hadoop = sc._jsc.hadoopConfiguration()
    before = hadoop.get("fs.defaultFS")
    try:
        hadoop.set("fs.defaultFS", "hdfs://127.0.0.1:9")
        assert warc.resolved(spark, "/some/where") == "hdfs://127.0.0.1:9/some/where"
        assert warc.resolved(spark, f"file:{tmp_path}") == f"file:{tmp_path}"
    finally:
        hadoop.set("fs.defaultFS", before)
    store, folder = warc.store_of("s3a://bucket/some/where?region=eu-west-1&endpoint_override=localhost:9000")
    assert (store.type_name, folder) == ("s3", "bucket/some/where")


def test_warc_fails_where_a_file_is_not_as_written(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(b"1234")
    for name, size in (("none", 4), ("a", 5)):
        with pytest.raises(OSError, match="do not see the same folder"):
            warc.Writer(str(tmp_path), 1).commit([None, warc.Written([(f"{tmp_path}/{name}.warc.gz", f"{tmp_path}/b.warc.gz", size)])])
    with pytest.raises(OSError, match="where it was listed"):
        list(warc.Reader(str(tmp_path), ["page_id"]).read(warc.Files([(f"{tmp_path}/a.warc.gz", 3)])))


def test_warc_ties_and_null_ids(spark, tmp_path):
    same = "p" * 200
    warc.write(table(spark, [(None, "u", same)] * 3 + [(5, "u", same + "q")] * 2 + [(None, "u", same + "q")], "page_id long, url string, html string"), str(tmp_path / "w"))
    found = [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read(spark, str(tmp_path / "w")).collect()]
    assert sorted(found, key=str) == sorted([(None, 200, "response", None)] * 3 + [(5, 201, "response", None)] * 2 + [(None, 201, "revisit", 5)], key=str)


# 4


def test_pii_cases(spark):
    texts = [
        None, "", "a@b.c@d.e x@y", "é 🙂 foo.bar@x-y.co.uk, 1.2.3.4.5 300.1.1.1 001.002.003.004", "+49 (30) 123-456 789 and +1 2", "4111 1111 1111 1111 4111-1111-1111-1112 " + "1 " * 20000,
        "a" * 30000, "9" * 50000, "a.b@c" * 5000, "1.2.3.4 " * 3000, "1" * 300 + ".2.3.4",
    ]
    df = table(spark, list(enumerate(texts)))
    for r in pii.find(df.withColumn("kind", F.lit(1))).collect():
        assert ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.base_spans) == plain_spans(texts[r.doc_id])
    more = pii.find(table(spark, [(1, "IBAN: DE89 3704 0044 0532 0130 00 and DE88 3704 0044 0532 0130 00"), (2, "tel 030 1234567\nnr 030 1234567")]))
    found = {r.doc_id: [(s.kind, s.match) for s in r.all_spans] for r in more.collect()}
    assert found == {1: [("iban", "DE89 3704 0044 0532 0130 00")], 2: [("phone_local", "030 1234567")]}
    assert pii.find(df.limit(0)).count() == 0


# 5


def variants(seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
            words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(words)))
    rows += [(5, None), (6, ""), (7, " \t"), (8, "One two"), (9, "one TWO"), (10, "one two three"), (11, base[0] * 3)]
    return rows


@pytest.mark.parametrize("hot", [64, 4])
def test_near_dedup_cases(spark, monkeypatch, hot):
    monkeypatch.setattr(near_dedup, "HOT", hot)
    rows = variants(hot)
    want = brute_components(rows)
    found = near_dedup.groups(table(spark, rows).withColumn("set_key", F.lit("own")))
    for r in found.collect():
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_near_dedup_repeats_nulls_and_nothing(spark):
    df = table(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "g h i j k"), (None, "l m n o p q")])
    found = sorted((r.n_shingles, r.doc_id or 0, r.component_id or 0, r.kept) for r in near_dedup.groups(df).collect())
    assert found == [(1, 2, 2, True), (2, 0, 0, True), (2, 0, 1, False), (2, 1, 1, True), (2, 1, 1, True)]
    assert near_dedup.groups(df.limit(0)).count() == 0


# 6


def test_quality_counts(spark):
    text = "A b c d e f A b c d e f\nsame line\n\nsame line\n $%\n"
    found = quality_rules.counts(table(spark, [(1, text), (2, None), (3, ""), (4, "x " * 30000)])).collect()
    rows = {r.doc_id: r for r in found}
    assert (rows[1].n_words, rows[1].n_symbols, rows[1].n_dup_lines, rows[1].n_repeat_words, rows[1].word_chars) == (17, 2, 1, 12, 12 + 16 + 2)
    assert (rows[2].n_words, rows[3].n_words, rows[3].word_chars, rows[4].n_repeat_words) == (0, 0, 0, 30000)


def test_binomial_tail(spark):
    from math import comb

    for n, k, p in ((30, 3, 0.2), (10, 0, 0.1), (50, 9, 0.3), (1, 1, 0.3), (25, 25, 0.4), (900, 3, 0.01), (20000, 180, 0.01), (20000, 20, 0.01)):
        got = spark.range(1).select(quality_rules.at_most(F.lit(k), F.lit(n), p)).first()[0]
        q = Fraction(p)
        assert got == pytest.approx(float(sum(comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k + 1)))) if n < 1000 else got == pytest.approx(tail(n, k, p))


def tail(n, k, p):
    from math import exp, fsum, lgamma, log

    return fsum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log(1 - p)) for i in range(k + 1))


def test_repeated_labels_count_once(spark):
    rows = [(i % 300, "xx", 0.0 if i % 300 else 0.4) for i in range(3000)]
    measures = table(spark, rows, "doc_id long, stratum string, symbols double").withColumns({"dup_lines": F.lit(0.0), "repeats": F.lit(0.0), "base_failed": F.lit(False)})
    labels = spark.range(3000).select((F.col("id") % 300).alias("doc_id"), F.lit(1).alias("quality"))
    # One of 300 documents lost is too many for 1.2 % at this level, ten of 3000 would not be.
    assert quality_rules.cutoffs(measures, labels, risk=0.012).first().max_symbols == 0.5 and quality_rules.enough(0.012) <= 300
    apart = measures.withColumn("doc_id", F.monotonically_increasing_id())
    assert quality_rules.cutoffs(apart, apart.select("doc_id", F.lit(1).alias("quality")), risk=0.012).first().max_symbols == 0.01


def test_cutoffs_keep_good_documents(spark):
    rows = [(i, "xx", 0.0 if i % 100 else 0.4) for i in range(3000)]
    measures = table(spark, rows, "doc_id long, stratum string, symbols double").withColumns({"dup_lines": F.lit(0.0), "repeats": F.lit(0.02), "base_failed": F.lit(False)})
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    r = quality_rules.cutoffs(measures, labels, risk=0.06).first()
    assert (r.max_symbols, r.max_dup_lines, r.max_repeats) == (0.01, 0.01, 0.02)
    r = quality_rules.cutoffs(measures, labels, risk=0.012).first()  # 1 % of rejections is not surely below 1.2 %
    assert r.max_symbols == 0.5
    assert quality_rules.cutoffs(measures, labels.limit(0)).count() == 0


def plain_rules(strata, risk, error):
    """{stratum: number of rules allowed} from lists of the first rule that loses each good document, by the exact tail."""
    from math import comb

    least = quality_rules.enough(risk, error)
    units = {s: x for s, x in strata.items() if len(x) >= least}
    small = [s for s in strata if s not in units]
    if small:
        units[None] = [r for s in small for r in strata[s]]

    def p(unit, rule):
        n, k = len(units[unit]), sum(r <= rule for r in units[unit])
        return sum(comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1)) if k < risk * n else 1.0

    firm, part = error * (1 - quality_rules.APART), error * quality_rules.APART
    until = lambda u, first, last, level: next((r - 1 for r in range(first, last + 1) if p(u, r) > level), last)
    left, allowed = sorted(units, key=lambda u: (p(u, quality_rules.FIRM), u is not None, u)), {}
    while left and p(left[0], quality_rules.FIRM) <= firm / len(left):
        allowed[left.pop(0)] = quality_rules.FIRM
    for u in left:
        allowed[u] = until(u, 1, quality_rules.FIRM, firm / len(left))
    for u, rules in allowed.items():
        if rules == quality_rules.FIRM:
            allowed[u] = until(u, quality_rules.FIRM + 1, quality_rules.RULES, part / len(units))
    return {s: allowed[s if s in units else None] for s in strata}


def test_rules_equal_a_plain_search(spark):
    rng = random.Random(17)
    values = {1: 0.6, 2: 0.4, 8: 0.025, 9: 0.015}
    for case in range(3):
        strata = {s: [rng.choice([99] * 80 + [1, 2, 8, 9] * (i % 3)) for _ in range(n)] for i, (s, n) in enumerate((("a", 150), ("b", 400), ("c", 60), ("d", 70), ("e", 130 + 60 * case)))}
        rows = [(i * 1000 + j, s, values.get(rule, 0.0)) for i, (s, x) in enumerate(strata.items()) for j, rule in enumerate(x)]
        measures = table(spark, rows, "doc_id long, stratum string, symbols double").withColumns({"dup_lines": F.lit(0.0), "repeats": F.lit(0.0), "base_failed": F.lit(False)})
        found = {r.stratum: r for r in quality_rules.cutoffs(measures, measures.select("doc_id", F.lit(1).alias("quality"))).collect()}
        for s, rules in plain_rules(strata, quality_rules.RISK, quality_rules.ERROR).items():
            if not rules:
                assert s not in found
                continue
            falling, r = quality_rules.CUTOFFS[::-1], found[s]
            assert r.max_symbols == falling[min(rules, 9) - 1] and r.max_repeats == (falling[rules - 19] if rules > 18 else None), (s, rules)


def test_learned_rules_reject_beyond_the_base_and_keep_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found = quality_rules.judged(docs, labels.filter("doc_id % 2 = 0"))
    assert found.filter("not base_failed and not kept").count() > 0
    held = found.join(labels.filter("doc_id % 2 = 1 and quality = 1").select("doc_id").distinct(), "doc_id").filter("not base_failed")
    for r in held.groupBy("stratum").agg(F.count("*").alias("n"), F.count_if(~F.col("kept")).alias("lost")).collect():
        assert r.lost <= quality_rules.RISK * r.n + 2 * (quality_rules.RISK * r.n) ** 0.5
    whole = quality_rules.judged(docs, labels).filter("not base_failed")
    bad = whole.join(labels.filter("quality = 0").select("doc_id").distinct(), "doc_id")
    assert bad.filter("not kept").count() > 0.5 * bad.count()


def test_quality_cases(spark):
    docs = table(spark, [(1, "a b c d e f g h i j k", None), (1, "a", "xx"), (None, None, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    found = quality_rules.judged(docs, labels).select("doc_id", "n_words", "kept").collect()
    assert sorted((r.doc_id or 0, r.n_words, r.kept) for r in found) == [(0, 0, False), (1, 1, False), (1, 11, True)]
    assert quality_rules.judged(docs.limit(0), labels).count() == 0


# 7


def test_url_cases(spark):
    urls = [
        "http://Example.ORG/es/x", "http://a.example.org/en/12?q#x", "http://notexample.org/es/", "https://org/", "https://org", "ftp://x.com/de/", "x.com/de/", None, "", "http://b.spam-farm.net/a",
        "http://x.com/fr/http://y.org/", "http://example.org/en/2", "http://x.net?/wp-login.php", "http://x.net/wp-login.php",
    ]
    pages = table(spark, [(i, u) for i, u in enumerate(urls)] + [(0, urls[0]), (0, urls[1])], "page_id long, url string").withColumn("host", F.lit("own"))
    found = {}
    for r in url_filters.judged(pages, url_filters.rules_table(spark, url_filters.HOST_RULES, url_filters.PATTERN_RULES)).collect():
        found.setdefault((r.page_id, r.url), []).append((r.host, r.path, r.rule, r.verdict))
    assert found[0, urls[0]] == [("example.org", "/es/x", "example.org/es/", "block")] * 2 and len(found) == len(urls) + 1
    one = {i: found[i, u][0] for i, u in enumerate(urls)}
    assert one[1] == ("a.example.org", "/en/12", "example.org/en/1", "block") and one[2][2:] == ("org/", "allow")
    assert one[3][2] == "org/" and one[4] == ("org", "", None, "allow") and one[5][2:] == ("com/de/", "block")
    assert one[6] == one[7] == one[8] == ("", "", None, "allow") and one[9][2:] == (None, "block")
    assert one[10] == ("x.com", "/fr/http://y.org/", "com/fr/", "allow") and one[11][2] == "org/"
    assert one[12][3] == "allow" and one[13][3] == "block"
    rules = url_filters.rules_table(spark, url_filters.HOST_RULES, [])
    assert url_filters.judged(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filters.judged(pages, rules.limit(0)).collect()} == {"allow"}


PATTERNS = ["||a.com^", "|a.com/", "^ad*top^", "x*y", "*q*", "b.net|", "^track^", "/Up^", "(1+1)", "^|", "é^z", "||com/a/*/c^", "a", "^^", "[x]$"]


def plain_fits(pattern, place):
    """Fits by plain search: the pattern's parts one after the other at every start."""
    start = {0: [0]} if pattern.startswith("|") else {}
    body = pattern.removeprefix("||" if pattern.startswith("||") else "|")
    end = body.endswith("|") and len(body) > 0
    body = body[:-1] if end else body
    if pattern.startswith("||"):
        at = {0} | {i + 1 for i, c in enumerate(place.split("/")[0]) if c == "."}
    else:
        at = {0} if start else set(range(len(place) + 1))
    for c in body:
        if c == "*":
            at = set(range(min(at), len(place) + 1)) if at else set()
        elif c == "^":
            sep = {i + 1 for i in at if i < len(place) and not (place[i].isascii() and place[i].isalnum())}
            at = sep | (at & {0, len(place)})
        else:
            at = {i + 1 for i in at if i < len(place) and place[i] == c}
    return len(place) in at if end else bool(at)


def test_patterns_equal_plain_search(spark):
    places = ["a.com/", "b.a.com", "xa.com/x", "ad-top/", "bad-top", "ad.x.top", "x1y", "b.net", "c.b.net/", "track", "s.track.io/", "h/up/", "h/Up", "h/Up.x", "h/(1+1)", "q", "é!z", "éz", "com/a/b/c", "x.com/a//c/", "a--", "h/[x]$", "h/a\nb.net", "zz"]
    pages = table(spark, [(i, f"http://{p}") for i, p in enumerate(places)] + [(99, None), (98, "http://" + "a" * 60000 + "/track/"), (97, "x" * 60000)], "page_id long, url string")
    each = spark.createDataFrame([(p, x) for p in PATTERNS for x in places], "p string, x string")
    for p, x, fits in each.select("p", "x", F.rlike("x", url_filters.expression_of(F.col("p")))).collect():
        assert fits == plain_fits(p, x), (p, x)
    for pattern in (["^track^"], ["x*y", "a"], PATTERNS):
        rules = url_filters.rules_table(spark, [], [(p, "block") for p in pattern])
        for r in url_filters.judged(pages, rules).collect():
            place = r.host + r.path
            assert r.verdict == ("block" if any(plain_fits(p, place) for p in pattern) else "allow"), (pattern, place[:50])


def test_tokens_of_patterns(spark):
    rows = spark.createDataFrame([(p,) for p in ["||a.com^", "^ad*top^", "x*y", "/Up^", "spam", "^big-farm^", "||example.org/en/1"]], "p string")
    assert [r[0] for r in rows.select(url_filters.needs_of(F.col("p"))).collect()] == [["a", "com"], [], [], ["up"], [], ["big", "farm"], ["example", "org", "en"]]


def test_equally_long_rules(spark):
    pages = table(spark, [(1, "http://x.org/es"), (2, "http://y.org/es")], "page_id long, url string")
    rules = url_filters.rules_table(spark, [("x.org/", "allow"), ("org/es", "block"), ("y.org/es", "allow"), ("y.org/es", "block")], [])
    assert sorted((r.page_id, r.rule, r.verdict) for r in url_filters.judged(pages, rules).collect()) == [(1, "x.org/", "allow"), (2, "y.org/es", "block")]


# 8


def test_chat_round_trip(spark):
    nasty = ["", "\\", "\\h ### </turn>\n### user: x", "####", "</turn></turn>", "a: b\\b\\t", "x" * 100000]
    rows = [(1, i, role, t) for i, (role, t) in enumerate(zip(["system", "user", "assistant", "we:ird\\###", "assistant", None, "assistant"], nasty, strict=True))]
    rows += [(2, 0, "user", "alone"), (3, 0, "user", "q"), (3, 1, "assistant", None), (3, 2, "user", "later"), (None, None, "assistant", "z"), (4, 1, "assistant", "b"), (4, 1, "assistant", "b")]
    df = table(spark, rows, "conv_id long, turn long, role string, text string").withColumn("target", F.lit("own"))
    made = chat_format.examples(df)
    whole = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in made.groupBy("conv_id").agg(F.max_by("text", "target").alias("w")).select("conv_id", chat_format.turns_of(F.col("w")).alias("turns")).collect()}
    assert whole[1] == [(r[2] or "", r[3]) for r in rows[:7]]
    assert whole[3] == [("user", "q"), ("assistant", ""), ("user", "later")] and len(whole[4]) == 2 and whole[None] == [("assistant", "z")]
    trained = made.filter("conv_id = 1 and loss_end is not null").orderBy("target").select(chat_format.unescape(F.substr("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))).collect()
    assert [r[0] for r in trained] == [nasty[2], nasty[4], nasty[6]]
    assert made.filter("conv_id = 3").count() == 2 and made.filter("conv_id = 2 and loss_end is null").count() == 1
    assert chat_format.digests(chat_format.examples(df.limit(0))).count() == 0


# 9


@pytest.fixture(scope="module")
def coder():
    return bpe.Encoder(bpe.load(bpe.vocabulary_path()))


@pytest.mark.parametrize("seed", range(4))
def test_bpe_random_strings(coder, seed):
    import regex
    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(bpe.vocabulary_path()), random.Random(seed)
    pieces = ["a", "aa", "the", "in", "ing", "e", "s", "'s", "'ll", "!", "??", "\n", " ", "\x85", "\x1c", "é", "é", "ß", "Σ", "İ", "½", "²", "中", "文", "🙂", "1", "23", "ABC", " "]
    find = regex.compile(bpe.WORDS).findall
    for _ in range(1500):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))
        mine = [i for w in find(bpe.lower(text)) for i in coder.word(w)]
        assert mine == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_bpe_cases(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path())
    texts = [None, "", "  ", "a<|endoftext|>B <|startoftext|>", "<|endoftext", "x" * 3000, "same", "same"]
    df = table(spark, list(enumerate(texts))).withColumn("ids", F.lit("own"))
    encoded = bpe.encode(df, bpe.vocabulary_path())
    for r in bpe.decode(encoded, bpe.vocabulary_path()).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.digests(df.limit(0), bpe.vocabulary_path()).count() == 0


def test_bpe_new_words_go_together(coder, monkeypatch):
    """Short words cost no call of their own, and chunks, separators that are no white space, long words and small tables give what each word alone gives."""
    from array import array

    import regex
    from tokenizers import Tokenizer

    rng = random.Random(11)
    parts = ["the", "relyan", "Σίσυφος", "don't", "'red", "!'s", "über", "日本", "a\x1cb", "\x1f's", "x" * 60, "ab" * 23, "é" * 24, "--", "7", "th́e", "ﬁ", ".", "🙂🙂"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", "\n", " ", "\x1d", "\x85"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    find = regex.compile(bpe.WORDS).findall
    want = [b"".join(array("i", coder.word(w)).tobytes() for w in find(bpe.lower(t))) for t in texts]
    alone, word = [], coder.word
    monkeypatch.setattr(coder, "word", lambda w: alone.append(w) or word(w))
    monkeypatch.setattr(bpe, "BLOCK", 50)
    for room, pairs in ((bpe.REMEMBERED, bpe.PAIRS), (40, 30)):
        monkeypatch.setattr(bpe, "REMEMBERED", room)
        monkeypatch.setattr(bpe, "PAIRS", pairs)
        coder.recent, coder.older, coder.known = {}, {}, bpe.Table(pairs)
        found = []
        for at in range(0, len(texts), 30):
            cut = [coder.chunks(bpe.lower(t)) for t in texts[at : at + 30]]
            packed = coder.learn({c for own in cut for c in own})
            found += [b"".join(packed[c] for c in own) for own in cut]
        assert found == want
        assert all(len(w.encode()) > bpe.LONG for w in alone)
    library = Tokenizer.from_file(bpe.vocabulary_path())
    assert [memoryview(b).cast("i").tolist() for b in found] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_bpe_split_at_white_space_is_the_library_s():
    import regex

    space = regex.compile(f"[{bpe.SPACE}]")
    assert [i for i in range(0x110000) if bool(space.match(chr(i))) != chr(i).isspace()] == [0x1C, 0x1D, 0x1E, 0x1F]


def test_other_vocabulary_rules_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="normalizer"):
        bpe.load(public_tokenizers.path("byte_bpe_50k.json"))


# 10


def test_perfect_hash():
    rng = np.random.default_rng(5)
    hi, lo = rng.integers(0, 2**63, 5000).astype(np.uint64), rng.integers(0, 2**63, 5000).astype(np.uint64)
    hi[:100] = hi[0]  # equal halves
    shard = Shard(*build(hi, lo, np.arange(1, 5001)))
    assert shard.count(hi, lo).tolist() == list(range(1, 5001))
    assert not shard.count(lo, hi).any() and len(shard.fingerprints) == 5000
    big = Shard(*build(hi[:3], lo[:3], np.array([1, 2**32 - 1, 2**40])))
    assert big.count(hi[:3], lo[:3]).tolist() == [1, 2**32 - 1, 2**32 - 1]
    none = Shard(*build(hi[:0], lo[:0], hi[:0]))
    assert none.count(hi, lo).sum() == 0


@pytest.mark.parametrize(("limit", "least", "shard_keys"), [(64 << 20, 1000, 1 << 18), (64 << 20, 1000, 3), (0, 1000, 1 << 18), (0, 12, 2), (0, 1, 5)])
def test_line_dedup_cases(spark, monkeypatch, limit, least, shard_keys):
    monkeypatch.setattr(line_dedup, "FREQUENT_LEAST", least)
    rows = [(i, f" Common LINE\t\nown {i}\n\nÄ line\r\n") for i in range(10)]
    rows += [(50, "x\ncommon line"), (50, "x\ncommon line"), (51, None), (52, ""), (53, "\n\n"), (54, "ä line\nown 3"), (None, "common line"), (55, "own 3\n" * 50000)]
    df = table(spark, rows).withColumn("n_lines", F.lit("own")).withColumn("hi", F.lit(1))
    found = line_dedup.drop_common_lines(df, broadcast_bytes=limit, shard_keys=shard_keys)
    assert set(found.columns) == {"doc_id", "hi", "text", "n_lines", "n_dropped"}
    rows = sorted((-1 if r.doc_id is None else r.doc_id, r.text[:20], r.n_lines, r.n_dropped) for r in found.collect())
    assert (0, "own 0\n\n", 5, 2) in rows and rows.count((50, "x", 2, 1)) == 2 and (-1, "", 1, 1) in rows
    assert (51, "", 1, 0) in rows and (52, "", 1, 0) in rows and (53, "\n\n", 3, 0) in rows
    assert (54, "ä line\nown 3", 2, 0) in rows and (55, ("own 3\n" * 9)[:20], 50001, 0) in rows
    assert line_dedup.drop_common_lines(df.limit(0), broadcast_bytes=limit).count() == 0


def test_line_index_holds_every_distinct_line(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    counts = line_dedup.line_counts(docs)
    want = {(r.hi, r.lo): r.docs for r in counts.collect()}
    index = line_dedup.index_shards(counts, 7).collect()
    shards = {r[0]: Shard(*r[1:]) for r in index}
    assert sum(len(s.counts) for s in shards.values()) == len(want) and min(want.values()) == 1
    for (hi, lo), n in want.items():
        key = np.array([hi]).view(np.uint64), np.array([lo]).view(np.uint64)
        assert shards[hi % 7].count(*key).tolist() == [n]


# all


OWN = ["_row", "_m", "_n", "_email", "_iban", "_words", "_lines", "_at", "bench_hits_before", "bench_hits", "text_key", "line_hits", "hits", "lang_pred", "score", "n_lines", "stratum", "symbols", "kept_id", "times", "row"]


def with_own(df):
    return df.select("*", *(F.lit("own").alias(c) for c in OWN))


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, f"same line of words here\nother {i} at a{i}@b.com with seven more words", "xx") for i in range(12)] + [(None, None, None), (90, "", "yy")]
    return with_own(table(spark, rows, "doc_id long, text string, lang string"))


def kept_own(found, replaced=()):
    rows = found.collect()
    return len(rows) and all(r[c] == "own" for r in rows for c in OWN if c not in replaced)


def test_columns_of_working_names_stay(spark, clashing):
    assert kept_own(pii.find(clashing))
    bench = with_own(table(spark, [(1, "nothing of this"), (2, "same line of words")], "item_id long, text string"))
    for block in (4_000_000, 5):
        assert kept_own(decontamination.contaminated(clashing, bench, block_chars=block), ["bench_hits"])
    for limit in (64 << 20, -1):
        assert kept_own(line_dedup.drop_common_lines(clashing, broadcast_bytes=limit), ["n_lines"])
    labels = with_own(table(spark, [(1, 1, 0)], "doc_id long, quality int, toxic int"))
    assert quality_rules.judged(clashing, labels).count() == clashing.count()
    assert near_dedup.groups(clashing).count() == clashing.count()


def test_pipeline_stages_leave_other_columns_alone(spark, clashing, sf_dir):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, clashing, sf_dir)
        assert found.columns == clashing.columns, name
        assert all(r[c] == "own" for r in found.collect() for c in OWN), name


# pipeline


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.run(spark, sf_dir)
    ids = {r.doc_id for r in out.collect()}
    assert 0 < len(ids) < docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == before.columns and docs.count() <= before.count(), name
    assert {r.doc_id for r in docs.select("doc_id").collect()} == ids
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
