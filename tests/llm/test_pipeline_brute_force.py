"""The whole pipeline against plain Python, stage after stage."""


import corpus_pipeline
from test_llm_cases import least_edits
from test_llm_queries import sha, shingles

from matchgrid.llm import bpe, decontamination, language_id

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without_common_lines(rows):
    keys = {d: [line.strip(" \t\n\x0b\x0c\r").translate(LOWER) for line in t.split("\n")] for d, t in rows}
    seen = {}
    for own in keys.values():
        for k in set(own):
            seen[k] = seen.get(k, 0) + 1
    gone = {k for k, n in seen.items() if k and n >= 10}
    return [(d, "\n".join(x for x, k in zip(t.split("\n"), keys[d], strict=True) if k not in gone)) for d, t in rows]


def one_of_each_group(rows, percent=80):
    sets, root = {d: shingles(t) for d, t in rows}, {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [(d, t) for d, t in rows if find(d) == d]


def clean(rows, items):
    patterns = [decontamination.normal(t) for _, t in items]
    found = least_edits(patterns, [f" {decontamination.normal(t)} " for _, t in rows])
    bad = {d for p, row in zip(patterns, found, strict=True) for (d, _), e in zip(rows, row, strict=True) if e <= int(len(p) * decontamination.ERROR_RATE)}
    return [(d, t) for d, t in rows if d not in bad]


def test_run_equals_plain_python(spark, sf_dir, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("length(text) <= 1800")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(25)
    held = [tuple(r) for r in items.select("item_id", "text").collect()]
    texts = docs.orderBy("doc_id").limit(12).collect()
    more = [(90_000 + i, f"{r.text} A COMMON line\n  a common LINE \nand {r.text}", r.lang, r.source, r.n_chars) for i, r in enumerate(texts)]
    more += [(91_000 + i, f"{r.text[:200]} {held[i][1].upper()} {r.text[:100]}", r.lang, r.source, r.n_chars) for i, r in enumerate(texts)]
    more += [(92_000, None, None, "x", 0), (92_001, "", "en", "x", 0), (92_002, "123 !", "en", "x", 0), (92_003, "  " + texts[0].text + "\t", "en", "x", 1)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    docs.coalesce(3).write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    found = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())

    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    model = language_id.trained(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    lang, _, _, fits = model.predict([t for _, t in rows])
    kept = [r for r, p, f in zip(rows, lang, fits, strict=True) if p != "und" and f]
    assert {92_000, 92_001, 92_002} == {d for d, _ in rows} - {d for d, _ in kept}
    lines = without_common_lines(kept)
    assert sum(a != b for a, b in zip(kept, lines, strict=True)) >= 12
    one = one_of_each_group(lines)
    assert 92_003 not in {d for d, _ in one} and len(one) < len(lines)
    rest = clean(one, held)
    assert not {91_000 + i for i in range(12)} & {d for d, _ in rest} and len(rest) > len(one) / 2
    library = Tokenizer.from_file(bpe.vocabulary_path())
    want = []
    for d, t in rest:
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert found == sorted(want)
