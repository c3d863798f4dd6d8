"""The fill-in-middle transformation against a plain regular expression and the SQL."""

import hashlib
import re

import pytest

from matchgrid.llm import fill_in_middle as fim

HARD = [
    "", None, " ", "a", "ab", "é", "a\nb", "naïve été", "日本語 text", "\x00a\x00", "😀b😀", "word " * 3000, "x" * 300_000, "<P>", "a <M> b", "<S", "S>P>", "<<P", "Zz[`{@", "a<S", "tail<",
    *(["repeated text, twice"] * 2),
]


def plain(doc_id, text):
    """The contract, by a regular expression."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def hard(spark):
    rows = [(i, t, "kept") for i, t in enumerate(HARD * 12)] + [(None, "null id", "kept"), (None, "null id", "kept")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, output_ string")


def test_equals_a_plain_expression(hard):
    rows, df = hard
    found = fim.transformed(df).select("doc_id", "text", "n_units", "form", "prefix_chars", "middle_chars", "output", "output_").collect()
    assert len(found) == len(rows) and {r.form for r in found} == {"plain", "psm", "spm"}
    for r in found:
        assert tuple(r)[2:7] == plain(r.doc_id, r.text) and r.output_ == "kept"


def test_reads_the_text_back(hard):
    _, df = hard
    from pyspark.sql import functions as F

    out = fim.transformed(df)
    wrong = out.filter(~fim.restored(F.col("output"), F.col("form")).eqNullSafe(F.coalesce("text", F.lit(""))))
    assert wrong.count() == 0


def test_replaces_clashing_columns_and_takes_an_empty_table(spark):
    df = spark.createDataFrame([(1, "some text", "old", 5)], "doc_id long, text string, form string, draws int")
    row = fim.transformed(df).collect()[0]
    assert row.form != "old" and row.draws == 5
    assert fim.transformed(df.limit(0)).collect() == []


def test_shares_follow_the_parameters(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "concat('some words ', id) AS text")
    forms = {r.form: r["count"] for r in fim.transformed(df, transformed_percent=60, suffix_first_percent=50).groupBy("form").count().collect()}
    assert abs(forms["plain"] - 1600) < 200 and abs(forms["psm"] - forms["spm"]) < 250
    assert {r.form for r in fim.transformed(df, transformed_percent=0).collect()} == {"plain"}
    other = fim.transformed(df, seed=2).filter("form <> 'plain'").count()
    assert abs(other - 3600) < 200


def test_wavelet_ranks_equal_counts():
    import numpy as np

    classes = np.random.default_rng(3).integers(0, 4, 1000).astype(np.uint8)
    matrix = fim.WaveletMatrix(classes)
    upto = np.arange(1001)
    for kind in range(4):
        assert (matrix.rank(kind, upto) == np.concatenate([[0], np.cumsum(classes == kind)])).all()
