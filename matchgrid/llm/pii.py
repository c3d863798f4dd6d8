r"""Personal data: regular expressions propose, validators confirm, context decides.

Base kinds (email, ip, card, phone) are the leftmost non-overlapping matches of
their expressions that pass their validators: number ranges, Luhn, digit
counts. They always stay. The method adds the kinds of ``ADDED``: keys of known
shape, IBANs (mod-97), secrets (strings of mixed letters and digits with the
entropy of random ones), social security numbers (issued ranges) and phone
numbers without a plus sign.

Every span has a score: that of its kind once its validator has passed, plus
``GAIN`` if one of the kind's words stands before it in the last ``CONTEXT``
code points of its line, minus ``LOSS`` if a word stands there that speaks
against it. An added span is kept from ``LEAST_SCORE`` on, if it overlaps no base
span and no kept span of a kind listed before its own. So context decides both
ways: ``token = "<40 hex digits>"`` is a secret, ``commit <40 hex digits>`` is
none, an IBAN counts unless an example is announced.

Positions come from the text between the matches: splitting at the expression
gives the gaps, and running sums of the lengths of gaps and matches give
the spans (code points, end exclusive). Everything is array functions on the
row, so there is no shuffle. The expressions are written with possessive
quantifiers and look-behind, which match the same spans as the plain ones but
neither recurse nor scan a long run of characters more than once, so very long
texts are searched whole in time proportional to their length.

Null and empty texts have no spans. Rows are independent, so repeated rows and
ties need no rule; spans with equal starts are ordered by kind. An empty table
gives an empty result. Columns of the outputs' names are replaced; others stay.
"""

from __future__ import annotations

import string
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds' expressions.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
LOCAL_PHONE = r"(?<![A-Za-z0-9.+(-])\(?[0-9]{2,5}\)?(?:[\x20/.-]?[0-9]{2,5}){2,4}(?![A-Za-z0-9])"
SECRET = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+=*+(?![A-Za-z0-9])"
SECRET_LETTERS = string.ascii_letters + string.digits + "+/_-="
SSN = r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])"
KEY = (
    r"(?<![A-Za-z0-9_])(?:A[KS]IA[A-Z0-9]{16}|gh[oprsu]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}+|sk_live_[A-Za-z0-9]{16,}+|AIza[A-Za-z0-9_-]{35}"
    r"|eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+|-----BEGIN\x20(?:[A-Z]+\x20)?PRIVATE\x20KEY-----)(?![A-Za-z0-9_])"
)

# Context words, for and against.
PHONE_WORDS = "tel|phone|telephone|mobile|fax|call|telefon|teléfono|téléphone"
IBAN_WORDS = "iban|account|konto|compte|cuenta"
SECRET_WORDS = "token|secret|password|passwd|pwd|api.?key|access.?key|private.?key|auth|authorization|bearer|credential|credentials"
SSN_WORDS = "ssn|social|security|taxpayer"
EXAMPLE_WORDS = "example|sample|dummy|beispiel|muster|ejemplo|exemple"
DIGEST_WORDS = "sha1|sha256|md5|commit|checksum|digest|hash|etag|uuid|revision"
NUMBER_WORDS = "order|invoice|isbn|serial|article|part|version|bestellung|pedido|commande"

#: Code points before a span in which context words count.
CONTEXT = 40
GAIN = LOSS = 0.3
LEAST_SCORE = 0.6

BASE = ["email", "ip", "card", "phone"]
#: Lengths that one step of a running sum adds up.
RUN = 256


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """The checksum of payment cards, over a string of digits."""
    each = F.transform(
        F.split(F.reverse(number), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def is_ip(match: Column) -> Column:
    """Four numbers of at most 255 each, leading zeros allowed."""
    return F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"))


def is_card(match: Column) -> Column:
    number = digits(match)
    return F.when(F.length(number).between(12, 19), luhn(number)).otherwise(False)


def is_phone(match: Column) -> Column:
    return F.length(digits(match)).between(9, 15)


def mod_97(match: Column) -> Column:
    """The checksum of IBANs: country and check digits move to the end, letters count from 10."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    moved = F.split(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4))), "")
    rest = F.aggregate(
        moved, F.lit(0),
        lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )
    return F.length(plain).between(15, 34) & (rest == 1)


def running_sums(lengths: str) -> tuple[Column, Callable[[Column], Column]]:
    """An array of the sums before each run of RUN lengths, and a function from position to the sum before it."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    runs = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / RUN).cast("int"))
    of_runs = F.transform(runs, lambda r: total(F.slice(lengths, r * RUN + 1, F.lit(RUN))))
    within = lambda i: total(F.slice(lengths, F.floor(i / RUN).cast("int") * RUN + 1, i % RUN))
    return of_runs, within


def located(df: DataFrame, kind: str, pattern: str, hint: Column) -> DataFrame:
    """``df`` with array ``_<kind>`` of struct(start, end, match) of the expression's matches.

    ``hint`` is a cheap test that every text with a match passes.
    """
    found = F.when(hint, F.regexp_extract_all("text", F.lit(pattern), 0))
    one = df.withColumn("_m", found)
    gaps = F.when(F.size("_m") > 0, F.split("text", pattern, -1))
    # Gap and match lengths in turn; the last gap is not needed.
    both = F.zip_with(F.transform(F.slice(gaps, F.lit(1), F.size("_m")), F.length), F.transform("_m", F.length), lambda g, m: F.array(g, m))
    two = one.withColumn("_n", F.when(F.size("_m") > 0, F.flatten(both)))
    of_runs, within = running_sums("_n")
    three = two.withColumn("_r", F.when(F.size("_m") > 0, of_runs))
    four = three.withColumn("_p", F.transform("_r", lambda _, i: F.aggregate(F.slice("_r", F.lit(1), i), F.lit(0), lambda a, x: a + x)))

    def span(match: Column, i: Column) -> Column:
        at = 2 * i + 1
        start = F.get("_p", F.floor(at / RUN).cast("int")) + within(at)
        return F.struct(start.alias("start"), (start + F.length(match)).alias("end"), match.alias("match"))

    spans = F.when(F.size("_m") > 0, F.transform("_m", span))
    return four.withColumn(f"_{kind}", F.coalesce(spans, F.array().cast("array<struct<start:int,end:int,match:string>>"))).drop("_m", "_n", "_r", "_p")


def of_kind(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def before(span: Column) -> Column:
    """What stands before a span in its line, ``CONTEXT`` code points at most."""
    near = F.substr("text", F.greatest(span["start"] + 1 - CONTEXT, F.lit(1)), F.least(span["start"], F.lit(CONTEXT)))
    return F.element_at(F.split(near, "\n"), -1)


def says(context: Column, words: str) -> Column:
    return context.rlike(f"(?i)(?<![A-Za-z])(?:{words})(?![A-Za-z])")


def entropy(match: Column) -> Column:
    """Bits a character of a string over ``SECRET_LETTERS``, from the frequencies of its own characters.

    Each letter is counted in one pass, so a string of any length takes time in proportion to it and no array of its characters.
    """
    n = F.length(match)
    letters = F.array(*(F.lit(c) for c in SECRET_LETTERS))
    share = F.transform(letters, lambda c: (n - F.length(F.replace(match, c, F.lit("")))) / n)
    return F.aggregate(share, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def is_secret(match: Column) -> Column:
    """Letters and several digits, as mixed as random hex digits are."""
    sized = (F.length(match) >= 20) & match.rlike("[A-Za-z]") & match.rlike("(?:[0-9][^0-9]*){3}")
    return F.when(sized, entropy(match) >= 3.0).otherwise(False)


def is_ssn(match: Column) -> Column:
    """Of a range that is issued."""
    return ~match.rlike("^(?:000|666|9..)|-00-|-0000$")


def is_local_phone(match: Column) -> Column:
    return F.length(digits(match)).between(7, 15)


@dataclass(frozen=True)
class Kind:
    """What proposes a kind of span, a test every text with one passes, its validator, score and context words."""

    pattern: str
    hint: Callable[[Column], Column]
    test: Callable[[Column], Column]
    score: float
    words: str
    against: str


KINDS = {
    "email": Kind(EMAIL, lambda t: F.contains(t, F.lit("@")), lambda m: F.lit(True), 0.9, "mail|email|e-mail|contact", EXAMPLE_WORDS),
    "ip": Kind(IP, lambda t: t.rlike(r"[0-9]\.[0-9]"), is_ip, 0.6, "ip|host|address|server|client", NUMBER_WORDS),
    "card": Kind(CARD, lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), is_card, 0.7, "card|visa|credit|karte|tarjeta|carte", NUMBER_WORDS),
    "phone": Kind(PHONE, lambda t: t.rlike(r"\+[0-9]"), is_phone, 0.7, PHONE_WORDS, NUMBER_WORDS),
    "key": Kind(KEY, lambda t: t.rlike("A[KS]IA|gh[oprsu]_|xox[abprs]-|sk_live_|AIza|eyJ|-----BEGIN"), lambda m: F.lit(True), 0.8, SECRET_WORDS, EXAMPLE_WORDS),
    "iban": Kind(IBAN, lambda t: t.rlike("[A-Z]{2}[0-9]{2}\\x20?[A-Z0-9]{4}"), mod_97, 0.7, IBAN_WORDS, EXAMPLE_WORDS),
    "secret": Kind(SECRET, lambda t: t.rlike("[A-Za-z0-9+/_-]{20}"), is_secret, 0.4, SECRET_WORDS, DIGEST_WORDS),
    "ssn": Kind(SSN, lambda t: t.rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}"), is_ssn, 0.4, SSN_WORDS, NUMBER_WORDS),
    "phone_local": Kind(LOCAL_PHONE, lambda t: says(t, PHONE_WORDS), is_local_phone, 0.4, PHONE_WORDS, NUMBER_WORDS),
}
ADDED = [k for k in KINDS if k not in BASE]


def score(span: Column, kind: Kind) -> Column:
    context = before(span)
    return F.round(F.lit(kind.score) + F.when(says(context, kind.words), GAIN).otherwise(0.0) - F.when(says(context, kind.against), LOSS).otherwise(0.0), 2)


def named(spans: Column, name: str) -> Column:
    """The spans that pass the kind's validator, with place (order of kinds), kind and score."""
    kind, place = KINDS[name], list(KINDS).index(name)
    good = F.filter(spans, lambda s: kind.test(s["match"]))
    return F.transform(
        good, lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("place"), F.lit(name).alias("kind"), s["end"].alias("end"), s["match"].alias("match"), score(s, kind).alias("score"))
    )


def listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base_spans`` and ``all_spans``: arrays of struct(start, place, kind, end, match, score)."""
    text = F.col("text")
    keep = [c for c in docs.columns if c.lower() not in ("base_spans", "all_spans")]
    # The row's own columns stay together, apart from the working columns.
    df = docs.select(F.struct(*keep).alias("_row"), F.coalesce("text", F.lit("")).alias("text"))
    for name in BASE:
        df = located(df, name, KINDS[name].pattern, KINDS[name].hint(text))
        df = df.withColumn(f"_{name}", named(F.col(f"_{name}"), name))
    df = df.withColumn("base_spans", F.array_sort(F.concat(*(f"_{k}" for k in BASE)))).drop(*(f"_{k}" for k in BASE))
    df = df.withColumn("_all", F.col("base_spans"))
    for name in ADDED:
        df = located(df, name, KINDS[name].pattern, KINDS[name].hint(text))
        free = lambda s: ~F.exists("_all", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        good = F.filter(named(F.col(f"_{name}"), name), lambda s: (s["score"] >= LEAST_SCORE) & free(s))
        df = df.withColumn("_all", F.concat("_all", good)).drop(f"_{name}")
    df = df.withColumn("all_spans", F.array_sort("_all"))
    own = [F.col("text") if c.lower() == "text" else F.col("_row").getField(c).alias(c) for c in keep]
    return df.select(*own, "base_spans", "all_spans")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: the personal data in every text of ``documents``."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    per_kind = [F.size(of_kind("base_spans", k)).cast("long").alias(f"n_{k}") for k in BASE]
    added = [F.size(of_kind("all_spans", k)).cast("long").alias(f"n_{k}") for k in ADDED]
    scores = F.transform("all_spans", lambda s: s["score"]).alias("scores")
    return found.select(
        "doc_id", *per_kind, F.sha2(listed("base_spans"), 256).alias("base_sha256"), listed("all_spans").alias("spans"),
        scores, F.size("all_spans").cast("long").alias("n_spans"), *added,
    )
