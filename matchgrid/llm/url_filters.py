r"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a pattern over host and path, a table of them has the columns (rule,
verdict, is_host). In a pattern ``*`` stands for any characters and ``^`` for one
that is neither letter nor digit, or for an end of the URL; ``|`` first or last
anchors it there, ``||`` first anchors it at the host's start or after a dot in the
host. Everything else is literal. A host rule like ``example.org/es/`` is the
pattern ``||example.org/es/``: it fits its host and all subdomains if the URL's path starts
with the rule's.

From each pattern follow its expression and its literal tokens: the runs of letters
and digits with a literal, ``^`` or an anchor on both sides, which every URL that it
fits must hold as a whole token. The corpus tells how often each token occurs;
every rule is filed under its rarest one. A URL's tokens fetch the rules filed
under them, and only those run their expressions. Rules without such a token are
always run, on all distinct URLs. All of it is DataFrame operations: distinct URLs
are joined with the index, so hot hosts are counted and judged once, and Spark
chooses by size whether the index is broadcast.

Of several host rules that fit the longest wins (of equally long ones the one that
sorts last; of equal ones with both verdicts, block). Pattern rules judge what no
host rule fits: a URL is blocked if a blocking pattern fits it, else allowed.

A null URL, or one without ``://``, has an empty host and path; no host rule fits
it and it is allowed unless an always-run pattern says otherwise. Very long URLs are
read whole. Repeated URLs and page ids each keep their row; extra columns are not
read, whatever their names. An empty table gives an empty result; without rules
everything is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
#: Patterns that judge the rest: kinds of junk hosts and pages.
PATTERN_RULES = [(p, "block") for p in ("^casino^", "^pills^", "^spam^", "^ads^", "^adserver^", "^poker^", "^viagra^", "/wp-login.php|", "/xmlrpc.php|")]
#: Parts that rules without a token are dealt to.
SALTS = 16


def rules_table(spark: SparkSession, host_rules: list[tuple[str, str]], pattern_rules: list[tuple[str, str]]) -> DataFrame:
    """(rule, verdict, is_host) of short lists of rules; longer ones are read from a table."""
    rows = [(r, v, True) for r, v in host_rules] + [(r, v, False) for r, v in pattern_rules]
    cells = [F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict"), F.lit(h).alias("is_host")) for r, v, h in rows]
    none = F.array().cast("array<struct<rule:string,verdict:string,is_host:boolean>>")
    return spark.range(1).select(F.inline(F.array(*cells) if cells else none))


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def expression_of(pattern: Column) -> Column:
    """The regular expression of a pattern."""
    body = F.regexp_replace(pattern, r"^\|\|?|\|$", "")
    # Stars at an end without an anchor say nothing, as the search begins anywhere.
    body = F.when(F.startswith(pattern, F.lit("|")), body).otherwise(F.regexp_replace(body, r"^\*+", ""))
    body = F.regexp_replace(F.regexp_replace(body, r"[^A-Za-z0-9*^]", r"\\$0"), r"\*+", "*")
    body = F.replace(F.replace(body, F.lit("*"), F.lit(".*")), F.lit("^"), F.lit(r"(?:[^A-Za-z0-9]|^|\z)"))
    start = F.when(F.startswith(pattern, F.lit("||")), r"^(?:[^/]*\.)?").when(F.startswith(pattern, F.lit("|")), "^").otherwise("")
    return F.concat(F.lit("(?s)"), start, body, F.when(F.endswith(pattern, F.lit("|")), r"\z").otherwise(""))


def needs_of(pattern: Column) -> Column:
    """The tokens that every URL which the pattern fits must hold."""
    return F.array_distinct(F.regexp_extract_all(lowered(pattern), F.lit(r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])"), 0))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(lowered(host), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_tokens(urls: DataFrame) -> DataFrame:
    """(url, place, token): host + path, each of its distinct tokens, and the part of the always-run rules."""
    place = F.concat(host_of(F.col("url")), path_of(F.col("url")))
    always = F.concat(F.lit(" "), F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("string"))
    tokens = F.array_append(F.filter(F.array_distinct(F.split(lowered(F.col("place")), "[^a-z0-9]+")), lambda t: t != ""), always)
    return urls.select("url", place.alias("place")).select("url", "place", F.explode(tokens).alias("token"))


def filed(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """The rules' index: rule columns by the rarest of each rule's tokens, or by every part of the URLs if it has none."""
    pattern = F.when(F.col("is_host"), F.concat(F.lit("||"), F.col("rule"))).otherwise(F.col("rule"))
    each = rules.select("rule", F.col("verdict").alias("rule_verdict"), "is_host", pattern.alias("pattern")).distinct()
    each = each.select("rule", "rule_verdict", "is_host", expression_of(F.col("pattern")).alias("expression"), needs_of(F.col("pattern")).alias("needs"))
    key = ["rule", "rule_verdict", "is_host", "expression"]
    needs = each.select(*key, F.explode("needs").alias("token"))
    seen = tokens.join(needs.select("token").distinct(), "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = needs.join(seen, "token", "left").groupBy(*key).agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "token")).alias("r")).select(*key, F.col("r.token").alias("token"))
    parts = F.transform(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.concat(F.lit(" "), i.cast("string")))
    return rarest.unionByName(each.filter(F.size("needs") == 0).select(*key, F.explode(parts).alias("token")))


def judged(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, url, host, path, rule, verdict) of every page by ``rules`` (rule, verdict, is_host)."""
    rows = pages.select("page_id", "url")
    tokens = with_tokens(rows.select("url").distinct())
    fits = tokens.join(filed(tokens, rules), "token").filter("place rlike expression")
    hosts = F.when(F.col("is_host"), F.struct(F.length("rule").alias("size"), F.col("rule").alias("name"), "rule_verdict"))
    found = fits.groupBy(F.col("url").alias("judged_url")).agg(F.max(hosts).alias("host_rule"), F.max(F.when(~F.col("is_host"), F.col("rule_verdict"))).alias("by_pattern"))
    return rows.join(found, F.col("url").eqNullSafe(F.col("judged_url")), "left").select(
        "page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        F.col("host_rule.name").alias("rule"), F.coalesce("host_rule.rule_verdict", "by_pattern", F.lit("allow")).alias("verdict"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op7: the verdict on every url of ``pages``."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judged(pages, rules_table(spark, HOST_RULES, PATTERN_RULES)).drop("url")


def _oracle() -> str:
    def fits(rule: str) -> str:
        host, _, path = rule.partition("/")
        return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}'))"

    longest = sorted(HOST_RULES, key=lambda r: -len(r[0]))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r}'" for r, _ in longest)
    verdict = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in longest)
    words = [p.strip("^") for p, _ in PATTERN_RULES if p[0] == "^"]
    ends = [p.strip("|") for p, _ in PATTERN_RULES if p[0] == "/"]
    patterns = " OR ".join([f"regexp_matches(host || path, '(^|[^A-Za-z0-9]){w}([^A-Za-z0-9]|$)', 's')" for w in words] + [f"ends_with(host || path, '{e}')" for e in ends])
    return rf"""
    WITH parts AS (
      SELECT page_id,
             translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
      FROM pages),
    ruled AS (SELECT *, CASE {rule} END AS rule FROM parts)
    SELECT page_id, host, path, rule,
           CASE {verdict} WHEN {patterns} THEN 'block' ELSE 'allow' END AS verdict FROM ruled
    """


ORACLE = _oracle()
