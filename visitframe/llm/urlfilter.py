"""URL filter: pattern rules found through their rarest literal token.

A rule has a regular expression over ``host + path + rest`` and literal tokens
(runs of ASCII letters and digits) that every URL it matches must hold whole.
The index keys a rule by the one of its tokens that fewest URLs of the corpus
hold. A URL's tokens fetch the candidate rules, and only their expressions run.
A rule without a token of its own is a candidate for every URL.

All on the JVM. Token counts are summed map-side over rule tokens only. The
index has one row per rule; whether it is broadcast is left to the planner,
which knows its size. Each URL keeps its own row number, so a host with a third
of all rows is never a grouping key.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULE = "rule string, pattern string, verdict string, tokens array<string>, listed boolean"
NO_TOKEN = ""
#: A site list: (verdict, host, path).
SITES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: The method's own patterns, for URLs that no listed site covers: (name, verdict, expression).
PATTERNS = (
    ("ad_server", "block", r"^[^/]*\.adserver\."),
    ("ad_path", "block", r"/(?:[^?#]*/)?adserver/"),
    ("login", "block", r"/wp-login\.php"),
    ("session", "block", r"[?&]session_id="),
    ("cart", "block", r"/checkout/cart/"),
    ("tracker", "block", r"/pixel/track\.gif"),
    ("adult", "block", r"[/.-]xxx[/.-]"),
    ("print_view", "block", r"[?&]view=print(?:$|[&#])"),
)


def site_rule(verdict: str, host: str, path: str) -> tuple:
    """A rule for a host with all its subdomains, and paths that begin with ``path``."""
    literal = host.lower() + path
    # The last run of an open-ended path may be a part of a longer token.
    tokens = [m.group() for m in re.finditer(r"[A-Za-z0-9]+", literal) if m.end() < len(literal)]
    return literal, rf"^(?:[^/]*\.)?{_quoted(host.lower())}{_quoted(path)}", verdict, tokens, True


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/])", r"\\\1", text)


def literal_tokens(pattern: str) -> list[str]:
    """Whole tokens that every match of ``pattern`` holds; errs towards fewer.

    Groups, classes and quantified characters may match anything, so a run of
    letters next to one of them is no whole token.
    """
    if "|" in re.sub(r"\([^()]*\)", "", pattern):
        return []
    wild = "\x00"
    flat = re.sub(r"\\[A-Za-z0-9]", wild, pattern)
    flat = re.sub(r"\\(.)", lambda m: "\x01" if m.group(1) in r"()[]{}?*+|" else m.group(1) if m.group(1) != "." else "\x01", flat)
    while (shorter := re.sub(r"\([^()]*\)[?*+]*|\[[^\]]*\][?*+]*", wild, flat)) != flat:
        flat = shorter
    flat = re.sub(r".(?:[?*]|\{[^}]*\})[?+]*", wild, flat).replace(".", wild).replace("+", wild)
    flat = flat.replace("^", "\x01").replace("$", "\x01")
    return [m.group(1) for m in re.finditer(r"(?<![A-Za-z0-9\x00])([A-Za-z0-9]+)(?![A-Za-z0-9\x00])", flat) if m.start() and m.end() < len(flat)]


def rules_table(spark: SparkSession, sites: Iterable[tuple] = SITES, patterns: Iterable[tuple] = PATTERNS) -> DataFrame:
    """The rules as a table; a longer list may as well be read from a file with these columns."""
    rows = [site_rule(*s) for s in sites] + [(n, p, v, literal_tokens(p), False) for n, v, p in patterns]
    structs = [
        F.struct(
            F.lit(name).alias("rule"), F.lit(pattern).alias("pattern"), F.lit(verdict).alias("verdict"),
            F.array(*[F.lit(t) for t in tokens]).cast("array<string>").alias("tokens"), F.lit(listed).alias("listed"),
        )
        for name, pattern, verdict, tokens, listed in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z in lower case), path, and the rest from ``?`` or ``#`` on; empty without ``://``."""
    safe = F.coalesce(url, F.lit(""))
    after = F.when(F.instr(safe, "://") > 0, F.regexp_replace(safe, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    rest = F.regexp_extract(after, r"(?s)^[^?#]*(.*)$", 1)
    return lowered, path, rest


def rarest_tokens(rules: DataFrame, rows: DataFrame) -> DataFrame:
    """The rules with ``_token``: the one that fewest URLs hold, ties in the alphabet's order."""
    wanted = rules.select("rule", "pattern", F.explode_outer("tokens").alias("_token"))
    held = rows.select(F.explode("_tokens").alias("_token"))
    counts = held.join(wanted.select("_token").distinct(), "_token", "left_semi").groupBy("_token").agg(F.count("*").alias("_n"))
    ranked = wanted.join(counts, "_token", "left")
    order = F.struct(F.coalesce("_n", F.lit(0)), "_token")
    best = ranked.groupBy("rule", "pattern").agg(F.min_by(F.coalesce("_token", F.lit(NO_TOKEN)), order).alias("_token"))
    return rules.drop("tokens").join(best, ["rule", "pattern"])


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict, pattern_rule) for each row of ``pages``.

    Of the listed sites that fit, the longest decides and is told in ``rule``.
    Without one, the longest of the method's fitting patterns decides and is
    told in ``pattern_rule``; without that the verdict is ``default``. A NULL
    url, or one without ``://``, has an empty host and path and the default
    verdict. Repeated rows and NULL ids all stay; other columns are not looked
    at, so their names may be anything.
    """
    host, path, rest = url_parts(F.col(url_col))
    rows = pages.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"), rest.alias("_rest"))
    rows = rows.withColumn("_target", F.concat("host", "path", "_rest")).drop("_rest")
    rows = rows.withColumn("_tokens", F.array_distinct(F.split("_target", "[^A-Za-z0-9]+")))
    index = rarest_tokens(rules, rows)
    always = F.array_union("_tokens", F.array(F.lit(NO_TOKEN)))
    fetched = rows.select("_row", "_id", "host", "path", "_target", F.explode(always).alias("_token")).join(index, "_token", "left")
    fits = F.when(
        F.col("pattern").isNotNull() & F.expr("_target rlike pattern"),
        F.struct("listed", F.length("rule").alias("_length"), "rule", "verdict"),
    )
    best = fetched.groupBy("_row").agg(
        F.first("_id").alias(id_col), F.first("host").alias("host"), F.first("path").alias("path"), F.max(fits).alias("_best")
    )
    listed = F.col("_best.listed")
    return best.select(
        id_col, "host", "path",
        F.when(listed, F.col("_best.rule")).alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
        F.when(~listed, F.col("_best.rule")).alias("pattern_rule"),
    )
