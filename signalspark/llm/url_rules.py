"""URL filters: rules indexed by their rarest literal token, with DataFrame functions only.

Two kinds of rules: prefixes of host and path, of which the longest wins, and
patterns, which judge a URL that no prefix fits.  Each rule is filed under the
one of its literal tokens that is rarest in all URLs; a URL's tokens fetch
candidate rules, and only those run their regular expression.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = "[a-z0-9]+"
#: Rules up to this number (some 20 MB) are broadcast; more are joined by shuffles.
BROADCAST_RULES = 100_000


@dataclass(frozen=True)
class Prefix:
    """A host (subdomains included) and the start of a path, like ``example.net/en/``."""

    rule: str
    verdict: str

    @property
    def regex(self) -> str:
        host, slash, path = self.rule.partition("/")
        return rf"^(?:[^/]*\.)?{escape(host)}{escape(slash + path)}" if slash else rf"^(?:[^/]*\.)?{escape(host)}(?:/|$)"

    @property
    def tokens(self) -> list[str]:
        # a token at the end of a path may go on in the URL
        whole = self.rule if "/" in self.rule else self.rule + "/"
        return [m[0].lower() for m in re.finditer("[A-Za-z0-9]+", whole) if m.end() < len(whole)]


@dataclass(frozen=True)
class Pattern:
    """``||`` a host or parent domain begins here, ``^`` a separator or the end, ``*`` anything; in lower case."""

    rule: str
    verdict: str

    @property
    def regex(self) -> str:
        text, out = self.rule, ""
        if text.startswith("||"):
            text, out = text[2:], r"^[a-z0-9+.-]*://(?:[^/?#]*\.)?"
        for c in text:
            out += "(?:[^a-z0-9_.%-]|$)" if c == "^" else "(?s:.*)" if c == "*" else escape(c)
        return out

    @property
    def tokens(self) -> list[str]:
        body = self.rule[2:] if self.rule.startswith("||") else self.rule
        anchored = body is not self.rule
        bounded = lambda i, edge: edge if not 0 <= i < len(body) else body[i] != "*"
        return [m[0] for m in re.finditer(TOKEN, body) if bounded(m.start() - 1, anchored) and bounded(m.end(), False)]


def escape(text: str) -> str:
    """Quote what regular expressions of Java and of RE2 take as special."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


#: Patterns for URLs that no prefix rule fits.
PATTERNS = (
    Pattern("||spam-farm.", "block"),
    Pattern("^spam^", "block"),
    Pattern("^casino^", "block"),
    Pattern("^adserver^", "block"),
    Pattern("/ads/", "block"),
)


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty if there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge(
    pages: DataFrame,
    rules: Sequence[Prefix],
    patterns: Sequence[Pattern] = PATTERNS,
    url: str = "url",
    keep: Sequence[str] | None = None,
    default: str = "allow",
    broadcast_rules: int = BROADCAST_RULES,
) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (the longest prefix rule that fits, or null) and ``verdict``.

    The verdict is the rule's; else ``block`` if a blocking pattern matches the
    URL in lower case, ``allow`` if only allowing ones do; else ``default``.  Of equally long
    rules the first in the alphabet wins.  A null URL, or one without ``://``,
    has empty host and path and gets the default unless a pattern matches it.
    One row per row, repeated rows included; an empty table stays empty;
    columns of these names are replaced.

    Equal URLs are judged once: they combine before the shuffle, so a URL on a
    third of all rows is one candidate.
    """
    spark = pages.sparkSession
    keep = [c for c in (pages.columns if keep is None else keep) if c not in ("host", "path", "rule", "verdict")]
    rows = [(i, r.rule, isinstance(r, Prefix), r.verdict, r.regex, r.tokens or [""]) for i, r in enumerate([*rules, *patterns])]
    filed = spark.createDataFrame(rows, "no int, rule string, prefix boolean, verdict string, regex string, tokens array<string>")
    source = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{url}`").alias("_url"))
    urls = source.filter("_url is not null").groupBy("_url").agg(F.count(F.lit(1)).alias("_n"))
    small = F.translate("_url", UPPER, LOWER)
    tokens = F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(small, F.lit(f"({TOKEN})"), 1)))
    parts = urls.select("_url", "_n", F.explode(tokens).alias("token"))
    hint = F.broadcast if len(rows) <= broadcast_rules else lambda df: df
    # the rarest token of each rule, counted over all rows
    literal = filed.select("no", F.explode("tokens").alias("token")).distinct()
    counts = parts.join(hint(literal.select("token").distinct()), "token").groupBy("token").agg(F.sum("_n").alias("n"))
    rarest = literal.join(counts, "token", "left").groupBy("no").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "token")).alias("r"))
    index = filed.drop("tokens").join(rarest.select("no", "r.token"), "no")
    found = parts.join(hint(index), "token")
    site = F.concat(host(F.col("_url")), path(F.col("_url")))
    found = found.withColumn("text", F.when(F.col("prefix"), site).otherwise(small)).filter("text rlike regex")
    order = F.struct(-F.length("rule"), "rule", "verdict")
    best = found.groupBy("_url").agg(
        F.min(F.when(F.col("prefix"), order)).alias("best"),
        F.max(F.when(~F.col("prefix"), F.col("verdict") == "block")).alias("blocked"),
    )
    judged = source.join(best, "_url", "left")
    by_pattern = F.when(F.col("blocked"), "block").when(~F.col("blocked"), "allow").otherwise(default)
    return judged.select(
        *[F.col(f"`{c}`") for c in keep],
        host(F.col("_url")).alias("host"),
        path(F.col("_url")).alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), by_pattern).alias("verdict"),
    )
