"""URL filters: pattern rules found by their rarest literal token.

Every rule names literal tokens that stand, as whole tokens, in any URL it matches.
A rule is filed under the token that is rarest in the URLs at hand. The tokens of a
URL fetch its candidate rules, and only their regular expressions are run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Tuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class PlaceRule:
    """Allow or block a host with its subdomains, below a path."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> tuple[str, str]:
        """For the whole host, and for the start of the path."""
        return rf"(?:.*\.)?{re.escape(self.host)}", re.escape(self.path)

    @property
    def tokens(self) -> tuple[str, ...]:
        path = self.path.lower()
        whole = path if path.endswith("/") else path[: path.rfind("/") + 1]
        return tuple(_TOKEN.findall(self.host)) + tuple(_TOKEN.findall(whole))


@dataclass(frozen=True)
class PatternRule:
    """Block what a regular expression finds in the host and path, lower-cased."""

    name: str
    pattern: str
    tokens: tuple[str, ...]


# Fixed values of the place rules.
PLACE_RULES = (
    PlaceRule("allow", "com", "/"),
    PlaceRule("block", "example.com", "/en/"),
    PlaceRule("allow", "www.example.com", "/en/"),
    PlaceRule("block", "net", "/es/"),
    PlaceRule("block", "net", "/fr/"),
)

_TERMS = {
    "gambling": ("casino", "poker", "bets", "betting", "slots", "jackpot", "roulette", "bingo"),
    "pills": ("pills", "viagra", "cialis", "pharma"),
    "adult": ("xxx", "porn", "adult", "escort", "sex"),
    "tracking": ("adserver", "doubleclick", "tracker", "clickbait"),
}
_PAIRS = {
    "lending": ("payday", "loans"),
    "copies": ("cracked", "software"),
    "watches": ("replica", "watches"),
    "prizes": ("free", "prizes"),
}


def pattern_rules() -> tuple[PatternRule, ...]:
    """A term between separators of the host or path; two terms in one host label or
    path part, joined by a dash."""
    single = (
        PatternRule(f"{kind}:{term}", rf"(^|[^a-z0-9]){term}([^a-z0-9]|$)", (term,))
        for kind, terms in _TERMS.items()
        for term in terms
    )
    double = (
        PatternRule(f"{kind}:{a}-{b}", rf"(^|[^a-z0-9]){a}-([a-z0-9]+-)?{b}([^a-z0-9]|$)", (a, b))
        for kind, (a, b) in _PAIRS.items()
    )
    return tuple(single) + tuple(double)


def host_of(url: Column) -> Column:
    """Between the first :// and the next of / ? # or the end, A-Z lower-cased; empty
    for null or no ://."""
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(
        F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")
    )


def path_of(url: Column) -> Column:
    """Between the host and the next of ? # or the end; empty like the host."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def token_counts(urls: DataFrame, host: str, path: str, tokens: set[str]) -> dict[str, int]:
    """In how many URLs each of the given tokens stands; one number per token."""
    lower = F.lower(F.concat_ws(" ", host, path))
    found = F.explode(F.array_distinct(F.split(lower, "[^a-z0-9]+")))
    counts = (
        urls.select(found.alias("token"))
        .where(F.col("token").isin(sorted(tokens)))
        .groupBy("token")
        .agg(F.count("*").alias("n"))
    )
    return {row["token"]: row["n"] for row in counts.collect()}


def filed_by_rarest(rules, counts: dict[str, int]) -> dict[str, list]:
    """Token -> rules filed under it."""
    filed: dict[str, list] = {}
    for rule in rules:
        filed.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(rule)
    return filed


def judge_urls(
    urls: DataFrame,
    url: str = "url",
    place_rules: tuple[PlaceRule, ...] = PLACE_RULES,
    patterns: tuple[PatternRule, ...] | None = None,
) -> DataFrame:
    """Add host, path, rule, verdict and found to every row.

    rule     name of the longest place rule that fits; null if none does
    verdict  that rule's action; without one, block if a pattern rule fits, else allow
    found    name of the first pattern rule that fits, by order; null if none does
    A null URL or one without :// has an empty host and path, and no rule fits it.
    Columns of these names are replaced, others pass through; repeated rows stay.
    """
    patterns = pattern_rules() if patterns is None else patterns
    parts = urls.drop("host", "path", "rule", "verdict", "found").withColumns(
        {"host": host_of(F.col(url)), "path": path_of(F.col(url))}
    )
    rules = (*place_rules, *patterns)
    counts = token_counts(parts, "host", "path", {t for rule in rules for t in rule.tokens})
    filed = filed_by_rarest(rules, counts)
    order = {rule.name: at for at, rule in enumerate(patterns)}
    places = {r.name: [re.compile(p, re.DOTALL) for p in r.pattern] for r in place_rules}
    texts = {r.name: re.compile(r.pattern) for r in patterns}

    def judged(host: str, path: str) -> tuple[str | None, str, str | None]:
        lower = f"{host} {path.lower()}"
        candidates = [rule for token in set(_TOKEN.findall(lower)) for rule in filed.get(token, ())]
        place, found = None, None
        for rule in candidates:
            if isinstance(rule, PlaceRule):
                of_host, of_path = places[rule.name]
                longer = place is None or len(rule.name) > len(place.name)
                if longer and of_host.fullmatch(host) and of_path.match(path):
                    place = rule
            elif (found is None or order[rule.name] < order[found]) and texts[rule.name].search(lower):
                found = rule.name
        if place:
            return place.name, place.action, found
        return None, "block" if found else "allow", found

    def judge(batches: Iterator[Tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in batches:
            rows = [judged(host, path) for host, path in zip(hosts, paths)]
            yield pd.DataFrame(rows, columns=["rule", "verdict", "found"], dtype=object)

    udf = F.pandas_udf(judge, "rule string, verdict string, found string")
    return parts.withColumn("_judged", udf("host", "path")).select(
        *parts.columns, "_judged.rule", "_judged.verdict", "_judged.found"
    )
