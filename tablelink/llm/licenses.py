"""License scans: ordered signature rules over the words of a text.

A rule is a regular expression over the text's words (lower-cased A-Z, one space
between words), a keyword and a part of a word without which it cannot match, a label
and a priority. Only texts that hold such a part are put into words, and only rules
whose keyword stands in the text are run. Of the places found, one that
lies inside another goes, and of two that overlap the one of the stronger rule stays.
Every rule is an expression of its own, so its pattern is compiled once per task. All of
it is Spark expressions on one row, so nothing is shuffled.

The rules are the hand-written signatures of `license_rules` (texts, identifiers,
addresses, denials) and the wordings in which the name of a license is usually given.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelink.llm.license_rules import ADDRESSES, BODIES, DENIALS, IDENTIFIERS
from tablelink.llm.shared import lowered

_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Put around matches; both are signs that words do not hold.
_OPEN, _CLOSE = "\x01", "\x02"

# Fixed phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Label, keyword and name of each license, as its words read after normalising. The
# keyword stands in every match of the name.
FAMILIES = (
    ("mit", "mit licen", r"mit licen[cs]e"),
    ("mit", "expat licen", r"expat licen[cs]e"),
    ("apache", "apache", r"apache(?: software)? licen[cs]e"),
    ("gpl", "general public", r"(?:gnu )?general public licen[cs]e"),
    ("gpl", "gpl", r"(?:gnu )?gpl(?: ?v?[123](?: 0)?)?"),
    ("lgpl", "lesser general", r"(?:gnu )?lesser general public licen[cs]e"),
    ("lgpl", "library general", r"(?:gnu )?library general public licen[cs]e"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl(?: ?v?[23](?: [01])?)?"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e"),
    ("agpl", "agpl", r"(?:gnu )?agpl(?: ?v?3(?: 0)?)?"),
    ("bsd", "bsd", r"(?:(?:[234]|two|three|four) clause )?bsd(?: [234] clause)? licen[cs]e"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e"),
    ("mpl", "mpl", r"mpl(?: ?v?[12](?: [01])?)?"),
    ("epl", "eclipse", r"eclipse public licen[cs]e"),
    ("cddl", "cddl", r"cddl"),
    ("cddl", "common development", r"common development and distribution licen[cs]e"),
    ("eupl", "european union", r"european union public licen[cs]e"),
    ("isc", "isc licen", r"isc licen[cs]e"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e"),
    ("boost", "boost", r"boost software licen[cs]e"),
    ("artistic", "artistic", r"artistic licen[cs]e"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("ofl", "open font", r"sil open font licen[cs]e"),
    ("cc0", "cc0", r"cc0(?: 1 0(?: universal)?)?"),
    ("cc-by-nc", "cc by nc", r"cc by nc"),
    ("cc-by-sa", "cc by sa", r"cc by sa"),
    ("cc-by-nd", "cc by nd", r"cc by nd"),
    ("cc-by", "cc by", r"cc by"),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial"),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike"),
    ("cc-by-nd", "creative commons", r"creative commons attribution no ?deriv(?:ative)?s"),
    ("cc-by", "creative commons", r"creative commons attribution"),
    ("public-domain", "public domain", r"public domain"),
)

# Priority (smaller is stronger), score and wording around the name.
WORDINGS = (
    (2, 0.95, r"(?:re)?licen[cs]ed under (?:the |a )?(?:terms of the )?{name}{version}"),
    (2, 0.95, r"(?:released|published|distributed|provided) under (?:the )?(?:terms of the )?{name}{version}"),
    (3, 0.9, r"under the (?:terms|conditions)(?: and conditions)? of (?:the )?{name}{version}"),
    (3, 0.9, r"(?:subject to|governed by|covered by) (?:the )?{name}{version}"),
    (5, 0.8, r"(?:see|read) (?:the )?{name}{version}(?: for (?:more )?details)?"),
    (5, 0.8, r"(?:copy|text) of the {name}{version}"),
    (6, 0.7, r"{name},? version [0-9]+(?: [0-9]+)?(?: or (?:any )?later)?"),
    (7, 0.6, r"{name} (?:agreement|notice|file|text|terms)"),
    (9, 0.4, r"{name}"),
)
_VERSION = r"(?: version)?(?: v?[0-9]+(?: [0-9]+)*)?(?: or (?:any )?later(?: version)?)?"


# Licenses that works are given up to.
_GIVEN_UP = (4, 0.85, r"(?:dedicated|placed|committed) (?:in)?to the {name}")
_UP_TO = ("public-domain", "cc0")


@dataclass(frozen=True)
class Rule:
    """`gate` is a part of a word that stands in every match, a whole word if it has two
    letters. A place whose `label` is None gives no license; without a gate a rule only
    runs on texts that other rules open."""

    label: str | None
    keyword: str
    pattern: str
    priority: int
    score: float
    gate: str | None


# Parts of words that open a text, the preferred ones first.
_GATES = (
    "licen", "spdx", "copyright", "gpl", "redistribut", "commons", "domain", "software", "proprietary",
    "misrepresented", "altered", "endorse", "consortium", "freedom", "brackets", "verbatim", "remix",
    "unauthori", "mpl", "acceptance", "perl", "ruby", "fuck", "beer", "materials",
)


def _gate(pattern: str) -> str:
    """A part of a word that stands in every match: of those outside of groups, the
    first of _GATES, else the longest."""
    group = re.compile(r"\(\?:[^()]*\)(?:\?|\{[^}]*\}\??)?|\[[^\]]*\]\+?")
    before = None
    while before != pattern:
        before, pattern = pattern, group.sub(" ", pattern)
    words = re.sub(r"[a-z]\?", " ", pattern).split()
    return next((gate for gate in _GATES if any(gate in word for word in words)), max(words, key=len))


def signature_rules() -> tuple[Rule, ...]:
    """All rules, strongest first."""
    rules = [Rule(None, keyword, pattern, 0, 0.0, None) for keyword, pattern in DENIALS]
    rules += [Rule(label, key, pattern, at, score, _gate(pattern)) for label, at, score, key, pattern in BODIES]
    rules += [
        Rule(label, "identifier", f"spdx licen[cs]e identifier (?:{words})", 1, 1.0, "spdx")
        for label, words in IDENTIFIERS
    ]
    rules += [Rule(label, key, pattern, 3, 0.9, _gate(pattern)) for label, key, pattern in ADDRESSES]
    for label, keyword, name in FAMILIES:
        wordings = (*WORDINGS, _GIVEN_UP) if label in _UP_TO else WORDINGS
        rules += [
            Rule(label, keyword, wording.format(name=f"(?:{name})", version=_VERSION), priority, score, _gate(name))
            for priority, score, wording in wordings
        ]
    return tuple(sorted(rules, key=lambda rule: rule.priority))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _marked(words: Column, pattern: str) -> Column:
    """The words with signs around every match."""
    return F.regexp_replace(words, F.lit(_bounded(pattern)), F.lit(f"{_OPEN}$0{_CLOSE}"))


def _places(marked: Column) -> Column:
    """Structs (first, last) of word numbers, one per match in marked words."""
    pieces = F.split(marked, _OPEN, -1)
    step = F.transform(
        F.slice(pieces, F.lit(2), F.size(pieces)),
        lambda piece: F.struct(
            _spaces(piece).alias("all"),
            _spaces(F.substring_index(piece, _CLOSE, 1)).alias("inner"),
        ),
    )
    start = F.struct(
        (_spaces(F.get(pieces, F.lit(0))) - 1).alias("at"),
        _none("array<struct<first:int,last:int>>").alias("out"),
    )

    def add(state: Column, match: Column) -> Column:
        place = F.struct(state["at"].alias("first"), (state["at"] + match["inner"]).alias("last"))
        return F.struct(
            (state["at"] + match["all"]).alias("at"),
            F.concat(state["out"], F.array(place)).alias("out"),
        )

    return F.aggregate(step, start, add, lambda state: state["out"])


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def _bounded(pattern: str) -> str:
    return f"(?<= )(?:{pattern})(?= )"


def _labelled(places: Column, label: str) -> Column:
    return F.transform(
        places, lambda p: F.struct(p["first"], p["last"], F.lit(label).alias("label"))
    )


def _kept(found: Column) -> Column:
    """Of the sorted places, those no other one contains or outranks.

    Places come by first word, longest first, strongest first. One that ends no
    later than the last kept one lies inside it. One that begins before the last
    kept one ends replaces it if its rule is stronger, and goes otherwise.
    """
    empty = F.filter(found, lambda _: F.lit(False))

    def add(kept: Column, place: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        return (
            F.when((F.size(kept) == 0) | (place["first"] > last["last"]), F.concat(kept, F.array(place)))
            .when(place["last"] <= last["last"], kept)
            .when(
                place["priority"] < last["priority"],
                F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(place)),
            )
            .otherwise(kept)
        )

    return F.aggregate(found, empty, add)


def scan_licenses(
    docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] | None = None
) -> DataFrame:
    """Add `license_scan`: n_words, base and found places.

    A struct of
      n_words  words of the text; 0 for null and texts without words
      base     places of the fixed phrases of BASE, all of them: first, last, label
      found    places the rules found, resolved: first, last, label, priority, score,
               by first word; a null label marks a place that denies a license
    Words are counted from 0. Repeated rows, null ids and further columns pass
    through; columns named license_scan, _license_plain, _license_split or _license_words
    are replaced or dropped.
    """
    rules = signature_rules() if rules is None else rules
    split = F.col("_license_split")
    place = "array<struct<first:int,last:int,label:string>>"
    detection = "array<struct<first:int,back:int,priority:int,last:int,label:string,score:double>>"
    spaced = F.col("_license_words")
    base = F.concat(
        *(
            _labelled(
                F.when(F.contains(spaced, F.lit(phrase)), _places(_marked(spaced, phrase))).otherwise(
                    _none("array<struct<first:int,last:int>>")
                ),
                label,
            )
            for phrase, label in BASE
        )
    ).cast(place)
    # What the places of a rule carry: one constant, which Spark folds while it plans.
    table = F.from_json(
        F.lit(json.dumps([{"label": r.label, "priority": r.priority, "score": r.score} for r in rules])),
        "array<struct<label:string,priority:int,score:double>>",
    )
    of_keyword: dict[str, list[int]] = {}
    for at, rule in enumerate(rules):
        of_keyword.setdefault(rule.keyword, []).append(at)
    matched = F.filter(
        F.flatten(
            F.array(
                *(
                    F.when(
                        F.contains(spaced, F.lit(keyword)),
                        F.array(
                            *(
                                F.struct(F.lit(at).alias("rule"), _marked(spaced, rules[at].pattern).alias("marked"))
                                for at in chosen
                            )
                        ),
                    ).otherwise(_none("array<struct<rule:int,marked:string>>"))
                    for keyword, chosen in of_keyword.items()
                ),
                _none("array<struct<rule:int,marked:string>>"),
            )
        ),
        lambda one: F.contains(one["marked"], F.lit(_OPEN)),
    )

    def detections(one: Column) -> Column:
        rule = F.get(table, one["rule"])
        return F.transform(
            _places(one["marked"]),
            lambda p: F.struct(
                p["first"].alias("first"),
                (-p["last"]).alias("back"),
                rule["priority"].alias("priority"),
                p["last"].alias("last"),
                rule["label"].alias("label"),
                rule["score"].alias("score"),
            ),
        )

    found = F.flatten(F.transform(matched, detections)).cast(detection)
    # A text is only normalised if the gate of some rule or phrase stands in it.
    plain = F.col("_license_plain")

    def opened(token: str) -> Column:
        there = F.contains(plain, F.lit(token))
        return there if len(token) > 2 else there & F.regexp_like(plain, F.lit(f"(?:^|{_NO_WORD}){token}(?:{_NO_WORD}|$)"))

    gate = reduce(Column.__or__, (opened(token) for token in sorted({"licen"} | {r.gate for r in rules if r.gate})))
    scan = F.struct(
        F.when(F.length(split) > 0, _spaces(split) + 1).otherwise(0).cast("long").alias("n_words"),
        F.coalesce(F.when(spaced.isNotNull(), base), _none(place)).alias("base"),
        F.coalesce(F.when(spaced.isNotNull(), _kept(F.sort_array(found))), _none(detection)).alias("found"),
    )
    return (
        docs.withColumn("_license_plain", F.lower(F.col(text)))
        .withColumn("_license_split", F.trim(F.regexp_replace(F.col(text), _BETWEEN, " ")))
        .withColumn("_license_words", F.when(gate, F.concat(F.lit(" "), lowered(split), F.lit(" "))))
        .withColumn("license_scan", scan)
        .drop("_license_plain", "_license_split", "_license_words")
    )
