from __future__ import annotations

import re

import pytest

from tablelink.llm import licenses as l

CASES = {
    "Licensed under the Apache License, Version 2.0.": {"apache"},
    "Released under the MIT License.": {"mit"},
    "This work is licensed under the GNU General Public License, version 3.": {"gpl"},
    "Licensed under CC BY-NC 4.0.": {"cc-by-nc"},
    "SPDX-License-Identifier: AGPL-3.0": {"agpl"},
    "GNU Lesser General Public License v2.1": {"lgpl"},
    "see the BSD 3-Clause Licence for details": {"bsd"},
    "dedicated to the public domain": {"public-domain"},
    "Creative Commons Attribution-ShareAlike": {"cc-by-sa"},
    "MIT License and Apache License": {"mit", "apache"},
    "permit license": set(),
    "mit licenses": set(),
    "no license at all": set(),
}


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, rules):
    """n_words, places of the base phrases, and the places that are left of the rules'."""
    words = words_of(text)
    base = [
        (k, k + len(p.split()) - 1, label)
        for p, label in l.BASE
        for k in range(len(words))
        if words[k : k + len(p.split())] == p.split()
    ]
    spaced = f" {' '.join(words)} "
    found = []
    for rule in rules:
        if rule.keyword in spaced:
            for match in re.finditer(rf"(?<= )(?:{rule.pattern})(?= )", spaced):
                first = spaced[: match.start()].count(" ") - 1
                last = first + match[0].count(" ")
                found.append((first, -last, rule.priority, last, rule.label, rule.score))
    kept = []
    for place in sorted(found):
        if not kept or place[0] > kept[-1][3]:
            kept.append(place)
        elif place[3] > kept[-1][3] and place[2] < kept[-1][2]:
            kept[-1] = place
    return len(words), sorted(base), [(p[0], p[3], p[4]) for p in kept]


def scanned(df):
    out = []
    for r in l.scan_licenses(df).collect():
        s = r["license_scan"]
        out.append(
            (r["doc_id"], s["n_words"], sorted((b["first"], b["last"], b["label"]) for b in s["base"]),
             [(f["first"], f["last"], f["label"]) for f in s["found"]])
        )
    return sorted(out, key=repr)


def test_cases(documents):
    rows = [(k, text) for k, text in enumerate(CASES)]
    got = scanned(documents(rows))
    assert {k: {label for *_, label in found} for k, _, _, found in got} == dict(enumerate(CASES.values()))


def test_against_brute_force(documents):
    rules = l.signature_rules()
    texts = list(CASES)
    rows = [(k, f"É {a} filler {b}\n{a.upper()}") for k, (a, b) in enumerate(zip(texts, texts[1:] + texts[:1]))]
    rows += [
        (None, "mit license"), (50, None), (51, ""), (52, "mit license"), (52, "mit license"), (53, " .. "),
        (54, "word " * 30_000 + "under the terms of the apache license version 2"), (55, "mit license " * 500),
    ]
    assert scanned(documents(rows)) == sorted(((i, *brute(t, rules)) for i, t in rows), key=repr)


def test_hundreds_of_rules_in_order():
    rules = l.signature_rules()
    assert len(rules) > 300 and [r.priority for r in rules] == sorted(r.priority for r in rules)


@pytest.mark.parametrize("label, keyword, name", l.FAMILIES, ids=lambda f: f[:14])
def test_keywords_stand_in_names(label, keyword, name):
    plain = re.sub(r"\(\?:[^()]*(?:\([^()]*\)[^()]*)*\)\??", "", name.replace("licen[cs]e", "license"))
    assert re.sub(" +", " ", plain).replace(" ?", "").find(keyword.split(" ")[-1]) >= 0


def test_empty_table(documents):
    assert scanned(documents([])) == []


TEXTS = {
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software": {"mit"},
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: Neither the name of the copyright holder nor the names of its contributors may be "
    "used to endorse or promote products derived from this software": {"bsd"},
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.": {"isc"},
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted. THE SOFTWARE IS PROVIDED \"AS IS\"": {"0bsd"},
    "you may not use this file except in compliance with the License. http://www.apache.org/licenses/LICENSE-2.0": {"apache"},
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
    "License as published by the Free Software Foundation": {"gpl"},
    "SPDX-License-Identifier: MIT": {"mit"},
    "SPDX-License-Identifier: CC-BY-SA-4.0": {"cc-by-sa"},
    "https://creativecommons.org/licenses/by-nc/4.0/": {"cc-by-nc"},
    "this notice may not be removed or altered from any source distribution": {"zlib"},
    "This code is not licensed under the GPL.": {None},
    "It is no longer released under the terms of the Mozilla Public License, really": {None},
    "rather than the Apache License it has the ISC license": {None, "isc"},
    "account of a success by others": set(),
}


def test_license_texts(documents):
    got = scanned(documents(list(enumerate(TEXTS))))
    assert {k: {label for *_, label in found} for k, _, _, found in got} == dict(enumerate(TEXTS.values()))


def test_license_texts_against_brute_force(documents):
    rules = l.signature_rules()
    texts = list(TEXTS) + list(CASES)
    rows = [(k, f"{a} and {b} {a}".upper() if k % 2 else f"{b}\n{a}") for k, (a, b) in enumerate(zip(texts, texts[3:] + texts[:3]))]
    assert scanned(documents(rows)) == sorted(((i, *brute(t, rules)) for i, t in rows), key=repr)


def needed_words(pattern):
    """Runs of characters outside of choices, for every match of the pattern has them."""
    pattern = pattern.replace("licen[cs]e", "license").replace("unauthori[sz]ed", "unauthorised")
    runs, depth, run = [], 0, ""
    for part in re.findall(r"\(\?:|\)\??(?:\{[^}]*\}\??)?|\[[^]]*\]\+?|[^\[\]]\?|[^\[\]]", pattern):
        if part == "(?:" or part[0] == ")" or len(part) > 1 and part[-1] in "?]+":
            runs.append(run if not depth else "")
            run = ""
            depth += (part == "(?:") - (part[0] == ")")
        elif not depth:
            run += part
    return [*runs, run]


def test_gates_and_keywords_stand_in_every_match():
    names = {keyword: needed_words(name) for _, keyword, name in l.FAMILIES}
    for rule in l.signature_rules():
        runs = needed_words(rule.pattern)
        assert any(rule.keyword in run for run in (*runs, *names.get(rule.keyword, ()))), rule
        assert rule.gate is None or any(rule.gate in run for run in (*runs, *names.get(rule.keyword, ()))), rule


def test_denials_give_no_label(documents):
    df = documents([(0, "This is not licensed under the GPL."), (1, "This is licensed under the GPL.")])
    found = {r["doc_id"]: [f["label"] for f in r["license_scan"]["found"]] for r in l.scan_licenses(df).collect()}
    assert found == {0: [None], 1: ["gpl"]}
