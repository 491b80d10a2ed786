import random
import re
from re import _parser as sre_parser

from memlake.llm.licenses import GATES, rules, scan

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def brute(text):
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        found = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), sorted(labels)


def test_base_equals_brute_force(spark):
    rng = random.Random(1)
    parts = ["MIT", "mit", "License", "license", "LICENSE,", "apache", "Apache-", "general", "public", "éa", "x\ny", "2.0", "...", "mit-license", "licenses", "K"]
    texts = [None, "", "   ", "license", "mit license", "MIT_License" + " x" * 20000 + " the Apache License", "a" * 50000]
    texts += [rng.choice([" ", "\n", "_"]).join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(0, None, 1)], "doc_id long, text string, n_words int")
    rows = scan(df).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(r["text"]), repr(r["text"])[:90]
    assert scan(df.limit(0)).count() == 0


def labels(spark, texts):
    rows = scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    return [sorted({d["label"] for d in r["detections"]}) for r in sorted(rows)]


def test_signatures_priority_and_containment(spark):
    got = labels(spark, [
        "Licensed under the Apache License, Version 2.0.", "GNU Affero General Public License v3", "the GNU Lesser General Public License, version 2.1", "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: BSD-3-Clause", "Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "Mozilla Public License 2.0 and the ISC license", "nothing here", "All rights reserved.", "a driving licence test",
    ])
    assert got == [["apache"], ["agpl"], ["lgpl"], ["gpl"], ["bsd-3"], ["cc-by-nc"], ["mit"], ["isc", "mpl"], [], ["all-rights-reserved"], []]


def test_hundreds_of_rules():
    assert len(rules()) > 250 and len({r[0] for r in rules()}) == len(rules())
    for _, _, gate, before, after in rules():
        re.compile(before), re.compile(after)
        assert gate


def sample(rng, node):
    """A random text that a regex matches."""
    out = ""
    for op, arg in node:
        kind = str(op)
        if kind == "LITERAL":
            out += chr(arg)
        elif kind == "NOT_LITERAL":
            out += "q"
        elif kind == "BRANCH":
            out += sample(rng, rng.choice(arg[1]))
        elif kind == "SUBPATTERN":
            out += sample(rng, arg[-1])
        elif kind == "MAX_REPEAT":
            out += "".join(sample(rng, arg[2]) for _ in range(rng.randint(arg[0], min(int(arg[1]), arg[0] + 3))))
        elif kind == "IN":
            some = rng.choice(arg)
            out += chr(some[1]) if str(some[0]) == "LITERAL" else chr(rng.randint(*some[1]))
    return out


def brute_detections(text):
    """Every rule against all words before and after every gate word, the longest match of each; then suppression
    among all detections of the text."""
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = set()
    for i, g in enumerate(w):
        if g not in GATES:
            continue
        for priority, label, gates, left, right in rules():
            if g not in gates.split("|"):
                continue
            before = [k for k in range(min(i, 40), -1, -1) if re.fullmatch(left, "".join(x + " " for x in w[i - k : i]))]
            after = [k for k in range(min(len(w) - i - 1, 40), -1, -1) if re.fullmatch(right, "".join(" " + x for x in w[i + 1 : i + 1 + k]))]
            if before and after:
                found.add((i - before[0], i + after[0], label, priority))
    beaten = lambda d, e: e[3] < d[3] and e[0] <= d[1] and e[1] >= d[0]
    within = lambda d, e: e[0] <= d[0] and e[1] >= d[1] and e[1] - e[0] > d[1] - d[0] and e[3] <= d[3]
    return sorted(d for d in found if not any(beaten(d, e) or within(d, e) for e in found))


def test_detections_equal_brute_force(spark):
    rng = random.Random(2)
    every, texts = rules(), []
    for n in range(len(every) + 150):
        parts = []
        for k in range(1 if n < len(every) else rng.randint(2, 6)):
            _, _, gate, left, right = every[n] if n < len(every) else rng.choice(every)
            said = sample(rng, sre_parser.parse(left)) + rng.choice(gate.split("|")) + sample(rng, sre_parser.parse(right))
            words = said.split(" ")
            if n >= len(every) and rng.random() < 0.3:
                words.insert(rng.randrange(len(words)), rng.choice(["the", "license", "public", "2", "x"]))
            parts += words + rng.choice([[], [], ["other", "words"], ["license"], ["or", "later"]])
        texts.append(rng.choice([" ", "-", ", "]).join(rng.choice([x, x.upper()]) for x in parts))
    rows = scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    for r in rows:
        assert [tuple(d) for d in r["detections"]] == brute_detections(r["text"]), r["text"]
    assert all(r["detections"] for r in rows if r["doc_id"] < len(every))


def test_long_titles_and_versions(spark):
    got = scan(spark.createDataFrame([(1, "the creative commons attribution non commercial no derivatives works 4.0 license"), (2, "under the lesser general public license version 2.1 only"), (3, "mit license " * 3000)], "doc_id int, text string")).collect()
    found = {r["doc_id"]: [(d["first_word"], d["last_word"], d["label"]) for d in r["detections"]] for r in got}
    assert found[1] == [(0, 11, "cc-by-nc-nd")] and found[2][0][1] == 8 and len(found[3]) == 3000


def test_prose_is_left_alone(spark):
    prose = [
        "released by MIT", "The study was released by Elastic last week.", "distributed with Python", "distributed by Apache helicopters", "available under curl", "in terms of the json format",
        "a non commercial license", "a noncommercial licence", "available under Python 3", "Tickets are available with EPL clubs", "distributed with PHP 3.0", "terms of the Ruby community", "under the terms of the open data policy",
        "available under artistic direction", "released with boost 1.0", "licensed by the city", "licensed with Perl modules", "the terms of the bsd camp", "released under ISC supervision", "available by llama",
    ]
    assert labels(spark, prose) == [[]] * len(prose)
    said = [
        "released under Apache 2.0", "licensed under MIT", "available under the GPL", "released under the Python license", "distributed with the curl license", "terms of the JSON license", "available under EPL 2.0", "a commercial license",
        "available under CC BY-SA 4.0", "under the terms of the 3-clause BSD", "subject to the terms and conditions of the GNU Lesser General Public License 2.1", "an MIT-style license",
    ]
    assert labels(spark, said) == [["apache"], ["mit"], ["gpl"], ["python"], ["curl"], ["json"], ["epl"], ["proprietary"], ["cc-by-sa"], ["bsd-3"], ["lgpl"], ["mit"]]
