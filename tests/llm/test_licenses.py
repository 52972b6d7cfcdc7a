import random
import re

from storefront.llm.license_rules import LICENSE_RULES, read_rules
from storefront.llm.licenses import BASE_PHRASES, CONFIDENCE, scan_licenses
from storefront.llm.queries import op13_license_rules

FOLDER = "/root/testdata/sf0.001"
GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
    "option) any later version."
)
MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction"
)
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met: 1. Redistributions of source code must retain the above notice. "
    "Neither the name of the Widget Works nor the names of its contributors may be used to endorse products"
)
TEXTS = [
    None,
    "",
    " \n.;!",
    "plain words and nothing else",
    "Licensed under CC BY-NC 4.0.",
    "This work is licensed under the GNU General Public License, version 3.",
    "Released under the MIT License. Also: mit  LICENSE, Mit-License; submit license, mit licenses",
    "Licensed under the Apache License, Version 2.0.\nApache\nLicense",
    "cc by cc by cc\tby, CC BY-SA 3.0 and cc, by; ccby cc bye éCC BY cc byé",
    "SPDX-License-Identifier: GPL-2.0-or-later\n// SPDX-License-Identifier: Apache-2.0",
    GPL,
    MIT,
    BSD,
    "Copyright (c) 2020 Widget Works. All rights reserved. Unauthorized copying is strictly prohibited.",
    "See https://www.apache.org/licenses/LICENSE-2.0 and https://creativecommons.org/licenses/by-nc-sa/4.0/",
    "two-clause BSD, BSD 3-Clause License, the zlib license and the Mozilla Public License v2.0",
    "MİT LICENSE, mit lıcense, K and ſ",
    "Licence publique générale GNU; licencia pública general de GNU; MIT Lizenz",
    "word " * 30000 + "mit license",
    "mit license " * 400,
    "\U0001f600 mit license \U0001f600 apache license",
]


def plain_scan(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    normal = f" {' '.join(words)} "
    base = []
    for phrase, label in BASE_PHRASES.items():
        size = len(phrase.split())
        base += [(i, label) for i in range(len(words)) if words[i : i + size] == phrase.split()]
    found = []
    for rule in LICENSE_RULES:
        for m in re.finditer(f" (?:{rule.expression})(?= )", normal):
            found.append((m.start(), m.end(), rule.rank, rule.number, rule.label))
    kept = []
    for n, (beg, end, rank, number, label) in enumerate(found):
        held = any(
            b <= beg and e >= end and r <= rank and ((b, e) != (beg, end) or (r, other) < (rank, number))
            for b, e, r, other, _ in found
        )
        if not held:
            kept.append((beg, end, rank, number, label))
    labels = {label for _, label in base}
    return (
        len(words),
        len(base),
        min(base)[0] if base else None,
        max(base)[0] if base else None,
        ",".join(sorted(labels)),
        ",".join(sorted(labels | {k[4] for k in kept})),
        CONFIDENCE[min(k[2] for k in kept)] if kept else 0.0,
        len(found),
        sorted(kept),
    )


def test_hundreds_of_rules_in_order():
    assert len(LICENSE_RULES) > 300 and list(LICENSE_RULES) == read_rules()
    assert [r.number for r in LICENSE_RULES] == list(range(len(LICENSE_RULES)))
    assert {r.rank for r in LICENSE_RULES} == set(range(len(CONFIDENCE)))


def sample(parts, rng):
    """A text that an expression matches, chosen at random."""
    out = ""
    for op, value in parts:
        op = str(op)
        if op == "LITERAL":
            out += chr(value)
        elif op == "IN":
            out += {"LITERAL": lambda v: chr(v), "CATEGORY": lambda v: "7"}[str(value[0][0])](value[0][1])
        elif op == "NOT_LITERAL":
            out += "x"
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            out += "".join(sample(value[2], rng) for _ in range(rng.randint(value[0], min(value[1], value[0] + 2))))
        elif op == "SUBPATTERN":
            out += sample(value[3], rng)
        elif op == "BRANCH":
            out += sample(rng.choice(value[1]), rng)
        else:
            assert op == "ASSERT_NOT"
    return out


def test_keywords_stand_in_all_a_rule_matches():
    rng = random.Random(4)
    for rule in LICENSE_RULES:
        for _ in range(20):
            text = sample(re._parser.parse(rule.expression), rng)
            assert re.fullmatch(rule.expression, text) and f" {text} ".count(rule.keyword), (rule, text)


def test_against_plain_version(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in scan_licenses(rows).collect()}
    assert len(got) == len(TEXTS)
    for n, text in enumerate(TEXTS):
        row = got[n]
        mine = (
            row["n_words"],
            row["n_base"],
            row["first_word"],
            row["last_word"],
            ",".join(row["base_labels"]),
            ",".join(row["labels"]),
            row["score"],
            row["n_found"],
            sorted((d["beg"], d["end"], d["rank"], d["rule"], d["label"]) for d in row["detections"]),
        )
        assert mine == plain_scan(text), text and text[:80]


def test_what_is_found(spark):
    texts = [GPL, MIT, BSD, TEXTS[4], TEXTS[9], TEXTS[13]]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: set(r["labels"]) for r in scan_licenses(rows).collect()}
    assert got[0] >= {"gpl", "gpl-3.0-or-later"} and "lgpl" not in got[0]
    assert got[1] == {"mit"} and "bsd-3-clause" in got[2]
    assert got[3] == {"cc-by", "cc-by-nc-4.0"}
    assert got[4] == {"apache-2.0", "gpl-2.0-or-later"}
    assert "proprietary" in got[5]


def test_query_on_its_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = op13_license_rules(spark, FOLDER).collect()
    assert len(rows) == len(texts)
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_found"]
    for row in rows:
        assert tuple(row[n] for n in names) == plain_scan(texts[row["doc_id"]])[:8]


def test_native_and_odd_tables(spark, odd_docs, no_docs):
    plan = scan_licenses(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan.split("InMemoryRelation")[0]
    rows = scan_licenses(odd_docs)
    assert rows.count() == odd_docs.count() and rows.where("doc_id IS NULL").count() == 1
    assert scan_licenses(no_docs).count() == 0
