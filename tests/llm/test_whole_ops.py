"""Whole jobs: what once was cut off."""

import textwrap

import numpy as np

from scriptorium.llm import licences, secrets

SCHEMA = "doc_id long, text string, source string"

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""


def wrapped(text, width=72, sign="", end="\n"):
    lines = [x for p in text.split("\n\n") for x in [*textwrap.wrap(p, width), ""]]
    return end.join((sign + x).rstrip() for x in lines)


def test_wrapped_licences(spark):
    ruled = "Released under the MIT License".replace(" ", " " + "-" * 200 + " ")
    gpl = ". ".join(licences.SENTENCES[f"gpl.{k}"] for k in ("redistribute", "hope", "details")) + "."
    texts = [
        wrapped(MIT), wrapped(APACHE), wrapped(APACHE, 60, "# "), wrapped(MIT, 50, " * "), wrapped(MIT, 78, "", "\r\n"), wrapped(gpl, 70, "// "), ruled, MIT,
        "All rights\n\nreserved", "prose without an end\nReleased under the MIT License\nmore prose", "Not released under the MIT License", wrapped(licences.SENTENCES["bsd.redistribution"] + ":\n\n1. x"),
    ]
    got = {r.doc_id: r for r in licences.licences(spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], SCHEMA)).collect()}
    assert [got[i].licences for i in range(len(texts))] == [["MIT"], ["Apache-2.0"], ["Apache-2.0"], ["MIT"], ["MIT"], ["GPL-3.0-or-later"], ["MIT"], ["MIT"], [], ["MIT"], [], ["BSD"]]
    assert got[2].sentence_ids == ["apache2.notice.you", "apache2.copy", "apache2.asis", "apache2.see"] and got[0].sentence_ids == ["mit.grant", "mit.condition"]
    assert all(not got[i].unclaimed for i in got)


def test_short_digit_free_and_punctuated_secrets(spark):
    said = ['password = "hunter2abc"', "pwd=Tr0ub4dor&3", 'secret: "correcthorsebatterystaple"', 'DB_PASSWORD="P@ss!w$rd.x:y"', "Authorization: Bearer abc.dEf", '{"password": "one two!three", "n": 1}']
    values = ["hunter2abc", "Tr0ub4dor&3", "correcthorsebatterystaple", "P@ss!w$rd.x:y", "abc.dEf", "one two!three"]
    harmless = ["password: required", "Author: Jane Smith wrote", "token = ${API_TOKEN}", "password=None", "the secret: we met at noon", "see session: 12", "-" * 40, "Donaudampfschifffahrtsgesellschaft"]
    rows = [(i, "so " + t + " it", "") for i, t in enumerate(said + harmless)] + [(90, None, None), (91, "", None), (92, "password=", None), (93, 'token: "', None)]
    forest = secrets.default_forest()
    clean = {r.doc_id: r.text for r in secrets.redact(spark.createDataFrame(rows, SCHEMA), forest).collect()}
    for i, v in enumerate(values):
        assert clean[i] == rows[i][1].replace(v, "[REDACTED]")
    assert all(clean[i] == t for i, t, _ in rows[len(values) :])


def test_no_labelled_secret_is_left_out():
    forest = secrets.default_forest()
    assert not np.isnan(forest.value).any()
    held_out = [f for f in secrets.labelled_findings(1000, seed=5) if f[4]]
    assert len(held_out) == 500 and sum(f[2] - f[1] < secrets.MIN_LENGTH for f in held_out) > 100
    found = secrets.judged([f[0] for f in held_out], [f[3] for f in held_out], forest)
    assert np.mean([any(a <= f[1] and b >= f[2] and s >= secrets.CUT for a, b, s in own) for f, own in zip(held_out, found, strict=True)]) > 0.95


def test_overlapping_secrets_are_one():
    forest = secrets.default_forest()
    text = 'password = "abcDEF1234567890abcd!x$Q"'
    (got,) = [[x for x in own if x[2] >= secrets.CUT] for own in secrets.judged([text], [""], forest)]
    assert [text[a:b] for a, b, _ in got] == ["abcDEF1234567890abcd!x$Q"]
