"""Language ID, personal data, decontamination and license scan against plain Python, with the cases their docstrings define."""

import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import pytest

from tracelake.llm import decontaminate, language, licenses, pii, url_filter

DOC = "doc_id bigint, text string, lang string"


def naive_bayes(train, text):
    """Character n-grams hashed as the operator hashes them, counted one by one."""
    bucket = lambda t: [int(b) for _, bs in language.grams([t]) for b in bs]
    counts, docs = {}, Counter()
    for t, lang in train:
        counts.setdefault(lang, Counter()).update(bucket(t))
        docs[lang] += 1
    best = {}
    for lang, own in counts.items():
        total = sum(own.values()) + 0.5 * language.BUCKETS
        best[lang] = math.log((docs[lang] + 1) / (sum(docs.values()) + len(docs))) + sum(math.log((own[b] + 0.5) / total) for b in bucket(text))
    top = max(best, key=lambda k: (best[k], -ord(k[0])))
    return top, 1 / sum(math.exp(v - best[top]) for v in best.values())


def test_language_equals_naive_bayes(spark):
    train = [("the cat and the dog", "en"), ("der Hund und die Katze", "de"), ("le chien et le chat", "fr"), ("the end of the day", "en"), ("das Ende des Tages", "de")]
    ask = ["the day", "die Tage", "le chat", "x", "THE HUND", "cat " * 3]
    docs = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(train)], DOC)
    model = language.fit(docs)
    got = {r.text: r for r in language.predict(spark.createDataFrame([(i, t, None) for i, t in enumerate(ask)], DOC), model).collect()}
    for t in ask:
        want, score = naive_bayes(train, t)
        assert (got[t].lang_pred, round(got[t].score, 6)) == (want, round(score, 6)), t


def test_language_defined_cases(spark):
    docs = spark.createDataFrame([(1, "hello there", "en"), (1, "hello there", "en"), (2, None, "en"), (None, "bonjour", "fr"), (3, "12 !?", None), (4, "", "fr"), (5, "bonjour " * 30_000, "fr")], DOC)
    model = language.fit(docs)
    assert model.languages == ("en", "fr")
    rows = [(r.doc_id, r.lang_pred, r.score) for r in language.predict(docs, model).collect()]
    assert {r for r in rows if r[0] in (2, 3, 4)} == {(2, "und", 0.0), (3, "und", 0.0), (4, "und", 0.0)}
    assert [r[1] for r in rows if r[0] == 1] == ["en", "en"] and [r[1] for r in rows if r[0] in (None, 5)] == ["fr", "fr"]
    empty = language.fit(docs.limit(0))
    assert {r.lang_pred for r in language.predict(docs, empty).collect()} == {"und"}
    assert language.predict(docs.limit(0), model).count() == 0
    clash = docs.selectExpr("*", "1 AS lang_pred", "'x' AS score", "2 AS owner")
    assert set(language.predict(clash, model).columns) == {"doc_id", "text", "lang", "owner", "lang_pred", "score"}


def test_held_out_fold(spark):
    got = {r.doc_id: r.h for r in spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id bigint").select("doc_id", language.held_out().alias("h")).collect()}
    assert all(got[i] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(50)) and got[None] is False


RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                doubled = [n if i % 2 == 0 else sum(divmod(2 * n, 10)) for i, n in enumerate(digits[::-1])]
                if not 13 <= len(digits) <= 19 or sum(doubled) % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_the_rules():
    rnd = random.Random(5)
    for _ in range(20_000):
        text = "".join(rnd.choice("ab.@-+ 01249().%_é,") for _ in range(rnd.randrange(60)))
        assert sorted(pii.base_spans(text)) == sorted(plain_spans(text)), text
    known = "4111 1111 1111 1111, +1 (988) 555-2485, é a.b@c.de@f.gh 1.2.3.4.5.6.7.8"
    assert sorted(pii.base_spans(known)) == sorted(plain_spans(known)) and len(plain_spans(known)) >= 5
    assert pii.base_spans("1" * 300_000) == [] and pii.base_spans("a" * 300_000) == []


def test_looser_spans_are_learned_and_redacted(spark):
    texts = [
        "please contact email jane.roe at example dot com soon", "call phone (415) 555-0100 now", "mail a.b@c.de or 10.0.0.1", "name Mr Thomas Miller here",
        "version 415-555-0100 of the table", None, "", "nothing of note", "nothing of note",
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, found string")
    model = pii.fit(docs)
    rows = {r.doc_id: r.s for r in docs.select("doc_id", pii.spans_of(model, docs.text, spark).alias("s")).collect()}
    assert [(s.kind, s.base) for s in rows[0]] == [("email", False)] and [(s.kind, s.base) for s in rows[1]] == [("phone", False)]
    assert [(s.kind, s.base) for s in rows[2]] == [("email", True), ("ip", True)] and [s.kind for s in rows[3]] == ["person"]
    assert rows[5] == rows[6] == rows[7] == rows[8] == []
    red = {r.doc_id: r.t for r in docs.select("doc_id", pii.redacted(model, docs.text, spark).alias("t")).collect()}
    assert red[2] == "mail [EMAIL] or [IP]" and red[5] is None and red[7] == texts[7]
    assert pii.fit(docs.limit(0)).spans("mail a.b@c.de")[0][:3] == ("email", 5, 13)


def test_reliabilities_find_the_bad_labeler():
    rnd, counts = random.Random(2), Counter()
    for _ in range(4000):
        true = rnd.random() < 0.5
        counts[tuple((1 if true else -1) * (1 if rnd.random() < right else -1) for right in (0.95, 0.9, 0.5))] += 1
    right, truth = pii.reliabilities({k: float(n) for k, n in counts.items()})
    assert right[0] > 0.9 and right[1] > 0.85 and 0.4 < right[2] < 0.6 and truth[(1, 1, -1)] > 0.9 > 0.1 > truth[(-1, -1, 1)]


def changed(words, places):
    return " ".join("zz" if i in places else w for i, w in enumerate(words))


def test_decontamination_tolerates_substitutions(spark, monkeypatch):
    rnd = random.Random(1)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [[rnd.choice(vocabulary) for _ in range(n)] for n in (40, 60, 25, 7, 3)]
    bench = [(i, " ".join(w)) for i, w in enumerate(items)] + [(9, None), (10, "")]
    noise = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    docs = [
        (1, f"{noise(30)}, {bench[0][1].upper()}. {noise(5)}"), (2, noise(9) + " " + changed(items[1], {3, 11, 22, 31, 40, 52})), (3, " ".join(items[1][20:45])),
        (4, changed(items[2], set(range(0, 25, 2)))), (5, noise(80)), (6, bench[3][1] + " end"), (7, bench[4][1]), (8, None), (None, bench[0][1]), (1, "clean text"), (11, noise(2) + " " + bench[2][1]),
    ]
    frames = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS item_id", "2 AS words"), spark.createDataFrame(bench, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(*frames).collect()}
    assert got == {(1, 0), (2, 1), (3, 1), (6, 3), (None, 0), (11, 2)}
    assert {r.doc_id for r in decontaminate.clean(*frames).collect()} == {4, 5, 7, 8}
    full = sorted(map(str, decontaminate.overlaps(*frames).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", -1)
    assert sorted(map(str, decontaminate.overlaps(*frames).collect())) == full
    assert decontaminate.overlaps(frames[0].limit(0), frames[1]).count() == decontaminate.overlaps(frames[0], frames[1].limit(0)).count() == 0


def cosine_licenses(notices):
    """Best template of each notice by TF-IDF over all notices, term by term."""
    words = lambda t: [w for w in re.split(r"[^\w]+|_", t.lower()) if w]
    df = Counter(w for n in notices for w in set(words(n)))
    idf = lambda w: math.log((1 + len(notices)) / (1 + df[w])) + 1
    vector = lambda t: {w: c * idf(w) for w, c in Counter(words(t)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    out = []
    for n in notices:
        a = vector(n)
        scores = [(-round(sum(x * b.get(w, 0) for w, x in a.items()) / (norm(a) * norm(b)), 6), name) for name, t in licenses.TEMPLATES for b in (vector(t),)]
        out.append(min(scores))
    return [(name, -s) if -s >= licenses.LEAST else None for s, name in out]


def test_license_scan_and_inheritance(spark):
    notices = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0!", "license of a cat in the hat by the sea", "Licensed under CC BY-NC 4.0."]
    want = cosine_licenses(notices)
    assert want[0][0] == "MIT" and want[2] is None
    files = [
        ("a/LICENSE", notices[0]), ("a/b/c/code.py", "x = 1"), ("a/b/own.py", f"# top\n{notices[1]}\ny"), ("a/b/LICENSE.txt", notices[3]), ("d/x.py", f"z\n{notices[2]}"), ("e.py", None), (None, "text"), ("a/empty", ""), ("a/empty", ""),
    ]
    df = spark.createDataFrame(files, "path string, text string").selectExpr("*", "1 AS license", "2 AS directory")
    got = {r.path: (r.license, r.score, r.basis, r.inherited_from) for r in licenses.scan(df).collect()}
    assert len(got) == 8
    assert got["a/LICENSE"] == ("MIT", pytest.approx(want[0][1]), "notice", None) and got["a/b/own.py"] == ("Apache-2.0", pytest.approx(want[1][1]), "notice", None)
    assert got["a/b/c/code.py"] == ("CC-BY-NC-4.0", pytest.approx(want[3][1]), "inherited", "a/b") and got["a/empty"][:1] == ("MIT",) and got["a/empty"][2:] == ("inherited", "a")
    assert got["d/x.py"] == got["e.py"] == got[None] == (None, None, None, None)
    assert licenses.scan(df.limit(0)).count() == 0


MIT_TEXT = """Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY.
"""
WHOLE = {"Apache-2.0": "Apache-2.0", "MPL-2.0": "MPL-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GPL-3": "GPL-3.0", "GPL-2": "GPL-2.0", "LGPL-3": "LGPL-3.0", "LGPL-2.1": "LGPL-2.1"}


def test_whole_license_texts_and_wrapped_headers(spark):
    folder = Path("/usr/share/common-licenses")
    whole = {k: (folder / k).read_text() for k in WHOLE if (folder / k).exists()}
    files = [("MIT/LICENSE", MIT_TEXT), ("MIT/x.py", "x"), *((f"{k}/COPYING", t) for k, t in whole.items()), *((f"{k}/x.py", "x") for k in whole)]
    header = "/* Licensed under the Apache License,\n * Version 2.0 (the License); you may not use this\n * file except in compliance with the License. You may\n * obtain a copy of the License at\n */\nint x;"
    gpl = "# This program is free software; you can redistribute it\n# and/or modify it under the terms of the GNU General Public License\n# as published by the Free Software Foundation; either version {0}\n# of the License, or (at your option) any later version.\nx = 1"
    files += [("apache.c", header), ("gpl2.py", gpl.format(2)), ("gpl3.py", gpl.format(3)), ("none.py", "# a cat\n# with no licence at all\nx = 1")]
    got = {r.path: (r.license, r.basis) for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    for k, name in (WHOLE | {"MIT": "MIT"}).items():
        if k == "MIT" or k in whole:
            assert got[f"{k}/x.py"] == (name, "inherited"), k
    assert [got[f][0] for f in ("apache.c", "gpl2.py", "gpl3.py", "none.py")] == ["Apache-2.0", "GPL-2.0", "GPL-3.0", None]


def test_every_template_is_looked_at(spark):
    assert all(re.search(licenses.LOOK, t) for _, t in licenses.TEMPLATES)
    isc = dict(licenses.TEMPLATES)["ISC"]
    files = [("a.c", f"// {isc}\nint x;"), ("b.c", "// " + isc.replace("software for", "software\n// for") + "\nint x;")]
    got = {r.path: r.license for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got == {"a.c": "ISC", "b.c": "ISC"}


def test_bad_section_among_many_is_rejected(spark):
    sections = [f"s{chr(97 + i)}" for i in range(25)]
    pages = [(f"http://hot.org/{s}/{i}", s == "sc" if i < 40 else None) for s in sections for i in range(60)]
    pages += [(f"http://hot.org/few{chr(97 + i)}/1", None) for i in range(10)]
    got = url_filter.judge(spark.createDataFrame(pages, "url string, bad boolean"), rules=(), bad="bad").collect()
    assert {(r.path.split("/")[1], r.verdict) for r in got if r.path.startswith("/s")} == {(s, "block" if s == "sc" else "allow") for s in sections}
    assert {(r.template.split("/")[1], r.verdict) for r in got if r.path.startswith("/few")} == {("*", "allow")}


def test_names_next_to_punctuation():
    for text in ("(James Smith)", '"Mary Jones" said', "name:James Smith", "dear James Smith,", "x—Paul Miller"):
        assert [(s.kind, text[s.start : s.end].split()[-2]) for s in pii.candidates(text)] == [("person", re.search("James|Mary|Paul", text)[0])], text
    assert pii.candidates("nobody here") == []


def test_names_behind_capitalised_words():
    wanted = {
        "Dear James Smith": ["James Smith"], "Contact Mary Jones": ["Mary Jones"], "President John Kennedy": ["John Kennedy"], "Dr. José Müller, Frau Sabine Weiß": ["Dr. José Müller", "Frau Sabine Weiß"],
        "John James Smith": ["John James Smith"], "Paul Smith met Anna Jones": ["Paul Smith", "Anna Jones"], "Jameson Smith, xJames Smith, James smith, James": [], "James Mary": ["James Mary"],
    }
    for text, names in wanted.items():
        assert [text[s.start : s.end] for s in pii.candidates(text) if s.kind == "person"] == names, text


def test_looser_spans_keep_off_each_other_in_long_texts():
    text = "Dear James Smith, " * 20_000 + "call 212-555-0100 or write to me@x.org or me [at] x [dot] org"
    found = pii.candidates(text)
    assert Counter(s.kind for s in found) == {"person": 20_000, "phone": 1, "email": 2}
    held = sorted((s.start, s.end) for s in found)
    assert all(a[1] <= b[0] for a, b in zip(held, held[1:]))


def test_copies_of_an_item_and_windows_of_an_alignment_are_judged_once(spark, monkeypatch):
    """Each window that hit used to bring its whole document to each copy of an item: forty copies in ten documents were judged some 30,000 times instead of ten."""
    rnd = random.Random(4)
    text = " ".join(f"w{rnd.randrange(900)}" for _ in range(50))
    bench = spark.createDataFrame([(i, text) for i in range(40)] + [(None, text), (99, "one two three four five six")], "item_id bigint, text string")
    docs = spark.createDataFrame([(i, f"{i} {text} end") for i in range(10)] + [(50, "x one two three four five six")], "doc_id bigint, text string")
    kept, written = decontaminate.stage, {}

    def counted(df):
        out = kept(df)
        written[tuple(df.columns)] = out.count()
        return out

    monkeypatch.setattr(decontaminate, "stage", counted)
    want = {(d, i, 50, 50, 1) for d in range(10) for i in range(40)} | {(50, 99, 6, 6, 1)}
    for rows in (200_000, 3):  # by a broadcast, then by the bit set
        monkeypatch.setattr(decontaminate, "SEED_ROWS", rows)
        assert {tuple(r) for r in decontaminate.overlaps(docs, bench).collect()} == want
        assert written["doc_id", "of", "start"] == 11 and written["of", "item_at", "seed"] < 120


def test_the_bit_set_lets_all_seeds_through_and_few_others(spark, monkeypatch):
    """Beyond the broadcast, all windows of all documents used to be shuffled."""
    seeds = spark.range(40_000).selectExpr("xxhash64(id) AS seed")
    windows = spark.range(400_000).selectExpr("id", "xxhash64(id) AS seed")
    passed = decontaminate._likely(windows, seeds, 40_000).agg({"id": "count"}).first()[0], decontaminate._likely(windows, seeds, 40_000).where("id < 40000").count()
    assert passed[1] == 40_000 and passed[0] < 45_000
