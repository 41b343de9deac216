"""License scan: sparse TF-IDF cosine of notices to templates, then inheritance from the nearest directory above.

A notice is a line with a cue word; of a licence file (by its name) it is the whole text. Equal notices are scored once. Document frequencies
count all notices of all files. A notice has the license of the closest template at a cosine of ``LEAST`` or more,
and a file that of its best notice. Wrapped headers are notices too: in a block of lines without a blank one, each run of words
over a line's end that begins like a template and is as long. A licence file of more than ``OPENING`` words is judged by such runs only, those
that begin in its first ``OPENING`` words before the others, for a license names other ones further down. Runs are also held
against the titles and headers in ``BLOCKS``. A file without one inherits from the nearest directory, its own first, that holds a
licence file; directories are resolved among themselves before files join them.

Defined results: a null or empty text has no notice; a null path is a file without a directory, which inherits nothing; of equal
scores the license that sorts first wins, and so of several licence files in one directory; files that repeat a path are
judged as one file; an empty table gives no rows. Only the path and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import stage

LEAST = 0.55
CUE = r"(?i)licen[cs]e|copyright|redistribut|public domain|permission is hereby granted"
#: What is looked at: ``CUE``, and what it lacks for every template to match.
LOOK = rf"{CUE}|permission to use|hereby granted"
OPENING = 100
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)([._-].*)?$"

# Openings of public license notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under the Creative Commons CC0 1.0 Universal dedication"),
)
# Titles of license texts and headers of several lines, sought as runs of words.
_FREE = "is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version"
BLOCKS = (
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("MIT", "MIT License Copyright"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-1.0", "GNU General Public License Version 1, February 1989"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-2.0", "GNU Library General Public License Version 2, June 1991"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("GFDL-1.2", "GNU Free Documentation License Version 1.2, November 2002"),
    ("GFDL-1.3", "GNU Free Documentation License Version 1.3, 3 November 2008"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-1.1", "Mozilla Public License Version 1.1"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("GPL-2.0", f"This program {_FREE.format('General Public License', '2')}"),
    ("AGPL-3.0", f"This program {_FREE.format('Affero General Public License', '3')}"),
    ("LGPL-3.0", f"This library {_FREE.format('Lesser General Public License', '3')}"),
    ("LGPL-2.1", f"This library {_FREE.format('Lesser General Public License', '2.1')}"),
    ("LGPL-2.0", f"This library {_FREE.format('Library General Public License', '2')}"),
)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _vectors(rows: DataFrame, key: str, frequency: DataFrame, notices: int) -> DataFrame:
    """(key, term, weight, norm) from rows of (key, words)."""
    counts = rows.select(key, F.explode("words").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    df = F.coalesce(F.col("df"), F.lit(0))
    weighed = counts.join(frequency, "term", "left").select(key, "term", (F.col("tf") * (F.log(F.lit(1.0 + notices) / (1 + df)) + 1)).alias("weight"))
    norms = weighed.groupBy(key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return weighed.join(norms, key)


def _directory(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def _runs(files: DataFrame, named: Column, known: DataFrame, path: str, text: str) -> DataFrame:
    """(path, words, template, order) of the runs of words that begin like a template, in wrapped headers and long licence files."""
    blocks = F.filter(F.split(F.col(text), r"\n[^\p{L}\p{N}\n]*\n"), lambda x: x.rlike(LOOK) & x.contains("\n"))
    held = files.where(F.col(text).rlike(LOOK)).select(F.col(path).alias("path"), named.alias("named"), F.explode(F.when(named, F.array(text)).otherwise(blocks)).alias("block"))
    lines = F.transform(F.split("block", "\n"), lambda line, i: F.transform(_words(line), lambda w: F.struct(w.alias("word"), i.alias("line"))))
    held = held.select("path", "named", F.flatten(lines).alias("words")).where(~F.col("named") | (F.size("words") > OPENING))
    starts = known.select("template", F.get("words", F.lit(0)).alias("start"), F.size("words").alias("long"))
    runs = held.select("path", "named", "words", F.posexplode("words").alias("at", "first")).join(F.broadcast(starts), F.col("first.word") == F.col("start"))
    runs = runs.select("path", "named", "template", "at", F.slice("words", F.col("at") + 1, F.col("long")).alias("run"))
    runs = runs.where("named OR element_at(run, 1).line < element_at(run, -1).line")
    return runs.select("path", F.col("run.word").alias("words"), "template", F.when(F.col("named") & (F.col("at") >= OPENING), 1).otherwise(0).alias("order"))


def matched(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, license, score) of each file with a notice close to a template."""
    named = F.element_at(F.split(F.coalesce(F.col(path), F.lit("")), "/"), -1).rlike(LICENCE_FILE)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(LOOK))
    rows = files.where(F.col(text).rlike(LOOK)).select(F.col(path).alias("path"), named.alias("named"), F.explode(F.when(named, F.array(text)).otherwise(lines)).alias("notice"))
    identity = F.md5(F.array_join("words", " "))
    rows = stage(rows.select("path", "named", _words(F.col("notice")).alias("words")).withColumn("id", identity))
    distinct = stage(rows.groupBy("id").agg(F.first("words").alias("words"), F.count("*").alias("n")))
    notices = distinct.agg(F.sum("n")).first()[0] or 0
    frequency = distinct.select("n", F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.sum("n").alias("df"))
    spark = files.sparkSession
    known = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(TEMPLATES + BLOCKS)], "template int, license string, text string")
    known = known.select("template", "license", _words(F.col("text")).alias("words"))
    runs = stage(_runs(files, named, known, path, text).withColumn("id", identity))
    theirs = _vectors(known, "template", frequency, notices).select("template", "term", F.col("weight").alias("their_weight"), F.col("norm").alias("their_norm"))
    judged = rows.where(~F.col("named") | (F.size("words") <= OPENING)).select("path", "id", F.lit(None).cast("int").alias("wanted"), F.lit(0).alias("order"))
    judged = judged.union(runs.select("path", "id", F.col("template").alias("wanted"), "order"))
    own = _vectors(distinct.select("id", "words").union(runs.select("id", "words")).dropDuplicates(["id"]), "id", frequency, notices)
    dots = own.join(F.broadcast(theirs), "term").groupBy("id", "template", "norm", "their_norm").agg(F.sum(F.col("weight") * F.col("their_weight")).alias("dot"))
    scored = dots.join(F.broadcast(known.select("template", "license")), "template").select("id", "template", "license", F.round(F.col("dot") / (F.col("norm") * F.col("their_norm")), 6).alias("score"))
    near = stage(scored.where(F.col("score") >= LEAST))
    lowest = F.min(F.struct((-F.col("score")).alias("back"), "license")).alias("best")
    best = near.where(F.col("template") < len(TEMPLATES)).groupBy("id").agg(lowest).withColumn("wanted", F.lit(None).cast("int"))
    best = best.union(near.groupBy("id", "template").agg(lowest).select("id", "best", F.col("template").alias("wanted")))
    found = judged.join(best, (judged["id"] == best["id"]) & judged["wanted"].eqNullSafe(best["wanted"])).groupBy("path").agg(F.min(F.struct("order", "best")).alias("top"))
    return found.select("path", F.col("top.best.license").alias("license"), (-F.col("top.best.back")).alias("score"))


def scan(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """One row per path: path, license, score, basis (``notice``, ``inherited`` or null) and the directory it came from."""
    found = stage(matched(files, path, text))
    paths = files.select(F.col(path).alias("path")).distinct().withColumn("directory", _directory(F.col("path")))
    named = F.element_at(F.split("path", "/"), -1).rlike(LICENCE_FILE)
    holds = found.where(named).select(_directory(F.col("path")).alias("above"), "license", "score")
    holds = holds.groupBy("above").agg(F.min(F.struct((-F.col("score")).alias("back"), "license")).alias("held"))
    # every directory with those above it, itself the deepest
    steps = F.split("directory", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))
    tree = paths.select("directory").distinct().where("directory IS NOT NULL").select("directory", F.posexplode(above).alias("depth", "above"))
    nearest = tree.join(holds, "above").groupBy("directory").agg(F.max_by(F.struct("above", "held"), "depth").alias("from"))
    judged = paths.join(found, "path", "left").join(nearest, "directory", "left")
    own = F.col("license").isNotNull()
    return judged.select(
        "path",
        F.coalesce("license", "from.held.license").alias("license"),
        F.coalesce("score", -F.col("from.held.back")).alias("score"),
        F.when(own, "notice").when(F.col("from").isNotNull(), "inherited").alias("basis"),
        F.when(~own, F.col("from.above")).alias("inherited_from"),
    )


def oracle_sql(files_sql: str) -> str:
    """The same rows in SQL; ``files_sql`` is a query of (path, text)."""
    values = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(TEMPLATES))
    words = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    base = "list_extract(string_split(coalesce(path, ''), '/'), -1)"

    def vectors(name: str, key: str, rows: str) -> str:
        return f"""
        {name}c AS (SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest(words) AS term FROM {rows}) GROUP BY ALL),
        {name}w AS (SELECT {key}, term, tf * (ln((1.0 + (SELECT coalesce(sum(n), 0) FROM distinct_)) / (1 + coalesce(df, 0))) + 1) AS weight FROM {name}c LEFT JOIN frequency USING (term)),
        {name} AS (SELECT *, sqrt(sum(weight * weight) OVER (PARTITION BY {key})) AS norm FROM {name}w)"""

    return f"""
        WITH files AS ({files_sql}),
        raw AS (SELECT path, unnest(CASE WHEN regexp_matches({base}, '{LICENCE_FILE}') THEN [text] ELSE list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{CUE}')) END) AS notice
                FROM files WHERE regexp_matches(text, '{CUE}')),
        rows_ AS (SELECT path, words, array_to_string(words, ' ') AS id FROM (SELECT path, {words.format("notice")} AS words FROM raw)),
        distinct_ AS (SELECT id, any_value(words) AS words, count(*) AS n FROM rows_ GROUP BY id),
        frequency AS (SELECT term, sum(n) AS df FROM (SELECT n, unnest(list_distinct(words)) AS term FROM distinct_) GROUP BY term),
        known AS (SELECT template, license, {words.format("text")} AS words FROM (VALUES {values}) t(template, license, text)),
        {vectors("theirs", "template", "known")}, {vectors("own", "id", "distinct_")},
        scored AS (SELECT own.id, license, round(sum(own.weight * theirs.weight) / (any_value(own.norm) * any_value(theirs.norm)), 6) AS score
                   FROM own JOIN theirs USING (term) JOIN known USING (template) GROUP BY own.id, template, license),
        best AS (SELECT id, license, score FROM scored WHERE score >= {LEAST} QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, license) = 1),
        found AS (SELECT path, license, score FROM rows_ JOIN best USING (id) QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, license) = 1),
        paths AS (SELECT DISTINCT path, regexp_extract(path, '(?s)^(.*)/[^/]*$', 1) AS directory FROM files),
        holds AS (SELECT regexp_extract(path, '(?s)^(.*)/[^/]*$', 1) AS above, license, score FROM found WHERE regexp_matches({base}, '{LICENCE_FILE}')
                  QUALIFY row_number() OVER (PARTITION BY above ORDER BY score DESC, license) = 1),
        tree AS (SELECT directory, depth, array_to_string(list_slice(string_split(directory, '/'), 1, depth), '/') AS above
                 FROM (SELECT directory, unnest(range(1, len(string_split(directory, '/')) + 1)) AS depth FROM (SELECT DISTINCT directory FROM paths))),
        nearest AS (SELECT directory, tree.above, license, score FROM tree JOIN holds USING (above) QUALIFY row_number() OVER (PARTITION BY directory ORDER BY depth DESC) = 1)
        SELECT path, coalesce(f.license, n.license) AS license, coalesce(f.score, n.score) AS score,
               CASE WHEN f.license IS NOT NULL THEN 'notice' WHEN n.license IS NOT NULL THEN 'inherited' END AS basis,
               CASE WHEN f.license IS NULL THEN n.above END AS inherited_from
        FROM paths LEFT JOIN found f USING (path) LEFT JOIN nearest n USING (directory)"""
