"""Licence scan: normalised text against licence templates by the Dice coefficient of their word bigrams.

Text is lower-cased and everything but letters and digits becomes one space. A document is scanned line by line, as a whole,
and by runs of lines, so that a licence is found as a line inside other text, as a text of several lines, and wrapped over
lines of a longer document. Everything is one expression on the document's row: no shuffle.

A coefficient of t with a template of b bigrams takes t * b / (2 - t) of them at least: templates of which the document has
fewer are compared with nothing in it. A unit's set of word bigrams is compared only with templates whose size lets the
coefficient reach the threshold: two sets of a and b members have a coefficient of 2 * min(a, b) / (a + b) at most.

Runs are sought for each template: from line to line, twice the template's bigrams that were seen less t times all that were
seen is the run's score. A run ends with the line of the highest score; it is over when the score is used up or has dropped
by more than a run that reaches t can hold of other text, (2 - 2t) * b. Then it is followed backwards from its end for the
line to start with, whose bigrams are counted without the one that leads to it. A line with bigrams of the template that leaves
the score as it is belongs to the run, at both ends: all words of a title may stand in the text below. What is reported has its coefficient computed from the run's own text. Of findings that overlap a run,
the one that exceeds the threshold by most bigrams, (coefficient - t) * (a + b), stays; a run of one line or of all lines is
that line or the whole. A copy of a licence that follows another within half its length counts with it.

Units of fewer than two words have no bigrams and match nothing; nulls and empty texts have no findings. The best finding is
the one of the highest coefficient, then the template first in name, then the earliest unit. Repeated rows are scanned each
for itself.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from importlib.resources import files

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectus.llm.line_dedup import bound

#: Short notices, opening paragraphs and, from ``license_texts``, whole texts of well-known licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "BSD-opening": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction'
    ),
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do "
        "so, subject to the following conditions:"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
TEMPLATES |= {path.name.removesuffix(".txt"): path.read_text("utf-8") for path in files("prospectus.llm").joinpath("license_texts").iterdir() if path.name.endswith(".txt")}

_RUN = "struct<start:int,end:int>"


def template_bigrams(text: str) -> list[str]:
    """The template's word bigrams, normalised as texts are; each once, in order."""
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def size_bounds(size: int, threshold: float) -> tuple[int, int]:
    """Least and greatest size of a set whose coefficient with one of ``size`` members can reach ``threshold``."""
    sizes = [n for n in range(1, int(2 * size / threshold) + 2) if 2 * min(n, size) >= threshold * (n + size)]
    return min(sizes), max(sizes)


def normalized(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def bigrams(unit: Column) -> Column:
    """The unit's distinct word bigrams."""
    words = F.split(unit, " ")
    following = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), following, lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(pairs)


def held_templates(sets: Mapping[str, list[str]], threshold: float) -> Column:
    """The templates as one constant array."""
    rows = []
    for rank, (name, own) in enumerate(sets.items()):
        least, most = size_bounds(len(own), threshold)
        values = {"rank": F.lit(rank), "name": F.lit(name), "size": F.lit(len(own)), "least": F.lit(least), "most": F.lit(most), "own": F.split(F.lit("\n".join(own)), "\n")}
        rows.append(F.struct(*[value.alias(key) for key, value in values.items()]))
    return F.array(*rows)


def found_in(unit: Column, grams: Column, templates: Column, threshold: float) -> Column:
    """The best finding of ``unit`` (``line``, ``start``, ``end``) among ``templates`` that its size allows, or null."""
    size = F.size(grams)

    def finding(t: Column) -> Column:
        shared = F.size(F.array_intersect(grams, t["own"]))
        return F.struct(
            (2.0 * shared / (size + t["size"])).alias("dice"),
            (-t["rank"]).alias("order"),
            t["name"].alias("license"),
            unit["line"].alias("line"),
            unit["start"].alias("start"),
            unit["end"].alias("end"),
            (2.0 * shared - threshold * (size + t["size"])).alias("excess"),
        )

    return F.array_max(F.transform(F.filter(templates, lambda t: size.between(t["least"], t["most"])), finding))


def runs_of(lines: Column, template: Column, threshold: float) -> Column:
    """First and last of the ``lines`` that may make a run for ``template``.

    A line has its bigrams with the one that leads to it from the line before (``grams``) and without (``plain``).
    """
    none = F.array().cast("array<string>")
    slack = (2 - 2 * threshold) * template["size"]

    def state(seen: Column, hits: Column, start: Column, best: Column, end: Column, found: Column, at: Column) -> Column:
        names = ("seen", "hits", "start", "best", "end", "found", "at")
        kinds = ("array<string>", "int", "int", "double", "int", f"array<{_RUN}>", "int")
        return F.struct(*[x.cast(kind).alias(name) for x, kind, name in zip((seen, hits, start, best, end, found, at), kinds, names, strict=True)])

    def score(hits: Column, seen: Column) -> Column:
        return 2.0 * hits - threshold * F.size(seen)

    def ended(run: Column) -> Column:
        """The runs so far, with this one if it has enough of the template."""
        own = F.array(F.struct(run["start"].cast("int").alias("start"), run["end"].cast("int").alias("end")))
        return F.when((run["best"] >= threshold * template["size"] - 2) & (run["end"] > run["start"]), F.concat(run["found"], own)).otherwise(run["found"])

    def step(run: Column, unit: Column) -> Column:
        line = unit["grams"]
        grown = F.struct(F.array_union(run["seen"], line).alias("seen"), (run["hits"] + F.size(F.array_intersect(F.array_except(line, run["seen"]), template["own"]))).alias("hits"))

        def go_on(now: Column) -> Column:
            value = score(now["hits"], now["seen"])
            over = (value <= 0) | (value < run["best"] - slack)
            alone = F.size(F.array_intersect(line, template["own"]))
            higher = (value > run["best"]) | ((value == run["best"]) & (alone > 0))
            further = state(now["seen"], now["hits"], run["start"], F.greatest(value, run["best"]), F.when(higher, run["at"]).otherwise(run["end"]), run["found"], run["at"] + 1)
            anew = bound(
                F.struct(alone.alias("hits"), score(alone, line).alias("value"), ended(run).alias("found")),
                lambda x: F.when(x["value"] > 0, state(line, x["hits"], run["at"], x["value"], run["at"], x["found"], run["at"] + 1)).otherwise(
                    state(none, F.lit(0), run["at"] + 1, F.lit(0.0), run["at"] + 1, x["found"], run["at"] + 1)
                ),
            )
            return F.when(over, anew).otherwise(further)

        return bound(grown, go_on)

    def trimmed(run: Column) -> Column:
        """The run from the line on, counted from its end, that gives the highest score."""
        back = F.reverse(F.slice(lines, run["start"] + 1, run["end"] - run["start"] + 1))

        def with_line(run_back: Column, line: Column) -> Column:
            new = F.size(F.array_intersect(F.array_except(line, run_back["seen"]), template["own"]))
            return F.struct(F.array_union(run_back["seen"], line).alias("seen"), (run_back["hits"] + new).alias("hits"))

        def step_back(run_back: Column, unit: Column) -> Column:
            both = F.struct(with_line(run_back, unit["plain"]).alias("begun"), with_line(run_back, unit["grams"]).alias("grown"))

            def go_on(now: Column) -> Column:
                value = score(now["begun"]["hits"], now["begun"]["seen"])
                known = F.exists(unit["plain"], lambda gram: F.array_contains(template["own"], gram))
                place = F.when((value > run_back["best"]) | ((value == run_back["best"]) & known), run_back["at"]).otherwise(run_back["start"])
                return state(now["grown"]["seen"], now["grown"]["hits"], place, F.greatest(value, run_back["best"]), run_back["end"], run_back["found"], run_back["at"] - 1)

            return bound(both, go_on)

        first = state(none, F.lit(0), run["end"], F.lit(0.0), run["end"], F.array(), run["end"])
        return F.aggregate(back, first, step_back, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))

    nothing = state(none, F.lit(0), F.lit(0), F.lit(0.0), F.lit(0), F.array(), F.lit(0))
    return F.transform(F.aggregate(lines, nothing, step, ended), trimmed)


def license_scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = 0.8, text: str = "text") -> DataFrame:
    """``docs`` with its licences: ``license`` and ``dice`` (best finding), ``line`` (from 0, a run's first; -1 for the whole
    text of a document of several lines), ``n_findings`` (lines, runs of lines and whole texts that match a template).

    Columns of these names in ``docs`` are replaced.
    """
    sets = {name: template_bigrams(template) for name, template in sorted(templates.items())}
    sets = {name: found for name, found in sets.items() if found}
    names = ("__lines", "__full", "__known", "__held", "__runs", "__findings")
    out = docs.drop(*names)
    if not sets:
        return out.withColumns({"license": F.lit(None).cast("string"), "dice": F.lit(None).cast("double"), "line": F.lit(None).cast("int"), "n_findings": F.lit(0)})
    least = min(size_bounds(len(own), threshold)[0] for own in sets.values())
    out = out.withColumn("__lines", F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), normalized))
    # the bigrams are letters, digits and blanks: nothing to quote
    every = ", ".join(f"'{gram}'" for gram in sorted(set().union(*sets.values())))
    whole_text = F.concat_ws(" ", F.filter("__lines", lambda x: x != ""))
    out = out.withColumn("__known", bigrams(whole_text)).withColumn("__known", F.expr(f"filter(__known, x -> x IN ({every}))"))
    enough = F.filter(held_templates(sets, threshold), lambda t: (F.size("__known") >= t["least"]) & (F.size(F.array_intersect("__known", t["own"])) >= t["least"]))
    out = out.withColumn("__held", F.when(F.size("__known") >= least, enough).otherwise(F.slice(held_templates(sets, threshold), 1, 0)))
    hopeful = F.size("__held") > 0
    # lines with words, by their place among them
    full = F.filter(F.transform("__lines", lambda unit, at: F.struct(unit.alias("unit"), at.alias("line"))), lambda x: x["unit"] != "")
    out = out.withColumn("__full", F.when(hopeful, full).otherwise(F.slice(full, 1, 0)))
    last = F.size("__full") - 1

    def unit_of(start: Column, end: Column, line: Column) -> Column:
        words = F.concat_ws(" ", F.transform(F.slice("__full", start + 1, end - start + 1), lambda x: x["unit"]))
        return F.struct(words.alias("unit"), line.alias("line"), start.alias("start"), end.alias("end"))

    def joined(unit: Column, at: Column) -> Column:
        """The line's bigrams, with and without the one that leads to it from the line before."""
        before = F.when(at > 0, F.substring_index(F.get("__full", at - 1)["unit"], " ", -1))
        return F.struct(bigrams(F.concat_ws(" ", before, unit["unit"])).alias("grams"), bigrams(unit["unit"]).alias("plain"))

    runs = F.flatten(F.transform("__held", lambda t: bound(F.transform("__full", joined), lambda lines: runs_of(lines, t, threshold))))
    spread = F.filter(F.array_distinct(runs), lambda r: (r["end"] > r["start"]) & ((r["start"] > 0) | (r["end"] < last)))
    out = out.withColumn("__runs", F.when(hopeful, spread).otherwise(F.array().cast(f"array<{_RUN}>")))
    lines = F.transform("__full", lambda x, at: F.struct(x["unit"].alias("unit"), x["line"].alias("line"), at.alias("start"), at.alias("end")))
    whole = F.filter(F.array(unit_of(F.lit(0), last, F.lit(-1))), lambda _: F.size("__lines") > 1)
    wrapped = F.transform("__runs", lambda r: unit_of(r["start"], r["end"], F.get("__full", r["start"])["line"]))
    # a unit of n words has n - 1 bigrams at most
    wordy = F.filter(F.concat(lines, whole, wrapped), lambda u: F.length(u["unit"]) - F.length(F.replace(u["unit"], F.lit(" "), F.lit(""))) >= least)
    each = F.transform(wordy, lambda u: bound(bigrams(u["unit"]), lambda grams: found_in(u, grams, F.col("__held"), threshold)))
    out = out.withColumn("__findings", F.when(hopeful, F.filter(each, lambda x: x["dice"] >= threshold)))
    is_run = lambda x: (x["line"] >= 0) & (x["end"] > x["start"])
    # most in excess first; of equal ones lines and wholes, which have no run's claim
    claim = F.transform("__findings", lambda x: F.struct(x["excess"].alias("excess"), (~is_run(x)).alias("plain"), x["order"].alias("order"), (-x["start"]).alias("early"), x.alias("x")))
    strongest = F.transform(F.reverse(F.array_sort(claim)), lambda x: x["x"])
    overlap = lambda x, y: (x["start"] <= y["end"]) & (y["start"] <= x["end"]) & (is_run(x) | is_run(y))
    kept = F.aggregate(strongest, F.slice("__findings", 1, 0), lambda found, x: F.when(F.exists(found, lambda y: overlap(x, y)), found).otherwise(F.concat(found, F.array(x))))
    out = out.withColumn("__findings", F.when(F.size("__runs") > 0, kept).otherwise(F.col("__findings")))
    ranked = F.array_max(F.transform("__findings", lambda x: F.struct(x["dice"], x["order"], (-F.when(x["line"] < 0, 2**31 - 1).otherwise(x["line"])).alias("place"), x["license"], x["line"])))
    out = out.withColumns({"license": ranked["license"], "dice": ranked["dice"], "line": ranked["line"], "n_findings": F.greatest(F.coalesce(F.size("__findings"), F.lit(0)), F.lit(0))})
    return out.drop(*names)
