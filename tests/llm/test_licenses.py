from __future__ import annotations

import re
import textwrap

import pytest

from prospectus.llm.licenses import TEMPLATES, license_scan, size_bounds, template_bigrams


def plainly(text, threshold=0.8):
    """Best (dice, name, line) and number of findings, comparing every unit with every template."""
    lines = [re.sub(r"[\W_]+", " ", line.lower()).strip() for line in (text or "").split("\n")]
    units = list(enumerate(lines)) + ([(-1, " ".join(x for x in lines if x))] if len(lines) > 1 else [])
    findings = []
    for line, unit in units:
        words = unit.split()
        own = set(zip(words, words[1:], strict=False))
        best = []
        for rank, (name, template) in enumerate(sorted(TEMPLATES.items())):
            other = {tuple(x.split()) for x in template_bigrams(template)}
            dice = 2 * len(own & other) / (len(own) + len(other))
            if dice >= threshold:
                best.append((-dice, rank, line if line >= 0 else 10**9, name, line))
        if best:
            findings.append(min(best))
    return (*min(findings)[3:], -min(findings)[0], len(findings)) if findings else (None, None, None, 0)


def test_against_every_template(documents, awkward):
    apache = TEMPLATES["Apache-2.0-header"]
    rows = awkward + [
        (20, f"intro\n{TEMPLATES['MIT']}\nbody text"),
        (21, apache),
        (22, apache.replace(". ", ".\n ").upper()),
        (23, "Released under the MIT Licence."),
        (24, TEMPLATES["GPL-3.0"] + " extra words here"),
        (25, TEMPLATES["MIT"] + "\n" + TEMPLATES["CC-BY-4.0"]),
        (26, "released under"),
        (27, TEMPLATES["ISC"].replace("modify", "change").replace("  ", " ")),
    ]
    docs = documents(rows, extra=("line", "dice", "unit", "__set"))
    out = license_scan(docs).collect()
    assert len(out) == len(rows)
    texts = {}
    for i, text in rows:
        texts.setdefault(i, text)
    for row in out:
        name, line, dice, n = plainly(texts[row["doc_id"]])
        assert (row["license"], row["line"], row["n_findings"]) == (name, line, n), row
        assert row["dice"] == dice
        assert row["__set"] == "x"
    assert {row["doc_id"] for row in out if row["license"]} >= {20, 21, 22, 25}


def test_size_bounds_are_tight():
    for size in (1, 4, 30):
        least, most = size_bounds(size, 0.8)
        reach = [n for n in range(1, 100) if 2 * min(n, size) / (n + size) >= 0.8]
        assert (least, most) == (reach[0], reach[-1])


def test_no_templates_and_empty_table(documents, awkward):
    assert {row["n_findings"] for row in license_scan(documents(awkward), {}).collect()} == {0}
    assert license_scan(documents([], "none")).count() == 0


def wrapped(name, width=72):
    return "\n".join(textwrap.fill(" ".join(block.split()), width) for block in re.split(r"\n\s*\n", TEMPLATES[name]))


OTHER = "\n".join(f"Plain words of page {i * 37}, nothing else: rivers {i * i} and hills {i * 11}, then a road." for i in range(60))


@pytest.mark.parametrize("name", ["MIT-text", "MIT-permission", "ISC-text", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0-header", "Apache-2.0-text", "GPL-2.0-text", "GPL-3.0-text", "MPL-2.0-text"])
def test_wrapped_inside_other_text(documents, name):
    rows = [(1, f"{OTHER}\n{wrapped(name)}\n{OTHER}"), (2, f"{OTHER}\n\n  Copyright 2020 A. Writer\n{wrapped(name, 78).upper()}"), (3, TEMPLATES[name])]
    out = {row["doc_id"]: row for row in license_scan(documents(rows)).collect()}
    assert {row["license"] for row in out.values()} == {name}
    assert all(row["dice"] > 0.97 for row in out.values())
    assert (out[1]["line"], out[1]["n_findings"]) == (60, 1)  # the title's line, though its words may all stand in the text below
    assert out[2]["line"] == 62


def test_two_licences_of_one_document(documents):
    text = f"{wrapped('MIT-text')}\n{OTHER}\n{wrapped('BSD-2-Clause', 60)}\n{OTHER}\n{wrapped('MIT-text', 50)}\n{OTHER}"
    row = license_scan(documents([(1, text)])).first()
    assert (row["license"], row["line"], row["n_findings"]) == ("BSD-2-Clause", wrapped("MIT-text").count("\n") + 61, 3)
    half = " ".join(TEMPLATES["MIT-text"].split()[:60])
    row = license_scan(documents([(1, f"{OTHER}\n{half}\nsome words between the two of them\n{wrapped('MIT-text')}\n{OTHER}")], "half")).first()
    assert (row["license"], row["dice"], row["line"]) == ("MIT-text", 1.0, 62)


def test_other_text_has_no_run(documents):
    row = license_scan(documents([(1, OTHER), (2, f"{OTHER}\nPermission is hereby granted, free of charge,\nto any person who asks.\n{OTHER}")])).collect()
    assert [x["n_findings"] for x in row] == [0, 0]
