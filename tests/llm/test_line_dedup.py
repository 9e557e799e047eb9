from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prospectus.llm.line_dedup import CROWD, marked, near_lines, probe_places, segment_keys, shared_keys, within_distance, without_near_lines
from prospectus.llm.queries import op3_line_dedup


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def edited(random, line, times):
    for _ in range(times):
        at, kind = int(random.integers(0, len(line) + 1)), random.integers(3)
        line = line[:at] + ("é" if kind < 2 else "") + line[at + (kind > 0) :]
    return line


def plainly(rows, min_chars=20, distance=2):
    """The deduplicated texts, by comparing all lines with all."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    lines = [(i, k, line) for i in order if rows[i][1] is not None for k, line in enumerate(rows[i][1].split("\n")) if len(line) >= min_chars]
    texts = sorted({line for _, _, line in lines})
    parent = {line: line for line in texts}

    def root(line):
        while parent[line] != line:
            line = parent[line]
        return line

    for n, a in enumerate(texts):
        for b in texts[n + 1 :]:
            if abs(len(a) - len(b)) <= distance and edits(a, b) <= distance:
                parent[root(a)] = root(b)
    seen, gone = set(), set()
    for i, k, line in lines:
        if root(line) in seen:
            gone.add((i, k))
        seen.add(root(line))
    return [None if row[1] is None else "\n".join(line for k, line in enumerate(row[1].split("\n")) if (i, k) not in gone) for i, row in enumerate(rows)]


def test_places_to_look_up():
    assert probe_places(0) == [(0, 0, 0)]
    assert probe_places(1) == [(0, 0, 0), (0, 1, 0), (1, 0, 0), (1, 1, 1)]
    assert len(probe_places(2)) == 12


@pytest.mark.parametrize("distance", [0, 1, 2, 4])
def test_edit_automaton(spark, distance):
    random = np.random.default_rng(distance)
    pairs = [("", ""), ("", "ab"), ("abcd", ""), ("same", "same"), ("aaaa", "aaaaaa"), ("😀é", "é")]
    for _ in range(400):
        line = "".join(random.choice(list("ab é😀"), random.integers(0, 30)))
        pairs.append((line, edited(random, line, random.integers(0, 6))))
    frame = spark.createDataFrame(pairs, "a string, b string").withColumn("near", within_distance(F.col("a"), F.col("b"), distance))
    for row in frame.collect():
        assert row["near"] == (edits(row["a"], row["b"]) <= distance), row
    with pytest.raises(ValueError):
        within_distance(F.col("a"), F.col("b"), 5)


def test_marks_hold_for_all_ids(spark):
    ids = spark.range(0, 40_000, 7).selectExpr("(id - 20000) * 998244353 AS line_id")
    every = spark.range(0, 40_000).selectExpr("(id - 20000) * 998244353 AS line_id", "id % 7 = 0 AS is_in")
    kept = {row["is_in"]: row["count"] for row in every.where(marked(ids)).groupBy("is_in").count().collect()}
    assert kept[True] == ids.count() and kept.get(False, 0) < 1_000
    assert every.where(marked(ids.limit(0))).count() == 0


@pytest.mark.parametrize("crowd", [CROWD, 40, 0])
def test_links_against_all_pairs(spark, crowd):
    """With all keys in windows, with some remainders crowded, and with all of them."""
    random = np.random.default_rng(4)
    lines = set()
    for _ in range(30):
        line = "".join(random.choice(list("abcde "), random.integers(20, 60)))
        lines |= {line} | {edited(random, line, n) for n in random.integers(1, 6, 5)}
    rows = [(2 * i, line) for i, line in enumerate(sorted(lines))]
    found = {tuple(sorted(row)) for row in near_lines(spark.createDataFrame(rows, "line_id long, line string"), 2, crowd).collect()}
    wanted = {(i, j) for i, a in rows for j, b in rows if i < j and edits(a, b) <= 2}
    assert found == wanted


def test_crowded_keys_meet_in_no_window(spark):
    """A segment that 3,000 variants of a line share is counted by aggregation; the rows are those of the window."""
    lines = [(2 * i, f"{'common beginning of the line':>28} {i * 7919:08d} {i * 104729:012d}") for i in range(3_000)]
    keys = segment_keys(spark.createDataFrame(lines, "line_id long, line string"), 2)
    crowded = shared_keys(keys, 1_000)
    plan = crowded._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "LeftSemi" in plan
    largest = keys.groupBy("key").count().agg(F.max("count")).first()[0]
    assert largest >= 3_000
    by_window = shared_keys(keys, CROWD)
    assert "LeftSemi" not in by_window._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, crowded.collect())) == sorted(map(tuple, by_window.collect()))


def test_documents_without_an_id_keep_one(documents):
    """They count as one owner: the first of their rows keeps the line, each other one loses it, in all its places."""
    line = "This line is on every page of the site."
    rows = [(None, f"{line}\n{line}\npage {i * 7919} of the book {i}") for i in range(200)]
    left = [row["text"].count(line) for row in without_near_lines(documents(rows)).collect()]
    assert sorted(left) == [0] * 199 + [1]


def test_texts_against_all_pairs(documents):
    random = np.random.default_rng(5)
    base = ["".join(random.choice(list("abcde "), random.integers(15, 50))) for _ in range(25)]
    rows = []
    for i in range(40):
        lines = [edited(random, base[random.integers(25)], random.integers(0, 4)) for _ in range(6)] + ["short"] * 2
        rows.append((i, "\n".join(lines)))
    rows += [(40, rows[3][1]), (41, None), (42, "")]
    out = {row["doc_id"]: row["text"] for row in without_near_lines(documents(rows, extra=("line", "row", "at"))).collect()}
    assert [out[i] for i, _ in rows] == plainly(rows)


def test_awkward_documents(documents, awkward):
    docs = documents(awkward, extra=("line", "removed_lines", "class_id", "owner"))
    out = without_near_lines(docs).collect()
    assert len(out) == len(awkward)
    left = sorted((row["doc_id"] or 99, row["text"] or "") for row in out)
    wanted = sorted((i or 99, t or "") for (i, _), t in zip(awkward, plainly(awkward), strict=True))
    assert left == wanted
    assert {row["owner"] for row in out} == {"x"}
    assert [row["text"] for row in out if row["doc_id"] == 3] == [None]


def test_a_common_line_stays_once(documents):
    line = "This line is on every page of the site."
    out = without_near_lines(documents([(i, f"{line}\nown text number {i * 7919} of page {i * i}") for i in range(300)])).collect()
    assert [row["doc_id"] for row in out if line in row["text"]] == [0]


def test_equal_short_lines_go(documents):
    line = "This line is on every page of the site."
    rows = [(1, f"Home\n\nAbout\n{line}"), (2, f"Home\n\n \n\u3000\nabout\nHomes\n{line}"), (3, "\n \n\u3000\nAbout\nHome\nHome"), (4, None)]
    out = {row["doc_id"]: (row["text"], row["removed_lines"]) for row in without_near_lines(documents(rows), exact_chars=1).collect()}
    assert out == {1: (rows[0][1], 0), 2: ("\n \n\u3000\nabout\nHomes", 2), 3: ("\n \n\u3000", 3), 4: (None, 0)}


def test_the_query_drops_equal_short_lines(spark, documents, tmp_path):
    documents([(1, "Home"), (2, "Home\nown")])
    assert {row["doc_id"]: row["text"] for row in op3_line_dedup(spark, str(tmp_path)).collect()} == {1: "Home", 2: "own"}


def test_empty_table(documents):
    assert without_near_lines(documents([])).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.text("ab", min_size=6, max_size=14), st.text("ab", min_size=6, max_size=14))
def test_a_segment_is_always_found(a, b):
    """What the join rests on: lines within the distance share a segment at one of the places looked up."""
    distance = 2
    a, b = sorted((a, b), key=len)
    if len(b) - len(a) > distance or edits(a, b) > distance:
        return
    size, longer = divmod(len(a), distance + 1)
    lengths = [size] * (distance + 1 - longer) + [size + 1] * longer
    starts = [sum(lengths[:i]) for i in range(distance + 1)]
    found = False
    for more, number, shift in probe_places(distance):
        if more == len(b) - len(a):
            at = starts[number] + shift
            found |= at >= 0 and b[at : at + lengths[number]] == a[starts[number] : starts[number] + lengths[number]]
    assert found


def test_a_document_of_very_many_equal_lines(documents):
    """The time is in proportion to the lines: a quadratic pass over these would take hours."""
    n = 1_000_000
    rows = [(1, "\n".join(["one and the same line of this log file"] * n)), (2, "another text of a single line, as it happens")]
    out = {row["doc_id"]: row for row in without_near_lines(documents(rows)).collect()}
    assert out[1]["text"] == "one and the same line of this log file" and out[1]["removed_lines"] == n - 1
    assert out[2]["removed_lines"] == 0
