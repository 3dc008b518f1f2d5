"""Layout: fixtures, and the relational plans against the in-task functions."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from foliant.operators import layout as task
from foliant.operators.interpreter import Chunk
from foliant.operators.layout import Region
from foliant.plans import layout

f = np.float32


def chunk(x0, y0, text, width=6, height=10):
    return Chunk(f(x0), f(y0), f(x0 + width * len(text)), f(y0 + height), text.encode(), len(text))


def region(x0, y0, x1, y1, text):
    return Region(f(x0), f(y0), f(x1), f(y1), text.encode(), len(text))


def test_columns_come_one_after_the_other():
    left = [chunk(50, 700 - 14 * i, f"left{i}") for i in range(3)]
    right = [chunk(350, 700 - 14 * i, f"right{i}") for i in range(3)]
    rows = [c for pair in zip(left, right) for c in pair]
    # chunks with equal whole y on one row go on with one another, so shift the right ones
    rows = [c if c.x0 < 300 else Chunk(c.x0, c.y0 - f(1), c.x1, c.y1 - f(1), c.text, c.length) for c in rows]
    assert task.render(rows).decode() == "left0\nleft1\nleft2\nright0\nright1\nright2\n"


def test_gap_makes_a_space():
    a = chunk(50, 700, "ab")
    assert task.lines([a, chunk(62.5, 700, "cd")])[0].text == b"abcd"
    assert task.lines([a, chunk(63.5, 700, "cd")])[0].text == b"ab cd"


def test_same_whole_y_is_one_line_however_far():
    assert len(task.lines([chunk(50, 700.2, "a"), chunk(500, 700.7, "b")])) == 1
    assert len(task.lines([chunk(50, 700, "a"), chunk(500, 701, "b")])) == 2


def test_flat_regions_take_in_what_follows():
    rows = [region(0, 0, 9, 9, "a"), region(0, 0, 0, 9, "b"), region(0, 0, 9, 9, "c"), region(0, 0, 9, 9, "d"), region(5, 5, 5, 5, "e")]
    assert [r.text for r in task.joined_flat(rows)] == [b"a", b"bcd", b"e"]


def test_more_than_300_boxes_stay_as_they_are():
    rows = [region(i * 20, 0, i * 20 + 9, 9, str(i)) for i in range(301, 0, -1)]
    assert task.reading_order(rows) == list(range(301))
    assert task.reading_order(rows[:300]) != list(range(300))


def test_a_box_between_defers_the_pair():
    rows = [region(0, 0, 100, 10, "a"), region(0, 40, 100, 50, "b"), region(40, 20, 60, 25, "m")]
    assert task.reading_order(rows) == [1, 2, 0]


def test_heights_that_differ_make_separate_boxes():
    assert len(task.boxes([region(0, 20, 90, 40, "big"), region(0, 11, 90, 19, "small")])) == 2


def _plane_brute(regions):
    """Pairs in a plain list, the least one searched anew each time."""
    boxes = [[r.x0, r.y0, r.x1, r.y1] for r in regions]
    order = {i: [i] for i in range(len(regions))}

    def waste(i, j):
        a, b = boxes[i], boxes[j]
        u = (max(a[2], b[2]) - min(a[0], b[0])) * (max(a[3], b[3]) - min(a[1], b[1]))
        return u - (a[2] - a[0]) * (a[3] - a[1]) - (b[2] - b[0]) * (b[3] - b[1])

    pairs = [[0, waste(i, j), i, j] for i in order for j in order if i < j]
    while pairs:
        best = min(pairs, key=lambda p: (p[0], p[1]))
        _, _, i, j = best
        a, b = boxes[i], boxes[j]
        u = [min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])]
        if not best[0] and any(boxes[k] not in (a, b) and boxes[k][0] >= u[0] and boxes[k][1] >= u[1] and boxes[k][2] <= u[2] and boxes[k][3] <= u[3] for k in order):
            best[0] = 1
            continue
        key = [f(0.5) * boxes[k][0] - f(1.5) * (boxes[k][1] + boxes[k][3]) for k in (i, j)]
        p, q = (i, j) if key[0] <= key[1] else (j, i)
        order[p] = order[p] + order.pop(q)
        boxes[p] = u
        pairs = [x for x in pairs if not {x[2], x[3]} & {i, j}] + [[0, waste(p, k), p, k] for k in sorted(order) if k != p]
    return next(iter(order.values()), [])


_boxes = st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40), st.integers(1, 12), st.integers(1, 12)), min_size=0, max_size=9)


@settings(max_examples=150, deadline=None)
@given(_boxes)
def test_reading_order_against_brute_force(rows):
    regions = [region(x, y, x + w, y + h, "t") for x, y, w, h in rows]
    assert task.reading_order(regions) == _plane_brute(regions)


@settings(max_examples=100, deadline=None)
@given(_boxes)
def test_components_against_brute_force(rows):
    regions = [region(x * 2, y * 3, x * 2 + w, y * 3 + h, "t") for x, y, w, h in rows]
    corners = np.array([(r.x0, r.y0, r.x1, r.y1) for r in regions], "f4").reshape(-1, 4)
    near = task.neighbours(corners, np.arange(len(regions)))
    label = list(range(len(regions)))
    for _ in label:
        for i in label[:]:
            for j in range(len(regions)):
                if near[i][j]:
                    assert near[j][i]
                    label[j] = label[i] = min(label[i], label[j])
    got = task.components(regions)
    most, task.MOST_AT_ONCE = task.MOST_AT_ONCE, 0
    assert task.components(regions) == got
    task.MOST_AT_ONCE = most
    assert sorted(map(sorted, got)) == sorted(sorted(i for i in range(len(label)) if label[i] == v) for v in set(label))


@pytest.fixture(scope="module")
def chunks(spark):
    rng = np.random.default_rng(1)
    rows = []
    for doc in range(6):
        for page in range(2):
            x, y = 40.0, 700.0
            for seq in range(60):
                text = "w" * int(rng.integers(0, 7))
                width = 0.0 if rng.random() < 0.05 else 6.0 * len(text)
                rows.append((str(doc), page, 0, 0, seq, x, y, x + width, y + 10, text, len(text)))
                x += width + float(rng.choice([0, 0.5, 2, 30]))
                if x > 400 or rng.random() < 0.1:
                    x, y = float(rng.choice([40, 40, 300])), y - float(rng.choice([12, 14, 30]))
    names = "doc_id string, page_no int, part int, layer_no int, seq int, x0 float, y0 float, x1 float, y1 float, text string, string_len int"
    return spark.createDataFrame(rows, names).withColumn("part", F.col("part").cast("tinyint"))


def test_relations_agree_with_the_task_functions(chunks):
    lines = layout.lines(chunks).cache()
    text = {(r["doc_id"], r["page_no"]): r["text"] for r in layout.layer_text(lines).collect()}
    pages: dict = {}
    for r in chunks.orderBy("seq").collect():
        pages.setdefault((r["doc_id"], r["page_no"]), []).append(Chunk(f(r["x0"]), f(r["y0"]), f(r["x1"]), f(r["y1"]), r["text"].encode(), r["string_len"]))
    assert text == {k: task.render(v).decode() for k, v in pages.items()}
    placed = {(r["doc_id"], r["page_no"], r["box_no"]): r["place"] for r in layout.reading_order(layout.boxes(lines)).collect()}
    assert placed == {(r["doc_id"], r["page_no"], r["box_no"]): r["place"] for r in layout.ordered_boxes(lines).collect()}
    by_line = {(r["doc_id"], r["page_no"], r["line_no"]): r["text"] for r in lines.collect()}
    assert by_line == {(*k, i): r.text.decode() for k, v in pages.items() for i, r in enumerate(task.lines(v))}
    grouped = layout.flat_groups(lines, "line_no").groupBy(*layout.LAYER, "group_no").agg(F.count("*").alias("n"))
    assert grouped.count() == sum(len(task.joined_flat(task.lines(v))) for v in pages.values())


def test_neighbour_pairs_agree(chunks):
    lines = layout.lines(chunks)
    got = {tuple(r) for r in layout.neighbour_pairs(lines).select("doc_id", "page_no", "a", "b").collect()}
    want = set()
    per: dict = {}
    for r in lines.orderBy("line_no").collect():
        per.setdefault((r["doc_id"], r["page_no"]), []).append(region(r["x0"], r["y0"], r["x1"], r["y1"], r["text"]))
    for k, v in per.items():
        corners = np.array([(r.x0, r.y0, r.x1, r.y1) for r in v], "f4")
        for i in range(len(v)):
            want |= {(*k, i, j) for j in np.flatnonzero(task.neighbours(corners, np.array([i]))[0]).tolist() if i < j}
    assert got == want


@pytest.fixture(scope="module")
def scattered(spark):
    """Regions of very different heights, some flat, on two pages; corners are quarters."""
    rng, rows = np.random.default_rng(3), []
    for page in (0, 1):
        for i in range(60):
            x, y, w, h = rng.integers(0, 400) / 4, rng.integers(-400, 400) / 4, rng.integers(0, 80) / 4, float(rng.choice([0, 0.25, 1, 1.75, 2, 9, 10, 64, 100]))
            rows.append(("d", page, 0, 0, i, float(x), float(y), float(x + w), float(y + h), "t", 1))
    schema = "doc_id string, page_no int, part int, layer_no int, line_no int, x0 float, y0 float, x1 float, y1 float, text string, string_len int"
    return spark.createDataFrame(rows, schema), rows


def test_neighbours_of_very_different_heights(scattered):
    frame, rows = scattered
    got = {tuple(r) for r in layout.neighbour_pairs(frame).select("page_no", "a", "b").collect()}
    want = set()
    for page in (0, 1):
        corners = np.array([r[5:9] for r in rows if r[1] == page], np.float32)
        near = task.neighbours(corners, np.arange(len(corners)))
        want |= {(page, i, j) for i in range(60) for j in range(i + 1, 60) if near[i, j]}
    assert got == want and len(want) > 5


def test_pairs_and_what_lies_between_against_brute_force(scattered):
    frame, rows = scattered
    boxes = frame.withColumnRenamed("line_no", "box_no")
    got = {tuple(r) for r in layout.between(boxes).select("page_no", "a", "b").collect()}
    top = {r["page_no"]: (r["waste"], r["a"], r["b"]) for r in layout.closest(boxes).collect()}
    want, least = set(), {}
    for page in (0, 1):
        own = [r[5:9] for r in rows if r[1] == page]
        for i, p in enumerate(own):
            for j in range(i + 1, len(own)):
                q = own[j]
                u = min(p[0], q[0]), min(p[1], q[1]), max(p[2], q[2]), max(p[3], q[3])
                area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
                least[page] = min(least.get(page, (1e9, 0, 0)), (area(u) - area(p) - area(q), i, j))
                if any(c[0] >= u[0] and c[1] >= u[1] and c[2] <= u[2] and c[3] <= u[3] and c not in (p, q) for c in own):
                    want.add((page, i, j))
    assert got == want and top == least
