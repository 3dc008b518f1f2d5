"""Work that must not grow with more than the input: counted, not timed."""

import numpy as np
import pytest

from foliant import queries
from foliant.functions import crypto, filters
from foliant.operators import fonts, layout as task
from foliant.plans import extract, layout
from foliant.sources.writer import rc4_encrypt, simple_pdf, tiff_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["matrix_product", "apply_point", "recovery_scan", "pdf_vertical", "pdf_font_metrics", "pdf_aes", "inherit_box", "pdf_roundtrip_text", "width_lookup", "diff_encoding"])
def test_files_are_made_and_read_by_all_cores(spark, name, monkeypatch):
    """However few bytes the rows have that files are made of."""
    seen, parse = [], extract.parse
    monkeypatch.setattr(extract, "parse", lambda files, *a, **k: seen.append(files.rdd.getNumPartitions()) or parse(files, *a, **k))
    queries.QUERIES[name](spark, SF)
    assert seen == [queries.LEAST_PARTS]


def test_a_font_is_loaded_once_however_many_pages_use_it(monkeypatch):
    seen, load = [], fonts.load_font
    monkeypatch.setattr(fonts, "load_font", lambda *a: seen.append(a) or load(*a))
    got = extract.read_document(simple_pdf([b"BT /F1 10 Tf 10 %d Td (x) Tj ET " % i for i in range(30)]), ("chunks",))
    assert len(got["chunks"]) == 30 and len(seen) == 1


@pytest.mark.parametrize("name", ["neighbour_pairs", "box_distance_top1", "between_exists", "plane_full"])
def test_words_and_pairs_are_not_moved(spark, name):
    """Texts are moved, before they become words (then boxes or a row a layer); a layer's pairs need no join."""
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    moved = plan.count("Exchange hashpartitioning")
    assert "MergeJoin" not in plan and "HashJoin" not in plan
    assert moved == {"between_exists": 3, "plane_full": 2}.get(name, 1) and "Generate posexplode" in plan.split("Exchange hashpartitioning")[moved - 1]


@pytest.mark.parametrize("at_once", [1 << 18, 700, 1])
def test_pairs_of_a_large_layer_in_blocks(at_once, monkeypatch):
    monkeypatch.setattr(layout, "AT_ONCE", at_once)
    rng = np.random.default_rng(7)
    n = 150
    low = rng.integers(0, 60, (n, 2)) / 4
    box = np.concatenate([low, low + rng.choice([0.25, 1, 1.75, 2, 9], (n, 2))], 1).astype("f4")
    number = np.arange(n, dtype="i4") * 3
    near = {(3 * i, 3 * j) for i, j in zip(*task.neighbours(box, np.arange(n)).nonzero()) if i < j}
    assert set(zip(*(x.tolist() for x in layout._near(number, box)))) == near and near
    third, best = set(), (np.inf, 0, 0)
    for i in range(n):
        for j in range(i + 1, n):
            u = np.concatenate([np.minimum(box[i, :2], box[j, :2]), np.maximum(box[i, 2:], box[j, 2:])])
            area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
            best = min(best, (area(u) - area(box[i]) - area(box[j]), 3 * i, 3 * j))
            inside = (box[:, :2] >= u[:2]).all(1) & (box[:, 2:] <= u[2:]).all(1)
            if (inside & (box != box[i]).any(1) & (box != box[j]).any(1)).any():
                third.add((3 * i, 3 * j))
    a, b, waste = layout._least_waste(number, box)
    assert (waste, a, b) == best
    assert set(zip(*(x.tolist() for x in layout._with_third(number, box)))) == third and 0 < len(third) < n * (n - 1) // 2


def test_rows_of_the_tiff_predictor_are_undone_at_once(monkeypatch):
    data = bytes(range(256)) * 30
    coded, seen, read = tiff_rows(data, 8), [], np.frombuffer
    monkeypatch.setattr(filters.np, "frombuffer", lambda *a: seen.append(a) or read(*a))
    assert filters.predict(coded + b"lost", {b"/Predictor": (4, b"2"), b"/Columns": (4, b"8")}) == data and len(seen) == 1
    colours = {b"/Predictor": (4, b"2"), b"/Columns": (4, b"2"), b"/Colors": (4, b"3")}
    assert filters.predict(bytes([1, 2, 3, 1, 1, 255]), colours) == bytes([1, 2, 3, 2, 3, 2])


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_both_ciphers_agree_over_turns_of_the_state(n):
    data = bytes(i * 7 % 256 for i in range(n))
    assert crypto.rc4(b"key", rc4_encrypt(b"key", data)) == data
    assert n < 256 or crypto.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"  # a published vector
