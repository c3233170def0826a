import random
import time

import numpy as np
import pyarrow as pa

from parcelcast.llm import decontaminate as dc
from parcelcast.llm.common import as_bytes
from tests.llm.data import documents, nothing, words


def edit_distance_within(pattern, text):
    """Smallest edit distance of ``pattern`` to any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(rng, text, n):
    t = list(text)
    for _ in range(n):
        k = rng.randrange(len(t))
        kind = rng.randrange(3)
        if kind == 0:
            t[k] = "#"
        elif kind == 1:
            del t[k]
        else:
            t.insert(k, "#")
    return "".join(t)


def test_every_segment_within_the_budget_is_found():
    rng = random.Random(8)
    items = [(i, words(rng, 14 + 3 * i, 0.5)[:60 + 14 * i].encode()) for i in range(6)]
    segments = dc.Segments(items, dc.RATE)
    texts = []
    for _ in range(120):
        k = rng.randrange(len(segments.text))
        part = edited(rng, segments.text[k].decode(), rng.randint(0, 9))
        texts.append(f"{words(rng, rng.randint(0, 25))} {part} {words(rng, rng.randint(0, 25))}")
    data, at = as_bytes(pa.array(texts))
    found = {}
    for text, item, start, end, edits in zip(*(x.tolist() for x in segments.matches(data, at))):
        found[text, item] = min(edits, found.get((text, item), 99))
        assert 0 <= start <= end <= at[text + 1] - at[text]
    want = {}
    for i, t in enumerate(texts):
        for item, seg, e in zip(segments.item, segments.text, segments.edits):
            d = edit_distance_within(seg, t.encode())
            if d <= e:
                want[i, item] = min(d, want.get((i, item), 99))
    assert found == want and len(want) > 60


def test_planted_items(spark):
    rng = random.Random(9)
    items = [(i, words(rng, 40, 0.7)) for i in range(5)] + [(9, None), (None, "no id here but a text"), (7, "short"), (3, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark)
    extra = docs.limit(4).collect()
    planted = [(1000 + i, f"{r.text}\n{items[i][1].upper().replace(' ', '  ')} end", *r[2:]) for i, r in enumerate(extra)]
    everything = docs.union(spark.createDataFrame(planted, docs.schema))
    for size in (dc.BLOCK_BYTES, 300):
        got = {r.row.doc_id: {m.item_id: m.edits for m in r.matches} for r in dc.find(everything, bench, block_bytes=size).collect()}
        assert {d: m for d, m in got.items() if m} == {1000 + i: {i: 0} for i in range(4)}
    kept = dc.remove(everything, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert dc.remove(documents(spark), bench).count() == documents(spark).count()
    assert dc.find(nothing(spark), bench).count() == 0
    assert len(dc.Segments([], dc.RATE).matches(np.zeros(100, np.uint8), np.array([0, 100]))[0]) == 0


def ranges(segments, texts):
    """First start, last end and fewest edits of each item in each text."""
    data, at = as_bytes(pa.array(texts))
    found = {}
    for text, item, start, end, edits in zip(*(x.tolist() for x in segments.matches(data, at))):
        s, e, k = found.get((text, item), (start, end, edits))
        found[text, item] = min(s, start), max(e, end), min(k, edits)
    return found


def test_counting_in_small_ranges_and_skipping_what_repeats_changes_nothing(monkeypatch):
    rng = random.Random(10)
    items = [(0, b"=" * 400), (1, b"ab" * 150), (2, words(rng, 60, 0.5).encode()), (3, b"=" * 120), (4, b"x" + b"=" * 90 + b"y"), (5, b"0123456789a" * 30)]
    texts = []
    for _ in range(6):
        parts = [rng.choice([words(rng, 30), rng.choice(items)[1].decode(), rng.choice(["=", "ab", "0123456789a"]) * rng.randint(90, 600)]) for _ in range(3)]
        texts.append(edited(rng, rng.choice(["", " "]).join(parts), 3))
    segments = dc.Segments(items, dc.RATE)
    monkeypatch.setattr(dc, "PAIRS", 1 << 40)
    want = ranges(segments, texts)
    for pairs in (2000, 50_000):
        monkeypatch.setattr(dc, "PAIRS", pairs)
        assert ranges(segments, texts) == want
    assert len(want) > 6


def test_a_megabyte_of_one_character_or_line():
    segments = dc.Segments([(0, b"=" * 400), (1, b"words that are not there " * 9)], dc.RATE)
    start = time.perf_counter()
    for text in ("=" * (1 << 20), ("=" * 79 + " ") * 13_000):
        assert ranges(segments, [text, "", "other"]) == {(0, 0): (0, len(text.rstrip()) + (text[-1] == " "), min(1, text.count(" ")))}
    assert time.perf_counter() - start < 10


def test_items_that_share_a_segment():
    text = words(random.Random(11), 30, 0.5)[:100]
    segments = dc.Segments([(3, text.encode()), (4, text.encode()), (5, (text[:80] + "!" * 60).encode())], dc.RATE)
    assert {i: k for (_, i), (_, _, k) in ranges(segments, ["a " + text]).items()} == {3: 0, 4: 0, 5: 0}
