"""The decontamination index: its size, its windows, and long items with edits."""

import random

import numpy as np
import pyarrow as pa
import pytest

from veinworks.llm import decontam, shingles

WORDS = [f"w{k}" for k in range(3000)]


def held_bytes(index):
    arrays = [index.any_item, *(x for pair in index.sets for x in pair)]
    for prints, item, offset, lists in index.classes.values():
        arrays += [prints, item, offset, *(x for pair in lists for x in pair)]
    return sum(a.nbytes for a in arrays)


@pytest.mark.parametrize(("low", "high"), [(20, 60), (500, 1500), (4000, 4000), (15_000, 20_000), (20, 20_000)])
def test_a_slice_takes_less_than_64_mb(spark, low, high):
    r = random.Random(low)
    lengths, used = [], 0
    while True:
        n = r.randint(low, high)
        used += min(n / 5 + 16, 72) * decontam.WINDOW_BYTES + 32 * n
        if used > 1.25 * decontam.SLICE_BYTES or len(lengths) == 700:
            break
        lengths.append(n)
    index = decontam.Index(list(range(len(lengths))), [" ".join(r.choices(WORDS, k=n)) for n in lengths])
    told = spark.createDataFrame([(n,) for n in lengths], "n int").agg(decontam.F.sum(decontam._index_bytes(decontam.F.col("n")))).first()[0]
    tables = len(index.classes) * 4 * 4 * (2**16 + 1)
    assert held_bytes(index) <= told + tables and held_bytes(index) < 64_000_000
    assert len(index.classes) <= 24


def test_number_of_window_sizes_does_not_follow_the_lengths():
    sizes = {decontam._window(n)[:2] for n in range(1, 20_001)}
    assert len(sizes) <= 32
    assert max(len(decontam._window(n)[2]) for n in range(1, 20_001)) <= 72


def test_every_unchanged_run_holds_an_indexed_window_wherever_it_starts():
    for n in (*range(5, 300), 361, 541, 800, 1234, 5000):
        g, size, starts = decontam._window(n)
        run = n - max(0, n - 4) // 5
        held = np.zeros(n + 1, bool)
        held[starts] = True
        for phase in range(g):
            own = np.flatnonzero(held & (np.arange(n + 1) % g == phase))
            first = own[np.minimum(np.searchsorted(own, np.arange(n - run + 1)), len(own) - 1)]
            assert (first >= np.arange(n - run + 1)).all() and (first + size <= np.arange(n - run + 1) + run).all(), (n, phase)


def test_long_items_with_edited_ends_and_edits_inside():
    r = random.Random(5)
    planted = missed = inside = inside_missed = 0
    for n in (100, 150, 248, 300, 361, 700, 1500):
        item = r.choices(WORDS, k=n)
        index = decontam.Index([7], [" ".join(item)])
        for k in range(12):
            cut = r.randrange(n // 6)
            part = item[cut:] if k % 2 else item[: n - cut]
            if k % 3 == 2:
                part = list(item)
                for _ in range(max(1, n // 40)):
                    part[r.randrange(n)] = "edited"
            before = r.randrange(40)
            text = ["pad"] * before + part + ["pad"] * r.randrange(40)
            word, _ = shingles.words(pa.array([" ".join(text)]))
            starts = (max(0, before - (cut if k % 2 and k % 3 != 2 else 0) + d) for d in range(-8, 9))
            windows = [word[a : a + n] for a in starts] + [word[: len(word) - d] for d in range(min(n // 5, len(word)))] * (len(text) <= n) + [word[d:] for d in range(n // 5)] * (len(text) <= n)
            if max(shingles.probability_jaccard(shingles.weighted(*shingles.shingled(w, np.array([0, len(w)])))[:2], index.sets[0]) for w in windows) < 0.8:
                continue  # the filling around a cut part counts against it
            found = [m for m in index.matches(pa.array([" ".join(text)]), 0.8) if m[1] == 0]
            edits = k % 3 == 2
            inside += edits
            inside_missed += edits and not found
            planted += not edits
            missed += not edits and not found
    assert planted >= 50 and missed == 0
    assert inside_missed <= inside // 20
