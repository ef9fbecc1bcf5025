import random
from bisect import bisect_left
from fractions import Fraction

import pytest

from strataline.plans import pgm


def fits(keys, first, last, epsilon):
    least, most = None, None
    for p in range(first, last + 1):
        for q in range(p + 1, last + 1):
            a = Fraction(max(0, q - epsilon) - (p + epsilon), keys[q] - keys[p])
            b = Fraction(q + epsilon - max(0, p - epsilon), keys[q] - keys[p])
            least = a if least is None else max(least, a)
            most = b if most is None else min(most, b)
    return least is None or least <= most


# The line through these keys and its rounded intercept
def test_rounding_gap_literals():
    (s,) = pgm.build([0, 1, 2, 9], 1).segments
    assert (s.slope_num, s.slope_den, s.intercept) == (3, 7, 0)
    assert (s.slope_num, s.origin_num, s.denominator) == (3, 1, 7)
    assert s.predict(2) == 0


@pytest.mark.parametrize("seed", range(60))
def test_segments_are_maximal_and_searches_hold(seed):
    rng = random.Random(seed)
    keys = sorted(rng.sample(range(-50, rng.choice([10, 60, 200, 5000])), rng.randint(1, 25)))
    epsilon = rng.choice([0, 1, 2, 3, 5])
    index = pgm.build(keys, epsilon)
    starts, at = [], 0
    while at < len(keys):
        end = at
        while end + 1 < len(keys) and fits(keys, at, end + 1, epsilon):
            end += 1
        starts.append(at)
        at = end + 1
    assert [s.start_rank for s in index.segments] == starts
    for rank, key in enumerate(keys):
        assert [s for s in index.segments if s.start_rank <= rank][-1].certifies(key, rank, epsilon)
    for q in range(keys[0] - 2, keys[-1] + 3):
        _, lo, hi = index.search(q)
        assert lo <= bisect_left(keys, q) <= hi


@pytest.mark.parametrize(("power", "epsilon"), [(1, 0), (9, 2), (20, 1), (30, 4), (60, 0), (61, 3)])
def test_wide_keys(power, epsilon):
    """Keys on both sides of zero, in steps that grow, up to the ends of 63 bits."""
    keys = sorted({s * (2 ** (power * i // 9) + i) for i in range(10) for s in (-1, 1)})
    index = pgm.build(keys, epsilon)
    for i, k in enumerate(keys):
        _, lo, hi = index.search(k)
        assert lo <= i <= hi


def test_steps_do_not_matter_and_input_is_checked():
    keys = sorted(random.Random(5).sample(range(10_000), 300))
    builder = pgm.IndexBuilder(2)
    for a in range(0, 300, 7):
        builder.extend(keys[a : a + 7])
    assert builder.index().segments == pgm.build(keys, 2).segments
    assert pgm.build([], 1).search(5) == (0, 0, 0)
    with pytest.raises(pgm.KeyOrder):
        pgm.build([1, 1], 0)
    with pytest.raises(ValueError):
        pgm.build([1], True)


@pytest.mark.parametrize(("epsilon", "count"), [(0, 12), (1, 2), (2, 2), (3, 1)])
def test_cubes(epsilon, count):
    assert len(pgm.build(sorted({n**3 % 101 for n in range(25)}), epsilon).segments) == count


def test_tables_of_keys_are_searched_as_single_keys(spark):
    rng, epsilon = random.Random(12), 2
    runs = {0: sorted(rng.sample(range(-500, 500), 120)), 1: sorted({n**3 % 1009 for n in range(300)}), 2: [-(2**62), -5, 0, 7, 2**62], 3: [4]}
    keys = spark.createDataFrame([(lv, k) for lv, ks in runs.items() for k in ks], "level int, key long")
    asked = [(lv, q) for lv, ks in runs.items() for k in ks for q in (k - 1, k, k + 1)] + [(0, -(2**62)), (1, 2**62), (9, 1)]
    found = pgm.search_rows(spark.createDataFrame(asked, "level int, key long").distinct(), pgm.build_levels(keys, epsilon)).collect()
    assert len(found) == len(set(asked))
    for r in found:
        if r["level"] in runs:
            assert (r["pos"], r["lo"], r["hi"]) == pgm.build(runs[r["level"]], epsilon).search(r["key"]), r
        else:
            assert (r["pos"], r["lo"], r["hi"]) == (0, 0, 0)
    builder = pgm.IndexBuilder(epsilon)
    closed = [s for k in runs[0] for s in (builder.add(k), builder.drain())[1]]
    assert [*closed, builder.open.close()] == pgm.build(runs[0], epsilon).segments
    assert builder.diagnostics()["active_span"] == len(runs[0]) - builder.open.first[1]
    wrong = pgm.band_violations(spark.createDataFrame([(0, k, i + (50 if i == 60 else 0)) for i, k in enumerate(runs[0])], "level int, key long, rank long"), pgm.build_levels(keys, epsilon), epsilon)
    assert [r["rank"] for r in wrong.collect()] == [110]


@pytest.mark.parametrize("seed", range(40))
def test_repeated_keys_have_lower_bounds_in_their_windows(seed):
    rng = random.Random(seed)
    counts = {k: rng.choice([1, 1, 2, 3, 60]) for k in rng.sample(range(-40, rng.choice([10, 60, 3000])), rng.randint(1, 40))}
    rows = sorted(k for k, n in counts.items() for _ in range(n))
    epsilon = rng.choice([0, 1, 2, 5])
    builder = pgm.IndexBuilder(epsilon)
    for k in sorted(counts):
        builder.add(k, counts[k])
    index = builder.index()
    for q in {q for k in counts for q in (k - 1, k, k + 1, k + 2)} | set(range(-45, 65)):
        _, lo, hi = index.search(q)
        assert lo <= bisect_left(rows, q) <= hi <= lo + 2 * epsilon + 2, q
    for k in counts:
        assert [s for s in index.segments if s.start_key <= k][-1].certifies(k, bisect_left(rows, k), epsilon)
    ends = [(s.start_rank, s.end_rank, s.end_key) for s in index.segments]
    assert ends[0][0] == 0 and ends[-1][1:] == (len(rows) - 1, rows[-1]) and all(b[0] == a[1] + 1 for a, b in zip(ends, ends[1:]))
    assert all(rows[b] == key for _, b, key in ends)


def test_tables_of_repeated_keys_are_built_as_single_keys(spark):
    rows = [(lv, k) for lv in (0, 1) for k in range(0, 300, 3) for _ in range(1 + (k * 7 + lv) % 4)]
    got = pgm.build_levels(spark.createDataFrame(rows, "level int, key long"), 1).orderBy("level", "segment").collect()
    for lv in (0, 1):
        builder = pgm.IndexBuilder(1)
        for k in range(0, 300, 3):
            builder.add(k, 1 + (k * 7 + lv) % 4)
        index = builder.index()
        assert [(r["start_key"], r["start_rank"], r["end_key"], r["end_rank"], r["n"]) for r in got if r["level"] == lv] == [(s.start_key, s.start_rank, s.end_key, s.end_rank, index.n) for s in index.segments]


def test_wrong_ranks_of_repeated_keys_are_found(spark):
    rows = [(0, k) for k in range(0, 200, 2) for _ in range(1 + 30 * (k % 3 == 0))]
    segments = pgm.build_levels(spark.createDataFrame(rows, "level int, key long"), 2)
    wrong = lambda off: [tuple(r) for r in pgm.band_violations(spark.createDataFrame([(lv, k, i + off.get(i, 0)) for i, (lv, k) in enumerate(rows)], "level int, key long, rank long"), segments, 2).collect()]
    assert rows[100] == (0, rows[99][1]) == rows[101]
    assert wrong({}) == []
    assert wrong({100: 1000}) == [(0, rows[100][1], rows.index(rows[100]))]
