import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import blobs, spans
from sparkloom.llm.components import Forest
from sparkloom.llm import repeats
from sparkloom.llm.repeats import Units, covered, factors, matches

texts = st.lists(st.text(alphabet="ab \n\té,", max_size=30) | st.none(), max_size=12)


@settings(max_examples=200, deadline=None)
@given(texts)
def test_split_and_hash_follow_the_words(held):
    data, offsets = spans.bytes_of(pa.array(held, pa.string()))
    begin, end, text = spans.split(data, offsets)
    raw = data.tobytes()
    wanted = [(i, w) for i, t in enumerate(held) for w in re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode())]
    assert [(i, raw[a:b]) for i, a, b in zip(text.tolist(), begin.tolist(), end.tolist(), strict=True)] == wanted
    hashes = spans.hash_spans(data, begin, end).tolist()
    assert len({(w, h) for (_, w), h in zip(wanted, hashes, strict=True)}) == len({w for _, w in wanted}) == len(set(hashes))


@settings(max_examples=100, deadline=None)
@given(texts, st.integers(1, 40))
def test_slices_cover_all_rows(held, most):
    _, offsets = spans.bytes_of(pa.array(held, pa.string()))
    cut = list(spans.slices(offsets, most))
    assert [i for i, j in cut for i in range(i, j)] == list(range(len(held)))
    assert all(offsets[j] - offsets[i] <= most or j == i + 1 for i, j in cut)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=40), st.integers(1, 8))
def test_leftmost_minima(values, width):
    least, place = spans.leftmost_minima(np.array(values, np.uint64), width)
    windows = [values[i : i + width] for i in range(len(values) - width + 1)]
    assert least.tolist() == [min(w) for w in windows] and place.tolist() == [i + w.index(min(w)) for i, w in enumerate(windows)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 6))
def test_equal_windows_have_equal_hashes(values, width):
    hashes = spans.hash_windows(np.array(values, np.uint64), width).tolist()
    windows = [tuple(values[i : i + width]) for i in range(len(values) - width + 1)]
    assert len(set(zip(windows, hashes, strict=True))) == len(set(windows)) == len(set(hashes))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(-9, 9)), max_size=30))
def test_blobs_round_trip(rows):
    group, values = np.array([g for g, _ in rows], np.int64), np.array([v for _, v in rows], np.int64)
    out = blobs.packed(group, values=values, pairs=np.stack([values, -values], axis=1))
    table = pa.table(out)
    assert blobs.unpacked(table["values"], np.int64).tolist() == [v for g in sorted(set(group.tolist())) for h, v in rows if h == g]
    assert (blobs.unpacked(table["pairs"], np.int64).reshape(-1, 2).sum(axis=1) == 0).all()


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 20), st.lists(st.tuples(st.integers(0, 19), st.integers(0, 19)), max_size=40))
def test_forest(n, edges):
    edges = [(a % n, b % n) for a, b in edges]
    forest = Forest(n)
    forest.union(np.array([a for a, _ in edges], np.int64), np.array([b for _, b in edges], np.int64))
    label = list(range(n))
    for _ in range(n):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert forest.roots(np.arange(n)).tolist() == label


def test_matches_go_on_in_step_and_factors_cover_them():
    units = Units(spans.split, 3, 1, keep_first=False)
    runs = [np.array(x) for x in ([4, 1, 6, 12], [2, 2, 1, 1], [9, 9, 9, 9], [104, 50, 200, 300])]
    begin, size, block, other = matches(units, *runs)
    assert begin.tolist() == [1, 4, 6, 12] and size.tolist() == [4, 4, 3, 3] and other.tolist() == [50, 104, 200, 300]
    chosen = factors(begin, size)
    assert begin[chosen].tolist() == [1, 4, 6, 12] and np.flatnonzero(covered(begin[chosen], size[chosen], 20)).tolist() == [*range(1, 9), 12, 13, 14]
    begin, size, _, _ = matches(units, *(np.array(x) for x in ([1, 3], [2, 2], [9, 9], [50, 52])))
    assert begin.tolist() == [1] and size.tolist() == [6]  # one match, from two runs that go on
    assert not len(factors(*matches(units, *(np.zeros(0, np.int64),) * 4)[:2]))


def test_the_greedy_parse_takes_the_farthest_reaching_match():
    begin, size = np.array([0, 0, 2, 3, 9, 20]), np.array([8, 5, 9, 4, 3, 4])
    assert factors(begin, size).tolist() == [0, 2, 4, 5]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 12)), max_size=25))
def test_factors_cover_what_all_matches_cover_and_none_is_idle(pairs):
    pairs = sorted(pairs, key=lambda x: (x[0], -x[1]))
    begin, size = np.array([a for a, _ in pairs], np.int64), np.array([b for _, b in pairs], np.int64)
    chosen = factors(begin, size)
    whole = covered(begin, size, 50)
    assert (covered(begin[chosen], size[chosen], 50) == whole).all()
    for k in range(len(chosen)):
        rest = np.delete(chosen, k)
        assert (covered(begin[rest], size[rest], 50) != whole).any()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=4, max_size=60))
def test_every_unit_of_a_match_equals_its_reference(words):
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    units, offsets = Units(spans.split, 4, 2, keep_first=False), np.array([0, len(data)])
    anchors = repeats._anchor_entries(units, data, offsets, np.zeros(1, np.int64), 7)
    held = repeats._window_entries(units, data, offsets, np.zeros(1, np.int64), 7, anchors.place)
    found, rest = repeats.merge(held, False)
    begin, size, block, other = matches(units, *repeats.runs_of(found, 1)[1:])
    assert all(words[b : b + n] == words[o : o + n] and b != o for b, n, o in zip(begin.tolist(), size.tolist(), other.tolist()))
    windows = [tuple(words[i : i + 4]) for i in range(len(words) - 3)]
    wanted = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(4)}
    chosen = factors(begin, size)
    assert set(np.flatnonzero(covered(begin[chosen], size[chosen], len(words))).tolist()) == wanted


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_patterns_of_bytes_and_words_do_not_collide():
    one = thue_morse(1024)
    other = one.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer((one + other).encode(), np.uint8)
    for lane in (0, 1):
        a, b = spans.hash_spans(data, np.array([0, 1024]), np.array([1024, 2048]), lane)
        assert a != b
        units = spans.hash_spans(data, np.arange(2048), np.arange(2048) + 1, lane)
        assert spans.hash_windows(units[:1024], 1024, lane)[0] != spans.hash_windows(units[1024:], 1024, lane)[0]


def test_long_spans_are_told_apart_to_their_ends():
    r = np.random.default_rng(0)
    data = r.integers(97, 122, 30_000).astype(np.uint8)
    both = np.concatenate([data, data])
    both[-1] ^= 1
    at = np.array([0, 30_000])
    assert spans.hash_spans(both, at, at + 29_999)[0] == spans.hash_spans(both, at, at + 29_999)[1]
    assert spans.hash_spans(both, at, at + 30_000)[0] != spans.hash_spans(both, at, at + 30_000)[1]
