import numpy as np
from hypothesis import given, settings, strategies as st

from arborix.kernels import bitmaps as B

SETS = st.one_of(
    st.sets(st.integers(0, B.BITS - 1), max_size=60),
    st.tuples(st.integers(0, B.BITS - 1), st.integers(0, 5_000)).map(lambda x: set(range(x[0], min(B.BITS, x[0] + x[1])))),
    st.integers(2, 7).map(lambda k: set(range(0, B.BITS, k))),
)


def box(s):
    return B.encode(np.array(sorted(s), np.int64))


@settings(max_examples=150, deadline=None)
@given(SETS, SETS)
def test_algebra(a, b):
    x, y = box(a), box(b)
    assert set(B.decode(x).tolist()) == a
    assert set(B.decode(B.union(x, y)).tolist()) == a | b
    assert set(B.decode(B.and_not(x, y)).tolist()) == a - b
    assert B.contains(y, np.array(sorted(a), np.int64)).tolist() == [v in b for v in sorted(a)]
    assert len(x) <= 1 + min(2 * max(len(a), 0), B.BITS // 8)


def test_containers():
    assert box({5, 900, 7_000})[:1] == B.ARRAY and box(range(100, 9_000))[:1] == B.RUNS and box(range(0, B.BITS, 3))[:1] == B.DENSE
    assert len(box(range(B.BITS))) == 5 and B.decode(box(range(B.BITS))).tolist() == list(range(B.BITS))


def test_build():
    ids = np.array([7, 40_000, 7, 8, 3, 7])
    got = B.build(ids, np.array([2, 2, 2, 2, 0, 2], np.int32), np.array([1, 1, 1, 1, 1, 5], np.int32))
    assert [(r, k, p, B.decode(c).tolist()) for r, k, p, c in got] == [(0, 0, 1, [3]), (0, 2, 1, [7, 8]), (0, 2, 5, [7]), (1, 2, 1, [7_232])]
