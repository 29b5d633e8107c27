import numpy as np
import pyarrow as pa
from brute import shingles as plain
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelake.llm import kernels

texts = st.lists(st.one_of(st.none(), st.text(alphabet="aAbB é\t\n\x0b ", max_size=24)), max_size=6)


@settings(max_examples=200, deadline=None)
@given(texts, st.integers(1, 5))
def test_shingle_sets_have_the_same_equalities(rows, width):
    data, offsets = kernels.string_buffers(pa.array(rows, pa.string()))
    got = []
    for i, j in kernels.slices(offsets, 16):
        h, bounds = kernels.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        run, owner = kernels.distinct(*kernels.shingles(h, bounds, width))
        got += [set(run[owner == k].tolist()) for k in range(j - i)]
    want = [plain(t, width) for t in rows]
    assert [len(g) for g in got] == [len(w) for w in want]
    for a, x in zip(got, want, strict=True):
        for b, y in zip(got, want, strict=True):
            assert len(a & b) == len(x & y)


def test_mix_is_one_to_one_on_a_sample():
    x = np.arange(100_000, dtype=np.uint64)
    assert len(np.unique(kernels.mix(x))) == len(x)


@settings(max_examples=100, deadline=None)
@given(texts, st.integers(1, 40), st.one_of(st.none(), st.integers(1, 3)))
def test_slices_cover_every_text_once(rows, most, bound):
    _, offsets = kernels.string_buffers(pa.array(rows, pa.string()))
    got = list(kernels.slices(offsets, most, bound))
    assert [k for i, j in got for k in range(i, j)] == list(range(len(rows)))
    assert all(j - i == 1 or offsets[j] - offsets[i] <= most for i, j in got)
    assert all(j - i <= (bound or len(rows)) for i, j in got)
