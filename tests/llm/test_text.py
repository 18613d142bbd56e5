import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import _text


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\té\x0b", max_size=12)), max_size=6))
def test_words_and_grams(texts):
    w = _text.Words(*_text.utf8(pa.array(texts, pa.string())))
    want = [(t or "").encode().split() for t in texts]
    assert w.count.tolist() == [len(x) for x in want]
    flat = [x for ws in want for x in ws]
    h = w.hashes()
    assert [w.data[a:b].tobytes() for a, b in zip(w.start, w.end)] == flat
    assert all((flat[i] == flat[j]) == (h[i] == h[j]) for i in range(len(flat)) for j in range(i))
    g, inside = w.grams(h, 2)
    places = [(d, k) for d, ws in enumerate(want) for k in range(len(ws))]
    grams = {}
    for i, (d, k) in enumerate(places):
        assert inside[i] == (k + 2 <= len(want[d]))
        if inside[i]:
            key = tuple(want[d][k : k + 2])
            assert grams.setdefault(key, g[i]) == g[i]
    assert len(set(grams.values())) == len(grams)


def test_slices_and_windows():
    batch = pa.RecordBatch.from_pydict({"t": ["a" * n for n in (5, 100, 3, 3, 3)]})
    parts = list(_text.slices(batch, "t", 10))
    assert [p.num_rows for p in parts] == [1, 1, 3]
    x = np.random.default_rng(0).integers(0, 9, 40)
    assert _text.sliding_min(x, 7).tolist() == [min(x[i : i + 7]) for i in range(40)]
    assert _text.sliding_max(x, 3).tolist() == [max(x[i : i + 3]) for i in range(40)]
