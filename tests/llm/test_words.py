import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sheaf.llm import words

TEXTS = st.lists(st.one_of(st.none(), st.text(st.sampled_from("aAbé \t\n\x0b\x0c\r\x1c 😀#"), max_size=30)), max_size=12)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.sampled_from([1, 7, 1 << 20]), st.sampled_from([pa.string(), pa.large_string()]))
def test_words_of_a_column(texts, block_bytes, kind):
    got = {}
    for b in words.blocks(pa.array(texts, kind), block_bytes):
        for i, s in b.rows():
            got[i] = [bytes(b.data[x:y]).decode() for x, y in zip(b.starts[s], b.ends[s])]
    assert got == {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in enumerate(texts)}


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_equal_words_have_equal_hashes_wherever_they_are(texts):
    seen = {}
    for block_bytes in (1, 1 << 20):
        for b in words.blocks(pa.array(texts, pa.string()), block_bytes):
            for w, h in zip((bytes(b.data[x:y]).lower() for x, y in zip(b.starts, b.ends)), b.hashes(lower=True).tolist()):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_sliced_columns_and_windows():
    column = pa.array(["a b", None, "c d e", "f"]).slice(1, 2)
    blocks = list(words.blocks(column))
    assert [len(b.starts) for b in blocks] == [3]
    h = blocks[0].hashes()
    assert len(words.windows(h, 2)) == 2 and len(words.windows(h, 5)) == 1 and len(words.windows(h[:0], 5)) == 0
    assert len(np.unique(words.windows(h, 2))) == 2
