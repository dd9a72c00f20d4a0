import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sparktally.llm.words import NON_WORD, SPACE, shingles, slices, words_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAzZ09é日 \n\t.,!\x0b\x00", max_size=40)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_equal_the_patterns(texts):
    column = pa.array(texts, pa.string())
    for table, pattern in ((SPACE, "[^\x20\x09-\x0D]+"), (NON_WORD, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        found = words_of(column, table)
        got = [[found.word(i).decode() for i in range(a, b)] for a, b in zip(found.first[:-1], found.first[1:])]
        assert got == [re.findall(pattern, (t or "").translate(LOWER)) for t in texts]
        flat = [w for row in got for w in row]
        assert len({*zip(flat, found.hashes.tolist())}) == len(set(flat)) == len(set(found.hashes.tolist()))


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_shingles_are_those_of_rows(texts):
    found = words_of(pa.array(texts, pa.string()), SPACE)
    hashes, at = shingles(found.hashes, found.first, 3)
    seen = {}
    for row, text in enumerate(texts):
        w = tuple((text or "").translate(LOWER).split())
        expected = [w[i:i + 3] for i in range(len(w) - 2)] or ([w] if w else [])
        w = hashes[at[row]:at[row + 1]].tolist()
        if "\x00" in (text or "") or "\x0b" in (text or ""):
            continue
        assert len(w) == len(expected)
        for h, e in zip(w, expected):
            assert seen.setdefault(h, e) == e


def test_slices_cover_all_rows_and_long_words_hash():
    batch = pa.record_batch([pa.array(["a" * 10, None, "b" * 1000, "", "c"])], ["text"])
    assert [s.num_rows for s in slices(batch, "text", 100)] == [2, 1, 2]
    big = "q" * 700_000
    found = words_of(pa.array([big + " x " + big, big[:-1] + "r"]), SPACE)
    assert found.hashes[0] == found.hashes[2] != found.hashes[3] and len(found.hashes) == 4
    assert np.array_equal(found.first, [0, 3, 4])
