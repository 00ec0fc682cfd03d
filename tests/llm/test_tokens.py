import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import tokens

PATTERNS = [(tokens.ALNUM, rb"[0-9a-z\x80-\xff]+"), (tokens.NONBLANK, rb"[^\x20\x09-\x0d]+")]


def fold(text):
    return re.sub(rb"[A-Z]+", lambda m: m[0].lower(), text)


@settings(deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abZ éß\n\t.9\x1f", max_size=30).map(str.encode)), max_size=6), st.integers(1, 40))
def test_words_and_hashes(texts, most):
    column = pa.array(texts, pa.binary())
    for keep, pattern in PATTERNS:
        rows = []
        for lo, hi, buf, offsets in tokens.slices(column, most):
            starts, ends, first = tokens.bounds(buf, offsets, keep)
            found = tokens.hashes(buf, starts, ends)
            for k in range(hi - lo):
                ws = [fold(bytes(buf[a:b])) for a, b in zip(starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]])]
                assert [tokens.word_hash(w) for w in ws] == found[first[k] : first[k + 1]].tolist()
                rows.append(ws)
        assert rows == [re.findall(pattern, fold(t or b"")) for t in texts]
        assert rows == [tokens.words(t, keep) for t in texts]


def test_long_words_and_blocks():
    buf = np.frombuffer(b"ab " * 10 + b"x" * (tokens.BLOCK + 5) + b" ab", np.uint8)
    starts, ends, _ = tokens.bounds(buf, np.array([0, len(buf)]), tokens.NONBLANK)
    found = tokens.hashes(buf, starts, ends)
    assert found[0] == found[-1] == np.uint64(tokens.word_hash(b"ab"))
    assert len(np.unique(found)) == 2
