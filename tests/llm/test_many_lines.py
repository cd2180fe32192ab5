"""More lines in one text than a line number in a signature's sort key holds."""

import numpy as np

from lanewise.llm.line_dedup import keyed, signatures


def test_lines_beyond_twenty_bits():
    lines = [f"{i:08d}" for i in range(2**20 + 3)]
    last = None
    for at, key, size in keyed(lines):
        assert (size == 1).all()
        last = at, key
    for i in (2**20 - 1, 2**20, 2**20 + 2):
        if i >= last[0]:
            assert np.array_equal(last[1][i - last[0]], signatures([lines[i]])[0][0])
    assert last[0] + len(last[1]) == len(lines)
