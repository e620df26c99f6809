"""The index never misses its recall without a word."""

import numpy as np
import pytest

from shelfwise.llm import ann


def test_fewer_hashes_where_probes_do_not_suffice():
    sample = np.random.default_rng(3).normal(size=(600, 12))
    wide = ann.make_index(sample, 10)
    assert (wide.hashes, wide.probes <= ann.MOST_PROBES) == (ann.HASHES, True)
    narrow = ann.make_index(sample, 10, width=0.5)
    assert narrow.hashes < ann.HASHES and narrow.probes <= ann.MOST_PROBES
    with pytest.raises(ArithmeticError, match="recall"):
        ann.make_index(sample, 10, width=0.1)
