"""Fragment signatures: unrelated sets share none, linked sets share one at least."""

import numpy as np
import pytest

from sievenet.llm.jaccard import Signatures


def drawn(rng, n):
    return np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))


@pytest.mark.parametrize("numerator", [80, 90])
@pytest.mark.parametrize("size", [80, 400, 600])
def test_unrelated_sets_share_no_signature(numerator, size):
    rng = np.random.default_rng(size)
    signatures = Signatures(numerator, 100)
    every = np.concatenate([np.unique(signatures.of(drawn(rng, int(size * f)))) for f in np.linspace(0.8, 1.2, 60)])
    assert len(np.unique(every)) >= 0.995 * len(every)


@pytest.mark.parametrize("numerator", [80, 90])
def test_linked_sets_share_a_signature(numerator):
    rng = np.random.default_rng(numerator)
    signatures = Signatures(numerator, 100)
    for size in [*range(1, 40), 100, 333, 1000]:
        for _ in range(20):
            one = drawn(rng, size)
            gone = rng.integers(0, size - (numerator * size + 99) // 100 + 1)  # left out of the second set: still at the threshold
            two = np.delete(one, rng.choice(len(one), gone, replace=False))
            while True:  # and as many new ones as the threshold allows
                wider = np.append(two, drawn(rng, 1))
                if 100 * len(two[np.isin(two, one)]) < numerator * (len(one) + len(wider) - len(two[np.isin(two, one)])):
                    break
                two = wider
            if np.array_equal(one, np.sort(two)):
                continue  # equal sets are one class, without signatures
            assert np.intersect1d(signatures.of(np.sort(one)), signatures.of(np.sort(two))).size
