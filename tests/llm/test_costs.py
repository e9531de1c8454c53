"""What the operators' inner steps do at once gives what one by one gives."""

import numpy as np
import pytest

from tessera.llm import maxent_lm, media, suffixes


def test_tokens_of_many_texts_are_those_of_each():
    texts = [b"One two  three", None, b"", b"   ", b"x" * 70_000, b"a b " * 40_000, "naïve\ttext\n".encode(), b"end"]
    found, sizes = maxent_lm.tokens_of(texts)
    each = [maxent_lm.tokens(t) for t in texts]
    assert sizes.tolist() == [len(x) for x in each] and (found == np.concatenate(each)).all()
    assert all(x[-1] == maxent_lm.END for x in each) and len(each[0]) == 4 and len(each[5]) == 80_001
    assert maxent_lm.tokens(b"one")[0] == found[0]


@pytest.mark.parametrize("n", [1, maxent_lm.CHUNK, maxent_lm.CHUNK + 5])
def test_logs_in_chunks_are_those_of_a_plain_softmax(n):
    rng = np.random.default_rng(n)
    rows = [rng.integers(0, 50, n) for _ in range(2)]
    weights = [rng.normal(size=(50, 32)).astype(np.float32) for _ in rows]
    bias, target = rng.normal(size=(n, 32)).astype(np.float32), rng.integers(0, 32, n)
    z = (weights[0][rows[0]] + weights[1][rows[1]] + bias).astype(float)
    want = z[np.arange(n), target] - np.log(np.exp(z).sum(1))
    assert np.allclose(maxent_lm.chosen_log(rows, weights, bias, target), want, atol=1e-4)


def test_common_prefixes_of_at_least_span_are_exact():
    rng = np.random.default_rng(3)
    part = rng.integers(2, 5, 300)
    s = np.concatenate([part, rng.integers(2, 5, 90), [1], part[20:290], [1], part[:150], [1, 0]]).astype(np.int32)
    order = suffixes.suffix_array(s, 258)
    (b1, exact), (b2, least) = suffixes.common_prefixes(s, order, 700), suffixes.common_prefixes(s, order, 700, 200)
    assert (b1 == b2).all() and (exact >= 200).any() and ((exact >= 200) == (least >= 200)).all() and (least[exact >= 200] == exact[exact >= 200]).all()


def test_code_lengths_read_together_are_those_read_one_by_one():
    rng = np.random.default_rng(5)
    inner = media.Inner(19, sum(int(media._INNER[s]) << 3 * k for k, s in enumerate(media.CODE_LENGTH_ORDER)))
    for w in rng.integers(0, 1 << 16, 500).tolist():
        bits, found, last = inner.several(w)
        at, each, before = 0, [], 0
        while at < bits:
            n, value, times = inner.one(w >> at, before)
            at, each, before = at + n, each + [value] * times, value or before
        assert at == bits <= 16 and list(found) == each and last == before
    fields, sizes = media._runs()
    for value, run in ((0, 1), (0, 139), (0, 280), (7, 1), (9, 9), (15, 30)):
        words, bits = media._run(value, run)
        k = value * (media.LONGEST_RUN + 1) + run
        assert sizes[k] == sum(bits) and fields[k] == sum(x << sum(bits[:i]) for i, x in enumerate(words))


@pytest.mark.parametrize("mode", range(14))
def test_rows_predicted_at_once_are_those_predicted_run_by_run(mode):
    px = np.random.default_rng(mode).integers(0, 1 << 32, 16 * 37, dtype=np.uint32)
    modes = np.array([mode, 11, mode], np.uint32) << np.uint32(8)
    assert (media.unpredicted(media.residuals(px, 16, 4, modes), 16, 37, 4, modes) == px).all()


def test_small_images_read_in_turn_are_those_read_as_vectors(monkeypatch):
    files = [media.store(bytes(range(32, 32 + k)) * (k % 9 + 1))[0] for k in range(1, 90)]
    found = [media.load_parts(x) for x in files]
    for few in (0, 1 << 20):
        monkeypatch.setattr(media, "FEW_PIXELS", few)
        assert [media.load_parts(x) for x in files] == found
