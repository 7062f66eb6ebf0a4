from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from marketloom.llm import lm
from marketloom.llm.packed import by_range, pack, range_count, steps, unpack
from marketloom.llm.tokens import pieces


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_blocks_come_back_whole(n):
    r = np.random.default_rng(n)
    wide = np.sort(r.integers(0, 2**64, n, dtype=np.uint64))
    small = r.integers(0, 3, n)
    first, second, none = unpack(pack(steps(wide), small, np.zeros(n, np.uint64)))
    assert (np.cumsum(first, dtype=np.uint64) == wide).all() and (second == small).all() and (none == 0).all()
    assert len(first) == len(none) == n


def test_ranges_hold_every_place_once():
    keys = np.random.default_rng(3).integers(0, 2**64, 1000, dtype=np.uint64)
    parts = dict(by_range(keys, 64))
    assert sorted(np.concatenate(list(parts.values())).tolist()) == list(range(1000))
    assert all((keys[at] % np.uint64(64) == r).all() and (np.diff(at) > 0).all() for r, at in parts.items())
    assert (range_count(0), range_count(2**28), range_count(2**28 + 1), range_count(2**30)) == (64, 64, 128, 256)


@pytest.mark.parametrize("size", [3, 7, 1_000_000])
@pytest.mark.parametrize("order", [2, 3])
def test_stretches_cut_long_texts_without_losing_ngrams(monkeypatch, size, order):
    """Texts longer than a stretch, words outside the common ones and many blocks of one range count like one whole."""
    monkeypatch.setattr(lm, "STRETCH", size)
    r = np.random.default_rng(5)
    texts = [" ".join(f"w{i}" for i in r.integers(0, 12, n)) for n in (0, 1, 2, 7, 8, 9, 200)]
    want = Counter()
    for t in texts:
        k = lm.token_keys(next(iter(pieces(pa.array([t])))))[0].tolist()
        want.update(tuple(k[i : i + order]) for i in range(len(k) - order + 1))
    common = SimpleNamespace(value=np.array(sorted({w for g in want for w in g})[:5], np.uint64))
    rows = [b for b in lm._pack_grams(order, common, 4)(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]))]
    blocks = pa.Table.from_batches(rows)
    got = {}
    for i in range(4):
        part = blocks.filter(pc.equal(blocks.column("r"), i))
        if len(part):
            out = lm._unpack_grams(common, 2)(part).to_pydict()
            got |= dict(zip(out["k"], zip(out["a"], out["b"], out["n"], strict=True), strict=True))
    expected = {}
    for g, n in want.items():
        if n >= 2:
            a, b, k = (int(x.view(np.int64)[0]) for x in lm.parted(*[np.array([w], np.uint64) for w in g]))
            expected[k] = (a, b, n)
    assert got == expected and expected


def test_pairs_of_texts_and_keys():
    r = np.random.default_rng(3)
    t, w = np.sort(r.integers(0, 9, 500)), r.integers(0, 2**63, 40, dtype=np.uint64)[r.integers(0, 40, 500)] * np.uint64(2)
    got = list(zip(*(x.tolist() for x in lm.distinct_pairs(t, w)), strict=True))
    want = Counter(zip(w.tolist(), t.tolist(), strict=True))
    assert got == [(b, a, n) for (a, b), n in sorted(want.items())]


@pytest.mark.parametrize("count", [64, 1 << 17])
def test_ranges_keep_the_order_given(count):
    keys = np.random.default_rng(5).integers(0, 2**63, 3000, dtype=np.uint64)
    got = {r: at.tolist() for r, at in by_range(keys, count)}
    want = {}
    for i, k in enumerate(keys.tolist()):
        want.setdefault(k % count, []).append(i)
    assert got == want


def test_token_keys_whatever_the_parts(monkeypatch):
    """Texts hashed in small parts, empty ones and one longer than a part among them, have the keys and borders of each text alone."""
    texts = ["", "a B  c", None, "lang " * 30, "", "é x", " ", "b"]
    alone = [lm.token_keys(next(iter(pieces(pa.array([t], pa.string())))))[0].tolist() for t in texts]
    for size in (1, 5, 40, 1 << 17):
        monkeypatch.setattr(lm, "CACHED", size)
        keys, borders = lm.token_keys(next(iter(pieces(pa.array(texts)))))
        assert [keys[i:j].tolist() for i, j in zip(borders[:-1], borders[1:], strict=True)] == alone
