import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomstone.functions import contexts, jvm, numeric, ppm, rans, tokens, transforms

RNG = np.random.default_rng(42)
SAMPLES = [
    b"", b"a", b"ab", b"aaaaaaa", bytes(range(256)) * 3, RNG.integers(0, 256, 5000, dtype=np.uint8).tobytes(), RNG.integers(0, 45, 3001, dtype=np.uint8).tobytes(),
    b"the quick brown fox " * 200, (1000 + 10 * np.sin(np.arange(3000) / 50)).astype("<f4").tobytes() + b"xyz", bytes([0xE8, 1, 2, 3, 4, 0xE9, 0xE8, 5, 6, 7, 8, 9]) * 20, b"\0" * 1000,
]


def test_golden_vectors():
    assert transforms.bwt(b"banana") == (b"nnbaaa", [3])
    first, state = transforms.delta(bytes([10, 20, 30]), 1)
    second, _ = transforms.delta(bytes([15, 25, 35]), 1, state)
    assert list(first) == [10, 10, 10] and list(second) == [241, 10, 10]
    assert transforms.delta(np.array([1, 2, 3], "<f4").tobytes(), 4)[0].hex() == "0000803f0000800100004000"
    a = bytes(range(0, 12))
    assert list(transforms.transpose(a, 4)) == [0, 4, 8, 1, 5, 9, 2, 6, 10, 3, 7, 11]
    assert list(transforms.transpose(bytes(range(10)), 4)) == [0, 4, 8, 1, 5, 9, 2, 6, 3, 7]
    assert tokens.FIRST_REPS == (1, 4, 8)
    assert transforms.bcj_x86(bytes([0xE8, 1, 0, 0, 0, 7])) == bytes([0xE8, 6, 0, 0, 0, 7])


@pytest.mark.parametrize("data", SAMPLES)
def test_transforms_come_back(data):
    for s in (0, 1, 2, 3, 4, 8, 12, 16):
        assert transforms.undelta(transforms.delta(data, s)[0], s)[0] == data
        assert transforms.untranspose(transforms.transpose(data, s), s) == data
    for channels in (1, 2, 3):
        for bits in (16, 32, 64):
            coded, order = transforms.word_delta(data, channels, bits)
            assert transforms.word_undelta(coded, channels, bits, order) == data and len(coded) == len(data)
    coded, rows = transforms.bwt(data)
    assert transforms.unbwt(coded, rows) == data
    for channels in (1, 2, 3):
        for bits in (8, 16, 24, 32):
            assert transforms.audio_undelta(transforms.audio_delta(data, channels, bits), channels, bits) == data
        coded, masks = transforms.float_channel_split(data, channels)
        assert transforms.float_channel_join(coded, channels, masks) == data
    sizes = transforms.plane_sizes(len(data), 3)
    assert transforms.planes_undelta(transforms.planes_delta(data, sizes), sizes) == data
    for stack in (transforms.Stack(stride=4), transforms.Stack(bwt=True), transforms.Stack(stride=3, bwt=True, filter="bcj_x86"), transforms.Stack(filter="float_split"), transforms.Stack(filter="rgb_split"), transforms.Stack(filter="rgba_delta"), transforms.Stack(filter="float_channel_split", channels=2), transforms.Stack(filter="audio_delta", channels=2, bit_depth=16)):
        coded, done = transforms.apply_stack(data, stack)
        assert transforms.undo_stack(coded, transforms.Stack.of_row(done.as_row())) == data


def test_carried_delta_is_that_of_the_whole():
    data = SAMPLES[5]
    parts, state = [], b""
    for at in range(0, len(data), 333):
        part, state = transforms.delta(data[at : at + 333], 4, state)
        parts.append(part)
    assert b"".join(parts) == transforms.delta(data, 4)[0]


def test_delta_only_where_it_helps():
    ramp = bytes(i % 256 for i in range(5000))
    assert transforms.delta_if_lower(ramp, 1) == (transforms.delta(ramp, 1)[0], True)
    assert transforms.delta_if_lower(SAMPLES[6], 1)[1] is False


def test_bwt_over_chunks(monkeypatch):
    monkeypatch.setattr(transforms, "BWT_CHUNK", 100)
    coded, rows = transforms.bwt(SAMPLES[7])
    assert len(rows) == 40 and transforms.unbwt(coded, rows) == SAMPLES[7]


def test_unknown_and_own_filters():
    with pytest.raises(KeyError):
        transforms.apply_stack(b"x", transforms.Stack(filter="nothing"))
    with pytest.raises(ValueError):
        transforms.register_filter("none", None, None)
    transforms.register_filter("test_invert", lambda d, s: (bytes(255 - b for b in d), s), lambda d, s: bytes(255 - b for b in d))
    coded, s = transforms.apply_stack(b"abc", transforms.Stack(filter="test_invert"))
    assert transforms.undo_stack(coded, s) == b"abc" and coded != b"abc"
    del transforms.FILTERS["test_invert"]


def test_statistics():
    assert numeric.entropy(b"") == 0 and numeric.entropy(bytes(range(256))) == pytest.approx(8)
    assert numeric.order1_entropy(b"abababab") == pytest.approx(0, abs=1e-9)
    assert numeric.log2_fixed8(0) == 0 and numeric.log2_fixed8(1) == 0 and numeric.log2_fixed8(4096) == 12 << 8
    for n in (3, 5, 1000, 65535, 2**31):
        assert abs(numeric.log2_fixed8(n) / 256 - math.log2(n)) < 0.01
        assert 0 <= math.log2(n) * 65536 - numeric.log2_fixed16(n) < 1.01
    assert abs(numeric.integer_entropy(SAMPLES[6]) / 256 - numeric.entropy(SAMPLES[6])) < 0.05
    assert numeric.dominant_byte(b"aab") == 97 and numeric.dominant_byte(b"abcd") is None and numeric.dominant_byte(b"") is None
    assert numeric.dominant_byte(b"bbaa") == 97
    assert numeric.autocorrelation(b"\x05" * 50, 3) == 1.0 and numeric.autocorrelation(b"ab", 1) == 0.0
    wave = np.tile(np.array([0, 50, 100, 200], np.uint8), 100).tobytes()
    assert numeric.file_stride(wave) == 4 and numeric.chunk_stride(wave) == 4 and numeric.file_stride(wave[:20]) is None
    assert not numeric.bcj_helps(b"MZ" + SAMPLES[5]) and not numeric.bcj_helps(b"short")


def test_bcj_helps_on_calls_to_one_place():
    code = bytearray()
    for i in range(3000):
        code += bytes([0x90, 0xE8]) + ((0x4000 - (len(code) + 6)) & 0xFFFFFFFF).to_bytes(4, "little")
    assert numeric.bcj_helps(bytes(code))


@pytest.mark.parametrize("name", list(tokens.LEVELS))
def test_tokens_come_back(name):
    for data in SAMPLES:
        parsed = tokens.parse(data, tokens.LEVELS[name])
        assert tokens.expand(parsed) == data
        streams, extra = tokens.separate(parsed)
        assert tokens.rejoin(streams, extra, len(parsed)) == parsed
        assert all(4 <= length <= tokens.LONGEST for kind, _, length in parsed if kind)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([b"ab", b"abc", b"x", b"hello ", b"\0\0\0\0"]), max_size=80).map(b"".join))
def test_optimal_parse(data):
    level = tokens.LEVELS["maximum"]
    best = tokens.parse_optimal(data, level)
    assert tokens.expand(best) == data
    streams, extra = tokens.separate(best)
    assert tokens.rejoin(streams, extra, len(best)) == best


def test_shorter_matches_in_quiet_planes():
    coded, masks = transforms.float_channel_split(SAMPLES[8], 1)
    least = tokens.min_match_map(len(coded), tuple(masks))
    assert set(least.tolist()) == {3, 4}
    parsed = tokens.parse(coded, tokens.LEVELS["balanced"], least)
    streams, extra = tokens.separate(parsed, least)
    assert tokens.expand(tokens.rejoin(streams, extra, len(parsed), least)) == coded


def test_longest_match_against_every_place():
    """Two values side by side: no candidate is of the other one, and none is much shorter than the longest match."""
    values = [SAMPLES[7][:900] + RNG.integers(0, 3, 400, dtype=np.uint8).tobytes(), SAMPLES[7][7:500] + b"xyz" * 40]
    for three in (True, False):
        search = tokens.Search(values, 1 << 20, three)
        length, distance = search.longest()
        every = search.all()
        begin = 0
        for data in values:
            for at in range(0, len(data), 13):
                most = min(tokens.LONGEST, len(data) - at)
                want = max((next((k for k in range(most) if data[p + k] != data[at + k]), most) for p in range(at)), default=0)
                got, d = int(length[begin + at]), int(distance[begin + at])
                least = 3 if three else 4
                assert got <= want and (got > want / 2 or want < least) and (got == 0 or got >= least)
                for n, e in [(got, d)] if got else []:
                    assert e <= at and all(data[at - e + k] == data[at + k] for k in range(n))
                found = every[begin + at]
                assert all(data[at - e + k] == data[at + k] for n, e in found for k in range(n))
                assert [n for n, _ in found] == sorted({n for n, _ in found}) and (not got or found[-1][0] == got)
            begin += len(data)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=80) | st.text("abc", max_size=200).map(str.encode), max_size=6))
def test_values_parsed_together_are_parsed_alone(values):
    level = tokens.LEVELS["balanced"]
    together = tokens.parse_many(values, level, [None] * len(values))
    assert [list(t) for t in together] == [list(tokens.parse(v, level)) for v in values]
    assert [tokens.expand(t) for t in together] == values


def test_bad_tokens():
    with pytest.raises(ValueError):
        tokens.expand([(tokens.MATCH, 5, 4)])


def test_slots():
    for d in [*range(1, 3000), *(2**k + j for k in range(12, 27) for j in (-1, 0, 1))]:
        slot, extra, bits = tokens.distance_slot(d)
        assert tokens.slot_base(slot) + extra == d and 0 <= extra < 1 << bits and slot < tokens.SLOTS


def test_rans():
    tables = [rans.normalise(numeric.histogram(d)) for d in SAMPLES]
    assert all(t.sum() == 4096 for t in tables)
    assert all((t[numeric.histogram(d) > 0] >= 1).all() for t, d in zip(tables, SAMPLES, strict=True))
    assert tables[0].tolist() == [16] * 256
    coded = rans.encode_many(SAMPLES, tables)
    assert rans.decode_many(coded, tables, list(map(len, SAMPLES))) == SAMPLES
    for d, t, c in zip(SAMPLES[1:], tables[1:], coded[1:], strict=True):  # close to the entropy
        assert len(c) <= numeric.entropy(d) * len(d) / 8 * 1.03 + 40
        state, out = 1 << 24, bytearray()
        start = np.cumsum(t) - t
        for s in reversed(d):
            f = int(t[s])
            while state >= f << 20:
                out.append(state & 255)
                state >>= 8
            state = (state // f << 12) + int(start[s]) + state % f
        assert bytes(out) + state.to_bytes(8, "big") == c
    with pytest.raises(ValueError):
        rans.encode_many([b"ab"], [np.full(256, 15)])
    with pytest.raises(ValueError):
        rans.decode_many([b"ab"], [np.full(256, 16)], [1])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 10**7), min_size=256, max_size=256))
def test_any_counts_normalise(counts):
    f = rans.normalise(np.array(counts))
    assert f.sum() == 4096 and (f >= 0).all() and (f[np.array(counts) > 0] >= 1).all()


def test_contexts():
    data = SAMPLES[7]
    before = b"\0" + data[:-1]
    assert contexts.decide(data[:50], before[:50]) is None
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, 60_000)
    y = np.where(x == 0, rng.integers(0, 40, 60_000), rng.integers(100, 140, 60_000)).astype(np.uint8)
    prev = np.where(x == 0, 10, 200).astype(np.uint8)
    mode, tables, table_of = contexts.decide(y.tobytes(), prev.tobytes())
    of = contexts.MODES[mode][0]
    assert tables == 2 and table_of[of(10)] != table_of[of(200)]
    for n in (256, 5, 1):
        assert len(set(contexts.cluster(contexts.context_histograms(data, before, "full"), n))) == n
    for mode, tables in (("full", 256), ("msb6", 3), ("lsb6", 1)):
        table_of = contexts.cluster(contexts.context_histograms(data, before, mode), tables)
        coded, freqs = contexts.encode(data, before, mode, tables, table_of)
        assert contexts.decode_chain(coded, len(data), mode, table_of, freqs) == data
    hists = contexts.context_histograms(data, before, "msb6")
    one = [0] * 64
    assert contexts.average_cost(hists, one, 1) == pytest.approx(numeric.entropy(data), rel=1e-9)
    assert contexts.clustered_cost(hists, list(range(64)), 64) <= contexts.clustered_cost(hists, one, 1)


def test_greedy_merges_are_the_cheapest():
    rng = np.random.default_rng(1)
    hists = np.zeros((7, 256), int)
    hists[:, :6] = rng.integers(0, 30, (7, 6))
    hists[3] = 0
    groups = [[i] for i in range(7)]
    while len(groups) > 3:
        cost = lambda g: float(contexts.cost_bits(hists[g].sum(axis=0)))
        pairs = [(round(cost(a + b) - cost(a) - cost(b), 6), min(a), min(b)) for i, a in enumerate(groups) for b in groups[i + 1 :]]
        _, x, y = min((loss, min(p, q), max(p, q)) for loss, p, q in pairs)
        a, b = next(g for g in groups if min(g) == x), next(g for g in groups if min(g) == y)
        groups.remove(b)
        a += b
    want = {frozenset(g) for g in groups}
    got = contexts.cluster(hists, 3)
    assert {frozenset(i for i in range(7) if got[i] == t) for t in set(got)} == want


@pytest.mark.parametrize("data", [d[:700] for d in SAMPLES])
def test_ppm(data):
    for nodes in (20, 1 << 16):
        assert ppm.decode(ppm.encode(data, nodes), len(data), nodes) == data


def test_ppm_predicts_and_mixes():
    m = ppm.Model()
    for b in b"abcabcabcabcabc":
        m.update(b)
    assert m.predict().argmax() == ord("a") and m.predict().sum() == pytest.approx(1)


def test_neighbours_learn_for_each_plane():
    near = ppm.Neighbours(2)
    assert near.predict(0, 7, 3).sum() == pytest.approx(1)
    for i in range(400):
        near.observe(0, 7, 7, i % 5)
        near.observe(1, 9, i % 5, 9)
    assert near.predict(0, 7, 3)[7] > 0.9 and near.predict(1, 7, 3)[3] > 0.9
    assert near.predict(0, 4, 4).sum() == pytest.approx(1)


def test_a_mix_follows_the_better_model():
    rng = np.random.default_rng(1)
    mixer = ppm.LogMixer((0.5, 0.5))
    good, flat = np.full(256, 0.1 / 255), np.full(256, 1 / 256)
    good[65] = 0.9
    bits = 0.0
    for _ in range(400):
        symbol = 65 if rng.random() < 0.9 else int(rng.integers(256))
        p = mixer.mix(good, flat)
        assert p.sum() == pytest.approx(1)
        bits -= np.log2(p[symbol])
        mixer.learn(symbol)
    assert mixer.weights[0] > 0.7 and bits < 400 * 1.8
    assert mixer.mix(flat, flat).argmax() in range(256) and (mixer.weights >= 0).all()


def test_payloads_of_several_segments(monkeypatch):
    from loomstone.operators import codec

    monkeypatch.setattr(codec, "SEGMENT", 100)
    values = [*SAMPLES, SAMPLES[7] * 20]
    parsed = tokens.parse_many(values, tokens.LEVELS["fast"], [None] * len(values))
    payloads = codec.code_tokens(parsed, [None] * len(values))
    assert [tokens.expand(t) for t in codec.decode_tokens(payloads, [None] * len(values))] == values
    assert codec.decode_tokens(payloads[::-1], [None] * len(values))[0] == parsed[-1]


def test_differences_of_words_are_small_on_smooth_series():
    i = np.arange(4000)
    smooth = (5000 + 50 * np.sin(i / 1e4)).astype("<f8").tobytes()
    coded, order = transforms.word_delta(smooth, 1, 64)
    assert order >= 2 and numeric.entropy(coded) < 0.5 * numeric.entropy(transforms.transpose(transforms.delta(smooth, 8)[0], 8))
    quadratic = (i * i).astype("<u4").tobytes()
    coded, order = transforms.word_delta(quadratic, 1, 32)
    assert order == 3 and len(set(coded[8:4000])) == 1


def test_the_optimal_parse_prices_a_distance_once(monkeypatch):
    data = b"".join(b"%d green bottles and %d more, " % (i % 17, i % 23) for i in range(400))
    asked, slot = [], tokens.distance_slot
    monkeypatch.setattr(tokens, "distance_slot", lambda d: asked.append(d) or slot(d))
    assert tokens.expand(tokens.parse_optimal(data, tokens.LEVELS["maximum"])) == data
    assert asked and len(asked) == len(set(asked))


def _texts():
    words = [b"%d green bottles " % (i * i % 97) for i in range(900)]
    return [b"", b"abc", b"a" * 700, b"".join(words), transforms.bwt(b"".join(words))[0], bytes(RNG.integers(0, 4, 20_000, dtype=np.uint8))]


def test_the_optimal_parse_leaves_the_byte_loop_to_its_helper(monkeypatch):
    texts, level = _texts(), tokens.LEVELS["maximum"]
    leasts = [RNG.integers(3, 5, len(t)).astype(np.uint8) for t in texts]
    for some in ([None] * len(texts), leasts):
        want = [tokens._cheapest_path(t, level, m) for t, m in zip(texts, some, strict=True)]
        with monkeypatch.context() as m:
            m.setattr(tokens, "_cheapest_path", None)
            assert tokens.parse_optimal_many(texts, level, some) == want
            m.setattr(jvm, "MOST", 100)  # values over it are parsed in Python, also beside others
            m.setattr(tokens, "_cheapest_path", lambda t, level, least: ("Python", t))
            assert [t[1] if isinstance(t, tuple) else tokens.expand(t) for t in tokens.parse_optimal_many(texts, level, some)] == texts


def test_without_its_helper_python_gives_the_same(monkeypatch):
    texts, level = _texts(), tokens.LEVELS["maximum"]
    tables = [rans.normalise(numeric.histogram(t)) for t in texts]
    turned = [t for t in [*texts, b"ba" * 50, b"z"] if t]
    do = lambda: (turns := [transforms.bwt(t) for t in turned], [transforms.unbwt(*t) for t in turns], tokens.parse_optimal_many(texts, level, [None] * len(texts)), coded := rans.encode_many(texts, tables), rans.decode_many(coded, tables, [*map(len, texts)]))
    want = do()
    assert jvm.ready() and want[1] == turned and want[4] == texts
    held = jvm._held()
    process = held.process
    process.kill()  # it dies between two calls
    process.wait()
    try:
        with pytest.warns(UserWarning, match="no helper"):
            assert do() == want
        assert not jvm.ready()
    finally:
        held.process, held.broken = None, False
    monkeypatch.setattr(jvm, "_command", lambda: ["/nowhere/java"])
    try:
        with pytest.warns(UserWarning, match="no helper"):
            assert do() == want
        with pytest.raises(ValueError):
            rans.encode_many([b"ab"], [rans.normalise(numeric.histogram(b"a"))])
    finally:
        held.process, held.broken = None, False
        monkeypatch.undo()
    with pytest.raises(ValueError):
        rans.encode_many([b"ab"], [rans.normalise(numeric.histogram(b"a"))])


def test_tokens_expand_alike_in_the_helper_and_in_python(monkeypatch):
    parts = [tokens.parse(t, tokens.LEVELS["balanced"]) for t in _texts()]
    parts.append(tokens.Tokens.of([(0, 97, 1), (1, 1, 300), (0, 98, 1), (2, 0, 4), (2, 1, 9), (1, 7, 258)]))
    want = [tokens._expanded(t) for t in parts]
    with monkeypatch.context() as m:
        m.setattr(tokens, "_expanded", lambda t: b"Python" if len(t) else b"")
        assert tokens.expand_many(parts) == want
    for bad in ([(1, 1, 4)], [(0, 97, 1), (1, 2, 4)], [(0, 97, 1), (1, 0, 4)]):
        with pytest.raises(ValueError):
            tokens.expand(bad)
    with pytest.raises(IndexError):
        tokens.expand([(0, 97, 1), (2, 3, 4)])
