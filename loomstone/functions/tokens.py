"""LZ77 tokens: parsing, prices, distance slots, separate streams, and back.

A token is (kind, value, length): kind 0 a literal byte; 1 a match at distance ``value``; 2 a match at
the distance number ``value`` of the three last ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from loomstone.functions import jvm
from loomstone.functions.numeric import LOG2_FRACTION, log2_fixed8

LITERAL, MATCH, REP = 0, 1, 2
#: The last three distances at the start of a chunk; longest match; most distance slots; DP window.
FIRST_REPS, LONGEST, SLOTS, DP_WINDOW = (1, 4, 8), 258, 56, 16_384
#: Bytes of values whose earlier places are searched together.
AT_ONCE = 1 << 21
#: Tokens of several values whose streams are separated together.
TOKENS_AT_ONCE = 1 << 17

Token = tuple[int, int, int]


@dataclass(frozen=True)
class Level:
    """lazy: look one byte ahead below ``threshold``; good: a match that long is taken whole by the optimal parse; depth:
    the surveyed number of candidates, of which the search by classes of sizes needs no limit."""

    lazy: bool
    depth: int
    threshold: int
    good: int
    window: int
    optimal: bool = False


# The levels by name.
LEVELS = {
    "tiny": Level(True, 256, 16, 16, 256 << 10),
    "fast": Level(False, 128, 0, 8, 4 << 20),
    "balanced": Level(True, 1024, 128, 32, 32 << 20),
    "maximum": Level(True, 4096, 258, 258, 128 << 20, True),
    "extreme": Level(True, 8192, 258, 258, 256 << 20, True),
}


def distance_slot(distance: int) -> tuple[int, int, int]:
    """(slot, extra value, extra bits). Slots 0 to 3 are the distances 1 to 4; then two slots for each power of two."""
    d = distance - 1
    if d < 4:
        return d, 0, 0
    top = d.bit_length() - 1
    slot = min(2 * top + (d >> top - 1 & 1), SLOTS - 1)
    base = slot_base(slot)
    return slot, distance - base, (slot - 2) // 2


def slot_base(slot: int) -> int:
    if slot < 4:
        return slot + 1
    return (1 << slot // 2) + (slot & 1) * (1 << slot // 2 - 1) + 1


#: slot_base of each slot.
BASES = np.array([slot_base(k) for k in range(SLOTS)], np.int64)


def min_match_map(n: int, masks: tuple[int, ...] = ()) -> np.ndarray | None:
    """Shortest match by position: 3 inside planes of low entropy of a channel split, else 4 (None: 4 everywhere)."""
    if not masks:
        return None
    out = np.full(n, 4, np.uint8)
    plane = n // (4 * len(masks))
    for c, mask in enumerate(masks):
        for p in range(4):
            if mask >> 4 + p & 1:
                at = (4 * c + p) * plane
                out[at : at + plane] = 3
    return out


def _common(data: bytes, a: int, b: int, most: int) -> int:
    """How many bytes from a and b on agree, up to most; a < b."""
    n, step = 0, 16
    while n < most:
        step = min(step, most - n)
        if data[a + n : a + n + step] != data[b + n : b + n + step]:
            x, y = data[a + n : a + n + step], data[b + n : b + n + step]
            while x[:1] == y[:1]:
                k = len(x) // 2 or 1
                if x[:k] == y[:k]:
                    n, x, y = n + k, x[k:], y[k:]
                else:
                    x, y = x[:k], y[:k]
            return n
        n += step
        step *= 2
    return most


class Search:
    """Earlier places of what begins at each byte of several values, found for all bytes at once.

    For each length of ``SIZES`` the places that begin with the same bytes are one class (a class of a longer size joins
    those of two overlapping shorter ones), and the place before in its class is a candidate: the nearest that agrees
    in so many bytes. Its exact length is that size and what still agrees after it. So a
    candidate is never shorter than the longest match by more than a third or a half, and it is the nearest of its size."""

    SIZES = (3, 4, 6, 8, 12, 16, 24, 32, 64, 128, 256)

    def __init__(self, values: list[bytes], window: int, three: bool = False) -> None:
        """three: also matches of three bytes."""
        sizes = np.array([len(v) for v in values], np.int64)
        self.ends = np.cumsum(sizes)
        x = np.frombuffer(b"".join(values), np.uint8)
        self.x, self.n, self.window = x, len(x), window
        self.width = max(1, int(self.n).bit_length())
        self.first = np.repeat(self.ends - sizes, sizes)  # where the value of each byte begins
        self.last = np.repeat(self.ends, sizes)
        self.found: list[tuple[int, np.ndarray, np.ndarray]] = []  # (size, places, candidates)
        ranks: dict[int, np.ndarray] = {}
        before, some = 0, np.arange(self.n)
        for size in self.SIZES[0 if three else 1 :]:
            some = some[some + size <= self.n]
            if before:
                rank = ranks[before]
                left, right = rank[some], rank[some + size - before]
                keep = right >= 0
                some, left, right = some[keep], left[keep], right[keep]
                key = left.astype(np.int64) << self.width | right
            else:
                key = np.zeros(len(some), np.int64)
                for k in range(size):
                    key = key << 8 | x[some + k]
            key, at = self._sorted(key, some)
            again = np.flatnonzero(key[1:] == key[:-1]) + 1
            if not len(again):
                break
            number = np.cumsum(np.r_[0, key[1:] != key[:-1]])
            ranks[size] = np.full(self.n, -1, np.int32)
            several = np.r_[key[1:] == key[:-1], False]
            several[again] = True
            ranks[size][at[several]] = number[several]
            places, earlier = at[again], at[again - 1]
            mine = (earlier >= self.first[places]) & (places - earlier <= window) & (places + size <= self.last[places])
            self.found.append((size, places[mine], earlier[mine]))
            before, some = size, np.sort(at[several])
        self.ranks = ranks

    def _sorted(self, key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys and places, by key and then by place; places are ascending."""
        if 3 * self.width <= 63:  # one number holds both, and numbers sort fast
            both = np.sort(key << self.width | at)
            return both >> self.width, both & (1 << self.width) - 1
        order = np.argsort(key, kind="stable")
        return key[order], at[order]

    def _length(self, size: int, at: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        """The exact lengths of candidates that agree in ``size`` bytes."""
        most = np.minimum(self.last[at] - at, LONGEST)
        n = np.full(len(at), size, np.int64)
        for step in [s for s in self.SIZES[::-1] if s < size and s in self.ranks]:
            rank = self.ranks[step]
            a, b = at + n, earlier + n
            inside = a + step <= self.n
            ra, rb = rank[np.where(inside, a, 0)], rank[np.where(inside, b, 0)]
            n += step * (inside & (ra >= 0) & (ra == rb))
        for _ in range(4):
            a, b = np.minimum(at + n, self.n - 1), earlier + n
            n += (at + n < self.n) & (self.x[a] == self.x[np.minimum(b, self.n - 1)])
        return np.minimum(n, most)

    def longest(self) -> tuple[np.ndarray, np.ndarray]:
        """Length and distance of the longest candidate at each byte; 0 and 0 without any."""
        length, distance = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        for size, at, earlier in self.found[::-1]:  # a candidate of a larger size is longer
            new = length[at] == 0
            at, earlier = at[new], earlier[new]
            length[at], distance[at] = self._length(size, at, earlier), at - earlier
        return length, distance

    def all(self) -> list[list[tuple[int, int]]]:
        """(length, distance) of the candidates at each byte, each longer than all nearer ones, shortest first."""
        out: list[list[tuple[int, int]]] = [[] for _ in range(self.n)]
        for size, at, earlier in self.found:
            for i, n, d in zip(at.tolist(), self._length(size, at, earlier).tolist(), (at - earlier).tolist(), strict=True):
                seen = out[i]
                if not seen or n > seen[-1][0]:
                    seen.append((n, d))
        return out


def promote(reps: tuple[int, ...], token: Token) -> tuple[int, ...]:
    kind, value, _ = token
    if kind == MATCH:
        return (value, *(r for r in reps if r != value))[:3] if value in reps else (value, *reps[:2])
    if kind == REP:
        return (reps[value], *(r for i, r in enumerate(reps) if i != value))
    return reps


@dataclass(eq=False)
class Tokens:
    """Tokens as arrays, in order."""

    kind: np.ndarray
    value: np.ndarray
    length: np.ndarray

    @staticmethod
    def of(rows: list[Token]) -> Tokens:
        cols = np.array(rows, np.int64).reshape(-1, 3).T
        return Tokens(cols[0].astype(np.uint8), cols[1], cols[2])

    @staticmethod
    def filled(data: bytes, matches: list[tuple[int, int, int, int]]) -> Tokens:
        """matches: (place, kind, value, length), ascending; all other bytes are literals."""
        x = np.frombuffer(data, np.uint8)
        m = np.array(matches, np.int64).reshape(-1, 4)
        change = np.zeros(len(x) + 1, np.int64)
        np.add.at(change, m[:, 0], 1)
        np.add.at(change, m[:, 0] + m[:, 3], -1)
        alone = np.flatnonzero(np.cumsum(change[:-1]) == 0)
        order = np.argsort(np.r_[alone, m[:, 0]], kind="stable")
        put = lambda literal, match: np.r_[literal, match][order]
        return Tokens(put(np.zeros(len(alone)), m[:, 1]).astype(np.uint8), put(x[alone].astype(np.int64), m[:, 2]), put(np.ones(len(alone), np.int64), m[:, 3]))

    def __len__(self) -> int:
        return len(self.kind)

    def __iter__(self) -> Iterator[Token]:
        return zip(self.kind.tolist(), self.value.tolist(), self.length.tolist(), strict=True)

    def __eq__(self, other) -> bool:
        return list(self) == list(other)

    def places(self) -> np.ndarray:
        return np.cumsum(self.length) - self.length

    def symbols(self, least: np.ndarray | None) -> np.ndarray:
        """The length symbols of all that are not literals."""
        some = self.kind > 0
        short = 4 if least is None else least[self.places()[some]].astype(np.int64)
        return np.minimum(self.length[some] - short, 255)


def _steps(data: bytes, level: Level, least: np.ndarray | None, length: list[int], distance: list[int]) -> Tokens:
    """Greedy parse, or lazy with one byte of look-ahead; a last distance wins over an equally long match."""
    out, at, n = [], 0, len(data)
    first, second, third = FIRST_REPS
    short = np.full(n, 4, np.uint8) if least is None else least
    # where a last distance fits there is a candidate as well, so nothing begins at any other byte
    starts = np.flatnonzero(np.array(length, np.int64) >= short).tolist()
    starts.append(n)
    lazy_below = level.threshold if level.lazy else 0

    def choose(i: int) -> Token:
        best, which, byte = 0, -1, data[i]
        if i >= first and data[i - first] == byte:
            best, which = _common(data, i - first, i, min(LONGEST, n - i)), 0
        if i >= second and data[i - second] == byte and (m := _common(data, i - second, i, min(LONGEST, n - i))) > best:
            best, which = m, 1
        if i >= third and data[i - third] == byte and (m := _common(data, i - third, i, min(LONGEST, n - i))) > best:
            best, which = m, 2
        if best >= length[i] and best >= (4 if least is None else least[i]):
            return REP, which, best
        return MATCH, distance[i], length[i]

    waiting: Token | None = None
    k = 0
    while True:
        while starts[k] < at:
            k += 1
        if starts[k] > at:
            at, waiting = starts[k], None
        if at >= n:
            break
        kind, value, size = token = waiting or choose(at)
        waiting = None
        if size < lazy_below and starts[k + 1] == at + 1 < n:
            waiting = choose(at + 1)
            if waiting[2] > size:
                at += 1  # a literal, then the longer one
                continue
            waiting = None
        out.append((at, *token))
        d = value if kind == MATCH else (first, second, third)[value]
        if d != first:
            if d != second:
                third = second
            first, second = d, first
        at += size
    return Tokens.filled(data, out)


def parse_many(values: list[bytes], level: Level, leasts: list[np.ndarray | None]) -> list[Tokens]:
    """Greedy or lazy parses of several values; places are searched for some megabytes of them at a time."""
    out: list[Tokens] = []
    begin = 0
    while begin < len(values):
        end, size = begin, 0
        while end < len(values) and (end == begin or size + len(values[end]) <= AT_ONCE):
            size += len(values[end])
            end += 1
        part = values[begin:end]
        search = Search(part, level.window, any(m is not None for m in leasts[begin:end]))
        length, distance = search.longest()
        at = 0
        for v, least in zip(part, leasts[begin:end], strict=True):
            mine = slice(at, at + len(v))
            out.append(_steps(v, level, least, length[mine].tolist(), distance[mine].tolist()))
            at += len(v)
        begin = end
    return out


def parse(data: bytes, level: Level, least: np.ndarray | None = None) -> Tokens:
    return parse_many([data], level, [least])[0]


@dataclass(frozen=True)
class Prices:
    """Bits of each symbol in 24.8 fixed point, from Laplace-smoothed counts of a first parse."""

    flags: list[int]
    literals: list[int]
    lengths: list[int]
    slots: list[int]
    reps: list[int]


def _prices(counts: list[int]) -> list[int]:
    total = log2_fixed8(sum(counts))
    return [max(0, total - log2_fixed8(c)) for c in counts]


def _slots(distances: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """distance_slot of each."""
    d = distances - 1
    top = np.frexp(np.maximum(d, 1).astype(np.float64))[1].astype(np.int64) - 1
    slot = np.where(d < 4, d, np.minimum(2 * top + (d >> np.maximum(top - 1, 0) & 1), SLOTS - 1))
    return slot, np.where(d < 4, 0, distances - BASES[slot]), np.where(slot < 4, 0, (slot - 2) // 2)


def price_model(tokens: Tokens, least: np.ndarray | None = None) -> Prices:
    kind, value = tokens.kind, tokens.value
    count = lambda x, n: (np.bincount(x, minlength=n) + 1).tolist()
    slots = _slots(value[kind == MATCH])[0]
    symbols = tokens.symbols(least)
    parts = (kind, 3), (value[kind == LITERAL], 256), (symbols, 256), (slots, SLOTS), (value[kind == REP], 3)
    return Prices(*(_prices(count(x, n)) for x, n in parts))


def parse_optimal_many(values: list[bytes], level: Level, leasts: list[np.ndarray | None]) -> list[Tokens]:
    """parse_optimal of each value: by the helper of ``jvm``, and in Python what that does not take."""
    out: list[Tokens | None] = [None] * len(values)
    if jvm.ready():
        extra = [distance_slot(slot_base(k))[2] for k in range(SLOTS)]
        settings = [level.window, level.good, level.threshold if level.lazy else 0, *LOG2_FRACTION.tolist(), *extra]
        some = [i for i, v in enumerate(values) if len(v) <= jvm.MOST]
        if found := jvm.parse_optimal([values[i] for i in some], [leasts[i] for i in some], settings):
            for i, cols in zip(some, found, strict=True):
                out[i] = Tokens(*cols)
    return [_cheapest_path(v, level, m) if t is None else t for v, m, t in zip(values, leasts, out, strict=True)]


def parse_optimal(data: bytes, level: Level, least: np.ndarray | None = None) -> Tokens:
    """Cheapest path under the prices of a first parse, window by window of 16,384 bytes.

    Each length is priced with the nearest candidate that has it, and with the last distances; extra bits cost 256 each. Of
    equal costs the first found stays."""
    return parse_optimal_many([data], level, [least])[0]


def _cheapest_path(data: bytes, level: Level, least: np.ndarray | None) -> Tokens:
    """parse_optimal in Python."""
    search = Search([data], level.window, least is not None)
    length, distance = search.longest()
    prices = price_model(_steps(data, level, least, length.tolist(), distance.tolist()), least)
    every, reps, out, n = search.all(), FIRST_REPS, [], len(data)
    short_of = [4] * n if least is None else least.tolist()
    match, slots = prices.flags[MATCH], prices.slots
    literal = [prices.flags[LITERAL] + p for p in prices.literals]
    rep_prices = [prices.flags[REP] + p for p in prices.reps]
    lengths = prices.lengths + prices.lengths[-1:] * (LONGEST - 255)  # by length less the shortest, up to LONGEST
    base_of: dict[int, int] = {}  # price of each distance seen
    for begin in range(0, n, DP_WINDOW):
        end = min(n, begin + DP_WINDOW)
        size = end - begin
        cost, how = [1 << 60] * (size + 1), [(LITERAL, 0, 1)] * (size + 1)
        state: list[tuple[int, ...]] = [reps] * (size + 1)
        cost[0], i = 0, 0
        while i < size:
            at, now, short = begin + i, cost[i], short_of[begin + i]
            here = state[i] = promote(state[i - how[i][2]], how[i]) if i else reps
            byte = data[at]
            if (price := now + literal[byte]) < cost[i + 1]:
                cost[i + 1], how[i + 1] = price, (LITERAL, byte, 1)
            most, jump, which = end - at, 0, 0
            if most > LONGEST:
                most = LONGEST
            for d in here:
                if d <= at and data[at - d] == byte:
                    # a last distance that agrees in less than the shortest match is no step
                    if most >= short and data[at - d : at - d + short] == data[at : at + short]:
                        full = _common(data, at - d, at, most)
                        base = now + rep_prices[which]
                        for k in range(short, full + 1):
                            if (price := base + lengths[k - short]) < cost[i + k]:
                                cost[i + k], how[i + k] = price, (REP, which, k)
                        if full > jump:
                            jump = full
                which += 1
            tried = short - 1
            for full, d in every[at]:
                if full > most:
                    full = most
                if full > tried:
                    if (base := base_of.get(d, -1)) < 0:
                        slot, _, extra = distance_slot(d)
                        base = base_of[d] = match + slots[slot] + 256 * extra
                    base += now
                    for k in range(tried + 1, full + 1):
                        if (price := base + lengths[k - short]) < cost[i + k]:
                            cost[i + k], how[i + k] = price, (MATCH, d, k)
                    tried = full
            if tried > jump:
                jump = tried
            i += jump if jump >= level.good else 1
        path, i = [], size
        while i > 0:
            path.append(how[i])
            i -= how[i][2]
        for token in path[::-1]:
            reps = promote(reps, token)
        out += path[::-1]
    return Tokens.of(out)


def expand_many(parts: list[Tokens]) -> list[bytes]:
    """expand of each: by the helper of ``jvm``, and in Python what that does not take or what is not right."""
    out: list[bytes] = [b""] * len(parts)
    sizes = [int(t.length.sum()) for t in parts]
    fits = lambda t, n: 0 < n <= jvm.MOST >= 7 * len(t) and t.length.max() < 1 << 15 and t.length.min() > 0 and t.value.max() < 1 << 31 and t.value.min() >= 0 and t.kind.max() <= REP
    some = [i for i, (t, n) in enumerate(zip(parts, sizes, strict=True)) if len(t) and fits(t, n)]
    for i, x in zip(some, jvm.expand([(parts[i].kind, parts[i].value, parts[i].length) for i in some], [sizes[i] for i in some]) or (), strict=False):
        out[i] = x
    return [x or _expanded(t) for x, t in zip(out, parts, strict=True)]


def expand(tokens: Tokens | list[Token]) -> bytes:
    """The bytes that tokens stand for; copies may overlap their source. Bad distances raise ValueError."""
    return expand_many([tokens if isinstance(tokens, Tokens) else Tokens.of(tokens)])[0]


def _expanded(tokens: Tokens) -> bytes:
    """expand in Python."""
    at = np.flatnonzero(tokens.kind)
    literals = tokens.value[tokens.kind == LITERAL].astype(np.uint8).tobytes()
    upto = (at - np.arange(len(at))).tolist()  # literals before each match
    out, used = bytearray(), 0
    first, second, third = FIRST_REPS
    for k, kind, value, length in zip(upto, tokens.kind[at].tolist(), tokens.value[at].tolist(), tokens.length[at].tolist(), strict=True):
        if k > used:
            out += literals[used:k]
            used = k
        d = value if kind == MATCH else (first, second, third)[value]
        if d != first:
            if d != second:
                third = second
            first, second = d, first
        begin = len(out) - d
        if begin < 0 or d < 1:
            raise ValueError("a distance leads before the start")
        if d >= length:
            out += out[begin : begin + length]
        else:
            out += (out[begin:] * (length // d + 1))[:length]
    out += literals[used:]
    return bytes(out)


STREAMS = ("flags", "literals", "lengths", "slots", "reps")


def separate_many(parts: list[Tokens], leasts: list[np.ndarray | None]) -> list[tuple[dict[str, bytes], bytes]]:
    """separate of each, so many together that arrays of theirs stay small."""
    out = []
    begin = 0
    while begin < len(parts):
        end, size = begin, 0
        while end < len(parts) and (end == begin or size + len(parts[end]) <= TOKENS_AT_ONCE):
            size += len(parts[end])
            end += 1
        out += _separate(parts[begin:end], leasts[begin:end])
        begin = end
    return out


def separate(tokens: Tokens, least: np.ndarray | None = None) -> tuple[dict[str, bytes], bytes]:
    """Five symbol streams (flags four to a byte) and the extra bits of distances, lowest first."""
    return _separate([tokens], [least])[0]


def _separate(parts: list[Tokens], leasts: list[np.ndarray | None]) -> list[tuple[dict[str, bytes], bytes]]:
    kind, value = np.concatenate([t.kind for t in parts]), np.concatenate([t.value for t in parts])
    sizes = np.array([len(t) for t in parts])
    part = np.repeat(np.arange(len(parts)), sizes)
    per_part = lambda x: np.bincount(x, minlength=len(parts))
    before = lambda n: np.cumsum(n) - n

    def cut(x: np.ndarray, counts: np.ndarray) -> list[bytes]:
        whole, ends = x.astype(np.uint8).tobytes(), np.cumsum(counts).tolist()
        return [whole[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    literal, match, rep = kind == LITERAL, kind == MATCH, kind == REP
    of_match = part[match]
    slots, rest, bits = _slots(value[match])
    of = np.repeat(np.arange(len(bits)), bits)
    n_bits = np.bincount(of_match[of], minlength=len(parts))
    n_bytes = -(-n_bits // 8)
    ones = np.zeros(8 * int(n_bytes.sum()), np.uint8)
    at = np.arange(len(of))
    ones[at + (8 * before(n_bytes) - before(n_bits))[of_match[of]]] = rest[of] >> (at - before(bits)[of]) & 1
    n_flags = -(-sizes // 4)
    flags = np.zeros(4 * int(n_flags.sum()), np.uint8)
    flags[np.arange(len(kind)) + (4 * before(n_flags) - before(sizes))[part]] = kind
    flags = np.bitwise_or.reduce(flags.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8), axis=1) if len(flags) else flags
    symbols = [t.symbols(m).astype(np.uint8).tobytes() for t, m in zip(parts, leasts, strict=True)]
    n_matches = per_part(of_match)
    streams = cut(flags, n_flags), cut(value[literal], per_part(part[literal])), symbols, cut(slots, n_matches), cut(value[rep], per_part(part[rep]))
    extra = cut(np.packbits(ones, bitorder="little"), n_bytes)
    return [(dict(zip(STREAMS, mine, strict=True)), bits) for *mine, bits in zip(*streams, extra, strict=True)]


def rejoin(streams: dict[str, bytes], extra: bytes, n_tokens: int, least: np.ndarray | None = None) -> Tokens:
    flags, literals, symbols, slots, reps = (np.frombuffer(streams[k], np.uint8).astype(np.int64) for k in STREAMS)
    kind = (flags[:, None] >> np.array([0, 2, 4, 6]) & 3).ravel()[:n_tokens]
    if (kind > REP).any():
        raise ValueError("an unknown flag")
    bits = np.where(slots < 4, 0, (slots - 2) // 2)
    start = np.cumsum(bits) - bits
    of = np.repeat(np.arange(len(bits)), bits)
    ones = np.unpackbits(np.frombuffer(extra, np.uint8), count=len(of), bitorder="little").astype(np.int64) if len(of) else of
    rest = np.bincount(of, (ones << np.arange(len(of)) - start[of]).astype(np.float64), len(bits)).astype(np.int64)
    value, length = np.zeros(n_tokens, np.int64), np.ones(n_tokens, np.int64)
    value[kind == LITERAL], value[kind == REP] = literals, reps
    value[kind == MATCH] = BASES[slots] + rest
    some = np.flatnonzero(kind)
    if least is None:
        length[some] = symbols + 4
    else:
        copied, out = 0, []
        for place, symbol in zip((some - np.arange(len(some))).tolist(), symbols.tolist(), strict=True):
            out.append(symbol + int(least[place + copied]))
            copied += out[-1]
        length[some] = out
    return Tokens(kind.astype(np.uint8), value, length)
