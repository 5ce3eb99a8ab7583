"""Language-model scoring by context-tree weighting, beside a word unigram base score.

The scored sequence: A-Z lower-cased, the words [^\\x20\\x09-\\x0D]+ joined by one space, then one
line feed as the end, so it is the same sequence of tokens that the base score sees. Each byte is
coded as eight binary decisions, most significant bit first; every decision has a context tree over
the preceding bytes (Willems, Shtarkov and Tjalkens, "The Context-Tree Weighting Method: Basic
Properties", 1995). A tree node has a Krichevsky-Trofimov estimate from all training text, and
Pw = (Pkt + product of the children's Pw) / 2 weighs all depths; the trees are then frozen, and a
bit's probability mixes the estimates along its context with the weights that training gave. Where
training has not seen a context, the deepest one that it has seen takes the whole of what is left.

No context is left out, at any size. A gram is a byte after its ``depth`` preceding bytes; the nearest
of these stands highest in its number, so all contexts are ranges of grams in order. Grams are
counted in Spark, for training and for all texts. The contexts with the same ``SPLIT`` nearest bytes
are one subtree: at most 2^24 grams whatever the corpus, worked on in one task, bit by bit. The few
contexts above (at most 2^16) are weighted on the driver, and a second pass over the subtrees gives
each gram the log probability of its byte. Texts then add up those of their grams: the most
frequent, a bounded number, travel to the tasks; all others are joined with the whole table.

Base score: word counts are added up in Spark too, and again the most frequent ones travel and the
tokens of all other words are joined with the whole count table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.llm.common import LOWER, arrow_map, texts, written

#: Bytes of context, grams and words that travel to all tasks.
DEPTH, HEAD_GRAMS, HEAD_WORDS = 5, 1 << 20, 1 << 17
#: Nearest bytes that make a subtree; grams of whole subtrees that are worked on at once.
SPLIT, AT_ONCE = 3, 1 << 18
#: Bytes that are counted or scored at once, and rows a task holds before it sends them on.
PIECE, HELD = 1 << 22, 1 << 22
END = b"\n"
LN2 = float(np.log(2))


def tokens(text: bytes) -> list[bytes]:
    return [*text.translate(LOWER).split(), END]


def sequence(words: list[bytes]) -> bytes:
    """words end with END; the byte before a document's first is END as well."""
    return b" ".join(words[:-1]) + END


def _pieces(seqs: list[bytes], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, where each sequence begins, how many): sequences in a row, each after depth ENDs."""
    part, size = [], 0
    for s in [*seqs, None]:
        if part and (s is None or size + len(s) > PIECE):
            yield np.frombuffer(b"".join(END * depth + p for p in part), np.uint8), np.fromiter(map(len, part), np.int64, len(part)), len(part)
            part, size = [], 0
        if s is not None:
            part.append(s)
            size += len(s)


def _positions(sizes: np.ndarray, depth: int) -> np.ndarray:
    """Where the bytes of the sequences are, without what precedes each."""
    shift = np.repeat(np.arange(1, len(sizes) + 1) * depth, sizes)
    return np.arange(int(sizes.sum())) + shift


def _grams(data: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The gram of each position: the nearest preceding byte highest, the byte itself lowest."""
    g = np.zeros(len(at), np.int64)
    for d in range(1, depth + 1):
        g = g << 8 | data[at - d]
    return g << 8 | data[at]


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)
    return k[start], np.add.reduceat(n, start) if len(k) else n


def count_grams(docs: DataFrame, depth: int) -> DataFrame:
    """docs: text, train (boolean). g, n, t: each gram, how often it occurs, and how often in training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            k, n = _added(keys, counts)
            keys.clear()
            counts.clear()
            return pa.RecordBatch.from_pydict({"g": pa.array(k >> 1), "n": pa.array(n), "t": pa.array(n * (k & 1))})

        for b in batches:
            first, train = 0, np.array(b.column(1).to_pylist(), np.int64)
            for data, sizes, many in _pieces([sequence(tokens(t)) for t in texts(b)], depth):
                g = _grams(data, _positions(sizes, depth), depth) << 1 | np.repeat(train[first : first + many], sizes)
                first += many
                k, n = np.unique(g, return_counts=True)
                keys.append(k)
                counts.append(n.astype(np.int64))
                if sum(map(len, keys)) > HELD:
                    k, n = _added(keys, counts)
                    keys[:], counts[:] = [k], [n]
                    if len(k) > HELD // 2:
                        yield out()
        if keys:
            yield out()

    partial = docs.select("text", "train").mapInArrow(run, "g long, n long, t long")
    return partial.groupBy("g").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))


def count_words(docs: DataFrame, text_col: str) -> DataFrame:
    """w (binary), n: each token and how often it occurs; END is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        out = lambda: pa.RecordBatch.from_pydict({"w": pa.array(list(found), pa.binary()), "n": pa.array(list(found.values()), pa.int64())})
        for b in batches:
            for t in texts(b):
                found.update(tokens(t))
            if len(found) > HELD // 8:
                yield out()
                found.clear()
        if found:
            yield out()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))


def least_count(counted: DataFrame, most: int) -> int:
    """The least threshold on n (of a fine scale) that leaves at most ``most`` rows."""
    scale = counted.groupBy(F.floor(F.log2("n") * 16).alias("s")).agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("least")).orderBy(F.desc("s"))
    total, least = 0, 1 << 62
    for r in scale.collect():  # some hundred rows
        total += r.c
        if total > most:
            break
        least = r.least
    return least


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural logarithm of the gamma function, x >= 0.5: Stirling's series from x + 6 on."""
    y = x + 6
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - np.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5))


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - np.log(np.pi)


def _by_key(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums of the values of equal keys, by key; keys in any order."""
    found, where = np.unique(keys, return_inverse=True)
    return found, *(np.bincount(where, v, len(found)) for v in values)


class Level:
    """The nodes of one depth for one bit: contexts with the bits before it, ascending."""

    def __init__(self, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> None:
        """below: log of the product of the children's Pw; None at the last depth."""
        self.node, self.seen = node, zeros + ones > 0
        self.one = (ones + 0.5) / (zeros + ones + 1)
        own = log_kt(zeros, ones)
        self.log_pw = own if below is None else np.logaddexp(own, below) - LN2
        self.stop = np.ones(len(own)) if below is None else np.exp(own - LN2 - self.log_pw)

    def down(self, mixed: np.ndarray, mass: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From what the parents have: the mixture so far, the weight of all that is deeper, and the estimate of the
        deepest context that training has seen."""
        stop = np.where(self.seen, self.stop, 0.0)
        return mixed + mass * stop * self.one, mass * (1 - stop), np.where(self.seen, self.one, last)


def _parents(node: np.ndarray, bit: int) -> np.ndarray:
    """The nodes one byte nearer: the farthest byte of the context goes, the bits stay."""
    return node >> 8 + bit << bit | node & (1 << bit) - 1


class Subtrees:
    """Whole subtrees: grams, ascending, and their training counts."""

    def __init__(self, g: np.ndarray, t: np.ndarray, depth: int, split: int) -> None:
        self.g, self.depth, self.split = g, depth, split
        t = t.astype(np.float64)
        self.pairs = {depth: (g, t)}  # a context and a byte, and how often
        for d in range(depth - 1, split - 1, -1):
            k, n = self.pairs[d + 1]
            self.pairs[d] = _by_key(k >> 16 << 8 | k & 255, n)

    def levels(self, bit: int) -> list[Level]:
        """From the depth ``split`` to the last."""
        out: list[Level] = []
        for d in range(self.depth, self.split - 1, -1):
            k, n = self.pairs[d]
            start = np.flatnonzero(np.r_[True, np.diff(k >> 8 - bit) != 0])
            is_one = k >> 7 - bit & 1
            zeros, ones = (np.add.reduceat(n * x, start) for x in (1 - is_one, is_one))
            node = k[start] >> 8 - bit
            below = None
            if out:
                below = np.bincount(np.searchsorted(node, _parents(out[0].node, bit)), out[0].log_pw, len(node))
            out.insert(0, Level(node, zeros, ones, below))
        return out

    def tops(self) -> tuple[np.ndarray, ...]:
        """For the contexts just above: context << 8 | 1 << bit | bits before, zeros, ones, sum of the log Pw."""
        parts = []
        for bit in range(8):
            k, n = self.pairs[self.split]
            top, is_one = self.levels(bit)[0], k >> 7 - bit & 1
            node, zeros, ones = _by_key(_parents(k >> 8 - bit, bit), n * (1 - is_one), n * is_one)
            below = np.bincount(np.searchsorted(node, _parents(top.node, bit)), top.log_pw, len(node))
            parts.append((node >> bit << 8 | 1 << bit | node & (1 << bit) - 1, zeros, ones, below))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def logs(self, upper: Upper) -> np.ndarray:
        """log10 of the probability of each gram's byte after its context."""
        out = np.zeros(len(self.g))
        for bit in range(8):
            levels = self.levels(bit)
            state = upper.of(_parents(levels[0].node, bit), bit)
            for i, level in enumerate(levels):
                if i:
                    at = np.searchsorted(levels[i - 1].node, _parents(level.node, bit))
                    state = tuple(x[at] for x in state)
                state = level.down(*state)
            mixed, mass, last = state
            one = np.clip(mixed + mass * last, 1e-12, 1 - 1e-12)
            mine = np.searchsorted(levels[-1].node, self.g >> 8 - bit)
            out += np.log10(np.where(self.g >> 7 - bit & 1, one[mine], 1 - one[mine]))
        return out


class Upper:
    """What the contexts of fewer than ``split`` bytes hand on to the subtrees below."""

    def __init__(self, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray, split: int) -> None:
        """Rows of Subtrees.tops, each node once."""
        keys, states = [], []
        byte_bits = np.floor(np.log2((node & 255).astype(np.float64) + 0.5)).astype(np.int64)
        for bit in range(8):
            mine = byte_bits == bit
            k = node[mine] >> 8 << bit | node[mine] & (1 << bit) - 1
            order = np.argsort(k)
            k, a, b, s = k[order], zeros[mine][order], ones[mine][order], below[mine][order]
            levels = [Level(k, a, b, s)]
            for _ in range(split - 1):
                k, a, b, s = _by_key(_parents(k, bit), a, b, levels[0].log_pw)
                levels.insert(0, Level(k, a, b, s))
            state = tuple(np.full(len(levels[0].node), x) for x in (0.0, 1.0, 0.5))
            for i, level in enumerate(levels):
                if i:
                    at = np.searchsorted(levels[i - 1].node, _parents(level.node, bit))
                    state = tuple(x[at] for x in state)
                state = level.down(*state)
            k = levels[-1].node
            keys.append(k >> bit << 8 | 1 << bit | k & (1 << bit) - 1)
            states.append(np.stack(state, axis=1))
        key = np.concatenate(keys)
        order = np.argsort(key)
        self.key, self.state = key[order].astype(np.int32), np.concatenate(states)[order]

    def of(self, node: np.ndarray, bit: int) -> tuple[np.ndarray, ...]:
        at = np.searchsorted(self.key, (node >> bit << 8 | 1 << bit | node & (1 << bit) - 1).astype(np.int32))
        return tuple(self.state[at].T)


def _whole(batches: Iterator[pa.RecordBatch], shift: int) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first one, g: whole subtrees, ``AT_ONCE`` rows or more together."""
    held: list[list[np.ndarray]] = []
    size = 0
    for b in batches:
        held.append([c.to_numpy() for c in b.columns])
        size += b.num_rows
        if size > AT_ONCE:
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.searchsorted(cols[0], cols[0][-1] >> shift << shift))
            if cut:
                yield [x[:cut] for x in cols]
            held, size = [[x[cut:] for x in cols]], len(cols[0]) - cut
    if size:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def gram_logs(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """grams: g, n, t. Returns g, n and l, the log10 probability of the gram's byte after its context, of every gram."""
    if not 1 <= depth <= 6:
        raise ValueError("depth: from 1 to 6 bytes of context, as a gram is a long")
    split = min(SPLIT, depth)
    shift = 8 * (depth + 1 - split)
    spark = grams.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = grams.select("g", "n", "t").repartition(parts, F.shiftright("g", shift)).sortWithinPartitions("g")

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, _, t in _whole(batches, shift):
            got = Subtrees(g, t, depth, split).tops()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], names=["node", "zeros", "ones", "below"])

    rows = ordered.mapInArrow(tops, "node long, zeros double, ones double, below double")
    summed = rows.groupBy("node").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below")))
    got = summed.toArrow()  # 2^16 contexts at most, 255 nodes each at most
    upper = Upper(*(got.column(i).to_numpy() for i in range(4)), split)
    pack = zstandard.ZstdCompressor(1).compress
    sent = spark.sparkContext.broadcast((pack(upper.key.tobytes()), pack(upper.state.astype(np.float32).tobytes())))

    def logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        above = Upper.__new__(Upper)
        above.key = np.frombuffer(unpack(sent.value[0]), np.int32)
        above.state = np.frombuffer(unpack(sent.value[1]), np.float32).reshape(-1, 3).astype(np.float64)
        for g, n, t in _whole(batches, shift):
            found = Subtrees(g, t, depth, split).logs(above)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n), pa.array(found)], names=["g", "n", "l"])

    return ordered.mapInArrow(logs, "g long, n long, l double")


class Table:
    """Grams to values by open addressing, for whole arrays at a time."""

    def __init__(self, grams: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(2 * len(grams)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits)
        left, slot = np.arange(len(grams)), self._slot(grams)
        while len(left):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = grams[left[free]]  # of several for one slot the last stays
            stays = self.keys[slot] == grams[left]
            self.values[slot[stays]] = values[left[stays]]
            left, slot = left[~stays], slot[~stays] + 1 & len(self.keys) - 1

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        mixed = grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values, 0 where there is none, and which grams have none."""
        slot = self._slot(grams)
        keys = self.keys[slot]
        out, lost = np.where(keys == grams, self.values[slot], 0.0), keys < 0
        left = np.flatnonzero((keys != grams) & ~lost)
        slot = slot[left]
        while len(left):
            slot = slot + 1 & len(self.keys) - 1
            keys = self.keys[slot]
            hit, end = keys == grams[left], keys < 0
            out[left[hit]] = self.values[slot[hit]]
            lost[left[end]] = True
            go = ~(hit | end)
            left, slot = left[go], slot[go]
        return out, lost


def score_texts(
    docs: DataFrame,
    train_on: Column,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    depth: int = DEPTH,
    head_grams: int = HEAD_GRAMS,
    head_words: int = HEAD_WORDS,
) -> DataFrame:
    """Score every row of docs with models of the rows that meet train_on.

    Returns the id, n_tokens, n_known (tokens that training has seen), train_tokens (long),
    base_score (log10 of the smoothed unigram probability of the tokens), score (log10 of the
    trees' probability of the sequence), n_bytes and bits_per_byte, one row for each row of docs. A null
    text counts as empty: one token, the end. Without training rows both models are those of no
    observations. Null ids, repeated ids and repeated rows are scored like others. Other columns are
    ignored. An empty table gives an empty table. How many grams and words travel to the tasks
    changes no result, only what is joined.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.coalesce(train_on, F.lit(False)).alias("train"))
    words = written(count_words(src.filter("train").select("text"), "text"))
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    least = least_count(words, head_words)
    head = {bytes(r.w): r.n for r in words.filter(F.col("n") >= least).toLocalIterator()}  # head_words rows at most
    logs = written(gram_logs(written(count_grams(src, depth)), depth))
    least_gram = least_count(logs, head_grams)
    top = logs.filter(F.col("n") >= least_gram).select("g", "l").toArrow()  # head_grams rows at most
    packed = (list(head), np.log10(np.array(list(head.values()), float) + 0.1))
    pack = zstandard.ZstdCompressor(1).compress  # a copy for each executor lies on its disk
    sent = spark.sparkContext.broadcast((packed, *(pack(top.column(i).to_numpy().tobytes()) for i in (0, 1))))
    del top, head
    state: dict = {}

    def gram_sums(seqs: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
        """The sum over the grams of each sequence that travelled, and its other grams."""
        sums, tails = [], []
        for data, sizes, _ in _pieces(seqs, depth):
            g = _grams(data, _positions(sizes, depth), depth)
            found, lost = state["table"].find(g)
            ends = np.cumsum(sizes)
            sums.append(np.add.reduceat(found, np.r_[0, ends[:-1]]))
            cut = np.searchsorted(np.flatnonzero(lost), ends[:-1])
            tails += np.split(g[lost], cut)
        return np.concatenate(sums) if sums else np.empty(0), tails

    def each(b: pa.RecordBatch) -> dict:
        if "head" not in state:
            (names, values), grams, found = sent.value
            state["head"] = dict(zip(names, values.tolist(), strict=True))
            unpack = zstandard.ZstdDecompressor().decompress
            state["table"] = Table(np.frombuffer(unpack(grams), np.int64), np.frombuffer(unpack(found), np.float64))
        get = state["head"].get
        toks = [tokens(t) for t in texts(b)]
        seqs = [sequence(t) for t in toks]
        found = [list(map(get, t)) for t in toks]
        rare = [[w for w, x in zip(t, f, strict=True) if x is None] if None in f else [] for t, f in zip(toks, found, strict=True)]
        sums, tails = gram_sums(seqs)
        return {
            "_id": b.column(0),
            "_row": b.column(2),
            "n_tokens": list(map(len, toks)),
            "n_bytes": list(map(len, seqs)),
            "_words": [sum(x for x in f if x is not None) for f in found],
            "_grams": sums,
            "_rare_words": rare,
            "_rare_grams": pa.array(tails, pa.list_(pa.int64())),
        }

    longs = [T.StructField(n, T.LongType()) for n in ("_row", "n_tokens", "n_bytes")]
    doubles = [T.StructField(n, T.DoubleType()) for n in ("_words", "_grams")]
    lists = [T.StructField("_rare_words", T.ArrayType(T.BinaryType())), T.StructField("_rare_grams", T.ArrayType(T.LongType()))]
    numbered = src.select("_id", "text").withColumn("_row", F.monotonically_increasing_id())
    scored = written(arrow_map(numbered, each, T.StructType([src.schema["_id"], *longs, *doubles, *lists])))
    rare = scored.filter(F.size("_rare_words") > 0).select("_row", F.explode("_rare_words").alias("_w"))
    known = words.filter(F.col("n") < least).select(F.col("w").alias("_known"), "n")
    count = F.coalesce(F.col("n"), F.lit(0))
    tail = (
        rare.join(known, F.col("_w") == F.col("_known"), "left")
        .groupBy(F.col("_row").alias("_of"))
        .agg(F.sum(F.log10(count + 0.1)).alias("_more"), F.sum((count == 0).cast("long")).alias("_unknown"))
    )
    rare = scored.filter(F.size("_rare_grams") > 0).select("_row", F.explode("_rare_grams").alias("_gram"))
    others = logs.filter(F.col("n") < least_gram).select("g", "l")
    deep = rare.join(others, F.col("_gram") == F.col("g")).groupBy(F.col("_row").alias("_in")).agg(F.sum("l").alias("_deep"))
    out = scored.drop("_rare_words", "_rare_grams")
    out = out.join(tail, F.col("_row") == F.col("_of"), "left").join(deep, F.col("_row") == F.col("_in"), "left")
    norm = float(np.log10(total + 0.1 * (distinct + 1)))
    score = F.col("_grams") + F.coalesce("_deep", F.lit(0.0))
    return out.select(
        F.col("_id").alias(id_col),
        "n_tokens",
        (F.col("n_tokens") - F.coalesce("_unknown", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("_words") + F.coalesce("_more", F.lit(0.0)) - F.col("n_tokens") * norm).alias("base_score"),
        score.alias("score"),
        "n_bytes",
        (-score / float(np.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
