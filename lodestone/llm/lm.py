"""Language-model scoring: a causal self-attention model over subword ids, beside a unigram word score.

Counting pass. Words of the training documents are counted by 64-bit hash in each task and summed by one shuffle of distinct
words; subword counts come along. The most frequent words, a table of at most ``HOT_WORDS`` rows, go to every worker; all
others are looked up by a join on their hashes, each document sending each of its rare words once, so neither frequent words
nor frequent documents meet in one task.

Model. A subword is one of ``CLASSES`` classes (the most frequent ones by themselves, the rest shared out) times its share of
the class. The class comes from one layer of causal attention, written in numpy: query, key and value rows by frequency
bucket, biases by distance, and the current subword's own row, into a softmax.

Training. Every window of every training document is trained on once. The counting pass writes them, in chunks of ``CHUNK``
consecutive ones. Chunks are dealt by a hash into ``ROUNDS`` rounds and, within a round, into lanes of about ``LANE`` chunks, whose
number grows with the input. A lane is trained by Adam in one task, in the order of the hashes; the lanes' parameters are
averaged by one small aggregation, from which the next round starts. So the result does not depend on how the input is
partitioned, but for the rounding of sums.

Scoring pass. A document's subwords are cut into windows of ``WINDOW``; each is scored once, with at least
``WINDOW - STRIDE`` earlier ones (where there are any) as context, in batches of windows under one mask.

Null and empty texts are one end token. Very long texts are cut into windows like others. Repeated rows score alike. Further
columns are ignored. Without training documents all counts are zero. Empty tables give no rows. Two words fall together with
a chance of 2**-64 a pair.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import discard, frequent, remainder, written
from lodestone.llm.units import held, library_encoder

VOCABULARY, END = 50_257, 50_256
DIM, BUCKETS, CLASSES = 8, 1024, 96
OWN_BUCKETS, OWN_CLASSES = 960, 72
WINDOW, STRIDE = 32, 24
BACK = WINDOW - STRIDE
HOT_WORDS = 1 << 17
#: Windows of a stored chunk; rounds of averaging; chunks of a lane.
CHUNK, ROUNDS, LANE = 8, 4, 2048
BATCH = 48
#: In a stored chunk, what is no subword; numbers that a chunk has.
NONE, STORED = 65_535, BACK + CHUNK * STRIDE + 1
#: By bucket: a query and the subword's own row, and a key and a value; biases by distance; the output layer, its biases last.
SHAPES = {"qe": (BUCKETS, 2 * DIM), "kv": (BUCKETS, 2 * DIM), "near": (WINDOW,), "w": (2 * DIM + 1, CLASSES)}
ENDS = np.cumsum([int(np.prod(s)) for s in SHAPES.values()]).tolist()
PARAMETERS = ENDS[-1]
#: Numbers up to this size are put into exp as they are; sums and quotients of the results stay within 32-bit floats.
PLAIN = 40


class WordBook(dict):
    """Numbers words as they come; arrays by number hold the hash, the subword ids and, once given, the count's logarithm."""

    MOST = 700_000

    def __init__(self, path: str, pattern: str):
        super().__init__()
        self.encode, self.find, self.parts = library_encoder(path), regex.compile(pattern).findall, {}
        self.hot: tuple[np.ndarray, np.ndarray] | None = None
        self.start_afresh()

    def start_afresh(self) -> None:
        self.clear()
        self.hash, self.size, self.at, self.ids, self.log = array("Q"), array("i"), array("q"), array("i"), np.empty(0)
        self.add(b"", [END])

    def trim(self) -> bool:
        """When the book is full, keep the half that came first, as frequent words come early; their numbers stay."""
        if len(self) <= self.MOST:
            return False
        n = self.MOST // 2
        early = list(islice(self.items(), n))
        end = self.at[n]
        self.clear()
        self.update(early)
        self.hash, self.size, self.at, self.ids, self.log = self.hash[:n], self.size[:n], self.at[:n], self.ids[:end], self.log[:n]
        return True

    def add(self, word: bytes, ids: list[int]) -> int:
        n = self[word] = len(self.hash)
        self.hash.append(xxhash.xxh3_64_intdigest(word))
        self.size.append(len(ids))
        self.at.append(len(self.ids))
        self.ids.extend(ids)
        return n

    def __missing__(self, word: bytes) -> int:
        out = []
        for m in self.find(" " + word.decode()):
            ids = self.parts.get(m)
            if ids is None:
                if len(self.parts) > 150_000:
                    self.parts.clear()
                ids = tuple(self.encode(m))  # the garbage collector need not look through tuples of numbers
                if len(m) <= 40:  # words share these parts, as before a comma
                    self.parts[m] = ids
            out += ids
        return self.add(word, out)

    def numbers(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words of the texts, each text followed by the end word (number 0), and the texts' lengths."""
        flat, sizes = [], []
        for t in texts:
            words = t.lower().split() if t else []
            flat += words
            flat.append(b"")
            sizes.append(len(words) + 1)
        return np.fromiter(map(self.__getitem__, flat), np.int64, len(flat)), np.array(sizes, np.int64)

    def subwords(self, numbers: np.ndarray) -> np.ndarray:
        size = np.frombuffer(self.size, np.int32)[numbers].astype(np.int64)
        first = np.frombuffer(self.at, np.int64)[numbers] - (np.cumsum(size) - size)
        return np.frombuffer(self.ids, np.int32)[np.repeat(first, size) + np.arange(size.sum())]

    def logs(self, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """log10(count + 1) by word number, nan for words that are not hot."""
        if self.hot is None or self.hot[0] is not hot[0]:
            self.hot, self.log = hot, np.empty(0)
        new = np.array(self.hash[len(self.log) :], np.uint64)
        if len(new):
            keys, values = hot
            at = np.minimum(np.searchsorted(keys, new), max(0, len(keys) - 1))
            got = np.where(keys[at] == new, values[at], np.nan) if len(keys) else np.full(len(new), np.nan)
            self.log = np.concatenate((self.log, got))
        return self.log


def keep_memory() -> None:
    """From now on this process keeps the memory that arrays free: glibc does so up to the largest mapped block that was freed,
    of at most 32 MB. Else pages are asked of the system anew for each larger array, which costs more than what is computed."""
    np.empty(31 << 20, np.uint8)


def book(path: str, pattern: str) -> WordBook:
    return held(("word book", path), lambda: WordBook(path, pattern))


def slices(b: pa.RecordBatch, column: int, chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of rows of about so many bytes."""
    start = size = 0
    for i, n in enumerate(x or 0 for x in pc.binary_length(b.column(column)).to_pylist()):
        size += n
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < b.num_rows:
        yield start, b.num_rows


def counted(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows of three kinds over all documents: counts (token, h, c, null) of words by hash and of subwords (token true) by id,
    to be summed; and chunks (null, h, 1, w) to train on, h a hash of the document's id and the chunk's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        words, totals = book(path, pattern), np.zeros(0, np.int64)
        words.trim()

        def out() -> pa.RecordBatch:
            n = np.flatnonzero(totals)
            c = totals[n]
            size = np.frombuffer(words.size, np.int32)[n]
            ids = np.bincount(words.subwords(n), np.repeat(c, size), VOCABULARY).astype(np.int64)
            t = np.flatnonzero(ids)
            h = np.concatenate((np.frombuffer(words.hash, np.uint64)[n].view(np.int64), t))
            return pa.RecordBatch.from_arrays([pa.array(np.arange(len(h)) >= len(n)), pa.array(h), pa.array(np.concatenate((c, ids[t]))), pa.nulls(len(h), pa.binary())], names=["token", "h", "c", "w"])

        for b in batches:
            for i, j in slices(b, 0):
                numbers, n_words = words.numbers(b.column(0)[i:j].to_pylist())
                got = np.bincount(numbers, minlength=len(totals))
                got[: len(totals)] += totals
                totals = got
                sizes = grouped(np.frombuffer(words.size, np.int32)[numbers].astype(np.int64), n_words)
                w, h = stored_chunks(words.subwords(numbers), sizes, np.asarray(b.column(1)[i:j]).astype(np.int64))
                rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * STORED), len(w), [None, pa.py_buffer(w.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.nulls(len(w), pa.bool_()), pa.array(h), pa.array(np.ones(len(w), np.int64)), rows], names=["token", "h", "c", "w"])
                if len(words) > words.MOST:
                    yield out()
                    words.trim()
                    totals = np.zeros(0, np.int64)
        yield out()

    return docs.select(F.col("text").cast("binary"), F.xxhash64("doc_id")).mapInArrow(run, "token boolean, h long, c long, w binary")


def stored_chunks(ids: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chunks, their hashes): the inputs of a chunk's positions as 16-bit numbers, with those of BACK positions before them and one
    after. A position's own subword is the next one's input; the input of the position behind a document's end is its last subword."""
    n = -(-sizes // (CHUNK * STRIDE))
    doc = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = (k * (CHUNK * STRIDE) - BACK)[:, None] + np.arange(STORED)[None, :]  # positions within the document
    there = (at >= 0) & (at <= sizes[doc][:, None])
    place = np.where(there & (at > 0), at - 1 + (np.cumsum(sizes) - sizes)[doc][:, None], 0)
    x = np.where(there, np.where(at > 0, ids[place], END), NONE).astype("<u2")
    h = (hashes[doc].view(np.uint64) ^ (k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    return x, (h ^ (h >> np.uint64(31))).view(np.int64)


def chunk_windows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, scored subwords, which places are real, which positions are scored) of the windows of stored chunks."""
    x = np.lib.stride_tricks.sliding_window_view(rows, WINDOW, axis=1)[:, : CHUNK * STRIDE : STRIDE].reshape(-1, WINDOW)
    after = np.lib.stride_tricks.sliding_window_view(rows[:, 1:], WINDOW, axis=1)[:, : CHUNK * STRIDE : STRIDE].reshape(-1, WINDOW)
    real = (x != NONE) & (after != NONE)
    keep = real[:, BACK]  # a window begins with a scored position
    x, after, real = x[keep], after[keep], real[keep]
    return np.where(real, x, 0), np.where(real, after, 0)[:, BACK:], real, real[:, BACK:]


class Vocabulary:
    """Bucket, class and share of its class (log10) of every subword, from the corpus' counts.

    Frequent subwords have a bucket and a class of their own; those that start words share other ones than those that go on.
    """

    def __init__(self, counts: np.ndarray, starts: np.ndarray):
        order = np.lexsort((np.arange(VOCABULARY), -counts))
        rank = np.empty(VOCABULARY, np.int64)
        rank[order] = np.arange(VOCABULARY)
        shared = lambda own, all: np.where(rank < own, rank, own + rank % ((all - own) // 2) * 2 + starts).astype(np.int32)
        self.bucket, self.kind = shared(OWN_BUCKETS, BUCKETS), shared(OWN_CLASSES, CLASSES)
        smooth = counts + 0.5
        whole = np.bincount(self.kind, smooth, CLASSES)
        self.share = np.log10(smooth / whole[self.kind]).astype(np.float32)
        self.prior = np.log(whole / whole.sum()).astype(np.float32)


def word_starts(path: str) -> np.ndarray:
    """Whether each subword begins with a space."""
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(path)
    return np.array([(known.id_to_token(i) or "").startswith("\u0120") for i in range(VOCABULARY)])


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    return {name: flat[at:end].reshape(shape) for (name, shape), at, end in zip(SHAPES.items(), [0, *ENDS], ENDS, strict=False)}


def initial(prior: np.ndarray) -> np.ndarray:
    flat = np.random.default_rng(7).normal(0, 0.1, PARAMETERS).astype(np.float32)
    p = unpack(flat)
    p["near"][:] = 0
    p["w"] *= 0.5
    p["w"][-1] = prior
    return flat


# Rows are scored positions, columns the window's places; a position sees itself and what stands before it.
AGO = BACK + np.arange(STRIDE)[:, None] - np.arange(WINDOW)[None, :]
NEAR = np.where(AGO >= 0, AGO, WINDOW)
BY_AGO = (NEAR.reshape(-1, 1) == np.arange(WINDOW)).astype(np.float32)


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places in the flat ids (n, WINDOW), which of them are real, which positions are scored (n, STRIDE), and the document."""
    n = -(-sizes // STRIDE)
    doc = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    inner = (k * STRIDE - BACK)[:, None] + np.arange(WINDOW)[None, :]
    real = (inner >= 0) & (inner < sizes[doc][:, None])
    first = (np.cumsum(sizes) - sizes)[doc][:, None]
    return np.where(real, inner + first, 0), real, real[:, BACK:], doc


ONES = {x: np.ones(CLASSES, x) for x in "fd"}


def rows_of(table: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    return table.take(numbers, 0, mode="clip")  # without the copy that a check of bounds makes


def summed(x: np.ndarray) -> np.ndarray:
    """Sums along the last axis, by the matrix library."""
    return x @ ONES[x.dtype.char][: x.shape[-1]]


def small(x: np.ndarray, more: float = 0) -> bool:
    return max(x.max(), -x.min()) + more <= PLAIN


def exponentials(z: np.ndarray) -> tuple[np.ndarray, np.ndarray | float]:
    """The rows' sums of exp(z), which replaces z, and what was taken from the rows before: their largest where numbers are not small."""
    top = 0.0
    if not small(z):
        top = z.max(1)
        z -= top[:, None]
    np.exp(z, out=z)
    return summed(z), top


def forward(p: dict[str, np.ndarray], x: np.ndarray, real: np.ndarray, attend: bool = True) -> tuple[np.ndarray, ...]:
    """Attention of the scored positions over their windows; x: buckets (n, WINDOW). attend False: each sees its own row only.

    Gives queries, keys, values, weights, what the weights have to be multiplied with to sum up to 1, hidden rows and logits.
    """
    qe, kv = rows_of(p["qe"], x[:, BACK:]), rows_of(p["kv"], x)
    q, k, v = qe[..., :DIM], kv[..., :DIM], kv[..., DIM:]
    h = np.empty((*qe.shape[:2], 2 * DIM + 1), qe.dtype)
    h[..., DIM:-1] = qe[..., DIM:]
    h[..., -1] = 1
    a = np.matmul(q, k.transpose(0, 2, 1))
    a *= DIM**-0.5
    edge = np.flatnonzero(~real.all(1))
    if small(a, np.abs(p["near"]).max()):
        np.exp(a, out=a)
        seen = np.zeros(WINDOW + 1, a.dtype)
        np.exp(p["near"], out=seen[:WINDOW])
        a *= rows_of(seen, NEAR)
        a[edge] *= real[edge][:, None, :]
    else:
        a += rows_of(np.append(p["near"], -1e9).astype(a.dtype), NEAR)
        a[edge] -= np.where(real[edge], 0, 1e9).astype(a.dtype)[:, None, :]
        a -= a.max(2, keepdims=True)
        np.exp(a, out=a)
    part = np.maximum(summed(a.reshape(-1, WINDOW)), 1e-30)  # places that are not real may see nothing
    part = np.reciprocal(part, out=part).reshape(*a.shape[:2], 1)
    if attend:
        np.multiply(np.matmul(a, v), part, out=h[..., :DIM])
    else:
        h[..., :DIM] = 0
    return q, k, v, a, part, h, h.reshape(-1, 2 * DIM + 1) @ p["w"]


PAIRS = np.arange(BUCKETS * DIM).reshape(BUCKETS, DIM)


def add_rows(table: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Add values (..., 2 * DIM) to the table's rows, two numbers at a time as one complex one."""
    kind = np.result_type(table, np.complex64)
    np.add.at(table.view(kind).ravel(), rows_of(PAIRS, rows).ravel(), values.view(kind).ravel())


def gradient(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, real: np.ndarray, scored: np.ndarray, attend: bool = True) -> np.ndarray:
    """Gradient of the mean loss over the scored positions, as one flat array in the order of SHAPES."""
    q, k, v, a, part, h, z = forward(p, x, real, attend)
    flat = np.zeros(PARAMETERS, z.dtype)
    g, sums = unpack(flat), exponentials(z)[0]
    z.reshape(-1)[np.arange(0, z.size, CLASSES) + y.ravel()] -= sums
    share = (scored.ravel() / (sums * max(1, np.count_nonzero(scored))))[:, None]  # z's rows times it are the logits' gradient
    dh = z @ p["w"][:-1].T
    dh *= share
    dh = dh.reshape(*h.shape[:2], 2 * DIM)
    if attend:
        do = dh[..., :DIM] * part
        ds = np.matmul(do, v.transpose(0, 2, 1))
        ds -= summed(do * h[..., :DIM])[..., None]  # the mean over what is attended to
        ds *= a
        g["near"][:] = ds.sum(0).ravel() @ BY_AGO
        ds *= DIM**-0.5
        dkv = np.empty((*x.shape, 2 * DIM), z.dtype)
        np.matmul(ds.transpose(0, 2, 1), q, out=dkv[..., :DIM])
        np.matmul(a.transpose(0, 2, 1), do, out=dkv[..., DIM:])
        np.matmul(ds, k, out=dh[..., :DIM])  # dh now holds the gradient of the queries and own rows
        add_rows(g["kv"], x, dkv)
    else:
        dh[..., :DIM] = 0
    add_rows(g["qe"], x[:, BACK:], dh)
    h = h.reshape(len(z), -1)
    h *= share
    g["w"][:] = (z.T @ h).T
    return flat


def inputs(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each subword's predecessor, the end token before the first."""
    x = np.empty_like(ids)
    x[1:] = ids[:-1]
    x[np.cumsum(sizes) - sizes] = END
    return x


def grouped(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs; no run is empty."""
    return np.add.reduceat(values, np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0)


def lane_trainer(start, classes, rate: float, attend: bool):
    """A function from a lane's chunks to its parameters (i, n, x), n the subwords that it was trained on, x the parameter times n."""

    def run(lane: pa.Table) -> pa.Table:
        keep_memory()
        bucket, kind = classes.value
        now, (m, s), step = start.value.copy(), np.zeros((2, len(start.value)), np.float32), 0  # m, s: 10 and 100 times Adam's means
        lane = lane.sort_by([("h", "ascending"), ("w", "ascending")])
        rows = np.frombuffer(b"".join(lane.column("w").to_pylist()), "<u2").reshape(-1, STORED)
        x, y, real, scored = chunk_windows(rows)
        x, y = bucket[x], kind[y]
        p = unpack(now)
        for at in range(0, len(x), BATCH):
            w = slice(at, at + BATCH)
            g = gradient(p, x[w], y[w], real[w], scored[w], attend)
            step += 1
            root = (1 - 0.99**step) ** 0.5
            m *= 0.9
            m += g
            s *= 0.99
            g *= g
            s += g
            np.sqrt(s, out=g)
            g += 1e-5 * root
            np.divide(m, g, out=g)
            g *= rate * root / (1 + step / 2000) / (1 - 0.9**step)
            now -= g
        n = float(scored.sum())
        return pa.table({"i": pa.array(np.arange(len(now), dtype=np.int32)), "n": pa.array(np.full(len(now), n)), "x": pa.array(now.astype(np.float64) * n)})

    return run


def trained(stored: DataFrame, vocabulary: Vocabulary, rate: float = 0.02, attend: bool = True) -> np.ndarray:
    """Parameters after ROUNDS rounds of training in lanes and averaging over them, weighed by their subwords. stored: (h, w)."""
    flat, spark = initial(vocabulary.prior), stored.sparkSession
    lanes = max(1, -(-stored.count() // (ROUNDS * LANE)))
    classes = spark.sparkContext.broadcast((vocabulary.bucket, vocabulary.kind))
    for r in range(ROUNDS):
        part = stored.where(F.pmod("h", F.lit(ROUNDS)) == r).select(F.pmod(F.xxhash64("h"), F.lit(lanes)).alias("lane"), "h", "w")
        done = part.groupBy("lane").applyInArrow(lane_trainer(spark.sparkContext.broadcast(flat), classes, rate, attend), "i int, n double, x double")
        mean = done.groupBy("i").agg((F.sum("x") / F.sum("n")).alias("x")).toPandas()
        if len(mean):
            flat = flat.copy()
            flat[mean.i.to_numpy()] = mean.x.to_numpy()
    return flat


def log_probability(p: dict[str, np.ndarray], vocabulary: Vocabulary, ids: np.ndarray, sizes: np.ndarray, attend: bool = True) -> np.ndarray:
    """log10 probability of each document's subwords, each scored once."""
    x, kind = vocabulary.bucket[inputs(ids, sizes)], vocabulary.kind[ids]
    place, real, scored, _ = windows(sizes)
    out, done = np.zeros(len(ids), np.float32), 0
    for at in range(0, len(place), 256):
        w = slice(at, at + 256)
        z = forward(p, rows_of(x, place[w]), real[w], attend)[-1]
        got = z[np.arange(len(z)), rows_of(kind, place[w, BACK:]).ravel()]
        sums, top = exponentials(z)
        got -= np.log(sums) + top
        got = got[scored[w].ravel()]
        out[done : done + len(got)] = got  # windows follow each other as the subwords do
        done += len(got)
    return grouped(out.astype(np.float64) * np.log10(np.e) + vocabulary.share[ids], sizes)


def score(docs: DataFrame, path: str, pattern: str, held_out: int = 2, parts: int = 7, attend: bool = True) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of doc_id, text.

    attend False trains and scores a model without context, to compare with.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    training = docs.where(F.coalesce(remainder("doc_id", parts) != held_out, F.lit(True)))
    gathered = written(counted(training, path, pattern), "gathered", "zstd")
    counts = written(gathered.where("token is not null").groupBy("token", "h").agg(F.sum("c").alias("c")), "counts")
    words = counts.where("not token").select("h", "c")
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = frequent(words, HOT_WORDS).toPandas().sort_values("h", key=lambda h: h.to_numpy(np.int64).view(np.uint64))
    hot = spark.sparkContext.broadcast((top.h.to_numpy(np.int64).view(np.uint64), np.log10(top.c.to_numpy(np.float64) + 1)))
    by_id = counts.where("token").select("h", "c").toPandas()  # at most one row for each subword
    tokens = np.zeros(VOCABULARY)
    tokens[by_id.h.to_numpy(np.int64)] = by_id.c.to_numpy()
    vocabulary = Vocabulary(tokens, word_starts(path))
    model = spark.sparkContext.broadcast((trained(gathered.where("w is not null").select("h", "w"), vocabulary, attend=attend), vocabulary))
    discard(gathered)
    schema = "doc_id long, n_tokens long, n_hot long, log_hot double, score double, rare array<long>, times array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        words, (flat, vocab) = book(path, pattern), model.value
        p = unpack(flat)
        for b in batches:
            for i, j in slices(b, 1):
                words.trim()
                numbers, sizes = words.numbers(b.column(1)[i:j].to_pylist())
                logs = words.logs(hot.value)[numbers]
                known = ~np.isnan(logs)
                length = np.frombuffer(words.size, np.int32)[numbers].astype(np.int64)
                got = log_probability(p, vocab, words.subwords(numbers), grouped(length, sizes), attend)
                doc, rare = np.repeat(np.arange(len(sizes)), sizes)[~known], np.frombuffer(words.hash, np.uint64)[numbers[~known]].view(np.int64)
                order = np.lexsort((rare, doc))
                doc, rare = doc[order], rare[order]
                first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (rare[1:] != rare[:-1]))[: len(doc)])
                seen, times = (doc[first], rare[first]), np.diff(np.append(first, len(doc)))
                ends = pa.array(np.searchsorted(seen[0], np.arange(len(sizes) + 1)), pa.int32())
                cols = [b.column(0)[i:j], pa.array(sizes), pa.array(grouped(known.astype(np.int64), sizes)), pa.array(grouped(np.where(known, logs, 0), sizes)), pa.array(got), pa.ListArray.from_arrays(ends, pa.array(seen[1])), pa.ListArray.from_arrays(ends, pa.array(times, pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "n_hot", "log_hot", "score", "rare", "times"])

    scored = written(docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, schema).withColumn("uid", F.monotonically_increasing_id()), "scored")
    rare = scored.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("uid", F.col("x.rare").alias("h"), F.col("x.times").alias("t"))
    found = rare.join(words, "h").groupBy("uid").agg(F.sum("t").alias("n_rare"), F.sum(F.col("t") * F.log10(F.col("c") + 1)).alias("log_rare"))
    out = scored.drop("rare", "times").join(found, "uid", "left")
    base = F.col("log_hot") + F.coalesce("log_rare", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(n + v + 1))
    return out.select(
        "doc_id", F.coalesce(remainder("doc_id", parts) == held_out, F.lit(False)).alias("held_out"), "n_tokens", (F.col("n_hot") + F.coalesce("n_rare", F.lit(0))).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
    )
