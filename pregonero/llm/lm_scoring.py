"""Scores texts with a log-bilinear neural language model and with smoothed word frequencies.

Tokens are words (A-Z lower-cased) and one end per text. Counts are taken over all learning texts by Spark. The model
predicts the next token's class from the two before it: the WORDS most frequent tokens are classes of their own, all others
share TAIL_CLASSES classes by their last three bytes. With context vectors r, output vectors q, a diagonal matrix per
position and a bias, the score of class w after u, v is (c1 * r[v] + c2 * r[u]) . q[w] + b[w]. It is trained in numpy by
noise-contrastive estimation on all learning tokens: Spark counts how often each triple of classes (two before, before,
class) occurs, and a triple counts in the loss as often as it occurs. So training costs what distinct triples cost, of which
there are at most 2.1 billion whatever the corpus. A triple above MOST times the mean count is cut into equal shares. Shares
are dealt into ROUNDS slices; in each round the tasks go on from common parameters over their part of a slice, and Spark
averages the parameters they arrive at, weighted by tokens, in two levels. The driver holds one set of parameters and no
text. For scoring the model is normalised exactly: batched matrix products give the log of the sum over all classes for each
pair of context classes, once. A tail token's probability is its class's times its share of the class, (c + 0.1) over the
class's sum.

Tokens counted often (at most HEAD of them, none longer than HEAD_BYTES bytes) are looked up in a broadcast table; the rest
are joined with the whole table of counts, so no token is left out.

Defined cases: null text is an empty text, whose only token is the end; a null id is neither learned from nor held out;
with nothing to learn from every count is 0; repeated rows are scored alike. An empty table gives an empty table.
"""

from __future__ import annotations

import math
import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext, cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from .store import shipped, slices, stage, unpacked

cloudpickle.register_pickle_by_value(sys.modules[__name__])

END = "\n"  # no word has a line break
WORDS = 1024
TAIL_CLASSES = 256
WIDTH = 24
HEAD = 1 << 18
HEAD_BYTES = 64
FIT_ROWS = 200_000
BATCH = 512
NOISE = 64
PASSES, ROUNDS = 1, 8
MOST = 4
RATE = 0.15
SMOOTH = 0.1
FLUSH = 1 << 19  # distinct words a task holds before it passes its counts on
TRIPLES = 1 << 21  # triples a task holds before it passes their counts on
TOGETHER = 1 << 13  # tokens looked up at once


def tokens_of(text: str | bytes | None) -> list[bytes]:
    text = text or b""
    return [*(text if isinstance(text, bytes) else text.encode()).lower().split(), END.encode()]


def in_groups(texts: pa.Array) -> Iterator[tuple[list[bytes], list[int]]]:
    """The tokens of about TOGETHER tokens' texts in a row, and how many each text has."""
    tokens, lengths = [], []
    for text in texts.cast(pa.binary()):
        before = len(tokens)
        tokens += tokens_of(text.as_py())
        lengths.append(len(tokens) - before)
        if len(tokens) >= TOGETHER:
            yield tokens, lengths
            tokens, lengths = [], []
    if lengths:
        yield tokens, lengths


def tail_class(token: bytes) -> int:
    return zlib.crc32(token[-3:]) % TAIL_CLASSES


def count_tokens(learn: DataFrame) -> DataFrame:
    """(text) -> (token, c), written."""

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["token", "c"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                counts.update(tokens_of(text.as_py()))
                if len(counts) >= FLUSH:
                    yield rows(counts)
                    counts = Counter()
        if counts:
            yield rows(counts)

    return stage(learn.mapInArrow(run, "token string, c long").groupBy("token").agg(F.sum("c").alias("c")), "token-counts")


def start_state(class_counts: np.ndarray, width: int = WIDTH, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters and, under `power_` names, the sums of their squared gradients."""
    rng = np.random.default_rng(seed)
    n_classes = len(class_counts)
    p = {
        "r": rng.normal(0, 0.1, (n_classes + 1, width)), "q": rng.normal(0, 0.1, (n_classes, width)), "b": np.log(class_counts / class_counts.sum()),
        "c1": np.ones(width), "c2": np.full(width, 0.5),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    return p | {f"power_{k}": np.ones(v.shape, np.float32) for k, v in p.items()}


def packed(state: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.ravel() for v in state.values()])


def spread(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """A state again, from its packed values."""
    parts = np.split(values.astype(np.float32), np.cumsum([v.size for v in like.values()])[:-1])
    return {k: part.reshape(v.shape) for (k, v), part in zip(like.items(), parts)}


def summed(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct entries of `at`, and the sums of their rows of values."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return at[first], np.add.reduceat(values[order], first)


def train(
    triples: np.ndarray, weights: np.ndarray, p: dict[str, np.ndarray], class_counts: np.ndarray, rng: np.random.Generator
) -> None:
    """Moves the state p on by one pass over triples (rows of class two before, class before, class; n_classes stands for
    the start of a text), each of which counts by its weight."""
    noise = class_counts / class_counts.sum()
    log_noise = np.log(NOISE * noise).astype(np.float32)
    cumulated = np.cumsum(noise)
    weights = (weights / weights.mean()).astype(np.float32)
    width = p["r"].shape[1]

    def step(name: str, at, gradient: np.ndarray) -> None:
        power = p[f"power_{name}"][at] + gradient * gradient
        p[f"power_{name}"][at] = power
        p[name][at] -= RATE * gradient / np.sqrt(power)

    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    order = rng.permutation(len(triples))
    for start in range(0, len(order), BATCH):
        at = order[start : start + BATCH]
        two, one, word = triples[at].T
        weight = weights[at]
        drawn = np.minimum(np.searchsorted(cumulated, rng.random(NOISE)), len(noise) - 1).astype(triples.dtype)
        r1, r2, q, q_drawn = p["r"][one], p["r"][two], p["q"][word], p["q"][drawn]
        context = p["c1"] * r1 + p["c2"] * r2
        # derivative of the loss by each score: data against noise
        real = (sigmoid((context * q).sum(1) + p["b"][word] - log_noise[word]) - 1) * weight
        false = sigmoid(context @ q_drawn.T + (p["b"][drawn] - log_noise[drawn])) * weight[:, None]
        by_context = real[:, None] * q + false @ q_drawn
        by_output = np.concatenate(
            (np.column_stack((real[:, None] * context, real)), np.column_stack((false.T @ context, false.sum(0))))
        )
        outputs, gradient_q = summed(np.concatenate((word, drawn)), by_output)
        inputs, gradient_r = summed(np.concatenate((one, two)), np.concatenate((by_context * p["c1"], by_context * p["c2"])))
        step("c1", slice(None), (by_context * r1).sum(0) / len(at))
        step("c2", slice(None), (by_context * r2).sum(0) / len(at))
        step("q", outputs, gradient_q[:, :width])
        step("b", outputs, gradient_q[:, width])
        step("r", inputs, gradient_r)


def decoded(codes: np.ndarray, n_classes: int) -> np.ndarray:
    """Triples of classes from their numbers, which `Lookup.codes` gives."""
    rest, word = np.divmod(codes, n_classes)
    return np.stack((*np.divmod(rest, n_classes + 1), word), axis=1).astype(np.int16)


def count_triples(learn: DataFrame, shared: Broadcast) -> DataFrame:
    """(text) -> (code, n), written: how often each triple of classes occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = unpacked(Lookup, shared)
        waiting, held = [], 0

        def counted() -> pa.RecordBatch:
            codes, n = np.unique(np.concatenate(waiting), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n.astype(np.int64))], ["code", "n"])

        for batch in batches:
            for tokens, lengths in in_groups(batch.column(0)):
                waiting.append(known.codes(known.read_tokens(tokens)[1], lengths))
                held += len(waiting[-1])
                if held >= TRIPLES:
                    yield counted()
                    waiting, held = [], 0
        if waiting:
            yield counted()

    return stage(learn.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "lm-triples")


def dealt(counted: DataFrame, n: int, distinct: int) -> DataFrame:
    """(code, n) -> (slice, code, weight), written. Shares of one triple go to all slices and tasks; no task gets them all."""
    most = MOST * n / max(distinct, 1)
    parts = F.ceil(F.col("n") / most)
    light = counted.filter(F.col("n") <= most).select("code", F.lit(0).cast("long").alias("part"), F.col("n").cast("float").alias("weight"))
    heavy = counted.filter(F.col("n") > most).select(
        "code", F.explode(F.sequence(F.lit(1).cast("long"), parts)).alias("part"), (F.col("n") / parts).cast("float").alias("weight")
    )
    rows = light.unionByName(heavy.repartition("code", "part"))
    # in the order of slices, so that a round reads the pages of its slice only
    return stage(
        rows.select(F.pmod(F.xxhash64("code", "part"), F.lit(ROUNDS)).cast("int").alias("slice"), "code", "weight").sortWithinPartitions("slice"),
        "lm-shares",
    )


def averaged(states: DataFrame, tasks: int) -> tuple[float, np.ndarray] | None:
    """(n, state) -> sum of n, mean state weighted by n. Sums are formed in two levels; the driver gets one row."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = 0.0, 0.0
        for batch in batches:
            for n, values in zip(*(batch.column(k).to_pylist() for k in (0, 1))):
                total, weight = total + n * np.frombuffer(values, np.float64), weight + n
        if weight:
            yield pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([(total / weight).tobytes()], pa.binary())], ["n", "state"])

    kind = "n double, state binary"
    rows = states.repartition(math.isqrt(tasks)).mapInArrow(add, kind).repartition(1).mapInArrow(add, kind).collect()
    return (rows[0][0], np.frombuffer(rows[0][1], np.float64)) if rows else None


def train_everywhere(shares: DataFrame, rows: int, class_counts: np.ndarray, passes: int, fit_rows: int) -> dict[str, np.ndarray]:
    """shares (written): rows of (slice, code, weight). A task trains on about `fit_rows` of a slice at a time."""
    spark = shares.sparkSession
    state = start_state(class_counts)
    tasks = max(1, rows // ROUNDS // fit_rows)
    for number in range(passes * ROUNDS if rows else 0):
        given = spark.sparkContext.broadcast((state, class_counts))

        def run(batches: Iterator[pa.RecordBatch], given=given, number=number) -> Iterator[pa.RecordBatch]:
            state, counts = given.value
            mine = {k: v.copy() for k, v in state.items()}
            rng = np.random.default_rng([number, TaskContext.get().partitionId()])
            waiting, n_waiting, seen = [], 0, 0.0

            def go() -> None:
                codes, weights = (np.concatenate([w[k] for w in waiting]) for k in (0, 1))
                train(decoded(codes, len(counts)), weights, mine, counts, rng)

            for batch in batches:
                waiting.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
                n_waiting, seen = n_waiting + batch.num_rows, seen + float(waiting[-1][1].sum(dtype=np.float64))
                if n_waiting >= fit_rows:
                    go()
                    waiting, n_waiting = [], 0
            if n_waiting:
                go()
            if seen:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([seen]), pa.array([packed(mine).astype(np.float64).tobytes()], pa.binary())], ["n", "state"]
                )

        now = shares.filter(F.col("slice") == number % ROUNDS).select("code", "weight").coalesce(tasks)
        found = averaged(now.mapInArrow(run, "n double, state binary"), tasks)
        if found:
            state = spread(found[1], state)
        given.unpersist()
    return state


def log_sums(p: dict[str, np.ndarray], before: int) -> np.ndarray:
    """Log of the sum over all classes for the context (any class, `before`): one number per class two before."""
    scores = (p["c1"] * p["r"][before] + p["c2"] * p["r"]) @ p["q"].T + p["b"]
    top = scores.max(axis=1)
    return (top + np.log(np.exp(scores - top[:, None]).sum(axis=1))).astype(np.float32)


class Lookup:
    """Broadcast part of the model: frequent tokens, class shares, parameters."""

    def __init__(self, head: list[tuple[str, int]], words: int, class_sums: np.ndarray):
        self.numbers = {w.encode(): i for i, (w, _) in enumerate(head)}
        self.log_c = np.log10(np.array([c for _, c in head], float) + SMOOTH)
        self.log_sum = np.log10(class_sums)
        n = min(words, len(head))
        tails = [tail_class(w.encode()) for w, _ in head[n:]]
        self.classes = np.concatenate((np.arange(n), words + np.array(tails, np.int64))).astype(np.int64)
        self.share = np.zeros(len(head))
        self.share[n:] = self.log_c[n:] - self.log_sum[tails] if tails else []
        self.words, self.n_classes = words, words + TAIL_CLASSES
        self.tables: tuple | None = None

    def read(self, text: str | None) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        return self.read_tokens(tokens_of(text))

    def read_tokens(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Head numbers of the tokens (-1 if not in the head), their classes, and the tokens not in the head."""
        at = np.fromiter(map(self.numbers.get, tokens, repeat(-1)), np.int64, len(tokens))
        missing = np.flatnonzero(at < 0)
        others = [tokens[i] for i in missing.tolist()]
        classes = self.classes[at] if len(self.classes) else np.zeros(len(at), np.int64)
        if others:
            classes[missing] = self.words + np.fromiter(map(tail_class, others), np.int64, len(others))
        return at, classes, others

    def contexts(self, classes: np.ndarray, lengths: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The classes before and two before, of texts in a row (or of one); each begins after two starts."""
        lengths = [len(classes)] if lengths is None else lengths
        w = np.concatenate(([self.n_classes] * 2, classes))
        before, two_before = w[1:-1].copy(), w[:-2].copy()
        starts = np.cumsum([0, *lengths[:-1]])
        before[starts] = two_before[starts] = self.n_classes
        seconds = starts[np.asarray(lengths) > 1] + 1
        two_before[seconds] = self.n_classes
        return before, two_before

    def codes(self, classes: np.ndarray, lengths: list[int] | None = None) -> np.ndarray:
        """One number for each triple of classes (two before, before, class) of texts in a row."""
        before, two_before = self.contexts(classes, lengths)
        return (two_before * (self.n_classes + 1) + before) * self.n_classes + classes

    def set_model(self, p: dict[str, np.ndarray], sums: np.ndarray) -> None:
        self.tables = ((p["r"] * p["c1"]) @ p["q"].T, (p["r"] * p["c2"]) @ p["q"].T, p["b"], sums)

    def log_probabilities(self, classes: np.ndarray, lengths: list[int] | None = None) -> np.ndarray:
        one, two, b, sums = self.tables
        (before, two_before), n = self.contexts(classes, lengths), self.n_classes
        # places in the flat tables: a row of the first two has n numbers, one of the sums n + 1
        return one.take(before * n + classes) + two.take(two_before * n + classes) + b.take(classes) - sums.take(before * (n + 1) + two_before)


def rest_column(counts: list[Counter]) -> pa.ListArray:
    """Per text the tokens that are not in the head, with their numbers."""
    ends = np.concatenate(([0], np.cumsum([len(c) for c in counts]))).astype(np.int32)
    tokens = pa.array([w for c in counts for w in c], pa.binary()).cast(pa.string())
    numbers = pa.array([n for c in counts for n in c.values()], pa.int64())
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([tokens, numbers], ["token", "n"]))


class Model:
    def __init__(self, counts: DataFrame, lookup: Lookup, n: int, v: int):
        self.counts, self.lookup, self.n, self.v = counts, lookup, n, v


def fit(learn: DataFrame, words: int = WORDS, head: int = HEAD, passes: int = PASSES, fit_rows: int = FIT_ROWS) -> Model:
    """learn: (id, text). passes: how often training goes over all learning tokens."""
    spark = learn.sparkSession
    counts = count_tokens(learn.select("text"))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # the head goes down to a count at which it has at most `head` tokens; counts are binned by their logarithm
    short = counts.filter(F.octet_length("token") <= HEAD_BYTES).withColumn("bin", F.floor(F.log2("c") * 64).cast("int"))
    bins = sorted(((r[0], r[1]) for r in short.groupBy("bin").agg(F.count("*")).collect()), reverse=True)
    lowest, total = None, 0
    for b, size in bins:
        total += size
        if total > head:
            break
        lowest = b
    rows = [] if lowest is None else [tuple(r) for r in short.filter(F.col("bin") >= lowest).select("token", "c").collect()]
    rows.sort(key=lambda r: (-r[1], r[0]))
    own = [w for w, _ in rows[:words]]
    sums = np.full(TAIL_CLASSES, SMOOTH)
    kind = F.pmod(F.crc32(F.expr("substring(cast(token as binary), -3)")), F.lit(TAIL_CLASSES))
    for k, s in counts.filter(~F.col("token").isin(own)).groupBy(kind).agg(F.sum(F.col("c") + SMOOTH)).collect():
        sums[k] += s
    lookup = Lookup(rows, words, sums)
    class_counts = np.concatenate((np.zeros(words), sums - SMOOTH)) + 0.5
    class_counts[: len(own)] += [c for _, c in rows[:words]]
    shared = shipped(spark, lookup)

    counted = count_triples(learn.select("text"), shared)
    shares = dealt(counted, n, counted.count())
    p = train_everywhere(shares, shares.count(), class_counts, passes, fit_rows)
    p = {k: v for k, v in p.items() if not k.startswith("power_")}
    given = spark.sparkContext.broadcast(p)

    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [log_sums(given.value, i).tobytes() for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["id", "sums"])

    # at most WORDS + TAIL_CLASSES + 1 rows
    table = spark.range(lookup.n_classes + 1).mapInArrow(normalise, "id long, sums binary").collect()
    lookup.set_model(p, np.stack([np.frombuffer(r[1], np.float32) for r in sorted(table)]))
    return Model(counts, lookup, n, v)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(id, text, ...) -> the other columns, then n_tokens, n_known, base_score, score: one row per row of docs."""
    spark = docs.sparkSession
    others = [f for f in docs.schema.fields if f.name != "text"]
    at_text = docs.columns.index("text")
    rest = T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("n", T.LongType())]))
    schema = T.StructType(
        [
            T.StructField("row_no", T.LongType()), *others, T.StructField("n_tokens", T.LongType()), T.StructField("known", T.LongType()),
            T.StructField("base", T.DoubleType()), T.StructField("part", T.DoubleType()), T.StructField("rest", rest),
        ]
    )
    floor = float(np.log10(model.n + SMOOTH * (model.v + 1)))
    shared = shipped(spark, model.lookup)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, row = unpacked(Lookup, shared), TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            found = []
            for tokens, lengths in in_groups(batch.column(at_text)):
                at, classes, missing = lookup.read_tokens(tokens)
                known = at >= 0
                head, logs = at[known], lookup.log_probabilities(classes, lengths)
                shares, log_c, log_sums = lookup.share[head], lookup.log_c[head], lookup.log_sum[classes[~known] - lookup.words]
                ends = np.cumsum(lengths)
                heads = np.cumsum(known)[ends - 1].tolist()
                begin = first = 0
                for end, last in zip(ends.tolist(), heads):
                    part = float(logs[begin:end].sum(dtype=np.float64)) / np.log(10)
                    if last > first:
                        part += float(shares[first:last].sum())
                    lost, lost_end = begin - first, end - last
                    if lost_end > lost:
                        part -= float(log_sums[lost:lost_end].sum())
                    base = float(log_c[first:last].sum()) - (end - begin) * floor
                    found.append((row, end - begin, last - first, base, part, Counter(missing[lost:lost_end])))
                    row, begin, first = row + 1, end, last
            new = list(zip(*found)) or [()] * 6
            kinds = [pa.int64()] * 3 + [pa.float64()] * 2
            new = [*[pa.array(c, k) for c, k in zip(new, kinds)], rest_column(new[5])]
            kept = [c for i, c in enumerate(batch.columns) if i != at_text]
            yield pa.RecordBatch.from_arrays([new[0], *kept, *new[1:]], schema.names)

    rows = stage(docs.mapInArrow(run, schema), "lm-rows")
    tail = rows.select("row_no", F.explode("rest").alias("one")).select("row_no", "one.token", "one.n")
    sums = tail.join(model.counts, "token", "left").groupBy("row_no").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("more_known")
    )
    more = F.coalesce("more", F.lit(0.0))
    return rows.join(sums, "row_no", "left").select(
        *[f.name for f in others], "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        (F.col("base") + more).alias("base_score"), (F.col("part") + more).alias("score"),
    )
