"""Language-model scores from a log-bilinear model trained by noise-contrastive estimation in numpy.

The model predicts a token from the two before it, in two steps: the token's class, by a log-bilinear
network (a linear map of the embeddings of both context classes, multiplied with the embeddings of all
classes), then the token within its class, by discounted counts. The most frequent words and the end of
a text are classes of their own; other words fall into classes by their last two bytes. A class leaves a
share for unseen words, so class and token probabilities each sum to one and no text is impossible.

1. Words are counted over the whole corpus, in training texts and in all.
2. The most frequent words (a bounded list) go to the tasks; a pass over the texts writes each text's
   classes, a byte a token, and its other words with their counts.
3. Training needs nothing but the counts of class triples, of which there are at most ``CLASSES ** 3``
   however large the corpus; they are summed with map-side combining and packed by first class.
4. A step of training is a Spark job: tasks sum the gradient of the noise-contrastive objective over
   their triples, with the expectation over the noise distribution taken exactly, as classes are few.
   The driver adds up at most ``PARTS`` gradients of the model's size.
5. A batch of matrix products gives the normalised log-probabilities of all classes after all contexts;
   texts look them up, and the other words of a text join their counts.

Defined cases: a null text is empty and scores its end alone; a null id counts as an empty one, which is
a training text; repeated rows are texts of their own; words of any length are compared as a whole; with
no training text the classes have the probabilities of an untrained model and base scores are 0; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import materialize, numbered

CLASSES = 256
#: words with a class of their own; class 0 is the end of a text, the classes after these go by last bytes
OWN = 191
SUFFIXES = CLASSES - 1 - OWN
#: most frequent words whose counts are sent to every task
FREQUENT = 65_536
DIM = 32
#: noise tokens for each token of the corpus
NOISE = 25
STEPS = 40
RATE = 0.05
#: at most so many tasks, and gradients, in a step
PARTS = 32
#: counted words a task holds before it passes them on
HELD_WORDS = 500_000
END = b""


def words_of(text: str) -> list[bytes]:
    """Words between white space of ASCII, with A to Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2


def suffix_class(word: bytes) -> int:
    return 1 + OWN + zlib.crc32(word[-2:]) % SUFFIXES


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, n, everywhere``: how often each word occurs in training texts and in all; the end is a word."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64()), ("everywhere", pa.int64())])

    def passed_on(held: tuple[Counter, Counter]) -> Iterator[pa.RecordBatch]:
        train, rest = held
        names = list(train) + [w for w in rest if w not in train]
        for at in range(0, len(names), 65536):
            some = names[at : at + 65536]
            n = np.fromiter((train[w] for w in some), np.int64, len(some))
            more = np.fromiter((rest[w] for w in some), np.int64, len(some))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), pa.array(n), pa.array(n + more)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (Counter(), Counter())
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                for text, out in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    held[out].update(words_of(text))
                    held[out][END] += 1
                if len(held[0]) + len(held[1]) > HELD_WORDS:
                    yield from passed_on(held)
                    held = (Counter(), Counter())
        yield from passed_on(held)

    partial = texts.select("text", "held_out").mapInArrow(run, "word binary, n long, everywhere long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"), F.sum("everywhere").alias("everywhere"))


@dataclass
class Lexicon:
    """What tasks know of words: the frequent ones, and totals by class."""

    numbers: dict[bytes, int]  # a frequent word's place in the arrays below
    classes: np.ndarray
    n: np.ndarray
    tokens: int  # of training texts, with ends
    kinds: int
    class_tokens: np.ndarray
    class_kinds: np.ndarray
    discount: float
    cutoff: int  # no other word occurs more often

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 1) / (self.tokens + self.kinds + 1))

    def unseen(self) -> np.ndarray:
        """Share of unseen words in each class; a class of one word has none unless that is unseen too."""
        total, kinds = self.class_tokens.astype(float), self.class_kinds
        share = np.where(total > 0, self.discount * kinds / np.maximum(total, 1), 1.0)
        return np.where((np.arange(CLASSES) <= OWN) & (total > 0), 0.0, share)

    def inside(self, n: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Log-probability of words within their classes."""
        own = classes <= OWN
        seen = np.where(own, 1.0, (n - self.discount) / np.maximum(self.class_tokens[classes], 1))
        return np.log10(np.where(n > 0, seen, np.where(own, 1.0, self.unseen()[classes])))


def lexicon(counts: DataFrame) -> Lexicon:
    """From the written table of counts: a bounded list of words, and one row of totals for each class."""
    of_suffix = (F.crc32(F.substring("word", -2, 2)) % SUFFIXES + 1 + OWN).cast("int")
    has = F.col("n") > 0
    totals = counts.filter(F.length("word") > 0).groupBy(of_suffix.alias("class")).agg(
        F.sum("n").alias("tokens"), F.count_if(has).alias("kinds"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")
    )
    rows = totals.collect()  # of ``SUFFIXES`` classes
    ends = counts.filter(F.length("word") == 0).agg(F.sum("n")).first()[0] or 0
    top = counts.filter(F.length("word") > 0).orderBy(F.desc("everywhere"), "word").limit(FREQUENT).collect()
    names = [bytes(r["word"]) for r in top]
    n = np.array([r["n"] for r in top], np.int64)
    classes = np.array([i + 1 if i < OWN else suffix_class(w) for i, w in enumerate(names)], np.int64)
    tokens, kinds = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    tokens[0], kinds[0] = ends, int(ends > 0)
    for r in rows:
        tokens[r["class"]], kinds[r["class"]] = r["tokens"], r["kinds"]
    for w, count, c in zip(names[:OWN], n[:OWN], classes[:OWN], strict=True):
        tokens[c], kinds[c] = count, int(count > 0)
        tokens[suffix_class(w)] -= count
        kinds[suffix_class(w)] -= int(count > 0)
    once, twice = (sum(r[k] for r in rows) for k in ("once", "twice"))
    discount = min(max(once / max(once + 2 * twice, 1), 0.1), 0.9)
    cutoff = top[-1]["everywhere"] if len(top) == FREQUENT else 0
    numbers = {w: i for i, w in enumerate(names)}
    return Lexicon(numbers, classes, n, int(tokens.sum()), int(kinds.sum()), tokens, kinds, discount, cutoff)


TOKENS = (
    "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, inside double, "
    "classes binary, others array<struct<word: binary, n: long>>"
)


def tokens(texts: DataFrame, known: Lexicon) -> DataFrame:
    """A row for each text: its classes in order, sums over its frequent words, and its other words with counts."""
    sent = texts.sparkSession.sparkContext.broadcast(known)  # of ``FREQUENT`` words
    others_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex: Lexicon = sent.value
        get = lex.numbers.get
        # the last place stands for the end of a text
        n = np.append(lex.n, lex.class_tokens[0])
        classes = np.append(lex.classes, 0)
        base, inside = lex.base(n), lex.inside(n, classes)
        end = len(lex.n)
        by_suffix: dict[bytes, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                out: dict[str, list] = {k: [] for k in ("n_tokens", "n_known", "base", "inside", "classes")}
                names: list[bytes] = []
                times: list[int] = []
                ends = [0]
                for text in some.column("text").to_pylist():
                    words = words_of(text)
                    words.append(END)
                    places = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
                    places[-1] = end
                    rare = np.flatnonzero(places < 0)
                    found = classes[places]
                    if len(rare):
                        unlisted = [words[i] for i in rare]
                        found[rare] = [by_suffix.get(w[-2:]) or by_suffix.setdefault(w[-2:], suffix_class(w)) for w in unlisted]
                        counted = Counter(unlisted)
                        names.extend(counted)
                        times.extend(counted.values())
                        places = places[places >= 0]
                    ends.append(len(names))
                    out["n_tokens"].append(len(words))
                    out["n_known"].append(int((n[places] > 0).sum()))
                    out["base"].append(float(base[places].sum()))
                    out["inside"].append(float(inside[places].sum()))
                    out["classes"].append(found.astype(np.uint8).tobytes())
                pairs = pa.StructArray.from_arrays([pa.array(names, pa.binary()), pa.array(times, pa.int64())], ["word", "n"])
                others = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs).cast(others_type)
                columns = [some.column(c) for c in ("uid", "doc_id", "held_out")]
                types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
                columns += [pa.array(out[k], t) for k, t in zip(out, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, others], names=["uid", "doc_id", "held_out", *out, "others"])

    return texts.select("uid", "doc_id", "held_out", "text").mapInArrow(run, TOKENS)


def triples(table: DataFrame) -> DataFrame:
    """``first, cells``: for each first class, the packed numbers and counts of the pairs that follow it in training texts."""
    schema = pa.schema([("cell", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(CLASSES**3, np.uint32)
        for batch in batches:
            for value in batch.column(0):
                seq = np.concatenate([np.zeros(2, np.int64), np.frombuffer(value.as_py(), np.uint8)])
                np.add.at(held, (seq[:-2] * CLASSES + seq[1:-1]) * CLASSES + seq[2:], 1)
        cells = np.flatnonzero(held)
        for at in range(0, len(cells), 65536):
            some = cells[at : at + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(held[some].astype(np.int64))], schema=schema)

    counted = table.filter(~F.col("held_out")).select("classes").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    first = F.floor(F.col("cell") / CLASSES**2).cast("int").alias("first")
    # a list has at most CLASSES ** 2 entries
    return counted.groupBy(first).agg(F.sort_array(F.collect_list(F.struct((F.col("cell") % CLASSES**2).alias("cell"), F.col("n").cast("double").alias("n")))).alias("cells"))


@dataclass
class Model:
    """Embeddings of classes in contexts (by position a linear map) and as predictions, and biases."""

    context: np.ndarray
    maps: np.ndarray
    target: np.ndarray
    bias: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [self.context, self.maps, self.target, self.bias]

    def predicted(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return self.context[first] @ self.maps[0] + self.context[second] @ self.maps[1]

    def scores(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Unnormalised scores of all classes after each context."""
        return self.predicted(first, second) @ self.target.T + self.bias

    def log_probabilities(self) -> np.ndarray:
        """log10 of the probability of each class after each context, contexts in rows."""
        out = np.empty((CLASSES**2, CLASSES), np.float32)
        second = np.arange(CLASSES)
        for first in range(CLASSES):
            s = self.scores(np.full(CLASSES, first), second)
            s -= s.max(axis=1, keepdims=True)
            s -= np.log(np.exp(s).sum(axis=1, keepdims=True))
            out[first * CLASSES : (first + 1) * CLASSES] = s / np.log(10)
        return out


def started(noise: np.ndarray, dim: int = DIM, seed: int = 7) -> Model:
    """Small random embeddings; the biases make it the unigram model."""
    r = np.random.default_rng(seed)
    draw = lambda: r.normal(0, 0.1, (CLASSES, dim))
    return Model(draw(), np.stack([np.eye(dim), np.eye(dim)]), draw(), np.log(noise))


def noise_contrast(model: Model, noise: np.ndarray, first: int, cells: np.ndarray, n: np.ndarray, k: int = NOISE) -> tuple[float, list[np.ndarray]]:
    """Objective and gradient over the triples of one first class.

    A token of the corpus is to be told from ``k`` draws of noise by how far its score is above the
    log of the noise's expected count; draws enter by their expectation.
    """
    seconds, row = np.unique(cells // CLASSES, return_inverse=True)
    counts = np.zeros((len(seconds), CLASSES))
    counts[row, cells % CLASSES] = n
    firsts = np.full(len(seconds), first)
    q = model.predicted(firsts, seconds)
    above = q @ model.target.T + model.bias - np.log(k * noise)
    true = 1 / (1 + np.exp(-above))
    expected = k * counts.sum(axis=1, keepdims=True) * noise
    objective = float((counts * -np.logaddexp(0, -above) + expected * -np.logaddexp(0, above)).sum())
    slope = counts * (1 - true) - expected * true
    by_q = slope @ model.target
    context = np.zeros_like(model.context)
    context[first] += by_q.sum(axis=0) @ model.maps[0].T
    context[seconds] += by_q @ model.maps[1].T
    maps = np.stack([np.outer(model.context[first], by_q.sum(axis=0)), model.context[seconds].T @ by_q])
    return objective, [context, maps, slope.T @ q, slope.sum(axis=0)]


def step(packed: DataFrame, model: Model, noise: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Objective and gradient over all triples: one row for each of at most ``PARTS`` tasks comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, least, sums = 0.0, CLASSES, [np.zeros_like(a) for a in model.arrays()]
        for batch in batches:
            for i, first in enumerate(batch.column(0).to_pylist()):
                flat = batch.column(1)[i].values
                cells, n = flat.field(0).to_numpy(), flat.field(1).to_numpy()
                objective, gradient = noise_contrast(model, noise, first, cells, n)
                total, least = total + objective, min(least, first)
                for a, g in zip(sums, gradient, strict=True):
                    a += g
        if least < CLASSES:
            yield pa.RecordBatch.from_pydict({"least": [least], "objective": [total], "gradient": [np.concatenate([a.ravel() for a in sums]).tobytes()]})

    rows = sorted(packed.mapInArrow(run, "least long, objective double, gradient binary").collect())
    flat = sum((np.frombuffer(r["gradient"]) for r in rows), np.zeros(sum(a.size for a in model.arrays())))
    out, at = [], 0
    for a in model.arrays():
        out.append(flat[at : at + a.size].reshape(a.shape))
        at += a.size
    return sum(r["objective"] for r in rows), out


def trained(packed: DataFrame, class_tokens: np.ndarray, steps: int = STEPS, rate: float = RATE) -> Model:
    """Steps by moments of the gradient, smaller towards the end."""
    noise = (class_tokens + 1.0) / (class_tokens.sum() + CLASSES)
    model = started(noise)
    total = max(float(class_tokens.sum()), 1.0)
    moments = [(np.zeros_like(a), np.zeros_like(a)) for a in model.arrays()]
    for i in range(1, steps + 1):
        _, gradient = step(packed, model, noise)
        now = rate * min(1.0, 2 * (1 - (i - 1) / steps))
        for a, g, (mean, square) in zip(model.arrays(), gradient, moments, strict=True):
            g = g / total
            mean += 0.1 * (g - mean)
            square += 0.01 * (g * g - square)
            a += now * (mean / (1 - 0.9**i)) / (np.sqrt(square / (1 - 0.99**i)) + 1e-12)
    return model


def class_scores(table: DataFrame, model: Model) -> DataFrame:
    """``uid`` and the log-probability of its classes; other columns but the packed ones stay."""
    kept = ["uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "inside"]
    schema = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, inside double, by_class double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = None
        for batch in batches:
            logs = model.log_probabilities() if logs is None else logs
            sums = []
            for value in batch.column(len(kept)):
                seq = np.concatenate([np.zeros(2, np.int64), np.frombuffer(value.as_py(), np.uint8)])
                sums.append(float(logs[seq[:-2] * CLASSES + seq[1:-1], seq[2:]].sum(dtype=np.float64)))
            columns = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sums, pa.float64())], names=[*kept, "by_class"])

    return table.select(*kept, "classes").mapInArrow(run, schema)


def other_words(table: DataFrame, counts: DataFrame, known: Lexicon) -> DataFrame:
    """Sums over the words of a text that are not on the list: they join their counts."""
    rare = table.select("uid", F.explode("others").alias("o")).select("uid", "o.word", F.col("o.n").alias("times"))
    listed = counts.filter(F.col("everywhere") <= known.cutoff).filter(F.col("n") > 0).select("word", F.col("n").alias("c"))
    place = (F.crc32(F.substring("word", -2, 2)) % SUFFIXES + 1).cast("int")
    of_class = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values[1 + OWN :]]), place)
    seen = (F.col("c") - known.discount) / of_class(known.class_tokens)
    inside = F.log10(F.when(F.col("c").isNotNull(), seen).otherwise(of_class(known.unseen())))
    base = F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(known.tokens + known.kinds + 1)))
    joined = rare.join(listed, "word", "left")
    return joined.groupBy("uid").agg(
        F.sum(F.col("times") * inside).alias("more_inside"),
        F.sum(F.col("times") * base).alias("more_base"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("times"))).alias("more_known"),
    )


def fitted(docs: DataFrame, held_out: Column) -> tuple[DataFrame, DataFrame, Lexicon, Model]:
    """Tables of tokens and word counts, what tasks know of words, and the trained model."""
    texts = numbered(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held_out.alias("held_out"))
    )
    counts = materialize(word_counts(texts), "word-counts")
    known = lexicon(counts)
    table = materialize(tokens(texts, known), "tokens")
    spark = docs.sparkSession
    parts = min(PARTS, max(spark.sparkContext.defaultParallelism, 1))
    packed = materialize(triples(table).repartition(parts, "first").sortWithinPartitions("first"), "triples")
    return table, counts, known, trained(packed, known.class_tokens)


def scored(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    ``held_out`` marks the texts that the model doesn't learn from. Scores are log10 probabilities of
    whole texts: ``base_score`` by smoothed counts of single tokens, ``score`` by the model.
    """
    table, counts, known, model = fitted(docs, is_held_out(F.col("doc_id")) if held_out is None else held_out)
    joined = class_scores(table, model).join(other_words(table, counts, known), "uid", "left")
    plus = lambda a, b, zero: (a + F.coalesce(F.col(b), F.lit(zero))).alias
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        plus(F.col("n_known"), "more_known", 0)("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"),
        plus(F.col("base"), "more_base", 0.0)("base_score"),
        plus(F.col("by_class") + F.col("inside"), "more_inside", 0.0)("score"),
    )
