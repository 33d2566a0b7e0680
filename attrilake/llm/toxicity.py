"""Toxicity by class-conditional Kneser-Ney models of words' characters.

A word is a run of letters, lower-cased; its characters and its end are predicted from up to
ORDER - 1 characters before them, or from the word's beginning. Each class (toxic, ordinary) has
counts of its own for the longest n-gram at each place. All lower orders are shared: they hold
Kneser-Ney's continuation counts, the number of different n-grams, one character longer to the
left, that end in an n-gram anywhere in the corpus. So an expression that one class has rarely seen
backs off to what both know and tells little. A word's evidence is the difference of its
log-likelihoods. A document's features are length-normalised: the means over all its words, over
its worst WINDOW words in a row, and over its worst few words; a logistic regression over them gives
the score.

Shared counts come from the words of all documents, class counts from all labelled rows whose
remainder is not 2; equal texts count once. Only the regression is fitted on a bounded sample, SAMPLE
rows a class, taken by the hash of doc_id; it is cross-fitted: each half's features come from the
class counts of the other half, and classes weigh as in all labelled rows. Discounting and
normalising are aggregations over exact n-grams; what comes to the driver and the workers are their
shares summed in cells, whose number grows with the n-grams up to 2^MOST_BITS. Scoring covers whole texts.

Defined results: null text counts as empty; a text without words has the features zero; without
labelled rows of both classes every score is 0; rows with equal texts have equal scores; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attrilake.llm.common import Scratch, likely
from attrilake.llm.shingles import slices

ORDER, WINDOW, SAMPLE = 7, 16, 6000
#: Cells of a table: about one for each character of the distinct words, within these bits.
LEAST_BITS, MOST_BITS = 16, 21
#: What a count gives up to the order below, in the shared orders and in a class; never more than itself.
SHARED_DISCOUNT, CLASS_DISCOUNT = 0.75, 3.0
#: Probability of a character that nothing is known of.
FLOOR = 1e-4
#: How many of the worst words the last features average.
WORST = (3, 6)
#: A word's evidence is held within this many nats, so that one word can't outweigh a window.
MOST = 8.0
#: Distinct words that a task counts, or a worker remembers, before it hands them out or forgets them.
WORDS_HELD = 300_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class Places:
    """The n-grams at each character of some words and at each word's end."""

    def __init__(self, words: list[str]):
        code = np.frombuffer("".join(w + "\0" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        lengths = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        self.starts = np.cumsum(lengths) - lengths
        self.word = np.repeat(np.arange(len(words)), lengths)
        self.since = np.arange(len(code)) - np.repeat(self.starts, lengths)  # characters before, in the word
        self.keys, self.contexts = [], []
        context = np.zeros(len(code), np.uint64)
        for order in range(1, ORDER + 1):
            if order > 1:
                # a character of the word, or its beginning; places that lie before it aren't used
                back = order - 1
                before = np.where(self.since >= back, code[np.maximum(np.arange(len(code)) - back, 0)] + np.uint64(2), np.uint64(1))
                context = (context + before) * _A
                context ^= context >> np.uint64(29)
            key = (context ^ (code + np.uint64(7)) * _B) * _A
            self.keys.append(key ^ key >> np.uint64(31))
            self.contexts.append(context * _B ^ context >> np.uint64(27))
        self.longest = np.minimum(self.since + 2, ORDER)  # with the word's beginning

    def top(self) -> tuple[np.ndarray, np.ndarray]:
        """The longest n-gram at each place, and its context."""
        rows = np.arange(len(self.word))
        return np.stack(self.keys)[self.longest - 1, rows], np.stack(self.contexts)[self.longest - 1, rows]


FEATURES = ("mean", "window", *(f"worst_{k}" for k in WORST))


def pack(table: np.ndarray, rest: float) -> tuple[bytes, bytes]:
    """Steps between the cells that differ from ``rest``, and their values in half precision."""
    cells = np.flatnonzero(table != rest)
    return zlib.compress(np.diff(cells, prepend=0).astype(np.uint32).tobytes(), 1), table[cells].astype(np.float16).tobytes()


def unpack(packed: tuple[bytes, bytes], rest: float, bits: int) -> np.ndarray:
    out = np.full(1 << bits, rest, np.float16)
    out[np.cumsum(np.frombuffer(zlib.decompress(packed[0]), np.uint32), dtype=np.int64)] = np.frombuffer(packed[1], np.float16)
    return out


@dataclass
class Model:
    """Tables by cell, for the shared orders and for the two classes: (discounted share by n-gram, back-off weight by context)."""

    bits: int
    shared: list
    classes: list  # toxic, ordinary
    weights: np.ndarray | None = None  # regression: bias and a weight for each feature

    def __getstate__(self):
        """Tables travel as the cells that hold something, so that what is sent grows with the n-grams alone."""
        packed = {id(t): pack(t, rest) for pairs in (self.shared, self.classes) for pair in pairs for t, rest in zip(pair, (0, 1), strict=True)}
        return self.bits, [[tuple(packed[id(t)] for t in pair) for pair in pairs] for pairs in (self.shared, self.classes)], self.weights

    def __setstate__(self, state):
        self.bits, tables, self.weights = state
        self.shared, self.classes = ([tuple(unpack(t, rest, self.bits) for t, rest in zip(pair, (0, 1), strict=True)) for pair in pairs] for pairs in tables)

    def evidence(self, words: list[str]) -> np.ndarray:
        """Evidence for toxic, in nats, of each word."""
        at, shift = Places(words), np.uint64(64 - self.bits)
        p = np.full(len(at.word), FLOOR)
        for i, (share, back) in enumerate(self.shared):
            p = np.where(at.longest > i + 1, share[at.keys[i] >> shift] + back[at.contexts[i] >> shift] * p, p)
        key, context = (x >> shift for x in at.top())
        toxic, ordinary = (share[key] + back[context] * p for share, back in self.classes)
        return np.clip(np.add.reduceat(np.log(toxic / ordinary), at.starts), -MOST, MOST)

    def score(self, features) -> float:
        if self.weights is None:
            return 0.0
        z = float(self.weights[0] + np.dot(self.weights[1:], features))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


class Scorer:
    """A model that remembers the evidence of words: WORDS_HELD recent ones and as many before them."""

    def __init__(self, model: Model):
        self.model, self.new, self.old = model, {}, {}

    def learn(self, words: set[str]) -> None:
        """Have the evidence of all these at hand."""
        if len(self.new) > WORDS_HELD:
            self.new, self.old = {}, self.new
        unknown = []
        for w in words:
            if w not in self.new:
                if w in self.old:
                    self.new[w] = self.old[w]
                else:
                    unknown.append(w)
        at = 0
        while at < len(unknown):  # a million characters at a time
            end, size = at, 0
            while end < len(unknown) and (end == at or size + len(unknown[end]) < 1 << 20):
                size += len(unknown[end]) + 1
                end += 1
            self.new.update(zip(unknown[at:end], self.model.evidence(unknown[at:end]).tolist(), strict=True))
            at = end

    def features(self, words: list[str]) -> tuple[float, ...]:
        if not words:
            return (0.0,) * len(FEATURES)
        found = np.fromiter(map(self.new.__getitem__, words), np.float64, len(words))
        total = np.r_[0.0, np.cumsum(found)]
        n = min(WINDOW, len(found))
        k = min(max(WORST), len(found))
        ranked = np.sort(np.partition(found, len(found) - k)[len(found) - k :])[::-1]
        return float(total[-1] / len(found)), float((total[n:] - total[:-n]).max() / n), *(float(ranked[:k].mean()) for k in WORST)


#: Counts of a class in a half, in this order: ordinary and toxic of half 0, then of half 1.
CELLS = ("ordinary_0", "toxic_0", "ordinary_1", "toxic_1")


def count_words(rows: DataFrame, kind: Column) -> DataFrame:
    """word, kind, n over all texts; counted in each task before the shuffle."""

    def counted(batches):
        held: dict[int, Counter] = {}

        def flush():
            for kind, counts in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([kind] * len(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], ["word", "kind", "n"])
            held.clear()

        for whole in batches:
            for batch in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                for text, kind in zip(batch.column("text").to_pylist(), batch.column("kind").to_pylist(), strict=True):
                    held.setdefault(kind, Counter()).update(words_of(text))
                if sum(map(len, held.values())) > WORDS_HELD:
                    yield from flush()
        yield from flush()

    return rows.select("text", kind.cast("int").alias("kind")).mapInArrow(counted, "word string, kind int, n long").groupBy("word", "kind").agg(F.sum("n").alias("n"))


def slices_of_words(batches, columns: list[str], most: int = 1 << 20):
    """Words and the other columns, about ``most`` characters at a time."""
    held, size = [], 0

    def settle():
        return [w for words, _ in held for w in words], [np.concatenate([c[i] for _, c in held]) for i in range(len(columns))]

    for batch in batches:
        words = batch.column("word").to_pylist()
        held.append((words, [batch.column(c).to_numpy() for c in columns]))
        size += sum(map(len, words)) + len(words)
        if size > most:
            yield settle()
            held, size = [], 0
    if held:
        yield settle()


def high(x: np.ndarray) -> np.ndarray:
    """The first 32 bits: more than any table's cells have."""
    return (x >> np.uint64(32)).astype(np.int64)


def continuations(words: DataFrame) -> DataFrame:
    """context (its level above 32 bits), gram, n of the shared orders: how many different longer n-grams end in each.

    Rows are dealt out once, by context; every later grouping is by the context and more.
    """

    def listed(batches):
        for found, _ in slices_of_words(batches, []):
            at = Places(found)
            for order in range(1, ORDER):
                some = at.longest > order
                longer = at.keys[order][some]
                longer, first = np.unique(longer, return_index=True)
                context, gram = (high(x[some][first]) for x in (at.contexts[order - 1], at.keys[order - 1]))
                yield pa.RecordBatch.from_arrays([pa.array(context | order << 32), pa.array(gram << 32 | high(longer * _A))], ["context", "pair"])

    pairs = words.select("word").distinct().mapInArrow(listed, "context long, pair long").repartition("context").distinct()
    return pairs.groupBy("context", F.shiftright("pair", 32).bitwiseAND(F.lit((1 << 32) - 1)).alias("gram")).agg(F.count("*").alias("n"))


def class_counts(words: DataFrame) -> DataFrame:
    """context, gram and a column of CELLS each: the longest n-grams in the labelled words, dealt out by context."""

    def listed(batches):
        for found, (kind, n) in slices_of_words(batches, ["kind", "n"]):
            at = Places(found)
            gram, context = at.top()
            pair = (gram >> np.uint64(32) << np.uint64(2) | kind[at.word].astype(np.uint64)).astype(np.int64)
            order = np.lexsort((pair, context))
            context, pair = high(context)[order], pair[order]
            new = np.flatnonzero(np.r_[True, (context[1:] != context[:-1]) | (pair[1:] != pair[:-1])])
            yield pa.RecordBatch.from_arrays([pa.array(context[new]), pa.array(pair[new]), pa.array(np.add.reduceat(n[at.word][order], new))], ["context", "pair", "n"])

    each = words.filter("kind >= 0").mapInArrow(listed, "context long, pair long, n long").repartition("context")
    kind = F.col("pair") % 4
    return each.groupBy("context", F.shiftright("pair", 2).alias("gram")).agg(*(F.sum(F.when(kind == k, F.col("n")).otherwise(0)).alias(c) for k, c in enumerate(CELLS)))


def discounted(counts: DataFrame, names: list[str], discount: float, bits: int) -> dict[tuple[int, str], tuple[np.ndarray, np.ndarray]]:
    """For each level and each column of counts: shares by n-gram cell, and the weights that contexts pass down, by context cell.

    2^(bits + 1) rows a level come to the driver at most.
    """
    of_context = Window.partitionBy("context")
    cut = {c: F.least(c, F.lit(discount)) for c in names}
    rows = counts.withColumns({f"{c}_share": F.coalesce(F.try_divide(F.col(c) - cut[c], F.sum(c).over(of_context)), F.lit(0.0)) for c in names})
    cell = lambda c: F.shiftright(c.bitwiseAND(F.lit((1 << 32) - 1)), 32 - bits).cast("int")
    share = F.struct(F.lit(0).alias("table"), cell(F.col("gram")).alias("cell"), *(F.col(f"{c}_share").alias(f"{c}_x") for c in names), *(F.lit(1.0).alias(f"{c}_y") for c in names))
    back = F.struct(F.lit(1).alias("table"), cell(F.col("context")).alias("cell"), *(cut[c].cast("double").alias(f"{c}_x") for c in names), *(F.col(c).cast("double").alias(f"{c}_y") for c in names))
    each = rows.select(F.shiftright("context", 32).cast("int").alias("level"), F.explode(F.array(share, back)).alias("r")).select("level", "r.*")
    value = lambda c: F.when(F.col("table") == 0, F.sum(f"{c}_x")).otherwise(F.coalesce(F.try_divide(F.sum(f"{c}_x"), F.sum(f"{c}_y")), F.lit(1.0))).cast("float").alias(c)
    found = each.groupBy("level", "table", "cell").agg(*map(value, names)).toArrow()
    level, table, cells = (found.column(c).to_numpy() for c in ("level", "table", "cell"))
    out: dict[tuple[int, str], tuple[np.ndarray, np.ndarray]] = {}
    for at in np.unique(level).tolist():
        for c in names:
            pair = out[at, c] = (np.zeros(1 << bits, np.float32), np.ones(1 << bits, np.float32))
            for i in (0, 1):
                here = (level == at) & (table == i)
                pair[i][cells[here]] = np.minimum(found.column(c).to_numpy()[here], 1)
    return out


def fit_weights(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Weighted logistic regression by Newton's method."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on labelled rows whose remainder is not 2; ``sample`` rows of each class at most for the regression."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(remainder(F.col("doc_id")) != 2).groupBy("doc_id").agg(F.min("toxic").cast("int").alias("toxic"))
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    # of equal texts the first is counted; the texts themselves are dealt out once, after that
    chosen = texts.select("doc_id", F.md5(F.col("text").cast("binary")).alias("key")).join(known, "doc_id").groupBy("key").agg(F.min(F.struct("doc_id", "toxic")).alias("r")).select("r.*")
    half = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)).cast("int")
    chosen = scratch.keep(chosen, "chosen")
    rows = scratch.keep(likely(texts, chosen, "doc_id").join(chosen, "doc_id").dropDuplicates(["doc_id"]).withColumn("half", half), "labelled")
    words = scratch.keep(count_words(texts, F.lit(-1)).unionByName(count_words(rows, 2 * F.col("half") + F.col("toxic"))), "words")
    characters = words.agg(F.coalesce(F.sum(F.char_length("word") + 1), F.lit(0))).first()[0]
    bits = min(max(characters.bit_length(), LEAST_BITS), MOST_BITS)
    lower = discounted(continuations(words), ["n"], SHARED_DISCOUNT, bits)
    # both classes counted in all rows and in either half
    sums = {(t, h): f"{t}_{h}" for t in ("toxic", "ordinary") for h in ("all", 0, 1)}
    both = class_counts(words).withColumns({f"{t}_all": F.col(f"{t}_0") + F.col(f"{t}_1") for t in ("toxic", "ordinary")})
    top = discounted(both, list(sums.values()), CLASS_DISCOUNT, bits)
    scratch.drop_but("labelled")
    none = (np.zeros(1 << bits, np.float32), np.ones(1 << bits, np.float32))
    lower = [lower.get((k, "n"), none) for k in range(1, ORDER)]
    of = lambda h: Model(bits, lower, [top.get((0, sums[t, h]), none) for t in ("toxic", "ordinary")])
    model = of("all")
    order = F.xxhash64("doc_id")
    fitted = [rows.filter(F.col("toxic") == t).orderBy(order, "doc_id").limit(sample) for t in (0, 1)]
    crossed = scored(fitted[0].unionByName(fitted[1]), [of(1), of(0)], keep=["toxic", "half"]).select("toxic", *FEATURES).toArrow()
    y = crossed.column("toxic").to_numpy().astype(np.float64)
    if 0 < y.sum() < len(y):
        every = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        weight = np.where(y == 1, every[1] / y.sum(), every[0] / (1 - y).sum())
        model.weights = fit_weights(np.stack([crossed.column(f).to_numpy() for f in FEATURES], 1), y, weight / weight.mean())
    return model


def scored(docs: DataFrame, models: list[Model], keep: list[str] = ()) -> DataFrame:
    """doc_id, score and features of every text; ``keep`` passes int columns on.

    Of two models, the one at a row's ``half`` scores it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)
    schema = "doc_id long, score double" + "".join(f", {f} double" for f in FEATURES) + "".join(f", {k} int" for k in keep)

    def score(batches):
        scorers = [Scorer(m) for m in shared.value]
        for whole in batches:
            for batch in slices(whole, "text"):
                halves = batch.column("half").to_pylist() if len(scorers) > 1 else [0] * batch.num_rows
                words = [words_of(t) for t in batch.column("text").to_pylist()]
                for h, scorer in enumerate(scorers):
                    scorer.learn(set().union(*(w for w, of in zip(words, halves, strict=True) if of == h)))
                found = [scorers[h].features(w) for w, h in zip(words, halves, strict=True)]
                columns = [batch.column("doc_id"), pa.array([scorers[0].model.score(f) for f in found], pa.float64())]
                columns += [pa.array([f[i] for f in found], pa.float64()) for i in range(len(FEATURES))]
                yield pa.RecordBatch.from_arrays(columns + [batch.column(k) for k in keep], [c.split()[0] for c in schema.split(", ")])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *keep).mapInArrow(score, schema)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = scored(docs, [model])
    return found.select("doc_id", (remainder(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
