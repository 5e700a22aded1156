"""Operator 9: toxicity by a convolutional text classifier.

A word's vector is the sum of hashed embeddings of the word and of its first bytes; filters of
several widths slide over the words of the whole text, each filter's largest value over the
text feeds a logistic layer. It is trained on every labelled document outside the held-out fold but one in five, which
are kept to calibrate on. Training goes in EPOCHS rounds, each a Spark job over all of these documents: they lie in shards of
about SHARD_ROWS rows (SHARD_BYTES of text), in each of which numpy takes mini-batch steps (Adam) from the round's model, and Spark
adds up how far the shards moved every parameter; the next model moves by the mean over those that moved it. Sums are
of whole numbers (parts of 1 / 2^20), so the model does not depend on which task has which shard. Scoring is
vectorised over Arrow batches and covers every word of every text.

Thresholds are calibrated by language on all labelled rows kept from training, which Spark counts by language, label and logit
(in steps of 1 / CELLS): the one of the best balanced accuracy, pulled towards that of all languages by one formula at every
number of rows, and the score is shifted so that 0.5 is the threshold. The language is told from the text itself, by
its script and its function words; labels, lang, source and doc_id are never inputs of a score.

Defined cases: null, empty and wordless texts score as a text without words does; long texts are scored whole; without
labels of both kinds every score is 0; rows of `labels` with nulls, other values than 0 and 1 or documents unknown are ignored; of several labels of
a doc_id toxic wins, of several texts the least in order counts; every row of `docs` gives one row, repeats included; an
empty table gives none. Columns beside doc_id and text are left out.
"""

from __future__ import annotations

import copy
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _PLAIN_WORDS, _bounded, map_texts, one_thread, read_table, remove_path, scratch_path, text_column
from .words import _BASE, _INVERSE, _powers, mix, word_hashes

#: Rows and bytes of text of a shard, on average: what is trained on between two sums.
SHARD_ROWS = 4_096
SHARD_BYTES = 64 << 20
BUCKETS = 1 << 18
DIM, WIDTHS, FILTERS = 12, (1, 2, 3), 12
PREFIXES = (4, 5)
EPOCHS, BATCH, RATE = 6, 32, 0.01
#: Bytes of text after which a mini-batch ends, however few texts it has.
BATCH_BYTES = 1 << 20
#: Steps of a logit that are told apart in calibration, and the largest one; and the rows of the rarer label that weigh as much as all languages.
CELLS, FARTHEST = 256, 64
PRIOR = 20
# Frequent function words by language.
_FUNCTION_WORDS = {
    "en": "the of and to in is that for it with as was on are by this be from",
    "es": "el los las y en un una por con para no es del se lo su al como",
    "de": "der die das und ist nicht ein eine mit den von zu auf für im dem des sich",
    "fr": "le les des et est un une dans pour pas au du que qui sur ne ce avec",
    "it": "il gli che di della per non una sono con del nel alla dei più anche",
    "pt": "o os uma não do da em para com por mais dos das foi ao ser",
    "nl": "het een van en niet dat op te zijn met voor aan ook er maar bij",
}
# Ranges of the first UTF-8 byte of a script's letters.
_SCRIPTS = {"greek": (0xCD, 0xCF), "cyrillic": (0xD0, 0xD3), "semitic": (0xD6, 0xDB), "indic": (0xE0, 0xE0), "han": (0xE3, 0xE9), "hangul": (0xEA, 0xED)}
LANGUAGES = ("other", *_FUNCTION_WORDS, *_SCRIPTS)


@functools.cache
def _known(words: str) -> np.ndarray:
    return np.sort(np.array([word_hashes([w.encode()])[0][0] for w in words.split()]))


def features(texts: list[bytes | None], languages: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Buckets of every word (word and prefixes), words per text, and each text's language if asked for."""
    raw = b" ".join(t or b"" for t in texts)
    data = np.frombuffer(raw.translate(_PLAIN_WORDS), dtype=np.uint8)
    sizes = np.array([len(t or b"") + 1 for t in texts], dtype=np.int64)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    inside = np.concatenate(([False], data != 32, [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), out=prefix[1:])
    back = _powers(_INVERSE, len(data) + 1)[starts]
    buckets = np.empty((len(starts), 1 + len(PREFIXES)), dtype=np.int32)
    for k, size in enumerate((None, *PREFIXES)):
        stop = ends if size is None else np.minimum(starts + size, ends)
        buckets[:, k] = mix((prefix[stop] - prefix[starts]) * back + np.uint64(k)) & np.uint64(BUCKETS - 1)
    counts = np.diff(np.searchsorted(starts, bounds))
    if not languages:
        return buckets, counts, None
    whole = mix((prefix[ends] - prefix[starts]) * back)
    votes = np.zeros((len(texts), len(LANGUAGES)))
    votes[:, 0] = 0.02 * counts + 0.5
    for k, words in enumerate(_FUNCTION_WORDS.values(), 1):
        known = _known(words)
        hit = known[np.minimum(np.searchsorted(known, whole), len(known) - 1)] == whole
        votes[:, k] = np.diff(np.searchsorted(np.flatnonzero(hit), np.searchsorted(starts, bounds)))
    for k, (low, high) in enumerate(_SCRIPTS.values(), 1 + len(_FUNCTION_WORDS)):
        votes[:, k] = 0.3 * np.diff(np.searchsorted(np.flatnonzero((data >= low) & (data <= high)), bounds))
    return buckets, counts, votes.argmax(axis=1)


class Model:
    """Embeddings, filters, logistic layer and one threshold per language."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.e = (rng.standard_normal((BUCKETS, DIM)) * 0.1).astype(np.float32)
        self.w = [(rng.standard_normal((width * DIM, FILTERS)) * (1 / np.sqrt(width * DIM))).astype(np.float32) for width in WIDTHS]
        self.b = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.v = (rng.standard_normal(FILTERS * len(WIDTHS)) * 0.3).astype(np.float32)
        self.c = np.zeros(1, np.float32)
        self.thresholds = np.zeros(len(LANGUAGES))

    def dense(self) -> list[np.ndarray]:
        """The parameters beside the embeddings."""
        return [*self.w, *self.b, self.v, self.c]

    def windows(self, x: np.ndarray, starts: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
        """The values of the filters of one width at every word; a window stops at its text's end."""
        width, out = WIDTHS[k], None
        for step in range(width):
            part = x @ self.w[k][step * DIM : (step + 1) * DIM]
            if out is None:
                out = part + self.b[k]
            else:
                inside = np.ones(len(x), bool)
                for back in range(1, step + 1):
                    inside[(starts + counts - back)[counts >= back]] = False
                at = np.flatnonzero(inside)
                out[at] += part[at + step]
        return out

    def logits(self, buckets: np.ndarray, counts: np.ndarray, block: int = 200_000) -> np.ndarray:
        """One logit for each text. Texts are taken in blocks of about `block` words."""
        pooled = np.zeros((len(counts), FILTERS * len(WIDTHS)), np.float32)
        ends = np.cumsum(counts)
        first = 0
        while first < len(counts):
            base = ends[first] - counts[first]
            last = max(first + 1, int(np.searchsorted(ends, base + block, side="right")))
            own = counts[first:last]
            x = self.e[buckets[base : ends[last - 1]]].sum(axis=1)
            some = np.flatnonzero(own)
            if len(some):
                starts = (np.cumsum(own) - own)[some]
                for k in range(len(WIDTHS)):
                    values = self.windows(x, starts, own[some], k)
                    pooled[first + some, k * FILTERS : (k + 1) * FILTERS] = np.maximum(np.maximum.reduceat(values, starts, axis=0), 0)
            first = last
        return pooled @ self.v + self.c[0]

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        buckets, counts, language = features(texts)
        return 1 / (1 + np.exp(-(self.logits(buckets, counts).astype(np.float64) - self.thresholds[language])))


def gradients(model: Model, b: np.ndarray, n: np.ndarray, labels: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of the mean logistic loss of texts of `n` words (none empty) with buckets `b`: by w, b, v and c; and buckets touched with theirs."""
    starts = np.cumsum(n) - n
    x = model.e[b].sum(axis=1)
    pooled, chosen = [], []
    for k in range(len(WIDTHS)):
        values = model.windows(x, starts, n, k)
        at = np.stack([values[s : s + m].argmax(axis=0) + s for s, m in zip(starts, n)])
        chosen.append(at)
        pooled.append(values[at, np.arange(FILTERS)])
    pooled = np.concatenate(pooled, axis=1)
    active = np.maximum(pooled, 0)
    p = 1 / (1 + np.exp(-(active @ model.v + model.c[0])))
    error = ((p - labels) / len(n)).astype(model.v.dtype)
    back = (error[:, None] * model.v) * (pooled > 0)
    gx = np.zeros_like(x)
    gw, gb = [], []
    for k, width in enumerate(WIDTHS):
        g, at = back[:, k * FILTERS : (k + 1) * FILTERS], chosen[k]
        grad = np.zeros_like(model.w[k])
        for s in range(width):
            inside = (at + s) < (starts + n)[:, None]
            place, weight = np.where(inside, at + s, 0), np.where(inside, g, 0)
            grad[s * DIM : (s + 1) * DIM] = np.einsum("dfe,df->ef", x[place], weight)
            np.add.at(gx, place.ravel(), (weight[:, :, None] * model.w[k][s * DIM : (s + 1) * DIM].T[None]).reshape(-1, DIM))
        gw.append(grad)
        gb.append(g.sum(axis=0))
    hot = np.flatnonzero(np.abs(gx).sum(axis=1))
    touched, inverse = np.unique(b[hot], return_inverse=True)
    ge = np.zeros((len(touched), DIM), gx.dtype)
    np.add.at(ge, inverse.reshape(-1), np.repeat(gx[hot], b.shape[1], axis=0))
    return [*gw, *gb, active.T @ error, np.array([error.sum()])], touched, ge


class Trainer:
    """Mini-batch steps (Adam) on a copy of a model."""

    def __init__(self, model: Model):
        self.model = copy.deepcopy(model)
        self.dense = self.model.dense()
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.dense]
        self.em, self.ev = np.zeros_like(model.e), np.zeros_like(model.e)
        self.moved = np.zeros(BUCKETS, bool)
        self.steps = 0

    def step(self, texts: list[bytes | None], labels: list[int]) -> None:
        buckets, counts, _ = features(texts, languages=False)
        some = counts > 0
        if not some.any():
            return
        self.steps += 1
        grads, touched, ge = gradients(self.model, buckets, counts[some], np.array(labels, np.float32)[some])
        rate = RATE * np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        for param, grad, (m, v) in zip(self.dense, grads, self.moments):
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            param -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
        self.em[touched] += 0.1 * (ge - self.em[touched])
        self.ev[touched] += 0.001 * (ge * ge - self.ev[touched])
        self.model.e[touched] -= rate * self.em[touched] / (np.sqrt(self.ev[touched]) + 1e-8)
        self.moved[touched] = True


#: Rows of DIM values that hold the parameters beside the embeddings; their places follow the buckets'.
_DENSE_ROWS = -(-(sum(WIDTHS) * DIM * FILTERS + 2 * len(WIDTHS) * FILTERS + 1) // DIM)
_ONE = 1 << 20
_MOVES = ", ".join(["place int", "n long", *(f"d{k} long" for k in range(DIM))])


def _in_rows(params: list[np.ndarray]) -> np.ndarray:
    flat = np.concatenate([p.reshape(-1) for p in params])
    return np.pad(flat, (0, _DENSE_ROWS * DIM - len(flat))).reshape(_DENSE_ROWS, DIM)


def _shard_moves(model: Model, batches):
    """How far the shards of a task (rows of shard, text and toxic, a shard's together) move the parameters: whole sums by place, and how many shards moved it."""
    sums, n = np.zeros((BUCKETS + _DENSE_ROWS, DIM), np.int64), np.zeros(BUCKETS + _DENSE_ROWS, np.int64)
    shard = trainer = None
    texts, labels, size = [], [], 0
    start = _in_rows(model.dense()).astype(np.float64)

    def whole(values):
        return np.rint(values * _ONE).astype(np.int64)

    def stop():
        if texts:
            trainer.step(texts, labels)
        at = np.flatnonzero(trainer.moved)
        sums[at] += whole(trainer.model.e[at].astype(np.float64) - model.e[at])
        n[at] += 1
        if trainer.steps:
            sums[BUCKETS:] += whole(_in_rows(trainer.dense) - start)
            n[BUCKETS:] += 1

    for batch in batches:
        for part in _bounded(batch):
            for text, toxic, own in zip(*(c.to_pylist() for c in part.columns)):
                if own != shard:
                    if trainer:
                        stop()
                    shard, trainer, texts, labels, size = own, Trainer(model), [], [], 0
                texts.append(text)
                labels.append(toxic)
                size += len(text or b"")
                if len(texts) == BATCH or size >= BATCH_BYTES:
                    trainer.step(texts, labels)
                    texts, labels, size = [], [], 0
    if trainer:
        stop()
    at = np.flatnonzero(n)
    for i in range(0, len(at), 10_000):
        own = at[i : i + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(n[own]), *(pa.array(sums[own, k]) for k in range(DIM))], names=["place", "n", *(f"d{k}" for k in range(DIM))])


def train(rows: DataFrame, seed: int = 7) -> Model:
    """A model of all rows (text binary, toxic, shard; sorted by shard where they lie). What comes to the driver is one model a round, of a fixed size."""
    model, moved = Model(seed), np.zeros(BUCKETS, bool)
    for _ in range(EPOCHS):
        load = rows.sparkSession.sparkContext.broadcast(model)

        def run(batches, load=load):
            one_thread()
            yield from _shard_moves(load.value, batches)

        sums = rows.select("text", "toxic", "shard").mapInArrow(run, _MOVES).groupBy("place").agg(F.sum("n").alias("n"), *(F.sum(f"d{k}").alias(f"d{k}") for k in range(DIM)))
        means = sums.select("place", *((F.col(f"d{k}") / F.col("n") / F.lit(float(_ONE))).cast("float").alias(f"d{k}") for k in range(DIM))).toArrow()
        load.destroy()
        place = means.column("place").to_numpy()
        by = np.zeros((BUCKETS + _DENSE_ROWS, DIM), np.float32)
        for k in range(DIM):
            by[place, k] = means.column(f"d{k}").to_numpy()
        model.e += by[:BUCKETS]
        moved[place[place < BUCKETS]] = True
        flat, first = by[BUCKETS:].reshape(-1), 0
        for param in model.dense():
            param += flat[first : first + param.size].reshape(param.shape)
            first += param.size
    model.e[~moved] = 0  # words that no step moved add nothing
    return model


def calibrate(model: Model, rows: DataFrame) -> None:
    """Each language's threshold: in the middle of the logits where balanced accuracy is best, pulled towards that of all
    languages, and that of all towards 0, where training itself puts it.

    Rows (text binary, toxic) are counted by language, label and logit. Those of which the rarer label has n weigh n against PRIOR of what they are pulled to.
    """
    load = rows.sparkSession.sparkContext.broadcast(model)

    def cells(batches):
        one_thread()
        for batch in batches:
            for part in _bounded(batch):
                buckets, counts, language = features(part.column(0).to_pylist())
                cell = np.rint(np.clip(load.value.logits(buckets, counts).astype(np.float64), -FARTHEST, FARTHEST) * CELLS)
                yield pa.RecordBatch.from_arrays([pa.array(language.astype(np.int32)), pa.array(cell.astype(np.int32)), part.column(1).cast(pa.int32())], names=["language", "cell", "toxic"])

    counted = rows.select("text", "toxic").mapInArrow(cells, "language int, cell int, toxic int").groupBy("language", "cell").agg(F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("toxic")).toArrow()
    load.destroy()
    set_thresholds(model, *(counted.column(c).to_numpy() for c in ("language", "cell", "clean", "toxic")))


def set_thresholds(model: Model, language: np.ndarray, cell: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> None:
    """Thresholds from the numbers of clean and toxic rows by language and logit."""

    def best(of: np.ndarray) -> float:
        x, at = np.unique(cell[of], return_inverse=True)
        # threshold before position k: what lies above is called toxic
        low = np.concatenate(([0], np.cumsum(np.bincount(at, clean[of])))) / clean[of].sum()
        high = np.concatenate(([0], np.cumsum(np.bincount(at, toxic[of])))) / toxic[of].sum()
        edges = np.concatenate(([x[0] - CELLS], (x[1:] + x[:-1]) / 2, [x[-1] + CELLS])) / CELLS
        top = np.flatnonzero(low - high >= (low - high).max() - 1e-12)
        return float(edges[top[len(top) // 2]])

    rarer = min(clean.sum(), toxic.sum())
    if rarer < 1:
        return
    everyone = rarer * best(np.ones(len(cell), bool)) / (rarer + PRIOR)
    for k in range(len(LANGUAGES)):
        of = language == k
        n = min(clean[of].sum(), toxic[of].sum())
        model.thresholds[k] = (n * best(of) + PRIOR * everyone) / (n + PRIOR) if n else everyone


def held_out():
    """Rows whose label is never learned: crc32 of doc_id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Train and calibrate on all labelled documents outside the held-out fold: four in five train, the others calibrate."""
    spark, paths = docs.sparkSession, []

    def staged(rows: DataFrame, name: str) -> DataFrame:
        paths.append(scratch_path(spark, name))
        rows.write.parquet(paths[-1])
        return spark.read.schema(rows.schema).parquet(paths[-1])

    marks = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = docs.where(~held_out()).select("doc_id", text_column(docs).cast("binary").alias("text"))
    lot = F.xxhash64("doc_id", F.lit("toxicity"))
    try:
        # labelled texts are of about the mean length of all
        size = own.agg(F.coalesce(F.avg(F.coalesce(F.octet_length("text"), F.lit(0))), F.lit(0)).alias("mean")).first()["mean"]
        shards = max(1, -(-int(marks.count() * max(1 / SHARD_ROWS, size / SHARD_BYTES) * 1000 * 4 / 5) // 1000))
        found = own.repartition(shards, "doc_id").join(marks.repartition(shards, "doc_id"), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
        # one shuffle: as the shuffle by doc_id deals them, so lie the shards
        dealt = found.withColumns({"lot": lot, "training": F.pmod(lot, F.lit(5)) > 0, "shard": F.pmod(F.hash("doc_id"), F.lit(shards))}).sortWithinPartitions("shard", "lot", "doc_id")
        rows, of = staged(dealt, "op9-labelled"), F.col("training")
        told = rows.where(of).agg(F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("toxic")).first()
        if not told["clean"] or not told["toxic"]:
            return None
        model = train(rows.where(of))
        calibrate(model, rows.where(~of))
        return model
    finally:
        for path in paths:
            remove_path(spark, path)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])
    load = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows of embeddings, a fixed size

    def start():
        one_thread()
        own = load.value

        def work(texts: list, rows: pa.RecordBatch) -> dict:
            return {"score": pa.array(own.scores(texts) if own is not None else np.zeros(len(texts)), pa.float64())}

        return work

    found = map_texts(docs, start, schema)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score(docs, fit(docs, read_table(spark, sf_dir, "labels")))
