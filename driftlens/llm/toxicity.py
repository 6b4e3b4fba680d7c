"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of five rows of hashed tables (the word, its first four to seven bytes).
Filters of one, two and three words with max pooling feed a logistic output. Labelled rows are a bounded sample in
hash order (MAX_LABELLED rows and MAX_LABELLED_BYTES of text), on which one task trains; every document is scored over
its whole text on the executors. The threshold is calibrated by language, which is guessed from function words of the
text itself; scores are shifted on the logit scale so that 0.5 is each language's threshold.

Rows without a label, null labels and null texts never fail: a null text scores as the empty text; with no labelled
row, or labels of one class only, every score is the labels' mean (0 without any).
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlens.llm.common import map_arrow, small_batches, table, trimmed, utf8
from driftlens.llm.words import Words, blocks, word_hash

MAX_LABELLED, MAX_LABELLED_BYTES = 6_000, 48_000_000
#: Labelled texts over so many bytes join the training sample after all others, while there is room; all are scored.
LONG_TEXT = 480_000
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 15, 8, (1, 2, 3), 12
ROWS, SCORED = 100_000, 1 << 14  # words convolved at a time in training, and in scoring: some 10 MB of arrays
PREFIXES = (None, 4, 5, 6, 7)
SEED = 20
#: Frequent function words by which a text's language is guessed.
FUNCTION_WORDS = {
    "en": ("the", "and", "of", "to", "in", "that", "is", "for", "with", "it"),
    "de": ("der", "die", "und", "das", "ist", "nicht", "mit", "von", "den", "ein"),
    "fr": ("le", "les", "des", "et", "un", "une", "pour", "dans", "est", "du"),
    "es": ("el", "los", "las", "y", "que", "para", "con", "por", "se", "su"),
}
LANGUAGES = (*FUNCTION_WORDS, "other")
_MARKS = {lang: np.array(sorted(word_hash(w) for w in words), np.uint64) for lang, words in FUNCTION_WORDS.items()}


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of bucket numbers (0: padding), words a text, languages.

    Two rows of padding follow each text, and two more the last, so that a window can begin at each of the others.
    """
    words = Words(texts)
    counts = words.counts()
    at = np.arange(len(words.start)) + 2 * words.doc
    ids = np.zeros((len(at) + 2 * len(counts) + 2, len(PREFIXES)), np.int32)
    for k, prefix in enumerate(PREFIXES):
        h = words.hashes(prefix)
        ids[at, k] = 1 + k * BUCKETS + (h >> np.uint64(20)) % np.uint64(BUCKETS)
        if prefix is None:
            votes = np.stack([np.bincount(words.doc[np.isin(h, m)], minlength=words.n) for m in _MARKS.values()] + [np.zeros(words.n)])
    language = np.where(votes.max(0) > 0, votes.argmax(0), len(LANGUAGES) - 1) if words.n else np.zeros(0, np.int64)
    return ids, counts, language


@dataclass
class ToxicityModel:
    """Weights of the network, and the logit at which each language's texts count as toxic."""

    table: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> ToxicityModel:
        table = rng.normal(0, 0.1, (1 + len(PREFIXES) * BUCKETS, DIM)).astype(np.float32)
        table[0] = 0
        return cls(table, [rng.normal(0, 0.5 / np.sqrt(w), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.5, len(WIDTHS) * FILTERS).astype(np.float32), 0.0)

    def convolve(self, ids: np.ndarray) -> np.ndarray:
        """All filters, width by width, at every row but the last two."""
        e = self.table[ids[:, 0]]
        for k in range(1, ids.shape[1]):
            e += self.table[ids[:, k]]
        n = len(e) - 2
        parts = iter(np.split(e @ np.concatenate([f[j] for f in self.filters for j in range(len(f))], 1), sum(WIDTHS), 1))
        return np.concatenate([sum(next(parts)[j : j + n] for j in range(w)) + self.bias[k] for k, w in enumerate(WIDTHS)], 1)

    def peaks(self, ids: np.ndarray, counts: np.ndarray, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
        """Max pooling: each filter's greatest value in each text (of counts words), and the row where its window begins.

        So many rows are convolved at a time, so that a very long text needs no more memory than its bucket numbers.
        """
        n, width = len(counts), len(self.out)
        owner = np.repeat(np.arange(n), counts + 2)
        best, at = np.full((n, width), -np.inf, np.float32), np.zeros((n, width), np.int64)
        for s in range(0, len(owner), rows):
            part = ids[s : s + rows + 2]
            c = self.convolve(part)
            c[part[:-2, 0] == 0] = -np.inf
            own = owner[s : s + len(c)]
            cuts = np.flatnonzero(np.diff(own, prepend=-1))
            top, place = np.maximum.reduceat(c, cuts, axis=0), np.zeros((len(cuts), width), np.int64)
            group = np.repeat(np.arange(len(cuts)), np.diff(np.append(cuts, len(c))))
            row, col = np.nonzero((c == top[group]) & np.isfinite(c))
            slot, first = np.unique(group[row] * width + col, return_index=True)
            place.flat[slot] = s + row[first]
            own = own[cuts]
            at[own] = np.where(top > best[own], place, at[own])
            best[own] = np.maximum(top, best[own])
        return np.maximum(best, 0), at

    def logits(self, ids: np.ndarray, counts: np.ndarray, rows: int = ROWS) -> np.ndarray:
        """One logit a text; texts without words pool zeros."""
        return self.peaks(ids, counts, rows)[0] @ self.out + self.out_bias


_PAD = np.zeros((2, len(PREFIXES)), np.int32)


def _narrow(ids: np.ndarray) -> np.ndarray:
    """The bucket numbers of one text's words, without padding, in 16 bits each: half the memory of the training sample."""
    return ((ids - 1) % BUCKETS).astype(np.uint16)


def _wide(words: np.ndarray) -> np.ndarray:
    """The rows that ``encode`` made, with the text's two rows of padding."""
    return np.concatenate([words + (1 + BUCKETS * np.arange(len(PREFIXES), dtype=np.int32)), _PAD])


def train(texts: list[bytes], toxic: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.05, drop: float = 0.5) -> ToxicityModel:
    """AdaGrad on the logistic loss; gradients flow through the pooled windows only, so an update touches few rows.

    In every other epoch each word is left out with probability drop, so that the filters learn all telling words of a
    text and not only its strongest.
    """
    rng = np.random.default_rng(SEED)
    model = ToxicityModel.fresh(rng)
    encoded = [(_narrow(ids[:-4]), lang[0]) for ids, _, lang in (encode([t]) for t in texts)]
    order = rng.permutation(len(texts))
    keep, check = order[len(order) // 5 :], order[: len(order) // 5]
    weight = np.array([0.5 / max(1 - toxic[keep].mean(), 1e-3), 0.5 / max(toxic[keep].mean(), 1e-3)])
    seen = {"t": np.full(model.table.shape, 1e-2, np.float32), "o": np.full(model.out.shape, 1e-2), "ob": 1e-2, "f": [np.full(f.shape, 1e-2) for f in model.filters], "b": [np.full(FILTERS, 1e-2) for _ in WIDTHS]}
    keep = np.array([i for i in keep if len(encoded[i][0])], np.int64)
    for epoch in range(epochs):
        keep = rng.permutation(keep)
        for s in range(0, len(keep), batch):
            own = keep[s : s + batch]
            parts = [_wide(encoded[i][0]) for i in own]
            if epoch % 2 == 0:
                parts = [ids * (rng.random((len(ids), 1)) >= drop) if len(ids) > 6 else ids for ids in parts]
            ids = np.concatenate([*parts, _PAD])
            pooled, at = model.peaks(ids, np.array([len(p) - 2 for p in parts]))
            p = 1 / (1 + np.exp(-(pooled @ model.out + model.out_bias)))
            g = (p - toxic[own]) * weight[toxic[own]] / batch
            grad_out, grad_ob = g @ pooled, g.sum()
            back = (g[:, None] * model.out * (pooled > 0)).astype(np.float32).reshape(len(own), len(WIDTHS), FILTERS)
            rows, steps, grad_f = [], [], []
            for k, w in enumerate(WIDTHS):
                places = at[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(w):
                    words = ids[places + j]
                    grad_f.append(np.einsum("bfd,bf->df", model.table[words].sum(2), back[:, k]))
                    rows.append(words.reshape(-1, len(PREFIXES)))
                    steps.append((model.filters[k][j].T * back[:, k, :, None]).reshape(-1, DIM))
            touched, inverse = np.unique(np.concatenate(rows), return_inverse=True)
            total = np.zeros((len(touched), DIM), np.float32)
            np.add.at(total, inverse.reshape(-1, len(PREFIXES)), np.concatenate(steps)[:, None, :])
            total[touched == 0] = 0
            seen["t"][touched] += total**2
            model.table[touched] -= rate * total / np.sqrt(seen["t"][touched])
            grads = iter(grad_f)
            for k, w in enumerate(WIDTHS):
                own_f, own_b = np.stack([next(grads) for _ in range(w)]), back[:, k].sum(0)
                seen["f"][k] += own_f**2
                seen["b"][k] += own_b**2
                model.filters[k] -= (rate * own_f / np.sqrt(seen["f"][k])).astype(np.float32)
                model.bias[k] -= (rate * own_b / np.sqrt(seen["b"][k])).astype(np.float32)
            seen["o"] += grad_out**2
            seen["ob"] += grad_ob**2
            model.out -= (rate * grad_out / np.sqrt(seen["o"])).astype(np.float32)
            model.out_bias -= rate * grad_ob / np.sqrt(seen["ob"])
    calibrate(model, [encoded[i] for i in check], toxic[check])
    return model


def _best_cut(logits: np.ndarray, toxic: np.ndarray) -> float | None:
    """The logit that splits with the highest F1, midway in its gap; None with fewer than five of either class."""
    if min(toxic.sum(), (1 - toxic).sum()) < 5:
        return None
    order = np.argsort(-logits, kind="stable")
    hits = np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + toxic.sum())
    k = int(f1.argmax())
    below = logits[order[k + 1]] if k + 1 < len(order) else logits[order[k]] - 1
    return float((logits[order[k]] + below) / 2)


def calibrate(model: ToxicityModel, encoded: list, toxic: np.ndarray) -> None:
    """Thresholds by language from rows the weights were not fitted on; a language with few rows takes the common one."""
    if not len(encoded):
        return
    logits = np.array([model.logits(np.concatenate([_wide(words), _PAD]), np.array([len(words)]))[0] for words, _ in encoded])
    language = np.array([lang for _, lang in encoded])
    common = _best_cut(logits, toxic)
    for k in range(len(LANGUAGES)):
        own = _best_cut(logits[language == k], toxic[language == k])
        model.thresholds[k] = own if own is not None else common if common is not None else 0.0


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str) -> DataFrame:
    """(text, label) of labelled rows outside the held-out fold: a bounded sample in hash order."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label_col).alias("_y")).where("_y is not null and _id is not null").groupBy("_id").agg(F.max("_y").alias("_y"))
    fold = F.crc32(F.col("_id").cast("string").cast("binary")) % 5
    # labels without a document take no place in the sample; it has MAX_LABELLED rows of (id, label) at most, so they may be
    # broadcast and no text is shuffled but theirs
    known = known.join(docs.select(F.col("doc_id").alias("_id")), "_id", "left_semi")
    sample = known.where(fold != 0).withColumn("_h", F.xxhash64("_id")).orderBy("_h", "_id").limit(MAX_LABELLED)
    own = docs.select(F.col("doc_id").alias("_doc"), F.coalesce(F.col("text"), F.lit("")).alias("_text")).withColumn("_t", F.xxhash64("_text"))
    labelled = own.join(F.broadcast(sample), F.col("_doc") == F.col("_id"))
    # rows that repeat id and text count once, and second texts of an id come after the first ones of all ids
    each = labelled.select("_id", "_h", "_t", F.length(F.col("_text").cast("binary")).alias("_n")).distinct()
    each = each.withColumn("_k", F.row_number().over(Window.partitionBy("_id").orderBy("_t"))).where(F.col("_k") <= MAX_LABELLED)
    # long texts come last, shortest first, so that none of them takes the place of all that follow
    order = [F.greatest(F.col("_n"), F.lit(LONG_TEXT)), "_k", "_h", "_id", "_t"]
    running = F.sum(F.col("_n").cast("long")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    picked = each.orderBy(*order).limit(MAX_LABELLED).withColumn("_sum", running).where(F.col("_sum") <= MAX_LABELLED_BYTES).select("_id", "_t", "_k")
    texts = labelled.join(F.broadcast(picked), ["_id", "_t"]).groupBy("_id", "_t", "_k", "_h").agg(F.first("_text").alias("_text"), F.first("_y").alias("_y"))
    return texts.repartition(1).sortWithinPartitions("_k", "_h", "_id", "_t").select("_text", "_y")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic") -> ToxicityModel | float:
    """The trained model, or the labels' mean where they have less than two classes.

    One task trains on the bounded sample, so that the driver holds the finished weights only and a lost executor
    means a second try.
    """

    def run(batches):
        rows = [(t, int(y > 0)) for batch in batches for t, y in zip(utf8(batch.column(0)), batch.column(1).to_pylist(), strict=True)]
        toxic = np.array([y for _, y in rows], np.int64)
        made = train([t for t, _ in rows], toxic) if len(set(toxic.tolist())) > 1 else float(toxic.mean()) if len(toxic) else 0.0
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(made)], pa.binary())})

    made = training_rows(docs, labels, label_col).mapInArrow(trimmed(run), "model binary").collect()  # one row
    return pickle.loads(made[0].model) if made else 0.0


def score_texts(model: ToxicityModel | float, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, languages and thresholds of texts."""
    ids, counts, language = encode(texts)
    if isinstance(model, float):
        return np.full(len(texts), model), language, np.full(len(texts), 0.5)
    cut = model.thresholds[language]
    z = np.clip(model.logits(ids, counts, SCORED) - cut, -50, 50)
    return 1 / (1 + np.exp(-z)), language, 1 / (1 + np.exp(-cut))


def score(docs: DataFrame, model: ToxicityModel | float) -> DataFrame:
    """doc_id, score, language (guessed from the text), threshold (its score before the shift) for every document."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batch):
        model, texts = held.value, list(utf8(batch.column(1)))
        parts = []
        for a, b in blocks(texts):
            parts.append(score_texts(model, texts[a:b]))
        scores, language, cut = (np.concatenate(x) for x in zip(*parts, strict=True))
        return {"doc_id": batch.column(0), "score": scores.astype(float), "language": [LANGUAGES[k] for k in language], "threshold": cut.astype(float)}

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, score double, language string, threshold double")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of documents; labels are learnt outside the held-out fold only."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "language", "threshold")


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows of docs whose text scores under 0.5, all their columns unchanged, without a shuffle.

    Null and empty texts score as texts without words; repeated rows are judged alike; an empty table stays empty.
    """
    held = spark.sparkContext.broadcast(fit(docs, table(spark, sf_dir, "labels")))
    small_batches(spark)

    def run(batches):
        for batch in batches:
            texts = list(utf8(batch.column(batch.schema.get_field_index("text"))))
            scores = [score_texts(held.value, texts[a:b])[0] for a, b in blocks(texts)]
            yield batch.filter(pa.array(np.concatenate(scores) < 0.5)) if scores else batch

    return docs.mapInArrow(trimmed(run), docs.schema)
