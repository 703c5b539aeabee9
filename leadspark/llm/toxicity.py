"""Toxicity: a convolutional text classifier trained in numpy and applied in batches.

A word is the sum of two rows of an embedding table picked by two hashes, so that
a chance meeting with a telling word in one row alone does not score. Filters of
several widths slide over the words, each keeps its maximum over the whole text,
and a logistic layer turns the maxima into a score.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, kept, small_batches
from .tokens import batch_parts, text_bytes, words

WIDTHS = (1, 2, 3)
FILTERS = 12
DIM = 16
ROWS = 1 << 16
#: Labelled rows of each class that training reads at most.
SAMPLE = 3_000
#: Words of training text at most, half of them for each class; the sample ends in hash order where they are reached.
SAMPLE_WORDS = 4_000_000
#: Labelled rows of more words do not train; all that do are read whole.
DOC_WORDS = 20_000
EPOCHS = 8
#: Step size of training.
RATE = 0.05
#: Spread of the embeddings at the start, and share of filters that the output ignores in a step.
SPREAD, DROPPED = 0.1, 0.25
#: Bins of a unit of log-odds, and the highest bin, in the counts that thresholds are set from.
BINS, TOP = 50, 1_000
#: Toxic rows that a language needs for a threshold of its own.
LEAST_TOXIC = 50
#: Words scored at a time.
STEP_WORDS = 100_000
#: Bytes of text hashed at a time.
STEP_BYTES = 1 << 20
SEED = 7


@dataclass
class Model:
    """Weights, the rejection threshold of each language (the key None holds for all others), and the last id hash of each class in training."""

    table: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    intercept: float
    thresholds: dict = field(default_factory=dict)
    cuts: dict = field(default_factory=dict)
    aside: bool = False
    _tables: list | None = None

    def plain(self) -> dict:
        """What a task needs, without this class: for broadcasting and kept()."""
        names = ("table", "filters", "bias", "out", "intercept", "thresholds")
        return {"content": {x: getattr(self, x) for x in names}}

    def tables(self) -> list[np.ndarray]:
        """What each row of the embedding table adds to each filter at each offset: a convolution is then a sum of gathers."""
        if self._tables is None:
            self._tables = [[self.table @ w[o] for o in range(len(w))] for w in self.filters]
        return self._tables

    def features(self, h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Maxima of all filters over each row; 0 (no activation) for rows without words."""
        a, b = rows_of(h)
        n = np.diff(bounds)
        some = np.flatnonzero(n > 0)
        out = np.zeros((len(n), len(WIDTHS) * FILTERS), np.float32)
        if not len(some):
            return out
        for k, parts in enumerate(self.tables()):
            act = parts[0][a] + parts[0][b]
            for o in range(1, len(parts)):
                more = parts[o][a[o:]] + parts[o][b[o:]]
                more[_crossing(bounds, some, o)] = 0
                act[: len(act) - o] += more
            top = np.maximum.reduceat(act, bounds[:-1][some], axis=0)
            out[some, k * FILTERS : (k + 1) * FILTERS] = top
        return np.maximum(out + self.bias, 0) * (n > 0)[:, None]

    def score(self, h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Scores of all rows, about STEP_WORDS words at a time."""
        out, at = [np.zeros(0)], 0
        while at < len(bounds) - 1:
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + STEP_WORDS, "right")) - 1)
            z = self.features(h[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at]) @ self.out + self.intercept
            out.append(1 / (1 + np.exp(-z.astype(np.float64))))
            at = end
        return np.concatenate(out)


def _made(content: dict) -> Model:
    return Model(**content)


def _crossing(bounds: np.ndarray, some: np.ndarray, o: int) -> np.ndarray:
    """Starts of windows whose word at offset o lies beyond their row (it then adds nothing)."""
    ends, begins = bounds[1:][some], bounds[:-1][some]
    at = np.concatenate([ends - 1 - j for j in range(o)])
    ok = (at >= np.tile(begins, o)) & (at < bounds[-1] - o)
    return at[ok]


def rows_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two table rows of each word hash."""
    return (h & np.uint64(ROWS - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(ROWS - 1)).astype(np.int64)


def train(h: np.ndarray, bounds: np.ndarray, labels: np.ndarray) -> Model:
    """Fits a model to rows of word hashes and 0/1 labels; the same rows give the same model.

    The first embedding coordinate starts at the smoothed log-odds of words that are
    toxic beyond chance, the rest at random values. Half of the filters start at that
    coordinate, the other half at random directions without a threshold, so that
    order and company of any words can be learnt. Filters, output and the embeddings
    that filters pick are trained by Adagrad on the logistic loss, with dropout.
    Where only one class is present, every score is its smoothed share; without rows
    scores are low.
    """
    rng = np.random.default_rng(SEED)
    table = (rng.standard_normal((ROWS, DIM)) * SPREAD).astype(np.float32)
    table[:, 0] = 0
    share = labels.mean() if len(labels) else 0.0
    if 0 < share < 1:
        words_seen, odds = telling_words(h, bounds, labels)
        for rows in rows_of(words_seen):
            np.maximum.at(table[:, 0], rows, (odds / 2).clip(0).astype(np.float32))
    # Of each width's filters one half starts at the first coordinate, the other half at random directions of the rest.
    filters = [(rng.standard_normal((w, DIM, FILTERS)) / np.sqrt(w * DIM)).astype(np.float32) for w in WIDTHS]
    half = FILTERS // 2
    bias = np.zeros((len(WIDTHS), FILTERS), np.float32)
    out = (rng.standard_normal((len(WIDTHS), FILTERS)) * 0.1).astype(np.float32)
    for w in filters:
        w[:, :, :half] *= 0.1
        w[0, 0, :half] = 1.0
    bias[:, :half], out[:, :half] = -0.8, 0.3
    prior = float(np.log((labels.sum() + 1) / ((1 - labels).sum() + 1))) if len(labels) else -2.0
    model = Model(table, filters, bias.ravel(), out.ravel(), prior if share in (0, 1) else -2.0)
    if not 0 < share < 1:
        model.out[:] = 0  # one class alone teaches only how common it is
        return model
    squares = {k: 1e-6 for k in ("out", "bias", "intercept")} | {"table": np.full(ROWS, 1e-6), "filters": [np.full(w.shape, 1e-6) for w in filters]}
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    for epoch in range(EPOCHS):
        order = rng.permutation(len(labels))
        for part in np.array_split(order, max(1, len(order) // 64)):
            keep = (rng.random(len(model.out)) >= DROPPED) / (1 - DROPPED)
            _step(model, h, bounds, labels, weight, part, squares, RATE / (1 + epoch / 2), keep.astype(np.float32))
    return model


def telling_words(h: np.ndarray, bounds: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, log-odds) of words that are toxic beyond chance: a Chernoff bound on seeing so many toxic rows, against all words that could."""
    own = [np.unique(h[s:e]) for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
    words_seen, word = np.unique(np.concatenate(own), return_inverse=True)
    toxic, all_docs = np.bincount(word, np.repeat(labels, [len(x) for x in own]), len(words_seen)), np.bincount(word, minlength=len(words_seen))
    share = labels.mean()
    odds = np.log((toxic + 2 * share) / (all_docs - toxic + 2 * (1 - share)) * (1 - share) / share)
    rate = np.clip(toxic / np.maximum(all_docs, 1), 1e-9, 1 - 1e-9)
    gain = all_docs * (rate * np.log(rate / share) + (1 - rate) * np.log((1 - rate) / (1 - share)))
    strong = np.flatnonzero((odds > 1.0) & (gain > np.log(10 * max(1, (all_docs >= 3).sum()))))
    return words_seen[strong], odds[strong]


def _step(model: Model, h, bounds, labels, weight, part, squares, rate, kept_filters) -> None:
    """One Adagrad step on the rows of `part`; rows without words teach the intercept."""
    own = [h[bounds[i] : bounds[i + 1]] for i in part]
    some = np.array([k for k, x in enumerate(own) if len(x)], np.int64)
    x = np.concatenate(own) if len(own) else h[:0]
    at = np.concatenate(([0], np.cumsum([len(own[k]) for k in some]))).astype(np.int64)
    a, b = rows_of(x)
    vectors = model.table[a] + model.table[b]
    z1, best = np.zeros((len(part), len(model.out)), np.float32), []
    for k, w in enumerate(model.filters):
        act = vectors @ w[0]
        for o in range(1, len(w)):
            more = vectors[o:] @ w[o]
            more[_crossing(at, np.arange(len(some)), o)] = 0
            act[: len(act) - o] += more
        top = np.stack([s + act[s:e].argmax(0) for s, e in zip(at[:-1], at[1:], strict=True)]) if len(some) else np.zeros((0, FILTERS), np.int64)
        best.append(top)
        cut = slice(k * FILTERS, (k + 1) * FILTERS)
        z1[some, cut] = np.take_along_axis(act, top, 0) + model.bias[cut]
    on = np.maximum(z1, 0) * kept_filters
    p = 1 / (1 + np.exp(-(on @ model.out + model.intercept)))
    g = ((p - labels[part]) * weight[part] / len(part)).astype(np.float32)
    d1 = (g[:, None] * model.out * kept_filters) * (z1 > 0)
    g_out, g_bias, g_in = on.T @ g, d1.sum(0), float(g.sum())
    touched, pulls = [np.zeros(0, np.int64)], [np.zeros((0, DIM), np.float32)]
    for k, w in enumerate(model.filters):
        d = d1[some, k * FILTERS : (k + 1) * FILTERS]
        g_w = np.zeros_like(w)
        for o in range(len(w)):
            pos = best[k] + o
            inside = pos < at[1:, None]
            pos = np.minimum(pos, len(x) - 1)
            do = d * inside
            g_w[o] = np.einsum("rfd,rf->df", vectors[pos], do)
            r, f = np.nonzero(do)
            grad = w[o].T[f] * do[r, f][:, None]
            touched += [a[pos[r, f]], b[pos[r, f]]]
            pulls += [grad, grad]
        squares["filters"][k] += g_w**2
        model.filters[k] -= (rate * g_w / np.sqrt(squares["filters"][k])).astype(np.float32)
    squares["out"] = squares["out"] + g_out**2
    squares["bias"] = squares["bias"] + g_bias**2
    squares["intercept"] += g_in**2
    model.out -= (rate * g_out / np.sqrt(squares["out"])).astype(np.float32)
    model.bias -= (rate * g_bias / np.sqrt(squares["bias"])).astype(np.float32)
    model.intercept -= rate * g_in / float(np.sqrt(squares["intercept"]))
    rows, inverse = np.unique(np.concatenate(touched), return_inverse=True)
    if len(rows):
        grads = np.zeros((len(rows), DIM), np.float32)
        np.add.at(grads, inverse, np.concatenate(pulls))
        squares["table"][rows] += (grads**2).sum(1)
        model.table[rows] -= (rate * grads / np.sqrt(squares["table"][rows])[:, None]).astype(np.float32)


def _hashed(texts: pa.Array):
    """Word hashes of the texts and their bounds, about STEP_BYTES of text at a time."""
    data, offsets = text_bytes(texts, fold=True)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STEP_BYTES, "right")) - 1)
        yield words(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], "alnum")
        at = end


def _hash_rows(batches):
    for batch in batches:
        whole = [h[s:e].tobytes() if e - s <= DOC_WORDS else None for h, bounds in _hashed(batch.column("text")) for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
        out = pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("lang"), pa.array(whole, pa.binary())], ["toxic", "lang", "words"])
        yield out.filter(out.column("words").is_valid())


def _word_counts(batches):
    for batch in batches:
        n = np.concatenate([np.zeros(0, np.int64), *[np.diff(bounds) for _, bounds in _hashed(batch.column("text"))]])
        out = pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("o"), pa.array(n.astype(np.int64))], ["toxic", "o", "n"])
        yield out.filter(pa.array(n <= DOC_WORDS))


def held_out(key) -> object:
    """Whether a row is outside training: crc32 of its id as text is a multiple of 5."""
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, lang, toxic): docs that have a label."""
    known = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    own = small_batches(docs).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return own.join(known.hint("merge"), "doc_id")


def _may_train(aside: bool):
    """Whether a row may train: it is not held out, nor in the eighth of the others that is set aside for thresholds."""
    number = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8"))
    return ~held_out(F.col("doc_id")) & (F.floor(number / 5) % 8 != 0 if aside else F.lit(True))


def _in_sample(cuts: dict, aside: bool) -> object:
    """Whether a labelled row is in the sample that ends at these id hashes."""
    inside = F.lit(False)
    for c, m in cuts.items():
        inside = inside | ((F.col("toxic") == c) & (F.xxhash64("doc_id", F.lit(SEED)) <= m))
    return inside & _may_train(aside)


def fit(docs: DataFrame, labels: DataFrame, aside: bool = False) -> Model:
    """Trains on a bounded sample of the labelled rows outside the held-out fifth; calibrate() sets the thresholds.

    With aside, an eighth of those rows is left to calibrate(). Null labels, ids and
    documents without a label do not train; a null text is empty; of labels that
    repeat an id the largest counts, and rows that repeat an id train each. Without
    labelled rows the model knows nothing and scores are low.

    The sample is the first SAMPLE rows of each class in the order of a hash of
    their ids, without those of more than DOC_WORDS words, as far as a class's half
    of SAMPLE_WORDS goes (its first row in any case); it is all that reaches the
    driver.
    """
    rows = _labelled(docs, labels).where(_may_train(aside))
    # Sizes first, so that only texts of the sample move.
    light = rows.select("toxic", F.xxhash64("doc_id", F.lit(SEED)).alias("o"), "doc_id")
    cut = {c: light.where(F.col("toxic") == c).select("o").orderBy("o").limit(SAMPLE).agg(F.max("o")).first()[0] for c in (0, 1)}
    cut = {c: m for c, m in cut.items() if m is not None}
    if not cut:
        return train(np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0))
    sizes = rows.where(_in_sample(cut, aside)).select("toxic", F.xxhash64("doc_id", F.lit(SEED)).alias("o"), "text").mapInArrow(_word_counts, "toxic int, o long, n long")
    most, cut = {c: SAMPLE_WORDS // 2 for c in cut}, {}
    for toxic, o, n in sorted(sizes.groupBy("toxic", "o").agg(F.sum("n")).collect()):
        most[toxic] -= n
        if most[toxic] >= 0 or toxic not in cut:
            cut[toxic] = o
    chosen = rows.where(_in_sample(cut, aside)).select("toxic", "lang", "text")
    sample = chosen.mapInArrow(_hash_rows, "toxic int, lang string, words binary")
    held = sorted((toxic, lang or "", len(w), bytes(w)) for toxic, lang, w in sample.toLocalIterator())
    y, n_words = np.array([x[0] for x in held], np.float64), [x[2] // 8 for x in held]
    bounds = np.concatenate(([0], np.cumsum(n_words))).astype(np.int64)
    h = np.frombuffer(b"".join(x[3] for x in held), np.uint64)
    del held
    model = train(h, bounds, y)
    model.cuts, model.aside, model._tables = cut, aside, None
    return model


def calibrate(model: Model, docs: DataFrame, labels: DataFrame, target: float = 0.98) -> Model:
    """Sets the model's thresholds from the scores of all labelled rows that it was not trained on, but for the held-out fifth.

    Rows are scored and counted in Spark by language, label and bin of log-odds; a
    class counts as often as among all labelled rows of its language, whatever the
    sample took. A threshold lies half-way below the lowest bin down to which at
    least `target` of the rows are toxic, never below 0.5. Languages with fewer than
    LEAST_TOXIC toxic rows, or that never reach the target, take the threshold of
    all; where all never reach it, nothing is rejected.
    """
    rows = _labelled(docs, labels).withColumn("lang", F.coalesce("lang", F.lit("")))
    fresh = _not_trained(rows, model).select("toxic", "lang", "text")
    scored = fresh.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model.plain())), "toxic int, lang string, score double")
    return _set_thresholds(model, rows, scored, target)


def _not_trained(rows: DataFrame, model: Model) -> DataFrame:
    """Labelled rows that the model has not seen, but for the held-out fifth."""
    return rows.where(~held_out(F.col("doc_id")) & ~_in_sample(model.cuts, model.aside))


def _set_thresholds(model: Model, rows: DataFrame, scored: DataFrame, target: float) -> Model:
    """Thresholds from scored(toxic, lang, score), weighed by the classes of all rows(lang, toxic)."""
    whole = {(r["lang"], r["toxic"]): r["count"] for r in rows.groupBy("lang", "toxic").count().collect()}
    odds = F.coalesce(F.log(F.try_divide(F.col("score"), 1 - F.col("score"))), F.lit(float(TOP)))
    place = F.when(F.col("score") >= 0.5, F.least(F.floor(odds * BINS), F.lit(TOP))).otherwise(-1).cast("int")
    counts: dict = {}
    for lang, toxic, at, n in scored.groupBy("lang", "toxic", place.alias("at")).count().collect():
        counts.setdefault(lang, np.zeros((2, TOP + 2)))[toxic, max(at, -1) + 1] += n
    model.thresholds, total = {}, np.zeros((2, TOP + 2))
    for lang, seen in counts.items():
        enough = seen[1].sum() >= LEAST_TOXIC and (seen[0].sum() > 0 or (lang, 0) not in whole)
        for c in (0, 1):
            if seen[c].sum():
                seen[c] *= whole[lang, c] / seen[c].sum()
        total += seen
        if enough and (limit := _threshold(seen, target)) is not None:
            model.thresholds[lang] = limit
    # A class that is labelled but never scored leaves the target without evidence.
    known = all(total[c].sum() > 0 for _, c in whole)
    limit = _threshold(total, target) if known else None
    model.thresholds[None] = float("inf") if limit is None else limit
    return model


def _threshold(counts: np.ndarray, target: float) -> float | None:
    """The threshold of counts by label and bin (from -1 on: below 0.5), or None where the target is never reached."""
    up_to = counts[:, ::-1].cumsum(1)[:, ::-1]
    good = np.flatnonzero((counts[1] > 0) & (up_to[1] >= target * up_to.sum(0)))
    good = good[good > 0]
    if not len(good):
        return None
    below = np.flatnonzero(counts.sum(0)[: good[0]])
    low = below[-1] if len(below) else 0
    return float(1 / (1 + np.exp(-((good[0] - 1) + low) / 2 / BINS)))


def _score(shared):
    def run(batches):
        model = kept(shared, "model", _made)
        for batch in batches:
            out = [model.score(h, bounds) for h, bounds in _hashed(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in batch.schema.names if x != "text"], pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())], [*[x for x in batch.schema.names if x != "text"], "score"])

    return run


def _scores(docs: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, lang, score) of all rows; lang is null where docs has none."""
    id_type = docs.schema[id_col].dataType.simpleString()
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    own = small_batches(docs).select(F.col(id_col).alias("doc_id"), lang.alias("lang"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model.plain())), f"doc_id {id_type}, lang string, score double")


def _verdicts(scored: DataFrame, model: Model, known: bool) -> DataFrame:
    limit = F.lit(model.thresholds.get(None)).cast("double")
    for name, own_limit in model.thresholds.items():
        if name is not None:
            limit = F.when(F.coalesce("lang", F.lit("")) == name, own_limit).otherwise(limit)
    rejected = (F.col("score") >= limit) if known and model.thresholds else F.lit(None).cast("boolean")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), rejected.alias("rejected"))


def toxicity_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, rejected): one row per row of docs, scored over the whole text.

    Only the text enters the score. rejected compares it with the threshold of the
    row's language, as drop_toxic() does; it is null where docs has no column lang or
    the model no thresholds. Null, empty and blank texts score as the model
    does without words. Rows that repeat an id or a text score alike; further
    columns are not read; an empty table gives an empty result.
    """
    return _verdicts(_scores(docs, model, id_col, text_col), model, "lang" in docs.columns)


def learned_scores(docs: DataFrame, labels: DataFrame, target: float = 0.98) -> DataFrame:
    """toxicity_scores() of a model fitted and calibrated on these labels: docs(doc_id, text, lang) are scored once, and thresholds come from the written scores, so no text is shuffled for them."""
    model = fit(docs, labels, aside=True)
    scored = Scratch(docs.sparkSession, "toxicity").table(_scores(docs, model, "doc_id", "text"), "scores")
    known = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = scored.withColumn("lang", F.coalesce("lang", F.lit(""))).join(known.hint("merge"), "doc_id")
    model = _set_thresholds(model, rows, _not_trained(rows, model).select("toxic", "lang", "score"), target)
    return _verdicts(scored, model, True)


def _keep(shared):
    def run(batches):
        for batch, scored in ((b, next(_score(shared)(iter([pa.RecordBatch.from_arrays([b.column("text")], ["text"])])))) for batch in batches for b in batch_parts(batch, "text")):
            limits = shared.value["content"]["thresholds"]
            limit = np.array([limits.get(x or "", limits.get(None, 0.5)) for x in batch.column("lang").to_pylist()])
            yield batch.filter(pa.array(scored.column("score").to_numpy(zero_copy_only=False) < limit))

    return run


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs(text, lang, ...) that score below their language's threshold; columns unchanged.

    Null and empty texts score as the model does without words; a null language
    counts as an empty name, and one without a threshold takes that of all. Rows that
    repeat an id or a text are judged each; column names are free, but for text and
    lang; an empty table stays empty.
    """
    return small_batches(docs).mapInArrow(_keep(docs.sparkSession.sparkContext.broadcast(model.plain())), docs.schema)
