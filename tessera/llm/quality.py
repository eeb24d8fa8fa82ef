"""Quality classifier by co-training of a text view and a metadata view.

The text view sees what a document says: which of NGRAMS telling n-grams it has (words and pairs of neighbours, each kind hashed into BUCKETS buckets
of its own; half are those that tell good from bad labelled documents best by chi-squared, half those rarest among good ones for their number among
bad ones), shares of character classes, and repetition of words and shingles. The metadata view sees the source, the language code,
the stated length and the shape of the page (lines and line lengths). Both are logistic regressions. Over ROUNDS rounds each
view labels the unlabelled documents that it is most confident about, and the other view learns from them; then each view is
calibrated on labelled documents that no training saw, and the calibrated log-odds are added to score every document. A document is kept
if its score reaches the cut that keeps KEEP_GOOD of the good calibration documents, and at most one half.

Good means quality 1 and toxic 0. Fit: at most LABELLED labelled documents, chosen by a hash of doc_id (a documented bound); only their feature
rows, some three hundred numbers each, reach the driver. All unlabelled documents take part: the texts are read once and leave about 100 bytes of features
each in a table, and STEPS Newton steps a round take slopes and second derivatives summed by Spark over all confident rows of it. These rows weigh
PSEUDO_WEIGHT each, but together at most POOL_SHARE times as much as the labelled ones, so that a corpus of any size leaves the labels their say. Scoring is a
pass over the same table; the model is a few kB.

Edge cases: null texts count as empty, null source and language as values of their own, a null length as the text's own. Without labels of both
classes every score is 0.5 and all are kept. Repeated labels of a document count once (the worse one); repeated documents are scored, and unlabelled ones
learned from, each; documents without an id are unlabelled. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_BLOCK, Words, discard, in_blocks, shingle_hashes, small, small_batches, table, written

LABELLED = 20_000
ROUNDS, STEPS = 3, 2
CONFIDENT = 0.95
PSEUDO_WEIGHT, POOL_SHARE = 0.5, 4
KEEP_GOOD = 0.995
BUCKETS, NGRAMS = 1 << 17, 256
#: The least chi-squared of an n-gram: about the largest that one of 10,000 n-grams without a bearing reaches.
LEAST_CHI = 15.0
SOURCES, LANGS = 32, 16
_CLASSES = 8
_U = np.uint64


def _byte_classes() -> np.ndarray:
    """0 control signs, 1 lower, 2 upper, 3 digit, 4 blank, 5 newline, 6 bytes beyond ASCII, 7 all other ASCII signs."""
    out = np.zeros(256, np.uint8)
    out[33:127] = 7
    out[97:123], out[65:91], out[48:58], out[[9, 11, 12, 13, 32]], out[10], out[128:] = 1, 2, 3, 4, 5, 6
    return out


def _plain_words() -> Words:
    w = Words()
    b = np.zeros(256, bool)
    b[[i for i in range(128) if not chr(i).isalnum()]] = True
    w.blank = b
    return w


def _bucketed(words: np.ndarray) -> np.ndarray:
    """The distinct buckets of a text's words, and, after those, of its pairs of neighbours."""
    pairs = shingle_hashes(words, 2) if len(words) > 1 else words[:0]
    return np.concatenate([np.unique((g >> _U(40)) % _U(BUCKETS)).astype(np.int64) + k * BUCKETS for k, g in enumerate((words, pairs))])


def text_features(texts: list[bytes], hasher: Words, classes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Per text, a row of numbers; and its distinct n-gram buckets."""
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    owner = np.repeat(np.arange(len(texts)), sizes)
    counts = np.bincount(owner * _CLASSES + classes[data], minlength=len(texts) * _CLASSES).reshape(-1, _CLASSES)
    words, bounds = hasher.of_texts(texts)
    rest = np.zeros((len(texts), 6))
    buckets = []
    for i in range(len(texts)):
        w = words[bounds[i] : bounds[i + 1]]
        b = _bucketed(w)
        buckets.append(b)
        if len(w):
            sh = shingle_hashes(w)
            rest[i] = (len(np.unique(w)) / len(w), len(np.unique(sh)) / len(sh), (w[1:] == w[:-1]).mean() if len(w) > 1 else 0, min(20.0, sizes[i] / len(w)), np.log1p(len(w)), len(w) < 5)
    return np.hstack([np.sqrt(counts / np.maximum(1, sizes)[:, None]), rest]), buckets


def meta_features(source: list, lang: list, n_chars: list, texts: list[bytes]) -> np.ndarray:
    out = np.zeros((len(texts), SOURCES + LANGS + 4))
    for i, (s, g, n, t) in enumerate(zip(source, lang, n_chars, texts, strict=True)):
        out[i, zlib.crc32(repr(s).encode()) % SOURCES] = 1
        out[i, SOURCES + zlib.crc32(repr(g).encode()) % LANGS] = 1
        n = len(t) if n is None else max(0, n)
        lines = t.count(b"\n") + 1
        out[i, -4:] = np.log1p(n), np.log1p(lines), np.log1p(n / lines), n < 50
    return out


# --- logistic regression ------------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _standard(m: dict, x: np.ndarray) -> np.ndarray:
    return np.hstack([np.clip((x - m["mean"]) / m["scale"], -8, 8), np.ones((len(x), 1))])


def slopes(m: dict, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The log-likelihood's second derivatives (negative) at the model, and below them its slope; features are standardised a few thousand rows at a time."""
    n = len(m["b"])
    out = np.zeros((n + 1, n))
    for at in range(0, len(x), 4096):
        z = _standard(m, x[at : at + 4096])
        p = _sigmoid(z @ m["b"])
        out[:-1] += (z * (p * (1 - p) + 1e-9)[:, None]).T @ z
        out[-1] += z.T @ (y[at : at + 4096] - p)
    return out


def stepped(m: dict, sums: np.ndarray, ridge: float = 1.0, most: float = 20.0) -> tuple[dict, float]:
    """The model after a Newton step on the sums, no coefficient by more than `most`; and the step's size."""
    penalty = np.full(len(m["b"]), ridge)
    penalty[-1] = 1e-6
    step = np.clip(np.linalg.solve(sums[:-1] + np.diag(penalty), sums[-1] - penalty * m["b"]), -most, most)
    return m | {"b": m["b"] + step}, float(np.abs(step).max())


def fitted(x: np.ndarray, y: np.ndarray) -> dict:
    """Newton's method on standardised features."""
    m = {"mean": x.mean(0, dtype=float), "scale": x.std(0, dtype=float) + 1e-6, "b": np.zeros(x.shape[1] + 1)}
    for _ in range(30):
        m, size = stepped(m, slopes(m, x, y))
        if size < 1e-6:
            break
    return m


def pool_slopes(given: dict, models: dict, text: np.ndarray, meta: np.ndarray) -> dict:
    """For each view: slopes() of its model on the rows that the other view, as given, is sure about, and below them their number."""
    views, out = {"text": text, "meta": meta}, {}
    for v, other in (("text", "meta"), ("meta", "text")):
        p = _sigmoid(log_odds(given[other], views[other]))
        sure = (p >= CONFIDENT) | (p <= 1 - CONFIDENT)
        sums = slopes(models[v], views[v][sure], (p[sure] > 0.5).astype(float))
        out[v] = np.vstack([sums, np.full((1, sums.shape[1]), float(sure.sum()))])
    return out


def log_odds(m: dict, x: np.ndarray) -> np.ndarray:
    parts = (x[at : at + 4096] for at in range(0, max(1, len(x)), 4096))
    return np.concatenate([np.clip((part - m["mean"]) / m["scale"], -8, 8) @ m["b"][:-1] + m["b"][-1] for part in parts])


def calibrated(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling: slope and offset of the log-odds, on targets drawn slightly inwards."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.column_stack([raw, np.ones(len(raw))])
    b = np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(x @ b)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (t - p) - 1e-3 * (b - [1, 0]))
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(b[0], 0.0)), float(b[1])


def co_trained(text: np.ndarray, meta: np.ndarray, y: np.ndarray, held: np.ndarray, rounds: int = ROUNDS, pooled=None) -> dict | None:
    """y: 1 good, 0 bad, -1 unlabelled. held: rows for calibration only. None without both classes.

    pooled: pool_slopes() of two dicts of models, summed over unlabelled rows kept elsewhere; by default over those given."""
    train, pool, check = (y >= 0) & ~held, y < 0, (y >= 0) & held
    if len(set(y[train])) < 2 or len(set(y[check])) < 2:
        return None
    pooled = pooled or (lambda given, models: pool_slopes(given, models, text[pool], meta[pool]))
    views, known = {"text": text, "meta": meta}, y[train].astype(float)
    models = {v: fitted(x[train], known) for v, x in views.items()}
    for _ in range(rounds):
        given = models
        for _ in range(STEPS):
            sums = pooled(given, models)
            share = {v: min(PSEUDO_WEIGHT, POOL_SHARE * len(known) / max(1.0, sums[v][-1, 0])) for v in views}
            models = {v: stepped(models[v], slopes(models[v], x[train], known) + share[v] * sums[v][:-1])[0] for v, x in views.items()}
    out: dict = {"models": models, "calibration": {v: calibrated(log_odds(models[v], x[check]), y[check]) for v, x in views.items()}}
    prior = np.log((y[check] > 0).sum() / (y[check] == 0).sum())
    out["prior"] = float(prior)
    good = np.sort(scored(out, text[check][y[check] > 0], meta[check][y[check] > 0])[2])
    out["cut"] = float(min(0.5, good[int((1 - KEEP_GOOD) * len(good))] * 0.999))
    return out


def scored(m: dict, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Calibrated probabilities of the views and of both together."""
    lo = {v: m["calibration"][v][0] * log_odds(m["models"][v], x) + m["calibration"][v][1] for v, x in (("text", text), ("meta", meta))}
    return _sigmoid(lo["text"]), _sigmoid(lo["meta"]), _sigmoid(lo["text"] + lo["meta"] - m["prior"])


# --- Spark jobs -----------------------------------------------------------------------------------------------------


def _batches(batches):
    """(batch, lo, hi, texts) in blocks of about TEXT_BLOCK bytes."""
    for batch in batches:
        texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        for lo, hi in in_blocks([len(t) for t in texts], TEXT_BLOCK):
            yield batch.slice(lo, hi - lo), texts[lo:hi]


def _columns(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, chars_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), F.col(chars_col).cast("long").alias("n_chars"))


def telling_ngrams(docs: DataFrame, known: DataFrame, least: int = 5) -> np.ndarray:
    """The chosen n-gram buckets, ascending: NGRAMS at most, none under LEAST_CHI, ties by number, those of the second half in at least `least` bad documents and 0.5 % of them.

    known: doc_id and good, few enough to broadcast. The counts are summed by Spark; one row for each bucket in `least` documents is collected."""

    def count(batches):
        hasher = _plain_words()
        for batch, texts in _batches(batches):
            seen = np.zeros((2, 2 * BUCKETS), np.int64)
            words, bounds = hasher.of_texts(texts)
            for k, good in enumerate(batch.column("good").to_pylist()):
                seen[good, _bucketed(words[bounds[k] : bounds[k + 1]])] += 1
            good, bucket = np.nonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(good.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(seen[good, bucket])], ["good", "bucket", "n"])

    rows = docs.join(F.broadcast(known), "doc_id").select("good", "text")  # at most LABELLED rows
    both = [F.sum(F.when(F.col("good") == g, F.col("n")).otherwise(0)).alias(f"n{g}") for g in (0, 1)]
    sums = small_batches(rows).mapInArrow(count, "good int, bucket int, n long").groupBy("bucket").agg(*both).where(F.col("n0") + F.col("n1") >= least)
    sums = sums.toArrow().sort_by("bucket")  # twice BUCKETS narrow rows at most
    bucket, in_bad, in_good = (sums.column(c).to_numpy().astype(float) for c in ("bucket", "n0", "n1"))
    n = {r["good"]: r["n"] for r in known.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = max(1, n.get(0, 0)), max(1, n.get(1, 0))
    lift = in_bad / bad / ((in_good + 1) / good)
    common = in_bad >= max(least, 0.005 * bad)
    share = (in_bad + in_good) / (bad + good)
    chi = (in_bad - bad * share) ** 2 / np.maximum(1e-9, share * (1 - share) * bad * good / (bad + good))
    best = np.argsort(-chi, kind="stable")[: NGRAMS // 2]
    best = best[chi[best] >= LEAST_CHI]
    rest = np.setdiff1d(np.flatnonzero(common & (chi >= LEAST_CHI)), best)
    rest = rest[np.argsort(-lift[rest], kind="stable")][: NGRAMS - len(best)]
    return np.sort(bucket[np.concatenate((best, rest))].astype(np.int64))


def _features(batch: pa.RecordBatch, texts: list[bytes], hasher: Words, classes: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text view's rows, with the chosen n-grams, and the metadata view's."""
    x, buckets = text_features(texts, hasher, classes)
    meta = meta_features(batch.column("source").to_pylist(), batch.column("lang").to_pylist(), batch.column("n_chars").to_pylist(), texts)
    has = np.array([np.isin(told, b, assume_unique=True) for b in buckets], float).reshape(len(texts), len(told))
    return np.hstack([x, has]), meta


def _packed(text: np.ndarray, meta: np.ndarray) -> list[pa.Array]:
    """Rows of both views as two binary columns: numbers, and the bits of n-grams, sources and languages."""
    plain, marks = _CLASSES + 6, SOURCES + LANGS
    numbers = np.hstack([text[:, :plain], meta[:, marks:]]).astype(np.float32)
    bits = np.packbits(np.hstack([meta[:, :marks], text[:, plain:]]) > 0, axis=1)
    return [pa.array([r.tobytes() for r in part], pa.binary()) for part in (numbers, bits)]


def _unpacked(numbers: list[bytes], bits: list[bytes], n_told: int) -> tuple[np.ndarray, np.ndarray]:
    plain, marks = _CLASSES + 6, SOURCES + LANGS
    n = np.frombuffer(b"".join(numbers), np.float32).reshape(len(numbers), -1)
    b = np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1), axis=1)[:, : marks + n_told].astype(np.float32)
    return np.hstack([n[:, :plain], b[:, marks:]]), np.hstack([b[:, :marks], n[:, plain:]])


def _views(batch: pa.RecordBatch, n_told: int) -> tuple[np.ndarray, np.ndarray]:
    return _unpacked(batch.column("numbers").to_pylist(), batch.column("bits").to_pylist(), n_told)


def feature_rows(docs: DataFrame, told: np.ndarray) -> DataFrame:
    """doc_id and both views' features, packed, of every row: one pass over the texts."""

    def features(batches):
        hasher, classes = _plain_words(), _byte_classes()
        for batch, texts in _batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_packed(*_features(batch, texts, hasher, classes, told))], ["doc_id", "numbers", "bits"])

    return small_batches(docs).mapInArrow(features, "doc_id long, numbers binary, bits binary")


def summed_slopes(pool: DataFrame, n_told: int, given: dict, models: dict) -> dict:
    """pool_slopes() over all rows of pool. A task sends one row for each matrix row, about 2 kB; these are added by matrix row, in the order of the tasks, and
    the sums, some 330 rows, are collected."""
    names = ("text", "meta")

    def part(batches):
        total = None
        for batch in batches:
            sums = pool_slopes(given, models, *_views(batch, n_told))
            total = sums if total is None else {v: total[v] + sums[v] for v in names}
        if total is not None:
            task = TaskContext.get().partitionId()
            rows = [(k, at, task, r.tobytes()) for k, v in enumerate(names) for at, r in enumerate(total[v])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["view", "at", "task", "sums"])

    def added(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("task")
        total = np.sum([np.frombuffer(r, float) for r in rows.column("sums").to_pylist()], axis=0)
        return pa.table([rows.column("view")[:1], rows.column("at")[:1], pa.array([total.tobytes()], pa.binary())], ["view", "at", "sums"])

    parts = pool.select("numbers", "bits").mapInArrow(part, "view int, at int, task int, sums binary")
    sums = parts.groupBy("view", "at").applyInArrow(added, "view int, at int, sums binary").collect()
    out = {v: np.zeros((len(models[v]["b"]) + 2, len(models[v]["b"]))) for v in names}
    for r in sums:
        out[names[r["view"]]][r["at"]] = np.frombuffer(r["sums"], float)
    return out


def learn(docs: DataFrame, labels: DataFrame) -> tuple[dict | None, DataFrame]:
    """The fitted model, and the table of features. A quarter of the labelled documents, by a checksum of doc_id, is for calibration only."""
    order = F.xxhash64("doc_id")
    good = F.min(F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)).alias("good")
    known = written(labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(good).where("good is not null").select("doc_id", F.col("good").cast("int").alias("good")), "known")
    some = written(known.orderBy(order, "doc_id").limit(LABELLED), "labelled")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 1
    told = telling_ngrams(docs, some.where(~held_out))
    roles = known.join(F.broadcast(some.select("doc_id", F.lit(True).alias("picked"))), "doc_id", "left").select("doc_id", F.when(F.col("picked"), F.col("good")).otherwise(2).alias("good"))
    features = written(feature_rows(docs, told).join(small(roles), "doc_id", "left").fillna(-1, "good"), "features")
    fit = features.where("good in (0, 1)").groupBy("doc_id").agg(F.min("good").alias("good"), F.min(F.struct("numbers", "bits")).alias("views"))
    rows = sorted(fit.toLocalIterator(), key=lambda r: r["doc_id"])  # at most LABELLED
    discard(some)
    discard(known)
    if not rows:
        return None, features
    y = np.array([r["good"] for r in rows])
    held = np.array([zlib.crc32(str(r["doc_id"]).encode()) % 4 == 1 for r in rows])
    text, meta = _unpacked([r["views"]["numbers"] for r in rows], [r["views"]["bits"] for r in rows], len(told))
    del rows
    pool = features.where("good = -1")
    model = co_trained(text, meta, y, held, pooled=lambda given, models: summed_slopes(pool, len(told), given, models))
    return model and model | {"told": told}, features


def rated(docs: DataFrame, labels: DataFrame, **names: str) -> DataFrame:
    """doc_id, text_prob, meta_prob, score (chance of a good document), keep, of every row."""
    cols = {"id_col": "doc_id", "text_col": "text", "source_col": "source", "lang_col": "lang", "chars_col": "n_chars"} | names
    docs = _columns(docs, **cols)
    model, features = learn(docs, labels)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches):
        m = held.value
        for batch in batches:
            if m is None:
                p = [np.full(len(batch), 0.5)] * 3
                keep = np.ones(len(batch), bool)
            else:
                p = scored(m, *_views(batch, len(m["told"])))
                keep = p[2] >= m["cut"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, p), pa.array(keep)], ["doc_id", "text_prob", "meta_prob", "score", "keep"])

    return features.select("doc_id", "numbers", "bits").mapInArrow(rate, "doc_id long, text_prob double, meta_prob double, score double, keep boolean")


def op9_quality(spark, sf_dir) -> DataFrame:
    return rated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
