"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score(x) = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pairwise part is computed in time linear
in the number of non-zero features: 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2].

Features of a text: its words, hashed to WORD_BUCKETS columns and scaled to unit length; STATISTICS, each cut into
BINS one-hot columns, so that products of two columns are conjunctions of ranges; and metadata columns of the row,
cut the same way. The model is fitted on the driver on a bounded sample; everything else runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import by_bytes, column, learnable, sql_type, trimmed, word_hashes

WORD_BUCKETS = 1 << 12
BINS = 24
STATISTICS = ("length", "word_length", "upper", "digits", "symbols", "exclamations", "distinct", "repeats", "top_word", "lines", "line_repeats", "non_ascii", "sentence", "symbol_ends", "bars")
SYMBOLS = "#$%&*+/<=>@[\\]^_`{|}~"


def width(metadata: int) -> int:
    return WORD_BUCKETS + BINS * (len(STATISTICS) + metadata)


def _class_table() -> np.ndarray:
    """Bits for each code point below 2^16: 1 upper, 2 lower or other letter, 4 digit, 8 symbol, 16 '!' or '?', 32 not ASCII, 64 white space, 128 sentence end."""
    out = np.zeros(1 << 16, np.uint8)
    for c in range(1 << 16):
        ch = chr(c)
        if ch.isalpha():
            out[c] = 1 if ch.isupper() else 2
        elif ch.isdigit():
            out[c] = 4
        elif ch.isspace():
            out[c] = 64
        if c > 127:
            out[c] |= 32
    for ch in SYMBOLS:
        out[ord(ch)] |= 8
    for ch in "!?":
        out[ord(ch)] |= 16 | 128
    out[ord(".")] |= 128
    return out


_classes: list[np.ndarray] = []


def _share(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bin of a share: finer near zero."""
    return np.minimum(BINS - 1, np.sqrt(x / np.maximum(n, 1)) * BINS).astype(np.int64)


def _log(x: np.ndarray) -> np.ndarray:
    return np.minimum(BINS - 1, np.log2(np.maximum(x, 0) + 1)).astype(np.int64)


def _at(cumulated: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return cumulated[bounds[1:]] - cumulated[bounds[:-1]]


def featurize(texts: list[str | None], metadata: list[list]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in compressed form: bounds [n + 1], columns and values. A null text counts as empty."""
    if not _classes:
        _classes.append(_class_table())
    n = len(texts)
    texts = [t or "" for t in texts]
    words, at = word_hashes(texts)
    doc = np.repeat(np.arange(n), np.diff(at))
    n_words = np.diff(at)

    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _classes[0][np.minimum(points, 0xFFFF)]
    chars = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    n_chars = np.diff(chars)
    counts = {bit: _at(np.concatenate(([0], np.cumsum((kind & bit) > 0))), chars) for bit in (1, 2, 4, 8, 16, 32, 64, 128)}
    letters = counts[1] + counts[2]
    visible = n_chars - counts[64]
    bars = _at(np.concatenate(([0], np.cumsum(points == ord("|")))), chars)
    next_space = np.append((kind[1:] & 64) > 0, True)
    symbol_ends = _at(np.concatenate(([0], np.cumsum(((kind & 24) > 0) & next_space))), chars)

    # distinct words of each text and how often they occur
    order = np.lexsort((words, doc))
    w, d = words[order], doc[order]
    first = np.ones(len(w), bool)
    first[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1])
    starts = np.flatnonzero(first)
    times = np.diff(np.append(starts, len(w)))
    of = d[starts]
    distinct = np.bincount(of, minlength=n)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, of, times)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    repeats = np.bincount(doc[same], minlength=n)
    lines = [t.split("\n") for t in texts]
    n_lines = np.array([len(x) for x in lines])
    line_repeats = n_lines - np.array([len(set(x)) for x in lines])

    bins = [
        _log(n_chars), np.minimum(BINS - 1, visible // np.maximum(n_words, 1)), _share(counts[1], letters), _share(counts[4], visible), _share(counts[8], visible), _share(counts[16], visible), _share(distinct, n_words), _share(repeats, n_words),
        _share(top, n_words), _log(n_lines), _share(line_repeats, n_lines), _share(counts[32], visible), _log(n_words // np.maximum(counts[128], 1)), _share(symbol_ends, n_words), _share(bars, n_words),
    ]
    for values in metadata:
        known = np.array([isinstance(v, (int, float)) and np.isfinite(v) for v in values], bool)
        bins.append(np.where(known, np.minimum(BINS - 2, np.log2(np.abs([v if k else 0 for v, k in zip(values, known, strict=True)]) + 1)), BINS - 1).astype(np.int64))

    # words of one bucket add up
    bucket = (w[starts] >> np.uint64(64 - 12)).astype(np.int64)
    key, where = np.unique(of * WORD_BUCKETS + bucket, return_inverse=True)
    value = np.bincount(where, times, len(key)) if len(key) else np.zeros(0)
    key_doc = key // WORD_BUCKETS
    norm = np.sqrt(np.bincount(key_doc, value**2, n)) if len(key) else np.ones(n)
    value = value / np.maximum(norm[key_doc], 1e-9)

    k = len(bins)
    dense_columns = WORD_BUCKETS + np.arange(k) * BINS + np.stack(bins, axis=1) if n else np.zeros((0, k), np.int64)
    all_doc = np.concatenate((key_doc, np.repeat(np.arange(n), k)))
    columns = np.concatenate((key % WORD_BUCKETS, dense_columns.ravel()))
    values = np.concatenate((value, np.full(n * k, 0.5)))
    order = np.argsort(all_doc, kind="stable")
    bounds = np.concatenate(([0], np.cumsum(np.bincount(all_doc, minlength=n)))).astype(np.int64)
    return bounds, columns[order].astype(np.int32), values[order].astype(np.float32)


@dataclass
class FactorisationMachine:
    """Bias, linear weights [columns] and factors [columns, rank]."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margins(self, bounds: np.ndarray, columns: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Linear in the number of non-zero features, by the sum-of-squares identity. Every row has a feature."""
        if len(bounds) < 2:
            return np.zeros(0)
        x = values.astype(np.float64)
        vx = self.factors[columns] * x[:, None]
        linear = np.add.reduceat(self.weights[columns] * x, bounds[:-1])
        sums = np.add.reduceat(vx, bounds[:-1], axis=0)
        squares = np.add.reduceat(vx**2, bounds[:-1], axis=0)
        return self.bias + linear + 0.5 * (sums**2 - squares).sum(axis=1)

    def scores(self, bounds: np.ndarray, columns: np.ndarray, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(bounds, columns, values), -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, columns: int, *, rank: int = 8, epochs: int = 12, batch: int = 64, rate: float = 0.05, decay: float = 1e-5, seed: int = 7) -> FactorisationMachine:
    """Adagrad on the logistic loss. Without labels of both classes: a constant.

    rows: each row's columns and values. No labels at all: 1, as nothing is known against any text.
    """
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels, np.float64)
    if len(labels) == 0 or labels.min() == labels.max():
        return FactorisationMachine(6.0 if len(labels) == 0 or labels[0] == 1 else -6.0, np.zeros(columns), np.zeros((columns, rank)))
    bias, w, v = 0.0, np.zeros(columns), rng.normal(0, 0.02, (columns, rank))
    gw, gv, gb = np.full(columns, 1e-6), np.full((columns, rank), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), batch):
            part = order[k : k + batch]
            c = np.concatenate([rows[i][0] for i in part])
            x = np.concatenate([rows[i][1] for i in part]).astype(np.float64)
            sizes = np.array([len(rows[i][0]) for i in part])
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            of = np.repeat(np.arange(len(part)), sizes)
            vx = v[c] * x[:, None]
            sums = np.add.reduceat(vx, starts, axis=0)
            margin = bias + np.add.reduceat(w[c] * x, starts) + 0.5 * (sums**2 - np.add.reduceat(vx**2, starts, axis=0)).sum(axis=1)
            g = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - labels[part]) / len(part)
            gx = g[of] * x
            touched, where = np.unique(c, return_inverse=True)
            dw = np.bincount(where, gx, len(touched)) + decay * w[touched]
            dv = np.zeros((len(touched), v.shape[1]))
            np.add.at(dv, where, gx[:, None] * (sums[of] - vx))
            dv += decay * v[touched]
            gw[touched] += dw**2
            gv[touched] += dv**2
            gb += g.sum() ** 2
            w[touched] -= rate * dw / np.sqrt(gw[touched])
            v[touched] -= rate * dv / np.sqrt(gv[touched])
            bias -= rate * g.sum() / gb**0.5
    return FactorisationMachine(bias, w, v)


def _rows(df: DataFrame, id_col: str, text_col: str, metadata: tuple[str, ...]) -> DataFrame:
    return df.select(column(id_col).alias("doc_id"), column(text_col).alias("text"), *(column(c).cast("double").alias(f"m{i}") for i, c in enumerate(metadata)))


def training_features(df: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, metadata: tuple[str, ...], per_class: int) -> tuple[list, np.ndarray]:
    """Features of at most per_class labelled texts of each class, those whose ids have the smallest hashes. Whole texts."""
    known = labels.select(column(id_col).alias("doc_id"), column(label_col).alias("label")).filter(F.col("label").isin(0, 1) & learnable(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    known = known.withColumn("h", F.xxhash64("doc_id"))
    taken = None
    for y in (0, 1):
        part = known.filter(F.col("label") == y).orderBy("h", "doc_id").limit(per_class)
        taken = part if taken is None else taken.union(part)

    def features(batches):
        for batch in batches:
            label, text = batch.column(0), batch.column(1).to_pylist()
            meta = [batch.column(2 + i).to_pylist() for i in range(len(metadata))]
            for a, b in by_bytes(text):
                bounds, columns, values = featurize(text[a:b], [m[a:b] for m in meta])
                yield pa.RecordBatch.from_arrays([label[a:b], pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(columns, pa.int32())), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.float32()))], ["label", "columns", "values"])

    rows = _rows(df, id_col, text_col, metadata)
    meta_columns = [f"m{i}" for i in range(len(metadata))]
    chosen = rows.join(F.broadcast(taken.select("doc_id", "label")), "doc_id")  # 2 x per_class ids
    # one row of each id, so that repeats don't enter the sample
    chosen = chosen.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", *meta_columns)).alias("r")).select("label", "r.text", *(f"r.{c}" for c in meta_columns))
    found = chosen.mapInArrow(features, "label int, columns array<int>, values array<float>").toArrow()
    columns, values = found.column("columns").combine_chunks(), found.column("values").combine_chunks()
    bounds = columns.offsets.to_numpy()
    c, x = columns.values.to_numpy(), values.values.to_numpy()
    rows = [(c[a:b], x[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    y = found.column("label").to_numpy()
    order = sorted(range(len(rows)), key=lambda i: (y[i], len(rows[i][0]), rows[i][0].tobytes()))  # the same model whatever the partitions
    return [rows[i] for i in order], y[order]


def train(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", metadata: tuple[str, ...] = (), per_class: int = 3000, rank: int = 8, seed: int = 7) -> FactorisationMachine:
    rows, y = training_features(df, labels, id_col=id_col, text_col=text_col, label_col=label_col, metadata=metadata, per_class=per_class)
    return fit(rows, y, width(len(metadata)), rank=rank, seed=seed)


def score(df: DataFrame, model: FactorisationMachine, *, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = (), keep: str | None = None) -> DataFrame:
    """doc_id and score of each row of df; with keep, df's columns and the score under that name, which no column of df has.

    Null and empty texts get the score of a text without words. Repeated rows are scored each; a text is scored whole.
    """
    # the few hundred KB of the model go with the task
    names = list(df.columns)

    def scores(text: list, meta: list[list]) -> pa.Array:
        out = [model.scores(*featurize(text[a:b], [m[a:b] for m in meta])) for a, b in by_bytes(text)]
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    if keep is None:

        def bare(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), scores(batch.column(1).to_pylist(), [batch.column(2 + i).to_pylist() for i in range(len(metadata))])], ["doc_id", "score"])
            trimmed()

        rows = _rows(df, id_col, text_col, metadata)
        return rows.mapInArrow(bare, f"doc_id {sql_type(rows, 'doc_id')}, score double")

    def whole(batches):
        for batch in batches:
            meta = [[None if v is None else float(v) for v in batch.column(names.index(c)).to_pylist()] for c in metadata]
            yield pa.RecordBatch.from_arrays([*batch.columns, scores(batch.column(names.index(text_col)).to_pylist(), meta)], plain)
        trimmed()

    # columns have plain names on their way, as mapInArrow can't take any name
    plain = [f"c{i}" for i in range(len(names) + 1)]
    schema = StructType([*(StructField(c, f.dataType) for c, f in zip(plain, df.schema)), StructField(plain[-1], DoubleType())])
    return df.toDF(*plain[:-1]).mapInArrow(whole, schema).toDF(*names, keep)


def accepted(score_col: Column, threshold: float = 0.7) -> Column:
    return score_col >= threshold
