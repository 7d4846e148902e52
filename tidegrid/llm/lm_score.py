"""Stupid-backoff scores of documents under n-gram counts of the whole corpus.

S(w | context) is count(context w) / count(context) for the longest context in which w was seen, times ALPHA for each
word by which the context was cut; at last ALPHA times the share of w among all words. A document's own n-grams don't
count for itself, else everything had been seen.

Count tables are partitioned by hash and joined to the exploded n-grams, in blocks. Documents lie in batches. A batch's
distinct n-grams, as sorted hashes, are cut into ranges of the hash: the range is the key of the exchange. Where a range
comes together, its n-grams of all batches are counted and joined, and every batch gets back the corpus counts of exactly
the n-grams that it sent. It then has the counts of all its n-grams and sums by document. A common n-gram is sent once
a batch, however often it occurs; hashes are sent as differences, about five bytes each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks_for, column, gram_hashes, sql_type, word_hashes

ALPHA = 0.4


def packed(values: np.ndarray) -> bytes:
    """Unsigned integers, compressed byte plane by byte plane."""
    v = values.astype("<u8", copy=False)
    planes = np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8).T)
    used = 8
    while used > 1 and not planes[used - 1].any():
        used -= 1
    return bytes([used]) + len(v).to_bytes(8, "little") + pa.compress(planes[:used].tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    used, n = data[0], int.from_bytes(data[1:9], "little")
    planes = np.zeros((8, n), np.uint8)
    if n:
        planes[:used] = np.frombuffer(pa.decompress(data[9:], used * n, codec="zstd"), np.uint8).reshape(used, n)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(n)


class Grams:
    """The n-grams of a batch of texts."""

    def __init__(self, texts: list[str | None], bits: int):
        self.words, self.at = word_hashes(texts)
        self.n_words = np.diff(self.at)
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), self.n_words)
        self.shift = np.uint64(64 - bits)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams that lie within one text, and the places where they start."""
        grams = gram_hashes(self.words, n) >> self.shift
        places = np.flatnonzero(self.doc[: len(grams)] == self.doc[n - 1 :]) if len(grams) else np.zeros(0, np.int64)
        return grams[places], places

    def elsewhere(self, n: int, total: np.ndarray) -> np.ndarray:
        """For each word's place, the count of the n-gram that starts there in all other documents; 0 where none starts.

        total: the corpus counts of the distinct n-grams of the batch, in order of their hashes.
        """
        out = np.zeros(len(self.doc), np.int64)
        grams, places = self.of(n)
        distinct, which = np.unique(grams, return_inverse=True)
        if len(distinct) != len(total):
            raise RuntimeError("a batch was not the same when it was read again")
        if len(places):
            key = self.doc[places].astype(np.int64) * len(distinct) + which
            _, back, own = np.unique(key, return_inverse=True, return_counts=True)
            out[places] = total[which] - own[back]
        return out


def document_scores(grams: Grams, totals: list[np.ndarray], all_words: int) -> np.ndarray:
    """Sum of the log scores of each text's words."""
    order = len(totals)
    seen = [grams.elsewhere(k + 1, totals[k]) for k in range(order)]
    place = np.arange(len(grams.doc)) - grams.at[:-1][grams.doc]
    others = np.maximum(1, all_words - grams.n_words[grams.doc])
    # unigrams, and below them one more step back
    value = np.where(seen[0] > 0, np.log(np.maximum(seen[0], 1) / others), math.log(ALPHA) - np.log(others))
    for n in range(2, order + 1):
        whole, context = np.zeros(len(place), np.int64), np.ones(len(place), np.int64)
        whole[n - 1 :] = seen[n - 1][: len(place) - n + 1]
        context[n - 1 :] = seen[n - 2][: len(place) - n + 1]
        far = place >= n - 1
        value = np.where(far, np.where(whole > 0, np.log(np.maximum(whole, 1) / np.maximum(context, 1)), value + math.log(ALPHA)), value)
    if not len(value):
        return np.zeros(len(grams.n_words))
    sums = np.add.reduceat(np.append(value, 0.0), grams.at[:-1])
    return np.where(grams.n_words > 0, sums, 0.0)


def backoff_scores(df: DataFrame, *, order: int = 3, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 8 << 20, least_batches: int = 12, seed: int = 11) -> DataFrame:
    """doc_id, n_words, log_score (natural, summed) and mean_log_score of each row of df.

    Words are runs without ASCII white space, A-Z as a-z. Counts are over all rows; a row's own n-grams are left out for
    itself, while repeated rows count for each other. A place with fewer words before it has a shorter longest context,
    at no cost. Null, empty and blank texts: no words, 0, and a null mean. Null ids keep their rows. An empty table
    gives an empty result. N-grams are told apart by hashes of twice the bits of the corpus size, plus two (40 at least).
    """
    rows = df.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    batches = blocks_for(size, batch_bytes, least_batches)
    ranges = 1 << max(4, math.ceil(math.log2(2 * batches)))
    bits = min(64, max(40, 2 * math.ceil(math.log2(size + 2) - 2) + 2))
    shift = np.uint64(bits - int(math.log2(ranges)))
    rows = rows.withColumn("batch", F.pmod(F.xxhash64(F.lit(seed), "doc_id", F.crc32(F.col("text").cast("binary"))), F.lit(batches)).cast("int"))

    def ask(table: pa.Table) -> pa.Table:
        grams = Grams(table.column("text").to_pylist(), bits)
        asked: list[list[bytes]] = [[] for _ in range(ranges)]
        times: list[list[bytes]] = [[] for _ in range(ranges)]
        for n in range(1, order + 1):
            distinct, counts = np.unique(grams.of(n)[0], return_counts=True)
            cuts = np.searchsorted(distinct >> shift, np.arange(ranges + 1))
            for r in range(ranges):
                asked[r].append(packed(np.diff(distinct[cuts[r] : cuts[r + 1]], prepend=np.uint64(0))))
                times[r].append(packed(counts[cuts[r] : cuts[r + 1]]))
        batch = table.column("batch")[0].as_py()
        return pa.table({"range": pa.array(range(ranges), pa.int32()), "batch": pa.array([batch] * ranges, pa.int32()), "grams": pa.array(asked, pa.list_(pa.binary())), "times": pa.array(times, pa.list_(pa.binary()))})

    def count(table: pa.Table) -> pa.Table:
        asked, times = table.column("grams").to_pylist(), table.column("times").to_pylist()
        answers: list[list[bytes]] = [[] for _ in asked]
        all_words = 0
        for k in range(order):
            own = [np.cumsum(unpacked(a[k]), dtype=np.uint64) for a in asked]
            bounds = np.concatenate(([0], np.cumsum([len(o) for o in own])))
            _, which = np.unique(np.concatenate(own), return_inverse=True)
            n = np.concatenate([unpacked(t[k]) for t in times]).astype(np.int64)
            total = np.bincount(which, n).astype(np.int64)  # exact below 2^53
            if k == 0:
                all_words = int(n.sum())
            for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                answers[i].append(packed(total[which[a:b]]))
        return pa.table({"batch": table.column("batch"), "range": table.column("range"), "words": pa.array([all_words] * len(asked), pa.int64()), "totals": pa.array(answers, pa.list_(pa.binary()))})

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        texts = table.column("text").to_pylist()
        if not texts:
            return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array([], pa.int64()), "log_score": pa.array([], pa.float64()), "mean_log_score": pa.array([], pa.float64())})
        grams = Grams(texts, bits)
        answers = answers.sort_by("range")
        blobs = answers.column("totals").to_pylist()
        totals = [np.concatenate([unpacked(b[k]) for b in blobs]).astype(np.int64) for k in range(order)]
        sums = document_scores(grams, totals, sum(answers.column("words").to_pylist()))
        n = grams.n_words
        mean = pa.array(sums / np.maximum(n, 1), mask=n == 0)
        return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(n, pa.int64()), "log_score": pa.array(sums, pa.float64()), "mean_log_score": mean})

    asked = rows.groupBy("batch").applyInArrow(ask, "range int, batch int, grams array<binary>, times array<binary>")
    answers = asked.groupBy("range").applyInArrow(count, "batch int, range int, words long, totals array<binary>")
    return rows.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(score, f"doc_id {sql_type(rows, 'doc_id')}, n_words long, log_score double, mean_log_score double")
