"""Best-fit packing of documents into fixed-length sequences, in bulk-synchronous supersteps.

Pieces lie in one order, longest first, and so do the gaps of the open sequences, smallest first. A superstep takes
all pieces of the next length at once: each gap's successor is the smallest gap that still holds the piece; where
several pieces want the same gap, ranks decide and the others move to the next; the gaps are updated; repeat. Pieces
that no gap holds open sequences.

Lengths are whole numbers up to the capacity, so both sorted sides are kept as runs: (length, count) and (gap, run of
sequences). A sweep over runs needs memory for runs only - at most capacity lengths however many pieces there are -
and its outcome is a table of runs: pieces ranked lo..hi of a length go to sequences s, s + 1, ... at one offset. Ranking
the pieces and looking up their places are distributed.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, column, sql_type

#: The byte-level pattern by which the tokenizer cuts text before merging.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Text of these characters only is cut alike by every regex library; any other is given to the tokenizer whole.
NOT_PLAIN = re.compile("[^\t\n\r -~¡-ɏ]")
PLAIN_BYTES = bytes([9, 10, 13, *range(32, 127), *range(161, 256)])


def rank_form(definition: str):
    """The tokenizer as tiktoken ranks, or None where that is not the same tokenizer.

    It is for byte-level merges without normalization whose ids are in the order of the merges: then the pair of lowest
    rank is the pair that is merged first, and both libraries give the same ids.
    """
    import tiktoken

    spec = json.loads(definition)
    model, cut = spec["model"], spec["pre_tokenizer"] or {}
    simple = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    if model["type"] != "BPE" or not simple or spec["normalizer"] or spec["post_processor"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        return None
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(merged) or len(set(merged)) != len(merged):
        return None
    # byte-level files write each byte as one printable character: itself, or the next free one from 256 on
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    byte_of, free = {}, 256
    for byte in range(256):
        if byte in printable:
            byte_of[chr(byte)] = byte
        else:
            byte_of[chr(free)] = byte
            free += 1
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in word): i for word, i in model["vocab"].items() if word not in special}
    if len(merged) + 256 != len(ranks) or max(ranks[bytes([b])] for b in range(256)) > min(merged):
        return None
    return tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Token ids as little-endian bytes, as the tokenizer gives them."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.ranked = rank_form(definition)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def plain(self, text: str) -> bool:
        try:
            if text.encode("latin-1").translate(None, PLAIN_BYTES):
                return False
        except UnicodeEncodeError:
            if NOT_PLAIN.search(text):
                return False
        return not any(s in text for s in self.special)

    def __call__(self, text: str) -> bytes:
        if self.ranked is not None and self.plain(text):
            return self.ranked.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def cut_points(tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: all have the capacity but the first, which takes the remainder."""
    first = tokens % capacity or min(tokens, capacity)
    return [(0, first), *((s, capacity) for s in range(first, tokens, capacity))]


_encoders: dict[int, Encoder] = {}


def token_pieces(df: DataFrame, tokenizer_file: str, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece of each row. Null text: empty, so one piece with the end id."""
    with open(tokenizer_file, encoding="utf-8") as f:
        definition = f.read()

    def tokenize(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        key = hash(definition)
        if key not in _encoders:
            _encoders[key] = Encoder(definition)
        encode, end = _encoders[key], end_id.to_bytes(4, "little")
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = encode(text or "") + end
                for k, (s, n) in enumerate(cut_points(len(ids) // 4, capacity)):
                    row.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[4 * s : 4 * (s + n)]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = df.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))
    return rows.mapInArrow(tokenize, f"doc_id {sql_type(rows, 'doc_id')}, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best fit decreasing over runs: (length, lo, hi, first sequence, offset) with ranks lo..hi-1, and the sequences used."""
    gaps: list[int] = []  # sizes of open gaps, ascending
    runs: dict[int, list[tuple[int, int]]] = {}  # gap: runs of sequences (first, count)
    out, used = [], 0

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in runs:
                insort(gaps, gap)
                runs[gap] = []
            runs[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, n = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], gaps[at]
            else:  # open sequences, as many as these pieces fill
                gap, first = capacity, used
                n = -(-left // (capacity // length))
                used += n
            fits = gap // length
            full = min(n, left // fits)  # sequences that take as many pieces as they hold
            for layer in range(fits if full else 0):
                out.append((length, rank, rank + full, first, capacity - gap + layer * length))
                rank += full
                left -= full
            leave(gap - fits * length, first, full)
            if full < n:
                rest = left if left < fits else 0
                for layer in range(rest):
                    out.append((length, rank, rank + 1, first + full, capacity - gap + layer * length))
                    rank += 1
                    left -= 1
                leave(gap - rest * length, first + full, 1 if rest else 0)
                untouched = full + (1 if rest else 0)
                leave(gap, first + untouched, n - untouched)
    return out, used


def pack(pieces: DataFrame, *, capacity: int = 2048, salts: int = 64) -> DataFrame:
    """The pieces with sequence_id and offset. pieces must give the same rows each time it is read.

    Ranks within a length: pieces are counted by (length, salt) - at most capacity x salts counts - so that a common
    length is ranked by many tasks. Repeated rows are separate pieces; among equal rows the order is any.
    """
    spark = pieces.sparkSession
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    tally = {(r["length"], r["salt"]): r["n"] for r in salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts: dict[int, int] = {}
    before = []
    for (length, salt), n in sorted(tally.items()):
        before.append((length, salt, counts.get(length, 0)))
        counts[length] = counts.get(length, 0) + n
    runs, _ = plan(counts, capacity)
    ranks = spark.createDataFrame(before, "length long, salt int, before long")
    places = spark.createDataFrame(runs, "length long, lo long, hi long, first long, offset long").groupBy("length").agg(F.array_sort(F.collect_list(F.struct("lo", "first", "offset"))).alias("runs"))
    w = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("k", F.row_number().over(w) - 1).join(F.broadcast(ranks), ["length", "salt"]).withColumn("rank", F.col("before") + F.col("k"))
    placed = ranked.join(F.broadcast(places), "length").withColumn("run", F.element_at("runs", F.size(F.filter("runs", lambda r: r["lo"] <= F.col("rank")))))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("run.first") + F.col("rank") - F.col("run.lo")).alias("sequence_id"), F.col("run.offset").alias("offset"))


def pack_documents(df: DataFrame, tokenizer_file: str, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenized once, written to the checkpoint folder, then packed. An empty table gives an empty result."""
    return pack(checkpointed(token_pieces(df, tokenizer_file, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col)), capacity=capacity)
