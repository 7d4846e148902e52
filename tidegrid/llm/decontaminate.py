"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A mask selects some of SPAN consecutive words and ignores the others, so a hash of the selected words survives
substitutions at the ignored places. Benchmark items and documents are hashed under the same masks and joined on the
hash; around each hit the item is laid along the document, and the best stretch (a point for each equal word, minus
one for each other) decides. Items shorter than a mask are joined on the hash of all their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, SPACE_CLASS, checkpointed, column, fresh_names

#: Selected places of a window of eight words: five each, so that some mask passes over most sets of two or three substitutions.
MASKS = ("11101001", "11010011", "10011101")
SPAN = 8
#: Benchmark seeds that are sent to all executors at most (40 bytes each); beyond it the join is by shuffle.
FEW_SEEDS = 500_000
FEW_IDS = 200_000


def words_of(text: Column) -> Column:
    """Lower-case words between ASCII white space; one empty word for blank texts."""
    return F.split(F.btrim(F.lower(text), F.lit(SPACES)), SPACE_CLASS)


def seed_hashes(words: Column, masks: tuple[str, ...]) -> Column:
    """For each window, a struct of its place and an array of one hash a mask."""
    last = F.size(words) - SPAN

    def seeds(i: Column) -> Column:
        return F.struct(i.alias("at"), F.array(*(F.xxhash64(F.lit(m), *(words[i + k] for k, c in enumerate(mask) if c == "1")) for m, mask in enumerate(masks))).alias("hashes"))

    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), seeds)).otherwise(F.array().cast("array<struct<at:int,hashes:array<bigint>>>"))


def hashed_words(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def seeds(df: DataFrame, id_col: str, text_col: str, masks: tuple[str, ...], out: str) -> DataFrame:
    """Rows (out, at, seed) of all windows of df."""
    hashed = df.select(column(id_col).alias(out), hashed_words(column(text_col)).alias("w"))
    windows = hashed.select(out, F.explode(seed_hashes(F.col("w"), masks)).alias("s"))
    return windows.select(out, F.col("s.at").alias("at"), F.explode("s.hashes").alias("seed"))


def runs(df: DataFrame, id_col: str, text_col: str, lengths: list[int], out: str, whole: bool = False) -> DataFrame:
    """Rows (out, at, seed) of all runs of so many words; whole: of those only that are a text by themselves."""
    hashed = df.select(column(id_col).alias(out), hashed_words(column(text_col)).alias("w"))
    size = F.size("w")

    def of_length(n: int) -> Column:
        run = lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(-n), *(F.col("w")[i + k] for k in range(n))).alias("seed"))
        return F.when(size == n if whole else size >= n, F.transform(F.sequence(F.lit(0), size - n), run)).otherwise(F.array().cast("array<struct<at:int,seed:bigint>>"))

    return hashed.select(out, F.explode(F.flatten(F.array(*(of_length(n) for n in lengths)))).alias("s")).select(out, "s.at", "s.seed")


def _best_stretch(equal: Column) -> Column:
    """score, matched, first and last of the stretch of an array of booleans with the most equal minus other entries."""
    zero = F.struct(*(F.lit(x).alias(n) for x, n in ((0, "at"), (0, "run"), (0, "run_from"), (0, "run_hits"), (0, "score"), (0, "matched"), (0, "first"), (-1, "last"))))

    def step(s: Column, hit: Column) -> Column:
        fresh = s["run"] <= 0
        run = F.when(fresh, 0).otherwise(s["run"]) + F.when(hit, 1).otherwise(-1)
        start = F.when(fresh, s["at"]).otherwise(s["run_from"])
        hits = F.when(fresh, 0).otherwise(s["run_hits"]) + F.when(hit, 1).otherwise(0)
        best = run > s["score"]
        return F.struct(
            (s["at"] + 1).alias("at"), run.alias("run"), start.alias("run_from"), hits.alias("run_hits"), F.when(best, run).otherwise(s["score"]).alias("score"),
            F.when(best, hits).otherwise(s["matched"]).alias("matched"), F.when(best, start).otherwise(s["first"]).alias("first"), F.when(best, s["at"]).otherwise(s["last"]).alias("last"),
        )

    return F.aggregate(equal, zero, step, lambda s: F.struct(s["score"].alias("score"), s["matched"].alias("matched"), s["first"].alias("first"), s["last"].alias("last")))


def contaminated(df: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", masks: tuple[str, ...] = MASKS, min_score: int = 12, min_share: float = 0.6) -> DataFrame:
    """One row for each document and benchmark item that it holds: doc_id, item_id, score, matched, item_words, doc_from, doc_to.

    A document holds an item if along one alignment the best stretch scores at least min_score, or min_share of the
    item's words if that is less. doc_from and doc_to are the stretch's first and last word in the document, of the
    alignment with the best score (the earliest, on a tie). Words are compared in lower case.

    Items shorter than a seed (SPAN words) are found where a document holds all their words in a row; so an item of one
    common word is found in many documents. Null and empty texts on either side are in no result, nor are rows of null
    id. Rows of one id are compared each, and the best is kept. Whole texts are searched.
    """
    items = checkpointed(benchmark.filter(column(item_col).isNotNull()).select(column(item_col).alias("item_id"), column(item_text_col).alias("text")))
    worded = items.filter(F.length(F.btrim("text", F.lit(SPACES))) > 0)
    short = [r["n"] for r in worded.select(F.size(words_of(F.col("text"))).alias("n")).filter(F.col("n") < SPAN).distinct().orderBy("n").collect()]
    bench_seeds = seeds(items, "item_id", "text", masks, "item_id")
    if short:
        bench_seeds = bench_seeds.union(runs(worded, "item_id", "text", short, "item_id", whole=True))
    bench_seeds = checkpointed(bench_seeds.withColumnRenamed("at", "item_at"))
    n_seeds = bench_seeds.count()
    few = n_seeds <= FEW_SEEDS
    docs = df.filter(column(id_col).isNotNull() & column(text_col).isNotNull()).select(column(id_col).alias("doc_id"), column(text_col).alias("text"))
    doc_seeds = seeds(docs, "doc_id", "text", masks, "doc_id")
    if short:
        doc_seeds = doc_seeds.union(runs(docs, "doc_id", "text", short, "doc_id"))
    doc_seeds = doc_seeds.withColumnRenamed("at", "doc_at")
    hits = doc_seeds.join(F.broadcast(bench_seeds) if few else bench_seeds, "seed").select("doc_id", "item_id", (F.col("doc_at") - F.col("item_at")).alias("shift")).distinct()
    hits = checkpointed(hits)

    of = hits.select("doc_id").distinct()
    texts = docs.join(F.broadcast(of) if hits.count() <= FEW_IDS else of, "doc_id", "left_semi")
    item_words = items.select("item_id", hashed_words(F.col("text")).alias("iw"))
    laid = hits.join(F.broadcast(item_words) if few else item_words, "item_id").join(texts.select("doc_id", hashed_words(F.col("text")).alias("dw")), "doc_id")
    first = F.greatest(F.lit(0), -F.col("shift"))
    last = F.least(F.size("iw") - 1, F.size("dw") - 1 - F.col("shift"))
    equal = F.transform(F.sequence(first, last), lambda i: F.col("iw")[i] == F.col("dw")[i + F.col("shift")])
    # a seed's hash may have met by chance, and rows of one id may differ in length: then nothing lies along
    scored = laid.filter(last >= first).select("doc_id", "item_id", "shift", F.size("iw").alias("item_words"), first.alias("from"), _best_stretch(equal).alias("s"))
    good = scored.filter(F.col("s.score") >= F.least(F.lit(min_score), F.ceil(F.col("item_words") * min_share)))
    best = F.struct(F.col("s.score").alias("score"), (-(F.col("shift") + F.col("from") + F.col("s.first"))).alias("o"), F.col("s.matched").alias("matched"), (F.col("shift") + F.col("from") + F.col("s.last")).alias("to"))
    found = good.groupBy("doc_id", "item_id").agg(F.max("item_words").alias("item_words"), F.max(best).alias("b"))
    return found.select("doc_id", "item_id", F.col("b.score").alias("score"), F.col("b.matched").alias("matched"), "item_words", (-F.col("b.o")).alias("doc_from"), F.col("b.to").alias("doc_to"))


def without_contaminated(df: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """df without the documents that hold a benchmark item."""
    (other,) = fresh_names(df, "gone")
    gone = contaminated(df, benchmark, id_col=id_col, **options).select(F.col("doc_id").alias(other)).distinct()
    return df.join(gone, column(id_col) == F.col(other), "left_anti")
