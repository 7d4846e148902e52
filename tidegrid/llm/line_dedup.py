"""Near-duplicate lines by an exact set-similarity join, in DataFrame operations only.

A line's tokens are its runs of `words` words (a shorter line is one token). Equal lines are grouped first. Two
different lines are similar if the Jaccard similarity of their token sets is at least num / den. In any one order of
all tokens, two similar sets of sizes x and y share a token among the first x - ceil(t x) + 1 and y - ceil(t y) + 1;
with prefixes that are longer by s - 1 tokens, they share s.

1. In the order of the tokens' hashes, which needs no counts, prefixes longer by a twentieth are held against each other.
   A line that shares fewer tokens there than any partner would is done; only prefixes have moved so far.
2. For the other lines, tokens are counted and put in order of rarity; lines meet at the rare tokens of their prefixes,
   by the length filter (sizes within t) and the positional filter (what can still be shared behind the tokens met).
3. Pairs are verified on the whole sets, and a line goes if an earlier one is similar or equal.

Where many lines meet at one token, each is held against the earliest of them first, then against the earliest of each
of a few hash classes, and at last against those that are earlier than what it has found. A line of a large group of
near copies so meets few of them, and what it finds is the earliest similar line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE_CLASS, SPACES, WORD, checkpointed, column, dropped, fresh_names, written

#: Documents with some lines' places that are sent to all executors at most (about 100 bytes each); beyond it the join
#: is by shuffle.
FEW_LINES = 500_000
#: One more shared token is asked for, and one more looked at, for so many of a line.
LONGER = 20
#: Hash classes of the lines at one token, of which the earliest ones are met in the second round.
CLASSES = 16


def line_tokens(h: Column, words: int) -> Column:
    """Distinct hashes of the runs of `words` words, ascending; of all words, if there are fewer. h: hashes of a line's words."""
    short = F.array(F.xxhash64(F.lit(-1), h))
    # words by place: slice() would copy the whole array for each run
    runs = F.transform(h, lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, words))))
    return F.when(F.size(h) < words, short).otherwise(F.sort_array(F.array_distinct(F.slice(runs, F.lit(1), F.size(h) - (words - 1)))))


def prefix_length(n: Column, num: int, den: int) -> Column:
    return (n - F.ceil(n * num / den) + 1).cast("int")


def _asked(n: Column) -> Column:
    """Tokens by which a set of n is asked to meet another of its size."""
    return (F.lit(1) + F.floor(n / LONGER)).cast("int")


def _lines(docs: DataFrame) -> DataFrame:
    """docs with line_no, line and odd in place of text: the lines with a word, and whether a text has white space other than spaces."""
    rest = [c for c in docs.columns if c != "text"]
    marked = docs.select(*rest, "text", F.col("text").rlike(r"[\t\r\x0B\f]").alias("odd"))
    return marked.select(*rest, "odd", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter(F.col("line").rlike(WORD))


def _tokenized(lines: DataFrame, words: int) -> DataFrame:
    """lines with two hashes of their words, k1 and k2, and their tokens t in place of line and odd."""
    rest = [c for c in lines.columns if c not in ("line", "odd")]
    low = lines.select(*rest, "odd", F.lower("line").alias("low"))
    # most lines have single spaces between words; a split at one character needs no pattern matching
    loose = F.col("odd") | F.col("low").contains("  ") | F.col("low").startswith(" ") | F.col("low").endswith(" ")
    low = low.select(*rest, "low", loose.alias("odd"))
    # the words are used once, so that they are hashed as they are cut
    trimmed = F.btrim("low", F.lit(SPACES))
    w = F.when(F.col("odd"), F.split(trimmed, SPACE_CLASS)).otherwise(F.split("low", " "))
    same = F.when(F.col("odd"), F.regexp_replace(trimmed, SPACE_CLASS, " ")).otherwise(F.col("low"))
    hashed = low.select(*rest, same.alias("same"), F.transform(w, lambda x: F.xxhash64(x)).alias("h"))
    return hashed.select(*rest, F.xxhash64("same").alias("k1"), F.xxhash64(F.lit(7), "same").alias("k2"), line_tokens(F.col("h"), words).alias("t"))


def _shared(entries: DataFrame) -> DataFrame:
    """entries whose token stands in more than one of them, with the number of those, lines."""
    return entries.withColumn("lines", F.count(F.lit(1)).over(Window.partitionBy("token"))).filter("lines > 1")


def _hash_join(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A shuffled join in which the smaller side's partitions are hashed, so that the larger is not sorted."""
    return big.join(small.hint("shuffle_hash"), on, how)


def removed_lines(df: DataFrame, *, words: int = 5, similarity: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each line that goes: doc_id, line_no (from 0), kept_doc, kept_line, shared, either.

    kept_doc and kept_line are the earliest line that is equal or, if none is, the earliest similar one, by id and then
    by line; of equal lines the first stands for all. shared / either is the similarity of the token sets (1 / 1 if the
    words are equal). Lines are compared in lower case, by their words; blank lines are no lines. Null and empty texts
    and rows of null id have no lines. Ids are of any type that has an order. Rows of one id are one document: where
    their lines of equal place are equal, they are one line. Whole texts are read; other columns of df are not.
    """
    num, den = similarity
    docs = df.filter(column(id_col).isNotNull() & column(text_col).isNotNull()).select(column(id_col).alias("doc_id"), column(text_col).alias("text"))
    prefix = F.slice("t", F.lit(1), prefix_length(F.col("n"), num, den) - 1 + _asked(F.col("n")))
    # a line's number holds as the rows are written
    seen = written(_tokenized(_lines(docs), words).withColumn("n", F.size("t")).select(F.monotonically_increasing_id().alias("lid"), "doc_id", "line_no", "k1", "k2", "n", prefix.alias("prefix")), compression="none")
    lines = seen.select("lid", "k1", "k2", "n", F.struct("doc_id", "line_no").alias("o"))

    first = checkpointed(lines.groupBy("k1", "k2").agg(F.min(F.struct("o", "lid", "n")).alias("f"), F.count(F.lit(1)).alias("copies")).select("k1", "k2", "f.*", "copies"))
    again = first.filter("copies > 1").select("k1", "k2", F.col("o").alias("kept"))
    gone_equal = _hash_join(lines.select("k1", "k2", "o"), again, ["k1", "k2"]).filter("o <> kept").select("o", "kept", F.lit(1).alias("shared"), F.lit(1).alias("either")).distinct()
    gone_equal = checkpointed(gone_equal)

    # 1: prefixes in the order of hashes. Of the tokens met there, those count that more lines have than equal ones
    met = _shared(seen.select(F.explode("prefix").alias("token"), "lid")).groupBy("lid", "lines").agg(F.count(F.lit(1)).alias("tokens"))
    met = met.join(first.select("lid", "k1", "n", "copies", "o"), "lid").filter("lines > copies").groupBy("lid").agg(F.sum("tokens").alias("tokens"), F.first("n").alias("n"), F.first("k1").alias("k1"), F.first("o").alias("o"))
    active = met.filter(F.col("tokens") >= _asked(F.ceil(F.col("n") * num / den))).select("o.doc_id", F.struct("o.line_no", "k1", "lid").alias("line"))
    by_doc = checkpointed(active.groupBy("doc_id").agg(F.collect_list("line").alias("active")))
    dropped(seen)

    # 2: the whole sets of those lines, in order of rarity; tokens of one line only come first, and no line meets another there
    texts = docs.join(F.broadcast(by_doc) if by_doc.count() <= FEW_LINES else by_doc, "doc_id")
    own = F.filter("active", lambda x: (x["line_no"] == F.col("line_no")) & (x["k1"] == F.col("k1")))
    near = _lines(texts).filter(F.exists("active", lambda x: x["line_no"] == F.col("line_no")))
    near = _tokenized(near, words).withColumn("own", own).filter(F.size("own") > 0)
    sets = written(near.select(F.col("own")[0]["lid"].alias("lid"), F.struct("doc_id", "line_no").alias("o"), F.size("t").alias("n"), "t"), compression="none")
    met = _shared(sets.select("lid", "n", F.explode("t").alias("token")))
    # a line that stands in two equal rows has each token twice, so ranks are dense
    of_line = Window.partitionBy("lid")
    met = met.withColumn("r", F.dense_rank().over(of_line.orderBy("lines", "token"))).withColumn("unique", F.col("n") - F.max("r").over(of_line))
    rare = met.filter(F.col("r") <= prefix_length(F.col("n"), num, den) - F.col("unique")).select("token", "lid", "n", "unique", (F.col("unique") + F.col("r") - 1).alias("at"))
    postings = checkpointed(rare.join(sets.select("lid", "o").distinct(), "lid").select("token", "lid", "o", "n", "unique", "at").distinct())

    # 3: the earliest line of each token, then the earliest of each class, then whatever is earlier than what was found
    line = F.struct("o", "lid", "n", "unique", "at").alias("line")
    each = postings.groupBy("token", F.pmod(F.xxhash64("lid"), F.lit(CLASSES)).alias("class")).agg(F.min(line).alias("line"), F.count(F.lit(1)).alias("lines"))
    hubs = checkpointed(each.groupBy("token").agg(F.min("line").alias("hub"), F.sum("lines").alias("lines"), F.collect_list("line").alias("firsts")).filter("lines > 1"))
    hub = hubs.select("token", F.col("hub.o").alias("least"), F.col("hub.lid").alias("hub_lid"))
    mine = checkpointed(postings.select("token", *(F.col(c).alias(f"b_{c}") for c in ("lid", "o", "n", "unique", "at"))).join(hub, "token").filter("least < b_o"))

    best = _verified(_met(mine, hubs.select("token", F.col("hub").alias("a")), F.col("b_o"), num, den), sets, num, den)
    for others in (hubs.filter(F.size("firsts") > 1).select("token", F.explode("firsts").alias("a")), postings.select("token", line.alias("a"))):
        left = mine.join(best.select(F.col("b").alias("b_lid"), F.col("a_o").alias("found")), "b_lid", "left").withColumn("limit", F.coalesce("found", "b_o")).filter("least < limit")
        met = _met(left, others, F.col("limit"), num, den, but=F.col("hub_lid"))
        best = _best(best.unionByName(_verified(met, sets, num, den)))
    dropped(sets)
    gone_near = best.select(F.col("b_o").alias("o"), F.col("a_o").alias("kept"), "shared", "either")
    gone = gone_equal.union(gone_near)
    return gone.select("o.doc_id", "o.line_no", F.col("kept.doc_id").alias("kept_doc"), F.col("kept.line_no").alias("kept_line"), "shared", "either")


def _met(mine: DataFrame, others: DataFrame, limit: Column, num: int, den: int, but: Column | None = None) -> DataFrame:
    """Pairs of lines (a, b), a earlier than b's limit, that meet at a token and that the length and positional filters leave."""
    a_n, b_n, a_at, b_at = F.col("a.n"), F.col("b_n"), F.col("a.at"), F.col("b_at")
    need = F.ceil((a_n + b_n) * num / (num + den))
    ahead = F.least(a_n - a_at, b_n - b_at)
    behind = F.least(a_at - F.col("a.unique"), b_at - F.col("b_unique"))  # what the tokens before may share at most
    fine = (F.col("a.o") < limit) & (a_n * den >= b_n * num) & (b_n * den >= a_n * num) & (ahead + behind >= need)
    if but is not None:
        fine = fine & (F.col("a.lid") != but)
    right = others.withColumnRenamed("token", "a_token")
    met = mine.join(right, (F.col("token") == F.col("a_token")) & fine)
    pairs = met.groupBy(F.col("a.lid").alias("a"), F.col("b_lid").alias("b")).agg(F.first("a.o").alias("a_o"), F.first("b_o").alias("b_o"), F.first(need).alias("need"), F.max(ahead).alias("ahead"))
    # where two lines meet first, nothing is shared before
    return pairs.filter("ahead >= need").select("a", "a_o", "b", "b_o")


def _best(pairs: DataFrame) -> DataFrame:
    """The earliest of each line's similar lines."""
    least = pairs.groupBy("b").agg(F.min(F.struct("a_o", "shared", "either")).alias("s"), F.min("b_o").alias("b_o"))
    return checkpointed(least.select("b", "b_o", "s.a_o", "s.shared", "s.either"))


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """For each line b of the pairs the earliest that is similar on the whole sets."""
    pairs = checkpointed(pairs)
    b = pairs.join(sets.select(F.col("lid").alias("b"), F.col("t").alias("b_t")), "b")
    both = b.join(sets.select(F.col("lid").alias("a"), F.col("t").alias("a_t")), "a")
    shared, total = F.size(F.array_intersect("a_t", "b_t")), F.size("a_t") + F.size("b_t")
    sized = both.select("b", "b_o", "a_o", shared.alias("shared"), total.alias("total"))
    good = sized.filter(F.col("shared") * den >= (F.col("total") - F.col("shared")) * num)
    return _best(good.select("b", "b_o", "a_o", "shared", (F.col("total") - F.col("shared")).alias("either")))


def without_repeated_lines(df: DataFrame, *, words: int = 5, similarity: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """df with the removed lines taken out of its texts, and without documents of which nothing but blank lines is left.

    count_col, if df has it, is set to the new text's length where lines were removed. Texts that lose no line, empty
    texts and rows of a null id among them, stay as they are. Rows of one id lose the same places.
    """
    gone = removed_lines(df, words=words, similarity=similarity, id_col=id_col, text_col=text_col)
    doc, places, left = fresh_names(df, "doc", "places", "left")
    by_doc = checkpointed(gone.groupBy(F.col("doc_id").alias(doc)).agg(F.collect_set("line_no").alias(places)))
    joined = df.join(F.broadcast(by_doc) if by_doc.count() <= FEW_LINES else by_doc, column(id_col) == F.col(doc), "left")
    kept = F.filter(F.split(column(text_col), "\n"), lambda line, i: ~F.array_contains(places, i))
    out = joined.withColumn(left, F.when(F.col(places).isNull(), column(text_col)).otherwise(F.array_join(kept, "\n")))
    out = out.filter(F.col(places).isNull() | F.col(left).rlike(WORD))
    columns = []
    for c in df.columns:
        if c == text_col:
            columns.append(F.col(left).alias(c))
        elif c == count_col:
            columns.append(F.when(F.col(places).isNull(), column(c)).otherwise(F.length(left)).cast(df.schema[c].dataType).alias(c))
        else:
            columns.append(column(c))
    return out.select(*columns)
