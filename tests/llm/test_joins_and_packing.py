"""Sharding, packing, decontamination, lines, neighbours and near duplicates, each against a plain version."""

from __future__ import annotations

import array
import collections
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegrid.llm import decontaminate, jaccard_join, line_dedup, neighbours, packing, sharding
from tidegrid.llm.components import connected_components
from tidegrid.llm.queries import vocabulary

from .conftest import words


# -- sharding ----------------------------------------------------------------------------------------------------------


@given(st.lists(st.integers(0, 50), min_size=1, max_size=8), st.integers(1, 6), st.integers(0, 10))
def test_matrix_has_its_margins(blocks, shards, seed):
    n = sum(blocks)
    sizes = [n // shards + (j < n % shards) for j in range(shards)]
    m = sharding.communication_matrix(blocks, sizes, seed)
    assert (m >= 0).all() and m.sum(axis=1).tolist() == blocks and m.sum(axis=0).tolist() == sizes


def test_matrix_has_the_right_mean():
    m = sum(sharding.communication_matrix([30, 10], [20, 20], s) for s in range(400)) / 400
    assert m == pytest.approx(np.array([[15, 15], [5, 5]]), abs=0.3)


@pytest.mark.parametrize("good,bad,draws", [(7, 5, 6), (40, 60, 30), (3, 200, 50), (500, 400, 700)])
def test_inversion_has_the_law(good, bad, draws):
    class Fixed:
        def __init__(self, u):
            self.u = u

        def random(self):
            return self.u

    total, upto = math.comb(good + bad, draws), 0
    for k in range(max(0, draws - bad), min(good, draws) + 1):
        p = math.comb(good, k) * math.comb(bad, draws - k)
        if p / total > 1e-9:
            assert sharding._by_inversion(Fixed((upto + p / 2) / total), good, bad, draws) == k
        upto += p
    n = 4 * 10**12
    drawn = [sharding._by_inversion(np.random.default_rng(i), n // 4, n - n // 4, 10**6) for i in range(200)]
    assert abs(np.mean(drawn) - 250_000) < 200 and 300 < np.std(drawn) < 580


def test_repeated_rows_go_to_all_shards(spark):
    df = spark.range(20_000).selectExpr("if(id < 4000, 0, id) AS doc_id", "if(id < 4000, 'same', string(id)) AS text")
    got = sharding.shuffle_into_shards(df, 24)
    same = {r.shard: r.n for r in got.filter("doc_id = 0").groupBy("shard").agg(F.count("*").alias("n")).collect()}
    assert len(same) == 24 and 100 < min(same.values()) and max(same.values()) < 240
    order = [r.doc_id for r in got.filter("shard = 0").orderBy("slot").collect()]
    beside = sum(a == b == 0 for a, b in zip(order, order[1:]))
    assert beside < 70  # about a fifth of the shard's fifth


def test_order_has_nothing_of_the_input_order(spark):
    """Chi-square of input bands against shards, against parts of a shard, and of each row's band against the next row's."""
    n, bands = 24_000, 24
    got = sharding.shuffle_into_shards(spark.range(n).selectExpr("id AS doc_id", "string(id) AS text"), 24).orderBy("shard", "slot").collect()
    band = np.array([r.doc_id for r in got]) * bands // n

    def chi_square(a, b, size):
        table = np.zeros((bands, size))
        np.add.at(table, (a, b), 1)
        expected = np.outer(table.sum(1), table.sum(0)) / len(a)
        return ((table - expected) ** 2 / expected).sum()

    place = np.array([r.slot for r in got]) * bands // (n // 24)
    for other in (np.array([r.shard for r in got]), place):
        assert 529 - 5 * 32.5 < chi_square(band, other, bands) < 529 + 5 * 32.5
    assert 529 - 5 * 32.5 < chi_square(band[:-1], band[1:], bands) < 529 + 5 * 32.5


def test_shards(spark, corpus, odd_rows):
    rows = odd_rows + [(i, "same text") for i in range(100, 400)]
    got = sharding.shuffle_into_shards(corpus(rows), 7).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    sizes = collections.Counter(r.shard for r in got)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(7):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    expected = collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == expected
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot)) if (r.doc_id or 0) >= 100]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.2
    assert sharding.shuffle_into_shards(corpus(rows).limit(0), 7).count() == 0
    assert sharding.shuffle_into_shards(corpus(rows[:3]), 7).count() == 3


# -- packing -----------------------------------------------------------------------------------------------------------


@settings(deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=12))
def test_plan_places_each_piece_once(counts):
    runs, used = packing.plan(counts, 60)
    fill = collections.defaultdict(list)
    ranks = collections.defaultdict(list)
    for length, lo, hi, first, offset in runs:
        ranks[length] += range(lo, hi)
        for k in range(hi - lo):
            fill[first + k].append((offset, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    assert len(fill) == used
    for pieces in fill.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 60
    assert used == best_fit([k for k, n in counts.items() for _ in range(n)], 60)


def best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_encoder_is_the_tokenizer():
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        encode = packing.Encoder(f.read())
    plain = Tokenizer.from_file(path)
    rng = random.Random(5)
    texts = ["", "it's we'll I'D", " a  b\n\n c\t\td   ", "Ünïcödé ²³ ½ ªº", "x" * 3000, "日本語 text", "a<|endoftext|>b", "a b\x85c"] + ["".join(rng.choice("ab 'sÀ1²!\n\t.") for _ in range(80)) for _ in range(200)]
    assert encode.ranked is not None
    for t in texts:
        assert encode(t) == array.array("I", plain.encode(t, add_special_tokens=False).ids).tobytes()


def test_packing_of_odd_texts(spark, corpus, odd_rows):
    path = vocabulary("byte_bpe_50k.json")
    got = packing.pack_documents(corpus(odd_rows), path).collect()
    with open(path, encoding="utf-8") as f:
        encode = packing.Encoder(f.read())
    expected = collections.Counter()
    for i, t in odd_rows:
        ids = encode(t or "") + bytes(4)
        for k, (s, n) in enumerate(packing.cut_points(len(ids) // 4, 2048)):
            expected[i, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    by_sequence = collections.defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for pieces in by_sequence.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) <= 2048
    assert len(by_sequence) <= -(-sum(r.length for r in got) // 2048) + 1
    assert packing.pack_documents(corpus(odd_rows).limit(0), path).count() == 0
    assert packing.cut_points(4096, 2048) == [(0, 2048), (2048, 2048)] and packing.cut_points(2049, 2048) == [(0, 1), (1, 2048)]


# -- decontamination ---------------------------------------------------------------------------------------------------


def test_masks_have_one_weight():
    assert {m.count("1") for m in decontaminate.MASKS} == {5} and {len(m) for m in decontaminate.MASKS} == {decontaminate.SPAN}


def test_benchmark_passages(spark, corpus, odd_rows):
    rng = random.Random(2)
    vocabulary_ = [f"w{i}" for i in range(300)]
    item = [rng.choice(vocabulary_) for _ in range(40)]
    other = [rng.choice(vocabulary_) for _ in range(30)]
    noise = lambda n: [rng.choice(vocabulary_) for _ in range(n)]
    changed = [w if i % 7 else "changed" for i, w in enumerate(item)]
    rows = odd_rows + [(100, " ".join(noise(200) + item + noise(50)).upper()), (101, "\n".join(noise(20) + changed)), (102, " ".join(noise(400))), (103, " ".join(item[:6] + noise(300))), (104, " ".join(other)), (105, " ".join(item[20:]))]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(other)), (3, "too short"), (4, None), (5, ""), (None, " ".join(item))], "item_id long, text string").withColumn("doc_id", F.lit(9))
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(corpus(rows), bench).collect()}
    assert set(got) == {(100, 1), (101, 1), (104, 2), (105, 1)}
    assert got[100, 1].doc_from == 200 and got[100, 1].doc_to == 239 and got[100, 1].score == 40
    assert got[101, 1].matched == sum(a == b for a, b in zip(item, changed, strict=True))
    assert decontaminate.contaminated(corpus(rows).limit(0), bench).count() == 0
    assert decontaminate.contaminated(corpus(rows), bench.limit(0)).count() == 0
    kept = decontaminate.without_contaminated(corpus(rows), bench)
    assert kept.columns == corpus(rows).columns and kept.count() == len(rows) - 4


def slow_contaminated(rows, items):
    """(doc, item): (score, matched, first, last) by trying every alignment on which a mask, or a whole short item, is equal."""
    span, out = decontaminate.SPAN, {}
    for doc, text in rows:
        d = words(text)
        for item, item_text in items:
            w = words(item_text)
            if not w or not d:
                continue
            masks = decontaminate.MASKS if len(w) >= span else ["1" * len(w)]
            # an alignment with fewer equal words than a mask selects has no seed
            alike = collections.Counter(j - i for j, x in enumerate(d) for i, y in enumerate(w) if x == y)
            for shift in sorted(k for k, n in alike.items() if n >= min(5, len(w))):
                equal = {i: w[i] == d[i + shift] for i in range(len(w)) if 0 <= i + shift < len(d)}
                if not any(all(equal.get(i + k, False) for k, c in enumerate(m) if c == "1") and i + len(m) - 1 in equal for m in masks for i in equal):
                    continue
                # every stretch of the alignment; of equal scores the one that ends first, then the one that begins last
                stretches = []
                for a in equal:
                    score = hits = 0
                    for b in range(a, max(equal) + 1):
                        score, hits = score + (1 if equal[b] else -1), hits + equal[b]
                        stretches.append((score, -b, a, hits))
                score, minus_b, a, hits = max(stretches)
                if score >= min(12, math.ceil(len(w) * 0.6 - 1e-9)):
                    found = (score, hits, a + shift, -minus_b + shift)
                    if (doc, item) not in out or (score, -found[2]) > (out[doc, item][0], -out[doc, item][2]):
                        out[doc, item] = found
    return out


def test_benchmark_passages_against_all_alignments(spark, corpus):
    rng = random.Random(12)
    some = [f"w{i}" for i in range(40)]
    noise = lambda n: [rng.choice(some) for _ in range(n)]
    items = [(k, " ".join(noise(rng.choice((3, 7, 8, 12, 20, 35))))) for k in range(14)]
    rows = []
    for doc in range(60):
        item = items[rng.randrange(len(items))][1].split()
        a = rng.randrange(len(item))
        part = [w if rng.random() > 0.12 else rng.choice(some) for w in (item if doc % 3 else item[a:])]
        rows.append((doc, " ".join(noise(rng.randrange(30)) + part + noise(rng.randrange(30)) + (item if doc % 7 == 0 else []))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.score, r.matched, r.doc_from, r.doc_to) for r in decontaminate.contaminated(corpus(rows), bench).collect()}
    slow = slow_contaminated(rows, items)
    assert got.keys() == slow.keys() and len(got) > 40
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in slow.items()}
    assert sum(got[k] == slow[k] for k in got) >= 0.9 * len(got)  # stretches of one score may end elsewhere


def test_items_shorter_than_a_seed_are_found(spark, corpus, odd_rows):
    rows = odd_rows + [(100, "so we ask: What is\tthe capital of Peru ? and go on"), (101, "what is the capital of Spain ?"), (102, "Capital"), (103, "the capital of Peru")]
    bench = spark.createDataFrame([(1, "what is the Capital of peru ?"), (2, "capital"), (3, "of Peru"), (4, " \n"), (5, ""), (6, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.score, r.matched, r.item_words, r.doc_from, r.doc_to) for r in decontaminate.contaminated(corpus(rows), bench).collect()}
    assert got == {(100, 1): (7, 7, 7, 3, 9), (100, 2): (1, 1, 1, 6, 6), (100, 3): (2, 2, 2, 7, 8), (101, 2): (1, 1, 1, 3, 3), (102, 2): (1, 1, 1, 0, 0), (103, 2): (1, 1, 1, 1, 1), (103, 3): (2, 2, 2, 2, 3)}


def test_substitutions_are_found(spark, corpus):
    """Of passages of 30 words with a fifth of them replaced, nearly all have a seed."""
    rng = random.Random(4)
    items = [[f"i{k}w{rng.randrange(10**6)}" for _ in range(30)] for k in range(60)]
    docs = [(k, " ".join(w if rng.random() > 0.2 else "zzz" for w in item)) for k, item in enumerate(items)]
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    got = decontaminate.contaminated(corpus(docs), bench).collect()
    assert all(r.doc_id == r.item_id for r in got) and len(got) >= 50


# -- lines -------------------------------------------------------------------------------------------------------------


def slow_lines(rows, n, num, den):
    lines = []
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            w = tuple(words(line.lower()))
            if w and i is not None:
                lines.append(((i, k), w, frozenset(w[j : j + n] for j in range(len(w) - n + 1)) if len(w) >= n else frozenset([w])))
    lines.sort(key=lambda x: x[0])
    first, out = {}, {}
    for at, (key, w, s) in enumerate(lines):
        if w in first:
            if first[w] != key:
                out[key] = first[w]
            continue
        first[w] = key
        for other, v, o in lines[:at]:
            if first[v] == other and den * len(s & o) >= num * len(s | o):
                out[key] = other
                break
    return out


def test_lines_against_all_pairs(spark, corpus, odd_rows):
    rng = random.Random(6)
    base = [[rng.choice("aa bb cc dd ee ff gg hh ii jj".split()) + str(rng.randrange(30)) for _ in range(rng.randrange(1, 40))] for _ in range(12)]
    rows = []
    for i in range(80):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            line = list(rng.choice(base))
            for _ in range(rng.randrange(3)):
                line[rng.randrange(len(line))] = f"new{rng.randrange(5)}"
            lines.append(rng.choice(["  ", " "]).join(line) + rng.choice(["", " ", "\t"]))
        rows.append((i + 100, rng.choice(["\n", "\n\n"]).join(lines)))
    rows += [r for r in odd_rows if r[0] != 6]
    got = {(r.doc_id, r.line_no): (r.kept_doc, r.kept_line) for r in line_dedup.removed_lines(corpus(rows)).collect()}
    assert got == slow_lines(rows, 5, 80, 100)


def test_lines_of_ids_that_are_strings_or_far_apart(spark):
    rows = [("b", "one two three four five six\nalone"), ("a", "One two three four five  six"), ("c", None)]
    got = line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert [(r.doc_id, r.line_no, r.kept_doc, r.kept_line) for r in got] == [("b", 0, "a", 0)]
    ends = [(-(2**63), "x y z"), (2**63 - 1, "x y z")]
    got = line_dedup.removed_lines(spark.createDataFrame(ends, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.kept_doc) for r in got] == [(2**63 - 1, -(2**63))]


def test_lines_of_a_large_group_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(400):
        line = list(base)
        for _ in range(rng.randrange(4)):
            line[rng.randrange(60)] = f"new{rng.randrange(3000)}"
        rows.append((i, " ".join(line)))
    got = {(r.doc_id, r.line_no): (r.kept_doc, r.kept_line) for r in line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == slow_lines(rows, 5, 80, 100) and len(got) > 150


def test_tokens_of_lines_are_counted_by_one_exchange(spark):
    entries = spark.createDataFrame([(7, 1), (7, 2), (8, 3), (9, 1), (9, 1)], "token long, lid long")
    out = line_dedup._shared(entries)
    assert sorted(map(tuple, out.select("token", "lid", "lines").collect())) == [(7, 1, 2), (7, 2, 2), (9, 1, 2), (9, 1, 2)]
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_white_space_between_words_is_no_difference(spark):
    lines = ["a b  c", " a b c", "a b c ", "A B C", "a\tb \x0b c", "a b c"]
    df = spark.createDataFrame([(i, "\t" in x, x) for i, x in enumerate(lines)], "i int, odd boolean, line string")
    assert len({(r.k1, r.k2, *r.t) for r in line_dedup._tokenized(df, 2).collect()}) == 1


def test_lines_are_taken_out(spark, corpus):
    rows = [(1, "the first line of it all here\nkeep this\n\nend"), (2, "own words\nThe FIRST line of it all here"), (3, "the first line of it all here"), (4, ""), (5, None), (6, "   ")]
    out = line_dedup.without_repeated_lines(corpus(rows))
    assert out.columns == corpus(rows).columns
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {1: (rows[0][1], len(rows[0][1])), 2: ("own words", 9), 4: ("", 0), 5: (None, None), 6: ("   ", 3)}
    assert line_dedup.removed_lines(corpus(rows).limit(0)).count() == 0


# -- neighbours --------------------------------------------------------------------------------------------------------


def test_all_codes_within_the_radius():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 256, (300, 4), dtype=np.uint8)
    queries = codes[:20] ^ (rng.random((20, 4)) < 0.3)
    index = neighbours.MultiIndex(codes)
    padded = np.ascontiguousarray(np.pad(queries, ((0, 0), (0, 4)))).view(np.uint64)
    far = np.unpackbits(queries[:, None, :] ^ codes[None], axis=2).sum(axis=2)
    for radius in (0, 3, 7, 12, 32):
        q, row, d = index.within(queries, padded, radius)
        assert set(zip(q.tolist(), row.tolist(), strict=True)) == {(a, b) for a, b in np.argwhere(far <= radius).tolist()} and (far[q, row] == d).all()


def test_neighbours_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(1200, 16)).astype(np.float32)
    vectors[100:140] = vectors[100]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)]
    rows += [(5000, None, "x"), (5001, [0.0] * 16, "x"), (5002, [float("nan")] * 16, "x"), (5003, [1.0] * 3, "x"), (None, [1.0] * 16, "x"), (5020, [None] * 16, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = collections.defaultdict(list)
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, k=20).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    x = vectors.astype(np.float64)
    hits = 0
    for i in range(0, 1200, 20):
        s = (x * x[i]).sum(axis=1)
        s[i] = -np.inf
        expected = np.lexsort((np.arange(1200), -s))[:20]
        mine = sorted(got[i])
        assert [r for r, _, _ in mine] == list(range(1, 21)) and all(v == pytest.approx(s[k], rel=1e-12) for _, k, v in mine)
        hits += len({k for _, k, _ in mine} & set(expected.tolist()))
    assert set(got) == set(range(0, 1200, 20)) and hits / (60 * 20) >= 0.9
    assert [k for _, k, _ in sorted(got[100])] == list(range(101, 121))
    few = neighbours.search(df.filter("vec_id < 5"), F.col("vec_id") == 0, k=20).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3, 4]
    assert neighbours.search(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_neighbours_of_repeated_rows_and_large_vectors(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 8))
    for factor in (1.0, 1e200, 1e-200):
        rows = [(i, (v * factor).tolist()) for i, v in enumerate(x)] + [(20, (x[20] * factor).tolist())] * 2 + [(20, (x[5] * factor).tolist())]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = neighbours.search(df, F.col("vec_id") % 20 == 0, k=10).collect()
        assert len(got) == 10 * 6  # 0 and 40, and four rows of 20
        of_20 = [(r.rank, r.vec_id) for r in got if r.query_id == 20]
        exact = []
        for at in (20, 60, 61, 62):
            scores = sorted((-float(np.dot(x[rows[at][0]] if at < 62 else x[5], np.array(rows[j][1]) / factor)), rows[j][0]) for j in range(len(rows)) if j != at)
            exact += [(k + 1, i) for k, (_, i) in enumerate(scores[:10])]
        assert sorted(of_20) == sorted(exact)


def test_neighbours_in_one_dense_cluster(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 64))
    x[::3] = rng.normal(size=64) + 0.05 * np.sqrt(64) * rng.normal(size=(2000, 64))
    x[30:90:3] = x[30] + 1e-6 * rng.normal(size=(20, 64))  # near copies, for which a small radius is proven
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in neighbours.search(df, F.col("vec_id") % 30 == 0, k=19, least_blocks=1).collect():
        got[r.query_id].append((r["rank"], r.vec_id))
    for i in range(0, 6000, 30):
        s = (x * x[i]).sum(axis=1)
        s[i] = -np.inf
        assert [k for _, k in sorted(got[i])] == np.lexsort((np.arange(6000), -s))[:19].tolist()


def test_radius_holds_all_that_is_as_near():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 20)) * rng.uniform(0.2, 1, (400, 1))
    x[:200] = x[0] + 0.01 * rng.normal(size=(200, 20))
    coder = neighbours.learn(x, float(np.sqrt((x**2).sum(axis=1).max())), bits=96)
    far = np.unpackbits(coder.query_codes(x)[:, None, :] ^ coder.codes(x)[None], axis=2).sum(axis=2)
    score = x @ x.T
    for k in (1, 20, 150):
        worst = np.sort(score, axis=1)[:, -k]
        radius = coder.radii(x, worst)
        assert (far <= radius[:, None])[score >= worst[:, None]].all()


# -- near duplicates ---------------------------------------------------------------------------------------------------


def slow_components(rows, n, num, den):
    sets = []
    for i, t in rows:
        w = words(t)
        sets.append((i, frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])))
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, o in sets[:a]:
            if s and o and i is not None and j is not None and den * len(s & o) >= num * len(s | o):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return collections.Counter((i, len(s), find(i)) for i, s in sets)


@pytest.mark.parametrize(("n", "num"), [(4, 85), (5, 80), (1, 60)])
def test_components_against_all_pairs(spark, corpus, odd_rows, n, num):
    rng = random.Random(8)
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.choice([1, 3, 5, 8, 13, 30, 90, 200]))] for _ in range(40)]
    rows = list(odd_rows)
    for i in range(260):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = f"w{rng.randrange(60)}"
        rows.append((i + 100, " ".join(w)))
    got = jaccard_join.jaccard_components(corpus(rows), words=n, similarity=(num, 100)).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == slow_components(rows, n, num, 100)


def test_regions_are_shared_by_all_linked_sets():
    rng = np.random.default_rng(9)
    for _ in range(2000):
        size = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        keep = a[rng.random(len(a)) > rng.random() * 0.18]
        b = np.unique(np.concatenate((keep, rng.integers(0, 2**64, int(rng.integers(0, 1 + len(a) // 8)), dtype=np.uint64))))
        if jaccard_join.linked(a, b, 85, 100):
            assert len(np.intersect1d(jaccard_join.regions(a, 85, 100), jaccard_join.regions(b, 85, 100)))


def test_linked_sets_share_a_region_without_their_commonest():
    rng = np.random.default_rng(12)
    linked = 0
    for _ in range(2000):
        a = np.unique(rng.integers(0, 2**64, int(rng.integers(1, 400)), dtype=np.uint64))
        keep = a[rng.random(len(a)) > rng.random() * 0.25]
        b = np.unique(np.concatenate((keep, rng.integers(0, 2**64, int(rng.integers(0, 1 + len(a) // 6)), dtype=np.uint64))))
        if jaccard_join.linked(a, b, 80, 100):
            # the worst order: what they share comes last
            sets = [jaccard_join.region_sets(s, 80, 100) for s in (a, b)]
            both = np.intersect1d(*(np.concatenate([k for _, k in s]) for s in sets))
            kept = [np.concatenate([k[np.lexsort((k, np.isin(k, both)))][: len(k) - spare] for spare, k in s]) for s in sets]
            assert len(np.intersect1d(*kept))
            linked += 1
    assert linked > 500


def test_a_common_passage_brings_no_long_texts_together(spark, monkeypatch):
    rng = np.random.default_rng(13)
    common = [f"c{i}" for i in range(30)]
    texts = [" ".join([*(f"w{x}" for x in rng.integers(0, 10**9, 4000)), *common]) for _ in range(24)]
    texts += [texts[0] + " more", texts[0].replace(" ", "  ", 50)]
    pairs, bounded = [], jaccard_join._bounded
    monkeypatch.setattr(jaccard_join, "_bounded", lambda p, *rest: pairs.append(p.count()) or bounded(p, *rest))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df).collect()}
    assert got == {i: i if i < 24 else 0 for i in range(26)} and sum(pairs) <= 4


def test_bounds_of_large_sets_tell_them_apart():
    rng = np.random.default_rng(14)
    sets = [np.unique(rng.integers(0, 2**64, 6000, dtype=np.uint64)) for _ in range(20)]
    points = [jaccard_join.count_vector(s, jaccard_join.dimensions(len(s))).astype("<u2").tobytes() for s in sets]
    sizes, labels = np.array([len(s) for s in sets]), np.arange(20)
    assert (jaccard_join.undecided(jaccard_join.folded(points), sizes, labels, 80, 100) == -1).all()
    short = [jaccard_join.count_vector(s).astype("<u2").tobytes() for s in sets]
    assert (jaccard_join.folded([*points, short[0]])[:20] == jaccard_join.folded(short)).all()


def test_tree_gives_every_pair_that_its_bound_allows():
    rng = np.random.default_rng(10)
    points = rng.poisson(3, (150, jaccard_join.DIMENSIONS)).astype(np.int32)
    points[75:] = points[:75] + rng.integers(0, 2, (75, jaccard_join.DIMENSIONS))
    sizes = points.sum(axis=1)
    found = set()
    for i, j in jaccard_join.CountTree(points, sizes).pairs(85, 100):
        found |= {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    bound = np.minimum(points[:, None], points[None]).sum(axis=2)
    allowed = 185 * bound >= 85 * (sizes[:, None] + sizes[None])
    assert found == {(a, b) for a, b in np.argwhere(allowed).tolist() if a < b}


def test_tree_of_like_points_takes_little_memory():
    import tracemalloc

    points = np.full((jaccard_join.TILE, jaccard_join.DIMENSIONS), 3, np.int32)
    tracemalloc.start()
    try:
        n = sum(len(i) for i, _ in jaccard_join.CountTree(points, points.sum(axis=1)).pairs(85, 100))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == jaccard_join.TILE * (jaccard_join.TILE - 1) // 2 and peak < 64 << 20


def test_texts_are_hashed_once(spark, corpus):
    found = jaccard_join.jaccard_components(corpus([(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, None)]))
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(1, 4, 1), (2, 4, 1), (3, 0, 3)]


def test_survivors_and_graphs(spark, corpus, odd_rows):
    df = corpus([(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, None), (4, ""), (5, ""), (None, "a b c d e f g h")])
    out = jaccard_join.survivors(df)
    assert out.columns == df.columns and sorted((r.doc_id or -1) for r in out.collect()) == [-1, 1, 3, 4, 5]
    assert jaccard_join.jaccard_components(df.limit(0)).count() == 0
    path = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(7, 7), (None, 3), (100, 90), (90, 80)], "a long, b long")
    labels = {r.id: r.label for r in connected_components(path).collect()}
    assert labels == {i: 0 for i in range(1, 41)} | {100: 80, 90: 80}


def test_large_groups_send_few_links_to_components(spark, monkeypatch):
    """Chains of near copies: each document shares regions with many others, but a link or two a document is enough."""
    from tidegrid.llm import jaccard_join

    rng = np.random.default_rng(11)
    words, texts = [f"w{i}" for i in rng.integers(0, 10**6, 120)], []
    for i in range(400):
        own = list(words)
        for _ in range(6):
            own[rng.integers(0, 120)] = f"n{rng.integers(0, 10**6)}"
        texts.append(" ".join(own))
        if i % 5 == 0:
            words[rng.integers(0, 120)] = f"c{i}"
    sent = []
    components = jaccard_join.connected_components

    def counted(links, *rest):
        links = jaccard_join.checkpointed(links)
        sent.append(links.distinct().count())
        return components(links, *rest)

    monkeypatch.setattr(jaccard_join, "connected_components", counted)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df, words=4, similarity=(85, 100)).collect()}
    sets = jaccard_join.shingle_sets(texts, 4)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if jaccard_join.linked(sets[i], sets[j], 85, 100):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in range(len(texts))}
    assert max(sent) <= len(texts), sent
