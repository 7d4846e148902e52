"""Quality, secrets, language models and language identification."""

from __future__ import annotations

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegrid.llm import langid, lm_score, quality, secrets
from tidegrid.llm.queries import QUERIES, vocabulary

from .conftest import words


def test_pairwise_part_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    fm = quality.FactorisationMachine(0.3, rng.normal(size=30), rng.normal(size=(30, 4)))
    columns, values = np.array([1, 5, 7, 29]), rng.normal(size=4)
    pairs = sum(fm.factors[columns[i]] @ fm.factors[columns[j]] * values[i] * values[j] for i in range(4) for j in range(i))
    expected = 0.3 + fm.weights[columns] @ values + pairs
    assert fm.margins(np.array([0, 4]), columns, values)[0] == pytest.approx(expected)


def test_quality_learns_and_is_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op1_quality"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_quality_of_odd_texts(spark, corpus, odd_rows):
    df = corpus(odd_rows)
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 0), (8, None, None)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        model = quality.train(df, known, metadata=("n_chars",))
        rows = quality.score(df, model, metadata=("n_chars",)).collect()
        assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows)
        empty = {r.score for r in rows if r.doc_id == 2}
        kept = quality.score(df, model, metadata=("n_chars",), keep="quality_score")
        assert kept.columns == [*df.columns, "quality_score"] and kept.count() == len(odd_rows) and len(empty) == 1
    assert quality.score(df.limit(0), model, metadata=("n_chars",)).count() == 0


def test_base_forms_of_secrets():
    text = 'Password: "abcdef" token=abc api-key = zzzzzzzz apikey:zzzzzz AKIA' + "A" * 16 + " AKIAshort " + "0f" * 12 + " " + "0f" * 11
    spans = secrets.base_spans(text)
    assert [text[s:e] for s, k, e in spans if k == 0] == ['Password: "abcdef', "apikey:zzzzzz"]
    assert [text[s:e] for s, k, e in spans if k == 1] == ["AKIA" + "A" * 16]
    assert [text[s:e] for s, k, e in spans if k == 2] == ["0f" * 12]
    # a form that is too short still takes its text: what it covers is not tried again
    assert secrets.base_spans("secret=token: abcdef") == []


def test_dense_strings_are_found_and_names_are_not(spark, corpus):
    rng = random.Random(3)
    secret = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    texts = [f"Ünter use {secret} now", "see getUserAccountSettingsPage and my_very_long_variable_name_here", "md5: " + hashlib.md5(b"x").hexdigest().upper(), "id 123e4567-e89b-12d3-a456-426614174000 ok", "https://example.com/" + secret, "internationalization", "1" * 40]
    rows = secrets.scan_secrets(corpus(list(enumerate(texts))), vocabulary("byte_bpe_50k.tiktoken")).orderBy("doc_id").collect()
    start = texts[0].index(secret)
    assert rows[0].spans == f"dense:{start}:{start + 40}"
    assert [r.n_dense for r in rows] == [1, 0, 0, 0, 0, 0, 0]


def test_keys_of_letters_in_urls_and_short_ones_are_found(spark, corpus):
    lower, mixed, key, short = "qzxvkwjhpfgtbydmrnclqsxzvwkjgphb", "qZxVkWjHpFgTbYdMrNcLqSxZvWkJgPhB", "x9Qz7Lk2Vp4Tr8Wm3Nc6Yb1", "x9Qz7Lk2Vp4Tr8Wm"
    found = [f"use {lower} now", f"use {lower.upper()} now", f"use {mixed} now", f"redis://user:{key}@host.example/0", f"https://{'h' * 3}.example/a?user=me&key={key}&z=1", f"see {short} here"]
    secret = [lower, lower.upper(), mixed, key, key, short]
    names = ["Donaudampfschifffahrtsgesellschaft", "understandability", "internationalization", "https://www.example.com:8080/" + key, "https://e.example/" + key + "?page=2", "https://e.example/?id=123e4567-e89b-12d3-a456-426614174000", "https://e.example/a@b/" + key, "1234567890123456"]
    rows = secrets.scan_secrets(corpus(list(enumerate(found + names))), vocabulary("byte_bpe_50k.tiktoken")).orderBy("doc_id").collect()
    assert [r.spans for r in rows[: len(found)]] == [f"dense:{t.index(k)}:{t.index(k) + len(k)}" for t, k in zip(found, secret, strict=True)]
    assert [r.n_dense for r in rows[len(found) :]] == [0] * len(names)


def test_secrets_of_odd_texts(spark, corpus, odd_rows):
    found = secrets.scan_secrets(corpus(odd_rows), vocabulary("byte_bpe_50k.tiktoken"))
    rows = secrets.with_digest(found).collect()
    assert len(rows) == len(odd_rows) and {r.base_sha256 for r in rows} == {hashlib.sha256(b"").hexdigest()}
    assert found.limit(0).count() == 0


def slow_base(text):
    """kind:start:end of the base forms by a walk over the characters."""
    ascii_ = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    skip = lambda i, allowed: next((k for k in range(i, len(text)) if text[k] not in allowed), len(text))

    def assign(i):
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if text[i : i + len(word)].isascii() and text[i : i + len(word)].lower() == word:
                k = i + len(word)
                k = skip(k + (text[k : k + 1] in ("'", '"')), " ")
                if text[k : k + 1] not in (":", "="):
                    return None
                k = skip(k + 1, " ")
                k += text[k : k + 1] in ("'", '"')
                end = skip(k, ascii_ | set("+/_.=-"))
                return (end, end - k >= 6) if end > k else None
        return None

    def access(i):
        end = skip(i + 4, set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
        return (end, end - i >= 20) if text.startswith("AKIA", i) and end > i + 4 else None

    def hexes(i):
        end = skip(i, set("0123456789abcdef"))
        return (end, end - i >= 24) if end > i else None

    out = []
    for k, form in enumerate((assign, access, hexes)):
        i = 0
        while i < len(text):
            if m := form(i):
                out += [(i, k, m[0])] * m[1]
                i = m[0]
            else:
                i += 1
    return [f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(out)]


def test_secrets_query_against_a_walk_over_the_characters(spark, sf, tmp_path):
    rng = random.Random(8)
    parts = ["password", "Passwd", "SECRET", "token", "api_key", "ApiKey", "api_", '"', "'", " ", "  ", ":", "=", "==", "abc", "aB3/x+._-", "zzzzzzzz", "AKIA", "AKIA" + "Q7" * 9, "A" * 15, "A9" * 9, "0f" * 9, "deadbeef", "ÄÖ ", "\n", "ſecret=", "toKen=abcdef", "secret=token: abcdef"]
    made = [(10**6 + i, "".join(rng.choice(parts) for _ in range(rng.randrange(60)))) for i in range(400)]
    documents = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    documents.union(spark.createDataFrame([*made, (10**7, None), (10**7 + 1, "")], "doc_id long, text string")).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in QUERIES["op2_secrets"](spark, str(tmp_path)).collect()}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    assert rows.keys() == texts.keys() and min(sum(r[n] for r in rows.values()) for n in ("n_assign", "n_access", "n_hex")) > 20
    for doc, text in texts.items():
        base, row = slow_base(text), rows[doc]
        assert row.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), text
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(b.startswith(k) for b in base) for k in ("assign", "access", "hex")]
        assert [x for x in (row.spans or "").split(",") if x and not x.startswith("dense")] == base


PARTS = st.sampled_from(["://", ":/", "/", ":", "@", "?", "#", " ", "\n", "key=", "a.b", "h" * 90, "Qx9zLk2Vp4Tr8Wm3Nc6Y", "https", "8080/", ",", "%"])


@given(st.lists(PARTS, max_size=14))
@settings(max_examples=400, deadline=None)
def test_what_stands_before_a_run_is_told_without_a_limit(parts):
    text = "".join(parts)
    before = secrets.Stretch(text)
    for m in secrets.RUN.finditer(text):
        before.to(m.start())
        _, scheme, rest = re.search(r"\S*\Z", text[: m.start()]).group().rpartition("://")
        assert (before.host >= 0) == bool(scheme)
        if scheme:
            assert text[before.host : m.start()] == rest
            assert (before.in_query, before.past_host) == ("?" in rest or "#" in rest, "/" in rest or "@" in rest)


def test_runs_in_long_urls(spark, corpus):
    key = "x9Qz7Lk2Vp4Tr8Wm3Nc6Yb1"
    long = "https://www.example.com/" + "a.b/" * 40
    texts = [long + "," + key, long + "?page=1&" + "c.d&" * 40 + "key=" + key, "x" + ".y" * 5000 + "," + key]
    rows = secrets.scan_secrets(corpus(list(enumerate(texts))), vocabulary("byte_bpe_50k.tiktoken")).orderBy("doc_id").collect()
    spans = [[tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x] for r in rows]
    assert spans[0] == [] and spans[2] == [(len(texts[2]) - len(key), len(texts[2]))]
    assert (len(texts[1]) - len(key), len(texts[1])) in spans[1]


def slow_scores(rows, order):
    texts = [words(t) for _, t in rows]
    counts = [collections.Counter(tuple(w[i : i + n + 1]) for w in texts for i in range(len(w) - n)) for n in range(order)]
    total, out = sum(map(len, texts)), []
    for w in texts:
        own = [collections.Counter(tuple(w[i : i + n + 1]) for i in range(len(w) - n)) for n in range(order)]
        seen = lambda g: counts[len(g) - 1][g] - own[len(g) - 1][g]  # noqa: B023, E731
        others, s = max(1, total - len(w)), 0.0
        for i in range(len(w)):
            factor = 1.0
            for n in range(min(order - 1, i), -1, -1):
                g = tuple(w[i - n : i + 1])
                if seen(g) > 0:
                    s += math.log(factor * seen(g) / (seen(g[:-1]) if n else others))
                    break
                factor *= lm_score.ALPHA
            else:
                s += math.log(factor / others)
        out.append((len(w), s))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_scores_against_a_loop(spark, corpus, odd_rows, order):
    rng = random.Random(1)
    rows = [(i + 100, " ".join(rng.choice("a b c dd ee f".split()) for _ in range(rng.randrange(40)))) for i in range(60)] + odd_rows
    got = lm_score.backoff_scores(corpus(rows), order=order).collect()
    expected = collections.Counter((i, n, round(s, 5)) for (i, _), (n, s) in zip(rows, slow_scores(rows, order), strict=True))
    assert collections.Counter((r.doc_id, r.n_words, round(r.log_score, 5)) for r in got) == expected
    assert all((r.mean_log_score is None) == (r.n_words == 0) for r in got)
    assert lm_score.backoff_scores(corpus(rows).limit(0), order=order).count() == 0


def test_packing_of_numbers():
    for v in (np.zeros(0, np.uint64), np.array([0, 1, 255, 256, 2**63 + 5], np.uint64), np.arange(1000, dtype=np.uint64)):
        assert (lm_score.unpacked(lm_score.packed(v)) == v).all()


def slow_parse(text, symbols_known, letters):
    sym = langid.symbols_of([text], letters)[0].tolist()
    known = symbols_known.tolist()
    phrases, at = 1, 0
    current: list[int] = []
    grams = {tuple(known[i:j]) for i in range(len(known)) for j in range(i + 1, min(len(known), i + 40) + 1)}
    for c in sym:
        if tuple([*current, c]) in grams:
            current.append(c)
        else:
            phrases += 1
            current = [c] if (c,) in grams else []
        at += 1
    return phrases


def test_parsing_against_a_search_for_substrings():
    rng = random.Random(7)
    known = ["".join(rng.choice("abca ") for _ in range(150)), "".join(rng.choice("xyza ") for _ in range(150))]
    parser = langid.CrossParser(["l1", "l2"], known)
    texts = ["".join(rng.choice("abcxyz q") for _ in range(200)) for _ in range(5)]
    bits, has = parser.bits_per_character(texts)
    for i, t in enumerate(texts):
        size = len(langid.symbols_of([t], parser.letters)[0])
        for j, k in enumerate(known):
            expected = slow_parse(t, langid.symbols_of([k], parser.letters)[0], parser.letters) * parser.bits[j] / size
            assert bits[i, j] == pytest.approx(expected)
    assert has.all()


@pytest.mark.parametrize("piece", [1, 3, 16, 64])
def test_phrases_go_on_over_pieces(monkeypatch, piece):
    rng = random.Random(piece)
    known = ["".join(rng.choice("abca ") for _ in range(400)), "".join(rng.choice("xyza ") for _ in range(300))]
    texts = [known[0], known[0][20:380] + known[0][10:200], known[1] * 2, "", "b", "q" * 50, *("".join(rng.choice("abcxyz q") for _ in range(rng.randrange(200))) for _ in range(6))]
    texts.append("".join(known[rng.randrange(2)][k : k + rng.randrange(1, 90)] for k in range(0, 200, 7)))
    whole, _ = langid.CrossParser(["l1", "l2"], known).bits_per_character(texts)
    monkeypatch.setattr(langid, "PIECE", piece)
    monkeypatch.setattr(langid, "TOGETHER", 1)
    parser = langid.CrossParser(["l1", "l2"], known)
    assert parser.bits_per_character(texts)[0] == pytest.approx(whole)
    assert whole[0, 0] * len(langid.symbols_of([known[0]], parser.letters)[0]) == pytest.approx(parser.bits[0])  # one phrase


def test_languages_are_found(spark):
    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op4_language"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.98


def test_languages_of_many_letters_are_told_apart():
    rng = random.Random(9)
    words = {lang: ["".join(chr(rng.randrange(0x4E00, 0x4E00 + 2500)) for _ in range(2)) for _ in range(300)] for lang in ("x", "y")}
    words["z"] = [chr(0x30000 + k) for k in range(300)]
    make = lambda lang: " ".join(rng.choice(words[lang]) for _ in range(2000))
    parser = langid.CrossParser(list(words), [make(lang) for lang in words])
    bits, _ = parser.bits_per_character([make(lang) for lang in ("x", "y", "z") for _ in range(5)])
    assert bits.argmin(axis=1).tolist() == [0] * 5 + [1] * 5 + [2] * 5 and len(parser.letters) > 800


def test_every_label_is_learned_from_all_of_its_texts(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2][:210]
    rows = [(i, "a" * 3000 + "b" * 3000, f"l{k % 70:02}") for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    languages, texts = langid.labelled_texts(df, id_col="doc_id", text_col="text", lang_col="lang", chars_per_language=1200, texts_per_language=60)
    assert languages == [f"l{k:02}" for k in range(70)]
    assert all(min(t.count("a"), t.count("b")) > 580 and len(t) <= 1200 for t in texts)


def test_language_of_odd_texts(spark, corpus, odd_rows):
    df = corpus(odd_rows)
    rows = langid.identify(df, ["de", "en"], ["der die das und ist ä ö ü ß", "the and of that with one two three"]).collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == len(odd_rows) and [by_id[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3
    assert by_id[6].lang_pred == "en" and by_id[7].lang_pred == "de" and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in langid.identify(df, [], []).collect()} == {"und"}
    assert langid.labelled_texts(df.limit(0), id_col="doc_id", text_col="text", lang_col="lang", chars_per_language=10, texts_per_language=2, max_languages=4) == ([], [])


def test_vocabulary_is_read_where_it_is():
    with open(vocabulary("byte_bpe_50k.tiktoken"), "rb") as f:
        assert base64.b64decode(f.readline().split()[0])
