"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds all substrings of a labelled text. A document is parsed from left to right
into the longest pieces that the automaton knows; the language whose text needs the fewest pieces, each worth
log2(length of the labelled text) bits, describes the document in the fewest bits a character and wins.

Only transitions from the start state are followed, so a missing transition ends a phrase and starts the next one at
the same character. Transitions are kept sparse, so scripts of thousands of letters and any number of languages fit: a
state is a number, and its transition by a symbol lies at the sum of both, marked with its owner. Parsing is a lookup a
character (two where a phrase ends), done for thousands of texts and all languages in step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_bytes, column, learnable, sql_type

SPACE, OTHER, FIRST = 0, 1, 2
#: Texts are parsed in pieces of so many characters, side by side; then each piece is parsed again from where the piece
#: before it has come to, up to the first phrase that both parses begin at one place. So phrases don't end with pieces.
PIECE = 1024
#: Languages that are parsed at a time: their phrases' places are kept for a batch of texts, a byte a character.
TOGETHER = 8
#: Labelled texts that are longer than their share are learned from in passages of so many characters, spread evenly.
PASSAGE = 100


def suffix_automaton(symbols: np.ndarray) -> list[dict[int, int]]:
    """For each state of the automaton of all substrings its transitions: symbol -> state. The first state is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols.tolist():
        cur = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in moves[p]:
            moves[p][c] = cur
            p = link[p]
        if p != -1:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return moves


def parse_table(symbols: np.ndarray, alphabet: int) -> np.ndarray:
    """The automaton as a table of owner << 32 | next; states are numbers, 0 the start, whose row has every symbol.

    The entry at state + symbol is the state's transition if the state is its owner. At the start, a symbol that the
    text has not is owned by none and leads back. States get their numbers by chance, those of most transitions first,
    and try again where entries are taken.
    """
    moves = suffix_automaton(symbols)
    degree = np.array([len(m) for m in moves])
    size = alphabet + 3 * int(degree.sum()) + len(moves)
    rng = np.random.default_rng(11)
    number, used, taken = np.zeros(len(moves), np.int64), np.zeros(size, bool), np.zeros(size + alphabet, bool)
    used[0], taken[:alphabet] = True, True
    claims, numbers = np.zeros(size + alphabet, np.int64), np.zeros(size, np.int64)
    for d in np.unique(degree)[::-1]:
        left = np.flatnonzero(degree == d)
        left = left[left > 0]
        own = np.array([list(moves[s]) for s in left], np.int64).reshape(len(left), d)
        while len(left):
            n = rng.integers(1, size, len(left))
            at = n[:, None] + own
            claims[at], numbers[n] = np.arange(len(left))[:, None], np.arange(len(left))
            fits = ~used[n] & ~taken[at].any(axis=1) & (claims[at] == np.arange(len(left))[:, None]).all(axis=1) & (numbers[n] == np.arange(len(left)))
            number[left[fits]] = n[fits]
            used[n[fits]], taken[at[fits]] = True, True
            left, own = left[~fits], own[~fits]
    table = np.full(size + alphabet, -1 << 32, np.int64)
    for s, m in enumerate(moves):
        for c, t in m.items():
            table[number[s] + c] = number[s] << 32 | number[t]
    return table


def letters_of(texts: list[str]) -> list[str]:
    """The letters of the texts, commonest first."""
    n: dict[str, int] = {}
    for t in texts:
        for ch in t.lower():
            if ch.isalpha():
                n[ch] = n.get(ch, 0) + 1
    return sorted(n, key=lambda c: (-n[c], c))


_letter: list[np.ndarray] = []


def symbols_of(texts: list[str | None], letters: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, and their bounds: lower-case letters, any letter that is not known as one symbol, and one space for each run of anything else."""
    if not _letter:
        _letter.append(np.array([chr(c).isalpha() for c in range(0x110000)], np.int32))
    low = [(t or "").lower() for t in texts]
    points = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _letter[0].copy()  # OTHER where a letter
    for i, ch in enumerate(letters):
        table[ord(ch)] = FIRST + i
    sym = table[points]
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] != SPACE) | (sym[:-1] != SPACE)
    after = np.cumsum([len(t) + 1 for t in low])
    kept = np.concatenate(([0], np.cumsum(keep)))
    return sym[keep], kept[np.concatenate(([0], after)).astype(np.int64)]


class CrossParser:
    """Parsers for labelled texts: texts[l] is the labelled text of languages[l]."""

    def __init__(self, languages: list[str], texts: list[str]):
        self.languages = languages
        self.letters = letters_of(texts)
        self.alphabet = FIRST + len(self.letters)
        own = [symbols_of([t], self.letters)[0] for t in texts]
        self.bits = np.array([np.log2(max(2, len(s))) for s in own])
        tables = [parse_table(s, self.alphabet) for s in own]
        self.roots = np.concatenate(([0], np.cumsum([len(t) for t in tables])[:-1])).astype(np.int64)
        # one table for all languages: states move by the language's root; no owner stays none
        self.table = np.concatenate([np.where(t < 0, t + r, t + (int(r) << 32 | int(r))) for t, r in zip(tables, self.roots, strict=True)]) if tables else np.zeros(0, np.int64)

    def bits_per_character(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """[text, language] bits, and whether a text has a letter."""
        sym, at = symbols_of(texts, self.letters)
        n, langs = len(texts), len(self.languages)
        sizes = np.diff(at)
        has_letter = np.add.reduceat(np.append(sym != SPACE, False).astype(np.int64), at[:-1]) > 0 if n else np.zeros(0, bool)
        pieces = -(-sizes // PIECE)
        of = np.repeat(np.arange(n), pieces)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = at[:-1][of] + PIECE * nth
        size = np.minimum(PIECE, at[1:][of] - start)
        padded = np.append(sym, np.zeros(PIECE, sym.dtype))
        phrases = np.zeros((langs, len(of)), np.int64)
        for g in range(0, langs, TOGETHER):
            own = slice(g, g + TOGETHER)
            phrases[own] = self._phrases(self.roots[own], padded, start, size, nth > 0)
        total = np.zeros((n, langs))
        for j in range(langs):
            total[:, j] = np.bincount(of, phrases[j], n)[:n] * self.bits[j]
        return total / np.maximum(sizes, 1)[:, None], has_letter

    def _phrases(self, roots: np.ndarray, padded: np.ndarray, start: np.ndarray, size: np.ndarray, goes_on: np.ndarray) -> np.ndarray:
        """[language, piece] phrases that begin in each piece; goes_on: the piece before it is of the same text."""
        begins, state = self._side_by_side(roots, padded, start, size)
        alone = begins.sum(axis=2, dtype=np.int64)
        out = alone + ~goes_on  # a text's first phrase
        end = state.copy()
        lang, piece = np.nonzero(np.broadcast_to(goes_on, out.shape))
        while len(piece):
            now, own, passed = end[lang, piece - 1], np.zeros(len(piece), np.int64), np.zeros(len(piece), np.int64)
            after = state[lang, piece]
            met = np.zeros(len(piece), bool)
            live, t = np.arange(len(piece)), 0
            while len(live):
                k, j = piece[live], lang[live]
                symbol = padded[start[k] + t]
                move = self.table[now[live] + symbol]
                new = move >> 32 != now[live]
                move = np.where(new, self.table[roots[j] + symbol], move)
                now[live] = move & 0xFFFFFFFF
                both = begins[j, k, t]
                own[live] += new
                passed[live] += both
                met[live] = new & both
                t += 1
                live = live[~(new & both) & (t < size[k])]
            out[lang, piece] = np.where(met, own + alone[lang, piece] - passed, own)
            after = np.where(met, after, now)
            changed = after != end[lang, piece]
            end[lang, piece] = after
            # a piece whose end is not what the next one was parsed from
            lang, piece = lang[changed], piece[changed] + 1
            fine = piece < len(size)
            lang, piece = lang[fine], piece[fine]
            fine = goes_on[piece]
            lang, piece = lang[fine], piece[fine]
        return out

    def _side_by_side(self, roots: np.ndarray, padded: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where phrases begin in each piece when it is parsed from its first character (that one not marked), and the last states."""
        order = np.argsort(-size, kind="stable")
        from_, length = start[order], size[order]
        state = np.repeat(roots[:, None], len(order), axis=1)
        begins = np.zeros((len(roots), len(order), PIECE), bool)
        live = np.searchsorted(-length, -np.arange(1, PIECE + 1), side="right")  # pieces of at least so many characters
        for t in range(int(length[0]) if len(length) else 0):
            m = live[t]
            symbol, now = padded[from_[:m] + t], state[:, :m]
            move = self.table[now + symbol]
            lang, k = np.nonzero(move >> 32 != now)
            begins[lang, order[k], t] = True
            move[lang, k] = self.table[roots[lang] + symbol[k]]
            state[:, :m] = move & 0xFFFFFFFF
        back = np.empty_like(state)
        back[:, order] = state
        return begins, back


def labelled_texts(df: DataFrame, *, id_col: str, text_col: str, lang_col: str, chars_per_language: int, texts_per_language: int, max_languages: int | None = None) -> tuple[list[str], list[str]]:
    """Languages and one labelled text for each, from the texts whose ids have the smallest hashes.

    Bounds of the sample: texts_per_language and chars_per_language; a text longer than its share of the latter (200 at
    least) gives passages from its beginning to its end. Every label is learned, unless max_languages (the most frequent)
    is given.
    """
    known = df.filter(learnable(column(id_col)) & column(lang_col).isNotNull() & column(text_col).isNotNull()).select(column(id_col).alias("doc_id"), column(text_col).alias("text"), column(lang_col).alias("lang"))
    if max_languages is not None:
        frequent = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages)
        known = known.join(F.broadcast(frequent.select("lang")), "lang", "left_semi")
    keyed = known.withColumn("h", F.xxhash64("doc_id"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    taken = keyed.withColumn("nth", nth).filter(F.col("nth") <= texts_per_language).withColumn("own", F.count(F.lit(1)).over(Window.partitionBy("lang")))
    share = F.greatest(F.lit(200), F.floor(F.lit(chars_per_language) / F.col("own"))).cast("int")
    passages = F.greatest(F.lit(2), F.floor(share / PASSAGE)).cast("int")
    at = lambda i: (F.lit(1) + F.floor(i * (F.length("text") - PASSAGE) / (passages - 1))).cast("int")
    spread = F.concat_ws("\n", F.transform(F.sequence(F.lit(0), passages - 1), lambda i: F.substring(F.col("text"), at(i), F.lit(PASSAGE))))
    rows = taken.select("lang", "h", F.when(F.length("text") <= share, F.col("text")).otherwise(spread).alias("text")).collect()
    out: dict[str, list[str]] = {}
    for lang, _, text in sorted(map(tuple, rows)):
        out.setdefault(lang, []).append(text)
    return list(out), ["\n".join(own)[: max(chars_per_language, 0)] for own in out.values()]


_parsers: dict[int, CrossParser] = {}


def identify(df: DataFrame, languages: list[str], texts: list[str], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (0 to 1, higher the clearer) of each row of df.

    'und' and 0 for null texts, texts without a letter, and without any labelled language. Ties go to the language
    first in order. Whole texts are parsed; repeated rows are separate rows.
    """

    def predict(batches):
        key = hash((tuple(languages), tuple(texts)))
        if key not in _parsers:
            _parsers.clear()
            _parsers[key] = CrossParser(languages, texts)
        parser = _parsers[key]
        for batch in batches:
            all_texts = batch.column(1).to_pylist()
            langs, scores = [], []
            for a, b in by_bytes(all_texts, 4 << 20):
                if not languages:
                    langs += ["und"] * (b - a)
                    scores += [0.0] * (b - a)
                    continue
                bits, has_letter = parser.bits_per_character(all_texts[a:b])
                best = bits.argmin(axis=1)
                weight = np.exp2(-4 * (bits - bits.min(axis=1, keepdims=True)))
                sure = 1 / weight.sum(axis=1)
                langs += [languages[k] if ok else "und" for k, ok in zip(best, has_letter, strict=True)]
                scores += np.where(has_letter, sure, 0.0).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = df.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))
    return rows.mapInArrow(predict, f"doc_id {sql_type(rows, 'doc_id')}, lang_pred string, score double")
