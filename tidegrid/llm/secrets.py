"""Secret scan: known credential forms, and strings that a byte-pair vocabulary has to cut into small tokens.

A vocabulary holds what people write often. Random strings are not in it: they come apart into tokens of one or two
characters. A run of credential characters with few characters per token is reported, unless it is a digest that is
labelled as one, or an identifier (words joined by case, hyphen, slash or underscore; a UUID; a number; the host or path
of a URL). Letters alone are judged by their tokens: those of a word are long. User-info and query of a URL are judged too.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, sql_type

# The credential forms of the contract.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run either way, so the length can be part of the pattern
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
MIN_ASSIGN, MIN_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "dense")
#: How the vocabulary's text is cut before merges; the file of the vocabulary does not hold it.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
#: Runs of LEAST characters are judged; those of fewer than SHORT vary more in characters per token, and meet a stricter limit.
LEAST, SHORT = 16, 20
UUID = re.compile(r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")
DIGEST = re.compile(r"(?i)[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}")
DIGEST_LABEL = re.compile(r"(?i)(md5|sha-?\d+|checksum|digest|etag|commit|revision|integrity|fingerprint)\W{0,4}$")
WORDS = re.compile(r"(?:[A-Z]?[a-z]{2,14}|[A-Z]{2,15}(?![A-Z]{2})|[0-9]{1,4})(?:[-_/+=]+|$|(?=[A-Z0-9]))")
PORT = re.compile(r"[0-9]{1,5}/")
USER_INFO_ENDS = re.compile(r"[^\s/?#@]*@")
QUERY_KEY = re.compile(r"[A-Za-z0-9_-]+=(?=[^=])")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the contract's forms, unsorted; leftmost and non-overlapping within a kind."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def is_identifier(run: str, before: str) -> bool:
    """Whether a run is a labelled digest or a name rather than a secret; before: the text in front of it."""
    core = run.strip("-_=/+")
    if UUID.fullmatch(core) or core.isdigit():
        return True
    if DIGEST.fullmatch(core) and DIGEST_LABEL.search(before):
        return True
    pos = 0
    while pos < len(core) and (m := WORDS.match(core, pos)):
        pos = m.end()
    return pos == len(core)


class Stretch:
    """What stands before a run in its stretch without white space, told from run to run; each character is looked at a few times at most."""

    def __init__(self, text: str):
        self.text, self.seen, self.first = text, 0, 0
        self.host = -1  # where the last URL's host begins
        self.in_query = self.past_host = False

    def to(self, start: int) -> None:
        text, i = self.text, start
        while i > self.seen and not text[i - 1].isspace():
            i -= 1
        if i > self.seen:
            self.seen = self.first = i
            self.host, self.in_query, self.past_host = -1, False, False
        scheme = text.rfind("://", max(self.first, self.seen - 2), start)
        if scheme >= 0:
            self.host, self.in_query, self.past_host = scheme + 3, False, False
        if self.host >= 0:
            part = text[max(self.seen, self.host) : start]
            self.in_query = self.in_query or "?" in part or "#" in part
            self.past_host = self.past_host or "/" in part or "@" in part
        self.seen = start


def judged_from(before: Stretch, start: int, end: int) -> int:
    """Where the part of a run begins that may be a secret: its end in a URL's host or path, behind the key in a query."""
    text = before.text
    if before.host < 0:
        return start
    if before.in_query:
        key = QUERY_KEY.match(text, start, end)
        return key.end() if key else start
    after_name = start > before.host and text[start - 1] == ":"
    in_authority = not before.past_host and (after_name or "/" not in text[start:end]) and not PORT.match(text, start, end)
    return start if in_authority and USER_INFO_ENDS.match(text, end) else end


def dense_spans(text: str, encode, max_chars_per_token: float, max_chars_per_token_short: float) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of runs with at most so many characters per token."""
    out = []
    before = Stretch(text)
    for m in RUN.finditer(text):
        end = m.end()
        before.to(m.start())
        start = judged_from(before, m.start(), end)
        run = text[start:end]
        # a digest's label and what stands between them are far shorter than 64 characters
        if len(run) >= LEAST and len(set(run)) > 3 and not is_identifier(run, text[max(0, start - 64) : start]):
            if len(run) <= (max_chars_per_token if len(run) >= SHORT else max_chars_per_token_short) * len(encode(run)):
                out.append((start, 3, end))
    return out


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan_secrets(df: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", max_chars_per_token: float = 2.2, max_chars_per_token_short: float = 1.7) -> DataFrame:
    """One row per row of df: its id, counts of the base kinds, base_spans, spans and n_dense.

    vocabulary: path of a tiktoken rank file, read on the driver and sent to the executors (under 1 MB). Spans are
    kind:start:end in code points, by start, then by the kind's place in KINDS. A dense run inside a base span is not
    reported again. Null and empty texts have no spans; a long text is scanned whole; repeated rows are separate rows.
    """
    with open(vocabulary, "rb") as f:
        ranks_file = f.read()

    def scan(batches):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines()) if a}
        encode = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text) if text else []
                dense = [d for d in dense_spans(text, encode, max_chars_per_token, max_chars_per_token_short) if not any(s <= d[0] and d[2] <= e for s, _, e in base)] if text else []
                kinds = [k for _, k, _ in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), joined(base), joined(base + dense), len(dense)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_spans", "spans", "n_dense"])

    rows = df.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))
    return rows.mapInArrow(scan, f"doc_id {sql_type(rows, 'doc_id')}, n_assign long, n_access long, n_hex long, base_spans string, spans string, n_dense long")


def with_digest(found: DataFrame) -> DataFrame:
    """The scan with the SHA-256 of its base spans in their place."""
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_dense")


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
