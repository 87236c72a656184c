"""Secret scan: three patterns, and strings that a subword vocabulary cannot shorten.

Words and names cost few tokens for their length, random strings many.  What the patterns leave
of a run of letters, digits and ``+/_=.-`` is tokenized whole, with ``-`` and ``_`` in it, and
else by its parts.  One with few characters to a token is exposed: fewer than ``MAX_RATIO`` in a
part that mixes letters and digits, and fewer than one in a hundred compounds of words has where
there are letters alone (``LETTERS``, by length) or signs that join words (``JOINED``).  Known
digests (hex of the length of MD5, SHA-1, SHA-2 or a commit) and identifiers (UUID, number, date,
version) are not.  Spans of the patterns stay.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.common import arrow_rows, column

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the vocabulary.
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
#: The patterns of the three kinds, and the least lengths of what they match.
ASSIGN = (
    r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "random")

MIN_CHARS = 16
MAX_RATIO = 2.0
#: Characters to a token that 99 of 100 compounds of words have, from a length on
#: (joined at random from the words of the given documents, 3,000 of each length and spelling).
LETTERS = ((32, 1.76), (22, 1.73), (0, 1.69))
#: The same with - or _ between words; where digits are among them, what grouped keys have at most.
JOINED, JOINED_WITH_DIGITS = 1.55, 1.6
#: Of letters and digits, the share of letters below which a joined run is a number or a date.
LEAST_LETTERS = 0.3
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
WORDS_OF_ASSIGN = ("password", "passwd", "secret", "token", "apikey", "api_key")
UUID = r"[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"
IDENTIFIER = UUID + r"|[\d.:/+_=-]+"  # or number, date, version
NAME = r"[A-Za-z]+[._-]?\d{0,4}"
KNOWN = re.compile(
    rf"(?<![0-9A-Za-z])(?:{UUID}|"
    + "|".join(f"[0-9a-f]{{{n}}}|[0-9A-F]{{{n}}}" for n in DIGEST_LENGTHS)
    + r")(?![0-9A-Za-z])"
)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the three patterns, in code points."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS_OF_ASSIGN):
        out += [
            (m.start(), m.end(), "assign")
            for m in re.finditer(ASSIGN, text)
            if len(m[1]) >= LEAST["assign"]
        ]
    if "AKIA" in text:
        out += [
            (m.start(), m.end(), "access")
            for m in re.finditer(ACCESS, text)
            if len(m[0]) >= LEAST["access"]
        ]
    # a run of fewer characters fails, and so does every run inside it
    out += [(m.start(), m.end(), "hex") for m in re.finditer(HEX[:-1] + "{%d,}" % LEAST["hex"], text)]
    return out


def looks_random(part: str, tokens: int, max_ratio: float) -> bool:
    letters, digits = sum(map(str.isalpha, part)), sum(map(str.isdigit, part))
    if not letters or re.fullmatch(IDENTIFIER, part) or KNOWN.fullmatch(part):
        return False
    if re.search("[_-]", part):
        limit = JOINED_WITH_DIGITS if digits else JOINED
        if letters < LEAST_LETTERS * (letters + digits):
            return False
    elif re.fullmatch(NAME, part):
        limit = next(x for n, x in LETTERS if len(part) >= n)
    else:
        limit = max_ratio if digits else JOINED
    return len(part) < min(limit, max_ratio) * tokens


def uncovered(start: int, end: int, spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What ``spans`` (sorted) leave of [start, end)."""
    for s, e in spans:
        if s > start:
            yield start, min(s, end)
        start = max(start, e)
        if start >= end:
            return
    yield start, end


def random_spans(
    text: str, known: list[tuple[int, int, str]], encoding, min_chars: int, max_ratio: float
) -> list[tuple[int, int, str]]:
    base = sorted((s, e) for s, e, _ in known)
    starts, reach = [s for s, _ in base], list(accumulate((e for _, e in base), max))
    out = []

    def find(pattern: str, start: int, end: int) -> None:
        for m in re.finditer(pattern + "{%d,}" % min_chars, text[start:end]):
            if looks_random(m[0], len(encoding.encode_ordinary(m[0])), max_ratio):
                out.append((start + m.start(), start + m.end(), "random"))

    for m in re.finditer(r"[A-Za-z0-9+/_=.-]{%d,}" % min_chars, text):
        if re.fullmatch(IDENTIFIER, m[0]):
            continue
        touching = base[bisect_right(reach, m.start()) : bisect_left(starts, m.end())]
        cut = [(m.start() + k.start(), m.start() + k.end()) for k in KNOWN.finditer(m[0])]
        for start, end in uncovered(m.start(), m.end(), sorted(touching + cut)):
            n = len(out)
            find("[A-Za-z0-9_-]", start, end)
            for s, e in list(uncovered(start, end, [x[:2] for x in out[n:]])):
                find("[A-Za-z0-9+/=]", s, e)
    return sorted(out)


def joined(spans: list[tuple[int, int, str]]) -> str:
    rank = {k: i for i, k in enumerate(KINDS)}
    order = sorted(spans, key=lambda x: (x[0], rank[x[2]]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in order)


def _scanner(ranks, min_chars: int, max_ratio: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding(
            "secrets", pat_str=SPLIT, mergeable_ranks=ranks.value, special_tokens={}
        )
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for batch in batches:
            base, added = [], []
            for text in batch.column("text").to_pylist():
                found = base_spans(text or "")
                base.append(found)
                added.append(random_spans(text or "", found, encoding, min_chars, max_ratio))
            columns = [
                batch.column("doc_id"),
                pa.array([_rows(x) for x in base], kind),
                pa.array([_rows(x) for x in added], kind),
                pa.array([joined(x) for x in base], pa.string()),
                pa.array([joined(x + y) for x, y in zip(base, added)], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(
                columns, names=["doc_id", "base", "added", "base_list", "spans"]
            )

    return scan


def _rows(spans: list[tuple[int, int, str]]) -> list[dict]:
    return [{"start": s, "end": e, "kind": k} for s, e, k in sorted(spans)]


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    min_chars: int = MIN_CHARS,
    max_ratio: float = MAX_RATIO,
) -> DataFrame:
    """Per row: doc_id, base and added (spans with start, end, kind), base_list and spans (text).

    Places are code points, ends exclusive.  Null texts count as empty and have no spans;
    repeated rows, null ids and further columns change nothing.  The vocabulary (about 1 MB) is
    read where the driver runs and sent to the tasks.
    """
    spark: SparkSession = docs.sparkSession
    arrow_rows(spark)
    ranks = spark.sparkContext.broadcast(load_ranks(vocabulary))
    rows = docs.select(column(id_col).alias("doc_id"), column(text_col).cast("string").alias("text"))
    span = "array<struct<start:int,end:int,kind:string>>"
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        _scanner(ranks, min_chars, max_ratio),
        f"doc_id {kind}, base {span}, added {span}, base_list string, spans string",
    )
