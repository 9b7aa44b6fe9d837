"""Secrets in texts: fixed patterns, and strings that a subword vocabulary spells badly.

Prose costs few tokens; random strings cost one for every two signs or so. A run
of key-like signs whose characters per token are below a bound is reported, once
digests of known lengths, UUIDs and plain numbers are out. Identifiers made of
words have many characters a token and need no rule of their own.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import DataFrame

from tandem.llm.words import slices

#: Fixed values of the base kinds, in the order of their listing.
KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

#: Least signs of a run that is scored, with a digit and without.
LEAST, LEAST_LETTERS = 12, 16
_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_HEX_ANY = re.compile(r"[0-9A-Fa-f]+")
_DIGESTS = frozenset((32, 40, 56, 64, 96, 128))
_LETTER, _DIGIT = re.compile(r"[A-Za-z]"), re.compile(r"[0-9]")

#: Characters per token below which a run counts as random.
CHARS_A_TOKEN = 2.2

_ENCODINGS: dict = {}


def encoding(path: str):
    """This process's byte-level encoding for a file of ranks."""
    if path not in _ENCODINGS:
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODINGS[path] = tiktoken.Encoding(
            "ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
    return _ENCODINGS[path]


def is_known(run: str) -> bool:
    """A digest of a usual length, a UUID, or signs without a letter."""
    if _UUID.fullmatch(run) or len(run) in _DIGESTS and _HEX_ANY.fullmatch(run):
        return True
    return not _LETTER.search(run)


def is_scored(run: str) -> bool:
    return len(run) >= (LEAST if _DIGIT.search(run) else LEAST_LETTERS) and not is_known(run)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the base kinds."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def outside(start: int, end: int, taken: list[tuple[int, int, int]], at: int = 0) -> Iterator[tuple[int, int]]:
    """The parts of a span that meet none of the sorted spans from place ``at``."""
    for a, _, b in islice(taken, at, None):
        if a >= end:
            break
        if b > start:
            if a > start:
                yield start, a
            start = b
    if start < end:
        yield start, end


def random_spans(
    text: str, path: str, bound: float = CHARS_A_TOKEN, taken: list[tuple[int, int, int]] | None = None
) -> list[tuple[int, int, int]]:
    """Spans of random runs; a run is cut at the sorted spans that are ``taken``, and each part scored."""
    taken, at, runs = taken or [], 0, []
    reach = list(accumulate((b for _, _, b in taken), max))
    for m in _RUN.finditer(text):
        if is_known(m[0]):
            continue
        while at < len(taken) and reach[at] <= m.start():
            at += 1
        runs += [(a, b) for a, b in outside(m.start(), m.end(), taken, at) if is_scored(text[a:b])]
    if not runs:
        return []
    tokens = encoding(path).encode_ordinary_batch([text[a:b] for a, b in runs], num_threads=1)
    return [(a, 3, b) for (a, b), ids in zip(runs, tokens, strict=True) if b - a < bound * len(ids)]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def secret_spans(docs: DataFrame, ranks: str, bound: float = CHARS_A_TOKEN) -> DataFrame:
    """Secrets of every whole text, as code-point spans with the end left out.

    Reads ``doc_id`` and ``text``, ignores other columns. Returns per row doc_id,
    base and spans (arrays of (kind, start, end, value), by start, then kind),
    base without and spans with the runs found by token efficiency. What a run
    shares with a base span is that span's, the rest is scored. Null and empty texts have none; repeated
    rows and rows without an id are scanned each for itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            base, every = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                own = base_spans(text)
                free = random_spans(text, ranks, bound, own)
                for out, spans in ((base, own), (every, sorted(own + free))):
                    out.append(
                        [{"kind": KINDS[k], "start": s, "end": e, "value": text[s:e]} for s, k, e in spans]
                    )
            span = pa.list_(
                pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, span), pa.array(every, span)], ["doc_id", "base", "spans"]
            )

    span = "array<struct<kind: string, start: bigint, end: bigint, value: string>>"
    return docs.selectExpr("CAST(doc_id AS BIGINT) doc_id", "CAST(text AS STRING) text").mapInArrow(
        run, f"doc_id long, base {span}, spans {span}"
    )


def span_digest(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
