"""Secret scans: fixed patterns, and sliding-window Shannon entropy.

Fixed patterns give the base spans. Beyond them, every run of token characters
of at least ``WINDOW`` characters is a candidate, and so is every part of it
that is hex, or letters and digits, alone; the character class of each (hex,
letters and digits, base64) sets the entropy a window must reach. The window
slides one character at a time over counts that are updated incrementally;
overlapping windows that reach the threshold join into one span. Candidates
matched by the allow list are suppressed; what a base span covers of an entropy
span is left to the base span, the rest on both sides stays.

Null text: empty, no spans. One output row per input row (repeated rows stay);
spans of one start come in the order of the kinds; very long texts are scanned
whole. An empty table gives an empty result; other columns play no part
(``redact`` passes them on).
Rows are scanned where they lie: no shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import chunks, raw, read, texts_of

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HINT = r"(?i)passw|secret|token|api_?key|AKIA"

#: Characters a window holds.
WINDOW = 20
#: Bits a character that a window must reach, by class; a run without a digit
#: or of one letter case only and no digit is no candidate of any class.
LEAST_BITS = {"hex": 2.9, "alnum": 3.5, "base64": 3.7}
#: Candidates that are no secrets: words joined by punctuation, plain words or
#: numbers, UUIDs, dates and versions.
ALLOW = (
    r"(?:[A-Za-z]+[-_/=+])*[A-Za-z]+",
    r"[0-9+/_=-]+",
    r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}",
    r"(?:[A-Za-z]+[-_/=+])*[A-Za-z]+[0-9]{1,4}",
)
#: Parts of a run that are of one class, though the run is not.
PARTS = tuple(re.compile(f"[{x}]{{{WINDOW},}}") for x in ("0-9a-f", "0-9A-F", "0-9A-Za-z"))
SPANS = "array<struct<kind: string, start: int, end: int>>"

_HEX = np.zeros(256, bool)
_HEX[[*b"0123456789abcdef"]] = True
_TOKEN = np.zeros(256, bool)
_TOKEN[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True


def runs(data: np.ndarray, at: np.ndarray, table: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the longest runs, within a text, of bytes in the table."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = table[data]
    change = inside[1:] != inside[:-1]
    edges = np.flatnonzero(change)
    start, end = edges[::2], edges[1::2]
    long = end - start >= least
    start, end = start[long], end[long]
    # a run over the border of two texts is two runs
    cut = np.searchsorted(at, start, side="right") != np.searchsorted(at, end, side="left")
    if cut.any():
        more = [(max(a, at[i]), min(b, at[i + 1])) for a, b in zip(start[cut], end[cut])
                for i in range(np.searchsorted(at, a, side="right") - 1, np.searchsorted(at, b, side="left"))]
        more = [(a, b) for a, b in more if b - a >= least]
        pairs = sorted([*zip(start[~cut], end[~cut]), *more])
        start, end = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
    return start, end


def char_class(run: str) -> str | None:
    """hex, alnum or base64; None where letters of one case or no digit show no secret."""
    if not any(c.isdigit() for c in run):
        return None
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", run):
        return "hex"
    return "alnum" if run.isalnum() else "base64"


def entropy_spans(run: str, window: int = WINDOW, least_bits: dict[str, float] = LEAST_BITS) -> list[tuple[int, int]]:
    """Joined windows of the run whose entropy reaches its class's threshold."""
    kind = char_class(run)
    if kind is None or len(run) < window:
        return []
    # H = log2(w) - sum(c log2 c) / w; the sum changes in two terms a step
    weight = [c * math.log2(c) if c else 0.0 for c in range(window + 2)]
    counts = Counter(run[:window])
    total = sum(weight[c] for c in counts.values())
    most = window * (math.log2(window) - least_bits[kind]) + 1e-9
    out: list[tuple[int, int]] = []
    for i in range(len(run) - window + 1):
        if i:
            c = counts[run[i - 1]]
            total += weight[c - 1] - weight[c]
            counts[run[i - 1]] = c - 1
            c = counts[run[i + window - 1]]
            total += weight[c + 1] - weight[c]
            counts[run[i + window - 1]] = c + 1
        if total <= most:
            if out and i <= out[-1][1]:
                out[-1] = (out[-1][0], i + window)
            else:
                out.append((i, i + window))
    return out


def run_spans(run: str, allowed: re.Pattern | None = None) -> list[tuple[int, int]]:
    """Joined spans of the run as a whole and of each part of one class in it,
    judged by that class, unless the part is on the allow list."""
    parts = {(m.start(), m.end()) for p in PARTS for m in p.finditer(run)} - {(0, len(run))}
    spans = entropy_spans(run) + [(a + x, a + y) for a, b in parts if not (allowed and allowed.fullmatch(run[a:b])) for x, y in entropy_spans(run[a:b])]
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def outside(start: int, end: int, spans: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the spans leave over of one from start to end."""
    out = []
    for a, b in sorted(spans):
        if a < end and b > start:
            if a > start:
                out.append((start, a))
            start = max(start, b)
    return [*out, (start, end)] if start < end else out


def scan_chunk(texts: pa.Array, allow: Sequence[str] = ALLOW) -> list[list[tuple[str, int, int]]]:
    """The spans (kind, start, end in code points) of each text, by start and kind."""
    allowed = re.compile("|".join(f"(?:{x})" for x in allow)) if allow else None
    found: list[list[tuple[str, int, int]]] = [[] for _ in range(len(texts))]
    for i in np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, HINT), False).to_numpy(zero_copy_only=False)):
        text = texts[i].as_py()
        found[i] += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        found[i] += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    data, at = raw(texts)

    def place(a: int, b: int) -> tuple[int, int, int]:
        i = int(np.searchsorted(at, a, side="right")) - 1
        before = int(np.count_nonzero((data[at[i] : a] & 0xC0) != 0x80))
        return i, before, before + int(b - a)

    for a, b in zip(*runs(data, at, _HEX, 32)):
        i, start, end = place(a, b)
        found[i].append(("hex", start, end))
    base = [list(x) for x in found]
    for a, b in zip(*runs(data, at, _TOKEN, WINDOW)):
        run = data[a:b].tobytes().decode()
        spans = [] if allowed and allowed.fullmatch(run) else run_spans(run, allowed)
        if spans:
            i, start, _ = place(a, b)
            rest = [r for x, y in spans for r in outside(x, y, [(s - start, e - start) for _, s, e in base[i]])]
            found[i] += [("entropy", start + x, start + y) for x, y in rest if any(c.isalnum() for c in run[x:y])]
    for x in found:
        x.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return found


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and all its spans, by start and then kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in chunks(batches):
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in scan_chunk(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return texts_of(docs).mapInArrow(run, f"doc_id long, spans {SPANS}")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every span in ``text`` replaced by the
    mark (overlapping spans by one), and ``n_chars``, where there is one, the
    new text's length."""
    names = docs.columns
    t = names.index("text")

    def hide(text: str, spans: list[tuple[str, int, int]]) -> str:
        out, done = [], 0
        for _, a, b in spans:
            if a >= done:
                out += [text[done:a], mark]
            done = max(done, b)
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = batch.column(t)
            spans = scan_chunk(texts)
            if any(spans):
                fixed = [hide(x, s) if s else x for x, s in zip(texts.to_pylist(), spans)]
                batch = pa.RecordBatch.from_arrays([pa.array(fixed, texts.type) if i == t else batch.column(i) for i in range(len(names))], schema=batch.schema)
            yield batch

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(written(F.filter("spans", lambda s: s["kind"] != "entropy")), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"), n("entropy").alias("n_entropy"),
    )
