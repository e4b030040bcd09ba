"""Secret scans: fixed patterns, and a randomness test battery for tokens that no pattern knows.

A candidate token is a run of 16 or more characters of the base64 and base64url alphabets in which a letter stands next to
a digit. Its encoding is inferred from the characters it uses (hex, base32, base36, base64); as numbers of that alphabet
its characters are tested for uniformity (chi-squared over as many equal groups as the length can fill), for runs above and
below the middle, and for lag-1 serial correlation; Fisher's method joins the three p-values.

Random tokens have p uniform in 0 to 1, text and structured names crowd near 0. Per encoding and length class the whole
corpus's p-values are counted; those above one half show how many tokens are random, so the share of non-random ones
above any threshold can be estimated, and the least threshold that keeps this false-discovery share below `rate` is taken.
Short tokens, whose tests have little power, thereby get stricter thresholds. Length classes with few tokens are judged
together with the rest of their encoding.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonnage.llm.common import bound, digest

# fixed patterns
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_MIXED = re.compile(r"[0-9][A-Za-z]|[A-Za-z][0-9]")
#: Texts that none of these match hold neither a base match nor a candidate.
_ANY = r"""(?i:password|passwd|secret|token|api_?key)["']? *[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|[0-9][A-Za-z]|[A-Za-z][0-9]"""

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = {"hex": _DIGITS + "abcdef", "HEX": _DIGITS + "ABCDEF", "base32": _UPPER + "234567", "base36": _LOWER + _DIGITS, "base64": _UPPER + _LOWER + _DIGITS + "+/", "base64url": _UPPER + _LOWER + _DIGITS + "-_"}
_VALUES = {name: {c: k for k, c in enumerate(a)} for name, a in ALPHABETS.items()}

#: Cells of the p-value counts, share of false discoveries, least p of any discovery, tokens a length class needs.
CELLS, RATE, LEAST_P, ENOUGH = 200, 0.1, 0.005, 30
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def encoding(token: str) -> str | None:
    """The narrowest alphabet that holds the token; base64 kinds need letters of both cases and digits."""
    used = set(token)
    if not (used & set(_DIGITS)) or used <= set(_DIGITS):
        return None
    for name, values in _VALUES.items():
        if used <= values.keys() and (not name.startswith("base64") or (used & set(_LOWER) and used & set(_UPPER))):
            return name
    return None


def _normal_tail(z: float) -> float:
    """P(|Z| > |z|)."""
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_tail(x: float, freedom: int) -> float:
    """P(chi-squared > x) by the cube-root normal approximation, exact series for even degrees of freedom."""
    if x <= 0:
        return 1.0
    if freedom % 2 == 0:
        term = total = math.exp(-x / 2)
        for k in range(1, freedom // 2):
            term *= x / 2 / k
            total += term
        return min(1.0, total)
    z = ((x / freedom) ** (1 / 3) - (1 - 2 / (9 * freedom))) / math.sqrt(2 / (9 * freedom))
    return min(1.0, max(1e-300, 0.5 * math.erfc(z / math.sqrt(2))))


def randomness(token: str, name: str) -> float:
    """Joint p-value of the battery under a uniformly random token of the alphabet."""
    values, size = np.array([_VALUES[name][c] for c in token], np.float64), len(ALPHABETS[name])
    n = len(values)
    groups = max(2, min(size, n // 5))
    share = np.bincount(np.arange(size) * groups // size, minlength=groups) / size
    seen = np.bincount((values.astype(int) * groups) // size, minlength=groups)
    uniform = _chi_tail(float(((seen - n * share) ** 2 / (n * share)).sum()), groups - 1)
    high = values >= size / 2
    n1, n2 = int(high.sum()), int(n - high.sum())
    if n1 and n2:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 1 + 2 * n1 * n2 / n
        spread = (mean - 1) * (mean - 2) / (n - 1)
        run_p = _normal_tail((runs - mean) / math.sqrt(spread)) if spread > 0 else 1.0
    else:
        run_p = 2.0 ** (1 - n)
    centred = values - values.mean()
    square = float((centred**2).sum())
    serial = _normal_tail(float((centred[1:] * centred[:-1]).sum()) / square * math.sqrt(n)) if square else 0.0
    statistic = -2 * sum(math.log(max(p, 1e-300)) for p in (uniform, run_p, serial))
    return _chi_tail(statistic, 6)


def candidates(text: str) -> Iterator[tuple[int, int, str, int, float]]:
    """(start, end, encoding, length class, p) of the tokens that look encoded; padding is no part of a token's values."""
    for m in _TOKEN.finditer(text):
        token = m[0].rstrip("=")
        if _MIXED.search(token) and (name := encoding(token)):
            yield m.start(), m.end(), name, min(12, int(2 * math.log2(len(token) / 16))), randomness(token, name)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns: leftmost, non-overlapping per kind, failing matches dropped."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return out


Limits = dict[tuple[str, int], float]


def limits(counts: Counter, rate: float = RATE) -> Limits:
    """Least p of a discovery per (encoding, length class) from counts of (encoding, length class, cell)."""
    cells: dict[tuple[str, int], np.ndarray] = {}
    for (name, length, cell), n in counts.items():
        for key in ((name, length), (name, -1)):
            cells.setdefault(key, np.zeros(CELLS))[cell] += n
    out = {}
    for (name, length), seen in cells.items():
        judged = seen if length < 0 or seen.sum() >= ENOUGH else cells[(name, -1)]
        random = 2 * judged[CELLS // 2 :].sum()
        above = judged[::-1].cumsum()[::-1]  # tokens with p in this cell or higher
        true = random * (1 - np.arange(CELLS) / CELLS)
        with np.errstate(divide="ignore", invalid="ignore"):
            false = np.where(above > 0, np.maximum(above - true, 0) / above, 0.0)
        good = np.flatnonzero((false <= rate) & (above > 0) & (np.arange(CELLS) / CELLS >= LEAST_P))
        out[(name, length)] = good[0] / CELLS if len(good) else math.inf
    return out


def measure(documents: DataFrame, rate: float = RATE) -> Limits:
    """Thresholds from the p-values of all candidate tokens of all documents; what is collected has a fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in _worth(batch["text"])[1]:
                seen.update((name, length, min(CELLS - 1, int(p * CELLS))) for _, _, name, length, p in candidates(text))
        if seen:
            names, lengths, cells = zip(*seen, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(lengths, pa.int64()), pa.array(cells, pa.int64()), pa.array(list(seen.values()), pa.int64())], ["name", "length", "cell", "n"])

    counted = bound(documents, text="text").mapInArrow(count, "name string, length long, cell long, n long")
    rows = counted.groupBy("name", "length", "cell").agg(F.sum("n").alias("n")).collect()
    return limits(Counter({(r.name, r.length, r.cell): r.n for r in rows}), rate)


def _worth(texts: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Positions and texts of those that may hold anything."""
    at = np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, _ANY), False).to_numpy(zero_copy_only=False))
    return at, texts.take(pa.array(at)).to_pylist()


def all_spans(text: str, found: Limits) -> list[tuple[str, int, int]]:
    """Base spans, and random tokens that overlap none of them, by start, then kind as listed."""
    out = base_spans(text)
    taken = [(s, e) for _, s, e in out]
    for start, end, name, length, p in candidates(text):
        if p >= found.get((name, length), math.inf) and not any(s < end and start < e for s, e in taken):
            out.append(("random", start, end))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def scan(documents: DataFrame, found: Limits, column: str = "__secrets") -> DataFrame:
    """`documents` with an array column of spans (kind, start, end) in code points, end exclusive; null is the empty text."""

    @F.arrow_udf(SPANS)
    def search(texts: pa.Array) -> pa.Array:
        at, some = _worth(texts)
        spans: list = [()] * len(texts)
        for k, text in zip(at.tolist(), some, strict=True):
            spans[k] = [{"kind": kind, "start": s, "end": e} for kind, s, e in all_spans(text, found)]
        return pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))

    return documents.withColumn(column, search(F.col("text")))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def secrets(documents: DataFrame, rate: float = RATE) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    Repeated rows get equal results; an empty table gives an empty result; texts are scanned whole, however long."""
    rows = scan(bound(documents, doc_id="doc_id", text="text"), measure(documents, rate))
    spans = F.col("__secrets")
    kinds = F.transform(spans, lambda x: x["kind"])
    numbers = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("bigint").alias(f"n_{kind}") for kind in KINDS]
    base = F.filter(spans, lambda x: x["kind"] != "random")
    *fixed, more = numbers
    return rows.select("doc_id", *fixed, digest(_listed(base)).alias("base_sha256"), _listed(spans).alias("spans"), more)


def redact(documents: DataFrame, rate: float = RATE, mark: str = "[SECRET]") -> DataFrame:
    """The documents, columns unchanged, with each secret (overlapping ones as one) replaced by `mark` in `text`.

    Where a text changed and the table has `n_chars`, that column gets the new length."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, found in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            parts, at = [], 0
            for x in found or ():
                if x["start"] >= at:
                    parts += [text[at : x["start"]], mark]
                at = max(at, x["end"])
            out.append(text if not found else "".join(parts) + text[at:])
        return pa.array(out, pa.string())

    rows = scan(documents, measure(documents, rate))
    some = F.size("__secrets") > 0
    columns = {}
    if "n_chars" in documents.columns:
        kind = dict(documents.dtypes)["n_chars"]
        columns["n_chars"] = F.when(some, F.length("text").cast(kind)).otherwise(F.col("n_chars"))
    rows = rows.withColumn("text", F.when(some, cut(F.col("text"), F.col("__secrets"))).otherwise(F.col("text")))
    return rows.withColumns(columns).select([F.col(f"`{c}`") for c in documents.columns])
