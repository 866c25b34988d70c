"""Secret scans: fixed patterns, and a battery of randomness tests for the rest.

A candidate is a run of 20 or more characters of `[A-Za-z0-9+/_=-]`. Its encoding is the
smallest alphabet that holds it. A run that no alphabet holds is split behind `=`, and
what still has separators of both base64 alphabets is split at those of either; the parts
of 20 or more characters are candidates. Three tests ask whether it could
be random in that encoding: chi-squared uniformity over the alphabet (exact up to
EXACT_CHARS characters), runs about the alphabet's middle (exact as well), and serial
correlation at lags 1 to LAGS; Fisher's method joins their p-values, and a candidate must
not be rejected at level RANDOM_LEVEL. Against the
null that it is ordinary text, the ratio of its probability under a model of
text (which character follows which, counted in all documents) to that under uniform
characters is a p-value (by Markov's inequality) that shrinks with length. The Benjamini-Hochberg rule with weights in proportion to
length holds a document's false discoveries at DISCOVERY_RATE. Candidates of one encoding
and length are tested together, so a text of many tokens takes linear time."""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, read_table, text_bytes

RANDOM_LEVEL = 0.005
DISCOVERY_RATE = 0.001
#: In the order of ties.
KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_HINTS = (b"passw", b"secret", b"token", b"api")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")
LEAST_CHARS = 20
_CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{%d,}" % LEAST_CHARS)
#: Parts between inner `=` signs, with the padding at their end; and parts of one base64 alphabet.
_PADDED = re.compile(rb"[^=]+=*")
_PARTS = (re.compile(rb"[A-Za-z0-9+/]+=*"), re.compile(rb"[A-Za-z0-9_-]+=*"))

#: Characters up to which chi-squared and runs are exact; beyond, there are more than one for each letter.
EXACT_CHARS = 64
LAGS = 4

_LOWER, _UPPER, _DIGITS = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
#: Alphabets from the smallest on; `=` at the end is padding and left out.
ENCODINGS = (
    ("decimal", _DIGITS), ("hex", _DIGITS + b"abcdef"), ("HEX", _DIGITS + b"ABCDEF"), ("base32", _UPPER + b"234567"), ("upper36", _DIGITS + _UPPER),
    ("lower36", _DIGITS + _LOWER), ("alnum62", _DIGITS + _UPPER + _LOWER), ("base64", _UPPER + _LOWER + _DIGITS + b"+/"), ("base64url", _UPPER + _LOWER + _DIGITS + b"-_"),
)


def encoding_of(token: bytes) -> tuple[str, bytes] | None:
    body = token.rstrip(b"=")
    return next(((name, letters) for name, letters in ENCODINGS if body and not body.translate(None, letters)), None)


def _normal_tail(z: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(x / math.sqrt(2)) for x in np.ravel(z)])


@functools.cache
def sum_squares(wanted: tuple[int, ...] = (16, 32, 36, 62, 64), most: int = EXACT_CHARS, cap: int = 720) -> dict[int, np.ndarray]:
    """For each number of cells P(n, s): the chance that n characters dealt out evenly to the
    cells have the sum of squared counts s; sums of `cap` and more are at `cap`. A cell is added at a time:
    of n characters in j + 1 cells the last one has c with a binomial chance."""
    n = np.arange(most + 1)
    p = np.zeros((most + 1, cap + 1))
    p[n, np.minimum(n * n, cap)] = 1.0  # one cell
    out = {}
    for j in range(1, max(wanted) + 1):
        if j in wanted:
            out[j] = p
        new = np.zeros_like(p)
        for c in range(most + 1):
            chance = np.array([math.comb(k, c) * (1 / (j + 1)) ** c * (j / (j + 1)) ** (k - c) for k in range(c, most + 1)])
            if chance.max() < 1e-18:
                break
            own, step = p[: most + 1 - c] * chance[:, None], min(c * c, cap)
            new[c:, step:] += own[:, : cap + 1 - step]
            new[c:, cap] += own[:, cap + 1 - step :].sum(1)
        p = new
    return out


@functools.cache
def _chi_tails(cells: int, n: int) -> np.ndarray:
    p = sum_squares()[cells][n]
    up, down = np.cumsum(p[::-1])[::-1], np.cumsum(p)
    return np.clip(2 * np.minimum(up, down), 0, 1)


def _chi_p(x: np.ndarray, cells: int) -> np.ndarray:
    """Two-sided p-values of the sum of squared counts of each row."""
    m, n = x.shape
    counts = np.bincount((np.arange(m)[:, None] * cells + x).ravel(), minlength=m * cells).reshape(m, cells)
    squares = (counts.astype(np.int64) ** 2).sum(1)
    if n <= EXACT_CHARS:
        tails = _chi_tails(cells, n)
        return tails[np.minimum(squares, len(tails) - 1)]
    shape = (cells - 1) / (2 * (1 - 1 / n))  # a gamma value with the same mean and variance, by its cube root
    chi = squares * cells / n - n
    z = (np.cbrt(chi / (cells - 1)) - 1 + 1 / (9 * shape)) * math.sqrt(9 * shape)
    return np.minimum(1, 2 * _normal_tail(np.abs(z)))


@functools.cache
def _runs_tails(a: int, b: int) -> list[float]:
    """Two-sided p-values by the number of runs of a high and b low characters."""
    whole, p = math.comb(a + b, a), [0.0] * (a + b + 2)
    for r in range(2, a + b + 1):
        h = r // 2
        ways = 2 * math.comb(a - 1, h - 1) * math.comb(b - 1, h - 1) if r % 2 == 0 else math.comb(a - 1, h) * math.comb(b - 1, h - 1) + math.comb(a - 1, h - 1) * math.comb(b - 1, h)
        p[r] = ways / whole
    return [min(1.0, 2 * min(sum(p[r:]), sum(p[: r + 1]))) for r in range(len(p))]


def _runs_p(x: np.ndarray, cells: int) -> np.ndarray:
    n, high = x.shape[1], x >= cells / 2
    a, runs = high.sum(1), 1 + (high[:, 1:] != high[:, :-1]).sum(1)
    out = np.full(len(x), 2.0 ** (1 - n))
    both = np.nonzero((a > 0) & (a < n))[0]
    if n <= EXACT_CHARS:
        out[both] = [_runs_tails(int(a[k]), n - int(a[k]))[runs[k]] for k in both]
    else:
        u, v = a[both].astype(float), n - a[both].astype(float)
        mean, var = 2 * u * v / n + 1, 2 * u * v * (2 * u * v - n) / (n * n * (n - 1.0))
        z = np.where(var > 0, np.abs(runs[both] - mean) / np.sqrt(np.maximum(var, 1e-9)), 0.0)
        out[both] = np.minimum(1, 2 * _normal_tail(z))
    return out


def _serial_p(x: np.ndarray) -> np.ndarray:
    """The least p-value of the lags' correlations, times their number. Mean as in permutations."""
    m, n = x.shape
    y = x - x.mean(1, keepdims=True)
    spread = (y * y).sum(1)
    out = np.ones(m)
    for lag in range(1, min(LAGS, n - 2) + 1):
        r = (y[:, lag:] * y[:, :-lag]).sum(1) / np.where(spread > 0, spread, 1)
        z = np.abs(r + (n - lag) / (n * (n - 1.0))) * n / math.sqrt(n - lag)
        out = np.minimum(out, LAGS * 2 * _normal_tail(z))
    return np.where(spread > 0, np.minimum(out, 1), 0.0)


def randomness(bodies: list[bytes], letters: bytes) -> np.ndarray:
    """For texts of one length, without padding, Fisher's p-values of the three tests under
    uniform, independent characters."""
    index = np.zeros(256, np.int64)
    index[np.frombuffer(letters, np.uint8)] = np.arange(len(letters))
    x = index[np.frombuffer(b"".join(bodies), np.uint8)].reshape(len(bodies), -1)
    if x.shape[1] < 3:
        return np.zeros(len(bodies))
    t = -sum(np.log(np.maximum(p, 1e-300)) for p in (_chi_p(x, len(letters)), _runs_p(x, len(letters)), _serial_p(x)))  # half of a chi-squared value with 6 degrees of freedom
    return np.exp(-t) * (1 + t + t * t / 2)


#: The model of ordinary text: characters that candidates are made of, and one place for all others.
_SYMBOLS = _UPPER + _LOWER + _DIGITS + b"+/_-"
_OTHER = len(_SYMBOLS)
_INDEX = np.full(256, _OTHER, np.int64)
_INDEX[list(_SYMBOLS)] = np.arange(_OTHER)


def pair_counts(raw: bytes) -> np.ndarray:
    """How often each symbol (or other character) is followed by each, at the text's start by another."""
    x = _INDEX[np.frombuffer(b" " + raw, np.uint8)]
    return np.bincount(x[:-1] * (_OTHER + 1) + x[1:], minlength=(_OTHER + 1) ** 2)


def text_model(counts: np.ndarray) -> np.ndarray:
    """Logarithms of the chance of each symbol behind each, one added to each count."""
    n = counts.reshape(_OTHER + 1, _OTHER + 1)[:, :_OTHER] + 1.0
    return np.log(n / n.sum(1, keepdims=True))


def learnt(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The model of ordinary text from all documents, read whole; each task sends one row for each pair
    that it has met."""

    def count(batches):
        import pyarrow as pa

        sums = np.zeros((_OTHER + 1) ** 2, np.int64)
        for batch in batches:
            for raw in text_bytes(batch):
                for at in range(0, len(raw), 1 << 20):
                    sums += pair_counts(raw[max(at - 1, 0) : at + (1 << 20)])
        at = np.nonzero(sums)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at], pa.int64())], ["pair", "n"])

    given = docs.select(F.col(text_col).alias("text"))
    rows = given.mapInArrow(lean(count), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()  # 67^2 rows at most
    counts = np.zeros((_OTHER + 1) ** 2)
    for r in rows:
        counts[r["pair"]] = r["n"]
    return text_model(counts)


def text_ps(bodies: list[bytes], sizes: np.ndarray, model: np.ndarray) -> np.ndarray:
    """p-values under the null that texts in alphabets of these sizes are ordinary text."""
    n = np.array([len(b) for b in bodies])
    x = _INDEX[np.frombuffer(b"".join(bodies), np.uint8)]
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    before = np.concatenate([[_OTHER], x[:-1]])
    before[starts] = _OTHER
    return np.exp(np.minimum(0.0, np.add.reduceat(model[before, x], starts) + n * np.log(sizes)))


def discovered(tokens: list[bytes], model: np.ndarray) -> list[bool]:
    """Which of one text's candidates are declared random."""
    n = len(tokens)
    weight = np.array([len(t) for t in tokens], float)
    weight *= n / max(weight.sum(), 1)
    found = [(k, t.rstrip(b"="), *e) for k, t in enumerate(tokens) if (e := encoding_of(t))]
    if not found:
        return [False] * n
    q, passes = np.ones(n), np.zeros(n, bool)
    at = np.array([k for k, *_ in found])
    q[at] = np.minimum(1.0, text_ps([b for _, b, *_ in found], np.array([len(letters) for *_, letters in found]), model) / weight[at])
    order = np.argsort(q, kind="stable")
    ok = np.nonzero(q[order] <= DISCOVERY_RATE * np.arange(1, n + 1) / max(n, 1))[0]
    if not len(ok):
        return [False] * n
    bound = q[order[ok[-1]]]
    alike: dict[tuple[bytes, int], list[tuple[int, bytes]]] = {}
    for k, body, name, letters in found:
        if name != "decimal" and q[k] <= bound:
            alike.setdefault((letters, len(body)), []).append((k, body))
    for (letters, _), own in alike.items():
        passes[[k for k, _ in own]] = randomness([b for _, b in own], letters) >= RANDOM_LEVEL
    return passes.tolist()


def candidates(raw: bytes) -> list[tuple[int, int]]:
    """(start, end) of what is tested; parts of a run may overlap."""
    out: list[tuple[int, int]] = []
    for m in _CANDIDATE.finditer(raw):
        if encoding_of(m[0]):
            out.append(m.span())
            continue
        for part in _PADDED.finditer(raw, *m.span()):
            if len(part[0]) < LEAST_CHARS:
                continue
            if encoding_of(part[0]):
                out.append(part.span())
            else:
                out += [x.span() for form in _PARTS for x in form.finditer(raw, *part.span()) if len(x[0]) >= LEAST_CHARS]
    return out


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping spans become one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def spans_of(raw: bytes, model: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points by start, then kind."""
    out: list[tuple[int, int, str]] = []
    low = raw.lower()
    if any(h in low for h in _HINTS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in raw:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(raw) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(raw)]
    taken = _united([(s, e) for s, e, _ in out])
    begins = [s for s, _ in taken]

    def free(s: int, e: int) -> bool:
        k = bisect.bisect_left(begins, e) - 1  # the last one that begins before e
        return k < 0 or taken[k][1] <= s

    found = [x for x in candidates(raw) if free(*x)]
    if found:
        random = _united([x for x, yes in zip(found, discovered([raw[s:e] for s, e in found], model)) if yes])
        out += [(s, e, "random") for s, e in random]
    if not out:
        return out
    if not raw.isascii():
        a = np.frombuffer(raw, np.uint8)
        before = np.concatenate([[0], np.cumsum((a & 0xC0) != 0x80)])
        out = [(int(before[s]), int(before[e]), k) for s, e, k in out]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def redacted(text: str, spans) -> str:
    """The text with each stretch of spans replaced by [secret]."""
    out, at = [], 0
    for s, e, _ in spans:
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], "[secret]"]
        at = e
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, model: np.ndarray | None = None) -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, n_random, base_sha256,
    spans and, if with_text, redacted (the text with secrets replaced; null if it is null).

    model is that of ordinary text; without one it is learnt from docs first. No shuffle but
    for its counts; only id and text are read. Null and empty texts have no spans, and
    base_sha256 is then the digest of nothing. Repeated rows and null ids come back as
    they are; an empty table gives an empty result; long texts are searched whole.
    Spans of different kinds may overlap; within a kind they don't."""
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model = learnt(docs, text_col) if model is None else model

    names = ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "redacted"][: 7 + with_text]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            raws = batch.column("text").cast(pa.binary()).to_pylist()
            cols: list[list] = [[] for _ in range(6 + with_text)]
            for raw in raws:
                spans = spans_of(raw or b"", model)
                for col, kind in zip(cols, KINDS):
                    col.append(sum(x[2] == kind for x in spans))
                cols[4].append(hashlib.sha256(joined(x for x in spans if x[2] != "random").encode()).hexdigest())
                cols[5].append(joined(spans))
                if with_text:
                    cols[6].append(None if raw is None else redacted(raw.decode("utf-8", "replace"), spans))
            kinds = [pa.int64()] * 4 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    out = kept.mapInArrow(lean(run), f"id {kept.schema['id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string" + ", redacted string" * with_text)
    return out.withColumnRenamed("id", id_col)


def redacted_rows(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", model: np.ndarray | None = None) -> DataFrame:
    """The rows of docs, with all their columns, secrets in the text replaced; where a text
    changes, length_col (if docs has it) gets its new length. model as in scan(). Null texts stay
    null, empty ones empty; texts are searched whole; repeated rows and null ids stay as they
    are; an empty table stays empty; other columns, whatever their names, pass through."""
    if length_col not in docs.columns:
        length_col = None
    model = learnt(docs, text_col) if model is None else model

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            names, cols = batch.schema.names, list(batch.columns)
            raws = batch.column(text_col).cast(pa.binary()).to_pylist()
            texts, changed = [], {}
            for k, raw in enumerate(raws):
                text = None if raw is None else raw.decode("utf-8", "replace")
                if spans := spans_of(raw or b"", model):
                    text = redacted(text, spans)
                    changed[k] = len(text)
                texts.append(text)
            if changed:
                at = names.index(text_col)
                cols[at] = pa.array(texts, cols[at].type)
                if length_col:
                    at = names.index(length_col)
                    cols[at] = pa.array([changed.get(k, n) for k, n in enumerate(cols[at].to_pylist())], cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(lean(run), docs.schema)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")
