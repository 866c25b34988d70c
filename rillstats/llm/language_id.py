"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of up to DEPTH bytes is counted on a bounded
sample of labelled texts and frozen. A context node of a tree, seen n times with d different
next bytes, gives a byte seen c times c / (n + d) and the escape to the next shorter
context d / (n + d) (method C); the shorter context leaves out the bytes that the longer one
had, and below the empty context all bytes left are alike. The order is variable: coding
starts at the longest context that the tree holds. Trees are sparse: of each language the
EDGES most frequent (context, byte) edges stay, and since an edge's shorter forms are at
least as frequent, what stays is a tree again, whose code lengths are exact.

Trees are sorted arrays. A text's code length is a sum over its (context, byte) windows;
the different windows of some texts are looked up together, once for each language."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, hash_share, lean, read_table, stored, text_bytes, trim

#: Labelled texts per language, about, that the statistics are learnt from.
SAMPLE_DOCS = 4_000
#: Bytes of the longest context.
DEPTH = 5
#: Size of the trees: edges of a language, and of all languages, which share them alike.
EDGES, ALL_EDGES = 100_000, 4_000_000
#: Code lengths are kept as whole numbers of this part of a bit, so sums don't depend on their order.
PARTS_OF_BIT = 4096
#: A text counts as rejected below this score or above these bits a byte.
LEAST_SCORE, MOST_BITS = 0.5, 8.0
UNKNOWN = "und"
#: Bytes coded at a time.
CHUNK = 1 << 20
_LETTER = re.compile(r"[^\W\d_]")
#: A word with a digit; no byte is gone through twice.
_NUMBERED = re.compile(rb"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+")
#: Bytes before a text's first.
_LEAD = b"\n" * DEPTH


def prepared(raw: bytes) -> bytes:
    """The text in lower case, each word with a digit as 0: numbers, keys and addresses say
    nothing of the language."""
    return _NUMBERED.sub(b"0", raw.decode("utf-8", "replace").lower().encode("utf-8", "replace"))


def has_letter(raw: bytes) -> bool:
    return bool(_LETTER.search(raw.decode("utf-8", "replace")))


def window_codes(raw: bytes) -> np.ndarray:
    """For each byte behind the first DEPTH its window: the context, its latest byte first, then the byte."""
    a = np.frombuffer(raw, np.uint8).astype(np.int64)
    n = max(len(a) - DEPTH, 0)
    out = a[DEPTH:].copy()
    for k in range(DEPTH):
        out |= a[k : k + n] << (8 * (k + 1))
    return out


def _at_order(codes: np.ndarray, k: int) -> np.ndarray:
    """The edges (context of k bytes, byte) of windows."""
    return ((codes >> (8 * (DEPTH - k + 1))) << 8) | (codes & 255)


def counted(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Different windows of whole texts, and how often each stands there."""
    return np.unique(np.concatenate([np.empty(0, np.int64), *(window_codes(_LEAD + t) for t in texts)]), return_counts=True)


class Tree:
    """One language's frozen statistics. edges: for each order from 0 on the sorted edges and their counts."""

    def __init__(self, edges: list[tuple[np.ndarray, np.ndarray]]):
        self.orders = []
        before = None
        for keys, n in edges:
            n = n.astype(float)
            nodes, first = np.unique(keys >> 8, return_index=True)
            total = np.add.reduceat(n, first) if len(first) else n
            kinds = np.diff(np.append(first, len(keys))).astype(float)
            level = {"edges": keys, "log_n": np.log2(n), "n": n, "nodes": nodes, "total": total, "kinds": kinds}
            escapes = np.where(kinds < 256, kinds, 0.0)
            level["whole"] = np.log2(total + escapes)  # coding starts here
            level["escape"] = level["whole"] - _log2(escapes)
            if before is not None:
                # what is left of the next shorter context without the bytes of this one
                up = np.searchsorted(before["nodes"], nodes >> 8)
                had = before["n"][np.searchsorted(before["edges"], ((keys >> 16) << 8) | (keys & 255))]
                rest = before["total"][up] - (np.add.reduceat(had, first) if len(first) else had)
                more = np.where(before["kinds"][up] < 256, before["kinds"][up] - kinds, 0.0)
                level["left"] = _log2(rest + more)
                level["left_escape"] = np.where(more > 0, level["left"] - _log2(more), 0.0)
            self.orders.append(level)
            before = level
        known = self.orders[0]["kinds"][0] if len(self.orders[0]["nodes"]) else 0.0
        self.other = float(np.log2(max(256 - known, 1)))

    def costs(self, codes: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each window."""
        out = np.zeros(len(codes))
        open_, came = np.arange(len(codes)), np.full(len(codes), -1)
        for k in range(len(self.orders) - 1, -1, -1):
            level = self.orders[k]
            if not len(open_) or not len(level["nodes"]):
                continue
            edge = _at_order(codes[open_], k)
            node = np.minimum(np.searchsorted(level["nodes"], edge >> 8), len(level["nodes"]) - 1)
            here = level["nodes"][node] == edge >> 8
            at, own, edge = open_[here], node[here], edge[here]
            place = np.minimum(np.searchsorted(level["edges"], edge), len(level["edges"]) - 1)
            found = level["edges"][place] == edge
            whole, escape = level["whole"][own], level["escape"][own]
            if k + 1 < len(self.orders) and len(self.orders[k + 1]["nodes"]):
                longer = self.orders[k + 1]
                from_ = came[at]
                whole = np.where(from_ >= 0, longer["left"][from_], whole)
                escape = np.where(from_ >= 0, longer["left_escape"][from_], escape)
            out[at] += np.where(found, whole - level["log_n"][place], escape)
            came[at] = own
            done = np.zeros(len(open_), bool)
            done[np.nonzero(here)[0][found]] = True
            open_ = open_[~done]
        out[open_] += self.other
        return out


def _log2(x: np.ndarray) -> np.ndarray:
    return np.log2(np.where(x > 0, x, 1.0))


def trees(counts: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> dict:
    """A model from each language's (order, edge, count)."""
    langs = sorted(counts)
    made = []
    for lang in langs:
        order, edge, n = counts[lang]
        by = [(edge[order == k], n[order == k]) for k in range(DEPTH + 1)]
        made.append(Tree([(e[i], c[i]) for e, c in by for i in [np.argsort(e, kind="stable")]]))
    return {"langs": langs, "trees": made}


def edges_of(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, edge, count) of windows."""
    parts = []
    for k in range(DEPTH + 1):
        edge, at = np.unique(_at_order(codes, k), return_inverse=True)
        parts.append((np.full(len(edge), k), edge, np.bincount(at, weights=n, minlength=len(edge)).astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*parts))


def learnt(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS, edges: int = EDGES) -> dict:
    """Statistics from rows with a language. Of a language with more than sample_docs rows
    about that many are taken, by a hash of the id; their texts are read whole. Edges are
    counted in Spark; the driver gets those that stay: the most frequent, ties all or none,
    and those of the empty context."""
    spark = docs.sparkSession
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return trees({})
    langs = sorted(sizes)
    shares = spark.createDataFrame([(lang, k, hash_share(sample_docs / sizes[lang])) for k, lang in enumerate(langs)], "lang string, k int, bound long")
    few = known.join(F.broadcast(shares), "lang").where(F.xxhash64(F.col("id").cast("string"), F.lit("language sample")) <= F.col("bound")).select("k", "text")

    def count(batches):
        import pyarrow as pa

        own: dict[int, list[bytes]] = {}

        def flush():
            for k, texts in own.items():
                order, edge, n = edges_of(*counted(texts))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(edge), k), pa.int32()), pa.array(order, pa.int32()), pa.array(edge, pa.int64()), pa.array(n, pa.int64())], ["k", "order", "edge", "n"])
            own.clear()

        size = 0
        for batch in batches:
            for k, raw in zip(batch.column("k").to_pylist(), text_bytes(batch)):
                own.setdefault(k, []).append(prepared(raw))
                size += len(raw)
                if size >= CHUNK:
                    yield from flush()
                    size = 0
        yield from flush()

    sums = stored(few.mapInArrow(lean(count), "k int, order int, edge long, n long").groupBy("k", "order", "edge").agg(F.sum("n").alias("n")), "language-edges")
    most = max(256, min(edges, ALL_EDGES // len(langs)))
    left, least = dict.fromkeys(range(len(langs)), most), dict.fromkeys(range(len(langs)), 1)
    for r in sums.where("order > 0").groupBy("k", "n").agg(F.count(F.lit(1)).alias("c")).orderBy("k", F.desc("n")).collect():
        left[r["k"]] -= r["c"]
        if left[r["k"]] < 0:
            least[r["k"]] = max(least[r["k"]], r["n"] + 1)
    bounds = F.broadcast(spark.createDataFrame(list(least.items()), "k int, least long"))
    rows = sums.join(bounds, "k").where("order = 0 or n >= least").select("k", "order", "edge", "n").toArrow()
    discard(sums)
    own, order, edge, n = (rows[c].to_numpy().astype(np.int64) for c in ("k", "order", "edge", "n"))
    model = trees({lang: (order[own == k], edge[own == k], n[own == k]) for k, lang in enumerate(langs)})
    del rows, own, order, edge, n
    trim()
    return model


def code_lengths(model: dict, texts: list[bytes]) -> np.ndarray:
    """Parts of a bit for each (text, language)."""
    out = np.zeros((len(texts), len(model["langs"])), np.int64)
    parts, owner, size = [], [], 0

    def code():
        sizes = np.array([len(p) - DEPTH for p in parts])
        inside = np.ones(int(sizes.sum()) + DEPTH * (len(parts) - 1), bool)
        for end in (np.cumsum(sizes + DEPTH) - DEPTH)[:-1]:
            inside[end : end + DEPTH] = False  # windows that reach into the next part
        codes, at = np.unique(window_codes(b"".join(parts))[inside], return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        for k, tree in enumerate(model["trees"]):
            costs = np.round(tree.costs(codes) * PARTS_OF_BIT).astype(np.int64)
            np.add.at(out[:, k], owner, np.add.reduceat(costs[at], starts))

    for k, raw in enumerate(texts):
        for start in range(0, len(raw), CHUNK):
            lead = _LEAD if start == 0 else raw[start - DEPTH : start]
            parts.append(lead + raw[start : start + CHUNK])
            owner.append(k)
            size += len(parts[-1])
            if size >= CHUNK:
                code()
                parts.clear(), owner.clear()
                size = 0
    if parts:
        code()
    return out


def predicted(model: dict, texts: list[bytes]) -> tuple[list[str], list[float], list[float]]:
    """Language, posterior under equal priors, and bits a byte."""
    langs = model["langs"]
    if not langs:
        return [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    ready = [prepared(t) for t in texts]
    bits = code_lengths(model, ready) / PARTS_OF_BIT
    best = bits.argmin(1)
    least = bits[np.arange(len(texts)), best]
    score = 1 / np.exp2(-np.minimum(bits - least[:, None], 1000)).sum(1)
    found = [has_letter(t) for t in texts]
    return (
        [langs[b] if ok else UNKNOWN for b, ok in zip(best, found)],
        [float(s) if ok else 0.0 for s, ok in zip(score, found)],
        [float(x / max(len(t), 1)) for x, t in zip(least, ready)],
    )


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score, bits_per_byte, rejected.

    No shuffle; only id and text are read, so columns with clashing names don't
    matter. Null and empty texts and texts without a letter are `und` with score 0
    and rejected; so is every text if nothing was learnt. Of languages with equal code
    lengths the first by name wins. Repeated rows and null ids come back as they are;
    an empty table gives an empty result; very long texts are coded a megabyte at a
    time, whole."""
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # ALL_EDGES edges at most, 256 a language at least

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                lang, score, bits = predicted(shared.value, list(text_bytes(some)))
                yield pa.RecordBatch.from_arrays([some.column("id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())], ["id", "lang_pred", "score", "bits_per_byte"])

    out = kept.mapInArrow(lean(run), f"id {kept.schema['id'].dataType.simpleString()}, lang_pred string, score double, bits_per_byte double")
    bad = (F.col("lang_pred") == UNKNOWN) | (F.col("score") < LEAST_SCORE) | (F.col("bits_per_byte") > MOST_BITS)
    return out.select(F.col("id").alias(id_col), "lang_pred", "score", "bits_per_byte", bad.alias("rejected"))


def rejects(lang: str, score: float, bits: float) -> bool:
    return lang == UNKNOWN or score < LEAST_SCORE or bits > MOST_BITS


def accepted(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that identify() doesn't reject; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                yield some.filter(pa.array([not rejects(*x) for x in zip(*predicted(shared.value, list(text_bytes(some, text_col))))], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = learnt(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte", "rejected")
