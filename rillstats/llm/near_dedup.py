"""Near-duplicate documents by min-max hashing.

Each of PERMUTATIONS hash functions gives a document two values of its signature, the
smallest and the largest hash of its shingles, so half as many hashes are evaluated as
values are had. ROWS values make a band. Documents whose band agrees are candidates;
candidates are confirmed on their full shingle sets.

A pair of similarity 0.8 shares none of the bands with probability (1 - 0.8^5)^38 =
3e-7; of higher similarity, still less often.

Equal sets are first folded into one class, so copies make no pairs. In each bucket
documents are then compared with one centre, and links are joined to components. Only
documents of a bucket that are in different components are compared further: with
other centres, and then exactly: their shingles are put in one order, rare ones first,
and two sets that are alike enough must share one among the first of each (prefix
filter), with enough left behind it (positional filter), and the parities of their hashes
by cells must not differ in more bits than the sets may differ in hashes (parity filter).
Only such pairs are confirmed, so a group of documents that are somewhat alike makes few pairs and loses none."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WordHashes, discard, fresh, hash_share, lean, mixed, read_table, rows_of, seen_in, small_side, stored, text_bytes, windows

PERMUTATIONS = 95
ROWS = 5
BANDS = 2 * PERMUTATIONS // ROWS
#: Rounds in which documents meet a centre before the exact rest. Each joins most of what the one before left
#: apart, so that the rest has few pairs that only say the same again.
STAR_ROUNDS = 4
#: Documents whose shingles are counted for the order, about, and the counters: about two
#: shingles of the counted ones share a counter. Any order gives the same links; rare ones first gives few pairs.
ORDER_DOCS, ORDER_BITS = 20_000, 22
#: Shingles before a shared one in which a pair looks for one that it shared before.
LOOK_BACK = 16
#: 64-bit words of a set's parity bits.
PARITY_WORDS = 8
#: Members that one task compares with a centre at a time.
CELL = 256
#: Links that one task joins to components at most (16 bytes each); more are joined in rounds of shuffles. On small
#: tables such rounds follow so fast that the driver has hundreds of threads for them at a time.
TASK_LINKS = 500_000
#: Shingles hashed at a time.
_BLOCK = 4096

_rng = np.random.default_rng(20_240_601)
_A = (_rng.integers(1 << 31, size=PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_B = _rng.integers(1 << 32, size=PERMUTATIONS, dtype=np.uint32)[:, None]


def shingles(raw: bytes, words: WordHashes, width: int) -> np.ndarray:
    """The sorted 64-bit hashes of the different shingles; the whole sequence is one if
    there are fewer words than `width`; A-Z are lower-cased."""
    own = words.of(raw.lower().split())
    if not len(own):
        return own
    return np.unique(windows(own, min(width, len(own))) + np.uint64(min(width, len(own))))


def min_max(hashes: np.ndarray) -> np.ndarray:
    """Smallest values under each permutation, then largest."""
    low, high = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    folded = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(folded), _BLOCK):
        x = folded[None, at : at + _BLOCK] * _A + _B
        np.minimum(low, x.min(1), out=low)
        np.maximum(high, x.max(1), out=high)
    return np.concatenate([low, high])


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, different between bands."""
    rows = signature.reshape(BANDS, ROWS).astype(np.uint64)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return out


def parity(hashes: np.ndarray) -> np.ndarray:
    """For each of 64 * PARITY_WORDS cells whether an odd number of hashes fall in it. Two
    sets differ in at least as many hashes as their parities differ in bits."""
    bits = np.bincount((hashes & np.uint64(64 * PARITY_WORDS - 1)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def node_of(hashes: np.ndarray) -> int:
    """A 64-bit name for a set of shingles."""
    import xxhash

    x = xxhash.xxh3_64_intdigest(hashes.tobytes())
    return x - (1 << 64) if x >> 63 else x


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """id, n (shingles), node (the set's name; null if it is empty), bands."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        words = WordHashes()
        for batch in batches:
            n, nodes, bands = [], [], []
            for raw in text_bytes(batch):
                own = shingles(raw, words, width)
                n.append(len(own))
                nodes.append(node_of(own) if len(own) else None)
                bands.append(band_keys(min_max(own)).view(np.int64) if len(own) else [])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["id", "n", "node", "bands"])

    return docs.mapInArrow(lean(run), f"id {kind}, n long, node long, bands array<long>")


def confirmed(pairs: DataFrame, classes: DataFrame, given: DataFrame, width: int, numerator: int, denominator: int) -> DataFrame:
    """Of pairs (centre, node) those with denominator * |both sets| >= numerator * |either set|.
    A centre's members are dealt out in cells of about CELL, each with the centre's text,
    so that no task gets all members of a large group; only centres with more members than
    a cell holds are joined to the pairs for it. Texts travel, not hashes: a shingle's hash takes 8 bytes
    that don't compress, its word about 3 in a shuffle."""
    sizes = stored(pairs.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / F.lit(CELL)).cast("int").alias("cells")), "centres", most=F.max("cells"))
    cell = F.lit(0)
    if (seen_in(sizes, "most") or 0) > 1:
        pairs = pairs.join(small_side(sizes.where("cells > 1"), sizes), "centre", "left")
        cell = F.pmod(F.xxhash64("node"), F.coalesce("cells", F.lit(1))).cast("int")
    members = pairs.select("centre", cell.alias("cell"), "node", F.lit(1).alias("part"))
    centres = sizes.select("centre", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.col("centre").alias("node"), F.lit(0).alias("part"))
    dealt = stored(members.unionByName(centres).join(classes.select("node", F.col("head").alias("id")), "node"), "dealt")
    cells = given.join(small_side(dealt), "id").select("centre", "cell", "part", "node", "text").repartition("centre", "cell").sortWithinPartitions("centre", "cell", "part")

    def run(batches):
        import pyarrow as pa

        words, centre, held = WordHashes(), None, None
        for batch in batches:
            a, b = [], []
            for c, node, part, raw in zip(batch.column("centre").to_pylist(), batch.column("node").to_pylist(), batch.column("part").to_pylist(), text_bytes(batch)):
                own = shingles(raw, words, width)
                if not len(own) or node_of(own) != node:
                    continue  # another row with the same id
                if part == 0:
                    centre, held = c, own
                elif centre == c:
                    both = len(np.intersect1d(held, own, assume_unique=True))
                    if denominator * both >= numerator * (len(held) + len(own) - both):
                        a.append(c), b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["centre", "node"])

    out = stored(cells.mapInArrow(lean(run), "centre long, node long").distinct(), "links")
    discard(dealt, sizes)
    return out


def components(edges: DataFrame) -> DataFrame:
    """a, b: each node of edges (a, b) but the least of its component, and that least one.

    Large-star and small-star rounds; each round's edges are written out."""
    now, state = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges"), None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        top = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(top, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        new = stored(small.where("a <> b").distinct(), "edges", hashes=F.sum(F.xxhash64("a", "b").cast("decimal(20, 0)")))
        discard(now)
        now, before = new, state
        state = rows_of(now), seen_in(now, "hashes")
        if state == before:
            return now


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What components() gives, of edges in arrays: in each round the larger of two linked
    roots is hung below the least that it is linked with, until none are linked."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    least, x, y = np.arange(len(nodes)), at[: len(a)], at[len(a) :]
    while True:
        x, y = least[x], least[y]
        apart = x != y
        if not apart.any():
            break
        x, y = x[apart], y[apart]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while (further := least[least] != least).any():
            least[further] = least[least[further]]
    below = np.nonzero(least != np.arange(len(nodes)))[0]
    return nodes[below], nodes[least[below]]


def components_in_task(edges: DataFrame) -> DataFrame:
    """What components() gives, of TASK_LINKS edges at most: one task reads them all."""

    def run(batches):
        import pyarrow as pa

        none = np.empty(0, np.int64)
        read = [(none, none), *((batch.column("a").to_numpy(zero_copy_only=False), batch.column("b").to_numpy(zero_copy_only=False)) for batch in batches)]
        a, b = least_reached(*(np.concatenate(x) for x in zip(*read)))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return stored(edges.coalesce(1).mapInArrow(lean(run), "a long, b long"), "components")


def linked(docs: DataFrame, width: int = 5, numerator: int = 80, denominator: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Two texts are linked if denominator * |both sets| >= numerator * |either set|; the
    bands are made for 0.8 and more. component_id is the smallest id of the texts that
    links reach. Null and empty texts have no shingles, are linked with nothing and
    kept. Rows with the same id and text are one; rows with the same id and different
    texts are linked only as their texts are. A row with a null id is linked with
    nothing; its component is null and it is kept. Only id and text are read, so
    clashing names don't matter. An empty table gives an empty result. Texts are read
    whole."""
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = stored(signatures(given, width), "signatures")
    whole = signed.where("id is not null and n > 0")
    # Copies are one node. Of a node's rows the one with the smallest id stands for it.
    classes = stored(whole.groupBy("node").agg(F.min("id").alias("head"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")
    # Bands are counted before the shuffle and joined, not windowed: a join of a band that many share is split up.
    buckets = classes.select("node", "n", F.explode("bands").alias("band"))
    several = buckets.groupBy("band").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("band")
    members = stored(buckets.join(several, "band"), "members")
    heads, texts = classes.select("node", "head"), given.where("id is not null")
    tested = component = None
    made = [members]
    for turn in range(STAR_ROUNDS + 1):
        now = _placed(members, component)
        pairs = _star(now, turn, numerator, denominator) if turn < STAR_ROUNDS else _left_over(_open(now), heads, texts, width, numerator, denominator, made)
        if tested is not None:
            pairs = pairs.join(tested, ["centre", "node"], "left_anti")
        pairs = stored(pairs, "pairs")
        made.append(pairs)
        if rows_of(pairs):
            near = confirmed(pairs, heads, texts, width, numerator, denominator)
            tested = pairs if tested is None else tested.unionByName(pairs)
            before, component = component, _merged(component, near)
            discard(near, *([] if before is None else [before]))
    discard(*made)
    return _result(signed, heads, component, id_col)


def _placed(members: DataFrame, component: DataFrame | None) -> DataFrame:
    """Members with their components."""
    if component is None:
        return members.withColumn("component", F.col("node"))
    return members.join(component.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").withColumn("component", F.coalesce("component", "node"))


def _open(now: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one component."""
    more = now.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band")
    return now.join(more, "band")


def _merged(component: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after further links. Only links between components are gone through, or all in one task."""
    edges = links.select(F.col("centre").alias("a"), F.col("node").alias("b"))
    if rows_of(links) + (rows_of(component) if component is not None else 0) <= TASK_LINKS:
        return components_in_task(edges if component is None else edges.unionByName(component))
    if component is None:
        return components(edges)
    for side in ("a", "b"):
        roots = component.select(F.col("a").alias(side), F.col("b").alias("root"))
        edges = edges.join(roots, side, "left").withColumn(side, F.coalesce("root", side)).select("a", "b")
    more = components_in_task(edges) if rows_of(links) <= TASK_LINKS else components(edges)
    moved = component.join(more.select(F.col("a").alias("b"), F.col("b").alias("root")), "b", "left").select("a", F.coalesce("root", "b").alias("b"))
    return stored(moved.unionByName(more), "components")


def _may(numerator: int, denominator: int):
    return denominator * F.least("n", "cn") >= numerator * F.greatest("n", "cn")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("centre", "node").alias("centre"), F.greatest("centre", "node").alias("node"))


def _star(now: DataFrame, turn: int, numerator: int, denominator: int) -> DataFrame:
    """Members of a bucket that holds more than one component with the bucket's centre, which
    differs between turns. A document is compared with its most frequent centre; other centres wait."""
    order = F.struct(F.xxhash64("node", F.lit(turn)).alias("o"), F.col("node").alias("centre"), F.col("n").alias("cn"), F.col("component").alias("cc"))
    centres = now.groupBy("band").agg(F.min(order).alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band", "c.centre", "c.cn", "c.cc")
    pairs = now.join(centres, "band").where((F.col("component") != F.col("cc")) & _may(numerator, denominator))
    votes = pairs.groupBy("node", "centre").agg(F.count(F.lit(1)).alias("votes"))
    return votes.groupBy("node").agg(F.max_by("centre", F.struct("votes", "centre")).alias("centre")).select("centre", "node")


def _left_over(open_: DataFrame, heads: DataFrame, given: DataFrame, width: int, numerator: int, denominator: int, tables: list[DataFrame]) -> DataFrame:
    """All pairs of open documents in different components that can be alike enough. tables gets what is stored for it."""
    nodes = open_.groupBy("node").agg(F.first("n").alias("n"), F.first("component").alias("component"))
    nodes = stored(nodes.join(heads.withColumnRenamed("head", "id"), "node"), "open")
    texts = given.join(small_side(nodes), "id")
    order = texts.sparkSession.sparkContext.broadcast(_order(texts, max(1, rows_of(nodes)), width))

    def prefixes(batches):
        import pyarrow as pa

        words = WordHashes()
        for batch in batches:
            keep, tokens, odd = [], [], []
            for k, (node, raw) in enumerate(zip(batch.column("node").to_pylist(), text_bytes(batch))):
                own = shingles(raw, words, width)
                if len(own) and node_of(own) == node:  # else another row with the same id
                    first = len(own) + (-numerator * len(own)) // denominator + 1
                    seen = order.value[(own >> np.uint64(64 - ORDER_BITS)).astype(np.int64)]
                    keep.append(k)
                    odd.append(parity(own))
                    tokens.append(own[np.lexsort((own, seen))[:first]].view(np.int64))
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column("node"), kept.column("n"), kept.column("component"), pa.array(tokens, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))], ["node", "n", "component", "tokens", "parity"])

    made = stored(texts.select("node", "n", "component", "text").mapInArrow(lean(prefixes), "node long, n long, component long, tokens array<long>, parity array<long>").dropDuplicates(["node"]), "prefixes")
    tokens = made.select("component", F.explode("tokens").alias("token"))
    several = tokens.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    before = lambda i: F.slice("tokens", F.greatest(i - (LOOK_BACK - 1), F.lit(1)), F.least(i, F.lit(LOOK_BACK)))
    placed = F.transform("tokens", lambda t, i: F.struct(i.alias("place"), t.alias("token"), before(i).alias("earlier")))
    odd = [F.col("parity")[k].alias(f"p{k}") for k in range(PARITY_WORDS)]
    rows = stored(made.select("node", "n", "component", *odd, F.inline(placed)).join(several, "token"), "shared-prefixes")
    other = rows.select("token", F.col("node").alias("centre"), F.col("n").alias("cn"), F.col("component").alias("cc"), F.col("place").alias("cplace"), F.col("earlier").alias("cearlier"), *(F.col(f"p{k}").alias(f"cp{k}") for k in range(PARITY_WORDS)))
    differ = sum((F.bit_count(F.col(f"p{k}").bitwiseXOR(F.col(f"cp{k}"))) for k in range(PARITY_WORDS)), F.lit(0))
    close = (numerator + denominator) * differ <= (denominator - numerator) * (F.col("n") + F.col("cn"))
    behind = F.least(F.col("n") - F.col("place"), F.col("cn") - F.col("cplace"))  # shared shingles at most, from this one on
    enough = (numerator + denominator) * behind >= numerator * (F.col("n") + F.col("cn"))
    # Both have the same order, so at its first shared shingle a pair has shared none before: there it is always made, and at few others.
    first = ~F.arrays_overlap("earlier", "cearlier")
    tables += [nodes, made, rows]
    pairs = rows.join(other, "token").where((F.col("node") > F.col("centre")) & (F.col("component") != F.col("cc")) & _may(numerator, denominator) & enough & close & first)
    return pairs.select("centre", "node").distinct()


def _order(texts: DataFrame, n: int, width: int) -> np.ndarray:
    """How often shingles occur in about ORDER_DOCS documents, in 2^ORDER_BITS counters by their
    first bits: 0 if at most once, else in steps of a quarter of a power of two, a byte each (4 MB)."""

    def count(batches):
        import pyarrow as pa

        words, sums = WordHashes(), np.zeros(1 << ORDER_BITS, np.int32)
        for batch in batches:
            for raw in text_bytes(batch):
                np.add.at(sums, (shingles(raw, words, width) >> np.uint64(64 - ORDER_BITS)).astype(np.int64), 1)
        at = np.nonzero(sums)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at], pa.int32())], ["place", "n"])

    few = texts.where(F.xxhash64("node", F.lit("order")) <= hash_share(ORDER_DOCS / n)).select("node", "text")
    sums = few.mapInArrow(lean(count), "place int, n int").groupBy("place").agg(F.sum("n").alias("n")).where("n > 1")
    rows = sums.select("place", F.least(F.lit(255), F.round(4 * F.log2("n"))).cast("short").alias("n")).toArrow()  # 2^ORDER_BITS rows of 6 bytes at most
    out = np.zeros(1 << ORDER_BITS, np.uint8)
    out[rows["place"].to_numpy()] = rows["n"].to_numpy()
    return out


def _result(signed: DataFrame, heads: DataFrame, component: DataFrame | None, id_col: str) -> DataFrame:
    named = heads.withColumn("component", F.col("node"))
    if component is not None:
        named = heads.join(component.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("head").alias("component_id"))
    named = named.join(least, "component").select("node", "component_id")
    own = signed.select("id", "n", F.when(F.col("id").isNotNull(), F.col("node")).alias("node"))
    out = own.join(named, "node", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that stay: of each component the document
    with the smallest id. Of rows with the same id and text one stays; an id whose texts
    differ stays if one of its texts does. Rows with a null id stay, and so do null and empty
    texts. Texts are read whole; other columns may have any names; an empty table stays empty."""
    found = linked(docs, width, id_col=id_col, text_col=text_col).where(F.col(id_col).isNotNull())
    named, place = fresh(docs, "kept_id", "place")
    ids = stored(found.groupBy(F.col(id_col).alias(named)).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows")), "kept-ids")
    same = F.col(id_col) == F.col(named)
    stay = docs.join(small_side(ids.where("not kept").select(named)), same, "left_anti")
    again = ids.where("kept and rows > 1").select(named)
    if again.isEmpty():
        return stay
    again = small_side(again)
    repeated = stay.join(again, same, "left_semi")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    first = F.row_number().over(Window.partitionBy(id_col, text_col).orderBy(*others or [F.col(id_col)]))
    one = repeated.withColumn(place, first).where(F.col(place) == 1).drop(place)
    return stay.join(again, same, "left_anti").unionByName(one)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(read_table(spark, sf_dir, "documents"), width=4)


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[k:k + 3], ' ') END AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS k FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
t AS MATERIALIZED (SELECT g, list(doc_id) AS ids FROM s GROUP BY g HAVING count(*) > 1),
o AS (SELECT a, b, count(*) AS shared FROM (SELECT a, unnest(ids) AS b FROM (SELECT ids, unnest(ids) AS a FROM t)) WHERE a < b GROUP BY a, b),
e AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
l AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(doc_id, to_id) AS (SELECT a, b FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.to_id),
c AS (SELECT doc_id, min(to_id) AS least FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(c.least, w.doc_id)) AS component_id, w.doc_id <= coalesce(c.least, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id
"""
