"""Benchmark decontamination by template windows.

Texts become tokens without the punctuation around them. In the template form numbers,
names (capitalised words inside a sentence) and units (after a number) are typed
placeholders; in the plain form tokens are only lower-cased. Windows of WIDTH tokens
of both forms are hashed (an item of fewer tokens is one window). A second template form
takes capitalised words that open a sentence for names too. Where a template window has
few other tokens it is widened, forwards and backwards, until it has LEAST_PLAIN; an item
that has fewer is one window as a whole. A bitmap of the
benchmark's windows, of a size with a fixed bound, is all that is broadcast: windows
of documents that pass it are joined to the benchmark's by hash, so false passes
fall out. Matches of one document and item with the same shift make one alignment.
It counts as a leak if plain windows cover enough of the item, or plain and template
windows do and each of the item's slot values is always replaced by the same value in
the document. Different names must have different replacements too (two persons don't become
one); different numbers may not: 3 pens and 2 cups may become 5 pens and 5 cups."""

from __future__ import annotations

import functools
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, mixed, read_table, small_side, stored, text_bytes, windows

WIDTH = 8
#: Tokens of an item that is searched for inside documents; a shorter one names no passage and
#: is found where it is a whole document.
LEAST_TOKENS = 3
#: Other tokens that a template window needs; less only if the item has less.
LEAST_PLAIN = 5
#: Covered tokens that always count as a leak, and the share of an item that does.
ENOUGH_TOKENS, ENOUGH_SHARE = 13, 0.6
#: Bits of the bitmap: 16 or more a window, up to this many (16 MB).
MOST_BITS = 1 << 27

#: Words that are units after a number.
UNITS = frozenset(
    b"km m cm mm mi mile miles meter meters metre metres kilometer kilometers kilometre kilometres inch inches ft foot feet yard yards kg g mg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons "
    b"l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years mph kmh percent % degree degrees dollar dollars cent cents euro euros usd eur gbp".split()
)
_NUMBER = re.compile(rb"[+-]?[$\x80-\xff]*[0-9][0-9.,:/]*%?$")
_EDGE = b"!\"#$&'()*,-./:;<=>?@[\\]^_`{|}~"
_NUM, _UNIT, _NAME = 1, 2, 4
_PLACEHOLDER = {_NUM: np.uint64(0x1111111111111111), _UNIT: np.uint64(0x2222222222222222), _NAME: np.uint64(0x3333333333333333)}


#: Classes of bytes: white space, punctuation at a token's edges, what may follow a sentence's end, sentence ends, digits.
_SPACE, _PUNCT, _CLOSE, _END, _DIGIT = 1, 2, 4, 8, 16
_CLASS = np.zeros(256, np.uint8)
for _bit, _own in ((_SPACE, b" \t\n\x0b\x0c\r"), (_PUNCT, _EDGE), (_CLOSE, b"\"')]"), (_END, b".!?:"), (_DIGIT, b"0123456789")):
    _CLASS[list(_own)] |= _bit
_WORD, _GAP = re.compile(rb"[^\x20\x09-\x0D]+"), re.compile(rb"[\x20\x09-\x0D]")
#: Powers of an odd number modulo 2^64; a place in a token is taken modulo their number.
_POWERS = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
#: Bytes read at a time, up to the next white space.
BLOCK = 1 << 16


def _lowered(raw: bytes) -> bytes:
    """The text in lower case, byte for byte; a word whose lower case has another length stays as it is."""
    if raw.isascii():
        return raw.lower()
    low = raw.decode("utf-8", "replace").lower().encode("utf-8", "replace")
    if len(low) == len(raw) and (_CLASS[np.frombuffer(low, np.uint8)] == _CLASS[np.frombuffer(raw, np.uint8)]).all():
        return low

    def one(m):
        word = m[0].decode("utf-8", "replace").lower().encode("utf-8", "replace")
        return word if len(word) == len(m[0]) else m[0]

    return _WORD.sub(one, raw)


def _block(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a stretch of text: plain hashes and kinds of the tokens that hold more than
    punctuation, which of all tokens they are, and which of all tokens end a sentence."""
    low = _lowered(raw)
    a, b = np.frombuffer(raw, np.uint8), np.frombuffer(low, np.uint8)
    cls = _CLASS[a]
    inside = (cls & _SPACE) == 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    token = np.cumsum(begins, dtype=np.int32) - 1
    ends = np.zeros(int(token[-1]) + 1 if len(token) else 0, np.uint8)
    tail = np.nonzero(inside & ((cls & _CLOSE) == 0))[0]
    if len(tail):
        last = tail[_changes(token[tail])[1:]]
        last = last[(cls[last] & _END) > 0]
        ends[token[last]] = 1
    solid = np.nonzero((cls & (_SPACE | _PUNCT)) == 0)[0]
    if not len(solid):
        return np.empty(0, np.uint64), np.empty(0, np.uint8), np.empty(0, np.int64), ends
    change = _changes(token[solid])
    first, last = solid[change[:-1]], solid[change[1:]]
    own = token[first]
    from_ = np.zeros(len(ends), np.int32)
    from_[own] = first
    rel = np.arange(len(a), dtype=np.int32)
    rel -= from_[token]
    rel &= len(_POWERS) - 1
    terms = np.zeros(len(a) + 1, np.uint64)
    np.multiply(_POWERS[rel], b, out=terms[:-1])
    edges = np.empty(2 * len(first), np.int64)
    edges[::2], edges[1::2] = first, last + 1
    plain = mixed(np.add.reduceat(terms, edges)[::2] + (last - first).astype(np.uint64))
    begin = a[first]
    upper = begin != b[first]
    for k in np.nonzero(~upper & (begin >= 0xC0))[0].tolist():  # the first character of more than a byte
        at, size = int(first[k]), 2 + int(begin[k] >= 0xE0) + int(begin[k] >= 0xF0)
        upper[k] = raw[at : at + size] != low[at : at + size]
    kind = upper * np.uint8(_NAME)
    digits = np.nonzero(cls & _DIGIT)[0]
    if len(digits):
        place = np.full(len(ends), -1)
        place[own] = np.arange(len(own))
        for k in set(place[token[digits]].tolist()):
            if _NUMBER.match(raw[first[k] : last[k] + 1]):
                kind[k] = _NUM
    return plain, kind, own.astype(np.int64), ends


def _changes(x: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins; behind the last one too."""
    out = np.ones(len(x) + 1, bool)
    np.not_equal(x[1:], x[:-1], out=out[1:-1])
    return out


@functools.cache
def _unit_hashes() -> frozenset[int]:
    return frozenset(_block(b" ".join(sorted(UNITS)))[0].tolist())


def read(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Plain hashes and kinds of the tokens, and which of them open a sentence. Each byte goes
    through some array operations, a block at a time; only tokens with digits are looked
    at one by one."""
    parts, at, count = [], 0, 0
    while at < len(text):
        space = _GAP.search(text, at + BLOCK)
        end = space.end() if space else len(text)
        plain, kind, own, ends = _block(text[at:end])
        parts.append((plain, kind, own + count, ends))
        at, count = end, count + len(ends)
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.uint8), np.empty(0, bool)
    plain, kind, own, ends = parts[0] if len(parts) == 1 else (np.concatenate(x) for x in zip(*parts))
    if not len(plain):
        return plain, kind, np.empty(0, bool)
    for k in (np.nonzero(kind[:-1] == _NUM)[0] + 1).tolist():  # a unit stands right behind a number
        if kind[k] != _NUM and int(plain[k]) in _unit_hashes():
            kind[k] |= _UNIT
    closed = np.maximum.reduceat(ends, own)  # the full stop of a token without more goes to the one before
    starts = np.ones(len(plain), bool)
    starts[1:] = closed[:-1] > 0
    return plain, kind, starts


def forms(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the plain and the template form, and where placeholders are."""
    plain, kind, starts = read(text)
    return plain, *_template(plain, kind, ~starts)[:2]


def all_forms(text: bytes) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    """Hashes of the plain form; of each template form the hashes, where placeholders are,
    which of them windows must have (in the second form those that open sentences), and
    the values of slots: plain hashes whose last bit says whether it is a name."""
    plain, kind, starts = read(text)
    template, slot, value = _template(plain, kind, ~starts)
    out = [(template, slot, slot, value)]
    if ((kind & _NAME > 0) & starts).any():
        more, open_slot, value = _template(plain, kind, np.ones(len(plain), bool))
        out.append((more, open_slot, open_slot & ~slot, value))
    return plain, out


def _template(plain, kind, names) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The template form with capitalised words as names where `names` says so, its slots and their values."""
    after_number = np.concatenate([[False], (kind[:-1] & _NUM) > 0])[: len(plain)]
    template, slot, value = plain.copy(), np.zeros(len(plain), bool), plain & ~np.uint64(1)
    for bit, where in ((_NAME, names), (_UNIT, after_number), (_NUM, True)):
        mine = ((kind & bit) > 0) & where
        template[mine] = _PLACEHOLDER[bit]
        slot |= mine
        value[mine] = (value[mine] & ~np.uint64(1)) | np.uint64(bit == _NAME)
    return template, slot, value


def _before(x) -> np.ndarray:
    """How many of x are true before each place, and in all."""
    return np.concatenate([[0], np.cumsum(x)])


_powers = np.ones((2, 1), np.uint64)


def _power(n: int) -> np.ndarray:
    """Powers 0 to n of an odd number and of its inverse, modulo 2^64."""
    global _powers
    if _powers.shape[1] <= n:
        base = 0x9E3779B97F4A7C15
        steps = np.full((2, 2 * n + 1), [[base], [pow(base, -1, 1 << 64)]], np.uint64)
        steps[:, 0] = 1
        _powers = np.cumprod(steps, axis=1, dtype=np.uint64)
    return _powers


def _widened(slots, at, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the windows at `at` widened to LEAST_PLAIN other tokens: to the
    right from their start, and to the left from their end. slots: how many before each place."""
    others = np.arange(len(slots)) - slots
    place = np.nonzero(np.diff(others))[0]
    right = at[others[at] + LEAST_PLAIN <= len(place)]
    left = at[others[at + width] >= LEAST_PLAIN] + width
    begin = np.concatenate([right, place[others[left] - LEAST_PLAIN]])
    end = np.concatenate([place[others[right] + LEAST_PLAIN - 1] + 1, left])
    both = np.unique(begin * len(slots) + end)
    return both // len(slots), both % len(slots) - both // len(slots)


def _template_windows(template, slot, must, widths: list[int], whole: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, lengths, hashes) of windows of `widths` with LEAST_PLAIN tokens that are no
    slots, of the widened ones, and of windows of the sizes `whole` with any."""
    slots, musts, n = _before(slot), _before(must), len(template)
    begins, lengths = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for width in sorted({*widths, *whole}):
        if width > n:
            continue
        others = width - slots[width:] + slots[: n - width + 1]
        good = (others >= LEAST_PLAIN) & (width == WIDTH)
        if width in whole:
            good |= (others > 0) & ((others < LEAST_PLAIN) | (width < WIDTH))
        at = np.nonzero(good & (musts[width:] > musts[: n - width + 1]))[0]
        begins.append(at), lengths.append(np.full(len(at), width))
        if width == WIDTH:
            weak = np.nonzero(others < LEAST_PLAIN)[0]
            if len(weak):
                at, own = _widened(slots, weak, width)
                ok = musts[at + own] > musts[at]
                begins.append(at[ok]), lengths.append(own[ok])
    at, own = np.concatenate(begins), np.concatenate(lengths)
    up, down = _power(n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(template * up[:n], dtype=np.uint64)])
    return at, own, mixed(mixed((sums[at + own] - sums[at]) * down[at]) + own.astype(np.uint64))


def _hashed(plain, forms, widths: list[int], whole: list[int] | None = None):
    """(positions, lengths, hashes, slots, their values) of the plain windows, then of each template form's.
    `whole` has the lengths of items that are one window; None if this is an item."""
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))]
    for width in widths:
        n = len(plain) - width + 1
        if n > 0:
            found.append((np.arange(n), np.full(n, width), mixed(windows(plain, width) + np.uint64(width))))
    yield *(np.concatenate(x) for x in zip(*found)), None, None
    for template, slot, must, value in forms:
        if must.any():
            own = whole
            if whole is None:
                own = [len(plain)] if len(plain) < WIDTH or (~slot).sum() < LEAST_PLAIN else []
            yield *_template_windows(template, slot, must, widths, own), slot, value
        else:
            yield *found[0], slot, value


#: form is 0 for plain windows, 1 for those of the first template form and 2 for those of the second.
_ROW = "pos int, h long, width int, n_tokens int, form int, slots array<long>"


def _rows(id_type: str, find):
    """A function for mapInArrow: a row for each window that find(text) gives."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, pos, hs, widths, lengths, forms, slots = [], [], [], [], [], [], []
            for k, text in enumerate(text_bytes(batch)):
                for p, h, width, n, form, s in find(text):
                    ids.append(k), pos.append(p), hs.append(h), widths.append(width), lengths.append(n), forms.append(form), slots.append(s)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(ids, pa.int64())), pa.array(pos, pa.int32()), pa.array(hs, pa.int64()), pa.array(widths, pa.int32()), pa.array(lengths, pa.int32()), pa.array(forms, pa.int32()), pa.array(slots, pa.list_(pa.int64()))],
                ["id", "pos", "h", "width", "n_tokens", "form", "slots"],
            )

    return run


def _listed(parts, plain, keep):
    for form, (at, lengths, h, slot, value) in enumerate(parts):
        good = keep(h)
        if not len(good):
            continue
        for p, width, x in zip(at[good].tolist(), lengths[good].tolist(), h[good].view(np.int64).tolist()):
            yield p, x, width, len(plain), form, value[p : p + width][slot[p : p + width]].view(np.int64).tolist() if form else []


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, pos, h, width, n_tokens, slots. Of items with the same text the smallest id stands for all."""
    kept = items.groupBy(F.col(text_col).alias("text")).agg(F.min(id_col).alias("id"))

    def find(text):
        plain, found = all_forms(text)
        width = min(WIDTH, len(plain))
        if width < LEAST_TOKENS:
            found = []
        if width:
            yield from _listed(_hashed(plain, found, [width]), plain, lambda h: np.arange(len(h)))

    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(lean(_rows(kind, find)), f"id {kind}, {_ROW}").withColumnRenamed("id", "item_id")


def marked(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places in h of the hashes that the bitmap may hold. Both of a hash's bits are set; the
    second is looked at where the first is."""
    mask, at = np.uint64(8 * len(bitmap) - 1), None
    for shift in (0, 32):
        bit = ((h if at is None else h[at]) >> np.uint64(shift)) & mask
        yes = np.nonzero((bitmap[(bit >> np.uint64(3)).view(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1)[0]
        at = yes if at is None else at[yes]
    return at


def bitmap(bench: DataFrame) -> tuple[np.ndarray, list[int], list[int]]:
    """The bitmap of the benchmark's windows, at most MOST_BITS / 8 bytes whatever their number, the widths of its plain
    windows, and those of template windows that are a whole item."""
    found = bench.groupBy("width", (F.col("form") == 0).alias("plain"), (F.col("width") == F.col("n_tokens")).alias("whole")).agg(F.count(F.lit(1)).alias("n")).collect()
    size = 1 << 18
    while size < min(MOST_BITS, 16 * sum(r["n"] for r in found)):
        size *= 2
    both = F.array(F.col("h").bitwiseAND(F.lit(size - 1)) + 1, F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(size - 1)) + 1)
    parts = bench.select(F.explode(both).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map")).collect()
    out = np.zeros(max(size // 8, 4096), np.uint8)
    for r in parts:  # bucket b > 0 has values 32768 (b - 1) + 1 .. 32768 b, so value v + 1 is bit v of the whole
        own = np.frombuffer(bytes(r["map"]), np.uint8)
        out[(r["bucket"] - 1) * 4096 : (r["bucket"] - 1) * 4096 + len(own)] |= own
    return out, sorted({r["width"] for r in found if r["plain"]}), sorted({r["width"] for r in found if r["whole"] and not r["plain"]})


def matches(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Alignments: id, item_id, shift, covered (by the plain windows and, as far as slots are
    replaced consistently, by template windows), n_tokens, n_slots (of those), consistent."""
    found, widths, whole = bitmap(bench)
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def find(text):
        plain, found_forms = all_forms(text)
        own = [w for w in widths if w >= LEAST_TOKENS or w == len(plain)]
        yield from _listed(_hashed(plain, found_forms, own, whole), plain, lambda h: marked(shared.value, h))

    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = kept.schema["id"].dataType.simpleString()
    mine = kept.mapInArrow(lean(_rows(kind, find)), f"id {kind}, {_ROW}").select("id", F.col("pos").alias("at"), "h", "width", F.col("form").alias("own_form"), F.col("slots").alias("own"))
    joined = mine.join(small_side(bench), ["h", "width"]).where(F.size("own") == F.size("slots"))
    pairs = F.arrays_zip(F.col("slots").alias("a"), F.col("own").alias("b"))
    form = F.greatest("form", "own_form")

    def pairs_of(most: int) -> Column:
        return F.array_distinct(F.flatten(F.collect_set(F.when(form <= most, pairs))))

    grouped = joined.groupBy("id", "item_id", (F.col("at") - F.col("pos")).alias("shift")).agg(F.max("n_tokens").alias("n_tokens"), F.sort_array(F.collect_set(F.struct("pos", "width", form.alias("form")))).alias("spans"), pairs_of(1).alias("inner"), pairs_of(2).alias("pairs"))
    opened, inner = _consistent("pairs"), _consistent("inner")
    return grouped.select(
        F.col("id").alias(id_col), "item_id", "shift", F.when(opened, _covered(2)).when(inner, _covered(1)).otherwise(_covered(0)).alias("covered"), "n_tokens",
        F.when(opened, F.size("pairs")).when(inner, F.size("inner")).otherwise(F.lit(0)).alias("n_slots"), inner.alias("consistent"),
    )


def _consistent(pairs: str) -> Column:
    names = F.filter(pairs, lambda p: p["a"].bitwiseAND(F.lit(1)) == 1)
    return (F.size(F.array_distinct(F.col(f"{pairs}.a"))) == F.size(pairs)) & (F.size(F.array_distinct(F.transform(names, lambda p: p["b"]))) == F.size(names))


def _covered(most: int) -> Column:
    """Tokens of the item that windows of forms up to `most` cover."""
    none = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("reach"))

    def add(so_far, x):
        end = x["pos"] + x["width"]
        return F.struct((so_far["covered"] + F.greatest(F.lit(0), end - F.greatest(x["pos"], so_far["reach"]))).alias("covered"), F.greatest(end, so_far["reach"]).alias("reach"))

    return F.aggregate(F.filter("spans", lambda x: x["form"] <= most), none, add, lambda x: x["covered"])


def leaked() -> Column:
    enough = F.least(F.lit(ENOUGH_TOKENS), F.ceil(F.lit(ENOUGH_SHARE) * F.col("n_tokens")))
    return F.col("covered") >= enough


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per contaminated document: id, item_id (of the largest cover, then the
    smallest), covered (tokens of that item), n_items, n_slots, shift.

    Rows with the same id count as one document. Null texts and empty texts match
    nothing; items of fewer than LEAST_TOKENS tokens match documents that hold nothing else. Rows with a null id
    have no name to be reported by and are left out. Other columns aren't read, so
    clashing names don't matter. An empty table of documents or items gives an empty
    result. Of items with one text the smallest id is reported; ids of items may be of any type that has an order."""
    bench = stored(benchmark_windows(items, item_col, item_text_col), "benchmark-windows")
    hits = matches(docs.where(F.col(id_col).isNotNull()), bench, id_col, text_col).where(leaked())
    best = F.min(F.struct((-F.col("covered")).alias("covered"), "item_id", "shift", "n_slots"))
    found = hits.groupBy(id_col).agg(F.count_distinct("item_id").alias("n_items"), best.alias("best"))
    return found.select(id_col, "best.item_id", (-F.col("best.covered")).alias("covered"), "n_items", "best.n_slots", "best.shift")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents; a document that isn't returned is clean."""
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
