"""Token counts by a sentencepiece model, in Arrow functions that return lengths only."""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, text_bytes

#: Bytes of new pieces of text that go to the library in one call.
CALL_BYTES = 262_144
#: Pieces of text whose lengths a worker remembers.
REMEMBERED = 400_000
#: A space after other text and before other text: no piece of the vocabulary reaches across it.
_BOUNDARY = re.compile("(?<=[^ ▁]) (?=[^▁])")


class Counter:
    """Counts tokens of whole texts.

    A text is cut at spaces that no vocabulary piece spans, so the parts' counts
    add up to the text's. If the vocabulary has a piece that does span such a
    place, texts are encoded whole."""

    def __init__(self, model: str):
        import public_tokenizers
        import sentencepiece

        file = model if "/" in model else str(public_tokenizers.path(model))
        self.library = sentencepiece.SentencePieceProcessor(model_file=file)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size()) if not self.library.is_control(i)]
        self.cut = not any(re.search("[^▁]▁", x) for x in names) and len(self.library.encode("a b")) == 2 and self.library.encode(" a  b", out_type=str)[0] == "▁"
        self.known: dict[str, int] = {}

    def parts(self, text: str) -> list[str]:
        if not text or not self.cut:
            return [text] if text else []
        if "  " not in text and "▁" not in text and text[0] != " " != text[-1]:
            return text.split(" ")
        return _BOUNDARY.split(text)

    def _learn(self, new: list[str]) -> None:
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
        start = size = 0
        for k, part in enumerate(new):
            size += len(part) if part.isascii() else len(part.encode())
            if size >= CALL_BYTES or k == len(new) - 1:
                some = new[start : k + 1]
                self.known.update(zip(some, map(len, self.library.encode(some, num_threads=1))))
                start, size = k + 1, 0

    def count(self, texts: list[bytes]) -> list[int]:
        """Texts in UTF-8 are taken in groups of about the same number of bytes."""
        out, group, size = [], [], 0
        for k, raw in enumerate(texts):
            group.append(self.parts(raw.decode("utf-8", "replace")))
            size += len(raw)
            if size >= 4 * CALL_BYTES or k == len(texts) - 1:
                need = set().union(*group)
                new = [x for x in need if x not in self.known]
                if new:
                    self._learn(new)
                    if len(need) != len(new):  # what was known may have been cleared
                        self._learn([x for x in need if x not in self.known])
                out += [sum(map(self.known.__getitem__, parts)) for parts in group]
                group, size = [], 0
        return out


@functools.lru_cache(maxsize=4)
def counter(model: str) -> Counter:
    return Counter(model)


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    No shuffle. Null and empty texts have 0 tokens; other columns of docs, whatever
    their names, are neither read nor returned; repeated rows and null ids come back
    as they are; an empty table gives an empty result. A very long text is cut at
    safe places and its parts are counted a group at a time. model is a file name in
    the public tokenizers' folder or a path that every executor has."""
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        import pyarrow as pa

        c = counter(model)
        for batch in batches:
            raw = list(text_bytes(batch))
            n = pa.array(c.count(raw), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(map(len, raw), pa.int64()), n], ["id", "n_bytes", "n_tokens"])

    out = kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"), "piece_bpe_32k.model")


def token_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, and whether there are tokens: what SQL can say of the counts."""
    return op5_token_counts(spark, sf_dir).select("doc_id", "n_bytes", (F.col("n_tokens") > 0).alias("any"))


BYTES_SQL = r"""
SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes, coalesce(text, '') <> '' AS any FROM documents
"""
