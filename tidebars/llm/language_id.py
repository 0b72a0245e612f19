"""Language identification by compression.

For each language a raw-content zstandard dictionary is cut from a bounded sample of labelled texts: up to ``DICT_BYTES``
bytes of pieces of at most ``PIECE_BYTES`` each. A text is encoded with every dictionary, in blocks of ``BLOCK_BYTES``
bytes (so that a long text meets the dictionary all along, and not only itself), and the language whose encoding is
smallest wins; every text at the same compression ``LEVEL``, one that finds short matches. Sizes are in bits, plus the bits of the
language's share among labelled texts, which settles ties of very short texts; further ties go to the first name.
A margin under ``margin`` of the second-best size is narrow: such rows are marked ``rejected`` and keep the best guess.

``und`` is the answer for null texts and texts without a letter, and where nothing was learned. Every whole text is
encoded, as lower-case words parted by blanks. Rows without label are not learned from. Repeated rows are learned from once
and answered alike; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, functions as F

from tidebars.llm.common import id_text

DICT_BYTES = 112 << 10
PIECE_BYTES = 1 << 10
BLOCK_BYTES = 1 << 9
LEVEL = 12
MARGIN = 0.01
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_BETWEEN = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """What is encoded: lower-case words with one blank before and after each."""
    return f" {_BETWEEN.sub(' ', text.lower())} ".encode()


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dict_bytes: int = DICT_BYTES) -> dict[str, tuple[bytes, float]]:
    """Dictionary and share of each language.

    Rows are drawn by a hash of their text, so copies count once, at a rate that yields about twice the pieces needed per
    language; what reaches the driver is bounded by that.
    """
    rows = labelled.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).where("text is not null and lang is not null")
    marked = rows.withColumn("draw", F.xxhash64("text"))
    # Shares count all rows; the rate follows from distinct texts, as copies are drawn together and count once.
    texts = marked.groupBy("lang", "draw").agg(F.count("*").alias("n"), F.max(F.least(F.octet_length("text"), F.lit(PIECE_BYTES))).alias("b"))
    counts = {r["lang"]: {"n": r["n"], "b": r["b"]} for r in texts.groupBy("lang").agg(F.sum("n").alias("n"), F.sum("b").alias("b")).collect()}
    if not counts:
        return {}
    total = sum(c["n"] for c in counts.values())
    rate = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, 3 * dict_bytes / max(1, c["b"])))) for k, c in counts.items()])
    drawn = marked.where(F.pmod("draw", F.lit(1_000_003)) < rate * 1_000_003)
    room = F.greatest(F.length("text") - PIECE_BYTES // 2, F.lit(0)) + 1
    piece = F.substring(F.col("text"), (1 + F.pmod(F.shiftright("draw", 20), room)).cast("int"), F.lit(PIECE_BYTES // 2))  # from anywhere in the text
    pieces = drawn.select("lang", "draw", piece.alias("piece")).distinct().collect()
    out = {}
    for lang in sorted(counts):
        own = [letters(r["piece"]) for r in sorted((r for r in pieces if r["lang"] == lang), key=lambda r: r["draw"])]
        out[lang] = (b"".join(own)[:dict_bytes], counts[lang]["n"] / total)
    return out


class Sizes:
    """Compressors of one worker process."""

    def __init__(self, learned: dict[str, tuple[bytes, float]]):
        self.langs = list(learned)
        self.prior = [-math.log2(share) for _, share in learned.values()]
        self.coders = []
        for content, _ in learned.values():
            plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
            if len(content) >= 8:
                plain["dict_data"] = d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(**plain))

    def bits(self, text: bytes) -> list[float]:
        blocks = [text[i : i + BLOCK_BYTES] for i in range(0, len(text), BLOCK_BYTES)]
        return [8 * sum(len(c.compress(b)) for b in blocks) + p for c, p in zip(self.coders, self.prior, strict=True)]


_OPEN: dict[int, Sizes] = {}


def predict(docs: DataFrame, learned: dict[str, tuple[bytes, float]], id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` (share of the best among all languages, two to the minus bits) and ``rejected``."""
    key = hash(tuple(learned.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _OPEN:
            _OPEN.clear()
            _OPEN[key] = Sizes(learned)
        sizes = _OPEN[key]
        for batch in batches:
            langs, scores, narrow = [], [], []
            for raw in batch.column(1).to_pylist():
                text = raw.decode("utf-8", "replace")
                if not sizes.langs or not _LETTER.search(text):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    narrow.append(True)
                    continue
                bits = sizes.bits(letters(text))
                best = min(range(len(bits)), key=bits.__getitem__)
                rest = sorted(bits)
                langs.append(sizes.langs[best])
                scores.append(1 / sum(2.0 ** max(-1000.0, rest[0] - b) for b in bits))
                narrow.append(len(rest) > 1 and rest[1] - rest[0] < margin * rest[1])
            yield pa.record_batch([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(narrow, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    df = id_text(docs, id_col, text_col)
    kind = df.schema["doc_id"].dataType.simpleString()
    return df.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")
