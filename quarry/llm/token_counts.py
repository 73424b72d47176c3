"""Token counts by overlap resynchronisation.

Texts up to ``chunk`` characters are encoded whole. A longer one is encoded
in chunks that overlap; token offsets of both encodings are compared inside
the overlap and the counts are spliced at a *wall* where both have a token
border. A wall is a space between two non-space ASCII characters, and it is
proven stable when no vocabulary piece holds the space mark after another
character: then no merge can cross it, so the tokens left of it cannot
depend on what follows, nor those right of it on what precedes. If the
overlap holds no common wall it is doubled, and at last the chunk itself
grows, up to the whole rest of the text.

Defined results: null or empty text has 0 bytes and 0 tokens; repeated rows
are counted each; a null id stays null; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import one_array, ship, slices, text_buffer

CHUNK = 1 << 15
OVERLAP = 256
MARK = "▁"


class ResyncCounter:
    """Counts tokens of one text; ``processor`` is a SentencePieceProcessor."""

    def __init__(self, processor, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.sp, self.chunk, self.overlap = processor, chunk, overlap
        pieces = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
        self.stable = not any(MARK in p.lstrip(MARK) for p in pieces)
        # a chunk begins after its wall's space: the dummy prefix stands for it
        self.stable &= processor.encode("a", return_type=str)[0].startswith(MARK)

    def borders(self, text: str) -> list[int]:
        return [begin for begin, _ in self.sp.encode(text, return_type="offset_mapping")["offsets"]]

    def wall(self, text: str, at: int) -> bool:
        a, b = text[at - 1 : at], text[at + 1 : at + 2]
        return text[at] == " " and a.isascii() and b.isascii() and a > " " and b > " "

    def count(self, text: str) -> int:
        if len(text) <= self.chunk or not self.stable:
            return len(self.sp.encode(text))
        total, start, size = 0, 0, self.chunk
        left: list[int] | None = None
        while True:
            end = start + size
            if end >= len(text):
                return total + len(self.sp.encode(text[start:]))
            left, cut, overlap = self.borders(text[start:end]), 0, self.overlap
            mine = set(left)
            while not cut:
                low = max(start, end - overlap)
                right = [low + b for b in self.borders(text[low:end])]
                cut = next((b for b in reversed(right) if low < b < end - 1 and b - start in mine and self.wall(text, b)), 0)
                if low == start:
                    break
                overlap *= 2
            if cut:
                total += sum(1 for b in left if b < cut - start)
                start, size = cut + 1, self.chunk
            else:
                size *= 2


def count_tokens(df: DataFrame, model_path: str, text: str = "text", key: str = "doc_id", limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` for every row of ``df``; a narrow
    map without any shuffle. ``model_path`` must be readable on executors."""
    ship(df)

    def run(batches: Iterator[pa.RecordBatch]):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        counter = ResyncCounter(sp, chunk, overlap)
        for batch in batches:
            for part in slices(batch, text):
                texts = one_array(part.column(text)).fill_null("").to_pylist()
                short = [t if len(t) <= chunk else "" for t in texts]
                counts = [len(x) for x in sp.encode(short, num_threads=1)]
                counts = [c if len(t) <= chunk else counter.count(t) for c, t in zip(counts, texts)]
                _, off = text_buffer(part.column(text))
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), pa.array(off[1:] - off[:-1], pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                    names=[key, "n_bytes", "n_tokens", "over_limit"],
                )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
