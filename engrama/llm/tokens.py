"""Token counts by overlap resynchronisation.

The library encodes a text of up to CHUNK code points whole. A longer one is
encoded in chunks that overlap. Two neighbours are spliced at a place in their overlap
which both encodings show to be a boundary of the whole text's encoding:

- a pre-token starts there in both, and the tokens on either side of it are the same ones
  at the same places: the pre-tokenizer reads on from its own last boundary, so from there on both read alike;
- or, inside a pre-token longer than the overlap, both have the same two tokens
  around it: byte-pair merges are settled by neighbours, and the left chunk has these two stand side by side.

Places near a chunk's cut, where its context is missing, are left out. An
overlap without such a place is doubled, and when it has reached the whole
chunk, the chunk itself grows.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrama.llm.shared import without

CHUNK, OVERLAP = 1 << 14, 1 << 8
#: Code points beside a cut whose tokens are not trusted; at least as many as the longest special string has.
MARGIN = 16
#: Texts that go to the library in one call.
BATCH = 64


class Encoder:
    """The library's encoder of a tokenizer file, and what is known of a chunk's encoding."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        #: only merges of neighbours may be spliced inside a pre-token
        self.merges = isinstance(self.library.model, BPE) and not self.library.model.dropout
        self.margin = max([MARGIN, *(len(t.content) + 1 for t in self.library.get_added_tokens_decoder().values())])
        #: chunks encoded, splices made between pre-tokens and inside one, overlaps widened, chunks grown
        self.seen = {"chunks": 0, "between": 0, "inside": 0, "widened": 0, "grown": 0}

    def encode(self, text: str):
        self.seen["chunks"] += 1
        return self.library.encode(text, add_special_tokens=False)

    def counts(self, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
        """Tokens of each text."""
        short = [x for x in texts if len(x) <= chunk]
        found: list[int] = []
        for i in range(0, len(short), BATCH):
            found += map(len, self.library.encode_batch_fast(short[i : i + BATCH], add_special_tokens=False))
        known = iter(found)
        return [next(known) if len(x) <= chunk else self.count(x, chunk, overlap) for x in texts]

    def count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """Tokens of one text, by chunks."""
        chunk = max(chunk, 4 * self.margin)
        at, end = 0, min(chunk, len(text))
        left, before, total = self.encode(text[at:end]), 0, 0  # tokens of left that are counted already
        while end < len(text):
            wide = max(overlap, 2 * self.margin + 2)
            while True:
                start = max(at, end - wide)
                if start > at:
                    stop = min(len(text), start + chunk)
                    right = self.encode(text[start:stop])
                    splice = self.splice(left, at, end, right, start, stop, before)
                    if splice:
                        total += splice[0] - before
                        left, at, end, before = right, start, stop, splice[1]
                        break
                    wide *= 2
                    self.seen["widened"] += 1
                else:  # no place in the whole chunk
                    end = min(len(text), at + 2 * (end - at))
                    left = self.encode(text[at:end])
                    self.seen["grown"] += 1
                    break
        return total + len(left) - before

    @staticmethod
    def tokens(e, at: int, low: int, high: int) -> list[tuple[int, int, int, bool, int]]:
        """(start, end, id, whether a pre-token starts here, index) of the tokens that lie between two places of the text."""
        out, ids = [], e.ids
        i = next((t for p in range(max(0, low - at), high - at) if (t := e.char_to_token(p)) is not None), len(ids))
        word = e.token_to_word(i - 1) if i else None
        while i < len(ids):
            a, b = e.token_to_chars(i)
            if b + at > high:
                break
            mine = e.token_to_word(i)
            out.append((a + at, b + at, ids[i], mine is None or mine != word, i))
            word = mine
            i += 1
        return out

    def splice(self, left, left_at: int, left_end: int, right, right_at: int, right_end: int, before: int) -> tuple[int, int] | None:
        """The last proven boundary: the tokens before it in left and in right. None where there is none."""
        low, high = right_at + self.margin, (left_end - self.margin if left_end < right_end else left_end)
        mine, theirs = (self.tokens(e, at, low, high) for e, at in ((left, left_at), (right, right_at)))
        there = {(a, b, i): k for k, (a, b, i, _, _) in enumerate(theirs)}
        inside = None
        for k in range(len(mine) - 1, 0, -1):
            (a1, b1, i1, _, _), (a2, b2, i2, new, index) = mine[k - 1], mine[k]
            j = there.get((a2, b2, i2))
            if j is None or j == 0 or theirs[j - 1][:3] != (a1, b1, i1) or index < before:
                continue
            if b1 > a2:  # several tokens of one character
                continue
            if new and theirs[j][3]:
                self.seen["between"] += 1
                return index, theirs[j][4]
            if inside is None and not new and not theirs[j][3]:
                inside = index, theirs[j][4]
        if inside is None or not self.merges:
            return None
        self.seen["inside"] += 1
        return inside


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder of a file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_counts(docs: DataFrame, path: str, limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Adds n_bytes, n_tokens (long) and over_limit to each row of docs; the text is read but not returned.

    path: a tokenizers .json on every machine; any pre-tokenizer that reads
    from left to right will do. A task holds one chunk's encoding beside the text. Null and empty texts have no
    bytes and no tokens. Repeated rows are all returned, an empty table gives
    none, and columns of these names are replaced, whatever their case.
    """
    rest = without(docs, "n_bytes", "n_tokens", "over_limit", "text")
    packed = docs.select(F.struct(*[rest[c] for c in rest.columns]).alias("row"), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            sizes = [len(x.encode()) for x in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(enc.counts(texts, chunk, overlap), pa.int64())], ["row", "n_bytes", "n_tokens"])

    schema = f"row {packed.schema['row'].dataType.simpleString()}, n_bytes long, n_tokens long"
    return packed.mapInArrow(run, schema).select("row.*", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
