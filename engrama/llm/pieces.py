"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The model's kind is byte-pair encoding with byte fallback. There the best path
to a place is the encoding of the text up to it; its last piece is the one
that, after the best path to its own start, the merge rules leave apart from
the piece before it. So a place keeps one back pointer, at most a piece's length back.
The text is streamed in blocks through an automaton that names the pieces ending at each place. A window of places is kept, and as soon as the
back pointers of all its places that may still be extended meet at one boundary, the ids up to there are
committed and the places before it dropped. Where no piece runs over a place with the character that follows, that
place is such a boundary at once (each word's start is); otherwise the back pointers are walked as soon as the
window is as long as the longest piece, and at every such stretch again.
A memory is a shortcut beside the pass, and counts its hits: what was committed between two boundaries at which all paths
meet in any text (word starts, line ends) is remembered, and the pass goes over the stretches in between, all that follow one another at once.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrama.llm.shared import without

MARK = "▁"
#: Stretches that a worker remembers, the longest of them, and pairs of pieces.
MEMORY, STRETCH, PAIRS = 120_000, 48, 120_000
#: Code points of a block of text.
BLOCK = 1 << 15

# the library writes one replacement character per byte that starts no whole character
codecs.register_error("one_per_byte", lambda e: ("\ufffd", e.start + 1))


class Pieces:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces):
            raise ValueError("only byte-pair models without a character map are supported")
        kind = pb.ModelProto.SentencePiece
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.vocab = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        self.score = {p.piece: p.score for p in model.pieces if p.type == kind.NORMAL}
        self.bytes = [0] * 256
        self.surface = [""] * len(model.pieces)
        self.raw: dict[int, int] = {}
        for i, p in enumerate(model.pieces):
            if p.type == kind.BYTE:
                self.raw[i] = b = int(p.piece[3:5], 16)
                self.bytes[b] = i
                self.surface[i] = chr(b) if b < 128 else ""
            elif p.type == kind.NORMAL:
                self.surface[i] = p.piece.replace(MARK, " ")
            elif p.type == kind.UNKNOWN:
                self.surface[i] = model.trainer_spec.unk_surface
        self.high = frozenset(i for i, b in self.raw.items() if b >= 128)
        self.longest = max(map(len, self.vocab))
        if not set("".join(self.vocab)) <= self.vocab.keys():
            raise ValueError("a character of a piece must be a piece")
        self.root = self.automaton()
        self.name = {i: p for p, i in self.vocab.items()}
        # where no piece runs on, all paths meet: before a mark that follows another character, and around a line end
        meets = all(MARK not in p.lstrip(MARK) for p in self.vocab) and not any("\n" in p for p in self.vocab)
        self.stretches = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+" if meets else "(?s:.+)")
        self.size = [len(self.name.get(i, "")) for i in range(len(model.pieces))]
        #: by piece, whether the rules leave it and a piece after it as they are; how many pairs are held
        self.apart: list[dict[int, bool]] = [{} for _ in model.pieces]
        self.pairs = 0
        #: by piece, what stands at its right (left) edge while the rules put it together, each with the score of its next merge
        self.rights: dict[int, tuple | None] = {}
        self.lefts: dict[int, tuple | None] = {}
        #: boundaries committed at, those of them that a walk along the back pointers found, the widest window so far, and stretches that the memory answered
        self.commits = self.walks = self.widest = self.hits = 0
        self.known: dict[str, bytes] = {}  # ids as little-endian 32-bit integers
        self.old: dict[str, bytes] = {}

    def automaton(self) -> list:
        """The automaton of Aho and Corasick over the pieces; a node holds what may follow, its longest proper suffix that begins a piece, the pieces (and their lengths) that end there, longest first, and its depth."""
        leaf: dict[str, list] = {}
        root = [{}, None, (), 0]
        level = [("", root)]
        begun = {p[:n] for p in self.vocab for n in range(1, len(p))}
        follow: dict[str, list[str]] = {}
        for p in begun | self.vocab.keys():
            follow.setdefault(p[:-1], []).append(p)
        while level:
            deeper = []
            for name, node in level:
                for p in follow.get(name, ()):
                    suffix = node[1]
                    while suffix is not None and p[-1] not in suffix[0]:
                        suffix = suffix[1]
                    suffix = root if suffix is None else suffix[0][p[-1]]
                    ending = ((self.vocab[p], len(p)), *suffix[2]) if p in self.vocab else suffix[2]
                    node[0][p[-1]] = made = [{} if p in begun else leaf, suffix, ending, len(p)]
                    deeper.append((p, made))
            level = deeper
        return root

    def grow(self, piece: int, side: int) -> tuple | None:
        """The merge rules on one piece by itself (the best-scored neighbours first, the leftmost among equals): the edge of a side and the score of the next merge, at each step. None if they don't make the piece."""
        parts, score, out = list(self.name[piece]), self.score, []
        while True:
            best, at = -np.inf, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and s > best:
                    best, at = s, i
            out += [parts[side], best]
            if at < 0:
                return tuple(out) if len(parts) == 1 else None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether the rules leave pieces a and b as they are when b follows a.

        Up to a merge over the boundary both sides go as they would alone, the better next merge first; so it is enough
        to look for a moment at which what stands on both sides of the boundary merges before either side goes on.
        """
        if a not in self.rights:
            self.rights[a] = self.grow(a, -1)
        if b not in self.lefts:
            self.lefts[b] = self.grow(b, 0)
        x, y, score = self.rights[a], self.lefts[b], self.score.get
        if x is None or y is None:
            return False
        i = j = 0
        while True:
            over, next_x, next_y = score(x[i] + y[j]), x[i + 1], y[j + 1]
            if over is not None and over > next_x and over >= next_y:
                return False
            if next_x >= next_y:
                if next_x == -np.inf:
                    return True
                i += 2
            else:
                j += 2

    def fit(self, a: int, b: int) -> bool:
        """stay_apart(), remembered."""
        if self.pairs >= PAIRS:
            for of in self.apart:
                of.clear()
            self.pairs = 0
        fits = self.apart[a][b] = self.stay_apart(a, b)
        self.pairs += 1
        return fits

    def viterbi(self, text: str, ends: frozenset[int] = frozenset()) -> Iterator[tuple[int, list[int]]]:
        """Boundaries of a text without its mark in front as they are found, each with the ids up to it from the one before; characters without a piece come as -1 - code point. ends: places that no piece runs over in any text, where no two pieces can join.

        At each place the pieces that end there are tried, longest first; the paths to their starts are settled. A place that
        no piece runs over by what follows it is a boundary.
        """
        root, longest, apart, fit = self.root, self.longest, self.apart, self.fit
        node = root
        # the window: the last piece of the best path to each place from base on, and which pieces are known to fit after it (None: all do)
        last: list[int | None] = [None]
        after: list[dict[int, bool] | None] = [None]
        base, next_walk = 0, longest
        for at, c in enumerate(text):
            while (step := node[0].get(c)) is None and node is not root:
                node = node[1]
            if step is not None:
                node = step
            if (step is None or node[3] == 1) and at:  # every path passes here
                yield at, self.path(last, at - base)
                self.note(len(last))
                if at in ends:
                    last, after = [None], [None]
                else:
                    del last[:-1], after[:-1]
                base, next_walk = at, at + longest
            if step is None:  # a character without a piece
                last.append(-1 - ord(c))
                after.append(None)
                continue
            for piece, size in node[2]:
                known = after[-size]
                if known is None or (fits if (fits := known.get(piece)) is not None else fit(last[-size], piece)):
                    break
            last.append(piece)
            after.append(apart[piece])
            if at >= next_walk:
                top = len(last) - 1
                live = set(range(top - node[3], top + 1))  # pieces to come start at one of these
                while len(live) > 1:  # walk the youngest back until all meet
                    live.discard(young := max(live))
                    live.add(young - (self.size[last[young]] if last[young] >= 0 else 1))
                if meet := live.pop():
                    self.walks += 1
                    base += meet
                    yield base, self.path(last, meet)
                    self.note(len(last))
                    del last[:meet], after[:meet]
                next_walk = at + longest
        self.note(len(last))
        yield len(text), self.path(last, len(last) - 1)

    def note(self, window: int) -> None:
        self.commits += 1
        if window > self.widest:
            self.widest = window

    def path(self, last: list[int], end: int) -> list[int]:
        """The pieces between two boundaries that all paths pass, the window's first place and one further on."""
        out, size = [], self.size
        while end:
            out.append(piece := last[end])
            end -= size[piece] if piece >= 0 else 1
        out.reverse()
        return out

    def passed(self, stretches: list[str]) -> list[bytes]:
        """Ids of stretches that follow one another and are not remembered, by one pass over all of them."""
        out: list[bytes] = []
        ids: list[int] = []
        ends = list(accumulate(map(len, stretches)))
        end = ends[0]
        for at, committed in self.viterbi("".join(stretches), frozenset(ends)):
            if min(committed) >= 0:
                ids += committed
            else:
                for piece in committed:
                    ids += [piece] if piece >= 0 else [self.bytes[b] for b in chr(-1 - piece).encode("utf-8", "surrogatepass")]
            if at == end:
                stretch, mine = stretches[len(out)], array("i", ids).tobytes()
                if len(stretch) <= STRETCH:
                    self.remember(stretch, mine)
                out.append(mine)
                ids = []
                if len(out) < len(ends):
                    end = ends[len(out)]
        return out

    def remember(self, stretch: str, ids: bytes) -> None:
        """Two generations: what is not met again while MEMORY / 2 others come in is forgotten."""
        if len(self.known) >= MEMORY // 2:
            self.old, self.known = self.known, {}
        self.known[stretch] = ids

    def packed(self, text: str | None) -> bytes:
        """Ids of a text, as the library gives them, in 32 bits each; the text is taken block by block."""
        if not text:
            return b""
        if len(text) < BLOCK:
            return self.run(self.stretches.findall(MARK + text.replace(" ", MARK)))
        out, rest = [], MARK
        for at in range(0, len(text), BLOCK):
            found = self.stretches.findall(rest + text[at : at + BLOCK].replace(" ", MARK))
            rest = found.pop() if at + BLOCK < len(text) else ""  # it may go on in the next block
            out.append(self.run(found))
        return b"".join(out)

    def run(self, stretches: list[str]) -> bytes:
        """Ids of stretches between boundaries that all paths pass."""
        known = self.known
        try:
            out = [known[s] for s in stretches]
            self.hits += len(out)
            return b"".join(out)
        except KeyError:
            out, new = [], []
            for s in stretches:
                ids = self.known.get(s)
                if ids is None and (ids := self.old.get(s)) is not None:
                    self.remember(s, ids)
                if ids is None:
                    new.append(s)
                    continue
                if new:
                    out += self.passed(new)
                    new = []
                self.hits += 1
                out.append(ids)
            return b"".join([*out, *(self.passed(new) if new else [])])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids, as the library gives it: a byte that starts no whole character becomes a replacement character, controls nothing, and a mark in front goes."""
        surface = self.surface
        if self.high.isdisjoint(ids):
            text = "".join([surface[i] for i in ids])
        else:
            parts, run = [], bytearray()
            for i in ids:
                if i in self.raw:
                    run.append(self.raw[i])
                else:
                    if run:
                        parts.append(run.decode("utf-8", "one_per_byte"))
                        run = bytearray()
                    parts.append(surface[i])
            text = "".join([*parts, run.decode("utf-8", "one_per_byte")])
        return text[1:] if text.startswith(" ") and self.marked(ids) else text

    def marked(self, ids: list[int]) -> bool:
        """Whether the first piece with a text begins with the mark itself."""
        return next((i in self.name for i in ids if self.surface[i] or i in self.raw), False)


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """This process's model; its memory outlives a task."""
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def encode(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """Adds n_ids (long), ids_sha256 (of the ids as little-endian 32-bit integers), decoded_sha256 (of the decoded text), round_trip and, if asked, ids to each row of docs; the text is not returned.

    path: a SentencePiece model on every machine. Null and empty texts have no
    ids. round_trip is false only where the text holds the mark character
    itself, which reads back as a blank. Repeated rows are all returned, an empty table
    gives none, and columns of these names are replaced.
    """
    added = {"n_ids": "long", "ids_sha256": "string", "decoded_sha256": "string", "round_trip": "boolean"} | ({"ids": "array<int>"} if with_ids else {})
    rest = without(docs, *added, "ids", "text")
    packed = docs.select(F.struct(*[rest[c] for c in rest.columns]).alias("row"), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for b in batches:
            for part in range(0, b.num_rows, 500):
                some = b.slice(part, 500)
                rows = []
                for text in some.column(1).to_pylist():
                    ids = np.frombuffer(packed_ids := model.packed(text), np.int32)
                    decoded = model.decode(ids.tolist())
                    rows.append((len(ids), hashlib.sha256(packed_ids).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest(), decoded == (text or ""), ids))
                columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.bool_()))]
                if with_ids:
                    columns.append(pa.array([r[4] for r in rows], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([some.column(0), *columns], ["row", *added])

    schema = f"row {packed.schema['row'].dataType.simpleString()}, " + ", ".join(f"{c} {t}" for c, t in added.items())
    return packed.mapInArrow(run, schema).select("row.*", *added)
