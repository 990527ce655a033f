"""SentencePiece (BPE) encoding and decoding with a prefix table.

For every prefix of a chunk of text there is exactly one last piece of its
encoding. An Aho-Corasick automaton over the pieces gives the candidates that
end at a position; a candidate is the last piece if it is compatible with the
last piece of the prefix before it, that is, if the two pieces next to each
other are never merged across their border. The table is filled from the left
and the ids are recovered backwards. Merges go by score, leftmost first; pieces
that merges can't build are no candidates; characters outside the vocabulary
fall back to bytes.

Text is cut into chunks only where no piece of the vocabulary spans the cut
(checked when a model is loaded), so chunks are encoded alone and short ones
are remembered, in a table of bounded size.

Defined results: null and empty texts encode to the end id alone and decode to
the empty text; texts of any length take time linear in their length; columns
other than the id and the text are ignored whatever their names are.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table

SPACE = "▁"
#: Chunks and piece pairs that a worker remembers.
MEMORY = 400_000
_COARSE = re.compile(rf"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _ranges(of: Callable[[int], bool]) -> str:
    """A character class of the code points below 65536 that ``of`` accepts."""
    out, start = [], None
    for c in range(0x10001):
        inside = c < 0x10000 and of(c)
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\u{start:04x}-\\u{c - 1:04x}")
            start = None
    return "".join(out)


@functools.cache
def _fine() -> re.Pattern:
    """Cuts between letters and anything else, and before spaces that follow something else."""
    letters, others = _ranges(lambda c: chr(c).isalpha()), _ranges(lambda c: not chr(c).isalpha() and chr(c) != SPACE)
    return re.compile(rf"{SPACE}*[{letters}]+|{SPACE}*[{others}\U00010000-\U0010ffff]+|{SPACE}+")


class PieceTable:
    """Encoder and decoder of one model file's bytes."""

    def __init__(self, model: bytes) -> None:
        import ahocorasick
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = lib.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(n)]
        self.eos = lib.eos_id()
        self.bytes = {}
        self.rank: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.surface: list[bytes] = []
        for i, p in enumerate(names):
            if lib.is_byte(i):
                self.bytes[int(p[1:-1], 16)] = i
                self.surface.append(bytes([int(p[1:-1], 16)]))
            elif lib.is_control(i):
                self.surface.append(b"")
            elif lib.is_unknown(i):
                self.unk = i
                self.surface.append(" ⁇ ".encode())
            else:
                self.rank[p] = -lib.get_score(i)
                self.ids[p] = i
                self.surface.append(p.replace(SPACE, " ").encode())
        self.said = {str(i): s for i, s in enumerate(self.surface)}
        self._events: dict[str, tuple | None] = {}
        self._pairs: dict[tuple[str, str], bool] = {}
        self._chunks: dict[str, str] = {}
        auto = ahocorasick.Automaton()
        for p in self.rank:
            if len(p) > 1 and self.events(p) is not None:
                auto.add_word(p, p)
        auto.make_automaton()
        self.auto = auto
        self.cut = _fine()
        fine = all(len(self.cut.findall(a + b)) == 1 for a, b in {(p[i], p[i + 1]) for p in self.rank for i in range(len(p) - 1)})
        if not fine:
            self.cut = _COARSE
        if not fine and any(SPACE in p.lstrip(SPACE) for p in self.rank):
            self.cut = re.compile(r"[\s\S]+")

    def events(self, piece: str) -> tuple | None:
        """The merges that build a piece, in order, as (score rank, first symbol after it, last symbol after it); None if merges build something else."""
        if piece in self._events:
            return self._events[piece]
        rank = self.rank
        symbols, out = list(piece), []
        while len(symbols) > 1:
            best, at = min(((rank.get(symbols[i] + symbols[i + 1], float("inf")), i) for i in range(len(symbols) - 1)))
            if best == float("inf"):
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            out.append((best, symbols[0], symbols[-1]))
        self._events[piece] = tuple(out) if len(symbols) == 1 else None
        return self._events[piece]

    def compatible(self, a: str, b: str) -> bool:
        """Do two pieces side by side stay two pieces?

        Both are built at once, the better merge first and the left one on a
        tie; they fail if a merge across the border would come before.
        """
        known = self._pairs.get((a, b))
        if known is not None:
            return known
        rank, inf = self.rank, float("inf")
        left, right = self.events(a) or (), self.events(b) or ()
        i = j = 0
        last, first = a[0] if not left else a[-1], b[0]
        good = True
        while True:
            across = rank.get(last + first, inf)
            x = left[i][0] if i < len(left) else inf
            y = right[j][0] if j < len(right) else inf
            if across < inf and across < x and across <= y:
                good = False
                break
            if x == inf and y == inf:
                break
            if x <= y:
                last = left[i][2]
                i += 1
            else:
                first = right[j][1]
                j += 1
        if len(self._pairs) >= MEMORY:
            self._pairs.clear()
        self._pairs[a, b] = good
        return good

    def _run(self, text: str, out: list[int]) -> None:
        """Ids of a text whose characters all are pieces.

        The automaton holds the pieces of two characters and more; where none
        of those is compatible, the last piece is the single character.
        """
        n = len(text)
        lasts = ["", *text]
        pairs, compatible = self._pairs, self.compatible
        at = 0
        for end, piece in self.auto.iter(text):  # for each end, longest first
            if end == at:
                continue
            start = end + 1 - len(piece)
            if start:
                good = pairs.get((lasts[start], piece))
                if good is None:
                    good = compatible(lasts[start], piece)
                if not good:
                    continue
            lasts[end + 1] = piece
            at = end
        back, ids = [], self.ids
        while n:
            piece = lasts[n]
            back.append(ids[piece])
            n -= len(piece)
        back.reverse()
        out.extend(back)

    def chunk_ids(self, chunk: str) -> list[int]:
        out: list[int] = []
        rank, start = self.rank, 0
        for i, c in enumerate(chunk):
            if c not in rank:
                if start < i:
                    self._run(chunk[start:i], out)
                out.extend(self.bytes.get(b, self.unk) for b in c.encode("utf-8", "replace"))
                start = i + 1
        if start < len(chunk):
            self._run(chunk[start:] if start else chunk, out)
        return out

    def _chunk(self, chunk: str) -> str:
        said = "".join(f"{i} " for i in self.chunk_ids(chunk))
        if len(chunk) <= 48:
            if len(self._chunks) >= MEMORY:
                self._chunks.clear()
            self._chunks[chunk] = said
        return said

    def encode_said(self, text: str | None) -> str:
        """The ids, the end id last, in decimal and joined by spaces."""
        if not text:
            return str(self.eos)
        get, own = self._chunks.get, self._chunk
        return "".join([get(c) or own(c) for c in self.cut.findall(SPACE + text.replace(" ", SPACE))]) + str(self.eos)

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in self.encode_said(text).split(" ")]

    def decode_said(self, said: str) -> str:
        return self._text(b"".join(map(self.said.__getitem__, said.split(" "))) if said else b"")

    def decode(self, ids: list[int]) -> str:
        return self._text(b"".join(self.surface[i] for i in ids))

    @staticmethod
    def _text(raw: bytes) -> str:
        return raw.decode("utf-8", "replace").removeprefix(" ")


_TABLES: dict[str, PieceTable] = {}


def piece_table(model: bytes) -> PieceTable:
    """The table of a model, made once a worker."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _TABLES:
        _TABLES[key] = PieceTable(model)
    return _TABLES[key]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """doc_id, ids (if wanted), n_tokens, ids_sha256 and decoded_sha256 of every document.

    The model file is read by the driver and sent to the executors once; its
    size doesn't depend on the data.
    """
    with open(model_path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        t = piece_table(sent.value)

        def row(doc_id, text):
            said = t.encode_said(text)
            end = said.rfind(" ")
            decoded = t.decode_said(said[: max(end, 0)])
            out = (doc_id, said.count(" ") + 1, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "replace")).hexdigest())
            return (*out, [int(i) for i in said.split(" ")]) if ids else out

        return row

    return map_rows(docs.select(F.col(id_col), F.col(text_col)), make, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)


def decode(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of rows of ids; null ids decode to the empty text."""
    with open(model_path, "rb") as f:
        sent = rows.sparkSession.sparkContext.broadcast(f.read())
    kind = rows.schema[id_col].dataType.simpleString()

    def make():
        t = piece_table(sent.value)
        return lambda doc_id, found: (doc_id, t.decode(found or []))

    return map_rows(rows.select(F.col(id_col), F.col(ids_col)), make, f"doc_id {kind}, text string")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), model_path(), ids=False)
