"""SentencePiece encoding and decoding as shortest paths through a weighted transducer."""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from roomfold.llm.arrow import map_chunks, remembers

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
# Piece types and model types of the file format.
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6
_UNIGRAM, _BPE = 1, 2
#: Remembered paths, piece pairs and beginnings of one Python worker; beyond that the memory starts afresh.
_PATHS, _PAIRS, _ENDS = 200_000, 400_000, 500_000
#: Characters of a part up to which its beginnings are remembered.
_SHORT = 24


class Transducer:
    """Normaliser, pieces and byte fallback, compiled from a model file.

    The normaliser maps white space to a visible mark and puts one in front. The piece transducer has an
    arc for every piece that starts at a position, and byte arcs for a character that no piece covers.
    Composing it with an input gives a lattice over positions; the encoding is its tropical shortest
    path. A unigram model weighs arcs by piece scores. For a pair-merging model the path also passes a
    bigram acceptor: two pieces may stand next to each other only if merging their joint text gives
    just these two, which leaves exactly the path that the merges would have produced.
    """

    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        model.ParseFromString(data)
        rules, self.kind = model.normalizer_spec, model.trainer_spec.model_type
        if self.kind not in (_UNIGRAM, _BPE) or rules.precompiled_charsmap or rules.remove_extra_whitespaces:
            raise ValueError("only unigram and pair-merging models without a character map are supported")
        self.prefix = rules.add_dummy_prefix
        self.pieces = [p.piece for p in model.pieces]
        self.size = len(self.pieces)
        normal = [i for i, p in enumerate(model.pieces) if p.type in (_NORMAL, _USER)]
        self.weight = [-p.score for p in model.pieces]
        self.bytes = [0] * 256
        for i, p in enumerate(model.pieces):
            if p.type == _BYTE:
                self.bytes[int(p.piece[1:-1], 16)] = i
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == _UNKNOWN)
        self.fallback = any(self.bytes)
        self.missing = max(self.weight[i] for i in normal) + 10
        #: arcs into a position: every ending of a piece; -1 where the ending is no piece itself
        self.arcs: dict[str, int] = {}
        for i in normal:
            for n in range(1, len(self.pieces[i])):
                self.arcs.setdefault(self.pieces[i][n:], -1)
        self.arcs |= {self.pieces[i]: i for i in normal}
        names = [self.pieces[i] for i in normal]
        # no piece spans a mark that follows other characters, nor a control character that is in no piece
        used = set("".join(names))
        lone = "".join(f"\\x{c:02x}" for c in range(32) if chr(c) not in used)
        apart = lone and not any(SPACE in x.lstrip(SPACE) for x in names)
        self.part = re.compile(f"{SPACE}*[^{SPACE}{lone}]+|{SPACE}+|[{lone}]" if apart else r"(?s).+")
        self.raw = [bytes([self.bytes.index(i)]) if p.type == _BYTE else p.piece.encode() if p.type in (_NORMAL, _USER)
                    else b"" for i, p in enumerate(model.pieces)]
        self.raw[self.unknown] = " ⁇ ".encode()
        self.paths: dict[str, tuple[int, ...]] = {}
        self.ends: dict[str, int] = {}
        self.pairs: dict[int, bool] = {}  # of left << 21 | right; left is -1 in front of the first piece

    def normalise(self, text: str) -> str:
        return ((SPACE if self.prefix else "") + text.replace(" ", SPACE)) if text else ""

    def _symbol(self, i: int) -> str:
        return self.pieces[i] if i < self.size else chr(i - self.size)

    def merged(self, text: str) -> list[str]:
        """Symbols after merging the best pair, leftmost first, for as long as one is a piece."""
        symbols = list(text)
        while True:
            best, at = math.inf, -1
            for k in range(len(symbols) - 1):
                piece = self.arcs.get(symbols[k] + symbols[k + 1], -1)
                if piece >= 0 and self.weight[piece] < best:
                    best, at = self.weight[piece], k
            if at < 0:
                return symbols
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]

    def _adjacent(self, left: int, right: int) -> bool:
        """Whether the bigram acceptor has an arc."""
        key = left << 21 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= _PAIRS:
                self.pairs.clear()
            a, b = self._symbol(left), self._symbol(right)
            known = self.pairs[key] = self.merged(a + b) == [a, b]
        return known

    def _into(self, part: str, j: int) -> list[tuple[int, int]]:
        """Arcs (from, symbol) of the lattice into position ``j``, the shortest first."""
        arcs, into = self.arcs, []
        for i in range(j - 1, -1, -1):
            piece = arcs.get(part[i:j])
            if piece is None:
                break
            if piece >= 0:
                into.append((i, piece))
        if not into or into[0][0] < j - 1:  # no piece for the character alone
            into.insert(0, (j - 1, self.size + ord(part[j - 1])))
        return into

    def _admitted(self, part: str, j: int, last: list[int]) -> int:
        """The symbol that ends a path to ``j``: the bigram acceptor lets just one through; the longest are tried first."""
        pairs = self.pairs
        for i, piece in reversed(self._into(part, j)):
            left = last[i]
            known = pairs.get(left << 21 | piece)
            if known is None:
                known = self._adjacent(left, piece) if left >= 0 else self._first(piece)
            if known:
                return piece
        raise ValueError("no path")

    def _end(self, begin: str) -> int:
        """The symbol that ends the path through a beginning of a few characters.

        It depends on that text alone, so it is remembered, and many words share it. Only the positions that an arc
        leads back to are looked at.
        """
        piece = self.ends.get(begin)
        if piece is not None:
            return piece
        pairs = self.pairs
        for i, piece in reversed(self._into(begin, len(begin))):
            left = self._end(begin[:i]) if i else -1
            known = pairs.get(left << 21 | piece)
            if known is None:
                known = self._adjacent(left, piece) if i else self._first(piece)
            if known:
                if len(self.ends) >= _ENDS:
                    self.ends.clear()
                self.ends[begin] = piece
                return piece
        raise ValueError("no path")

    def path(self, part: str) -> tuple[int, ...]:
        """Ids on the shortest path through the lattice of one part."""
        n, last = len(part), [-1]
        if self.kind == _BPE and n <= _SHORT:
            out, at = [], n
            while at > 0:
                piece = self._end(part[:at])
                at -= self._emit(piece, out)
            return tuple(reversed(out))
        if self.kind == _BPE:
            for j in range(1, n + 1):
                last.append(self._admitted(part, j, last))
        else:
            cost = [0.0]
            for j in range(1, n + 1):
                best, piece = min((cost[i] + (self.weight[p] if p < self.size else self.missing), p) for i, p in self._into(part, j))
                cost.append(best)
                last.append(piece)
        out: list[int] = []
        at = n
        while at > 0:
            at -= self._emit(last[at], out)
        return tuple(reversed(out))

    def _emit(self, piece: int, out: list[int]) -> int:
        """Append the ids of a symbol, last one first; how many characters it stands for."""
        if piece < self.size:
            out.append(piece)
            return len(self.pieces[piece])
        char = chr(piece - self.size).encode("utf-8", "surrogatepass")
        out += [self.bytes[b] for b in reversed(char)] if self.fallback else [self.unknown]
        return 1

    def _first(self, piece: int) -> bool:
        """Whether merging a piece's own text gives the piece; kept beside the pairs."""
        text = self._symbol(piece)
        known = self.pairs[-1 << 21 | piece] = self.merged(text) == [text]
        return known

    def encode(self, text: str | None) -> array:
        out, paths = array("i"), self.paths
        for part in self.part.findall(self.normalise(text or "")):
            ids = paths.get(part)
            if ids is None:
                ids = self.path(part)
                if len(part) <= 48:
                    if len(paths) >= _PATHS:
                        paths.clear()
                    paths[part] = ids
            out.extend(ids)
        return out

    def decode(self, ids: list[int] | None) -> str:
        """Text of the ids: bytes joined and read as UTF-8, marks back to spaces, the mark in front dropped."""
        raw = self.raw
        text = b"".join([raw[i] for i in ids or () if 0 <= i < self.size]).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.prefix and text[:1] == " " else text


@lru_cache(maxsize=2)
def compiled(data: bytes) -> Transducer:
    return Transducer(data)


remembers(__name__, compiled.cache_clear)


def read_model(path: str = MODEL_PATH) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _lists(rows: list[array]) -> pa.Array:
    flat = array("i")
    for r in rows:
        flat.extend(r)
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(flat, np.int32) if flat else np.empty(0, np.int32)))


def encode(docs: DataFrame, text: str = "text", path: str = MODEL_PATH, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) and ``ids``, the piece ids of the whole text; a column of that name is replaced.

    Null and empty texts have no ids. A visible space mark in a text is read as a space. Each row is encoded on its
    own, so repeated rows get equal ids. The model file, a fixed vocabulary, is read once and broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_model(path))
    keep = [c for c in (docs.columns if keep is None else keep) if c != "ids"]
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("kept"), docs[text].alias("text"))
    kept = rows.schema["kept"].dataType.simpleString()

    def run(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        machine = compiled(shared.value)
        for part in parts:
            yield {"kept": part["kept"], "ids": _lists([machine.encode(t) for t in part["text"]])}

    return map_chunks(rows, "text", f"kept {kept}, ids array<int>", run).select("kept.*", "ids")


def decode(encoded: DataFrame, ids: str = "ids", path: str = MODEL_PATH, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) and ``decoded``; null ids give an empty text, ids beyond the vocabulary nothing."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_model(path))
    keep = [c for c in (encoded.columns if keep is None else keep) if c != "decoded"]
    rows = encoded.select(F.struct(*[encoded[c] for c in keep]).alias("kept"), encoded[ids].alias("ids"))
    kept = rows.schema["kept"].dataType.simpleString()

    def run(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        machine = compiled(shared.value)
        for part in parts:
            yield {"kept": part["kept"], "decoded": [machine.decode(x) for x in part["ids"]]}

    return map_chunks(rows, "ids", f"kept {kept}, decoded string", run).select("kept.*", "decoded")


def transcode(docs: DataFrame, text: str = "text", path: str = MODEL_PATH, keep: list[str] | None = None) -> DataFrame:
    """Encoding and decoding in one pass: the columns ``keep`` (default: all), ``ids`` and ``round_trip``.

    ``round_trip`` tells whether the ids decode to the text (null: the empty text); columns of the two names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_model(path))
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("ids", "round_trip")]
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("kept"), docs[text].alias("text"))
    kept = rows.schema["kept"].dataType.simpleString()

    def run(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        machine = compiled(shared.value)
        for part in parts:
            ids = [machine.encode(t) for t in part["text"]]
            same = [machine.decode(x) == (t or "") for x, t in zip(ids, part["text"])]
            yield {"kept": part["kept"], "ids": _lists(ids), "round_trip": same}

    return map_chunks(rows, "text", f"kept {kept}, ids array<int>, round_trip boolean", run).select("kept.*", "ids", "round_trip")
