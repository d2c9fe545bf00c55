"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The trellis has a state for each boundary of the text and an edge for each piece. For a merge (BPE)
model an edge may follow another if the two pieces stay apart when merged together; as merges are local, a sequence all of
whose neighbours stay apart is the model's own encoding, so the surviving path is the library's result.
For a unigram model the edges carry scores and the best sum survives. Only a window bounded by the longest
piece is kept: as soon as all surviving backpointer paths meet in one boundary, the ids before it are committed.

Boundaries that no piece of the vocabulary crosses (before a blank that follows another character, around line feeds, between letters and
other characters) are such meeting points always. What the pass has committed between two of them is remembered in each worker (the last MEMO segments or more,
2 * MEMO at most), as the pass would commit it again.

Encoding is reversible for every text: characters without a piece go out as byte pieces, and so does a
literal U+2581, which the library would turn into a blank.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, tidy

#: Where the public model lies in this environment; a parameter of every function.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
MEMO = 250_000
#: What a character without a piece costs in a unigram model.
NO_PIECE = 1e6


@dataclass
class Vocabulary:
    """ids and ranks of the normal pieces, ids of the byte pieces, the bytes of every id, and whether the model merges."""

    ids: dict[str, int]
    ranks: dict[str, float]
    byte_ids: list[int]
    spelled: list[bytes]
    merges: bool
    prefix: bool
    splits: dict[str, tuple[str, str]] = field(default_factory=dict)
    odd: set[str] = field(default_factory=set)


def load(path: str = MODEL) -> Vocabulary:
    """Reads a model file on the driver; its normaliser must be the identity and bytes must have pieces."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces or not model.trainer_spec.byte_fallback:
        raise ValueError("only models with the identity normaliser and byte pieces can be reversed")
    ids, ranks, byte_ids, spelled = {}, {}, [0] * 256, []
    for k, p in enumerate(model.pieces):
        raw = b""
        if p.type == 6:
            raw = bytes([int(p.piece[3:5], 16)])
            byte_ids[raw[0]] = k
        elif p.type in (1, 4):
            ids[p.piece], ranks[p.piece] = k, -p.score
            raw = p.piece.replace(BLANK, " ").encode()
        spelled.append(raw)
    out = Vocabulary(ids, ranks, byte_ids, spelled, model.trainer_spec.model_type == 2, model.normalizer_spec.add_dummy_prefix)
    if out.merges:
        _derive(out)
    return out


def merge(symbols: list[str], ranks: dict[str, float]) -> tuple[list[str], tuple[str, str] | None]:
    """The merge rule itself, for short strings: join the best-ranked, leftmost neighbours until none is a piece. Also the last join."""
    last = None
    while True:
        found = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in ranks]
        if not found:
            return symbols, last
        k = min(found)[1]
        last = (symbols[k], symbols[k + 1])
        symbols = [*symbols[:k], symbols[k] + symbols[k + 1], *symbols[k + 2 :]]


def _derive(v: Vocabulary) -> None:
    """How each piece is made. A piece that is not made of earlier ones in order of rank is odd: its neighbours are tried by the merge rule."""
    for piece in sorted(v.ids, key=len):
        if len(piece) == 1:
            continue
        made, last = merge(list(piece), v.ranks)
        if made != [piece]:
            v.odd.add(piece)
            continue
        v.splits[piece] = last
        if any(len(x) > 1 and (x in v.odd or v.ranks[x] >= v.ranks[piece]) for x in last):
            v.odd.add(piece)


def stay_apart(left: str, right: str, v: Vocabulary) -> bool:
    """True if the pieces, merged together, come out as themselves.

    Follows the right edge of one and the left edge of the other back in time; a join across the boundary happens
    if it ranks before the joins that would use up either side.
    """
    ranks, splits = v.ranks, v.splits
    if left in v.odd or right in v.odd:
        return merge(list(left + right), ranks)[0] == [left, right]
    a, b, used_a, used_b = left, right, float("inf"), float("inf")
    while True:
        r = ranks.get(a + b)
        if r is not None and r < used_a and r <= used_b:
            return False
        fa, fb = (ranks[a] if len(a) > 1 else None), (ranks[b] if len(b) > 1 else None)
        if fa is None and fb is None:
            return True
        if fb is None or (fa is not None and fa > fb):
            used_a, a = fa, splits[a][1]
        else:
            used_b, b = fb, splits[b][0]


class Encoder:
    """Encodes and decodes with one vocabulary; remembers segments and neighbours up to a bound."""

    def __init__(self, v: Vocabulary) -> None:
        self.v, self.longest = v, max(map(len, v.ids))
        self.starts = {p[:k] for p in v.ids for k in range(1, len(p) + 1)}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        #: The id of each piece, -1 for what only begins one; and for each first piece what may follow it.
        self.known = dict.fromkeys(self.starts, -1) | v.ids
        self.names = {k: p for p, k in v.ids.items()}
        self.costs = {k: v.ranks[p] for p, k in v.ids.items()}
        self.follows: dict[int, dict[int, bool]] = {}
        self.pairs = 0
        self.cut = re.compile(self._boundaries())

    def _boundaries(self) -> str:
        """A pattern of segments between boundaries that no piece crosses, as far as this vocabulary has such boundaries."""
        bodies = [p.lstrip(BLANK) for p in self.v.ids]
        if any(BLANK in b for b in bodies):
            return "(?s).+"
        letter = re.compile(r"[^\W\d_]")
        if any(len({bool(letter.match(c)) for c in b}) > 1 for b in bodies):
            return f"{BLANK}*[^{BLANK}]+|{BLANK}+"
        feed = "" if "\n" in self.starts else "\n"
        other = rf"(?:(?![^\W\d_])[^{BLANK}{feed}])+"
        return rf"{BLANK}*[^\W\d_]+|{BLANK}*{other}|{BLANK}+" + (r"|\n" if feed else "")

    def stream(self, text: str) -> Iterator[list[int]]:
        """The ids of an escaped text (blanks as U+2581), committed up to where all surviving backpointer paths meet, a list whenever the window is full.

        The window is full once it holds as many characters as two of the longest pieces; if its paths don't meet, once it has doubled. Boundaries before the last commit are forgotten.
        """
        return self._merged(text) if self.v.merges else self._scored(text)

    def _merged(self, text: str) -> Iterator[list[int]]:
        """stream() of a merge model: an edge may follow another if the two pieces stay apart."""
        n, known, follows, longest = len(text), self.known, self.follows, self.longest
        base, due = 0, 2 * longest  # the window begins at boundary base
        back = [-1] * ((n if n < due else due + longest) + 1)  # where the edge to a boundary begins
        edge = back[:]  # its piece, -1 for a character without one
        back[0] = 0
        for at in range(n):
            k = at - base
            if back[k] < 0:
                continue
            if k >= due:
                met = self._meeting(back, base, at)
                yield self._path(text, back, edge, base, met)
                gone, base = met - base, met
                k -= gone
                due = max(2 * longest, 2 * k)
                room = [-1] * (due + longest + 1 - len(back) + gone)
                back, edge = back[gone:] + room, edge[gone:] + room
            before = edge[k]
            may = follows.get(before)
            if may is None:
                may = follows[before] = {}
            end, j, piece = at + 1, k + 1, known.get(text[at])
            if (piece is None or piece < 0) and back[j] < 0:
                back[j] = at
            while piece is not None:
                if piece >= 0 and back[j] < 0:  # an encoding is unique, so a boundary is reached by one path
                    ok = may.get(piece)
                    if ok is None:
                        ok = may[piece] = before < 0 or stay_apart(self.names[before], self.names[piece], self.v)
                        self.pairs += 1
                        if self.pairs > 4 * MEMO:
                            follows.clear()
                            self.pairs = 0
                    if ok:
                        back[j], edge[j] = at, piece
                end += 1
                if end > n:
                    break
                j += 1
                piece = known.get(text[at:end])
        if n:
            yield self._path(text, back, edge, base, n)

    def _scored(self, text: str) -> Iterator[list[int]]:
        """stream() of a unigram model: the least sum of costs survives."""
        n, known, costs, longest = len(text), self.known, self.costs, self.longest
        base, due = 0, 2 * longest
        back = [-1] * (due + longest + 1)
        edge, cost = back[:], [0.0] * len(back)
        back[0] = 0
        for at in range(n):
            k = at - base
            if back[k] < 0:
                continue
            if k >= due:
                met = self._meeting(back, base, at)
                yield self._path(text, back, edge, base, met)
                gone, base = met - base, met
                k -= gone
                due = max(2 * longest, 2 * k)
                room = [-1] * (due + longest + 1 - len(back) + gone)
                back, edge, cost = back[gone:] + room, edge[gone:] + room, cost[gone:] + [0.0] * len(room)
            edges, end = [], at + 1
            if known.get(text[at], -1) < 0:
                edges.append((k + 1, -1, cost[k] + NO_PIECE))
            while end <= n and (piece := known.get(text[at:end])) is not None:
                if piece >= 0:
                    edges.append((end - base, piece, cost[k] + costs[piece]))
                end += 1
            for j, piece, sum_ in edges:
                if back[j] < 0 or sum_ < cost[j]:
                    back[j], edge[j], cost[j] = at, piece, sum_
        if n:
            yield self._path(text, back, edge, base, n)

    @staticmethod
    def _meeting(back: list[int], base: int, at: int) -> int:
        """The last boundary that the paths of all boundaries from `at` on have in common. Steps back the rightmost path until one is left; all begin in `base`."""
        live = {base + k for k in range(at - base, len(back)) if back[k] >= 0}
        while len(live) > 1:
            last = max(live)
            live.remove(last)
            live.add(back[last - base])
        return live.pop()

    def _path(self, text: str, back: list[int], edge: list[int], base: int, end: int) -> list[int]:
        out: list[int] = []
        while end > base:
            start, piece = back[end - base], edge[end - base]
            if piece >= 0:
                out.append(piece)
            else:
                out += [self.v.byte_ids[x] for x in reversed(text[start:end].encode("utf-8", "surrogatepass"))]
            end = start
        out.reverse()
        return out

    def encode(self, text: str | None) -> np.ndarray:
        """The ids; none for an empty or null text."""
        if not text:
            return np.empty(0, np.int32)
        memo, out, stream = self.memo, [], self._merged if self.v.merges else self._scored
        for k, part in enumerate(text.split(BLANK)):
            if k:
                out.append(np.array([self.v.byte_ids[x] for x in BLANK.encode()], np.int32).tobytes())
            part = part.replace(" ", BLANK)
            for segment in self.cut.findall(BLANK + part if not k and self.v.prefix else part):
                ids = memo.get(segment)
                if ids is None:
                    ids = self.older.get(segment)
                    if ids is None:
                        ids = b"".join([array("i", committed).tobytes() for committed in stream(segment)])
                    if len(segment) <= 4 * self.longest:
                        if len(memo) >= MEMO:
                            self.older, self.memo = memo, {}
                            memo = self.memo
                        memo[segment] = ids
                out.append(ids)
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.v.spelled.__getitem__, ids.tolist()))
        return (raw[1:] if self.v.prefix and raw[:1] == b" " else raw).decode("utf-8", "surrogatepass")


#: The encoder of the last vocabulary that this worker has seen, with its memory.
_LAST: list = []


def _encoder(shared) -> Encoder:
    v = shared.value
    if not _LAST or _LAST[0] is not v:
        _LAST[:] = [v, Encoder(v)]
    return _LAST[1]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, check: bool = True) -> DataFrame:
    """(doc_id, ids, n_ids, round_trip) for every row of `docs`.

    ids are those of the whole text; an empty or null text has none. round_trip says that decoding gave the text back (null if `check` is off). Repeated rows
    and null ids stay as they are; other columns are ignored. The vocabulary (a few MB) is read by the driver and broadcast.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load(model or MODEL))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(shared)
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, len(texts), 256):  # so that a batch's ids stay small
                part = [t.as_py() for t in texts.slice(at, 256)]
                got = [own.encode(t) for t in part]
                ends = np.concatenate([[0], np.cumsum([len(g) for g in got])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(got)))
                same = [own.decode(g) == (t or "") for g, t in zip(got, part)] if check else [None] * len(part)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), ids, pa.array(np.diff(ends)), pa.array(same, pa.bool_())], names=["doc_id", "ids", "n_ids", "round_trip"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, ids array<int>, n_ids int, round_trip boolean")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null or no ids give an empty text."""
    ship(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(load(model or MODEL))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(shared)
        for batch in batches:
            texts = [own.decode(np.array(x.as_py() or [], np.int32)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, text string")
