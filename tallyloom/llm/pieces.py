"""SentencePiece encoding and decoding with an Aho-Corasick automaton and Viterbi.

The pieces of a ``.model`` file and their scores make a unigram vocabulary. Its
Aho-Corasick automaton reads a text once; at each position the output links give
every piece that ends there, longest first, and each relaxes the best score of
that position. The segmentation with the largest sum of scores wins, on ties the
longer last piece. Characters without a piece of their own may stand alone at a
penalty and become byte pieces.

No piece has a word mark after another character and none holds a line feed (the
vocabulary is checked for both), so no piece crosses the place before a run of
spaces or around a line feed. The best segmentation of a text is therefore that
of its units, and the automaton runs over many different units side by side, one
array step for each position; units met before come from a bounded cache. Units
with few of their length (text without spaces, say) go one by one.

Encoding follows the file's settings: a dummy space in front, spaces kept as word
marks, identity normalisation. A word mark that stands in the text itself goes to
byte pieces, so decoding gives back every text exactly.

The supplied public model was trained for merges (BPE), so its scores are merge
ranks; the Viterbi above treats them as scores, as the unigram kind of the same
library does, and its ids differ from those of merging.

Defined results: null and empty texts have no pieces and decode to the empty
text; rows that repeat are encoded alike; an empty table gives an empty result;
the only columns read are the id, the text and, if there, one struct ``_rest``.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from tallyloom.llm.base import KEPT, quoted, tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: What the unigram kind of the library subtracts from the least score for an unknown character.
UNKNOWN_PENALTY = 10.0
CACHED_UNITS, CACHED_LENGTH = 150_000, 48
#: Bytes whose next states are kept together; a row has 256 / STRETCH = 8 of them.
STRETCH = 32
#: Texts are encoded together up to so many bytes.
TOGETHER = 1_500_000
_LITERAL = b"\xff"  # stands for a word mark of the text; no piece holds this byte
_UNIT = re.compile(r" *[^ \n]+|\n| +")


class Vocabulary:
    """What tasks need of a model file; small enough to go with them."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: dict[int, int]):
        self.pieces, self.scores, self.byte_ids = pieces, scores, byte_ids
        self.normal = [i for i in range(len(pieces)) if pieces[i] and i not in set(byte_ids.values())]
        if any(re.search(f"[^{MARK}]{MARK}|\n", pieces[i]) for i in self.normal):
            raise ValueError("a piece crosses a unit")
        if len(byte_ids) != 256:
            raise ValueError("the vocabulary has no byte pieces")

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, scores, byte_ids = [], [], {}
        for i in range(p.get_piece_size()):
            pieces.append("" if p.is_control(i) or p.is_unknown(i) or p.is_unused(i) else p.id_to_piece(i))
            scores.append(p.get_score(i))
            if p.is_byte(i):
                byte_ids[int(pieces[i][3:5], 16)] = i
        return cls(pieces, scores, byte_ids)


class Automaton:
    """block, blocks: next state for state and byte (see ``after``); first: the longest piece that ends in a state;
    then: the state with the next shorter one (the output link)."""

    def __init__(self, vocabulary: Vocabulary):
        pieces = {vocabulary.pieces[i].encode(): i for i in reversed(vocabulary.normal)}
        children: list[dict[int, int]] = [{}]
        depth, ends = [0], {}
        for piece, i in pieces.items():
            state = 0
            for byte in piece:
                nxt = children[state].get(byte)
                if nxt is None:
                    nxt = children[state][byte] = len(children)
                    children.append({})
                    depth.append(depth[state] + 1)
                state = nxt
            ends[state] = i
        n = len(children)
        self.first = np.full(n, -1, np.int32)
        for state, i in ends.items():
            self.first[state] = i
        own = self.first.copy()
        goto = np.zeros((n, 256), np.int32)
        self.then = np.zeros(n, np.int32)  # 0: no more
        fail = np.zeros(n, np.int32)
        level = [0]
        while level:
            below = []
            for state in level:
                row = goto[state]
                if state:
                    row[:] = goto[fail[state]]
                for byte, child in children[state].items():
                    fail[child] = row[byte] if state else 0
                    row[byte] = child
                    back = fail[child]
                    self.then[child] = back if own[back] >= 0 else self.then[back]
                    below.append(child)
            level = below
        # most stretches of a row are those of other states: each different one is kept once
        rows = goto.reshape(-1, STRETCH)
        _, at, which = np.unique(rows.view(np.dtype((np.void, rows.dtype.itemsize * STRETCH))).ravel(), return_index=True, return_inverse=True)
        self.blocks, self.block = rows[at].ravel(), (which * STRETCH).astype(np.int32)
        # a state without a piece of its own starts at its output link
        none = np.flatnonzero((own < 0) & (self.then > 0))
        self.first[none] = own[self.then[none]]
        self.then[none] = self.then[self.then[none]]
        self.length = np.zeros(len(vocabulary.pieces), np.int32)
        for piece, i in pieces.items():
            self.length[i] = len(piece)
        self.score = np.array(vocabulary.scores, np.float64)
        self.unknown = min(vocabulary.scores[i] for i in vocabulary.normal) - UNKNOWN_PENALTY

    def after(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        return self.blocks[self.block[state.astype(np.int32) * 8 + (byte >> 5)] + (byte & 31)]


class Encoder:
    #: A step with fewer units goes byte by byte through plain numbers, as long units are few of a length.
    FEW = 24

    def __init__(self, vocabulary: Vocabulary):
        self.auto = Automaton(vocabulary)
        self.byte_ids = np.array([vocabulary.byte_ids[b] for b in range(256)], np.int32)
        self.cache: dict[str, bytes] = {}
        own = {i: b for b, i in vocabulary.byte_ids.items()}
        self.texts = [bytes([own[i]]) if i in own else p.replace(MARK, " ").encode() for i, p in enumerate(vocabulary.pieces)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids (int32) of each text."""
        units = [_UNIT.findall(" " + t) if t else [] for t in texts]
        new = {u for own in units for u in own}.difference(self.cache)
        found: dict[str, bytes] = {}
        if new:
            self._encode_units(sorted(new, key=len), found)
            if len(self.cache) + len(found) > CACHED_UNITS:
                kept = {u: self.cache[u] for own in units for u in own if u in self.cache}
                self.cache = kept if len(kept) < CACHED_UNITS else {}
                found.update(kept)
            for u, ids in found.items():
                if len(u) <= CACHED_LENGTH and len(self.cache) < CACHED_UNITS:
                    self.cache[u] = ids
        out = []
        for own in units:
            out.append(np.frombuffer(b"".join([found[u] if u in found else self.cache[u] for u in own]), np.int32))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        text = b"".join(map(self.texts.__getitem__, ids.tolist()))
        return text[1:]  # without the dummy space

    def _encode_units(self, units: list[str], found: dict[str, bytes]) -> None:
        coded = [u.encode().replace(b"\xe2\x96\x81", _LITERAL).replace(b" ", b"\xe2\x96\x81") for u in units]
        order = sorted(range(len(units)), key=lambda i: len(coded[i]))
        at = 0
        while at < len(order):
            # the units of a step are about as long, and the table of scores stays small
            stop = at + 1
            while stop < len(order) and stop - at < 20_000 and (stop - at + 1) * len(coded[order[stop]]) <= 2_000_000 and len(coded[order[stop]]) <= len(coded[order[at]]) + 4:
                stop += 1
            mine = order[at:stop]
            words = [coded[i] for i in mine]
            for i, ids in zip(mine, self._viterbi(words) if len(words) >= self.FEW else map(self._viterbi_one, words), strict=True):
                found[units[i]] = ids
            at = stop

    def _viterbi(self, words: list[bytes]) -> list[bytes]:
        auto, n, most = self.auto, len(words), max(map(len, words))
        text = np.frombuffer(b"".join([w.ljust(most, b"\0") for w in words]), np.uint8).reshape(n, most)
        sizes = np.array([len(w) for w in words])
        rows = np.arange(n)
        best = np.full((most + 1, n), -np.inf)
        best[0] = 0.0
        piece = np.full((most + 1, n), -1, np.int32)  # that ends there; -1: an unknown character
        start = np.zeros((most + 1, n), np.int32)
        state = np.zeros(n, np.int32)
        head = np.zeros(n, np.int32)  # where the current character starts
        for t in range(most):
            byte = text[:, t]
            begins = (byte & 0xC0) != 0x80
            head = np.where(begins, t, head)
            state = auto.after(state, byte)
            link, out = state, auto.first[state]
            live = rows[out >= 0]
            alone = np.zeros(n, bool)
            while len(live):
                i = out[live]
                size = auto.length[i]
                frm = t + 1 - size
                score = best[frm, live] + auto.score[i]
                better = score > best[t + 1, live]
                up = live[better]
                best[t + 1, up] = score[better]
                piece[t + 1, up] = i[better]
                start[t + 1, up] = frm[better]
                alone[live[frm == head[live]]] = True
                link = auto.then[link] if len(live) == n else _moved(link, live, auto.then)
                live = live[link[live] > 0]
                out = _moved(out, live, None, auto.first[link[live]])
            # a whole character that no piece stands for alone
            whole = ~alone & (((text[:, t + 1] & 0xC0) != 0x80) if t + 1 < most else True)
            lone = rows[whole & (t < sizes)]
            if len(lone):
                score = best[head[lone], lone] + auto.unknown
                better = score > best[t + 1, lone]
                up = lone[better]
                best[t + 1, up] = score[better]
                piece[t + 1, up] = -1
                start[t + 1, up] = head[up]
        at = sizes.copy()
        steps = []
        while True:
            live = at > 0
            if not live.any():
                break
            steps.append(np.where(live, piece[at, rows], -2))
            at = np.where(live, start[at, rows], 0)
        ids = np.array(steps[::-1], np.int32).T
        used = ids != -2
        counts = used.sum(axis=1)
        flat = ids[used].astype(np.int32).tobytes()
        ends = (np.cumsum(counts) * 4).tolist()
        unknown = (ids == -1).any(axis=1)
        result = [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        for r in np.flatnonzero(unknown):
            result[r] = self._with_bytes(words[r], piece[:, r], start[:, r])
        return result

    def _viterbi_one(self, word: bytes) -> bytes:
        """The same for one unit: a link's piece relaxes the score of the position where it ends."""
        auto = self.auto
        block, blocks, first, then, length, scores = (memoryview(x) for x in (auto.block, auto.blocks, auto.first, auto.then, auto.length, auto.score))
        unknown, size, lowest = auto.unknown, len(word), float("-inf")
        best = array("d", [0.0]) + array("d", [lowest]) * size
        piece, start = array("i", [-1]) * (size + 1), array("i", [0]) * (size + 1)
        state = head = 0
        for t, byte in enumerate(word, 1):
            if byte & 0xC0 != 0x80:
                head = t - 1
            state = blocks[block[state * 8 + (byte >> 5)] + (byte & 31)]
            link, own, top, alone = state, first[state], lowest, False
            if own >= 0:
                while True:
                    frm = t - length[own]
                    score = best[frm] + scores[own]
                    if score > top:
                        top, piece[t], start[t] = score, own, frm
                    if frm == head:
                        alone = True
                    link = then[link]
                    if link <= 0:
                        break
                    own = first[link]
            # a whole character that no piece stands for alone
            if not alone and (t == size or word[t] & 0xC0 != 0x80):
                score = best[head] + unknown
                if score > top:
                    top, piece[t], start[t] = score, -1, head
            best[t] = top
        return self._with_bytes(word, piece, start)

    def _with_bytes(self, word: bytes, piece: Sequence[int], start: Sequence[int]) -> bytes:
        parts, at = [], len(word)
        while at > 0:
            frm = int(start[at])
            if piece[at] >= 0:
                parts.append([int(piece[at])])
            else:
                parts.append([int(self.byte_ids[b]) for b in word[frm:at].replace(_LITERAL, b"\xe2\x96\x81")])
            at = frm
        return np.array([i for p in reversed(parts) for i in p], np.int32).tobytes()


def _moved(values: np.ndarray, live: np.ndarray, table: np.ndarray | None, to: np.ndarray | None = None) -> np.ndarray:
    values = values.copy()
    values[live] = table[values[live]] if to is None else to
    return values


def _encoder(vocabulary: Vocabulary) -> Encoder:
    """One automaton for each worker process, kept between tasks of this kind."""
    key = hash((len(vocabulary.pieces), tuple(vocabulary.scores[:2000]), tuple(vocabulary.pieces[:2000])))
    if key not in KEPT:
        KEPT.clear()
        KEPT[key] = Encoder(vocabulary)
    return KEPT[key]


def _parts(sizes: list[int]) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, n in enumerate(sizes):
        size += n
        if size >= TOGETHER:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(sizes):
        yield at, len(sizes)


def _encode_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            column = batch.column("text")
            for a, b in _parts(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
                texts = column.slice(a, b - a).to_pylist()
                ids = encoder.encode(texts)
                exact = [encoder.decode(i) == (t or "").encode() for i, t in zip(ids, texts, strict=True)]
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                pieces = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])))
                rest = [c for c in batch.schema.names if c != "text"]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], pieces, pa.array(exact, pa.bool_())], [*rest, "ids", "exact"])

    return run


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """docs: any columns but ids and exact, with text -> the others, ids and exact
    (whether decoding the ids gave back the text)."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))
    others = [f for f in docs.schema.fields if f.name != "text"]
    schema = StructType([*others, StructField("ids", ArrayType(IntegerType())), StructField("exact", BooleanType())])
    return docs.select(*[F.col(quoted(f.name)) for f in others], F.col("text").cast("string")).mapInArrow(tidy(_encode_batches(shared), keeps=True), schema)


def _decode_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            texts = [encoder.decode(np.array(i or [], np.int32)) for i in batch.column("ids").to_pylist()]
            rest = [c for c in batch.schema.names if c != "ids"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(texts, pa.binary()).cast(pa.string())], [*rest, "text"])

    return run


def decode(coded: DataFrame, path: str = MODEL) -> DataFrame:
    """coded: any columns but text, with ids -> the others and text."""
    shared = coded.sparkSession.sparkContext.broadcast(Vocabulary.load(path))
    others = [f for f in coded.schema.fields if f.name != "ids"]
    schema = StructType([*others, StructField("text", StringType())])
    return coded.select(*[F.col(quoted(f.name)) for f in others], "ids").mapInArrow(tidy(_decode_batches(shared), keeps=True), schema)
