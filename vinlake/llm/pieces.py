"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces reads a text once. At each position it reports the pieces that end there, the longest first and then along output links,
and each relaxes that position: a Viterbi search in a single pass. Characters without a piece of their own become byte pieces.

What relaxing means depends on the model. In a unigram model scores are log probabilities: the best sum wins. In a BPE model they are ranks of merges, and their best sum
is not what SentencePiece returns. There the winner of a position is the one piece that merging would leave beside the winner of the position where the piece begins: a
sequence of pieces is the result of merging exactly if each two neighbours are the result of merging their own text.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinlake.llm.common import map_texts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: What an unknown character scores below the least piece.
PENALTY = 10.0
#: Pairs of pieces that a task remembers at most.
PAIRS = 400_000
#: Segmentations that a task remembers at most, of chunks of so many characters at most.
MEMO, MEMO_CHARS = 200_000, 48


class Pieces(dict):
    """Encoder and decoder of one model. As a dict it remembers the ids of chunks, as bytes of 32-bit numbers."""

    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.automaton = ahocorasick.Automaton()
        self.bytes = [0] * 256
        self.text: list[bytes] = []
        self.scores: dict[str, float] = {}
        self.pairs: dict[int, bool] = {}
        least, inner = 0.0, False
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.text.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.text.append(b"")
            else:
                self.automaton.add_word(piece, (len(piece), i, sp.get_score(i)))
                self.scores[piece] = sp.get_score(i)
                self.text.append(piece.replace(SPACE, " ").encode())
                least = min(least, sp.get_score(i))
                inner |= SPACE in piece.lstrip(SPACE) or "\n" in piece or "\0" in piece
        self.automaton.make_automaton()
        self.ranks = all(x <= 0 and x == int(x) for x in self.scores.values())  # a BPE model
        self.unknown = least - PENALTY
        # No piece runs over a space that follows something else, or over a line's end: a text falls into chunks there, and each has its own best path.
        self.chunks = re.compile(f"{SPACE}*[^{SPACE}\n\0]+|{SPACE}+|\n|\0").findall if not inner else (lambda text: [text] if text else [])

    def merged(self, text: str) -> list[str]:
        """Merging, for two pieces' text: the neighbours of the best score, the leftmost of equals, again and again."""
        parts = list(text)
        while True:
            best = max((i for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in self.scores), key=lambda i: (self.scores[parts[i] + parts[i + 1]], -i), default=None)
            if best is None:
                return parts
            parts[best : best + 2] = [parts[best] + parts[best + 1]]

    def neighbours(self, a: str, b: str) -> bool:
        """Whether merging leaves these two pieces beside each other."""
        return a + b not in self.scores and self.merged(a + b) == [a, b]

    def merging(self, chunk: str) -> array:
        """The ids that merging gives, in one pass: length[end] is that of the last piece of the chunk's first `end` characters, 0 for an unknown one."""
        n, pairs = len(chunk), self.pairs
        length, ids = [0] * (n + 1), [-1] * (n + 1)
        decided = 0
        for end, (size, i, _) in self.automaton.iter(chunk):
            end += 1
            if end == decided:
                continue
            start = end - size
            before = ids[start]
            if before >= 0:  # else the chunk or the piece after an unknown character begins here
                known = pairs.get(before << 32 | i)
                if known is None:
                    if len(pairs) >= PAIRS:
                        pairs.clear()
                    known = pairs[before << 32 | i] = self.neighbours(chunk[start - length[start] : start], chunk[start:end])
                if not known:
                    continue
            length[end], ids[end], decided = size, i, end
        out, at = [], n
        while at:
            out.append(ids[at] if length[at] else chunk[at - 1])
            at -= length[at] or 1
        return self._ids(out)

    def viterbi(self, chunk: str) -> array:
        """The ids of the best path over the whole chunk. Of equal scores the path with the longer last piece is taken."""
        n, unknown = len(chunk), self.unknown
        best, back = [0.0] + [float("-inf")] * n, [(0, -1)] * (n + 1)
        done, single = 0, False  # positions up to `done` have all their pieces

        def close(upto: int) -> None:
            nonlocal done, single
            while done < upto:
                if not single and best[done] + unknown > best[done + 1]:
                    best[done + 1], back[done + 1] = best[done] + unknown, (1, -1)
                done, single = done + 1, False

        for end, (length, i, score) in self.automaton.iter(chunk):
            if end > done:
                close(end)
            single |= length == 1
            now = best[end + 1 - length] + score
            if now > best[end + 1]:
                best[end + 1], back[end + 1] = now, (length, i)
        close(n)
        out, at = [], n
        while at:
            length, i = back[at]
            out.append(i if i >= 0 else chunk[at - 1])
            at -= length
        return self._ids(out)

    def _ids(self, out: list[int | str]) -> array:
        """Ids in order, from a path that is given backwards, with the bytes of unknown characters."""
        ids = array("i")
        for x in reversed(out):
            if isinstance(x, int):
                ids.append(x)
            else:  # \0 stands for a space mark that the text itself holds
                ids.extend(self.bytes[b] for b in (SPACE if x == "\0" else x).encode("utf-8", "surrogatepass"))
        return ids

    def __missing__(self, chunk: str) -> bytes:
        ids = (self.merging(chunk) if self.ranks else self.viterbi(chunk)).tobytes()
        if len(chunk) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        # A zero character is swapped with the text's own space marks, so that these stay apart from spaces; texts with both are rare and go bytewise.
        if SPACE in text or "\0" in text:
            return np.concatenate([self._plain(part, k == 0) if k % 2 == 0 else np.array([self.bytes[b] for b in part.encode()], np.int32) for k, part in enumerate(re.split(f"([{SPACE}\0])", text))])
        return self._plain(text, True)

    def _plain(self, text: str, first: bool) -> np.ndarray:
        marked = (SPACE if first else "") + text.replace(" ", SPACE)
        return np.frombuffer(b"".join(map(self.__getitem__, self.chunks(marked))), np.int32)

    def decode(self, ids) -> str:
        raw = b"".join(map(self.text.__getitem__, ids))
        return raw.decode("utf-8", "replace").removeprefix(" ")


_made: dict[bytes, Pieces] = {}


def pieces_of(model: bytes) -> Pieces:
    """The encoder, built once in each Python worker."""
    if model not in _made:
        _made.clear()
        _made[model] = Pieces(model)
    return _made[model]


def _model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip) of every row's whole text.

    For a BPE model, as the given one is, this departs from the best path by score, which is not what such a model means: each position, reached along the automaton's
    output links in the same single pass, is settled by what merging leaves beside the piece before it. Ids are the library's. A unigram model's positions are relaxed by
    score.

    round_trip: decoding the ids gives the text again, exactly. A null text has null ids and no token, an empty one an empty list; both are true round trips. Null
    and repeated ids and repeated rows each return a row. Other columns are left out. The driver reads the model file and broadcasts it.
    """
    model = df.sparkSession.sparkContext.broadcast(_model_bytes(path))

    def make():
        pieces = pieces_of(model.value)

        def fn(ids, texts):
            found = [pieces.encode(t) if t else np.zeros(0, np.int32) for t in texts]
            same = [(t or "") == pieces.decode(x.tolist()) for t, x in zip(texts, found)]
            sizes = [len(x) for x in found]
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), mask=np.array([*(t is None for t in texts), False]))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found or [np.zeros(0, np.int32)])))
            return [ids, sizes, lists.cast(pa.list_(pa.field("element", pa.int32(), True))), same]

        return fn

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    return map_texts(rows, make, "doc_id long, n_tokens long, ids array<int>, round_trip boolean", rows=128)


def decode(df: DataFrame, path: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of every row: the text that its ids stand for. Null ids give a null text, no ids an empty one; control pieces stand for nothing; bytes that are
    no UTF-8 become U+FFFD."""
    model = df.sparkSession.sparkContext.broadcast(_model_bytes(path))

    def make():
        pieces = pieces_of(model.value)
        return lambda ids, lists: [ids, [None if x is None else pieces.decode(x) for x in lists]]

    return map_texts(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("x")), make, "doc_id long, text string")
