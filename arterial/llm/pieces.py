"""SentencePiece encoding and decoding by an Aho-Corasick automaton and Viterbi.

The vocabulary is that of a SentencePiece model file; its pieces and scores are read on
the driver and broadcast (their number is fixed by the file). An Aho-Corasick automaton
over all pieces walks a text once; at each position the pieces that end there, which are
the matches along the output links, relax the best score of the position. Blanks are
written as U+2581 and a text starts with one, as the model's normaliser does. A
character that no piece covers becomes its UTF-8 bytes, at a score below every piece's.

Segmentation is exact for the whole text, yet done in parts: no piece holds U+2581
behind another character or a line's end, so a best path of a text is the best paths of its
stretches (blanks and the characters up to the next blank or line's end) end to end. Stretches repeat, so each
task keeps those it has seen in a table of bounded size.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arterial.llm.common import release

BLANK = "▁"
#: Stretches that a task keeps; longer ones than this many characters are never kept.
KEPT, KEPT_CHARS = 200_000, 40
#: Texts whose ids are held at a time.
STEP_ROWS = 200
#: A byte costs this much more than the worst piece.
BYTE_PENALTY = 10.0
_NEVER = float("-inf")


@dataclass
class Vocabulary:
    """Pieces with ids and scores; ``byte_ids[b]`` is the piece of byte b."""

    pieces: list[tuple[str, int, float]]
    byte_ids: list[int]
    size: int
    text_of: dict[int, str] = field(default_factory=dict)


def load_vocabulary(path: str) -> Vocabulary:
    """Read a model file with byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids, text_of = [], [0] * 256, {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces.append((piece, i, model.get_score(i)))
            text_of[i] = piece
    return Vocabulary(pieces, byte_ids, model.get_piece_size(), text_of)


class _Seen(dict):
    """Ids of stretches as bytes of 32-bit numbers, made when first asked for."""

    def __init__(self, codec: "Codec", prefix: str):
        self.codec, self.prefix = codec, prefix

    def __missing__(self, word: str) -> bytes:
        ids = array("i", self.codec.viterbi(self.prefix + word)).tobytes()
        if len(word) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.clear()
            self[word] = ids
        return ids


class Codec:
    """Encodes and decodes texts; one for each Python worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.automaton = ahocorasick.Automaton()
        for piece, i, score in vocabulary.pieces:
            self.automaton.add_word(piece, (len(piece), score, i))
        if vocabulary.pieces:
            self.automaton.make_automaton()
        self.parted = all(BLANK not in p.lstrip(BLANK) and "\n" not in p for p, _, _ in vocabulary.pieces)
        self.byte_score = min((s for _, _, s in vocabulary.pieces), default=0.0) - BYTE_PENALTY
        self.byte_of = {i: b for b, i in enumerate(vocabulary.byte_ids)}
        self.is_byte = np.zeros(vocabulary.size, bool)
        self.is_byte[vocabulary.byte_ids] = True
        self.is_high = np.zeros(vocabulary.size, bool)  # bytes that are parts of characters
        self.is_high[vocabulary.byte_ids[128:]] = True
        self.text_of = {i: t.replace(BLANK, " ") for i, t in vocabulary.text_of.items()} | {i: chr(b) for b, i in enumerate(vocabulary.byte_ids[:128])}
        # Stretches that start with one blank, and those behind a line's end, which start with none.
        self.marked, self.bare = _Seen(self, BLANK), _Seen(self, "")

    def _bytes(self, text: str) -> tuple[int, ...]:
        return tuple(self.v.byte_ids[b] for b in text.encode())

    def viterbi(self, text: str) -> list[int]:
        """The ids of the best segmentation. Equal scores go to the longer last piece."""
        best: list[float] = [0.0]  # by place; ``back`` has the piece that leads there, None for bytes
        back: list[tuple | None] = [None]
        at, top, last, led = 0, 0.0, None, None
        # Matches come by end, the longest first. What ends at one place is gathered before
        # it is stored; where no piece of a single character ends, its bytes may be better.
        for end, match in self.automaton.iter(text) if self.v.pieces and text else ():
            if end >= at:
                if last is not None:
                    self._settle(text, best, back, top, led, last[0] == 1)
                while len(best) <= end:
                    self._settle(text, best, back, _NEVER, None, False)
                at, top = end + 1, _NEVER
            last = match
            s = best[at - match[0]] + match[1]
            if s > top:
                top, led = s, match
        if last is not None:
            self._settle(text, best, back, top, led, last[0] == 1)
        # Behind the last match only bytes go on.
        n, out = len(text), []
        while n:
            match = back[n] if n < len(back) else None
            if match is not None:
                out.append(match[2])
                n -= match[0]
            else:
                out += reversed(self._bytes(text[n - 1].replace(BLANK, " ")))
                n -= 1
        out.reverse()
        return out

    def _settle(self, text: str, best: list, back: list, top: float, led: tuple | None, single: bool) -> None:
        """Store the best way to the next place; unless a single character's piece ends there,
        the bytes of the character before it compete."""
        if not single:
            at = len(best)
            s = best[-1] + self.byte_score * len(text[at - 1].encode())
            if s > top:
                top, led = s, None
        best.append(top)
        back.append(led)

    def _line(self, line: str, first: bool) -> bytes:
        """A stretch of a text without line ends or U+2581; the first of a text is marked."""
        words = line.split(" ")
        if "" in words[1:] or first and not words[0] and len(words) > 1:
            return self._runs(line, first)
        lead = self.marked[words[0]] if first else self.bare[words[0]] if words[0] else b""
        return lead + b"".join(map(self.marked.__getitem__, words[1:]))

    def _runs(self, line: str, first: bool) -> bytes:
        """The same for lines with runs of blanks: a run belongs to the word behind it."""
        words = ((" " if first else "") + line).split(" ")
        out, run = [self.bare[words[0]] if words[0] else b""], 0
        for at, w in enumerate(words[1:], 1):
            run += 1
            if w or at == len(words) - 1:
                out.append(self.bare[BLANK * run + w])
                run = 0
        return b"".join(out)

    def encode_array(self, text: str) -> np.ndarray:
        """The ids of a text; none for the empty one."""
        if not text:
            return np.zeros(0, np.int32)
        out: list[bytes] = []
        # A literal U+2581 would read back as a blank, so it goes as bytes.
        for k, part in enumerate(text.split(BLANK)):
            if k:
                out.append(np.array(self._bytes(BLANK), np.int32).tobytes())
            if not self.parted:
                out.append(np.array(self.viterbi((BLANK if k == 0 else "") + part.replace(" ", BLANK)), np.int32).tobytes())
                continue
            # No piece crosses a line's end, which is a byte itself.
            for j, line in enumerate(part.split("\n")):
                if j:
                    out.append(self.bare["\n"])
                if line or not (j or k):
                    out.append(self._line(line, not (j or k)))
        return np.frombuffer(b"".join(out), np.int32)

    def encode(self, text: str) -> list[int]:
        return self.encode_array(text).tolist()

    def decode(self, ids) -> str:
        """The text of ids that ``encode`` gave."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return ""
        if not self.is_high[ids].any():
            text = "".join(map(self.text_of.__getitem__, ids.tolist()))
            return text[1:] if text.startswith(" ") else text
        out, pending = [], bytearray()
        for i in ids.tolist():
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                continue
            if pending:
                out.append(pending.decode(errors="replace"))
                pending.clear()
            out.append(self.text_of.get(i, ""))
        if pending:
            out.append(pending.decode(errors="replace"))
        text = "".join(out)
        return text[1:] if text.startswith(" ") else text


_codec: list = [None, None]


def _worker_codec(key: str, vocabulary) -> Codec:
    """The worker's codec, built once for a broadcast vocabulary and kept between tasks."""
    if _codec[0] != key:
        _codec[:] = [key, Codec(vocabulary.value)]
    return _codec[1]


def _share(spark: SparkSession, model: str) -> tuple:
    return uuid.uuid4().hex, spark.sparkContext.broadcast(load_vocabulary(model))


def encode_pieces(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ids (array<int>), n_pieces and n_byte_pieces of the whole text.

    Exact: ``decode_pieces`` gives the text back, character for character. Null texts
    have null ids and counts of 0, empty ones no ids. Equal rows get equal ids, texts of any
    length are segmented whole, and an empty table gives an empty result; other columns are
    carried along, ones named like a result are replaced.
    """
    return _encode(docs, model, text_col, check=False)


def encode_checked(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """As ``encode_pieces``, and exact boolean: decoding gives the text back (true for null)."""
    return _encode(docs, model, text_col, check=True)


def _encode(docs: DataFrame, model: str, text_col: str, check: bool) -> DataFrame:
    key, vocabulary = _share(docs.sparkSession, model)
    kept = docs.drop("ids", "n_pieces", "n_byte_pieces", "exact")
    made = "ids array<int>, n_pieces long, n_byte_pieces long" + ", exact boolean" * check
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), made])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _worker_codec(key, vocabulary)
        for whole in frames:
            for lo in range(0, len(whole), STEP_ROWS):  # ids of few texts at a time
                f = whole.iloc[lo : lo + STEP_ROWS].copy()
                ids = [None if t is None else codec.encode_array(t) for t in f[text_col]]
                f["ids"] = ids
                f["n_pieces"] = [0 if i is None else len(i) for i in ids]
                f["n_byte_pieces"] = [0 if i is None else int(codec.is_byte[i].sum()) for i in ids]
                if check:
                    f["exact"] = [t is None or codec.decode(i) == t for t, i in zip(f[text_col], ids, strict=True)]
                yield f
        codec.marked.clear()  # the worker lives on
        codec.bare.clear()
        release()

    return kept.mapInPandas(run, schema)


def decode_pieces(encoded: DataFrame, model: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``encoded`` with the texts of its ids as ``text_col``; null ids give null texts."""
    key, vocabulary = _share(encoded.sparkSession, model)
    kept = encoded.drop(text_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), f"`{text_col}` string"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _worker_codec(key, vocabulary)
        for f in frames:
            yield f.assign(**{text_col: [None if i is None else codec.decode(i) for i in f[ids_col]]})

    return kept.mapInPandas(run, schema)


def piece_counts(encoded: DataFrame) -> DataFrame:
    """How often each id occurs: id, n."""
    return encoded.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
