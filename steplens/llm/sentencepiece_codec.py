"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a one-pass Viterbi."""

from __future__ import annotations

import re
import zlib
from math import log
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steplens.llm.common import ship, slices
from steplens.llm.tokens import IdStore, end_to_end

SPACE = "▁"
#: How much less than the least piece an unknown character scores, as in the public unigram decoder.
UNKNOWN_PENALTY = 10.0
#: Added to a merge's rank before its logarithm is taken for that of the piece's frequency, by the Zipf-Mandelbrot rule.
RANK_OFFSET = 100.0
#: Kinds of model in the public file format, and the numbers of the fields read here.
UNIGRAM, BPE = 1, 2
_TRAINER, _NORMALISER, _KIND, _MAP, _PREFIX, _SQUEEZE, _ESCAPE = 2, 3, 3, 2, 3, 4, 5


def _fields(raw: bytes) -> dict[int, list]:
    """Values of a protocol buffer message by field number: whole numbers, or bytes."""
    out: dict[int, list] = {}
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = number()
        size = {0: 0, 1: 8, 5: 4}.get(tag & 7)
        if size == 0:
            out.setdefault(tag >> 3, []).append(number())
        else:
            size = number() if size is None else size
            out.setdefault(tag >> 3, []).append(raw[at : at + size])
            at += size
    return out


def settings(path: str) -> int:
    """The kind of the model. Fails where its text rules differ from the ones followed here: a space in front of every text,
    space marks for spaces, every space kept, and no map of characters."""
    with open(path, "rb") as f:
        model = _fields(f.read())
    kind = _fields(model[_TRAINER][0]).get(_KIND, [UNIGRAM])[0]
    rules = _fields(model[_NORMALISER][0]) if _NORMALISER in model else {}
    found = (rules.get(_MAP, [b""])[0], *(bool(rules.get(k, [1])[0]) for k in (_PREFIX, _SQUEEZE, _ESCAPE)))
    if found != (b"", True, False, True):
        raise ValueError(f"{path}: its text rules are not supported")
    if kind not in (UNIGRAM, BPE):
        raise ValueError(f"{path}: neither a unigram model nor one of merges")
    return kind


class Codec:
    """Pieces and scores of a SentencePiece model file; the segmentation is the one of the largest sum of scores. The scores
    of a model of merges are ranks: logarithms of frequencies are made of them."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        merges = settings(path) == BPE
        self.unknown = model.unk_id()
        self.automaton = ahocorasick.Automaton()
        self.bytes_of: list[bytes] = []
        self.byte_id: dict[int, int] = {}
        least, normal = 0.0, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"" if model.is_control(i) else " ⁇ ".encode())
            else:
                score = -log(RANK_OFFSET - model.get_score(i)) if merges else model.get_score(i)
                least = min(least, score)
                self.automaton.add_word(piece, (i, len(piece), score))
                normal.append(piece)
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
        self.automaton.make_automaton()
        self.unknown_score = least - UNKNOWN_PENALTY
        # A text falls apart before a space mark that follows anything else, and around a line end, if no piece spans them.
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            self.chunk = re.compile(r"(?s).+")
        elif any("\n" in p for p in normal):
            self.chunk = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        else:
            self.chunk = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+")
        self.store = IdStore(lambda new: end_to_end(map(self.viterbi, new)))

    def viterbi(self, text: str) -> np.ndarray:
        """Ids of ``text``, whose spaces are marks by now. The automaton reports at each position the pieces that end
        there, longest first along its output links; each relaxes the best score of the position. A character that is
        no piece itself may also be unknown, and then becomes its bytes."""
        n, unknown, at = len(text), self.unknown_score, 0
        best, back, step = [0.0] * (n + 1), [-1] * (n + 1), [1] * (n + 1)
        for end, (piece, size, score) in self.automaton.iter(text):
            while at <= end:
                at += 1
                best[at] = best[at - 1] + unknown
            total = best[at - size] + score
            if total > best[at]:
                best[at], back[at], step[at] = total, piece, size
        ids, i = [], len(text)
        while i > 0:
            if back[i] >= 0:
                ids.append(back[i])
            elif self.byte_id:
                ids.extend(self.byte_id[b] for b in reversed(text[i - 1].encode()))
            else:
                ids.append(self.unknown)
            i -= step[i]
        return np.array(ids[::-1], np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end and the texts' offsets in them."""
        find, chunks, first = self.chunk.findall, [], [0]
        for t in texts:
            if t:
                chunks += find(SPACE + t.replace(" ", SPACE))
            first.append(len(chunks))
        coded = pa.array(chunks, pa.string()).dictionary_encode()
        entries = self.store.lookup(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        return self.store.gather(entries, np.array(first, np.int64))

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``: pieces with marks as spaces, without the one that stands before every text; bytes that
        are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, n_ids, ids_crc32, round_trip): ids of each whole text and whether decoding gives the text back.

    A null or empty text has no ids and comes back as empty. A text that holds the space mark U+2581 itself comes back
    with a space there, so round_trip is false. Null and repeated doc_id stay; an empty table gives no rows.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").fill_null("").to_pylist()
                ids, offsets = own.encode(texts)
                raw, flat, ends = memoryview(ids.astype("<u4").tobytes()), ids.tolist(), offsets.tolist()
                spans = list(zip(ends[:-1], ends[1:], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)),
                        pa.array(np.diff(offsets)),
                        pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in spans], pa.int64()),
                        pa.array([own.decode(flat[a:b]) == t for (a, b), t in zip(spans, texts, strict=True)]),
                    ],
                    ["doc_id", "ids", "n_ids", "ids_crc32", "round_trip"],
                )

    kinds = "doc_id long, ids array<int>, n_ids long, ids_crc32 long, round_trip boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kinds)


def decode_documents(coded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of encoded rows (doc_id, ids); null ids count as none."""
    ship(coded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts: Iterable[str] = (own.decode(x or []) for x in batch.column("ids").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(texts), pa.string())], ["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
