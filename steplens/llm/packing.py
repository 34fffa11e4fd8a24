"""Best-fit packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steplens.llm.common import ship, slices
from steplens.llm.tokens import IdStore, end_to_end
from steplens.sources.scratch import materialise

CAPACITY = 2048
#: Documents whose pieces are packed together, and parts whose sequences that are less than full are.
PART_DOCS = 4096
#: Bytes of text that are tokenised at once.
TOKEN_BYTES = 4 << 20
#: Letters of which the tokenizer makes one pre-token whatever stands beside them, and marks that may follow them.
_PLAIN = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-įı-ſ]+)(?P<marks>[!-/:-@\[-`{-~]*)$"


class CapacityTree:
    """Open bins by remaining capacity: leaf c of a segment tree holds the bins with c left, and each inner node whether
    any leaf below it holds one. Finding the tightest bin that fits takes a logarithm of the capacity."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, left: int, number: int) -> None:
        self.bins[left].append(number)
        i = left + self.size
        while i and not self.any[i]:
            self.any[i] = 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(bin, what it has left) of the tightest open bin with ``need`` left, taken out of the tree."""
        i = need + self.size
        while not self.any[i]:
            while i & 1:
                i >>= 1
                if i <= 1:
                    return None
            i += 1
            if i & (i - 1) == 0:
                return None
        while i < self.size:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        left = i - self.size
        number = self.bins[left].pop()
        while i and not (self.bins[left] if i >= self.size else self.any[2 * i] or self.any[2 * i + 1]):
            self.any[i] = 0
            i >>= 1
        return number, left


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item: longest first, each into the open bin that it leaves the least room in."""
    tree, opened = CapacityTree(capacity), 0
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        if (found := tree.take(need)) is None:
            found, opened = (opened, capacity), opened + 1
        bins[i], offsets[i] = found[0], capacity - found[1]
        if found[1] > need:
            tree.add(found[1] - need, found[0])
    return bins, offsets


class _Encoder:
    """Ids of parts of words by a tokenizer whose pre-tokens never hold white space: runs of letters or of marks, many in
    one call as each is one pre-token, and whole other words, which have a zero character in front."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def __call__(self, new: list[str]) -> Iterable[np.ndarray]:
        plain = [x for x in new if x and x[0] != "\0"]
        runs = iter(self._runs(plain))
        odd = iter(self.tokenizer.encode_batch([x[1:] for x in new if x[:1] == "\0"], add_special_tokens=False))
        for x in new:
            if not x:
                yield np.empty(0, np.int32)
            elif x[0] == "\0":
                yield np.array(next(odd).ids, np.int32)
            else:
                yield next(runs)

    def _runs(self, parts: list[str]) -> Iterator[np.ndarray]:
        for at in range(0, len(parts), 2048):
            some = parts[at : at + 2048]
            one = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            word = np.array(one.word_ids, np.int64)
            if len(word) and word[-1] + 1 == len(some):
                ids, cut = np.array(one.ids, np.int32), [0, *(np.flatnonzero(np.diff(word)) + 1).tolist(), len(word)]
                yield from (ids[a:b] for a, b in zip(cut, cut[1:], strict=False))
            else:
                yield from (np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch(some, add_special_tokens=False))


@lru_cache(2)
def _store(path: str) -> IdStore:
    encoder = _Encoder(path)
    return IdStore(lambda new: end_to_end(encoder(new)))


def token_ids(text: pa.Array, path: str, closing: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, each with ``closing`` after it, and the texts' offsets in them. A word is the run of
    its letters and the run of marks after them, if it is no more than that, and else itself."""
    split = pc.ascii_split_whitespace(text.fill_null("") if text.null_count else text)
    coded = split.flatten().dictionary_encode()
    cut = pc.extract_regex(coded.dictionary, _PLAIN)
    letters = pc.utf8_lower(pc.struct_field(cut, "letters"))
    other = pc.binary_join_element_wise("\0", coded.dictionary, "")
    head = pc.if_else(pc.is_valid(cut), letters, other)
    tail = pc.if_else(pc.is_valid(cut), pc.struct_field(cut, "marks"), "")
    parts = pa.concat_arrays([head, tail]).dictionary_encode()
    store = _store(path)
    entries = store.lookup(parts.dictionary.to_pylist())[parts.indices.to_numpy()]
    both = np.stack([entries[: len(head)], entries[len(head) :]], axis=1)[coded.indices.to_numpy()]
    offsets = split.offsets.to_numpy().astype(np.int64)
    return store.gather(both.ravel(), 2 * (offsets - offsets[0]), closing)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, salt[, ids]): the ids of each whole text and a closing 0, cut where they
    are longer than ``capacity``. Null text counts as empty: one piece of one id. A null doc_id stays."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            for part in slices(batch, "text", TOKEN_BYTES):
                ids, offsets = token_ids(part.column("text"), path)
                n = np.diff(offsets)
                count = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(capacity, n[row] - start)
                begin = offsets[row] + start
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * (a + m)]) for a, m in zip(begin.tolist(), length.tolist(), strict=True)]
                arrays = [part.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(row + seen)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "salt"]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.append(begin, len(ids)).astype(np.int32)), pa.array(ids)))
                    names.append("ids")
                seen += len(n)
                yield pa.RecordBatch.from_arrays(arrays, names)
        _store(path).clear()  # a worker outlives its task

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kinds)


def pack(cut: DataFrame, n_docs: int, capacity: int = CAPACITY, part_docs: int = PART_DOCS) -> DataFrame:
    """``cut`` with sequence_id and offset in place of salt: sequences of at most ``capacity`` ids, gapless from offset 0.

    Pieces are dealt by a hash into parts of about ``part_docs`` documents, and each part is packed by best-fit
    decreasing; so no task sees more than its part. What parts leave less than full, about one sequence each, is packed again
    as wholes, in groups of as many parts, until one group is left. An empty table gives no rows.
    """
    parts = max(1, n_docs // part_docs)
    dealt = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "salt"), F.lit(parts)))
    out = [f for f in cut.schema.fields if f.name != "salt"]

    def place(group: pa.Table) -> pa.Table:
        bins, offsets = best_fit_decreasing(group["length"].to_numpy(), capacity)
        part = group["part"][0].as_py()
        kept = group.select([f.name for f in out])
        return kept.append_column("sequence_id", pa.array((part << 32) + bins)).append_column("offset", pa.array(offsets))

    kinds = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in out] + ["sequence_id long", "offset long"])
    packed = dealt.groupBy("part").applyInArrow(place, kinds)
    level = 0
    while parts > 1:
        packed, parts, level = _join_loose(materialise(packed, "packed"), capacity, part_docs, level), -(-parts // part_docs), level + 1
    return packed


def _join_loose(packed: DataFrame, capacity: int, part_docs: int, level: int) -> DataFrame:
    """``packed`` with its sequences that are less than full put into each other, those of ``part_docs`` parts at a time. The
    part is the upper half of sequence_id; joined sequences have the number of the group of parts there, and below it numbers
    that no part and no other ``level`` gives."""
    loose = packed.groupBy("sequence_id").agg(F.sum("length").alias("length")).where(F.col("length") < capacity)
    loose = loose.withColumn("group", F.floor(F.shiftright("sequence_id", 32) / part_docs))

    def place(group: pa.Table) -> pa.Table:
        bins, offsets = best_fit_decreasing(group["length"].to_numpy(), capacity)
        number = group["group"][0].as_py()
        return pa.Table.from_arrays([group["sequence_id"].combine_chunks(), pa.array((number << 32) + (1 << 31) + (level << 27) + bins), pa.array(offsets)], ["sequence_id", "to", "base"])

    moves = loose.groupBy("group").applyInArrow(place, "sequence_id long, to long, base long")
    moved = packed.join(materialise(moves, "moves"), "sequence_id", "left")
    others = [c for c in packed.columns if c not in ("sequence_id", "offset")]
    return moved.select(*others, F.coalesce("to", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, from pieces that carry ``ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Packed pieces of all documents: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset."""
    return pack(pieces(docs, path, capacity, with_ids), docs.count(), capacity)
