"""Alignment of the tokens of two tokenizers over the same bytes, as an Arrow pipeline in the tasks: lists are flattened with their
parents' indices, lengths summed in segments, ends of tokens met by a hash join on (document, end). Spark merges the partial
counts of id pairs and brings them back to the documents."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from steplens.llm.common import ship, slices, text_bytes
from steplens.llm.sentencepiece_codec import SPACE, settings
from steplens.llm.tokens import IdStore, Runs, end_to_end
from steplens.sources.scratch import materialise

#: Text bytes that one step aligns, the pieces of a very long text too, text bytes of a part, which has one table of id pairs, and bytes of the store of ids.
STEP_BYTES, PART_BYTES, STORE_BYTES = 2 << 20, 16 << 20, 128 << 20
#: Ends of tokens below one document: an end and its document share 64 bits.
_END_BITS = 31
_CODED = "part long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, places array<int>, times array<int>, pairs array<long>, docs array<long>"
_FOUND = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"


def _letters() -> dict[str, int]:
    """Bytes by the character that stands for them in byte-level vocabularies: printable bytes of Latin-1 stand for themselves, all others
    for the characters from U+0100 on, in order."""
    own = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return {chr(b) if b in own else chr(next(rest)): b for b in range(256)}


class Tokens:
    """Ids of chunks of text and the bytes of each id; a chunk whose tokens do not give its bytes has the one id -1."""

    def __init__(self, encode: Callable[[list[str]], Iterable[list[int]]], bytes_of: list[bytes]):
        self.encode = encode
        self.bytes_of = pa.array(bytes_of, pa.binary())
        self.lengths = pc.binary_length(self.bytes_of).cast(pa.int64())

    def checked(self, chunks: list[str]) -> Runs:
        lists = list(self.encode(chunks))
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum()))
        given, bounds = text_bytes(pa.array(chunks, pa.string()))
        back, ends = text_bytes(self.bytes_of.take(pa.array(ids)))
        cuts = ends[np.concatenate([[0], np.cumsum(sizes)])]
        if np.array_equal(cuts, bounds) and np.array_equal(given, back):
            return ids, sizes
        same = [bytes(given[a:b]) == bytes(back[c:d]) for a, b, c, d in zip(bounds, bounds[1:], cuts, cuts[1:], strict=False)]
        return end_to_end(np.array(x if ok else [-1], np.int32) for x, ok in zip(lists, same, strict=True))


def byte_level(path: str) -> Tokens:
    """Tokens by a byte-level vocabulary file; strings of special tokens in a text are plain text."""
    from tokenizers import Tokenizer

    tokenizer, letters = Tokenizer.from_file(path), _letters()
    tokenizer.encode_special_tokens = True
    special = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
    names = tokenizer.get_vocab(with_added_tokens=True)
    bytes_of = [b""] * (max(names.values()) + 1)
    for name, i in names.items():
        bytes_of[i] = special[i].encode() if i in special else bytes(letters[c] for c in name)
    return Tokens(lambda chunks: (e.ids for e in tokenizer.encode_batch_fast(chunks, add_special_tokens=False)), bytes_of)


def pieces(path: str) -> Tokens:
    """Tokens by a SentencePiece model that puts a space in front of every text; chunks bring theirs, so it is cut off."""
    import sentencepiece

    settings(path)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    bytes_of = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        bytes_of.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace(SPACE, " ").encode())
        if SPACE in piece.lstrip(SPACE):
            raise ValueError(f"{path}: a piece goes on after a space")
    return Tokens(lambda chunks: model.encode([c[1:] for c in chunks], num_threads=1), bytes_of)


class Both:
    """Two tokenizers with one store: it holds each chunk's ids by the first and behind them those by the second, raised by ``SECOND``;
    a chunk that either does not give back has an id below 0."""

    SECOND = 1 << 24

    def __init__(self, a: Tokens, b: Tokens):
        self.a, self.b = a, b
        self.store = IdStore(self._encode, STORE_BYTES)

    def _encode(self, chunks: list[str]) -> Runs:
        (x, n), (y, m) = self.a.checked(chunks), self.b.checked(chunks)
        total = n + m
        out, begin = np.empty(len(x) + len(y), np.int32), np.cumsum(total) - total
        out[np.arange(len(x)) + np.repeat(begin - (np.cumsum(n) - n), n)] = x
        out[np.arange(len(y)) + np.repeat(begin + n - (np.cumsum(m) - m), m)] = np.where(y < 0, y, y + self.SECOND)
        return out, total

    def ids(self, texts: pa.Array) -> tuple[pa.ListArray, pa.ListArray]:
        """Ids of both for each text with a space in front; a text that either does not give back has no ids, nor has an empty one."""
        texts = pc.fill_null(texts, "")
        spaced = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
        parts, first = chunks(spaced)
        coded = parts.dictionary_encode()
        entries = self.store.lookup(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        ids, offsets = self.store.gather(entries, first)
        good = ids >= 0
        if not good.all():  # no id of a text with a bad chunk counts
            bad = np.unique(np.searchsorted(offsets, np.flatnonzero(~good), "right") - 1)
            for i, j in zip(offsets[bad].tolist(), offsets[bad + 1].tolist(), strict=True):
                good[i:j] = False
        lists = []
        for own, less in ((good & (ids < self.SECOND), 0), (good & (ids >= self.SECOND), self.SECOND)):
            cut = np.concatenate([[0], np.cumsum(own)])[offsets]
            lists.append(pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids[own] - less)))
        return lists[0], lists[1]


@lru_cache(2)
def both(a_path: str, b_path: str) -> Both:
    return Both(byte_level(a_path), pieces(b_path))


#: Last bytes of letters, digits and marks of ASCII, and of characters that no white space of Unicode shares its last byte with.
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_SOLID[0x80:] = True
_SOLID[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False


def chunks(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pieces of the texts that both tokenizers take on their own, and the number of each text's first one. A text falls apart
    before a space between what is no white space and anything else: no token of either goes on past the one and over a space."""
    raw, offsets = text_bytes(texts)
    if not len(raw):
        return pa.array([], pa.string()), np.zeros(len(offsets), np.int64)
    start = np.zeros(len(raw) + 1, bool)
    start[1:-1] = (raw[1:] == 0x20) & _SOLID[raw[:-1]]
    start[offsets[1:] - 1] = False  # a space at the end of a text stays with what is before it
    start[offsets] = True
    starts = np.flatnonzero(start)
    cut = pa.Array.from_buffers(pa.string(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(raw)])
    return cut, np.searchsorted(starts, offsets)


def _ends(ids: pa.ListArray, lengths: pa.Array, name: str) -> pa.Table:
    """(key, name): the document and end of each token, summed in segments, and its id."""
    parent, flat = pc.list_parent_indices(ids).cast(pa.int64()), ids.flatten()
    total = pc.cumulative_sum(pc.take(lengths, flat))
    ahead = np.concatenate([[0], total.to_numpy()])
    offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy())])
    end = pc.subtract(total, pc.take(pa.array(ahead[offsets[:-1]]), parent))
    return pa.table({"key": pc.add(pc.shift_left(parent, pa.scalar(_END_BITS, pa.int64())), end), name: flat})


def _flat(column: pa.ChunkedArray) -> pa.Array:
    whole = column.combine_chunks()
    return pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole


class Aligned:
    """Documents of one step: ``links`` (doc, a, b), a row for each stretch between two neighbouring ends, which is what one token of either
    shares with one of the other; ``both`` marks those that end a group."""

    def __init__(self, a_ids: pa.ListArray, b_ids: pa.ListArray, a: Tokens, b: Tokens):
        self.n = len(a_ids)
        met = _ends(a_ids, a.lengths, "a").join(_ends(b_ids, b.lengths, "b"), "key", join_type="full outer", use_threads=False)
        met = met.take(pc.sort_indices(met["key"]))
        own = [_flat(met[c]) for c in ("key", "a", "b")]
        self.key, (self.at_a, self.at_b) = own[0], (pc.is_valid(x).to_numpy(zero_copy_only=False) for x in own[1:])
        self.doc = pc.shift_right(self.key, pa.scalar(_END_BITS, pa.int64()))
        self.a, self.b = (pc.fill_null_backward(x) for x in own[1:])
        self.both = self.at_a & self.at_b

    def per_doc(self, marks: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc.to_numpy()[marks], minlength=self.n)

    def pairs(self) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """(doc, pair, times) of each id pair that a document holds linked, by document; a pair is a above 32 bits and b below."""
        pair = pc.bit_wise_or(pc.shift_left(self.a.cast(pa.int64()), pa.scalar(32, pa.int64())), self.b.cast(pa.int64()))
        held = pa.table({"doc": self.doc, "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
        held = held.take(pc.sort_indices(held["doc"]))
        return held["doc"].to_numpy(), _flat(held["pair"]), held["count_all"].to_numpy()

    def written(self, a_names: int, names: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All groups as text, end to end, and each document's offsets in its bytes. ``names`` holds each id of a with a comma and
        with a bar behind it, then each of b with a comma, with a semicolon and with nothing."""
        doc, ends = self.doc.to_numpy(), np.cumsum(self.both)
        group = ends - self.both  # groups that end before
        last = np.append(doc[1:] != doc[:-1], True)[: len(doc)]
        n_a, n_b = np.cumsum(self.at_a), np.cumsum(self.at_b)
        upto_a, upto_b = (np.concatenate([[0], n[self.both]]) for n in (n_a, n_b))
        ia, ib = np.flatnonzero(self.at_a), np.flatnonzero(self.at_b)
        out = np.empty(len(ia) + len(ib), np.int64)
        out[np.arange(len(ia)) + upto_b[group[ia]]] = 2 * self.a.to_numpy()[ia] + self.both[ia]
        after = np.where(self.both & last, 2, self.both)
        out[np.arange(len(ib)) + upto_a[group[ib] + 1]] = 2 * a_names + 3 * self.b.to_numpy()[ib] + after[ib]
        text = names.take(pa.array(out))
        tokens = np.concatenate([[0], np.cumsum(self.per_doc(self.at_a) + self.per_doc(self.at_b))])
        _, offsets = text_bytes(text)
        return text, offsets[tokens]


@lru_cache(2)
def _names(n_a: int, n_b: int) -> pa.Array:
    return pa.array([f"{i}{c}" for i in range(n_a) for c in ",|"] + [f"{i}{c}" for i in range(n_b) for c in (",", ";", "")])


def _aligned(texts: pa.Array, two: Both) -> tuple[dict, memoryview, list[tuple[int, int]], tuple[np.ndarray, pa.Array, np.ndarray]]:
    """Counts of each text, the bytes of all groups as text with each text's span in them, and its id pairs."""
    a, b = two.a, two.b
    met = Aligned(*two.ids(texts), a, b)
    text, cuts = met.written(len(a.bytes_of), _names(len(a.bytes_of), len(b.bytes_of)))
    counts = {"n_a": met.per_doc(met.at_a), "n_b": met.per_doc(met.at_b), "n_groups": met.per_doc(met.both), "n_links": np.bincount(met.doc.to_numpy(), minlength=met.n)}
    return counts, memoryview(text_bytes(text)[0]), list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)), met.pairs()


def _step(part: pa.RecordBatch, two: Both, with_groups: bool, most: int) -> dict:
    text = part.column("text")
    if part.num_rows == 1 and (pc.sum(pc.binary_length(text)).as_py() or 0) > 2 * most:
        return _long_step(part, two, with_groups, most)
    counts, raw, spans, (doc, pair, times) = _aligned(text, two)
    coded = pair.dictionary_encode()
    return counts | {
        "doc_id": part.column("doc_id"),
        "sha": pa.array([hashlib.sha256(raw[x:y]).hexdigest() if y > x else "" for x, y in spans], pa.string()),
        "groups": pa.array([bytes(raw[x:y]).decode() for x, y in spans] if with_groups else [None] * len(spans), pa.string()),
        "first": np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(spans)))]),
        "local": coded.indices.to_numpy(), "times": times.astype(np.int32), "pairs": coded.dictionary.to_numpy(),
    }


def _long_step(part: pa.RecordBatch, two: Both, with_groups: bool, most: int) -> dict:
    """The same of one very long text, in pieces between chunks: tokens of both end there, so groups and links never span two pieces."""
    cut, _ = chunks(pc.binary_join_element_wise(" ", part.column("text"), ""))
    ends = np.cumsum(pc.binary_length(cut).to_numpy())
    total, digest, kept, found, seen, at = {}, hashlib.sha256(), [], [], False, 0
    while at < len(cut):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        piece = pa.array(["".join(cut.slice(at, to - at).to_pylist())[1:]], pa.string())
        counts, raw, ((x, y),), (_, pair, times) = _aligned(piece, two)
        if y == x:  # a piece that either does not give back: the text has no tokens
            total, seen, found, kept = {}, False, [], []
            break
        digest.update(b";" * seen + raw[x:y])
        seen, at = True, to
        kept.append(bytes(raw[x:y]).decode() if with_groups else "")
        found.append((pair.to_numpy(), times))
        total = {c: total.get(c, 0) + n for c, n in counts.items()}
    pairs, local = np.unique(np.concatenate([np.empty(0, np.int64), *[p for p, _ in found]]), return_inverse=True)
    times = np.bincount(local, weights=np.concatenate([np.empty(0), *[t for _, t in found]]), minlength=len(pairs))
    none = np.zeros(1, np.int64)
    return {c: total.get(c, none) for c in ("n_a", "n_b", "n_groups", "n_links")} | {
        "doc_id": part.column("doc_id"),
        "sha": pa.array([digest.hexdigest() if seen else ""], pa.string()),
        "groups": pa.array([";".join(kept) if with_groups else None], pa.string()),
        "first": np.array([0, len(pairs)]), "local": np.arange(len(pairs)), "times": times.astype(np.int32), "pairs": pairs,
    }


def _part(steps: list[dict], number: int) -> Iterator[pa.RecordBatch]:
    """Rows of a part: its documents, whose links name places in the part's list of pairs, and the list itself with the documents that hold
    each pair, counted by ``Table.group_by``."""
    schema = pa.schema([(n, t) for n, t in zip([c.split()[0] for c in _CODED.split(", ")], [pa.int64()] * 6 + [pa.string()] * 2 + [pa.list_(pa.int32())] * 2 + [pa.list_(pa.int64())] * 2, strict=True)])
    pairs = np.unique(np.concatenate([s["pairs"] for s in steps]))
    held = []
    for s in steps:
        place = np.searchsorted(pairs, s["pairs"])[s["local"]].astype(np.int32)
        held.append(place)
        n, first = len(s["doc_id"]), pa.array(s["first"].astype(np.int32))
        columns = [pa.array(np.full(n, number)), s["doc_id"], *[pa.array(s[c].astype(np.int64)) for c in ("n_a", "n_b", "n_groups", "n_links")], s["sha"], s["groups"]]
        columns += [pa.ListArray.from_arrays(first, pa.array(place)), pa.ListArray.from_arrays(first, pa.array(s["times"]))]
        yield pa.RecordBatch.from_arrays([*columns, *[pa.nulls(n, t) for t in schema.types[-2:]]], schema=schema)
    counted = pa.table({"place": np.concatenate(held)}).group_by("place", use_threads=False).aggregate([([], "count_all")])
    docs = np.zeros(len(pairs), np.int64)
    docs[counted["place"].to_numpy()] = counted["count_all"].to_numpy()
    yield pa.RecordBatch.from_arrays([pa.array([number]), *[pa.nulls(1, t) for t in schema.types[1:-2]], pa.array([pairs.tolist()], schema.types[-1]), pa.array([docs.tolist()], schema.types[-1])], schema=schema)


def coded(docs: DataFrame, a_path: str, b_path: str, with_groups: bool = False) -> DataFrame:
    """Parts of ``docs`` written as ``_part`` gives them: a row for each document and one more for each part."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = both(a_path, b_path)
        steps, size, number = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", STEP_BYTES):
                steps.append(_step(part, two, with_groups, STEP_BYTES))
                size += pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
                if size >= PART_BYTES:
                    yield from _part(steps, number)
                    steps, size, number = [], 0, number + 1
        if steps:
            yield from _part(steps, number)
        two.store.clear()  # a worker outlives its task

    return materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _CODED), "aligned")


def _listed(found: DataFrame) -> DataFrame:
    """(part, place, pair, docs): each part's partial counts."""
    rows = found.where("pairs is not null").select("part", F.posexplode(F.arrays_zip("pairs", "docs")).alias("place", "p"))
    return rows.select("part", "place", F.col("p.pairs").alias("pair"), F.col("p.docs").alias("docs"))


def pair_counts(found: DataFrame) -> DataFrame:
    """(a, b, pair, docs, best) of ``coded`` parts: how many documents of all hold each id pair linked, and whether no other pair of its a is
    held by more."""
    totals = _listed(found).groupBy("pair").agg(F.sum("docs").alias("docs"))
    totals = totals.select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND((1 << 32) - 1).cast("int").alias("b"), "pair", "docs")
    return materialise(totals.withColumn("best", F.col("docs") == F.max("docs").over(Window.partitionBy("a"))), "pair-counts")


def align_documents(docs: DataFrame, a_path: str, b_path: str, with_groups: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups) of every row: its tokens by the byte-level vocabulary
    ``a_path`` and the pieces ``b_path``, the groups between the bytes where tokens of both end, the links, pairs of tokens whose bytes
    overlap, those of them that no other pair of their a outnumbers, and the documents that hold the pairs, over all links.

    Texts null, empty, or that one of the two does not give back byte for byte have no tokens: zeros and no groups. ``groups`` is null
    unless asked for. Rows alike count as documents each; an empty table gives an empty one."""
    found = coded(docs, a_path, b_path, with_groups)
    counts = pair_counts(found)
    told = _listed(found).join(counts.select("pair", F.col("docs").alias("held"), "best"), "pair").select(F.col("part").alias("of"), "place", "held", "best")

    def finish(own: pa.Table, pairs: pa.Table) -> pa.Table:
        held, best = np.zeros((2, pairs.num_rows), np.int64)
        place = pairs["place"].to_numpy()
        held[place], best[place] = pairs["held"].to_numpy(), pairs["best"].to_numpy()
        places, times = _flat(own["places"]), _flat(own["times"])
        at, n = places.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        first = np.concatenate([[0], np.cumsum(pc.list_value_length(places).to_numpy())])
        sums = [np.concatenate([[0], np.cumsum(n * x[at])]) for x in (best, held)]
        n_best, count_sum = (pa.array(s[first[1:]] - s[first[:-1]]) for s in sums)
        return pa.table([*[own[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")], n_best, count_sum, own["groups_sha256"], own["groups"]], names=[c.split()[0] for c in _FOUND.split(", ")])

    rows = found.where("pairs is null").drop("pairs", "docs")
    return rows.groupBy("part").cogroup(told.groupBy("of")).applyInArrow(finish, _FOUND)
