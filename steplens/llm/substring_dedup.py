"""Repeated word windows: super-k-mers travel by minimiser to buckets, where sorting counts windows exactly."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steplens.llm.common import SLICE_BYTES, Words, mix, ship, slices, span_hashes, text_bytes, words

#: Words of a window, and of the minimiser that decides its bucket.
WINDOW, MINIMISER = 35, 4
#: Bytes of super-k-mers that a map task gathers before it sends them off, and that a bucket has on average.
FLUSH_BYTES, BUCKET_BYTES = 32 << 20, 3 << 20
#: A bucket of more times its average is dealt out by what stands around the minimisers.
HOT = 4


def super_kmers(w: Words, h: np.ndarray, window: int, minimiser: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of windows, minimiser hash, first word of the minimiser) of each run of consecutive windows of one text that share the
    place of their minimiser: the least hash of ``minimiser`` words in a row, the leftmost of equal ones. Equal windows
    have equal minimisers wherever they stand."""
    n, total = w.counts(), len(w.start)
    none = np.empty(0, np.int64)
    if total < window:
        return none, none, none.astype(np.uint64), none
    grams = total - minimiser + 1
    g = h[:grams].copy()
    for j in range(1, minimiser):
        g = mix(g * np.uint64(0x100000001B3) + h[j : j + grams])
    low = (g >> np.uint64(32) << np.uint64(32)) | np.arange(grams, dtype=np.uint64)
    span, have = window - minimiser + 1, 1
    while have < span:
        shift = min(have, span - have)
        low = np.minimum(low[:-shift], low[shift:])
        have += shift
    at = np.arange(len(low))
    begin, size = np.repeat(w.first[:-1], n)[: len(low)], np.repeat(n, n)[: len(low)]
    starts = np.flatnonzero(at - begin <= size - window)
    if not len(starts):
        return none, none, none.astype(np.uint64), none
    least = low[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (least[1:] != least[:-1]) | (np.diff(starts) != 1)
    first = np.flatnonzero(new)
    return starts[first], np.diff(np.append(first, len(starts))), least[first] >> np.uint64(32), (least[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)


@dataclass(frozen=True)
class Deal:
    """How super-k-mers are dealt to buckets, alike for equal windows wherever they stand: by the minimiser; from a ``hot``
    bucket by the minimiser and the words on that side of it where the window has more; and from one that is hot even then
    (``hotter``) each window by itself. Both lists are sorted, and no longer than all bytes over those of a hot bucket."""

    window: int
    minimiser: int
    buckets: int
    hot: np.ndarray
    hotter: np.ndarray

    def runs(self, w: Words, all_of: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, number of windows, bucket) of the runs of windows that travel as one string, or of those alone that
        are dealt by more than the minimiser."""
        h = w.hashes()
        first, count, low, place = super_kmers(w, h, self.window, self.minimiser)
        bucket = mix(low) % np.uint64(self.buckets)
        if not len(self.hot):
            return first, count, bucket
        hot = _among(bucket, self.hot)
        cold = ~hot & all_of
        parts = [(first[cold], count[cold], bucket[cold])]
        first, count, low, place = first[hot], count[hot], low[hot], place[hot]
        side = (self.window - self.minimiser + 1) // 2
        left = np.clip(place - side - first + 1, 0, count)
        for k, begin, size, around in ((1, first, left, place - side), (2, first + left, count - left, place + self.minimiser)):
            some = size > 0
            begin, size, around = begin[some], size[some], around[some]
            own = mix(mix(low[some]) + mix(span_hashes(h, around, around + side)) + np.uint64(k)) % np.uint64(self.buckets)
            alone = _among(own, self.hotter)
            parts.append((begin[~alone], size[~alone], own[~alone]))
            each = np.repeat(begin[alone] - np.cumsum(size[alone]) + size[alone], size[alone]) + np.arange(int(size[alone].sum()))
            parts.append((each, np.ones_like(each), mix(span_hashes(h, each, each + self.window)) % np.uint64(self.buckets)))
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True))

    def spans(self, w: Words, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return w.start[first], w.end[first + count + self.window - 2]


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _pieces(part: pa.Array, deal: Deal):
    w = words(part)
    first, count, bucket = deal.runs(w)
    data = w.joined.tobytes()
    begin, end = deal.spans(w, first, count)
    return w, first, bucket, [data[s:e] for s, e in zip(begin.tolist(), end.tolist(), strict=True)]


def deal_of(texts: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER, bucket_bytes: int = BUCKET_BYTES) -> Deal:
    """The deal for column text of ``texts``: the bytes of every bucket are counted over all of them, equal strings of one slice
    once as they are merged before they travel, and counted again for the hot buckets alone if there are any."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    none = np.empty(0, np.uint64)
    deal = Deal(window, minimiser, max(8, 3 * total // bucket_bytes), none, none)

    def full(deal: Deal) -> np.ndarray:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, int] = defaultdict(int)
            for batch in batches:
                for part in slices(batch, "text"):
                    w = words(part.column("text"))
                    first, size, bucket = deal.runs(w, all_of=not len(deal.hot))
                    begin, end = deal.spans(w, first, size)
                    # Equal strings of one slice travel once.
                    once = np.unique(span_hashes(w.joined, begin, end), return_index=True)[1]
                    own, where = np.unique(bucket[once], return_inverse=True)
                    for b, n in zip(own.tolist(), np.bincount(where, (end - begin)[once], len(own)).tolist(), strict=True):
                        held[b] += int(n)
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], ["bucket", "n"])

        sums = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
        rows = sums.where(F.col("n") > HOT * bucket_bytes).select("bucket").collect()
        return np.array(sorted(r["bucket"] for r in rows), np.uint64)

    deal = replace(deal, hot=full(deal))
    return replace(deal, hotter=full(deal)) if len(deal.hot) else deal


def _repeated_spans(count: dict[bytes, int], window: int) -> Iterator[tuple[bytes, int, int]]:
    """(super-k-mer, first word, words) of what repeated windows cover in each. Windows are sorted by a hash, and equal
    hashes are compared byte by byte."""
    texts = list(count)
    w = words(pa.array(texts, pa.binary()))
    n = w.counts()
    begin, size = np.repeat(w.first[:-1], n), np.repeat(n, n)
    starts = np.flatnonzero(np.arange(len(w.start)) - begin <= size - window)
    left, right = w.start[starts], w.end[starts + window - 1]
    h = span_hashes(w.joined, left, right)
    order = np.argsort(h, kind="stable")
    hit = np.zeros(len(w.start), bool)
    owner = np.repeat(np.arange(len(texts)), n)
    hit[starts] = (np.fromiter(count.values(), np.int64, len(texts)) > 1)[owner[starts]]
    data = w.joined.tobytes()
    same = np.flatnonzero(h[order][1:] == h[order][:-1])
    runs = np.split(same, np.flatnonzero(np.diff(same) != 1) + 1) if len(same) else []
    for run in runs:
        by_text = defaultdict(list)
        for i in order[run[0] : run[-1] + 2].tolist():
            by_text[data[left[i] : right[i]]].append(starts[i])
        for equal in by_text.values():
            if len(equal) > 1:
                hit[equal] = True
    hits = np.flatnonzero(hit)
    if not len(hits):
        return
    cut = np.flatnonzero((np.diff(hits) != 1) | (owner[hits][1:] != owner[hits][:-1])) + 1
    for run in np.split(hits, cut):
        t = owner[run[0]]
        yield texts[t], int(run[0] - w.first[t]), len(run) + window - 1


def _digest(text: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(text)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def repeated_spans(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(_sl_id, _sl_key, _sl_spans): for each row of ``docs`` with repeated windows the word spans (at, n) they cover. Rows
    are told apart by doc_id and a hash of it with the text, so that a repeated doc_id does no harm.

    Two streams leave the documents. Super-k-mers go to the bucket of their minimiser, merged first within each map
    task, so a text that fills a third of the table sends each super-k-mer once a task; buckets that a frequent phrase
    fills in many surroundings are dealt out further. The places where each one stands go by its 128-bit digest to the join with
    what the buckets found, whose skewed keys Spark splits. All places of a super-k-mer in one text are one row, and those no
    further apart than a window are one run of it, as what repeats in each is a window at least: few words over and over are
    one place. Spans of rows equal in doc_id and text are merged as they are gathered.
    """
    ship(docs.sparkSession)
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    deal = deal_of(keyed, window, minimiser, bucket_bytes)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[bytes, int]] = defaultdict(dict)
        size, pack = 0, zstandard.ZstdCompressor(level=6)

        def flush() -> pa.RecordBatch:
            blocks = [pack.compress(b"\n".join((b"2" if n > 1 else b"1") + t for t, n in own.items())) for own in held.values()]
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(blocks, pa.binary())], ["bucket", "block"])

        for batch in batches:
            for part in slices(batch, "text"):
                _, _, bucket, texts = _pieces(part.column("text"), deal)
                for b, t in zip(bucket.tolist(), texts, strict=True):
                    own = held[b]
                    if t in own:
                        own[t] += 1
                    else:
                        own[t] = 1
                        size += len(t)
                if size > FLUSH_BYTES:
                    yield flush()
                    held.clear()
                    size = 0
        if held:
            yield flush()

    def count(group: pd.DataFrame) -> pd.DataFrame:
        unpack, seen = zstandard.ZstdDecompressor(), {}
        for block in group["block"]:
            for line in unpack.decompress(block).split(b"\n"):
                seen[line[1:]] = seen.get(line[1:], 0) + line[0] - 48
        rows = [(*_digest(t), at, n) for t, at, n in _repeated_spans(seen, window)]
        return pd.DataFrame(rows, columns=["d1", "d2", "off", "n"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w, first, _, texts = _pieces(part.column("text"), deal)
                doc = np.searchsorted(w.first, first, side="right") - 1
                digest = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, texts)), np.int64).reshape(-1, 2)
                order = np.lexsort((first, digest[:, 1], digest[:, 0], doc))
                doc, digest, at = doc[order], digest[order], (first - w.first[doc])[order]
                row, run = (np.ones(len(at), bool) for _ in range(2))
                row[1:] = (np.diff(doc) != 0) | (digest[1:] != digest[:-1]).any(axis=1)
                run[1:] = row[1:] | (np.diff(at) > window)
                begin, own = np.flatnonzero(run), np.flatnonzero(row)
                reach = at[np.append(begin, len(at))[1:] - 1] - at[begin]
                runs = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (at[begin], reach)], ["at", "reach"])
                runs = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(begin, own), len(begin)).astype(np.int32)), runs)
                rows = pa.array(doc[own])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digest[own, 0]), pa.array(digest[own, 1]), part.column("doc_id").take(rows), part.column("key").take(rows), runs], ["d1", "d2", "_sl_id", "_sl_key", "runs"]
                )

    found = keyed.select("text").mapInArrow(send, "bucket long, block binary").groupBy("bucket").applyInPandas(count, "d1 long, d2 long, off int, n int")
    places = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "key").mapInArrow(place, "d1 long, d2 long, _sl_id long, _sl_key long, runs array<struct<at:int,reach:int>>")
    of_runs = F.transform("runs", lambda r: F.struct((r["at"] + F.col("off")).alias("at"), (r["reach"] + F.col("n")).alias("n")))
    spans = places.join(found, ["d1", "d2"]).select("_sl_id", "_sl_key", of_runs.alias("spans"))
    return spans.groupBy("_sl_id", "_sl_key").agg(F.flatten(F.collect_set("spans")).alias("_sl_spans"))


def _packed(text: pa.Array) -> pa.Array:
    pack = zstandard.ZstdCompressor(level=3)
    raw, offsets = text_bytes(text)
    ends = offsets.tolist()
    return pa.array([pack.compress(raw[a:b]) if ok else None for a, b, ok in zip(ends, ends[1:], text.is_valid().to_pylist(), strict=False)], pa.binary())


def _unpacked(packed: pa.Array, kind: pa.DataType) -> pa.Array:
    unpack = zstandard.ZstdDecompressor()
    return pa.array([None if x is None else unpack.decompress(x) for x in packed.to_pylist()], pa.large_binary()).cast(kind)


def remove_repeats(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` with every word cut from ``text`` that a window covers whose words stand elsewhere too, in the same text
    or another; with n_words and n_removed beside its columns.

    Windows are judged on the input. White space stays with the word before it, and a text without repeats is unchanged.
    A null text stays null and has no words; texts of fewer words than a window stay; a repeated row repeats all its
    windows. An empty table gives no rows.
    """
    spans = repeated_spans(docs, window, minimiser, bucket_bytes)
    names = [f"_sl_{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index("text")]
    # Whole texts go to the join with their spans packed.
    packed = F.arrow_udf(_packed, "binary")
    whole = docs.select(*[(packed(c) if c == "text" else F.col(c)).alias(n) for n, c in zip(names, docs.columns, strict=True)], F.xxhash64("doc_id", "text").alias("_sl_row"), F.col("doc_id").cast("long").alias("_sl_doc"))
    joined = whole.join(spans, whole["_sl_doc"].eqNullSafe(spans["_sl_id"]) & (whole["_sl_row"] == spans["_sl_key"]), "left")
    joined = joined.select(*names, F.col("_sl_spans.at").alias("_sl_at"), F.col("_sl_spans.n").alias("_sl_n"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES // 2):
                given = _unpacked(part.column(text), pa.string())
                w = words(given)
                cover = np.zeros(len(w.start) + 1, np.int64)
                at, n = part.column("_sl_at"), part.column("_sl_n")
                base = np.repeat(w.first[:-1], np.diff(_list_offsets(at)))
                begin = base + at.flatten().to_numpy()
                np.add.at(cover, begin, 1)
                np.add.at(cover, begin + n.flatten().to_numpy(), -1)
                gone = np.cumsum(cover[:-1]) > 0
                ahead = np.concatenate([[0], np.cumsum(gone)])
                removed = ahead[w.first[1:]] - ahead[w.first[:-1]]
                stop = np.append(w.begin[1:], len(w.raw))
                last = w.first[1:][w.counts() > 0] - 1
                stop[last] = w.offsets[1:][w.counts() > 0]
                edge = np.zeros(len(w.raw) + 1, np.int8)
                np.add.at(edge, w.begin[gone], 1)
                np.add.at(edge, stop[gone], -1)
                keep = np.cumsum(edge[:-1], dtype=np.int8) == 0
                offsets = np.concatenate([[0], np.cumsum(keep)])[w.offsets]
                new = pa.LargeStringArray.from_buffers(len(given), pa.py_buffer(offsets), pa.py_buffer(w.raw[keep].tobytes())).cast(given.type)
                if given.null_count:
                    new = pa.compute.if_else(given.is_null(), pa.scalar(None, given.type), new)
                arrays = [new if c == text else part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(w.counts()), pa.array(removed)], [*names, "_sl_words", "_sl_removed"])

    kinds = [f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields, strict=True)]
    out = joined.mapInArrow(cut, ", ".join([*kinds, "_sl_words long", "_sl_removed long"]))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)], F.col("_sl_words").alias("n_words"), F.col("_sl_removed").alias("n_removed"))


def _list_offsets(lists: pa.Array) -> np.ndarray:
    """Offsets of a list array whose null lists count as empty."""
    return np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
