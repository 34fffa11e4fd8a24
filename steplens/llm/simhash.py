"""SimHash near-duplicates: Golay-code fuzzy keys for the pieces of a fingerprint, joined and verified."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steplens.llm.common import ship, slices, words
from steplens.operators.components import connected_components
from steplens.sources.scratch import materialise

#: Bits of the three segments; each is padded with zeros to the 23 bits of the Golay code.
SEGMENTS = (22, 21, 21)
#: Differing bits that still link. Of four over three segments one segment has none, or two have one each.
MAX_BITS = 4
#: Rows of one key that one task compares; keys with more are dealt out as a grid of parts.
PART = 1 << 19
#: Pairs of one pair of keys up to which all are listed at once; more are compared block by block.
FEW = 1 << 16


def simhash(text: pa.Array, shingle: int = 4) -> np.ndarray:
    """64-bit fingerprints as signed integers: bit i is set if it is set in over half of the XXH64 (seed 42) of the
    word shingles, repeats included. Fewer words than a shingle: the whole sequence; no words: zero."""
    w = words(text, lower=True)
    n = w.counts()
    begin = np.repeat(w.first[:-1], n)
    size = np.repeat(n, n)
    at = np.arange(len(w.start))
    keep = (at - begin <= size - shingle) | ((size < shingle) & (at == begin))
    last = np.minimum(at + shingle, begin + size)[keep] - 1
    data, digest = w.joined.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((digest(data[s:e], 42) for s, e in zip(w.start[keep].tolist(), w.end[last].tolist(), strict=True)), np.uint64, int(keep.sum()))
    return votes(h, np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1)))


def votes(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The bits that are set in over half of each run of ``count`` hashes; zero for an empty run."""
    out, full = np.zeros(len(count), np.uint64), count > 0
    if len(h):
        n = count[full]
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0, dtype=np.int32)
        out[full] = np.packbits(sums * 2 > n[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out.view(np.int64)


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, row_key, fp) for every row of ``docs``, whole texts; null text counts as empty, null and repeated doc_id
    stay, told apart by row_key, a hash of doc_id and text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row_key"), pa.array(simhash(part.column("text"), shingle))], ["doc_id", "row_key", "fp"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("row_key"))
    return own.mapInArrow(run, "doc_id long, row_key long, fp long")


@lru_cache(1)
def golay() -> tuple[np.ndarray, list[np.ndarray]]:
    """The syndrome of each single bit of the perfect (23, 12) Golay code, and for each of the 2048 syndromes the error
    patterns of weight up to 4, lightest first: a word xor its patterns gives the codewords within distance 4, about
    five of them, and the first is the nearest (distance 3 at most)."""
    syndromes = []
    for bit in range(23):
        rest = 1 << bit
        for k in range(22, 10, -1):
            if rest >> k & 1:
                rest ^= 0xC75 << (k - 11)  # generator polynomial of the code
        syndromes.append(rest)
    patterns: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = p = 0
            for b in bits:
                s, p = s ^ syndromes[b], p | 1 << b
            patterns[s].append(p)
    return np.array(syndromes, np.uint32), [np.array(x, np.uint32) for x in patterns]


@lru_cache(1)
def _tables() -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    single, patterns = golay()
    by_byte = []
    for k in range(3):
        table = np.zeros(256, np.uint32)
        for value in range(256):
            for b in range(8):
                if value >> b & 1 and 8 * k + b < 23:
                    table[value] ^= single[8 * k + b]
        by_byte.append(table)
    size = np.array([len(p) for p in patterns])
    padded = np.zeros((2048, int(size.max())), np.uint32)
    for s, p in enumerate(patterns):
        padded[s, : len(p)] = p
    return by_byte, size, padded


def codewords(fp: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, codeword index, nearest) for one segment of each fingerprint: all codewords within distance 4 of it, the
    nearest one first. Of two segments that differ in one bit at most either's nearest codeword is among the other's."""
    by_byte, size, padded = _tables()
    word = segment(fp, number).astype(np.uint32)
    syndrome = by_byte[0][word & 255] ^ by_byte[1][word >> 8 & 255] ^ by_byte[2][word >> 16]
    row = np.repeat(np.arange(len(fp)), size[syndrome])
    rank = np.arange(len(row)) - np.repeat(np.cumsum(size[syndrome]) - size[syndrome], size[syndrome])
    return row, ((word[row] ^ padded[syndrome[row], rank]) >> 11).astype(np.int64), rank == 0


def segment(fp: np.ndarray, number: int) -> np.ndarray:
    return fp.view(np.uint64) >> np.uint64(sum(SEGMENTS[:number])) & np.uint64((1 << SEGMENTS[number]) - 1)


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, nearest) for each fingerprint and segment: the codewords of the segment, numbered through all three."""
    found = [codewords(fp, number) for number in range(len(SEGMENTS))]
    return np.concatenate([r for r, _, _ in found]), np.concatenate([(i << 12) + c for i, (_, c, _) in enumerate(found)]), np.concatenate([n for _, _, n in found])


def second_keys(fp: np.ndarray, number: int, nearest: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) by which fingerprints of one codeword of segment ``number`` are told apart: the segment as it is, which
    is how two meet that do not differ in it, and the codewords of the next segment, or only its nearest."""
    row, word, near = codewords(fp, (number + 1) % len(SEGMENTS))
    keep = near if nearest else np.ones(len(row), bool)
    whole = segment(fp, number).astype(np.int64) << 13 | 1 << 12
    return np.concatenate([np.arange(len(fp)), row[keep]]), np.concatenate([whole, word[keep]])


def candidates(left: np.ndarray, right: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(u, v, compared): links between fingerprints ``left``, by their nearest codeword of segment ``number``, and
    ``right``, that have it among theirs; they join all that pairs within ``MAX_BITS`` join which share a second key."""
    a, ka = second_keys(left, number, True)
    b, kb = second_keys(right, number, False)
    order = np.argsort(ka, kind="stable")
    a, ka = a[order], ka[order]
    order = np.argsort(kb, kind="stable")
    b, kb = b[order], kb[order]
    key, begin, size = np.unique(ka, return_index=True, return_counts=True)
    low, high = np.searchsorted(kb, key, "left"), np.searchsorted(kb, key, "right")
    pairs = size * (high - low)
    links = []
    few = np.flatnonzero((pairs > 0) & (pairs <= FEW))
    for some in np.split(few, np.flatnonzero(np.diff(np.cumsum(pairs[few]) >> 22)) + 1):
        n, wide = pairs[some], (high - low)[some]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        u = left[a[np.repeat(begin[some], n) + at // np.repeat(wide, n)]]
        v = right[b[np.repeat(low[some], n) + at % np.repeat(wide, n)]]
        close = (u != v) & (np.bitwise_count(u.view(np.uint64) ^ v.view(np.uint64)) <= MAX_BITS)
        links.append(spanning(u[close], v[close]))
    for i in np.flatnonzero(pairs > FEW).tolist():
        links.append(forest(left[a[begin[i] : begin[i] + size[i]]], right[b[low[i] : high[i]]]))
    u, v = (np.concatenate([np.empty(0, np.int64), *[x[i] for x in links]]) for i in (0, 1))
    return *spanning(u, v), int(pairs.sum())


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One link to the root of its group for every other end of the links."""
    node, where = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, parent = where[: len(u)], where[len(u) :], np.arange(len(node))
    while True:
        x, y = parent[a], parent[b]
        if (x == y).all():
            break
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent[parent] != parent).any():
            parent = parent[parent]
    linked = parent != np.arange(len(node))
    return node[linked], node[parent[linked]]


def forest(left: np.ndarray, right: np.ndarray, most: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all fingerprints of ``right`` and ``left`` that pairs within ``most`` bits join: one link each to
    the root of its group at most, so that a tight group never gives its pairs. Pairs are compared block by block, and
    those within one group by now are passed over."""
    node, where = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = where[: len(left)], where[len(left) :]
    parent = np.arange(len(node))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    bits, step = node.view(np.uint64), max(1, (1 << 22) // max(1, len(b)))
    for at in range(0, len(a), step):
        rows = a[at : at + step]
        x, y = np.nonzero(np.bitwise_count(bits[rows][:, None] ^ bits[b][None, :]) <= most)
        u, v = parent[rows[x]], parent[b[y]]
        for i, j in np.unique(np.stack([u, v])[:, u != v], axis=1).T.tolist():
            i, j = root(i), root(j)
            parent[max(i, j)] = min(i, j)
        for _ in range(64):
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    linked = parent != np.arange(len(node))
    return node[linked], node[parent[linked]]


def links(distinct: DataFrame, n_docs: int, part: int = PART) -> DataFrame:
    """(u, v): the links of ``compared_links``."""
    return compared_links(distinct, n_docs, part).where("u is not null").select("u", "v")


def compared_links(distinct: DataFrame, n_docs: int, part: int = PART) -> DataFrame:
    """(u, v, compared): links between the distinct fingerprints ``fp`` that join exactly the groups that all pairs within
    ``MAX_BITS`` bits join, and on one row of each task with u null how many pairs it compared.

    Rows travel by a codeword of one segment, and meet there by that segment as it is or by a codeword of the next one: a
    pair with one untouched segment meets by the first, any other has two neighbouring segments of one differing bit. So what is compared shares 21 bits or
    24 of a key. A key is compared in one group of about ``part`` rows, and a fuller key as a grid of such groups."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 16):
                fp = batch.column("fp").slice(at, 1 << 16).to_numpy()
                row, key, near = fuzzy_keys(fp)
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(fp[row]), pa.array(near)], ["k", "fp", "near"])

    rows = distinct.select("fp").mapInArrow(keyed, "k int, fp long, near boolean")
    # At most 3 * 4096 keys: a table of proven size.
    grid = F.broadcast(rows.groupBy("k").count().select("k", F.ceil(F.col("count") / part).cast("int").alias("n")))
    rows = rows.join(grid, "k").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    all_parts = F.sequence(F.lit(0), F.col("n") - 1)
    indexed = rows.where("near").select("k", "fp", F.col("own").alias("i"), F.explode(all_parts).alias("p"), F.lit(True).alias("near"))
    probing = rows.select("k", "fp", F.explode(all_parts).alias("i"), F.col("own").alias("p"), F.lit(False).alias("near"))
    groups = max(8, n_docs // 1024)

    def compare(group: pa.Table) -> pa.Table:
        fp, near, key = group["fp"].to_numpy(), group["near"].to_numpy(), group["k"].to_numpy().astype(np.int64)
        cell = (key << 40) + (group["i"].to_numpy().astype(np.int64) << 20) + group["p"].to_numpy()
        order = np.argsort(cell, kind="stable")
        found = [candidates(fp[own[near[own]]], fp[own[~near[own]]], int(key[own[0]] >> 12)) for own in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1)]
        u, v = spanning(*(np.concatenate([f[i] for f in found]) for i in (0, 1)))
        u, v, n = (pa.concat_arrays([pa.array(x, pa.int64()), pa.array([y], pa.int64())]) for x, y in ((u, None), (v, None), (np.zeros(len(u), np.int64), sum(f[2] for f in found))))
        return pa.Table.from_arrays([u, v, n], ["u", "v", "compared"])

    both = indexed.unionByName(probing).withColumn("g", F.pmod(F.xxhash64("k", "i", "p"), F.lit(groups)))
    return both.groupBy("g").applyInArrow(compare, "u long, v long, compared long")


def near_duplicates(docs: DataFrame, shingle: int = 4, part: int = PART) -> DataFrame:
    """(doc_id, row_key, fp, component_id) for every row of ``docs``.

    Two rows are linked if their fingerprints differ in at most ``MAX_BITS`` bits;
    component_id is the smallest doc_id reachable over links, the row's own included. Equal fingerprints are merged
    before any comparison. Null texts count as empty and link at fingerprint zero; a null doc_id keeps its row and
    never becomes a component_id unless the component has no other. An empty table gives no rows.
    """
    fps = materialise(fingerprints(docs, shingle), "fingerprints")
    n_docs = fps.count()
    merged = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    distinct = materialise(merged, "distinct")
    nodes = connected_components(materialise(links(distinct, n_docs, part), "links"), "u", "v")
    placed = distinct.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = placed.join(least, "component").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", "row_key", "fp", "component_id")


def fingerprint_hex(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` less near-duplicates: of each component the rows of its smallest doc_id stay, and where no row
    of it has a doc_id, all of its rows. Rows of one doc_id with other texts are judged apart."""
    gone = near_duplicates(docs).where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("row_key").alias("_sl_key"), F.col("doc_id").alias("_sl_id")).distinct()
    own = (F.xxhash64(docs["doc_id"], docs["text"]) == gone["_sl_key"]) & docs["doc_id"].cast("long").eqNullSafe(gone["_sl_id"])
    return docs.join(gone, own, "left_anti")
