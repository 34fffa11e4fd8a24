"""SimHash near-dedup by similarity of word shingles: fingerprints whose Golay keys meet propose pairs, MinHash bands those
that lie further apart than the keys reach, and the shingle sets of whole texts decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steplens.llm import simhash
from steplens.llm.common import mix, ship, slices, words
from steplens.operators.components import connected_components
from steplens.sources.scratch import materialise

#: Words of a shingle, and the share of two texts' shingles, in tenths, that both must have.
SHINGLE, TENTHS = 5, 8
#: Two texts of similarity s share a band with probability 1 - (1 - s ** ROWS) ** BANDS: 0.9993 at 0.8.
BANDS, ROWS = 24, 6
#: Distinct texts of one band that one task compares; bands with more are dealt out as a grid of parts.
PART = 512

_ODD = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_TURN = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64) + np.uint64(1 << 32)) | np.uint64(1)


def shingles(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of all texts end to end, and the n + 1 offsets of the texts in them. Fewer words than a
    shingle: the whole sequence; no words: none."""
    w = words(text, lower=True)
    n, h = w.counts(), w.hashes()
    place = np.arange(len(h)) - np.repeat(w.first[:-1], n)
    size = np.repeat(n, n)
    at = np.flatnonzero((place <= size - SHINGLE) | ((size < SHINGLE) & (place == 0)))
    total = np.minimum(size[at], SHINGLE).astype(np.uint64)
    for k in range(SHINGLE):
        inside = size[at] > k
        total[inside] += mix(h[at[inside] + k] * _TURN[k])
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    return mix(total), np.concatenate([[0], np.cumsum(count)]).astype(np.int64)


def band_keys(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``BANDS`` keys for each text that has shingles, in order."""
    begin = offsets[:-1][np.diff(offsets) > 0]
    out = np.zeros((len(begin), BANDS), np.uint64)
    for i, odd in enumerate(_ODD if len(begin) else []):
        band = i // ROWS
        out[:, band] = mix((out[:, band] ^ np.minimum.reduceat(mix_once(h, odd), begin)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band + 1))
    return out.view(np.int64)


def mix_once(h: np.ndarray, odd: np.uint64) -> np.ndarray:
    x = h * odd
    return (x ^ (x >> np.uint64(32))) * odd


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, node, fp, bands): node is a digest of the set of shingles, zero where there are none, and fp the
    fingerprint that the shingles vote for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h, offsets = shingles(part.column("text"))
                node = np.zeros(part.num_rows, np.int64)
                for i in np.flatnonzero(np.diff(offsets)).tolist():
                    digest = xxhash.xxh3_64_intdigest(np.unique(h[offsets[i] : offsets[i + 1]]).tobytes())
                    node[i] = np.uint64(digest or 1).view(np.int64)
                keys = band_keys(h, offsets)
                ends = np.concatenate([[0], np.cumsum(np.where(np.diff(offsets) > 0, BANDS, 0))]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1)))
                fp = pa.array(simhash.votes(h, np.diff(offsets)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row_key"), pa.array(node), fp, bands], ["doc_id", "row_key", "node", "fp", "bands"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("row_key"))
    return own.mapInArrow(run, "doc_id long, row_key long, node long, fp long, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, h): the sets of shingles of the nodes ``wanted`` (node, row), from the texts of their rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h, offsets = shingles(part.column("text"))
                sets = [np.unique(h[s:e]) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                flat = np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["node", "h"])

    texts = docs.select("text", F.xxhash64(F.col("doc_id"), "text").alias("row")).join(wanted, "row").select("node", "text")
    return texts.mapInArrow(run, "node long, h array<long>").groupBy("node").agg(F.any_value("h").alias("h"))


def _alike(a: str, b: str) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both * 10 >= (F.size(a) + F.size(b) - both) * TENTHS


def _compare(group: pd.DataFrame) -> pd.DataFrame:
    """Links between the two parts of one cell that join all that its similar pairs join, beyond what was joined before."""
    group = group.drop_duplicates(["node", "side"])
    left, right = group[group["side"] == 0], group[group["side"] == 1]
    if not len(right):  # a part against itself
        right = left
    root = {c: c for c in group["comp"]}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    sets = [*left["h"], *right["h"]]
    size = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    cut = np.concatenate([[0], np.cumsum(size)])
    low = cut[len(left)]
    others, begin = codes[low:], cut[len(left) : -1] - low
    node, comp = right["node"].to_numpy(), right["comp"].tolist()
    mark = np.zeros(int(codes.max()) + 1, np.int64)
    found = []
    for i, (own, c) in enumerate(zip(left["node"].tolist(), left["comp"].tolist(), strict=True)):
        roots = [find(x) for x in comp]
        if all(x == find(c) for x in roots):
            continue
        mark[codes[cut[i] : cut[i + 1]]] = 1
        both = np.add.reduceat(mark[others], begin)
        mark[codes[cut[i] : cut[i + 1]]] = 0
        for j in np.flatnonzero(both * 10 >= (size[i] + size[len(left) :] - both) * TENTHS).tolist():
            u, v = find(c), find(comp[j])
            if u != v:
                root[max(u, v)] = min(u, v)
                found.append((own, int(node[j])))
    return pd.DataFrame(found, columns=["u", "v"]).astype("int64")


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """(u, v): nodes of one fingerprint, each with the least of them, and the least nodes of fingerprints that are linked."""
    fps = materialise(nodes.groupBy("fp").agg(F.min("node").alias("least")), "fingerprints")
    close = materialise(simhash.links(fps.select("fp"), fps.count()), "close")
    u, v = (fps.select(F.col("fp").alias(x), F.col("least").alias(f"n_{x}")) for x in "uv")
    return nodes.select("node", "fp").join(fps, "fp").select(F.col("node").alias("u"), F.col("least").alias("v")).unionByName(close.join(u, "u").join(v, "v").select(F.col("n_u").alias("u"), F.col("n_v").alias("v")))


def links(docs: DataFrame, nodes: DataFrame, part: int = PART) -> DataFrame:
    """(u, v): links between the sets of ``nodes`` (node, row, fp, bands) that join what all pairs of similarity 0.8 or more
    within a band join, and pairs that their fingerprints link; none of them is less similar.

    Bands with the same members count once. Each member is compared with the least and the greatest of its band, which is
    all there is up to three; fuller bands that this does not join to one group are compared in full, as a grid of cells.
    """
    rows = nodes.select("node", F.explode("bands").alias("k"))
    bands = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("node").alias("least"), F.max("node").alias("most"), F.bit_xor(F.xxhash64("node")).alias("all")).where("least <> most")
    bands = materialise(bands.groupBy("n", "least", "most", "all").agg(F.min("k").alias("k")).select("k", "n", "least", "most"), "bands")
    members = materialise(rows.join(bands, "k"), "members")
    stars = members.select(F.explode(F.array(F.struct(F.least("node", "least").alias("u"), F.greatest("node", "least").alias("v")), F.struct(F.least("node", "most").alias("u"), F.greatest("node", "most").alias("v")))).alias("e"))
    stars = stars.select("e.u", "e.v").unionByName(_by_fingerprint(nodes).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))
    stars = materialise(stars.where("u <> v").distinct(), "pairs")
    wanted = members.select("node").unionByName(stars.select(F.explode(F.array("u", "v")).alias("node"))).distinct()
    sets = materialise(_sets(docs, wanted.join(nodes.select("node", "row"), "node")), "sets")
    u, v = (sets.select(F.col("node").alias(x), F.col("h").alias(f"h_{x}")) for x in "uv")
    near = materialise(stars.join(u, "u").join(v, "v").where(_alike("h_u", "h_v")).select("u", "v"), "near")

    joined = connected_components(near, "u", "v")
    full = members.where("n > 3").join(joined, "node", "left").select("k", "n", "node", F.coalesce("component", "node").alias("comp"))
    full = materialise(full, "full")
    open_bands = full.groupBy("k").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("k")
    rest = full.join(materialise(open_bands, "open"), "k").withColumn("parts", F.ceil(F.col("n") / part).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    cells = rest.select("k", "node", "comp", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    cells = cells.select("k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "node", "comp")
    later = cells.join(sets, "node").groupBy("k", "i", "j").applyInPandas(_cell, "u long, v long")
    return near.unionByName(later)


def _cell(group: pd.DataFrame) -> pd.DataFrame:
    if group["i"].iat[0] != group["j"].iat[0] and group["side"].nunique() < 2:
        return pd.DataFrame({"u": [], "v": []}).astype("int64")
    return _compare(group)


def near_duplicates(docs: DataFrame, part: int = PART) -> DataFrame:
    """(doc_id, row_key, node, component_id) for every row of ``docs``.

    Two rows that share a MinHash band, or whose fingerprints differ in at most four bits, are linked if the Jaccard similarity of their sets of five-word shingles, ASCII case
    apart, is 0.8 or more. Shingles are compared as 64-bit hashes. component_id is the smallest doc_id reachable over links,
    the row's own included. Rows of equal sets are merged before any comparison.
    Null texts count as empty, and texts without words are linked to each other; a null doc_id keeps its row and never
    becomes a component_id unless the component has no other. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    rows = materialise(_rows(docs), "rows")
    nodes = materialise(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("row_key").alias("row"), F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands")), "nodes")
    joined = connected_components(materialise(links(docs, nodes, part), "links"), "u", "v")
    placed = nodes.select("node", "least").join(joined, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    by_node = placed.join(least, "component").select("node", "component_id")
    return rows.select("doc_id", "row_key", "node").join(by_node, "node").select("doc_id", "row_key", "node", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` less near copies: of each component the rows of its smallest doc_id stay, and where no row of it
    has a doc_id, all of its rows. Rows of one doc_id with other texts are judged apart."""
    gone = near_duplicates(docs).where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("row_key").alias("_sl_key"), F.col("doc_id").alias("_sl_id")).distinct()
    own = (F.xxhash64(docs["doc_id"], docs["text"]) == gone["_sl_key"]) & docs["doc_id"].cast("long").eqNullSafe(gone["_sl_id"])
    return docs.join(gone, own, "left_anti")
