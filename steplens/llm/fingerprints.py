"""Canonical exact digests of documents: folded text under a wide xxHash, with byte comparison of equal digests."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from steplens.llm.common import ship, slices
from steplens.sources.scratch import materialise

#: Text bytes of one range of doc_id, which one task reads in order, and ranges at most: beyond them ranges grow, and are
#: still read row by row.
RANGE_BYTES, MOST_RANGES = 4 << 20, 20_000
#: Documents with repeated digests up to which their ids are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000
_NULL_ID = -(1 << 63)


def canonical(text: str) -> str:
    """NFKC, full case folding, NFKC again, and every run of white space as one space, none at the ends."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split())


def digest(folded: str) -> str:
    return xxhash.xxh3_128_hexdigest(folded.encode("utf-8", "surrogatepass"))


def second_digest(folded: str) -> bytes:
    """What tells folded texts apart whose first digests are the same."""
    return hashlib.blake2b(folded.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _with_neighbours(docs: DataFrame) -> DataFrame:
    """``docs`` dealt into ranges of doc_id, column r, each in descending order in one partition; the first row of the
    range below comes along at its end with ahead set, and the first row of all with the last range."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("place", F.coalesce("doc_id", F.lit(_NULL_ID)))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(max(1, min(MOST_RANGES, total // RANGE_BYTES)))
    cuts = own.agg(F.percentile_approx("place", [i / n for i in range(1, n)] or [0.5], 10 * n + 1000)).first()[0] if n > 1 else []
    bounds = np.unique(np.array(cuts or [], np.int64))

    @F.pandas_udf(T.IntegerType())
    def number(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, place.to_numpy(), side="left").astype(np.int32))

    # One row a range, MOST_RANGES at most.
    heads = own.select("place", number("place").alias("r")).groupBy("r").agg(F.max("place")).collect()
    heads = sorted((r, place) for r, place in heads)
    targets = {place: heads[(i + 1) % len(heads)][0] for i, (_, place) in enumerate(heads)}
    known, to = np.array(sorted(targets), np.int64), np.array([targets[k] for k in sorted(targets)], np.int32)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def dealt(place: pd.Series) -> pd.Series:
        p = place.to_numpy()
        r = np.searchsorted(bounds, p, side="left")
        i = np.minimum(np.searchsorted(known, p), len(known) - 1)
        head = known[i] == p
        return pd.Series([[a, b] if h else [a] for a, b, h in zip(r.tolist(), to[i].tolist(), head.tolist(), strict=True)])

    placed = own.select("doc_id", "text", "place", F.posexplode(dealt("place")).alias("ahead", "r"))
    return placed.repartitionById(len(bounds) + 1, "r").sortWithinPartitions("r", "ahead", F.desc("place"), "text")


def fingerprints(docs: DataFrame, digest: Callable[[str], str] = digest) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The edited text is the whole text with its last third of code points replaced by as many of the next document's
    first, in descending doc_id; after the last comes the first. Rows of one doc_id stand in the order of their texts, null
    doc_id last; null text counts as empty; a single row is its own next; an empty table gives no rows. An exact digest
    is like another or not: the likenesses are 1 or 0, and compare folded bytes. Where different folded texts, edited ones
    among them, share a digest, a second one of each text follows it.
    """
    ship(docs.sparkSession)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "second", "edited_second"]
    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, second binary, edited_second binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (range, ahead, doc_id, text, folded) of the row before
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for r, ahead, doc_id, text in zip(*(part.column(c).to_pylist() for c in ("r", "ahead", "doc_id", "text")), strict=True):
                    folded = canonical(text)
                    if held and held[0] == r and not held[1]:
                        rows.append(_compare(digest, *held[2:], text, folded))
                    held = (r, ahead, doc_id, text, folded)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(_KINDS), _KINDS, strict=True)], names)

    if docs.isEmpty():
        return docs.sparkSession.createDataFrame([], kinds).drop("second", "edited_second")
    found = materialise(_with_neighbours(docs).mapInArrow(run, kinds), "digests")
    return _told_apart(docs, found, digest)


_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.binary(), pa.binary()]


def _compare(digest: Callable[[str], str], doc_id: int | None, text: str, folded: str, after: str, after_folded: str) -> tuple:
    third = len(text) // 3
    edited = text[: len(text) - third] + after[:third]
    other = canonical(edited)
    return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), digest(folded), digest(other), float(folded == other), float(folded == after_folded), second_digest(folded), second_digest(other)


def _shared_by_texts(docs: DataFrame, found: DataFrame, digest: Callable[[str], str]) -> DataFrame:
    """Digests that the bytes of two different folded texts of ``docs`` share."""
    # Written first, so that the join deals out both its sides itself and Spark may split a digest of very many rows.
    repeated = materialise(found.groupBy("fingerprint").count().where("count > 1").select("fingerprint"), "shared-digests")
    ids = materialise(found.join(repeated, "fingerprint").select("doc_id").distinct(), "repeated")
    side = F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))

    @F.pandas_udf("folded string, fingerprint string")
    def fold(text: pd.Series) -> pd.DataFrame:
        folded = [canonical(t) for t in text]
        return pd.DataFrame({"folded": folded, "fingerprint": [digest(t) for t in folded]})

    texts = own.join(side, own["id"].eqNullSafe(ids["doc_id"]), "left_semi").select(fold("text").alias("f")).select("f.*")
    return texts.groupBy("fingerprint").agg(F.min("folded").alias("low"), F.max("folded").alias("high")).where("low <> high").select("fingerprint")


def _told_apart(docs: DataFrame, found: DataFrame, digest: Callable[[str], str]) -> DataFrame:
    """``found`` with digests that different folded texts share extended by the second digest of each text; the texts themselves are
    compared by their bytes, edited ones by their second digests."""
    both = found.select("fingerprint", "second").unionByName(found.select(F.col("edited_fingerprint").alias("fingerprint"), F.col("edited_second").alias("second")))
    edited = both.groupBy("fingerprint").agg(F.min("second").alias("low"), F.max("second").alias("high")).where("low <> high").select("fingerprint")
    shared = materialise(_shared_by_texts(docs, found, digest).unionByName(edited).distinct(), "shared")
    if not shared.isEmpty():
        for name, second in (("fingerprint", "second"), ("edited_fingerprint", "edited_second")):
            own = shared.select(F.col("fingerprint").alias("_shared"))
            found = found.join(own, found[name] == own["_shared"], "left")
            found = found.withColumn(name, F.when(F.col("_shared").isNull(), F.col(name)).otherwise(F.concat_ws("-", name, F.lower(F.hex(second))))).drop("_shared")
    return found.drop("second", "edited_second")
