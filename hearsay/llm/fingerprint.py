"""Document fingerprints: a digest of quartiles of hashed byte-triplet counts, with a bounded difference score."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm import textops as tx

BUCKETS = 256
#: Triplets of bytes within a window of four: which two bytes follow the first.
SHAPES = ((1, 2), (1, 3), (2, 3))
#: Most points that the length can add to a difference, and that any two digests can differ by.
LENGTH_POINTS, STEP = 48, (0, 1, 2, 6)
WORST = 6 * BUCKETS + LENGTH_POINTS
#: Bytes of text of a stretch of ids, beyond as many as the session has shuffle partitions, and most stretches.
STRETCH, STRETCHES = 1 << 27, 10_000


def digests(texts: Iterable[bytes]) -> list[str]:
    """The digest of each text: two hex digits for its length, then two bits for each bucket.

    Three triplets of each window of four bytes are hashed to BUCKETS buckets. A bucket's code is
    the quarter of all buckets' counts that its count lies in: 0 up to the first quartile, 3 above
    the third. The length is coded by its logarithm, in steps of a tenth. Texts of under four
    bytes have no triplets, all codes 0, and their length.
    """
    out = []
    for data in texts:
        raw = np.frombuffer(data, np.uint8)
        if len(raw) >= 4:
            n = len(raw) - 3
            first = raw[:n].astype(np.uint32)
            count = np.zeros(BUCKETS, np.int64)
            for k, (i, j) in enumerate(SHAPES):
                x = first * np.uint32(0x9E3779B1) + raw[i : n + i] * np.uint32(0x85EBCA77) + raw[j : n + j] * np.uint32(0xC2B2AE3D) + np.uint32(0x27D4EB2F * (k + 1) & 0xFFFFFFFF)
                x ^= x >> np.uint32(15)
                x *= np.uint32(0x2C1B3C6D)
                count += np.bincount(x >> np.uint32(24), minlength=BUCKETS)
            low, mid, high = np.sort(count)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
            code = (count > low).astype(np.uint8) + (count > mid) + (count > high)
        else:
            code = np.zeros(BUCKETS, np.uint8)
        packed = code[0::4] << 6 | code[1::4] << 4 | code[2::4] << 2 | code[3::4]
        out.append(f"{min(255, int(10 * np.log(1 + len(raw)))):02x}{packed.tobytes().hex()}")
    return out


def _codes(digest: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex("".join(digest)), np.uint8).reshape(len(digest), 1 + BUCKETS // 4)
    return raw[:, 0].astype(np.int64), np.stack([raw[:, 1:] >> s & 3 for s in (6, 4, 2, 0)], axis=2).reshape(len(digest), BUCKETS)


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """1 minus the share of the worst difference, row by row: 1 for equal digests, at least 0.

    Buckets add 0, 1, 2 or 6 points by how many quarters they lie apart, lengths one for each
    step up to LENGTH_POINTS.
    """
    if not left:
        return np.zeros(0)
    (n, a), (m, b) = _codes(left), _codes(right)
    points = np.array(STEP)[np.abs(a.astype(np.int8) - b.astype(np.int8))].sum(axis=1) + np.minimum(np.abs(n - m), LENGTH_POINTS)
    return 1 - points / WORST


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of whole texts; a null text counts as empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.row_slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], pa.array(digests((t or "").encode() for t in batch.column(1)[part].to_pylist()))], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """text with its last half (rounded down) replaced by as many first characters of the following text, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each text.

    The next text is the next in order of doc_id (null first), then text; the first follows the
    last. Rows are dealt by ranges of doc_id, so each task streams through a sorted stretch with
    one text in hand; the first text of each stretch is also sent to the end of the one before.
    A null text is empty. Repeated rows follow one another. Other columns are ignored.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    if not parts:
        size = own.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size // STRETCH, STRETCHES))
    marks = own.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 100 * parts)).first()[0] or []
    bounds = np.array(sorted(set(marks)), np.int64)

    @F.arrow_udf("int")
    def stretch(ids: pa.Array) -> pa.Array:
        known = np.asarray(ids.fill_null(-(1 << 63)))
        return pa.array(np.searchsorted(bounds, known, side="right").astype(np.int32))

    own = own.withColumn("part", stretch("doc_id"))
    # the first row of each stretch, as many rows as stretches: its key by an aggregate, then its text by a join
    lead = own.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("k"))
    least = own.join(F.broadcast(lead), "part").where(F.col("doc_id").eqNullSafe(F.col("k.doc_id"))).groupBy("part").agg(F.min("text").alias("text"))
    order = sorted(r.part for r in lead.select("part").collect())
    before = F.create_map(*(F.lit(x) for i, p in enumerate(order) for x in (p, order[i - 1]))) if order else F.create_map(F.lit(0), F.lit(0))
    ghost = least.select(F.lit(None).cast("long").alias("doc_id"), "text", before[F.col("part")].alias("part"), F.lit(1).alias("ghost"))
    rows = own.withColumn("ghost", F.lit(0)).unionByName(ghost).repartition(parts, "part").sortWithinPartitions("part", "ghost", "doc_id", "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_part = None, None
        for batch in batches:
            for at in tx.row_slices(batch.column(1)):
                out = []
                for doc, text, part, ghost in zip(*(c[at].to_pylist() for c in batch.columns), strict=True):
                    own_print = digests([text.encode()])[0]
                    if held and part == held_part:
                        changed = edited(held[1], text)
                        out.append((held[0], len(held[1]), hashlib.sha256(changed.encode()).hexdigest(), held[2], digests([changed.encode()])[0], own_print))
                    # the row at a stretch's end only lends its text
                    held, held_part = None if ghost else (doc, text, own_print), part
                if out:
                    doc, chars, sha, own_prints, changed, following = map(list, zip(*out, strict=True))
                    near = [pa.array(likeness(own_prints, x)) for x in (changed, following)]
                    yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(chars, pa.int64()), *map(pa.array, (sha, own_prints, changed)), *near], names)

    return rows.select("doc_id", "text", "part", "ghost").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
