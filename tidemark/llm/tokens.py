"""Encoding of texts with a public byte-level tokenizer, in overlapping chunks.

A text of one chunk is one piece. Longer ones are cut into overlapping chunks that tasks pre-tokenise in parallel; where
the pre-tokens of two neighbours meet at a boundary in their overlap, the streams agree from there on, and the texts
between such boundaries are encoded as pieces. Pieces are cut from the chunks, never from the whole text. If an overlap has
no boundary (a pre-token is longer), the next one of the following chunks ends the piece, so that a piece is longer than
a chunk only by what no tokenizer could split. The ids equal those of the whole text.

Only sure boundaries are used: those that every way of pre-tokenising has, wherever it started, as the pattern joins the two
characters beside it in no pre-token. Each side encoded alone then gives the same pre-tokens.

Defined cases: NULL, empty texts: an empty list; blank texts are encoded as they are; rows with NULL or repeated ids are
encoded one by one, as texts are told apart by row; decoding joins the raw bytes of the ids, so a character split among
tokens comes out whole; further columns of the input aren't read.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Callable, Iterator
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import settle

#: Where the vocabularies lie; the driver reads the file and hands its bytes (a fixed size) to the executors.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The fixed pattern of the vocabulary's pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a chunk and of its overlap with the next one, and how many boundaries of an overlap are compared.
CHUNK_CHARS, OVERLAP_CHARS, COMPARED = 2_000, 200, 8
#: Between which characters a boundary is sure: behind a letter, digit or sign and before another kind, but for what an apostrophe can join.
SURE = r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=[^\s\p{L}\p{N}])(?=[\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=\p{L})"

_loaded: dict[int, object] = {}


def encoding(ranks: bytes):
    """The tokenizer of a rank file, built once per Python worker."""
    import tiktoken

    key = hash(ranks)
    if key not in _loaded:
        pairs = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines() if isinstance(ranks, bytes) else ranks)}
        _loaded[key] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=pairs, special_tokens={})
    return _loaded[key]


def vocabulary(spark: SparkSession, path: str = VOCABULARY) -> Broadcast:
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def _encoder(ranks: Broadcast, text: str, keep: list[str], count: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoding(ranks.value)
        for batch in batches:
            ids = [tokenizer.encode_ordinary(t) if t else [] for t in batch.column(text).to_pylist()]
            out = pa.array([len(x) for x in ids], pa.int64()) if count else pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], out], names=[*keep, "n" if count else "ids"])

    return encode


def boundaries(text: str, start: int, stop: int) -> Iterator[int]:
    """Starts of pre-tokens in [start, stop), but for 0, that are sure.

    Pre-tokens are sought from a sure boundary shortly before ``start``, from which on they are those of the whole text.
    Characters that no version of Unicode had yet are left out, as libraries may differ on them.
    """
    import regex

    base = max(start - OVERLAP_CHARS, 1) - 1
    sure = [base + m.start() for m in regex.finditer(SURE, text[base : stop + 1]) if m.start()]
    begin = 0 if base == 0 else next(iter(sure), stop)
    sure = {at for at in sure if unicodedata.category(text[at - 1]) != "Cn" != unicodedata.category(text[at])}
    for m in regex.finditer(PATTERN, text, pos=begin):
        if m.start() >= stop:
            return
        if m.start() >= start and m.start() in sure:
            yield m.start()


def _chunks(rows: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(_row, _id, _i, _len, _text): the overlapping chunks of each text, numbered; settled, so that rows keep their numbers."""
    kind = rows.schema["_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, text in enumerate(batch.column("_text").to_pylist()):
                starts = range(0, len(text), chunk)
                for first in range(0, len(starts), 1000):
                    some = starts[first : first + 1000]
                    same = pa.array(np.zeros(len(some), np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [*[batch.column(c).slice(n, 1).take(same) for c in ("_row", "_id")], pa.array([s // chunk for s in some], pa.int64()), pa.array([len(text)] * len(some), pa.int64()), pa.array([text[s : s + chunk + overlap] for s in some], pa.string())],
                        names=["_row", "_id", "_i", "_len", "_text"],
                    )

    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    return settle(numbered.mapInArrow(cut, f"_row bigint, _id {kind}, _i bigint, _len bigint, _text string").repartition("_row", "_i"))


def pieces(rows: DataFrame, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """(_row, _id, _piece, _text): the texts (_id, _text) cut where the pre-tokens of overlapping chunks meet; _piece rises along the text."""
    if not 0 < overlap <= chunk:
        raise ValueError("the overlap must be in (0, chunk]")
    chunks = _chunks(rows, chunk, overlap)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails, firsts = [], [], []
            for i, t in zip(batch.column("_i").to_pylist(), batch.column("_text").to_pylist()):
                heads.append([i * chunk + b for b in islice(boundaries(t, 0, overlap), COMPARED)])
                tails.append([i * chunk + b for b in islice(boundaries(t, chunk, chunk + overlap), COMPARED)])
                firsts.append(heads[-1][0] if heads[-1] else next((i * chunk + b for b in boundaries(t, overlap, chunk)), None))
            places = [pa.array(x, pa.list_(pa.int64())) for x in (heads, tails)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("_row", "_i", "_len")], *places, pa.array(firsts, pa.int64())], names=["_row", "_i", "_len", "_head", "_tail", "_first"])

    ends = chunks.select("_row", "_i", "_len", "_text").mapInArrow(edges, "_row bigint, _i bigint, _len bigint, _head array<bigint>, _tail array<bigint>, _first bigint")
    order = Window.partitionBy("_row").orderBy("_i")
    meet = F.when(F.col("_i") == 0, F.lit(0)).otherwise(F.coalesce(F.array_min(F.array_intersect("_head", F.lag("_tail").over(order))), F.col("_first")))
    points = ends.withColumn("_meet", meet)
    points = points.withColumn("_next", F.lead("_meet").over(order)).withColumn("_piece", F.max(F.when(F.col("_meet").isNotNull(), F.col("_i"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.max(F.when(F.col("_meet").isNotNull(), F.col("_i"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    points = points.withColumn("_before", before)

    start, stop = F.col("_i") * chunk, F.least((F.col("_i") + 1) * chunk, F.col("_len"))
    reach = F.least((F.col("_i") + 1) * chunk + overlap, F.col("_len"))
    end = F.when(F.col("_next") < reach, F.col("_next")).otherwise(stop)
    span = lambda piece, a, z: F.struct(piece.alias("_piece"), F.substr("_text", (a - start + 1).cast("int"), (z - a).cast("int")).alias("_text"))
    own = span(F.col("_piece"), F.coalesce("_meet", start), end)
    # what lies before the first boundary of a chunk and wasn't in reach of the chunk before belongs to the piece begun there
    lead = F.when(F.col("_meet") >= start + overlap, span(F.col("_before"), start, F.col("_meet")))
    parts = chunks.select("_row", "_id", "_i", "_text").join(points.drop("_head", "_tail", "_first"), ["_row", "_i"]).select("_row", "_id", "_i", F.explode(F.array_compact(F.array(lead, own))).alias("_p")).select("_row", "_id", "_i", "_p.*")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_text"))), lambda x: x["_text"]), "")
    return parts.groupBy("_row", "_piece").agg(F.first("_id").alias("_id"), joined.alias("_text"))


def encode(documents: DataFrame, ident: str, text: str, ranks: Broadcast, count: bool = False, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """(ident, ids ARRAY<INT>), or with ``count`` (ident, n BIGINT), of every row."""
    rows = documents.select(F.col(ident).alias("_id"), F.col(text).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    made = "n bigint" if count else "ids array<int>"
    length = F.coalesce(F.length("_text"), F.lit(0))
    single = rows.where(length <= chunk).mapInArrow(_encoder(ranks, "_text", ["_id"], count), f"_id {kind}, {made}")
    several = pieces(rows.where(length > chunk), chunk, overlap)
    encoded = several.mapInArrow(_encoder(ranks, "_text", ["_row", "_piece", "_id"], count), f"_row bigint, _piece bigint, _id {kind}, {made}")
    whole = F.sum("n").alias("n") if count else F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_piece", "ids"))), lambda x: x["ids"])).alias("ids")
    stitched = encoded.groupBy("_row").agg(F.first("_id").alias("_id"), whole).drop("_row")
    return single.unionByName(stitched).withColumnRenamed("_id", ident)


def decode(encoded: DataFrame, ident: str, ids: str, ranks: Broadcast) -> DataFrame:
    """(ident, text): the raw bytes of the ids joined and read as UTF-8; NULL for a NULL list."""
    rows = encoded.select(F.col(ident).alias("_id"), F.col(ids).alias("_ids"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoding(ranks.value)
        for batch in batches:
            texts = [None if x is None else tokenizer.decode_bytes(x).decode("utf-8", errors="replace") for x in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(texts, pa.string())], names=["_id", "text"])

    return rows.mapInArrow(join, f"_id {rows.schema['_id'].dataType.simpleString()}, text string").withColumnRenamed("_id", ident)
