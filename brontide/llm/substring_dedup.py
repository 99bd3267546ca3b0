"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

A word goes if a window of ``window`` consecutive words covers it whose word
sequence also starts earlier (smaller id, or the same document further left).

The corpus itself is the reference.  It is indexed by anchors: the smallest
hash of ``gram`` consecutive words in each window (a minimizer), which equal
windows share whatever stands around them.  The reference block of an anchor is
the stretch of words that its windows can reach; the earliest of equal blocks stands
for all.  Matching a document against every block of the corpus word by word would be
quadratic; the anchors find the blocks that can hold a factor, and none is missed:

* the whole block equals one that occurs earlier: the factor goes on, and every
  window of the anchor is a repeat;
* no other place has the anchor: no window there can be a repeat;
* the anchor is known but the block is not: a factor begins or ends inside it.
  Only these windows are compared one by one with the windows of the other
  blocks of the anchor (the check at factor boundaries).

The matches of a document with one reference document at one distance are strung
together; from left to right, the parse takes at each place the match that reaches
furthest and goes on at its end (``factors``: start, length, and where in which
document the words stand before).  The words of all factors go.

Anchors are about an eighth of all positions, and a hot passage is counted by
partial aggregation before anything is shuffled.  Joins are on hashes whose hot
keys Spark may split; documents are shuffled by id only.

Defined cases: a null or empty text has no words; texts under ``window`` words
lose nothing; equal copies keep the copy of the smallest id; rows of one id and
one text are one document and lose the same words, each in its own row; rows of
one id and different texts are different documents, in the order of the texts'
hashes; a row with a null id loses nothing; ids are integers (any other type raises
TypeError); extra columns are ignored, whatever
their names, but ``cleaned`` keeps them.  Word sequences are compared as
64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import arrow_batches, discard, integer_ids, materialise
from .hashing import Segments, Words, blocks, mix

GRAM = 6
_FACTOR = ("start", "length", "ref_id", "ref_start")


def _anchors(words: Words, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, block hash, text index, first and last window start, place) of each anchor of a block of texts."""
    hashes, reach = words.hash, window - gram + 1
    total = len(hashes)
    first, last = words.each(words.first), words.each(words.last)
    starts = np.flatnonzero(np.arange(total) + window <= last)
    none = np.zeros(0, np.int64)
    if not len(starts):
        return none, none, none, none, none, none
    seg = Segments(hashes)
    at = np.arange(total - gram + 1)
    grams = seg.of(at, at + gram)
    view = np.lib.stride_tricks.sliding_window_view(grams, reach)
    least = np.empty(len(starts), np.int64)
    for i in range(0, len(starts), 1 << 16):
        part = starts[i : i + (1 << 16)]
        least[i : i + (1 << 16)] = part + view[part].argmin(axis=1)
    new = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    p, s0 = least[new], starts[new]
    s1 = starts[np.concatenate([new[1:], [len(starts)]]) - 1]
    left, right = np.maximum(first[p], p - reach + 1), np.minimum(last[p], p + window)
    block = mix(seg.of(left, p) * np.uint64(3) + seg.of(p, right))
    text = np.searchsorted(words.last, p, side="right")
    return grams[p].view(np.int64), block.view(np.int64), text, s0 - first[p], s1 - first[p], p - first[p]


def _index(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, which = np.asarray(batch.column(0)), np.asarray(batch.column(2))
            for i, texts in blocks(batch.column(1).cast(pa.binary()).to_pylist()):
                a, c, t, *at = _anchors(Words(texts), window, gram)
                yield pa.record_batch([pa.array(a), pa.array(c), pa.array(ids[t + i]), pa.array(which[t + i]), *(pa.array(x, pa.int32()) for x in at)], ["a", "c", "d", "v", "s0", "s1", "p"])

    return run


def _windows(window: int):
    """The window hashes of the listed starts of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, which, spans = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i, texts in blocks(batch.column(1).cast(pa.binary()).to_pylist()):
                words = Words(texts)
                seg, h, d, v, s = Segments(words.hash), [], [], [], []
                for j in range(len(texts)):
                    at = np.unique(np.concatenate([np.arange(x["s0"], x["s1"] + 1) for x in spans[i + j]]))
                    at = at[at + window <= words.last[j] - words.first[j]]
                    h.append(seg.of(at + words.first[j], at + words.first[j] + window).view(np.int64))
                    d.append(np.full(len(at), ids[i + j], np.int64))
                    v.append(np.full(len(at), which[i + j], np.int64))
                    s.append(at)
                yield pa.record_batch([pa.array(np.concatenate(h)), pa.array(np.concatenate(d)), pa.array(np.concatenate(v)), pa.array(np.concatenate(s), pa.int32())], ["h", "d", "v", "s"])

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str, own: tuple[Column, ...] = ()) -> DataFrame:
    """(``d``, ``v``, ``t``, ``own`` ...): id, what tells texts of one id apart, text; ``v`` is 0 if no id is repeated."""
    key = docs.select(F.col(id_col).cast("long").alias("d")).where("d is not null")
    repeated = not key.groupBy("d").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    which = F.xxhash64(F.col(text_col)) if repeated else F.lit(0).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("d"), which.alias("v"), F.col(text_col).alias("t"), *own)


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, gram: int = GRAM) -> DataFrame:
    """(``d``, ``v``, ``a``, ``b``, ``rd``, ``rv``, ``ra``): word spans [a, b) made of windows that start earlier, at ``ra`` of (``rd``, ``rv``)."""
    return _spans(_keyed(docs, id_col, text_col), window, gram)


def _spans(keyed: DataFrame, window: int, gram: int) -> DataFrame:
    arrow_batches(keyed.sparkSession)
    slim = keyed.where("d is not null and t is not null")
    rows = slim.select("d", "t", "v").mapInArrow(_index(window, gram), "a long, c long, d long, v long, s0 int, s1 int, p int")
    rows = materialise(rows, "anchors")
    # written first: a join of two plain exchanges is one whose hot keys Spark can split
    shared = materialise(rows.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a"), "shared")
    known = materialise(rows.join(shared.hint("merge"), "a", "left_semi"), "known")
    discard(rows, shared)
    place = F.struct("d", "v", "s0", "s1", "p")
    whole = materialise(known.groupBy("a", "c").agg(F.min(place).alias("f"), F.count(F.lit(1)).alias("n")), "blocks")
    mixed = materialise(whole.groupBy("a").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("a"), "mixed")
    firsts = whole.join(mixed.hint("merge"), "a", "left_semi").select("f.d", "f.v", F.struct("f.s0", "f.s1").alias("x"))
    ends = slim.join(firsts.groupBy("d", "v").agg(F.collect_list("x").alias("x")), ["d", "v"]).select("d", "t", "v", "x")
    compared = materialise(ends.mapInArrow(_windows(window), "h long, d long, v long, s int"), "windows")
    seen = materialise(compared.groupBy("h").agg(F.min(F.struct("d", "v", "s")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "f"), "seen")
    single = compared.join(seen.hint("merge"), "h").where("d != f.d or v != f.v or s != f.s").select(
        "d", "v", F.col("s").alias("a"), (F.col("s") + window).alias("b"), F.col("f.d").alias("rd"), F.col("f.v").alias("rv"), F.col("f.s").alias("ra")
    )
    repeated = whole.where("n > 1").select("a", "c", "f")
    going_on = (
        known.join(repeated.hint("merge"), ["a", "c"])
        .where("d != f.d or v != f.v or s0 != f.s0")
        # equal blocks stand the same way around their anchors, though their windows may be fewer
        .select("d", "v", F.col("s0").alias("a"), (F.col("s1") + window).alias("b"), F.col("f.d").alias("rd"), F.col("f.v").alias("rv"), (F.col("s0") - F.col("p") + F.col("f.p")).cast("int").alias("ra"))
    )
    return going_on.unionByName(single)


def factored(a: np.ndarray, b: np.ndarray, ref: np.ndarray, ra: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(start, length, reference, start there) of the factors that matches [a, b) with references ``ref`` at ``ra`` give, from left to right."""
    shift = ra - a
    order = np.lexsort((a, shift, ref))
    a, b, ref, shift = a[order], b[order], ref[order], shift[order]
    runs: list[list[int]] = []  # matches of one reference at one distance, as far as they touch
    for x, y, r, s in zip(a.tolist(), b.tolist(), ref.tolist(), shift.tolist(), strict=True):
        if runs and runs[-1][2:] == [r, s] and x <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], y)
        else:
            runs.append([x, y, r, s])
    runs.sort()
    out, at, k, best = [], -1, 0, None
    while k < len(runs) or (best and best[1] > at):
        while k < len(runs) and runs[k][0] <= at:
            best = runs[k] if best is None or runs[k][1] > best[1] else best
            k += 1
        if best is None or best[1] <= at:
            if k < len(runs):
                at, best = runs[k][0], None
            continue
        out.append((at, best[1] - at, best[2], at + best[3]))
        at = best[1]
    return out


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, spans = batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2)
        bounds, flat = spans.offsets.to_numpy(), spans.values
        a, b, rd, rv, ra = (flat.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("a", "b", "rd", "rv", "ra"))
        n_words, n_removed, kept, digest, factors = [], [], [], [], []
        for i, text in enumerate(texts):
            words = (text or b"").split()
            total, j, k, own = len(words), bounds[i], bounds[i + 1], []
            if k > j and spans[i].is_valid:
                pairs, ref = np.unique(np.stack([rd[j:k], rv[j:k]]), axis=1, return_inverse=True)
                own = [(s, min(n, total - s), int(pairs[0, r]), at) for s, n, r, at in factored(a[j:k], b[j:k], ref.ravel(), ra[j:k])]
                gone = np.zeros(total, bool)
                for s, n, *_ in own:
                    gone[s : s + n] = True
                words = [words[x] for x in np.flatnonzero(~gone)]
            out = b" ".join(words)
            n_words.append(total)
            n_removed.append(total - len(words))
            kept.append(out)
            digest.append(hashlib.sha256(out).hexdigest())
            factors.append([dict(zip(_FACTOR, x, strict=True)) for x in own])
        kind = pa.list_(pa.struct([(x, pa.int64()) for x in _FACTOR]))
        yield pa.record_batch(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(digest), pa.array(factors, kind), *batch.columns[3:]],
            ["_id", "n_words", "n_removed", "kept_text", "kept_sha256", "factors", *batch.schema.names[3:]],
        )


def _parsed(docs: DataFrame, id_col: str, text_col: str, window: int, more: tuple[str, ...]) -> DataFrame:
    """(_id, n_words, n_removed, kept_text, kept_sha256, factors, more): a row per row of ``docs``, its own columns ``more`` in one struct."""
    integer_ids(docs, id_col)
    # one struct, whose fields cannot be taken for columns of this module
    own = (F.struct(*more).alias("more"),) if more else ()
    keyed = _keyed(docs, id_col, text_col, own)
    spans = materialise(_spans(keyed, window, GRAM).groupBy("d", "v").agg(F.collect_list(F.struct("a", "b", "rd", "rv", "ra")).alias("x")), "spans")
    slim = keyed.join(spans.hint("merge"), ["d", "v"], "left").select("d", "t", "x", *["more"] * len(own))
    made = [("_id", LongType()), ("n_words", LongType()), ("n_removed", LongType()), ("kept_text", StringType()), ("kept_sha256", StringType())]
    made.append(("factors", ArrayType(StructType([StructField(x, LongType()) for x in _FACTOR]))))
    return slim.mapInArrow(_remove, StructType([StructField(*x) for x in made] + slim.schema.fields[3:]))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """A row per row of ``docs``: the id, n_words, n_removed, kept_text, kept_sha256 and factors."""
    out = _parsed(docs, id_col, text_col, window, ())
    return out.select(F.col("_id").cast(docs.schema[id_col].dataType).alias(id_col), *out.columns[1:])


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """The rows and columns of ``docs``, each text without its repeats."""
    out = _parsed(docs, id_col, text_col, window, tuple(c for c in docs.columns if c != text_col))
    return out.select([F.col("kept_text").alias(c) if c == text_col else F.col("more")[c].alias(c) for c in docs.columns])
