"""Best-fit packing of tokenised documents by minimum bin slack.

Texts become token ids (a public tokenizer), closed by id 1; documents longer
than a sequence are cut into full pieces and a rest.  What decides a packing is
only how many pieces there are of each length, so the table is reduced to that
histogram (at most ``capacity`` numbers).  On it the driver fills bin after bin:
the longest piece left, then a bitset subset-sum dynamic program over the lengths
still available finds the fullest feasible combination, which is removed -- as
often as the counts allow, so a combination costs the same for one bin as for a
billion.  Ranks of the pieces within their length (two-level, a hot length is
spread) then look up their bin and offset.

Defined cases: null counts as empty (one piece, the closing id); equal lengths
are ranked by a hash of id and piece, then id and piece; repeated rows are packed
once each, as are rows with null ids; ids are integers (any other type raises
TypeError); extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, integer_ids, materialise, ranked

CAPACITY, END_ID = 4096, 1
#: Words whose ids a Python worker remembers (about 200 bytes each).
CACHE = 200_000
#: Words of these characters need no normalisation but lower case; all others take the tokenizer's own path.
_PLAIN = re.compile(r"[!-~\u00a1-\u024f]+")
_PLAIN_TEXT = re.compile(r"[\t-\r -~\u00a1-\u024f]*")
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


def _kinds() -> np.ndarray:
    """White space, letter, number or other, for the code points of plain texts."""
    out = np.full(0x370, _OTHER, np.uint8)
    for i in range(0x370):  # lower-casing can give combining marks
        kind = unicodedata.category(chr(i))[0]
        out[i] = _LETTER if kind == "L" else _NUMBER if kind == "N" else _OTHER
    out[[9, 10, 11, 12, 13, 32]] = _SPACE
    return out


_KIND = _kinds()


def pieces_of(text: str) -> tuple[str, np.ndarray]:
    """The pieces of lower-cased plain text, each closed by a zero, and where each begins in ``text``.

    A piece is a run of letters, one number, a run of anything else, or an
    apostrophe with s, t, m, d, re, ve or ll where no such run is under way.
    """
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    n = len(points)
    kind = _KIND[points]
    before = np.concatenate([[_SPACE], kind[:-1]])
    begins = (kind != _SPACE) & ((kind != before) | (kind == _NUMBER))
    for i in np.flatnonzero((points == 39) & (before != _OTHER)).tolist():
        tail = text[i + 1 : i + 3]
        size = 3 if tail in ("re", "ve", "ll") else 2 if tail[:1] in ("s", "t", "m", "d") and tail else 0
        if size:
            begins[i + 1 : i + size] = False
            if i + size < n and kind[i + size] != _SPACE:
                begins[i + size] = True
    start = np.flatnonzero(begins)
    shown = np.flatnonzero(kind != _SPACE)
    # a zero goes before each piece but the first, and one to the end
    place = np.arange(len(shown)) + np.cumsum(begins[shown]) - 1
    out = np.zeros(len(shown) + len(start), "<u4")
    out[place] = points[shown]
    return out.tobytes().decode("utf-32-le"), start


def _byte_of() -> dict[str, int]:
    """The byte that each printable stand-in of a byte-level vocabulary means."""
    # The bytes that byte-level vocabularies show as themselves.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """ids of a text as little-endian unsigned 32-bit bytes, word by word.

    The pieces of plain texts (see ``_PLAIN_TEXT``) are merged in one call for a
    whole batch: every piece is closed by a zero byte that stands for the
    vocabulary's end-of-word mark, and the byte-pair ranks come from the
    tokenizer's file.  White space always separates words for this tokenizer, so
    other texts are encoded word by word; their words are remembered.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.of = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = _byte_of()
        raw = lambda x: bytes(byte[c] for c in x.removesuffix("</w>")) + b"\0" * x.endswith("</w>")
        merges = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        ends = [x for x in model["vocab"] if x.endswith("</w>") and len(x) == 5]
        order = dict.fromkeys([*map(raw, ends), *(raw(a + b) for a, b in merges)])
        ranks = {x: i for i, x in enumerate(order)}
        for i in range(256):
            ranks.setdefault(bytes([i]), len(ranks))
        self.fast = tiktoken.Encoding("pieces", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.id = np.zeros(len(ranks), np.uint32)
        self.last = np.zeros(len(ranks), bool)
        for x, i in model["vocab"].items():
            if (x != "</w>") and not x.startswith("<|") and (k := ranks.get(raw(x))) is not None:
                self.id[k], self.last[k] = i, x.endswith("</w>")
        self.known: dict[bytes, bytes] = {}

    def learn(self, words: list[bytes]) -> None:
        """Encodes and remembers words."""
        plain = []
        for word in words:
            text = word.decode()
            if _PLAIN.fullmatch(text) and "<|" not in text:
                plain.append(text)
            else:
                self.known[word] = np.array(self.of.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self.known.update(zip((x.encode() for x in plain), self.merged(plain), strict=True))

    def merged(self, texts: list[str]) -> list[bytes]:
        """The ids of plain texts, in one call."""
        low = [x.lower() for x in texts]
        pieces, start = pieces_of(" ".join(low))
        if not pieces:
            return [b""] * len(texts)
        edges = np.cumsum([0, *(len(x) + 1 for x in low)])
        got = self.fast.encode_to_numpy(pieces, disallowed_special=())
        ids = self.id[got].astype("<u4").tobytes()
        closed = np.concatenate([[0], np.flatnonzero(self.last[got]) + 1]) * 4
        bounds = closed[np.searchsorted(start, edges)].tolist()
        return [ids[i:j] for i, j in zip(bounds, bounds[1:], strict=False)]

    def __call__(self, texts: list[bytes | None]) -> list[bytes]:
        shown = [(x or b"").decode() for x in texts]
        plain = [i for i, x in enumerate(shown) if _PLAIN_TEXT.fullmatch(x) and "<|" not in x]
        out: list[bytes] = [b""] * len(texts)
        for i, ids in zip(plain, self.merged([shown[i] for i in plain]), strict=True):
            out[i] = ids
        rest = sorted(set(range(len(texts))) - set(plain))
        split = {i: texts[i].split() for i in rest}
        if len(self.known) > CACHE:
            self.known = {}
        if new := [x for x in set().union(*split.values()) if x not in self.known]:
            self.learn(new)
        for i in rest:
            out[i] = b"".join(map(self.known.__getitem__, split[i]))
        return out


_encoders: dict[str, Encoder] = {}


def _pieces(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        encode = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        for batch in batches:
            ids, rows, out = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), []
            for i in range(0, len(rows), 64):
                for d, got in zip(ids[i : i + 64], encode(rows[i : i + 64]), strict=True):
                    got += end
                    n = len(got) // 4
                    for piece, start in enumerate(range(0, n, capacity)):
                        own = got[4 * start : 4 * (start + capacity)]
                        out.append((d, piece, start, len(own) // 4, zlib.crc32(own)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(x, t) for x, t in zip(cols, types, strict=True)], ["d", "piece", "start", "length", "ids_crc32"])

    return run


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum up to ``room``.

    One bitset holds the sums reached so far; its states are kept per length to
    read the combination back.
    """
    mask, reached, states = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        states.append((length, reached))
        left, step = min(counts[length], room // length), 1
        while left > 0:  # doubling steps: 1, 2, 4, ... copies and the rest
            take = min(step, left)
            reached |= (reached << (length * take)) & mask
            left, step = left - take, step * 2
        if reached >> room & 1:
            break
    total = reached.bit_length() - 1
    out: dict[int, int] = {}
    for length, before in reversed(states):
        used = 0
        while not before >> total & 1:
            total, used = total - length, used + 1
        if used:
            out[length] = used
    return out


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(number of bins, length -> copies in each) until no piece is left."""
    left, out = {k: v for k, v in counts.items() if v > 0}, []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        if not rest[longest]:
            del rest[longest]
        own = fullest(rest, capacity - longest)
        own[longest] = own.get(longest, 0) + 1
        times = min(left[k] // n for k, n in own.items())
        out.append((times, own))
        for k, n in own.items():
            left[k] -= times * n
            if not left[k]:
                del left[k]
    return out


def _places(counts: dict[int, int], capacity: int) -> tuple[dict[int, int], tuple[np.ndarray, ...]]:
    """Where each length begins in one numbering of all pieces, and the runs of that numbering with their bins."""
    base, at = {}, 0
    for length in sorted(counts):
        base[length], at = at, at + counts[length]
    used, runs, bins = dict.fromkeys(counts, 0), [], 0
    for times, own in plan(counts, capacity):
        offset = 0
        for length, n in sorted(own.items(), reverse=True):
            runs.append((base[length] + used[length], n, bins, offset, length))
            used[length] += n * times
            offset += n * length
        bins += times
    runs.sort()
    return base, tuple(np.array(x, np.int64) for x in (zip(*runs, strict=True) if runs else [()] * 5))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a materialised table of pieces (d, piece, start, length, ...)."""
    spark = pieces.sparkSession
    arrow_batches(spark)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    base, runs = _places(counts, capacity)
    ids = pieces.withColumn("_h", F.xxhash64("d", "piece", "start").bitwiseAND(F.lit((1 << 63) - 1)))
    numbered = ranked(ids, ["length"], "_h", ["d", "piece", "start"], name="_r").drop("_h")
    names = numbered.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, copies, first, offset, length = runs
        for batch in batches:
            if not batch.num_rows:
                continue
            size = np.asarray(batch.column(names.index("length")))
            lengths, where = np.unique(size, return_inverse=True)
            at = np.asarray(batch.column(names.index("_r"))) + np.array([base[int(x)] for x in lengths], np.int64)[where]
            i = np.searchsorted(lo, at, side="right") - 1
            into, slot = np.divmod(at - lo[i], copies[i])
            cols = [batch.column(k) for k in range(len(names)) if names[k] != "_r"]
            yield pa.record_batch([*cols, pa.array(first[i] + into), pa.array(offset[i] + slot * length[i])], [*(x for x in names if x != "_r"), "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema if f.name != "_r")
    return numbered.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): a row per piece."""
    arrow_batches(docs.sparkSession)
    integer_ids(docs, id_col)
    id_type = docs.schema[id_col].dataType
    slim = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t"))
    pieces = materialise(slim.mapInArrow(_pieces(tokenizer, capacity, end_id), "d long, piece int, start long, length long, ids_crc32 long"), "pieces")
    return pack(pieces, capacity).withColumn("d", F.col("d").cast(id_type)).withColumnRenamed("d", id_col)
