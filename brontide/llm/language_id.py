"""Language ID by cross-parsing entropy over suffix automata.

One suffix automaton per language is built from a bounded sample of labelled
text.  A text is cut greedily into the longest phrases that occur in a
language's sample; phrases times ``log2`` of the sample's length is the number
of bits that the language needs, and the language needing fewest wins.

Case is folded and every run of non-letters is one space; the symbols are the UTF-8
bytes of what is left, so letters of all scripts keep apart, and a byte that no sample
has is a phrase of its own.  Every text is parsed from its first symbol to its last in
one greedy parse.  For speed, pieces of ``PIECE`` symbols are parsed side by side (numpy)
as if a phrase began with each; then each is parsed again from the state in which the
piece before really ended, until both parses are in one state, from where they agree.

Sample (documented bound): per language whole texts in the order of a hash of their
id, until they have ``SAMPLE`` symbols or are ``DOCS`` rows, however many languages
there are.  A language's automaton takes at most ``2 * symbols`` states of four bytes
for each distinct byte.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
equal counts go to the first language in code-point order; without any labelled
row everything is ``und``; extra columns are ignored; repeated rows are scored
once each.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import arrow_batches

DOCS, SAMPLE, PIECE = 96, 40_000, 1024
#: Symbols that are parsed side by side.
GRID = 1 << 20


@cache
def _folded() -> np.ndarray:
    """Code point -> lower-cased letter, or 32."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        if (c := chr(i)).isalpha():
            out[i] = ord(c.lower()[:1])
    return out


def encoded(text: str) -> np.ndarray:
    """The bytes of a text's lower-cased letters, each run of anything else as one blank."""
    codes = _folded()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    gap = codes == 32
    kept = codes[~(gap & np.concatenate([[True], gap[:-1]]))]
    return np.frombuffer(kept.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)


def automaton(codes: list[int], width: int) -> np.ndarray:
    """Transitions [state, symbol] -> width * next state, plus 1 where the symbol begins a new phrase; ``width`` is even."""
    link, length, nexts, last = [-1], [0], [{}], 0
    for c in codes:
        cur = len(link)
        link.append(0)
        length.append(length[last] + 1)
        nexts.append({})
        p = last
        while p != -1 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p != -1:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                nexts.append(dict(nexts[q]))
                while p != -1 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    root = np.zeros(width, np.int64)
    for c, to in nexts[0].items():
        root[c] = to * width
    table = np.tile((root + 1).astype(np.int32), (len(link), 1))
    at = np.array([(s, c, to) for s, own in enumerate(nexts) for c, to in own.items()], np.int64).reshape(-1, 3)
    table[at[:, 0], at[:, 1]] = at[:, 2] * width
    table[0] = root + 1  # whatever leaves the root begins a phrase; an unknown symbol is one of its own
    return table


class Parser:
    def __init__(self, samples: dict[str, str]) -> None:
        self.names = sorted(samples)
        learned = {name: encoded(samples[name]) for name in self.names}
        seen = sorted({int(b) for x in learned.values() for b in np.unique(x)})
        # one symbol more for bytes that no sample has, and one to make the width even
        width = (len(seen) + 2) // 2 * 2
        self.symbol = np.full(256, len(seen), np.uint8)
        self.symbol[seen] = np.arange(len(seen))
        tables, self.base, self.bits, at = [], [], [], 0
        for name in self.names:
            codes = self.symbol[learned[name]]
            tables.append(automaton(codes.tolist(), width) + np.int32(at * width))
            self.base.append(at * width)
            self.bits.append(math.log2(len(codes) + 2))
            at += len(tables[-1])
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases [language, text], symbols) of each text."""
        codes = [self.symbol[encoded(x)] for x in texts]
        size = np.array([len(x) for x in codes], np.int64)
        state = np.repeat(np.array(self.base, np.int32)[:, None], len(texts), 1)
        total = np.zeros((len(self.names), len(texts)), np.int64)
        held: list[tuple[int, np.ndarray]] = []
        for i, x in enumerate(codes):
            for at in range(0, len(x), GRID):  # a longer text goes on where it stopped
                held.append((i, x[at : at + GRID]))
                if len(x) > at + GRID or sum(len(y) for _, y in held) >= GRID:
                    self._parse(held, state, total)
                    held = []
        if held:
            self._parse(held, state, total)
        return total, size

    def _parse(self, parts: list[tuple[int, np.ndarray]], state: np.ndarray, total: np.ndarray) -> None:
        """Adds the phrases of (text, symbols) to ``total``, from the texts' states, which are moved on."""
        own = np.concatenate([np.full(-(-len(x) // PIECE), i) for i, x in parts])
        flat = [x[k : k + PIECE] for _, x in parts for k in range(0, len(x), PIECE)]
        begins = np.concatenate([[True], own[1:] != own[:-1]])
        size = np.array([len(x) for x in flat])
        order = np.argsort(-size, kind="stable")
        place = np.argsort(order)
        grid = np.zeros((size.max(), len(flat)), np.uint8)
        for k, j in enumerate(order):
            grid[: size[j], k] = flat[j]
        entry = np.where(begins, state[:, own], np.array(self.base, np.int32)[:, None])
        now = entry[:, order]
        steps = np.zeros((len(grid), *now.shape), np.int32)
        for at, (row, k) in enumerate(zip(grid, np.searchsorted(-size[order], -np.arange(len(grid)), side="left"), strict=True)):
            steps[at, :, :k] = self.table[now[:, :k] + row[:k]]
            now[:, :k] = steps[at, :, :k] & ~1
        upto = np.cumsum(steps & 1, axis=0, dtype=np.int32)
        guessed, count = now[:, place], upto[size - 1, :, place].T.copy()
        whole, end, used = count.copy(), guessed.copy(), entry
        while True:  # pieces whose predecessor ended in another state than they were parsed from
            lang, piece = np.nonzero((used != np.roll(end, 1, axis=1)) & ~begins)
            if not len(lang):
                break
            now = used[lang, piece] = end[lang, piece - 1]
            made = np.zeros(len(lang), np.int64)
            for at in range(len(grid)):
                k = place[piece]
                step = self.table[now + grid[at, k]]
                made += step & 1
                now = step & ~1
                same = now == steps[at, lang, k] & ~1
                last = ~same & (size[piece] == at + 1)
                x, y = lang[same], piece[same]
                count[x, y] = made[same] + whole[x, y] - upto[at, x, place[y]]
                end[x, y] = guessed[x, y]
                count[lang[last], piece[last]], end[lang[last], piece[last]] = made[last], now[last]
                left = ~same & ~last
                lang, piece, now, made = lang[left], piece[left], now[left], made[left]
                if not len(lang):
                    break
        for k in range(len(self.names)):
            total[k] += np.bincount(own, count[k], total.shape[1]).astype(np.int64)
        closes = np.concatenate([begins[1:], [True]])
        state[:, own[closes]] = end[:, closes]

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.names:
            return ["und"] * len(texts), [0.0] * len(texts)
        count, size = self.phrases([x or "" for x in texts])
        bits = count * np.array(self.bits)[:, None]
        best = bits.argmin(axis=0)
        # a probability from at most 64 symbols' worth of bits: more would always round to 1
        gap = (bits - bits.min(axis=0)) * np.minimum(1, 64 / np.maximum(size, 1))
        score = 1 / np.exp2(-gap).sum(axis=0)
        named = size > 0  # what has no letter has no symbol
        return [self.names[k] if ok else "und" for k, ok in zip(best, named, strict=True)], np.where(named, score, 0.0).tolist()


_parsers: dict[int, Parser] = {}


def sample(labelled: DataFrame, id_col: str, text_col: str, lang_col: str) -> dict[str, str]:
    """Language -> sample text, from rows that may be learned from."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not counts:
        return {}
    hashed = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 40))
    limit = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, 2 * DOCS / n) * (1 << 40)))])
    picked = rows.select(F.col(lang_col).alias("l"), hashed.alias("h"), F.col(text_col).alias("t")).where(F.col("h") <= limit[F.col("l")])
    # at most DOCS rows a language reach the driver, though one id may have many rows
    place = F.row_number().over(Window.partitionBy("l").orderBy("h", F.xxhash64("t")))
    out: dict[str, list[str]] = {}
    held: Counter = Counter()
    for r in sorted(picked.withColumn("k", place).where(F.col("k") <= DOCS).collect(), key=lambda r: (r["l"], r["k"])):
        if held[r["l"]] < SAMPLE:
            out.setdefault(r["l"], []).append(r["t"])
            held[r["l"]] += len(encoded(r["t"]))
    return {k: " ".join(x) for k, x in out.items()}


def identify(docs: DataFrame, samples: dict[str, str], id_col: str = "doc_id", text_col: str = "text", more: tuple[Column, ...] = ()) -> DataFrame:
    """(id, more ..., lang_pred, score) for every row; only the text decides."""
    arrow_batches(docs.sparkSession)
    key = hash(tuple(sorted(samples.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _parsers:
            _parsers.clear()
            _parsers[key] = Parser(samples)
        parser = _parsers[key]
        for batch in batches:
            names, scores = parser(batch.column(1).to_pylist())
            yield pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["own", "lang_pred", "score"])

    # one struct, whose fields cannot be taken for columns of this module
    slim = docs.select(F.struct(F.col(id_col), *more).alias("own"), F.col(text_col).alias("text"))
    made = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    return slim.mapInArrow(run, StructType([slim.schema["own"], *made])).select("own.*", *[f.name for f in made])
