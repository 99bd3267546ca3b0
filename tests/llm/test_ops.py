"""Each operator against a plain brute-force version, on odd input."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from brontide.llm import chat, gif_media, language_id, licenses, minhash_dedup, mixing, packing, registry, simhash, substring_dedup, toxicity
from brontide.llm.common import ranked, spread
from brontide.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
rng = np.random.default_rng(5)


def prose(n, seed=0):
    r = np.random.default_rng(seed)
    return " ".join("w" + str(x) for x in r.integers(0, 4000, n))


PASSAGE, LONG = prose(60, 1), prose(30_000, 2)
NEAR = prose(200, 3).split()
ROWS = [
    (0, None, None, None), (1, "", "en", "a"), (2, " \t\n", "en", "a"), (3, "one", "en", "b"), (4, "a b c d", "de", None), (5, "a b c d", "de", "b"),
    (6, PASSAGE + " " + prose(100, 4), "en", "a"), (7, prose(50, 5) + "\n" + PASSAGE, "fr", "a"), (8, LONG, "en", "a"), (9, LONG, "en", "b"), (10, " ".join(NEAR), "en", "c"),
    (11, " ".join(NEAR[:-3] + ["x", "y"]), "en", "c"), (12, " ".join(NEAR[5:]).upper(), "en", "c"), (13, ("same " * 300).strip(), "es", "a"), (14, "Ünïcödé ßtraße   漢字 \U0001f600 it's", "de", "d"),
    (15, PASSAGE.replace("w", "v"), "en", "a"), (16, PASSAGE + " " + prose(40, 6), "en", None), (17, "Licensed under the MIT License. under the mit license", "en", "a"),
    (18, "Apache License, Version 2.0 and CC BY-NC 4.0", "en", "b"), (19, "!!!", "en", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string, d string, t int, size string, rank long, _local long, h string, c string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", 1, "y", 2, 3, "z", "c") for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def texts():
    return {r[0]: r[1] or "" for r in ROWS}


def removed(rows):
    seen, out = set(), {}
    for i in sorted(rows):
        w = WORD.findall(rows[i])
        gone = set()
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone.update(range(s, s + 20))
            seen.add(k)
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest())
    return out


def test_substring_dedup(docs, empty):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.dedup(docs).collect()}
    assert got == removed(texts())
    assert substring_dedup.dedup(empty).count() == 0


def test_substring_dedup_many(spark):
    base = [prose(25, k) for k in range(12)]
    rows = {i: " ".join(base[j] for j in rng.integers(0, 12, 4)) + " " + prose(7, 100 + i) for i in range(60)}
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.dedup(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    assert got == removed(rows)


def test_factors(spark):
    """Factors are true copies of earlier words, in order, and cover exactly what goes."""
    base = [prose(25, k) for k in range(12)]
    r = np.random.default_rng(3)
    rows = {i: (" ".join(base[j] for j in r.integers(0, 12, 4)) + " " + prose(7, 300 + i)).split() for i in range(40)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string")
    for got in substring_dedup.dedup(df).collect():
        w, at = rows[got["doc_id"]], 0
        for f in got["factors"]:
            other = rows[f["ref_id"]]
            assert f["start"] >= at and f["length"] > 0 and (f["ref_id"], f["ref_start"]) < (got["doc_id"], f["start"])
            assert w[f["start"] : f["start"] + f["length"]] == other[f["ref_start"] : f["ref_start"] + f["length"]]
            at = f["start"] + f["length"]
        assert sum(f["length"] for f in got["factors"]) == got["n_removed"]
    pick = lambda *m: substring_dedup.factored(*(np.array(x, np.int64) for x in zip(*m, strict=True)))
    assert pick((0, 30, 1, 100), (10, 60, 2, 0), (20, 50, 1, 120)) == [(0, 50, 1, 100), (50, 10, 2, 40)]
    assert pick((0, 20, 1, 0), (0, 40, 2, 5), (50, 70, 1, 9)) == [(0, 40, 2, 5), (50, 20, 1, 9)]


def groups(rows):
    sets = {}
    for i, t in rows.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = frozenset(tuple(w[s : s + 5]) for s in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    up = {i: i for i in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in rows:
        for j in rows:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (len(sets[i]), top(i), top(i) == i) for i in rows}


def test_near_groups(docs, empty):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.near_groups(docs).collect()}
    assert got == groups(texts())
    assert minhash_dedup.near_groups(empty).count() == 0


def test_near_groups_chains(spark):
    """Chains of edits, whose ends are unlike, and a null id."""
    rows, w = {}, prose(120, 9).split()
    for i in range(40):
        w = w[3:] + prose(3, 500 + i).split()
        rows[1000 - i] = " ".join(w)
    df = spark.createDataFrame([*rows.items(), (None, " ".join(w))], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.near_groups(df).collect()}
    assert got.pop(None)[1:] == (None, True)
    assert got == groups(rows)


def test_close_misses_no_similar_pair(spark):
    """Many sets around one base, of several sizes and at or near the threshold, most in one component."""
    rng = np.random.default_rng(5)
    sets = {i: {*rng.choice(40, 40 - i % 11, replace=False).tolist(), *(1000 + rng.integers(0, 12, i % 7)).tolist()} for i in range(150)}
    sets |= {200: {1}, 201: {1}, 202: {1, 2, 3, 4}, 203: {1, 2, 3}, 204: set(range(40)), 205: set(range(30))}
    part = {i: 0 if i % 3 else i for i in sets}
    table = spark.createDataFrame([(i, sorted(x)) for i, x in sets.items()], "d long, s array<long>")
    got = {(r["u"], r["v"]) for r in minhash_dedup._close(spark.createDataFrame(list(part.items()), "d long, c long").join(table, "d"), 75).collect()}
    alike = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    want = {(i, j) for i in sets for j in sets if i < j and part[i] != part[j] and alike(sets[i], sets[j])}
    assert {(200, 201), (202, 203), (204, 205)} & want and len(want) > 100 and want <= got
    assert all(part[i] != part[j] and i < j for i, j in got)


def test_exact_links(docs, spark):
    """The way without tables gives the same components."""
    rows = texts()
    links = minhash_dedup.exact_links(docs).collect()
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame([tuple(r) for r in links], "u long, v long"), "u", "v").collect()}
    fold = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x).split()
    least = {i: min(j for j in rows if fold(rows[j]) == fold(rows[i])) if rows[i].strip() else i for i in rows}
    assert {i: found.get(least[i], least[i]) for i in rows} == {i: c for i, (_, c, _) in groups(rows).items()}
    with pytest.raises(TypeError):
        minhash_dedup.near_groups(docs.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_near_groups_around_one_text(spark):
    """Edits of one text, of which some pairs are links and most are just below."""
    base, rows = prose(150, 21).split(), {}
    rng = np.random.default_rng(3)
    for i in range(60):
        w = list(base)
        for at in rng.choice(150, 1 + i % 6, replace=False):
            w[at] = f"x{i}y{at}"
        rows[i] = " ".join(w)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.near_groups(df).collect()}
    assert got == groups(rows)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20, 60)] + [(3, 1), (3, 2), (7, 7)], "u long, v long")
    got = {r["node"]: r["component"] for r in components(links, "u", "v").collect()}
    assert got == {**{i: 20 for i in range(20, 61)}, 1: 1, 2: 1, 3: 1}


def test_packing(docs, empty):
    path = registry.tokenizer_path()
    got = packing.pack_documents(docs, path).collect()
    from tokenizers import Tokenizer

    of = Tokenizer.from_file(path)
    ids = {i: [*of.encode(t, add_special_tokens=False).ids, 1] for i, t in texts().items()}
    assert Counter(r["doc_id"] for r in got) == {i: -(-len(x) // 4096) for i, x in ids.items()}
    bins = defaultdict(list)
    for r in got:
        own = ids[r["doc_id"]][r["start"] : r["start"] + 4096]
        assert r["start"] == 4096 * r["piece"] and r["length"] == len(own) and r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in bins.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) == -(-sum(map(len, ids.values())) // 4096)
    assert packing.pack_documents(empty, path).count() == 0


def test_fullest_is_fullest():
    from itertools import product

    for _ in range(60):
        counts = {int(k): int(n) for k, n in zip(rng.integers(1, 15, 4), rng.integers(1, 4, 4), strict=True)}
        room = int(rng.integers(0, 40))
        best = max(s for c in product(*[range(n + 1) for n in counts.values()]) if (s := sum(a * b for a, b in zip(counts, c, strict=True))) <= room)
        got = packing.fullest(counts, room)
        assert sum(k * n for k, n in got.items()) == best and all(n <= counts[k] for k, n in got.items())


def test_encoder_is_the_tokenizer():
    e = packing.Encoder(registry.tokenizer_path())
    odd = ["it's's we'll !'s ''s 'so 't'd I'm'm you've3'll4 '", "a'", "rock 'n' roll's'", "İx ß ẞ Ĳ", "a\x1cb c\xa0d \x00 e", "<|endoftext|> x", "½² 漢字 ΣΑΣ", "", "  ", "x" * 300, "don’t"]
    assert [np.frombuffer(x, "<u4").tolist() for x in e([t.encode() for t in odd])] == [e.of.encode(t, add_special_tokens=False).ids for t in odd]


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    size = {i: len(WORD.findall(t)) for i, t in texts().items()}
    own = defaultdict(int)
    for i, _, _, s in ROWS:
        own[s] += size[i]
    names = sorted((s for s in own if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, open_, rest = {}, set(names), 1.5 * sum(size.values())
    while True:
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * own[s]}
        if not full:
            break
        for s in full:
            target[s] = 2.0 * own[s]
            rest -= target[s]
        open_ -= full
    target |= {s: weight[s] * level for s in open_}
    source = {r[0]: r[3] for r in ROWS}
    taken = defaultdict(int)
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == own[s] and r["target"] == pytest.approx(target[s]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert {s: taken[s] for s in names} == {s: int(target[s] + 1e-9) for s in names}
    assert len(got) == len(ROWS) and sorted(mixing.mix(docs).collect()) == sorted(got)
    assert mixing.mix(empty).count() == 0


def test_schedule_is_even(spark):
    goals = spark.createDataFrame([(0, "a", 60_000, 90_000.0), (1, "b", 40_000, 30_000.0), (2, "c", 10, 20.0)], "s int, source string, source_size long, target double")
    slots = mixing.schedule(spark, goals, 100).collect()
    assert Counter({s: sum(r["words"] for r in slots if r["s"] == s) for s in (0, 1, 2)}) == {0: 90_000, 1: 30_000, 2: 20}
    early = [r["s"] for r in slots if r["slot"] is not None and r["slot"] < 200]
    assert abs(early.count(0) - 150) <= 4


def test_ranked_is_whole(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("k"), spread(F.col("id")).alias("h"))
    got = sorted((r["k"], r["rank"]) for r in ranked(df, ["k"], "h", ["id"], 16).collect())
    assert got == sorted((k, i) for k in range(3) for i in range(len(range(k, 500, 3))))


def base_scan(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    found = [(i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_licenses(docs, empty, spark):
    for r in licenses.scan(docs).collect():
        wanted = base_scan(texts()[r["doc_id"]])
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == wanted
        assert set(filter(None, wanted[4].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert licenses.scan(empty).count() == 0 and 200 <= len(licenses.rules())
    cases = {
        "SPDX-License-Identifier: BSD-3-Clause": "bsd-3", "This is licensed under the GNU General Public License, version 3.": "gpl-3", "Dual licensed under the GNU Lesser General Public License v2.1": "lgpl-2.1",
        "Released under a Creative Commons Attribution-ShareAlike 4.0 license": "cc-by-sa", "nothing here": "", "as is the of it": "", "available under the terms of the Mozilla Public License 2.0": "mpl-2",
    }
    df = spark.createDataFrame([(i, "lorem ipsum " * 40 + t) for i, t in enumerate(cases)], "doc_id long, text string")
    assert [r["labels"] for r in licenses.scan(df).orderBy("doc_id").collect()] == list(cases.values())


def naive_labels(text):
    """Every rule over the whole text, without any gate, chunk or surroundings."""
    line = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))) + " "
    places = [(m.start(), m.end(), prio, label) for label, prio, _, _, rx, _ in licenses.rules() for m in re.finditer(f"(?<= )(?:{rx})(?= )", line)]
    within = lambda p, q: q[0] <= p[0] and q[1] >= p[1] and (q[2] > p[2] or (q[2] == p[2] and q[1] - q[0] > p[1] - p[0]))
    base = base_scan(text)[4]
    return ",".join(sorted({p[3] for p in places if not any(within(p, q) for q in places)} | set(base.split(",") if base else [])))


def test_license_rules_against_a_plain_engine(spark):
    """A statement of every rule, alone between other words; and a text of many chunks."""
    from re import _parser

    r = np.random.default_rng(8)
    cases = []
    for *_, rx, _ in licenses.rules():
        made = alternatives(_parser.parse(rx.split("{")[0])) if "{" in rx and "{2}" not in rx else alternatives(_parser.parse(rx.replace("[0-9]{2}", "07")))
        cases.append("lorem ipsum " * int(r.integers(0, 60)) + made[int(r.integers(0, len(made)))] + " dolor" * int(r.integers(0, 60)))
    cases.append(" ".join(f"{c} and" for c in cases[::3]))
    cases.append("released only under the gpl 2 " * 400)
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(df).collect()}
    assert [(c[-200:], got[i], naive_labels(c)) for i, c in enumerate(cases) if got[i] != naive_labels(c)] == []


def test_chat(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", "no"), (2, 2, "user", None), (3, 0, "user", "alone"), (4, 0, None, "odd"), (None, 0, "user", "x")]
    df = spark.createDataFrame([(*x, "p") for x in turns], "conv_id long, turn long, role string, text string, p string")
    got = {frozenset((r["chosen_id"], r["rejected_id"])): r for r in chat.format_pairs(df).collect()}
    assert set(got) == {frozenset((1, 2)), frozenset((3, 4))}
    r = got[frozenset((1, 2))]
    assert r["n_prefix"] == 1 and r["prompt"] == "<|user|>\nhi<|end|>\n" and {r["chosen_mask"], r["rejected_mask"]} == {"1", "10"} and {r["chosen_chars"], r["rejected_chars"]} == {3, 2}
    assert got[frozenset((3, 4))]["n_prefix"] == 0 and chat.format_pairs(df.limit(0)).count() == 0


def test_gif(docs, empty):
    for r in gif_media.store(docs, keep_media=True).collect():
        raw = texts()[r["doc_id"]].encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = bytes(r["media"])
        assert (len(media), hashlib.sha256(media).hexdigest()) == (r["media_bytes"], r["media_sha256"])
        assert b"".join(f.area()[..., 0].tobytes() for f in gif_media.decode(media)) == payload
    assert gif_media.store(empty).count() == 0


def test_gif_rules(spark):
    """Hand-made: two colours, local palettes, transparency and each disposal."""
    import struct

    def image(left, pixels, disposal, clear=None, local=None):
        gce = struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (clear is not None), 7, clear or 0, 0)
        bits = "".join(f"{c:03b}"[::-1] for c in [4, *pixels, 5])
        data = int(bits[::-1], 2).to_bytes(-(-len(bits) // 8), "little")
        return gce + struct.pack("<BHHHHB", 0x2C, left, 0, len(pixels), 1, 0x80 if local else 0) + (local or b"") + bytes([2, len(data)]) + data + b"\0"

    palette = bytes([0, 0, 0, 255, 0, 0])
    gif = b"GIF89a" + struct.pack("<HHBBB", 2, 1, 0x80, 0, 0) + palette + image(0, [1, 1], 1) + image(0, [0, 1], 3, clear=1) + image(1, [1], 2, local=bytes([9, 9, 9, 8, 8, 8])) + image(0, [0], 0) + b";"
    shown = [[tuple(x) for x in f.canvas[0].tolist()] for f in gif_media.decode(gif)]
    red, black = (255, 0, 0), (0, 0, 0)
    table = spark.createDataFrame([(1, bytearray(gif)), (2, None), (3, bytearray(gif[:-20])), (4, bytearray(b"x"))], "k int, media binary")
    rows = sorted(gif_media.frames(table, more=("k",)).collect(), key=lambda r: (r["k"], r["frame"] is None, r["frame"]))
    assert [(r["k"], r["frame"], r["delay"], r["disposal"], r["error"] is None) for r in rows if r["k"] != 3] == [(1, 0, 7, 1, True), (1, 1, 7, 3, True), (1, 2, 7, 2, True), (1, 3, 7, 0, True), (4, None, None, None, False)]
    assert bytes(rows[0]["samples"]) == bytes(red * 2) and rows[0]["red"] == [0] * 7 + [2] and rows[0]["green"] == [2] + [0] * 7 == rows[0]["blue"]
    assert any(r["k"] == 3 and r["error"] for r in rows) and any(r["k"] == 3 and r["frame"] == 0 for r in rows)
    assert shown == [[red, red], [black, red], [red, (8, 8, 8)], [black, black]]
    assert [f.delay for f in gif_media.decode(gif)] == [7] * 4
    for bad in (b"", b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"?"):
        with pytest.raises((ValueError, struct.error)):
            list(gif_media.decode(bad))
    for n in (64, 8192, 3 * 8192 + 64):
        noise = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        assert b"".join(f.area()[..., 0].tobytes() for f in gif_media.decode(gif_media.encode(noise))) == noise


def naive_print(spark, texts_):
    """Fingerprints by counting votes in Python; only the term hash is Spark's."""
    terms = {}
    for x in texts_:
        w = re.split(r"[\x20\x09-\x0D]+", x.lower())
        terms[x] = list(zip(w, [*w[1:], None], strict=True))[: max(1, len(w) - 1)] if len(w) > 1 else [(w[0], None)]
        terms[x] = [(p, q if q is not None else "") for p, q in (zip(w, [*w[1:], ""], strict=True))]
    every = sorted({p for x in terms.values() for p in x})
    hashed = {(r["a"], r["b"]): r["h"] for r in spark.createDataFrame(every, "a string, b string").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()}
    out = {}
    for x, pairs in terms.items():
        votes = [sum((hashed[p] >> k) & 1 for p in pairs) for k in range(64)]
        out[x] = f"{sum(1 << k for k in range(64) if 2 * votes[k] > len(pairs)):016x}"
    return out


def check_prints(spark, rows, got):
    """rows: (id or None, text) in order; got: rows of edited_pairs."""
    near = lambda a, b: 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 64
    edits = [t[: len(t) - len(t) // 4] + rows[(k + 1) % len(rows)][1][: len(t) // 4] for k, (_, t) in enumerate(rows)]
    fp = naive_print(spark, {t for _, t in rows} | set(edits))
    every = {fp[t] for _, t in rows}
    want = Counter()
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        close = None if i is None or i % 50 else sum(near(fp[t], o) >= 1 - 3 / 64 for o in every) - 1
        want[i, len(t), hashlib.sha256(edits[k].encode()).hexdigest(), fp[t], fp[edits[k]], near(fp[t], fp[edits[k]]), near(fp[t], fp[nxt]), close] += 1
    assert Counter(map(tuple, got)) == want


def test_simhash(spark, docs, empty):
    check_prints(spark, sorted(texts().items()), simhash.edited_pairs(docs).collect())
    assert simhash.edited_pairs(empty).count() == 0


def test_simhash_odd_rows(spark):
    """Null and repeated ids: each row has its own place, by the text's hash within an id, null last."""
    docs = odd_rows(spark)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("x", F.xxhash64("text")).collect()
    rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["x"]))
    check_prints(spark, [(r["doc_id"], r["text"]) for r in rows], simhash.edited_pairs(docs).collect())


def test_within_radius(spark):
    base = [int(x) for x in rng.integers(-(2**62), 2**62, 30)]
    prints = base + [b ^ sum(1 << int(k) for k in rng.choice(63, 3, replace=False)) for b in base] + [b ^ 0b11111 for b in base]
    df = spark.createDataFrame([(x,) for x in prints], "fp long")
    got = {(r["q"], r["fp"]) for r in simhash.within(df, df.limit(1000), 3).collect()}
    assert got == {(a, b) for a in prints for b in prints if bin((a ^ b) & (2**64 - 1)).count("1") <= 3}


def naive_phrases(text, known):
    count = i = 0
    while i < len(text):
        n = 1
        while i + n < len(text) and text[i : i + n + 1] in known:
            n += 1
        count, i = count + 1, i + n
    return count


def test_cross_parsing(monkeypatch):
    """One greedy parse of the whole text, however it is cut for speed; letters of all scripts keep apart."""
    samples = ["abracadabra banana bandana", "the cat sat on the mat", "漢字かな漢字"]
    p = language_id.Parser(dict(zip("xyz", samples, strict=True)))
    r = np.random.default_rng(4)
    cases = ["banana cadabra", "the mat sat", "zzz", "a", "漢か 字字", ""] + ["".join(r.choice(list("abrcdnthes "), n)) for n in (40, 100, 333)]
    for piece, grid in ((1024, 1 << 20), (7, 1 << 20), (3, 50)):
        monkeypatch.setattr(language_id, "PIECE", piece)
        monkeypatch.setattr(language_id, "GRID", grid)
        got, size = p.phrases(cases)
        for k, t in enumerate(cases):
            shown = lambda s: p.symbol[language_id.encoded(s)].tobytes()
            assert got[:, k].tolist() == [naive_phrases(shown(t), shown(s)) for s in samples] and size[k] == len(language_id.encoded(t))


def test_language_held_out(spark, sf):
    got = registry.op1_language_id(spark, f"{sf}/../sf0.01").join(spark.read.parquet(f"{sf}/../sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.97 and got["score"].between(0, 1).all()


def test_language_odd(docs, empty):
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, {"en": "the cat", "de": "das haus"}).collect()}
    assert [got[i] for i in (0, 1, 2, 19)] == ["und"] * 4 and got[3] in ("en", "de")
    assert language_id.identify(empty, {}).count() == 0 and language_id.sample(empty, "doc_id", "text", "lang") == {}


def test_toxicity_held_out(spark, sf):
    d = f"{sf}/../sf0.1"
    got = registry.op3_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out and toxic is not null").toPandas()
    hit = got["predicted"] == 1
    assert (got["toxic"] == 1)[hit].mean() > 0.9 and hit[got["toxic"] == 1].mean() > 0.85


def test_toxicity_odd(docs, empty):
    assert toxicity.fit([]) == {} and toxicity.fit([("a", 1)]) == {}
    assert {r["score"] for r in toxicity.score(docs, {}).collect()} == {0.0}
    w = toxicity.fit([(f"{prose(30, k)} nasty", 1) for k in range(40)] + [(prose(30, 900 + k), 0) for k in range(60)])
    of = toxicity.Scorer(w)
    assert of(prose(30, 77) + " nasty") > 0.7 > of(prose(30, 78)) and of(None) == of("") < 0.7
    assert toxicity.score(empty, w).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = before = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == before.columns and out.count() > 0
        docs = spark.createDataFrame(out.toPandas(), out.schema)
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 4096


def brute_mix(spark, rows):
    """(id, text) as often as the mix takes them, of rows (id, text, source): targets by filling up, then whole passes of each tape and a prefix."""
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text))
    names = sorted(x for x in sizes if x is not None) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    free, target, left = set(names), {}, 1.5 * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if 2 * sizes[s] <= weight[s] * level]
        for s in full or free:
            target[s] = 2.0 * sizes[s] if full else weight[s] * level
        left -= sum(target[s] for s in full)
        free = free - set(full) if full else set()
    ids = spark.createDataFrame([(r[0],) for r in rows], "d long").distinct()
    at = {r["d"]: r["h"] for r in ids.select("d", spread(F.col("d")).alias("h")).collect()}
    out = Counter()
    for s in names:
        tape, goal = sorted((r for r in rows if r[2] == s), key=lambda r: (at[r[0]], r[0])), int(target[s])
        while goal > 0:
            for i, text, _ in tape:
                w = WORD.findall(text)
                if n := min(goal, len(w)):
                    out[i, text if n == len(w) else " ".join(w[:n])] += 1
                    goal -= n
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage by hand, each on what the one before leaves; only the classifier's weights are the operator's own."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    texts_, r = {}, np.random.default_rng(12)
    for i in range(60):
        words = prose(int(r.integers(30, 120)), 700 + i).split()
        texts_[i] = " ".join(words + (PASSAGE.split() if i % 6 == 0 else []))
        if i % 5 == 0:
            texts_[100 + i] = " ".join([*words[:-1], "changed"])
    for i in range(40):
        texts_[200 + i] = prose(40, 900 + i) + (" you nasty loser nasty" if i % 2 else "")
    docs = [(i, t, "en", "abc"[i % 3] if i % 7 else None, len(t)) for i, t in texts_.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(200 + i, 1, i % 2) for i in range(40)] + [(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    table, labels = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    of = toxicity.Scorer(toxicity.fit(toxicity.training_rows(table, labels, registry.fold("doc_id", 3) != 1)))
    kept = {i: t for i, t in texts_.items() if of(t) < 0.7}
    assert 0 < len(texts_) - len(kept) <= 20 and all("nasty" in texts_[i] for i in texts_.keys() - kept.keys())
    kept = {i: kept[i] for i, (_, _, first) in groups(kept).items() if first}
    seen, cut = set(), {}
    for i in sorted(kept):
        w, gone = WORD.findall(kept[i]), set()
        for s in range(len(w) - 19):
            if (k := tuple(w[s : s + 20])) in seen:
                gone.update(range(s, s + 20))
            seen.add(k)
        cut[i] = " ".join(x for j, x in enumerate(w) if j not in gone)
    source = {d[0]: d[3] for d in docs}
    encode = Tokenizer.from_file(registry.tokenizer_path()).encode
    want = Counter()
    for (i, text), n in brute_mix(spark, [(i, t, source[i]) for i, t in cut.items()]).items():
        ids = [*encode(text, add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            own = np.array(ids[start : start + 4096], "<u4")
            want[i, piece, start, len(own), zlib.crc32(own.tobytes())] += n
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for x in got:
        bins[x["sequence_id"]].append((x["offset"], x["length"]))
    for x in bins.values():
        assert [o for o, _ in sorted(x)] == np.cumsum([0, *(n for _, n in sorted(x))])[:-1].tolist() and sum(n for _, n in x) <= 4096


def test_missing_subpackage():
    """The entry works without the subpackage."""
    import os
    import subprocess
    import sys

    code = "import sys; sys.modules['brontide.llm'] = None; import __spark_entry__ as e; assert not any(k.startswith('op1_') for k in e.queries())"
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0


def odd_rows(spark):
    """Null and repeated ids, with equal and with other texts."""
    rows = [
        (5, PASSAGE + " " + prose(30, 20), "en", "a"), (5, prose(70, 21), "de", "b"), (7, prose(40, 22) + " " + PASSAGE, "fr", "a"), (7, prose(40, 22) + " " + PASSAGE, "fr", "a"),
        (None, PASSAGE + " " + prose(10, 23), "en", "b"), (None, prose(80, 24), None, None), (None, prose(80, 24), None, None), (8, None, "en", "a"), (8, "", None, "a"), (9, prose(1200, 25), "es", "b"),
        (9, PASSAGE, "es", "b"), (2, PASSAGE.replace("w", "v") + " x", "en", "c"), (2, "y " + PASSAGE.replace("w", "v"), "en", "c"), (2, "y " + PASSAGE.replace("w", "v"), "en", "c"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_pipeline_cuts_each_row(spark):
    """One row for each, cut like brute force: rows of one id and text are one document, null ids lose nothing."""
    import corpus_pipeline

    docs = odd_rows(spark)
    hashed = [(r["doc_id"], r["v"], r["text"] or "", r["lang"], r["source"]) for r in docs.withColumn("v", F.xxhash64("text")).collect()]
    seen, gone = set(), defaultdict(set)
    for i, v, t in sorted({x[:3] for x in hashed if x[0] is not None}):
        w = WORD.findall(t)
        for s in range(len(w) - 19):
            if (k := tuple(w[s : s + 20])) in seen:
                gone[i, t].update(range(s, s + 20))
            seen.add(k)
    left = [(i, " ".join(x for j, x in enumerate(WORD.findall(t)) if j not in gone[i, t]), lang, source) for i, _, t, lang, source in hashed]
    got = corpus_pipeline.cut_repeats(spark, docs, "")
    assert got.columns == docs.columns and any(gone.values())
    assert Counter(map(tuple, got.collect())) == Counter((*x, len(x[1])) for x in left)


def test_pipeline_stages_keep_odd_columns(spark):
    """Columns named like those the stages make come back unchanged, as do null ids; an empty table gives no rows."""
    import corpus_pipeline

    names = ("score", "row", "own", "size", "taken", "words", "cut", "kept_text", "factors", "more", "d", "t", "x", "h", "component_id", "kept", "z")
    docs = odd_rows(spark).withColumns({n: F.lit(f"<{n}>") for n in names})
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(10)], "doc_id long, quality int, toxic int")
    import tempfile

    folder = tempfile.mkdtemp()
    labels.write.parquet(f"{folder}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all(r[n] == f"<{n}>" for r in got for n in names), name
        assert name == "mixing" or sum(r["doc_id"] is None for r in got) == 3, name
        assert stage(spark, docs.limit(0), folder).count() == 0, name
    assert corpus_pipeline.pack(spark, docs, folder).count() >= docs.count()


def test_pipeline_mixes_each_row(spark):
    """Null and repeated ids are taken for what their own place on the tape gives: whole passes of all, then a prefix."""
    import corpus_pipeline

    docs = odd_rows(spark)
    taken = [(r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in mixing.mix(docs).collect()]
    assert Counter(x[:2] for x in taken) == Counter((r["doc_id"], len(WORD.findall(r["text"] or ""))) for r in docs.collect())
    assert all(0 <= x[4] <= 2 * x[1] for x in taken)
    hashed = docs.select("doc_id", "text", "lang", "source", spread(F.col("doc_id")).alias("h"), F.xxhash64("text").alias("x")).collect()
    wanted = Counter()
    goals = {x[2]: int(x[3]) for x in taken}
    assert len(goals) == 4
    for source in ("a", "b", "c", None):
        tape = sorted((r for r in hashed if r["source"] == source), key=lambda r: (r["h"], r["doc_id"] is not None, r["doc_id"] or 0, r["x"]))
        total = sum(len(WORD.findall(r["text"] or "")) for r in tape)
        left = goals[total]
        while left > 0:
            for r in tape:
                w = WORD.findall(r["text"] or "")
                if n := min(left, len(w)):
                    text = r["text"] if n == len(w) else " ".join(w[:n])
                    wanted[r["doc_id"], text, r["lang"], source, len(text)] += 1
                    left -= n
    got = corpus_pipeline.mix_sources(spark, docs, "")
    assert got.columns == docs.columns and Counter(map(tuple, got.collect())) == wanted


def alternatives(parsed):
    """A text for each choice of alternatives of a parsed regex; a range or word class gives one character."""
    out = [""]
    for op, arg in parsed:
        kind = str(op)
        if kind == "LITERAL":
            own = [chr(arg)]
        elif kind == "IN":
            own = [chr(a if str(o) == "LITERAL" else a[0]) if str(o) != "CATEGORY" else "s" for o, a in arg]
        elif kind == "SUBPATTERN":
            own = alternatives(arg[3])
        elif kind == "BRANCH":
            own = [x for branch in arg[1] for x in alternatives(branch)]
        elif kind == "MAX_REPEAT":
            least, _, part = arg
            own = [x * least for x in alternatives(part)] if least else ["", *alternatives(part)]
        else:
            assert kind == "ASSERT_NOT"
            own = [""]
        out = [a + b for a in out for b in own]
    return out


def test_license_gates_pass_every_alternative(spark):
    from re import _parser

    for _, keys, name in licenses.FAMILIES:
        assert [t for t in alternatives(_parser.parse(name)) if not any(k in t for k in keys.split("|"))] == []
    whole = [(word, form.replace("{}", "@")) for form, _, _, word in licenses.STATEMENTS] + [(key, rx) for _, key, rx, _, _ in licenses.GENERAL]
    for word, rx in whole:
        assert [t for t in alternatives(_parser.parse(rx)) if word not in t or not re.search(licenses.PREFILTER, t)] == []
    cases = {
        "this program is released only under the GNU GPL version 2.0": "gpl-2", "available to you under GPL v2": "gpl-2", "shared to you only under the terms of CC Attribution 4.0": "cc-by",
        "licensed under a Creative Commons Attribution Non-Commercial 4.0 license": "cc-by-nc", "confidential and confidential": "proprietary",
    }
    df = spark.createDataFrame([(i, "lorem ipsum " * 40 + t) for i, t in enumerate(cases)], "doc_id long, text string")
    assert [r["labels"] for r in licenses.scan(df).orderBy("doc_id").collect()] == list(cases.values())
