"""License scans by ordered signature rules (DataFrame operations only).

A keyword prefilter finds the few texts that can hold a license statement; only
there rules are tried, each again gated by its own keyword.  A rule is a regex
over the text's words joined by single blanks, with a label and a priority.  All
places of all rules that match are collected; a place that lies within a place
of higher priority, or within a longer one of the same priority, is suppressed.
What survives gives the labels; the score is the confidence of the strongest
surviving rule (``score`` 0 without one).

Base phrases are counted apart, word by word, and never suppressed.

Defined cases: null counts as empty; texts without words give 0 and null;
overlapping places that do not contain each other both stay; equal places of
equal priority both stay; a rule's places in one chunk of a long stretch do not overlap
one another; repeated rows are scanned once each; extra columns are
ignored.
"""

from __future__ import annotations

import json
from functools import cache, reduce
from operator import or_
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The phrases whose places are counted, with their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Label, keywords (any of them) and a regex for the names of each license family.
FAMILIES = [
    ("mit", "mit", r"(?:the )?mit(?: x11| expat)?"),
    ("apache-2", "apache", r"(?:the )?apache(?: software)?(?: license)?(?: version)? v?2(?: 0)?"),
    ("apache-1.1", "apache", r"(?:the )?apache(?: software)?(?: license)?(?: version)? 1 1"),
    ("apache-1", "apache", r"(?:the )?apache(?: software)?(?: license)?(?: version)? 1(?: 0)?(?! 1)"),
    ("bsd-2", "bsd", r"(?:the )?(?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd)"),
    ("bsd-3", "bsd", r"(?:the )?(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd)"),
    ("bsd-4", "bsd", r"(?:the )?(?:original bsd|bsd 4 clause|4 clause bsd)"),
    ("bsd", "bsd", r"(?:the |a )?bsd(?: style)?"),
    ("0bsd", "bsd", r"(?:the )?(?:0bsd|zero clause bsd|bsd zero clause)"),
    ("gpl-1", "gpl|general public", r"(?:the )?(?:gnu )?(?:general public license|gpl)(?: version)? ?v?1(?: 0)?"),
    ("gpl-2", "gpl|general public", r"(?:the )?(?:gnu )?(?:general public license|gpl)(?: version)? ?v?2(?: 0)?"),
    ("gpl-3", "gpl|general public", r"(?:the )?(?:gnu )?(?:general public license|gpl)(?: version)? ?v?3(?: 0)?"),
    ("gpl", "gpl|general public", r"(?:the )?(?:gnu general public license|gnu gpl|gpl)"),
    ("lgpl-2", "lgpl|library general", r"(?:the )?(?:gnu )?(?:library general public license|lgpl)(?: version)? ?v?2(?: 0)?(?! 1)"),
    ("lgpl-2.1", "lgpl|lesser general", r"(?:the )?(?:gnu )?(?:lesser general public license|lgpl)(?: version)? ?v?2 1"),
    ("lgpl-3", "lgpl|lesser general", r"(?:the )?(?:gnu )?(?:lesser general public license|lgpl)(?: version)? ?v?3(?: 0)?"),
    ("lgpl", "lgpl|lesser general", r"(?:the )?(?:gnu lesser general public license|gnu lgpl|lgpl)"),
    ("agpl-3", "agpl|affero", r"(?:the )?(?:gnu )?(?:affero general public license|agpl)(?: version)? ?v?3(?: 0)?"),
    ("agpl", "agpl|affero", r"(?:the )?(?:gnu affero general public license|gnu agpl|agpl)"),
    ("fdl-1.3", "free doc", r"(?:the )?(?:gnu )?free documentation license(?: version)? 1 3"),
    ("fdl", "free doc", r"(?:the )?(?:gnu )?free documentation license"),
    ("mpl-1.1", "mpl|mozilla", r"(?:the )?(?:mozilla public license|mpl)(?: version)? ?v?1 1"),
    ("mpl-2", "mpl|mozilla", r"(?:the )?(?:mozilla public license|mpl)(?: version)? ?v?2(?: 0)?"),
    ("epl-1", "epl|eclipse", r"(?:the )?(?:eclipse public license|epl)(?: version)? ?v?1(?: 0)?"),
    ("epl-2", "epl|eclipse", r"(?:the )?(?:eclipse public license|epl)(?: version)? ?v?2(?: 0)?"),
    ("cddl-1", "cddl|common development", r"(?:the )?(?:common development and distribution license|cddl)(?: version)?(?: 1 0)?"),
    ("cpl-1", "common", r"(?:the )?common public license(?: version)?(?: 1 0)?"),
    ("isc", "isc", r"(?:the )?isc"),
    ("zlib", "zlib", r"(?:the )?zlib(?: libpng)?"),
    ("libpng", "libpng", r"(?:the )?libpng"),
    ("boost-1", "bsl|boost", r"(?:the )?(?:boost software license|bsl)(?: version)?(?: 1 0)?"),
    ("artistic-1", "artistic", r"(?:the )?artistic license(?: version)? 1(?: 0)?"),
    ("artistic-2", "artistic", r"(?:the )?artistic license(?: version)? 2(?: 0)?"),
    ("artistic", "artistic", r"(?:the )?(?:perl )?artistic"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"(?:the )?wtfpl"),
    ("cc0-1", "cc0|commons zero", r"(?:the )?(?:cc0|creative commons zero)(?: 1 0)?"),
    ("cc-by-nc-nd", "cc by|cc attribution|creative commons", r"(?:a |the )?(?:cc|creative commons)(?: by| attribution)(?: nc| non ?commercial)(?: nd| no ?deriv(?:s|atives?)?)(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc by|cc attribution|creative commons", r"(?:a |the )?(?:cc|creative commons)(?: by| attribution)(?: nc| non ?commercial)(?: sa| share ?alike)(?: [1-4] [05])?"),
    ("cc-by-nc", "cc by nc", r"(?:a |the )?cc by nc(?: [1-4] [05])?"),
    ("cc-by-nc", "commercial", r"(?:a |the )?creative commons attribution non ?commercial(?: [1-4] [05])?"),
    ("cc-by-nd", "cc by|cc attribution|creative commons", r"(?:a |the )?(?:cc|creative commons)(?: by| attribution)(?: nd| no ?deriv(?:s|atives?)?)(?: [1-4] [05])?"),
    ("cc-by-sa", "cc by|cc attribution|creative commons", r"(?:a |the )?(?:cc|creative commons)(?: by| attribution)(?: sa| share ?alike)(?: [1-4] [05])?"),
    ("cc-by", "cc by|cc attribution|creative commons", r"(?:a |the )?(?:cc|creative commons)(?: by| attribution)(?: [1-4] [05])?"),
    ("public-domain", "public domain", r"(?:the )?public domain"),
    ("psf-2", "python", r"(?:the )?python software foundation(?: license)?"),
    ("php-3", "php", r"(?:the )?php license(?: version)?(?: 3(?: 0| 01)?)?"),
    ("ofl-1.1", "ofl|open font", r"(?:the )?(?:sil )?(?:open font license|ofl)(?: version)?(?: 1 [01])?"),
    ("ms-pl", "ms pl|microsoft public", r"(?:the )?(?:microsoft public license|ms pl)"),
    ("ms-rl", "ms rl|microsoft reciprocal", r"(?:the )?(?:microsoft reciprocal license|ms rl)"),
    ("eupl-1.2", "eupl|european union public", r"(?:the )?(?:european union public licen[cs]e|eupl)(?: version)?(?: v?1 2)?"),
    ("odbl-1", "odbl|open database", r"(?:the )?(?:open database license|odbl)(?: v?1 0)?"),
    ("odc-by", "odc by|open data commons", r"(?:the )?(?:open data commons attribution license|odc by)"),
    ("ogl-3", "open gov", r"(?:the )?open government licen[cs]e(?: v?3 0)?"),
    ("postgresql", "postgresql", r"(?:the )?postgresql"),
    ("openssl", "openssl", r"(?:the )?openssl"),
    ("ruby", "ruby", r"(?:the )?ruby"),
    ("vim", "vim", r"(?:the )?vim"),
    ("x11", "x11", r"(?:the )?x11"),
    ("ncsa", "ncsa", r"(?:the )?(?:university of illinois )?ncsa"),
    ("osl-3", "osl|open software", r"(?:the )?(?:open software license|osl)(?: v?3 0)?"),
    ("sspl-1", "sspl|server side public", r"(?:the )?(?:server side public license|sspl)(?: v?1(?: 0)?)?"),
    ("busl-1.1", "busl|business source", r"(?:the )?(?:business source license|busl)(?: 1 1)?"),
    ("elastic-2", "elastic", r"(?:the )?elastic license(?: v?2(?: 0)?)?"),
    ("json", "json", r"(?:the )?json"),
]

#: How a statement names a license, with priority, confidence and keyword; {} is the family's regex.
STATEMENTS = [
    (r"spdx license identifier {}", 5, 1.0, "spdx"),
    (r"(?:is |are |be )?(?:dual )?(?:licensed|released|distributed|available|published|provided|redistributed|shared) (?:to you )?(?:only )?under (?:the terms of )?(?:the conditions of )?{}(?: licen[cs]e)?(?: version| v)?", 4, 0.95, "under"),
    (r"(?:under|subject to) (?:the )?(?:terms|conditions)(?: and conditions)? of {}(?: licen[cs]e)?", 4, 0.9, " of "),
    (r"(?:under|with) {} licen[cs]e", 3, 0.85, "licen"),
    (r"licen[cs]e {}", 2, 0.7, "licen"),
    (r"{} licen[cs]e", 1, 0.6, "licen"),
]

#: Statements without a family: label, keyword, regex, priority, confidence.
GENERAL = [
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}", 1, 0.5),
    ("all-rights-reserved", "reserved", r"all rights reserved", 1, 0.5),
    ("permissive-grant", "permission", r"permission is hereby granted free of charge", 3, 0.8),
    ("permissive-grant", "redistribution", r"redistribution and use in source and binary forms", 3, 0.8),
    ("no-warranty", "warrant", r"without warrant(?:y|ies) of any kind", 1, 0.4),
    ("as-is", "provided as is", r"provided as is", 1, 0.4),
    ("gpl", "free software", r"this (?:program|library) is free software", 2, 0.7),
    ("proprietary", " and ", r"(?:proprietary|confidential) and (?:confidential|proprietary)", 1, 0.6),
]

#: Any text with a license statement holds one of these (words joined by blanks, any case).
KEYWORDS = [
    "licen", "copyright", "spdx", "warrant", "redistribut", "rights reserved", "permission is hereby", "public domain", "cc by", "creative commons",
    "free software", "proprietary and", "confidential and", "only under", "you under", "released under", "available under", "published under", "provided ", "shared under",
    "distributed under", "terms of", "conditions of", "terms and conditions",
]
PREFILTER = "(?i)" + "|".join(KEYWORDS)
#: Characters of a stretch that are scanned together; what is scanned around them lets no place be cut.
CHUNK = 4096
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def rules() -> list[tuple[str, int, str, str, str, float]]:
    """(label, priority, two keywords, regex, confidence) of every signature: each family in each statement."""
    made = [
        (label, priority, key, word, form.replace("{}", name), sure)
        for label, keys, name in FAMILIES
        for key in keys.split("|")
        for form, priority, sure, word in STATEMENTS
    ]
    return made + [(label, priority, key, key, rx, sure) for label, key, rx, priority, sure in GENERAL]


@cache
def longest() -> int:
    """Characters of the longest place that any rule can match, with the blanks around it: every rule is bounded."""
    return max(_parser.parse(rx).getwidth()[1] for *_, rx, _ in rules()) + 2


def _literal() -> Column:
    """All rules as one constant (an array of structs)."""
    rows = [{"label": a, "prio": b, "key": c, "word": d, "rx": f"(?<= )(?:{e})(?= )", "sure": f} for a, b, c, d, e, f in rules()]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<label:string,prio:int,key:string,word:string,rx:string,sure:double>>")


def _surroundings(line: Column) -> Column:
    """The stretches of a text around its prefilter words, between bars; near ones are one stretch.

    A place holds a prefilter word, so it reaches no further than ``longest`` from it.
    """
    most = longest()
    gaps, hits = F.split(line, PREFILTER, -1), F.regexp_extract_all(line, F.lit(PREFILTER), F.lit(0))
    before = lambda x: F.regexp_replace(F.right(x, F.lit(most)), r"^\S+", "")
    after = lambda x: F.regexp_replace(F.left(x, F.lit(most)), r"\S+$", "")
    between = lambda x: F.when(F.length(x) <= 2 * most, x).otherwise(F.concat(after(x), F.lit(" | "), before(x)))
    inner = F.zip_with(F.slice(gaps, 2, F.size(hits) - 1), F.slice(hits, 2, F.size(hits) - 1), lambda gap, hit: F.concat(between(gap), hit))
    return F.concat(before(F.element_at(gaps, 1)), F.element_at(hits, 1), F.array_join(inner, ""), after(F.element_at(gaps, -1)), F.lit(" "))


def _places(text: Column, rule: Column) -> Column:
    """(start, end, prio, label, sure) of each match of a rule, in characters."""
    found = F.regexp_extract_all(text, rule["rx"], F.lit(0))
    parts = F.split(text, rule["rx"], -1)
    walked = F.aggregate(
        F.zip_with(F.slice(parts, 1, F.size(found)), found, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("hit"))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["hit"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["hit"]).alias("end")))).alias("out"),
        ),
    )
    return F.transform(walked["out"], lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), rule["prio"].alias("prio"), rule["label"].alias("label"), rule["sure"].alias("sure")))


def _within(p: Column, q: Column) -> Column:
    length = lambda x: x["end"] - x["start"]
    return (q["start"] <= p["start"]) & (q["end"] >= p["end"]) & ((q["prio"] > p["prio"]) | ((q["prio"] == p["prio"]) & (length(q) > length(p))))


def detections(lined: DataFrame, line: str) -> DataFrame:
    """Adds ``kept``: the surviving places of the column ``line`` (blank-joined words between blanks).

    A line is scanned in chunks of ``CHUNK`` characters, each with ``longest`` more on
    either side: these hold whatever can contain a place that begins in the chunk, so
    the work grows with a line's length, not with its square.
    """
    text, most = F.col(line), longest()
    whole = F.array(F.struct(F.lit(0).alias("skip"), text.alias("part")))
    cut = lambda i: F.struct(
        F.when(i > 0, most).otherwise(0).alias("skip"), F.substring(text, F.greatest(i * CHUNK - most, F.lit(0)) + 1, F.lit(CHUNK + 2 * most) - F.when(i > 0, 0).otherwise(most)).alias("part")
    )
    parts = F.when(F.length(text) <= CHUNK, whole).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / CHUNK).cast("int")), cut))
    # a text that the prefilter left out is null and costs nothing more
    hits = lambda c: F.filter(_literal(), lambda r: F.contains(c["part"], r["key"]) & F.contains(c["part"], r["word"]) & F.rlike(c["part"], r["rx"]))
    placed = lambda c: F.struct(c["skip"].alias("skip"), F.flatten(F.transform(hits(c), lambda r: _places(c["part"], r))).alias("places"))
    own = lambda c, p: (p["start"] >= c["skip"]) & (p["start"] < c["skip"] + CHUNK)
    left = lambda c: F.filter(c["places"], lambda p: own(c, p) & ~F.exists(c["places"], lambda q: _within(p, q)))
    found = lined.withColumn("_found", F.when(text.isNotNull(), F.transform(parts, placed)))
    return found.withColumn("kept", F.flatten(F.transform("_found", left))).drop("_found")


def _words(text: Column) -> Column:
    """The words of blank-joined words that begin and end with a blank."""
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) - 1


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    joined = F.concat(F.lit(" "), F.trim(F.regexp_replace(text, _GAP, " ")), F.lit(" "))
    lined = docs.select(F.col(id_col).alias("_id"), joined.alias("line"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    # "  " is the empty text; others have single blanks only
    lined = lined.withColumn("low", F.lower("line"))
    counted = lined.select("_id", F.when(F.col("line") == "  ", 0).otherwise(_words(F.col("line"))).cast("long").alias("n_words"), F.when(reduce(or_, [F.contains("low", F.lit(k)) for k in KEYWORDS]), F.translate("line", upper, upper.lower())).alias("line"))
    # rules read the surroundings of the prefilter's words only, which hold any statement whole
    found = detections(counted.withColumn("near", F.when(F.col("line").isNotNull(), _surroundings(F.col("line")))), "near")
    for k, phrase in enumerate(BASE):
        found = found.withColumn(f"p{k}", F.split("line", f"(?<= ){phrase}(?= )", -1))
    n = sum((F.coalesce(F.size(f"p{k}") - 1, F.lit(0)) for k in range(len(BASE))), F.lit(0))
    first = [F.when(F.size(f"p{k}") > 1, _words(F.element_at(f"p{k}", 1))) for k in range(len(BASE))]
    last = [F.when(F.size(f"p{k}") > 1, F.col("n_words") - _words(F.element_at(f"p{k}", -1)) - len(p.split())) for k, p in enumerate(BASE)]
    base = F.filter(F.array(*[F.when(F.coalesce(F.size(f"p{k}"), F.lit(0)) > 1, F.lit(x)) for k, x in enumerate(BASE.values())]), lambda x: x.isNotNull())
    every = F.array_sort(F.array_distinct(F.concat(base, F.coalesce(F.col("kept.label"), F.array().cast("array<string>")))))
    sure = F.greatest(F.coalesce(F.array_max("kept.sure"), F.lit(0.0)), F.when(n > 0, 0.85).otherwise(0.0))
    out = found.select(
        "_id", "n_words", n.cast("long").alias("n_base"), F.least(*first).cast("long").alias("first_word"), F.greatest(*last).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), sure.alias("score"),
    )
    return out.withColumnRenamed("_id", id_col)
