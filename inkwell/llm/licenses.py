"""License detection by ordered signature rules, with built-in operators only.

Texts are lower-cased (A-Z) and reduced to words, as the contract of the scan defines them; rules are regular
expressions over the words joined by single spaces. No rule is tried on texts without any of a few rare words, and a
rule only on texts that hold its keyword. Every match is a span with a label and a priority. A span that lies inside
another one of the same or a higher priority (a smaller number), or that equals one of a higher priority, is
suppressed; of spans that only overlap all stay. Everything happens inside the row, so nothing is shuffled.

The rules are made from a table of licenses: for each its SPDX identifiers, its names, its versions and its short
forms ("licensed under ..."), so a few hundred expressions result. Base phrases are found apart from them and their
labels always stay.

Defined results: null, empty and word-free texts have no words, no places, null first and last words, empty labels
and score 0; rows that repeat an id are scanned one by one; a null id is passed through; other columns are ignored.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import ascii_lower

#: What stands between words, before A-Z have become a-z.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Phrases whose places are counted, with their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


@dataclass(frozen=True)
class Rule:
    """keyword: words that must stand in the text; pattern: over words joined by spaces; priority: 1 before 2 before 3."""

    label: str
    keyword: str
    pattern: str
    priority: int
    weight: float


# The licenses. Label; keyword of its names; names, as patterns over words; SPDX identifier; versions
# as they are written (an empty list: the license has none).
_LICENSES = (
    ("mit", "mit", r"mit (?:expat )?licen[sc]e|mit x11 licen[sc]e", "mit", ()),
    ("mit", "expat", r"expat licen[sc]e", "", ()),
    ("mit-0", "mit", r"mit no attribution(?: licen[sc]e)?", "mit 0", ()),
    ("isc", "isc", r"isc licen[sc]e", "isc", ()),
    ("isc", "internet systems", r"internet systems consortium licen[sc]e", "", ()),
    ("bsd", "bsd", r"bsd licen[sc]e|bsd style licen[sc]e", "bsd", ()),
    ("bsd", "berkeley", r"berkeley software distribution licen[sc]e", "", ()),
    ("bsd-clause", "bsd", r"(?:(?:new|modified|revised|simplified|original) bsd licen[sc]e)", "bsd", ("1 clause", "2 clause", "3 clause", "4 clause")),
    ("apache", "apache", r"apache (?:software )?licen[sc]e", "apache", ("1 0", "1 1", "2 0")),
    ("gpl", "general public", r"(?:gnu )?general public licen[sc]e", "gpl", ("1 0", "2 0", "3 0", "1", "2", "3")),
    ("gpl", "gpl", r"gnu gpl|gpl licen[sc]e", "gpl", ("1 0", "2 0", "3 0", "1", "2", "3")),
    ("lgpl", "lesser general public", r"(?:gnu )?lesser general public licen[sc]e", "lgpl", ("2 0", "2 1", "3 0", "3")),
    ("lgpl", "library general public", r"(?:gnu )?library general public licen[sc]e", "lgpl", ("2 0",)),
    ("agpl", "affero", r"(?:gnu )?affero (?:general public )?licen[sc]e", "agpl", ("1 0", "3 0", "3")),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[sc]e", "gfdl", ("1 1", "1 2", "1 3")),
    ("mpl", "mozilla", r"mozilla public licen[sc]e", "mpl", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse", r"eclipse public licen[sc]e", "epl", ("1 0", "2 0")),
    ("edl", "eclipse", r"eclipse distribution licen[sc]e", "edl", ("1 0",)),
    ("cddl", "common development", r"common development and distribution licen[sc]e", "cddl", ("1 0", "1 1")),
    ("cpl", "common public", r"common public licen[sc]e", "cpl", ("1 0",)),
    ("ipl", "ibm", r"ibm public licen[sc]e", "ipl", ("1 0",)),
    ("eupl", "european union", r"european union public licen[sc]e", "eupl", ("1 0", "1 1", "1 2")),
    ("artistic", "artistic", r"(?:perl )?artistic licen[sc]e", "artistic", ("1 0", "2 0")),
    ("bsl", "boost", r"boost software licen[sc]e", "bsl", ("1 0",)),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e", "zlib", ()),
    ("unlicense", "unlicen", r"the unlicen[sc]e|unlicen[sc]e", "unlicense", ()),
    ("wtfpl", "what the", r"do what the \w+ you want to public licen[sc]e", "wtfpl", ("2",)),
    ("cc0", "cc0", r"cc0(?: universal)?", "cc0", ("1 0",)),
    ("cc0", "creative commons", r"creative commons (?:zero|public domain dedication)", "cc0", ("1 0",)),
    ("python", "python", r"python software foundation licen[sc]e", "psf", ("2 0", "2")),
    ("python", "psf", r"psf licen[sc]e", "", ("2 0", "2")),
    ("ruby", "ruby", r"ruby licen[sc]e", "ruby", ()),
    ("php", "php", r"php licen[sc]e", "php", ("3 0", "3 01")),
    ("openssl", "openssl", r"openssl licen[sc]e", "openssl", ()),
    ("postgresql", "postgresql", r"postgresql licen[sc]e", "postgresql", ()),
    ("ofl", "open font", r"(?:sil )?open font licen[sc]e", "ofl", ("1 0", "1 1")),
    ("odbl", "open database", r"open (?:data commons )?open database licen[sc]e|open database licen[sc]e", "odbl", ("1 0",)),
    ("odc-by", "open data commons", r"open data commons attribution licen[sc]e", "odc by", ("1 0",)),
    ("pddl", "public domain dedication", r"public domain dedication and licen[sc]e", "pddl", ("1 0",)),
    ("osl", "open software", r"open software licen[sc]e", "osl", ("1 0", "2 0", "2 1", "3 0")),
    ("afl", "academic free", r"academic free licen[sc]e", "afl", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e", "ms pl", ()),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e", "ms rl", ()),
    ("ncsa", "ncsa", r"university of illinois ncsa open source licen[sc]e|ncsa open source licen[sc]e", "ncsa", ()),
    ("vim", "vim", r"vim licen[sc]e", "vim", ()),
    ("w3c", "w3c", r"w3c (?:software notice and )?licen[sc]e", "w3c", ()),
    ("busl", "business source", r"business source licen[sc]e", "busl", ("1 0", "1 1")),
    ("sspl", "server side public", r"server side public licen[sc]e", "sspl", ("1 0", "1")),
    ("elastic", "elastic", r"elastic licen[sc]e", "elastic", ("1 0", "2 0")),
    ("qpl", "q public", r"q public licen[sc]e", "qpl", ("1 0",)),
    ("lppl", "latex", r"latex project public licen[sc]e", "lppl", ("1 0", "1 1", "1 2", "1 3c")),
    ("nasa", "nasa", r"nasa open source agreement", "nasa", ("1 3",)),
    ("proprietary", "all rights", r"all rights reserved", "", ()),
    ("public-domain", "public domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain|public domain(?: work)?", "", ()),
)
# Creative Commons: each combination of terms, its name and the versions.
_CC_TERMS = (("by", "attribution"), ("by sa", "attribution share ?alike"), ("by nd", "attribution no ?deriv(?:atives|s)"), ("by nc", "attribution non ?commercial"), ("by nc sa", "attribution non ?commercial share ?alike"), ("by nc nd", "attribution non ?commercial no ?deriv(?:atives|s)"))
_CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: Every match of a rule holds one of these; they are rare, so most texts are done after this one search.
GATE = ("licen", "gpl", "released under ", "distributed under ", "available under ", "provided under ", "published under ", "creative commons", "creativecommons", "cc0", "cc by", "all rights reserved", "public domain", "nasa open", "permission is", "permission to", "redistribution and use", "free software", "wtfpl", "opensource org", "spdx")
_UNDER = r"(?:(?:licen[sc]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?)"


def rules() -> list[Rule]:
    """All rules, the most specific form of each license first."""
    out: list[Rule] = []
    for label, keyword, name, spdx, versions in _LICENSES:
        versioned = "" if label.startswith("bsd") else "(?:version |v ?)?"
        for v in versions:
            full = f"{label.removesuffix('-clause')}-{v.replace(' ', '.') if 'clause' not in v else v.replace(' ', '-')}"
            out.append(Rule(full, keyword, rf"\b(?:{name}) {versioned}{v}(?: or (?:later|any later version))?\b", 1, 1.0))
            if spdx:
                out.append(Rule(full, "spdx", rf"\bspdx licen[sc]e identifier {spdx} {v}(?: only| or later)?\b", 1, 1.0))
                out.append(Rule(full, spdx.split(" ")[0], rf"\b{_UNDER}{spdx} {versioned}{v}\b", 1, 0.9))
        if spdx:
            out.append(Rule(label, "spdx", rf"\bspdx licen[sc]e identifier {spdx}\b", 2, 1.0))
            out.append(Rule(label, spdx.split(" ")[0], rf"\b{_UNDER}{spdx}\b", 2, 0.8))
            out.append(Rule(label, "opensource", rf"\bopensource org licen[sc]es {spdx}\b", 2, 0.9))
        out.append(Rule(label, keyword, rf"\b{_UNDER}(?:{name})\b", 2, 0.9))
        out.append(Rule(label, keyword, rf"\b(?:{name})\b", 3, 0.6))
    for terms, name in _CC_TERMS:
        label = "cc-" + terms.replace(" ", "-")
        for v in _CC_VERSIONS:
            full = f"{label}-{v.replace(' ', '.')}"
            out.append(Rule(full, "cc", rf"\bcc {terms} {v}\b", 1, 1.0))
            out.append(Rule(full, "creative commons", rf"\bcreative commons {name} (?:licen[sc]e )?(?:\w+ )?(?:version )?{v}\b", 1, 1.0))
            out.append(Rule(full, "creativecommons", rf"\bcreativecommons org licen[sc]es {terms} {v}\b", 1, 1.0))
        out.append(Rule(label, "cc", rf"\bcc {terms}\b", 3, 0.6))
        out.append(Rule(label, "creative commons", rf"\bcreative commons {name}\b", 3, 0.7))
    out.append(Rule("mit", "permission is hereby", r"\bpermission is hereby granted free of charge to any person obtaining a copy\b", 2, 0.9))
    out.append(Rule("isc", "permission to use", r"\bpermission to use copy modify and or distribute this software for any purpose\b", 2, 0.9))
    out.append(Rule("bsd", "redistribution and use", r"\bredistribution and use in source and binary forms with or without modification are permitted\b", 2, 0.9))
    out.append(Rule("gpl", "free software", r"\bthis program is free software you can redistribute it and or modify it\b", 2, 0.8))
    out.append(Rule("unlicense", "free and unencumbered", r"\bthis is free and unencumbered software released into the public domain\b", 1, 1.0))
    out.append(Rule("wtfpl", "wtfpl", r"\bwtfpl\b", 3, 0.6))
    return out


def words_of(text: Column) -> Column:
    """The words joined by single spaces, in their own case."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), BETWEEN, " "))


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _places(words: Column, phrase: str) -> Column:
    """Where the words of a phrase stand one after the other: an array of word numbers."""
    want = phrase.split(" ")
    last = F.size(words) - F.lit(len(want))
    same = lambda i: [F.get(words, i + F.lit(k)) == F.lit(w) for k, w in enumerate(want)]

    def holds(i: Column) -> Column:
        first, *rest = same(i)
        for c in rest:
            first = first & c
        return first

    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), holds)).otherwise(F.array().cast("array<int>"))


def _spans(canon: Column, known: list[Rule]) -> Column:
    """All matches of the rules whose keyword the text holds: array of struct(start, end, priority, label, weight).

    A rule's matches and the gaps between them add up to the positions."""
    table = F.from_json(F.lit(json.dumps([asdict(r) for r in known])), "array<struct<label:string,keyword:string,pattern:string,priority:int,weight:double>>")
    keywords = F.filter(F.from_json(F.lit(json.dumps(sorted({r.keyword for r in known}))), "array<string>"), lambda k: F.contains(canon, k))
    tried = _let(keywords, lambda held: F.filter(table, lambda r: F.array_contains(held, r["keyword"])))

    def found(r: Column) -> Column:
        hits = F.regexp_extract_all(canon, r["pattern"], F.lit(0))
        gaps = F.split(canon, r["pattern"], -1)
        lengths = F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("hit")))
        lengths = F.filter(lengths, lambda x: x["hit"].isNotNull())
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
        placed = F.aggregate(lengths, start, lambda a, x: F.struct((a["at"] + x["gap"] + x["hit"]).alias("at"), F.concat(a["spans"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["hit"]).alias("end")))).alias("spans")))
        return F.transform(placed["spans"], lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), r["priority"].alias("priority"), r["label"].alias("label"), r["weight"].alias("weight")))

    return F.flatten(F.transform(tried, found))


def _standing(spans: Column) -> Column:
    """The spans that no other suppresses. Sorted by start, then from the longest, a span lies inside an earlier one
    exactly if it ends at or before the furthest end so far; that is kept for each priority."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["priority"].alias("priority"), s["label"].alias("label"), s["weight"].alias("weight"))))
    kind = "array<struct<start:int,back:int,priority:int,label:string,weight:double>>"
    empty = F.struct(*(F.lit(-1).alias(f"end{p}") for p in (1, 2, 3)), F.array().cast(kind).alias("kept"))

    def step(a: Column, s: Column) -> Column:
        end = -s["back"]
        reach = F.when(s["priority"] == 1, a["end1"]).when(s["priority"] == 2, F.greatest(a["end1"], a["end2"])).otherwise(F.greatest(a["end1"], a["end2"], a["end3"]))
        ends = [F.when(s["priority"] == p, F.greatest(a[f"end{p}"], end)).otherwise(a[f"end{p}"]).alias(f"end{p}") for p in (1, 2, 3)]
        return F.struct(*ends, F.when(end <= reach, a["kept"]).otherwise(F.concat(a["kept"], F.array(s))).alias("kept"))

    return F.aggregate(order, empty, step)["kept"]


def scan_licenses(documents: DataFrame, known: list[Rule] | None = None, base: tuple[tuple[str, str], ...] = BASE, gate: tuple[str, ...] = GATE) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and the
    detections that stand (label, start and end in the joined words, priority, weight). With rules of your own give a
    gate: words of which every text with a match holds one."""
    known = rules() if known is None else known
    none, no_places = F.array().cast("array<string>"), F.array().cast("array<int>")

    def held(canon: Column) -> Column:
        """Base places (an array for each phrase) and standing detections of a lower-cased text that passed the gate."""
        by_phrase = _let(F.split(canon, " "), lambda words: F.array(*(F.when(F.contains(canon, F.lit(p)), _places(words, p)).otherwise(no_places) for p, _ in base)))
        return F.struct(by_phrase.alias("places"), _let(_spans(canon, known), _standing).alias("detections"))

    def scanned(canon: Column) -> Column:
        passed = _let(F.lower(canon), lambda low: F.exists(F.from_json(F.lit(json.dumps([*gate, *(p for p, _ in base)])), "array<string>"), lambda w: F.contains(low, w)))
        n = F.when(canon == "", F.lit(0)).otherwise(F.length(canon) - F.length(F.replace(canon, F.lit(" "), F.lit(""))) + 1)
        return F.struct(n.cast("long").alias("n_words"), F.when(passed, _let(ascii_lower(canon), held)).alias("held"))

    def digest(r: Column) -> Column:
        every = F.coalesce(F.flatten(r["held"]["places"]), no_places)
        standing = r["held"]["detections"]
        base_labels = F.array_compact(F.array(*(F.when(F.size(F.get(r["held"]["places"], F.lit(i))) > 0, F.lit(label)) for i, (_, label) in enumerate(base))))
        labels = F.array_union(base_labels, F.coalesce(F.transform(standing, lambda d: d["label"]), none))
        best = F.coalesce(F.array_max(F.transform(standing, lambda d: d["weight"])), F.lit(0.0))
        return F.struct(
            r["n_words"].alias("n_words"),
            F.size(every).cast("long").alias("n_base"),
            F.array_min(every).cast("long").alias("first_word"),
            F.array_max(every).cast("long").alias("last_word"),
            F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
            F.array_join(F.array_sort(labels), ",").alias("labels"),
            F.when(F.size(every) > 0, F.greatest(best, F.lit(0.6))).otherwise(best).alias("score"),
            F.transform(standing, lambda d: F.struct(d["label"].alias("label"), d["start"].alias("start"), (-d["back"]).alias("end"), d["priority"].alias("priority"), d["weight"].alias("weight"))).alias("detections"),
        )

    made = _let(words_of(F.col("text")), lambda canon: _let(scanned(canon), digest))
    return documents.select("doc_id", made.alias("made")).select("doc_id", "made.*")
