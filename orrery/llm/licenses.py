"""License scans by ordered signature rules, with DataFrame operations only.

A text is lower-cased and reduced to its words. A prefilter lets most texts pass unscanned: key words over those words, of which
every match of a rule holds one. For the rest each rule (label, priority, key words, regular expression over the words) is tried if
one of its key words occurs; they are derived from the expression, one for each alternative. Matches are intervals of words.
An interval that lies within one of a rule that goes first (smaller priority number; of equals a strictly longer interval) is
suppressed. The labels of what is left, and those of the base phrases, are the text's labels; its score is that of its most
reliable detection. Everything happens within a row: no shuffle, at any size.

Rules are written by hand: a table of licenses with their names and identifiers, in five forms each (identifier tag, notice,
named with version, named, short).

Edge cases: a null text is an empty one: no words, nothing found, empty labels, score 0, null places; overlapping places of a
phrase all count; repeated rows are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import read, text_or_empty

#: Between words: every ASCII character but digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE = (("mit", ("mit", "license")), ("apache", ("apache", "license")), ("gpl", ("general", "public", "license")))

#: Label, name in running text, identifier words. Names and identifiers are regular expressions over
#: words that are separated by one space.
LICENSES = (
    ("mit", "mit", "mit"),
    ("mit-0", "mit no attribution", "mit 0"),
    ("apache-1.0", "apache(?: software)?", "apache 1 0"),
    ("apache-1.1", "apache(?: software)?", "apache 1 1"),
    ("apache-2.0", "apache(?: software)?", "apache 2(?: 0)?"),
    ("gpl-1.0", "gnu general public", "gpl 1 0(?: only| or later)?"),
    ("gpl-2.0", "(?:gnu )?general public", "gpl 2 0(?: only| or later)?"),
    ("gpl-3.0", "(?:gnu )?general public", "gpl 3 0(?: only| or later)?"),
    ("lgpl-2.0", "(?:gnu )?library general public", "lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "(?:gnu )?lesser general public", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", "(?:gnu )?lesser general public", "lgpl 3 0(?: only| or later)?"),
    ("agpl-1.0", "affero general public", "agpl 1 0(?: only| or later)?"),
    ("agpl-3.0", "(?:gnu )?affero general public", "agpl 3 0(?: only| or later)?"),
    ("gfdl-1.1", "gnu free documentation", "gfdl 1 1(?: only| or later)?"),
    ("gfdl-1.2", "gnu free documentation", "gfdl 1 2(?: only| or later)?"),
    ("gfdl-1.3", "gnu free documentation", "gfdl 1 3(?: only| or later)?"),
    ("bsd-1-clause", "(?:bsd 1 clause|one clause bsd)", "bsd 1 clause"),
    ("bsd-2-clause", "(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)", "bsd 2 clause(?: patent| views)?"),
    ("bsd-3-clause", "(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)", "bsd 3 clause(?: clear)?"),
    ("bsd-4-clause", "(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)", "bsd 4 clause(?: uc)?"),
    ("0bsd", "(?:zero clause bsd|bsd zero clause|0 clause bsd)", "0bsd"),
    ("isc", "(?:isc|internet systems consortium)", "isc"),
    ("mpl-1.0", "mozilla public", "mpl 1 0"),
    ("mpl-1.1", "mozilla public", "mpl 1 1"),
    ("mpl-2.0", "mozilla public", "mpl 2 0(?: no copyleft exception)?"),
    ("epl-1.0", "eclipse public", "epl 1 0"),
    ("epl-2.0", "eclipse public", "epl 2 0"),
    ("eupl-1.1", "european union public", "eupl 1 1"),
    ("eupl-1.2", "european union public", "eupl 1 2"),
    ("cddl-1.0", "common development and distribution", "cddl 1 0"),
    ("cddl-1.1", "common development and distribution", "cddl 1 1"),
    ("cpl-1.0", "common public", "cpl 1 0"),
    ("cpal-1.0", "common public attribution", "cpal 1 0"),
    ("artistic-1.0", "(?:perl )?artistic", "artistic 1 0(?: perl| cl8)?"),
    ("artistic-2.0", "artistic", "artistic 2 0"),
    ("bsl-1.0", "boost software", "bsl 1 0"),
    ("busl-1.1", "business source", "busl 1 1"),
    ("zlib", "(?:zlib|zlib libpng)", "zlib"),
    ("libpng", "libpng", "libpng(?: 2 0)?"),
    ("ncsa", "university of illinois(?: ncsa)? open source", "ncsa"),
    ("x11", "(?:x11|x consortium)", "x11"),
    ("postgresql", "postgresql", "postgresql"),
    ("python-2.0", "python software foundation", "(?:python|psf) 2 0"),
    ("php-3.01", "php", "php 3 0 1"),
    ("ruby", "ruby", "ruby"),
    ("openssl", "(?:openssl|openssl ssleay)", "openssl"),
    ("ofl-1.0", "(?:sil )?open font", "ofl 1 0"),
    ("ofl-1.1", "(?:sil )?open font", "ofl 1 1"),
    ("ms-pl", "microsoft public", "ms pl"),
    ("ms-rl", "microsoft reciprocal", "ms rl"),
    ("afl-3.0", "academic free", "afl 3 0"),
    ("osl-3.0", "open software", "osl 3 0"),
    ("odbl-1.0", "open(?: data commons open)? database", "odbl 1 0"),
    ("odc-by-1.0", "open data commons attribution", "odc by 1 0"),
    ("pddl-1.0", "public domain dedication and", "pddl 1 0"),
    ("wtfpl", "do what the fuck you want to public", "wtfpl"),
    ("unlicense", "unlicense", "unlicense"),
    ("cc0-1.0", "(?:cc0|creative commons zero)(?: universal)?", "cc0 1 0"),
    ("cc-by-2.0", "creative commons attribution", "cc by 2 0"),
    ("cc-by-3.0", "creative commons attribution", "cc by 3 0"),
    ("cc-by-4.0", "creative commons attribution(?: international)?", "cc by 4 0"),
    ("cc-by-sa-2.0", "creative commons attribution share ?alike", "cc by sa 2 0"),
    ("cc-by-sa-3.0", "creative commons attribution share ?alike", "cc by sa 3 0"),
    ("cc-by-sa-4.0", "creative commons attribution share ?alike(?: international)?", "cc by sa 4 0"),
    ("cc-by-nd-4.0", "creative commons attribution no ?deriv(?:ative)?s", "cc by nd 4 0"),
    ("cc-by-nc-4.0", "creative commons attribution non ?commercial", "cc by nc 4 0"),
    ("cc-by-nc-sa-4.0", "creative commons attribution non ?commercial share ?alike", "cc by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "creative commons attribution non ?commercial no ?deriv(?:ative)?s", "cc by nc nd 4 0"),
)
#: Label, expression, priority, score of rules that fit no form.
OTHERS = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", 2, 0.95),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 2, 0.95),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 2, 0.9),
    ("zlib", "the origin of this software must not be misrepresented", 2, 0.9),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation", 2, 0.95),
    ("lgpl", "(?:gnu )?lesser general public license", 3, 0.9),
    ("agpl", "(?:gnu )?affero general public license", 3, 0.9),
    ("gpl", "(?:gnu )?gpl(?:v[0-9]| v ?[0-9]| version [0-9])?", 5, 0.6),
    ("lgpl", "(?:gnu )?lgpl(?:v[0-9]| v ?[0-9]| version [0-9])?", 5, 0.6),
    ("agpl", "(?:gnu )?agpl(?:v[0-9]| v ?[0-9]| version [0-9])?", 5, 0.6),
    ("public-domain", "(?:released into|dedicated to|placed in|in) the public domain", 3, 0.8),
    ("all-rights-reserved", "all rights reserved", 4, 0.7),
    ("copyright", "copyright(?: c)? (?:19|20)[0-9]{2}", 5, 0.4),
    ("no-warranty", "without warranty of any kind", 5, 0.3),
    ("proprietary", "proprietary and confidential", 3, 0.8),
    # openings, clauses and notices of license texts
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell", 2, 0.95),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 2, 0.95),
    ("mit-0", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is", 1, 0.95),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", 1, 1.0),
    ("apache-2.0", "you may obtain a copy of the license at https? www apache org licenses license 2 0", 1, 1.0),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 2, 0.9),
    ("apache-1.1", "this product includes software developed by the apache software foundation", 2, 0.8),
    ("gpl-2.0", "gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", 1, 1.0),
    ("gpl-3.0", "gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", 1, 1.0),
    ("gpl-2.0", "gnu general public license version 2 june 1991", 1, 1.0),
    ("gpl-3.0", "gnu general public license version 3 29 june 2007", 1, 1.0),
    ("gpl", "you should have received a copy of the gnu general public license along with this program", 2, 0.95),
    ("gpl", "the licenses for most software are designed to take away your freedom to share and change it", 2, 0.9),
    ("lgpl-2.1", "gnu lesser general public license version 2 1 february 1999", 1, 1.0),
    ("lgpl-3.0", "gnu lesser general public license version 3 29 june 2007", 1, 1.0),
    ("lgpl", "gnu (?:lesser|library) general public license as published by the free software foundation", 2, 0.95),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public license along with this library", 2, 0.95),
    ("agpl-3.0", "gnu affero general public license version 3 19 november 2007", 1, 1.0),
    ("agpl", "gnu affero general public license as published by the free software foundation", 2, 0.95),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 2, 0.95),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", 1, 1.0),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1", 1, 1.0),
    ("mpl-1.0", "the contents of this file are subject to the mozilla public license version 1 0", 1, 1.0),
    ("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution license", 2, 0.95),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", 1, 1.0),
    ("epl-1.0", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0", 1, 1.0),
    ("bsd-3-clause", "neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse or promote products derived from this software", 2, 0.95),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 2, 0.95),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 3, 0.9),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", 3, 0.9),
    ("bsd", "this software is provided by the copyright holders? and contributors as is and any express or implied warranties", 3, 0.85),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is", 1, 0.95),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", 2, 0.9),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 2, 0.95),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", 2, 0.95),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 2, 0.95),
    ("unlicense", "this is free and unencumbered software released into the public domain", 1, 1.0),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", 2, 0.95),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", 1, 1.0),
    ("cc0-1.0", "to the extent possible under law (?:[^ ]+ ){1,12}waived all copyright and related or neighboring rights", 2, 0.95),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", 1, 1.0),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution share ?alike 4 0 international license", 1, 1.0),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution non ?commercial 4 0 international license", 1, 1.0),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", 1, 1.0),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", 1, 0.95),
    ("openssl", "this product includes cryptographic software written by eric young", 2, 0.9),
    ("python-2.0", "psf is making python available to licensee on an as is basis", 1, 0.95),
    ("artistic-2.0", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", 4, 0.5),
    ("eupl-1.2", "licensed under the eupl(?: version 1 2)?", 2, 0.9),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license", 2, 0.9),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited", 2, 0.9),
    ("proprietary", "no part of this (?:publication|work|document|book) may be reproduced(?: stored| distributed| or transmitted)?", 3, 0.8),
    ("no-warranty", "this (?:program|library) is distributed in the hope that it will be useful but without any warranty", 4, 0.5),
    ("no-warranty", "the software is provided as is without warranty of any kind express or implied", 4, 0.4),
    ("copyleft-notice", "see the gnu (?:lesser |affero )?general public license for more details", 4, 0.7),
)


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keywords: tuple[str, ...]  # every match holds one of them
    pattern: str  # begins with the space before its first word and looks at the space after its last one
    score: float

    @property
    def keyword(self) -> str:
        """What every match holds: the key word, or nothing if there are several."""
        return self.keywords[0] if len(self.keywords) == 1 else ""


def _needed(items: Iterable) -> list[frozenset[str]]:
    """Sets of literals of a parsed expression; every match holds at least one literal of each set."""
    out, run = [], []
    for op, value in [*items, (None, None)]:
        if op is _parser.LITERAL:
            run.append((op, value))
            continue
        if run:
            out.append(frozenset(["".join(chr(c) for _, c in run)]))
        if op is _parser.SUBPATTERN:
            out += _needed(value[3])
        elif op is _parser.BRANCH:
            # the parser moves what all branches begin with before them
            best = [_best(_needed([*run, *x])) for x in value[1]]
            if all(best):
                out.append(frozenset().union(*best))
        elif op is _parser.MAX_REPEAT and value[0] > 0:
            out += _needed(value[2])
        run = []
    return out


def _best(sets: list[frozenset[str]]) -> frozenset[str]:
    """The set whose shortest literal is the longest; of equals the first."""
    return max(sets, key=lambda s: min(map(len, s)), default=frozenset())


def _rule(label: str, priority: int, key: str, words: str, score: float) -> Rule:
    """``key`` is the part of ``words`` that the key words are taken from; it stands in every match."""
    return Rule(label, priority, tuple(sorted(_best(_needed(_parser.parse(key))))), f" (?:{words})(?= )", score)


def rules() -> list[Rule]:
    """All rules, in order."""
    out = []
    for label, name, identifier in LICENSES:
        digits = [d for d in label.split("-")[-1].split(".") if d.isdigit()] if "." in label else []
        major, *minor = digits or [""]
        number = f"{major}(?: {minor[0]})?" if digits and minor and minor[0] == "0" else " ".join(digits)
        version = f"(?:version |v ?|release )?{number}" if digits else ""
        tail = f" licen[sc]e(?: {version})" if digits else " licen[sc]e"
        full = f"{name}(?: public)?{tail}"
        out += [
            _rule(label, 1, "spdx licen", f"spdx licen[sc]e identifier {identifier}", 1.0),
            _rule(label, 2, name, f"(?:licensed|released|distributed|available|published|provided|covered|use) under (?:the )?(?:terms of (?:the )?)?(?:{full})", 0.95),
            _rule(label, 3, name, full, 0.9),
            _rule(label, 4, name, f"{name} {version}" if digits else f"the {name} licen[sc]e terms", 0.8),
            _rule(label, 5, identifier, f"{identifier} licen[sc]ed?", 0.6),
        ]
    out += [_rule(label, priority, words, words, score) for label, words, priority, score in OTHERS]
    return out


def _prefilter() -> tuple[str, ...]:
    """The fewest words of which every match of any rule holds one: "licen" for the rules that need it, else the rule's key words."""
    words: set[str] = set()
    for r in rules():
        licensed = any(all("licen" in x for x in s) for s in _needed(_parser.parse(r.pattern)))
        words |= {"licen"} if licensed else set(r.keywords)
    return tuple(sorted(w for w in words if not any(v != w and v in w for v in words)))


#: A text whose words hold none of these is not scanned.
PREFILTER = _prefilter()


def _lower(column: str) -> Column:
    """A-Z lower-cased, as far as rules and words can tell: of other letters only U+212A would become an ASCII one, so it is put aside."""
    return F.lower(F.replace(F.col(column), F.lit("\u212a"), F.lit("\u0138")))


def _places(words: Column, phrase: tuple[str, ...]) -> Column:
    """Indices at which the phrase stands in an array of words."""
    last = F.size(words) - len(phrase)

    def here(i: Column) -> Column:
        hit = words[i] == phrase[0]
        for k, w in enumerate(phrase[1:], 1):
            hit = hit & (words[i + k] == w)
        return hit

    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), here)).otherwise(F.array().cast("array<int>"))


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _detections(spaced: Column) -> Column:
    """Array of (label, priority, score, start, end) of all rules' matches; end is exclusive."""
    table = F.from_json(
        F.lit(json.dumps([{"label": r.label, "priority": r.priority, "keywords": r.keywords, "pattern": r.pattern, "score": r.score} for r in rules()])),
        "array<struct<label:string,priority:int,keywords:array<string>,pattern:string,score:double>>",
    )
    tried = F.filter(table, lambda r: F.exists(r.keywords, lambda k: spaced.contains(k)))
    kind = "array<struct<label:string,priority:int,score:double,start:int,end:int>>"

    def intervals(r: Column) -> Column:
        found = F.regexp_extract_all(spaced, r.pattern, F.lit(0))
        between = F.split(spaced, r.pattern, -1)
        start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            first = acc["at"] + _spaces(x["between"])
            end = first + _spaces(x["found"])
            one = F.struct(r.label.alias("label"), r.priority.alias("priority"), r.score.alias("score"), first.alias("start"), end.alias("end"))
            return F.when(x["found"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out")))

        return F.aggregate(F.arrays_zip(between.alias("between"), found.alias("found")), start, step, lambda acc: acc["out"])

    return F.flatten(F.transform(tried, intervals))


def _kept(found: Column) -> Column:
    """Detections that don't lie within one that goes first."""

    def within(d: Column, e: Column) -> Column:
        longer = (e["end"] - e["start"]) > (d["end"] - d["start"])
        return (e["start"] <= d["start"]) & (e["end"] >= d["end"]) & ((e["priority"] < d["priority"]) | ((e["priority"] == d["priority"]) & longer))

    return F.filter(found, lambda d: ~F.exists(found, lambda e: within(d, e)))


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections."""
    passes = F.lit(False)
    for word in PREFILTER:
        passes = passes | F.col("_spaced").contains(word)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("_text"))
    rows = rows.withColumn("_spaced", F.concat(F.lit(" "), F.trim(F.regexp_replace(_lower("_text"), SEPARATORS, " ")), F.lit(" ")))
    n_words = F.when(F.col("_spaced") == "  ", 0).otherwise(_spaces(F.col("_spaced")) - 1)
    rows = rows.select("doc_id", n_words.cast("long").alias("n_words"), F.when(passes, F.col("_spaced")).alias("_spaced"))
    words = F.split(F.trim(F.col("_spaced")), " ")
    nothing = F.array().cast("array<struct<label:string,priority:int,score:double,start:int,end:int>>")
    rows = rows.withColumn("_words", F.when(F.col("_spaced").contains(" license "), words))
    rows = rows.select(
        "doc_id",
        "n_words",
        *[F.when(F.col("_words").isNotNull(), _places(F.col("_words"), phrase)).otherwise(F.array().cast("array<int>")).alias(f"_{label}") for label, phrase in BASE],
        F.when(F.col("_spaced").isNotNull(), _detections(F.col("_spaced"))).otherwise(nothing).alias("_found"),
    )
    rows = rows.withColumn("detections", F.when(F.size("_found") > 1, _kept(F.col("_found"))).otherwise(F.col("_found")))
    places = F.concat(*[F.col(f"_{label}") for label, _ in BASE])
    base = F.filter(F.array(*[F.when(F.size(f"_{label}") > 0, F.lit(label)) for label, _ in BASE]), lambda x: x.isNotNull())
    rows = rows.withColumns({"_places": places, "_base": base})
    best = F.array_max(F.concat(F.transform("detections", lambda d: d["score"]), F.array(F.when(F.size("_places") > 0, F.lit(0.9)).otherwise(F.lit(0.0)))))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("_places").cast("long").alias("n_base"),
        F.array_min("_places").cast("long").alias("first_word"),
        F.array_max("_places").cast("long").alias("last_word"),
        _joined(F.col("_base")).alias("base_labels"),
        _joined(F.concat("_base", F.transform("detections", lambda d: d["label"]))).alias("labels"),
        best.alias("score"),
        "detections",
    )


def op7_license_scans(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents")).drop("detections")
