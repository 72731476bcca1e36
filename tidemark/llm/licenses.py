"""License scans by ordered signature rules, in column expressions only.

A text is lower-cased (A-Z) and reduced to its words with one space between them. Rules are regular expressions over that
form: sentences of the license texts themselves, names with joined versions, addresses and lists, each written out below,
and a few shapes (license identifier, notice, address, title, bare name) for each license of the table. A rule is
tried only where one of its keywords occurs, words that it can't match without; they are spelled out from the names in its
pattern. No rule is tried where no keyword of any rule occurs. All places of a rule are found; a place that lies within
one of higher priority, or within a longer one of its own, is suppressed.

Everything happens row by row in built-in functions: no shuffle, no Python. Places are swept in order of their start,
with the furthest end seen for each priority. Lists of places grow in pieces of about the square root of their number, as
an array is copied whenever it grows.

Nulls and ties: null counts as empty. Of two places with the same bounds, the higher priority stays; of equal priority
the first label in order. Repeated rows give equal results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that part words; letters A-Z are lower-cased before.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Fixed phrases whose places are always counted, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Licenses by label: names as regular expressions over words, version words and identifier words.
LICENSES: dict[str, tuple[str, str, str]] = {
    "mit": ("(?:mit|expat|x11)", "", "mit"),
    "mit-0": ("mit no attribution", "", "mit 0"),
    "apache-1.1": ("apache(?: software)?", "1 1", "apache 1 1"),
    "apache-2.0": ("apache(?: software)?", "2(?: 0)?", "apache 2 0"),
    "gpl-1.0": ("(?:gnu )?(?:general public|gpl)", "1(?: 0)?", "gpl 1 0"),
    "gpl-2.0": ("(?:gnu )?(?:general public|gpl)", "2(?: 0)?", "gpl 2 0"),
    "gpl-3.0": ("(?:gnu )?(?:general public|gpl)", "3(?: 0)?", "gpl 3 0"),
    "lgpl-2.0": ("(?:gnu )?(?:library general public|lgpl)", "2(?: 0)?", "lgpl 2 0"),
    "lgpl-2.1": ("(?:gnu )?(?:lesser general public|lgpl)", "2 1", "lgpl 2 1"),
    "lgpl-3.0": ("(?:gnu )?(?:lesser general public|lgpl)", "3(?: 0)?", "lgpl 3 0"),
    "agpl-3.0": ("(?:gnu )?(?:affero general public|agpl)", "3(?: 0)?", "agpl 3 0"),
    "gfdl-1.2": ("(?:gnu )?(?:free documentation|fdl)", "1 2", "gfdl 1 2"),
    "gfdl-1.3": ("(?:gnu )?(?:free documentation|fdl)", "1 3", "gfdl 1 3"),
    "bsd-2-clause": ("(?:simplified bsd|2 clause bsd|bsd 2 clause|freebsd)", "", "bsd 2 clause"),
    "bsd-3-clause": ("(?:new bsd|modified bsd|3 clause bsd|bsd 3 clause|revised bsd)", "", "bsd 3 clause"),
    "bsd-4-clause": ("(?:original bsd|4 clause bsd|bsd 4 clause)", "", "bsd 4 clause"),
    "0bsd": ("(?:zero clause bsd|bsd zero clause|0bsd)", "", "0bsd"),
    "isc": ("isc", "", "isc"),
    "mpl-1.1": ("mozilla public", "1 1", "mpl 1 1"),
    "mpl-2.0": ("mozilla public", "2(?: 0)?", "mpl 2 0"),
    "epl-1.0": ("eclipse public", "1(?: 0)?", "epl 1 0"),
    "epl-2.0": ("eclipse public", "2(?: 0)?", "epl 2 0"),
    "cpl-1.0": ("common public", "1(?: 0)?", "cpl 1 0"),
    "cddl-1.0": ("common development and distribution", "1(?: 0)?", "cddl 1 0"),
    "eupl-1.1": ("european union public", "1 1", "eupl 1 1"),
    "eupl-1.2": ("european union public", "1 2", "eupl 1 2"),
    "artistic-1.0": ("artistic", "1(?: 0)?", "artistic 1 0"),
    "artistic-2.0": ("artistic", "2(?: 0)?", "artistic 2 0"),
    "bsl-1.0": ("boost software", "1(?: 0)?", "bsl 1 0"),
    "busl-1.1": ("business source", "1 1", "busl 1 1"),
    "sspl-1.0": ("server side public", "1(?: 0)?", "sspl 1 0"),
    "elastic-2.0": ("elastic", "2(?: 0)?", "elastic 2 0"),
    "zlib": ("(?:zlib|zlib libpng)", "", "zlib"),
    "unlicense": ("(?:unlicense|unlicence)", "", "unlicense"),
    "wtfpl": ("(?:wtfpl|do what the fuck you want to public)", "", "wtfpl"),
    "psf-2.0": ("(?:python software foundation|psf)", "2(?: 0)?", "psf 2 0"),
    "postgresql": ("postgresql", "", "postgresql"),
    "ofl-1.1": ("(?:sil )?open font", "1 1", "ofl 1 1"),
    "odbl-1.0": ("open (?:data commons open )?database", "1(?: 0)?", "odbl 1 0"),
    "ecl-2.0": ("educational community", "2(?: 0)?", "ecl 2 0"),
    "afl-3.0": ("academic free", "3(?: 0)?", "afl 3 0"),
    "ms-pl": ("microsoft public", "", "ms pl"),
    "ms-rl": ("microsoft reciprocal", "", "ms rl"),
    "upl-1.0": ("universal permissive", "1(?: 0)?", "upl 1 0"),
    "vim": ("vim", "", "vim"),
    "openssl": ("openssl", "", "openssl"),
    "ncsa": ("(?:university of illinois ncsa|illinois ncsa|ncsa)(?: open source)?", "", "ncsa"),
    "hpnd": ("historical permission notice", "", "hpnd"),
}
# Creative Commons licenses are named by their conditions and version.
CC_CONDITIONS = {"by": "attribution", "by sa": "attribution sharealike", "by nc": "attribution noncommercial", "by nd": "attribution noderivatives",
                 "by nc sa": "attribution noncommercial sharealike", "by nc nd": "attribution noncommercial noderivatives"}
CC_VERSIONS = ("2 0", "2 5", "3 0", "4 0")
# Statements without a license of their own.
STATEMENTS = {
    "public-domain": r"(?:in|into|to) the public domain|cc0(?: 1 0)?|no rights reserved",
    "all-rights-reserved": r"all rights reserved",
    "proprietary": r"(?:proprietary and confidential|confidential and proprietary|under (?:a |the )?proprietary licen[sc]e)",
}

# Sentences that only the text of the license, or the notice that applies it, holds.
BODIES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("isc", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("0bsd", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "terms and conditions for use reproduction and distribution"),
    ("apache-1.1", "this product includes software developed by the apache software foundation"),
    ("gpl-1.0", "the license agreements of most software companies try to keep users at the mercy of those companies"),
    ("gpl-2.0", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-2.0", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-3.0", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-3.0", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("lgpl-2.0", "this license the library general public license applies to some specially designated free software foundation software"),
    ("lgpl-2.1", "this license the lesser general public license applies to some specially designated software packages"),
    ("lgpl-2.1", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license"),
    ("lgpl-3.0", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3"),
    ("lgpl-3.0", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license"),
    ("agpl-3.0", "the gnu affero general public license is a free copyleft license for software and other kinds of works"),
    ("agpl-3.0", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
    ("epl-1.0", "the accompanying program is provided under the terms of this eclipse public license agreement"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("artistic-2.0", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed"),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement"),
    ("ncsa", "neither the names of its contributors nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("public-domain", "has dedicated the work to the public domain by waiving all"),
]
# Names with their version in one word, or without one.
JOINED = {
    "gpl-1.0": "gplv1|gpl1", "gpl-2.0": "gplv2|gpl2", "gpl-3.0": "gplv3|gpl3", "lgpl-2.0": "lgplv2 0", "lgpl-2.1": "lgplv2 1|lgplv21|lgpl2 1|lgpl21",
    "lgpl-3.0": "lgplv3|lgpl3", "agpl-3.0": "agplv3|agpl3", "apache-2.0": "apachev2|apache2|aslv2|asl 2 0|alv2|apache v2", "apache-1.1": "aslv1 1|asl 1 1",
    "mpl-1.1": "mplv1 1|mpl1 1", "mpl-2.0": "mplv2|mpl2", "epl-1.0": "eplv1", "epl-2.0": "eplv2", "eupl-1.2": "euplv1 2", "cddl-1.0": "cddlv1", "bsl-1.0": "bslv1",
    "bsd": "(?:bsd|berkeley) (?:style )?licen[sc]e|bsd licensed", "unlicense": "the (?:unlicense|unlicence)", "mit": "mit licensed|mit style licen[sc]e", "lgpl": "lgpl licen[sc]e|lgpl licensed",
    "gpl": "gpl licen[sc]e|gpl licensed|gnu gpl|gnu public licen[sc]e", "agpl": "agpl licen[sc]e|agpl licensed", "wtfpl": "wtfpl", "isc": "isc licensed", "cc0-1.0": "cc0 1 0",
}
# Main addresses of license texts, as words.
SITES = {
    "apache-2.0": "apache org licenses license 2 0", "apache-1.1": "apache org licenses license 1 1", "gpl-2.0": "gnu org licenses (?:old licenses )?gpl 2 0",
    "gpl-3.0": "gnu org licenses gpl 3 0", "gpl": "gnu org (?:licenses|copyleft) gpl", "lgpl-2.1": "gnu org licenses (?:old licenses )?lgpl 2 1", "lgpl-3.0": "gnu org licenses lgpl 3 0",
    "lgpl": "gnu org (?:licenses|copyleft) lgpl", "agpl-3.0": "gnu org licenses agpl(?: 3 0)?", "gfdl-1.3": "gnu org licenses fdl(?: 1 3)?", "mpl-1.1": "mozilla org mpl (?:1 1|mpl 1 1)",
    "mpl-2.0": "mozilla org (?:en us )?mpl 2 0", "epl-1.0": "eclipse org (?:org documents|legal) epl v10", "epl-2.0": "eclipse org (?:org documents|legal) epl (?:2 0|v20)",
    "bsl-1.0": "boost org license 1 0", "unlicense": "unlicense org", "wtfpl": "wtfpl net", "zlib": "zlib net zlib license", "ofl-1.1": "scripts sil org ofl",
    "cc0-1.0": "creativecommons org publicdomain zero 1 0", "mit": "opensource org license mit", "artistic-2.0": "perlfoundation org artistic license 2 0", "postgresql": "postgresql org about licen[sc]e",
}
# Fields of package files: "license" and a short name; and lists, of which each name counts.
FIELDS = {
    "mit": "mit", "isc": "isc", "apache-2.0": "apache 2(?: 0)?", "bsd-2-clause": "bsd 2 clause", "bsd-3-clause": "bsd 3 clause", "bsd": "bsd", "gpl-2.0": "gpl 2 0", "gpl-3.0": "gpl 3 0",
    "lgpl-2.1": "lgpl 2 1", "lgpl-3.0": "lgpl 3 0", "agpl-3.0": "agpl 3 0", "mpl-2.0": "mpl 2 0", "unlicense": "(?:unlicense|unlicence)", "0bsd": "0bsd", "zlib": "zlib", "cc0-1.0": "cc0 1 0", "wtfpl": "wtfpl",
}
LISTED = {
    "mit": "mit (?:and|or) (?:the )?apache|(?:apache|apache 2 0|apache 2) (?:and|or) (?:the )?mit",
    "bsd": "bsd (?:and|or) (?:the )?(?:apache|gpl|lgpl|mpl)|(?:apache|apache 2 0|apache 2|gpl|lgpl|mpl) (?:and|or) (?:the )?bsd",
}

IDENTIFIER, NOTICE, ADDRESS, TITLE, BARE = range(5, 0, -1)
CONFIDENCE = {IDENTIFIER: 1.0, NOTICE: 0.95, ADDRESS: 0.9, TITLE: 0.8, BARE: 0.6}
#: Score of a phrase that no rule covers.
PHRASE_SCORE = 0.75

_UNDER = r"(?:licen[sc]ed|released|distributed|available|provided|published|covered|offered|redistribute it) under (?:the terms of )?(?:the )?"


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keywords: tuple[str, ...]
    pattern: str
    #: How the word behind a place must not begin.
    unless: str = ""

    @property
    def regex(self) -> str:
        return self.pattern if not self.unless else f"(?:{self.pattern})(?! {self.unless})"


_TOKEN = re.compile(r"\(\?:|\[(\w+)\]|.")


def spelled(pattern: str) -> list[str]:
    """All texts that a pattern of letters, letter classes, groups, ``|`` and ``?`` matches."""
    tokens = list(_TOKEN.finditer(pattern))[::-1]

    def alternatives() -> list[str]:
        out, texts = [], [""]
        while tokens and tokens[-1][0] != ")":
            token = tokens.pop()
            if token[0] == "|":
                out, texts = out + texts, [""]
                continue
            piece = alternatives() if token[0] == "(?:" else list(token[1] or token[0])
            if token[0] == "(?:":
                tokens.pop()
            if tokens and tokens[-1][0] == "?":
                tokens.pop()
                piece = ["", *piece]
            texts = [text + end for text in texts for end in piece]
        return out + texts

    return alternatives()


def shortest(keywords: Iterable[str]) -> tuple[str, ...]:
    """The keywords that contain no other one."""
    kept: list[str] = []
    for keyword in sorted(set(keywords), key=lambda k: (len(k), k)):
        if not any(k in keyword for k in kept):
            kept.append(keyword)
    return tuple(kept)


def keywords_of(pattern: str, behind: str = " ") -> tuple[str, ...]:
    """What stands, with the space before it and ``behind`` after it, wherever the pattern matches."""
    return shortest(f" {text}{behind}" for text in spelled(pattern))


def rules() -> list[Rule]:
    """All rules, in order of priority; patterns stand between single spaces."""
    out = []
    for label, (name, version, identifier) in LICENSES.items():
        named = keywords_of(name, " " if version else " licen")
        stated = f"(?: licen[sc]e)?(?: (?:version |v ?)?{version})" if version else " licen[sc]e"
        out += [
            Rule(label, IDENTIFIER, (" spdx license identifier ",), f"spdx license identifier {identifier}(?: only| or later)?"),
            Rule(label, NOTICE, named, f"{_UNDER}{name}{stated}"),
            Rule(label, ADDRESS, ("opensource org licen",), f"(?:www )?opensource org licen[sc]es? {identifier}"),
            Rule(label, TITLE, named, f"{name}{stated}"),
        ]
    for short, long in CC_CONDITIONS.items():
        for version in CC_VERSIONS:
            label = f"cc-{short} {version}".replace(" 0", ".0").replace(" 5", ".5").replace(" ", "-")
            name = f"(?:cc {short}|creative commons {long})"
            named = keywords_of(name)
            out += [
                Rule(label, IDENTIFIER, (" spdx license identifier ",), f"spdx license identifier cc {short} {version}"),
                Rule(label, NOTICE, named, f"{_UNDER}{name}(?: licen[sc]e)?(?: version)? {version}(?: international| unported| generic)?"),
                Rule(label, ADDRESS, ("creativecommons org licen",), f"creativecommons org licen[sc]es {short} {version}"),
                Rule(label, TITLE, named, f"{name}(?: licen[sc]e)?(?: version)? {version}"),
            ]
    out += [Rule(label, NOTICE, keywords_of(pattern), pattern) for label, pattern in BODIES]
    out += [Rule(label, ADDRESS, keywords_of(pattern), f"(?:www )?{pattern}") for label, pattern in SITES.items()]
    out += [Rule(label, TITLE, keywords_of(pattern), pattern) for table in (JOINED, LISTED) for label, pattern in table.items()]
    fields = ((label, f"licen[sc]e (?:is )?{name}") for label, name in FIELDS.items())
    # in "a license; mit licenses" the name belongs to what follows
    out += [Rule(label, ADDRESS, keywords_of(pattern), pattern, "licen") for label, pattern in fields]
    out += [Rule(label, BARE, keywords_of(pattern), pattern) for label, pattern in STATEMENTS.items()]
    out += [Rule(label, BARE, keywords_of(phrase), phrase) for phrase, label in PHRASES.items()]
    return sorted(out, key=lambda rule: -rule.priority)


#: Words of the rules that any prose has; no text is looked at for one of these alone.
PROSE = set(
    "about accompanying agreed agreement allowed applicable applies asserted associated available basis companies conditions contents different documentation either"
    " everyone features following force freedom given granted hereby implied incorporates materials mentioning names notice other person permitted program"
    " purpose reserved rights source terms their under unless verbatim version without works world written".split()
)


def gates() -> tuple[str, ...]:
    """Words or keywords of which one stands in every text that any rule matches: words that several keywords share, most
    shared first, then the keywords without such a word. Every one costs a look at every text."""
    left = {keyword for rule in rules() for keyword in rule.keywords}
    chosen = []
    while True:
        shared = Counter(word for keyword in left for word in set(keyword.split()) if len(word) > 4 and word not in PROSE)
        word, times = max(shared.items(), key=lambda kv: (kv[1], kv[0]), default=("", 0))
        if times < 2:
            return shortest([*chosen, *left])
        chosen.append(f" {word}")
        left = {keyword for keyword in left if f" {word}" not in keyword}


def words_of(text: Column) -> Column:
    """Lower-cased words with one space between them and one at either end; without words, one space."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(text, UPPER, UPPER.lower()), SEPARATORS, " ")), F.lit(" "))


def word_count(words: Column) -> Column:
    """Words of a string with a space at either end of each word."""
    spaces = F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit("")))
    return F.when(F.trim(words) == "", F.lit(0)).otherwise(spaces - 1).cast("long")


PLACE = "struct<start: int, end: int, priority: int, label: string>"
#: Pieces of a list that grow by themselves have at least so many entries.
PIECE = 64


def _folded(items: Column, zero: Column, kind: str, step) -> Column:
    """Fold a list into a state and a list of what each step adds: ``zero`` is a struct that the field ``found`` is added to;
    ``step(state, item)`` gives the state and an array to add. Pieces are folded by themselves and then joined, so that what is
    copied grows with the number of items times its square root."""
    size = F.greatest(F.lit(PIECE), F.ceil(F.sqrt(F.size(items))).cast("int"))
    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.size(items) - 1, F.lit(0)) / size).cast("int"))
    none = F.array().cast(f"array<{kind}>")
    state_of = lambda s: F.struct(s["state"].alias("state"), none.alias("found"))

    def one(s: Column, item: Column) -> Column:
        state, more = step(s["state"], item)
        return F.struct(state.alias("state"), F.concat(s["found"], more).alias("found"))

    def piece(s: Column, at: Column) -> Column:
        done = F.aggregate(F.slice(items, at * size + 1, size), state_of(s), one)
        # one evaluation of the piece for both fields
        return F.element_at(
            F.transform(F.array(done), lambda d: F.struct(d["state"].alias("state"), F.concat(s["found"], d["found"]).alias("found"))), 1
        )

    return F.aggregate(starts, F.struct(zero.alias("state"), none.alias("found")), piece, lambda s: s["found"])


def _places(words: Column, rule: Column) -> Column:
    """Start, end, priority and label of each place of a rule, in characters of ``words``."""
    pattern = F.concat(F.lit("(?<= )(?:"), rule["pattern"], F.lit(")(?= )"))
    gaps, hits = F.split(words, pattern, -1), F.regexp_extract_all(words, pattern, F.lit(0))
    # behind the last gap there is no hit
    steps = F.filter(F.zip_with(gaps, hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("hit"))), lambda x: x["hit"].isNotNull())

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["gap"]
        here = F.struct(start.alias("start"), (start + x["hit"]).alias("end"), rule["priority"].alias("priority"), rule["label"].alias("label"))
        return start + x["hit"], F.array(here)

    return _folded(steps, F.lit(0), PLACE, step)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _table() -> Column:
    """All rules as one literal, parsed once: built column by column, it takes seconds."""
    structs = (
        f"named_struct('keywords', array({', '.join(map(_quoted, r.keywords))}), 'pattern', {_quoted(r.regex)}, 'priority', {r.priority}, 'label', {_quoted(r.label)})"
        for r in rules()
    )
    return F.expr(f"array({', '.join(structs)})")


def detections(words: Column) -> Column:
    """Places (start, end, priority, label) that no other place of their priority or a higher one contains, by start."""
    tried = F.filter(_table(), lambda rule: F.exists(rule["keywords"], lambda keyword: F.contains(words, keyword)))
    found = F.flatten(F.transform(tried, lambda rule: _places(words, rule)))
    # those that contain others come first: by start, then from the longest, then from the highest priority
    ordered = F.array_sort(F.transform(found, lambda p: F.struct(p["start"], (-p["end"]).alias("end"), (-p["priority"]).alias("priority"), p["label"])))
    swept = F.transform(ordered, lambda p: F.struct(p["start"], (-p["end"]).alias("end"), (-p["priority"]).alias("priority"), p["label"]))
    levels = range(BARE, IDENTIFIER + 1)
    zero = F.struct(*(F.lit(-1).alias(f"end{n}") for n in levels))

    def step(state: Column, place: Column) -> tuple[Column, Column]:
        higher = F.greatest(F.lit(-1), *(F.when(place["priority"] <= n, state[f"end{n}"]).otherwise(-1) for n in levels))
        ends = (F.when(place["priority"] == n, F.greatest(state[f"end{n}"], place["end"])).otherwise(state[f"end{n}"]).alias(f"end{n}") for n in levels)
        return F.struct(*ends), F.when(higher >= place["end"], F.array().cast(f"array<{PLACE}>")).otherwise(F.array(place))

    # sorted once for all pieces
    return F.element_at(F.transform(F.array(swept), lambda places: _folded(places, zero, PLACE, step)), 1)


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def scan(docs: DataFrame) -> DataFrame:
    """For each row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and the places found as
    ``detections`` (in characters of the text's words, from the space before the first)."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), words_of(F.coalesce(docs["text"], F.lit(""))).alias("words"))
    words = F.col("words")
    gate = F.expr(" OR ".join(f"contains(words, {_quoted(keyword)})" for keyword in gates()))
    none = F.array().cast(f"array<{PLACE}>")
    found = rows.withColumn("gated", gate).withColumn("detections", F.when(F.col("gated"), detections(words)).otherwise(none))

    def places(phrase: str) -> Column:
        return F.when(F.col("gated"), F.regexp_count(words, F.lit(f"(?<= ){re.escape(phrase)}(?= )"))).otherwise(0).cast("long")

    def first(phrase: str) -> Column:
        return word_count(F.concat(F.substring_index(words, f" {phrase} ", 1), F.lit(" ")))

    def last(phrase: str) -> Column:
        after = word_count(F.concat(F.lit(" "), F.substring_index(words, f" {phrase} ", -1)))
        return word_count(words) - after - len(phrase.split())

    counted = found.withColumns({f"n{k}": places(phrase) for k, phrase in enumerate(PHRASES)})
    has = [F.col(f"n{k}") > 0 for k in range(len(PHRASES))]
    firsts = [F.when(h, first(phrase)) for h, phrase in zip(has, PHRASES)]
    lasts = [F.when(h, last(phrase)) for h, phrase in zip(has, PHRASES)]
    base = F.array_compact(F.array(*(F.when(h, label) for h, label in zip(has, PHRASES.values()))))
    own = F.transform("detections", lambda place: place["label"])
    confidence = F.transform("detections", lambda place: F.element_at(F.array(*(F.lit(CONFIDENCE[n]) for n in sorted(CONFIDENCE))), place["priority"]))
    score = F.greatest(F.lit(0.0), F.array_max(confidence), F.when(F.size(base) > 0, PHRASE_SCORE))
    return counted.select(
        "doc_id", word_count(words).alias("n_words"), sum((F.col(f"n{k}") for k in range(1, len(PHRASES))), F.col("n0")).alias("n_base"),
        F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"), _joined(base).alias("base_labels"),
        _joined(F.concat(base, own)).alias("labels"), score.alias("score"), "detections",
    )
