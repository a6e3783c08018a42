"""License scans by ordered signature rules.

Rules are regular expressions in order of priority. A keyword automaton finds out which rules can match a text at all;
only those run. Detections that lie inside one of higher priority, or inside a longer one of the same, are suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gavilla.llm.common import per_process, strings

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}  # A-Z only

# The base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# For each licence its label, the keyword of which every mention holds one (several are divided by |), and a
# pattern of its name (of lower-case text; white space stands for any run of blanks, also in keywords).
NAMES = [
    ("apache-2.0", "apache", r"apache(?: software)? licen[cs]e,? (?:version |v)?2(?:\.0)?|apache[- ]2(?:\.0)?"),
    ("apache-1.1", "apache", r"apache(?: software)? licen[cs]e,? (?:version |v)?1\.1|apache-1\.1"),
    ("apache-1.0", "apache", r"apache(?: software)? licen[cs]e,? (?:version |v)?1\.0|apache-1\.0"),
    ("mit", "mit", r"mit(?:/x11| expat)? licen[cs]e|mit-licen[cs]ed?"),
    ("mit-0", "mit", r"mit no attribution|mit-0"),
    ("x11", "x11|x consortium", r"x11 licen[cs]e|x consortium licen[cs]e"),
    ("bsd-2-clause", "bsd", r"(?:simplified|2-clause|two-clause|freebsd) bsd(?: licen[cs]e)?|bsd 2-clause|bsd-2-clause"),
    ("bsd-3-clause", "bsd", r"(?:new|modified|revised|3-clause|three-clause) bsd(?: licen[cs]e)?|bsd 3-clause|bsd-3-clause"),
    ("bsd-4-clause", "bsd", r"(?:original|4-clause|four-clause) bsd(?: licen[cs]e)?|bsd-4-clause"),
    ("bsd-0-clause", "bsd", r"zero-clause bsd|0bsd|bsd-0-clause"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public licen[cs]e,? (?:version |v)3(?:\.0)?"),
    ("agpl-1.0", "affero", r"affero general public licen[cs]e,? (?:version |v)1(?:\.0)?"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e"),
    ("agpl-3.0", "agpl", r"(?:gnu )?agpl(?:[- ]?v?3(?:\.0)?)(?:-only|-or-later)?"),
    ("lgpl-3.0", "lesser", r"(?:gnu )?lesser general public licen[cs]e,? (?:version |v)3(?:\.0)?"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public licen[cs]e,? (?:version |v)2\.1"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[cs]e"),
    ("lgpl-2.0", "library", r"(?:gnu )?library general public licen[cs]e"),
    ("lgpl-3.0", "lgpl", r"(?:gnu )?lgpl[- ]?v?3(?:\.0)?(?:-only|-or-later|\+)?"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl[- ]?v?2\.1(?:-only|-or-later|\+)?"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public licen[cs]e,? (?:as published by the free software foundation,? )?(?:either )?(?:version |v)3(?:\.0)?"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public licen[cs]e,? (?:as published by the free software foundation,? )?(?:either )?(?:version |v)2(?:\.0)?"),
    ("gpl-1.0", "general public", r"(?:gnu )?general public licen[cs]e,? (?:either )?(?:version |v)1(?:\.0)?"),
    ("gpl", "general public", r"(?:gnu )?general public licen[cs]e"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl[- ]?v?3(?:\.0)?(?:-only|-or-later|\+)?"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl[- ]?v?2(?:\.0)?(?:-only|-or-later|\+)?"),
    ("gpl", "gpl", r"(?:gnu )?gpl"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl"),
    ("agpl", "agpl", r"(?:gnu )?agpl"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation licen[cs]e"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]e,? (?:version |v)?2(?:\.0)?"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e,? (?:version |v)?1\.1"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e"),
    ("mpl-2.0", "mpl", r"mpl[- ]?2(?:\.0)?"),
    ("epl-2.0", "eclipse", r"eclipse public licen[cs]e,?(?: -)? (?:version |v)?2(?:\.0)?"),
    ("epl-1.0", "eclipse", r"eclipse public licen[cs]e,?(?: -)? (?:version |v)?1(?:\.0)?"),
    ("edl-1.0", "eclipse", r"eclipse distribution licen[cs]e"),
    ("cddl-1.0", "common development", r"common development and distribution licen[cs]e"),
    ("cpl-1.0", "common public", r"common public licen[cs]e"),
    ("eupl-1.2", "european union", r"european union public licen[cs]e"),
    ("isc", "isc", r"isc licen[cs]e"),
    ("zlib", "zlib", r"zlib(?:/libpng)? licen[cs]e"),
    ("unlicense", "unlicense", r"the unlicense|unlicense\.org"),
    ("wtfpl", "wtfpl|do what the f", r"wtfpl|do what the f\S+ you want to public licen[cs]e"),
    ("bsl-1.0", "boost", r"boost software licen[cs]e"),
    ("busl-1.1", "business source", r"business source licen[cs]e"),
    ("sspl-1.0", "server side", r"server side public licen[cs]e"),
    ("elastic-2.0", "elastic", r"elastic licen[cs]e"),
    ("artistic-2.0", "artistic", r"artistic licen[cs]e,? (?:version |v)?2(?:\.0)?"),
    ("artistic-1.0", "artistic", r"artistic licen[cs]e"),
    ("psf", "python", r"python software foundation licen[cs]e"),
    ("php-3.01", "php", r"php licen[cs]e"),
    ("ruby", "ruby", r"ruby licen[cs]e"),
    ("ofl-1.1", "open font", r"(?:sil )?open font licen[cs]e"),
    ("ncsa", "ncsa", r"(?:university of illinois/)?ncsa(?: open source)? licen[cs]e"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("afl-3.0", "academic", r"academic free licen[cs]e"),
    ("osl-3.0", "open software", r"open software licen[cs]e"),
    ("odbl-1.0", "open database|odbl", r"open database licen[cs]e|odbl"),
    ("odc-by-1.0", "commons attribution", r"open data commons attribution licen[cs]e"),
    ("pddl-1.0", "public domain dedication", r"public domain dedication and licen[cs]e"),
    ("cc0-1.0", "cc0", r"cc0(?:[- ]1\.0)?(?: universal)?"),
    ("public-domain", "public domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("openrail", "rail", r"(?:creativeml |bigscience )?open ?rail(?:-?[ms]{1,2})?(?: licen[cs]e)?"),
    ("all-rights-reserved", "all rights", r"all rights reserved"),
    ("proprietary", "proprietary", r"proprietary and confidential"),
]
# Creative Commons terms; with versions and spellings they make the rules of that family.
CC_TERMS = {
    "by": "attribution", "by-sa": "attribution[- ]share ?alike", "by-nd": "attribution[- ]no ?deriv(?:ative)?s?",
    "by-nc": "attribution[- ]non-?commercial", "by-nc-sa": "attribution[- ]non-?commercial[- ]share ?alike",
    "by-nc-nd": "attribution[- ]non-?commercial[- ]no ?deriv(?:ative)?s?",
}
CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]
# Identifiers of the SPDX list (in lower case, as texts are read), which name a licence after an SPDX tag, in a
# field or in a grant, but not on their own.
IDENTIFIERS = """
0bsd aal afl-2.1 afl-3.0 agpl-1.0 agpl-3.0 apache-1.0 apache-1.1 apache-2.0 apsl-2.0 artistic-1.0 artistic-2.0 blueoak-1.0.0 bsd-1-clause
bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-4-clause bsl-1.0 busl-1.1 bzip2-1.0.6 cal-1.0 catosl-1.1 cc0-1.0
cddl-1.0 cddl-1.1 cecill-2.0 cecill-2.1 cecill-b cecill-c cern-ohl-p-2.0 cern-ohl-s-2.0 cern-ohl-w-2.0 cpal-1.0 cpl-1.0 curl ecl-2.0
efl-2.0 elastic-2.0 epl-1.0 epl-2.0 eudatagrid eupl-1.1 eupl-1.2 fsfap ftl gfdl-1.1 gfdl-1.2 gfdl-1.3 gpl-1.0 gpl-2.0 gpl-3.0 hpnd icu ijg
ipl-1.0 isc json lgpl-2.0 lgpl-2.1 lgpl-3.0 libpng-2.0 lpl-1.02 lppl-1.3c miros mit mit-0 mit-cmu mit-modern-variant mpl-1.0 mpl-1.1
mpl-2.0 ms-pl ms-rl mulanpsl-2.0 ncsa ngpl nokia nposl-3.0 ntp odbl-1.0 odc-by-1.0 ofl-1.0 ofl-1.1 ogl-uk-3.0 oldap-2.8 openssl
osl-2.1 osl-3.0 parity-7.0.0 pddl-1.0 php-3.0 php-3.01 postgresql psf-2.0 python-2.0 qpl-1.0 ruby sgi-b-2.0 sissl sleepycat spl-1.0
sspl-1.0 tcl ucl-1.0 unicode-dfs-2016 unlicense upl-1.0 vim w3c wtfpl x11 xfree86-1.1 xnet zlib zpl-2.0 zpl-2.1
""".split()
# Sentences of licence texts that tell which one it is, with their label and keyword.
SENTENCES = [
    ("mit", "obtaining a copy", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsl-1.0", "obtaining a copy", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("isc", "with or without fee", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("postgresql", "without a written agreement", r"without fee, and without a written agreement is hereby granted"),
    ("bsd", "source and binary forms", r"redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd-3-clause", "names of its contributors", r"neither the names? of (?:\S+ ){1,12}nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "mentioning features", r"all advertising materials mentioning features or use of this software must display"),
    ("zlib", "must not be misrepresented", r"the origin of this software must not be misrepresented"),
    ("apache-2.0", "in compliance with the", r"you may not use this (?:file|work) except in compliance with the licen[cs]e"),
    ("mpl-2.0", "source code form", r"this source code form is subject to the terms of the mozilla public licen[cs]e, v\. ?2\.0"),
    ("unlicense", "free and unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "verbatim or modified", r"everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document, and changing it is allowed"),
    ("cc0-1.0", "with this deed", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("ofl-1.1", "font software", r"this font software is licen[cs]ed under the sil open font licen[cs]e"),
    ("gpl-3.0", "version 3 of the", r"gnu general public licen[cs]e as published by the free software foundation,? either version 3 of the licen[cs]e"),
    ("gpl-2.0", "version 2 of the", r"gnu general public licen[cs]e as published by the free software foundation; either version 2 of the licen[cs]e"),
]
# Statements around a name, with the confidence of a detection; the first is of the highest priority.
STATEMENTS = [
    ("tag", r"spdx-license-identifier: ?\(?(?:{name})(?![a-z0-9])", 1.0),
    ("grant", r"(?<![a-z0-9])(?:licen[cs]ed|released|distributed|available|provided|published|covered|redistribut\w+|modif\w+)(?: it| them)? under(?: the)?(?: terms(?: and conditions)? of)?(?: the)? (?:{name})(?![a-z0-9])", 0.95),
    ("field", r"(?<![a-z0-9])licen[cs]e ?[:=] ?[\"']?(?:the )?(?:{name})(?![a-z0-9])", 0.9),
    ("mention", r"(?<![a-z0-9])(?:{name})(?![a-z0-9])", 0.6),
]
# The same for identifiers, with what can stand before one, for the gates. An expression after a tag names several
# licences, so there the span is that of the identifier alone.
IDENTIFIER_STATEMENTS = [
    (r"spdx-license-identifier: ?(?:\(*[a-z0-9.+-]+\)* (?:and|or|with) )*\(*(?P<name>{name})", [], 1.0),
    (STATEMENTS[1][1], ["under ", "of ", "the "], 0.95),
    (STATEMENTS[2][1], [":", ": ", "=", "= ", "'", '"', "the "], 0.9),
]
# What may follow an identifier; "mit.edu" is none.
IDENTIFIER_END = r"(?:-only|-or-later|\+)?(?![a-z0-9]|\.[a-z0-9])"
SENTENCE_SCORE = 0.97


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: re.Pattern
    score: float

    def spans(self, lowered: str) -> list[tuple[int, int]]:
        """Its detections: whole matches, or what the pattern calls the name."""
        part = "name" if "name" in self.pattern.groupindex else 0
        return [m.span(part) for m in self.pattern.finditer(lowered)]


def rules() -> list[Rule]:
    """All rules in order of priority: every statement with every name, then identifiers and sentences of licence texts."""
    names, identifiers = list(NAMES), list(IDENTIFIERS)
    for term, words in sorted(CC_TERMS.items(), key=lambda x: -len(x[0])):
        spelled = term.replace("-", "[- ]")
        for version in CC_VERSIONS:
            number = re.escape(version)
            identifiers.append(f"cc-{term}-{version}")
            names.append((f"cc-{term}-{version}", "creative", rf"creative commons {words}(?: \d\.\d)?(?: international| unported)?(?: public)? licen[cs]e,? (?:version |v)?{number}|creative commons {words} {number}|creativecommons\.org/licenses/{term}/{number}"))
            names.append((f"cc-{term}-{version}", "cc", rf"cc[- ]{spelled}[- ]{number}"))
        names.append((f"cc-{term}", "creative", rf"creative commons {words}(?: licen[cs]e)?|creativecommons\.org/licenses/{term}/"))
        names.append((f"cc-{term}", "cc", rf"cc[- ]{spelled}"))
    found = []
    for _, statement, score in STATEMENTS:
        found += [Rule(label, keyword, spaced(statement.format(name=name)), score) for label, keyword, name in names]
    for statement, before, score in IDENTIFIER_STATEMENTS:
        for identifier in identifiers:
            keyword = "|".join(lead + identifier for lead in before) or "spdx-license-identifier"
            pattern = statement.format(name=re.escape(identifier) + IDENTIFIER_END)
            found.append(Rule(identifier, keyword, spaced(pattern), score))
    found += [Rule(label, keyword, spaced(sentence), SENTENCE_SCORE) for label, keyword, sentence in SENTENCES]
    return found


def spaced(pattern: str) -> re.Pattern:
    """The pattern with each blank as any run of white space."""
    return re.compile(pattern.replace(" ?", r"\s?").replace(" ", r"\s+"))


class Scanner:
    """Rules behind their keywords."""

    def __init__(self):
        self.rules = rules()
        self.gates = ahocorasick.Automaton()
        by_keyword: dict[str, list[int]] = {}
        for k, rule in enumerate(self.rules):
            for keyword in rule.keyword.split("|"):
                by_keyword.setdefault(keyword, []).append(k)
        for keyword, ranks in by_keyword.items():
            self.gates.add_word(keyword, (keyword, ranks))
        self.gates.make_automaton()

    def ready(self, lowered: str) -> set[int]:
        """The rules of which a keyword is in the text, each run of white space read as one blank."""
        met, found = set(), set()
        for _, (keyword, ranks) in self.gates.iter(" ".join(lowered.split())):
            if keyword not in met:
                met.add(keyword)
                found.update(ranks)
        return found

    def detect(self, lowered: str) -> list[tuple[int, int, str, float]]:
        """(start, end, label, score) of the detections that stay, by place."""
        spans = []
        for k in self.ready(lowered):
            spans += [(k, start, end) for start, end in self.rules[k].spans(lowered)]
        # A span stays if none that ranks before it holds it. Spans are met by rank; those kept are searched by place.
        spans.sort(key=lambda s: (round(-self.rules[s[0]].score, 2), -(s[2] - s[1]), s[0], s[1]))
        kept: list[tuple[int, int, int]] = []
        taken = Cover()
        for k, start, end in spans:
            if not taken.holds(start, end):
                taken.add(start, end)
                kept.append((k, start, end))
        return sorted((start, end, self.rules[k].label, self.rules[k].score) for k, start, end in kept)


class Cover:
    """Intervals of which none holds another; tells whether a new one lies inside one of them."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def holds(self, start: int, end: int) -> bool:
        # Without containment ends rise with starts, so the last that starts no later reaches farthest.
        at = bisect_right(self.starts, start) - 1
        return at >= 0 and self.ends[at] >= end

    def add(self, start: int, end: int) -> None:
        at = bisect_left(self.starts, start)
        stop = at
        while stop < len(self.ends) and self.ends[stop] <= end:
            stop += 1
        self.starts[at:stop], self.ends[at:stop] = [start], [end]


def base_places(words: list[str]) -> list[tuple[int, str]]:
    """(first word, label) of every place where the words of a base phrase stand one after the other."""
    found = []
    for phrase, label in PHRASES.items():
        wanted = phrase.split()
        at, size = -1, len(wanted)
        while True:
            try:
                at = words.index(wanted[0], at + 1)
            except ValueError:
                break
            if words[at : at + size] == wanted:
                found.append((at, label))
    return sorted(found)


SCHEMA = (
    "struct<n_words: bigint, n_base: bigint, first_word: bigint, last_word: bigint, base_labels: string, labels: string, "
    "score: double, detections: array<struct<start: int, stop: int, label: string, score: double>>>"
)


def scan(text: str | None, scanner: Scanner) -> tuple:
    lowered = (text or "").translate(LOWER)
    words = WORD.findall(lowered)
    # Every base phrase holds one of these words.
    places = base_places(words) if "license" in lowered or "nc" in lowered else []
    found = scanner.detect(lowered)
    base = sorted({label for _, label in places})
    score = max([s for *_, s in found] + [1.0 if places else 0.0])
    return (
        len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(base),
        ",".join(sorted({*base, *(label for _, _, label, _ in found)})), score,
        [{"start": a, "stop": b, "label": label, "score": s} for a, b, label, s in found],
    )


def detect_licences(docs: DataFrame, text: str = "text", out: str = "licence") -> DataFrame:
    """``docs`` with struct ``out``: word counts, base places, labels, score and the detections' spans.

    Narrow: a text never leaves its task, and rules run over whole texts. Null and empty texts have no words, labels are
    empty strings and the score is 0; repeated rows get the same result.
    """

    @F.arrow_udf(SCHEMA)
    def of(texts: pa.Array) -> pa.Array:
        scanner = per_process("licence-scanner", Scanner)
        span = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("label", pa.string()), ("score", pa.float64())])
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]
        columns = list(zip(*(scan(t, scanner) for t in strings(texts)))) or [()] * 8
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return docs.withColumn(out, of(F.col(text).cast("string")))


def licence_labels(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    found = detect_licences(docs.select("doc_id", "text"))
    return found.select(
        "doc_id", *[f"licence.{c}" for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")]
    )
