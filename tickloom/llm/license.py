"""License scans by ordered signature rules.

A rule is a regular expression over a text's lower-cased words, joined by single blanks, with a label,
a priority and keywords, one of which must be in the text before the expression runs. Detections are
word intervals. A detection that lies within one of a higher priority, or within a longer or earlier
one of its own, is suppressed; others stay, also where they overlap in part.

The rules are made from hand-written names of licenses and hand-written forms of referring to one
(``FORMS``), plus single rules for notices. Three phrases are a fixed base whose labels always stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .text import arrow_map, slices

#: The phrases every scan reports, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: label, name, short name (regexes over blank-joined words), keyword; hand-written.
LICENSES = (
    ("mit", r"mit license|the mit license|expat license", r"mit|expat", "mit|expat"),
    ("mit-0", r"mit no attribution license", r"mit 0", "mit"),
    ("apache-1.1", r"apache software license version 1 1", r"apache 1 1", "apache"),
    ("apache-2.0", r"apache license(?: version)? 2(?: 0)?|apache software license 2 0", r"apache 2(?: 0)?|asl 2 0", "apache|asl"),
    ("apache", r"apache (?:software )?license", r"apache", "apache"),
    ("bsd-2-clause", r"(?:simplified|freebsd|2 clause|two clause) bsd license|bsd 2 clause license", r"bsd 2 clause|2 clause bsd", "bsd"),
    ("bsd-3-clause", r"(?:new|modified|revised|3 clause|three clause) bsd license|bsd 3 clause license", r"bsd 3 clause|3 clause bsd", "bsd"),
    ("bsd-4-clause", r"(?:original|4 clause|four clause) bsd license|bsd 4 clause license", r"bsd 4 clause|4 clause bsd", "bsd"),
    ("0bsd", r"zero clause bsd license|bsd zero clause license", r"0bsd", "bsd"),
    ("bsd", r"bsd (?:style )?license", r"bsd", "bsd"),
    ("isc", r"isc license|internet systems consortium license", r"isc", "isc|internet systems"),
    ("gpl-1.0", r"general public license (?:version |v ?)1(?: 0)?", r"gpl ?v?1(?: 0)?(?: only| or later)?|gplv1", "gpl|general"),
    ("gpl-2.0", r"general public license (?:version |v ?)2(?: 0)?", r"gpl ?v?2(?: 0)?(?: only| or later)?|gplv2", "gpl|general"),
    ("gpl-3.0", r"general public license (?:version |v ?)3(?: 0)?", r"gpl ?v?3(?: 0)?(?: only| or later)?|gplv3", "gpl|general"),
    ("lgpl-2.0", r"library general public license(?: version 2(?: 0)?)?", r"lgpl ?v?2(?: 0)?(?: only| or later)?", "lgpl|library"),
    ("lgpl-2.1", r"lesser general public license (?:version |v ?)2 1", r"lgpl ?v?2 1(?: only| or later)?", "lgpl|lesser"),
    ("lgpl-3.0", r"lesser general public license (?:version |v ?)3(?: 0)?", r"lgpl ?v?3(?: 0)?(?: only| or later)?", "lgpl|lesser"),
    ("lgpl", r"lesser general public license", r"lgpl", "lgpl|lesser"),
    ("agpl-3.0", r"affero general public license(?: version 3(?: 0)?| v3)?", r"agpl ?v?3?(?: 0)?(?: only| or later)?", "agpl|affero"),
    ("gpl", r"gnu general public license|gnu gpl", r"gpl", "gpl|gnu"),
    ("gfdl", r"(?:gnu )?free documentation license(?: version 1 [123])?", r"gfdl(?: 1 [123])?", "gfdl|free documentation"),
    ("mpl-1.1", r"mozilla public license(?: version)? 1 1", r"mpl 1 1", "mpl|mozilla"),
    ("mpl-2.0", r"mozilla public license(?: version| v)? ?2(?: 0)?", r"mpl ?v?2(?: 0)?", "mpl|mozilla"),
    ("mpl", r"mozilla public license", r"mpl", "mpl|mozilla"),
    ("epl-1.0", r"eclipse public license(?: version| v)? 1(?: 0)?", r"epl 1 0", "epl|eclipse"),
    ("epl-2.0", r"eclipse public license(?: version| v)? 2(?: 0)?", r"epl 2 0", "epl|eclipse"),
    ("cddl", r"common development and distribution license(?: version)?(?: 1 [01])?", r"cddl(?: 1 [01])?", "cddl|common development"),
    ("cpl", r"common public license(?: version)?(?: 1 0)?", r"cpl(?: 1 0)?", "cpl|common public"),
    ("eupl", r"european union public licen[cs]e(?: version)?(?: 1 [12])?", r"eupl(?: 1 [12])?", "eupl|european"),
    ("artistic", r"artistic license(?: version)?(?: [12] 0)?", r"artistic(?: [12] 0)?", "artistic"),
    ("zlib", r"zlib(?: libpng)? license", r"zlib", "zlib"),
    ("boost", r"boost software license(?: version)?(?: 1 0)?", r"bsl 1 0", "boost|bsl"),
    ("unlicense", r"the unlicense|unlicense org", r"unlicense", "unlicense"),
    ("wtfpl", r"do what the [a-z]+ you want to public license", r"wtfpl", "wtfpl|do what"),
    ("python", r"python software foundation license(?: version 2)?", r"psf(?: 2 0)?|python 2 0", "python|psf"),
    ("ruby", r"ruby license", r"ruby", "ruby"),
    ("php", r"php license(?: version)?(?: 3 01?)?", r"php 3 01?", "php"),
    ("postgresql", r"postgresql licen[cs]e", r"postgresql", "postgresql"),
    ("openssl", r"openssl license", r"openssl", "openssl"),
    ("ofl", r"(?:sil )?open font license(?: version)?(?: 1 1)?", r"ofl(?: 1 1)?", "ofl|open font"),
    ("cecill", r"cecill(?: [bc])? licen[cs]e", r"cecill(?: [bc])?(?: 2 [01])?", "cecill"),
    ("ms-pl", r"microsoft public license", r"ms pl", "microsoft|ms pl"),
    ("odbl", r"open (?:data commons open )?database license", r"odbl(?: 1 0)?", "odbl|database license"),
    ("cc0", r"creative commons zero(?: 1 0)?(?: universal)?", r"cc0(?: 1 0)?", "cc0|creative commons zero"),
    ("cc-by-sa", r"creative commons attribution share ?alike(?: [1-4] [05])?", r"cc by sa(?: [1-4] [05])?", "cc by|creative commons"),
    ("cc-by-nc", r"creative commons attribution non ?commercial(?: [1-4] [05])?", r"cc by nc(?: [1-4] [05])?", "cc by|creative commons"),
    ("cc-by-nd", r"creative commons attribution no ?deriv(?:ative|ative work)?s(?: [1-4] [05])?", r"cc by nd(?: [1-4] [05])?", "cc by|creative commons"),
    ("cc-by-nc-sa", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?", r"cc by nc sa(?: [1-4] [05])?", "cc by|creative commons"),
    ("cc-by-nc-nd", r"creative commons attribution non ?commercial no ?derivs(?: [1-4] [05])?", r"cc by nc nd(?: [1-4] [05])?", "cc by|creative commons"),
    ("cc-by", r"creative commons attribution(?: [1-4] [05])?(?: international| unported)?", r"cc by(?: [1-4] [05])?", "cc by|creative commons"),
    ("cc", r"creative commons licen[cs]e", r"creativecommons org licenses", "creative commons|creativecommons"),
)

#: priority, template over a license's name (N) and short name (S).
FORMS = (
    (6, r"spdx license identifier (?:{S})"),
    (5, r"licensed under (?:the )?(?:terms of (?:the )?)?(?:{N}|{S})(?: licen[cs]e)?"),
    (5, r"(?:released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?(?:{N}|{S})(?: licen[cs]e)?"),
    (4, r"(?:opensource|spdx|creativecommons|gnu|apache) org licenses (?:{S})"),
    (3, r"{N}"),
    (2, r"licen[cs]e (?:{S})|(?:{S}) licen[cs]e"),
)

#: label, priority, expression, keyword; hand-written.
NOTICES = (
    ("reserved", 1, r"all rights reserved", "reserved"),
    ("gpl", 1, r"general public license", "general public"),
    ("cc-by", 1, r"cc by", "cc by"),
    ("copyright", 2, r"copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})*", "copyright"),
    ("copyright", 1, r"(?:c|copyright) (?:19|20)[0-9]{2} [^ ]+", " c 19| c 20|copyright"),
    ("proprietary", 4, r"proprietary and confidential|confidential and proprietary", "confidential"),
    ("proprietary", 4, r"unauthorized (?:copying|use|reproduction) (?:of this [^ ]+ )?is (?:strictly )?prohibited", "unauthorized"),
    ("proprietary", 3, r"no part of this [^ ]+ may be reproduced", "reproduced"),
    ("public-domain", 4, r"(?:released|dedicated|placed) (?:in|in to|into|to) the public domain", "public domain"),
    ("public-domain", 2, r"public domain", "public domain"),
    ("mit", 5, r"permission is hereby granted free of charge to any person obtaining a copy", "hereby granted"),
    ("isc", 5, r"permission to use copy modify and or distribute this software for any purpose", "permission to use"),
    ("bsd", 5, r"redistribution and use in source and binary forms with or without modification", "redistribution"),
    ("gpl", 5, r"this program is free software you can redistribute it and or modify it", "free software"),
    ("warranty", 3, r"without warranty of any kind(?: express or implied)?", "warranty"),
    ("warranty", 3, r"provided as is", "provided as is"),
    ("eula", 3, r"end user licen[cs]e agreement", "end user"),
    ("noncommercial", 2, r"non ?commercial use only|for non ?commercial use", "commercial"),
    ("copyleft", 2, r"copyleft", "copyleft"),
    ("attribution", 2, r"attribution required|must give (?:appropriate )?credit", "attribution"),
    ("license-url", 2, r"licen[cs]e (?:url|link) https?", "http"),
    ("see-license", 2, r"see (?:the )?(?:license|licence|copying)(?: file)?(?: for details)?", "see"),
)


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    expression: re.Pattern[bytes]
    keywords: tuple[bytes, ...]


def rules() -> list[Rule]:
    """Every rule in order; where priority and length tie, the earlier one stays."""
    made = [(label, priority, form.replace("{N}", f"(?:{name})").replace("{S}", short), key) for priority, form in FORMS for label, name, short, key in LICENSES]
    return [Rule(label, priority, re.compile(rb"(?<= )(?:" + expression.encode() + rb")(?= )"), tuple(k.encode() for k in key.split("|"))) for label, priority, expression, key in [*made, *NOTICES]]


RULES = rules()
#: Without one of these no rule can match: each rule's expression needs one, so most texts stop here.
GATES = tuple(dict.fromkeys(k for r in RULES for k in r.keywords))
WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
PLACES = {label: re.compile(b"(?= " + phrase.encode() + b" )") for phrase, label in BASE.items()}


def suppress(found: list[tuple[int, int, int, int]]) -> list[int]:
    """Of detections (start, end, priority, rule), the positions of those that stay."""
    stay: list[int] = []
    above_start, above_end = np.empty(0, np.int64), np.empty(0, np.int64)
    for level in sorted({f[2] for f in found}, reverse=True):
        own = sorted((k for k, f in enumerate(found) if f[2] == level), key=lambda k: (found[k][0], -found[k][1], found[k][3]))
        reach, kept = -1, []
        for k in own:
            start, end = found[k][:2]
            at = np.searchsorted(above_start, start, side="right") - 1
            if end <= reach or (at >= 0 and above_end[at] >= end):
                continue
            reach = end
            kept.append(k)
        stay += kept
        start = np.concatenate([above_start, [found[k][0] for k in kept]]).astype(np.int64)
        end = np.concatenate([above_end, [found[k][1] for k in kept]]).astype(np.int64)
        order = np.argsort(start, kind="stable")
        above_start, above_end = start[order], np.maximum.accumulate(end[order]) if len(order) else end
    return stay


def scan(text: bytes) -> tuple[int, int, int | None, int | None, str, str, float, list[tuple[int, int, str]]]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score and the detections (start, end, label)."""
    words = text.lower().translate(WORDS).split()
    n = len(words)
    joined = b" " + b" ".join(words) + b" "
    gates = {g for g in GATES if g in joined}
    if not gates:
        return n, 0, None, None, "", "", 0.0, []
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)
    base, base_labels = [], set()
    for label, place in PLACES.items():
        at = [m.start() for m in place.finditer(joined)]
        if at:
            base_labels.add(label)
            base += np.searchsorted(blanks, at).tolist()
    found = []
    for k, rule in enumerate(RULES):
        if any(w in gates for w in rule.keywords):
            found += [(int(np.searchsorted(blanks, m.start() - 1)), int(np.searchsorted(blanks, m.end())), rule.priority, k) for m in rule.expression.finditer(joined)]
    stay = [found[k] for k in suppress(found)]
    spans = sorted((s, e, RULES[k].label) for s, e, _, k in stay)
    covered = reach = 0
    for s, e, _ in spans:
        covered += max(0, e - max(s, reach))
        reach = max(reach, e)
    labels = base_labels | {s[2] for s in spans}
    return n, len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), min(1.0, covered / n) if n else 0.0, spans


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start: long, end: long, label: string>>"
SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())])


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document: its words, the base places, labels, the share of words covered, and spans.

    A null or empty text has no words, no labels and score 0. Words are counted from 0 over the whole
    text. Repeated rows and null ids get a row each; extra columns are ignored. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [scan(t) for t in pc.fill_null(part.column("text"), "").cast(pa.binary()).to_pylist()]
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()))]
                spans = pa.array([[{"start": s, "end": e, "label": x} for s, e, x in r[7]] for r in rows], pa.list_(SPAN))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *columns, spans], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return arrow_map(docs.select("doc_id", "text"), run, SCHEMA)
