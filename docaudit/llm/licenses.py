"""License scans with a positional rare-token index (operator 9).

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. Templates (short phrases and
notices) are indexed by word: each word has postings (template, position). The words' document frequencies are
counted over all documents, with partial sums in each task; the counts of the templates' words, which are some
hundred, give their IDF. Each notice has postings for its own words with the highest IDF: ``VOTES`` more than the words
that ``COVER`` lets it lack. In a file, all places of these words are looked up; an occurrence at p and a posting at t
propose the notice at p - t. Neighbouring places pool their proposals: where ``VOTES`` of them lie within ``DRIFT`` words,
the notice is laid there. A notice that stands there thus gets its votes whatever else the file holds, and with up to
``DRIFT`` words put in or left out.

A licence has several forms: a notice, openings of its grant, statements ("licensed under the ...") with each of its names, and its
identifiers. A statement must stand there word for word, as its text is its key phrase.

Phrases must stand there word for word. They are proposed by the rarest of their own words, at all its places, so
none is missed. Notices must hold ``COVER`` of their words in their order, and all their mandatory key phrases.
Templates are a parameter; ``templates`` reads them from a table.

Defined results: a null text counts as an empty one (0 words, no labels, score 0); repeated rows come back alike; rows
without doc_id are scanned too, a doc_id that is no whole number is an error; other columns are ignored; empty tables give no rows. Score: 1 with a phrase, else the
largest covered share of a notice that was found, else 0.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm.common import table

#: A form of a licence: label, text, key phrases that must stand in it. A label may have several.
Form = tuple[str, str, tuple[str, ...]]

COVER = 0.8
VOTES = 3
DRIFT = 8
#: Phrases and the labels they give.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices of public licences, and the key phrases that must stand in them.
NOTICES = {
    "mit": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", ("permission is hereby granted free of charge", "without restriction")),
    "apache-2": ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License", ("apache license version 2",)),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    "gpl": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("gnu general public license",)),
    "lgpl": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    "mpl-2": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    "unlicense": ("This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4",)),
    "cc-by-nc": ("This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License", ("creative commons attribution noncommercial",)),
}

#: Names that statements give licences, and their identifiers. Of Creative Commons licences the version belongs to the name, as one name begins another.
NAMES = {
    "mit": (("MIT License", "MIT Licence", "Expat License"), ("MIT",)),
    "apache-2": (("Apache License Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache Software License"), ("Apache-2.0",)),
    "bsd": (("BSD License", "BSD 3-Clause License", "3-Clause BSD License", "BSD 2-Clause License", "2-Clause BSD License", "New BSD License", "Modified BSD License", "Simplified BSD License"), ("BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "0BSD")),
    "gpl": (("GNU General Public License", "GNU GPL", "GPLv2", "GPLv3", "GPL version", "GNU Public License"), ("GPL-2.0", "GPL-3.0", "GPL-1.0")),
    "lgpl": (("GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL", "LGPLv2", "LGPLv3"), ("LGPL-2.0", "LGPL-2.1", "LGPL-3.0")),
    "agpl": (("GNU Affero General Public License", "Affero General Public License", "GNU AGPL", "AGPLv3"), ("AGPL-3.0", "AGPL-1.0")),
    "gfdl": (("GNU Free Documentation License",), ("GFDL-1.2", "GFDL-1.3")),
    "mpl-2": (("Mozilla Public License",), ("MPL-2.0", "MPL-1.1")),
    "isc": (("ISC License",), ("ISC",)),
    "unlicense": (("Unlicense",), ("Unlicense",)),
    "cc0": (("Creative Commons Zero", "Creative Commons CC0", "CC0 1.0"), ("CC0-1.0",)),
    "cc-by": (("Creative Commons Attribution 4.0", "Creative Commons Attribution 3.0", "Creative Commons Attribution 2.0", "CC BY 4.0", "CC BY 3.0"), ("CC-BY-4.0", "CC-BY-3.0")),
    "cc-by-sa": (("Creative Commons Attribution-ShareAlike", "Creative Commons Attribution Share Alike", "CC BY-SA"), ("CC-BY-SA",)),
    "cc-by-nd": (("Creative Commons Attribution-NoDerivatives", "Creative Commons Attribution-NoDerivs", "CC BY-ND"), ("CC-BY-ND",)),
    "cc-by-nc": (("Creative Commons Attribution-NonCommercial 4.0", "Creative Commons Attribution-NonCommercial 3.0", "CC BY-NC 4.0"), ("CC-BY-NC-4.0", "CC-BY-NC-3.0")),
    "cc-by-nc-sa": (("Creative Commons Attribution-NonCommercial-ShareAlike", "CC BY-NC-SA"), ("CC-BY-NC-SA",)),
    "cc-by-nc-nd": (("Creative Commons Attribution-NonCommercial-NoDerivatives", "Creative Commons Attribution-NonCommercial-NoDerivs", "CC BY-NC-ND"), ("CC-BY-NC-ND",)),
    "epl": (("Eclipse Public License",), ("EPL-1.0", "EPL-2.0")),
    "cddl": (("Common Development and Distribution License",), ("CDDL-1.0", "CDDL-1.1")),
    "cpl": (("Common Public License",), ("CPL-1.0",)),
    "eupl": (("European Union Public Licence", "European Union Public License"), ("EUPL-1.1", "EUPL-1.2")),
    "artistic": (("Artistic License", "Perl Artistic License"), ("Artistic-1.0", "Artistic-2.0")),
    "zlib": (("zlib License", "zlib/libpng License"), ("Zlib",)),
    "boost": (("Boost Software License",), ("BSL-1.0",)),
    "wtfpl": (("Do What The Fuck You Want To Public License", "WTFPL"), ("WTFPL",)),
    "osl": (("Open Software License",), ("OSL-3.0",)),
    "afl": (("Academic Free License",), ("AFL-3.0",)),
    "ofl": (("SIL Open Font License",), ("OFL-1.1",)),
    "psf": (("Python Software Foundation License", "PSF License"), ("PSF-2.0", "Python-2.0")),
    "ms-pl": (("Microsoft Public License",), ("MS-PL",)),
    "ms-rl": (("Microsoft Reciprocal License",), ("MS-RL",)),
    "postgresql": (("PostgreSQL License",), ("PostgreSQL",)),
    "openssl": (("OpenSSL License",), ("OpenSSL",)),
    "php": (("PHP License",), ("PHP-3.0", "PHP-3.01")),
    "ruby": (("Ruby License",), ("Ruby",)),
    "ncsa": (("University of Illinois/NCSA Open Source License",), ("NCSA",)),
    "odbl": (("Open Database License", "Open Data Commons Open Database License"), ("ODbL-1.0",)),
    "upl": (("Universal Permissive License",), ("UPL-1.0",)),
    "cecill": (("CeCILL License", "CeCILL Free Software License"), ("CECILL-2.0", "CECILL-2.1", "CECILL-B", "CECILL-C")),
}
#: What stands before the name of a licence in a statement, and before an identifier.
STATEMENTS = ("licensed under the", "licensed under a", "licensed under", "released under the", "released under", "distributed under the", "available under the", "governed by the", "under the terms of the", "subject to the terms of the", "covered by the")
IDENTIFIERS = ("SPDX-License-Identifier:",)
#: Openings of full grants, with the key phrases that must stand in them.
OPENINGS = (
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", ("redistribution and use in source and binary forms with or without modification",)),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program", ("a copy of the gnu general public license",)),
    ("lgpl", "You should have received a copy of the GNU Lesser General Public License along with this library", ("a copy of the gnu lesser general public license",)),
    ("agpl", "You should have received a copy of the GNU Affero General Public License along with this program", ("a copy of the gnu affero general public license",)),
    ("agpl", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("gnu affero general public license as published",)),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("person or organization obtaining a copy",)),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable",)),
    ("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed", ("changing it is allowed as long as the name is changed",)),
)


def statements() -> list[Form]:
    """A form for each statement or identifier with each name: it must stand there word for word."""
    out = [(label, f"{before} {name}") for label, (names, _) in NAMES.items() for name in names for before in STATEMENTS]
    out += [(label, f"{before} {name}") for label, (_, ids) in NAMES.items() for name in ids for before in IDENTIFIERS]
    return [(label, text, (text,)) for label, text in out]


def listed(notices: dict[str, tuple[str, tuple[str, ...]]] | list[Form]) -> list[Form]:
    """Forms as a list; of a dictionary each label has one."""
    return [(label, text, tuple(keys)) for label, (text, keys) in sorted(notices.items())] if isinstance(notices, dict) else list(notices)


def known_forms() -> list[Form]:
    """The notices, openings and statements that this module knows."""
    return [*listed(NOTICES), *OPENINGS, *statements()]


#: Bytes that may stand in a word (digits, a-z, all above ASCII) stay, A-Z become a-z, others a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def lacking(n: int) -> int:
    """How many of its n words a notice may lack."""
    return next((m for m in range(n, 0, -1) if (n - m) / n >= COVER), 0)


def pooled(starts: list[int], votes: int) -> Iterator[tuple[int, int]]:
    """(first, last) of the runs of ``starts`` that hold ``votes`` of them or more within ``DRIFT`` words."""
    starts = sorted(starts)
    lo = 0
    for hi, start in enumerate(starts):
        while start - starts[lo] > DRIFT:
            lo += 1
        # a run is given once, when the next start lies too far off to belong to it
        if hi - lo + 1 >= votes and (hi + 1 == len(starts) or starts[hi + 1] - starts[lo] > DRIFT):
            yield starts[lo], start


def in_order(notice: list[bytes], window: list[bytes]) -> int:
    """How many words of the notice stand in the window in their order (longest common subsequence)."""
    row = [0] * (len(notice) + 1)
    for w in window:
        last = 0
        for i, n in enumerate(notice, 1):
            kept = row[i]
            if w == n:
                row[i] = last + 1
            elif row[i - 1] > kept:
                row[i] = row[i - 1]
            last = kept
    return row[-1]


def templates(table: DataFrame) -> list[Form]:
    """Forms from a table of label, text and keys (array of key phrases). One row for each form comes to the driver."""
    return sorted((r["label"], r["text"], tuple(r["keys"] or ())) for r in table.select("label", "text", "keys").collect())


class Index:
    """Postings of the phrases' and notices' rarest words."""

    def __init__(self, idf: dict[bytes, float], phrases: dict[str, str], notices: dict | list[Form]):
        self.idf = idf
        self.anchors: dict[bytes, list[tuple[list[bytes], int, str]]] = defaultdict(list)
        for phrase, label in phrases.items():
            words = words_of(phrase)
            at = max(range(len(words)), key=lambda i: (idf[words[i]], -i))
            self.anchors[words[at]].append((words, at, label))
        self.notices = [(label, words_of(text), [words_of(k) for k in keys]) for label, text, keys in listed(notices) if words_of(text)]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, words, _) in enumerate(self.notices):
            rarest = sorted(range(len(words)), key=lambda i: (-idf[words[i]], words[i], i))
            for at in rarest[: lacking(len(words)) + VOTES]:
                self.postings[words[at]].append((n, at))
        self.looked_up = self.anchors.keys() | self.postings.keys()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], dict[str, float]]:
        """Places of phrases (first word, label), and the covered shares of the notices found."""
        places: dict[bytes, list[int]] = defaultdict(list)
        looked_up = self.looked_up
        if looked_up.isdisjoint(words):
            return [], {}
        for i, w in enumerate(words):
            if w in looked_up:
                places[w].append(i)
        base = []
        for anchor, phrases in self.anchors.items():
            for i in places.get(anchor, ()):
                for phrase, at, label in phrases:
                    if i >= at and words[i - at : i - at + len(phrase)] == phrase:
                        base.append((i - at, label))
        starts: dict[int, list[int]] = defaultdict(list)
        for w, postings in self.postings.items():
            if w in places:
                for n, at in postings:
                    starts[n] += [i - at for i in places[w]]
        found: dict[str, float] = {}
        for n, proposed in starts.items():
            label, notice, keys = self.notices[n]
            for lo, hi in pooled(proposed, min(VOTES, len(notice))):
                window = words[max(0, lo) : hi + len(notice)]
                spaced = b" " + b" ".join(window) + b" "
                if found.get(label, 0) < 1 and all(b" " + b" ".join(k) + b" " in spaced for k in keys):
                    cover = in_order(notice, window) / len(notice)
                    if cover >= COVER:
                        found[label] = max(found.get(label, 0), cover)
        return sorted(base), found


def vocabulary(phrases: dict[str, str], notices: dict | list[Form]) -> set[bytes]:
    return {w for t in [*phrases, *(text for _, text, _ in listed(notices))] for w in words_of(t)}


def document_frequencies(docs: DataFrame, words: set[bytes], text: str = "text") -> tuple[int, dict[bytes, int]]:
    """Number of documents, and of those that hold each of the templates' words, over whole texts of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        total = 0
        for batch in batches:
            total += batch.num_rows
            for t in batch.column(0):
                seen.update(words.intersection(words_of(t.as_py())))
        rows = [("", total), *((w.decode("utf-8"), n) for w, n in seen.items())]
        yield pa.record_batch([pa.array([w for w, _ in rows]), pa.array([n for _, n in rows], pa.int64())], names=["word", "n"])

    counts = docs.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    got = {r["word"].encode("utf-8"): r["n"] for r in counts.collect()}  # one row for each word of the templates at most
    return got.pop(b"", 0), got


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, notices: dict | list[Form] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row."""
    phrases, notices = PHRASES if phrases is None else phrases, known_forms() if notices is None else notices
    words = vocabulary(phrases, notices)
    total, counts = document_frequencies(docs, words)
    idf = {w: math.log((total + 1) / (counts.get(w, 0) + 1)) for w in words}
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    schema = pa.schema([("k", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value, phrases, notices)
        for batch in batches:
            out = []
            for k, t in zip(batch.column(0), batch.column(1)):
                found = words_of(t.as_py())
                base, more = index.scan(found)
                own = {label for _, label in base}
                out.append((k.as_py(), len(found), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(own)), ",".join(sorted(own | more.keys())), 1.0 if base else max(more.values(), default=0.0)))
            yield pa.record_batch([pa.array([r[i] for r in out], schema.field(i).type) for i in range(8)], schema=schema)

    kind = docs.schema["doc_id"].dataType
    rows = docs.select(F.col("doc_id").cast("long").alias("k"), "text").mapInArrow(run, "k long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
    return rows.select(F.col("k").cast(kind).alias("doc_id"), *rows.columns[1:])


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
