"""Licences by sentence rules, in DataFrame functions only.

A text is normalised and cut into sentences, each sentence mapped to the number
of the known licence sentence it equals (0: unknown), and the run of numbers is
matched against rules: sentences of a licence that follow one another. Texts are
cut twice, with line ends as sentence ends (notices on their own lines) and as
spaces (wrapped paragraphs, which end at lines without a letter or digit and at
copyright lines). List marks and bare numbers are no sentences of a run. Known
sentences are cut as texts are, so one may have several numbers. Everything
happens within the row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm.words import text_or_empty

#: Sentences of public licence texts and notices, by name; normalised before use.
SENTENCES = {
    "mit-notice": "Released under the MIT License.",
    "mit-notice-2": "Licensed under the MIT License.",
    "mit-notice-3": "This project is licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice-kept": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-notice-2": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-limits": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software:",
    "gpl-free-2": "This program is free software;",
    "gpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",
    "gpl2-version": "either version 2 of the License, or (at your option) any later version.",
    "ccbync-notice": "Licensed under CC BY-NC 4.0.",
    "ccby-notice": "Licensed under CC BY 4.0.",
    "ccbysa-notice": "Licensed under CC BY-SA 4.0.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

#: A licence and, in order, the known sentences that announce it.
RULES = (
    ("Apache-2.0", ("apache-notice",)),
    ("Apache-2.0", ("apache-notice-2", "apache-limits")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("CC-BY-4.0", ("ccby-notice",)),
    ("CC-BY-NC-4.0", ("ccbync-notice",)),
    ("CC-BY-SA-4.0", ("ccbysa-notice",)),
    ("GPL-2.0-or-later", ("gpl-free-2", "gpl2-terms", "gpl2-version")),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl3-terms")),
    ("ISC", ("isc-grant",)),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-notice-2",)),
    ("MIT", ("mit-notice-3",)),
    ("MIT", ("mit-grant", "mit-notice-kept", "mit-warranty", "mit-liability")),
    ("MPL-2.0", ("mpl-notice",)),
    ("Unlicense", ("unlicense",)),
)
#: Further sentences, which the SQL twin does not know.
MORE_SENTENCES = {
    "mit-notice-kept-2": "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software.",
    "mit-zero-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc-grant-2": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-names-2": "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "apache-title": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "apache-title-2": "Apache License Version 2.0, January 2004 https://www.apache.org/licenses/",
    "gpl2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl21-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl3-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "agpl3-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "gpl2-only-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl2-only-terms-2": "you can redistribute it and/or modify it under the terms of version 2 of the GNU General Public License as published by the Free Software Foundation.",
    "gpl2-terms-comma": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
    "gpl3-version": "either version 3 of the License, or (at your option) any later version.",
    "gpl3-only-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3.",
    "lgpl-free": "This library is free software;",
    "lgpl-terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;",
    "lgpl21-version": "either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-terms-2": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    "mpl-title": "Mozilla Public License Version 2.0",
    "epl2-title": "Eclipse Public License - v 2.0",
    "boost-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "cc0-title": "CC0 1.0 Universal",
    "ccby-title": "Creative Commons Attribution 4.0 International Public License",
    "ccby-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "ccbysa-title": "Creative Commons Attribution-ShareAlike 4.0 International Public License",
    "ccbysa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "ccbync-title": "Creative Commons Attribution-NonCommercial 4.0 International Public License",
    "ccbync-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
}

#: Further rules, as above.
MORE_RULES = (
    ("0BSD", ("0bsd-grant",)),
    ("AGPL-3.0-only", ("agpl3-title",)),
    ("AGPL-3.0-or-later", ("gpl-free", "agpl3-terms")),
    ("AGPL-3.0-or-later", ("gpl-free", "agpl3-terms-2")),
    ("Apache-2.0", ("apache-title",)),
    ("Apache-2.0", ("apache-title-2",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names-2")),
    ("BSL-1.0", ("boost-title",)),
    ("CC-BY-4.0", ("ccby-title",)),
    ("CC-BY-4.0", ("ccby-work",)),
    ("CC-BY-NC-4.0", ("ccbync-title",)),
    ("CC-BY-NC-4.0", ("ccbync-work",)),
    ("CC-BY-SA-4.0", ("ccbysa-title",)),
    ("CC-BY-SA-4.0", ("ccbysa-work",)),
    ("CC0-1.0", ("cc0-title",)),
    ("EPL-2.0", ("epl2-title",)),
    ("GPL-2.0-only", ("gpl2-title",)),
    ("GPL-2.0-only", ("gpl-free", "gpl2-only-terms")),
    ("GPL-2.0-only", ("gpl-free", "gpl2-only-terms-2")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl2-terms-comma")),
    ("GPL-3.0-only", ("gpl3-title",)),
    ("GPL-3.0-only", ("gpl-free", "gpl3-only-terms")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl2-terms", "gpl3-version")),
    ("ISC", ("isc-grant-2",)),
    ("LGPL-2.1-only", ("lgpl21-title",)),
    ("LGPL-2.1-or-later", ("lgpl-free", "lgpl-terms", "lgpl21-version")),
    ("LGPL-3.0-only", ("lgpl3-title",)),
    ("LGPL-3.0-or-later", ("gpl-free", "lgpl3-terms")),
    ("LGPL-3.0-or-later", ("lgpl-free", "lgpl3-terms")),
    ("MIT", ("mit-grant", "mit-notice-kept-2", "mit-warranty", "mit-liability")),
    ("MIT-0", ("mit-zero-grant",)),
    ("MPL-2.0", ("mpl-title",)),
    ("Zlib", ("zlib-grant",)),
)
#: A licence named here is left out when the longer one is found.
CONTAINED = {"BSD-2-Clause": "BSD-3-Clause"}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Patterns that both engines read alike. The mark between sentences is the sign U+0001.
LINE_END, SENTENCE_END = r"\n", r"[.!?;:]([\x20\x09-\x0D]|\z)"
NOT_WORD = r"[^a-z0-9\x01]+"
MARK = "\x01"
#: A line end before a line without a letter or digit, and a copyright line; both end a paragraph.
BLANK_LINE = r"\n(?=[^A-Za-z0-9\n]*+(\n|\z))"
COPYRIGHT_LINE = r"(?i)(^|\n)[^A-Za-z0-9\n]*+copyright[\x20\t]+(\(c\)|\u00a9|[0-9]{4})[^\n]*+"
#: A bare number or letter, or the "and" or "or" of a list, alone or before the words of a sentence.
LIST_MARK = r"(^|\x01)\x20?((and|or)(\x20([0-9]{1,3}|[a-z]))?|[0-9]{1,3}|[a-z])(?=\x20?(\x01|\z)|\x20[a-z])"


def _marked(text: Column, by_line: bool) -> Column:
    """Normalised text with a mark after each sentence."""
    if not by_line:
        text = F.regexp_replace(F.regexp_replace(text, COPYRIGHT_LINE, MARK), BLANK_LINE, MARK)
    ends = F.regexp_replace(text, SENTENCE_END, MARK)
    if by_line:
        ends = F.translate(ends, "\n", MARK)
    return F.regexp_replace(F.translate(ends, UPPER, LOWER), NOT_WORD, " ")


def _cut(marked: Column) -> Column:
    own = F.transform(F.split(marked, MARK), lambda s: F.trim(s))
    return F.filter(own, lambda s: s != "")


def sentences(text: Column, by_line: bool) -> Column:
    """The normalised sentences of a text, in order; empty ones are left out."""
    return _cut(_marked(text, by_line))


def without_list_marks(text: Column, by_line: bool) -> Column:
    """``sentences`` without list marks and bare numbers."""
    return _cut(F.regexp_replace(_marked(text, by_line), LIST_MARK, MARK))


def normalised_sentence(sentence: str) -> str:
    """What ``sentences`` makes of one known sentence that has no end within."""
    low = sentence.lower().rstrip(".!?;:")
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in low).split())


def pieces(sentence: str) -> list[str]:
    """What ``without_list_marks`` makes of one known sentence."""
    cut = [normalised_sentence(s) for s in re.split(r"[.!?;:](?:[\x20\x09-\x0D]|$)", sentence)]
    cut = [re.sub(LIST_MARK.replace(r"\z", r"\Z"), "", s).strip() for s in cut]
    return [s for s in cut if s]


KNOWN = [normalised_sentence(s) for s in SENTENCES.values()]
NUMBERS = {name: at + 1 for at, name in enumerate(SENTENCES)}
PIECES = {name: pieces(s) for name, s in (SENTENCES | MORE_SENTENCES).items()}
#: What sentences of texts are compared with: the known sentences, then pieces that are none of them.
ALL_KNOWN = KNOWN + [p for p in dict.fromkeys(p for own in PIECES.values() for p in own) if p not in KNOWN]
_PLACES = {s: ALL_KNOWN.index(s) + 1 for s in ALL_KNOWN}
#: Pieces of one or two words count within rules only.
_SHORT = [at for s, at in _PLACES.items() if len(s.split()) < 3]

def numbered(own: Column) -> Column:
    """The number of each sentence, 0 for an unknown one."""
    known = F.array(*(F.lit(s) for s in ALL_KNOWN))
    return F.transform(own, lambda s: F.array_position(known, s))


def rule_text(names: tuple[str, ...]) -> str:
    return "," + "".join(f"{NUMBERS[n]}," for n in names)


def rule_run(names: tuple[str, ...]) -> str:
    """The run of numbers of a rule, as ``_runs`` writes it."""
    return "," + "".join(f"{_PLACES[p]}," for n in names for p in PIECES[n])


def _runs(numbers: Column) -> Column:
    return F.concat(F.lit(","), F.array_join(numbers.cast("array<string>"), ","), F.lit(","))


def license_scan(docs: DataFrame) -> DataFrame:
    """The licences that every whole text announces.

    Reads ``doc_id`` and ``text`` (null: empty), ignores other columns. Returns
    per row doc_id, n_sentences (cut by line), n_known, sentences (the numbers of
    the known ones, cut by line and without list marks, in order) and licenses
    (sorted names). Empty texts have none;
    repeated rows and rows without an id are scanned each; an empty table
    gives an empty result.
    """
    text = text_or_empty("text")
    lines = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.size(sentences(text, True)).cast("bigint").alias("n_sentences"),
        numbered(without_list_marks(text, True)).alias("_lines"),
        numbered(without_list_marks(text, False)).alias("_flow"),
    )
    runs = lines.withColumns({"_line_run": _runs(F.col("_lines")), "_flow_run": _runs(F.col("_flow"))})
    found = F.array_sort(
        F.array_distinct(
            F.filter(
                F.array(
                    *(
                        F.when(
                            F.col("_line_run").contains(rule_run(names))
                            | F.col("_flow_run").contains(rule_run(names)),
                            F.lit(license_),
                        )
                        for license_, names in RULES + MORE_RULES
                    )
                ),
                lambda x: x.isNotNull(),
            )
        )
    )
    for shorter, longer in CONTAINED.items():
        found = F.when(F.array_contains(found, longer), F.array_remove(found, shorter)).otherwise(found)
    known = F.filter("_lines", lambda n: (n > 0) & ~n.isin(_SHORT))
    return runs.select(
        "doc_id",
        "n_sentences",
        F.size(known).cast("bigint").alias("n_known"),
        known.alias("sentences"),
        found.alias("licenses"),
    )
