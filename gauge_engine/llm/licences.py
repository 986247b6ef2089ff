"""Licence recognition from sentences, in DataFrame expressions only.

Known licence sentences are looked for in the normalised text, from one sentence start to
a sentence end. A line end can be either, or stand inside a sentence that runs over it.
The identifiers found, in the order of the text, are matched against rules: a rule is an
ordered list of identifiers, other sentences may stand between them. Rules are ordered
from the most to the least specific; a rule counts for its licence unless a more specific
rule of the same licence family has already matched.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and notices, by identifier.
SENTENCES = {
    "mit-release": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "apache-licensed": "Licensed under the Apache License, Version 2.0.",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-comply": "you may not use this file except in compliance with the License.",
    "apache-obtain": "You may obtain a copy of the License at",
    "apache-law": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl-3": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl-merchant": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "bsd-redistribute": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "cc-by-4": "Licensed under CC BY 4.0.",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}

# (licence family, licence, sentences in order), the most specific of a family first.
RULES = (
    ("mit", "MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("mit", "MIT-notice", ("mit-release",)),
    ("mit", "MIT-notice", ("mit-licensed",)),
    ("mit", "MIT-partial", ("mit-grant",)),
    ("apache", "Apache-2.0", ("apache-header", "apache-comply", "apache-obtain", "apache-law")),
    ("apache", "Apache-2.0-notice", ("apache-licensed",)),
    ("apache", "Apache-2.0-partial", ("apache-header",)),
    ("gpl", "GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-merchant", "gpl-see")),
    ("gpl", "GPL-3.0-notice", ("gpl-3",)),
    ("gpl", "GPL-2.0-notice", ("gpl-2",)),
    ("gpl", "GPL-3.0-partial", ("gpl-free",)),
    ("bsd", "BSD-3-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("bsd", "BSD-2-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary")),
    ("mpl", "MPL-2.0", ("mpl-2",)),
    ("cc-by-nc", "CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("cc-by", "CC-BY-4.0", ("cc-by-4",)),
    ("cc-by-sa", "CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("cc0", "CC0-1.0", ("cc0",)),
)

# A sentence ends at one of these marks with white space behind it, and at a line without a
# letter or digit; _ENDS stands for both in normalised texts, _LINE for any other line end.
_SENTENCE_END = r"[.!?;:]\s+|\n[^\p{L}\p{N}\n]*(?=\n)"
_ENDS, _LINE = "\x01", "\x02"


def normal_sentence(sentence: str) -> str:
    """Lower-cased runs of letters and digits, one blank between them."""
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def _marked(text: Column) -> Column:
    """Normalised text with its sentence and line ends; comment leaders fall away."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), f"[{_ENDS}{_LINE}]", " "), r"\r\n?", "\n")
    ended = F.regexp_replace(F.regexp_replace(plain, _SENTENCE_END, f" {_ENDS} "), r"\n", f" {_LINE} ")
    held = F.regexp_replace(ended, f"[^a-z0-9{_ENDS}{_LINE}]+", " ")
    spaced = F.regexp_replace(held, f" ?([{_ENDS}{_LINE}]) ?", " $1 ")
    return F.concat(F.lit(f"{_ENDS} "), F.trim(F.regexp_replace(spaced, " +", " ")), F.lit(f" {_ENDS}"))


def _phrases() -> dict[str, str]:
    """Normalised known sentence -> identifier."""
    return {normal_sentence(s): name for name, s in SENTENCES.items()}


def _sentence_pattern() -> str:
    """Any known sentence between two ends. Line ends may stand between its words, other ends
    where the known sentence has them itself; of two sentences the longer one is found."""
    line, ends = f"(?: {_LINE})* ", f"(?: [{_ENDS}{_LINE}])* "
    patterns = []
    for sentence in sorted(SENTENCES.values(), key=lambda s: -len(normal_sentence(s))):
        pieces = [normal_sentence(p).split() for p in re.split(r"[.!?;:]\s+", sentence)]
        patterns.append(ends.join(line.join(words) for words in pieces if words))
    return f"(?<=[{_ENDS}{_LINE}] )(?:{'|'.join(patterns)})(?= [{_ENDS}{_LINE}])"


def _telling_words() -> list[str]:
    """One word of each known sentence, its longest: without it the sentence cannot occur."""
    return sorted({max(normal_sentence(s).split(), key=lambda w: (len(w), w)) for s in SENTENCES.values()})


def scan_licences(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``licence_sentences`` (identifiers in order) and ``licences``.

    Both are arrays, empty where nothing is found; clashing columns are replaced. A known
    sentence is recognised whatever its case and punctuation, if it is a sentence of its own
    in the text, on one line or over several, with or without comment leaders. Null and empty texts have none. Repeated rows get equal
    results; an empty table stays empty. Texts without any telling word are not cut.
    """
    text = F.coalesce(text_col, F.lit(""))
    low = F.lower(text)
    may_hold = F.lit(False)
    for word in _telling_words():
        may_hold = may_hold | F.contains(low, F.lit(word))
    known = F.create_map(*[F.lit(x) for pair in _phrases().items() for x in pair])
    none = F.array().cast("array<string>")
    matches = F.regexp_extract_all(_marked(text), F.lit(_sentence_pattern()), F.lit(0))
    sentences = F.transform(
        matches, lambda s: F.try_element_at(known, F.regexp_replace(s, f"[ {_ENDS}{_LINE}]+", " "))
    )
    found = docs.withColumn("licence_sentences", F.when(may_hold, F.array_compact(sentences)).otherwise(none))
    sequence = F.concat(F.lit("|"), F.array_join("licence_sentences", "||"), F.lit("|"))
    names, families = [], {}
    for family, licence, ids in RULES:
        fits = sequence.like("%" + "%".join(f"|{i}|" for i in ids) + "%")
        earlier = families.get(family)
        families[family] = fits if earlier is None else earlier | fits
        names.append(F.when(fits if earlier is None else fits & ~earlier, F.lit(licence)))
    return found.withColumn(
        "licences", F.when(F.size("licence_sentences") > 0, F.array_compact(F.array(*names))).otherwise(none)
    )
