"""Licence scans by sentence rules, in DataFrame operations only.

A text is normalised to words with marks between them for line breaks, blank lines and sentence
ends. A known licence sentence is found where its words stand between two such marks, over wrapped
lines and behind comment signs; its identifiers are given in the order of the text. Ordered rules
name licences by runs of identifiers; the first rule whose run occurs names the document's licence.
The tables are short parameters, held as literals of the plan; there is no join and no shuffle.

A sentence may begin and end at any line (notices without a full stop, a copyright line before it)
and runs on over single line breaks, not over a blank line or a line of signs only, and over the end
of a sentence only where the known sentence has one itself ("free software: you", "v. 2.0").

Defined cases: a null or empty text has no sentences, an empty identifier list and no licence;
repeated sentences repeat their identifiers; rows are independent, so that ties, repeated rows,
null keys and other columns need no rule; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTENCES = {
    # Short notices.
    "mit-short": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License."],
    "apache2-short": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0."],
    "gpl3-short": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."],
    "gpl2-short": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2."],
    "lgpl3-short": ["Licensed under the GNU Lesser General Public License, version 3."],
    "agpl3-short": ["Licensed under the GNU Affero General Public License, version 3."],
    "mpl2-short": ["Licensed under the Mozilla Public License, Version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "cc-by-4": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa-4": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc-4": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-nd-4": ["Licensed under CC BY-ND 4.0."],
    "cc0": ["Released under CC0 1.0.", "This work is dedicated to the public domain under CC0 1.0."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    # Sentences of longer texts.
    "grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "redistribution": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "source-form": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "binary-form": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "no-endorsement": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "apache2-may-not": ["you may not use this file except in compliance with the License."],
    "apache2-copy": ["You may obtain a copy of the License at"],
    "as-is": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "no-liability": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "bsd-as-is": ["THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."],
    "bsd-no-liability": ["IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."],
    "isc-as-is": ["THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."],
    "apache2-unless": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "apache2-see": ["See the License for the specific language governing permissions and limitations under the License."],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "gpl-see": ["See the GNU General Public License for more details."],
    "gpl-copy": ["You should have received a copy of the GNU General Public License along with this program."],
    "gpl2-free-software": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "lgpl21-free-software": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "lgpl3-free-software": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "agpl3-free-software": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "mpl2-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "zlib-as-is": ["This software is provided 'as-is', without any express or implied warranty."],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "boost-short": ["Distributed under the Boost Software License, Version 1.0."],
    "gpl-free-software": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
}

#: Further wordings of the sentences above, as the licences' own headers have them.
WORDINGS = {
    "mpl2-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "apache2-short": ["Licensed under the Apache License, Version 2.0 (the \"License\");"],
    "apache2-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
}

#: In this order: a longer text before the parts that it shares with a shorter one.
RULES = [
    ("MIT", ["grant", "notice"]),
    ("BSD-3-Clause", ["redistribution", "source-form", "binary-form", "no-endorsement"]),
    ("BSD-2-Clause", ["redistribution", "source-form", "binary-form"]),
    ("Apache-2.0", ["apache2-short", "apache2-may-not", "apache2-copy"]),
    ("GPL-3.0-or-later", ["gpl-free-software"]),
    ("GPL-2.0-or-later", ["gpl2-free-software"]),
    ("LGPL-2.1-or-later", ["lgpl21-free-software"]),
    ("LGPL-3.0-or-later", ["lgpl3-free-software"]),
    ("AGPL-3.0-or-later", ["agpl3-free-software"]),
    ("Zlib", ["zlib-as-is", "zlib-grant"]),
    ("Zlib", ["zlib-grant"]),
    ("ISC", ["isc-grant"]),
    ("AGPL-3.0", ["agpl3-short"]),
    ("GPL-3.0", ["gpl3-short"]),
    ("GPL-2.0", ["gpl2-short"]),
    ("LGPL-3.0", ["lgpl3-short"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("MPL-2.0", ["mpl2-short"]),
    ("Apache-2.0", ["apache2-short"]),
    ("BSL-1.0", ["boost-short"]),
    ("MIT", ["mit-short"]),
    ("Unlicense", ["unlicense"]),
    ("CC0-1.0", ["cc0"]),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What becomes of a lower-cased text between two line breaks, in this order: P stands for a blank line (or one of signs
#: only), L for a line break with the comment signs and list number after it, S for a sentence end, blanks for the rest.
#: No step repeats a group, as Java's stack would grow with the text.
MARKS = [
    (r"\r\n?", "\n"),
    (r"\n[^a-z0-9\n]*(?:(?:rem|dnl)[ \t]*)?(?=\n)", "P"),
    (r"\n[^a-z0-9P\n]*(?:(?:rem|dnl|[a-z0-9]{1,2}\))[ \t]+[^a-z0-9P\n]*)?", "L"),
    (r"[.;:!?][ \tL]+", "S"),
    (r"[^a-z0-9LPS]+", " "),
]


def normalised(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.translate(str.maketrans(UPPER, LOWER))).strip(" ")


def known_sentences() -> dict[str, str]:
    return {normalised(s): name for name, group in SENTENCES.items() for s in group}


def all_sentences() -> dict[str, str]:
    return {s: name for table in (SENTENCES, WORDINGS) for name, group in table.items() for s in group}


def _pattern(sentences: list[str]) -> str:
    """Finds the sentences, a longer one before its beginnings, in a text with MARKS."""
    found = set()
    for s in sentences:
        s = s.translate(str.maketrans(UPPER, LOWER))
        for cut, mark in MARKS:
            s = re.sub(cut, mark, s)
        gaps = re.split("([a-z0-9]+)", s.strip(" LPS"))
        found.add("".join(x if x.isalnum() and x.islower() or x.isdigit() else "[ LS]+" if "S" in x else "[ L]+" if x else "" for x in gaps))
    ordered = sorted(found, key=lambda x: (-x.count("]+"), x))
    return f"[LPS] ?({'|'.join(ordered)})(?= ?[LPS])"


def sentence_ids(text: Column, sentences: dict[str, str] | None = None) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    known = sentences or all_sentences()
    table = F.create_map(*[F.lit(x) for s, name in {normalised(s): name for s, name in known.items()}.items() for x in (s, name)])
    marked = F.concat(F.lit("\n"), F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit("\n"))
    for cut, mark in MARKS:
        marked = F.regexp_replace(marked, cut, mark)
    found = F.regexp_extract_all(marked, F.lit(_pattern(list(known))), F.lit(1))
    return F.transform(found, lambda s: F.try_element_at(table, F.regexp_replace(s, "[ LS]+", " ")))


def scan(docs: DataFrame, sentences: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sentence_ids, licence, licences) of every row.

    ``licence`` is the name of the first rule that matches, null for none; ``licences`` lists the
    names of all rules that match, each once, in the order of the rules.
    """
    rules = RULES if rules is None else rules
    rows = docs.select(F.col(key).alias("key"), sentence_ids(F.col(text), sentences).alias("ids"))
    line = F.concat(F.lit(","), F.array_join("ids", ","), F.lit(","))
    ordered = F.array(*[F.when(F.contains(line, F.lit("," + ",".join(run) + ",")), F.lit(name)) for name, run in rules])
    licences = F.array_distinct(F.filter(ordered, lambda x: x.isNotNull()))
    return rows.select(F.col("key").alias(key), F.col("ids").alias("sentence_ids"), licences.alias("licences")).withColumn("licence", F.try_element_at("licences", F.lit(1)))
