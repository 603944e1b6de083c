"""Licence scan by sentence rules; DataFrame expressions only, one pass, no exchange.

Sentences end at blank lines and at . ! ? followed by white space or the end; a
single line end may end a sentence or lie inside one (wrapped texts, also with
comment signs before each line).  Texts are normalised (lower case, all but
ASCII letters and digits to one space) and known licence sentences are found
between such ends, the longest first; their identifiers, in order, are a
document's sequence.  Ordered rules of several identifiers then rewrite the
sequence: a rule that finds its identifiers in a row claims them for its licence,
so a longer rule before a shorter one wins.  What is left is claimed by rules of
one identifier; identifiers that no rule claims are reported as unclaimed.

All known sentences are one pattern, a tree of their words, so its cost does not
follow their number.  Every known sentence holds one of a few word stems (found
when the pattern is built); texts without any of those are not searched.  The
known sentences and rules are constants of fixed size (add more through the
arguments), so they are literals of the plan.

Nulls: a null text has no sentences.  Empty texts and tables give no findings and
no rows.  Repeated rows get the same result.  Ties: of two known sentences that
start at one place the longer one counts.  Very long texts are searched whole, in
one row.  Only doc_id and text are read, so extra columns don't matter.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.shared import table

# Sentences of public licence texts, by identifier.
TEXTS = {
    "apache2.notice.you": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
    "apache2.copy": "You may obtain a copy of the License at",
    "apache2.asis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache2.see": "See the License for the specific language governing permissions and limitations under the License",
    "mit.grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "mit.condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit.warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "mit.liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "bsd.redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd.source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd.binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd.advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd.endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd.disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    "bsd.liability": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE",
    "isc.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "isc.disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    "isc.liability": "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE",
    "zlib.asis": "This software is provided 'as-is', without any express or implied warranty",
    "zlib.liability": "In no event will the authors be held liable for any damages arising from the use of this software",
    "zlib.grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "zlib.origin": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software",
    "zlib.product": "If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required",
    "zlib.altered": "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software",
    "zlib.notice": "This notice may not be removed or altered from any source distribution",
    "boost.grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
    "unlicense.release": "This is free and unencumbered software released into the public domain",
    "unlicense.anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "mpl2.subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "mpl2.copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "epl2.made": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl1.made": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html".split(". ", 1)[1],
    "gpl.redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2.redistribute": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl2only.redistribute": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "gpl.hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl.details": "See the GNU General Public License for more details",
    "gpl.received": "You should have received a copy of the GNU General Public License along with this program",
    "lgpl3.redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl21.redistribute": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl.hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "lgpl.details": "See the GNU Lesser General Public License for more details",
    "lgpl.received": "You should have received a copy of the GNU Lesser General Public License along with this library",
    "agpl3.redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl.details": "See the GNU Affero General Public License for more details",
    "agpl.received": "You should have received a copy of the GNU Affero General Public License along with this program",
    "gpl3.notice": "This work is licensed under the GNU General Public License, version 3",
    "cc0.notice": "This work is dedicated to the public domain under CC0 1.0",
    "reserved": "All rights reserved",
}
# Names of licences in notices.  Each gives a sentence for every phrase below, and one with its SPDX identifier.
NAMES = {
    "MIT": ["MIT License", "MIT Licence"], "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"], "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "3-clause BSD license"], "ISC": ["ISC License"], "Zlib": ["zlib License"], "BSL-1.0": ["Boost Software License, Version 1.0"], "Unlicense": ["Unlicense"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"], "EPL-2.0": ["Eclipse Public License 2.0"], "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL version 2", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL version 3", "GPLv3"], "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "LGPLv2.1"], "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPLv3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPLv3"], "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"], "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"], "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0"], "CC-BY-ND-4.0": ["CC BY-ND 4.0"],
}
PHRASES = ["Licensed under {}", "Released under {}", "Distributed under {}", "This work is licensed under {}", "This project is licensed under {}", "This software is licensed under {}", "This software is released under {}", "This file is licensed under {}"]
# Ordered rules, licence and identifiers in a row.
RULES = [
    ("Apache-2.0", ["apache2.notice.you", "apache2.copy", "apache2.asis", "apache2.see"]),
    ("MIT", ["mit.grant", "mit.condition", "mit.warranty", "mit.liability"]),
    ("MIT", ["mit.grant", "mit.condition"]),
    ("BSD-4-Clause", ["bsd.redistribution", "bsd.source", "bsd.binary", "bsd.advertising", "bsd.endorse", "bsd.disclaimer", "bsd.liability"]),
    ("BSD-3-Clause", ["bsd.redistribution", "bsd.source", "bsd.binary", "bsd.endorse", "bsd.disclaimer", "bsd.liability"]),
    ("BSD-3-Clause", ["bsd.redistribution", "bsd.source", "bsd.binary", "bsd.endorse"]),
    ("BSD-2-Clause", ["bsd.redistribution", "bsd.source", "bsd.binary", "bsd.disclaimer", "bsd.liability"]),
    ("BSD-2-Clause", ["bsd.redistribution", "bsd.source", "bsd.binary"]),
    ("ISC", ["isc.grant", "isc.disclaimer", "isc.liability"]),
    ("0BSD", ["0bsd.grant", "isc.disclaimer", "isc.liability"]),
    ("Zlib", ["zlib.asis", "zlib.liability", "zlib.grant", "zlib.origin", "zlib.product", "zlib.altered", "zlib.notice"]),
    ("BSL-1.0", ["boost.grant"]),
    ("Unlicense", ["unlicense.release", "unlicense.anyone"]),
    ("MPL-2.0", ["mpl2.subject", "mpl2.copy"]),
    ("GPL-3.0-or-later", ["gpl.redistribute", "gpl.hope", "gpl.details", "gpl.received"]),
    ("GPL-3.0-or-later", ["gpl.redistribute", "gpl.hope", "gpl.details"]),
    ("GPL-2.0-or-later", ["gpl2.redistribute", "gpl.hope", "gpl.details", "gpl.received"]),
    ("GPL-2.0-or-later", ["gpl2.redistribute", "gpl.hope", "gpl.details"]),
    ("GPL-2.0-only", ["gpl2only.redistribute", "gpl.hope", "gpl.details", "gpl.received"]),
    ("GPL-2.0-only", ["gpl2only.redistribute", "gpl.hope", "gpl.details"]),
    ("LGPL-2.1-or-later", ["lgpl21.redistribute", "lgpl.hope", "lgpl.details", "lgpl.received"]),
    ("LGPL-2.1-or-later", ["lgpl21.redistribute", "lgpl.hope", "lgpl.details"]),
    ("LGPL-3.0-or-later", ["lgpl3.redistribute", "gpl.hope", "lgpl.details"]),
    ("AGPL-3.0-or-later", ["agpl3.redistribute", "gpl.hope", "agpl.details", "agpl.received"]),
    ("AGPL-3.0-or-later", ["agpl3.redistribute", "gpl.hope", "agpl.details"]),
    ("Apache-2.0", ["apache2.notice.you"]), ("GPL-3.0-or-later", ["gpl.redistribute"]), ("GPL-2.0-or-later", ["gpl2.redistribute"]), ("GPL-2.0-only", ["gpl2only.redistribute"]), ("GPL-3.0", ["gpl3.notice"]),
    ("LGPL-2.1-or-later", ["lgpl21.redistribute"]), ("LGPL-3.0-or-later", ["lgpl3.redistribute"]), ("AGPL-3.0-or-later", ["agpl3.redistribute"]), ("CC0-1.0", ["cc0.notice"]), ("BSD", ["bsd.redistribution"]),
    ("Zlib", ["zlib.grant"]), ("MPL-2.0", ["mpl2.subject"]), ("EPL-2.0", ["epl2.made"]), ("EPL-1.0", ["epl1.made"]), ("Unlicense", ["unlicense.release"]), ("ISC", ["isc.grant"]), ("0BSD", ["0bsd.grant"]),
    *((k, [f"{k}.notice"]) for k in NAMES), *((k, [f"{k}.spdx"]) for k in NAMES),
]
# Other wordings of the same identifiers; the MIT text goes on after "without restriction".
WORDINGS = {
    "mit.grant": [TEXTS["mit.grant"] + ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"],
    "apache2.copy": [TEXTS["apache2.copy"] + " http://www.apache.org/licenses/LICENSE-2.0", TEXTS["apache2.copy"] + " https://www.apache.org/licenses/LICENSE-2.0"],
    "gpl.received": [TEXTS["gpl.received"] + "; if not, write to the Free Software Foundation, Inc", TEXTS["gpl.received"] + ", see <https://www.gnu.org/licenses/>", TEXTS["gpl.received"] + ", see <http://www.gnu.org/licenses/>"],
    "agpl.received": [TEXTS["agpl.received"] + ", see <https://www.gnu.org/licenses/>"],
    "mpl2.copy": [TEXTS["mpl2.copy"].replace("https", "http")],
    "bsd.endorse": [TEXTS["bsd.endorse"].replace("the copyright holder", x) for x in ("the author", "the organization", "the University")],
    "bsd.liability": [TEXTS["bsd.liability"].replace("COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR"), TEXTS["bsd.liability"].replace("COPYRIGHT HOLDER OR", "COPYRIGHT HOLDERS OR")],
    **{f"{k}.notice": [p.format(w) for n in names for p in PHRASES for w in (f"the {n}", f"a {n}", n)] for k, names in NAMES.items()},
    **{f"{k}.spdx": [f"SPDX-License-Identifier: {k}{x}" for x in ("", "-only", "-or-later")] for k in NAMES},
}
SENTENCES = TEXTS | {f"{k}.notice": PHRASES[0].format(f"the {names[0]}") for k, names in NAMES.items()} | {f"{k}.spdx": f"SPDX-License-Identifier: {k}" for k in NAMES}
END = "E"  # no capital is left in lower-cased text
#: Word stems of which every known sentence holds one, tried in this order.
STEMS = ["licen", "software", "redistribut", "copyright", "mpl", "gpl", "rights reserved", "cc by", "cc0", "version", "notice"]


def normalised(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def known_sentences(sentences: dict[str, str] = SENTENCES, wordings: dict[str, list[str]] = WORDINGS) -> dict[str, str]:
    """Normalised sentence -> identifier; where two identifiers share a wording, the first keeps it."""
    known: dict[str, str] = {}
    for name, said in [*sentences.items(), *((n, w) for n, ws in wordings.items() if n in sentences for w in ws)]:
        if len([p for p in re.split(r"[.!?]+(?:\s+|$)|\n+", said) if p]) != 1:
            raise ValueError(f"{name} is more than one sentence")
        known.setdefault(normalised(said), name)
    return known


def word_tree(sentences: list[str]) -> str:
    """A pattern of all sentences that shares their first words, longer ones first; a line end may stand for each space."""
    tree: dict = {}
    for s in sentences:
        at = tree
        for w in s.split(" "):
            at = at.setdefault(w, {})
        at[""] = {}

    def pattern(node: dict) -> str:
        rest = [w + (f"[ \n]{p}" if (p := pattern(n)) and "" not in n else f"(?:[ \n]{p})?" if p else "") for w, n in node.items() if w]
        return rest[0] if len(rest) == 1 else f"(?:{'|'.join(sorted(rest, key=len, reverse=True))})" if rest else ""

    return pattern(tree)


def bordered(text: Column) -> Column:
    """Normalised words; END between sentences, a line end where a line ends inside a paragraph."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[.!?]+(\s+|$)", END)
    t = F.regexp_replace(t, f"[^a-z0-9\n{END}]+", " ")
    t = F.regexp_replace(t, " ?\n ?\n[\n ]*", END)  # lines without letters and digits are blank
    return F.trim(F.regexp_replace(t, f" ?([\n{END}]) ?", "$1"))


def sequence(text: Column, sentences: dict[str, str] = SENTENCES, wordings: dict[str, list[str]] = WORDINGS) -> Column:
    """array<string>: identifiers of the known sentences of a text, in order."""
    known = known_sentences(sentences, wordings)
    # stems of known sentences, as few as are needed; a sentence without any keeps its own first word
    stems = list(dict.fromkeys(next((x for x in STEMS if normalised(x) in s), s.split(" ")[0]) for s in known))
    ids = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    hits = F.regexp_extract_all(bordered(text), F.lit(f"(?<![ a-z0-9])({word_tree(list(known))})(?![ a-z0-9])"), 1)
    low = F.lower(text)
    worth = reduce(lambda a, b: a | b, [low.contains(x) for x in stems if " " not in x])
    if parted := "|".join(x.replace(" ", "[^a-z0-9]+") for x in stems if " " in x):
        worth = worth | low.rlike(parted)
    none = F.array().cast("array<string>")
    return F.when(worth, F.transform(hits, lambda s: F.element_at(ids, F.translate(s, "\n", " ")))).otherwise(none)


def licences(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES, wordings: dict[str, list[str]] = WORDINGS) -> DataFrame:
    """doc_id, sentence_ids, licences (distinct, sorted), unclaimed (identifiers left over, in order)."""
    found = docs.select("doc_id", sequence(F.col("text"), sentences, wordings).alias("sentence_ids"))
    # each identifier between bars of its own, so that neighbours don't share one
    start = F.array_join(F.transform("sentence_ids", lambda s: F.concat(F.lit("|"), s, F.lit("|"))), "")
    marks = [(f"<{name}#{i}>", "".join(f"|{s}|" for s in ids)) for i, (name, ids) in enumerate(rules) if len(ids) > 1]
    found = found.withColumn("left_over", reduce(lambda c, r: F.replace(c, F.lit(r[1]), F.lit(r[0])), marks, start))
    claimed = F.regexp_extract_all("left_over", F.lit("<([^#>]*)#"), 1)
    single = {ids[0]: name for name, ids in reversed(rules) if len(ids) == 1}
    of = F.create_map(*[F.lit(x) for kv in single.items() for x in kv])
    found = found.withColumns({"claimed": claimed, "rest": F.regexp_extract_all("left_over", F.lit(r"\|([^|]*)\|"), 1)})
    alone = F.filter(F.transform("rest", lambda s: F.try_element_at(of, s)), lambda x: x.isNotNull())
    unclaimed = F.filter("rest", lambda s: F.try_element_at(of, s).isNull())
    return found.select("doc_id", "sentence_ids", F.array_sort(F.array_distinct(F.concat("claimed", alone))).alias("licences"), unclaimed.alias("unclaimed"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licences by sentence rules."""
    found = licences(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("licences", ",").alias("licences"),
        F.size("licences").cast("long").alias("n_licences"), F.size("unclaimed").cast("long").alias("n_unclaimed"),
    )


def _oracle() -> str:
    known = ", ".join(f"('{s}', '{n}')" for s, n in known_sentences().items())
    folded = "coalesce(seq, '')"
    for i, (name, ids) in enumerate(RULES):
        if len(ids) > 1:
            folded = f"replace({folded}, '{''.join(f'|{s}|' for s in ids)}', '<{name}#{i}>')"
    single = ", ".join(f"('{i}', '{n}')" for i, n in {ids[0]: name for name, ids in reversed(RULES) if len(ids) == 1}.items())
    return rf"""
WITH known(s, id) AS (VALUES {known}), single(id, name) AS (VALUES {single}),
parts AS (SELECT doc_id, p, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS s
          FROM (SELECT doc_id, unnest(l) AS s, unnest(range(len(l))) AS p
                FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '[.!?]+(\s+|$)|\n+') AS l FROM documents))),
hits AS (SELECT doc_id, count(*) AS n, string_agg('|' || id || '|', '' ORDER BY p) AS seq FROM parts JOIN known USING (s) GROUP BY doc_id),
done AS (SELECT doc_id, coalesce(n, 0) AS n, {folded} AS f FROM documents LEFT JOIN hits USING (doc_id)),
names AS (SELECT map(list(id), list(name)) AS m FROM single),
out AS (SELECT doc_id, n, regexp_extract_all(f, '<([^#>]*)#', 1) AS c, regexp_extract_all(f, '\|([^|]*)\|', 1) AS r FROM done),
sums AS (SELECT doc_id, n, list_sort(list_distinct(list_concat(c, list_filter(list_transform(r, lambda x: m[x]), lambda x: x IS NOT NULL)))) AS l, list_filter(r, lambda x: m[x] IS NULL) AS u FROM out, names)
SELECT doc_id, n AS n_sentences, array_to_string(l, ',') AS licences, CAST(len(l) AS BIGINT) AS n_licences, CAST(len(u) AS BIGINT) AS n_unclaimed FROM sums
"""


ORACLE_SQL = {"op7_licences": _oracle()}
