"""License scans: canonical digests of whole texts and of their lines, hash-joined to known ones.

A text is made canonical by lower case, dropping copyright notices (not other lines that
begin with the word), equivalent spellings,
and one blank for any run of other than letters and digits. Its SHA-256 digest is joined
to the digests of known licence texts; each line of a text is looked up in the same way
as a notice. Nothing short of an entire known text matches: a text is known with and
without its title, and a long one with and without its appendix too.

Only DataFrame functions run. The table of known digests has one row a known text (a
fixed list or the caller's); it is counted, and broadcast up to KNOWN_TEXTS rows.

Defined cases: null text is empty; a text that is empty once canonical matches nothing;
each row is looked up for itself, repeated doc_ids too; of several known texts with one
digest the first name in order counts; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_table
from .license_digests import DIGESTS

KNOWN_TEXTS = 100_000

_DISCLAIMER = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD_TERMS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "

# fixed values: public licence texts, and one-line notices
LICENSES = {
    "MIT": 'MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n'
    + _DISCLAIMER
    + "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": 'ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "0BSD": 'BSD Zero Clause License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-2-Clause": "BSD 2-Clause License\n\n" + _BSD_TERMS + _BSD_END,
    "BSD-3-Clause": "BSD 3-Clause License\n\n" + _BSD_TERMS + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END,
    "Zlib": "zlib License\n\nThis software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.",
    "WTFPL": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004\n\nEveryone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.\n\nDO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n\n0. You just DO WHAT THE FUCK YOU WANT TO.",
    "Apache-2.0 notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Released under the BSD 3-Clause License."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2."],
    "MPL-2.0": ["Licensed under the Mozilla Public License, version 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC0-1.0": ["Released under CC0 1.0."],
}
# fixed values: spellings that count as equal, as (from, to), applied in this order
SPELLINGS = [("licence", "license"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("copyright holder", "copyright owner"), ("favour", "favor"), ("authoris", "authoriz"), ("organis", "organiz"), ("recognis", "recogniz"), ("acknowledgement", "acknowledgment"), ("centre", "center"), ("programme", "program"), ("wilful", "willful"), ("behaviour", "behavior"), ("labour", "labor"), ("non commercial", "noncommercial"), ("merchantibility", "merchantability"), ("https", "http")]
# the SQL's rule, which also drops lines of prose; it is left as it was
COPYRIGHT_RE = r"(^|\n)[^\n\p{L}]*(copyright|\(c\)|©|all rights reserved)[^\n]*"

# words after "copyright", or after the "(c)" of a list, that make a line prose and no notice
_PROSE = "notices?|holders?|owners?|licen[sc]es?|laws?|permissions?|statements?|interests?|protection|treaty|infringement|disclaimers?|acts?|status|doctrines?|works?|rights?|conditions?|exceptions?|the (?:software|library|program)|and|or|in|on|of|is|as|for|to|that|which|with|under|if|any|an?"
_ITEM = "the|this|these|those|you|your|it|its|if|each|every|all|no|not|such|must|may|shall|will|when|where|by|with|under|at|from|prohibit\\w*|accompany|convey\\w*|cause|give|use|include|" + _PROSE
#: a line that is a copyright notice: (c) or a year or a holder by name after the word, or the sign itself, or all rights reserved
NOTICE_RE = rf"(^|\n)[^\n\p{{L}}©(]*(?:(?i:copyright)(?:[^\S\n]+(?i:by)\b|[^\S\n:,]*[:,]?[^\S\n]*(?:(?i:\(c\))|©|[<\[{{(]?(?:\p{{Nd}}{{4}}|(?i:y{{2,4}}|year)\b)|(?!(?i:{_PROSE})\b)\p{{Lu}}))|(?i:\(c\))[^\S\n]*(?!(?i:{_ITEM})\b)[\p{{L}}\p{{N}}<\[{{]|©|(?i:all rights reserved))[^\n]*"


def _respelt(text: Column) -> Column:
    for a, b in SPELLINGS:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _marks_gone(text: Column) -> Column:
    """Lower case, no copyright lines, one blank for other than letters, digits and line ends."""
    low = F.lower(text)
    marked = low.contains("copyright") | low.contains("(c)") | low.contains("©") | low.contains("all rights reserved")
    # names are told by their capitals
    out = F.when(marked, F.lower(F.regexp_replace(text, NOTICE_RE, "\n"))).otherwise(low)
    return F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")


def _one_line(bare: Column) -> Column:
    return F.trim(F.regexp_replace(bare, r" ?\n[ \n]*", " "))


def canonical(text: Column) -> Column:
    return _respelt(_one_line(_marks_gone(text)))


def _untitled(text: str) -> list[str]:
    """A known text, and that text without the title line it may stand without."""
    title, _, rest = text.partition("\n\n")
    return [text, rest] if title.lower().endswith("license") else [text]


def known_digests(spark: SparkSession, licenses: dict[str, str] | None = None, notices: dict[str, list[str]] | None = None) -> DataFrame:
    """digest, name, whole: one row for each known text; of full licence texts (license_digests) the digests are kept."""
    rows = [(n, t, True) for n, t in licenses.items()] if licenses is not None else [(n, x, True) for n, t in LICENSES.items() for x in _untitled(t)]
    rows += [(n, t, False) for n, many in (NOTICES if notices is None else notices).items() for t in many]
    known = spark.createDataFrame(rows or [("", "", True)], "name string, text string, whole boolean")
    found = known.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "name", "whole").where(F.length("name") > 0)
    if licenses is None:
        full = spark.createDataFrame([(d, n, True) for n, many in DIGESTS.items() for d in many], "digest string, name string, whole boolean")
        found = found.union(full)
    return found.groupBy("digest", "whole").agg(F.min("name").alias("name"))


def license_scan(docs: DataFrame, licenses: dict[str, str] | None = None, notices: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, digest (of the canonical text; null if empty), license, notices (of lines, joined by commas)."""
    known = known_digests(docs.sparkSession, licenses, notices)
    rows = text_table(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", _marks_gone(F.col("text")).alias("bare"))
    rows = rows.select("row", "doc_id", _respelt(_one_line(F.col("bare"))).alias("all"), F.split(_respelt(F.col("bare")), "\n").alias("lines"))
    rows = rows.select("row", "doc_id", F.posexplode(F.concat(F.array("all"), "lines")).alias("k", "part"))
    rows = rows.select("row", "doc_id", (F.col("k") == 0).alias("whole"), F.trim("part").alias("part"))
    rows = rows.select("row", "doc_id", "whole", F.when(F.col("part") != "", F.sha2("part", 256)).alias("digest"))
    # one row of some hundred bytes for each known text; a longer list is joined as Spark sees fit
    found = rows.join(F.broadcast(known) if known.count() <= KNOWN_TEXTS else known, ["digest", "whole"], "left")
    whole = F.col("whole")
    return (
        found.groupBy("row", "doc_id")
        .agg(F.max(F.when(whole, F.col("digest"))).alias("digest"), F.max(F.when(whole, F.col("name"))).alias("license"), F.array_join(F.array_sort(F.collect_set(F.when(~whole, F.col("name")))), ",").alias("notices"))
        .select("doc_id", "digest", "license", "notices")
    )


def license_sql() -> str:
    """The scan of the table documents in DuckDB SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    made = f"trim(regexp_replace(regexp_replace(lower(t), {quote(COPYRIGHT_RE)}, chr(10), 'g'), {quote(r'[^\p{L}\p{N}]+')}, ' ', 'g'))"
    for a, b in SPELLINGS:
        made = f"replace({made}, {quote(a)}, {quote(b)})"
    values = [(n, t, "true") for n, t in LICENSES.items()] + [(n, t, "false") for n, many in NOTICES.items() for t in many]
    rows = ", ".join(f"({quote(n)}, {quote(t)}, {w})" for n, t, w in values)
    return f"""
    WITH known AS (SELECT min(name) AS name, whole, {made} AS c FROM (VALUES {rows}) v(name, t, whole) GROUP BY ALL),
    parts AS (SELECT doc_id, true AS whole, coalesce(text, '') AS t FROM documents
              UNION ALL SELECT doc_id, false, unnest(string_split(coalesce(text, ''), chr(10))) FROM documents),
    made AS (SELECT doc_id, whole, nullif({made}, '') AS c FROM parts)
    SELECT m.doc_id, max(CASE WHEN m.whole THEN sha256(m.c) END) AS digest, max(CASE WHEN m.whole THEN k.name END) AS license,
           coalesce(string_agg(DISTINCT CASE WHEN NOT m.whole THEN k.name END, ',' ORDER BY CASE WHEN NOT m.whole THEN k.name END), '') AS notices
    FROM made m LEFT JOIN known k ON k.c = m.c AND k.whole = m.whole GROUP BY m.doc_id"""
