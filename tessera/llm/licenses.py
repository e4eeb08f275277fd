"""License scans by sentence rules, with DataFrame functions only.

A text is cut into sentences: at a blank line (one that holds comment marks alone counts as blank) and after `.`, `!`, `?` or `:` before
white space. Lines within a sentence are joined, as licences are shipped hard-wrapped, often behind comment marks; a sentence that is unknown as a
whole is looked at line by line, for notices amid other lines. Sentences are normalised (ASCII lower case, other characters than
letters and digits to one space, copyright lines before them left out) and looked up among known licence sentences; the sequence of
their identifiers is then matched against ordered licence rules. A rule claims the identifiers that it matches, so a longer rule before
a shorter one wins. Narrow: no join and no shuffle. Texts without any anchor word are not cut at all; every known
sentence holds an anchor, which `check_anchors` makes sure of.

Of rules that would claim the same identifiers the earlier one wins; a null id stays null. Null or empty text: no sentence, no licence. Repeated rows give repeated results, an empty table an empty one. Very long texts are scanned whole.
Only the id and the text are read, so clashing extra columns do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised sentences of public licences and licence notices, by identifier.
SENTENCES = [
    ("APACHE_LINE", "licensed under the apache license version 2 0"),
    ("APACHE_LINE", "licensed under the apache license version 2 0 the license"),
    ("APACHE_GRANT", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("APACHE_COPY", "you may obtain a copy of the license at"),
    ("APACHE_COPY", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("APACHE_WARRANTY", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("APACHE_SEE", "see the license for the specific language governing permissions and limitations under the license"),
    ("MIT_LINE", "released under the mit license"),
    ("MIT_LINE", "licensed under the mit license"),
    ("MIT_GRANT", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("MIT_NOTICE", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("MIT_WARRANTY", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("MIT_LIABILITY", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("BSD_GRANT", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BSD_SOURCE", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("BSD_BINARY", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("BSD_NAMES", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSD_WARRANTY", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("BSD_LIABILITY", "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("ISC_GRANT", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("0BSD_GRANT", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("ISC_WARRANTY", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("ISC_LIABILITY", "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("GPL3_LINE", "this work is licensed under the gnu general public license version 3"),
    ("GPL_PROGRAM", "this program is free software"),
    ("GPL3_FREE", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("GPL3_FREE", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("GPL2_FREE", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("AGPL3_FREE", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("LGPL21_FREE", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("GPL_WARRANTY", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("GPL_WARRANTY", "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("GPL_SEE", "see the gnu general public license for more details"),
    ("GPL_SEE", "see the gnu affero general public license for more details"),
    ("GPL_SEE", "see the gnu lesser general public license for more details"),
    ("GPL_COPY", "you should have received a copy of the gnu general public license along with this program"),
    ("GPL_COPY", "you should have received a copy of the gnu affero general public license along with this program"),
    ("MPL2_FORM", "this source code form is subject to the terms of the mozilla public license v"),
    ("MPL2_COPY", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("MPL2_COPY", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    ("ZLIB_WARRANTY", "this software is provided as is without any express or implied warranty"),
    ("ZLIB_LIABILITY", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("ZLIB_GRANT", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("ZLIB_ORIGIN", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("ZLIB_ALTERED", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("UNLICENSE_FREE", "this is free and unencumbered software released into the public domain"),
    ("UNLICENSE_GRANT", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("BSL_GRANT", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
    ("GPL1_TITLE", "gnu general public license version 1 february 1989"),
    ("GPL2_TITLE", "gnu general public license version 2 june 1991"),
    ("GPL3_TITLE", "gnu general public license version 3 29 june 2007"),
    ("AGPL3_TITLE", "gnu affero general public license version 3 19 november 2007"),
    ("LGPL2_TITLE", "gnu library general public license version 2 june 1991"),
    ("LGPL21_TITLE", "gnu lesser general public license version 2 1 february 1999"),
    ("LGPL3_TITLE", "gnu lesser general public license version 3 29 june 2007"),
    ("GFDL12_TITLE", "gnu free documentation license version 1 2 november 2002"),
    ("GFDL13_TITLE", "gnu free documentation license version 1 3 3 november 2008"),
    ("APACHE_TITLE", "apache license version 2 0 january 2004 http www apache org licenses"),
    ("MPL11_TITLE", "mozilla public license version 1 1"),
    ("MPL2_TITLE", "mozilla public license version 2 0"),
    ("ARTISTIC_INTENT", "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control over the development of the package while giving the users of the package the right to use and distribute the package in a more or less customary fashion plus the right to make reasonable modifications"),
    ("CC0_WAIVER", "to the greatest extent permitted by but not in contravention of applicable law affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders all of affirmer s copyright and related rights and associated claims and causes of action whether now known or unknown including existing as well as future claims and causes of action in the work i in all territories worldwide ii for the maximum duration provided by applicable law or treaty including future time extensions iii in any current or future medium and for any number of copies and iv for any purpose whatsoever including without limitation commercial advertising or promotional purposes the waiver"),
    ("CC_BY_LINE", "licensed under cc by 4 0"),
    ("CC_BY_LINE", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("CC_BY_SA_LINE", "licensed under cc by sa 4 0"),
    ("CC_BY_SA_LINE", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("CC_BY_NC_LINE", "licensed under cc by nc 4 0"),
    ("CC_BY_NC_LINE", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
]
# Sentences with a slot, as what stands before and after it; the holder's or author's name stands in it.
SLOTS = [
    ("BSD_NAMES", "neither the name of ", " nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSD_WARRANTY", "this software is provided by ", " as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("BSD_LIABILITY", "in no event shall ", " be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("MIT_LIABILITY", "in no event shall ", " be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("ISC_WARRANTY", "the software is provided as is and ", " disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("ISC_LIABILITY", "in no event shall ", " be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
]
#: Characters that a slot may hold.
SLOT = 120
# Licence rules in order; each is a licence and the sequence of its sentences.
RULES = [
    ("GPL-1.0-only", ["GPL1_TITLE"]),
    ("GPL-2.0-only", ["GPL2_TITLE", "GPL2_FREE", "GPL_WARRANTY", "GPL_SEE"]),
    ("GPL-2.0-only", ["GPL2_TITLE"]),
    ("GPL-3.0-only", ["GPL3_TITLE", "GPL_PROGRAM", "GPL3_FREE", "GPL_WARRANTY", "GPL_SEE", "GPL_COPY"]),
    ("GPL-3.0-only", ["GPL3_TITLE"]),
    ("AGPL-3.0-only", ["AGPL3_TITLE", "GPL_PROGRAM", "AGPL3_FREE", "GPL_WARRANTY", "GPL_SEE", "GPL_COPY"]),
    ("AGPL-3.0-only", ["AGPL3_TITLE"]),
    ("LGPL-2.0-only", ["LGPL2_TITLE"]),
    ("LGPL-2.1-only", ["LGPL21_TITLE", "LGPL21_FREE", "GPL_WARRANTY", "GPL_SEE"]),
    ("LGPL-2.1-only", ["LGPL21_TITLE"]),
    ("LGPL-3.0-only", ["LGPL3_TITLE"]),
    ("GFDL-1.2-only", ["GFDL12_TITLE"]),
    ("GFDL-1.3-only", ["GFDL13_TITLE"]),
    ("Apache-2.0", ["APACHE_TITLE", "APACHE_GRANT", "APACHE_COPY", "APACHE_WARRANTY", "APACHE_SEE"]),
    ("Apache-2.0", ["APACHE_TITLE"]),
    ("MPL-1.1", ["MPL11_TITLE"]),
    ("MPL-2.0", ["MPL2_TITLE", "MPL2_FORM", "MPL2_COPY"]),
    ("MPL-2.0", ["MPL2_TITLE"]),
    ("Artistic-1.0", ["ARTISTIC_INTENT"]),
    ("CC0-1.0", ["CC0_WAIVER"]),
    ("Apache-2.0", ["APACHE_GRANT", "APACHE_COPY", "APACHE_WARRANTY", "APACHE_SEE"]),
    ("MIT", ["MIT_GRANT", "MIT_NOTICE", "MIT_WARRANTY", "MIT_LIABILITY"]),
    ("BSD-3-Clause", ["BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_NAMES", "BSD_WARRANTY", "BSD_LIABILITY"]),
    ("BSD-2-Clause", ["BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_WARRANTY", "BSD_LIABILITY"]),
    ("ISC", ["ISC_GRANT", "ISC_WARRANTY", "ISC_LIABILITY"]),
    ("0BSD", ["0BSD_GRANT", "ISC_WARRANTY", "ISC_LIABILITY"]),
    ("GPL-3.0-or-later", ["GPL_PROGRAM", "GPL3_FREE", "GPL_WARRANTY", "GPL_SEE", "GPL_COPY"]),
    ("AGPL-3.0-or-later", ["GPL_PROGRAM", "AGPL3_FREE", "GPL_WARRANTY", "GPL_SEE", "GPL_COPY"]),
    ("GPL-2.0-or-later", ["GPL2_FREE", "GPL_WARRANTY", "GPL_SEE"]),
    ("LGPL-2.1-or-later", ["LGPL21_FREE", "GPL_WARRANTY", "GPL_SEE"]),
    ("Zlib", ["ZLIB_WARRANTY", "ZLIB_LIABILITY", "ZLIB_GRANT", "ZLIB_ORIGIN", "ZLIB_ALTERED"]),
    ("Unlicense", ["UNLICENSE_FREE", "UNLICENSE_GRANT"]),
    ("BSD-3-Clause", ["BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_NAMES"]),
    ("BSD-2-Clause", ["BSD_GRANT", "BSD_SOURCE", "BSD_BINARY"]),
    ("MPL-2.0", ["MPL2_FORM", "MPL2_COPY"]),
    ("MPL-2.0", ["MPL2_FORM"]),
    ("AGPL-3.0-or-later", ["AGPL3_FREE"]),
    ("GPL-3.0-or-later", ["GPL3_FREE"]),
    ("GPL-2.0-or-later", ["GPL2_FREE"]),
    ("LGPL-2.1-or-later", ["LGPL21_FREE"]),
    ("Apache-2.0", ["APACHE_GRANT"]),
    ("MIT", ["MIT_GRANT"]),
    ("BSL-1.0", ["BSL_GRANT"]),
    ("ISC", ["ISC_GRANT"]),
    ("0BSD", ["0BSD_GRANT"]),
    ("Zlib", ["ZLIB_GRANT"]),
    ("Unlicense", ["UNLICENSE_FREE"]),
    ("GPL-3.0-only", ["GPL3_LINE"]),
    ("Apache-2.0", ["APACHE_LINE"]),
    ("MIT", ["MIT_LINE"]),
    ("CC-BY-NC-4.0", ["CC_BY_NC_LINE"]),
    ("CC-BY-SA-4.0", ["CC_BY_SA_LINE"]),
    ("CC-BY-4.0", ["CC_BY_LINE"]),
]
ANCHORS = ["licen", "permission", "distribut", "warrant", "copyright", "software"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Where a sentence ends, a line that is as good as blank, and copyright lines at a sentence's start.
END, BLANK, OWNER = """([.!?:]["')]*)[ \\t\\r\\n]+""", r"\n[ \t\r]*[*#/;]*[ \t\r]*\n", r"(?i)^(?:[ \t*#/;]*(?:copyright|\(c\)|©)[^\n]*\n)+"


def check_anchors(sentences: list[tuple[str, str]]) -> None:
    missing = [s for _, s in sentences if not any(a in s for a in ANCHORS)]
    if missing:
        raise ValueError(f"no anchor word in {missing}")


def scan(docs: DataFrame, sentences: list[tuple[str, str]] = SENTENCES, rules: list = RULES, slots: list[tuple[str, str, str]] = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, sentence_ids (in text order, comma-joined), n_sentences, licenses (in rule order,
    comma-joined, each once) and n_unclaimed (known sentences that no rule claimed)."""
    check_anchors([*sentences, *((k, before + after) for k, before, after in slots)])
    low, anchored = F.lower("text"), F.lit(False)
    for a in ANCHORS:
        anchored = anchored | F.contains(low, F.lit(a))
    known = F.create_map(*[F.lit(x) for k, s in sentences for x in (s, k)])

    def slotted(p: Column) -> Column:
        out = F.lit(None).cast("string")
        for k, before, after in reversed(slots):
            fits = F.startswith(p, F.lit(before)) & F.endswith(p, F.lit(after)) & F.length(p).between(len(before) + len(after) + 1, len(before) + len(after) + SLOT)
            out = F.when(fits, k).otherwise(out)
        return out

    def look_up(s: Column) -> Column:
        plain = F.trim(F.regexp_replace(F.translate(F.regexp_replace(s, OWNER, ""), UPPER, LOWER), "[^a-z0-9]+", " "))
        return F.transform(F.array(plain), lambda p: F.coalesce(F.try_element_at(known, p), slotted(p)))[0]

    def ids_of(s: Column) -> Column:
        by_line = F.filter(F.transform(F.split(s, "\n"), look_up), lambda k: k.isNotNull())
        return F.transform(F.array(look_up(s)), lambda k: F.when(k.isNotNull(), F.array(k)).otherwise(by_line))

    cut = F.split(F.regexp_replace(F.regexp_replace("text", END, "$1\u001e"), BLANK, "\u001e"), "\u001e")
    ids = F.flatten(F.flatten(F.transform(cut, ids_of)))
    found = docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).select("doc_id", F.when(anchored, ids).otherwise(F.array().cast("array<string>")).alias("ids"))
    steps = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{k}>" for k in seq)).alias("seq")) for name, seq in rules])
    start = F.struct(F.concat(F.lit(""), F.array_join(F.transform("ids", lambda k: F.concat(F.lit("<"), k, F.lit(">"))), "")).alias("left"), F.array().cast("array<string>").alias("names"))
    walk = F.aggregate(steps, start, lambda acc, r: F.struct(F.replace(acc["left"], r["seq"], F.lit("|")).alias("left"), F.when(F.contains(acc["left"], r["seq"]), F.array_append(acc["names"], r["name"])).otherwise(acc["names"]).alias("names")))
    out = found.select("doc_id", "ids", F.when(F.size("ids") > 0, walk).alias("end"))
    return out.select(
        "doc_id",
        F.array_join("ids", ",").alias("sentence_ids"),
        F.size("ids").cast("bigint").alias("n_sentences"),
        F.coalesce(F.array_join(F.array_distinct("end.names"), ","), F.lit("")).alias("licenses"),
        F.coalesce(F.length("end.left") - F.length(F.replace("end.left", F.lit("<"), F.lit(""))), F.lit(0)).cast("bigint").alias("n_unclaimed"),
    )


def sql(sentences: list[tuple[str, str]] = SENTENCES, rules: list = RULES, slots: list[tuple[str, str, str]] = SLOTS) -> str:
    """The same over the view `documents`, for DuckDB."""
    known = f"map([{', '.join(repr(s) for _, s in sentences)}], [{', '.join(repr(k) for k, _ in sentences)}])"
    end, owner = END.replace("'", "''"), OWNER.replace("'", "''")

    def plain(x: str) -> str:
        return f"trim(regexp_replace(translate(regexp_replace({x}, '{owner}', ''), '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'))"

    def look_up(x: str) -> str:
        cases = " ".join(f"WHEN starts_with({x}, '{b}') AND ends_with({x}, '{a}') AND length({x}) BETWEEN {len(b) + len(a) + 1} AND {len(b) + len(a) + SLOT} THEN '{k}'" for k, b, a in slots)
        return f"coalesce({known}[{x}], CASE {cases} END)"

    steps, last = [], "r0"
    for i, (name, seq) in enumerate(rules, 1):
        pat = "".join(f"<{k}>" for k in seq)
        steps.append(f"r{i} AS (SELECT doc_id, ids, replace(rest, '{pat}', '|') AS rest, CASE WHEN contains(rest, '{pat}') AND NOT list_contains(names, '{name}') THEN list_append(names, '{name}') ELSE names END AS names FROM {last})")
        last = f"r{i}"
    return f"""
WITH u AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '{end}', '\\1' || chr(30), 'g'), '{BLANK}', chr(30), 'g'), chr(30))) AS s,
    generate_subscripts(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '{end}', '\\1' || chr(30), 'g'), '{BLANK}', chr(30), 'g'), chr(30)), 1) AS i FROM documents),
w AS (SELECT doc_id, i, s, {look_up("p")} AS whole FROM (SELECT *, {plain("s")} AS p FROM u)),
l AS (SELECT doc_id, i, 0 AS j, whole AS k FROM w WHERE whole IS NOT NULL
  UNION ALL SELECT doc_id, i, j, {look_up("p")} AS k FROM (SELECT doc_id, i, j, {plain("line")} AS p FROM (SELECT doc_id, i, unnest(string_split(s, chr(10))) AS line, generate_subscripts(string_split(s, chr(10)), 1) AS j FROM w WHERE whole IS NULL))),
f AS (SELECT d.doc_id, coalesce(g.ids, []::VARCHAR[]) AS ids FROM documents d LEFT JOIN (SELECT doc_id, list(k ORDER BY i, j) AS ids FROM l WHERE k IS NOT NULL GROUP BY doc_id) g USING (doc_id)),
r0 AS (SELECT doc_id, ids, array_to_string(list_transform(ids, lambda k: '<' || k || '>'), '') AS rest, []::VARCHAR[] AS names FROM f),
{", ".join(steps)}
SELECT doc_id, array_to_string(ids, ',') AS sentence_ids, len(ids)::BIGINT AS n_sentences, array_to_string(names, ',') AS licenses,
  (length(rest) - length(replace(rest, '<', '')))::BIGINT AS n_unclaimed FROM {last}"""
