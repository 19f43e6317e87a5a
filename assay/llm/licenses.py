"""Licence scans by recognised sentences, in DataFrame functions only.

Comment marks at line starts go, wrapped lines are joined, and texts are cut into sentences at blank lines, at list
marks and at . ! or ? before white space. A sentence is normalised: A-Z lowered, all but a-z and digits to single
spaces. Known sentences map to identifiers; a sentence that isn't known as a whole is read line by line, so that a
notice of one line counts between others that don't end. The identifiers, in the order of their places in a text, form a
sequence, and a licence applies where one of its rules' sequences occurs in it, in order and without another known
sentence between. A rule that lies inside a longer match of another rule of the same text still counts, as each names a
licence.

Known sentences are looked up by 64-bit hash and then compared. Only texts that hold one of GATES are cut at all, and
only sentences that hold one of them are looked up: every known sentence has one.

Defined cases: null text has no sentences; a sentence that repeats counts at each place; repeated rows are scanned
each; null doc_ids stay; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts

# Known licence sentences, normalised, by identifier.
SENTENCES = {
    "apache2-short": "licensed under the apache license version 2 0",
    "apache2-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache2-may-not": "you may not use this file except in compliance with the license",
    "apache2-copy-at": "you may obtain a copy of the license at",
    "apache2-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2-see": "see the license for the specific language governing permissions and limitations under the license",
    "apache2-copyright": "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form",
    "apache2-trademarks": "this license does not grant permission to use the trade names trademarks service marks or product names of the licensor except as required for reasonable and customary use in describing the origin of the work and reproducing the content of the notice file",
    "mit-short": "released under the mit license",
    "mit-short-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-liable": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-advertising": "all advertising materials mentioning features or use of this software must display the following acknowledgement this product includes software developed by the copyright holder licensed as above",
    "gpl3-short": "this work is licensed under the gnu general public license version 3",
    "gpl3-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl2-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "gpl-details": "see the gnu general public license for more details",
    "gpl-copy": "you should have received a copy of the gnu general public license along with this program",
    "gpl-copy-if-not": "you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses",
    "gpl-copy-if-not-http": "you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses",
    "gpl-copy-if-not-write": "you should have received a copy of the gnu general public license along with this program if not write to the free software foundation inc 51 franklin street fifth floor boston ma 02110 1301 usa",
    "lgpl21-redistribute": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3-redistribute": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl3-program": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-details": "see the gnu lesser general public license for more details",
    "agpl3-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-details": "see the gnu affero general public license for more details",
    "mpl2": "this source code form is subject to the terms of the mozilla public license v",  # the stop of "v." ends it
    "epl2-made-available": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "epl2-made-available-http": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at http www eclipse org legal epl 2 0",
    "epl1-made-available": "all rights reserved this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution",
    "unlicense-dedicate": "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain",
    "unlicense-successors": "we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law",
    "cc0-waive": "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "cc0-dedication": "you should have received a copy of the cc0 public domain dedication along with this software license waiver",
    "zlib-granted": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "bsl1-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "bsl1-notices": "the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor",
    "bsl1-short": "distributed under the boost software license version 1 0",
    "wtfpl": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    "psf2": "psf is making python available to licensee on an as is basis",
    "artistic2": "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed",
    "ofl11": "this font software is licensed under the sil open font license version 1 1",
    "ccbync4-short": "licensed under cc by nc 4 0",
    "ccby4-short": "licensed under cc by 4 0",
    "ccby4-long": "this work is licensed under a creative commons attribution 4 0 international license",
    "ccbysa4-long": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "ccbync4-long": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "ccbynd4-long": "this work is licensed under a creative commons attribution noderivatives 4 0 international license",
}
# Identifiers of the SPDX licence list that are known after "SPDX-License-Identifier:".
SPDX = (
    "0BSD", "AFL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.1", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0",
    "CC0-1.0", "CDDL-1.0", "CDDL-1.1", "ECL-2.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1",
    "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "MS-PL", "NCSA", "OFL-1.1", "OSL-3.0", "PostgreSQL", "PSF-2.0", "Unlicense", "UPL-1.0", "WTFPL", "X11", "Zlib",
)
# Licences by ordered sequences of sentences.
RULES = (
    ("0BSD", ("0bsd-grant",)),
    ("AGPL-3.0", ("agpl3-redistribute", "agpl-details")),
    ("Apache-2.0", ("apache2-short",)),
    ("Apache-2.0", ("apache2-notice",)),
    ("Apache-2.0", ("apache2-may-not", "apache2-copy-at")),
    ("Apache-2.0", ("apache2-as-is", "apache2-see")),
    ("Apache-2.0", ("apache2-copyright", "apache2-trademarks")),
    ("Artistic-2.0", ("artistic2",)),
    ("BSD-2-Clause", ("bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSL-1.0", ("bsl1-short",)),
    ("BSL-1.0", ("bsl1-grant", "bsl1-notices")),
    ("CC-BY-4.0", ("ccby4-long",)),
    ("CC-BY-4.0", ("ccby4-short",)),
    ("CC-BY-NC-4.0", ("ccbync4-short",)),
    ("CC-BY-NC-4.0", ("ccbync4-long",)),
    ("CC-BY-ND-4.0", ("ccbynd4-long",)),
    ("CC-BY-SA-4.0", ("ccbysa4-long",)),
    ("CC0-1.0", ("cc0-waive",)),
    ("EPL-1.0", ("epl1-made-available",)),
    ("EPL-2.0", ("epl2-made-available",)),
    ("EPL-2.0", ("epl2-made-available-http",)),
    ("GPL-2.0", ("gpl2-redistribute", "gpl-copy")),
    ("GPL-2.0", ("gpl2-redistribute", "gpl-details")),
    ("GPL-2.0", ("gpl2-only",)),
    ("GPL-3.0", ("gpl3-short",)),
    ("GPL-3.0", ("gpl3-redistribute", "gpl-copy")),
    ("GPL-3.0", ("gpl3-redistribute", "gpl-details")),
    ("ISC", ("isc-grant",)),
    ("LGPL-2.1", ("lgpl21-redistribute", "lgpl-details")),
    ("LGPL-3.0", ("lgpl3-redistribute", "lgpl-details")),
    ("LGPL-3.0", ("lgpl3-program", "lgpl-details")),
    ("MIT", ("mit-short",)),
    ("MIT", ("mit-short-licensed",)),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MPL-2.0", ("mpl2",)),
    ("OFL-1.1", ("ofl11",)),
    ("PSF-2.0", ("psf2",)),
    ("Unlicense", ("unlicense-dedicate",)),
    ("WTFPL", ("wtfpl",)),
    ("Zlib", ("zlib-granted",)),
)
GATES = ("licens", "copyright", "permission", "redistribut")
#: Comment marks at a line's start, and what closes a block comment at its end.
COMMENT = r"^[ \t]*(?://+|/\*+|\*+/?|#+|;+|--+|<!--|%+)[ \t]*|[ \t]*(?:\*+/|-->)[ \t]*$"
#: A list mark at a line's start.
MARK = r"^[ \t]*(?:[-•]|\(?(?:[0-9]{1,2}|[A-Za-z]|[ivx]{1,4})[.)])[ \t]+"
#: White space after a stop; a form feed takes its place, and list marks become blank lines.
STOP = r"([.!?])[ \t\n\f\r]+"
CUT = r"\f|\n[ \t]*\n[ \t\n\f\r]*"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def known(sentences: dict[str, str], spdx: tuple[str, ...]) -> dict[str, str]:
    """Identifiers by normalised sentence."""
    named = {re.sub("[^a-z0-9]+", " ", f"spdx license identifier {x}".lower()): f"spdx-{x.lower()}" for x in spdx}
    return {text: k for k, text in sentences.items()} | named


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(sentence, UPPER, LOWER), "[^a-z0-9]+", " "))


def sentences_of(text: Column) -> Column:
    """The sentences of a text, with their line feeds."""
    lines = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), f"(?dm){COMMENT}", ""), f"(?dm){MARK}", "\n\n")
    return F.split(F.regexp_replace(lines, STOP, "$1\f"), CUT, -1)


def scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules=RULES, spdx: tuple[str, ...] = SPDX) -> DataFrame:
    """doc_id, n_known long, sentence_ids (comma-joined, in order), licenses (distinct, sorted, comma-joined)."""
    by_text = known(sentences, spdx)
    hashes = [int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64)) for t in by_text]  # as Spark's xxhash64
    table, names = F.array(*map(F.lit, by_text)), F.array(*map(F.lit, by_text.values()))
    none = F.expr("cast(array() as array<string>)")

    def gated(s: Column) -> Column:
        out = F.lit(False)
        for g in GATES:
            out = out | F.contains(s, F.lit(g))
        return out

    def found(cut: Column) -> Column:
        """Of texts: (place in the table of the hash, the text) of those that may be known."""
        some = F.filter(F.transform(cut, normalised), gated)
        at = F.transform(some, lambda s: F.struct(s.alias("s"), F.array_position(F.array(*map(F.lit, hashes)), F.xxhash64(s)).cast("int").alias("k")))
        sure = F.filter(at, lambda x: (x["k"] > 0) & (F.try_element_at(table, F.when(x["k"] > 0, x["k"]).otherwise(1)) == x["s"]))
        return F.transform(sure, lambda x: F.element_at(names, x["k"]))

    def of_sentence(s: Column) -> Column:
        whole = found(F.array(s))
        return F.when((F.size(whole) > 0) | ~F.contains(s, F.lit("\n")), whole).otherwise(found(F.split(s, "\n", -1)))

    cut = F.filter(sentences_of(F.col("text")), lambda s: gated(F.translate(s, UPPER, LOWER)))
    ids = F.when(gated(F.translate("text", UPPER, LOWER)), F.flatten(F.transform(cut, of_sentence)))
    rows = texts(docs).select("doc_id", F.coalesce(ids, none).alias("ids"))
    path = F.concat(F.lit(","), F.array_join("ids", ","), F.lit(","))
    every = [*rules, *((name, (k,)) for name, k in ((x, f"spdx-{x.lower()}") for x in spdx))]
    hit = F.array_compact(F.array(*(F.when(F.contains(path, F.lit("," + ",".join(seq) + ",")), F.lit(name)) for name, seq in every)))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_known"), F.array_join("ids", ",").alias("sentence_ids"), F.array_join(F.array_sort(F.array_distinct(F.when(F.size("ids") > 0, hit).otherwise(none))), ",").alias("licenses"))
