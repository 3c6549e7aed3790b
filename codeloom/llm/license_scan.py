"""Licences by sentence rules, with DataFrame functions alone.

A text is cut into pieces at line ends and at .!?; followed by space, and normalised (lower case, runs of other than letters
and digits become one space). Known sentences are looked for across cuts, so wrapped ones are found, and in any comment
style: mentions (`MENTIONS`) from the start of a piece to the end of one, wording of licence texts anywhere between words,
as the real sentences go on or name a holder. Of overlapping ones the first counts. Each document's sequence of sentence
identifiers is matched against the rules in their order, longest first: a rule whose
identifiers occur one after another (unknown sentences between them don't matter) names its licence and uses them up.

One row per document, so null, empty and unlicensed texts have empty strings and zero; repeated rows get equal rows, an
empty table gives none. Nothing is shuffled and other columns are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: identifier -> normalised sentence
SENTENCES = {
    1: "released under the mit license",
    2: "licensed under the apache license version 2 0",
    3: "this work is licensed under the gnu general public license version 3",
    4: "licensed under cc by nc 4 0",
    5: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    6: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    7: "the software is provided as is without warranty of any kind express or implied",
    8: "you may not use this file except in compliance with the license",
    9: "you may obtain a copy of the license at",
    10: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    11: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    12: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    13: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    14: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    15: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    16: "either version 3 of the license or at your option any later version",
    17: "either version 2 of the license or at your option any later version",
    18: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    19: "this source code form is subject to the terms of the mozilla public license v 2 0",
    20: "this is free and unencumbered software released into the public domain",
    21: "this work is licensed under a creative commons attribution 4 0 international license",
    22: "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    23: "licensed under cc by 4 0",
    24: "licensed under cc by sa 4 0",
    25: "all rights reserved",
    26: "spdx license identifier mit",
    27: "spdx license identifier apache 2 0",
    28: "spdx license identifier gpl 3 0 or later",
    29: "spdx license identifier gpl 3 0 only",
    30: "licensed under the mit license",
    31: "this file is licensed under the bsd 3 clause license",
    32: "licensed under the apache license version 2 0 the license",
    34: "apache license version 2 0 january 2004",
    35: "gnu general public license version 3 29 june 2007",
    36: "gnu general public license version 2 june 1991",
    37: "gnu lesser general public license version 3 29 june 2007",
    38: "gnu lesser general public license version 2 1 february 1999",
    39: "gnu affero general public license version 3 19 november 2007",
    40: "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    41: "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    42: "either version 2 1 of the license or at your option any later version",
    43: "mozilla public license version 2 0",
    44: "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    45: "boost software license version 1 0 august 17th 2003",
    46: "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    47: "eclipse public license v 2 0",
    48: "the person who associated a work with this deed has dedicated the work to the public domain",
    49: "cc0 1 0 universal",
    50: "provided that the above copyright notice and this permission notice appear in all copies",
    51: "under the terms of the gnu general public license version 2 only",
    52: "spdx license identifier bsd 3 clause",
    53: "spdx license identifier bsd 2 clause",
    54: "spdx license identifier mpl 2 0",
    55: "spdx license identifier gpl 2 0 only",
    56: "spdx license identifier gpl 2 0 or later",
    57: "spdx license identifier isc",
    33: "names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
}
#: Identifiers that count only as whole pieces; the others are wording of licence texts.
MENTIONS = {1, 2, 3, 4, *range(21, 33), *range(52, 58)}
#: Words (or beginnings of words) of which every sentence holds one: a text without any of them holds no sentence.
ANCHORS = ("license", "permission", "copyright", "warranty", "redistribution", "unencumbered", "reserved", "domain", "universal")
#: (licence, identifiers in order); tried in this order.
RULES = [
    ("BSD-3-Clause", [11, 12, 13, 14]),
    ("BSD-3-Clause", [11, 12, 13, 33]),
    ("Apache-2.0", [2, 8, 9, 10]),
    ("Apache-2.0", [32, 8, 9, 10]),
    ("AGPL-3.0-or-later", [40, 16]),
    ("LGPL-2.1-or-later", [41, 42]),
    ("LGPL-3.0-or-later", [41, 16]),
    ("ISC", [18, 50]),
    ("MIT", [5, 6, 7]),
    ("BSD-2-Clause", [11, 12, 13]),
    ("GPL-3.0-or-later", [15, 16]),
    ("GPL-2.0-or-later", [15, 17]),
    ("Apache-2.0", [2, 8]),
    ("Apache-2.0", [32, 8]),
    ("GPL-3.0-only", [35]),
    ("GPL-2.0-only", [36]),
    ("LGPL-3.0-only", [37]),
    ("LGPL-2.1-only", [38]),
    ("AGPL-3.0-only", [39]),
    ("GPL-2.0-only", [51]),
    ("Apache-2.0", [34]),
    ("MIT", [5, 6]),
    ("MIT", [5]),
    ("Apache-2.0", [2]),
    ("Apache-2.0", [32]),
    ("MIT", [1]),
    ("MIT", [30]),
    ("MIT", [26]),
    ("Apache-2.0", [27]),
    ("GPL-3.0-or-later", [28]),
    ("GPL-3.0-only", [29]),
    ("GPL-3.0-only", [3]),
    ("CC-BY-NC-4.0", [4]),
    ("ISC", [18]),
    ("MPL-2.0", [43]),
    ("BSL-1.0", [45]),
    ("BSL-1.0", [44]),
    ("Zlib", [46]),
    ("EPL-2.0", [47]),
    ("CC0-1.0", [49, 48]),
    ("CC0-1.0", [48]),
    ("CC0-1.0", [49]),
    ("BSD-3-Clause", [52]),
    ("BSD-2-Clause", [53]),
    ("MPL-2.0", [54]),
    ("GPL-2.0-only", [55]),
    ("GPL-2.0-or-later", [56]),
    ("ISC", [57]),
    ("MPL-2.0", [19]),
    ("Unlicense", [20]),
    ("CC-BY-4.0", [21]),
    ("CC-BY-SA-4.0", [22]),
    ("CC-BY-4.0", [23]),
    ("CC-BY-SA-4.0", [24]),
    ("BSD-3-Clause", [31]),
    ("LicenseRef-AllRightsReserved", [25]),
]
BREAK = r"[.!?;]+(?:\s+|$)|[\r\n]+"
CUT = "\x01"


def _any(ids) -> str:
    return "|".join(SENTENCES[i].replace(" ", "[ |]+") for i in sorted(ids, key=lambda i: -len(SENTENCES[i])))


#: Known sentences among the pieces.
FIND = rf"(?:(?<=\| )(?:{_any(MENTIONS)})(?= *\|)|(?<= )(?:{_any(SENTENCES.keys() - MENTIONS)})(?= ))"


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_sentences (known ones), sentence_ids, positions (numbers of the pieces they begin in, from 0), licenses (comma-joined)."""
    known = F.create_map(*[F.lit(x) for i, t in SENTENCES.items() for x in (t, i)])
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{i}>" for i in ids)).alias("ids")) for name, ids in RULES])
    # Cuts become bars: "| first piece | second piece |".
    lower = F.lower(F.coalesce(text_col, F.lit("")))
    possible = reduce(lambda a, b: a | b, [lower.contains(a) for a in ANCHORS])
    pieces = F.regexp_replace(F.translate(lower, CUT, " "), BREAK, CUT)
    pieces = F.regexp_replace(F.trim(F.regexp_replace(pieces, f"[^a-z0-9{CUT}]+", " ")), f" ?{CUT} ?", " | ")
    pieces = F.when(possible, pieces).otherwise("")
    base = df.select(id_col, F.concat(F.lit("| "), F.trim(pieces), F.lit(" |")).alias("__pieces"))
    met = F.when(F.col("__pieces").rlike(FIND), F.regexp_extract_all("__pieces", F.lit(rf"({FIND}|\|)"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    item = "array<struct<at:int,id:int>>"
    cuts = lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit("")))
    walked = F.aggregate(
        "__met",
        F.struct(F.lit(-1).alias("at"), F.array().cast(item).alias("known")),
        lambda acc, x: F.struct(
            (acc["at"] + cuts(x)).alias("at"),
            F.when(x == "|", acc["known"]).otherwise(F.array_append(acc["known"], F.struct(acc["at"].alias("at"), F.element_at(known, F.regexp_replace(x, "[ |]+", " ")).alias("id")))).alias("known"),
        ),
        lambda acc: acc["known"],
    )
    base = base.select(id_col, met.alias("__met")).select(id_col, walked.alias("__known"))
    numbers = F.transform("__known", lambda x: x["id"].cast("string"))
    # Every identifier has its own marks on both sides, so that neighbours can be used up one by one.
    sequence = F.array_join(F.transform(numbers, lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")
    matched = F.aggregate(
        rules,
        F.struct(sequence.alias("left"), F.array().cast("array<string>").alias("found")),
        lambda acc, r: F.when(acc["left"].contains(r["ids"]), F.struct(F.replace(acc["left"], r["ids"], F.lit(";")).alias("left"), F.array_append(acc["found"], r["name"]).alias("found"))).otherwise(acc),
        lambda acc: F.array_join(F.array_sort(F.array_distinct(acc["found"])), ","),
    )
    return base.select(
        id_col,
        F.size("__known").cast("long").alias("n_sentences"),
        F.array_join(numbers, ",").alias("sentence_ids"),
        F.array_join(F.transform("__known", lambda x: x["at"].cast("string")), ",").alias("positions"),
        F.when(F.size("__known") > 0, matched).otherwise("").alias("licenses"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
