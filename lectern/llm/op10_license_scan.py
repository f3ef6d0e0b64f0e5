"""License scan by ordered signature rules, in DataFrame operations only.

A text becomes its words, lower-cased and joined by one space; everything works on
that line. A keyword prefilter (``contains``) passes only the texts that hold any of
a few keywords to the rules, and each rule has keywords of its own, one of which must
be there before its regex is tried. Both filters are lossless: all that a rule matches
holds one of its keywords and one of the few. A rule's places are word intervals. They are put in the order
(start, longer first, priority) and folded once: an interval contained in one already
kept is suppressed; of two that overlap otherwise the one of higher priority stays.
The fold keeps the interval in hand; what is settled goes to arrays of bounded pieces, so
a text with very many places costs little more than time in proportion to them.

The rules are of three kinds: sentences of the licenses' own texts and notices, SPDX
identifiers (in SPDX lines and their expressions, after words of a grant, and alone
where they say enough), and license names with the forms in which they are used.

Base places (fixed phrases, all of them counted) are found apart from the rules, and
suppression never removes their labels.

Null texts count as empty: no words, no places, empty labels, score 0. Rows are kept
as they are, repeated ones and null doc_ids too; an empty table gives an empty result.
Kept columns may have any names but those that are added. Everything is one pass over each row; nothing is shuffled.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Phrases whose every place counts, with their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Licenses: label, keywords (one of them stands in all that the name matches), regexes of the name in words, regex of a version ("" for none).
FAMILIES = (
    ("gpl", ("general public", "gnu gpl", "gplv", "gpl2", "gpl3"), r"gnu general public licen[cs]e|gnu gpl|gplv?[23]", r"v?[123](?: 0)?"),
    ("lgpl", ("lesser general", "library general", "lgpl"), r"gnu (?:lesser|library) general public licen[cs]e|lgplv?[23]?", r"v?(?:2|2 1|3)(?: 0)?"),
    ("agpl", ("affero", "agpl"), r"(?:gnu )?affero general public licen[cs]e|agplv?[13]?", r"v?[13](?: 0)?"),
    ("apache", ("apache",), r"apache (?:software )?licen[cs]e|apache licensed", r"v?(?:1 0|1 1|2 0|2)"),
    ("mit", ("mit", "expat"), r"(?:the )?mit(?: x11)? licen[cs]e|expat licen[cs]e", r""),
    ("bsd", ("bsd",), r"(?:[234] clause )?(?:new |modified |simplified |revised )?bsd licen[cs]e|bsd [0234] clause", r""),
    ("isc", ("isc",), r"isc licen[cs]e", r""),
    ("mpl", ("mozilla",), r"mozilla public licen[cs]e", r"v?[12](?: [01])?"),
    ("epl", ("eclipse",), r"eclipse (?:public|distribution) licen[cs]e", r"v?[12](?: 0)?"),
    ("cddl", ("common development",), r"common development and distribution licen[cs]e", r"v?1 [01]"),
    ("cpl", ("common public",), r"common public licen[cs]e", r"v?1 0"),
    ("eupl", ("european union",), r"european union public licen[cs]e", r"v?1 [012]"),
    ("artistic", ("artistic",), r"artistic licen[cs]e", r"v?[12](?: 0)?"),
    ("zlib", ("zlib",), r"zlib(?: libpng)? licen[cs]e", r""),
    ("boost", ("boost",), r"boost software licen[cs]e", r"v?1 0"),
    ("unlicense", ("unlicense",), r"(?:the )?unlicense", r""),
    ("wtfpl", ("wtfpl",), r"wtfpl", r"v?2"),
    ("python", ("python",), r"python (?:software foundation )?licen[cs]e", r"v?2(?: 0)?"),
    ("ruby", ("ruby",), r"ruby licen[cs]e", r""),
    ("perl", ("perl",), r"same terms as perl itself|perl licen[cs]e", r"v?5"),
    ("php", ("php",), r"php licen[cs]e", r"v?3(?: 01?)?"),
    ("postgresql", ("postgresql",), r"postgresql licen[cs]e", r""),
    ("ofl", ("open font",), r"(?:sil )?open font licen[cs]e", r"v?1 [01]"),
    ("odbl", ("open database",), r"open database licen[cs]e", r"v?1 0"),
    ("ogl", ("open government",), r"open government licen[cs]e", r"v?[123](?: 0)?"),
    ("gfdl", ("free documentation",), r"gnu free documentation licen[cs]e", r"v?1 [123]"),
    ("cc0", ("cc0", "cc zero"), r"cc0|cc zero", r"v?1 0"),
    ("cc-by", ("cc by",), r"cc by", r"[1234] [05]"),
    ("cc-by-sa", ("cc by",), r"cc by sa", r"[1234] [05]"),
    ("cc-by-nc", ("cc by",), r"cc by nc", r"[1234] [05]"),
    ("cc-by-nd", ("cc by",), r"cc by nd", r"[1234] [05]"),
    ("cc-by-nc-sa", ("cc by",), r"cc by nc sa", r"[1234] [05]"),
    ("cc-by-nc-nd", ("cc by",), r"cc by nc nd", r"[1234] [05]"),
    ("creative-commons", ("creative commons",), r"creative commons(?: attribution)?(?: non ?commercial)?(?: share ?alike| no ?deriv(?:ative)?s)?(?: licen[cs]e)?", r"[1234] [05]"),
    ("ms-pl", ("microsoft",), r"microsoft (?:public|reciprocal) licen[cs]e", r""),
    ("bsl", ("business source",), r"business source licen[cs]e", r"v?1 [01]"),
    ("sspl", ("server side",), r"server side public licen[cs]e", r"v?1"),
    ("public-domain", ("public domain",), r"(?:in|into|to) the public domain", r""),
    ("proprietary", ("reserved",), r"all rights reserved", r""),
    ("upl", ("universal permissive",), r"universal permissive licen[cs]e", r"v?1 0"),
)

#: How a family's name is used: kind, regex around it, priority (lower is stronger), confidence.
FORMS = (
    ("grant", r"(?:licensed|released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?{name}(?: version)? ?{version}", 1, 1.0),
    ("version", r"{name}(?: as published[a-z ]{{0,60}})? (?:version|v) {version}", 2, 0.95),
    ("numbered", r"{name} {version}", 3, 0.9),
    ("header", r"(?:licen[cs]e|spdx licen[cs]e identifier) (?:is )?(?:the )?{name}", 4, 0.9),
    ("terms", r"(?:terms|conditions|copy|text) of (?:the )?{name}", 5, 0.85),
    ("copyright", r"copyright [^ ]+(?: [^ ]+){{0,6}} {name}", 6, 0.8),
    ("name", r"{name}", 7, 0.7),
)


#: SPDX identifiers in words, with their labels. Those that say enough by themselves (last value) count anywhere, the others after words of a grant.
SPDX = (
    ("gpl", r"gpl [123] 0(?: only| or later)?", True),
    ("lgpl", r"lgpl (?:2 0|2 1|3 0)(?: only| or later)?", True),
    ("agpl", r"agpl [13] 0(?: only| or later)?", True),
    ("gfdl", r"gfdl 1 [123](?: invariants| no invariants)?(?: only| or later)?", True),
    ("apache", r"apache (?:1 0|1 1|2 0)", True),
    ("mit", r"mit(?: 0)?", False),
    ("mit", r"x11", False),
    ("bsd", r"0?bsd(?: [1234] clause)?", False),
    ("bsd", r"bsd [1234] clause(?: patent| clear| lbnl)?", True),
    ("isc", r"isc", False),
    ("mpl", r"mpl (?:1 [01]|2 0)(?: no copyleft exception)?", True),
    ("epl", r"epl [12] 0", False),
    ("cddl", r"cddl 1 [01]", True),
    ("cpl", r"cpl 1 0", False),
    ("eupl", r"eupl 1 [012]", True),
    ("artistic", r"artistic [12] 0(?: perl| cl8)?", True),
    ("zlib", r"zlib", False),
    ("boost", r"bsl 1 0", False),
    ("bsl", r"busl 1 1", True),
    ("unlicense", r"unlicense", False),
    ("wtfpl", r"wtfpl", False),
    ("python", r"(?:psf|python) 2 0(?: 1)?", False),
    ("ruby", r"ruby", False),
    ("php", r"php 3 01?", False),
    ("postgresql", r"postgresql", False),
    ("ofl", r"ofl 1 [01](?: rfn| no rfn)?", True),
    ("odbl", r"odbl 1 0", True),
    ("ogl", r"ogl uk [123] 0", True),
    ("cc0", r"cc0 1 0", True),
    ("cc-by", r"cc by [1234] [05]", True),
    ("cc-by-sa", r"cc by sa [1234] [05]", True),
    ("cc-by-nc", r"cc by nc [1234] [05]", True),
    ("cc-by-nd", r"cc by nd [1234] [05]", True),
    ("cc-by-nc-sa", r"cc by nc sa [1234] [05]", True),
    ("cc-by-nc-nd", r"cc by nc nd [1234] [05]", True),
    ("ms-pl", r"ms (?:pl|rl)", True),
    ("sspl", r"sspl 1 0", True),
    ("upl", r"upl 1 0", False),
)

#: Sentences of the licenses' own texts and notices: label, a keyword that stands in each, regex.
BODIES = (
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "above copyright notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("boost", "permission is hereby granted", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("isc", "permission to use", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("postgresql", "permission to use", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "endorse or promote", r"neither the names? of (?:[^ ]+ ){1,14}may be used to endorse or promote products derived from this software"),
    ("bsd", "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "held liable", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("apache", "apache license", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache", "contributor", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("gpl", "free software", r"free software you can redistribute it and or modify it under the terms of (?:version [123] of )?the gnu general public license"),
    ("gpl", "copyleft", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl", "freedom to share", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("lgpl", "free software", r"free software you can redistribute it and or modify it under the terms of (?:version [23](?: 1)? of )?the gnu (?:lesser|library) general public license"),
    ("agpl", "free software", r"free software you can redistribute it and or modify it under the terms of (?:version 3 of )?the gnu affero general public license"),
    ("agpl", "copyleft", r"the gnu affero general public license is a free copyleft license for software and other kinds of works"),
    ("gfdl", "permission is granted", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl", "source code form", r"this source code form is subject to the terms of the mozilla public license"),
    ("epl", "accompanying materials", r"this program and the accompanying materials are (?:made available|licensed) under the terms of the eclipse public license"),
    ("cddl", "common development", r"the contents of this file are subject to the terms of (?:either )?(?:[^ ]+ ){0,12}the common development and distribution license"),
    ("eupl", "eupl", r"licensed under the eupl"),
    ("artistic", "conditions under which", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("perl", "free software", r"free software you can redistribute it and or modify it under the same terms as the perl"),
    ("python", "psf is making", r"psf is making python available to licensee on an as is basis"),
    ("ruby", "copyrighted", r"ruby is (?:a )?(?:free )?copyrighted (?:free )?software"),
    ("php", "may not be called php", r"products derived from this software may not be called php"),
    ("unlicense", "unencumbered software", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "what the fuck", r"you just do what the fuck you want to"),
    ("cc0", "neighboring rights", r"waived all copyright and related or neighboring rights"),
    ("cc-by", "creative commons attribution", r"creative commons attribution (?:[1234] [05] )?(?:international |unported |generic )?(?:public )?licen[cs]e"),
    ("cc-by-sa", "creative commons attribution", r"creative commons attribution share ?alike (?:[1234] [05] )?(?:international |unported |generic )?(?:public )?licen[cs]e"),
    ("cc-by-nc", "creative commons attribution", r"creative commons attribution non ?commercial (?:[1234] [05] )?(?:international |unported |generic )?(?:public )?licen[cs]e"),
    ("ofl", "font software", r"this font software is licensed under the sil open font license"),
    ("ofl", "font software", r"the font software may be sold as part of a larger software package"),
    ("ogl", "public sector information", r"contains public sector information licen[cs]ed under the open government licen[cs]e"),
    ("ms-pl", "u s copyright law", r"the terms reproduce reproduction derivative works and distribution have the same meaning here as under u s copyright law"),
    ("bsl", "production use", r"the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("sspl", "third parties as a service", r"make the functionality of the program or a modified version available to third parties as a service"),
    ("public-domain", "public domain", r"(?:dedicated|placed|released|donated) (?:in|into|to) the public domain"),
    ("proprietary", "unauthori", r"unauthori[sz]ed (?:copying|reproduction|use|distribution)(?: or distribution)? of (?:this|the) (?:file|software|program|document|material)(?: via any medium)? is strictly prohibited"),
    ("proprietary", "proprietary and confidential", r"proprietary and confidential"),
)


def rules() -> list[tuple[str, tuple[str, ...], str, int, float]]:
    """(label, keywords, regex over the padded line, priority, confidence), strongest first."""
    out = [(label, (keyword,), f" {body}(?= )", 0, 1.0) for label, keyword, body in BODIES]
    # how SPDX identifiers end, in words
    ends = "[0-9]|only|later|clause|patent|mit|x11|bsd|isc|zlib|unlicense|wtfpl|ruby|postgresql"
    for label, name, plain in SPDX:
        out.append((label, ("spdx licen",), f" spdx licen[cs]e identifier {name}(?= )", 1, 1.0))
        # later members of an SPDX expression: the name is found first, then what stands before it is looked at
        out.append((label, ("spdx licen",), f" {name}(?<= spdx licen[cs]e identifier [a-z0-9 ]{{0,80}}(?:{ends}) (?:or|and) {name})(?= )", 1, 1.0))
        out.append((label, ("licen", " under "), f" (?:(?:licen[cs]ed|released|distributed|published|available) under (?:the )?|licen[cs]e (?:is )?){name}(?= )", 2, 0.9))
        if plain:
            out.append((label, (f" {name.partition(' ')[0]} ",), f" {name}(?= )", 3, 0.9))
    for label, keywords, name, version in FAMILIES:
        for kind, form, priority, confidence in FORMS:
            if "{version}" in form and kind != "grant" and not version:
                continue
            body = form.format(name=f"(?:{name})", version=f"(?:{version})?" if kind == "grant" and version else f"(?:{version})" if version else "")
            out.append((label, keywords, f" {body.rstrip()}(?= )".replace(" ?(?=", "(?="), priority, confidence))
    return sorted(out, key=lambda r: r[3])


#: What any rule matches holds one of these.
KEYWORDS = ("licen", "cc by", "cc0", "copyright", "public domain", "rights reserved", "gpl", "wtfpl", "creative commons", "cc zero", "bsd", "same terms as perl", "same terms as the perl")
KEYWORDS += ("permission is hereby granted", "permission to use", "redistribution and use", "endorse or promote", "advertising materials", "altered source versions", "held liable", "conditions under which", "may not be called php", "what the fuck", "font software", "third parties as a service", "unauthori", "proprietary and confidential")
KEYWORDS += (" under ", " gfdl ", " apache ", " mpl ", " cddl ", " eupl ", " artistic ", " busl ", " ofl ", " odbl ", " ogl ", " ms ", " sspl ")


def padded_line(text: Column) -> Column:
    """' w0 w1 … ' : the words of a text, each between two spaces; ' ' if there are none."""
    return F.regexp_replace(F.concat(F.lit(" "), ascii_lower(F.coalesce(text, F.lit(""))), F.lit(" ")), BREAK, " ")


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" ")))


def scan_licenses(docs: DataFrame, *keep: str, prefilter: bool = True) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels, score, detections to the columns ``keep`` of ``docs``.

    ``detections`` holds the places of rules that were kept: label, first word and the word after the last.
    ``prefilter`` changes the speed only.
    """
    # kept columns travel under numbers, so any names will do
    kept = [f"_k{i}" for i in range(len(keep))]
    line = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept, strict=True)], padded_line(F.col("text")).alias("line"))
    line = line.select(*kept, "line", (_spaces(F.col("line")) - 1).cast("long").alias("n_words"), reduce(lambda a, b: a | b, [F.col("line").contains(k) for k in KEYWORDS] if prefilter else [F.lit(True)]).alias("gate"))
    # base phrases: what stands between their places tells where they are
    for i, (phrase, _) in enumerate(BASE):
        here = F.col("line").contains(f" {phrase} ")
        line = line.withColumn(f"parts{i}", F.when(here, F.split("line", f" {phrase}(?= )", -1)))
    firsts, lasts, counts, labels = [], [], [], []
    for i, (phrase, label) in enumerate(BASE):
        parts, n = F.col(f"parts{i}"), len(phrase.split())
        counts.append(F.coalesce(F.size(parts) - 1, F.lit(0)))
        firsts.append(_spaces(F.element_at(parts, 1)))
        lasts.append(F.col("n_words") - (_spaces(F.element_at(parts, -1)) - 1) - n)
        labels.append(F.when(parts.isNotNull(), F.lit(label)))
    base = line.select(
        *kept,
        "line",
        "n_words",
        "gate",
        reduce(lambda a, b: a + b, [F.when(c > 0, c).otherwise(0) for c in counts]).cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_compact(F.array(*labels)).alias("base"),
    )
    kind = "array<struct<label:string,keywords:array<string>,regex:string,priority:int,confidence:double>>"
    names = ("label", "keywords", "regex", "priority", "confidence")
    literal = F.from_json(F.lit(json.dumps([dict(zip(names, r, strict=True)) for r in rules()])), kind)
    gated = F.filter(literal, lambda r: F.exists(r["keywords"], lambda k: F.contains(F.col("line"), k))) if prefilter else literal
    places = F.sort_array(F.flatten(F.transform(gated, _places)))
    found = base.withColumn("detections", F.when(F.col("gate"), _suppressed(places)).otherwise(F.array().cast(f"array<{_FOUND}>")))
    every = F.sort_array(F.array_union("base", F.transform("detections", lambda d: d["label"])))
    best = F.greatest(F.when(F.size("base") > 0, 0.8).otherwise(0.0), F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)))
    out = found.select(*kept, "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", F.sort_array("base")).alias("base_labels"), F.concat_ws(",", every).alias("labels"), best.alias("score"), "detections")
    return out.toDF(*keep, *out.columns[len(kept) :])


_FOUND = "struct<label:string,start:bigint,end:bigint,confidence:double>"
#: Arrays are built in pieces of so many, which are then put together: appending to one long array would copy it each time.
PIECE = 256


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _pieces(n: Column) -> Column:
    """Numbers of the pieces of an array of n."""
    return F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / PIECE).cast("int"))).otherwise(F.array().cast("array<int>"))


def _places(r: Column) -> Column:
    """Every place of a rule as (start, -end, priority, label, confidence), in words."""
    line = F.col("line")
    # words before and in each place: spaces in what stands before it and in it
    hits = F.transform(F.regexp_extract_all(line, r["regex"], F.lit(0)), _spaces)
    before = F.transform(F.split(line, r["regex"], -1), _spaces)
    long = lambda c: c.cast("bigint")

    def located(steps: Column) -> Column:
        """``steps``: (b)efore and (h)it in words; running sums, piece by piece."""

        def piece(o: Column, i: Column) -> Column:
            start = F.named_struct(F.lit("at"), o["at"], F.lit("out"), F.array().cast("array<struct<s:bigint,e:bigint>>"))
            ran = F.aggregate(
                F.slice(steps, i * PIECE + 1, F.lit(PIECE)),
                start,
                lambda a, x: F.named_struct(F.lit("at"), a["at"] + x["b"] + x["h"], F.lit("out"), F.concat(a["out"], F.array(F.named_struct(F.lit("s"), a["at"] + x["b"], F.lit("e"), a["at"] + x["b"] + x["h"])))),
            )
            return _let(ran, lambda p: F.named_struct(F.lit("at"), p["at"], F.lit("out"), F.concat(o["out"], F.array(p["out"]))))

        first = F.named_struct(F.lit("at"), F.lit(0).cast("bigint"), F.lit("out"), F.array().cast("array<array<struct<s:bigint,e:bigint>>>"))
        return F.aggregate(_pieces(F.size(steps)), first, piece, lambda o: F.flatten(o["out"]))

    steps = F.zip_with(F.slice(before, F.lit(1), F.size(hits)), hits, lambda b, h: F.named_struct(F.lit("b"), long(b), F.lit("h"), long(h)))
    return _let(steps, lambda x: F.transform(located(x), lambda p: F.struct(p["s"].alias("start"), (-p["e"]).alias("back"), r["priority"].alias("priority"), r["label"].alias("label"), r["confidence"].alias("confidence"))))


def _suppressed(places: Column) -> Column:
    """The places that are kept of ``places`` in order: no place within another; of two that overlap the one of higher priority."""
    last = "struct<label:string,start:bigint,end:bigint,confidence:double,priority:int>"
    bare = lambda x: F.named_struct(*[y for c in ("label", "start", "end", "confidence") for y in (F.lit(c), x[c])])

    def step(a: Column, x: Column) -> Column:
        """``last`` is the place in hand: a later one drops, replaces or settles it."""
        end = -x["back"]
        item = F.named_struct(F.lit("label"), x["label"], F.lit("start"), x["start"], F.lit("end"), end, F.lit("confidence"), x["confidence"], F.lit("priority"), x["priority"])
        none = a["last"].isNull()
        overlaps = ~none & (x["start"] < a["last"]["end"])
        drops = ~none & ((end <= a["last"]["end"]) | (overlaps & (x["priority"] >= a["last"]["priority"])))
        settled = F.when(none | overlaps | drops, a["done"]).otherwise(F.concat(a["done"], F.array(bare(a["last"]))))
        return F.named_struct(F.lit("done"), settled, F.lit("last"), F.when(drops, a["last"]).otherwise(item))

    def piece(o: Column, i: Column) -> Column:
        ran = F.aggregate(F.slice(every, i * PIECE + 1, F.lit(PIECE)), F.named_struct(F.lit("done"), F.array().cast(f"array<{_FOUND}>"), F.lit("last"), o["last"]), step)
        return _let(ran, lambda p: F.named_struct(F.lit("done"), F.concat(o["done"], F.array(p["done"])), F.lit("last"), p["last"]))

    def whole(o: Column) -> Column:
        return F.concat(F.flatten(o["done"]), F.when(o["last"].isNull(), F.array().cast(f"array<{_FOUND}>")).otherwise(F.array(bare(o["last"]))))

    every = None

    def run(x: Column) -> Column:
        nonlocal every
        every = x
        return F.aggregate(_pieces(F.size(x)), F.named_struct(F.lit("done"), F.array().cast(f"array<array<{_FOUND}>>"), F.lit("last"), F.lit(None).cast(last)), piece, whole)

    return _let(places, run)


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan_licenses(docs, "doc_id").drop("detections")
