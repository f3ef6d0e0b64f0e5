"""The license scan's prefilter against the rules without it."""

from re import _parser as parser
from itertools import product

import pytest

from lectern.llm import op10_license_scan as op10


def said(pattern):
    """All strings a regex matches; what repeats without a small bound is tried at its least."""

    def some(tokens):
        return ["".join(x) for x in product(*[one(*t) for t in tokens])]

    def one(op, arg):
        op = str(op)
        if op == "LITERAL":
            return [chr(arg)]
        if op == "IN":
            return [chr(c) for kind, x in arg if str(kind) != "NEGATE" for c in ([x] if str(kind) == "LITERAL" else x[:1])] if str(arg[0][0]) != "NEGATE" else ["x"]
        if op == "NOT_LITERAL":
            return ["x"]
        if op == "MAX_REPEAT":
            least, most, inner = arg
            return [s for n in {least, most if most <= 1 else least} for s in ("".join(x) for x in product(some(inner), repeat=n))]
        if op == "SUBPATTERN":
            return some(arg[3])
        if op == "BRANCH":
            return [s for b in arg[1] for s in some(b)]
        if op == "ASSERT":
            return [""]
        raise ValueError(op)

    return sorted(set(some(parser.parse(pattern))))


@pytest.mark.parametrize("family", op10.FAMILIES, ids=lambda f: f[0])
def test_keywords_cover_names(family):
    for text in said(family[2]):
        assert any(k in text for k in family[1]) and any(k in text for k in op10.KEYWORDS), text


def test_prefilter_is_lossless(spark):
    short = [("Released under the GPLv3", "gpl"), ("GNU GPL", "gpl"), ("gpl2", "gpl"), ("see LGPLv2", "lgpl"), ("GNU Library General Public License", "lgpl"), ("AGPLv3", "agpl"), ("Expat license", "mit"), ("CC Zero", "cc0")]
    texts = [t for t, _ in short] + [t for f in op10.FAMILIES for t in said(f[2])]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    with_, without = ({r.doc_id: r for r in op10.scan_licenses(d, "doc_id", prefilter=p).collect()} for p in (True, False))
    assert with_ == without
    assert [with_[i].labels for i in range(len(short))] == [label for _, label in short]
    assert all(with_[i].labels and with_[i].score > 0 for i in with_)


def test_bodies_and_spdx(spark):
    want = [
        ("SPDX-License-Identifier: MIT", "mit"),
        ("SPDX-License-Identifier: Apache-2.0", "apache"),
        ("// SPDX-License-Identifier: GPL-3.0-only", "gpl"),
        ("SPDX-License-Identifier: MPL-2.0", "mpl"),
        ("SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause", "apache,bsd,mit"),
        ("under LGPL-2.1-or-later", "lgpl"),
        ("License: ISC", "isc"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"),
        ("This is free and unencumbered software released into the public domain.", "unlicense"),
        ("You just DO WHAT THE FUCK YOU WANT TO.", "wtfpl"),
        ("You can redistribute the file and use PHP 3.0, which took 10 ms", ""),
    ]
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(want)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in op10.scan_licenses(d, "doc_id").collect()}
    assert [got[i] for i in range(len(want))] == [w for _, w in want]


def test_keywords_cover_bodies_and_ids(spark):
    """Each rule's own sentence passes both filters and finds its rule."""
    texts = [(label, t) for label, _, body in op10.BODIES for t in said(body)] + [(label, f"spdx license identifier {t}") for label, name, _ in op10.SPDX for t in said(name)] + [(label, t) for label, name, plain in op10.SPDX if plain for t in said(name)]
    d = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    with_, without = ({r.doc_id: r for r in op10.scan_licenses(d, "doc_id", prefilter=p).collect()} for p in (True, False))
    assert with_ == without
    assert [(x, texts[i][1], with_[i].labels) for i, (x, _) in enumerate(texts) if x not in with_[i].labels.split(",")] == []
