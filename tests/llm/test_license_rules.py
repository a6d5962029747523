"""Every rule on strings of its own pattern, through the keyword gate."""

import itertools
import random
import re
import re._parser as parser

import pytest

from hopweave.llm import license_scan as s
from hopweave.llm.license_passages import SIGNATURES
from tests.llm.test_license_scan import labels


def strings(tree):
    """Strings that a parsed pattern matches: each branch, each optional part with and without, \\w+ as one letter."""
    parts = []
    for op, value in tree:
        name = str(op)
        if name == "LITERAL":
            parts.append([chr(value)])
        elif name == "IN":
            parts.append(["w"] if str(value[0][0]) == "CATEGORY" else [chr(c) for _, c in value])
        elif name == "BRANCH":
            parts.append([x for b in value[1] for x in strings(b)])
        elif name == "SUBPATTERN":
            parts.append(strings(value[3]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            parts.append([x for n in {value[0], max(value[0], 1)} for x in ("" if n == 0 else None,) if n == 0] + (strings(value[2]) if value[1] else []))
        elif name not in ("ASSERT",):
            raise ValueError(name)
    return ["".join(x) for x in itertools.product(*parts)]


def test_every_rule_fires_on_all_its_strings():
    draw, dead = random.Random(1), []
    for r in s.rules():
        made = strings(parser.parse(r.pattern.pattern.decode()))
        for text in made if r.priority == 1 else draw.sample(made, min(len(made), 12)):
            if r.label not in labels(text):
                dead.append((r.label, text, labels(text)))
    assert not dead, (len(dead), dead[:20])


@pytest.mark.parametrize("text, want", [
    ("Licensed under AGPLv3", "AGPL-3.0"), ("agpl3", "AGPL-3.0"), ("LGPLv2.1", "LGPL-2.1"), ("LGPLv3", "LGPL-3.0"), ("gpl2", "GPL-2.0"), ("gpl3", "GPL-3.0"), ("GPLv3", "GPL-3.0"), ("FreeBSD license", "BSD-2-Clause"),
    ("SPDX-License-Identifier: MIT", "MIT"), ("SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("SPDX-License-Identifier: ISC", "ISC"), ("released under Apache 2.0", "Apache-2.0"), ("relicensed under MIT-0", "MIT-0"),
])
def test_names_in_one_word_and_identifiers(text, want):
    assert labels(text) == [want] and s.scan(text.encode(), s.gate())[6] > 0


def test_identifiers_alone_are_no_licence():
    assert labels("MIT and Apache 2.0, available under PostgreSQL") == []


def test_signatures_by_hand():
    """Each by a string of its own, with punctuation, capitals and line breaks between the words."""
    marks = itertools.cycle([", ", " ", "\n * ", '" ', ". ", " ("])
    seen = set()
    for label, word, pattern in SIGNATURES:
        for text in strings(parser.parse(pattern))[:6]:
            text = re.sub(" +", " ", text)
            assert word in text.split(" "), (label, word, text)
            written = "".join(w.capitalize() + next(marks) for w in text.strip().split(" "))
            assert label in labels("Prose before. " + written + " and after"), (label, text, labels(written))
            seen.add(text)
    assert len(SIGNATURES) > 100 and len(seen) > 150


@pytest.mark.parametrize("text, want", [
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", ["MIT"]),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", ["0BSD"]),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ["ISC"]),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", ["GPL-2.0", "gpl"]),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License", ["LGPL-2.1", "gpl"]),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", ["Apache-2.0"]),
    ("Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software", ["BSD-3-Clause"]),
    ("No part of this publication may be reproduced. All rights reserved.", ["Proprietary", "reserved"]),
    ("Redistribution of books is a fine hobby, and permission to use the kitchen is granted", []),
    ("The internal rules say: use only for government work in the public interest", []),
])
def test_labelled_snippets(text, want):
    assert labels(text) == want
