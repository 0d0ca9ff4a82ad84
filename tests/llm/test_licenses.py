"""License rules by family: texts with their labels, expressions, words that make a detection something else, suppression."""

import random

import pytest

from lodestar.llm import licenses


def found(text):
    normal = b" " + b" ".join(licenses.normalise(text)) + b" "
    return licenses.suppress(licenses.base_places(normal) + licenses.detections(normal, licenses.rules()))


@pytest.mark.parametrize(("text", "labels"), [
    ("Mozilla Public License Version 2.0", {"mpl-2"}),
    ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", {"gpl-3"}),
    ("BSD-3-Clause", {"bsd-3"}),
    ("GPL-3.0-or-later", {"gpl-3"}),
    ("Redistributions of source code must retain the above copyright notice", {"bsd"}),
    ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", {"gpl-3"}),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", {"mit", "apache-2"}),
    ("He is licensed in MIT licence office", set()),
    ("the number of an Apache license plate", set()),
    ("// SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0 OR EPL-2.0) AND BSD-3-Clause\nimport x", {"gpl-2", "epl-2", "bsd-3"}),
    ("SPDX-License-Identifier: nothing known OR MIT", set()),
    ("SPDX-License-Identifier: ISC\nSPDX-License-Identifier: Zlib", {"isc", "zlib"}),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", {"mpl-2"}),
    ("Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.", {"zlib"}),
    ("This is free and unencumbered software released into the public domain.", {"unlicense"}),
    ("The Software shall be used for Good, not Evil.", {"json"}),
    ("either version 2.1 of the License", set()),
    ("", set()),
])
def test_labels(text, labels):
    assert {d.label for d in found(text)} == labels


def test_the_parts_of_an_expression_lie_side_by_side():
    parts = [(d.start, d.end) for d in sorted(found("x SPDX-License-Identifier: MIT OR Apache-2.0 OR GPL-3.0-or-later y"), key=lambda d: d.start)]
    assert parts == [(1, 5), (5, 9), (9, 15)]


def test_suppression_is_that_of_all_pairs():
    rng = random.Random(5)
    for _ in range(300):
        every = [licenses.Detection(a, a + rng.randint(1, 6), "x", 0.5, k) for k, a in enumerate(rng.choices(range(12), k=rng.randint(0, 14)))]
        inside = lambda d, o: o.start <= d.start and d.end <= o.end and ((o.start, o.end) != (d.start, d.end) or o.priority < d.priority)
        want = {d for d in every if not any(inside(d, o) for o in every if o != d)}
        assert set(licenses.suppress(every)) == want


def test_rules_are_written_out_and_gated():
    written = [*licenses.TITLES, *licenses.NOTICES, *licenses.CLAUSES, *licenses.OTHERS]
    assert len(written) + len(licenses.NAMES) > 150 and len(set(r[2] for r in written)) > 100


def test_a_long_text_of_detections_stays_linear():
    import time

    began = time.time()
    assert len(found("SPDX-License-Identifier: MIT OR Apache-2.0\n" * 20_000)) == 40_000 and time.time() - began < 20
