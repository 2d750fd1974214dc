"""Notices that differ by a word name their own license or none; texts that repeat take linear time."""

from __future__ import annotations

import time

import pytest

from recscope.llm import license_dice as ld

MATCHER = ld.Matcher(ld.ALL, 0.8)


def names(text: str) -> list[str]:
    return [f["license"] for f in MATCHER.scan(text)]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Licensed under the Apache License, Version 1.1.", ["Apache-1.1"]),
        ("Licensed under the Apache License, Version 7.3.", []),
        ("This work is licensed under a Creative Commons Attribution 3.0 Unported License.", ["CC-BY-3.0"]),
        ("This work is licensed under a Creative Commons Attribution 3.0 International License.", ["CC-BY-3.0"]),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", ["CC-BY-4.0"]),
        ("This work is licensed under the GNU General Public License, version 1.", ["GPL-1.0"]),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0"]),
        ("This library is licensed under the GNU Lesser General Public License, version 2.1.", ["LGPL-2.1"]),
        ("This work is licensed under the GNU Affero General Public License, version 3.", ["AGPL-3.0"]),
        ("Distributed under the Boost Software License, Version 2.0.", []),
        ("This project is licensed under the terms of the GPL license.", []),
        ("This project is licensed under the terms of the Proprietary license.", []),
        ("This project is not licensed under the terms of the MIT license.", []),
        ("This project is licensed under the terms of the MIT license.", ["MIT"]),
        ("This parser is licensed under the terms of the MIT license.", ["MIT"]),
        ("MIT License", ["MIT"]),
        ("# SPDX-License-Identifier: MIT", ["MIT"]),
        ("SPDX-License-Identifier: GPL-2.0-or-later", ["GPL-2.0"]),
        ("BSD 2-Clause", ["BSD-2-Clause"]),
        ("CC BY-SA 3.0", ["CC-BY-SA-3.0"]),
        ("A license.", []),
        ("The license is public.", []),
    ],
)
def test_lines(text, expected):
    assert names(f"Nothing to see here at all.\n\n{text}\n\nNor is there anything here, my friend.") == expected


def test_every_notice_names_its_own_license():
    """Each against all others, in all the usual sentences."""
    wrong = {line: names(line) for key, lines in ld.notices().items() for line in lines if names(line) != [key]}
    assert not wrong


@pytest.mark.parametrize("line", ["Licensed under the MIT License.\n", "MIT License\nLicensed under the Apache License, Version 2.0.\n", "the software is provided as is\n", "software\n"])
def test_repeated_lines_take_linear_time(line):
    MATCHER.scan(line)
    began = time.perf_counter()
    found = MATCHER.scan(line * (100_000 // line.count("\n")))
    assert time.perf_counter() - began < 5
    if "icense" in line:
        assert len(found) >= 10_000


def test_a_license_many_times_over():
    text = max(ld.TEMPLATES["MIT"], key=len)
    began = time.perf_counter()
    found = MATCHER.scan(f"{text}\n\n" * 300)
    assert time.perf_counter() - began < 10 and {f["license"] for f in found} == {"MIT"}
    covered = sum(f["end"] - f["start"] for f in found)
    assert covered > 0.95 * 300 * len(text)
