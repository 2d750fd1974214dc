"""Standard texts and notices that resemble others are reported under their own names."""

from __future__ import annotations

import pytest

from recscope.llm import license_dice as ld

GNU = (
    "This {what} is free software{mark} you can redistribute it and/or modify\nit under the terms of the GNU {kind}General Public License as published by\nthe Free Software Foundation{then} either version {version} of the License, or\n"
    "(at your option) any later version.\n\nThis {what} is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\n"
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU\n{kind}General Public License for more details.\n\nYou should have received a copy of the GNU {kind}General Public License\n"
    "along with this {what}.  If not, see <https://www.gnu.org/licenses/>.\n"
)


@pytest.mark.parametrize(
    ("name", "what", "kind", "version"),
    [("GPL-3.0", "program", "", "3"), ("AGPL-3.0", "program", "Affero ", "3"), ("LGPL-3.0", "program", "Lesser ", "3"), ("GPL-2.0", "program", "", "2"), ("LGPL-2.1", "library", "Lesser ", "2.1")],
)
def test_gnu_notices(name, what, kind, version):
    mark, then = (":", ",") if version == "3" else (";", ";")
    text = GNU.format(what=what, kind=kind, version=version, mark=mark, then=then)
    assert [f["license"] for f in ld.Matcher(ld.TEMPLATES, 0.8).scan(text)] == [name]


def test_third_clause():
    text = max(ld.TEMPLATES["BSD-2-Clause"], key=len).replace(
        " THIS SOFTWARE IS",
        "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS",
    )
    assert [f["license"] for f in ld.Matcher(ld.TEMPLATES, 0.8).scan(text)] == ["BSD-3-Clause"]


@pytest.mark.parametrize("name", ["Apache-2.0", "Zlib", "BSL-1.0", "0BSD", "ISC", "MIT", "MIT-0", "BSD-2-Clause", "BSD-3-Clause", "Unlicense", "WTFPL"])
@pytest.mark.parametrize("width", [40, 72])
def test_full_texts_in_wrapped_lines(name, width):
    import textwrap

    text = "Copyright (c) 2021 Somebody\n\n" + textwrap.fill(max(ld.TEMPLATES[name], key=len), width, break_on_hyphens=False)
    found = ld.Matcher(ld.TEMPLATES, 0.8).scan(text)
    assert [f["license"] for f in found] == [name]
    assert found[0]["dice"] > 0.95


def test_a_clause_put_in_does_not_hide_a_license():
    text = max(ld.TEMPLATES["MIT"], key=len)
    clause = " Users of this program are also asked to send a postcard to its author whenever they travel abroad. Thank you all very much for that."
    at = text.index(" THE SOFTWARE IS")
    assert [f["license"] for f in ld.Matcher(ld.TEMPLATES, 0.8).scan(text[:at] + clause + text[at:])] == ["MIT"]
