"""License scans: Dice coefficients over word bigrams against license templates.

A text is cut into sentences and lines. Of runs of units that share enough bigrams with the templates, every span of
consecutive units is compared with them: 2 |A and B| / (|A| + |B|) over the sets of word bigrams. A coefficient of
``threshold`` t bounds the sizes, |B| t / (2 - t) <= |A| <= |B| (2 - t) / t, so only templates within the bounds are
candidates of a segment, and a unit of which less than t / (2 - t) of the bigrams are in any template begins no
segment by itself; a run passes over up to ``BRIDGED`` such units, as of a clause that was put in. Of overlapping matches the
best one counts. A template of fewer than ``SHORT`` bigrams differs from another license's by a word or two, so it matches only where
the words that tell licenses apart (``TELLING``: names, negations; and whatever has a digit, such as versions) are the same as its own.

A span ends when it is larger than the bounds of the largest template, or when over half as many of its bigrams are repetitions as there are different ones: text
that repeats takes time in proportion to its length.

Words are in lower case without punctuation at their ends, ``licence`` is read as ``license``, and units that begin with
a copyright mark are left out, as are bigrams across units of different runs. Null and empty texts and single words match nothing. Ties go to the
longer segment, then to the template's name. Every row is scanned by itself; extra columns stay, one named like the
added column is replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recscope.llm.common import remembered

ENDS = " .,;:!?\"'()[]{}<>*#|-_/\\=~`“”‘’«»"
UNIT = re.compile(r"[^\n.!?]*(?:[.!?]+(?!\s|\Z)[^\n.!?]*)*(?:[.!?]+(?=\s|\Z)|\n|\Z)")
REMEMBER = 400_000
MATCHES = "array<struct<license:string,dice:double,start:int,end:int>>"

#: Bigrams from which on a template is told apart by its length.
SHORT = 30
#: Bigrams that a span may repeat besides half of its different ones.
REPEATS = 10

#: Sentences of no template that a run may pass over at once.
BRIDGED = 2

# Notices and license texts, as published (copyright lines left out). The full texts of MPL-2.0, GPL, LGPL, AGPL and
# Creative Commons are not among them.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "ISC": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ],
    "BSD-2-Clause": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0.",
        """1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. "Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License. "Legal Entity" shall mean the union of the acting entity and all other entities that control, are controlled by, or are under common control with that entity. For the purposes of this definition, "control" means (i) the power, direct or indirect, to cause the direction or management of such entity, whether by contract or otherwise, or (ii) ownership of fifty percent (50%) or more of the outstanding shares, or (iii) beneficial ownership of such entity. "You" (or "Your") shall mean an individual or Legal Entity exercising permissions granted by this License. "Source" form shall mean the preferred form for making modifications, including but not limited to software source code, documentation source, and configuration files. "Object" form shall mean any form resulting from mechanical transformation or translation of a Source form, including but not limited to compiled object code, generated documentation, and conversions to other media types. "Work" shall mean the work of authorship, whether in Source or Object form, made available under the License, as indicated by a copyright notice that is included in or attached to the work (an example is provided in the Appendix below). "Derivative Works" shall mean any work, whether in Source or Object form, that is based on (or derived from) the Work and for which the editorial revisions, annotations, elaborations, or other modifications represent, as a whole, an original work of authorship. For the purposes of this License, Derivative Works shall not include works that remain separable from, or merely link (or bind by name) to the interfaces of, the Work and Derivative Works thereof. "Contribution" shall mean any work of authorship, including the original version of the Work and any modifications or additions to that Work or Derivative Works thereof, that is intentionally submitted to Licensor for inclusion in the Work by the copyright owner or by an individual or Legal Entity authorized to submit on behalf of the copyright owner. For the purposes of this definition, "submitted" means any form of electronic, verbal, or written communication sent to the Licensor or its representatives, including but not limited to communication on electronic mailing lists, source code control systems, and issue tracking systems that are managed by, or on behalf of, the Licensor for the purpose of discussing and improving the Work, but excluding communication that is conspicuously marked or otherwise designated in writing by the copyright owner as "Not a Contribution." "Contributor" shall mean Licensor and any individual or Legal Entity on behalf of whom a Contribution has been received by Licensor and subsequently incorporated within the Work. 2. Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form. 3. Grant of Patent License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except as stated in this section) patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work, where such license applies only to those patent claims licensable by such Contributor that are necessarily infringed by their Contribution(s) alone or by combination of their Contribution(s) with the Work to which such Contribution(s) was submitted. If You institute patent litigation against any entity (including a cross-claim or counterclaim in a lawsuit) alleging that the Work or a Contribution incorporated within the Work constitutes direct or contributory patent infringement, then any patent licenses granted to You under this License for that Work shall terminate as of the date such litigation is filed. 4. Redistribution. You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications, and in Source or Object form, provided that You meet the following conditions: (a) You must give any other recipients of the Work or Derivative Works a copy of this License; and (b) You must cause any modified files to carry prominent notices stating that You changed the files; and (c) You must retain, in the Source form of any Derivative Works that You distribute, all copyright, patent, trademark, and attribution notices from the Source form of the Work, excluding those notices that do not pertain to any part of the Derivative Works; and (d) If the Work includes a "NOTICE" text file as part of its distribution, then any Derivative Works that You distribute must include a readable copy of the attribution notices contained within such NOTICE file, excluding those notices that do not pertain to any part of the Derivative Works, in at least one of the following places: within a NOTICE text file distributed as part of the Derivative Works; within the Source form or documentation, if provided along with the Derivative Works; or, within a display generated by the Derivative Works, if and wherever such third-party notices normally appear. The contents of the NOTICE file are for informational purposes only and do not modify the License. You may add Your own attribution notices within Derivative Works that You distribute, alongside or as an addendum to the NOTICE text from the Work, provided that such additional attribution notices cannot be construed as modifying the License. You may add Your own copyright statement to Your modifications and may provide additional or different license terms and conditions for use, reproduction, or distribution of Your modifications, or for any such Derivative Works as a whole, provided Your use, reproduction, and distribution of the Work otherwise complies with the conditions stated in this License. 5. Submission of Contributions. Unless You explicitly state otherwise, any Contribution intentionally submitted for inclusion in the Work by You to the Licensor shall be under the terms and conditions of this License, without any additional terms or conditions. Notwithstanding the above, nothing herein shall supersede or modify the terms of any separate license agreement you may have executed with Licensor regarding such Contributions. 6. Trademarks. This License does not grant permission to use the trade names, trademarks, service marks, or product names of the Licensor, except as required for reasonable and customary use in describing the origin of the Work and reproducing the content of the NOTICE file. 7. Disclaimer of Warranty. Unless required by applicable law or agreed to in writing, Licensor provides the Work (and each Contributor provides its Contributions) on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied, including, without limitation, any warranties or conditions of TITLE, NON-INFRINGEMENT, MERCHANTABILITY, or FITNESS FOR A PARTICULAR PURPOSE. You are solely responsible for determining the appropriateness of using or redistributing the Work and assume any risks associated with Your exercise of permissions under this License. 8. Limitation of Liability. In no event and under no legal theory, whether in tort (including negligence), contract, or otherwise, unless required by applicable law (such as deliberate and grossly negligent acts) or agreed to in writing, shall any Contributor be liable to You for damages, including any direct, indirect, special, incidental, or consequential damages of any character arising as a result of this License or out of the use or inability to use the Work (including but not limited to damages for loss of goodwill, work stoppage, computer failure or malfunction, or any and all other commercial damages or losses), even if such Contributor has been advised of the possibility of such damages. 9. Accepting Warranty or Additional Liability. While redistributing the Work or Derivative Works thereof, You may choose to offer, and charge a fee for, acceptance of support, warranty, indemnity, or other liability obligations and/or rights consistent with this License. However, in accepting such obligations, You may act only on Your own behalf and on Your sole responsibility, not on behalf of any other Contributor, and only if You agree to indemnify, defend, and hold each Contributor harmless for any liability incurred by, or claims asserted against, such Contributor by reason of your accepting any such warranty or additional liability.""",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ],
    "Zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "0BSD": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ],
    "MIT-0": [
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "WTFPL": [
        """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.""",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    ],
    "LGPL-2.1": [
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    ],
    "LGPL-3.0": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "Unlicense": [
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    ],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
}


# Words that tell licenses apart.
TELLING = frozenset(
    "mit isc bsd bsd-style apache zlib boost 0bsd mit-0 wtfpl gpl lgpl agpl gnu general lesser affero public mozilla mpl unlicense cc cc0 creative commons attribution by by-sa by-nc by-nd by-nc-sa by-nc-nd "
    "sharealike noncommercial noderivatives attribution-sharealike attribution-noncommercial attribution-noderivatives attribution-noncommercial-sharealike attribution-noncommercial-noderivatives "
    "eclipse epl eupl artistic perl python psf openssl php ruby x11 expat cddl osl afl cecill ofl json libpng postgresql vim proprietary commercial custom "
    "not no non never neither nor isn't aren't wasn't cannot can't longer except".split()
)
# Names of licenses as they are written, with their identifiers.
NAMES = {
    "MIT": ["MIT"], "ISC": ["ISC"], "0BSD": ["0BSD", "BSD Zero Clause"], "MIT-0": ["MIT-0", "MIT No Attribution"], "BSD-2-Clause": ["BSD 2-Clause", "BSD-2-Clause"], "BSD-3-Clause": ["BSD 3-Clause", "BSD-3-Clause"], "BSD-4-Clause": ["BSD 4-Clause", "BSD-4-Clause"],
    "Apache-1.0": ["Apache License, Version 1.0", "Apache License 1.0", "Apache-1.0"], "Apache-1.1": ["Apache License, Version 1.1", "Apache License 1.1", "Apache-1.1"], "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0", "BSL-1.0"], "Zlib": ["zlib"], "Unlicense": ["Unlicense"], "WTFPL": ["WTFPL"], "CC0-1.0": ["CC0 1.0", "CC0-1.0", "CC0 1.0 Universal"],
    "MPL-1.0": ["Mozilla Public License, version 1.0", "MPL-1.0", "MPL 1.0"], "MPL-1.1": ["Mozilla Public License, version 1.1", "MPL-1.1", "MPL 1.1"], "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0", "MPL 2.0"],
}
GNU = {"GPL": ("GNU General Public License", ("1", "2", "3")), "LGPL": ("GNU Lesser General Public License", ("2", "2.1", "3")), "AGPL": ("GNU Affero General Public License", ("1", "3"))}
COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}


def notices() -> dict[str, list[str]]:
    """Lines that name a license: its name alone, as an identifier, and in the usual sentences."""
    names = {k: list(v) for k, v in NAMES.items()}
    out: dict[str, list[str]] = {}
    for short, (long, versions) in GNU.items():
        for v in versions:
            key = f"{short}-{v if '.' in v else v + '.0'}"
            names[key] = [f"{long}, version {v}", f"{long} version {v}", f"{long} v{v}", f"{short}-{v if '.' in v else v + '.0'}", f"{short} v{v}", f"{short}v{v}", f"{short} version {v}"]
            out.setdefault(key, []).extend(f"SPDX-License-Identifier: {key}-{x}" for x in ("only", "or-later"))
    for short, long in COMMONS.items():
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            kind = "International" if v == "4.0" else "Unported" if v == "3.0" else "Generic"
            names[f"CC-{short}-{v}"] = [f"CC {short} {v}", f"CC-{short}-{v}", f"Creative Commons Attribution{long.removeprefix('Attribution')} {v} {kind}", f"Creative Commons {long} {v}"]
    for key, own in names.items():
        lines = out.setdefault(key, [])
        lines.append(f"SPDX-License-Identifier: {key}")
        for name in own:
            called = name if "License" in name else f"{name} License"
            lines += [f"{called}", f"Licensed under the {called}.", f"Released under the {called}.", f"Distributed under the {called}.", f"This work is licensed under the {called}.", f"This project is licensed under the terms of the {called}."]
            if called != name:
                lines += [f"Licensed under {name}.", f"Released under {name}.", *([name] if " " in name else [])]
            if name.startswith("Creative"):
                lines.append(f"This work is licensed under a {called}.")
    return {key: list(dict.fromkeys(lines)) for key, lines in out.items()}


def told(words: list[str]) -> frozenset[str]:
    """The words of a text that tell licenses apart."""
    return frozenset(w for w in words if w in TELLING or any(map(str.isdigit, w)))


#: The published texts with the lines that name a license.
ALL = {key: TEMPLATES.get(key, []) + [x for x in notices().get(key, []) if x not in TEMPLATES.get(key, [])] for key in [*TEMPLATES, *(k for k in notices() if k not in TEMPLATES)]}


class _Bare(dict):
    def __missing__(self, word: str) -> str:
        if len(self) > REMEMBER:
            self.clear()
        bare = self[word] = word.strip(ENDS).replace("licence", "license")
        return bare


def words_of(text: str) -> list[str]:
    own = remembered("license")
    bare = own.get("bare") or own.setdefault("bare", _Bare())
    return [w for w in map(bare.__getitem__, text.lower().split()) if w]


#: Words after ``copyright`` where a wrapped line of a license begins with it.
AFTER_COPYRIGHT = frozenset("notice notices holder holders owner owners license law laws and or statement statements interest patent".split())


def _is_copyright(words: list[str]) -> bool:
    """Whether a unit is a copyright mark: the sign, or the word with a year or a name."""
    if words[0] == "c":
        return any(w[:2] in ("19", "20") for w in words[1:2])
    return words[0] == "©" or (words[0] == "copyright" and words[1:2] != [] and words[1] not in AFTER_COPYRIGHT)


class Matcher:
    """License templates by size, with an index from bigram to templates."""

    def __init__(self, templates: dict[str, list[str]], threshold: float) -> None:
        each = sorted((len(b := set(pairwise(words_of(text)))), name, b) for name, texts in templates.items() for text in texts)
        self.sizes = [n for n, _, _ in each]
        self.size_array = np.array(self.sizes)
        self.told = [told([w for b in bigrams for w in b]) if n < SHORT else None for n, _, bigrams in each]
        self.names = [name for _, name, _ in each]
        self.threshold = threshold
        self.index: dict[tuple[str, str], list[int]] = defaultdict(list)
        for k, (_, _, bigrams) in enumerate(each):
            for b in bigrams:
                self.index[b].append(k)
        self.words = {w for b in self.index for w in b}

    def compare(self, words: list[str]) -> tuple[float, str] | None:
        """The best template above the threshold, and its coefficient."""
        own = set(pairwise(words))
        n, t = len(own), self.threshold
        low, high = bisect_left(self.sizes, n * t / (2 - t) - 1e-9), bisect_right(self.sizes, n * (2 - t) / t + 1e-9)
        if low >= high or not n:
            return None
        shared: Counter = Counter()
        for b in own:
            for k in self.index.get(b, ()):
                if low <= k < high:
                    shared[k] += 1
        best = max(((2 * m / (n + self.sizes[k]), -k) for k, m in shared.items()), default=(0.0, 0))
        return (best[0], self.names[-best[1]]) if best[0] >= t else None

    def spans(self, run: list[tuple[int, int, list[str]]], exact: bool = False) -> list[tuple]:
        """The best template above the threshold of every span of consecutive units, as a key to sort by; ``exact``: the best one
        whose telling words are the span's, of spans that don't repeat themselves.

        Runs of units that were met before in the same order aren't compared again.
        """
        found = []
        known: dict[str, tuple[list[str], list[tuple]]] = {}
        texts = [" ".join(w) for _, _, w in run]
        for i, (start, _, _) in enumerate(run):
            met = known.get(texts[i])
            if met is None or texts[i : i + len(met[0])] != met[0] or (len(met[0]) == len(run) - i + 1):
                met = known[texts[i]] = self._from(run, texts, i, exact)
            for dice, k, n in met[1]:
                end = run[i + n][1]
                found.append((-dice, start - end, self.names[k], start, end))
        return found

    def _from(self, run: list[tuple[int, int, list[str]]], texts: list[str], i: int, exact: bool) -> tuple[list[str], list[tuple]]:
        """(units that were looked at, (coefficient, template, units after the first one) of the spans that begin with a unit)."""
        t = self.threshold
        most = self.sizes[-1] * (2 - t) / t + 1e-9 if self.sizes else 0
        own: set = set()
        seen, out = 0, []
        shared = np.zeros(len(self.sizes), np.int64)
        last: list[str] = []
        said: set[str] = set()
        for at in range(i, len(run)):
            words = run[at][2]
            fresh = []
            for b in pairwise(last + words):
                seen += 1
                if b not in own:
                    own.add(b)
                    fresh += self.index.get(b, ())
            if fresh:
                np.add.at(shared, fresh, 1)
            said |= told(words)
            last = words[-1:]
            n = len(own)
            if n > most or (exact and seen - n > n / 2 + REPEATS):
                return texts[i : at + 1], out
            low, high = bisect_left(self.sizes, n * t / (2 - t) - 1e-9), bisect_right(self.sizes, n * (2 - t) / t + 1e-9)
            if not n or low >= high:
                continue
            dice = 2 * shared[low:high] / (n + self.size_array[low:high])
            good = np.flatnonzero(dice >= t)
            for k in good[np.argsort(-dice[good], kind="stable")].tolist():
                if not exact or self.told[low + k] is None or self.told[low + k] == said:
                    out.append((float(dice[k]), low + k, at - i))
                    break
        return [*texts[i:], ""], out  # ended by the run, not by its own units

    def scan(self, text: str) -> list[dict]:
        """Matches by place, none overlapping another."""
        share = self.threshold / (2 - self.threshold)
        runs: list[list[tuple[int, int, list[str]]]] = [[]]
        unknown: list[tuple[int, int, list[str]]] = []
        for m in UNIT.finditer(text):
            words = words_of(m[0])
            if not words or _is_copyright(words):
                continue
            bigrams = list(pairwise(words))
            met = sum(b in self.index for b in bigrams)
            bridges = len(words) == 1 and words[0] in self.words and bool(runs[-1])  # such as a version's number
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            unit = start, m.start() + len(m[0].rstrip()), words
            if bridges or (met and met >= share * len(bigrams) / 2):
                runs[-1] += [*unknown, unit]
                unknown = []
            elif runs[-1]:
                unknown.append(unit)
                if len(unknown) > BRIDGED:
                    runs.append([])
                    unknown = []
        found = []
        for run in runs:
            found += self.spans(run, exact=True)
        kept: list[tuple[int, int, float, str]] = []
        for dice, _, name, start, end in sorted(found):
            at = bisect_left(kept, (start,))
            if (at == len(kept) or kept[at][0] >= end) and (at == 0 or kept[at - 1][1] <= start):
                kept.insert(at, (start, end, -dice, name))
        return [{"license": name, "dice": dice, "start": start, "end": end} for start, end, dice, name in kept]


def licenses(df: DataFrame, threshold: float = 0.8, text: str = "text", out: str = "licenses", templates: dict[str, list[str]] = ALL) -> DataFrame:
    """Add ``out``: the licenses of ``text``, as an array of name, coefficient and place (code points, end exclusive)."""

    @F.arrow_udf(MATCHES)
    def matched(texts: pa.Array) -> pa.Array:
        key = threshold, hash(str(templates))
        matchers = remembered("license")
        if key not in matchers:
            matchers[key] = Matcher(templates, threshold)
        matcher = matchers[key]
        kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))
        return pa.array([matcher.scan(t) for t in texts.to_pylist()], kind)

    return df.withColumn(out, matched(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))))
