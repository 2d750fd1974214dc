"""License texts that follow one another, against every span of units by definition."""

from __future__ import annotations

import itertools
import random
from itertools import pairwise

import pytest

from recscope.llm import license_dice as ld


def paragraphs(name: str, n: int) -> str:
    """The longest template of a license, in ``n`` paragraphs of sentences."""
    sentences = [s for s in ld.UNIT.findall(max(ld.TEMPLATES[name], key=len)) if s.strip()]
    n = min(n, len(sentences))
    return "\n\n".join("".join(sentences[k * len(sentences) // n : (k + 1) * len(sentences) // n]).strip() for k in range(n))


@pytest.mark.parametrize("between", ["\n\n", "\n\nCopyright 2020 Somebody\n\n"])
@pytest.mark.parametrize(("a", "b"), list(itertools.permutations(["MIT", "ISC", "BSD-2-Clause", "GPL-3.0"], 2)))
def test_consecutive_licenses_are_all_reported(a, b, between):
    matcher = ld.Matcher(ld.TEMPLATES, 0.8)
    found = matcher.scan(paragraphs(a, 3) + between + paragraphs(b, 4))
    assert [f["license"] for f in found] == [a, b]
    assert all(f["dice"] > 0.95 for f in found)


def test_spans_are_those_of_brute_force():
    draw = random.Random(5)
    matcher = ld.Matcher(ld.TEMPLATES, 0.8)
    units = [u.split() for texts in ld.TEMPLATES.values() for t in texts for u in ld.UNIT.findall(t) if u.strip()]
    for _ in range(40):
        at = draw.randrange(len(units) - 8)
        run = [(k, k + 1, ld.words_of(" ".join(w if draw.random() > 0.05 else "foo" for w in u))) for k, u in enumerate(units[at : at + 8])]
        run = [u for u in run if u[2]]
        expected = []
        for i, j in itertools.combinations(range(len(run) + 1), 2):
            own = set(pairwise([w for u in run[i:j] for w in u[2]]))
            scores = [2 * len(own & b) / (len(own) + len(b)) for texts in ld.TEMPLATES.values() for t in texts if (b := set(pairwise(ld.words_of(t))))]
            if own and max(scores) >= 0.8:
                expected.append((run[i][0], run[j - 1][1], max(scores)))
        assert [(s, e, -d) for d, _, _, s, e in matcher.spans(run)] == expected
