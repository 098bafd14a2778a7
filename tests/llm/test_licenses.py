"""Each license rule fires on every sentence that its pattern spells."""

import re
from itertools import product

import pytest

from filingrisk.llm import licenses
from filingrisk.llm.signatures import RULES


def spelled(tree):
    """All texts of a parsed rule; a repeat is taken at its least and its most (2 for an endless one)."""
    parts = []
    for op, value in tree:
        kind = str(op)
        if kind == "LITERAL":
            parts.append([chr(value)])
        elif kind == "IN":
            parts.append(["w"] if str(value[0][0]) == "NEGATE" else [chr(v) for _, v in value])
        elif kind == "NOT_LITERAL":
            parts.append(["w"])
        elif kind == "BRANCH":
            parts.append([t for branch in value[1] for t in spelled(branch)])
        elif kind == "SUBPATTERN":
            parts.append(spelled(value[3]))
        else:
            least, most, inner = value
            parts.append([t * n for t in spelled(inner) for n in {least, min(int(most), 8) if int(most) < 100 else least + 1}])
    return ["".join(p) for p in product(*parts)]


@pytest.mark.parametrize("gap", [" ", "\n", " - "])
def test_every_rule_fires(gap):
    missed = []
    for line in RULES.strip().splitlines():
        _, label, _, rule = (x.strip() for x in line.split("|", 3))
        for text in spelled(re._parser.parse(rule)):
            low = f"see {text}, here".replace(" ", gap).encode()
            n = len(text.replace(",", " ").split())
            found = licenses.detect(low, licenses.word_starts(low))
            # The rule's own place, or one of a better rule that holds it.
            if not any(a <= 1 and b >= 1 + n for _, _, a, b in found):
                missed.append((label, text))
    assert not missed


@pytest.mark.parametrize(
    "text, label",
    [
        ("under mplv2.0", "mpl-2.0"),
        ("EUPLv1.2 applies", "eupl-1.2"),
        ("Creative Commons Attribution-ShareAlike", "cc-by-sa"),
        ("Creative Commons Attribution-NonCommercial", "cc-by-nc"),
        ("Attribution Non-Commercial", "cc-by-nc"),
        ("Attribution-NoDerivatives", "cc-by-nd"),
        ("OpenRAIL license", "openrail"),
        ("Beerware license", "beerware"),
        ("https://www.eclipse.org/legal/epl-v20.html", "epl"),
        ("GNU General Public License v2.0", "gpl-2.0"),
        ("All rights\nreserved", "all-rights-reserved"),
        ("in the public\n// domain: released into the public\n// domain", "public-domain"),
        (
            "Neither the name of the copyright holder nor the names of its\n# contributors may be used to endorse or promote products",
            "bsd-3-clause",
        ),
    ],
)
def test_named_cases(text, label):
    assert label in licenses.scan(text)[5].split(",")
