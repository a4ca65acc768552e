"""Licence expressions against a recursive-descent parser, and prose after a tag."""

import random

import pytest

from brindle.llm import licences as L

LICENCES = {"MIT": 1.0, "GPL-3.0-or-later": 0.3, "Apache-2.0": 0.95, "mpl-2.0": 0.6, "LicenseRef-own": 0.5, "LGPL-2.1+": 0.5, "Zlib": 0.5}
EXCEPTIONS = ["Classpath-exception-2.0", "GCC-exception-3.1"]


def longest(tokens):
    """(value, labels) of the longest head that is an expression after closing its brackets; None without one."""

    def parse(tokens, closing):
        at = [0]

        def peek():
            return tokens[at[0]] if at[0] < len(tokens) else None

        def either():
            value, labels = both()
            while (peek() or "").lower() == "or":
                at[0] += 1
                other, more = both()
                value, labels = max(value, other), labels + more
            return value, labels

        def both():
            value, labels = one()
            while (peek() or "").lower() == "and":
                at[0] += 1
                other, more = one()
                value, labels = min(value, other), labels + more
            return value, labels

        def one():
            t = peek()
            at[0] += 1
            if t == "(":
                out = either()
                if peek() != ")":
                    raise ValueError
                at[0] += 1
            elif t in LICENCES:
                out = LICENCES[t], [L.label_of(t)]
            else:
                raise ValueError
            while (peek() or "").lower() == "with":
                if tokens[at[0] + 1 : at[0] + 2] and tokens[at[0] + 1] in EXCEPTIONS:
                    at[0] += 2
                else:
                    raise ValueError
            return out

        got = either()
        if at[0] != len(tokens):
            raise ValueError
        return got

    for n in range(len(tokens), 0, -1):
        head = tokens[:n]
        open_brackets = head.count("(") - head.count(")")
        if open_brackets < 0:
            continue
        try:
            return parse(head + [")"] * open_brackets, open_brackets)
        except ValueError:
            continue
    return None


def test_shunting_yard_matches_recursive_descent():
    rng = random.Random(5)
    words = [*LICENCES, *EXCEPTIONS, "AND", "or", "And", "OR", "WITH", "with", "(", ")", "see", "business"]
    seen = set()
    for _ in range(20_000):
        tokens = []
        for _ in range(rng.randrange(1, 12)):
            tokens.append(rng.choice(words[: len(LICENCES)] if rng.random() < 0.45 else words))
        want, got = longest(tokens), L.evaluate(" ".join(tokens))
        assert (got is None) == (want is None), tokens
        if want:
            assert got[0] == want[0] and sorted(got[1]) == sorted(want[1]), tokens
        seen.add(want and want[0])
    assert seen >= {None, 1.0, 0.3, 0.95, 0.6, 0.5}


@pytest.mark.parametrize("line", ["see file LICENSE.txt", "none of your business", "NOASSERTION", "NONE", "mitigate this", "the usual", "gpled", "a and b", "apachean tribes", "", "()", "with care"])
def test_prose_after_a_tag_names_nothing(line):
    n, notices, expressions, labels, score = L.Scanner(L.BASE | L.MORE).scan(f"x\nSPDX-License-Identifier: {line}\ny")
    assert (notices, expressions, labels, score) == ([], [], [], 0.0)


@pytest.mark.parametrize("line,labels,score", [("MIT", ["mit"], 1.0), ("mit-0", ["mit"], 1.0), ("BSD-3-Clause", ["bsd"], 1.0), ("0BSD", ["bsd"], 1.0), ("GPL-2.0-only WITH Classpath-exception-2.0 */", ["gpl"], 0.3), ("Apache-2.0 see NOTICE", ["apache"], 0.95), ("CC-BY-SA-4.0", ["cc-by"], 0.8), ("GPLv3+", ["gpl"], 0.3), ("Zlib", ["zlib"], 0.5), ("LicenseRef-Acme.1", ["licenseref-acme.1"], 0.5), ("MIT WITH love", ["mit"], 1.0)])
def test_identifiers(line, labels, score):
    got = L.Scanner(L.BASE | L.MORE).scan(f"SPDX-License-Identifier: {line}")
    assert got[3] == labels and got[4] == score
