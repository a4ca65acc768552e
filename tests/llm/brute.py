"""Plain Python versions of the operators, for comparison on small tables."""

from __future__ import annotations


def ws_words(text: str | None) -> list[tuple[int, int, bytes]]:
    """(start, end, lower-cased word) by bytes."""
    import re

    raw = (text or "").encode()
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)
    return [(m.start(), m.end(), m.group()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", low)]


def substring_dedup(rows, run: int, min_line: int, digest):
    """Expected (doc_id, n_words, n_removed, kept words) with the same choice of passages: digest(list of words) orders runs."""
    first: dict = {}
    units = []
    for doc_id, text, tk in rows:
        words = ws_words(text)
        w = [x[2] for x in words]
        raw = (text or "").encode()
        own = []
        if w:
            own.append((("t", *w), 0, len(w)))
        lo = 0
        for i in range(1, len(w) + 1):
            if i == len(w) or b"\n" in raw[words[i - 1][1] : words[i][0]]:
                if i - lo >= min_line:
                    own.append((("l", *w[lo:i]), lo, i - lo))
                lo = i
        feeds = [raw[words[i - 1][1] : words[i][0]].count(b"\n") for i in range(1, len(w))]
        for lo in [i for i in range(len(w)) if not i or feeds[i - 1] > 1]:  # paragraphs
            hi = next((i for i in range(lo + 1, len(w)) if feeds[i - 1] > 1), len(w))
            cuts = [lo, *(i for i in range(lo + 1, hi) if feeds[i - 1]), hi]
            if min_line <= hi - lo < len(w) and min(b - a for a, b in zip(cuts, cuts[1:])) < min_line:
                own.append((("p", *w[lo:hi]), lo, hi - lo))
        n = len(w) - run + 1
        if n > 0:
            d = digest(w, run)
            picked = set()
            for a in range(max(1, n - run)):
                span = range(a, min(n, a + run + 1))
                picked.add(min(span, key=lambda j: (d[j], j)))
            own += [(("r", *w[p : p + run]), p, run) for p in picked]
        units.append((doc_id, tk, w, own))
        for u, at, size in own:
            key = (doc_id is not None, doc_id, tk, at)
            if u not in first or key < first[u]:
                first[u] = key
    out = []
    for doc_id, tk, w, own in units:
        gone = [False] * len(w)
        for u, at, size in own:
            f = first[u]
            if (f[0], f[1], f[2]) != (doc_id is not None, doc_id, tk) or at >= f[3] + size:
                gone[at : at + size] = [True] * size
        out.append((doc_id, len(w), sum(gone), [x for x, g in zip(w, gone) if not g]))
    return out
