"""Tokens aligned in rows against all pairs of a page, one by one."""

import random

import numpy as np
import pytest

from foliant.functions.text import plain_text_score
from foliant.operators import matching


def near(a, b):
    area = [max(0.0, x[2] - x[0]) * max(0.0, x[3] - x[1]) for x in (a, b)]
    shared = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    away = np.hypot((a[0] + a[2]) / 2 - (b[0] + b[2]) / 2, (a[1] + a[3]) / 2 - (b[1] + b[3]) / 2)
    return max(shared / max(1e-6, sum(area) - shared), max(0.0, 1 - away / (3 * max(1.0, (area[0] ** 0.5 + area[1] ** 0.5) / 2))))


def all_pairs(s, o, least=0.45):
    found = sorted(((0.7 * t + 0.3 * near(a[2:], b[2:]), a[0], b[0], kind) for a in s for b in o for t, kind in [plain_text_score(a[1], b[1])]), reverse=True)
    lefts, rights, kept = set(), set(), set()
    for score, i, j, kind in found:
        if score >= least and ("contains" in kind or (i not in lefts and j not in rights)):
            lefts.add(i)
            rights.add(j)
            kept.add((i, j, round(score, 9), kind))
    return kept


@pytest.mark.parametrize("seed", range(6))
def test_alignment_by_all_pairs(seed):
    r = random.Random(seed)
    words = ["a", "ab", "abc", "total", "totals", "subtotal", "date", "dated", "update", "über", "ยอด", "ยอดรวม", "xyz", "zyx", "invoice", "invoise"]
    s, o = ([(i, r.choice(words), x := r.randrange(30) * 20.0, y := r.randrange(3) * 12.0, x + r.choice([0.0, 15.0, 40.0]), y + 10) for i in range(60)] for _ in range(2))
    columns = [([t[0] for t in v], [t[1] for t in v], [np.array([t[k] for t in v]) for k in (2, 3, 4, 5)]) for v in (s, o)]
    got = matching.page_matches(*(tuple(c[k] for c in columns) for k in range(3)), 0.45, room=1000)  # several blocks
    assert {(i, j, round(score, 9), kind) for i, j, score, kind in got} == all_pairs(s, o)


def test_a_page_compares_each_pair_of_words_once(monkeypatch):
    seen = []
    monkeypatch.setattr(matching, "plain_text_score", lambda a, b: seen.append((a, b)) or plain_text_score(a, b))
    texts, x = ["same", "other"] * 400, np.arange(800) * 50.0
    box = [x, np.zeros(800), x + 40, np.full(800, 10.0)]
    assert len(matching.page_matches((list(range(800)),) * 2, (texts,) * 2, (box, box), 0.45)) == 800
    assert len(seen) == len(set(seen)) <= 4
