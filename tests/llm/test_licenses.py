import random
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.llm import licenses

TOY = {"p": "a b c a b d a b c e", "q": "b c a b c a", "r": "e e e a b"}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list("abcdez")), max_size=60))
def test_matching_statistics(words):
    a = licenses.build(TOY)
    tokens = [a.vocabulary.get(w) for w in words]
    strings = {n: t.split() for n, t in TOY.items()}

    def places(part):
        return {(k, i + len(part)) for k, t in enumerate(strings.values()) for i in range(len(t) - len(part) + 1) if t[i : i + len(part)] == part}

    sizes = []
    for i, (size, state) in enumerate(licenses.statistics(tokens, a)):
        best = max((n for n in range(i + 2) if not n or places(words[i + 1 - n : i + 1])), default=0)
        assert size == best
        if size:
            assert set(a.ends[state]) >= places(words[i + 1 - size : i + 1]) and set(a.ends[state]) <= places(words[i + 1 - size : i + 1])
        sizes.append((i + 1, size, state))
    want = [(e, n, s) for k, (e, n, s) in enumerate(sizes) if n >= 2 and (k + 1 == len(sizes) or sizes[k + 1][1] != n + 1)]
    assert licenses.anchors(tokens, a, 2) == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list("abcdez")), max_size=40))
def test_parts_are_all_maximal_matches(words):
    a = licenses.build(TOY)
    want = {}
    for k, t in enumerate(x.split() for x in TOY.values()):
        for i in range(len(words)):
            for j in range(len(t)):
                n = 0
                while i + n < len(words) and j + n < len(t) and words[i + n] == t[j + n]:
                    n += 1
                if n >= 2 and not (i and j and words[i - 1] == t[j - 1]):
                    want.setdefault(k, set()).add((i, i + n, j, j + n))
    got = licenses.parts([a.vocabulary.get(w) for w in words], a, 2)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list("abcdez")), max_size=60))
def test_a_template_is_found_whatever_the_others(words):
    a, text = licenses.build(TOY), " ".join(words)
    for name, t in TOY.items():
        assert [h for h in licenses.scan(text, a) if h[0] == name] == licenses.scan(text, licenses.build({name: t}))


def test_template_inside_a_longer_match():
    a = licenses.build(licenses.TEMPLATES)
    for text, end in (("Licensed under the Apache License, Version 2.0. The code is here.", 46), ('Licensed under the Apache License, Version 2.0 (the "License")', 46), (licenses.TEMPLATES["Apache-2.0"], 46)):
        assert [h for h in licenses.scan(text, a) if h[0] == "Apache-2.0-notice"] == [("Apache-2.0-notice", 0, end, 8, 1.0)], text
    assert {h[0] for h in licenses.scan(licenses.TEMPLATES["Apache-2.0"], a)} == {"Apache-2.0", "Apache-2.0-notice"}


def test_templates_are_found_whole_and_edited():
    a = licenses.build(licenses.TEMPLATES)
    rng = random.Random(4)
    for name, text in licenses.TEMPLATES.items():
        whole = licenses.scan(f"Préface ici. {text} And then more.", a)
        hit = next(h for h in whole if h[0] == name)
        assert hit[4] == 1.0 and f"Préface ici. {text}"[hit[1] : hit[2]].lower() == text.rstrip(".)/").lower()
        words = text.split()
        if len(words) > 40:
            for _ in range(3):
                words[rng.randrange(5, len(words) - 5)] = "zzz"
            assert name in {h[0] for h in licenses.scan(" ".join(words), a)}
            assert name not in {h[0] for h in licenses.scan(" ".join(words[: len(words) // 2]), a)}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list("abcdez")), max_size=25), st.integers(0, 3))
def test_chains_against_brute_force(words, gap):
    a = licenses.build(TOY)
    for t, runs in licenses.parts([a.vocabulary.get(w) for w in words], a, 2).items():
        runs.sort()
        follow = {i: [] for i in range(len(runs))}
        for j, (ps, pe, pts, pte) in enumerate(runs):
            for i, (s, e, ts, te) in enumerate(runs):
                cut = max(0, pe - s, pte - ts)
                if j < i and ps >= s - a.sizes[t] - gap and cut < e - s and abs(s - pe + cut) <= gap and abs(ts - pte + cut) <= gap and pe < e and pte < te:
                    follow[j].append((i, e - s - cut))
        most = {}

        def walk(i, covered, start):
            most.setdefault(i, set()).add((covered, start))
            for k, n in follow[i]:
                walk(k, covered + n, start)

        for i, p in enumerate(runs):
            walk(i, p[1] - p[0], p[0])
        best, start = licenses.best_chains(runs, a.sizes[t], gap)
        for i in range(len(runs)):
            assert best[i] == max(n for n, _ in most[i]) and (best[i], start[i]) in most[i]


@given(st.lists(st.tuples(st.integers(1, 4), st.integers(0, 30), st.integers(1, 6)), max_size=25))
def test_overlaps_against_brute_force(raw):
    spans = [(n, s, s + w) for n, s, w in raw]
    kept = []
    for n, s, e in sorted(spans, key=lambda x: (-x[0], x[1], x[2])):
        if all(e <= s2 or s >= e2 for _, s2, e2 in kept):
            kept.append((n, s, e))
    assert licenses.without_overlaps(spans) == kept


def test_repeated_notices_take_time_in_proportion():
    a = licenses.build(licenses.TEMPLATES)
    began = time.perf_counter()
    assert len(licenses.scan("All rights reserved. " * 50_000, a)) == 50_000
    assert time.perf_counter() - began < 10


def test_chains_do_not_cross_gaps():
    a = licenses.build({"t": "one two three four five six seven eight"})
    near = "one two three four x x five six seven eight"
    far = "one two three four " + "x " * 40 + "five six seven eight"
    assert [h[3] for h in licenses.scan(near, a)] == [8]
    assert licenses.scan(far, a) == []
    assert licenses.scan("five six seven eight one two three four", a) == []
    assert [h[1:4] for h in licenses.scan("one two three four five six seven eight " * 2, a)] == [(0, 39, 8), (40, 79, 8)]


def test_tables(docs, odd, made):
    a = licenses.build(licenses.TEMPLATES)
    got = sorted(map(tuple, licenses.find_licenses(docs).collect()))
    assert got == sorted((r.doc_id, *h) for r in docs.collect() for h in licenses.scan(r.text, a))
    assert got and all(c >= licenses.COVERAGE for *_, c in got)
    assert licenses.find_licenses(odd).count() == licenses.find_licenses(odd.limit(0)).count() == 0
    text = "x " * 300_000 + "Released under the MIT License."
    d = made([(1, text, "en", "s"), (1, text, "en", "s"), (None, "İ All Rights Reserved", None, None)]).withColumn("start", F.lit(1)).withColumn("license", F.lit(1))
    assert sorted((str(r.doc_id), r.license, r.start) for r in licenses.find_licenses(d).collect()) == [("1", "MIT-notice", 600_000)] * 2 + [("None", "All-rights-reserved", 2)]


def test_whole_query_against_brute_force(docs):
    """Parts from all diagonals of text against template, without an automaton, then chains."""
    words = {n: licenses.WORD.findall(t.lower()) for n, t in licenses.TEMPLATES.items()}
    number = {w: i for i, w in enumerate(sorted({w for t in words.values() for w in t}))}
    coded = {n: np.array([number[w] for w in t]) for n, t in words.items()}
    want = []
    for r in docs.collect():
        at = [m.span() for m in licenses.WORD.finditer(r.text.lower())]
        text = np.array([number.get(r.text.lower()[a:b], -1) for a, b in at])
        for name, t in coded.items():
            if not np.isin(text, t).any():
                continue
            same = text[:, None] == t[None, :]
            runs = []
            for d in range(-len(t) + 1, len(text)):
                diagonal = np.concatenate([[False], np.diagonal(same, -d), [False]]).astype(np.int8)
                step = np.diff(diagonal)
                for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1)):
                    if b - a >= licenses.MIN_MATCH:
                        i, j = (a + d, a) if d >= 0 else (a, a - d)
                        runs.append((int(i), int(i + b - a), int(j), int(j + b - a)))
            runs.sort()
            best, start = licenses.best_chains(runs, len(t))
            good = [(n, s, p[1]) for n, s, p in zip(best, start, runs) if n >= licenses.COVERAGE * len(t)]
            want += [(r.doc_id, name, at[s][0], at[e - 1][1], min(n, len(t))) for n, s, e in licenses.without_overlaps(good)]
    got = sorted(tuple(r)[:5] for r in licenses.find_licenses(docs).collect())
    assert got and got == sorted(want)


def test_of_equal_overlapping_findings_the_first_stays():
    a = licenses.build({"t": "one two three one two"})
    assert [h[1:4] for h in licenses.scan("one two three one two three one two", a)] == [(0, 21, 5)]
