import random

from textprofile.llm import licenses as L
from tests.conftest import SF_MID

from .frames import LONG, ROWS, awkward, empty


def test_every_template_is_found_in_noise():
    rng = random.Random(1)
    m = L.Matcher()
    noise = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(n))
    for t in L.TEMPLATES:
        text = noise(60) + "\n" + t.text + "\n" + noise(60)
        found = m.find(text)
        assert [(f[2], f[3]) for f in found] == [(t.license, 0)], t
        a, b = found[0][:2]
        assert [w for w, _, _ in L.words_at(text[a:b])] == [w for w, _, _ in L.words_at(t.text)]


def test_changed_wordings_and_versions():
    m = L.Matcher()
    names = lambda s: [f[2] for f in m.find(s)]
    assert names("this work is licensed under the gnu general public license version 3") == ["GPL-3.0"]
    assert names("This work was licensed under the GNU General Public License, version 3.") == ["GPL-3.0"]
    assert names("This work is licensed under the GNU General Public License, version 2.") == ["GPL-2.0"]
    assert names("This work is licensed under the GNU General Public License, version 7.") == []
    assert names("Released under the BSD License.") == ["BSD"]
    assert names("Licensed under CC BY 4.0.") == ["CC-BY-4.0"] and names("Licensed under CC BY-NC-SA 4.0.") == ["CC-BY-NC-SA-4.0"]
    assert names("a driving license and a fishing licence, by permission of the king") == []
    two = "Released under the MIT License. Released under the MIT License."
    assert names(two) == ["MIT", "MIT"]


def test_ranking_loses_nothing(spark):
    """Compression ranks and drops templates; trying all of them gives the same."""
    ranked, plain = L.Matcher(), L.Matcher(ranked=False)
    texts = [r["text"] for r in spark.read.parquet(f"{SF_MID}/documents.parquet").select("text").collect()]
    found = [ranked.find(t) for t in texts]
    assert sum(map(len, found)) > 10
    assert [[f[:4] for f in x] for x in found] == [[f[:4] for f in plain.find(t)] for t in texts]


def test_the_right_template_saves_most():
    m = L.Matcher()
    for i, t in enumerate(L.TEMPLATES):
        assert L.TEMPLATES[m.rank(t.text)[0][1]].license == t.license


def brute(m, text):
    """Every template against all words of the text, without pieces or ranking."""
    words = L.words_at(text)
    found = sorted((e / m.patterns[i].n, -m.patterns[i].n, x, y, i, e) for i in range(len(m.templates))
                   for e, x, y in m._occurrences(i, [w for w, _, _ in words]))
    out, taken = [], set()
    for _, _, x, y, i, e in found:
        if not taken & set(range(x, y)):
            taken |= set(range(x, y))
            out.append((words[x][1], words[y - 1][2], m.templates[i].license, e))
    return sorted(out)


def noise(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(n))


def test_long_texts_full_of_notices():
    """A notice every 50 words up to 20,000 words: none is lost."""
    rng = random.Random(4)
    ranked, plain = L.Matcher(), L.Matcher(ranked=False)
    for t in L.TEMPLATES:  # one long run of windows that touch each other
        found = ranked.find("\n".join(noise(rng, 50) + "\n" + t.text for _ in range(50)))
        assert [(f[2], f[3]) for f in found] == [(t.license, 0)] * 50
    for n in (4, 40, 400):
        put = [rng.choice(L.TEMPLATES) for _ in range(n)]
        text = "\n".join(noise(rng, 50) + "\n" + t.text for t in put)
        found = ranked.find(text)
        assert [(f[2], f[3]) for f in found] == [(t.license, 0) for t in put]
        assert [f[:4] for f in found] == [f[:4] for f in plain.find(text)]
    text = "Licensed under CC BY 4.0. " * 3000
    assert len(ranked.find(text)) == 3000


def test_edited_notices_against_brute_force():
    """Up to the allowed edits anywhere, any case and line breaks."""
    rng, m = random.Random(5), L.Matcher()
    names = lambda s: [f[2:4] for f in m.find(s)]
    assert names("Available under CC BY 4.0.") == [("CC-BY-4.0", 1)]
    assert names("Released under CC BY-SA 4.0.") == [("CC-BY-SA-4.0", 1)]
    assert names("Distributed under CC BY-NC 4.0.") == [("CC-BY-NC-4.0", 1)]
    assert names("RELEASED\nUNDER\nTHE\nMIT\nLICENSE") == [("MIT", 0)]
    lost = 0
    for _ in range(60):
        parts = []
        for _ in range(6):
            i = rng.randrange(len(m.templates))
            words = m.patterns[i].words[:]
            for _ in range(rng.randrange(m.limits[i] + 1)):
                at = rng.randrange(len(words))
                words[at:at + rng.randrange(2)] = rng.choice(([], ["other"], ["license"], ["mit"]))
            parts += [noise(rng, rng.randrange(12)), rng.choice((" ".join(words), " ".join(words).upper(), "\n".join(words)))]
        text = " ".join(parts)
        want = brute(m, text)
        lost += 6 - len(want)
        assert [f[:4] for f in m.find(text)] == want
    assert lost < 180  # most of what was put in is accepted


def test_awkward_rows(spark):
    out = L.scan_licenses(awkward(spark)).collect()
    assert len(out) == len(ROWS) and all(r["n_hits"] == 0 and r["hits"] == "" for r in out)
    assert L.scan_licenses(empty(spark)).count() == 0
    df = spark.createDataFrame([(1, LONG + " Released under the MIT License."), (None, "Released under the MIT License.")],
                               "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_hits"], r["licenses"], r["hits"]) for r in L.scan_licenses(df).collect()}
    assert got[1] == (1, "MIT", f"MIT:{len(LONG) + 1}:{len(LONG) + 31}:0") and got[None][0] == 1


def test_gain_decides():
    """Without savings no template is looked for; with savings for all, every one
    is: the gain keeps the searches few and loses nothing."""
    rng = random.Random(8)
    words = sorted(L.Matcher().anchors)  # words that lead to blocks, mostly without a notice
    text = " ".join(noise(rng, 40) + " " + " ".join(rng.sample(words, 2)) for _ in range(400))
    text += " ".join(noise(rng, 150) + " " + t.text for t in L.TEMPLATES)
    m, none, every = L.Matcher(), L.Matcher(), L.Matcher()
    none.saved = lambda block, among=None: dict.fromkeys(range(len(L.TEMPLATES)), 0)
    every.saved = lambda block, among=None: dict.fromkeys(range(len(L.TEMPLATES)), 10_000)
    limited = {t.license for t, n in zip(L.TEMPLATES, m.least) if n > 0}
    free = {t.license for t, n in zip(L.TEMPLATES, m.least) if n <= 0}
    assert sum(n > 0 for n in m.least) > 20 and {"GPL-3.0", "LGPL-3.0", "MIT", "Apache-2.0", "BSD-2-Clause", "ISC"} <= limited
    # a constant of nothing loses the notices of all templates that have a limit
    assert {f[2] for f in none.find(text)} <= free and len(m.find(text)) - len(none.find(text)) > 20
    assert [f[:4] for f in m.find(text)] == [f[:4] for f in every.find(text)] and len(m.find(text)) == len(L.TEMPLATES)
    once = L.Matcher(least=m.least)
    once.find(text)
    assert once.tried < every.tried


def test_edits_up_to_the_limit_save_enough():
    """Notices with all allowed words changed at random, alone and among others:
    the choice never leaves out one that the confirmation would accept."""
    rng, m = random.Random(9), L.Matcher()
    for _ in range(1500):
        i = rng.randrange(len(m.templates))
        words = m.patterns[i].words[:]
        for at in rng.sample(range(len(words)), m.limits[i]):
            if words[at] not in m.templates[i].keys and words[at] not in m.told[i]:
                words[at] = noise(rng, 1)
        other = rng.choice(L.TEMPLATES).text.lower() if rng.random() < 0.5 else noise(rng, rng.randrange(60))
        block = f"{noise(rng, rng.randrange(20))} {' '.join(words)} {other}"
        assert m.saved(block, [i])[i] >= m.least[i], m.templates[i]


def test_neighbours_are_not_confused():
    m = L.Matcher()
    names = lambda s: [f[2] for f in m.find(s)]
    gnu = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the "
           "Free Software Foundation, either version {} of the License, or (at your option) any later version.")
    for title, version, name in (("General Public License", "3", "GPL-3.0"), ("General Public License", "2", "GPL-2.0"),
                                 ("Lesser General Public License", "3", "LGPL-3.0"), ("Lesser General Public License", "2.1", "LGPL-2.1"),
                                 ("Affero General Public License", "3", "AGPL-3.0"), ("Library General Public License", "2", "LGPL-2.0")):
        assert names(gnu.format(title, version)) == [name]
        assert names(f"This work is licensed under the GNU {title}, version {version}.") == [name]
    head = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    third = ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
             "derived from this software without specific prior written permission.")
    assert names(head + " 1. Redistributions of source code must retain the above copyright notice.") == ["BSD-2-Clause"]
    both = head + " 1. Redistributions must retain the notice. " + third
    assert [f[2] for f in L.by_clauses(m.find(both), both)] == ["BSD-3-Clause", "BSD-3-Clause"]
    assert names("SPDX-License-Identifier: Apache-2.0") == ["Apache-2.0"]
    assert names("SPDX-License-Identifier: GPL-2.0-or-later") == ["GPL-2.0-or-later"]
    assert names("// SPDX-License-Identifier: MIT") == ["MIT"]
    assert names("Licensed under CC BY 3.0.") == ["CC-BY-3.0"] and names("Licensed under CC BY-SA 3.0.") == ["CC-BY-SA-3.0"]
    long = "This work is licensed under a Creative Commons {} 4.0 International License."
    assert names(long.format("Attribution")) == ["CC-BY-4.0"]
    assert names(long.format("Attribution-NonCommercial-NoDerivatives")) == ["CC-BY-NC-ND-4.0"]
    assert names("This work is licensed under the GNU General Public License, version 2.1.") == []
    assert names("Released under the BSD 4-Clause License.") == []
    for t in L.TEMPLATES:  # a telling word more or less, or another number: never under the old name
        words = [w for w, _, _ in L.words_at(t.text)]
        for at, w in enumerate(words):
            for new in ([], [w, "lesser"], ["7"]):
                if w in m.told[L.TEMPLATES.index(t)] or new[:1] != [w] and w.isdigit() or "lesser" in new:
                    changed = words[:at] + new + words[at + 1:]
                    if "lesser" in new and at + 1 == len(words):
                        continue  # after the notice
                    assert all(L.telling(changed[:]) == m.told[i] or f[2] != L.TEMPLATES[i].license or
                               L.telling([x for x, _, _ in L.words_at(" ".join(changed)[f[0]:f[1]])]) == m.told[i]
                               for f in m.find(" ".join(changed)) for i in [L.TEMPLATES.index(t)])
