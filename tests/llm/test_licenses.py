import random
import re

from pairlens.llm import licenses as lic
from pairlens.llm.license_rules import rules

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(text):
    words = WORD.findall((text or "").translate(LOWER))
    places = []
    for phrase, label in lic.BASE.items():
        parts = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(parts)] == parts]
    at = [i for i, _ in places]
    labels = ",".join(sorted({label for _, label in places}))
    return len(words), len(places), min(at, default=None), max(at, default=None), labels


def slow_suppress(found):
    kept = []
    for d in sorted(found, key=lambda d: (-d.priority, d.start - d.end, d.start, d.label)):
        if not any(k.start <= d.start and d.end <= k.end for k in kept):
            kept.append(d)
    return sorted(kept)


def test_rules_are_many_and_each_keyword_is_needed():
    assert len(rules()) > 200
    for label, priority, keyword, regex in rules():
        re.compile(regex)
        assert label == label.lower() and priority in lic.SURE


def test_suppression_matches_the_definition():
    rng = random.Random(1)
    for _ in range(300):
        found = []
        for _ in range(rng.randint(0, 14)):
            a = rng.randint(0, 20)
            found.append(lic.Detection(rng.choice("xyz"), rng.randint(1, 4), a, a + rng.randint(1, 9)))
        assert sorted(lic.suppress(found)) == slow_suppress(found)


def test_scan_matches_brute_force(docs_of):
    rng = random.Random(2)
    parts = "gnu general public license GNU General-Public License, apache Apache License mit MIT License. cc by CC-BY é ünder 3 \n".split(" ")
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 200))) for _ in range(60)]
    texts += [None, "", "...", "x" * 50_000, "mit license " * 20_000, "the mit license", "émit license", "mit licenseé"]
    got = {r.doc_id: r for r in lic.scan(docs_of(texts)).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    assert lic.scan(docs_of(["a"]).limit(0)).collect() == []


def test_known_lines():
    def labels(text):
        return [d.label for d in lic.detect(lic.words_of(text))]

    assert labels("This work is licensed under the GNU General Public License, version 3.") == ["gpl-3.0-only"]
    assert labels("GNU General Public License, version 2 or any later version") == ["gpl-2.0-or-later"]
    assert labels("Licensed under CC BY-NC 4.0.") == ["cc-by-nc-4.0"]
    assert labels("Licensed under the Apache License, Version 2.0.") == ["apache-2.0"]
    assert labels("Released under the MIT License.") == ["mit"]
    assert labels("// SPDX-License-Identifier: LGPL-2.1-or-later") == ["lgpl-2.1"]
    assert labels("limited mitten") == []


def test_many_hits_and_word_numbers():
    """Suppression in proportion to the hits; the numbers of a detection's words are those of the text."""
    text = "the mit license and gnu general public license version 3 or later " * 4000
    n_words, n_base, first, last, base, labels, score, spans = lic._scan(text)
    words = text.split()
    assert n_words == len(words) == 48_000 and n_base == 8000 and (first, last) == (1, 47_992) and len(spans) >= 8000
    for label, _, word, n in spans[:50] + spans[-50:]:
        assert words[word : word + n][0] in ("the", "mit", "gnu", "license", "general") and n >= 2
    assert [s[2] for s in spans] == sorted(s[2] for s in spans)


def test_repeated_and_null_ids(docs_of):
    rows = lic.scan(docs_of(["mit license", None, "mit license"], [None, 1, 1])).collect()
    assert sorted((r.doc_id or 0, r.n_base) for r in rows) == [(0, 1), (1, 0), (1, 1)]
