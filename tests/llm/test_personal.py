import random
import re

import pytest

from pairlens.llm import personal

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(text):
    total = 0
    for i, c in enumerate(reversed(re.sub("[^0-9]", "", text))):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def good(kind, hit):
    n = len(re.sub("[^0-9]", "", hit))
    return {
        "email": True,
        "ip": kind == "ip" and all(int(p) <= 255 for p in hit.split(".")),
        "card": 12 <= n <= 19 and luhn(hit),
        "phone": 9 <= n <= 15,
    }[kind]


def brute(text):
    out = [(m.start(), k, m.end()) for k, (kind, r) in enumerate(BASE.items()) for m in r.finditer(text or "") if good(kind, m.group())]
    return [(list(BASE)[k], a, b) for a, k, b in sorted(out)]


def corpus():
    rng = random.Random(4)
    parts = ["a.b@c.de", "@", "x@y", "1.2.3.4", "256.1.1.1", "0001.02.003.4.5", ".", "-", " ", "4111 1111 1111 1111", "4111-1111-1111-1112"]
    parts += ["79927398713", "0", "12", "+1 (017) 555-7713", "+4", "(", ")", "é", "😀", "_", "%", "5", "\n", "+12", "a@b.c", "@d.e", "0000 0000 0000"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(600)]
    return out + [None, "", "9" * 30_000, "a" * 30_000, "a.b" * 10_000 + "@" + "c.d" * 10_000, "+" * 5000, "1.1.1.1 " * 5000, "+1" + " " * 20_000 + "2"]


def test_base_matches_the_plain_patterns(docs_of):
    texts = corpus()
    got = {r.doc_id: r.spans for r in personal.spans(docs_of(texts)).collect()}
    for i, text in enumerate(texts):
        assert [(s.kind, s.start, s.end) for s in got[i] if s.kind in personal.BASE] == brute(text), text
        for s in got[i]:
            assert text[s.start : s.end] == s.text and 0 < s.score <= 0.99


@pytest.fixture(scope="module")
def found(docs_of):
    def find(*texts):
        rows = sorted(personal.spans(docs_of(list(texts))).collect(), key=lambda r: r.doc_id)
        return [[(s.kind, s.text, s.score) for s in r.spans] for r in rows]

    return find


def test_checksums_and_words(found):
    iban, ssn = "DE89 3704 0044 0532 0130 00", "123-45-6789"
    got = found(
        f"x {iban}.", f"x {iban[:-1]}1.", f"Konto: {iban}", f"my ssn is {ssn}", f"part {ssn}", "ssn 000-45-6789", "call 555-123-4567", "no 555-123-4567",
        "the recall 555-123-4567", "my credit card 4111111111111111", "GB82WEST12345698765432 and FR1420041010050500013M02606", f"A{iban}",
    )
    assert got[0] == [("iban", iban, 0.8)] and got[1] == [] and got[2] == [("iban", iban, 0.99)]
    assert got[3] == [("ssn", ssn, 0.5)] and got[4] == [] and got[5] == []
    assert got[6] == [("local_phone", "555-123-4567", 0.5)] and got[7] == [] and got[8] == []
    assert got[9] == [("card", "4111111111111111", 0.99)]
    assert [s[1] for s in got[10]] == ["GB82WEST12345698765432", "FR1420041010050500013M02606"] and got[11] == []


def test_ids_and_no_rows(docs_of):
    rows = personal.spans(docs_of(["a@b.cd", None, "a@b.cd"], [None, 1, 1])).collect()
    assert sorted((r.doc_id is None, len(r.spans)) for r in rows) == [(False, 0), (False, 1), (True, 1)]
    assert personal.spans(docs_of(["a"]).limit(0)).collect() == []


def test_plan_is_native(docs_of):
    plan = personal.spans(docs_of(["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
