import hashlib
import random
import re
import time

from helpers import documents, empty, odd_rows, table, with_clashing

from retailcast.llm.pii import find_spans, masked, mod_97, pii_report, pii_spans

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [sum(divmod(int(d) * 2, 10)) if i % 2 else int(d) for i, d in enumerate(digits[::-1])]
    return sum(doubled) % 10 == 0


def good(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if good(k, m.group())]


def base(spans):
    return [s[:3] for s in spans if s[0] in PATTERNS]


def test_equals_the_patterns_on_the_table(spark):
    docs = table(spark)
    got = {r.doc_id: r for r in pii_report(docs).collect()}
    for r in docs.collect():
        want = brute(r.text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        g = got[r.doc_id]
        assert g.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (g.n_email, g.n_ip, g.n_card, g.n_phone) == tuple(sum(w[0] == k for w in want) for k in PATTERNS)


def test_equals_the_patterns_on_random_texts():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choices(["1", "25", "4", "0", ".", "-", " ", "+", "@", "a", "b.", "(", ")", "é", "%", "\n", "x@y.z", "4272683025356771"], k=rng.randint(1, 30)))
        assert base(find_spans(text)) == brute(text), text


def test_added_kinds_and_context():
    assert mod_97("GB82WEST12345698765432") and not mod_97("GB82WEST12345698765433")
    kinds = {s[0]: s for s in find_spans("account GB82 WEST 1234 5698 7654 32, amex card 378282246310005")}
    assert kinds["iban"][3] == 1.0 and "short_card" in kinds
    assert "short_card" not in {s[0] for s in find_spans("number 378282246310005 alone")}
    plain, near = find_spans("xx 10.0.0.1 xx")[0], find_spans("server 10.0.0.1")[0]
    assert near[3] > plain[3]
    assert masked("to a@b.co now", find_spans("to a@b.co now")) == "to <email> now"


def test_account_numbers_before_short_tokens():
    spanish, british = "ES91 2100 0418 4502 0005 1332", "GB82 WEST 1234 5698 7654 32"
    found = lambda text: [text[a:b] for kind, a, b, _ in find_spans(text) if kind == "iban"]
    for after in ("", ".", " BIC CAIXESBB", " EUR 20", " 2024", " TRANSFER", " EUROS", " a"):
        assert found(f"to {spanish}{after}") == [spanish], after
        assert found(f"to {spanish.replace(' ', '')}{after}") == [spanish.replace(" ", "")], after
    for number in ("SE45 5000 0000 0583 9825 7466", "AT61 1904 3002 3457 3201", "BE68 5390 0754 7034", "PL61 1090 1014 0000 0712 1981 2874"):
        assert found(f"{number} BIC") == [number]
    assert found(f"{spanish} {british} AB12 CDEF GHIJ {spanish} EUR") == [spanish, british, spanish]
    assert found("ES92 2100 0418 4502 0005 1332 EUR") == []


def test_hostile_texts_take_linear_time():
    start = time.time()
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+1" * 150_000, "1 " * 150_000, "a@b." * 75_000, "AB12 " + "ABCD " * 60_000, "+" + "1 " * 150_000):
        find_spans(text)
    assert time.time() - start < 30


def test_odd_rows(spark):
    docs = with_clashing(odd_rows(spark))
    got = pii_report(docs).collect()
    assert len(got) == docs.count() and all(r.n_email == 0 and r.spans == "" for r in got)
    assert pii_report(empty(spark)).count() == 0
    row = pii_spans(documents(spark, "é a@b.co"), with_masked=True).first()
    assert (row.spans[0].start, row.spans[0].end, row.masked) == (2, 8, "é <email>")
