import hashlib
import random
import re
import time

from conftest_llm import SF
from docloom.llm import pii
from docloom.llm.pii import KINDS, emails, find_pii, find_spans, luhn, mod97, redact
from docloom.llm.queries import QUERIES

RULES = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(p) <= 255 for p in t.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda t: 16 <= len(re.sub(r"\D", "", t)) <= 19 and luhn(re.sub(r"\D", "", t))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 8 <= len(re.sub(r"\D", "", t)) <= 15)}


def brute(text):
    return [(k, m.start(), m.end()) for k, (rx, ok) in RULES.items() for m in re.finditer(rx, text or "") if ok(m[0])]


def base(text):
    return [x[:3] for x in find_spans(text) if x[0] in RULES]


def test_base_spans_equal_plain_regexes():
    rng = random.Random(5)
    pieces = ["a@b.co", "@", "x.y%z", "1.2.3.4", "256.1.1.1", ".", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824",
              "+", " ", "é", "9" * 30, "-", "@a.b@c.d", "00000300.1.2.3", "1.2.3.4.5.6.7.8.9", "\n", "a" * 50, "+1+22(33)4455667788"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        assert base(text) == brute(text), text


def test_linear_on_hostile_texts():
    for text in ("a" * 300_000, "a@" * 100_000, "1" * 200_000, "1." * 100_000, "+1" * 100_000, "A1" * 100_000, "x@" + "a-" * 100_000):
        find_spans(text)
    assert list(emails("a@b.c%d@e.f")) == [(0, 5), (5, 11)]


def test_added_kinds_need_validators_and_context():
    kinds = lambda t: [x[0] for x in find_spans(t)]
    assert mod97("GB82WEST12345698765432") and kinds("pay GB82 WEST 1234 5698 7654 32 NOW") == ["iban"]
    assert kinds("pay GB82 WEST 1234 5698 7654 33") == []
    assert kinds("amex card 378282246310005") == ["card_short"] and kinds("number 378282246310005") == []
    assert kinds("call (743) 555-3824") == ["phone_local"] and kinds("see (743) 555-3824") == []
    assert kinds("ssn 123-45-6789") == ["ssn"] and kinds("ssn 000-45-6789") == [] and kinds("n 123-45-6789") == []
    assert kinds('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"') == ["secret"]
    assert kinds('hash 04dbebab91ab85687d33eeaaf9ac699e1188f962') == []
    assert find_spans("mail a@b.co")[0][3] > find_spans("see a@b.co")[0][3]


def test_iban_after_a_code_that_looks_like_its_start():
    text = "REF ID12 DE89 3704 0044 0532 0130 00, DE12 GB82 WEST 1234 5698 7654 32"
    spans = [(k, text[a:b]) for k, a, b, _ in find_spans(text)]
    assert spans == [("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82 WEST 1234 5698 7654 32")]


def test_edges_and_redaction(make):
    rows = [(1, None, "x", 0, "s"), (2, "", "x", 0, "s"), (None, "to a@b.co, née +1 (743) 555-3824", "x", 9, "s"),
            (4, "hi a@b.co", "x", 9, "s"), (4, "hi a@b.co", "x", 9, "s"), (5, "w " * 100_000 + "1.2.3.4", None, 1, None)]
    docs = make(rows, "doc_id long, text string, row string, n_chars long, spans string")
    found = find_pii(docs).collect()
    assert len(found) == 6 and sorted(len(r.spans) for r in found) == [0, 0, 1, 1, 1, 2]
    out = {(r.doc_id, r.text, r.n_chars, r.row) for r in redact(docs).collect()}
    assert redact(docs).schema == docs.schema
    assert (None, "to [EMAIL], née [PHONE]", 23, "x") in out and (4, "hi [EMAIL]", 10, "x") in out
    assert (1, None, 0, "x") in out and (2, "", 0, "x") in out
    assert find_pii(make([], docs.schema)).count() == 0


def test_query_against_brute_force(spark, documents):
    got = {r.doc_id: r for r in QUERIES["op3_pii"](spark, SF).collect()}
    assert len(got) == len(documents)
    for d in documents:
        spans, r = brute(d["text"]), got[d["doc_id"]]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in spans) for k in RULES]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        listed = [tuple(x.split(":")) for x in r.spans.split(",") if x]
        assert [(k, int(a), int(b)) for k, a, b in listed if k in RULES] == spans
        assert listed == sorted(listed, key=lambda x: (KINDS.index(x[0]), int(x[1])))


def test_added_spans_keep_clear_of_all_before():
    draw = random.Random(8)
    bits = ["4111 1111 1111 1111", "card 378282246310005", "+49 30 1234567", "(555) 123-4567 call", "ssn 123-45-6789", "a.b@c.de",
            "IBAN DE89 3704 0044 0532 0130 00", "token=abcdefghij0123456789xyz", "10.0.0.1", " ", "phone ", "token: +4915112345678901234567"]
    for _ in range(300):
        text = draw.choice(["", " "]).join(draw.choices(bits, k=12))
        plain = list(pii._base(text))
        for k, a, b in pii._added(text):  # each against all before it
            if all(b <= x or a >= y for _, x, y in plain):
                plain.append((k, a, b))
        assert [x[:3] for x in find_spans(text, 0.0)] == sorted(plain, key=lambda x: (KINDS.index(x[0]), x[1]))


def test_many_added_spans_take_linear_time():
    text = "ssn 123-45-6789 and card 378282246310005, " * 25_000
    start = time.perf_counter()
    found = find_spans(text)
    assert len(found) == 50_000 and time.perf_counter() - start < 20
