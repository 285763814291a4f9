import hashlib
import re

from keepsake.llm import pii
from keepsake.llm.queries import QUERIES
from llm_helpers import docs  # noqa: F401

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        t += v - 9 if v > 9 else v
    return t % 10 == 0


def ok(kind, s):
    d = re.sub("[^0-9]", "", s)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in s.split(".")),
            "card": lambda: 12 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()


def brute(text):
    out = [(m.start(), o, m.end(), k) for o, (k, p) in enumerate(PATTERNS.items())
           for m in re.finditer(p, text or "") if ok(k, m.group())]
    return sorted(out)


def check(rows, got):
    want = {i: brute(t) for i, t in rows}
    assert {r["doc_id"] for r in got} == set(want)
    for r in got:
        w = want[r["doc_id"]]
        text = ",".join(f"{k}:{s}:{e}" for s, _, e, k in w)
        base = [x for x in r["spans"].split(",") if x.split(":")[0] in PATTERNS]
        assert ",".join(base) == text
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        for k in PATTERNS:
            assert r[f"n_{k}"] == sum(x[3] == k for x in w)


TRICKY = [
    (1, None), (2, ""), (3, "a@b.c+d@e.f g@h"), (4, "1.2.3.4.5.6.7.8 256.1.1.1 0255.00.1.1 9999999999999999999999.1.1.1"),
    (5, "4111 1111-1111 1111, 4111111111111112 5 79927398713"), (6, "+1 (743) 555-3824 +49 30 12 +1"),
    (7, "é𝄞 x@y.zz 🙂 4111111111111111 ü 10.0.0.1"), (8, "a" * 30000 + " x@" + "9" * 30000),
    (9, "x@y." * 300), (10, "..@a.b @c.d --@-.- a@b..c"), (11, "+1234567890123456 +12345678"),
    (12, "4111111111111111 " * 2500), (13, "1 2 3 4 5 6 7 8 9 0 1 2 8 4111111111111111"),
]


def test_against_plain_python(docs):
    found = pii.digest_columns(pii.find_personal_data(docs(TRICKY).select("doc_id", "text")))
    check(TRICKY, found.collect())


def test_query_against_plain_python(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
            .select("doc_id", "text").collect()]
    check(rows, QUERIES["op9_pii"](spark, "/root/testdata/sf0.001").collect())


def test_context_and_checksums_add_spans(docs):
    rows = [(1, "bank DE89 3704 0044 0532 0130 00 end"), (2, "DE89370400440532013001"), (3, "ssn 078-05-1120"),
            (4, "part 078-05-1120"), (5, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'),
            (6, "24be64439e3e49cf46b2d7c90f3602a3d0b907ff")]
    got = {r["doc_id"]: [s["kind"] for s in r["pii"]] for r in pii.find_personal_data(docs(rows)).collect()}
    assert got == {1: ["iban"], 2: [], 3: ["ssn"], 4: [], 5: ["secret"], 6: []}


def test_mask_and_empty_table(docs, spark):
    from pyspark.sql import functions as F
    d = pii.find_personal_data(docs([(1, "mail é a@b.cc now 10.0.0.1")]))
    assert d.select(pii.mask(F.col("text"), F.col("pii"))).first()[0] == "mail é <email> now <ip>"
    assert pii.find_personal_data(docs([])).count() == 0


def test_context_is_read_across_earlier_spans(docs):
    a, b = "24be64439e3e49cf46b2", "9f0c1d2e3b4a59687706"
    rows = [(1, "ssn 078-05-1120, 219-09-9999"), (2, f"tokens: {a} {b}"), (3, "ssn " + "-" * 37 + " 078-05-1120"),
            (4, f"secret {'x' * 20} {a}"), (5, f"é𝄞 ssn 078-05-1120, 219-09-9999 {'.' * 40} 219-09-9998")]
    got = {r["doc_id"]: [(s["start"], s["kind"]) for s in r["pii"]]
           for r in pii.find_personal_data(docs(rows)).collect()}
    assert got == {1: [(4, "ssn"), (17, "ssn")], 2: [(8, "secret"), (29, "secret")], 3: [], 4: [(28, "secret")],
                   5: [(7, "ssn"), (20, "ssn")]}


def test_ibans_before_upper_case_words_and_other_ibans(docs):
    full = ["ES91 2100 0418 4502 0005 1332", "BE68539007547034", "SE45 5000 0000 0583 9825 7466", "AT611904300234573201",
            "NO93 8601 1117 947", "MT84MALT011000012345MTLCAST001S", "FR14 2004 1010 0505 0001 3M02 606"]
    rows = [(i, f"é {iban}{after}") for i, iban in enumerate(full) for after in (" BIC CAIXESBB", " EUR 50", " BANK", "")]
    rows += [(90, " ".join(full)), (91, "XX12 3456 7890 " + full[0]), (92, "ES91 2100 0418 4502 0005 1333 BIC")]
    for r in pii.find_personal_data(docs(rows)).collect():
        got = [r["text"][s["start"]:s["end"]] for s in r["pii"] if s["kind"] == "iban"]
        assert got == {90: full, 91: [full[0]], 92: []}.get(r["doc_id"], full[r["doc_id"] % 90:r["doc_id"] % 90 + 1])
