import math
import re
import zlib
from collections import Counter

from keepsake.llm import url_filter as uf
from keepsake.llm.queries import QUERIES

ALPHABET = "abcdefghijklmnopqrstuvwxyz0./-_"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), path


def ruled(host, path):
    fit = [(h + p, v) for v, h, p in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=lambda f: len(f[0])) if fit else (None, None)


def codes(text):
    out = []
    for c in text:
        c = c.lower() if "A" <= c <= "Z" else "0" if c in "0123456789" else c
        out.append((ALPHABET.find(c) if c in ALPHABET else 30) + 1)
    return out


class Brute:
    """The two models as dictionaries of context counts."""

    def __init__(self, rows):
        self.n = {b: Counter() for b in (True, False)}
        known = [(h + p, v == "block") for h, p, (_, v) in rows if v and h + p]
        held = [k for k in known if zlib.crc32(k[0].encode()) % uf.HOLD_OUT == 0]
        for text, bad in known:
            if zlib.crc32(text.encode()) % uf.HOLD_OUT:
                c = [0] * uf.ORDER + codes(text)
                for i in range(uf.ORDER, len(c)):
                    for k in range(uf.ORDER + 1):
                        self.n[bad][tuple(c[i - k:i + 1])] += 1
        self.totals = {b: {} for b in self.n}
        for b, n in self.n.items():
            for w, x in n.items():
                t = self.totals[b].setdefault(w[:-1], [0, 0])
                t[0] += x
                t[1] += 1
        self.cut = self.calibrate([(self.score(t), b) for t, b in held])

    def p(self, bad, w):
        lower = 1 / 32 if len(w) == 1 else self.p(bad, w[1:])
        total, kinds = self.totals[bad].get(w[:-1], (0, 0))
        return (self.n[bad][w] + kinds * lower) / (total + kinds) if total else lower

    def score(self, text):
        c = [0] * uf.ORDER + codes(text)
        logs = [math.log(self.p(True, w)) - math.log(self.p(False, w))
                for w in (tuple(c[i - uf.ORDER:i + 1]) for i in range(uf.ORDER, len(c)))]
        return sum(logs) / len(logs) if logs else 0.0

    def calibrate(self, scored):
        nb, ng = sum(b for _, b in scored), sum(not b for _, b in scored)
        if not nb or not ng:
            return None
        bins = sorted({math.floor(s / uf.BIN) for s, _ in scored})
        best = (1.0, 0.0)
        for last, nxt in zip(bins, bins[1:]):
            b = sum(x for s, x in scored if math.floor(s / uf.BIN) <= last)
            g = sum(not x for s, x in scored if math.floor(s / uf.BIN) <= last)
            err = b / nb + 1 - g / ng
            if err < best[0]:
                best = (err, (last + 1 + nxt) * uf.BIN / 2)
        return best[1]


def compare(rows, got):
    parsed = {i: parts(u) for i, u in rows}
    model = Brute([(h, p, ruled(h, p)) for h, p in (parts(u) for _, u in rows)])
    assert len(got) == len(rows)
    for r in got:
        h, p = parsed[r["page_id"]]
        rule, verdict = ruled(h, p)
        score = model.score(h + p)
        assert (r["host"], r["path"], r["rule"]) == (h, p, rule)
        assert abs(r["score"] - score) < 1e-4
        if verdict or model.cut is None or abs(score - model.cut) > 1e-3:
            assert r["verdict"] == (verdict or ("block" if model.cut is not None and score > model.cut else "allow"))


def test_query_against_dictionaries(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()]
    compare(rows, QUERIES["op2_url_filter"](spark, sf).collect())


EDGE = [(1, None), (2, ""), (3, "no scheme"), (4, "x://NET/"), (5, "x://NET"), (6, "http://a.Example.net/en/x?y#z"),
        (7, "http://example.net/en"), (8, "http://example.com/de/"), (9, "http://notexample.com/de/"),
        (10, "http://org/fr/"), (11, "http://a://b/c"), (12, "http://h?q=/de/"), (13, "http://é𝄞.com/ü\n/x#"),
        (14, "http://" + "long" * 5000 + ".org/fr/"), (15, "http://a.net/1"), (15, "http://a.net/1")]


def test_edge_urls(spark):
    df = spark.createDataFrame(EDGE, "page_id long, url string").withColumnRenamed("page_id", "host")
    got = uf.judge_urls(df).selectExpr("host as page_id", "judged.*").collect()
    compare(EDGE, got)


def test_no_labelled_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "http://x.com/a"), (2, None)], "page_id long, url string")
    assert [r["judged"]["verdict"] for r in uf.judge_urls(df).collect()] == ["allow", "allow"]
    assert uf.judge_urls(df.limit(0)).count() == 0
