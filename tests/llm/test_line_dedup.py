from collections import Counter, defaultdict

from pyspark.sql import functions as F

from keepsake.llm import line_dedup as ld


def page(lines, noise=""):
    return "<html><head><style>p{}</style></head><body>" + noise + "".join(f"<p>{x}</p>\n" for x in lines) + "</body></html>"


def test_shares_per_host(spark):
    rows = []
    for i in range(8):
        rows.append((i, "http://A.example/x", page(["Menu", " Menu ", f"story {i}", "often" if i < 3 else "seldom"], "<script>Menu</script>")))
    rows += [(20 + i, "http://b.example/", page(["Menu", f"b {i}"])) for i in range(3)]  # too few pages
    rows += [(40, None, page(["Menu"])), (41, "no host", None), (42, "http://a.example", ""), (43, "http://a.example", "<<<<p>" * 2000),
             (0, "http://A.example/x", page(["Menu", "story 0"]))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("cleaned", F.lit(1)).withColumn("host", F.lit("h"))
    got = ld.drop_boilerplate(df).collect()
    assert len(got) == len(rows)
    lines = {"a.example": defaultdict(set)}
    pages = [r for r in rows if r[1] and "a.example" in r[1].lower()]
    count = Counter()
    for _, _, h in pages:
        count.update({x for x in ("Menu", "often", "seldom", *(f"story {i}" for i in range(8))) if h and f">{x}<" in h.replace("> ", ">").replace(" <", "<")})
    drop = {x for x, n in count.items() if n > ld.RATIO * len(pages)}
    assert drop == {"Menu", "seldom"} and lines
    for r in got:
        text = r["cleaned"]["text"].split("\n")
        if r["cleaned"]["host"] == "a.example":
            assert r["cleaned"]["host_pages"] == len(pages) and not drop & set(text)
        elif r["page_id"] >= 20 and r["page_id"] <= 40:
            assert "Menu" in text and r["cleaned"]["n_dropped"] == 0
        assert r["cleaned"]["n_lines"] - r["cleaned"]["n_dropped"] == len([x for x in text if x])
    assert ld.drop_boilerplate(df.limit(0)).count() == 0


def test_page_lines(spark):
    html = "<title>T</title><ul><li><a href='/x'>one</a></li><li> two <b>bold</b></li></ul>a<br>b &amp; c<script>x</script><!-- c -->"
    df = spark.createDataFrame([(html,), (None,), ("",)], "html string")
    assert [r[0] for r in df.select(ld.page_lines(F.col("html"))).collect()] == [["T", "one", "two bold", "a", "b &amp; c"], [], []]
