import re
from collections import Counter

from support import SF, same_rows

from tesselar.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    lines = text.split("\n")
    full = [x for x in lines if re.search(r"[^\x20\x09-\x0D]", x)]
    times = Counter(full)
    chars = lambda s: len(re.sub(r"[\x20\x09-\x0D]", "", s))

    def marked(k):
        grams = [tuple(words[i : i + k]) for i in range(n - k + 1)]
        c = Counter(grams)
        return {j for i, g in enumerate(grams) if c[g] > 1 for j in range(i, i + k)}

    return (n, sum(map(len, words)), sum(text.count(x) for x in "#*$%&|<>"), len(full) - len(times), len(marked(3)), sum(c * chars(x) for x, c in times.items() if c > 1), len(full), *(sum(len(words[i]) for i in marked(k)) for k in quality.COVERAGE))


def test_brute_force(duck, nasty):
    texts = [t for (t,) in duck.execute("SELECT text FROM documents LIMIT 80").fetchall()] + [r["text"] for r in nasty.collect()]
    texts += ["a b c d e f g h i j k a b c d e f g h i j k", "x\nx\nx\n\n", "a b a b a b a b a b a b a b", "l1 l2\nl1 l2\n" * 9]
    for t in texts:
        assert quality.measure(t or "") == brute(t), repr(t)[:80]


def test_query(spark, duck):
    ours, theirs = same_rows(quality.op2_quality(spark, SF), duck, quality.OP2_SQL)
    assert ours == theirs


def test_hard_rows(nasty, empty):
    from pyspark.sql import functions as F

    rows = quality.rate(nasty.withColumn("KEPT", F.lit("x"))).collect()
    assert len(rows) == nasty.count() and not any(r["kept"] for r in rows if not r["text"])
    assert quality.keep_good(nasty).columns == nasty.columns
    assert quality.rate(empty).count() == 0 and quality.keep_good(empty).count() == 0


def test_verdict():
    clean = " ".join(f"w{i}" for i in range(200))
    assert quality.verdict(quality.measure(clean)) == (False, True)
    assert quality.verdict(quality.measure(" ".join(f"w{i}" for i in range(49)))) == (True, False)
    passage = " ".join(f"p{i}" for i in range(30))
    assert quality.verdict(quality.measure(f"{passage} {clean} {passage}")) == (False, False)
    assert quality.verdict(quality.measure(clean + "\n" + "one long repeated line of text here\n" * 9))[1] is False
