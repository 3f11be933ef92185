import hashlib
import re

from pyspark.sql import functions as F

from talewind.llm import pii

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def holds(kind, hit):
    d = re.sub("[^0-9]", "", hit)
    return {
        "email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in hit.split(".")),
        "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15,
    }[kind]


def brute(text):
    return [(k, m.start(), m.end()) for k, p in RULES.items() for m in re.finditer(p, text or "") if holds(k, m[0])]


ODD = [
    "a@b.c.d@e.f x@y", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.0255 1.2.3.256", "4111 1111 1111 1111, 4111-1111-1111-1111 41111111111111112",
    "+1 (555) 123-4567 +12 +1234567890123456 ++49 30 1234567.", "é漢😀 a_b%c@d-e.fg 漢 10.0.0.1", "a@b.c_x@d.e-@f.g", "." * 50 + "@" * 50,
    "9" * 3000, "1.1.1" * 300, None, "", "x" * 20000 + "@" + "y." * 500,
]


def test_base_spans(spark, documents):
    frame = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    for docs in (frame, documents.select("doc_id", "text")):
        texts = {r.doc_id: r.text for r in docs.collect()}
        for r in pii.digest(pii.found_spans(docs)).collect():
            want = brute(texts[r.doc_id])
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == s[0] for s in want) for k in RULES], (r, want)
            assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
            assert set(r.spans.split(",")) >= {f"{k}:{a}:{b}" for k, a, b in want} - {""}


def test_patterns_find_unseen_identifiers(spark):
    rows = [(i, f"call the desk under phone +49 30 55{i:05d} now") for i in range(40)]
    rows += [(100 + i, f"member card 4{i:03d}-{i * 7 % 10000:04d}-00x{i}") for i in range(3)]
    rows += [(200 + i, f"mail to address user{i}@site{i}.org today") for i in range(40)] + [(300, "mail to address user.name@intranet today")]
    found = {r.doc_id: r for r in pii.digest(pii.found_spans(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert found[300].n_email == 0 and found[300].spans == "email:16:34"
    assert all(found[100 + i].spans == "" for i in range(3))


def test_redaction(spark, odd):
    docs = spark.createDataFrame([(1, "x +1 (555) 123-4567, a@b.co.", 99, "k"), (2, None, 5, "k"), (3, "clean", 6, "k"), (None, "ip 10.0.0.1", 1, "k")], "doc_id long, text string, n_chars long, _x string")
    rows = {r.doc_id: r for r in pii.redacted(docs).collect()}
    assert rows[1].text == "x <PHONE>, <EMAIL>." and rows[1].n_chars == len(rows[1].text)
    assert rows[2].text is None and rows[2].n_chars == 5 and rows[3].n_chars == 6 and rows[None].text == "ip <IP>"
    assert pii.redacted(odd).columns == odd.columns and pii.redacted(odd).count() == 13
    assert pii.found_spans(odd.limit(0)).count() == 0


def test_running_sums(spark):
    rows = spark.createDataFrame([([*range(n)],) for n in (1, 2, 255, 256, 257, 1000)], "v array<long>")
    for r in rows.select("v", pii.running_sums(F.col("v")).alias("s")).collect():
        assert r.s == [sum(r.v[:i]) for i in range(len(r.v))]


def test_very_long_matches(spark):
    """Addresses and numbers of very many parts neither recurse nor take long."""
    texts = ["a@b" + ".c" * 100_000, "1" + " 2" * 50_000, "+1" + " 2" * 50_000 + "3", "1." * 2000 + "1"]
    rows = {r.doc_id: r for r in pii.digest(pii.found_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    assert rows[0].n_email == 1 and "email:0:200003" in rows[0].spans
    assert all(rows[i].n_email == 0 and rows[i].n_card == 0 and rows[i].n_phone == 0 for i in (1, 2))
    assert rows[3].n_ip == 500
