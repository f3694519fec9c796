import hashlib
import math
import random
import re

from quillon.llm import pii

KINDS = ["email", "ip", "card", "phone"]
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    double = [sum(divmod(2 * int(c), 10)) for c in s[-2::-2]]
    return (sum(map(int, s[-1::-2])) + sum(double)) % 10 == 0


def plain(t):
    out = [(m.start(), m.end(), "email") for m in EMAIL.finditer(t)]
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[ -]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(t) if 10 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def test_base_equals_plain_patterns(spark, sf):
    random.seed(3)
    made = ["".join(random.choice("ab.@-+ 0123456789().,%x\né") for _ in range(random.randint(0, 60))) for _ in range(20000)]
    for t in made:
        assert pii.base_spans(t) == plain(t), t
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = pii.find(docs).collect()
    assert len(got) == len(texts) and any(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got)
    for r in got:
        want = plain(texts[r.doc_id])
        listed = ",".join(f"{k}:{a}:{b}" for a, b, k in want)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for *_, k in want) for x in KINDS]
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))


def test_disclosing_terms_equal_brute_force(spark):
    rows = ["ask Zorro at a@b.co now please"] * 2 + ["Zorro wrote a@b.co please"] + ["please ask now at home"] * 9 + ["ask c@d.ee now quietly", "c@d.ee said quietly yes", "other quietly"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = docs.select(pii.find_base(docs).alias("f")).select("f.*")
    got = {(r.entity, r.term): r.disclosure for r in pii.disclosing_terms(found, docs, least=-9).collect()}
    n, want = len(rows), {}
    words = [set(re.findall(r"[a-z]{3,}", t.lower())) for t in rows]
    for e in ("a@b.co", "c@d.ee"):
        holds = [k for k, t in enumerate(rows) if e in t]
        for t in {w for k in holds for w in re.findall(r"[a-z]{3,}", rows[k].lower().replace(e, " "))}:
            both = sum(t in re.findall(r"[a-z]{3,}", rows[k].lower().replace(e, " ")) for k in holds)
            if both >= 2:
                n_t = sum(t in w for w in words)
                want[f"email:{e}", t] = math.log(n * both / (len(holds) * n_t)) / math.log(n / len(holds))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert got["email:a@b.co", "zorro"] > 0.99 and got["email:a@b.co", "please"] < 0.5
    clean = {r.doc_id: r.text for r in pii.sanitize(docs).collect()}
    assert clean[0] == "ask  at [email] now please" and clean[3] == rows[3]
    spans = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    assert spans[0] == "term:4:9,email:13:19" and spans[3] == ""


def test_terms_disclose_from_the_whole_document(spark):
    far = "filler words stand here " * 60
    rows = [f"Zorro {far} a@b.co {far} and zorro again"] * 2 + [f"a@b.co {far} Zorro"] + [far] * 9
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = docs.select(pii.find_base(docs).alias("f")).select("f.*")
    got = {(r.entity, r.term): r.disclosure for r in pii.disclosing_terms(found, docs).collect()}
    assert abs(got["email:a@b.co", "zorro"] - 1) < 1e-9 and ("email:a@b.co", "filler") not in got
    spans = {r.doc_id: r.spans.split(",") for r in pii.find(docs).collect()}
    for k in range(3):
        assert {f"term:{m.start()}:{m.end()}" for m in re.finditer("zorro", rows[k].lower())} <= set(spans[k])
    clean = {r.doc_id: r.text for r in pii.sanitize(docs).collect()}
    assert all("zorro" not in clean[k].lower() and "[email]" in clean[k] for k in range(3)) and clean[5] == far


def test_edges(spark):
    rows = [(None, None), (1, ""), (1, "x@y.zz"), (2, "9" * 20000), (3, "a" * 200000), (4, "1." * 50000), (5, "+1" + " " * 50000), (6, "é x@y.zz")]
    docs = spark.createDataFrame([(i, t, 0, "k", 1, 2) for i, t in rows], "doc_id long, text string, n_chars int, key string, pii_key int, PII_marks int")
    got = pii.find(docs).collect()
    assert len(got) == len(rows)
    assert sorted(r.spans for r in got if "email" in r.spans) == ["email:0:6", "email:2:8"]
    assert all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in got if not r.spans)
    out = pii.sanitize(docs)
    assert {(r.pii_key, r.PII_marks, r.key) for r in out.collect()} == {(1, 2, "k")}
    assert out.columns == docs.columns and sorted((r.text or "")[:9] for r in out.where("doc_id in (1, 6)").collect()) == ["", "[email]", "é [email]"]
    assert out.where("text = 'é [email]'").first().n_chars == 9
    assert pii.find(docs.limit(0)).count() == 0 and pii.sanitize(docs.limit(0)).count() == 0


def test_an_entity_in_many_texts_meets_only_terms_of_the_text(spark):
    """One address in every other text, a term of its own in each three: as many spans as hold a term, and rows of the join in proportion."""
    rows = [f"write to all@one.org about name{chr(97 + k // 78)}{chr(97 + k // 3 % 26)}" if k < 300 else "nothing to say here" for k in range(900)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = docs.select(pii.find_base(docs).alias("f")).select("f.*").cache()
    terms = pii.disclosing_terms(found, docs)
    assert terms.count() == len({w for t in rows for w in t.split() if "name" in w}) + 2  # write, about
    spans = pii.find(docs).collect()
    assert sum(r.spans.count("term:") for r in spans) == 300 * 3
