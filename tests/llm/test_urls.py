import duckdb
import pytest

from quillon.llm import urls

SPLIT = r"""
with r as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end rest from pages)
select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
       regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') path from r"""


def expected_rule(host, path):
    best = None
    for verdict, h, p in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return best


@pytest.fixture(scope="module")
def model(spark):
    return urls.train(urls.labelled(spark))


def test_rules_and_parts(spark, sf, model):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    want = {r[0]: r[1:] for r in con.execute(SPLIT).fetchall()}
    got = urls.judge(spark.read.parquet(f"{sf}/pages.parquet"), model).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.host, r.path) == want[r.page_id]
        own = expected_rule(r.host, r.path)
        assert r.rule == (own[0] if own else None)
        assert r.verdict == (own[1] if own else "block" if r.block_score >= 0.5 else "allow")


def judged(spark, model, hosts):
    df = spark.createDataFrame([(k, f"https://{h}/a/17") for k, h in enumerate(hosts)], "page_id long, url string")
    return {hosts[r.page_id]: r.block_score for r in urls.judge(df, model, rules=()).collect()}


def test_names_that_were_not_taught(spark, model):
    """Hosts none of which stands in the labelled table, joined from its words and from others in ways it does not use."""
    taught = {r.host for r in urls.features(urls.labelled(spark)).select("host").distinct().collect()}
    block = ["roulette-win.org", "cheap-rolex.org", "onlinecasinoroyal.info", "pokernight.co", "free-porn-videos.biz", "buyviagraonline.ru", "thepaydayloansguy.us", "torrentswarez.to", "jackpotslots.io", "megalottery-prize.net"]
    allow = ["cityhospital.org", "publiclibrary-oslo.no", "old-museumsquare.de", "universityofnorthland.edu", "weathertoday.fm", "village-bakery.co.uk", "mountainhotel.ch", "schoolforum.nl", "gardenrecipes.fr", "the-doctor-clinic.ie"]
    assert not taught & {*block, *allow}
    got = judged(spark, model, block + allow)
    assert sum(got[h] >= 0.5 for h in block) >= 7, got
    assert sum(got[h] < 0.5 for h in allow) >= 9, got
    assert sum(got[a] > got[b] for a in block for b in allow) >= 0.9 * len(block) * len(allow), got


def test_words_that_were_not_taught_are_allowed(spark):
    """A third of the allowed words is held out of the table, with all their forms; what the rest teaches leaves other words alone."""
    table = urls.labelled(spark)
    held = urls.ALLOWED_NAMES[::3]
    plain = "|".join(held)
    model = urls.train(table.where(f"not url rlike '{plain}'"))
    got = judged(spark, model, [f"{w}.example.org" for w in held])
    assert sum(s < 0.5 for s in got.values()) >= 0.8 * len(held)


def test_any_labelled_table(spark):
    table = spark.createDataFrame([(f"http://{w}{k}.org/", float(w == "blue")) for w in ("blue", "green") for k in range(30)], "url string, label double")
    pages = spark.createDataFrame([(1, "http://bluehouse.org/"), (2, "http://greenhouse.org/")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urls.judge(pages, table=table, rules=()).collect()} == {1: "block", 2: "allow"}


def test_edges(spark, model):
    made = [
        (1, None), (2, "no scheme"), (3, "://"), (4, "HTTP://WWW.Example.COM/en/x?q#f"), (5, "http://example.com"), (6, "http://a.net/fr/"),
        (7, "http://big-casino.org/poker"), (8, "http://city-library.org/books"), (9, "http://x.org/" + "a" * 30000), (9, "http://anexample.com/en/"), (None, "http://é.net/ES/"),
    ]
    got = {(r.page_id, r.host): r for r in urls.judge(spark.createDataFrame([(i, u, "z") for i, u in made], "page_id long, url string, hashed string"), model).collect()}
    at = {k[0]: v for k, v in got.items() if k[0] != 9}
    assert (at[1].host, at[1].path, at[1].rule) == ("", "", None) and (at[2].host, at[3].host) == ("", "")
    assert (at[4].host, at[4].path, at[4].rule, at[4].verdict) == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert at[5].path == "" and at[5].rule is None
    assert (at[6].rule, at[6].verdict) == ("net/fr/", "block")
    assert at[7].verdict == "block" and at[8].verdict == "allow"
    assert got[9, "anexample.com"].rule == "com/" and len(got) == len(made)
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), model).count() == 0
