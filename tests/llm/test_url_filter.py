import math
import re

from quillstat.llm import url_filter as U

SCHEMA = "page_id long, url string, html string, host string, verdict string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")


def rule(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


URLS = ["http://a.com/x", "http://COM/", "http://a.com", "https://example.com/en/1?x", "https://m.example.com/en/", "http://www.example.com/en/2#a",
        "http://w.www.example.com/en/3", "http://a.net/es/1", "http://net/fr/", "http://a.net/en/1", "http://notnet/es/", "http://a.org/e?/es/", "no scheme", None, "",
        "x://y://z/p", "://h.com/a/b#c", "http://a.b\n.com/x\ny?z", "http://ÄB.com/É", "http://user@h.net:80/es/1", "http://a.org?x=/y"]


def test_hosts_paths_and_rules(spark):
    rows = [(i, u, "<p>some words here</p>") for i, u in enumerate(URLS)] + [(0, URLS[0], None), (None, "http://a.org/x", "")]
    got = U.judge_urls(table(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        url = "http://a.org/x" if r["page_id"] is None else URLS[r["page_id"]]
        host, path = parts(url)
        assert (r["host"], r["path"]) == (host, path)
        name, verdict = rule(host, path)
        assert r["rule"] == name and r["verdict"] in ("allow", "block")
        if verdict:
            assert r["verdict"] == verdict and r["score"] is None


def test_segment():
    logp = {w: math.log(n / 1000) for w, n in (("cheap", 50), ("pills", 40), ("the", 300), ("then", 30), ("pill", 20), ("s", 1))}
    assert U.segment("cheappills", logp) == ["cheap", "pills"]
    assert U.segment("thethen", logp) == ["the", "then"]
    assert U.segment("", logp) == []
    assert U.segment("qqq", logp) == ["qqq"] and U.segment("cheapqq", logp) == ["cheap", "qq"]


def test_segment_is_the_best_split():
    logp = {w: math.log(p) for w, p in (("a", .1), ("ab", .2), ("abc", .05), ("bc", .3), ("c", .05))}

    def cost(ws):
        return sum(logp.get(w, -math.log(1e6) - (2 + len(w)) * math.log(10)) for w in ws)

    def splits(x):
        return [[]] if not x else [[x[:i]] + r for i in range(1, len(x) + 1) for r in splits(x[i:])]
    for name in ("abc", "abcab", "cabbc", "xabcx"):
        assert math.isclose(cost(U.segment(name, logp)), max(map(cost, splits(name))))


def test_naive_bayes_separates(spark):
    """Pages no rule decides follow the words they share with decided ones; scores equal a plain computation."""
    rows = [(i, f"http://shop{i % 3}.net/es/cheappills/{i}", "<p>cheap pills cheap pills news daily</p>") for i in range(20)]
    rows += [(100 + i, f"http://read{i % 3}.com/dailynews/{i}", "<p>daily news daily news cheap pills</p>") for i in range(20)]
    rows += [(200, "http://x.org/cheappills", ""), (201, "http://y.org/dailynews", "")]
    got = {r["page_id"]: r for r in U.judge_urls(table(spark, rows)).collect()}
    assert got[200]["verdict"] == "block" and got[201]["verdict"] == "allow"

    logp = U.dictionary(table(spark, rows).select("page_id", "url", "html"))
    assert set(logp) == {"cheap", "pills", "news", "daily"}

    def tokens(url):
        host, path = parts(url)
        out = []
        for part, c in (("h", host), ("p", path)):
            for name in re.split(r"[^a-z0]+", re.sub(r"\d+", "0", c.lower())):
                out += [f"{part}:{w}" for w in U.segment(name, logp)] if name else []
        return out
    count = {"block": {}, "allow": {}}
    for _, u, _ in rows[:40]:
        for t in tokens(u):
            c = count[rule(*parts(u))[1]]
            c[t] = c.get(t, 0) + 1
    v = len(set(count["block"]) | set(count["allow"]))
    total = {k: sum(c.values()) for k, c in count.items()}
    for i, u in ((200, rows[40][1]), (201, rows[41][1])):
        s = sum(math.log((count["block"].get(t, 0) + 1) / (total["block"] + v + 1)) - math.log((count["allow"].get(t, 0) + 1) / (total["allow"] + v + 1))
                for t in tokens(u) if t in count["block"] or t in count["allow"])
        assert abs(got[i]["score"] / 1e9 - s) < 1e-6


def test_dictionary_is_bounded_and_whole_levels(spark):
    html = " ".join(f"w{chr(97 + i)} " * (26 - i) for i in range(26))
    t = table(spark, [(1, "u", html)])
    assert set(U.dictionary(t, 3)) == {"wa", "wb", "wc"}
    two = table(spark, [(1, "u", "aa aa bb bb cc cc dd")])
    assert set(U.dictionary(two, 3)) == {"aa", "bb", "cc"} and U.dictionary(two, 2) == {}


def test_segmented_knows_every_word(spark, monkeypatch):
    """Words below any bound of the dictionary, and the total over all words; equal to the splitter with the whole vocabulary."""
    html = "cheap " * 60 + "pills " * 50 + "ch eappills rareword " + " ".join(f"{a}{b}{c}" for a in "abcdefg" for b in "hijklmn" for c in "opqrstu")
    t = table(spark, [(1, "u", html), (2, "u", None)])
    counts = U.word_counts(t)
    full = {r["word"]: r["n"] for r in counts.collect()}
    logp = {w: math.log(n / sum(full.values())) for w, n in full.items()}
    names = ["cheappills", "rarewordaho", "cheap0pills0", "0", "zz", "ünï", "ahobipcjq" * 30, "x" * 500, "rarewordrareword"]
    monkeypatch.setattr(U, "DICTIONARY_WORDS", 2)
    monkeypatch.setattr(U, "PIECES", 100)
    got = U.segmented(spark.createDataFrame([(x,) for x in names + names[:3]], "name string"), counts).collect()
    assert sorted(r["name"] for r in got) == sorted(names)
    for r in got:
        assert r["words"] == U.segment(r["name"], logp)
    assert {r["name"]: r["words"] for r in got}["rarewordaho"] == ["rareword", "aho"]


def test_judge_takes_words_below_the_old_bound(spark, monkeypatch):
    """One page more of rare words than the dictionary takes must not change how names are split."""
    monkeypatch.setattr(U.dictionary, "__defaults__", (1,))
    rows = [(i, f"http://a{i}.net/es/cheappills", "cheap pills") for i in range(5)] + [(10 + i, f"http://b{i}.com/dailynews", "daily news") for i in range(5)]
    rows += [(100, "http://x.org/pillscheap", ""), (101, "http://y.org/newsdaily", "")]
    got = {r["page_id"]: r for r in U.judge_urls(table(spark, rows)).collect()}
    assert got[100]["verdict"] == "block" and got[101]["verdict"] == "allow"
    assert got[100]["score"] > 0 > got[101]["score"]


def test_empty_table(spark):
    assert U.judge_urls(table(spark, [])).count() == 0
