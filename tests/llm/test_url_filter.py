import fnmatch
import random
import re

from pyspark.sql import functions as F

from pulse.llm import url_filter as U


def brute(url, rules, default="allow"):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fits = []
    for rule, verdict in rules:
        rhost, slash, rest = rule.partition("/")
        if (host == rhost or host.endswith("." + rhost)) and path.startswith(slash + rest):
            fits.append((-len(rule), verdict != "block", rule, verdict))
    best = min(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def urls():
    rnd = random.Random(2)
    hosts = ["example.org", "m.example.org", "EXAMPLE.ORG", "xexample.org", "org", "a.b.com", "com", "net.com:80", "", "é.org"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?x=/es/", "/fr/é", "/de/x#y", "//es/", "/x.org/", "/" + "a" * 3000]
    out = [f"{rnd.choice(['http', 'HTTPS', ''])}://{h}{p}" for h in hosts for p in paths]
    return out + [None, "", "no scheme", "a://b://example.org/es/", "http://example.org\n/es/", "x" * 5000]


def test_verdicts_equal_brute_force(spark):
    rows = list(enumerate(urls())) + [(3, "http://org/"), (3, "http://org/")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("rule", F.lit(2))
    for rules in (U.RULES, [], [("org", "block"), ("com/d", "allow"), ("com/", "block"), ("com/f", "block")]):
        got = sorted(map(tuple, U.judge_urls(df, rules).collect()), key=str)
        assert got == sorted(((i, *brute(u, rules)) for i, u in rows), key=str)
    assert U.judge_urls(df.limit(0)).collect() == []


def test_many_globs_over_several_words_equal_fnmatch():
    rnd = random.Random(4)
    globs = ["".join(rnd.choice("ab.?*") for _ in range(rnd.randrange(1, 30))) for _ in range(80)]
    globs = [g.replace("**", "*") for g in globs]
    texts = ["".join(rnd.choice("ab.") for _ in range(rnd.randrange(0, 25))) for _ in range(300)]
    automaton = U.WildcardAutomaton(globs)
    assert automaton.words > 10
    for k, g in enumerate(globs):
        rank = [len(globs)] * len(globs)
        rank[k] = 0
        hit = automaton.best([t.encode() for t in texts], __import__("numpy").array(rank), len(globs)) == 0
        assert hit.tolist() == [fnmatch.fnmatchcase(t, g) for t in texts]


def test_single_stars_stop_at_slashes():
    automaton = U.WildcardAutomaton(["*.org/x**", "a**z", "?b"])
    accepts = automaton.run([b".a.org/xy", b"/.org/x", b"a/z", b"/b", b"cb"]) & automaton._mask(automaton.finals)
    assert (accepts.any(axis=1)).tolist() == [True, False, True, False, True]
