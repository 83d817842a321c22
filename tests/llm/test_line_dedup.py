import random

from pulse.llm import line_dedup as L


def tokens(line):
    w = line.lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    """Per (id, text): the removed line numbers, the links of its distinct lines, the least id connected to one of them.

    Documents are taken in the order of their ids (null last); equal ids must not differ in their lines' order."""
    own = sorted({(d is None, d or 0, t) for d, t in docs if t is not None})
    first, lines = {}, []
    for k, (_, _, t) in enumerate(own):
        for i, line in enumerate(t.split("\n")):
            key = tuple(line.lower().split())
            if key:
                lines.append((k, i, key))
                first.setdefault(key, k)
    classes = list(first)
    sets = {c: tokens(" ".join(c)) for c in classes}
    similar = {c: set() for c in classes}
    gone_classes, root = set(), {c: c for c in classes}
    at = {c: n for n, c in enumerate(classes)}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    for n, c in enumerate(classes):
        for o in classes[:n]:
            if len(sets[c] & sets[o]) * 9 >= 4 * (len(sets[c]) + len(sets[o])):
                similar[c].add(o)
                similar[o].add(c)
                gone_classes.add(c)
                x, y = sorted((find(c), find(o)), key=at.get)
                root[y] = x
    out, seen = {}, set()
    for k, (none, d, t) in enumerate(own):
        mine = [(i, c) for kk, i, c in lines if kk == k]
        gone = []
        for i, c in mine:
            if c in seen or c in gone_classes:
                gone.append(i)
            seen.add(c)
        ids = [own[first[find(c)]] for _, c in mine]
        known = [i[1] for i in ids if not i[0]] + ([] if none else [d])
        out[(None if none else d, t)] = (gone, sum(len(similar[c]) for c in {c for _, c in mine}), min(known, default=None))
    return out


def corpus():
    rnd = random.Random(8)
    words = ["w%d" % i for i in range(400)]
    base = [[rnd.choice(words) for _ in range(rnd.choice([1, 3, 5, 6, 9, 30, 60]))] for _ in range(50)]
    passage = [rnd.choice(words) for _ in range(40)]
    docs = []
    for d in range(90):
        lines = []
        for _ in range(rnd.randrange(0, 6)):
            line = list(rnd.choice(base))
            kind = rnd.random()
            if kind < 0.4:
                line[rnd.randrange(len(line))] = rnd.choice(words)
            elif kind < 0.6:
                line = passage + [rnd.choice(words) for _ in range(rnd.randrange(4, 40))]
            lines.append("  ".join(line).upper() if kind > 0.9 else " ".join(line))
        docs.append((d, "\n".join(lines)))
    long = " ".join(rnd.choice(words) for _ in range(4000))
    return docs + [(200, None), (201, ""), (202, " \n\t\n "), (None, docs[3][1]), (5, docs[5][1]), (7, "other text of seven"),
                   (300, long), (301, long + " tail"), (302, "w1 w2 w3\nw1 w2 w3")]


def test_removed_lines_equal_brute_force(spark, monkeypatch):
    docs = corpus()
    random.Random(1).shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs)
    # equal first fields are ordered by the text's hash, so ids that repeat with other texts are left out of the comparison
    texts = {}
    for d, t in docs:
        texts.setdefault(d, set()).add(t)
    compared = 0
    for few, block in ((L.FEW, L.BLOCK), (0, 3), (10**6, 1)):      # all tokens frequent and in parts; all rare
        monkeypatch.setattr(L, "FEW", few)
        monkeypatch.setattr(L, "BLOCK", block)
        got = L.dedup_lines(df).collect()
        assert len(got) == len(docs)
        kept = {d: [] for d, _ in docs}
        for r in got:
            kept[r["doc_id"]].append(r["text"])
        report = {r["doc_id"]: r for r in L.line_report(df).collect()}
        for (d, t), (gone, links, least) in want.items():
            if len(texts[d]) == 1:
                left = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
                assert kept[d] == [left] * len(kept[d])
                assert (report[d]["removed"], report[d]["n_links"], report[d]["n_lines"], report[d]["class_id"]) == (
                    gone, links, len(t.split("\n")), least)
                compared += 1
    assert compared > 150 and sum(links for _, links, _ in want.values()) > 20


def test_links_between_different_lines_are_kept(spark):
    """A line, and the same with one word changed in two documents: one link, one component."""
    line = [f"w{i}" for i in range(60)]
    near = " ".join([*line[:30], "x", *line[31:]])
    docs = [(1, " ".join(line)), (2, near), (3, near), (4, "something else")]
    report = {r["doc_id"]: r for r in L.line_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {d: (r["class_id"], r["n_links"], r["removed"]) for d, r in report.items()} == {
        1: (1, 1, []), 2: (1, 1, [0]), 3: (1, 1, [0]), 4: (4, 0, [])}


def test_columns_stay_and_the_length_is_kept_right(spark):
    df = spark.createDataFrame([(1, "a b\nc d", 7, 1), (2, "A  b\nnew", 8, 2), (3, None, None, 3)],
                               "doc_id long, text string, n_chars int, cid int")
    kept = {r["doc_id"]: (r["text"], r["n_chars"], r["cid"]) for r in L.dedup_lines(df).collect()}
    assert kept == {1: ("a b\nc d", 7, 1), 2: ("new", 3, 2), 3: (None, None, 3)}
    assert L.dedup_lines(df).schema == df.schema
    assert L.dedup_lines(df.limit(0)).collect() == [] and L.line_report(df.limit(0)).collect() == []


def test_lines_that_differ_in_white_space_alone_are_equal(spark):
    long = [f"w{i}" for i in range(30)]
    docs = [(1, "a b\r\nnew"), (2, "a\tb\n \t\r\nA \x0b\f b"), (3, " ".join(long)), (4, "\t".join(long) + "\r"),
            (5, "  ".join([*long[:29], "x"]))]
    report = {r["doc_id"]: r for r in L.line_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {d: r["removed"] for d, r in report.items()} == {1: [], 2: [0, 2], 3: [], 4: [0], 5: [0]}
    assert {d: r["class_id"] for d, r in report.items()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3}     # 5 is similar to 3


def test_repeated_rows_keep_their_near_copies(spark):
    line = [f"w{i}" for i in range(54)]
    near = " ".join([*line[:27], "x", *line[28:]])        # Jaccard 45 / 55
    docs = [(1, " ".join(line))] * 3 + [(2, near)] * 3 + [(None, near.upper() + " y")] * 4
    report = L.line_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["removed"]) for r in report) == sorted(
        [("1", [])] * 3 + [("2", [0])] * 3 + [("None", [0])] * 4)
    docs = [(1, " ".join(line)), *[(None, near)] * 5]
    report = L.line_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["removed"]) for r in report) == [("1", [])] + [("None", [0])] * 5
