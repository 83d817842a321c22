import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from pulse.llm import alignment as A
from pulse.llm.queries import op13_token_alignment

SF = "/root/testdata/sf0.001"
ODD = ["a", "b", "é", "ß", " ", "  ", "\n", "\t", ".", "'s", "'", "1", "23", "—", "don't", "<|endoftext|>", "<s>", "<0x0A>", "▁", "日本", "\r",
       " ", "_", "😀", "é", "ﬁ", "\x00"]


@pytest.fixture(scope="module")
def both():
    return A.tokenizers(A.FOLDER)


def _plainly(both, text):
    """(a ids, b ids) by the two libraries over the whole text, and the tokens' bytes."""
    if not text:
        return [], []
    a = both.byte_bpe.encode(" " + text, add_special_tokens=False).ids
    b = both.pieces.encode(text)
    data = (" " + text).encode()
    a_bytes = b"".join(both.a_bytes[i] for i in a)
    b_bytes = b"".join(both.b_bytes[i] for i in b)
    return (a, b) if a_bytes == data == b_bytes else ([], [])


def _spans(sizes, ids):
    ends = np.cumsum([sizes[i] for i in ids]).tolist()
    return list(zip([0, *ends[:-1]], ends))


def _documents(both, texts):
    """What the contract asks of every text, by loops over token spans."""
    own = [_plainly(both, t) for t in texts]
    links = []
    for a, b in own:
        sa, sb = _spans(both.a_sizes, a), _spans(both.b_sizes, b)
        links.append([(a[i], b[j]) for i, (x, y) in enumerate(sa) for j, (u, v) in enumerate(sb) if max(x, u) < min(y, v)])
    counts = Counter(p for own_links in links for p in own_links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for (a, b), own_links in zip(own, links):
        ends_a, ends_b = [y for _, y in _spans(both.a_sizes, a)], [y for _, y in _spans(both.b_sizes, b)]
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, lo = [], 0
        for cut in cuts:
            groups.append(",".join(str(t) for t, e in zip(a, ends_a) if lo < e <= cut) + "|"
                          + ",".join(str(t) for t, e in zip(b, ends_b) if lo < e <= cut))
            lo = cut
        out.append((len(a), len(b), len(cuts), len(own_links), sum(counts[p] == best[p[1]] for p in own_links),
                    sum(counts[p] for p in own_links), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_row_products_are_the_matrix_product():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x, y = (rng.integers(0, 3, s) * (rng.random(s) < 0.4) for s in ((5, 7), (7, 6)))

        def csr(m):
            rows, columns = np.nonzero(m)
            return A.Csr(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(m)))]), columns, m[rows, columns], m.shape[1])
        i, j, v = A.row_products(csr(x), csr(y))
        dense = np.zeros((5, 6), int)
        dense[i, j] = v
        assert (dense == x @ y).all() and (np.diff(i * 6 + j) > 0).all()
        t = csr(y).transposed()
        assert t.width == 7 and t.columns.tolist() == np.nonzero(y.T)[1].tolist()


def test_words_and_whole_texts_give_the_libraries_ids(both):
    rng = random.Random(2)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += ["x" * 5000, " " * 3000 + "y", "ab " * 4000, "\n" * 700 + "z"]
    got = both.encode(texts)
    assert [(a.tolist(), b.tolist()) for a, b in got] == [_plainly(both, t) for t in texts]


def test_every_document_of_the_table(spark, both):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' where length(text) < 4000 order by doc_id").fetchall()
    df = spark.createDataFrame([(i, t, 1, "x", 2.0) for i, t in rows], "doc_id long, text string, row int, pair string, n_a double")
    want = {i: w for (i, _), w in zip(rows, _documents(both, [t for _, t in rows]))}
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in A.alignment_report(df).collect()}
    assert got == want
    # with counts that are not broadcast: most links are joined
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in A.alignment_report(df, most=20).collect()} == want
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in A.alignment_report(df, most=0).collect()} == want


def test_query_runs_over_whole_texts(spark):
    n = duckdb.sql(f"select count(*) from '{SF}/documents.parquet'").fetchall()[0][0]
    got = op13_token_alignment(spark, SF).collect()
    assert len(got) == n and all(r["n_links"] >= max(r["n_a"], r["n_b"]) for r in got)


def test_edge_cases(spark, both):
    texts = [None, "", "same text.", "same text.", "a▁b", "日本語 text", "\x00", " ", "  lead", "trail ", "é" * 30000, "word " * 20000]
    df = spark.createDataFrame([(None if i == 2 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = A.alignment_report(df).collect()
    want = _documents(both, [t if t and len(t) < 1000 else "" for t in texts])
    counts = {}
    for r in got:
        counts.setdefault(r["doc_id"], []).append(tuple(r[c] for c in COLUMNS))
    assert counts[0] == counts[1] == [(0, 0, 0, 0, 0, 0, "")]
    assert counts[4] == [(0, 0, 0, 0, 0, 0, "")]            # U+2581 comes back as a blank
    for i in (5, 7, 8, 9):                                  # short ones: tokens and groups don't depend on the others
        assert [c[:4] + c[6:] for c in counts[i]] == [want[i][:4] + want[i][6:]]
    assert counts[None][0] == counts[3][0]
    assert counts[10][0][0] > 0 and counts[11][0][0] >= 20000
    assert A.alignment_report(df.limit(0)).collect() == []


def test_links_of_each_kind(spark, both):
    df = spark.createDataFrame([(1, "Unbelievable tokenizers, éh?")], "doc_id long, text string")
    a, b = _plainly(both, "Unbelievable tokenizers, éh?")
    sa, sb = _spans(both.a_sizes, a), _spans(both.b_sizes, b)
    got = A.token_links(df).collect()
    assert {(r["a_at"], r["b_at"], r["bytes"]) for r in got if r["kind"] == "overlap"} == {
        (i, j, min(y, v) - max(x, u)) for i, (x, y) in enumerate(sa) for j, (u, v) in enumerate(sb) if max(x, u) < min(y, v)}
    cuts = sorted({y for _, y in sa} & {y for _, y in sb})
    group = lambda end: sum(c < end for c in cuts)
    assert {(r["a_at"], r["b_at"]) for r in got if r["kind"] == "group"} == {
        (i, j) for i, (_, y) in enumerate(sa) for j, (_, v) in enumerate(sb) if group(y) == group(v)}
    assert all(r["a_id"] == a[r["a_at"]] and r["b_id"] == b[r["b_at"]] for r in got)
