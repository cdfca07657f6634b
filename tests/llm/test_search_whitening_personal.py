"""Lexical search, whitening and personal data against brute force, and the edge cases that their docstrings define."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandscope.llm import lexical_search, pii, queries, terms, whitening

DOCS = "doc_id long, text string, rank string, score string, row string, spans string, n_spans string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def frame(spark, rows, parts=3):
    """Documents with extra columns whose names clash with results and internal names."""
    return spark.createDataFrame([(i, t, "a", "b", "c", "d", "e") for i, t in rows], DOCS).repartition(parts)


def lowered(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def words(rng, n, size=40):
    return " ".join("w" + str(min(int(rng.expovariate(0.15)), size)) for _ in range(n))


# --- terms -------------------------------------------------------------------


def test_terms_are_those_of_the_pattern():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aZ9 .\n\t\x00\x0b\x7f\x85 éÉ“漢𝔘İ{[_'") for _ in range(rng.randint(0, 40))) for _ in range(400)] + [None, ""]
    for array in (pa.array(texts), pa.array(["x y", *texts]).slice(1)):
        row, found = terms.split(array)
        got = defaultdict(list)
        for r, t in zip(row.tolist(), found.to_pylist(), strict=True):
            got[r].append(t)
        assert [got[i] for i in range(len(texts))] == [lowered(t) for t in texts]


def test_slices_cover_a_batch():
    batch = pa.record_batch([pa.array(["a" * n for n in (5, 0, 90, 3, 3, 3)] + [None])], names=["t"])
    parts = list(terms.slices(batch, "t", 8))
    assert [x for p in parts for x in p["t"].to_pylist()] == batch["t"].to_pylist()
    assert all(p.num_rows == 1 or sum(len(x or "") for x in p["t"].to_pylist()) <= 8 for p in parts)


# --- lexical search ----------------------------------------------------------


def ranked(docs, items, k=10):
    held = [(i, Counter(lowered(t))) for i, t in docs]
    n_docs, n_words = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        rows = []
        for i, c in held:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // max(1, n_words)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(lowered(text)) if t in c)
            if s > 0:
                rows.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("segment", [(1, 1), (400, 30), (2_000_000, 65_536)])
def test_search_against_all_scores(spark, segment):
    rng = random.Random(5)
    docs = [(i, words(rng, rng.choice([1, 5, 30, 200]))) for i in range(300)]
    docs += [(1000 + i, docs[i % 7][1]) for i in range(60)] + [(None, docs[0][1]), (3, docs[0][1]), (3, docs[0][1]), (2000, None), (2001, ""), (2002, "?!"), (2003, words(rng, 20_000))]
    items = [(i, words(rng, 12)) for i in range(12)] + [(20, None), (21, ""), (22, "nowhere"), (23, "W1 w1 w39"), (23, "w2"), (None, "w3 w4")]
    index = lexical_search.build_index(frame(spark, docs), segment_terms=segment[0], segment_docs=segment[1])
    rows = lexical_search.search(index, frame(spark, items).select(F.col("doc_id").alias("item_id"), "text", "rank", "score"), query_terms=15).collect()
    assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows), key=str) == ranked(docs, items)


def test_search_of_nothing(spark):
    none, some = frame(spark, []), frame(spark, [(1, "a b")])
    items = lambda d: d.withColumnRenamed("doc_id", "item_id")
    assert lexical_search.search(lexical_search.build_index(none), items(some)).count() == 0
    assert lexical_search.search(lexical_search.build_index(some), items(none)).count() == 0


def test_blocks_stay_compressed_below_the_threshold():
    """A term of one document decides; of the frequent term, the blocks after that document stay closed."""
    count = 6_400
    doc = np.r_[np.arange(count), [777]]
    found = pa.array(["often"] * count + ["once"], pa.large_string())
    rows = lexical_search.segment_rows(1, list(range(count)), doc, found, count, count + 1)
    (segment,) = lexical_search._segments(iter([rows]))
    best = lexical_search.Best(1)
    best.add(np.array([10**9]), np.array([5]), np.array([True]))
    lexical_search.search_segment(segment, [("often", 1), ("once", 9_000)], best)
    assert [i for _, i in best.rows] == [777]
    assert segment.lists["often"].open.sum(axis=1).tolist() == [777 // 64 + 1, 1]


def test_varint_round_trip():
    rng = np.random.default_rng(2)
    values = np.r_[0, 127, 128, 2**31 - 1, rng.integers(0, 2 ** rng.integers(1, 31, 500))]
    data, size = lexical_search.varint(values)
    assert len(data) == size.sum() and (lexical_search.unvarint(data) == values).all()


def test_search_query_equals_its_sql(spark, tmp_path):
    import duckdb

    sf_dir = "/root/testdata/sf0.001"
    rows = queries.op11_lexical_search(spark, sf_dir).collect()
    base = duckdb.connect()
    for t in ("documents", "benchmark"):
        base.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    expected = base.execute(f"SELECT item_id, rank, doc_id, score FROM ({queries.ORACLES['op11_lexical_search']})").fetchall()
    assert sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows) == sorted(expected)


# --- whitening ---------------------------------------------------------------


def vectors(spark, rows, parts=5):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, component string, n int").repartition(parts)


def expected_whitening(x, k):
    n, total = len(x), x.sum(axis=0)
    centred = (n * x - total) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes.T[::-1]
    return ((n * x - total) ** 2).sum(axis=1), centred @ axes[:k].T / np.sqrt(values[:k]), values[:k] / values.sum()


def test_whitening_against_the_covariance(spark):
    rng = np.random.default_rng(4)
    data = (rng.normal(size=(700, 12)) * np.linspace(3, 0.3, 12) + 5).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    bad = [(900, None), (901, [float("nan")] * 12), (902, [float("inf")] + [0.0] * 11), (903, [None] + [0.0] * 11), (904, [1.0] * 3), (905, [])]
    x = np.floor(64 * data.astype(np.float64)).astype(np.int64) + 1_000_000
    deviation, white, explained = expected_whitening(x, 8)
    out, fitted, error = whitening.whiten(vectors(spark, rows + bad, 9), components=8, fan_in=2)
    got = {r["vec_id"]: r for r in out.collect()}
    assert sorted(got) == list(range(700)) and fitted.n == 700 and error < 1e-9
    assert [got[i]["deviation"] for i in range(700)] == deviation.tolist()
    own = np.array([got[i]["whitened"] for i in range(700)])
    assert np.allclose(np.abs(own), np.abs(white), atol=1e-7)
    assert np.allclose(fitted.eigenvalues / fitted.trace, explained, rtol=1e-10)
    assert np.allclose(fitted.axes @ fitted.axes.T, np.eye(8), atol=1e-12)


def test_whitening_error_is_measured(spark):
    rows = spark.createDataFrame([([float(i), 2.0 * (-1) ** i],) for i in range(10)], "whitened array<double>").repartition(4)
    centred = np.array([[i - 4.5, 2.0 * (-1) ** i] for i in range(10)])
    assert whitening.identity_error(rows, fan_in=2) == pytest.approx(np.abs(centred.T @ centred / 10 - np.eye(2)).max())


def test_whitening_of_few_and_flat_rows(spark):
    for rows, n, components in (([], 0, 0), ([(1, None)], 0, 0), ([(1, [1.0, 2.0])], 1, 0), ([(1, [1.0, 2.0]), (1, [1.0, 2.0])], 2, 0), ([(1, [1.0, 2.0]), (None, [2.0, 4.0]), (3, [3.0, 6.0])], 3, 1)):
        out, fitted, _ = whitening.whiten(vectors(spark, rows), components=4)
        got = out.collect()
        assert len(got) == n and all(len(r["whitened"]) == components for r in got)
        assert (fitted.n if fitted else 0) == n


def test_whitening_query_has_a_row_for_each_component(spark, tmp_path):
    rng = np.random.default_rng(1)
    vectors(spark, [(i, rng.normal(size=5).tolist()) for i in range(40)]).write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = queries.op12_embedding_whitening(spark, str(tmp_path)).collect()
    assert len(rows) == 200 and {r["component"] for r in rows} == {1, 2, 3, 4, 5} and {r["n"] for r in rows} == {40}
    assert sum(r["explained"] for r in rows) == pytest.approx(40) and rows[0]["identity_error"] < 1e-9


# --- personal data -----------------------------------------------------------

# The patterns as the contract states them.
STATED = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def plainly(text):
    out = []
    for rank, (kind, pattern) in enumerate(STATED):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            luhn = sum(d if n % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for n, d in enumerate(reversed(digits))) % 10 == 0
            fine = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}[kind]
            if fine:
                out.append((rank, *m.span()))
    return out


def test_patterns_against_plain_search():
    rng = random.Random(9)
    pieces = ["a", "@", ".", "b-c", "%", "+", "1", "255", "256", "0007", " ", "-", "(", ")", "4111 1111 1111 1111", "4111111111111111", "+1 (386) 555-3733", "x@y.z", "10.0.0.1", "é", "\n", "@b.c"]
    hits = Counter()
    for _ in range(6_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 14)))
        assert pii.base_spans(text) == plainly(text), text
        hits.update(k for k, *_ in pii.base_spans(text))
    assert min(hits[k] for k in range(4)) > 100


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "1." * 100_000, "+1" + " (" * 100_000, "a@" * 100_000, "a@b." * 50_000, "1 " * 100_000])
def test_patterns_are_linear(text):
    import time

    start = time.monotonic()
    pii.base_spans(text)
    assert time.monotonic() - start < 3


def told(docs, entity, term, width):
    """PMI over IC by counting documents one by one; and the texts that have both."""
    with_entity = [i for i, (_, t) in enumerate(docs) if entity in {pii.entity(k, t[a:b]) for k, a, b in plainly(t)}]
    with_term = [i for i, (_, t) in enumerate(docs) if term in lowered(t)]
    beside = [i for i, (_, t) in enumerate(docs) if (entity, term) in {c[:2] for c in pii.contexts(t, plainly(t), width)}]
    share = math.log2(len(beside) * len(docs) / (len(with_entity) * len(with_term))) / math.log2(len(docs) / len(with_entity)) if beside else 0
    return share, len({docs[i][1] for i in beside})


def corpus():
    rng = random.Random(3)
    docs = []
    for i in range(200):
        body = words(rng, 30)
        if i % 10 == 0:
            body += f" ask Quillon {i} at quill@site.org or +1 (386) 555-3733 " + words(rng, 12)
        elif i % 25 == 1:
            body += " Quillon's 10.1.2.3 " + words(rng, 20)
        docs.append((i, body))
    return docs + [(500 + i, docs[10][1]) for i in range(40)]


def test_terms_that_disclose(spark):
    docs = corpus()
    rows = {r["doc_id"]: r for r in pii.find_personal_data(frame(spark, docs), context=4).collect()}
    assert len(rows) == len(docs)
    added = 0
    for i, text in docs:
        base = plainly(text)
        expected = {}
        for name, term, a, b in pii.contexts(text, base, 4):
            share, texts = told(docs, name, term, 4)
            if share >= pii.DISCLOSURE and texts >= pii.SUPPORT:
                expected[a, b] = max(share, expected.get((a, b), 0))
        got = [(s["rank"], s["start"], s["stop"], s["removed"]) for s in rows[i]["spans"]]
        assert got == [(*s, True) for s in base] + [(4, a, b, share >= pii.REMOVAL) for (a, b), share in sorted(expected.items())]
        assert [(s["rank"], s["start"], s["stop"]) for s in rows[i]["base"]] == base
        added += len(expected)
        assert base or not expected
    assert added > 20
    assert "quillon" in {lowered(docs[10][1][s["start"] : s["stop"]])[0] for s in rows[10]["spans"] if s["rank"] == 4}


def test_sanitise(spark):
    docs = corpus() + [(900, None), (901, "")]
    out = {r["doc_id"]: r for r in pii.sanitise(frame(spark, docs), context=4).collect()}
    assert out[900]["text"] is None and out[901]["text"] == "" and out[3]["text"] == docs[3][1]
    assert set(out[3].asDict()) == set(DOCS.replace(" long", "").replace(" string", "").split(", "))
    text = out[10]["text"]
    assert "[EMAIL]" in text and "[PHONE]" in text and "Quillon" not in text and "quill@" not in text
    assert out[10]["n_spans"] >= 3 and out[3]["n_spans"] == 0 and out[3]["spans"] == "d"


def test_replaced():
    assert pii.replaced("ask Ann 12 low a@b.c.", [(4, 4, 7, False), (4, 8, 10, False), (4, 11, 14, False), (0, 15, 20, True)]) == "ask [NAME] [NUMBER] [WORD] [EMAIL]."
    assert pii.replaced("abcdef", [(1, 1, 4, True), (2, 2, 5, True)]) == "a[IP]f"


def test_personal_data_edges(spark):
    rows = [(1, None), (2, ""), (None, "x@y.z"), (3, "x@y.z"), (3, "x@y.z"), (4, "é𝔘 x@y.z"), (5, words(random.Random(1), 30_000) + " 10.0.0.1")]
    got = pii.find_personal_data(frame(spark, rows)).collect()
    spans = sorted((r["doc_id"] or 0, [(s["rank"], s["start"], s["stop"]) for s in r["base"]]) for r in got)
    assert spans == sorted((i or 0, plainly(t or "")) for i, t in rows) and (4, [(0, 3, 8)]) in spans
    assert pii.find_personal_data(frame(spark, [])).count() == 0 and pii.sanitise(frame(spark, [])).count() == 0


def test_personal_data_query(spark, tmp_path):
    docs = [(1, "a@b.c 1.2.3.4 a@b.c"), (2, None), (3, "4111111111111111 +1 (386) 555-3733")]
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in queries.op13_personal_data(spark, str(tmp_path)).collect()}
    for i, text in docs:
        base = ",".join(f"{STATED[k][0]}:{a}:{b}" for k, a, b in plainly(text or ""))
        assert rows[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and rows[i]["spans"] == base
        assert [rows[i][f"n_{k}"] for k, _ in STATED] == [sum(x[0] == n for x in plainly(text or "")) for n in range(4)]
