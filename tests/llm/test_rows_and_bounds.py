"""Rows that share or lack ids, results that don't depend on bounds, and the pipeline's stages."""

from __future__ import annotations

import random
import time
from collections import Counter

import numpy as np
import pytest

from strandscope.llm import decontaminate, langid, line_dedup, packing, secrets, sharding, tokens, workspace

from .test_llm_operators import DOCS, EDGE, frame, prose, vocabulary  # noqa: F401


def texts_of(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_lines_go_only_from_the_row_that_repeats_them(spark):
    window, own = "a\nb\nc", "keep1\nkeep2\nkeep3\nkeep4"
    rows = [(1, window), (2, f"{window}\nrest"), (2, own), (2, own), (None, f"{window}\nnull"), (None, "u\nv\nw\nx"), (None, None)]
    want = Counter([(1, ""), (2, "rest"), (2, own), (2, own), (None, f"{window}\nnull"), (None, "u\nv\nw\nx"), (None, None)])
    assert texts_of(line_dedup.dedup_lines(frame(spark, rows))) == want


def test_spans_belong_to_their_row(spark):
    rng = random.Random(2)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(48))
    rows = [(1, "nothing at all"), (1, f"see {key}"), (None, f"a {key}"), (None, "nothing")]
    got = Counter((r["doc_id"], tuple((s["start"], s["stop"]) for s in r["spans"])) for r in secrets.scan_secrets(frame(spark, rows)).collect())
    assert got == Counter({(1, ()): 1, (1, ((4, 52),)): 1, (None, ((2, 50),)): 1, (None, ()): 1})


def test_uniformity_is_against_the_tokens_alphabet(spark):
    rng = random.Random(4)
    draw = lambda symbols: "".join(rng.choice(symbols) for _ in range(60))
    cases = [(name, draw(symbols)) for name, symbols in secrets.ALPHABETS.items() for _ in range(20)] + [("skewed", draw("ABCDabcd+")) for _ in range(20)]
    out = secrets.randomness(spark.createDataFrame(cases, "case string, token string")).collect()
    share = lambda name: sum(r["p_uniform"] >= 0.001 for r in out if r["case"] == name) / 20
    assert all(share(name) >= 0.9 for name in secrets.ALPHABETS) and share("skewed") == 0
    assert {r["encoding"] for r in out if r["case"] == "hex"} == {"hex"}
    evidence = {name: np.median([r["evidence_p"] for r in out if r["case"] == name]) for name in ("hex", "base64", "skewed")}
    assert evidence["hex"] < 1e-4 and evidence["base64"] < 1e-4 and evidence["skewed"] == 1


def test_many_matches_are_placed_in_little_time(spark):
    text = " ".join(f"deadbeefdeadbeef{i:05x} x" for i in range(20_000))
    began = time.time()
    r = secrets.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert time.time() - began < 60
    assert len(r["base"]) == 20_000 and all(text[s["start"] : s["stop"]] == s["value"] for s in r["base"][::501])


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_results_do_not_depend_on_blocks(spark, block):
    bench = [(i, f"{prose(i, 10 + 9 * (i % 14))}. {prose(900 + i, 9)}.") for i in range(30)] + [(77, None), (78, "")]
    rows = [(100 + i, f"{prose(6000 + i, 177 + i)} {bench[i][1].upper()} {prose(7000 + i, 150)}") for i in range(30)] + EDGE
    out = decontaminate.contaminated(frame(spark, rows), spark.createDataFrame(bench, "item_id long, text string"), block_items=block).collect()
    assert {(r["doc_id"], r["item_id"]) for r in out} == {(100 + i, i) for i in range(30)}
    whole = decontaminate.contaminated(frame(spark, rows), spark.createDataFrame(bench[::-1], "item_id long, text string")).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, whole))


def test_shards_of_any_ids_are_ranges_that_divide_no_small_group(spark):
    rng = random.Random(1)
    rows = [(rng.choice([-(1 << 63), (1 << 63) - 1, 0, rng.getrandbits(62), -rng.getrandbits(62)]), prose(i % 150, 30 + i % 9)) for i in range(600)]
    out = sharding.shard_documents(frame(spark, rows), 6).collect()
    assert len(out) == len(rows)
    total = sum(r["size"] for r in out)
    groups = Counter()
    for r in out:
        groups[r["text"]] += r["size"]
    for s in range(6):
        own = [r for r in out if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 6) <= 2 * max(groups.values())
    single = [t for t, n in Counter(t for _, t in rows).items() if n == 1]
    shards = {}
    for r in out:
        shards.setdefault(r["text"], set()).add(r["shard"])
    assert all(len(shards[t]) == 1 for t in single)
    # a group that weighs no more than the largest document stays whole
    rows = [(i, prose(i, 400)) for i in range(12)] + [(100 + i, f"same {i % 40}") for i in range(400)]
    out = sharding.shard_documents(frame(spark, rows), 8).collect()
    assert all(len({r["shard"] for r in out if r["text"] == f"same {k}"}) == 1 for k in range(40))


def test_only_letters_are_letters(spark):
    net = langid.fit([b"hello there", b"guten tag"], ["en", "de"])
    rows = [(1, "½ ² Ⅷ 12 _"), (2, "½ x"), (3, None), (4, "")]
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(frame(spark, rows), net).collect()}
    assert out[1] == out[3] == out[4] == ("und", 0.0) and out[2][0] in ("en", "de")


def test_the_program_places_most_pieces_and_meets_its_bound():
    rng = np.random.default_rng(3)
    for draw, share in ((rng.lognormal(5.5, 0.9, 1000), 0.5), (rng.lognormal(5.5, 0.9, 20_000), 0.9), (rng.integers(500, 1500, 3000), 0.75)):
        lengths = np.clip(draw.astype(int), 1, 2047)
        counts = np.bincount(lengths, minlength=2049)
        used, rest, bound = packing._rounded(counts, 2048)
        pieces = sum(len(c) * n for c, n in used.items())
        assert pieces > share * len(lengths)
        fewest = sum(packing.pack_histogram(counts, 2048).values())
        assert bound <= fewest <= sum(packing.best_fit(counts, 2048).values())
        assert lengths.sum() / 2048 <= bound + 1 and fewest <= 1.02 * bound + 1


def test_ids_are_those_of_tokenizers_on_any_text(vocabulary):  # noqa: F811
    from tokenizers import Tokenizer

    rng = random.Random(21)
    marks = [" ", " ", " ", "  ", "\n", "\t", "\xa0", "　", "\x85", " ", "<|endoftext|>", "<|endoftext", "é", "ß", "日本", "½", "can't", "I'll", "...", "Word", "word", "x1", "12", "🙂", "_", "'s", "\r\n", "\x00"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 9))) for _ in range(100_000)]
    texts += ["a  b c", "New  York City is", "x\u0085y  z", "hello　world  ok", "<|endoftext|>", " a<|endoftext|> b"]
    tokenizer, encoder = Tokenizer.from_file(vocabulary), tokens.ByteLevelEncoder(vocabulary)
    got = encoder.encode(texts)
    for text, ids, want in zip(texts, got, tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, text


def test_a_cluster_needs_a_shared_folder():
    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            master = "local-cluster[3,2,1024]"
            getConf = staticmethod(lambda: {})  # noqa: N815

            class _jsc:  # noqa: N801
                sc = staticmethod(lambda: type("C", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))

    with pytest.raises(RuntimeError, match="checkpoint"):
        workspace.checkpoint_root(Cluster)


# --- the pipeline ------------------------------------------------------------

PLAIN = "doc_id long, text string, severity string, n_removed string, n_chars int"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    toxic = [(i, prose(i, 40) + (" you utter scum" if i % 5 == 0 else "")) for i in range(120)]
    window = "\n".join(prose(700 + k, 8) for k in range(3))
    near = prose(901, 60).split()
    item = f"{prose(950, 25)}. {prose(951, 9)}."
    rows = toxic + [(201, f"{window}\n{prose(41, 9)}"), (202, f"{window}\n{prose(42, 9)}"), (203, window)]
    rows += [(301, " ".join(near)), (302, " ".join([*near[:-1], "other"])), (302, prose(43, 30)), (302, prose(43, 30))]
    rows += [(401, f"{prose(44, 70)} {item} {prose(45, 40)}"), (402, f"{item} {prose(46, 40)}"), (402, prose(47, 60)), *EDGE]
    docs = spark.createDataFrame([(i, t, f"s{n}", f"r{n}", None if t is None else len(t)) for n, (i, t) in enumerate(rows)], PLAIN)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(100)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_keep_their_columns_and_clean_documents(spark, tables):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    before = docs.collect()
    stage = dict(pipeline.STAGES)

    def through(name):
        out = stage[name](spark, docs, tables)
        assert out.columns == docs.columns
        return out.collect()

    clean = through("toxicity")
    gone = Counter(before) - Counter(clean)
    assert {r["doc_id"] for r in gone} == set(range(0, 120, 5))
    lines = {(r["doc_id"], r["severity"]): r for r in through("line_dedup")}
    assert len(lines) >= len(before) - 4 and all(r["n_removed"].startswith("r") for r in lines.values())
    assert [r for (i, _), r in lines.items() if i == 203] == [] and [r["text"] for (i, _), r in lines.items() if i == 202] == [prose(42, 9)]
    assert all(r["n_chars"] == len(r["text"]) for r in lines.values() if r["text"] is not None)
    near = Counter((r["doc_id"], r["text"]) for r in through("near_dedup"))
    assert near[(302, prose(43, 30))] == 1 and not any(i == 302 and "other" in (t or "") for i, t in near) and near[(1, None)] == near[(8, None)] == 1
    assert Counter(before) - Counter(through("decontamination")) == Counter(r for r in before if r["doc_id"] == 401 or (r["doc_id"] == 402 and r["text"] != prose(47, 60)))


def test_pipeline_end_to_end_and_on_nothing(spark, tables, tmp_path):
    import corpus_pipeline as pipeline

    out = pipeline.run(spark, tables).collect()
    ids = {r["doc_id"] for r in out}
    assert not ids & {*range(0, 120, 5), 203, 401} and {1, 201, 202, 301, 302, 402} <= ids
    assert sum(r["doc_id"] == 302 for r in out) == 1
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
