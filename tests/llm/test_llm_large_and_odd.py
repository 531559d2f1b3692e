"""Texts of a megabyte and more, clashing names, many repeated rows, and packing by brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from runlens.llm import decontaminate, jaccard_join, line_dedup, packing, quality_classifier, quality_rules, substring_dedup, suffix_dedup

draw = random.Random(17)
NAMES = "score string, held_out string, predicted string, n_hit string, items string, win string, words string, hits string, item_ids string, kept string"
ITEM = " ".join(f"item{j}" for j in range(14))


def lines(n):
    return "\n".join(" ".join(f"w{draw.randrange(50_000)}" for _ in range(10)) for _ in range(n))


@pytest.fixture(scope="module")
def large(spark):
    """Two near copies of 1.3 MB, one word of 1.5 MB, and one text of 100,000 equal words, between small ones."""
    body = lines(20_000)
    changed = body.replace(" w7 ", " other ", 3) + "\n" + ITEM + "\nlast line of the text"
    rows = [(1, body), (2, changed), (3, "é" * 750_000), (4, "again " * 100_000), (5, "a small text of a few words"), (6, None), (7, body[:3000])]
    return rows, spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string").repartition(3)


def test_large_texts_repeated_bytes(large):
    rows, docs = large
    first: dict = {}
    raw = {i: (t or "").encode() for i, t in rows}
    for i, r in raw.items():
        for k in range(len(r) - 49):
            first.setdefault(hashlib.blake2b(r[k : k + 50], digest_size=8).digest(), i)
    want = {}
    for i, r in raw.items():
        gone = np.zeros(len(r) + 1, np.int64)
        for k in range(len(r) - 49):
            if first[hashlib.blake2b(r[k : k + 50], digest_size=8).digest()] < i:
                gone[k] += 1
                gone[k + 50 if k + 50 < len(gone) else -1] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        want[i] = (len(r), int(gone.sum()), hashlib.sha256(bytes(np.frombuffer(r, np.uint8)[~gone])).hexdigest())
    found = suffix_dedup.dedup_substrings(docs).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in found} == want


def test_large_texts_repeated_words(large):
    rows, docs = large
    split = {i: (t or "").encode().split() for i, t in rows}
    count = Counter(hash(tuple(w[k : k + 35])) for w in split.values() for k in range(len(w) - 34))
    want = {}
    for i, w in split.items():
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if count[hash(tuple(w[k : k + 35]))] > 1:
                gone[k : k + 35] = [True] * 35
        want[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.dedup_substrings(docs).collect()} == want


def test_large_texts_lines_and_rules(large):
    rows, docs = large
    first: dict = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            first.setdefault(x.lower().strip(), i)
    kept = {i: "\n".join(x for x in (t or "").split("\n") if len(x.strip()) < 10 or first[x.lower().strip()] == i) for i, t in rows}
    assert {r["doc_id"]: r["kept_text"] for r in line_dedup.dedup_lines(docs).collect()} == kept
    found = {r["doc_id"]: r for r in quality_rules.apply_rules(docs).collect()}
    for i, t in rows:
        words = (t or "").split()
        assert (found[i]["n_words"], found[i]["word_chars"]) == (len(words), sum(map(len, words)))
    assert found[4]["n_repeat_words"] == 100_000 and found[4]["base_failed"] and not found[1]["base_failed"] and found[3]["base_failed"]


def test_large_texts_benchmark_and_copies(spark, large):
    rows, docs = large
    items = spark.createDataFrame([(1, ITEM), (2, "nowhere to be found at all in any of these many texts")], "item_id long, text string")
    found = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, items).collect()}
    assert {i: (r["n_words"], r["n_hit"], r["contaminated"]) for i, r in found.items()} == {i: (len((t or "").split()), 14 if i == 2 else 0, i == 2) for i, t in rows}
    linked = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join_components(docs).collect()}
    sizes = {i: len({tuple(w[k : k + 4]) for w in [(t or "").lower().split()] for k in range(max(1, len(w) - 3)) if w}) for i, t in rows}
    assert linked == {i: (n, 1 if i == 2 else i) for i, n in sizes.items()}


def test_clashing_names(spark):
    texts = [(k, ("good words in a row " * 20 if k % 2 else "### $$$ BUY!! " * 20) + (ITEM if k == 3 else "")) for k in range(60)]
    docs = spark.createDataFrame([(*r, *(["x"] * 10)) for r in texts], "doc_id long, text string, " + NAMES)
    labels = spark.createDataFrame([(k, k % 2, 0, "y") for k in range(60)], "doc_id long, quality int, toxic int, text string")
    scored = quality_classifier.score(docs, quality_classifier.fit_sample(docs, labels))
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
    assert {r["doc_id"]: r["predicted"] for r in scored.collect()} == {k: k % 2 for k in range(60)}
    items = spark.createDataFrame([(1, ITEM, "z", "z")], "item_id long, text string, doc_id string, words string")
    assert [r["doc_id"] for r in decontaminate.decontaminate(docs, items).collect() if r["contaminated"]] == [3]


@pytest.fixture(scope="module")
def repeated(spark):
    """Four hundred times one row, others with its text, and a few that differ."""
    text = " ".join(f"r{j}" for j in range(200))
    rows = [(7, text)] * 400 + [(k, text) for k in range(20, 40)] + [(3, text + " end"), (50, "of its own " * 3), (7, "another text under the same id")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def test_many_repeated_rows(repeated):
    rows, docs = repeated
    found = Counter((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup.dedup_substrings(docs).collect())
    size = len(rows[0][1])
    assert found == Counter({(7, size, size): 400, (3, size + 4, 0): 1, (50, 33, 0): 1, (7, 30, 0): 1} | {(k, size, size): 1 for k in range(20, 40)})
    found = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.dedup_substrings(docs).collect())
    assert found == Counter({(7, 200, 200): 400, (3, 201, 200): 1, (50, 9, 0): 1, (7, 6, 0): 1} | {(k, 200, 200): 1 for k in range(20, 40)})


def check_cover(pieces, rows):
    """Every id of every row lies in exactly one piece, and pieces hold what they say."""
    encode = packing.encoder(packing.vocabulary_path("byte_bpe_50k.json"))
    whole = defaultdict(list)
    for i, t in rows:
        ids = np.r_[encode(t or ""), packing.SEPARATOR].astype("<u4")
        whole[i, len(ids)].append(ids)
    covered = {key: np.zeros(key[1] + 1, np.int64) for key in whole}
    for r in pieces:
        key, a, b = (r["doc_id"], r["doc_tokens"]), r["start"], r["start"] + r["length"]
        assert r["length"] > 0 and b <= key[1] and r["ids_crc32"] in {zlib.crc32(ids[a:b].tobytes()) for ids in whole[key]}
        covered[key][a] += 1
        covered[key][b] -= 1
    for key, marks in covered.items():
        assert (np.cumsum(marks[:-1]) == len(whole[key])).all()
    filled = defaultdict(list)
    for r in pieces:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in filled.values():
        held.sort()
        assert [a for a, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))] and sum(n for _, n in held) <= 1024


def test_packing_covers_every_id_once(spark, repeated, large):
    rows, docs = repeated
    check_cover(packing.pack(docs).collect(), rows)
    rows, docs = large
    check_cover(packing.pack(docs).collect(), rows)


def test_packing_stage_covers_every_id_once(spark, sf_dir):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check_cover(pipeline.STAGES[-1][1](spark, docs, sf_dir).collect(), [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_neighbours_are_in_the_order_of_bm25():
    """Against scores computed text by text from the formula."""
    rng = np.random.Generator(np.random.PCG64(2))
    texts = [rng.integers(0, 60, rng.integers(5, 80)) for _ in range(40)]
    idf = rng.random(packing.VOCABULARY).astype(np.float32) + 0.1
    size = np.array([len(t) for t in texts], np.float64)
    counts = [tuple(np.unique(t, return_counts=True)) for t in texts]
    index = packing.Index(counts, size, idf, float(size.mean()))
    used = rng.random(40) < 0.3
    for seed in range(40):
        score = {}
        for k, t in enumerate(texts):
            tf = Counter(t.tolist())
            score[k] = sum(float(idf[x]) * tf[x] * (packing.K1 + 1) / (tf[x] + packing.K1 * (1 - packing.B + packing.B * len(t) / size.mean())) for x in set(texts[seed].tolist()) if x in tf)
        found = index.neighbours(seed, used).tolist()
        assert sorted(found) == [k for k in range(40) if not used[k]]
        assert [score[k] for k in found] == pytest.approx(sorted((score[k] for k in found), reverse=True))
