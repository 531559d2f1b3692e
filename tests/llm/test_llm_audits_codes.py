"""Filter audit, language identification and vector codes against brute force, over awkward rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from runlens.llm import filter_audit, language_id, vector_codes

SPACE = " \t\n\x0b\x0c\r"


def split(text):
    for c in SPACE[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


# filter audit


@pytest.fixture(scope="module")
def audited():
    rng = random.Random(3)
    say = lambda n, words=900: " ".join(f"w{rng.randrange(words)}" for _ in range(n))
    long = say(150)
    texts = [None, "", " \t\n", "A B C", "ABC " * 40 + long, long, long, long + " $", say(400, 30), say(99), say(100), "é x " * 120, "word|" * 3, "x" * 1_200_000, "Word " * 250_000, say(120, 4000).upper()]
    rows = [(k, t, [None, "en", "", "de"][k % 4]) for k, t in enumerate(texts)]
    rows += [(k, texts[k % len(texts)], rng.choice(["en", "de", None])) for k in range(100, 160)]
    rows += [(5, long, "en"), (5, long, "de"), (5, "other text", "en"), (None, long, "en"), (None, long, "en"), (None, None, "xx")]
    rng.shuffle(rows)
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 130)] + [(5, 1, 0), (5, 0, 1), (None, 1, 1), (7777, 1, 1)]
    return rows, labels


def audit_by_hand(rows, labels):
    """Every order applied to every row."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    rank = lambda i: (1 << 63) - 1 if i is None else i
    first = {}
    for i, t, _ in rows:
        first[t or ""] = min(first.get(t or "", 1 << 64), rank(i))
    fails = []
    for i, t, lang in rows:
        t = t or ""
        words = split(t)
        fails.append((lang or "", i, {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": first[t] < rank(i),
        }))
    out = {}
    for part in {p for p, _, _ in fails}:
        own, total = [(i, f) for p, i, f in fails if p == part], Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone, kept = [r for r in left if r[1][x]], [r for r in left if not r[1][x]]
                total[x] += len(gone)
                out[part, "".join(order), step] = [
                    len(kept), len(gone), sum(f[x] for _, f in own) - len(gone), sum(f[x] and sum(f.values()) == 1 for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                ]
                left = kept
        for order in permutations("ABCDE"):
            for step, x in enumerate(order, 1):
                out[part, "".join(order), step].append(total[x])
    return out


def test_filter_audit(spark, audited):
    rows, labels = audited
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "doc_id long, text string, lang string, part string, digest string, n long").repartition(5)
    marks = spark.createDataFrame([(*r, "z") for r in labels], "doc_id long, quality int, toxic int, rank string")
    found = filter_audit.audit(docs, marks)
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r["part"], r["filter_order"], r["step"]): list(r[3:]) for r in found.collect()} == audit_by_hand(rows, labels)
    assert filter_audit.audit(docs.limit(0), marks).collect() == []
    none = filter_audit.audit(docs, marks.limit(0)).agg({"good_lost": "sum", "removed": "sum"}).first()
    assert none["sum(good_lost)"] == 0 and none["sum(removed)"] > 0


def test_interactions_of_any_number_of_filters(spark):
    """Three filters over given flags."""
    rows = [("p", a, b, c, 1 + a + 2 * b, a, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    frame = spark.createDataFrame(rows, "part string, X long, Y long, Z long, n long, good long, toxic long")
    found = filter_audit.interactions(filter_audit.joint_failures(frame, "XYZ"), "XYZ").collect()
    assert len(found) == 18
    for r in found:
        before, at = r["filter_order"][: r["step"] - 1], "XYZ".index(r["filter_order"][r["step"] - 1])
        left = [x for x in rows if not any(x[1 + "XYZ".index(f)] for f in before)]
        assert r["removed"] == sum(x[4] for x in left if x[1 + at]) and r["kept"] == sum(x[4] for x in left if not x[1 + at])


# language identification


def all_segmentations(word, probabilities, known):
    """Sum over every way to cut the marked word, and the pieces' expected counts."""
    total, counts = 0.0, defaultdict(float)

    def cut(rest, product, used):
        nonlocal total
        if not rest:
            total += product
            for p in used:
                counts[p] += product
            return
        for k in range(1, len(rest) + 1):
            piece = rest[:k] if rest[:k] in known else "" if k == 1 else None
            if piece is not None:
                cut(rest[k:], product * probabilities[piece], [*used, piece])

    cut(language_id.MARK + word, 1.0, [])
    return total, {p: c / total for p, c in counts.items()}


def test_forward_sums_all_segmentations():
    rng = random.Random(9)
    pieces = sorted({language_id.MARK, language_id.MARK + "a", language_id.MARK + "ab", "a", "b", "ab", "ba", "abc", "cab", "aé", "é", "bcab"})
    trie = language_id.Trie(pieces)
    probabilities = [{p: rng.random() for p in ["", *pieces]} for _ in range(3)]
    logs = np.log([[p[x] for p in probabilities] for x in trie.pieces])
    words = ["a", "c", "日", "abc", "abcab", "cabcabé", "b" * 12, "éa日ab", "ab" * 6] + ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 10))) for _ in range(200)]
    found = np.exp(language_id.word_logs(trie, words, logs))
    for w, row in zip(words, found):
        assert row == pytest.approx([all_segmentations(w, p, set(pieces))[0] for p in probabilities])
    times = np.array([rng.randrange(1, 5) for _ in words])
    counts = language_id.expected(trie, words, times, logs[:, 0]) / language_id.GRAIN
    want = Counter()
    for w, n in zip(words, times):
        want.update({p: n * c for p, c in all_segmentations(w, probabilities[0], set(pieces))[1].items()})
    assert counts == pytest.approx([want[p] for p in trie.pieces], abs=0.1)


def test_language_id(spark):
    rng = random.Random(4)
    stems = {"en": ["the", "ing", "wh", "ough", "and", "th"], "de": ["sch", "ung", "der", "ö", "ich", "tz"], "fr": ["eau", "tion", "les", "é", "oi", "ç"]}
    say = lambda lang, n: " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(k, say(lang, rng.choice([3, 30, 200])), lang) for k, lang in enumerate(rng.choices(list(stems), k=400))]
    rows += [(900, None, "en"), (901, "", "de"), (902, "12 + ½ ²³ --", "fr"), (903, say("de", 60_000), "de"), (904, "öschung" * 3_000, "de"), (905, say("fr", 50), None), (None, say("en", 50), "xx"), (907, "...", "punct"), (7, say("de", 20), "de"), (7, say("de", 20), "de"), (906, "日本 語", None)]
    docs = spark.createDataFrame([(*r, "s", 0.5) for r in rows], "doc_id long, text string, lang string, source string, score double").repartition(4)
    model = language_id.learn(docs)
    assert model.languages == ["de", "en", "fr"]
    found = language_id.identify(docs, model).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in found)
    by_id = {r["doc_id"]: r for r in found}
    tested = [(by_id[i]["lang_pred"], lang) for i, _, lang in rows[:400] if held(i) and i != 7]
    assert len(tested) > 50 and sum(a == b for a, b in tested) >= 0.97 * len(tested)
    assert [by_id[i]["lang_pred"] for i in (900, 901, 902, 903, 904, 905, 907)] == ["und", "und", "und", "de", "de", "fr", "und"]
    assert by_id[906]["lang_pred"] in model.languages and by_id[900]["score"] == 0
    # the model doesn't depend on how rows are dealt
    again = language_id.learn(docs.repartition(3, "doc_id"))
    assert np.array_equal(again.logs, model.logs)
    assert language_id.identify(docs.limit(0), model).collect() == []
    nothing = language_id.learn(docs.limit(0))
    assert {(r["lang_pred"], r["score"]) for r in language_id.identify(docs, nothing).collect()} == {("und", 0.0)}


# vector codes


def codes_by_hand(rows, parts=4, entries=256, rounds=4):
    kept = [(i, label, [math.floor(1024 * x) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, _, v in kept), default=0) // parts)
    kept = [(i, label, v + [0] * (parts * width - len(v))) for i, label, v in kept]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[cut(v, p) for _, _, v in first] for p in range(parts)]
    nearest = lambda z, p: min((sum((a - b) ** 2 for a, b in zip(z, q)), e) for e, q in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for _, _, v in kept:
                own[nearest(cut(v, p), p)[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(c) for c in zip(*own[e])] if e in own else q for e, q in enumerate(books[p])]
    out, by_label = [], Counter()
    for i, label, v in kept:
        found = [nearest(cut(v, p), p) for p in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
        by_label[label] += out[-1][3]
    digest = hashlib.sha256(",".join(str(x) for b in books for q in b for x in q).encode()).hexdigest()
    return sorted(((i, c, e, by_label[label]) for i, label, c, e in out), key=repr), digest


def vectors(n, dims, seed):
    rng = random.Random(seed)
    base = [[rng.gauss(0, 0.2) for _ in range(dims)] for _ in range(n)]
    rows = [(k * 3, v, rng.choice([1, 2, None])) for k, v in enumerate(base)]
    rows += [(5000 + k, base[0], 1) for k in range(n // 2)]  # a group of copies
    rows += [(0, base[1], 7), (0, base[1], 7), (None, base[2], None), (6000, None, 1), (6001, [None, *base[0][1:]], 1), (6002, [float("nan"), *base[0][1:]], 1), (6003, [float("-inf"), *base[0][1:]], 2), (6004, [], 3), (6005, base[3][:-3], 3)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("n, dims", [(400, 8), (40, 6), (300, 16)])
def test_vector_codes(spark, n, dims):
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in vectors(n, dims, n)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, cells string, error long").repartition(3)
    coded, books = vector_codes.compress(frame)
    want, digest = codes_by_hand(rows)
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in coded.collect()), key=repr) == want
    assert vector_codes.codebook_digest(books) == digest


def test_vector_codes_of_nothing(spark):
    empty = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    assert vector_codes.compress(empty)[0].collect() == []
    assert vector_codes.compress(empty.limit(0))[0].collect() == []


def test_tree_keeps_lower_of_equal_entries():
    rng = np.random.Generator(np.random.PCG64(1))
    for scale in (3, 1 << 25):
        entries = rng.integers(-scale, scale, (256, 4))
        entries[100:200] = entries[rng.integers(0, 100, 100)]
        points = np.concatenate([rng.integers(-scale, scale, (3000, 4)), entries])
        d = ((points[:, None, :] - entries[None]) ** 2).sum(2)
        found, at = vector_codes.Tree(entries).nearest(points)
        assert np.array_equal(found, d.min(1)) and np.array_equal(at, d.argmin(1))


def test_rare_labels_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "HOT_SHARE", 4)
    rows = [(k, None if k % 3 == 0 else 7 if k % 3 == 1 else k, "00", k) for k in range(90)]
    found = vector_codes.with_label_errors(spark.createDataFrame(rows, "vec_id long, label long, code string, error long"), len(rows)).collect()
    sums = Counter()
    for _, label, _, e in rows:
        sums[label] += e
    assert sorted((r["vec_id"], r["label_error"]) for r in found) == [(k, sums[label]) for k, label, _, _ in rows]
