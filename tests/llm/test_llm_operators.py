"""Each operator against a brute-force version, over plain and awkward rows."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from runlens.llm import chat_format, decontaminate, jaccard_join, line_dedup, packing, quality_classifier, quality_rules, repeats, substring_dedup, suffix_dedup, warc_index

rng = random.Random(5)
VOCABULARY = ["the", "of", "and", "Is", "é", "ÉCOLE", "naïve", "x1", "longerword", "日本語", "a b", "***", "|", "ß"]


def words(n, letters=VOCABULARY):
    return " ".join(rng.choice(letters) + (str(rng.randrange(40)) if rng.random() < 0.6 else "") for _ in range(n))


def texts():
    passage, base = words(60), words(120)
    lines = ["A common line, of some length", "  a COMMON line, of some length\t", "short", "another shared line here É", ""]
    near = base.split(" ")
    near[7] = "changed"
    return [
        None, "", " ", "\n\n", "one", "two words", "one", base, base, " ".join(near), " ".join(near[1:]), passage, "head " + passage + " tail",
        passage + "\n" + passage, "a" * 400, "ab " * 300, "the " * 200, words(3000), "\n".join(lines), "\n".join([*lines, *lines]), "\n".join([lines[0], "mine alone, this one"]),
        words(40) + "\n" + lines[3], "x\x00y \x1c z " * 20, words(80).upper(), base.replace(" ", "  "), "tail " + base, words(5) + " " + " ".join(near[40:]),
    ]


@pytest.fixture(scope="module")
def rows():
    out = [(k, t) for k, t in enumerate(texts())]
    out += [(7, out[7][1]), (3, "another text under a used id " + words(60)), (None, out[7][1]), (None, None), (None, out[12][1])]
    out += [(100 + k, words(70) + " " + texts()[12]) for k in range(6)]
    rng.shuffle(out)
    return out


CLASHING = "hash string, pos string, text_key string, n_lines string, block string, n string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    schema = f"doc_id long, text string, {CLASHING}"
    return spark.createDataFrame([(i, t, "h", "p", "k", "l", "b", "n", None, None if i == 4 else f"s{(i or 0) % 2}", len(t or "")) for i, t in rows], schema).repartition(3)


@pytest.fixture(scope="module")
def none(spark, docs):
    return spark.createDataFrame([], docs.schema)


def by_row(found, *fields):
    return sorted((tuple(r[f] for f in fields) for r in found.collect()), key=repr)


def sha(raw):
    return hashlib.sha256(raw if isinstance(raw, bytes) else raw.encode()).hexdigest()


def test_suffix_dedup(docs, rows, none):
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - 49):
            held = first.get(raw[k : k + 50])
            mine = (1 << 63) - 1 if i is None else i
            first[raw[k : k + 50]] = mine if held is None else min(held, mine)
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 49):
            if first[raw[k : k + 50]] < ((1 << 63) - 1 if i is None else i):
                gone[k : k + 50] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()) if len(raw) else 0
        want.append((i, len(raw), int(gone.sum()), spans, bytes(np.frombuffer(raw, np.uint8)[~gone])))
    found = suffix_dedup.dedup_substrings(docs)
    assert by_row(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept") == sorted(((*w[:4], bytearray(w[4])) for w in want), key=repr)
    assert suffix_dedup.dedup_substrings(none).collect() == []


def test_suffix_dedup_in_parts_of_ranges(docs, monkeypatch):
    """Fewer ranges than buckets: each is dealt to several by the gram's hash."""
    fields = ("doc_id", "n_removed", "n_spans", "kept")
    want = by_row(suffix_dedup.dedup_substrings(docs), *fields)
    monkeypatch.setattr(suffix_dedup, "MOST_RANGES", 2)
    assert by_row(suffix_dedup.dedup_substrings(docs), *fields) == want


def test_multikey_sort_orders_by_tokens():
    data = np.array([[rng.randrange(3) for _ in range(4)] for _ in range(500)], np.uint64)
    order, label = suffix_dedup.multikey_sort(lambda k, items: data[items, k], len(data), 4)
    ranked = [tuple(data[i]) for i in order]
    assert ranked == sorted(map(tuple, data))
    assert [ranked.index(r) for r in ranked] == label.tolist()


def test_multikey_sort_from_labels():
    data = np.array([[rng.randrange(4) for _ in range(3)] for _ in range(300)], np.uint64)
    labels = np.repeat([0, 100, 101, 102], [100, 1, 1, 198])
    order, label = suffix_dedup.multikey_sort(lambda k, items: data[items, k], len(data), 3, labels)
    ranked = [(labels[i], *data[i].tolist()) for i in order]
    assert ranked == sorted((a, *d) for a, d in zip(labels, data.tolist()))
    assert [ranked.index(r) for r in ranked] == label.tolist()


@pytest.mark.parametrize("operator", [suffix_dedup, substring_dedup])
def test_common_grams_change_no_result(docs, monkeypatch, operator):
    want = [tuple(r) for r in operator.dedup_substrings(docs).collect()]
    for part in (1, 2):  # all grams are common; every other one is
        monkeypatch.setattr(repeats, "common_grams", lambda sampled, n, span: np.unique(sampled)[::part])
        assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in operator.dedup_substrings(docs).collect())


def test_common_phrase_anchors_few_windows():
    """A phrase in ever different text, found everywhere, is the minimiser of no window that spans another gram."""
    phrase, draw = np.arange(1000, 1020), np.random.Generator(np.random.PCG64(1))
    units = np.concatenate([np.r_[draw.integers(1, 1 << 40, 15), phrase] for _ in range(400)]).astype(np.uint64)
    hashes = repeats.gram_hashes(repeats.mixed(units), 6)
    common = repeats.common_grams(repeats.sample_hashes(hashes, 3), 1000, 30)
    assert set(common.tolist()) == set(hashes[15:30].tolist())
    plain, ours = (repeats.find_runs(hashes, np.array([len(units)]), 35, 6, c) for c in (None, common))
    assert np.isin(hashes[plain[2]], common).sum() > 100 and not np.isin(hashes[ours[2]], common).any()
    assert repeats.common_grams(np.empty(0, np.uint64), 4, 30).tolist() == []


def test_substring_dedup(docs, rows, none):
    count, split = Counter(), [(i, (t or "").encode().split()) for i, t in rows]
    for _, w in split:
        count.update(tuple(w[k : k + 35]) for k in range(len(w) - 34))
    want = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        want.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    assert by_row(substring_dedup.dedup_substrings(docs), "doc_id", "n_words", "n_removed", "kept_text") == sorted(want, key=repr)
    assert substring_dedup.dedup_substrings(none).collect() == []


def test_runs_cover_all_windows_once():
    units = np.array([rng.randrange(1, 5) for _ in range(2000)], np.uint64)
    sizes = np.array([700, 3, 0, 49, 50, 1198])
    hashes = repeats.gram_hashes(units, 8)
    first, last, place = repeats.find_runs(hashes, sizes, 50, 8)
    windows = repeats.flatten_ranges(first, last - first + 1)
    ends = np.cumsum(sizes)
    assert windows.tolist() == [k for a, z in zip(ends - sizes, ends) for k in range(a, z - 49)]
    assert ((place >= first) & (place <= last + 42)).all()


@pytest.mark.parametrize("piece", [1, 7, 64, 1950, 1951])
def test_runs_do_not_depend_on_the_piece(piece):
    """Blocks of more units than a piece are scanned piece by piece, with the same runs."""
    units = np.array([rng.randrange(1, 9) for _ in range(2000)], np.uint64)
    sizes, hashes = np.array([1500, 500]), repeats.gram_hashes(units, 8)
    common = np.unique(hashes[::50])
    for known in (None, common):
        whole, pieces = (repeats.find_runs(hashes, sizes, 50, 8, known, n) for n in (repeats.PIECE, piece))
        assert [x.tolist() for x in whole] == [x.tolist() for x in pieces]


def line_key(line):
    key = line.strip(" \t\n\x0b\x0c\r")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in key)


def last(i):
    return (1 << 63) - 1 if i is None else i


def test_line_dedup(docs, rows, none):
    first = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(line_key(line)) >= 10:
                first[line_key(line)] = min(first.get(line_key(line), last(i)), last(i))
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(line_key(x)) < 10 or first[line_key(x)] == last(i)]
        want.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    found = line_dedup.dedup_lines(docs)
    assert by_row(found, "doc_id", "n_lines", "n_dropped", "kept_text") == sorted(want, key=repr)
    assert "lang" in found.columns and line_dedup.dedup_lines(none).collect() == []


def test_line_dedup_over_64_lines(spark):
    shared = [f"line number {k} of many" for k in range(300)]
    rows = [(1, "\n".join(shared[::3])), (2, "\n".join(shared)), (3, "\n".join(shared))]
    found = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[2]["kept_text"].split("\n") == [s for k, s in enumerate(shared) if k % 3] and found[3]["kept_text"] == "" and found[1]["n_dropped"] == 0


def test_line_dedup_native_plan(docs, capsys):
    line_dedup.dedup_lines(docs).explain()
    assert "Python" not in capsys.readouterr().out.replace("ExistingRDD", "")


def test_quality_rules(docs, rows, none):
    def measures(t):
        w = (t or "").encode().split()
        rep = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        cov = [any(0 <= k - j <= len(w) - 3 and rep[tuple(w[k - j : k - j + 3])] > 1 for j in range(3)) for k in range(len(w))]
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        chars = sum(len(x.decode()) for x in w)
        return len(w), chars, sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), sum(cov)

    limit, holders, norm = 2, defaultdict(set), lambda x: b" ".join(x.translate(quality_rules._NORMAL).encode().split())
    source = lambda i: "" if i == 4 else f"s{(i or 0) % 2}"
    for i, t in rows:
        for line in (t or "").split("\n"):
            if norm(line):
                holders[source(i), norm(line)].add(last(i))
    want = []
    for i, t in rows:
        m = measures(t)
        gone = sum(len(norm(x).split()) for x in (t or "").split("\n") if norm(x) and len(holders[source(i), norm(x)]) > limit and min(holders[source(i), norm(x)]) < last(i))
        failed = m[0] < 50 or 100 * m[4] > 50 * m[0]
        want.append((i, *m, failed, not failed and not m[0] - gone < 0.3 * m[0]))
    found = quality_rules.apply_rules(docs, max_line_docs=limit)
    assert by_row(found, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept") == sorted(want, key=repr)
    assert quality_rules.apply_rules(none).collect() == []


def test_quality_rules_keep_one_of_many_copies(spark):
    text = " ".join(f"w{k}" for k in range(100))
    docs = spark.createDataFrame([(k, text, "s") for k in range(30)] + [(99, text + " more", "s")], "doc_id long, text string, source string")
    assert {r["doc_id"] for r in quality_rules.apply_rules(docs).where("kept").collect()} == {0, 99}


BENCH = [(1, "The of, and IS x1 longerword"), (2, "one"), (3, None), (4, "..."), (None, "two words"), (10, words(25)), (1, "The of, and IS x1 longerword"), (11, "Étude ONE"), (12, "a b a b a b a")]


def test_decontaminate(spark, rows, none):
    low = lambda t: [w for w in "".join(c.lower() if "A" <= c <= "Z" else c if c.isdigit() and c < "\x80" or "a" <= c <= "z" or c >= "\x80" else " " for c in t or "").split(" ") if w]
    planted = [(None, "a row without an id: " + BENCH[5][1]), (200, "before. " + BENCH[5][1] + " after " * 3), (201, " ".join(BENCH[5][1].split(" ")[4:16])), (202, "The-of-and!is X1 longerWord"), (203, ", One;"), (204, "étude one Étude One. étude"), (205, "ÉTude one a B a b A b a b a?"), (206, "a b a"), (206, "a b a b")]
    every = [*rows, *planted]
    docs = spark.createDataFrame(every, "doc_id long, text string")
    items = spark.createDataFrame(BENCH, "item_id long, text string")
    windows = defaultdict(set)
    for i, t in BENCH:
        w = low(t)
        for k in range(max(1, len(w) - 9) if w and i is not None else 0):
            windows[tuple(w[k : k + 10])].add(str(i))
    want = []
    for i, t in every:
        w, hit, ids = low(t), set(), set()
        for win, owners in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    ids |= owners
        want.append((i, len(w), len(hit), sorted(ids), bool(hit)))
    found = decontaminate.decontaminate(docs, items)
    assert by_row(found, "doc_id", "n_words", "n_hit", "item_ids", "contaminated") == sorted(want, key=repr)
    assert decontaminate.decontaminate(none, items).collect() == []
    assert not any(r["contaminated"] for r in decontaminate.decontaminate(docs, items.limit(0)).collect())


def test_decontaminate_without_broadcast(spark, docs, rows, monkeypatch):
    items = spark.createDataFrame(BENCH, "item_id long, text string")
    fields = ("doc_id", "n_words", "n_hit", "item_ids")
    small = by_row(decontaminate.decontaminate(docs, items), *fields)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert by_row(decontaminate.decontaminate(docs, items), *fields) == small


def shingles(t, n=4):
    w = (t or "").encode().lower().split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return sorted(((i, len(x), None if i is None else root(i)) for i, x in sets), key=repr)


def test_jaccard_join(docs, rows, none):
    assert by_row(jaccard_join.join_components(docs), "doc_id", "n_shingles", "component_id") == brute_components(rows)
    assert jaccard_join.join_components(none).collect() == []


def union_find(links):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    return sorted((x, root(x)) for x in list(parent))


def test_components_grow(spark):
    """Chains, stars and loops in one go, and by links that come later: within, between and beside components."""
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(300, 301), (301, 300), (300, 301)]
    links += [(rng.randrange(400, 700), rng.randrange(400, 700)) for _ in range(200)]
    links = [(a, b) for a, b in links if a != b]
    later = [(0, 40), (159, 39), (301, 2), (900, 901), (901, 902), (902, 100), (950, 951)] + [(rng.randrange(400, 900), rng.randrange(400, 900)) for _ in range(80)]
    later = [(a, b) for a, b in later if a != b]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    parts = jaccard_join.components(frame(links))
    assert by_row(parts, "id", "component") == sorted(union_find(links), key=repr)
    assert by_row(jaccard_join.grown_by(parts, frame(later)), "id", "component") == sorted(union_find(links + later), key=repr)
    nothing = jaccard_join.components(frame([]))
    assert nothing.collect() == [] and by_row(jaccard_join.grown_by(nothing, frame(later)), "id", "component") == sorted(union_find(later), key=repr)


def test_jaccard_join_many_sizes(spark):
    """Copies with a growing number of edits, of all sizes, and chains of near copies."""
    out, k = [], 0
    for size in [*range(1, 40), 60, 90, 150, 300, 700]:
        base = [f"w{rng.randrange(10_000)}" for _ in range(size)]
        for edits in range(6):
            copy = list(base)
            for _ in range(edits * max(1, size // 100)):
                copy[rng.randrange(size)] = f"v{rng.randrange(10_000)}"
            out.append((k, " ".join(copy)))
            k += 1
    chain = [f"c{n}" for n in range(200)]
    for n in range(40):
        chain = chain[4:] + [f"c{200 + 4 * n + m}" for m in range(4)]
        out.append((k, " ".join(chain)))
        k += 1
    rng.shuffle(out)
    docs = spark.createDataFrame(out, "doc_id long, text string")
    assert by_row(jaccard_join.join_components(docs), "doc_id", "n_shingles", "component_id") == brute_components(out)


def test_layouts_cover_their_differences():
    for low, high in jaccard_join.bands(most=5000):
        for n in (10, 10**6, 10**12):
            m, x, slack, _ = jaccard_join.layout(low, high, n)
            assert m + x >= jaccard_join.differing(high) + 1 + slack and 0 <= x <= m


CHAT = [(1, 0, "system", "be <|im_end|> kind"), (1, 1, "user", "<\\|x <\\\\| <|"), (1, 2, "assistant", "ok\n"), (2, 0, "assistant", None), (2, 0, "assistant", None), (None, 0, None, "x"), (3, 5, "we<|ird", "a"), (4, 0, "user", ""), (4, 1, "assistant", "é" * 5000)]


def test_chat_format(spark):
    turns = spark.createDataFrame([(*r, "extra") for r in CHAT], "conv_id long, turn long, role string, text string, segment string")
    segments = chat_format.format_turns(turns)
    found = {r["conv_id"]: r for r in chat_format.read_back(segments).collect()}
    groups = defaultdict(list)
    for c, t, r, x in CHAT:
        groups[c].append((t, r or "", x or ""))
    assert set(found) == set(groups)
    for c, g in groups.items():
        g.sort()
        loss = "".join(x for _, r, x in g if r == "assistant")
        assert (found[c]["n_turns"], found[c]["turns_sha256"]) == (len(g), sha("".join(f"{r}\n{x}\n" for _, r, x in g)))
        assert (found[c]["loss_chars"], found[c]["loss_sha256"]) == (len(loss), sha(loss))
    assert {c: r["valid_order"] for c, r in found.items()} == {1: True, 2: False, None: False, 3: False, 4: True}
    for r in segments.where("part <> 1").collect():
        assert r["segment"].count("<|") == 1 and not r["loss"]
    assert not any("<|" in r["segment"] for r in segments.where("part = 1").collect())
    assert chat_format.read_back(chat_format.format_turns(turns.limit(0))).collect() == []


def test_escape_is_reversible():
    for _ in range(2000):
        t = "".join(rng.choice("<|\\x") for _ in range(rng.randrange(12)))
        assert chat_format.unescape(chat_format.escape(t)) == t and "<|" not in chat_format.escape(t)


PAGES = [(5, "http://www.Example.com:8080/a b?Q=1#f", "<p>é</p>"), (2, "https://example.com/", "<p>é</p>"), (9, None, "<p>é</p>"), (1, "nonsense", None), (3, "http://b.org", ""), (None, "http://c.org/x", "<p>é</p>"), (7, "http://b.org/\nnew", "only"), (7, "http://b.org/\nnew", "only"), (8, "http://u:p@a.net/%20", "long " * 50_000)]


def test_warc(spark):
    pages = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, key string, sha int")
    directory = warc_index.write_archives(pages)
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in PAGES:
        raw, ref = (h or "").encode(), first.get(h or "")
        other = ref is not None and ref != i
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if other else "response", ref if other else None))
    fields = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert by_row(warc_index.read_archives(directory), *fields) == sorted(want, key=repr)
    assert by_row(warc_index.read_captures(directory, pages.select("url")), *fields) == sorted(want, key=repr)
    one = spark.createDataFrame([("HTTPS://example.COM/",), ("http://absent.org/",)], "url string")
    assert [r["page_id"] for r in warc_index.read_captures(directory, one).collect()] == [2]
    lookup = warc_index.Lookup.of(directory)
    assert [c["payload"].decode() for c in lookup.find("https://EXAMPLE.com/")] == ["<p>é</p>"]
    assert len(lookup.find("http://b.org/\nnew")) == 2 and lookup.find("http://absent.org/") == []
    empty = warc_index.write_archives(pages.limit(0))
    assert warc_index.read_archives(empty).collect() == [] == warc_index.read_captures(empty, pages).collect()


def test_warc_archives_grow_with_the_input(spark, tmp_path, monkeypatch):
    """As many archives, and tasks that write and read them, as the input's bytes ask for, also of one hot URL."""
    monkeypatch.setattr(warc_index, "ARCHIVE_BYTES", 5_000)
    made = {}
    for scale in (1, 10):
        rows = [(k, "http://one.example/hot" if k % 3 else f"http://h{k % 7}.example/p{k}", hashlib.sha512(str(k).encode()).hexdigest() * 4) for k in range(300 * scale)]
        path = str(tmp_path / f"pages{scale}")
        spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(path)
        pages = spark.read.parquet(path)
        directory = warc_index.write_archives(pages)
        made[scale] = directory.select("archive").distinct().count()
        found = warc_index.read_captures(directory, pages.select("url"))
        assert sorted(r["page_id"] for r in found.collect()) == list(range(300 * scale))
    assert made[10] >= 5 * made[1] and made[10] > 20


def test_warc_blocks_and_binary_search(spark, monkeypatch):
    monkeypatch.setattr(warc_index, "BLOCK_LINES", 7)
    pages = spark.createDataFrame([(k, f"http://h{k % 5}.net/p{k}", f"page {k}") for k in range(200)] + [(1000 + k, "http://h1.net/same", f"v{k}") for k in range(20)], "page_id long, url string, html string")
    directory = warc_index.write_archives(pages)
    assert directory.count() > 28 and sorted(r[0] for r in warc_index.read_captures(directory, pages.select("url")).select("page_id").collect()) == sorted(r[0] for r in pages.select("page_id").collect())
    lookup = warc_index.Lookup.of(directory)
    for k in range(0, 200, 67):
        assert [c["page_id"] for c in lookup.find(f"http://h{k % 5}.net/p{k}")] == [k]
    assert sorted(c["page_id"] for c in lookup.find("http://h1.net/same")) == list(range(1000, 1020))


def test_jaccard_blocks_of_many_rows(spark):
    """Rows that hash alike share a block, whatever the number of blocks; pairs behind them are found."""
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    pairs = [(10**6 + k, text(k)) for k in range(40)] + [(2 * 10**6 + k, text(k) + " more") for k in range(40)]
    empty = spark.range(70_000).selectExpr("CAST(1 AS long) AS doc_id", "'' AS text")
    found = jaccard_join.join_components(empty.unionByName(spark.createDataFrame(pairs, "doc_id long, text string")))
    counts = Counter((r["doc_id"], r["component_id"]) for r in found.collect())
    assert counts == Counter({(1, 1): 70_000} | {(base + k, 10**6 + k): 1 for base in (10**6, 2 * 10**6) for k in range(40)})


def test_packing(spark, docs, rows, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = packing.pack(docs).collect()
    want = Counter()
    for i, t in rows:
        want[i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [0])] += 1
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i in {i for i, _ in rows}:
        own = [ids for (j, ids), n in want.items() if j == i for _ in range(n)]
        assert sum(r["length"] for r in pieces[i]) == sum(map(len, own))
        for r in pieces[i]:
            cuts = [ids[r["start"] : r["start"] + r["length"]] for ids in own if len(ids) == r["doc_tokens"]]
            assert r["ids_crc32"] in {zlib.crc32(np.array(c, "<u4").tobytes()) for c in cuts}
    for s in sequences.values():
        s.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in s] == [0, *np.cumsum([r["length"] for r in s])[:-1].tolist()] and sum(r["length"] for r in s) <= 1024
    assert sum(sum(r["length"] for r in s) < 1000 for s in sequences.values()) <= 1
    assert packing.pack(none).collect() == []


def test_quick_encoder_equals_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, encode = Tokenizer.from_file(path), packing.encoder(path)
    marks = [chr(c) for c in [*range(0x250), *range(0x2000, 0x2070)]]
    cases = ["x" + c + " y" + c + c + "  z1" + c for c in marks] + [t or "" for t in texts()] + ["a <|endoftext|>b", "it's I'LL 've 12 3", "̀\U0001f600 ok"]
    cases += ["".join(rng.choice(marks) for _ in range(40)) for _ in range(300)]
    for t in cases:
        assert encode(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_packing_prefers_lexical_neighbours():
    idf = np.ones(packing.VOCABULARY, np.float32)
    a, b = np.arange(100, 400, dtype=np.uint16), np.arange(1000, 1300, dtype=np.uint16)
    rows = [(k, 0, 300, (a if k % 2 else b).copy()) for k in range(6)]
    placed = defaultdict(set)
    for doc_id, _, _, _, _, sequence, _ in packing.pack_shard(rows, idf, 0):
        placed[sequence].add(doc_id)
    full = max(placed.values(), key=len)
    assert len([d for d in full if d % 2 == min(full) % 2]) >= 3


def test_packing_finds_neighbours_across_the_corpus(spark, monkeypatch):
    """Far more tails than a shard holds, a few of each subject: they meet all the same."""
    monkeypatch.setattr(packing, "SHARD_DOCS", 32)
    draw = random.Random(5)
    words = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in "bdgklmnprst"]
    subjects = [draw.sample(words, 40) for _ in range(100)]
    rows = [(k, " ".join(draw.choice(subjects[k % 100]) for _ in range(150))) for k in range(1000)]
    met = defaultdict(set)
    for r in packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        met[r["sequence_id"]].add(r["doc_id"])
    with_own = {d for docs in met.values() for d in docs if any(o != d and o % 100 == d % 100 for o in docs)}
    assert len(with_own) > 700


def test_packing_scores_whole_texts(spark):
    """A long text's tail is a few words that say nothing; its body decides."""
    body = {s: [f"{s}{a}{b}" for a in "bdfgklmn" for b in "aeiou"] for s in ("qua", "zer")}
    draw = random.Random(6)
    many = lambda s, n: " ".join(draw.choice(body[s]) for _ in range(n))
    encode = packing.encoder(packing.vocabulary_path("byte_bpe_50k.json"))

    def cut(text, n):  # as many words as give some n tokens
        parts = text.split(" ")
        while len(encode(" ".join(parts))) > n:
            parts.pop()
        return " ".join(parts)

    rows = [(0, cut(many("qua", 900), 900))] + [(k, cut(many("qua" if k % 2 else "zer", 900), 1010) + " the" * 50) for k in range(1, 9)]
    rows = [(i, t) for i, t in rows if i == 0 or 1024 < len(encode(t)) + 1 < 1100]
    assert len(rows) > 6
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    (own,) = {r["sequence_id"] for r in found if r["doc_id"] == 0}
    others = {r["doc_id"] for r in found if r["sequence_id"] == own} - {0}
    assert others and all(k % 2 for k in others)


def junk(k):
    return " ".join(["### click", "|", "BUY NOW!!", "$$$"][(k + j) % 4] + str(j % 7) for j in range(80))


def test_quality_classifier(spark):
    rows = [(k, junk(k) if k % 3 == 0 else " ".join(rng.choice(["the", "house", "river", "of", "green", "walks", "and", "slowly"]) for _ in range(80))) for k in range(600)]
    docs = spark.createDataFrame([*rows, (None, "text"), (1000, None), (1001, ""), (1000, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 != 0), 0) for k, _ in rows] + [(None, 1, 0), (5000, 1, 0), (3, None, 0), (1000, 1, 1)], "doc_id long, quality int, toxic int")
    found = quality_classifier.score(docs, quality_classifier.fit_sample(docs, labels)).collect()
    assert len(found) == 604 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in found)
    held = [r for r in found if r["doc_id"] is not None and r["doc_id"] < 600 and r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found if r["doc_id"] is not None)
    assert sum(r["predicted"] == int(r["doc_id"] % 3 != 0) for r in held) >= 0.97 * len(held)
    # held-out labels change nothing
    flipped = labels.withColumn("quality", quality_classifier.F.when(quality_classifier.held_out(labels.doc_id), 1 - labels.quality).otherwise(labels.quality))
    again = quality_classifier.score(docs, quality_classifier.fit_sample(docs, flipped)).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, again), key=repr)
    alone = quality_classifier.score(docs, quality_classifier.fit_sample(docs, labels.limit(0))).collect()
    assert {r["score"] for r in alone} == {0.5}
    assert quality_classifier.score(docs.limit(0), quality_classifier.fit_sample(docs.limit(0), labels)).collect() == []


def test_jaccard_rows_that_share_an_id(spark):
    """Documents of their own, each in its own component, which has the smallest doc_id in it."""
    a, b = words(80), words(80)
    rows = [(1, a), (3, a + " x"), (3, b), (3, b), (9, b + " y"), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_row(jaccard_join.join_components(docs), "doc_id", "component_id") == [(1, 1), (3, 1), (3, 3), (3, 3), (9, 3), (None, None)]
    gone = {(r["doc_id"], r["kept"], r["rows"]) for r in jaccard_join.copies_to_drop(docs).collect()}
    assert gone == {(3, False, 1), (3, True, 2), (9, False, 1)}


def test_jaccard_large_groups_in_tiles(spark, monkeypatch):
    """Unlinked texts that share much: more members than a tile, with pairs put off."""
    monkeypatch.setattr(jaccard_join, "TILE", 3)
    base = words(120).split(" ")
    rows = [(k, " ".join(w if (j * 7 + k) % 40 else f"own{k}x{j}" for j, w in enumerate(base))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_row(jaccard_join.join_components(docs), "doc_id", "n_shingles", "component_id") == brute_components(rows)


def test_layouts_reach_any_size():
    plans = jaccard_join.reaching(jaccard_join.layouts(1000), 3_000_000)
    assert plans[-1][1] >= 3_000_000 and all(a[1] + 1 == b[0] for a, b in zip(plans, plans[1:]))


def test_pairs_of_many_groups_are_compared_in_one(monkeypatch):
    """Two documents that share groups in several chunks are one likely pair, found in the first of their groups."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    hashes = [np.unique(rng.integers(0, 1 << 63, 60).astype(np.uint64))] * 4  # all alike, so that every pair is likely
    members = {-7: [0, 1, 2], 3: [0, 1], 5: [0, 1, 2, 3], 9: [2, 3]}
    groups = {d: sorted(g for g, held in members.items() if d in held) for d in range(4)}
    found = []
    for gid, held in members.items():  # a chunk a group
        ids = pa.array(held, pa.int64())
        same = lambda v, kind: pa.array([v] * len(held), kind)
        chunk = pa.table({"gid": same(gid, pa.int64()), "low": same(0, pa.int32()), "high": same(0, pa.int32()), "ref": ids, "tile": same(0, pa.int32())})
        documents = pa.table({"doc": ids, "part": ids, "n": same(60, pa.int64()), "bits": pa.array([jaccard_join.bitmap(hashes[d]).tobytes() for d in held], pa.binary()), "groups": pa.array([groups[d] for d in held], pa.list_(pa.int64()))})
        out = jaccard_join._likely(1 << 20, 85)(chunk, documents).to_pylist()
        found += [(r["left"], r["right"], gid) for r in out if r["gid"] is None]
    assert sorted(found) == [(0, 1, -7), (0, 2, -7), (0, 3, 5), (1, 2, -7), (1, 3, 5), (2, 3, 5)]
    held = jaccard_join.earlier_groups([np.array([1, 2, 8]), np.array([2, 5]), np.array([1, 9])], 8)
    assert (held[0] & held[1]).any() and (held[0] & held[2]).any() and not (held[1] & held[2]).any()
    assert jaccard_join.earlier_groups([np.array([1]), np.array([2])], 8) is None
