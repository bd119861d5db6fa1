"""The ten operators against brute force on small tables: nulls, empty texts, ties, repeats, clashing names."""

import hashlib
import math
import re
import tarfile
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from veilspark.llm import bpe_trie, chat_format, line_dedup, lm_scoring, media_columns, packing, quality_rules, queries, sharding, simhash, url_filters

WORDS = "the of and tion shond erin weath blor quith navel porst gleam".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, _text string"


def texts():
    rng = np.random.RandomState(3)
    out = [None, "", "  \n\t", "one", "two words", "a b c été \U0001f600 x", "don't <|endoftext|> stop 123 4567", "x" * 5000]
    base = [" ".join(rng.choice(WORDS, n)) for n in (60, 80, 300, 5000)]
    out += base + base[:2]  # exact copies
    out += [base[2].replace("quith", "quath", 1), base[0].upper()]
    out += ["same line here\n" + b + "\nlast of all" for b in base[:3]]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"src{i % 5}" if i % 6 else None, len(t or ""), "z", "q") for i, t in enumerate(texts())]
    rows += [rows[9], (None, "no id", "en", "src1", 5, None, None)]  # a repeated row, a null id
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def pairs(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = packing.pack(docs, path, capacity=256).collect()
    by = Counter(r.id for r in rows if r.piece == 0)
    assert by == Counter(r.doc_id for r in docs.select("doc_id").collect())
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in rows:
        ids = [*library.encode(text[r.id] or "", add_special_tokens=False).ids, 1]
        part = ids[r.start : r.start + r.length]
        assert len(part) == r.length <= 256 and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32 and r.start == 256 * r.piece
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(held) <= math.ceil(sum(r.length for r in rows) / 256) + 1
    assert packing.pack(empty, path).count() == 0


def fewest(items, capacity):
    """The fewest sequences by trying all assignments."""
    items = sorted(items, reverse=True)

    def fits(k):
        room, seen = [capacity] * k, set()

        def go(at):
            if at == len(items):
                return True
            state = (at, tuple(sorted(room)))
            if state in seen:
                return False
            seen.add(state)
            for b in range(k):
                if room[b] >= items[at] and room[b] not in room[:b]:
                    room[b] -= items[at]
                    if go(at + 1):
                        return True
                    room[b] += items[at]
            return False

        return go(0)

    k = -(-sum(items) // capacity)
    while not fits(k):
        k += 1
    return k


def test_bin_completion_is_the_optimum_on_small_cases():
    rng, searched, better = np.random.RandomState(1), 0, 0
    for _ in range(150):
        capacity = int(rng.choice([20, 50, 100]))
        items = rng.randint(max(1, capacity // 6), capacity // 2 + 4, rng.randint(1, 14)).tolist()
        found = packing.bin_completion(Counter(items), capacity)
        held = Counter()
        for pattern, n in found.patterns:
            assert sum(a * k for a, k in pattern) <= capacity
            for a, k in pattern:
                held[a] += n * k
        assert held == Counter(items) and found.optimal and found.sequences == fewest(items, capacity)
        searched += found.nodes > 0
        better += found.sequences < sum(n for _, n in packing.best_fit_decreasing(Counter(items), capacity))
    assert searched > 5 and better > 2
    assert packing.bin_completion({}, 100).patterns == []


def test_bin_completion_stops_at_its_limits_with_a_whole_packing():
    items = Counter(np.random.RandomState(4).randint(800, 2100, 400).tolist())
    found = packing.bin_completion(items, 4096, nodes=30, steps=200)
    held = Counter()
    for pattern, n in found.patterns:
        for a, k in pattern:
            held[a] += n * k
    assert held == items and found.nodes <= 30 and found.sequences >= found.bound


def test_words_of_the_packing_vocabulary_are_the_librarys():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), packing.WordTokenizer(path, keep=500)
    rng = np.random.RandomState(5)
    letters = list("aAbBsSt'mdlrve \u2019\u00e9\u00c9\u00df\u1e9e\u0130\u0131\u00f1\u00d10129\u0663 \t\n\x0b\x0c\r\x1c\x85\xa0 #$%<|>\u00aa\u00d7\u4e2d\U0001f600\u0301\u0308_-.,\u00b2\ufb01\u03a3\x00\x7f")
    texts = ["".join(rng.choice(letters, rng.randint(0, 30))) for _ in range(2000)] + ["<|endoftext|>", "a<|startoftext|>b", "don't DON'T it'll 'Re", "etaoin" * 500]
    texts += ["".join(rng.choice(list("etaoinshrdlu"), rng.randint(1, 20))) for _ in range(2000)]
    for at in range(0, len(texts), 300):
        for text, ids in zip(texts[at : at + 300], own.encode(texts[at : at + 300]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_url_filters(spark):
    html = lambda x: f'<html><head><link rel="canonical" href="{x}"></head></html>'
    rows = [
        (1, "http://WWW.Example.com/en/a?b#c", None), (2, "http://a.example.com/en/", None), (3, "http://x.org/", html("http://shop.net/es/1")), (4, "http://shop.net/es/1", ""),
        (5, None, "x"), (6, "nothing", None), (7, "http://y.org/p", html("http://x.org/")), (8, "http://z.org/", html("http://good.com/")), (9, "http://notexample.com/en/", None), (9, "http://notexample.com/en/", None),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.verdicts(pages).collect()}
    assert got[1] == ("www.example.com", "/en/a", "www.example.com/en/", "allow") and got[2][2:] == ("example.com/en/", "block")
    assert got[3][2:] == (None, "block") and got[7][2:] == (None, "block") and got[8][2:] == (None, "allow")
    assert got[5] == ("", "", None, "allow") and got[6] == ("", "", None, "allow") and got[9][2] == "com/"
    assert url_filters.verdicts(pages).count() == 10 and url_filters.verdicts(pages.limit(0)).count() == 0


def test_chat_format(spark):
    call = lambda i, name, args, more="": f'<tool_call>{{"id":"{i}","name":"{name}","arguments":{args}{more}}}</tool_call>'
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "x " + call("a", "search", '{"query":"q","limit":3}') + call("b", "fetch", '{"url":5}')), (1, 2, "tool", '{"tool_call_id":"a","content":{"z":1,"y":2}}'),
        (1, 3, "tool", '{"tool_call_id":"nobody","content":1}'), (1, 4, "assistant", call("c", "nothing", "{}", ',"depends_on":["a"]')), (1, 5, "assistant", "<tool_call>{broken</tool_call>"), (None, 0, "user", None),
    ]
    out = chat_format.link(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    got = {(r.kind, r.call_id): r for r in out.collect() if r.call_id}
    assert got["call", "a"].status == "linked" and got["call", "a"].errors == [] and got["result", "a"].json == '{"content":{"y":2,"z":1},"tool_call_id":"a"}'
    assert got["call", "b"].status == "unanswered" and got["call", "b"].errors == ["url: not string"] and got["result", "nobody"].status == "orphan"
    assert got["call", "c"].errors == ["unknown tool: nothing"] and got["result", "a"].level == 1
    assert {r.status for r in out.collect() if r.kind == "call" and r.call_id is None} == {"malformed"}
    assert out.limit(0).count() == 0


def naive_print(text):
    w = (text or "").encode().translate(simhash.LOWER).split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs, empty):
    rows = docs.select("doc_id", "text").collect()
    prints = [naive_print(r.text) for r in rows]
    part = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 2:
                    part[i] = part[j] = min(part[i], part[j])
    least = {p: min((rows[i].doc_id for i in range(len(rows)) if part[i] == p and rows[i].doc_id is not None), default=None) for p in part}
    want = sorted(((rows[i].doc_id, f"{prints[i]:016x}", least[part[i]]) for i in range(len(rows))), key=repr)
    assert pairs(simhash.group_near_duplicates(docs), "id", "fingerprint", "component_id") == want
    assert simhash.group_near_duplicates(empty).count() == 0


def test_bit_planes_against_hamming():
    rng = np.random.RandomState(5)
    base = rng.randint(0, 256, (6, 8), dtype=np.uint8)
    rows = np.repeat(base, 30, axis=0) ^ (rng.random((180, 8)) < 0.15).astype(np.uint8)
    groups = np.sort(rng.randint(0, 4, 180)).astype(np.int64)
    parent = list(range(180))

    def top(p, x):
        while p[x] != x:
            x = p[x]
        return x

    for i in range(180):
        for j in range(i):
            if groups[i] == groups[j] and np.unpackbits(rows[i] ^ rows[j]).sum() <= 3:
                a, b = top(parent, i), top(parent, j)
                parent[max(a, b)] = min(a, b)
    mine = list(range(180))
    for i, j in simhash.link_block(groups, rows, 3):
        assert np.unpackbits(rows[i] ^ rows[j]).sum() <= 3 and groups[i] == groups[j]
        a, b = top(mine, i), top(mine, j)
        mine[max(a, b)] = min(a, b)
    assert [top(mine, i) for i in range(180)] == [top(parent, i) for i in range(180)]


def test_near_duplicates_keep_one_and_clean(spark):
    rng = np.random.RandomState(9)
    made = [" ".join(rng.choice(2000, 200).astype(str)) for _ in range(12)]
    near = made[0].split()
    near[100] = "changed"
    rows = [(i, t) for i, t in enumerate(made)] + [(50, made[1]), (51, " ".join(near)), (None, "no id")]
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert kept == {*range(12), None}


def rewritten(run, seed):
    """60 pairs of 200-word documents, ids i and 100 + i, the second with ``run`` words in a row changed."""
    rng, rows = np.random.RandomState(seed), []
    for i in range(60):
        w = [f"w{x}" for x in rng.randint(0, 10**6, 200)]
        at = rng.randint(10, 150)
        rows += [(i, " ".join(w)), (100 + i, " ".join(w[:at] + [f"new{x}" for x in rng.randint(0, 10**6, run)] + w[at + run :]))]
    return rows


def test_near_duplicates_below_the_similarity_stay(spark):
    rows = rewritten(20, 11)  # 172 of 220 shingles: 0.78
    assert not any(simhash.similar(simhash.words_of(a[1]), simhash.words_of(b[1]), 5, 80) for a, b in zip(rows[::2], rows[1::2], strict=True))
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert kept == {r[0] for r in rows}


def test_near_duplicates_at_the_similarity_are_found(spark):
    rows = rewritten(17, 12)  # 175 of 217 shingles: 0.806
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert kept == set(range(60))
    assert simhash.joint_recall(0.8, 256, 63, 8, 2) >= 0.999


def variants(seed, n):
    """Texts around one text, each with up to a third of its words changed, so that some are near duplicates of some."""
    rng = np.random.RandomState(seed)
    base = [f"w{x}" for x in rng.randint(0, 10**6, 120)]
    out = []
    for _ in range(n):
        w = list(base)
        at, run = rng.randint(0, 80), rng.randint(0, 40)
        w[at : at + run] = [f"v{x}" for x in rng.randint(0, 10**6, run)]
        out.append(" ".join(w))
    return out


def brute_groups(texts, linked):
    part = list(range(len(texts)))

    def top(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if linked(i, j):
                a, b = top(i), top(j)
                part[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(texts))]


def test_a_hot_group_of_near_copies_in_many_chunks(spark):
    rows = list(enumerate(variants(21, 150) + [None, "", " \n", "one"] + variants(22, 30)))
    words = [simhash.words_of(t) for _, t in rows]
    part = brute_groups(words, lambda i, j: simhash.similar(words[i], words[j], 5, 80))
    assert 5 < len(set(part)) < 150
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    for chunk in (8, 1 << 11):
        kept = {r.doc_id for r in simhash.drop_near_duplicates(df, chunk=chunk).collect()}
        assert kept == set(part), chunk


def test_hot_buckets_of_fingerprints_in_many_chunks(spark):
    rng = np.random.RandomState(8)
    base = rng.randint(0, 256, (3, 8), dtype=np.uint8)
    bits = np.unpackbits(np.repeat(base, 70, axis=0), axis=1) ^ (rng.random((210, 64)) < 0.03).astype(np.uint8)
    fps = np.unique(np.packbits(bits, axis=1), axis=0)
    rows = [(1, i, f.tobytes()) for i, f in enumerate(fps)] + [(2, i, f.tobytes()) for i, f in enumerate(fps[:20])]
    part = brute_groups(fps, lambda i, j: np.unpackbits(fps[i] ^ fps[j]).sum() <= 2)
    assert 5 < len(set(part)) < len(fps) - 20
    df = spark.createDataFrame(rows, "block bigint, node bigint, fp binary")
    for chunk in (7, 64, 4096):
        edges = [(r.a, r.b) for r in simhash.block_links(df, 2, chunk).collect()]
        assert len(edges) < 12 * len(fps)
        mine = brute_groups(fps, lambda i, j, e={frozenset(x) for x in edges}: frozenset((i, j)) in e)
        assert mine == part, chunk


def test_rows_that_share_an_id_are_told_apart_by_text(spark):
    a, b, c = variants(31, 1)[0], variants(32, 1)[0], variants(33, 1)[0]
    rows = [(5, a, "x"), (5, b, "x"), (5, b, "x"), (4, a, "y"), (9, c, "z"), (9, c, "y")]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string, _node string"))
    assert pairs(kept, "doc_id", "text", "_node") == sorted([(4, a, "y"), (5, b, "x"), (9, c, "y")], key=repr)


def test_quality_rules(spark, docs, empty):
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.quality_report(docs).collect()}
    for r in docs.select("doc_id", "text").collect():
        t, w = r.text or "", split(r.text)
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        repeated = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if split(x)]
        n = len(w)
        assert (r.doc_id, n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated), n < 50 or 100 * len(repeated) > 50 * n) in got
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and quality_rules.keep_good(empty).count() == 0
    assert kept.count() == quality_rules.quality_report(docs).filter("kept").count()
    assert "Python" not in quality_rules.quality_report(docs)._jdf.queryExecution().toString()


def test_line_dedup(spark, docs, empty):
    cut, count = line_dedup.remove_boilerplate(docs, 2)
    assert [c for c in cut.columns if c != count] == docs.columns
    rows = docs.select("doc_id", "text", "source").collect()
    sites = defaultdict(set)
    for r in rows:
        for x in (r.text or "").split("\n"):
            if r.source is not None and split(x):
                sites[x.strip(" \t\n\x0b\f\r")].add(r.source)
    common = {x for x, s in sites.items() if len(s) >= 2}
    got = {r.doc_id: r.text for r in cut.collect()}
    seen = set()
    for r in sorted((r for r in rows if r.doc_id is not None), key=lambda r: r.doc_id):
        if r.text is None:
            assert got[r.doc_id] is None
        elif r.doc_id not in seen:
            kept = []
            for x in r.text.split("\n"):
                line = x.strip(" \t\n\x0b\f\r")
                if line in common and (line, "met") in seen:
                    continue
                if line in common:
                    seen.add((line, "met"))
                kept.append(x)
            assert got[r.doc_id] == "\n".join(kept)
        seen.add(r.doc_id)
    assert line_dedup.remove_boilerplate(empty)[0].count() == 0


@pytest.mark.parametrize("d", [0.3, 0.8])
def test_table_numbers_follow_their_law(d):
    rng = np.random.default_rng(1)
    s = lm_scoring.log_stirling(400, d)
    for c in (2, 5, 40, 300):
        for b in (0.01, 1.0, 30.0):
            logs = s[c, 1 : c + 1] + np.arange(1, c + 1) * math.log(b)
            p = np.exp(logs - logs.max())
            p /= p.sum()
            mean = (p * np.arange(1, c + 1)).sum()
            sd = math.sqrt((p * (np.arange(1, c + 1) - mean) ** 2).sum())
            got = lm_scoring.draw_tables(np.full(4000, c), np.full(4000, b), d, rng, lm_scoring.log_stirling(lm_scoring.EXACT, d))
            assert abs(got.mean() - mean) < max(6 * sd / 60, 0.02 * mean) + (0.5 if c > lm_scoring.EXACT else 0)


def test_lm_scoring(spark, docs, empty):
    rows = docs.select("doc_id", "text").collect()
    tokens = [[*simhash.words_of(r.text), b"\n"] for r in rows]
    out = [lm_scoring.held_out(r.doc_id) for r in rows]
    counts = Counter(w for t, h in zip(tokens, out, strict=True) if not h for w in t)
    n, v = sum(counts.values()), len(counts)
    want = sorted(((r.doc_id, h, len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 6)) for r, t, h in zip(rows, tokens, out, strict=True)), key=repr)
    scored = lm_scoring.score(docs, block_tokens=700, bucket_pairs=400)
    got = [(r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scored.collect()]
    assert sorted(got, key=repr) == want
    assert all(r.score < 0 for r in scored.collect())
    # the same text scores the same wherever it stands
    by = defaultdict(set)
    text = {r.doc_id: r.text for r in rows}
    for r in scored.collect():
        by[text[r.id]].add(round(r.score, 9))
    assert all(len(x) == 1 for x in by.values())
    assert lm_scoring.score(empty).count() == 0


def test_lm_scores_are_probabilities(spark):
    """Probabilities of different texts add up to less than one."""
    ids = [i for i in range(2000) if not lm_scoring.held_out(i)]
    held = [i for i in range(2000) if lm_scoring.held_out(i)]
    train = ["a b", "b c a b", "c", "a b c", "", "b b b"]
    tests = ["", *"abc", "zz"]
    one = [(i, t) for i, t in zip(ids, train, strict=False)] + [(i, t) for i, t in zip(held, tests, strict=False)]
    rows = {r.id: r.score for r in lm_scoring.score(spark.createDataFrame(one, "doc_id bigint, text string")).collect()}
    assert 0 < 10 ** rows[held[0]] < 1 and sum(10 ** rows[i] for i in held[: len(tests)]) < 1


def exact_scores(train, tests, sweeps=250, burn=50, seed=5):
    """log10 probabilities by the exact sampler: customers seated one at a time, parents of tables included."""
    rng = np.random.RandomState(seed)
    pairs = [(u, w) for t in train for u, w in zip(["<"] + t, t + [">"], strict=True)]
    by_pair, by_word = Counter(pairs), Counter(w for _, w in pairs)
    d = lm_scoring.discount(np.array(list(by_pair.values())))
    d0 = lm_scoring.discount(np.array(list(by_word.values())))
    base = 1 / (len(by_word) + 1)
    seats, served, n_tables = defaultdict(list), Counter(), Counter()
    top, top_served, top_tables = defaultdict(list), 0, 0

    def parent(w):
        return (sum(top[w]) - d0 * len(top[w]) + (1 + d0 * top_tables) * base) / (1 + top_served)

    def probability(u, w):
        return (sum(seats[u, w]) - d * len(seats[u, w]) + (1 + d * n_tables[u]) * parent(w)) / (1 + served[u])

    def draw(weights):
        x = rng.rand() * sum(weights)
        for i, v in enumerate(weights):
            x -= v
            if x < 0:
                return i
        return len(weights) - 1

    def sit(tables, discount, new):
        i = draw([s - discount for s in tables] + [new])
        if i == len(tables):
            tables.append(1)
            return True
        tables[i] += 1
        return False

    def leave(tables):
        i = draw(tables)
        tables[i] -= 1
        if not tables[i]:
            del tables[i]
            return True
        return False

    def add(u, w):
        nonlocal top_served, top_tables
        if sit(seats[u, w], d, (1 + d * n_tables[u]) * parent(w)):
            n_tables[u] += 1
            top_tables += sit(top[w], d0, (1 + d0 * top_tables) * base)
            top_served += 1
        served[u] += 1

    def remove(u, w):
        nonlocal top_served, top_tables
        if leave(seats[u, w]):
            n_tables[u] -= 1
            top_tables -= leave(top[w])
            top_served -= 1
        served[u] -= 1

    for u, w in pairs:
        add(u, w)
    total = [np.zeros(len(t) + 1) for t in tests]
    for k in range(sweeps):
        for u, w in pairs:
            remove(u, w)
            add(u, w)
        if k >= burn:
            for x, t in zip(total, tests, strict=True):
                x += [probability(u, w) for u, w in zip(["<"] + t, t + [">"], strict=True)]
    return [float(np.log10(x / (sweeps - burn)).sum()) for x in total]


@pytest.mark.parametrize("bucket_pairs", [10**6, 250])
def test_lm_scores_are_near_those_of_the_exact_sampler(spark, bucket_pairs):
    """In one bucket, and in several, whose parents are seated apart while they sample."""
    rng = np.random.RandomState(8)
    words = [f"w{k}" for k in range(15)]
    follow = {w: rng.dirichlet(np.full(15, 0.3)) for w in words}
    texts = []
    for _ in range(90):
        t = [words[rng.randint(15)]]
        while len(t) < rng.randint(3, 14):
            t.append(str(rng.choice(words, p=follow[t[-1]])))
        texts.append(t)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    train = [t for i, t in enumerate(texts) if not lm_scoring.held_out(i)]
    want = np.array(exact_scores(train, texts))
    got = {r.id: r.score for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), sweeps=80, burn=20, bucket_pairs=bucket_pairs).collect()}
    mine = np.array([got[i] for i in range(len(texts))])
    assert abs(mine.sum() / want.sum() - 1) < 0.02 and np.abs(mine / want - 1).max() < 0.12 and np.corrcoef(mine, want)[0, 1] > 0.995


def test_lm_beats_the_base_on_held_out_texts(spark):
    df = lm_scoring.score(queries.table(spark, "/root/testdata/sf0.001", "documents"))
    r = {x.held_out: x for x in lm_scoring.perplexity(df).collect()}
    assert r[True].perplexity < 0.6 * r[True].base_perplexity and r[False].perplexity < r[False].base_perplexity


def test_media_columns(spark, docs, empty, tmp_path):
    rows, places = media_columns.store(docs, f"file://{tmp_path}/shards")
    digests = {r.digest: r for r in places.collect()}
    for r in rows.join(docs.select(F.col("doc_id").alias("id"), "text").distinct(), "id").collect():
        raw = (r.text or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        p = digests[r.digest]
        with open(p.shard.removeprefix("file://"), "rb") as f:
            f.seek(p.offset)
            assert media_columns.from_png(f.read(p.length)) == payload and hashlib.sha256(payload).hexdigest() == r.digest and r.n_bytes == len(raw)
    for shard in {p.shard for p in digests.values()}:
        with tarfile.open(shard.removeprefix("file://")) as t:
            assert all(m.name.endswith(".png") for m in t.getmembers())
    heads = {r.digest: r.height for r in media_columns.read_headers(places).collect()}
    assert len(heads) == len(digests) == places.count()
    assert media_columns.media_report(empty).count() == 0


def test_media_report_is_what_the_files_hold(spark, docs, tmp_path):
    from collections import Counter as count

    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = media_columns.media_report(docs, f"file://{tmp_path}/shards").collect()
    assert count(r.doc_id for r in rows) == count(r.doc_id for r in docs.collect())
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        with open(r.shard.removeprefix("file://"), "rb") as f:
            f.seek(r.offset)
            media = f.read(r.length)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_bytes == len(media) and r.media_sha256 == hashlib.sha256(media).hexdigest()
        assert (r.width, r.height, r.depth, r.colour) == (64, len(payload) // 64, 8, 0) and r.digest == r.payload_sha256
        n, by = len(payload), count(payload)
        entropy = -sum(c / n * math.log2(c / n) for c in by.values())
        assert r.feature.startswith(f"png 64x{n // 64}x8 distinct={len(by)} mean={sum(payload) / n:.6f} ") and abs(float(r.feature.rpartition("=")[2]) - entropy) < 2e-6


def test_media_report_keeps_little_beside_its_texts(spark, tmp_path):
    """Work tables hold digests as bytes, each once (166 bytes a row here; in hexadecimal, one of them twice, 356); payloads are well compressed."""
    from veilspark.llm.common import shared_dir

    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.sha2(F.concat("id", F.lit(f" {k}")), 256).substr(1, k) for k in (5, 9, 3, 7) * 4]).alias("text")).repartition(2)
    work = Path(shared_dir(spark).removeprefix("file://"))
    before = set(work.glob("veilspark-*/*"))
    found = media_columns.media_report(docs, f"file://{tmp_path}/shards")
    tables = [f for folder in set(work.glob("veilspark-*/*")) - before for f in folder.rglob("*.parquet")]
    assert found.count() == 20_000
    assert sum(f.stat().st_size for f in tables) < 250 * 20_000
    payload = media_columns.padded(" ".join(r.text for r in docs.limit(50).collect()))[1]
    assert len(media_columns.to_png(payload)) <= len(media_columns.to_png(payload, 5)) < len(media_columns.to_png(payload, 1))


def test_a_digest_is_stored_once_though_bits_collide(spark, docs, tmp_path):
    many = docs.unionByName(docs).repartition(5)
    for bits in (8, 1 << 20):
        folder = f"{tmp_path}/{bits}"
        rows, places = media_columns.store(many, f"file://{folder}", bits=bits)
        stored = Counter(m.name for shard in Path(folder).iterdir() for m in tarfile.open(shard).getmembers())
        assert set(stored.values()) == {1} and {f"{r.digest}.png" for r in rows.collect()} == set(stored)
        assert places.count() == len(stored)


def test_sharding(spark, docs, empty):
    rows = sharding.shard_report(docs.unionByName(docs).unionByName(docs)).collect()
    assert len(rows) == 3 * docs.count()
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw) and 0 <= r.shard < 16
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    many = spark.range(4000).selectExpr("id as doc_id", "repeat('ab ', cast(1 + id * 7919 % 300 as int)) as text")
    sizes = [r.b for r in sharding.shard_report(many).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) < 0.02 * sum(sizes) / 16
    assert sharding.shard_report(empty).count() == 0
    copies = spark.range(3000).selectExpr("id as doc_id", "repeat('ab ', cast(1 + id % 201 as int)) as text")
    for made, shards in ((sharding.shard(copies), 16), (sharding.shard(copies, 12, most_leaves=4), 12)):
        rows = made.collect()
        held, slots = defaultdict(set), defaultdict(list)
        for r in rows:
            held[r.text_crc32].add(r.shard)
            slots[r.shard].append(r.slot)
        sizes = Counter()
        for r in rows:
            sizes[r.shard] += r.size
        assert len(rows) == 3000 and sorted(slots) == list(range(shards)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
        assert sum(len(x) > 1 for x in held.values()) <= shards - 1 and max(sizes.values()) < 1.06 * sum(sizes.values()) / shards


def test_bpe_trie(spark, docs, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    got = {r.doc_id: r for r in bpe_trie.digests(docs, path).withColumnRenamed("id", "doc_id").collect()}
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == want
    assert bpe_trie.digests(empty, path).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = queries.table(spark, folder, "documents")
    after = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, after = after, stage(spark, after, folder)
        assert after.columns == docs.columns and 0 < after.count() <= before.count(), name
    assert corpus_pipeline.run(spark, folder).filter("piece = 0").count() == after.count()
