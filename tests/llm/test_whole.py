"""Queries against their SQL on made tables that reach the methods, and the pipeline against brute force."""

import json
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
from pyspark.sql import functions as F

from veilspark.llm import chat_format, quality_rules, queries, simhash, url_filters

SPLIT = re.compile("[^\x20\x09-\x0d]+")


def same_as_sql(df, sql, **tables):
    duck = duckdb.connect()
    for name, rows in tables.items():
        duck.register(name, rows.toArrow())
    got = duck.execute(sql)
    names = sorted(df.columns)
    at = [[x[0] for x in got.description].index(n) for n in names]
    assert sorted(repr([str(r[n]) for n in names]) for r in df.collect()) == sorted(repr([str(r[i]) for i in at]) for r in got.fetchall())


def test_redirect_equivalence_is_the_sqls(spark):
    canon = lambda x: f'<html><head><link rel="canonical" href="{x}"></head></html>'
    fresh = lambda x: f"<meta http-equiv='refresh' content='0; url={x}'>"
    rows = [
        (1, "http://a.org/1", canon("http://a.org/2")), (2, "http://a.org/2", fresh("http://shop.net/es/x")), (3, "http://b.org/", canon("http://a.org/1")),  # a chain to a block
        (4, "http://c.org/x", canon("http://d.org/y")), (5, "http://d.org/y", canon("http://c.org/x")),  # a cycle of the unruled
        (6, "http://e.org/", canon("http://good.com/a")), (7, "http://f.org/", canon("http://e.org/")), (8, "http://f.org/z", canon("http://shop.net/fr/")), (9, "http://f.org/z", canon("/")),  # allow before block
        (10, "http://shop.net/es/q", canon("http://good.com/a")), (11, "HTTP://B.org/#x", None), (12, None, canon("http://a.org/1")), (13, "no address", canon("http://a.org/1")), (14, "http://g.org?q=1&r=2", canon("//h.org/?x=1&amp;y=2")),
        (15, "http://h.org/?x=1&y=2", fresh("http://shop.net/es/x")), (16, "http://www.example.com/en/", ""), (17, "http://x.example.com/en/", canon("http://good.com/b")), (17, "http://x.example.com/en/", canon("http://good.com/b")),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    out = url_filters.verdicts(pages)
    same_as_sql(out, url_filters.SQL, pages=pages)
    got = {r.page_id: r.verdict for r in out.collect()}
    assert got[1] == got[3] == got[11] == got[14] == "block" and got[4] == got[7] == got[9] == "allow" and got[10] == "block"


def test_rules_beyond_the_compiled_number_judge_alike(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 30}.site{i % 7}.org/p{i % 5}/x") for i in range(200)] + [(200, None)], "page_id bigint, url string").withColumn("html", F.lit(None).cast("string"))
    rules = [(f"site{i % 7}.org", f"/p{i % 5}", "block" if i % 2 else "allow") for i in range(35)] + [(f"h{i}.site1.org", "/", "block") for i in range(5)]
    few = url_filters.verdicts(pages, rules)
    many = url_filters.verdicts(pages, rules + [(f"none{i}.org", "/", "block") for i in range(300)])
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect())) and few.filter("verdict = 'block'").count() > 10
    hops = spark.createDataFrame([("http://h0.site0.org/q", "http://h9.site1.org/p1/x")], "src string, dst string")
    one = spark.createDataFrame([(1, "http://h0.site0.org/q", None)], "page_id bigint, url string, html string")
    assert url_filters.judge(one, [("site1.org", "/p1", "block")], hops).first().verdict == "block"


def test_quality_is_the_sqls(spark):
    rng = np.random.RandomState(6)
    words = "the of and tion shond erin weath blor quith navel der die und le la porst".split()
    texts = [None, "", " \n\t ", "a b c", "x " * 60, " ".join(rng.choice(words, 80)), "\n".join([" ".join(rng.choice(words, 12))] * 9), " ".join(f"w{x}" for x in range(70)), "### &&& " * 40, "é\x1cü " + " ".join(rng.choice(words, 55)), "z" * 5000]
    texts += [" ".join(rng.choice(words, n)) + "\n" + " ".join(f"u{rng.randint(9)}" for _ in range(n)) for n in range(20, 70, 5)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, "a")], "doc_id bigint, text string")
    same_as_sql(quality_rules.quality_report(docs), quality_rules.SQL, documents=docs)


def naive_links(rows):
    """Status and level of each call and result of one conversation, by plain recursion."""
    calls, results, seen = {}, {}, []
    for turn, kind, body in rows:
        i = body.get("id") if kind == "call" else body.get("tool_call_id")
        held = calls if kind == "call" else results
        seen.append((turn, kind, i, i in held))
        held.setdefault(i, (turn, body))
    before = lambda kind, i: [("c", i)] if kind == "r" else [("r", j) for j in set(calls[i][1].get("depends_on", [])) if j in results and j in calls]
    level = {}

    def depth(kind, i, path=()):
        if (kind, i) in path:
            return None
        if (kind, i) not in level:
            ds = [depth(k, j, (*path, (kind, i))) for k, j in before(kind, i)] if (kind == "c" or i in calls) else []
            if None in ds:
                return None
            level[kind, i] = max(ds, default=-1) + 1
        return level[kind, i]

    out = []
    for turn, kind, i, again in seen:
        mine, other = (calls, results) if kind == "call" else (results, calls)
        d = None if again else depth(kind[0], i)
        status = "duplicate" if again else ("unanswered" if kind == "call" else "orphan") if i not in other else "cycle" if d is None else "linked"
        out.append((turn, kind, i, status, d if status == "linked" else None))
    return sorted(out, key=repr)


def test_tool_calls_chains_cycles_and_repeats(spark):
    rng = np.random.RandomState(3)
    rows, want = [], {}
    for conv in range(8):
        events, n = [], 7
        for i in range(n):
            on = [f"k{j}" for j in range(n) if rng.rand() < (0.25 if conv % 2 else 0.35) and (j < i or conv % 2)]
            events.append((2 * i, "call", {"id": f"k{i}", "name": "search", "arguments": {"query": "q"}, "depends_on": on}))
            if rng.rand() < 0.85:
                events.append((2 * i + 1, "result", {"tool_call_id": f"k{i}", "content": i}))
        events += [(40, "call", {"id": "k1", "name": "search", "arguments": {"query": "again"}}), (41, "result", {"tool_call_id": "none", "content": 1})]
        want[conv] = naive_links(events)
        tag = {"call": "tool_call", "result": "tool_response"}
        rows += [(conv, t, "assistant", f"<{tag[k]}>{json.dumps(b)}</{tag[k]}>") for t, k, b in events]
    out = chat_format.link(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).filter("kind != 'message'").collect()
    got = defaultdict(list)
    for r in out:
        got[r.conv_id].append((r.turn, r.kind, r.call_id, r.status, r.level if r.status == "linked" else None))
    assert {c: sorted(x, key=repr) for c, x in got.items()} == want
    assert {s for x in want.values() for *_, s, _ in x} >= {"linked", "cycle", "duplicate", "orphan", "unanswered"}


def test_json_is_canonical_at_every_depth(spark):
    body = {"id": "a", "name": "run_code", "arguments": {"timeout": 1.5, "code": "x", "language": None, "z": {"b": [{"d": 1, "c": "é"}], "a": True}}}
    row = chat_format.link(spark.createDataFrame([(1, 0, "assistant", f"<tool_call>{json.dumps(body)}</tool_call>")], "conv_id bigint, turn bigint, role string, text string")).filter("kind = 'call'").first()
    assert row.json == json.dumps({k: body[k] for k in ("arguments", "id", "name")}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert row.errors == ["language: not string", "z: not known"]


def brute_pipeline(docs):
    """(doc_id, text) that the stages before packing keep."""
    kept = []
    for r in docs:
        t, w = r.text or "", SPLIT.findall(r.text or "")
        n, tri, cover = len(w), Counter(zip(w, w[1:], w[2:], strict=False)), set()
        for i in range(n - 2):
            if tri[w[i], w[i + 1], w[i + 2]] > 1:
                cover |= {i, i + 1, i + 2}
        if n < 50 or 2 * len(cover) > n:
            continue
        lines = [x for x in t.split("\n") if SPLIT.search(x)]
        ratios = sum(map(len, w)) / n, len(re.findall(r"[#*$%&|<>]", t)) / n, sum(x in quality_rules.STOP_WORDS for x in w) / n, (len(lines) - len(set(lines))) / max(len(lines), 1)
        if 2 <= ratios[0] <= 20 and ratios[1] <= 0.3 and ratios[2] >= 0.02 and ratios[3] <= 0.5:
            kept.append(r)
    strip = lambda x: x.strip("\x20\t\n\x0b\x0c\r")
    sites, first = defaultdict(set), {}
    for r in sorted(kept, key=lambda r: r.doc_id):
        for at, line in enumerate(r.text.split("\n")):
            if strip(line):
                sites[strip(line)].add(r.source)
                first.setdefault(strip(line), (r.doc_id, at))
    gone = lambda r, at, x: strip(x) and len(sites[strip(x)]) >= 10 and first[strip(x)] != (r.doc_id, at)
    cut = {r.doc_id: "\n".join(x for at, x in enumerate(r.text.split("\n")) if not gone(r, at, x)) for r in kept}
    cut = {i: t for i, t in cut.items() if strip(t)}
    ids = sorted(cut)
    words = [simhash.words_of(cut[i]) for i in ids]
    sets = [simhash._shingles(w, 5) for w in words]
    by, part = defaultdict(set), list(range(len(ids)))
    for i, s in enumerate(sets):
        for x in s:
            by[x].add(i)

    def top(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, s in enumerate(sets):
        met = Counter(j for x in s for j in by[x] if j < i)
        for j, both in met.items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                a, b = top(i), top(j)
                part[max(a, b)] = min(a, b)
    return {ids[i]: cut[ids[i]] for i in range(len(ids)) if top(i) == i}


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    want = brute_pipeline(docs.collect())
    folder = str(tmp_path)
    docs.withColumns({"_removed": F.lit(1), "node": F.lit("z")}).write.parquet(f"{folder}/documents.parquet")
    rows = corpus_pipeline.run(spark, folder).collect()
    library = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    lengths = Counter()
    for r in rows:
        lengths[r.doc_id] += r.length
    assert lengths == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in want.items()}
    docs.limit(0).write.parquet(f"{folder}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0
