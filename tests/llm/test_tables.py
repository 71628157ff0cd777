"""Operators on whole tables against brute force: chat, URL filter, shards, pages, near-duplicates, pipeline."""

import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from gridvalue.functions import settle
from gridvalue.llm import chat, components, html_text, sharding, simhash, url_filter
from gridvalue.llm.ordered import in_order
from gridvalue.llm.registry import ORACLES, QUERIES

from . import brute


def shown(rows):
    return sorted(map(str, map(tuple, rows)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in ("conversations", "pages", "documents", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df, cursor = QUERIES[name](spark, sf), con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    got = df.select(*names).collect()
    assert sorted(df.columns) == sorted(names) and got and shown(got) == shown(cursor.fetchall())


def test_every_operator_is_registered():
    names = list(entry.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names


TURNS = [
    (1, 0, "user", "a"), (1, 1, "bot", "b"), (2, 0, "user", "a"), (2, 1, "bot", "b"), (2, 2, "user", "c"),
    (3, 0, "user", "a"), (3, 1, "bot", "b"), (3, 2, "user", "c"), (4, 0, "user", None), (5, 0, "user", ""), (5, 1, None, ""),
    (6, None, "user", "x"), (6, None, "user", "x"), (None, 0, "user", "a"), (None, 1, "bot", "z"), (7, 0, "user", "ab"),
]


def test_chat_collapses_snapshots(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("x"))
    got = {r["conv_id"]: r for r in chat.format_chats(turns).collect()}
    assert set(got) == {2, 4, 5, 6, None, 7}
    assert got[2]["copies"] == 2 and got[2]["n_turns"] == 3 and got[4]["copies"] == 1
    assert got[2]["rendered"] == "<|im_start|>user\na<|im_end|>\n<|im_start|>bot\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n"
    assert got[6]["n_turns"] == 2
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_chat_parts(spark):
    rows = [(1, i, "user", str(i)) for i in range(7)] + [(2, i, "user", str(i)) for i in range(5)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_chats(turns, turns_per_part=3).orderBy("part").collect()
    assert [(r["conv_id"], r["part"], r["n_turns"]) for r in got] == [(1, 0, 7), (1, 1, 7), (1, 2, 7)]
    assert "".join(r["rendered"] for r in got).count("<|im_start|>") == 7


PAGES = [
    (0, "http://a.com/x", '<a href="http://b.org/1">x</a><a href="//c.org/">'), (1, "http://b.org/", '<a href="https://D.org/q">'),
    (2, "http://e.org/", "<A class=q HREF=http://x.net/es/1>"), (3, "http://x.net/es/1", None), (4, "http://x.net/en/", ""),
    (5, "http://d.org/p", '<a href="http://e.org">'), (6, None, "x"), (7, "foo", "x"), (8, "http://f.org", '<a href="http://e.org">'),
    (9, "https://WWW.Example.com/en/1?q#f", "x"), (10, "ftp://m.example.com/en/2", "x"), (11, "http://example.com#/en/", "x"),
    (12, "http://com/", "x"), (12, "http://com/", "x"), (None, "http://net/fr/", "x"), (13, "://", "x"),
]


def test_url_filter_odd_urls(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = url_filter.filter_urls(pages)
    by = {r["page_id"]: r for r in got.collect()}
    assert got.count() == len(PAGES)
    assert by[9]["host"] == "www.example.com" and by[9]["path"] == "/en/1" and by[9]["rule"] == "www.example.com/en/"
    assert (by[10]["rule"], by[10]["verdict"]) == ("example.com/en/", "block")
    assert (by[11]["host"], by[11]["path"], by[11]["rule"], by[11]["verdict"]) == ("example.com", "", None, "allow")
    assert by[2]["verdict"] == "block" and by[8]["verdict"] == "block" and by[5]["trust"] > 0
    assert by[6]["verdict"] == by[7]["verdict"] == by[13]["verdict"] == "allow" and by[6]["host"] == ""
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_url_filter_scores_are_pagerank(spark):
    rng = random.Random(5)
    links = {(rng.randrange(12), rng.randrange(12)) for _ in range(30)}
    edges = [(f"h{a}", f"h{b}", rng.randint(1, 3)) for a, b in sorted(links) if a != b]
    seeds = {"trust": {"h0": 2, "h1": 1}, "distrust": {"h5": 1}}
    got = {(r["kind"], r["host"]): r["score"] for r in url_filter.propagate(
        spark.createDataFrame(edges, "src string, dst string, n long"),
        spark.createDataFrame([(k, h, w) for k, s in seeds.items() for h, w in s.items()], "kind string, host string, weight long"),
        rounds=6).collect()}
    for kind, seed in seeds.items():
        base = {h: w / sum(seed.values()) for h, w in seed.items()}
        steps = edges if kind == "trust" else [(b, a, n) for a, b, n in edges]
        score = dict(base)
        for _ in range(6):
            new = {}
            for a, b, n in steps:
                new[b] = new.get(b, 0) + 0.85 * score.get(a, 0) * n / sum(m for x, _, m in steps if x == a)
            rest = 1 - sum(new.values())
            score = {h: new.get(h, 0) + rest * base.get(h, 0) for h in {*new, *base}}
        for h, v in score.items():
            assert abs(got.get((kind, h), 0) - v) < 1e-9


def test_url_filter_trust_goes_along_a_long_chain_and_through_a_hub(spark):
    chain = [(f"h{i:02}", f"h{i + 1:02}", 1) for i in range(36)]
    hub = [("h00", f"x{i}", 1) for i in range(200)] + [(f"x{i}", "h00", 1) for i in range(200)]
    seeds = spark.createDataFrame([("trust", "h00", 1), ("distrust", "h36", 1)], "kind string, host string, weight long")

    def scores(edges, tolerance):
        rows = url_filter.propagate(spark.createDataFrame(edges, "src string, dst string, n long"), seeds, tolerance=tolerance)
        return {(r["kind"], r["host"]): r["score"] for r in rows.collect()}

    got = scores(chain, 1e-3)
    assert all(got["trust", f"h{i:02}"] > 0 and got["distrust", f"h{i:02}"] > 0 for i in range(37))
    assert abs(sum(v for (k, _), v in got.items() if k == "trust") - 1) < 1e-9
    near = scores(hub, 5e-2)
    # h00 holds 1 / 1.85 of the mass, its 200 neighbours the rest in equal parts.
    assert abs(near["trust", "h00"] - 1 / 1.85) < 0.05
    assert all(abs(near["trust", f"x{i}"] - 0.85 / 1.85 / 200) < 5e-4 for i in range(200))


def test_url_filter_sql_follows_links(spark):
    # The SQL tells pages by their ids.
    rows = list({r[0]: r for r in PAGES if r[0] is not None}.values())
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, tolerance=5e-2).collect()]
    expected = con.execute("select page_id, host, path, rule, verdict from (" + url_filter.oracle_sql() + ")").fetchall()
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_op5_shards(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op5_sharding"](spark, sf).collect()
    check_shards(rows, docs, 24)
    loads = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(24)]
    assert max(loads) - min(loads) <= 0.1 * sum(loads) / 24


def check_shards(rows, docs, shards):
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        body = (docs[r["doc_id"]] or "").encode()
        assert r["size"] == len(body) + 8 and r["text_crc32"] == zlib.crc32(body) and r["law"] == "bytes"
    for s in range(shards):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))
    assert {r["shard"] for r in rows} <= set(range(shards))


def test_shards_of_a_hot_text_and_small_groups(spark):
    texts = {i: "hot text " * 20 for i in range(400)} | {i: f"text {i // 3} " * 20 for i in range(400, 1000)} | {1000: None, 1001: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("size", F.lit("clash"))
    rows = sharding.shard_report(docs, 5).collect()
    check_shards(rows, texts, 5)
    loads = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(5)]
    assert max(loads) < 1.1 * min(loads)
    where = {}
    for r in rows:
        where.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert all(len(s) == 1 for t, s in where.items() if t and not t.startswith("hot")) and len(where["hot text " * 20]) > 1
    assert sharding.shard_report(docs.limit(0), 5).count() == 0


def test_shards_are_written(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i % 7}" * 9, "x") for i in range(60)], "doc_id long, text string, _x string")
    sharding.write_shards(docs, str(tmp_path / "s"), 3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 60 and back.select("shard").distinct().count() == 3


def test_lines_of_odd_markup():
    html = """<!DOCTYPE html><title>t</title><nav><a>menu</a></nav><div class="side-bar ads">advert</div><![if x]>
      <article><header><h1>Head  &amp; line</h1></header><p><b>one<br>two<p>three&nbsp;four<aside>side</aside><script>x='</p>'</script>
      <form>send<input></form><div id="comments">reader</div><!-- c --><ul><li>five</ul></article><footer>foot</footer>"""
    assert html_text.main_text(html_text.lines_of(html), []) == "Head & line\none two\nthree four\nfive"
    assert html_text.lines_of("") == [] and html_text.lines_of("<p") == []


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        marks = html_text.shared_lines(a, b)
        assert sum(marks) == brute.lcs_length(a, b)
        rest = iter(b)
        assert all(x in rest for x, m in zip(a, marks) if m)


def test_pages_without_article_are_differenced(spark):
    def page(i, body):
        return (i, f"http://s.org/news/{i}", f"<div>Site name</div>{body}<div>All rights reserved</div>")

    rows = [page(1, "<p>First story</p>"), page(2, "<p>Second story</p>"), (3, None, None), (4, "http://lone.org/", "<p>Alone</p>"),
            (5, "http://s.org/news/5", "<article><p>Site name</p></article>"), (6, "http://s.org/zzz", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in html_text.extract_pages(pages).collect()}
    assert got == {i: (u, t, len(t)) for i, u, t in (
        (1, rows[0][1], "First story"), (2, rows[1][1], "Second story"), (3, None, ""), (4, rows[3][1], "Alone"),
        (5, rows[4][1], "Site name"), (6, rows[5][1], ""))}
    assert html_text.extract_pages(pages.limit(0)).count() == 0


def test_op8_keeps_articles_whole(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op8_html_text"](spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = html_text.lines_of(pages[r["page_id"]].split("<article>")[1].split("</article>")[0])
        assert r["text"] == "\n".join(t for t, _ in article) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("ring", [False, True])
def test_rows_see_their_neighbours(spark, ring):
    keys = [None, None, *[i // 3 for i in range(900)]]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, n long")
    dealt, bucket, side, _ = in_order(df, ["k"], before=True, after=True, ring=ring)
    rows = dealt.withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r["n"] for r in rows if r[side] == 0) == list(range(len(keys)))
    buckets = sorted({r[bucket] for r in rows})
    spans = {b: sorted({r["k"] if r["k"] is not None else -1 for r in rows if r[bucket] == b and r[side] == 0}) for b in buckets}
    assert len(buckets) > 10 and all(spans[a][-1] < spans[b][0] for a, b in zip(buckets, buckets[1:]))
    for i, b in enumerate(buckets):
        own = {s: {r["k"] if r["k"] is not None else -1 for r in rows if r[bucket] == b and r[side] == s} for s in (-1, 1)}
        assert own[-1] == ({spans[buckets[i - 1]][-1]} if i or ring else set())
        assert own[1] == ({spans[buckets[i + 1]][0]} if i + 1 < len(buckets) else set())


def test_components_of_random_graphs(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1090)] + [(7, 7)]
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components.component_roots(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}


def test_op9_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    expected = brute.components({d["doc_id"]: brute.simhash(d["text"]) for d in docs})
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op9_simhash"](spark, sf).collect()}
    assert got == expected and len({c for _, c in got.values()}) < len(got)


def _broadcast_plans(df):
    """The plan below each broadcast of an executed frame."""
    lines, out = df._jdf.queryExecution().executedPlan().toString().splitlines(), []
    depth = [len(re.match(r"[\s:+\-]*", x)[0]) for x in lines]
    for i, x in enumerate(lines):
        if "BroadcastExchange" in x:
            end = next((k for k in range(i + 1, len(lines)) if depth[k] <= depth[i]), len(lines))
            out.append("\n".join(lines[i:end]))
    return out


def test_simhash_broadcasts_tiles_and_no_visitors(spark):
    bits = np.random.default_rng(5).integers(-2**63, 2**63, 20_000)
    prints = settle(spark.createDataFrame([(int(b),) for b in bits], "bits long"), "prints")
    links = simhash.fingerprint_links(prints, "bits")
    links.collect()
    sent = _broadcast_plans(links)
    assert sent and not [x for x in sent if "Generate" in x]


def test_simhash_links_of_dense_prints(spark, monkeypatch):
    """Fingerprints within a few bits of each other, in many blocks of one tile."""
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) & (2**64 - 1) for b in base for _ in range(12)}
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "bits long")
    expected = brute.components(dict(enumerate(p % 2**64 for p in signed)))
    for block in (4096, 2):
        monkeypatch.setattr(simhash, "BLOCK", block)
        roots = {r["node"]: r["root"] for r in components.component_roots(simhash.fingerprint_links(frame, "bits")).collect()}
        named = {}
        for i, p in enumerate(signed):
            named.setdefault(roots.get(p, p), set()).add(expected[i][1])
        assert all(len(s) == 1 for s in named.values()) and len(named) == len({c for _, c in expected.values()})


def test_near_duplicates_of_odd_texts(spark):
    rows = [(3, None), (1, ""), (2, " \t\n"), (5, "same text here now"), (4, "SAME  text\nhere now"), (4, "SAME  text\nhere now"),
            (9, "quite another text"), (None, "quite another text"), (None, "alone"), (7, "one"), (8, "word " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"bits": F.lit("b"), "_key": F.lit(1)})
    got = sorted(map(str, [tuple(r) for r in simhash.near_duplicate_report(docs).select("doc_id", "component_id").collect()]))
    assert got == sorted(map(str, [
        (3, 1), (1, 1), (2, 1), (5, 4), (4, 4), (4, 4), (9, 9), (None, 9), (None, None), (7, 7), (8, 8)]))
    kept = simhash.keep_one_per_class(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, [r["doc_id"] for r in kept.collect()])) == sorted(map(str, [1, 4, 9, None, 7, 8]))
    assert simhash.near_duplicate_report(docs.limit(0)).count() == 0


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None), (10**6 + 1, "123 456"), (10**6 + 2, "")], "doc_id long, text string")
    docs = docs.withColumn("rejected", F.lit("mine")).unionByName(odd, allowMissingColumns=True)
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        before, after = {r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"] for r in out.collect()}
        if name == "language_id":
            assert after == {k for k, t in before.items() if t and any(c.isalpha() for c in t)}
        elif name == "near_duplicates":
            classes = brute.components({k: brute.simhash(t) for k, t in before.items()})
            assert after == {c for _, c in classes.values()}
        else:
            leaks = brute.leaks(list(before.items()), [tuple(b) for b in bench])
            assert after == {k for k, v in leaks.items() if not v[4]}
        docs = spark.createDataFrame(out.collect(), out.schema)
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(last) == sizes[-1] and all(len(r["ids"]) == r["n_tokens"] for r in last)
