"""Extraction, sharding, decontamination, licences, search and the pipeline."""

import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from roomfold.llm import dedup, decontaminate, extract, licenses, queries, search, sharding
from roomfold.llm.license_rules import GATE, KINDS, RULES
from tests.compare import connection, difference, spark_rows, sql_rows
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"
WEIGHTS = {"word:plain": 1.0, "word:link": -0.5, "tag:p": -0.05, "tag:li": -0.3, "tag:a": -0.3}


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("only words here", "only words here"), ("<script>var a='<p>x</p>'", ""), ("<p>a<b>c</b>d", "acd"),
    ("<p>a &lt;b&gt; &amp;&nbsp; c\n\n d</p>", "a <b> & c d"), ("<p>one<br>two<p>three", "one two\nthree"),
    ("<nav><a>m n o p</a></nav><p>x y z</p><footer>f f f f</footer>", "x y z"),
    ("<article><header><h1>T t</h1></header><p>x y</p><div class='ad-box'>buy it</div><p>z</p><section id=comments><article>no no no</article></section></article>", "T t\nx y\nz"),
    ("<div class='with-sidebar'><main><p>a b c</p></main></div><aside>q q</aside>", "a b c"),
    ("<form><p>name</p></form><div role=banner>b</div><p>text of it</p><div hidden>h</div><div style='display: none'>h</div>", "text of it"),
    ("<p>unclosed <a href='x'>link</a> and <i title=\"a>b\">more", "unclosed link and more"), ("<!-- <p>x --><p>y</p><!-- open", "y"),
])
def test_main_text_of_small_pages(page, text):
    assert extract.main_text(page, WEIGHTS) == text


def test_region_is_the_best_run():
    draw = random.Random(1)
    for _ in range(200):
        found = [extract.Node(draw.choice(["word:plain", "word:link", "tag:li"]), draw.randrange(4), "", False, False, 0) for _ in range(12)]
        value = [WEIGHTS[n.feature] * (n.words if n.feature[:5] == "word:" else 1) for n in found]
        first, last = extract.region(found, WEIGHTS)
        best = max((sum(value[a:b]) for a in range(13) for b in range(a, 13)), default=0)
        assert sum(value[first:last]) == pytest.approx(max(best, 0))


def test_extraction_takes_the_articles(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    learned = extract.learn(pages)
    assert learned["word:plain"] > 0 > learned["word:nav"] and all(w < 0 for n, w in learned.items() if n[:4] == "tag:")
    got = {r.id: r.text for r in extract.extract(pages, learned).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        blocks = [" ".join(extract.entities.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)
    odd = spark.createDataFrame([(1, None, "t"), (1, None, "t"), (None, "<p>x " + "y " * 300_000, "t")], "page_id long, html string, text string")
    assert sorted(len(r.text) for r in extract.extract(odd, extract.learn(odd)).collect()) == [0, 0, 600_001]
    assert extract.extract(odd.limit(0), {}).count() == 0


def rendezvous(key, shards):
    """The shard with the largest 53 bits of xxhash64 over (text, 32-bit number) chained with seed 42."""
    first = xxhash.xxh64(key.encode(), seed=42).intdigest()
    score = [xxhash.xxh64(s.to_bytes(4, "little"), seed=first).intdigest() >> 11 for s in range(shards)]
    return score.index(max(score))


def test_shards_equal_plain_hashing_and_slots_have_no_gaps(spark):
    texts = ["", None, "é" * 5, "dup", "dup"] + [f"t{i}" for i in range(400)]
    rows = [(i if i else None, t) for i, t in enumerate(texts)] + [(3, "dup")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("slot", F.lit("x")).withColumn("shard", F.lit("y"))
    got = sharding.shards(docs).collect()
    assert len(got) == len(rows)
    assert Counter((r.id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        name = "" if r.id is None else str(r.id)
        assert (r.shard, r.grown_shard) == (rendezvous(name, 40), rendezvous(name, 41))
        assert r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shards(docs.limit(0)).count() == 0


def test_weighted_shards_follow_their_weights_and_move_little(spark, tmp_path):
    keys = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    got = sharding.shards(keys, weights=[1.0, 2.0, 5.0], grown_weight=2.0).collect()
    share = Counter(r.shard for r in got)
    assert all(abs(share[s] / 20_000 - w / 8) < 0.02 for s, w in enumerate((1, 2, 5)))
    moved = [r for r in got if r.shard != r.grown_shard]
    assert all(r.grown_shard == 3 for r in moved) and abs(len(moved) / 20_000 - 0.2) < 0.02
    sharding.write_shards(keys.limit(50), str(tmp_path / "s"), weights=[1.0] * 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 50 and back.where(F.col("_shard") != sharding.place(F.col("doc_id"), [1.0] * 4)).count() == 0
    with pytest.raises(ValueError):
        sharding.place(F.col("doc_id"), [])


def test_contained_items_equal_plain_search(spark):
    draw = random.Random(7)
    say = lambda n: [f"w{draw.randrange(400)}" for _ in range(n)]
    items = [(i, " ".join(say(n))) for i, n in enumerate([1, 2, 3, 4, 5, 6, 9, 20, 40, 57, 130])] + [(50, None), (51, " "), (None, "w1"), (7, None)]
    docs = []
    for k in range(60):
        own = say(draw.choice([0, 3, 40, 900]))
        _, text = items[draw.randrange(11)]
        passage = text.upper().split()
        for _ in range(draw.randrange(3)):
            passage[draw.randrange(len(passage))] = "changed"
        at = draw.randrange(len(own) + 1)
        docs.append((k, " ".join([*own[:at], *passage, *own[at:]])))
    docs += [(90, None), (91, ""), (0, docs[0][1]), (99, " ".join(say(30_000) + items[9][1].split()))]
    a = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contained([d for d in docs if d[1]], [i for i in items if i[0] is not None and i[1]])
    for settings in (decontaminate.Settings(), decontaminate.Settings(block_words=50)):
        rows = decontaminate.contained_items(a, b, settings=settings).collect()
        assert {(r.id, r.item_id): (r.shared, r.n_item) for r in rows} == want
        assert len(rows) == len(want) + sum(1 for i, _ in want if i == 0)
    kept = {r.doc_id for r in decontaminate.clean(a, b).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in want}
    assert decontaminate.contained_items(a, b.limit(0)).count() == decontaminate.contained_items(a.limit(0), b).count() == 0


def plain_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(brute.LOWER))
    places = {p: [i for i in range(len(words)) if words[i:i + len(p.split())] == p.split()] for p in licenses.PHRASES}
    joined = f" {' '.join(words)} "
    found = []
    for n, (priority, weight, label, keyword, regex) in enumerate(RULES):
        if keyword in joined:
            found += [(m.start(), m.end(), priority, n, label, weight) for m in re.finditer(f"(?<= )(?:{regex})(?= )", joined)]
    order = sorted(found, key=lambda d: (d[0], -d[1], -d[2], d[3]))
    kept = [d for i, d in enumerate(order) if not any(e[1] >= d[1] and e[2] >= d[2] for e in order[:i])]
    every = sorted(x for p in places.values() for x in p)
    base = {licenses.PHRASES[p] for p, x in places.items() if x}
    return (len(words), len(every), every[0] if every else None, every[-1] if every else None, ",".join(sorted(base)),
            ",".join(sorted(base | {d[4] for d in kept})), max([d[5] for d in kept], default=0.0)), kept


LICENCES = [
    None, "", "no words of it", "MIT License. mit  license, GNU General-Public license v3", "Licensed under CC BY-NC 4.0.", "CC\nBY", "accident by",
    "Licensed under the Apache License, Version 2.0. See http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: GPL-2.0-or-later",
    "This work is licensed under the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and so on. The MIT license",
    "émit license", "mit licenseé", "2-clause BSD license and 3-clause BSD, BSD-style license", "Copyright 2020 A. B. All rights reserved. proprietary license",
    "creative commons attribution sharealike 4.0 international license " * 40, "x " * 50_000 + "apache license", "public domain is in the public domain"]


def test_licence_scan_equals_plain_rules(spark):
    rows = list(enumerate([*LICENCES, "CC BY"]))
    docs = spark.createDataFrame([*rows, (5, "CC\nBY"), (None, "mit license")], "doc_id long, text string").withColumn("labels", F.lit(1))
    got = licenses.scan(docs).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        text = "mit license" if r.id is None else rows[r.id][1]
        want, kept = plain_scan(text)
        own = (r.n_words, r.n_base, r.first_word, r.last_word, ",".join(sorted(set(r.base))),
               ",".join(sorted({*r.base, *(d.label for d in r.detections)})), max([d.confidence for d in r.detections], default=0.0))
        assert own == want and [(d.start, d.end, d.rule) for d in r.detections] == [(d[0], d[1], d[3]) for d in kept]
    assert licenses.scan(docs.limit(0)).count() == 0
    plan = licenses.scan(docs)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_rules_are_gated_and_compile():
    assert len(RULES) > 200 and {r[0] for r in RULES} == {p for p, _ in KINDS.values()}
    for _, _, _, keyword, regex in RULES:
        re.compile(regex)
        assert any(stem in keyword for stem in GATE), keyword


def plain_search(docs, asked, k=10):
    tf = {i: Counter(brute.words(t)) for i, t in docs}
    df = Counter(w for c in tf.values() for w in c)
    length = {i: sum(c.values()) for i, c in tf.items()}
    average = sum(length.values()) / len(docs)
    out = {}
    for q, text in asked:
        scores = defaultdict(float)
        for w in set(brute.words(text)):
            for i, c in tf.items():
                if c[w]:
                    scores[i] += math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (
                        c[w] + 1.2 * (0.25 + 0.75 * length[i] / average))
        out[q] = sorted(((round(-s, 9), i) for i, s in scores.items()))[:k]
    return out


@pytest.mark.parametrize("settings", [search.Settings(), search.Settings(k=3, shard_bytes=3_000, block=4, pass_terms=60)])
def test_search_equals_all_scores(spark, settings):
    draw = random.Random(9)
    docs = [(i, " ".join(f"w{int(draw.paretovariate(0.6)) % 300}" for _ in range(draw.randrange(40)))) for i in range(200)]
    docs += [(300 + i, docs[i][1].upper()) for i in range(20)] + [(400, None), (401, " ")]
    asked = docs[::7] + [(900, "nothing known"), (901, None)]
    a = spark.createDataFrame([*docs, (None, "w1 w2")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    b = spark.createDataFrame([*asked, (None, "w1"), asked[0]], "query_id long, text string")
    got = defaultdict(list)
    for r in sorted(search.top_k(a, b, settings=settings).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((round(-r.score, 9), r.id))
        assert r.rank == len(got[r.query_id])
    for q, want in plain_search(docs, asked, settings.k).items():
        assert [i for _, i in got[q]] == [i for _, i in want] and all(abs(x - y) < 1e-6 for (x, _), (y, _) in zip(got[q], want))
    assert search.top_k(a.limit(0), b).count() == search.top_k(a, b.limit(0)).count() == 0


def test_search_leaves_blocks_unopened():
    rare = [("x " + "a " * (i % 5)) if i % 500 else "needle in x" for i in range(4000)]
    parts = search.Index.build(list(range(4000)), rare)
    index = search.Index(*parts, 2.0, search.Settings())
    terms = search.np.unique(search.hashed_words(["needle x"])[0])
    opened = []
    ranges = search._ranges
    try:
        search._ranges = lambda a, b: opened.append(int((b - a).sum())) or ranges(a, b)
        index.top(terms, search.np.array([5.0, 5.0]), 5)
    finally:
        search._ranges = ranges
    assert sum(opened[1:]) < 0.5 * len(index.doc)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(spark, name):
    assert difference(spark_rows(queries.QUERIES[name](spark, SMALL)), sql_rows(connection(SMALL), queries.ORACLES[name])) is None


def test_pipeline_stages_keep_clean_documents_and_columns(spark, tmp_path):
    draw = random.Random(4)
    say = lambda n: " ".join(f"{draw.choice('bcdfgl')}{draw.choice('aeiou')}{draw.choice('mnrst')}{draw.choice('aeiou')}{draw.choice(['', 'n', 's'])}" for _ in range(n)) + "."
    texts = [say(60 + i % 9) for i in range(80)]
    item = say(30)
    rows = [(i, t, "aa", "s", len(t)) for i, t in enumerate(texts)]
    planted = {100: texts[3], 101: texts[5].replace(texts[5].split()[30], "other", 1), 102: texts[7] + " " + item, 103: " ".join(w + "***" for w in texts[9].split()),
               104: None, 105: "", 106: "12 34 !"}
    rows += [(i, t, "aa", "s", len(t or "")) for i, t in planted.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, step in corpus_pipeline.STAGES:
        before = docs
        docs = step(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert name == "encoding" or docs.columns == before.columns
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    whole = set(range(80))
    assert whole <= seen["quality"] and not seen["quality"] & {103, 104, 105}
    assert seen["language"] == seen["quality"] - {106}
    want = brute.components([(i, t) for i, t, *_ in rows if i in seen["language"]], 5, 80)
    assert seen["near_dedup"] == {i for i, c in want.items() if i == c} and {100, 101} & seen["near_dedup"] == set()
    assert seen["decontamination"] == seen["near_dedup"] - {102} and seen["encoding"] == seen["decontamination"]
    assert docs.where("not round_trip").count() == 0
    assert spark.createDataFrame([], docs.schema).count() == 0


def test_dedup_stage_default_is_five_words_at_eighty():
    assert (dedup.Settings().words, dedup.Settings().similarity) == (5, 80)


def test_every_operator_has_its_query():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))


def test_text_of_the_region_outside_a_touched_article_stays():
    page = "<div>one two three four five six</div><article><p>a card</p></article><div>seven eight nine ten</div>"
    assert extract.main_text(page, WEIGHTS) == "one two three four five six\na card\nseven eight nine ten"


@pytest.mark.parametrize("page, text", [
    ("<article><p>a b</p><h2 id='related-work'>Related work</h2><p>c d</p><h2 id=search-methods>Search</h2><section id='discussion'><p>" + "w " * 30 + "</p></section>"
     "<div class='notice'><p>mind the gap here</p></div></article>", "a b\nRelated work\nc d\nSearch\n" + ("w " * 30).strip() + "\nmind the gap here"),
    ("<div class='has-sidebar'><p>a b c d</p></div>", "a b c d"), ("<div class='page no-sidebar'><p>a b c d</p></div>", "a b c d"),
    ("<div class='sidebar-layout'><nav><a>m n</a></nav><p>" + "w " * 30 + "</p></div><p>x</p>", ("w " * 30).strip() + "\nx"),
    ("<p>" + "w " * 30 + "</p><div class=sidebar><p>q q q</p></div>", ("w " * 30).strip()),
    ("<article><p>a b</p><div class=comments><p>" + "w " * 60 + "</p></div></article>", "a b"),
])
def test_everyday_names_do_not_drop_text(page, text):
    assert extract.main_text(page, WEIGHTS) == text


def test_items_of_one_shingle_are_found_at_every_place():
    settings = decontaminate.Settings()
    texts = [f"a{i} b{i} c{i} d{i} e{i} f{i}" for i in range(1500)]  # two shingles: the item's is the first or the last
    for cut in (slice(0, 5), slice(1, 6)):
        items = [" ".join(t.split()[cut]) for t in texts]
        found = decontaminate.find(texts, decontaminate.build_classes(list(range(1500)), items, settings), settings)
        assert sorted(found) == [(i, i, 1, 1) for i in range(1500)]


LONG = " ".join(f"w{i}" for i in range(200))


@pytest.mark.parametrize("page, text", [
    (f"<article><p>a b</p><div class='ad'><p>{LONG}</p></div><p>c</p></article>", "a b\nc"),
    (f"<article><p>a b</p><div class='sidebar'>{LONG}</div><div class='share-buttons'>{LONG}</div><div role=contentinfo>{LONG}</div></article>", "a b"),
    (f"<article><p>{LONG}</p></article><section><h2>Comments</h2><article><p>{LONG}</p></article><article>no</article></section>", LONG),
    (f"<article><p>a b c</p><section><h3>3 Comments</h3><article><p>{LONG}</p></article></section><p>d</p></article>", "a b c\nd"),
    (f"<article><p>a b c</p><h2>Leave a reply</h2><div>{LONG}</div></article><div class='comment-list'><article>{LONG}</article></div>", "a b c"),
    (f"<article><h1>Comments on the law</h1><p>{LONG}</p></article>", f"Comments on the law\n{LONG}"),
    (f"<article><p>a</p><div class='related-work'>{LONG}</div><div class='related-posts'>x y</div></article>", f"a\n{LONG}"),
])
def test_boilerplate_inside_articles_goes_whatever_its_length(page, text):
    assert extract.main_text(page, WEIGHTS) == text


def test_pages_of_many_tags_take_linear_time():
    began = time.time()
    page = "<article>" + "<div class='ad'>buy it</div><p>w</p>" * 50_000 + "</article>"
    assert extract.main_text(page, WEIGHTS) == "\n".join("w" * 50_000)
    assert extract.main_text("<div class=ad>" * 50_000 + "a b c" + "</div>" * 50_000, WEIGHTS) == "a b c"
    assert extract.main_text("<div>" * 50_000 + "a b c" + "</div>" * 50_000 + "</i>" * 50_000, WEIGHTS) == "a b c"
    assert time.time() - began < 20


def test_kept_columns_may_clash(spark):
    pages = spark.createDataFrame([(1, "<p>a b</p>", "t", 2, "u")], "page_id long, html string, text string, id int, url string")
    found = extract.extract(pages, {}, keep=["url", "text", "id"])
    assert found.columns == ["id", "url", "text"] and tuple(found.collect()[0]) == (1, "u", "a b")
