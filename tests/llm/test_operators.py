"""The training-data operators against brute force and on odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.llm import chat, common, decontaminate, mixing, ngram_join, quality, queries, sharding, substring_dedup, token_counts, toxicity, url_filters

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(5)
VOCABULARY = [a + b for a in "bdfgklmn" for b in "aeiou"]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def corpus():
    base = [prose(n, n) for n in (3, 4, 5, 12, 60, 80, 120, 200, 400)]
    near = [base[5].replace("ba", "bo", 1), base[5] + " extra words", " ".join(base[8].split()[10:])]
    long = prose(6000, 1)
    texts = [*base, *near, base[5], base[5], None, "", " \n\t ", "one", long, long + " tail", "x" * 20000, "A\r\nb\x0bc\x0cd", "Ünï <turn user> & ünï &lt;"]
    return [(i, t, "en", (f"s{i % 3}" if i % 5 else None), len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return spark.createDataFrame([*rows, rows[4]], DOCS).withColumn("n_words", F.lit("clash")).withColumn("score", F.lit(1)).withColumn("size", F.lit("clash")).cache()


def empty(spark, ddl=DOCS):
    return spark.createDataFrame([], ddl)


def words(text):
    return re.findall("[^\x20\x09-\x0D]+", text or "")


def shingles(text, n=5):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def classes(rows):
    """Components by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_ngram_join_against_all_pairs(spark, docs):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs).collect()}
    assert got == {(i, n, c) for i, (n, c) in classes({r.doc_id: r.text for r in docs.collect()}.items()).items()}


def test_ngram_join_chains_and_tiles(spark, monkeypatch):
    """A chain of texts that only links step by step, and many texts around one passage, with small groups and blocks."""
    monkeypatch.setattr(ngram_join, "GATHERED", 3)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "KEYS", 0)  # all links by tiles
    long = prose(300, 3).split()
    chain = [" ".join(long[10 * i : 10 * i + 100]) for i in range(15)]
    shared = prose(30, 9)
    around = [f"{shared} {prose(4 + i % 5, 100 + i)}" for i in range(25)]
    rows = list(enumerate(chain + around))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows)


def test_ngram_join_odd_tables(spark):
    assert ngram_join.ngram_join(empty(spark)).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (1, None)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in ngram_join.ngram_join(rows).collect()) == [(-1, 2, None), (1, 0, 1)]
    kept = ngram_join.one_of_each(spark.createDataFrame([(2, "a b c d e", "x"), (1, "a b c d e", "y"), (3, "", "z")], "doc_id long, text string, extra string"))
    assert kept.columns == ["doc_id", "text", "extra"] and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_one_of_each_tells_rows_by_id_and_text(spark):
    """Different texts under one id stay; copies without id go; of a group the smallest id stays, whatever the partitions."""
    a, b, c, d = (prose(60, 20 + i) for i in range(4))
    rows = [(1, a), (1, b), (1, b), (2, a + " tail"), (None, c), (None, c), (None, c + " tail"), (7, d + " tail"), (None, d), (5, d), (None, ""), (None, None), (9, None), (9, "")]
    for parts in (1, 4):
        kept = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        left = [(r.doc_id, r.text) for r in kept]
        assert sum(x[1] in (c, c + " tail") for x in left) == 1
        assert sorted(map(str, (x for x in left if x[1] not in (c, c + " tail")))) == sorted(map(str, [(1, a), (1, b), (5, d), (None, ""), (None, None), (9, None), (9, "")]))


def test_ngram_join_texts_of_one_id(spark):
    """Rows with one id are one document: what links with one of its texts links with the others."""
    a, b, c = prose(60, 31), prose(60, 32), prose(60, 33)
    rows = [(9, a), (9, b), (5, a + " tail"), (7, b + " tail"), (8, c), (9, None), (None, c)]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[9, 56] == got[5, 57] == got[7, 57] == 5 and got[8, 56] == 8 and got[None, 56] is None


def test_ngram_join_common_shingle(spark):
    """Many texts around one passage: what tiles leave open grows with the links, not with the square of the group."""
    passage = prose(12, 70)

    def left_open(count):
        rows = [(i, f"{passage} {prose(20, 10_000 + i)}") for i in range(count)] + [(count + i, f"{prose(40, 3)} end {i}") for i in range(40)]
        table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.xxhash64("text"))
        sets = ngram_join.sketched(table, 5).filter("bucket is null").select("sid", "key", "n", "bits", F.col("sid").alias("class")).cache()
        tiles = ngram_join.tiled(ngram_join.shared(ngram_join.prefixes(table, np.zeros(ngram_join.WIDTH, np.int64), 5)), sets)
        return ngram_join.open_pairs(tiles, sets, False).count(), ngram_join.open_pairs(tiles, sets, True).count()

    (small, few), (large, more) = left_open(1500), left_open(3000)
    assert 780 <= small <= large <= 1.2 * small and 20 <= few <= more <= 200


def test_bitmaps_bound_the_overlap():
    sets = [next(iter(ngram_join.shingle_sets(pa.array([prose(n, s)])))) for s, n in enumerate((6, 9, 20, 30, 40, 75, 80, 200, 260))]
    maps = ngram_join.Bitmaps([ngram_join.bitmap(s) for s in sets])
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)):
                differ = int(maps.differ(np.array([i]), np.array([j]))[0])
                assert len(np.intersect1d(a, b)) <= (len(a) + len(b) - differ) / 2 and (differ == 0) == (i == j)


def test_url_parts_and_given_rules(spark):
    rows = [(1, "http://A.Example.com/en/x?y#z"), (2, "https://www.example.com/en/"), (3, "x.net/es/"), (4, None), (5, "ftp://net/es/"), (6, "http://notnet/es/"), (7, "http://a.net/fr/1"), (8, "http://com"), (9, "a://b.com?x=://c/d")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("verdict", F.lit(3))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge_urls(pages).collect()}
    assert got[1] == ("a.example.com", "/en/x", "example.com/en/", "block") and got[2][2:] == ("www.example.com/en/", "allow")
    assert got[3] == ("", "", None, "allow") and got[4] == ("", "", None, "allow") and got[5][2:] == ("net/es/", "block")
    assert got[6][2] is None and got[7][3] == "block" and got[8] == ("com", "", None, "allow") and got[9][:2] == ("b.com", "")
    assert url_filters.judge_urls(empty(spark, "page_id long, url string")).count() == 0


def test_url_rules_against_enumeration(spark):
    """Mined rules and matches, against all combinations of tokens counted in Python."""
    from itertools import combinations

    r = random.Random(2)
    hosts, paths = ["a.net", "b.net", "c.com", "d.org", "example.com", "m.example.org"], ["/en/1", "/es/2.html", "/fr/3?q=1", "/de/4#x"]
    urls = [f"http://{r.choice(hosts)}{r.choice(paths)}" for _ in range(300)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {x.page_id: x.verdict for x in url_filters.judge_urls(pages).collect()}
    host, path = url_filters.url_parts(F.col("url"))
    seen = pages.select("page_id", url_filters.url_tokens(F.col("url"), host, path).alias("t"), url_filters.rule_column(host, path)["verdict"].alias("v")).collect()
    labelled = [(frozenset(x.t), x.v) for x in seen if x.v]
    rules = {}
    for n in (1, 2, 3):
        for tokens in {c for t, _ in labelled for c in combinations(sorted(t), n)}:
            held = [v for t, v in labelled if set(tokens) <= t]
            for v in ("allow", "block"):
                support, sure = held.count(v) / len(labelled), held.count(v) / len(held)
                if support >= url_filters.MIN_SUPPORT and sure >= url_filters.MIN_CONFIDENCE:
                    rules[tokens, v] = (sure, support)
    kept = {k: x for k, x in rules.items() if not any(v == k[1] and len(t) < len(k[0]) and set(t) <= set(k[0]) and y[0] >= x[0] for (t, v), y in rules.items())}
    for x in seen:
        if not x.v:
            fits = sorted((-s[0], -s[1], len(t)) + (v,) for (t, v), s in kept.items() if set(t) <= set(x.t))
            best = {f[3] for f in fits if f[:3] == fits[0][:3]} if fits else {"allow"}
            assert got[x.page_id] in best


def test_url_rules_from_far_host_labels(spark):
    """A label left of the third from the right is a token, and gives an ungoverned url its verdict."""
    urls = [f"http://casino.x.blog{i}.net/es/{i}" for i in range(30)] + [f"http://a.y.site{i}.com/" for i in range(30)] + ["http://casino.z.q.org/n"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    host, path = url_filters.url_parts(F.col("url"))
    assert "host3:casino" in pages.filter("page_id = 60").select(url_filters.url_tokens(F.col("url"), host, path).alias("t")).first().t
    got = {r.page_id: r for r in url_filters.judge_urls(pages).collect()}
    assert got[60].verdict == "block"


def test_url_rules_from_a_template_of_many_tokens(spark):
    """Tokens that always come together are mined as one, and each of them can fit an ungoverned url."""
    fixed = "/".join(f"seg{chr(97 + i)}" for i in range(14)) + "?" + "&".join(f"k{chr(97 + i)}=1" for i in range(14))
    urls = [f"http://a{i}.net/es/{fixed}" for i in range(40)] + [f"http://b{i}.com/home" for i in range(40)] + ["http://x.org/segc", "http://y.org/other?kb=2", "http://z.org/home", "http://q.org/none"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filters.judge_urls(pages).collect()}
    assert [got[i] for i in (0, 40, 80, 81, 82, 83)] == ["block", "allow", "block", "block", "allow", "allow"]


def test_contamination_spans_and_blocks(spark, docs):
    tests = spark.createDataFrame([(1, prose(30, 60)), (2, "Ünï TURN"), (3, None), (4, "..."), (5, prose(120, 120)[:200]), (5, prose(60, 60))], "item_id long, text string")
    whole = decontaminate.contamination(docs, tests)
    parts = decontaminate.contamination(docs.dropDuplicates(["doc_id"]), tests, block_bytes=100)
    a = {r.doc_id: r for r in decontaminate.digest(whole).collect()}
    b = {r.doc_id: r for r in decontaminate.digest(parts).collect()}
    assert a == b and any(r.contaminated for r in a.values()) and not all(r.contaminated for r in a.values())
    for r in whole.filter("size(items) > 0").join(docs.select("doc_id", "text"), "doc_id").collect():
        for span in r.byte_spans:
            hit = r.text.encode()[span.start : span.end].decode()
            assert not re.match(r"^[\x00-\x2F]|[\x00-\x2F]$", hit)
    assert a[0].n_words == 3 and a[0].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert decontaminate.contamination(empty(spark), tests).count() == 0
    assert decontaminate.contamination(docs, empty(spark, "item_id long, text string")).filter("size(items) > 0").count() == 0
    left = decontaminate.drop_contaminated(docs, tests)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, r in a.items() if not r.contaminated}


def test_contamination_blocks_keep_every_row(spark):
    """One automaton and many, on repeated rows, null ids, an id with several texts, and hits of two items side by side."""
    one, two = prose(12, 1), prose(11, 2)
    texts = [f"x {one} y", f"x {one} y", "clean text", f"{one}, {two}!", f"{two} {one} {two}", None, ""]
    rows = [*((i, t) for i in (1, None) for t in texts), (2, one), (2, one), (3, "clean text"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tests = spark.createDataFrame([(i, t) for i, t in enumerate([one, two, prose(40, 3), prose(40, 4), "short item"])], "item_id long, text string")
    whole, parts = ([tuple(map(str, r)) for r in decontaminate.contamination(docs, tests, block_bytes=b).collect()] for b in (1 << 20, 100))
    assert sorted(whole) == sorted(parts) and len(parts) == len(rows)
    n_hit = sorted((str(r.doc_id), r.n_words, r.n_hit) for r in decontaminate.digest(decontaminate.contamination(docs, tests, block_bytes=100)).collect())
    force = {t: (len(words(t)), 12 * (t or "").count(one) + 11 * (t or "").count(two)) for _, t in rows}
    assert n_hit == sorted((str(i), *force[t]) for i, t in rows)


def test_mix_targets_and_totals(spark):
    r = random.Random(3)
    rows = [(i, prose(r.randint(1, 200), i), f"s{min(i % 9, 4)}" if i % 17 else None) for i in range(3000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(table).toPandas()
    got["source"] = got["source"].fillna("~")  # the last in order
    sizes = got.groupby("source")["size"].sum()
    at = {s: (2 * sizes[s], (5, 2, 1)[i % 3]) for i, s in enumerate(sorted(sizes.index))}
    low, high, want = 0.0, 1e9, 1.5 * sizes.sum()
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(c, level * w) for c, w in at.values()) < want else (low, level)
    for s, own in got.groupby("source"):
        goal = own["target"].iloc[0]
        cap, weight = at[s]
        assert goal == pytest.approx(min(cap, level * weight), rel=1e-6)
        assert abs(own["taken"].sum() - goal) <= 2 * own["size"].max()
        times = goal / own["size"].sum()
        assert abs(own["copies"].sum() - times * len(own)) <= 2 and set(own["copies"]) <= {int(times), int(times) + 1}
    assert (got["taken"] <= 2 * got["size"]).all()
    again = mixing.mix_sources(table.repartition(5)).toPandas()
    assert sorted(map(tuple, got[["doc_id", "copies"]].values)) == sorted(map(tuple, again[["doc_id", "copies"]].values))


def test_mix_odd_rows(spark, docs):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == docs.count() and all(r.taken <= 2 * r.size for r in got)
    assert mixing.mix_sources(empty(spark)).count() == 0
    nothing = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix_sources(nothing).collect()] == [0, 0]
    copies = {(r.doc_id, r.size): r.copies for r in got}
    mixed = mixing.mixture(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(copies[r.doc_id, r.size] for r in got)


def test_flight_keeps_both_totals():
    r = np.random.default_rng(1)
    p, w, g, s = r.random(500), r.integers(0, 50, 500), r.integers(0, 4, 500), r.integers(-(2**62), 2**62, 500)
    out = mixing.flight(p, w, g, s)
    for k in range(4):
        own = g == k
        assert ((out[own] > 0) & (out[own] < 1)).sum() <= 2
        assert out[own].sum() == pytest.approx(p[own].sum()) and (out[own] * w[own]).sum() == pytest.approx((p[own] * w[own]).sum())


def test_reply_trees(spark):
    rows = [("a", 1, None, "user", "hi", 0.0), ("a", 2, 1, "assistant", "bad", 1.0), ("a", 3, 1, "assistant", "good <b> & </turn>", 3.0), ("a", 4, 3, "user", "thx", 0.0), ("b", 1, 99, None, None, 0.0), (None, 5, None, "user", "n", None)]
    tree = spark.createDataFrame(rows, "conv_id string, node long, parent long, role string, text string, score double")
    got = {(r.conv_id, r.branch): r for r in chat.format_trees(tree, branches=2).collect()}
    best, second = got["a", 1], got["a", 2]
    assert best.score == 3.0 and best.n_turns == 3 and second.n_turns == 2 and got["b", 1].n_turns == 1 and got[None, 1].n_turns == 1
    assert [best.formatted[s.start : s.end] for s in best.loss] == ["good &lt;b&gt; &amp; &lt;/turn&gt;"]
    back = spark.createDataFrame([(best.formatted,)], "f string").select(chat.read_back(F.col("f")).alias("t")).first().t
    assert [(x.role, x.text) for x in back] == [("user", "hi"), ("assistant", "good <b> & </turn>"), ("user", "thx")]
    assert chat.format_trees(empty(spark, tree.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))).count() == 0


def test_reply_trees_with_cycles_and_repeated_nodes(spark):
    """Nodes on a cycle or hanging from one are on no path; the sound ones, long chains included, come out; a node's least row stands."""
    rows = [("x", 1, 2, "user", "a", 0.0), ("x", 2, 1, "user", "b", 0.0), ("x", 3, 2, "user", "hangs", 0.0), ("x", 9, 9, "user", "self", 0.0), ("x", 10, None, "user", "root", 0.0), ("x", 11, 10, "assistant", "leaf", 0.0)]
    rows += [("y", i, i - 1 if i else None, "user", f"t{i}", 1.0) for i in range(70)] + [("y", 5, 4, "user", "t5 again", 9.0)]
    rows += [("z", 1, 2, "user", "a", 0.0), ("z", 2, 3, "user", "b", 0.0), ("z", 3, 1, "user", "c", 0.0), ("w", None, None, "user", "no node", 0.0)]
    tree = spark.createDataFrame(rows, "conv_id string, node long, parent long, role string, text string, score double").withColumn("leaf", F.lit("clash")).withColumn("c", F.lit(1))
    got = {r.conv_id: r for r in chat.format_trees(tree, branches=5).collect()}
    assert set(got) == {"x", "y"} and got["x"].n_turns == 2 and got["y"].n_turns == 70 and got["y"].score == 70.0
    assert "t5 again" not in got["y"].formatted and "hangs" not in got["x"].formatted
    digest = chat.digest(chat.format_trees(tree).withColumn("turns", F.lit("clash"))).collect()
    assert sorted(r.n_turns for r in digest) == [2, 70]


def test_thread_orders_ties_and_long_conversations(spark):
    rows = [(1, i // 2, "user" if i % 3 else "assistant", f"t{i} &amp;") for i in range(301)] + [(2, 0, None, None), (2, None, "user", "first")] + [(3, 0, "user", "same")] * 2
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digest(chat.format_trees(chat.thread(table))).collect()}
    order = sorted((t for c, *t in rows if c == 1), key=lambda t: t)
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in order).encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256("".join(x for _, r, x in order if r == "assistant").encode()).hexdigest()
    assert got[2].n_turns == 2 and got[3].n_turns == 2


def test_digest_reads_the_loss_mask(spark):
    """What is learnt is cut out of the output by the mask: an empty or shifted mask gives another digest."""
    rows = [(1, 0, "user", "q <&>"), (1, 1, "assistant", "a <b> &amp; </turn>"), (1, 2, "user", "ü"), (1, 3, "assistant", ""), (1, 4, "assistant", "end é")]
    whole = chat.format_trees(chat.thread(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).cache()
    said = "a <b> &amp; </turn>end é"
    got = chat.digest(whole).first()
    assert (got.loss_chars, got.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    emptied = chat.digest(whole.withColumn("loss", F.slice("loss", 1, 0))).first()
    assert emptied.loss_chars == 0 and emptied.loss_sha256 == hashlib.sha256(b"").hexdigest() and emptied.turns_sha256 == got.turns_sha256
    shifted = F.transform("loss", lambda x: F.struct((x["start"] + 1).alias("start"), (x["end"] + 1).alias("end")))
    assert chat.digest(whole.withColumn("loss", shifted)).first().loss_sha256 != got.loss_sha256
    spans = whole.first()
    assert [spans.formatted[x.start : x.end] for x in spans.loss] == ["a &lt;b&gt; &amp;amp; &lt;/turn&gt;", "", "end é"]


def test_branches_ranked_before_their_paths_are_listed(spark):
    """Scores of all paths against a plain walk, in a tree with many leaves."""
    r = random.Random(6)
    rows = [("t", 0, None, "user", "n0", 0.5)] + [("t", i, r.randrange(max(0, i - 9), i), r.choice(["user", "assistant"]), f"n{i}", r.randrange(8) / 2) for i in range(1, 120)]
    parent, score = {x[1]: x[2] for x in rows}, {x[1]: x[5] for x in rows}

    def path(i):
        return [] if i is None else [*path(parent[i]), i]

    leaves = set(parent) - set(parent.values())
    want = sorted(((-sum(score[n] for n in path(i)), i) for i in leaves))[:3]
    tree = spark.createDataFrame(rows, "conv_id string, node long, parent long, role string, text string, score double")
    got = sorted(chat.format_trees(tree, branches=3).collect(), key=lambda x: x.branch)
    assert [(x.score, x.leaf, x.n_turns) for x in got] == [(-s, i, len(path(i))) for s, i in want]
    assert [re.findall(r"n\d+", x.formatted) for x in got] == [[f"n{n}" for n in path(i)] for _, i in want]


def removed_by_force(texts, n):
    all_words = [words(t) for t in texts]
    seen = {}
    for w in all_words:
        for i in range(len(w) - n + 1):
            seen[tuple(w[i : i + n])] = seen.get(tuple(w[i : i + n]), 0) + 1
    out = []
    for w in all_words:
        gone = set()
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone.update(range(i, i + n))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize(("window", "anchor"), [(35, 8), (6, 2), (3, 3), (150, 8), (300, 8)])
def test_substring_dedup_against_all_windows(spark, docs, window, anchor):
    rows = docs.collect()
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.substring_dedup(docs, window, anchor).collect())
    assert got == sorted((r.doc_id, *x) for r, x in zip(rows, removed_by_force([r.text for r in rows], window), strict=True))


def test_substring_dedup_odd_tables(spark):
    assert substring_dedup.substring_dedup(empty(spark)).count() == 0
    loop = "a b " * 200
    got = substring_dedup.substring_dedup(spark.createDataFrame([(1, loop), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r.n_words, r.n_removed) for r in got) == [(0, 0), (400, 400)]


@pytest.mark.parametrize("gathered", [1, 1 << 17])
def test_substring_dedup_long_windows_and_hot_anchors(spark, monkeypatch, gathered):
    """Copies longer than a byte can tell, and one passage in many texts, held whole or passing in pieces."""
    monkeypatch.setattr(substring_dedup, "GATHERED", gathered)
    long, passage = prose(700, 41), prose(60, 42)
    texts = [long, long, *(f"{prose(20 + i % 3, 500 + i)} {passage} {prose(15, 800 + i % 7)}" for i in range(60))]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for window in (35, 140, 300):
        got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.substring_dedup(table, window).collect())
        assert got == [(i, *x) for i, x in enumerate(removed_by_force(texts, window))]
    with pytest.raises(ValueError):
        substring_dedup.substring_dedup(table, 40_000)


def test_substring_dedup_hot_anchors_by_the_words_beside(spark, monkeypatch):
    """Anchors with more classes than a shard takes are dealt by their neighbours, and lose nothing by it."""
    monkeypatch.setattr(substring_dedup, "SHARD_SEGMENTS", 3)
    passage, left, right = prose(8, 60), [prose(27, 61 + i) for i in range(4)], [prose(27, 71 + i) for i in range(4)]
    r = random.Random(9)
    texts = []
    for _ in range(80):
        a, b, k = r.choice(left).split(), r.choice(right).split(), r.randrange(28)
        texts.append(" ".join([*prose(9, r.randrange(10**6)).split(), *a[27 - k :], *passage.split(), *b[: 27 - k], *prose(9, r.randrange(10**6)).split()]))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for window in (35, 20, 9):
        got = sorted((x.doc_id, x.n_words, x.n_removed, x.kept) for x in substring_dedup.substring_dedup(table, window).collect())
        assert got == [(i, *x) for i, x in enumerate(removed_by_force(texts, window))]


def test_substring_dedup_is_judged_by_the_index(spark, docs, monkeypatch):
    """Without the index's reports nothing is removed, and hashes that say too much don't remove a word."""
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted(x[1] for x in removed_by_force([t for _, t in rows], 35))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    nothing = np.empty(0, np.int64)
    monkeypatch.setattr(substring_dedup, "repeated", lambda *_: (nothing, nothing, nothing))
    assert substring_dedup.substring_dedup(table).agg(F.sum("n_removed")).first()[0] == 0 < sum(want)
    monkeypatch.undo()
    # Two different segments under one anchor and hash: read as two occurrences, found to differ.
    a, b, passage = prose(30, 1), prose(30, 2), prose(8, 3)
    monkeypatch.setattr(substring_dedup, "segment_hashes", lambda hashes, start, end, at: np.ones(len(start), np.uint64))
    monkeypatch.setattr(substring_dedup, "anchors", lambda offsets, hashes, window, anchor: (np.array([0, 38]), np.ones(2, np.uint64), np.array([0, 38]), np.array([38, 76])))
    two = spark.createDataFrame([(1, f"{passage} {a}"), (2, f"{passage} {b}")], "doc_id long, text string").coalesce(1)
    assert [r.n_removed for r in substring_dedup.substring_dedup(two).collect()] == [0, 0]


def test_wavelet_matrix_ranks():
    r = np.random.default_rng(0)
    symbols = r.integers(0, 37, 1000)
    m = substring_dedup.WaveletMatrix(symbols, 37)
    start = m.follow(np.arange(37), np.zeros(37, np.int64))
    for place in (0, 1, 63, 64, 65, 500, 1000):
        ranks = m.follow(np.arange(37), np.full(37, place)) - start
        assert ranks.tolist() == np.bincount(symbols[:place], minlength=37).tolist()


def test_sharding_law_and_least_moves(spark, docs):
    rows = [(i, "x" * (i * 7 % 90)) for i in range(2500)] + [(i, "same") for i in range(2500, 4000)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.reshard(table).toPandas()
    counts = got.groupby("shard").size()
    assert len(counts) == 24 and counts.max() - counts.min() <= 1
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    assert (got["text_crc32"] == [zlib.crc32(dict(rows)[i].encode()) for i in got["doc_id"]]).all()
    sizes = {s: sorted(own["size"]) for s, own in got.groupby("old_shard")}
    assert got[got["moved"]]["size"].sum() == least_bytes(sizes, 24)
    odd = sharding.reshard(docs).toPandas()
    assert len(odd) == docs.count() and odd.groupby("shard").size().max() <= 2
    nothing = odd[odd["doc_id"] == 14].iloc[0]
    assert nothing["size"] == 8 and nothing["text_crc32"] == 0
    assert sharding.reshard(empty(spark)).count() == 0


def test_sharding_carries_clashing_columns(spark):
    """Columns with the names of results give way, all others are carried, whatever the stage calls its own."""
    names = ["lang", "edge", "moved", "below", "gives", "from", "low", "high", "new_shard", "law", "text_crc32", "grown_shard", "old_shard", "tied", "rank", "size", "shard", "slot", "a.b"]
    table = spark.createDataFrame([(i, f"t{i}", *(f"{c}{i}" for c in names)) for i in range(60)], ", ".join(["doc_id long, text string", *(f"`{c}` string" for c in names)]))
    got = sharding.reshard(table, shards=5, carry=tuple(table.columns)).collect()
    assert len(got) == 60 and len(set(got[0].__fields__)) == len(got[0].__fields__)
    for r in got:
        assert all(r[c] == f"{c}{r.doc_id}" for c in ("lang", "edge", "below", "from", "rank", "tied", "a.b")) and r.text == f"t{r.doc_id}" and r.law == "rows" and r.size == 8 + len(r.text)


def least_bytes(sizes, shards):
    """The fewest bytes that moves can take, over all choices of the shards that keep one row more."""
    from functools import cache

    least, more = divmod(sum(map(len, sizes.values())), shards)
    own = [sizes.get(j, []) for j in range(shards)]
    beyond = sum(sum(x) for j, x in sizes.items() if j >= shards)

    @cache
    def best(j, left):
        if j == shards:
            return float("inf") if left else 0
        ways = [(extra, sum(own[j][: max(0, len(own[j]) - least - extra)])) for extra in (0, 1) if extra <= left]
        return min(cost + best(j + 1, left - extra) for extra, cost in ways)

    return beyond + best(0, more)


def test_transfers_move_the_fewest_bytes():
    r = random.Random(4)
    cases = [({0: [8, 8, 8, 999, 999], 1: [100] * 5}, 3)]
    for _ in range(200):
        cases.append(({i: sorted(r.choice((r.randint(8, 20), r.randint(8, 900))) for _ in range(r.randint(0, 12))) for i in range(r.randint(1, 6))}, r.randint(1, 8)))
    for sizes, shards in cases:
        rows = {s: len(x) for s, x in sizes.items()}
        most = sharding.forced(rows, shards)
        blocks = sharding.transfers(rows, {s: sizes[s][n - 1] for s, n in most.items() if n}, shards)
        after = {j: rows.get(j, 0) for j in range(max(shards, *rows) + 1)}
        moved, given = 0, {}
        for s, low, high, j in blocks:
            assert s != j and low == given.get(s, 0) and high > low
            given[s] = high
            after[s] -= high - low
            after[j] += high - low
            moved += sum(sizes[s][low:high])
        counts = [after[j] for j in range(shards)]
        assert max(counts) - min(counts) <= 1 and all(after[j] == 0 for j in after if j >= shards)
        assert moved == least_bytes(sizes, shards) and len(blocks) <= len(rows) + shards


def test_rewrite_only_touched_shards(spark, tmp_path):
    table = spark.createDataFrame([(i, f"t{i}") for i in range(200)], "doc_id long, text string")
    sharded, numbers = sharding.resharded(table, shards=4, old=F.lit(0))
    sharding.rewrite(sharded, numbers, str(tmp_path / "out"))
    assert numbers == [0, 1, 2, 3] and sorted({x for r in sharded.filter("moved").collect() for x in (r.shard, r.old_shard)}) == numbers and spark.read.parquet(str(tmp_path / "out")).count() == 200
    uneven, moved = sharding.resharded(table, shards=3, old=F.when(F.col("doc_id") < 100, 0).when(F.col("doc_id") < 167, 1).otherwise(2), carry=("text",))
    assert moved == [0, 2]
    back = sharding.rewritten(uneven, moved, str(tmp_path / "two"), 3).collect()
    assert sorted((r.doc_id, r.text) for r in back) == [(i, f"t{i}") for i in range(200)]
    assert sorted(p.name for p in (tmp_path / "two").iterdir() if p.is_dir()) == ["shard=0", "shard=2"]
    for s in range(3):
        assert sorted(r.slot for r in back if r.shard == s) == list(range(sum(r.shard == s for r in back)))


def test_toxicity_held_out_and_misspelt(spark):
    r = random.Random(8)
    bad = ["grubling", "snorfwit", "mugglarse"]
    rows, labels = [], []
    for i in range(1500):
        text = prose(r.randint(20, 150), 1000 + i).split()
        toxic = i % 6 == 0
        if toxic:
            text.insert(r.randrange(len(text)), r.choice(bad))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    rows += [(5000, None), (5001, ""), (5002, prose(80, 77) + " snorfwitt"), (5003, "clean " * 3000 + "grubling")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    labelled = spark.createDataFrame([*labels, labels[0], (None, 1), (7, None)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.toxicity(docs, labelled).collect()}
    truth = dict(labels)
    held = [x for i, x in got.items() if i in truth and x.held_out]
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, x in got.items())
    assert np.mean([x.predicted == truth[x.doc_id] for x in held]) >= 0.97
    assert got[5000].predicted == got[5001].predicted == 0 and got[5002].predicted == 1 and got[5003].predicted == 1
    assert toxicity.toxicity(docs.limit(0), labelled).count() == 0
    assert {x.predicted for x in toxicity.toxicity(docs.limit(5), labelled.limit(0)).collect()} == {0}


def test_toxicity_scores_recomputed_word_by_word():
    """Document scores against a plain loop over windows, words and n-grams."""
    import xxhash

    def buckets(word):
        out = [xxhash.xxh3_64_intdigest(word, 0) % toxicity.BUCKETS]
        marked = f"<{word}>"
        for size in toxicity.GRAMS:
            for i in range(len(marked) - size + 1):
                total = size
                for c in marked[i : i + size]:
                    total = int(common.mix(np.array([(total * 0x100000001B3 + ord(c)) % 2**64], np.uint64))[0])
                out.append(total % toxicity.BUCKETS)
        return out

    draw = np.random.default_rng(4)
    model = toxicity.Model(draw.normal(0, 1, toxicity.BUCKETS), -0.3)
    texts = ["One two THREE", None, "", prose(40, 7), "é日本 a\tb\u00a0c", "x", prose(13, 8) + " grubling"]
    got = model.document_logits(toxicity.bags(pa.array(texts, pa.string())), len(texts))
    for text, z in zip(texts, got, strict=True):
        said = words((text or "").lower())
        windows = [said[i : i + toxicity.WINDOW] for i in range(0, len(said), toxicity.WINDOW)]
        logits = [np.mean([model.value[b] for w in window for b in buckets(w)]) + model.bias for window in windows]
        assert z == pytest.approx(max(logits) if logits else min(model.bias, 0.0), abs=1e-9)


def test_toxicity_ties_and_odd_tables(spark):
    rows = [(1, "bad word " * 30, 9), (1, "bad word " * 30, 9), (None, "bad word", 9), (2, None, 9), (3, "good text " * 4000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").withColumn("predicted", F.lit("clash")).withColumn("held_out", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (77, 1), (2, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 5 and len({r.score for r in got if r.doc_id == 1}) == 1 and all(0 <= r.score <= 1 for r in got)
    assert [r.predicted for r in got if r.doc_id == 2] == [0]


def quality_base(text):
    w = words(text)
    grams = {}
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i : i + 3]), []).append(i)
    cover = {j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover)


def test_quality_base_counts(spark, docs):
    extra = spark.createDataFrame([(900, "a b c a b c a b c", "en", "s", 1), (901, "x|y\nx|y\n \nx|y <&>\r\n", "en", "s", 1), (902, "q " * 5000, "en", "s", 1)], DOCS)
    table = docs.select(*[c.split()[0] for c in DOCS.split(", ")]).unionByName(extra).withColumn("kept", F.lit("clash"))
    texts = {r.doc_id: r.text for r in table.collect()}
    got = quality.quality_rules(table).collect()
    assert len(got) == table.count()
    for r in got:
        n = quality_base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])


def test_quality_line_limits(spark):
    own = lambda i: prose(30, i)
    rows = [(i, f"{own(i)}\nStock  Line of the host\n{own(i + 500)}", "a") for i in range(30)] + [(100, "\n".join(["Stock line of the host"] * 4 + [own(7), own(8)]), "a"), (101, f"{own(1)}\n{own(2)}\nstock line of the host", "b")]
    rows += [(200 + i, f"{own(4)}\n{own(5)}\ncopied text of many documents", "c") for i in range(40)] + [(300, f"{own(1)}\n{own(2)}", "c")]
    table = spark.createDataFrame([*rows, rows[0], *[rows[31]] * 15], "doc_id long, text string, source string").withColumn("n_chars", F.length("text")).withColumn("key", F.lit(1)).withColumn("host", F.lit("clash"))
    found = quality.quality_rules(table, line_documents=10).collect()
    got = {r.doc_id: r for r in found}
    assert len(found) == table.count() and got[0].n_removed == 5 and got[100].n_removed == 20 and got[101].n_removed == 0 and got[300].n_removed == 0
    assert got[200].n_removed == 65 and not got[200].kept  # copies are documents, rows that are equal are one
    kept = {r.doc_id: r for r in quality.clean(table, line_documents=10).collect()}
    assert kept[0].text == f"{own(0)}\n{own(500)}" and kept[0].n_chars == len(kept[0].text) and kept[101].text.endswith("host")
    assert quality.quality_rules(empty(spark)).count() == 0


def test_quality_limit_is_the_same_for_large_hosts(spark):
    """On a host of 12,000 documents a line in 21 of them goes and one in 20 stays, as on a small one."""
    line = lambda i: f"line {'of' if i % 2 else 'in'} document number {i} here"
    rows = spark.range(12_000).select(F.col("id").alias("doc_id"), F.lit("host").alias("source"), F.concat_ws(
        "\n", F.concat(F.lit("own words of text "), "id"), F.when(F.col("id") < 21, "a line that goes"), F.when((F.col("id") >= 10) & (F.col("id") < 30), "A line  that stays here"),
    ).alias("text"))
    small = spark.createDataFrame([(20_000 + i, "small", f"{line(i)}\na line that goes") for i in range(21)], "doc_id long, source string, text string")
    got = {r.doc_id: r.n_removed for r in quality.quality_rules(rows.unionByName(small)).collect()}
    assert got == {**dict.fromkeys(range(12_000), 0), **dict.fromkeys(range(21), 4), **dict.fromkeys(range(20_000, 20_021), 4)}


def test_token_counts_against_the_library(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    odd = ["<|endoftext|>a<|endoftext|>", " \n\n  x\u00a0\u2003y 123 it's IT'S", "日本語 text ᄑ \U0001e6c0\u10940", "  lead", "trail  ", "\x1c\x85", "é" * 70]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(odd, 500)), "doc_id long, text string")).withColumn("n_tokens", F.lit("clash"))
    texts = {r.doc_id: r.text or "" for r in table.collect()}
    got = token_counts.token_counts(table, queries.tokenizer_path()).collect()
    assert len(got) == table.count()
    for r in got:
        n = len(tokenizer.encode(texts[r.doc_id], add_special_tokens=False))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)
    for sent in (0, 40):  # all, or most, by the shuffled join
        some = {r.doc_id: r.n_tokens for r in token_counts.token_counts(table, queries.tokenizer_path(), sent=sent).collect()}
        assert some == {r.doc_id: r.n_tokens for r in got}
    assert token_counts.token_counts(empty(spark), queries.tokenizer_path()).count() == 0


def test_units_keep_pre_tokens_whole():
    """Cutting a text into units first gives the pre-tokens of the whole text, whatever white space it has."""
    from collections import Counter

    with open(queries.tokenizer_path(), encoding="utf-8") as file:
        cutter = token_counts.Cutter(file.read())
    r = random.Random(6)
    for _ in range(3000):
        text = "".join(r.choice([" ", " ", "\n", "\t", "\x1c", "\u00a0", "a", "b'", "'s", "9", "?!", "é", "\u2003"]) for _ in range(r.randint(0, 12)))
        units, special = cutter.units(text)
        got = Counter()
        for unit in units:
            got.update(cutter.pre_tokens(unit))
        assert special == 0 and got == Counter(cutter.pre_tokens(text)), repr(text)


def test_slices_and_words():
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(["a" * 10, None, "b", "", "c d"])], names=["id", "text"])
    assert pa.Table.from_batches(list(common.slices(iter([batch])))).num_rows == 5
    offsets, codes, distinct = common.words_of(pa.array([" a\tb a ", None, "", "\x0b", "é\u00a0x"]))
    assert offsets.tolist() == [0, 3, 3, 3, 3, 4] and [distinct[i].as_py() for i in codes] == ["a", "b", "a", "é\u00a0x"]
