"""Each corpus operator against brute force on small fixtures, with nulls, empty and long
texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import attribution, decontaminate, exact, html, linededup, lm, neardup, order, packing, shingles, tokens, toxicity
from quillon.llm.common import cut

DOCS = "doc_id long, text string, DOC_ID string, node string, band string"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], DOCS)


def prose(rng, n):
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()) + str(rng.randrange(30)) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for i in range(40):
        w = prose(rng, rng.randrange(3, 120))
        out.append((i, " ".join(w)))
        for c in range(rng.randrange(3)):
            v = list(w)
            for _ in range(rng.randrange(1 + len(v) // 15)):
                v[rng.randrange(len(v))] = "Other%d" % rng.randrange(99)
            out.append((100 + 10 * i + c, " ".join(v) + (" \n" if c else "")))
    hub = prose(rng, 150)
    for i in range(60):
        v = list(hub)
        for _ in range(i % 6):
            v[rng.randrange(len(v))] = "edit%d" % rng.randrange(9)
        out.append((1000 + i, " ".join(v)))
    w = prose(rng, 20000)
    out += [(2000, " ".join(w)), (2001, " ".join(w[:-3])), (2002, "a b c d e f g " * 500), (2003, "a b c d e f g " * 480)]
    w = prose(rng, 104)
    out += [(7, " ".join(w)), (7, " ".join(w[:40] + ["other"] + w[41:80] + ["other"] + w[81:])), (None, " ".join([*w, "z"])), (7, " ".join(w))]
    out += [(None, "lonely text"), (None, out[0][1]), (3000, None), (3001, ""), (3002, "  \n "), (3003, "one two"), (3004, "One  two"), (0, out[0][1])]
    return out


def bag(text, k=5):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split(" ")
    w = [x for y in w for x in __import__("re").split(r"[\x09-\x0d]+", y) if x]
    return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else Counter()


def similarity(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if a or b else 1.0


def test_neardup(spark, rows):
    got = neardup.near_duplicates(make(spark, rows)).collect()
    assert len(got) == len(rows)
    bags = [bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if bags[a] == bags[b] or similarity(bags[a], bags[b]) >= 0.8:
            parent[find(b)] = find(a)
    want = defaultdict(list)
    for i in range(len(rows)):
        want[find(i)].append(rows[i][0])
    expected = Counter()
    for v in want.values():
        ids = [x for x in v if x is not None]
        for x in v:
            expected[(x, min(ids, default=None), len(v))] += 1
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == expected
    assert sum(r.kept for r in got) == len(want)
    one = neardup.one_of_each(make(spark, rows))
    assert one.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert Counter(r[0] for r in one.collect()) == Counter(min((x for x in v if x is not None), default=None) for v in want.values())
    assert neardup.one_of_each(make(spark, [])).count() == 0
    assert neardup.near_duplicates(make(spark, [])).count() == 0


def test_neardup_within_large_bands(spark):
    """Documents around one template, 0.797 alike, of which 40 pairs are 0.804 alike."""
    template = [f"t{i}" for i in range(200)]
    docs = [(i, " ".join([*template, f"p{i // 2}" if i < 80 else f"q{i}", *[f"u{i}x{j}" for j in range(24)]])) for i in range(200)]
    assert similarity(bag(docs[0][1]), bag(docs[1][1])) >= 0.8 > similarity(bag(docs[1][1]), bag(docs[2][1]))
    got = {r.doc_id: (r.class_id, r.class_size) for r in neardup.near_duplicates(make(spark, docs)).collect()}
    assert got == {i: (i - i % 2, 2) if i < 80 else (i, 1) for i in range(200)}


def test_bagminhash_is_unbiased():
    rng = np.random.Generator(np.random.PCG64(1))
    s = rng.integers(1, 2**62, 40).astype(np.uint64)
    a, b = rng.integers(0, 9, 40), rng.integers(0, 9, 40)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    m, found = 512, []
    for salt in range(12):
        t = shingles.mix(s + np.uint64(salt))
        row = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
        sig = neardup.bagminhash(row, np.concatenate([t[a > 0], t[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, m)
        found.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(found) - true) < 4 * (true * (1 - true) / (12 * m)) ** 0.5


def test_exact(spark, rows):
    digests = [lambda t: F.unhex(F.sha2(t, 256)), lambda t: F.substring(F.unhex(F.sha2(t, 256)), 1, 1)]  # the second collides
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    for d in digests:
        got = exact.exact_dedup(make(spark, rows), digest=d, salts=3).collect()
        want = Counter((i, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        assert sum(r.kept for r in got) == len(groups)
    assert exact.exact_dedup(make(spark, [])).count() == 0


def test_decontamination(spark, rows):
    rng = random.Random(9)
    items = [(i, " ".join(prose(rng, n))) for i, n in enumerate([5, 9, 14, 30, 33, 64, 200])] + [(50, None), (51, ""), (52, "one two"), (None, rows[3][1])]
    docs = list(rows)
    for i, t in items[:7]:
        w = t.split()
        for pad in (0, 40, 5000):
            docs.append((5000 + 10 * i + pad % 7, " ".join(prose(rng, pad) + w + prose(rng, pad))))
        docs.append((6000 + i, " ".join(prose(rng, 30) + w[: len(w) * 3 // 4] + prose(rng, 30))))
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    want = Counter()
    for q, t in items:
        s = set(bag(t))
        for i, d in docs:
            share = len(s & set(bag(d)))
            if s and share >= 0.8 * len(s):
                want[(i, q, share, len(s))] += 1
    got = Counter((r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in decontaminate.contained_items(make(spark, docs), bench).collect())
    assert got == want
    small = decontaminate.blocks(iter([(i, t) for i, t in items if i is not None]), most=40)
    assert sum(len(b.ids) for b in small) == 8
    kept = decontaminate.decontaminate(make(spark, docs), bench)
    hit = {i for i, *_ in want}
    assert kept.columns == make(spark, []).columns and Counter(r[0] for r in kept.collect()) == Counter(i for i, _ in docs if i not in hit)
    assert decontaminate.contained_items(make(spark, []), bench).count() == decontaminate.contained_items(make(spark, docs), bench.limit(0)).count() == 0


def test_crf_marginals():
    rng = np.random.Generator(np.random.PCG64(2))
    lengths = np.array([1, 4, 6, 2])
    u, edge = rng.normal(size=13), rng.normal(size=(2, 2))
    p, _ = toxicity.marginals(u, edge, lengths)
    q, _ = toxicity.marginals_only(u, edge, lengths)
    at = 0
    for n in lengths:
        total, ones = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(u[at + i] * y[i] for i in range(n)) + sum(edge[y[i - 1], y[i]] for i in range(1, n)))
            total += w
            ones += w * np.array(y)
        assert np.allclose(p[at : at + n], ones / total) and np.allclose(q[at : at + n], ones / total)
        at += n


def test_toxicity(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(400):
        w = prose(rng, rng.randrange(5, 60))
        bad = i % 5 == 0
        if bad:
            w.insert(rng.randrange(len(w)), rng.choice(["vileword", "nastyx" + rng.choice("abcdefg")]))
        docs.append((i, ". ".join([" ".join(w[:9]), " ".join(w[9:])])))
        labels.append((i, int(bad), 5))
    lab = spark.createDataFrame([*labels, (None, 1, 1), (7, None, 1)], "doc_id long, toxic int, TEXT int")
    more = [(900, None), (901, ""), (902, "..."), (None, "a vileword here"), (903, "x " * 50000 + "vileword")]
    model = toxicity.learn(make(spark, docs), lab)
    got = {r.doc_id: r for r in toxicity.toxicity(make(spark, docs + more), model).collect()}
    held = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in held) for i, _ in docs)
    assert all(got[i].predicted == (i % 5 == 0) for i in held)
    assert got[900].score == got[901].score == got[902].score == 0 and got[None].predicted == got[903].predicted == 1
    assert [(s.start, s.end) for s in got[903].spans] == [(100000, 100008)]
    assert toxicity.toxicity(make(spark, []), model).count() == 0
    none = toxicity.learn(make(spark, []), lab)
    assert [r.predicted for r in toxicity.toxicity(make(spark, more), none).collect()] == [0] * 5


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab 'sé\n\t.,1 <|>endoftx"), max_size=40) | st.just("a<|endoftext|> b"))
def test_ids_are_those_of_tokenizers(text):
    e = tokens.encoder(tokens.default_path())
    assert e.ids(text) == e.exact(text)


def test_attribution(spark, rows):
    e = tokens.encoder(tokens.default_path())
    docs = [*rows, (7000, "a\n\nb  c\n"), (7001, "é\nß 日本\n\n\n"), (7002, "\n")]
    for rule in attribution.RULES:
        got = defaultdict(list)
        for r in attribution.token_counts(make(spark, docs[-12:]), tokens.default_path(), rule=rule).collect():
            got[r.doc_id].append(r)
        for i, text in docs[-12:]:
            if i is None:
                continue
            text = text or ""
            mine = sorted(got[i], key=lambda r: r.section)
            n = len(np.frombuffer(e.ids(text), "<u4"))
            assert sum(r.n_tokens for r in mine) == n == mine[0].doc_tokens
            assert "".join(text[r.start_char : r.end_char] for r in mine) == text
            assert len(mine) == max(1, len(text.splitlines(keepends=True))) or " " in text
    ends, bounds = np.array([2, 5, 6, 10]), np.array([0, 4, 7])
    assert attribution.attribute(ends, bounds, "start").tolist() == [0, 0, 1, 1]
    assert attribution.attribute(ends, bounds, "end").tolist() == [0, 1, 1, 2]
    assert attribution.attribute(ends, bounds, "most").tolist() == [0, 0, 1, 2]
    assert attribution.token_counts(make(spark, []), tokens.default_path()).count() == 0


def test_packing(spark, rows):
    e = tokens.encoder(tokens.default_path())
    size = 128
    got = packing.pack(make(spark, rows), tokens.default_path(), size=size, rounds=60).collect()
    want = Counter()
    for i, t in rows:
        ids = np.append(np.frombuffer(e.ids(t or ""), "<u4"), np.uint32(2)).astype("<u4")
        first = (len(ids) - 1) % size + 1
        for k, a in enumerate([0, *range(first, len(ids), size)]):
            piece = ids[a : first if not k else a + size]
            want[(i, k, a, len(piece), zlib.crc32(piece.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        end = 0
        for o, n in sorted(v):
            assert o == end
            end += n
        assert end <= size
    assert len(by) <= 1.02 * -(-sum(r.length for r in got) // size) + 1
    assert packing.pack(make(spark, []), tokens.default_path()).count() == 0


@settings(max_examples=12, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 9), min_size=1, max_size=6))
def test_packing_plan_holds_each_piece_once(histogram):
    made, used = packing.plan(histogram, 12, 10), Counter()
    for config, n in made:
        assert sum(x * k for x, k in config.items()) <= 12
        used.update({x: k * n for x, k in config.items()})
    assert used == Counter(histogram)
    assert packing.solve(histogram, 12, 60)[1] <= sum(n for _, n in made) + 1e-9


def fewest(pieces, size, bins=()):
    """Brute force: the least number of sequences."""
    if not pieces:
        return len(bins)
    x, rest, out = pieces[0], pieces[1:], len(bins) + len(pieces)
    for i in range(len(bins)):
        if bins[i] + x <= size and bins[i] not in bins[:i]:
            out = min(out, fewest(rest, size, (*bins[:i], bins[i] + x, *bins[i + 1 :])))
    return min(out, fewest(rest, size, (*bins, x)))


def test_packing_is_near_the_fewest():
    rng = random.Random(6)
    for _ in range(6):
        histogram = Counter(rng.randrange(1, 13) for _ in range(9))
        best = fewest(sorted(histogram.elements(), reverse=True), 12)
        bound = packing.solve(histogram, 12)[1]
        assert bound <= best + 1e-9
        assert best <= sum(n for _, n in packing.plan(histogram, 12)) <= best + 1


def test_packing_comes_from_the_program():
    """Many full pieces and few of each other length, as in long documents."""
    rng = random.Random(7)
    histogram = Counter([1024] * 3000 + [rng.randrange(1, 1024) for _ in range(3000)])
    least = -(-sum(x * n for x, n in histogram.items()) // 1024)
    solved, bound = packing.solve(histogram, 1024)
    assert bound >= 0.98 * least and sum(x for _, x in solved) <= 1.01 * bound
    left = Counter(histogram)
    of_program = sum(n for _, n in packing.from_program(left, 1024))
    rest = sum(n for _, n in packing.best_fit(left, 1024))
    assert of_program >= 0.95 * (of_program + rest) and of_program + rest <= 1.01 * least


def test_packing_of_lengths_that_leave_room():
    assert sum(n for _, n in packing.plan({600: 50, 500: 20, 424: 30}, 1024)) == 60  # 30 x 600+424, 20 x 600, 10 x 500+500


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "a" * 2_000_000], ids=["blanks", "lines", "letters"])
def test_very_long_runs(spark, text):
    """Through every operator that encodes."""
    ids = tokens.encoder(tokens.default_path()).exact(text)
    n = len(ids) // 4
    df = make(spark, [(1, text)])
    got = packing.pack(df, tokens.default_path()).collect()
    assert sum(r.length for r in got) == n + 1 and len({r.sequence_id for r in got}) == len(got) == -(-(n + 1) // 1024)
    counts = attribution.token_counts(df, tokens.default_path()).agg(F.sum("n_tokens"), F.max("doc_tokens")).first()
    assert tuple(counts) == (n, n)
    assert order.materialise(df, tokens.default_path()).agg(F.sum("n_sequences")).first()[0] == -(-(n + 1) // order.LENGTH)


def test_order(spark, rows, tmp_path):
    for n in (1, 2, 3, 17, 1000):
        assert sorted(order.feistel(np.arange(n), n, 42).tolist()) == list(range(n))
    path = str(tmp_path / "shards")
    e = tokens.encoder(tokens.default_path())
    order.write_shards(order.materialise(make(spark, rows), tokens.default_path(), length=64, per_shard=16), path)
    got = order.read_from(spark, path).orderBy("slot").collect()
    want = Counter()
    for i, t in rows:
        ids = [*np.frombuffer(e.ids(t or ""), "<u4").tolist(), order.PAD]
        for k in range(0, len(ids), 64):
            part = ids[k : k + 64]
            want[(i, k // 64, np.array(part + [order.PAD] * (64 - len(part)), "<u2").tobytes())] += 1
    assert [r.slot for r in got] == list(range(sum(want.values())))
    assert Counter((r.doc_id, r.piece, bytes(r.ids)) for r in got) == want
    assert [r.slot for r in order.read_from(spark, path, 33).orderBy("slot").collect()] == list(range(33, len(got)))
    shard = next((tmp_path / "shards/data/shard=2").glob("part-*"))
    with open(shard, "rb") as f:  # a reader that resumes needs no Spark
        f.seek(3 * 128)
        assert f.read(128) == bytes(got[35].ids)
    assert order.materialise(make(spark, []), tokens.default_path()).count() == 0


def test_order_does_not_depend_on_splits(spark, rows, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    docs = make(spark, rows).toDF("doc_id", "text", "x", "y", "z")
    docs.coalesce(1).write.option("parquet.block.size", 20000).option("parquet.page.size.row.check.min", 1).parquet(one)
    docs.repartition(5).write.parquet(two)
    found = {}
    for path, in_order, most in ((one, True, "128m"), (one, True, "8k"), (two, False, "128m"), (two, False, "8k"), (one, False, "8k")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        docs = spark.read.parquet(path)
        got = order.materialise(docs, tokens.default_path(), length=64, per_shard=16, in_file_order=in_order).orderBy("shard")
        found.setdefault(in_order, []).append([bytes(r.payload) for r in got.collect()])
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert all(x == v[0] for v in found.values() for x in v)


def test_best_stretch():
    rng = random.Random(4)
    for _ in range(200):
        s = [rng.choice([-2.0, -1.0, 0.5, 1.0]) for _ in range(rng.randrange(12))]
        a, b = html.best_stretch(s)
        best = max((sum(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1)), default=0)
        assert sum(s[a:b]) == max(0, best)


def test_html(spark):
    art = "<article><h1>Head &amp; one</h1><p>Some  <b>bo</b>ld\nwords here, x&lt;y.<br>Next</p><div class='ad'>Buy now</div><p>More words and more.</p></article>"
    page = "<html><head><title>T</title><style>p{}</style><script>var a='<p>no</p>';</script></head><body><nav><ul><li><a href=x>Menu</a></li><li><a>Two</a></li></ul></nav>" + art + "<div class=comments><p>I think so too</p></div><footer>&copy; me</footer></body></html>"
    pages = [(i, f"u{i}", page) for i in range(5)] + [(9, None, None), (None, "u", ""), (10, "u", "<p>plain"), (11, "u", "no tags at all"), (12, "u", "<<<>>>&&<p"), (13, "u", "<article><p>" + "word " * 50000)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, HTML string")
    got = {(r.page_id, r.url): r for r in html.extract_text(df, html.learn(df)).collect()}
    want = "Head & one\n\nSome bold words here, x<y. Next\n\nMore words and more."
    assert all(got[(i, f"u{i}")].text == want for i in range(5)) and got[(0, "u0")].n_chars == len(want)
    assert got[(9, None)].text == got[(None, "u")].text == "" and got[(10, "u")].text == "plain" and got[(11, "u")].text == "no tags at all"
    assert got[(13, "u")].n_chars == 249999
    assert html.extract_text(df.limit(0), html.learn(df.limit(0))).count() == 0


def test_html_of_several_layouts(spark):
    """Labelled pages of one layout; pages of others, where nothing of the article may go."""
    site = "<html><body><nav><ul><li>Home<li>About us</ul></nav><div class='promo big'>Best price today</div><article><h1>Title</h1><p>%s</article><div class='talk'><p>I agree with this</div><footer>All rights</footer></body></html>"
    rng = random.Random(3)
    df = spark.createDataFrame([(i, "u", site % " ".join(prose(rng, 60))) for i in range(30)], "page_id long, url string, html string")
    learned = html.learn(df)
    assert {"c:promo", "c:talk", "e:nav", "e:footer"} <= learned.bad and not {"e:li", "e:ul", "e:p", "e:div", "e:article"} & learned.bad
    text = lambda body: html.extract(f"<html><body>{body}</body></html>", learned)
    long = " ".join(prose(rng, 40))
    assert text(f"<article><p>{long}<ul><li>one thing<li>another thing</ul><table><tr><td>a cell<td>b cell<tr><td>c cell</table><p>{long}</article>") == "\n\n".join([long, "one thing", "another thing", "a cell", "b cell", "c cell", long])
    assert text(f"<article><p class='promo'>Buy now<div>{long}</div></article>") == long
    assert text(f"<section class='related-work'><p>{long}</section>") == long
    assert text(f"<div class='post-header-menu-less'>{long}</div>") == long
    assert text(f"<header>Site name</header><main><header><h1>The title</h1></header><p>{long}</main><aside>Other news</aside>") == f"The title\n\n{long}"
    assert text(f"<form>Your name</form><div id=x><b><p>{long}</b> and <i>m</i>ore</div><div class='comments'>No!</div>") == f"{long} and more"
    assert html.extract("<nav>Menu</nav><p>Text", html.weights(iter(()))) == "Text"


def test_lm(spark, rows):
    got = lm.lm_scores(make(spark, rows), bucket_bytes=30000, segment_bytes=40000)
    assert got.count() == len(rows)

    def toks(t):
        return [*("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()), None]

    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    train = Counter(x for i, t in rows if not held(i) for x in toks(t))
    n, v = sum(train.values()), len(train)
    want = defaultdict(list)
    for i, t in rows:
        want[i].append((len(toks(t)), sum(x in train for x in toks(t)), sum(log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in toks(t))))
    for r in got.collect():
        assert r.held_out == held(r.doc_id) and r.train_tokens == n
        assert any((r.n_tokens, r.n_known) == w[:2] and abs(r.base_score - w[2]) < 1e-6 * abs(w[2]) for w in want[r.doc_id])
        assert r.score <= 0
    # scores, by counts in dictionaries; the filter's rare false positives aside
    streams = {k: [None, *toks(t)] for k, (_, t) in enumerate(rows)}
    two = Counter(p for k, (i, _) in enumerate(rows) if not held(i) for p in itertools.pairwise(streams[k]) if p[0] is not None)
    two.update((("start", streams[k][1]) for k, (i, _) in enumerate(rows) if not held(i)))
    starts = sum(not held(i) for i, _ in rows)

    def parts(k):
        w = streams[k]
        c = np.array([train[x] for x in w[1:]])
        c1 = np.array([starts, *(train[x] for x in w[1:-1])])
        q = np.array([two[("start" if j == 0 else w[j], w[j + 1])] for j in range(len(w) - 1)])
        return c, c1, np.where(q > 0, lm.GRID[np.maximum(lm.level(q), 1) - 1], 0)

    weight = lm.fitted(sum(lm.cells(*parts(k), n, v) for k, (i, _) in enumerate(rows) if not held(i)))
    scores = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        c, c1, q = parts(k)
        w = np.where(c1 > 0, weight[np.minimum(lm.level(c1), lm.CLASSES - 1)], 0)
        scores[i].append(float(np.log10((1 - w) * (c + 0.5) / (n + 0.5 * (v + 1)) + w * np.minimum(q, c1) / np.maximum(c1, 1)).sum()))
    off = [min(abs(r.score - x) / abs(x) for x in scores[r.doc_id]) for r in got.collect()]
    assert max(off) < 0.05 and np.median(off) < 5e-3  # a few unseen bigrams in a thousand pass the filter
    s = got.filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert s[0] > s[1]
    assert lm.lm_scores(make(spark, [])).count() == 0


def test_lm_probes_a_large_filter_by_segment(spark, rows):
    found = []
    for most in (lm.MAX_BYTES, 64):
        got = lm.lm_scores(make(spark, rows), bucket_bytes=30000, segment_bytes=40000, max_bytes=most).collect()
        found.append(sorted((str(r.doc_id), r.n_tokens, round(r.score, 6)) for r in got))
    assert found[0] == found[1]


def test_filter_counts():
    rng = np.random.Generator(np.random.PCG64(8))
    h, n = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64)), None
    n = rng.geometric(0.3, len(h))
    f = lm.Filter([lm.Filter.build(h[h % np.uint64(3) == s], n[h % np.uint64(3) == s], 1 << 20) for s in range(3)])
    got = f.counts(h)
    want = lm.GRID[lm.level(n) - 1]
    assert (got >= want).all() and (got == want).mean() > 0.98
    other = rng.integers(0, 2**63, 5000).astype(np.uint64)
    assert (f.counts(other) == 0).mean() > 0.98


def one_edit(a, b):
    if a == b:
        return True
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_line_dedup(spark):
    rng = random.Random(11)
    base = [prose(rng, rng.randrange(1, 14)) for _ in range(25)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            w = list(rng.choice(base))
            for _ in range(rng.randrange(3)):
                k = rng.randrange(len(w) + 1)
                w[k : k + rng.randrange(2)] = [rng.choice("pqrs")] * rng.randrange(2)
            lines.append("  ".join(w) if rng.random() < 0.1 else " ".join(w))
        docs.append((i, "\n".join(lines)))
    docs += [(None, "a null id line here now\n" + " ".join(base[0])), (90, None), (91, ""), (92, "\n\n \n"), (93, "w " * 3000), (94, "w " * 2999 + "v")]
    places = sorted(((-1 if i is None else i, no, line) for i, t in docs for no, line in enumerate((t or "").split("\n")) if line.split()), key=lambda x: x[:2])
    want = defaultdict(list)
    for k, (i, no, line) in enumerate(places):
        w = line.split()
        for _, _, other in places[:k]:
            v = other.split()
            if line == other or (min(len(w), len(v)) >= linededup.LEAST_WORDS and one_edit(w, v)):
                want[i].append(no)
                break
    df = make(spark, docs)
    removed = linededup.line_dedup(df)
    assert {(-1 if r.doc_id is None else r.doc_id): list(r.removed) for r in removed.collect()} == dict(want)
    out = linededup.without_lines(df, cut(removed, "test"))
    assert out.columns == df.columns
    got = {r[0]: r[1] for r in out.collect()}
    for i, t in docs:
        assert got[i] == (None if t is None else "\n".join(x for no, x in enumerate(t.split("\n")) if no not in want[-1 if i is None else i]))
    assert linededup.line_dedup(make(spark, [])).count() == 0
