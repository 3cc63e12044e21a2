"""The pipeline on a small folder of tables, stage by stage, against plain Python."""

import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from quillon.llm import attribution, tokens

from .test_ops import bag, make, prose, similarity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, folder, docs, labels, items):
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in docs], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


@pytest.fixture(scope="module")
def case():
    rng = random.Random(21)
    docs, labels = [], []
    for i in range(160):
        w = prose(rng, rng.randrange(30, 60))
        if i % 5 == 0:
            w.insert(rng.randrange(len(w)), "vileword")
        docs.append((i, ". ".join([" ".join(w[:15]), " ".join(w[15:])])))
        labels.append((i, 1, int(i % 5 == 0)))
    w = prose(rng, 100)
    item = prose(rng, 30)
    docs += [(300, " ".join(w)), (301, " ".join([*w[:50], "changed", *w[51:]])), (300, " ".join(w)), (None, " ".join([*w, "more"])), (302, docs[1][1]), (303, " ".join(prose(rng, 60)) + " " + " ".join(item)), (304, None), (305, ""), (306, " \n "), (None, "only a text without an id here"), (307, "a line that comes again here\nown line of this one now\na line that comes again here")]
    return docs, labels, [(1, " ".join(item)), (2, None), (None, "")]


def test_stages(spark, case, tmp_path):
    docs, labels, items = case
    write(spark, tmp_path, docs, labels, items)
    at, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        if name != "packing":
            assert out.columns == at.columns
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = at.collect()
    toxic = {i for i, _ in docs if i is not None and i < 160 and i % 5 == 0}
    assert Counter((r.doc_id, r.text) for r in seen["toxicity"]) == Counter((i, t) for i, t in docs if i not in toxic)
    lines = {}
    for r in seen["line_dedup"]:
        lines[r.doc_id, r.text] = r.n_chars
        assert r.n_chars == (None if r.text is None else len(r.text))
    assert len(seen["line_dedup"]) == len(seen["toxicity"])
    assert lines[307, "a line that comes again here\nown line of this one now"]
    # one document of each component of similar ones stays
    rows = [(r.doc_id, r.text) for r in seen["line_dedup"]]
    parent = list(range(len(rows)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    bags = [bag(t) for _, t in rows]
    for a in range(len(rows)):
        for b in range(a):
            if bags[a] == bags[b] or similarity(bags[a], bags[b]) >= 0.8:
                parent[find(a)] = find(b)
    classes = defaultdict(list)
    for x in range(len(rows)):
        classes[find(x)].append(rows[x][0])
    least = Counter(min((i for i in v if i is not None), default=None) for v in classes.values())
    assert Counter(r.doc_id for r in seen["near_dedup"]) == least
    assert Counter(r.doc_id for r in seen["decontamination"]) == least - Counter([303])
    # every document that is left is packed once, without holes
    enc = tokens.encoder(tokens.default_path())
    want = Counter((r.doc_id, len(enc.ids(r.text or "")) // 4 + 1) for r in seen["decontamination"])
    assert Counter((r.doc_id, r.length) for r in seen["packing"]) == want
    by = defaultdict(list)
    for r in seen["packing"]:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(v), sorted(v)[1:])) and sum(n for _, n in v) <= 1024


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_attribution_counts_each_section(spark, case):
    """Tokens of each line by a loop over the offsets that tokenizers gives."""
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(tokens.default_path())
    texts = [(i, t) for i, t in enumerate([*(t for _, t in case[0][:20]), "a\n\n\nb  c \n d", "é\nß x\n", "tie\nab", "", None, "\n", "word " * 20000 + "\nlast"])]
    got = {(r.doc_id, r.section): (r.n_tokens, r.n_crossing) for r in attribution.token_counts(make(spark, texts), tokens.default_path(), rule="start").collect()}
    for i, t in texts:
        t = t or ""
        ends = [k + 1 for k, c in enumerate(t) if c == "\n"]
        bounds = [0, *[e for e in ends if e < len(t)]] if t else [0]
        section = lambda p: max(k for k, b in enumerate(bounds) if b <= p)
        counts, crossing = Counter(), Counter()
        for a, b in exact.encode(t, add_special_tokens=False).offsets:
            counts[section(a)] += 1
            crossing[section(a)] += section(b - 1) > section(a)
        if t.isascii():  # a token may hold a part of another character
            assert {k: v for (d, k), v in got.items() if d == i} == {k: (counts[k], crossing[k]) for k in range(len(bounds))}
        assert sum(n for (d, _), (n, _) in got.items() if d == i) == len(exact.encode(t, add_special_tokens=False).ids)
