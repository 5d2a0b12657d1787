"""Operators against plain versions of themselves, and the cases that broke or slowed them."""

import hashlib
import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import chat, html_extract, html_training, mixing, sharding, simhash, suffix_dedup, tokens, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s" + "abc"[(i or 0) % 3], 1) for i, t in rows], DOCS)


def prose(seed, n, vocabulary=3000):
    return [f"w{x}" for x in np.random.default_rng(seed).integers(0, vocabulary, n)]


def edited(words, seed, n):
    """A copy in which n words are replaced."""
    r = np.random.default_rng(seed)
    out = list(words)
    for k in r.choice(len(out), n, replace=False):
        out[k] = f"x{r.integers(10**6)}"
    return out


def jaccard(a, b, width=5):
    sets = [{tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set() for w in (a, b)]
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1]))


def test_near_duplicate_stage_against_jaccard(spark):
    texts = {}
    for g in range(8):
        base = prose(g, 220)
        texts[10 * g] = base
        for k, n in enumerate((1, 2, 4, 12, 40), 1):
            texts[10 * g + k] = edited(base, 100 * g + k, n)
    kept = {r.doc_id for r in simhash.one_of_each(frame(spark, [(i, " ".join(w)) for i, w in texts.items()])).collect()}
    classes, joined = simhash.near_texts(frame(spark, [(i, " ".join(w)) for i, w in texts.items()]))
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(texts, 2):
        if jaccard(texts[a], texts[b]) >= 0.8:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    groups = {i: root(i) for i in texts}
    sure = {i for i in texts if all(not 0.72 < jaccard(texts[i], texts[j]) < 0.88 for j in texts if j != i)}
    assert {i for i in sure if groups[i] == i} <= kept and not {i for i in sure if groups[i] != i} & kept
    assert classes.count() == len(texts) and joined.count() >= 16


def test_near_duplicate_stage_keeps_what_differs(spark):
    long = " ".join(prose(1, 300))
    rows = [(1, long), (1, "another text under the same id"), (2, long.upper()), (3, " " + long.replace(" ", "\n\t ")), (None, "lost"), (None, "lost"), (4, None), (5, ""), (6, "one"), (7, "two"), (7, "two")]
    kept = simhash.one_of_each(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(1, long), (1, rows[1][1]), (0, "lost"), (4, ""), (6, "one"), (7, "two")])
    assert simhash.one_of_each(frame(spark, rows).where("doc_id = 99")).count() == 0


def test_wide_pairs_skip_nothing():
    r = np.random.default_rng(4)
    base = r.integers(0, 2**64, (400, simhash.WIDE), np.uint64)
    near = base[:200] ^ (np.uint64(1) << r.integers(0, 64, (200, simhash.WIDE)).astype(np.uint64))
    fp = np.concatenate([base, near])
    size = np.concatenate([r.integers(1, 300, 400), r.integers(1, 300, 200)])
    all_ = np.arange(len(fp))
    got = {(min(p, q), max(p, q)) for x, y in simhash.wide_pairs(size, fp, all_, all_, True, 0.8) for p, q in zip(x.tolist(), y.tolist())}
    fits = lambda i, j: min(size[i], size[j]) >= 0.8 * max(size[i], size[j])
    assert got == {(i, 400 + i) for i in range(200) if fits(i, 400 + i)}


def test_fingerprints_by_hand(spark):
    from xxhash import xxh64_intdigest

    def by_hand(text):
        words = [w for w in text.translate({c: c + 32 for c in range(65, 91)}).replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
        if not words:
            return 0
        shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or [" ".join(words)]
        h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    texts = ["", " \n", "One", "one two THREE", "É È a b c\x0bd", " ".join(prose(3, 90)), "a b c d a b c d a b c d", "x y z w v"]
    got = simhash.near_duplicates(frame(spark, list(enumerate(texts))))
    assert {r.doc_id: r.fingerprint for r in got.collect()} == {i: f"{by_hand(t):016x}" for i, t in enumerate(texts)}


def test_shards_against_a_plain_tree(spark):
    docs = frame(spark, [(i, "x" * (i * 37 % 500)) for i in range(600)])
    rows = [r.asDict() for r in sharding.measured(docs).collect()]
    span = sharding.COORD + sharding.TIE - sharding.BITS * sharding.PASSES
    where = {}

    def split(part, node, leaves):
        if leaves == 1:
            where.update({r["doc_id"]: node for r in part})
            return
        width = [max(r[x] for r in part) - min(r[x] for r in part) for x in ("x0", "x1", "x2")]
        axis = width.index(max(width))
        key = lambda r: ((r[f"x{axis}"] << sharding.TIE) + r["tie"]) >> span
        want, below, cut = sum(r["size"] for r in part) * (leaves // 2) / leaves, 0, None
        for b, g in itertools.groupby(sorted(part, key=key), key):
            n = sum(r["size"] for r in g)
            if below <= want:
                cut = b + (below + n - want < want - below)
            below += n
        split([r for r in part if key(r) < cut], node, leaves // 2)
        split([r for r in part if key(r) >= cut], node + leaves // 2, leaves - leaves // 2)

    split(rows, 0, 7)
    assert {r.doc_id: r.shard for r in sharding.kd_shards(docs, 7).collect()} == where


def test_mixture_against_a_plain_one(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 200)
    rows = [(i, "w " * (5 + i * 13 % 40)) for i in range(90)] + [(200 + 3 * k, "v " * 60) for k in range(30)]
    docs = frame(spark, rows)
    md5 = lambda *p: int(hashlib.md5("|".join(map(str, p)).encode()).hexdigest()[:15], 16)  # noqa: E731, S324
    source = {i: "s" + "abc"[i % 3] for i, _ in rows}
    size = {i: len(t.split()) for i, t in rows}
    total = {s: sum(size[i] for i in size if source[i] == s) for s in "sa sb sc".split()}
    everything = sum(total.values())
    budget = int(everything * 0.7)
    a = mixing.exponent(spark.createDataFrame(list(total.items()), "source string, tokens long"), budget, 0.999, 2.0)
    w = {s: (n / everything) ** a for s, n in total.items()}
    want = []
    for s, n in total.items():
        quota = round(w[s] / sum(w.values()) * mixing.UNIT) * budget // mixing.UNIT
        passes, rest = divmod(quota, n)
        n_blocks = max(1, -(-n // mixing.BLOCK_TOKENS))
        mine = [i for i in size if source[i] == s]
        blocks = {b: [i for i in mine if md5(0, i) % n_blocks == b] for b in {md5(0, i) % n_blocks for i in mine}}
        taken, left = [], rest
        for b in sorted(blocks, key=lambda b: (md5(0, s, passes, b), b)):
            whole = sum(size[i] for i in blocks[b])
            if left <= 0:
                break
            if whole <= left:
                taken, left = taken + blocks[b], left - whole
                continue
            for i in sorted(blocks[b], key=lambda i: md5(0, i)):
                if size[i] <= left:
                    taken.append(i)
                    left -= size[i]
            break
        want += mine * passes + taken
    got = mixing.mixture(docs, budget_share=0.7, target_entropy=0.999, max_repeat=2.0)
    assert sorted(r.doc_id for r in got.collect()) == sorted(want)


def test_machine_scores_every_pair():
    r = np.random.default_rng(2)
    words = [f"word{k}" for k in range(12)]
    ids = np.unique(np.concatenate([toxicity.terms(w) for w in words[:8]]))
    m = toxicity.Machine(ids, -0.3, r.normal(size=len(ids)), r.normal(size=(len(ids), 3)))
    texts = [" ".join(r.choice(words, r.integers(1, 12))) for _ in range(40)] + ["", "word1 " * 500, "WORD1 Word2!"]
    for t, fast in zip(texts, toxicity.Scorer(m).scores(texts)):
        at = [k for k, h in enumerate(ids) if h in set(toxicity.terms(t).tolist())]
        z = m.bias + sum(m.weights[k] for k in at) + sum(float(m.factors[i] @ m.factors[j]) for i, j in itertools.combinations(at, 2))
        assert abs(m.score(t) - 1 / (1 + np.exp(-z))) < 1e-9 and abs(fast - m.score(t)) < 1e-9


def test_a_repeated_id_is_one_example(spark):
    rows = [(k, f"bad thing number {k}" if k % 2 else f"good thing number {k}") for k in range(1, 80)]
    docs = frame(spark, rows + [(1, f"another text {k}") for k in range(50)])
    labels = spark.createDataFrame([(k, 1, k % 2) for k, _ in rows], "doc_id long, quality int, toxic int")
    a, b = toxicity.train(docs, labels), toxicity.train(docs.repartition(3), labels)
    assert (a.ids == b.ids).all() and np.allclose(a.weights, b.weights)


def test_viterbi_against_all_paths():
    model = html_extract.fitted()
    for page, truth in html_training.labelled_pages(40, seed=5):
        blocks = html_extract.blocks_of(page)[:9]

        def weight(path, blocks=blocks):
            z = model.begin if path[0] else 0.0
            for n, (b, s) in enumerate(zip(blocks, path)):
                z += sum(model.weights.get(f, 0.0) for f in b.features) if s else 0.0
                z += model.change[path[n - 1]][s] if n else 0.0
            return z

        if blocks:
            best = max(itertools.product((0, 1), repeat=len(blocks)), key=weight)
            assert abs(weight(best) - weight([int(x) for x in model.decode(blocks)])) < 1e-9
        assert truth is not None


@pytest.mark.parametrize("piece", ["<div class=x ", '<a "> x ', "<a \"'> x ", "<svg> a ", "<div>", "<ul><li>x", "<!-- ", "</section>x", "<p>x<script>"])
def test_broken_pages_take_linear_time(piece):
    page = piece * (5_000_000 // len(piece) // 8)
    began = time.monotonic()
    html_extract.blocks_of(page)
    assert time.monotonic() - began < 20


def test_unclosed_drawings_end_no_page():
    texts = lambda page: [b.text for b in html_extract.blocks_of(page)]
    assert texts("<p>a<svg><p>b") == ["a", "b"] and texts("<p>a<svg>x</svg><p>b") == ["a", "b"]
    assert texts("<p>a <math>x</math> c<p>b") == ["a", "x", "c", "b"] and texts("<p>a<script>x<p>b") == ["a"]
    assert texts('<p title="a > b">c</p>') == ["c"] and texts("a < b <3") == ["a < b <3"]


def test_a_long_conversation(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(200)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"tree": F.lit("x"), "node": F.lit(3), "score": F.lit(9.0)})
    out = chat.formatted(chat.reply_chains(d)).select("n_turns", chat.loss_text().alias("loss")).collect()
    assert [(r.n_turns, r.loss) for r in out] == [(200, "".join(f"t{k}" for k in range(1, 200, 2)))]
    kind = "tree string, node long, parent long, score double, role string, text string"
    with pytest.raises(ValueError, match="repeated"):
        chat.paths(spark.createDataFrame([("t", 1, None, 0.0, "u", "x"), ("t", 1, None, 0.0, "u", "y")], kind))


def test_repeats_are_flagged(spark):
    shared = "s" * 25 + "".join(chr(97 + k * 7 % 26) for k in range(60))
    got = suffix_dedup.without_repeats(frame(spark, [(1, "a" + shared), (2, "b" + shared), (3, "nothing of the kind stands in here at all, it is new"), (4, None)]), 40)
    assert {r.doc_id: (r.repeats, r.n_removed > 0) for r in got.collect()} == {1: (1, True), 2: (1, True), 3: (0, False), 4: (0, False)}
    with pytest.raises(ValueError):
        suffix_dedup.without_repeats(frame(spark, []), 5000)


def test_vocabularies_are_told_apart(spark):
    a = [(f"p{k}", float(-k)) for k in range(500)] + [(c, -900.0) for c in "p0123456789"]
    b = [*a[:1], ("p1", -499.0), *a[2:]]
    texts = [("p1",)] * 3
    d = spark.createDataFrame([(k, t[0]) for k, t in enumerate(texts)], "doc_id long, text string")
    score = lambda v: {r.score for r in d.mapInArrow(tokens._counted(v), "doc_id long, n_tokens long, score double").collect()}
    assert score(a) != score(b)


def test_a_repeated_id_joins_no_groups(spark):
    a, b = " ".join(prose(1, 60)), " ".join(prose(2, 60))
    got = simhash.near_duplicates(frame(spark, [(5, a), (7, a), (5, b), (9, b), (3, b)])).collect()
    by = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    assert sorted(by.values()) == [3, 3, 3, 5, 5] and len(set(r.fingerprint for r in got)) == 2
